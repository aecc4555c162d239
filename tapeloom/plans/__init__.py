"""Registered queries by family."""


def MODULES():
    import importlib
    import pkgutil

    names = sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.startswith("on_"))
    return [importlib.import_module(f"tapeloom.plans.{n}") for n in names]

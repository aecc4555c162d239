"""Registered queries: a Spark plan, its output columns, and an independent SQL text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.plans import relations
from tapeloom.plans.relations import Tables

# Just under one half: exact decimal ties round the same way in every engine.
NUDGE = 0.49997


def _parse(out: str) -> list[tuple[str, str]]:
    pairs = []
    for item in out.split():
        name, _, kind = item.partition(":")
        pairs.append((name, kind))
    return pairs


@dataclass(frozen=True)
class Query:
    """``out`` lists the columns: ``name`` as is, ``name:l`` bigint, ``name:b`` boolean, ``name:s`` text,
    ``name:4`` double rounded to 4 places."""

    key: str
    plan: Callable[[Tables], DataFrame]
    out: str
    sql: str | None = None

    def run(self, spark, sf_dir: str) -> DataFrame:
        df = self.plan(Tables(spark, sf_dir))
        cols = []
        for name, kind in _parse(self.out):
            c = F.col(name)
            if kind == "l":
                c = c.cast("bigint")
            elif kind == "b":
                c = c.cast("boolean")
            elif kind == "s":
                c = c.cast("string")
            elif kind:
                scale = float(10 ** int(kind))
                c = F.floor(F.nanvl(c.cast("double"), F.lit(None).cast("double")) * scale + NUDGE) / scale
            cols.append(c.alias(name))
        return df.select(*cols)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        cols = []
        for name, kind in _parse(self.out):
            if kind == "l":
                cols.append(f"CAST({name} AS BIGINT) AS {name}")
            elif kind == "b":
                cols.append(f"CAST({name} AS BOOLEAN) AS {name}")
            elif kind == "s":
                cols.append(f"CAST({name} AS VARCHAR) AS {name}")
            elif kind:
                x, scale = f"CAST({name} AS DOUBLE)", f"1e{kind}"
                cols.append(f"CASE WHEN isnan({x}) THEN NULL ELSE floor({x} * {scale} + {NUDGE}) / {scale} END AS {name}")
            else:
                cols.append(name)
        ctes, body = relations.with_views(self.sql)
        return f"WITH {ctes}q_body AS (\n{body}\n)\nSELECT {', '.join(cols)} FROM q_body"


def all_queries() -> dict[str, Query]:
    from tapeloom.plans import MODULES

    found: dict[str, Query] = {}
    for mod in MODULES():
        for q in mod.QUERIES:
            assert q.key not in found, q.key
            found[q.key] = q
    return found

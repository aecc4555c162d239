"""Pieces of SQL text shared by the comparison queries."""

P = "PARTITION BY symbol ORDER BY ts"


def frame(n: int) -> str:
    return f"({P} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(agg: str, x: str, n: int) -> str:
    """``agg(x)`` over n rows, null until n values are present."""
    return f"CASE WHEN count({x}) OVER {frame(n)} >= {n} THEN {agg}({x}) OVER {frame(n)} END"


def lagged(x: str = "close", k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({P})"


RET = f"SELECT symbol, ts, open, high, low, close, volume, close / {lagged()} - 1 AS r, ln(close / {lagged()}) AS lr, row_number() OVER ({P}) AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM bars"


def ewm_list(xs: str, alpha: float) -> str:
    """adjust=True weighted mean of a list, newest last."""
    q = repr(1 - alpha)
    return (
        f"list_sum(list_transform({xs}, lambda x, i: x * pow({q}, len({xs}) - i))) / "
        f"list_sum(list_transform({xs}, lambda x, i: pow({q}, len({xs}) - i)))"
    )


def phi(x: str) -> str:
    """Normal distribution function by the series 1/2 + pdf(x) * (x + x^3/3 + x^5/15 + ...)."""
    series = (
        f"list_sum(list_transform(range(0, 130), lambda k: exp((2 * k + 1) * ln(greatest(abs({x}), 1e-300)) "
        f"- (lgamma(2e0 * k + 2) - k * ln(2e0) - lgamma(k + 1e0)) - ({x}) * ({x}) / 2)))"
    )
    return f"(CASE WHEN {x} > 8.5 THEN 1e0 WHEN {x} < -8.5 THEN 0e0 ELSE 0.5e0 + sign({x}) * {series} / sqrt(2 * pi()) END)"

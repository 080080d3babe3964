"""Mathematical column expressions that Spark has no function for."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of Acklam's rational approximation of the inverse normal distribution.
ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
ACKLAM_LOW = 0.02425


def _horner(x: str, coefficients: tuple) -> str:
    text = f"{coefficients[0]:.17e}"
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c:.17e})"
    return text


def inverse_normal_sql(p: str) -> str:
    """SQL text (Spark and DuckDB) of the standard normal quantile of the expression ``p`` in (0, 1)."""
    low = f"sqrt(-2e0 * ln({p}))"
    high = f"sqrt(-2e0 * ln(1e0 - {p}))"
    mid = f"({p} - 0.5e0)"
    square = f"({mid} * {mid})"

    def tail(q: str) -> str:
        return f"{_horner(q, ACKLAM_C)} / ({_horner(q, ACKLAM_D)} * {q} + 1e0)"

    centre = f"{_horner(square, ACKLAM_A)} * {mid} / ({_horner(square, ACKLAM_B)} * {square} + 1e0)"
    return f"CASE WHEN {p} < {ACKLAM_LOW!r} THEN {tail(low)} WHEN {p} > {1 - ACKLAM_LOW!r} THEN -({tail(high)}) ELSE {centre} END"


def inverse_normal(p: str) -> Column:
    """The standard normal quantile of column ``p``; null outside (0, 1)."""
    return F.expr(f"CASE WHEN {p} > 0 AND {p} < 1 THEN {inverse_normal_sql(p)} END")

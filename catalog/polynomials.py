"""Normal distribution in SQL, by the same polynomials as the library."""

from __future__ import annotations

from meteorium.functions import numeric as num


def poly(coefs: list[float], x: str) -> str:
    out = repr(coefs[0]) + "::DOUBLE"
    for k in coefs[1:]:
        out = f"({out} * {x} + {k!r}::DOUBLE)"
    return out


def cdf_sql(x: str) -> str:
    """Normal distribution function of an expression, as the Spark side computes it."""
    a = f"abs({x})"
    body = f"exp(-{a} * {a} / 2) * {poly(num.CDF_NUM, a)} / {poly(num.CDF_DEN, a)}"
    tail = f"exp(-{a} * {a} / 2) / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65::DOUBLE))))) / {num.CDF_ROOT}::DOUBLE"
    lower = f"(CASE WHEN {a} > 37 THEN 0 WHEN {a} < {num.CDF_SPLIT}::DOUBLE THEN {body} ELSE {tail} END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {lower} ELSE {lower} END)"


def p_sql(z: str) -> str:
    return f"2 * {cdf_sql(f'(-abs({z}))')}"

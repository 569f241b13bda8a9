"""Tail probabilities as Column expressions.

Spark SQL has no error function, so ``erfc`` is the three-range rational
approximation of W. J. Cody (Math. Comp. 23, 1969), written as expression text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cody's coefficients, highest power first.
_NEAR_NUM = [1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2,
             3.77485237685302021e2, 3.20937758913846947e3]
_NEAR_DEN = [1.0, 2.36012909523441209e1, 2.44024637934444173e2,
             1.28261652607737228e3, 2.84423683343917062e3]
_MID_NUM = [2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0,
            6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2,
            1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3]
_MID_DEN = [1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2,
            1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3,
            3.43936767414372164e3, 1.23033935480374942e3]
_FAR_NUM = [1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1,
            1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4]
_FAR_DEN = [1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1,
            6.05183413124413191e-2, 2.33520497626869185e-3]


def let(value: Column, fn) -> Column:
    """fn(value) with ``value`` evaluated once, however often fn uses it.

    Nested formulas would otherwise repeat their argument at every use, and
    predicates pushed through them would multiply it again. ``fn`` is a Python function
    of a Column or the text of an expression in ``x``.
    """
    if isinstance(fn, str):
        return F.call_function("transform", F.array(value), F.expr(f"x -> {fn}"))[0]
    return F.transform(F.array(value), fn)[0]


def _horner(x: str, coefficients: list[float]) -> str:
    text = f"{coefficients[0]!r}D"
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c!r}D)"
    return text


def _erfc_text(x: str) -> str:
    y, y2 = f"abs({x})", f"({x} * {x})"
    inverse = f"(1D / {y2})"
    near = f"1D - {x} * {_horner(y2, _NEAR_NUM)} / {_horner(y2, _NEAR_DEN)}"
    mid = f"exp(-{y2}) * {_horner(y, _MID_NUM)} / {_horner(y, _MID_DEN)}"
    far = (f"exp(-{y2}) / {y} * ({1 / math.sqrt(math.pi)!r}D"
           f" - {inverse} * {_horner(inverse, _FAR_NUM)} / {_horner(inverse, _FAR_DEN)})")
    upper = f"CASE WHEN {y} <= 4D THEN {mid} WHEN {y} < 27D THEN {far} ELSE 0D END"
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN {y} <= 0.46875D THEN {near} "
            f"WHEN {x} < 0D THEN 2D - ({upper}) ELSE {upper} END")


def erfc(x: Column) -> Column:
    """Complementary error function."""
    return let(x.cast("double"), _erfc_text("x"))


def normal_tail(z: Column) -> Column:
    """P(Z > z) for a standard normal Z."""
    return let(z / F.lit(math.sqrt(2.0)), f"0.5D * ({_erfc_text('x')})")


def normal_cdf(z: Column) -> Column:
    return normal_tail(-z)


def chi2_tail(h: Column, df: Column) -> Column:
    """P(X > h) for chi-square X with a whole number ``df`` of degrees of freedom.

    Both parities are a finite series: even df starts from exp(-h/2), odd df
    from the normal tail; terms follow by multiplying with (h/2)/(i + offset).
    """
    half, even = "(x.h / 2D)", "x.df % 2 = 0"
    offset = f"IF({even}, 0D, 0.5D)"
    first = f"exp(-{half}) * IF({even}, 1D, sqrt({half}) * {2 / math.sqrt(math.pi)!r}D)"
    steps = "IF(x.df >= 2, sequence(1, CAST(floor(x.df / 2) AS INT)), CAST(array() AS ARRAY<INT>))"
    series = (f"aggregate({steps}, named_struct('term', {first}, 'total', 0D), "
              f"(s, i) -> named_struct('term', s.term * {half} / (i + {offset}), 'total', s.total + s.term), "
              f"s -> s.total)")
    base = f"IF({even}, 0D, {_erfc_text(f'sqrt({half})')})"
    text = f"CASE WHEN x.df >= 1 AND x.h >= 0D THEN least(1D, {base} + {series}) END"
    return let(F.struct(h.cast("double").alias("h"), df.cast("int").alias("df")), text)

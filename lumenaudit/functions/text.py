"""Text and number helpers: folding, brand mentions, rounding, status."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def folded(text: str) -> str:
    """Without accents and case (NFKD, combining marks dropped, case folded)."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()


@pandas_udf(StringType())
def _fold(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda x: folded(x) if x is not None else None)


def fold(c: Column) -> Column:
    """`folded` as a column function, in Arrow batches; Spark has no compatibility decomposition of its own."""
    return _fold(c)


def mentioned(text: Column, brand: Column) -> Column:
    """Folded brand within folded text, no word character on either side. False for null or empty."""
    quoted = F.replace(brand, F.lit(r"\E"), F.lit(r"\E\\E\Q"))  # a brand may hold the mark that ends a quotation
    pattern = F.concat(F.lit(r"(?U)(?<!\w)\Q"), quoted, F.lit(r"\E(?!\w)"))
    return F.coalesce((F.trim(brand) != "") & F.regexp_like(text, pattern), F.lit(False))


def words(c: Column) -> Column:
    """How many words, by Unicode white space."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != ""))


def rounded_sql(x: str, digits: int = 2) -> str:
    """`rounded` of the SQL expression x, which is best a column, as it is named several times."""
    return f"({cents_sql(x, digits)} / {float(10**digits)}D)"


def cents_sql(x: str, digits: int = 2) -> str:
    """The integer nearest to x * 10^digits, where x stands for exactly its binary value; ties go to the even one.

    Products of a double's upper 26 bits and of its lower 27 by a power of ten are exact, so the sign of what x * 10^digits
    is above or below a half can be told without error.
    """
    p, upper = f"{float(10**digits)}D", f"({x} * 134217729D - ({x} * 134217729D - {x}))"
    low = f"floor({x} * {p})"
    over = f"(({upper} * {p} - {low} - 0.5D) + ({x} - {upper}) * {p})"
    return f"({low} + CASE WHEN {over} > 0 THEN 1 WHEN {over} < 0 THEN 0 ELSE pmod({low}, 2) END)"


def rounded(c: Column, digits: int = 2) -> Column:
    """The double nearest to c at so many digits, as Python's round gives it: 2.675 is below its middle, 0.125 a tie.

    Spark's own functions round the shortest text of a double, where 2.675 is a tie.
    """
    # A function of one array entry, so that the expression of c stands in the plan once.
    return F.get(F.transform(F.array(c.cast("double")), lambda x: _rounded(x, digits)), F.lit(0))


def _rounded(x: Column, digits: int) -> Column:
    p = F.lit(float(10**digits))
    low = F.floor(x * p)
    upper = x * 134217729.0 - (x * 134217729.0 - x)
    over = (upper * p - low - 0.5) + (x - upper) * p
    return (low + F.when(over > 0, 1).when(over < 0, 0).otherwise(F.pmod(low, F.lit(2)))) / p


#: Doubles are summed in integers of this part.
UNITS = float(1 << 50)


def units(c: Column, size: float = UNITS) -> Column:
    """A double (below 2^63 / size) in whole units, cut."""
    return F.floor(c * size).cast("decimal(19,0)")


def steady_sum(c: Column, size: float = UNITS, times: Column | None = None) -> Column:
    """The sum of doubles, each in whole units, so that their order doesn't matter."""
    whole = units(c, size)
    return F.sum(whole if times is None else whole * times.cast("decimal(19,0)")).cast("double") / size


def share(part: Column, whole: Column, factor: float = 100.0) -> Column:
    """part / whole * factor, not rounded; null for an empty whole."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * factor


def clamped(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), c.cast("double")))


def status(score: Column) -> Column:
    """From 80 ok, from 50 warning, else critical."""
    return F.when(score >= 80, "ok").when(score >= 50, "warning").otherwise("critical")


def steps(value: Column, *limits: tuple[float, float], otherwise: float = 0.0) -> Column:
    """The score of the first limit that the value doesn't exceed."""
    out = None
    for limit, score in limits:
        out = F.when(value <= limit, float(score)) if out is None else out.when(value <= limit, float(score))
    return out.otherwise(float(otherwise))

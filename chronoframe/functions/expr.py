"""Column helpers with one rule each for nulls, zero denominators, order of nulls and non-finite values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """The value, or null where it is null, NaN or infinite."""
    x = col(c)
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, null where b is zero or either is null."""
    return F.try_divide(col(a), F.nullif(col(b), F.lit(0).cast("double")))


def clip(c: str | Column, low: float, high: float) -> Column:
    x = col(c)
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def up(c: str | Column) -> Column:
    return col(c).asc_nulls_last()


def down(c: str | Column) -> Column:
    return col(c).desc_nulls_last()


def round6(c: str | Column) -> Column:
    return F.round(col(c), 6)


def round_binary(c: str | Column, places: int) -> Column:
    """The double nearest to the value times ten to `places`, halves away from zero, over that power: SQL
    engines that scale the binary value round so, the built-in one rounds its shortest decimal text.  They
    differ where a value of few digits ends in a 5, such as a mean of two rounded ones."""
    x = col(c)
    y = F.abs(x) * 10.0**places
    return F.signum(x) * (F.rint(y) + F.when(y - F.rint(y) == 0.5, 1.0).otherwise(0.0)) / 10.0**places


def share(condition: Column) -> Column:
    """Aggregate: share of rows, null conditions left out."""
    return F.avg(condition.cast("double"))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def key_hash(*parts: Column | str, length: int = 64) -> Column:
    """SHA-256 of the parts' texts joined by '|', its first hex digits: deterministic ids."""
    text = F.concat_ws("|", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts])
    return F.substring(F.sha2(text, 256), 1, length)


def corr(x: str | Column, y: str | Column, over=None) -> Column:
    """Aggregate: correlation over the pairs, null where either side doesn't vary (the built-in one
    fails there under ANSI)."""
    a, b = F.when(col(y).isNotNull(), col(x)), F.when(col(x).isNotNull(), col(y))
    parts = [F.covar_pop(a, b), F.stddev_pop(a), F.stddev_pop(b)]
    if over is not None:
        parts = [p.over(over) for p in parts]
    return ratio(parts[0], parts[1] * parts[2])

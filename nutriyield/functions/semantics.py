"""Column expressions that carry R's missing-value and rounding rules.

All helpers return ``Column`` expressions built from ``pyspark.sql.functions``,
so they stay JVM-side and inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------------------- aggregates

def strict_sum(c) -> Column:
    """``sum(x)`` without ``na.rm``: NULL as soon as one input is NULL."""
    c = _c(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def sum_na_rm(c) -> Column:
    """``sum(x, na.rm = TRUE)``: NULLs skipped, all-NULL group gives 0."""
    return F.coalesce(F.sum(_c(c)), F.lit(0.0))


def strict_mean(c) -> Column:
    """``mean(x)`` without ``na.rm``."""
    c = _c(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))


def mean_na_rm(c) -> Column:
    """``mean(x, na.rm = TRUE)``; all-NULL group gives NULL (R gives NaN)."""
    return F.avg(_c(c))


def median_na_rm(c) -> Column:
    """Exact interpolated median, NULLs skipped (R ``median(x, na.rm=TRUE)``)."""
    return F.median(_c(c))


def n_distinct_r(c) -> Column:
    """``length(unique(x))``: distinct values with NULL counted as one value."""
    c = _c(c)
    return F.count_distinct(c) + F.max(c.isNull().cast("int"))


def first_by(value, order) -> Column:
    """Deterministic ``first(x)``: the value at the smallest ``order`` key.

    ``order`` must be a total order inside the group (add tie breakers).
    """
    return F.min_by(_c(value), _c(order))


# --------------------------------------------------------------------------- scalars

def r_ifelse(cond: Column, yes, no) -> Column:
    """``ifelse(cond, yes, no)``: NULL condition gives NULL (CASE WHEN would take ELSE)."""
    yes = yes if isinstance(yes, Column) else F.lit(yes)
    no = no if isinstance(no, Column) else F.lit(no)
    return F.when(cond.isNull(), F.lit(None)).when(cond, yes).otherwise(no)


def paste(*cols, sep: str = " ") -> Column:
    """``paste``: NULL is printed as the text ``NA`` (``concat_ws`` would skip it)."""
    parts = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(sep))
        parts.append(F.coalesce(_c(c).cast("string"), F.lit("NA")))
    return F.concat(*parts)


def in_levels(c, levels: Sequence[str]) -> Column:
    """Factor with fixed levels: values outside ``levels`` become NULL."""
    c = _c(c)
    return F.when(c.isin(list(levels)), c)


def level_rank(c, levels: Sequence[str]) -> Column:
    """1-based position of the value in ``levels``; NULL when absent."""
    pos = F.array_position(F.array(*[F.lit(v) for v in levels]), _c(c))
    return F.when(pos > 0, pos.cast("int"))


def str_to_title(c) -> Column:
    """``stringr::str_to_title``: first letter of each word upper, rest lower."""
    return F.initcap(_c(c))


def str_replace_first(c, pattern: str, replacement: str) -> Column:
    """``str_replace``: replace the first regex match only."""
    return F.regexp_replace(_c(c), f"^(.*?){pattern}", f"$1{replacement}")


def str_remove_first(c, pattern: str) -> Column:
    """``str_remove``: drop the first regex match."""
    return str_replace_first(c, pattern, "")


def safe_div(a, b) -> Column:
    """x / 0 gives NULL instead of raising under ANSI mode (R would give Inf)."""
    return F.try_divide(_c(a), _c(b))


def _snap_once(x: Column, digits: int) -> Column:
    k = F.lit(digits - 1) - F.floor(F.log10(F.abs(x)))
    up = F.rint(x * F.pow(F.lit(10.0), k)) / F.pow(F.lit(10.0), k)
    down = F.rint(x / F.pow(F.lit(10.0), -k)) * F.pow(F.lit(10.0), -k)
    return F.when(x.isNull() | F.isnan(x) | (x == 0) | F.isnan(F.abs(x) - F.abs(x)), x) \
        .when(k >= 0, up).otherwise(down)


def sig(c, digits: int = 8) -> Column:
    """Snap a double to ``digits`` significant digits (half-even).

    Sums over shuffled partitions differ in the last bits; snapping makes results
    comparable across engines and partition counts.  Only exact IEEE steps are
    used (power of ten, one multiply or divide, ``rint``), so any engine doing
    the same steps gets the same bits.  NULL, NaN and 0 pass through.

    Decimal inputs often sum to a value exactly half-way between two
    ``digits``-digit numbers; the last-bit noise of the summation order would
    then pick the side.  A first snap to 12 digits removes that noise, so the
    half-way case is decided by the same bits in every engine.
    """
    x = _c(c).cast("double")
    if digits < 12:
        x = _snap_once(x, 12)
    return _snap_once(x, digits)


def comma_format(c) -> Column:
    """``format(x, big.mark = ",")`` for whole numbers (no common-width padding)."""
    return F.format_number(_c(c).cast("double"), 0)


def catch_label(c) -> Column:
    """Tonnes as a label: "<1" below one, else the rounded number with thousands separators."""
    return F.when(_c(c) < 1, F.lit("<1")).otherwise(comma_format(_c(c)))


# --------------------------------------------------------------------------- frames

def cols_between(df: DataFrame, first: str, last: str) -> list[str]:
    """``select(a:b)``: columns from ``first`` to ``last`` in schema order."""
    cols = df.columns
    i, j = cols.index(first), cols.index(last)
    return cols[i: j + 1]


def numeric_cols(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """``where(is.numeric)`` minus ``exclude``."""
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in ex]


def snap_doubles(df: DataFrame, digits: int = 8) -> DataFrame:
    """Apply :func:`sig` to every double column (report boundary only)."""
    return df.withColumns({f.name: sig(f.name, digits) for f in df.schema.fields
                           if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def drop_na_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``na.omit``: drop rows with any NULL (and NaN in double columns)."""
    cols = list(cols or df.columns)
    dbl = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
        if c in dbl:
            cond = cond & ~F.isnan(F.col(c))
    return df.where(cond)

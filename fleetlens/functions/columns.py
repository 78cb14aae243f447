"""Enum, duration, text and number rules, and the table jobs that apply them."""

from functools import reduce

from pyspark.sql import functions as F

from fleetlens.schemas import LOG_LEVELS


def _names(names):
    return F.array(*[F.lit(n) for n in names])


def enum_ordinal(col, names):
    """Position of the name in order of declaration, null on a miss. Used to sort states."""
    pos = F.array_position(_names(names), col)
    return F.when(pos > 0, pos - 1)


def decode_enum(col, names, on_miss="null", default=None):
    """Exact, case-sensitive name match. A miss gives null, a default, or an error."""
    known = F.when(col.isin(*names), col)
    if on_miss == "null":
        return known
    if on_miss == "default":
        return F.coalesce(known, F.lit(default))
    if on_miss == "error":
        unknown = F.raise_error(F.concat(F.lit("unknown name: "), col)).cast("string")
        return F.when(col.isNull() | col.isin(*names), col).otherwise(unknown)
    raise ValueError("on_miss must be null, default or error")


def decode_enums(df, spec, on_miss="null", default=None):
    """Check several name columns and add `<col>_ordinal`. `spec` maps column to catalogue.

    With on_miss="null" a bad name becomes null, so that `quarantine` can split such rows off.
    """
    out = {c: decode_enum(F.col(c), names, on_miss, default) for c, names in spec.items()}
    ordinals = {f"{c}_ordinal": enum_ordinal(F.col(c), names) for c, names in spec.items()}
    return df.withColumns({**ordinals, **out})


def duration(start, end, now, stop_at_end=False):
    """Run time in the unit of the inputs. By default the end is not looked at."""
    if not stop_at_end:
        return now - start
    return F.when(end >= start, end).otherwise(now) - start


def job_durations(jobs, now, start="start_ts", end="end_ts", stop_at_end=False):
    """Add `duration` to every job."""
    return jobs.withColumn("duration", duration(F.col(start), F.col(end), F.lit(now), stop_at_end))


def safe_trim(col):
    """Trimmed text; null gives the empty text."""
    return F.coalesce(F.trim(col), F.lit(""))


def drop_blank(arr):
    """Trimmed elements of an array without null and blank ones."""
    return F.filter(F.transform(arr, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def clamp_min(col, low):
    """At least `low`. A null stays null (greatest would turn it into `low`)."""
    return F.when(col.isNotNull(), F.greatest(col, F.lit(low)))


def or_default(col, keep, default):
    """The value where `keep(col)` holds, else the default. A null stays null."""
    return F.when(keep(col), col).when(col.isNotNull(), F.lit(default))


def clean_columns(df, trim=(), blank_free=(), at_least=None):
    """Trim text columns, drop blanks from array columns, and raise numbers to a lower limit."""
    cols = {c: safe_trim(F.col(c)) for c in trim}
    cols |= {c: drop_blank(F.col(c)) for c in blank_free}
    cols |= {c: clamp_min(F.col(c), low) for c, low in (at_least or {}).items()}
    return df.withColumns(cols)


def min_severity(df, level, col="level"):
    """Rows at or above a log level. As a list of names the filter reaches the scan."""
    if level not in LOG_LEVELS:
        raise ValueError(f"unknown level {level!r}")
    return df.filter(F.col(col).isin(*LOG_LEVELS[LOG_LEVELS.index(level):]))


def all_of(conditions):
    """AND of a list of conditions."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))

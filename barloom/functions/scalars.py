"""Column functions: guarded arithmetic, clipping, text and time helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.schema import EXCHANGE_ZONE


def number(c: Column) -> Column:
    """Text or number to double; anything unreadable, NaN or infinite becomes null."""
    return finite(c.try_cast("double"))


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def clip(c: Column, lo: float | Column, hi: float | Column) -> Column:
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (lo, hi))
    return F.when(c.isNotNull(), F.greatest(F.least(c, hi), lo))


def ratio(a: Column, b: Column, eps: float) -> Column:
    return a / (b + F.lit(eps))


def pair_corr(a: Column, b: Column) -> Column:
    """Correlation aggregate that is null for a flat side (the built-in one raises in ANSI mode); no null pairs."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def blank_zero(c: Column) -> Column:
    return F.when(c != 0, c)


def through_float(c: Column) -> Column:
    """Round a double through single precision."""
    return c.cast("float").cast("double")


def names_list(c: Column) -> Column:
    """Comma-separated names, trimmed, blanks removed."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def utc_wall(c: Column) -> Column:
    """An instant as UTC wall time."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), c.cast("timestamp_ntz"))


def instant(c: Column) -> Column:
    """UTC wall time as an instant, whatever the session time zone."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), c.cast("timestamp_ntz")).cast("timestamp")


def exchange_wall(c: Column, zone: str = EXCHANGE_ZONE) -> Column:
    """UTC wall time to exchange wall time."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), c)


def from_exchange_wall(c: Column, zone: str = EXCHANGE_ZONE) -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), c)


def read_timestamp(c: Column, formats: Sequence[str] = ("yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss"), zone: str = "UTC") -> Column:
    """Text to UTC wall time: offsets are honoured, bare text is taken in ``zone``, the unreadable is null."""
    aware = c.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & c.contains(":")
    bare = F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats], F.try_to_timestamp(c))
    bare = bare.cast("timestamp_ntz")
    if zone != "UTC":
        bare = from_exchange_wall(bare, zone)
    return F.when(aware, utc_wall(F.try_to_timestamp(c))).otherwise(bare)


def json_first(c: Column, *paths: str) -> Column:
    """First path of a JSON text that holds a value."""
    return F.coalesce(*[F.get_json_object(c, p) for p in paths])


def monday_weekday(c: Column) -> Column:
    """Weekday with Monday as 0."""
    return F.weekday(c)


def epoch_seconds(c: Column) -> Column:
    """Seconds of UTC wall time since 1970 as a double, without a session time zone."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)
    return micros / F.lit(1e6)


def rank_position(c: Column, low: float, high: float, log: bool = False) -> Column:
    """A value in a numeric range as a share of the range; outside values are null."""
    if log and low > 0 and high > 0:
        share = (F.ln(c) - F.ln(F.lit(low))) / F.greatest(F.ln(F.lit(high)) - F.ln(F.lit(low)), F.lit(1e-12))
    else:
        share = (c - low) / max(high - low, 1e-12)
    return F.when((c >= low) & (c <= high), share)


def choice_position(c: Column, choices: Sequence) -> Column:
    """A value in a list of choices as a share of the list; unknown values are null."""
    at = F.array_position(F.array(*[F.lit(x) for x in choices]), c) - 1
    return F.when(at >= 0, F.lit(0.0) if len(choices) == 1 else at / float(len(choices) - 1))


def step_position(c: Column, low: int, high: int) -> Column:
    """A whole number in a range as a share of the range."""
    v = F.floor(F.abs(c)) * F.signum(c)
    return F.when((v >= low) & (v <= high), (v - low) / float(max(high - low, 1)))

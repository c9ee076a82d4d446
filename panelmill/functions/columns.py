"""Column expressions shared by the operators; all of them stay inside codegen."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wall-clock layout MM/dd/yyyy HH:mm:ss of the vendor feeds.
WALL_CLOCK_SHAPE = r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:[0-5]\d$"
WALL_CLOCK_FORMAT = "MM/dd/yyyy HH:mm:ss"

SUNDAY, SATURDAY = 1, 7
PEAK_HOURS = (7, 22)


def parse_wall_clock(text: Column) -> Column:
    """``MM/dd/yyyy HH:mm:ss`` text as a zone-free timestamp; NULL when malformed.

    Built from its parts, so neither ANSI mode nor the session time zone can
    change the outcome (a clock-change gap would otherwise move wall-clock times).
    """

    def part(start: int, length: int) -> Column:
        return F.substring(text, start, length).try_cast("int")

    return F.when(
        text.rlike(WALL_CLOCK_SHAPE),
        F.try_make_timestamp_ntz(part(7, 4), part(1, 2), part(4, 2), part(12, 2), part(15, 2), part(18, 2)),
    )


def bucket(ts: Column, grain: str) -> Column:
    """Start of the hour or day holding ``ts``, as ``timestamp_ntz``.

    ``date_trunc`` casts zone-free input through the session zone; a date plus
    an hour interval does not.
    """
    day = F.to_date(ts).cast("timestamp_ntz")
    if grain == "day":
        return day
    if grain == "hour":
        return day + F.make_dt_interval(F.lit(0), F.hour(ts))
    raise ValueError(f"unknown grain {grain!r}: expected 'hour' or 'day'")


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or unknown."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def ratio_or(numerator: Column, denominator: Column, default: float) -> Column:
    """Quotient, or ``default`` where the denominator is zero or unknown."""
    return F.when(denominator != 0, numerator / denominator).otherwise(F.lit(float(default)))


def cyclic(position: Column, period: int, prefix: str) -> dict[str, Column]:
    """Sine and cosine of a position on a circle of ``period`` steps."""
    angle = position * F.lit(2 * math.pi) / F.lit(period)
    return {f"{prefix}_sin": F.sin(angle), f"{prefix}_cos": F.cos(angle)}


def calendar(ts: Column, extras: Sequence[str] = ()) -> dict[str, Column]:
    """Calendar parts of a timestamp; ``extras`` adds ``peak`` and/or ``week`` columns."""
    hour, month, weekday = F.hour(ts), F.month(ts), F.dayofweek(ts)
    parts = {
        "hour": hour,
        "day_of_week": weekday,
        "day_of_month": F.dayofmonth(ts),
        "month": month,
        "year": F.year(ts),
        "is_weekend": flag(weekday.isin(SUNDAY, SATURDAY)),
        **cyclic(hour, 24, "hour"),
        **cyclic(month, 12, "month"),
    }
    if "peak" in extras:
        parts["is_peak_hour"] = flag(hour.between(*PEAK_HOURS))
    if "week" in extras:
        parts["week_of_year"] = F.weekofyear(ts)
        parts["day_name"] = F.date_format(ts, "EEEE")
    return parts


def key_token(keys: Sequence[str], seed: int) -> Column:
    """Text that identifies a row by its keys, for hashing."""
    return F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))


def hash_share(keys: Sequence[str], seed: int, parts: int = 100) -> Column:
    """Row position in 0..parts-1, a function of the keys alone.

    MD5 rather than a Spark-only hash, so other engines can repeat the split;
    unlike a random generator it does not depend on partitioning.
    """
    head = F.substring(F.md5(key_token(keys, seed)), 1, 8)
    return F.pmod(F.conv(head, 16, 10).cast("long"), F.lit(parts)).cast("int")


def wall_clock_text(ts: str) -> Column:
    """Vendor text of a zone-free timestamp, from its own digits; formatting it would pass the session zone."""
    text = F.col(ts).cast("timestamp_ntz").cast("string")
    return F.concat_ws(
        " ",
        F.concat_ws("/", F.substring(text, 6, 2), F.substring(text, 9, 2), F.substring(text, 1, 4)),
        F.when(text.isNotNull(), F.substring(text, 12, 8)),
    )

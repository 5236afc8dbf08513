"""Scalar column expressions: parsing, labels, bands, buckets and exact money."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "<UNKNOWN>"
HASH_NULL = "<NULL>"
CATEGORY_NULL = "__NULL__"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.trim(as_col(c).cast("string")), F.lit(""))


def known_or_unknown(c: Column | str) -> Column:
    return F.coalesce(blank_to_null(c), F.lit(UNKNOWN))


def parse_currency(c: Column | str) -> Column:
    """'$1,234.50' -> 1234.5; NULL when it is not a number."""
    return F.regexp_replace(F.trim(as_col(c)), "[$,]", "").try_cast("double")


def parse_event_time(year, month, day, time) -> Column:
    """Zone-free timestamp from four text parts; seconds are optional."""
    two = lambda c: F.lpad(F.trim(as_col(c).cast("string")), 2, "0")
    text = F.concat(
        F.trim(as_col(year).cast("string")), F.lit("-"), two(month), F.lit("-"), two(day), F.lit(" "), F.trim(as_col(time))
    )
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm"))
    ).cast("timestamp_ntz")


def decode_label(c: Column | str) -> Column:
    text = F.lower(F.trim(as_col(c).cast("string")))
    return F.when(text.isin("yes", "true"), 1).when(text.isin("no", "false"), 0)


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch (session time zone must be UTC)."""
    return F.unix_micros(as_col(ts).cast("timestamp"))


def whole_seconds_between(earlier_us: Column, later_us: Column) -> Column:
    """Difference of whole-second clock readings, counting second boundaries."""
    second = lambda c: F.unix_seconds(F.timestamp_micros(c))
    return second(later_us) - second(earlier_us)


def cents(amount: Column | str) -> Column:
    """Money as integer cents, so that sums are exact in any order."""
    return F.round(as_col(amount) * 100).cast("long")


def dollars(total_cents: Column) -> Column:
    return total_cents.cast("double") / F.lit(100.0)


def ratio(top: Column | str, bottom: Column | str) -> Column:
    """Double division that gives NULL for a zero or missing denominator."""
    bottom = as_col(bottom).cast("double")
    return as_col(top).cast("double") / F.when(bottom != 0, bottom)


def amount_band(amount: Column | str) -> Column:
    """Eight bands closed on the right; a NULL amount falls through to the last."""
    a = as_col(amount)
    band = F.when(a < 0, "NEGATIVE / REFUND-LIKE").when(a == 0, "ZERO")
    for top, label in ((25, ">0–25"), (50, "25–50"), (100, "50–100"), (250, "100–250"), (500, "250–500")):
        band = band.when(a <= top, label)
    return band.otherwise("500+")


def month_key(ts: Column | str) -> Column:
    return F.date_format(as_col(ts), "yyyy-MM")


def flag(c: Column | str) -> Column:
    """Boolean with NULL read as false."""
    return F.coalesce(as_col(c).cast("boolean"), F.lit(False))


def positive_part(amount: Column | str) -> Column:
    return F.greatest(as_col(amount), F.lit(0.0))


def feature_hash(columns: list[str]) -> Column:
    """md5 over the text of the columns, NULLs spelled out, joined by the unit separator."""
    return F.md5(F.concat_ws("\u001f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(HASH_NULL)) for c in columns]))


def category(c: Column | str) -> Column:
    return F.coalesce(as_col(c).cast("string"), F.lit(CATEGORY_NULL))


def queue_bucket(ts: Column | str, kind: str = "DAY") -> Column:
    """Operational capacity bucket of a timestamp."""
    ts = as_col(ts)
    day = F.date_format(ts, "yyyy-MM-dd")
    kind = kind.upper()
    if kind == "DAY":
        return day
    if kind == "SHIFT":
        hour = F.hour(ts)
        shift = F.when(hour < 8, "00-08").when(hour < 16, "08-16").otherwise("16-24")
        return F.concat(day, F.lit("T"), shift)
    if kind == "WEEK":
        return F.concat_ws("/", *_week_bounds(ts))
    if kind == "HOUR":
        return F.concat(day, F.lit("T"), F.date_format(ts, "HH"))
    raise ValueError(f"no review bucket is called {kind}")


def _week_bounds(ts: Column) -> tuple[Column, Column]:
    monday = F.to_date(F.date_trunc("week", ts))
    return F.date_format(monday, "yyyy-MM-dd"), F.date_format(F.date_add(monday, 6), "yyyy-MM-dd")


def monitoring_window(ts: Column | str, frequency: str) -> Column:
    """D-<day>, W-<monday>_<sunday> or M-<month>."""
    ts = as_col(ts)
    frequency = frequency.upper()
    if frequency == "DAY":
        return F.concat(F.lit("D-"), F.date_format(ts, "yyyy-MM-dd"))
    if frequency == "WEEK":
        return F.concat(F.lit("W-"), F.concat_ws("_", *_week_bounds(ts)))
    if frequency == "MONTH":
        return F.concat(F.lit("M-"), F.date_format(ts, "yyyy-MM"))
    raise ValueError(f"no monitoring window is called {frequency}")


def four_bands(c: Column | str, low: float, medium: float, high: float) -> Column:
    """LOW / MEDIUM / HIGH / VERY_HIGH, closed on the right; NULL stays NULL."""
    c = as_col(c)
    return (
        F.when(c <= low, "LOW").when(c <= medium, "MEDIUM").when(c <= high, "HIGH").when(c > high, "VERY_HIGH")
    )


def channel_group(use_chip: Column | str) -> Column:
    c = as_col(use_chip)
    return (
        F.when(c == "Online Transaction", "Online").when(c == "Swipe Transaction", "Swipe")
        .when(c == "Chip Transaction", "Chip").otherwise("Other/Unknown")
    )


def cold_start_segment(cold_card, new_merchant, pair_new) -> Column:
    card, merchant, pair = flag(cold_card), flag(new_merchant), flag(pair_new)
    return (
        F.when(card & merchant, "BOTH_NODES_UNSEEN").when(card, "NEW_CARD_ONLY").when(merchant, "NEW_MERCHANT_ONLY")
        .when(pair, "WARM_PAIR_NEW").otherwise("WARM_PAIR_SEEN")
    )


def unpivot_stack(pairs: list[tuple[str, str]], names: tuple[str, ...]) -> str:
    """SQL ``stack`` text for one output row per entry of ``pairs``."""
    width = len(names)
    cells = ", ".join(", ".join(p) for p in pairs)
    assert all(len(p) == width for p in pairs)
    return f"stack({len(pairs)}, {cells}) as ({', '.join(names)})"


def segment_text(df, column: str) -> str:
    """SQL text of a column as a segment name; booleans read True / False."""
    if df.schema[column].dataType.typeName() == "boolean":
        return f"case when {column} then 'True' when not {column} then 'False' end"
    return f"cast({column} as string)"

"""Text expressions.  All of them are built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space (Unicode White_Space
# and the four separators U+001C to U+001F).
SPACE_CLASS = r"[\s\x1c-\x1f]"
_SPLIT = f"(?U){SPACE_CLASS}+"
_STRIP = rf"(?U)\A{SPACE_CLASS}+|{SPACE_CLASS}+\z"


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.regexp_replace(text, _STRIP, "")


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def tokenize(text: Column) -> Column:
    """White-space tokens, case kept.  NULL and blank text give an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPLIT), "")


def blank_to(text: Column, default: str) -> Column:
    """``default`` for NULL and for the empty string."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def joined(items: Column, default: str) -> Column:
    """Non-NULL list items joined by one space; ``default`` for nothing."""
    return blank_to(F.array_join(items, " "), default)


def first_non_empty(*texts: Column, default: str) -> Column:
    """First text that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(default))


def snippet(text: Column, length: int) -> Column:
    """First ``length`` characters, with an ellipsis where something was cut."""
    return F.concat(
        F.substring(text, 1, length),
        F.when(F.length(text) > length, F.lit("…")).otherwise(F.lit("")),
    )


def known(number: Column) -> Column:
    """The number, with NaN as NULL."""
    return F.when(F.isnan(number.cast("double")), F.lit(None)).otherwise(number)


def rating_note(rating: Column) -> Column:
    """`` (rated 4.2/5)`` for 4.25 (half to even), or nothing without a rating."""
    value = F.bround(known(rating).cast("decimal(30,10)"), 1).cast("double")
    return F.when(value.isNotNull(), F.format_string(" (rated %.1f/5)", value)).otherwise(F.lit(""))


def star_bar(rating: Column) -> Column:
    """Five stars, the rating rounded half to even of them filled."""
    full = F.bround(known(rating).cast("double")).cast("int")
    return F.when(
        full.isNotNull(),
        F.concat(F.repeat(F.lit("★"), full), F.repeat(F.lit("☆"), F.lit(5) - full)),
    ).otherwise(F.lit(""))


def review_count_note(count: Column) -> Column:
    """``(1,234 reviews)``, or nothing for NULL and zero."""
    return F.when(
        known(count) != 0, F.concat(F.lit("("), F.format_number(count, 0), F.lit(" reviews)"))
    ).otherwise(F.lit(""))


def search_mode(label: Column) -> Column:
    """``semantic``, ``bm25`` or ``hybrid`` from a label; ``hybrid`` for any other label."""
    mode = F.lower(strip(label))
    return F.when(mode.isin("semantic", "bm25", "hybrid"), mode).otherwise(F.lit("hybrid"))


def utc_iso(ts: Column) -> Column:
    """ISO 8601 text of an instant in UTC, whatever the session's time zone."""
    at = F.to_utc_timestamp(ts, F.current_timezone())
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))

"""Costs, tokens, retries and images, as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docgate import fixed


def none_as_zero(*names: str) -> list[Column]:
    return [F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names]


def cost_usd(fresh: Column, written: Column, read: Column, out: Column, in_rate: Column, out_rate: Column) -> Column:
    """Dollars for tokens at dollars a million: written to and read from the cache at their own share of the input rate."""
    return (fresh * in_rate + written * in_rate * fixed.CACHE_WRITE + read * in_rate * fixed.CACHE_READ + out * out_rate) / 1e6


def cache_hit_ratio(fresh: Column, written: Column, read: Column) -> Column:
    total = fresh + written + read
    return F.when(total > 0, read / total).otherwise(F.lit(0.0))


def text_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / fixed.CHARS_PER_TOKEN)


def image_tokens(width: Column, height: Column) -> Column:
    return F.floor(width * height / fixed.PIXELS_PER_TOKEN)


def page_tokens(page: Column) -> Column:
    """Of a page struct of kind, text, width, height."""
    text = text_tokens(F.coalesce(page["text"], F.lit("")))
    return F.when(page["kind"] == "image", image_tokens(F.coalesce(page["width"], F.lit(0)), F.coalesce(page["height"], F.lit(0)))).otherwise(text)


def image_size(width: Column, height: Column, edge: int = fixed.MAX_EDGE) -> Column:
    """The size of an image brought down to a longest edge; smaller ones stay."""
    scale = F.least(F.lit(1.0), F.lit(float(edge)) / F.greatest(width, height))
    return F.struct(F.greatest(F.lit(1), (width * scale).cast("int")).alias("width"), F.greatest(F.lit(1), (height * scale).cast("int")).alias("height"))


def render_scale(width: Column, height: Column, edge: int = fixed.MAX_EDGE) -> Column:
    return F.least(F.lit(fixed.MAX_SCALE), F.lit(float(edge)) / F.greatest(width, height))


def retry_at(now: Column, attempts: Column) -> Column:
    """When to try again after so many attempts."""
    waits = F.array(*map(F.lit, fixed.BACKOFF_SECONDS))
    place = F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(len(fixed.BACKOFF_SECONDS) - 1)).cast("int")
    return now + F.make_interval(secs=F.element_at(waits, place + 1))


def _seconds(ms: Column) -> Column:
    """Whole milliseconds as seconds with one decimal, as the double nearest to them rounds: a tie goes by what that double is more
    or less than it stands for (its product with 1000 to twice the precision), and to the even digit if it is exact."""
    ms = ms.cast("long")
    near = ms / F.lit(1000.0)
    head = near * 134217729.0 - (near * 134217729.0 - near)
    over = (head * 1000.0 - ms) + (near - head) * 1000.0
    tenths, rest = F.floor(ms / 100), ms % 100
    up = (rest > 50) | (rest == 50) & ((over > 0) | (over == 0) & (tenths % 2 == 1))
    tenths = tenths + up.cast("long")
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def duration(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(ms.cast("long").cast("string"), F.lit("ms"))).otherwise(F.concat(_seconds(ms), F.lit("s")))


def number(value: Column) -> Column:
    """A text as a number, null if it isn't one; not a number counts as none."""
    parsed = F.trim(value).try_cast("double")
    return F.when(~F.isnan(parsed), parsed)


def chosen_model(override: Column, default: Column) -> Column:
    return F.coalesce(F.nullif(override, F.lit("")), default)


def close_enough(expected: Column, actual: Column) -> Column:
    """Numbers within a hundredth; null equals null."""
    return F.when(expected.isNull() | actual.isNull(), expected.isNull() & actual.isNull()).otherwise(F.abs(expected - actual) <= 0.01)


def says(expected: Column, actual: Column) -> Column:
    """Whether a text holds the expected one, caseless; null equals null."""
    return F.when(expected.isNull() | actual.isNull(), expected.isNull() & actual.isNull()).otherwise(F.contains(F.lower(actual), F.lower(expected)))

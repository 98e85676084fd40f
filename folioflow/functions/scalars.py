"""Column functions: labels, clamps, paths. Nulls give null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import DATA_URL_HEAD, DEFAULT_OUTPUT


def _tenths(n: Column, unit: int) -> Column:
    """n / unit with one decimal, halves up."""
    t = F.floor((n * 10 + unit // 2) / F.lit(unit)).cast("long")
    return F.concat((F.floor(t / 10)).cast("long").cast("string"), F.lit("."), (t % 10).cast("string"))


def size_label(n: Column, kb_decimals: int = 0) -> Column:
    """B below 1 KiB, KB below 1 MiB with 0 or 1 decimals, MB with 1."""
    n = n.cast("long")
    kb = _tenths(n, 1024) if kb_decimals else F.floor((n + 512) / 1024).cast("long").cast("string")
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1 << 20, F.concat(kb, F.lit(" KB")))
        .when(n.isNotNull(), F.concat(_tenths(n, 1 << 20), F.lit(" MB")))
    )


def micros(ts: Column) -> Column:
    """Microseconds since 1970 on the clock that ts shows, whatever the session's zone."""
    whole = F.datediff(ts, F.lit("1970-01-01")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return whole * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def relative_time(ts: Column, now: Column) -> Column:
    """Just now (future too), minutes, hours, and from a day on the date."""
    s = (micros(now) - micros(ts)) / 1_000_000
    ago = lambda unit, letter: F.concat(F.floor(s / unit).cast("string"), F.lit(f"{letter} ago"))
    return F.when(s < 60, F.lit("Just now")).when(s < 3600, ago(60, "m")).when(s < 86400, ago(3600, "h")).otherwise(F.date_format(ts, "yyyy-MM-dd"))


def badge(n: Column) -> Column:
    """Null at 0, 9+ above 9."""
    return F.when(n > 9, F.lit("9+")).when(n > 0, n.cast("string"))


def pluralise(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, F.lit(one)).otherwise(F.lit(many)))


def base_name(path: Column) -> Column:
    """The last part, of either kind of separator, without those at the end; empty if there is none."""
    return F.regexp_extract(path, r"([^/\\]+)[/\\]*$", 1)


def dir_name(path: Column) -> Column:
    """What stands before the last part; `.` if nothing does."""
    d = F.regexp_extract(path, r"^(.*?)[/\\]+[^/\\]*[/\\]*$", 1)
    return F.when(d != "", d).when(path.startswith("/"), F.lit("/")).when(path.isNotNull(), F.lit("."))


def is_pdf(path: Column) -> Column:
    return F.lower(path).endswith(".pdf")


def data_url(content: Column) -> Column:
    """Base64 without line breaks behind a fixed media type."""
    return F.concat(F.lit(DATA_URL_HEAD), F.regexp_replace(F.base64(content), "[\r\n]", ""))


def is_blob_url(uri: Column) -> Column:
    return uri.startswith("blob:")


def output_name(name: Column) -> Column:
    """A default for null and empty names."""
    return F.coalesce(F.nullif(name, F.lit("")), F.lit(DEFAULT_OUTPUT))


def zoom_in(zoom: Column) -> Column:
    return F.least(zoom + 25, F.lit(200))


def zoom_out(zoom: Column) -> Column:
    return F.greatest(zoom - 25, F.lit(50))


def scale(zoom: Column) -> Column:
    return zoom / F.lit(100.0)


def rotate(rotation: Column, by: int) -> Column:
    """The sign follows the dividend: -90 stays -90."""
    return (rotation + by) % 360


def previous_page(page: Column) -> Column:
    return F.greatest(F.lit(1), page - 1)


def next_page(page: Column, pages: Column) -> Column:
    """0 when there are no pages."""
    return F.least(pages, page + 1)


def page_jump(text: Column, pages: Column, current: Column) -> Column:
    """The number that text begins with, if it is a page; else the current page."""
    n = F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*([+-]?\d+)", 1).try_cast("long")
    return F.when((n >= 1) & (n <= pages), n).otherwise(current)


def width_clamp(width: Column) -> Column:
    return F.greatest(F.lit(400), F.least(width - 64, F.lit(900)))


def or_default(x: Column, default: float | str) -> Column:
    """Null, NaN, 0 and the empty string take the default."""
    if isinstance(default, str):
        return F.coalesce(F.nullif(x, F.lit("")), F.lit(default))
    return F.when(x.isNull() | F.isnan(x) | (x == 0), F.lit(default)).otherwise(x)


def merged_message(n: Column) -> Column:
    return F.concat(n.cast("string"), F.lit(" PDFs merged successfully"))


def notification_style(kind: Column) -> Column:
    """success, error and warning have styles of their own; all else is info."""
    return F.when(kind.isin("success", "error", "warning"), kind).otherwise(F.lit("info"))

"""Text and date functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(s: Column, delimiters: str = r"\s") -> Column:
    """What stands between delimiters (a character class), without empty parts."""
    return F.filter(F.split(s, f"[{delimiters}]+"), lambda x: x != "")


def join_words(words: Column, sep: str) -> Column:
    return F.array_join(words, sep)


def whole_number(s: Column) -> Column:
    """Integer of a text with commas between thousands; null if it is none."""
    return F.regexp_replace(F.trim(s), ",", "").try_cast("long")


def array_text(a: Column, sep: str = ",") -> Column:
    return F.array_join(a.cast("array<string>"), sep)


def parse_array(s: Column) -> Column:
    """Doubles of a text such as `1 2 3` or `[1, 2, 3]`."""
    return F.transform(tokens(F.translate(s, "[],", "   ")), lambda x: x.try_cast("double"))


def padded(n: Column, width: int = 5) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def plain_name(s: Column) -> Column:
    """Lower case, spaces as _, without quotes."""
    return F.translate(F.lower(F.trim(s)), " \"'", "_")


def truncated(x: Column, width: int, fallback: str | None = None) -> Column:
    """A number's text cut to `width` characters; `fallback` if its whole part doesn't fit."""
    s = x.cast("string")
    whole = F.length(F.split(s, r"\.")[0])
    return F.when(s.contains("E") | (whole > width), F.lit(fallback)).otherwise(F.substring(s, 1, width))


def band_label(s: Column) -> Column:
    """Bounds of a label such as `$1,000-$1,999` as a struct (lo, hi)."""
    part = lambda i: F.regexp_replace(F.regexp_extract(s, r"\$([\d,]+)\D+\$?([\d,]+)", i), ",", "").try_cast("int")
    return F.struct(part(1).alias("lo"), part(2).alias("hi"))


def first_link(line: Column) -> Column:
    """The first quoted href of a line; null if there is none."""
    return F.nullif(F.regexp_extract(line, 'href="([^"]*)"', 1), F.lit(""))


def unquoted_commas(line: Column) -> Column:
    """A line of quoted CSV with the commas inside quotes made spaces and the quotes removed."""
    parts = F.split(line, '"')
    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.translate(p, ",", " ")).otherwise(p)), "")


def without_dashes(line: Column) -> Column:
    """A PostScript line with its dash pattern made solid."""
    return F.regexp_replace(line, r"\[[^\]]*\](\s+\d+\s+setdash)", "[]$1")


def day_month_year(d: Column, mon: Column, yy: Column) -> Column:
    """Date of `5`, `Jan`, `04` in the 2000s."""
    return F.to_date(F.concat_ws(" ", F.lpad(d.cast("string"), 2, "0"), F.initcap(F.substring(mon, 1, 3)), F.concat(F.lit("20"), F.lpad(yy.cast("string"), 2, "0"))), "dd MMM yyyy")


def iso_time(ts: Column, offset: str = "Z") -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(offset))


def is_friday(d: Column) -> Column:
    return F.dayofweek(d) == 6


def bits_to_byte(bits: Column) -> Column:
    """Up to eight booleans as a byte, the first the highest; missing ones are 0."""
    return F.aggregate(F.transform(bits, lambda b, i: F.when(b, F.pow(F.lit(2.0), 7 - i)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x).cast("int")

"""Text operators as column expressions. Offsets and lengths count code points."""

from __future__ import annotations

from datetime import date, datetime
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as a word and as white space, in classes that Java and RE2 read alike.
WORD = r"[\p{L}\p{N}_'-]{2,}"
SPACE = r"[\p{Z}\s\x1c-\x1f\x85]+"
TITLE_CAP, SNIPPET_CAP = 1000, 4000


def tokens(text: Column) -> Column:
    """The distinct lower-cased words of two characters or more, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two token sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def compact(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def normalized(text: Column) -> Column:
    return F.lower(compact(text))


def meaningful(text: Column) -> Column:
    return text.rlike(r"[\p{L}\p{N}]")


def capped(text: Column, limit: int) -> Column:
    return text if limit <= 0 else F.substring(text, 1, limit)


def cap_warning(text: Column, limit: int, method: str) -> Column:
    """content_truncated:<length>><limit>:<method> where the cap cuts, else null."""
    if limit <= 0:
        return F.lit(None).cast("string")
    return F.when(F.length(text) > limit, F.concat(F.lit("content_truncated:"), F.length(text).cast("string"), F.lit(f">{limit}:{method}")))


def window(text: Column, start: Column, max_chars: int, limit: int) -> Column:
    """One page of a text from `start` (0-based): content, start, end, has_more, next. An offset past the end is null."""
    size = min(max_chars, limit)
    end = F.least(F.length(text), start + size)
    page = F.struct(F.substr(text, start + 1, end - start).alias("content"), start.alias("start"), end.alias("end"), (end < F.length(text)).alias("has_more"), F.when(end < F.length(text), end).alias("next"))
    return F.when(start <= F.length(text), page)


def chunks(df: DataFrame, text_col: str, size: int) -> DataFrame:
    """A row for each page of a text: chunk_no, chunk_start, chunk. Their concatenation is the text; an empty text has one."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text_col) - 1, F.lit(0)), F.lit(size))
    rows = df.select("*", F.posexplode(starts).alias("chunk_no", "chunk_start"))
    return rows.withColumn("chunk", F.substr(F.col(text_col), F.col("chunk_start") + 1, F.lit(size)))


def link_labels(text: Column) -> Column:
    """Markdown links as their labels."""
    return F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1")


def comma_list(value: Column, fold_case: bool = True) -> Column:
    """The trimmed, non-empty parts, each once; with fold_case the first of those that differ in case only."""
    parts = F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    if not fold_case:
        return F.array_distinct(parts)
    lower = F.transform(parts, lambda x: F.lower(x))
    return F.filter(parts, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)


def retry_after(value: Column, now: Column) -> Column:
    """Seconds to wait from a header of seconds or an HTTP date, at least 1; null if it says nothing finite."""
    text = F.trim(value)
    seconds = text.try_cast("double")
    moment = F.regexp_replace(text, r"^[A-Za-z]{3},\s*", "")
    stamp = F.try_to_timestamp(F.regexp_replace(moment, "GMT$", "+0000"), F.lit("dd MMM yyyy HH:mm:ss Z"))
    wait = F.coalesce(seconds, F.unix_micros(stamp) / 1e6 - now)
    return F.when(~F.isnan(wait) & (F.abs(wait) != float("inf")), F.greatest(wait, F.lit(1.0)))


def server_timing(value: Column) -> Column:
    """engine -> milliseconds of total_<i>_<engine>;dur=<ms> parts; a repeated engine keeps its last."""
    form = r"^\s*total_[0-9]+_(.+?);dur=([0-9.]+)\s*$"
    parts = F.filter(F.split(value, ","), lambda x: x.rlike(form) & F.regexp_extract(x, form, 2).try_cast("double").isNotNull())
    pairs = F.transform(parts, lambda x: F.struct(F.regexp_extract(x, form, 1).alias("key"), F.regexp_extract(x, form, 2).try_cast("double").alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda o: o["key"] == p["key"]))
    return F.map_from_entries(last)


def time_range(value: Column) -> Column:
    text = F.lower(F.trim(value))
    return F.when(text.isin("day", "month", "year"), text)


def _published(value: str | None) -> str | None:
    text = " ".join(str(value).split()) if value is not None else ""
    if not text:
        return None
    if len(text) in (4, 7) and text[:4].isdigit() and (len(text) == 4 or (text[4] == "-" and text[5:].isdigit())):
        return text
    for read in (lambda t: datetime.fromisoformat(t.replace("Z", "+00:00")), date.fromisoformat, parsedate_to_datetime):
        try:
            return read(text).isoformat()
        except (ValueError, TypeError, OverflowError):
            continue
    return None


@F.pandas_udf(T.StringType())
def published_at(value: pd.Series) -> pd.Series:
    """A date as text: YYYY and YYYY-MM stay, ISO and mail dates become ISO, anything else is null."""
    return value.map(_published)


def first_published(*values: Column) -> Column:
    return F.coalesce(*(published_at(v) for v in values))

"""Text preparation as Columns: everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extra stop substrings of the tf-idf flavour in order of removal, and month names.
EXTRA_STOPS = ["preauth", "from", "xxxxx", "for", "port", "sshd", "ssh", "root"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
#: English stop words, frozen here so that every dialect uses the same list.
STOP_WORDS = (
    "i me my we our ours you your yours he him his she her hers it its they them their what which who whom this that these those am is are was were be been being "
    "have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after "
    "above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor "
    "not only own same so than too very can will just don should now"
).split()


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def countgroup(raw: Column) -> Column:
    """Letters of each white-space token, lower case; tokens without letters go."""
    return F.filter(F.transform(F.split(F.lower(raw), r"\s+"), lambda t: F.regexp_replace(t, "[^a-z]", "")), lambda t: t != "")


def event_tokens(raw: Column) -> Column:
    """Count-group tokens without single letters, stop words and months."""
    stop = F.array(*map(F.lit, STOP_WORDS + MONTHS))
    return F.filter(countgroup(raw), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))


def letters_only(message: Column) -> Column:
    """Non-letters become blanks, then the extra stops go as substrings, then underscores."""
    out = F.regexp_replace(F.lower(message), "[^a-z]", " ")
    for stop in EXTRA_STOPS:
        out = F.replace(out, F.lit(stop), F.lit(""))
    return F.replace(out, F.lit("_"), F.lit(" "))


def squeeze(text: Column) -> Column:
    """Drop single-character tokens and runs of blanks."""
    return F.concat_ws(" ", F.filter(F.split(text, " +"), lambda t: F.length(t) > 1))


def strip_positions(raw: Column) -> Column:
    """Drop the first five tokens and the bracketed part of the sixth."""
    parts = words(raw)
    rest = F.slice(parts, 6, 1_000_000)
    return F.concat_ws(" ", F.transform(rest, lambda t, i: F.when(i == 0, F.split(t, r"\[").getItem(0)).otherwise(t)))


def without_stops(tokens: Column) -> Column:
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(tokens, lambda t: ~F.array_contains(stop, t))


def erase(raw: Column, patterns: list[str], columns: list[int]) -> Column:
    """Erase patterns, then drop token places."""
    out = raw
    for p in patterns:
        out = F.regexp_replace(out, p, "")
    kept = F.array(*map(F.lit, columns)) if columns else F.array().cast("array<int>")
    return F.filter(words(out), lambda t, i: ~F.array_contains(kept, i))


def date_words(raw: Column) -> Column:
    """Month names that stand next to a day or a time (approximates free date discovery)."""
    return F.regexp_extract_all(F.lower(raw), F.lit(r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+[0-9]{1,2}\b"), F.lit(1))


def timestamp(text: Column, year: int, log_type: str = "auth") -> Column:
    """Parsed time stamps: the year is put in for formats without one."""
    if log_type == "kippo":
        return F.to_timestamp(F.regexp_replace(text, r"\+0000$", ""), "yyyy-MM-dd HH:mm:ss")
    with_year = F.concat(F.regexp_replace(text, r" [0-9]+:.*$", ""), F.lit(f" {year} "), F.regexp_extract(text, r"([0-9]+:[0-9]+:[0-9]+)$", 1))
    return F.to_timestamp(with_year, "MMM d yyyy HH:mm:ss")


def pad_day(stamp: Column) -> Column:
    return F.regexp_replace(stamp, r"^([A-Z][a-z]{2}) ([0-9])( |$)", "$1  $2$3")

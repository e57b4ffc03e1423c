"""Meeting days, times of day, terms and section identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import let, squash

# Spellings of days, texts that name no time, the form of a clock range and of a term.
DAYS = {
    "Monday": ("m", "mon", "monday"),
    "Tuesday": ("t", "tu", "tue", "tues", "tuesday"),
    "Wednesday": ("w", "wed", "wednesday"),
    "Thursday": ("th", "thu", "thur", "thurs", "thursday"),
    "Friday": ("f", "fri", "friday"),
    "Saturday": ("sa", "sat", "saturday"),
    "Sunday": ("s", "su", "sun", "sunday"),
}
NO_TIME = r"(?i)^(?:tba|to be announced|online|online only|arranged|by arrangement|by appointment|asynchronous|synchronous)$"
CLOCK = r"(?i)\b(\d{1,2}):(\d{2})\s*(am|pm)?\s*(?:-|–|—|to)\s*(\d{1,2}):(\d{2})\s*(am|pm)?\b"
TERM = r"(?i)^(?:Fall|Spring|Summer|Winter)\s+\d{4}$"
SPELLINGS = "|".join(sorted((s for names in DAYS.values() for s in names), key=lambda s: (-len(s), s)))
DAY = rf"(?i)(?<![A-Za-z])({SPELLINGS})(?![A-Za-z])"


def meeting_days(times: Column) -> Column:
    """Names of the days in a times cell, in order, each once."""
    names = F.create_map(*(F.lit(x) for day, spelled in DAYS.items() for s in spelled for x in (s, day)))
    # A day is a whole run of letters, so runs are taken and looked up.
    runs = lambda t: F.regexp_extract_all(F.lower(t), F.lit("([a-z]+)"), F.lit(1))
    found = lambda t: F.array_distinct(F.array_compact(F.transform(runs(t), lambda d: F.try_element_at(names, d))))
    return let(squash(times), lambda t: F.when(t.rlike(NO_TIME), F.array().cast("array<string>")).otherwise(found(t)))


def time_of_day(times: Column) -> Column:
    """morning, afternoon or evening by the first clock time with am or pm, else empty."""
    pattern = r"(?i)(\d{1,2}):(\d{2})\s*(am|pm)"
    read = let(F.regexp_extract(times, pattern, 0), lambda t: F.struct(F.regexp_extract(t, r"^(\d+)", 1).alias("hour"), F.lower(F.right(t, F.lit(2))).alias("half")))
    return let(read, lambda r: let(_hour(r["hour"], r["half"]), _bucket))


def _hour(text: Column, half: Column) -> Column:
    hour = F.nullif(text, F.lit("")).try_cast("int") % 12 + F.when(half == "pm", 12).otherwise(0)
    return F.when(F.nullif(text, F.lit("")).try_cast("int") > 12, F.nullif(text, F.lit("")).try_cast("int") + F.when(half == "pm", 12).otherwise(0)).otherwise(hour)


def _bucket(hour: Column) -> Column:
    return F.when(hour < 12, "morning").when(hour < 17, "afternoon").when(hour.isNotNull(), "evening").otherwise("")


def has_clock_range(times: Column) -> Column:
    """Whether the first clock range has hours from 1 to 12 and minutes below 60."""
    # Hours from 1 to 12 and minutes below 60 as a form of their own, at the first range.
    first = F.regexp_extract(squash(times), CLOCK, 0)
    return first.rlike(r"(?i)^(?:0?[1-9]|1[0-2]):[0-5]\d\D.*[^\d:](?:0?[1-9]|1[0-2]):[0-5]\d(?:\D|$)")


def is_schedule(times: Column) -> Column:
    """Whether a times cell is empty, names no time, or is a clock range beside which only days stand."""
    def body(text: Column) -> Column:
        before = F.regexp_replace(F.regexp_extract(text, rf"(?s)^(.*?)(?:{CLOCK})", 1), DAY, " ")
        after = F.regexp_extract(text, rf"(?s)^.*?(?:{CLOCK})(.*)$", 7)
        clean = has_clock_range(text) & ~F.concat(before, after).rlike(r"\p{L}")
        return (text == "") | text.rlike(NO_TIME) | clean

    return let(squash(times), body)


def is_term(term: Column) -> Column:
    return squash(term).rlike(TERM)


def normalize_term(term: Column) -> Column:
    """Season with a capital and year, other texts squashed."""
    text = squash(term)
    return F.when(text.rlike(TERM), F.initcap(text)).otherwise(text)


def split_place(cell: Column) -> Column:
    """Struct of times and location: cut after the last am or pm of a cell."""
    pattern = r"(?is)^(.*\b\d{1,2}:\d{2}\s*(?:am|pm))\s*(.*)$"
    times = F.regexp_extract(cell, pattern, 1)
    return F.struct(F.when(times != "", times).otherwise(cell).alias("times"), F.regexp_extract(cell, pattern, 2).alias("location"))


def identity_key(code: Column, term: Column, section: Column) -> Column:
    """SHA-256 that names an offering."""
    return F.sha2(F.concat_ws("\u001f", code, term, section), 256)

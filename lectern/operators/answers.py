"""Citations and deterministic text answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lectern.functions.text import escape_markdown

CITATION = r"[\[【]([Ss]\d{1,9})[\]】]"


def source_records(basis: DataFrame, order: list) -> DataFrame:
    """Basis rows with place and label S1, S2, ... in order; one basis per ``answer_id``."""
    place = F.row_number().over(W.partitionBy("answer_id").orderBy(*order))
    return basis.withColumn("place", place).withColumn("label", F.concat(F.lit("S"), F.col("place")))


def cited(answers: DataFrame, basis: DataFrame) -> DataFrame:
    """(answer_id, uid, mention): the basis rows that an answer cites, in order of first mention.

    Cited by label, or by course code where the basis has the code once.
    """
    pieces = F.split("text", CITATION, -1)
    marks = F.regexp_extract_all("text", F.lit(CITATION), F.lit(1))
    at = F.transform(marks, lambda m, i: F.struct(F.upper(m).alias("label"), (F.aggregate(F.slice(pieces, 1, i + 1), F.lit(0), lambda a, p: a + F.length(p)) + F.aggregate(F.slice(marks, 1, i), F.lit(0), lambda a, m: a + F.length(m) + 2)).alias("at")))
    by_label = answers.select("answer_id", F.explode(at).alias("m")).select("answer_id", F.col("m.label").alias("label"), F.col("m.at").alias("at"))
    by_label = by_label.join(basis.select("answer_id", "label", "uid"), ["answer_id", "label"]).select("answer_id", "uid", "at")
    once = basis.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("answer_id", F.upper(F.trim("course_code"))))).where("n = 1")
    by_code = answers.join(once.select("answer_id", "uid", "course_code"), "answer_id").withColumn("at", F.instr(F.upper("text"), F.upper("course_code")) - 1).where("at >= 0")
    first = by_label.union(by_code.select("answer_id", "uid", "at")).groupBy("answer_id", "uid").agg(F.min("at").alias("at"))
    return first.withColumn("mention", F.row_number().over(W.partitionBy("answer_id").orderBy("at", "uid"))).drop("at")


def unsupported(cites: DataFrame, basis: DataFrame) -> DataFrame:
    """Citations of rows that are not in the basis."""
    return cites.join(basis.select("answer_id", "uid"), ["answer_id", "uid"], "left_anti")


def sources_event(cites: DataFrame, basis: DataFrame) -> DataFrame:
    """One JSON event per answer that lists its cited rows in order of mention."""
    rows = cites.join(basis.select("answer_id", "uid", "course_code", "title", "label"), ["answer_id", "uid"])
    record = F.struct("mention", "uid", "course_code", "title", F.col("label").alias("citation_label"))
    listed = F.transform(F.array_sort(F.collect_list(record)), lambda r: r.dropFields("mention"))
    return rows.groupBy("answer_id").agg(F.to_json(F.struct(F.lit("sources").alias("type"), listed.alias("sources"))).alias("event"))


def points_text(raw: Column, low: Column, high: Column) -> Column:
    """Points as shown: the raw cell, else the range, else N/A."""
    number = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    made = F.when(low.isNull() & high.isNull(), "N/A").when(low.eqNullSafe(high) | high.isNull(), number(low)).when(low.isNull(), number(high)).otherwise(F.concat_ws("-", number(low), number(high)))
    return F.when(F.trim(F.coalesce(raw, F.lit(""))) != "", F.trim(raw)).otherwise(made)


def course_line(place: Column, code: Column, title: Column) -> Column:
    return F.concat(place.cast("string"), F.lit(". "), code, F.lit(" - "), escape_markdown(title))


def course_list(rows: DataFrame, place: str = "place") -> DataFrame:
    """One text: a numbered line per course."""
    line = F.struct(F.col(place).alias("p"), course_line(F.col(place), F.col("course_code"), F.col("title")).alias("line"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda s: s["line"]), "\n").alias("text"))


def schedule_text(sections: Column, most: int = 4) -> Column:
    """Sections of a course, at most ``most`` lines and how many more there are."""
    line = lambda s: F.concat_ws(" | ", s["term"], s["section_id"], F.when(s["times"] == "", "TBA").otherwise(s["times"]), s["instructor"])
    shown = F.transform(F.slice(sections, 1, most), line)
    more = F.when(F.size(sections) > most, F.concat(F.lit("(+"), (F.size(sections) - most).cast("string"), F.lit(" more)")))
    return F.concat_ws("\n", F.array_join(shown, "\n"), more)


def prerequisite_text(parsed: Column) -> Column:
    """What is known about prerequisites as a sentence."""
    joined = F.array_join(parsed["codes"], ", ")
    return (
        F.when(parsed["status"] == "UNKNOWN", "Prerequisites are not listed.").when(parsed["status"] == "EXPLICIT_NONE", "No prerequisites.")
        .when(parsed["recommended_only"], F.concat(F.lit("Recommended: "), joined)).when(parsed["relationship"] == "OR", F.concat(F.lit("One of: "), joined))
        .when(parsed["relationship"] == "AND", F.concat(F.lit("All of: "), joined)).otherwise(F.concat(F.lit("Mentioned: "), joined))
    )


def markdown_export(turns: DataFrame, key: str, order: str) -> DataFrame:
    """A conversation per row as Markdown."""
    speaker = F.when(F.col("role") == "user", "User").otherwise("Assistant")
    block = F.struct(order, F.concat(F.lit("**"), speaker, F.lit("**: "), F.coalesce("text", F.lit(""))).alias("block"))
    return turns.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda s: s["block"]), "\n\n").alias("markdown"))


def json_export(turns: DataFrame, key: str, order: str) -> DataFrame:
    """A conversation per row as JSON."""
    message = F.struct(order, F.col("role"), F.col("text").alias("content"))
    listed = F.transform(F.array_sort(F.collect_list(message)), lambda s: s.dropFields(order))
    return turns.groupBy(key).agg(F.to_json(F.struct(listed.alias("messages"))).alias("json"))

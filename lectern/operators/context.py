"""Texts for an answer's context: courses with their labels, and notices about what is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lectern.plans.language import localised

#: Sections of a course that are written out, and characters of its description.
MOST_SECTIONS, MOST_CHARS = 4, 500
#: Notices by language; {count} is a number.
NOTICES = {
    "en": {"limited": "Showing {count} results; more match.", "math_scope": "Mathematics is taken as applied mathematics here.", "reference_mismatch": "You speak of {count} courses; please name them."},
    "es": {"limited": "Se muestran {count} resultados; hay más.", "math_scope": "Matemáticas se entiende aquí como matemáticas aplicadas.", "reference_mismatch": "Habla de {count} cursos; nómbrelos, por favor."},
    "fr": {"limited": "{count} résultats affichés ; il y en a d'autres.", "math_scope": "Les mathématiques sont ici les mathématiques appliquées.", "reference_mismatch": "Vous parlez de {count} cours ; nommez-les, s'il vous plaît."},
}


def course_context(code: Column, title: Column, points: Column, prerequisites: Column, description: Column, sections: Column, label: Column, most_chars: int = MOST_CHARS) -> Column:
    """A course as lines: what it is, with its label, prerequisites, the beginning of its description, and its first sections.

    ``sections`` is an array of structs with term, section_id, times, instructor,
    location, enrollment_current and enrollment_capacity; unknown parts are ``?`` or TBA.
    """
    known = lambda c, other: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(other))
    number = lambda c: F.coalesce(c.cast("string"), F.lit("?"))

    def line(s: Column) -> Column:
        return F.concat(
            F.lit("  "), known(s["term"], "?"), F.lit(", Section "), known(s["section_id"], "?"), F.lit(": "), known(s["times"], "TBA"), F.lit(", "), known(s["instructor"], "TBA"), F.lit(", "),
            known(s["location"], "TBA"), F.lit(", "), number(s["enrollment_current"]), F.lit("/"), number(s["enrollment_capacity"]))

    held = F.coalesce(F.size(sections), F.lit(0))
    shown = F.array_join(F.transform(F.slice(sections, 1, MOST_SECTIONS), line), "\n")
    more = F.when(held > MOST_SECTIONS, F.concat(F.lit("\n  (+"), (held - MOST_SECTIONS).cast("string"), F.lit(" more matching sections)"))).otherwise("")
    text = F.trim(F.coalesce(description, F.lit("")))
    told = F.when(text == "", "").otherwise(F.concat(F.lit("\n  Desc: "), F.substring(text, 1, most_chars), F.when(F.length(text) > most_chars, "...").otherwise("")))
    token = F.when(F.coalesce(label, F.lit("")) == "", "").otherwise(F.concat(F.lit(" ["), label, F.lit("]")))
    return F.concat(
        F.lit("["), known(code, "?"), F.lit("]"), token, F.lit(" "), known(title, "?"), F.lit(" | "), points, F.lit("\n  Prereqs: "), prerequisites, told, F.lit("\n"),
        F.when(held > 0, F.concat(shown, more)).otherwise("  No matching sections"))


def prompt_context(courses: DataFrame, answer: str, order: str, text: str, most: int) -> DataFrame:
    """(answer, context): the first ``most`` course texts of each answer, a blank line between them."""
    place = F.row_number().over(W.partitionBy(answer).orderBy(order))
    rows = courses.withColumn("_n", place).where(F.col("_n") <= most)
    listed = F.array_sort(F.collect_list(F.struct("_n", F.col(text).alias("t"))))
    return rows.groupBy(answer).agg(F.array_join(F.transform(listed, lambda x: x["t"]), "\n\n").alias("context"))


def notice(name: Column, language: Column, count: Column) -> Column:
    """A notice in a language, in English where that has none, with its number."""
    return F.replace(localised(NOTICES, name, language), F.lit("{count}"), F.coalesce(count.cast("string"), F.lit("?")))


def notices(truncated: Column, defaulted_from: Column, language: Column, shown: Column) -> Column:
    """Lines to add under a result: that it is cut, and that mathematics stands for a department."""
    line = lambda name: F.concat(F.lit("\n\n_"), notice(F.lit(name), language, shown), F.lit("_"))
    return F.concat(F.when(truncated, line("limited")).otherwise(""), F.when(F.coalesce(defaulted_from == "mathematics", F.lit(False)), line("math_scope")).otherwise(""))

"""Whether a course suits beginners, by explicit evidence only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.codes import level
from lectern.functions.text import fold, sentence_around

# Phrases that count as evidence.
NO_PRIOR = (
    r"\b(?:assumes?|requires?|expects?)\s+no\s+(?:prior|previous)\s+(?:(?:programming|computing|technical|subject[- ]matter)\s+)?(?:background|experience|knowledge)\b|"
    r"\bno\s+(?:prior|previous)\s+(?:(?:programming|computing|technical|subject[- ]matter)\s+)?(?:background|experience|knowledge)\s+(?:is\s+)?required\b|"
    r"\bwithout\s+(?:prior|previous)\s+(?:(?:programming|computing|technical|subject[- ]matter)\s+)?(?:background|experience|knowledge)\b"
)
FOR_BEGINNERS = (
    r"\b(?:intended|designed|suitable|appropriate)\s+for\s+(?:(?:complete|absolute)\s+)?(?:beginners?|novices?|non[- ]?majors?)\b|"
    r"\bbasic\s+introduction\s+to\b|"
    r"\bintroductory\s+course\s+(?:intended|designed)\s+for\s+(?:(?:complete|absolute)\s+)?(?:beginners?|novices?|non[- ]?majors?)\b"
)


def beginner_suitability(code: Column, title: Column, description: Column, prerequisites: Column, text: Column) -> Column:
    """Struct of status, reason, evidence and priority; ``prerequisites`` is the parsed struct of ``text``."""
    told, name = fold(description), fold(title)
    number = level(code)
    made = lambda s, r, e, p: F.struct(F.lit(s).alias("status"), F.lit(r).alias("reason"), e.alias("evidence"), F.lit(p).alias("priority"))
    advanced = name.rlike(r"\badvanced\b") | ((number >= 3000) & (number < 9999)) | F.coalesce(code.rlike(r"9999\s*$"), F.lit(False))
    return (
        F.when(told.rlike(NO_PRIOR), made("positive", "explicit_no_prior_background", sentence_around(told, NO_PRIOR), 0))
        .when(prerequisites["status"] == "EXPLICIT_NONE", made("positive", "explicit_no_prerequisites", F.trim(text), 1))
        .when(told.rlike(FOR_BEGINNERS), made("positive", "reliable_introductory_evidence", sentence_around(told, FOR_BEGINNERS), 1))
        .when(prerequisites["status"] == "LISTED", made("negative", "listed_prerequisites", F.trim(text), 2))
        .when(advanced, made("negative", "advanced_level", F.when(name != "", name).otherwise(F.trim(code)), 2))
        .otherwise(made("unknown", "unknown", F.lit(""), 3))
    )

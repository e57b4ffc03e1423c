"""Which way a question is answered, and whether the service can answer at all."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Attributes that are told of each course as facts, and those only if there are several courses.
FACTS, SHARED_FACTS = ("credits", "instructor", "enrollment"), ("description", "difficulty")


def answer_path(intent: Column, scope: Column, basis_size: Column, recall: Column, miscounted: Column) -> Column:
    """Name of the way to answer, by the first rule that holds.

    ``intent`` has query_type, suitability and day_preference, ``scope``
    attribute and operation; ``recall``: whether earlier results are asked for;
    ``miscounted``: whether their number isn't the one named.
    """
    kind = F.lower(F.coalesce(intent["query_type"], F.lit("")))
    several, attribute = basis_size > 1, F.coalesce(scope["attribute"], F.lit(""))
    days = F.size(F.coalesce(intent["day_preference"], F.array().cast("array<string>"))) > 0
    listed = (several & kind.isin("search", "recommend")) | (F.coalesce(scope["operation"], F.lit("")) == "list")
    return (
        F.when(kind == "stats", "stats").when(miscounted, "count_mismatch").when(F.coalesce(intent["suitability"], F.lit("")) == "beginner", "suitability")
        .when(attribute == "prerequisites", "prerequisites").when((attribute == "schedule") | days | (kind == "schedule"), "schedule")
        .when(attribute.isin(*FACTS) | (several & attribute.isin(*SHARED_FACTS)), "facts").when((basis_size > 0) & ~recall & listed, "list").otherwise("model")
    )


def health(mode: Column, cloud_ok: Column, local_ok: Column, has_key: Column, courses: Column) -> Column:
    """Struct status, usable and reasons of a service in mode cloud, local or hybrid, with ``courses`` loaded."""
    model_ok = F.when(mode == "cloud", cloud_ok).when(mode == "local", local_ok).otherwise(cloud_ok | local_ok)
    reasons = F.array_compact(F.array(
        F.when(~model_ok & mode.isin("cloud", "hybrid"), F.when(has_key, "cloud model unreachable").otherwise("no key for the cloud model")),
        F.when(~model_ok & mode.isin("local", "hybrid"), "local model unreachable"), F.when(courses == 0, "no courses loaded"),
    ))
    usable = model_ok & (courses > 0)
    return F.struct(F.when(usable, "ok").otherwise("degraded").alias("status"), usable.alias("usable"), reasons.alias("reasons"))

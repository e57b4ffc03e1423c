"""Prerequisite texts: status, codes, relationship and least number of courses."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from lectern.functions.codes import BODY, extract_codes
from lectern.functions.text import fold

# Phrases of the four languages, accents folded.
UNKNOWN = (
    r"\b(?:unknown|not\s+(?:listed|available|provided|specified)|no\s+(?:prerequisite|prerequisites|prereq|prereqs)\s+(?:listed|provided)|"
    r"to\s+be\s+(?:announced|determined)|tba|tbd|n/?a|no\s+(?:consta|indicado|indicados|disponible)|"
    r"non\s+(?:indique|indiques|renseigne|renseignes|disponible))\b|未列出|未提供|未说明|未知|待定|暂无信息"
)
NONE = (
    r"^(?:none|no\s+(?:prerequisites?|prereqs?)(?:\s+(?:are\s+)?required)?|(?:there\s+are\s+)?no\s+(?:prerequisites?|prereqs?)|"
    r"without\s+(?:prerequisites?|prereqs?)|sin\s+(?:prerrequisitos?|requisitos?\s+previos?)|"
    r"no\s+se\s+requieren?\s+(?:prerrequisitos?|requisitos?\s+previos?)|aucun(?:e)?\s+(?:prerequis|prealable)s?|"
    r"pas\s+de\s+(?:prerequis|prealable)s?|(?:无|没有|无需)(?:任何)?(?:先修|前置)(?:课|课程)?(?:要求)?|"
    r"不需要(?:任何)?(?:先修|前置)(?:课|课程)?)[.!。！;；\s]*$"
)
RECOMMENDED = (
    r"\b(?:recommended|recommendation|advised|suggested|recomendad[oa]s?|se\s+recomienda|aconsejad[oa]s?|"
    r"recommandees?|recommande|conseillees?|conseille)\b|建议|推荐"
)
MANDATORY = (
    r"\b(?:required|requires?|must|mandatory|need(?:ed|s)?|obligatori[oa]s?|se\s+requiere|debe(?:n)?|"
    r"obligatoires?|exigees?|requis(?:e|es|s)?|doit|doivent)\b|必须|要求|需先|须先"
)
AND_WORD = r"\b(?:and|y|et)\b|并且|以及|和|与|及|且"
OR_WORD = r"\b(?:or|o|ou)\b|或者|或"
SYMBOLS = re.compile(rf"(?P<c>{BODY})|(?P<a>{AND_WORD})|(?P<o>{OR_WORD})|(?P<l>\()|(?P<r>\))|(?P<s>[,，;；])", re.IGNORECASE)


def least_courses(text: str) -> int | None:
    """Courses that meet an expression of codes, conjunctions and brackets, null if it can't be read.

    The symbols become letters; a comma takes the only conjunction in use. Inner
    brackets and products are then reduced to their least counts until one is left.
    """
    letters = "".join(m.lastgroup for m in SYMBOLS.finditer(text))
    words = set(letters) & {"a", "o"}
    letters = letters[letters.find("c") : letters.rfind("c") + 1].join(
        [re.search(r"l*$", letters[: max(letters.find("c"), 0)])[0], re.search(r"^r*", letters[letters.rfind("c") + 1 :])[0]]
    ) if "c" in letters else ""
    if len(words) == 1:
        only = next(iter(words))
        letters = re.sub(f"{only}+", only, letters.replace("s", only))
    counts: list = [1 if x == "c" else x for x in letters]

    def reduced(flat: list) -> int | None:
        """Least count of an expression without brackets."""
        best, total, expect = None, 0, True
        for item in [*flat, "o"]:
            if isinstance(item, int) == expect:
                if expect:
                    total += item
                elif item == "o":
                    best = total if best is None else min(best, total)
                    total = 0
                elif item != "a":
                    return None
                expect = not expect
            else:
                return None
        return best

    while "r" in counts:
        close = counts.index("r")
        opens = [i for i in range(close) if counts[i] == "l"]
        if not opens:
            return None
        inner = reduced(counts[opens[-1] + 1 : close])
        if inner is None:
            return None
        counts[opens[-1] : close + 1] = [inner]
    return reduced(counts) if counts else None


@F.pandas_udf(IntegerType())
def least_courses_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([least_courses(t or "") for t in texts], index=texts.index, dtype="Int32")


def parse_prerequisites(text: Column) -> Column:
    """Struct of status, codes, relationship, recommended_only and min_count.

    Missing evidence is UNKNOWN and counts null; only an explicit statement is
    EXPLICIT_NONE and counts 0.
    """
    t = fold(text)
    codes = extract_codes(text)
    has_and, has_or, n = t.rlike(AND_WORD), t.rlike(OR_WORD), F.size(codes)
    status = F.when((t == "") | t.rlike(UNKNOWN), "UNKNOWN").when(t.rlike(NONE), "EXPLICIT_NONE").otherwise("LISTED")
    listed = status == "LISTED"
    relation = (
        F.when(~listed | (n == 0), "UNKNOWN").when(has_and & has_or, "MIXED").when(has_or, "OR").when(has_and | (n == 1), "AND").otherwise("UNKNOWN")
    )
    soft = listed & t.rlike(RECOMMENDED) & ~t.rlike(MANDATORY)
    least = (
        F.when(status == "UNKNOWN", None).when(status == "EXPLICIT_NONE", 0).when(soft, 0)
        .when((relation == "AND") & (n == 1), 1).when(relation == "UNKNOWN", None).otherwise(least_courses_udf(t))
    )
    none = F.array().cast("array<string>")
    return F.struct(
        status.alias("status"), F.when(listed, codes).otherwise(none).alias("codes"), relation.alias("relationship"),
        soft.alias("recommended_only"), least.cast("int").alias("min_count"),
    )

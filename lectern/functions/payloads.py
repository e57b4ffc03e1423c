"""Constraints on JSON payloads, compiled from a schema to one column: the first rule that a payload breaks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of events, providers, and codes of errors that a client may be told.
PROVIDERS = ("groq", "ollama", "deterministic")
INTENT_PROVIDERS = ("rule", "groq", "ollama", "minimal")
ERROR_CODES = ("first_event_timeout", "idle_timeout", "network_error", "http_error", "protocol_error", "stream_failed", "early_eof")
CITATION = {"answer_source": ("verified", "deterministic"), "prompt_basis": ("candidate",)}
#: How Spark names the types of a VARIANT, by kind of field; any other of its names is an array or object.
TYPES = {"text": r"STRING", "flag": r"BOOLEAN", "whole": r"BIGINT", "number": r"BIGINT|DOUBLE|DECIMAL.*|FLOAT", "list": r"ARRAY.*", "record": r"OBJECT.*"}


@dataclass(frozen=True)
class Rule:
    """A field of a payload: its kind, whether it may be absent or null, and its values.

    ``text`` is not blank unless ``blank`` allows it; ``least`` and ``most``
    bound numbers.
    """

    name: str
    kind: str
    optional: bool = False
    nullable: bool = False
    choices: tuple[str, ...] = ()
    least: float | None = None
    most: float | None = None
    blank: bool = False

    def broken(self, payload: Column) -> Column:
        """What is wrong with the field, null if nothing."""
        at = f"$.{self.name}"
        value = F.try_variant_get(payload, at, "variant")
        say = lambda what: F.lit(f"{self.name}: {what}")
        text = F.try_variant_get(payload, at, "string")
        checks = [(~F.schema_of_variant(value).rlike(f"^(?:{TYPES[self.kind]})$"), say(f"not a {self.kind}"))]
        if self.kind == "text" and not self.blank:
            checks.append((F.trim(F.regexp_replace(text, r"\s", " ")) == "", say("blank")))
        if self.choices:
            checks.append((~text.isin(*self.choices), say("unknown value")))
        number = F.try_variant_get(payload, at, "double")
        checks += [(number < self.least, say(f"under {self.least:g}"))] if self.least is not None else []
        checks += [(number > self.most, say(f"over {self.most:g}"))] if self.most is not None else []
        found = F.when(value.isNull(), F.lit(None).cast("string") if self.optional else say("missing"))
        found = found.when(F.is_variant_null(value), F.lit(None).cast("string") if self.nullable else say("null"))
        for test, what in checks:
            found = found.when(test, what)
        return found


def violation(payload: Column, rules: list[Rule], *more: tuple[Column, str]) -> Column:
    """The first rule that a VARIANT breaks, or the first of ``more`` (condition, words); null if none."""
    return F.coalesce(*(r.broken(payload) for r in rules), *(F.when(F.coalesce(test, F.lit(False)), what) for test, what in more), F.lit(None).cast("string"))


SOURCE = "array<struct<uid:string,course_code:string,title:string,citation_label:string,source_label:string,role:string,citation_status:string,offerings:array<struct<term:string,section_id:string,meeting_time:string,location:string>>>>"
META = [
    Rule("provider", "text", choices=PROVIDERS), Rule("fallback_available", "flag"), Rule("history_turns", "whole", least=0, most=10), Rule("revision", "whole", least=0),
    Rule("intent_provider", "text", optional=True, choices=INTENT_PROVIDERS), Rule("intent_fallback_used", "flag", optional=True), Rule("intent_fallback_reason", "text", optional=True, nullable=True),
]
FALLBACK = [Rule("action", "text", choices=("reset",)), Rule("from", "text", choices=("groq",)), Rule("to", "text", choices=("ollama",)), Rule("reason", "text")]
DONE = [Rule("provider", "text", choices=PROVIDERS), Rule("fallback_used", "flag"), Rule("fallback_reason", "text", nullable=True)]
ERROR = [
    Rule("message", "text"), Rule("code", "text", optional=True, choices=ERROR_CODES), Rule("provider", "text", optional=True, choices=PROVIDERS), Rule("fallback_used", "flag", optional=True),
    Rule("fallback_reason", "text", optional=True, nullable=True), Rule("interrupted", "flag", optional=True), Rule("partial_provider", "text", optional=True, choices=PROVIDERS),
]


def sources_broken(payload: Column) -> list[tuple[Column, str]]:
    """Rules of a sources event between its parts."""
    get = lambda path, kind: F.try_variant_get(payload, path, kind)
    courses, version = get("$.courses", "array<string>"), F.coalesce(get("$.schema_version", "int"), F.lit(1))
    answers, basis = get("$.answer_sources", SOURCE), get("$.prompt_basis", SOURCE)
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    needed = ("uid", "course_code", "title", "citation_label", "source_label")

    def bad(role: str):
        return lambda s: F.coalesce(
            blank(s[needed[0]]) | blank(s[needed[1]]) | blank(s[needed[2]]) | blank(s[needed[3]]) | blank(s[needed[4]]) | ~s["citation_label"].rlike(r"^S[1-9]\d*$")
            | (s["role"] != role) | ~s["citation_status"].isin(*CITATION[role]) | s["offerings"].isNull(), F.lit(True))

    uids = lambda x: F.transform(x, lambda s: s["uid"])
    # A source as the basis must have it: the fields that say what it is.
    facts = lambda s: F.struct(s["uid"].alias("uid"), *(s[c].alias(c) for c in needed[1:]), s["offerings"].alias("offerings"))
    labels = F.transform(basis, lambda s, i: s["citation_label"] == F.concat(F.lit("S"), (i + 1).cast("string")))
    two = version == 2
    return [
        (courses.isNull() | F.exists(courses, blank), "courses: not a list of names"),
        (~version.isin(1, 2), "schema_version: unknown value"),
        (~two & (get("$.answer_sources", "variant").isNotNull() | get("$.prompt_basis", "variant").isNotNull()), "sources without schema_version 2"),
        (two & (answers.isNull() | F.exists(answers, bad("answer_source"))), "answer_sources: broken source"),
        (two & (basis.isNull() | F.exists(basis, bad("prompt_basis"))), "prompt_basis: broken source"),
        (two & ((F.size(F.array_distinct(uids(answers))) < F.size(answers)) | (F.size(F.array_distinct(uids(basis))) < F.size(basis))), "sources: repeated uid"),
        (two & ~F.forall(labels, lambda x: x), "prompt_basis: labels not in order"),
        (two & (F.size(F.array_except(uids(answers), uids(basis))) > 0), "answer_sources: not in prompt_basis"),
        (two & (F.size(F.array_except(F.transform(answers, facts), F.transform(basis, facts))) > 0), "answer_sources: differs from prompt_basis"),
        (two & (courses != F.transform(answers, lambda s: s["course_code"])), "courses: differ from answer_sources"),
    ]


def event_violation(text: Column) -> Column:
    """The first rule that the payload of a stream event breaks, null for a good one."""
    payload = F.try_parse_json(text)
    get = lambda name, kind: F.try_variant_get(payload, f"$.{name}", kind)
    has = lambda name: get(name, "variant").isNotNull()
    kind, used, reason = get("type", "string"), get("fallback_used", "boolean"), get("fallback_reason", "string")
    by_kind = {
        "meta": violation(payload, META, (get("fallback_available", "boolean") & (get("provider", "string") != "groq"), "fallback_available: not of this provider")),
        "chunk": violation(payload, [Rule("content", "text", blank=True)], (get("content", "string") == "", "content: empty")),
        "fallback": violation(payload, FALLBACK),
        "sources": violation(payload, [], *sources_broken(payload)),
        "error": violation(
            payload, ERROR, (has("partial_content") & (F.coalesce(get("partial_content", "string"), F.lit("")) == ""), "partial_content: empty"),
            (has("partial_content") != has("partial_provider"), "partial_content and partial_provider go together"),
            (has("partial_content") & ~F.coalesce(get("interrupted", "boolean"), F.lit(False)), "partial_content without interrupted"),
            (used & reason.isNull(), "fallback_reason: missing"), (~has("fallback_used") & has("fallback_reason"), "fallback_reason without fallback_used")),
        "done": violation(payload, DONE, (used & reason.isNull(), "fallback_reason: missing"), (~used & reason.isNotNull(), "fallback_reason without fallback")),
    }
    found = F.when(payload.isNull(), F.lit("not JSON")).when(F.coalesce(~F.schema_of_variant(get("type", "variant")).eqNullSafe(F.lit("STRING")), F.lit(True)), F.lit("type: missing"))
    for name, broken in by_kind.items():
        found = found.when(kind == name, broken)
    return found.otherwise(F.lit("type: unknown value"))

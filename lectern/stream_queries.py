"""Queries of the stateful operators over finished logs, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import payloads
from lectern.queries import query, read
from lectern.streaming import chat, sessions


@query("chat_turns", """WITH pairs AS (
 SELECT conv_id, turn, role, text, lead(text) OVER w AS reply, lead(role) OVER w AS answered FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
asked AS (SELECT *, (conv_id + turn) % 5 AS way FROM pairs WHERE role = 'user' AND answered = 'assistant' AND reply <> ''),
ended AS (
 SELECT conv_id, turn, text AS question,
  CASE WHEN way = 2 THEN 'error' WHEN way = 3 AND turn % 4 = 0 THEN 'timeout' WHEN way = 3 THEN 'early end' ELSE 'commit' END AS outcome,
  CASE WHEN way = 2 THEN 'overloaded' WHEN way = 3 AND turn % 4 = 0 THEN 'no event in time' ELSE '' END AS detail,
  CASE way WHEN 0 THEN reply || reply WHEN 4 THEN reply || '<thi' ELSE reply END AS answer FROM asked),
summed AS (
 SELECT *, sum(CASE WHEN outcome = 'commit' THEN 1 ELSE 0 END) OVER v AS done, sum(CASE WHEN outcome = 'commit' THEN length(question) + length(answer) ELSE 0 END) OVER v AS chars
 FROM ended WINDOW v AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, md5(question) AS question, outcome, detail, md5(answer) AS answer,
 (SELECT count(*) FROM summed c WHERE c.conv_id = s.conv_id AND c.outcome = 'commit' AND c.done <= s.done AND s.done - c.done < 10
   AND s.chars - c.chars + length(c.question) + length(c.answer) <= 12000) AS turns
FROM summed s""")
def _(spark, d):
    done = chat.replayed(chat.chat_log(read(spark, d, "conversations")))
    return done.select("conv_id", F.md5("question").alias("question"), "outcome", "detail", F.md5("answer").alias("answer"), "turns")


@query("availability_cache", """WITH RECURSIVE e AS (
 SELECT event_id, user_id, ts, value > 20 AS ok, event_type = 'error' AS force, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (
 SELECT user_id, n, event_id, ok AS available, true AS probed, ts AS looked FROM e WHERE n = 1
 UNION ALL
 SELECT e.user_id, e.n, e.event_id, CASE WHEN e.force OR e.ts - r.looked >= INTERVAL 6 HOUR THEN e.ok ELSE r.available END, e.force OR e.ts - r.looked >= INTERVAL 6 HOUR,
  CASE WHEN e.force OR e.ts - r.looked >= INTERVAL 6 HOUR THEN e.ts ELSE r.looked END
 FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, event_id, available, probed FROM r""")
def _(spark, d):
    e = read(spark, d, "events").select("user_id", "event_id", "ts", (F.col("value") > 20).alias("ok"), (F.col("event_type") == "error").alias("force"))
    return sessions.cached_checks(e, "user_id", "ts", "event_id", "ok", 6 * 3600, "force")


@query("evicted_sessions", """WITH s AS (SELECT DISTINCT conv_id, (conv_id * 7919) % 1000 AS used, conv_id % 397 = 5 AS active FROM conversations),
placed AS (SELECT *, row_number() OVER (ORDER BY used, conv_id) AS place, count(*) OVER () AS n FROM s),
waits AS (SELECT min(place) AS oldest FROM placed WHERE active)
SELECT conv_id, used FROM placed, waits WHERE place <= n - 50 AND (oldest IS NULL OR place < oldest)""")
def _(spark, d):
    s = read(spark, d, "conversations").select("conv_id", (F.col("conv_id") * 7919 % 1000).alias("used"), (F.col("conv_id") % 397 == 5).alias("active")).distinct()
    return sessions.evicted(s, "conv_id", "used", "active", 50).select("conv_id", "used")


@query("payload_rules", "SELECT event_id, CASE WHEN CAST(props->>'k' AS INT) < 10 THEN 'k: under 10' WHEN CAST(props->>'k' AS INT) > 90 THEN 'k: over 90' END AS violation FROM events")
def _(spark, d):
    rules = [payloads.Rule("k", "whole", least=10, most=90), payloads.Rule("note", "text", optional=True)]
    return read(spark, d, "events").select("event_id", payloads.violation(F.try_parse_json("props"), rules).alias("violation"))


#: Payloads of stream events, with what is wrong with each; N is a number and T a text of the table.
PAYLOADS = [
    ('{"type":"meta","provider":"groq","fallback_available":true,"history_turns":N,"revision":3}', "CASE WHEN N > 10 THEN 'history_turns: over 10' END"),
    ('{"type":"meta","provider":"ollama","fallback_available":true,"history_turns":N,"revision":3}', "CASE WHEN N > 10 THEN 'history_turns: over 10' ELSE 'fallback_available: not of this provider' END"),
    ('{"type":"meta","provider":"groq","fallback_available":"yes","history_turns":1,"revision":3}', "'fallback_available: not a flag'"),
    ('{"type":"meta","provider":"groq","fallback_available":true,"history_turns":1.5,"revision":3}', "'history_turns: not a whole'"),
    ('{"type":"meta","provider":"groq","fallback_available":false,"history_turns":1}', "'revision: missing'"),
    ('{"type":"meta","provider":"groq","fallback_available":false,"history_turns":1,"revision":0,"intent_fallback_reason":" "}', "'intent_fallback_reason: blank'"),
    ('{"type":"chunk","content":T}', "CASE WHEN text = '' THEN 'content: empty' END"),
    ('{"type":"chunk","content":N}', "'content: not a text'"),
    ('{"type":"fallback","action":"reset","from":"groq","to":"ollama","reason":T}', "CASE WHEN trim(text) = '' THEN 'reason: blank' END"),
    ('{"type":"fallback","action":"reset","from":"ollama","to":"groq","reason":"x"}', "'from: unknown value'"),
    ('{"type":"sources","courses":[T]}', "CASE WHEN trim(text) = '' THEN 'courses: not a list of names' END"),
    ('{"type":"sources","courses":[N]}', "NULL"),
    ('{"type":"sources","schema_version":3,"courses":[]}', "'schema_version: unknown value'"),
    ('{"type":"done","provider":"groq","fallback_used":false,"fallback_reason":null}', "NULL"),
    ('{"type":"done","provider":"ollama","fallback_used":true,"fallback_reason":null}', "'fallback_reason: missing'"),
    ('{"type":"done","provider":"ollama","fallback_used":false,"fallback_reason":"x"}', "'fallback_reason without fallback'"),
    ('{"type":"error","message":T}', "CASE WHEN trim(text) = '' THEN 'message: blank' END"),
    ('{"type":"error","message":"x","code":"odd"}', "'code: unknown value'"),
    ('{"type":"error","message":"x","interrupted":true,"partial_content":T,"partial_provider":"groq"}', "CASE WHEN text = '' THEN 'partial_content: empty' END"),
    ('{"type":"error","message":"x","partial_content":T}', "CASE WHEN text = '' THEN 'partial_content: empty' ELSE 'partial_content and partial_provider go together' END"),
    ('{"type":"note","text":T}', "'type: unknown value'"),
    ('{"content":T}', "'type: missing'"),
    ('[T', "'not JSON'"),
]


@query("event_violations", "SELECT conv_id, turn, CASE (conv_id * 7 + turn) % " + str(len(PAYLOADS)) + " " + " ".join(f"WHEN {k} THEN {v.replace('N >', 'conv_id % 20 >')}" for k, (_, v) in enumerate(PAYLOADS)) + " END AS violation FROM conversations")
def _(spark, d):
    rows = read(spark, d, "conversations")
    text = F.regexp_replace(F.to_json(F.struct(F.col("text").alias("t"))), r'(?s)^\{"t":(.*)\}$', "$1")
    made = F.element_at(F.array(*(F.lit(p) for p, _ in PAYLOADS)), ((F.col("conv_id") * 7 + F.col("turn")) % len(PAYLOADS) + 1).cast("int"))
    made = F.replace(F.replace(made, F.lit("N"), (F.col("conv_id") % 20).cast("string")), F.lit("T"), text)
    return rows.select("conv_id", "turn", payloads.event_violation(made).alias("violation"))

"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a pattern over ``host`` and what follows it in a url. Its literal
tokens are the runs of letters and digits that any url it fits must hold as a
whole; tokens of all urls are counted, and a rule is filed under its rarest one.
The tokens of a url then fetch the rules that may fit, and only those run their
regular expressions. A rule without a token is tried on every url.

Two kinds of rules. ``host`` rules are a host and a path (``example.net/en/``):
they fit the host and its subdomains, case-sensitively, where the url's path
begins with the path. ``pattern`` rules are text with ``*`` (any characters),
``^`` (a character that is neither letter nor digit, or the end), a leading
``||`` (where the host or a label of it begins) and a trailing ``|`` (the end of
the url); letters in either case. The longest host rule that fits decides; with
none, a pattern rule does, allow before block; with none, the url is allowed.

Main path: DataFrame functions only, one shuffle of (page_id, url). Rules go to
all tasks if they are small; beyond that they are joined, salted because one
token may be in most urls.

Defined results: null urls and those without ``://`` have empty host and path
and fit nothing; a url without a host fits no rule; equal rows are judged
once and returned each; of host rules of one length block goes first, then the
smallest; rules of no host fit nothing, nor do null rules; other columns are ignored; an empty table
gives no rows, no rules allow all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = "kind string, action string, rule string"
#: Production rules: by host and path, then names that open a host or one of its labels.
HOST_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
PATTERN_RULES = [("block", f"||{word}-") for word in ("ads", "adult", "casino", "cheap", "free", "spam")]
#: Rule text up to which rules go to every task.
BROADCAST_BYTES = 8 << 20
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``, empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return lowered(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0))


def path(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def target(url: Column) -> Column:
    """What rules are tried on: the host in lower case, then all that follows it."""
    return F.concat(host(url), F.regexp_replace(after_scheme(url), r"^[^/?#]*", ""))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(lowered(text), F.lit("[0-9a-z]+"), F.lit(0)))


def rule_table(spark: SparkSession, hosts: list[tuple[str, str]] = HOST_RULES, patterns: list[tuple[str, str]] = PATTERN_RULES) -> DataFrame:
    """(kind, action, rule) of lists of (action, rule)."""
    return spark.createDataFrame([*(("host", a, r) for a, r in hosts), *(("pattern", a, r) for a, r in patterns)], RULES)


def compiled(rules: DataFrame) -> DataFrame:
    """Rules with regex, literal tokens and length."""
    rule, of_host = F.col("rule"), F.col("kind") == "host"
    escaped = lambda x, but="": F.regexp_replace(x, rf"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F&&[^{but}]])" if but else r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])", r"\\$1")
    inside = r"(?:[^/?#]*\.)?"
    # A host rule: the host in lower case, its path as it is; without a path the host must end there.
    name = lowered(F.substring_index(rule, "/", 1))
    has_path = F.contains(rule, F.lit("/"))
    literal = F.concat(name, F.when(has_path, F.substr(rule, F.length(name) + 1)).otherwise(F.lit("")))
    host_regex = F.concat(F.lit(f"^{inside}"), escaped(literal), F.when(has_path, F.lit("")).otherwise(F.lit(r"(?:[/?#]|$)")))
    host_edges = F.concat(F.lit("|"), literal, F.when(has_path, F.lit("*")).otherwise(F.lit("|")))
    # A pattern rule: without its anchors, every sign but * and ^ stands for itself.
    begins, ends = F.startswith(rule, F.lit("||")), F.endswith(rule, F.lit("|")) & (F.length(rule) > 2)
    body = F.regexp_replace(F.regexp_replace(rule, r"^\|\|", ""), r"\|$", "")
    signs = F.replace(F.replace(escaped(body, r"*\^"), F.lit("*"), F.lit(".*")), F.lit("^"), F.lit("(?:[^0-9a-z]|$)"))
    pattern_regex = F.concat(F.lit("(?is)"), F.when(begins, F.lit(f"^{inside}")).otherwise(F.lit("")), signs, F.when(ends, F.lit("$")).otherwise(F.lit("")))
    pattern_edges = F.concat(F.when(begins, F.lit("|")).otherwise(F.lit("*")), body, F.when(ends, F.lit("|")).otherwise(F.lit("*")))
    edges = lowered(F.when(of_host, host_edges).otherwise(pattern_edges))
    # A run beside a * may go on in the url and is no token; nor is one at an end that isn't anchored.
    whole = F.array_distinct(F.regexp_extract_all(edges, F.lit(r"(?<![0-9a-z*])[0-9a-z]+(?![0-9a-z*])"), F.lit(0)))
    fitting = rules.where(F.col("kind").isin("host", "pattern") & F.col("action").isin("allow", "block") & (rule != "")).where(~of_host | (name != ""))
    return fitting.select("kind", "action", "rule", F.when(of_host, host_regex).otherwise(pattern_regex).alias("regex"), whole.alias("tokens"), F.length("rule").alias("length")).distinct()


def indexed(rules: DataFrame, urls: DataFrame, small: bool) -> DataFrame:
    """Rules filed under the token that the fewest of ``urls`` (targets) hold; a rule without tokens under the empty one."""
    each = rules.withColumn("token", F.explode_outer("tokens"))
    named = each.select("token").where("token is not null").distinct()
    seen = urls.select(F.explode(tokens(F.col("target"))).alias("token"))
    if small:
        counts = seen.join(F.broadcast(named), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("urls"))
    else:
        counts = seen.groupBy("token").agg(F.count(F.lit(1)).alias("urls")).join(named, "token", "left_semi")
    rarity = F.struct(F.coalesce("urls", F.lit(0)), "token")
    rarest = each.join(counts, "token", "left").groupBy("kind", "action", "rule").agg(F.min_by("token", rarity).alias("token"), F.first("regex").alias("regex"), F.first("length").alias("length"))
    return rarest.withColumn("token", F.coalesce("token", F.lit("")))


def judged(pages: DataFrame, rules: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict, and the pattern rule that fits, of every row."""
    rules = compiled(rules)
    small = rules.agg(F.coalesce(F.sum(F.octet_length("regex") + 2 * F.octet_length("rule") + 64), F.lit(0))).first()[0] <= broadcast_bytes
    url = F.col("url")
    # Equal rows are one from here on; this is the only shuffle of the table while the rules are small.
    rows = pages.select(F.col("page_id").cast("long"), "url").groupBy("page_id", "url").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    index = indexed(rules, pages.select(target(url).alias("target")), small).select("token", "kind", "action", "rule", "regex", "length")
    # The empty token keeps a row of every url, and fetches the rules that have none.
    asked = F.concat(F.array(F.lit("")), F.when(host(url) != "", tokens(target(url))).otherwise(F.array().cast("array<string>")))
    asking = rows.withColumns({"target": target(url), "hosted": host(url) != ""}).withColumn("token", F.explode(asked))
    if small:
        found = asking.join(F.broadcast(index), "token", "left")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        found = asking.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(index.withColumn("salt", salts), ["token", "salt"], "left")
    fits = F.when(F.col("regex").isNotNull() & F.col("hosted"), F.expr("rlike(target, regex)"))
    by_host = F.when(fits & (F.col("kind") == "host"), F.struct(-F.col("length"), F.col("action") != "block", "rule", "action"))
    by_pattern = F.when(fits & (F.col("kind") == "pattern"), F.struct(F.col("action") != "allow", -F.col("length"), "rule", "action"))
    best = found.groupBy("page_id", "url", "copies").agg(F.min(by_host).alias("h"), F.min(by_pattern).alias("p"))
    verdict = F.coalesce("h.action", "p.action", F.lit("allow"))
    each = best.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    return each.select("page_id", host(url).alias("host"), path(url).alias("path"), F.col("h.rule").alias("rule"), verdict.alias("verdict"), F.col("p.rule").alias("pattern"))

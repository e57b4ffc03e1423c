"""Robots rules: which urls an agent may fetch.

The group of an agent is that of its longest name that begins the agent's, else
the one of ``*``; of the group's rules the longest path that begins the url's
decides, and Allow wins a tie. Rules meet urls by the beginnings of their paths, a
join on equality; paths with ``*`` or ``$`` are few and tried by host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1))


def path(url: Column) -> Column:
    """Path and query, at least a slash."""
    found = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^#]*)", 1)
    return F.when(found.startswith("/"), found).otherwise(F.concat(F.lit("/"), found))


def rules(files: DataFrame) -> DataFrame:
    """(host, agent, allow, path) of robots files (host, text).

    Agents named one after another share the rules that follow; an empty
    Disallow allows everything. Lines without a colon, comments and other fields say nothing.
    """
    lines = files.select(F.lower("host").alias("host"), F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("at", "line"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("line", "#.*$", "")))
    name, value = F.lower(F.trim(F.substring_index("line", ":", 1))), F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1))
    rows = lines.where(F.contains("line", F.lit(":"))).select("host", "at", name.alias("name"), value.alias("value")).where("name in ('user-agent', 'allow', 'disallow')")
    order = W.partitionBy("host").orderBy("at")
    begins = (F.col("name") == "user-agent") & ~F.coalesce(F.lag("name").over(order) == "user-agent", F.lit(False))
    rows = rows.withColumn("group", F.sum(begins.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    agents = rows.where("name = 'user-agent'").select("host", "group", F.lower("value").alias("agent"))
    said = rows.where("name <> 'user-agent'").select("host", "group", ((F.col("name") == "allow") | (F.col("value") == "")).alias("allow"), F.when(F.col("value") == "", "/").otherwise(F.col("value")).alias("path"))
    # A group without rules counts as well: it shields its agents from those of others.
    return agents.join(said, ["host", "group"], "left").select("host", "agent", F.coalesce("allow", F.lit(True)).alias("allow"), F.coalesce("path", F.lit("/")).alias("path")).distinct()


def pattern(rule: Column) -> Column:
    """A path with wildcards as a regular expression."""
    quoted = F.regexp_replace(rule, r"([\\.+?^()\[\]{}|$])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\\\$$", r"\$"))


def decided(urls: DataFrame, found: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """``urls`` with ``allowed`` and ``rule``, the path that decided (null: none did, so the url is allowed)."""
    name = F.lit(agent.lower())
    own = found.where((F.col("agent") == "*") | (F.startswith(name, F.col("agent")) & (F.col("agent") != "")))
    length = F.when(F.col("agent") == "*", 0).otherwise(F.length("agent"))
    best = own.groupBy("host").agg(F.max(length).alias("best"))
    own = own.join(best, "host").where(length == F.col("best")).select("host", "allow", F.col("path").alias("rule")).distinct()
    asked = urls.select(url).distinct().select(F.col(url).alias("u"), host(F.col(url)).alias("host"), path(F.col(url)).alias("p"))
    wild = F.col("rule").contains("*") | F.col("rule").endswith("$")
    # Only beginnings as long as some rule of the host can meet one.
    sizes = own.where(~wild).groupBy("host").agg(F.collect_set(F.length("rule")).alias("sizes"))
    starts = asked.join(sizes, "host").withColumn("n", F.explode("sizes")).where(F.col("n") <= F.length("p")).withColumn("rule", F.substr("p", F.lit(1), F.col("n")))
    plain = starts.join(own.where(~wild), ["host", "rule"]).select("u", "rule", "allow")
    tried = asked.join(own.where(wild).withColumn("regex", pattern(F.col("rule"))), "host").where(F.expr("rlike(p, regex)")).select("u", "rule", "allow")
    verdict = plain.union(tried).groupBy("u").agg(F.max(F.struct(F.length("rule").alias("n"), "allow", "rule")).alias("v"))
    rows = urls.join(verdict, urls[url] == verdict["u"], "left")
    return rows.select(*(urls[c] for c in urls.columns), F.coalesce("v.allow", F.lit(True)).alias("allowed"), F.col("v.rule").alias("rule"))

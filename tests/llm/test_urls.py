"""URL rules: verdicts against trying every rule on every url, the index, and the edges."""

import random
import re

import pytest

from lectern.llm import urls

KIND = "page_id long, url string, host string, token string, `a.b` map<string,int>"


def parts(url):
    if url is None or "://" not in url:
        return "", "", ""
    rest = url.split("://", 1)[1]
    name = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(name) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), name), path, rest[len(name) :]


def host_fits(rule, host, path):
    name, slash, rest = rule.partition("/")
    name = name.lower()
    return bool(name and host) and (host == name or host.endswith("." + name)) and path.startswith(slash + rest)


def pattern_fits(rule, host, rest):
    if not rule or not host:
        return False
    body, end = rule.removeprefix("||"), ""
    if body.endswith("|") and len(rule) > 2:
        body, end = body[:-1], r"\Z"
    signs = "".join(".*" if c == "*" else r"(?:[^0-9a-z]|\Z)" if c == "^" else re.escape(c) for c in body)
    return re.search((r"\A(?:[^/?#]*\.)?" if rule.startswith("||") else "") + signs + end, host + rest, re.I | re.S | re.A) is not None


def brute(url, hosts, patterns):
    host, path, rest = parts(url)
    by_host = min(((-len(r), a != "block", r, a) for a, r in hosts if host_fits(r, host, path)), default=None)
    by_pattern = min(((a != "allow", -len(r), r, a) for a, r in patterns if pattern_fits(r, host, rest)), default=None)
    return host, path, by_host and by_host[2], (by_host or by_pattern or ("", "", "", "allow"))[3], by_pattern and by_pattern[2]


PATTERNS = [*urls.PATTERN_RULES, ("block", "/banner/"), ("block", "*track*"), ("allow", "||good.ads-x.org^"), ("block", "ref=x|"), ("block", "^utm_source^"), ("block", "||a.b"), ("allow", "(+)"), ("block", "pixel")]
HOSTS = [*urls.HOST_RULES, ("block", "net"), ("allow", "x.org/A/"), ("block", "x.org/a/"), ("block", "b.net/a/"), ("allow", "net/a/b/"), ("allow", "org/fr/"), ("block", "org/fr/"), ("block", "/nohost"), ("block", "d\\E.net/"), ("block", "ex*mple.com/")]


def made(rng):
    names = ["example", "net", "ads-x", "www", "b", "a", "x", "Org", "casino-win", "good", "xcasino-y", "d\\E", "exmple"]
    host = ".".join(rng.choices(names, k=rng.randrange(0, 4))) + rng.choice(["", ".net", ".NET", ".org", ".com", ".example.net", ".net:80", "."])
    path = "".join("/" + rng.choice(["en", "fr", "de", "a", "A", "b", "banner", "track", "(+)", "pixel1", "é", ""]) for _ in range(rng.randrange(0, 4)))
    return rng.choice(["http://", "https://", "HTTP://", "", "://", "x://y://"]) + host + path + rng.choice(["", "?utm_source=feed", "?page=2&ref=x", "#top", "?u=http://b.net/en/", "?ref=xy", "/?x#y"])


@pytest.mark.parametrize("limit", [urls.BROADCAST_BYTES, 0])
def test_verdicts(spark, limit):
    rng = random.Random(5)
    texts = [made(rng) for _ in range(1500)] + [None, "", "://", "http://", "http://net", "http://net/", "http://NET/", "http:///en/", "a://b.net/\n/en/", "http://x.net/" + "a/" * 50_000] + ["http://one.net/"] * 400
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)]
    rows += rows[:20]
    pages = spark.createDataFrame([(i, t, "clash", "clash", {"k": 1}) for i, t in rows], KIND).repartition(5)
    rules = urls.rule_table(spark, HOSTS, PATTERNS).union(spark.createDataFrame([("host", "block", None), (None, "block", "com/"), ("host", None, "com/"), ("pattern", "block", "")], urls.RULES))
    got = [tuple(r) for r in urls.judged(pages, rules, limit).collect()]
    want = [(i, *brute(t, HOSTS, PATTERNS)) for i, t in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r[3] for r in got} >= {"net/", "example.net/en/", "net/a/b/", None}


def test_rarest_token(spark):
    seen = spark.createDataFrame([("www.a.net/x/",)] * 5 + [("b.net/casino/",)] * 2, "target string")
    rules = urls.compiled(urls.rule_table(spark, [("block", "a.net/x/"), ("block", "net/")], [("block", "/casino^"), ("block", "*asin*"), ("block", "||unseen.net^")]))
    index = {r["rule"]: r["token"] for r in urls.indexed(rules, seen, True).collect()}
    assert index == {"a.net/x/": "a", "net/": "net", "/casino^": "casino", "*asin*": "", "||unseen.net^": "unseen"}
    assert index == {r["rule"]: r["token"] for r in urls.indexed(rules, seen, False).collect()}


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/", "", "", None)], KIND)
    assert urls.judged(pages.limit(0), urls.rule_table(spark)).count() == 0
    assert [tuple(r) for r in urls.judged(pages, urls.rule_table(spark, [], []).limit(0)).collect()] == [(1, "a.net", "/", None, "allow", None)]


def test_no_python_on_the_way(spark):
    plan = urls.judged(spark.createDataFrame([(1, "http://a.net/", "", "", None)], KIND), urls.rule_table(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan

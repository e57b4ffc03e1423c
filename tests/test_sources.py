"""Course pages, robots rules, dictionaries, quarantine and evidence against plain Python."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from lectern.operators import dictionary, evidence, robots
from lectern.sources import course_pages, readers

PAGE = """<html><head><title>Bulletin &amp; more</title></head><body><h1>not here</h1><main><h1>Computing <em>Dept</em></h1>
<div class="courseblock"><p class="courseblocktitle">outside the root</p></div>
<div id="sc_courseblock"><div class="x courseblock"><p class="courseblocktitle"><strong>COMS W1004 Intro to <i>Things</i>. 3 points.</strong></p>
<p class="courseblockdesc">First<br>text</p><p>extra</p><div><p>not direct</p></div>
<div class="desc_sched"><table class="scheduletbl"><tr><td colspan="6">Fall 2025: COMS W1004</td></tr>
<tr><th>Course Number</th><th>Section/Call Number</th><th>Times/Location</th><th>Instructor</th><th>Points</th><th>Enrollment</th></tr>
<tr><td>COMS 1004</td><td>001/1234</td><td>M W 10:10am - 11:25am<br>501 Hall</td><td></td><td>3.00</td><td>20/30</td></tr>
<tr><td>COMS 1004</td><td>001/1234</td><td>M W 10:10am - 11:25am<br>501 Hall</td><td></td><td>4.00</td><td>1/2</td></tr>
<tr><td></td><td></td><td></td><td></td></tr><tr><td></td><td></td><td>TBA</td><td></td></tr>
<tr><td>Spring 2026</td></tr><tr><td>COMS 1004</td><td>002/99</td><td>TBA</td><td>A. Person</td></tr>
<tr><th>Instructor</th><th>Section/Call Number</th><th>Course Number</th></tr><tr><td>B. Person</td><td>003/1</td><td>COMS 1004</td></tr></table>
<table class="other"><tr><td>a</td><td>b</td></tr></table></div></div>
<div class="courseblock"><p>no title<p class="courseblocktitle">second"""


def test_course_pages(spark):
    pages = spark.createDataFrame([("u", PAGE), ("v", "<p>nothing</p>"), ("w", None), ("x", "")], "url string, html string")
    blocks = course_pages.courses(pages).orderBy("block").collect()
    assert [(b["page_title"], b["department"], b["course_code"], b["title"], b["points_raw"]) for b in blocks][0] == ("Bulletin & more", "Computing Dept", "COMS W1004", "Intro to Things", "3 points")
    assert len(blocks) == 2 and [tuple(p) for p in blocks[0]["paragraphs"]] == [("courseblockdesc", "First text"), ("extra_paragraph", "extra")]
    rows = course_pages.sections(course_pages.courses(pages)).orderBy("place").collect()
    assert [(r["term"], r["catalog_ref"], r["section_call_number"], r["times"], r["location"], r["instructor"], r["points"], r["enrollment_current"], r["enrollment_capacity"]) for r in rows] == [
        ("Fall 2025", "COMS W1004", "001/1234", "M W 10:10am - 11:25am", "501 Hall", "", "3.00", 20, 30),
        ("Spring 2026", "", "002/99", "TBA", "", "A. Person", "", None, None),
        # The last headers lack three columns, which go by their place: "003/1" isn't in the third one.
        ("Spring 2026", "", "003/1", "COMS 1004", "", "B. Person", "", None, None),
    ]
    course_pages.register(spark)
    pages.createOrReplaceTempView("raw_pages")
    assert [r[0] for r in spark.sql("select b.title from raw_pages, lateral course_blocks(html) b where b.block = 0").collect()] == ["COMS W1004 Intro to Things . 3 points."]


def test_robots(spark):
    text = "User-agent: a\nUser-agent: bot\nDisallow: /x\nAllow: /x/y\n\nUser-agent: *\nDisallow: /\nUser-agent: bottle\nDisallow:\nUser-agent: none"
    found = robots.rules(spark.createDataFrame([("H.org", text), ("e.org", None), ("q.org", "User-agent: *\nDisallow: /p$\nDisallow: /*.gif\nAllow: /a.b\nDisallow: /a")], "host string, text string"))
    urls = ["https://h.org/x/yz", "https://h.org/xx", "https://h.org/", "https://e.org/x", "https://q.org/p", "https://q.org/pp", "https://q.org/d/e.gif?x", "https://q.org/a.b", "https://q.org/axb", "https://q.org", "nonsense", None]
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    said = lambda agent: {r["url"]: (r["allowed"], r["rule"]) for r in robots.decided(rows, found, agent).collect()}
    bot, other, bottle, none = said("Bot/2"), said("crawler"), said("bottler"), said("none")
    assert bot["https://h.org/x/yz"] == (True, "/x/y") and bot["https://h.org/xx"] == (False, "/x") and bot["https://h.org/"] == (True, None)
    assert other["https://h.org/"] == (False, "/") and bottle["https://h.org/xx"] == (True, "/") == none["https://h.org/xx"]
    assert [other[u] for u in urls[3:]] == [(True, None), (False, "/p$"), (True, None), (False, "/*.gif"), (True, "/a.b"), (False, "/a"), (True, None), (True, None), (True, None)]
    assert len(other) == len(urls)


def test_dictionary_looks_only_where_a_phrase_may_begin(spark):
    """Of the places of a long text hardly any but those of phrases reach the join, at borders of pieces too."""
    body = "x\U0001d7d8y" * 1000
    places = [0, 500, dictionary.PIECE - 1, 2 * dictionary.PIECE - 5, 2950]
    for at in places:
        body = body[:at] + "begins here" + body[at + 11 :]
    terms = spark.createDataFrame([("begins here",), ("Begins",), ("x!",)], "p string")
    got = dictionary.found(spark.createDataFrame([(1, body), (1, "none")], "k long, t string"), "k", "t", terms, "p")
    want = {(p, m.start()) for p in ("begins here", "Begins") for m in re.finditer(p.lower(), body)}
    assert {(r["phrase"], r["start"]) for r in got.collect()} == want and got.count() == len(want)
    heads = spark.createDataFrame([(8, "begins h"), (4, "begi"), (2, "x!")], "n int, head string").coalesce(1)
    maps = {n: np.zeros(1 << (dictionary.BITS - 6), dtype="<i8") for n in (2, 4, 8)}
    for r in heads.mapInPandas(dictionary.phrase_slots, "n int, word int, bits long").collect():
        maps[r["n"]][r["word"]] |= r["bits"]
    asked = spark.createDataFrame([(body[: dictionary.PIECE + 11],)], "t string").select(dictionary.places_of({n: m.tobytes() for n, m in maps.items()})("t").alias("a")).first()["a"]
    assert {c >> 5 for c in asked if c & 31 == 4} >= {0, 500, dictionary.PIECE - 1} and len(asked) < 20


def test_dictionary(spark):
    """Thousands of phrases, against finding each; words only; the first of each text."""
    rng = random.Random(3)
    letters = "abé日 "
    phrases = {"".join(rng.choices(letters, k=rng.choice([1, 2, 3, 5, 9, 17, 40]))) for _ in range(3000)} | {"A b"}
    texts = [(i, "".join(rng.choices(letters, k=rng.randrange(700)))) for i in range(12)] + [(50, None), (51, ""), (52, max(phrases, key=len) * 9), (52, "A b")]
    want = {(i, p, m.start()) for i, t in texts for p in phrases if t for m in re.finditer(f"(?={re.escape(p.lower())})", t.lower())}
    df, terms = spark.createDataFrame(texts, "k long, t string"), spark.createDataFrame([(p,) for p in phrases] + [(None,), ("",), ("A b",)], "p string")
    for limit in (dictionary.BROADCAST_BYTES, 0):
        got = dictionary.found(df, "k", "t", terms, "p", broadcast_bytes=limit)
        assert {tuple(r) for r in got.collect()} == want
    firsts = {r["k"]: (r["phrase"], r["start"]) for r in dictionary.first_found(got, "k").collect()}
    for k in {i for i, _, _ in want}:
        start, _, phrase = min((s, -len(p), p) for i, p, s in want if i == k)
        assert firsts[k] == (phrase, start)
    whole = dictionary.found(spark.createDataFrame([(1, "cs cs50 (CS) 课cs课")], "k long, t string"), "k", "t", spark.createDataFrame([("cs",)], "p string"), "p", words=True)
    assert sorted(r["start"] for r in whole.collect()) == [0, 9, 14]
    assert dictionary.found(df, "k", "t", terms.limit(0), "p").count() == 0


def test_quarantine(spark, tmp_path):
    uid = lambda c: c * 40
    files = {f"{uid('a')}.json": f'{{"course_uid": "{uid("a")}", "title": "t"}}', f"{uid('b')}.json": '{"course_uid": "cut of', "c.json": f'{{"course_uid": "{uid("c")}"}}', "d.json": '{"course_uid": "short"}', "e.json": "[1, 2]", "f.json": "", "g.json": '{"other": 1}'}
    (tmp_path / "in").mkdir()
    for name, text in files.items():
        (tmp_path / "in" / name).write_text(text)
    rows = readers.quarantined(spark, str(tmp_path / "in"))
    got = {r["file_name"]: r["problem"] for r in rows.collect()}
    # An empty file has no row; JSON that isn't an object of the schema can't be read.
    assert got == {f"{uid('a')}.json": None, f"{uid('b')}.json": "unreadable", "c.json": "file_name_mismatch", "d.json": "invalid_uid", "e.json": "unreadable", "g.json": "unreadable"}
    counts = {r["sink"]: r["rows"] for r in readers.split_sinks(rows, str(tmp_path / "out")).collect()}
    assert counts == {"good": 1, "mismatched": 2, "unreadable": 3}
    pages = spark.createDataFrame([("https://h/a/b?x=1", True), ("https://h/c", True), ("", True), ("https://h/d", False)], "source_page_url string, is_course_page boolean")
    saved = pages.select(F.concat(F.lit("r__"), readers.file_name(F.col("source_page_url")), F.lit(".html")).alias("name"), F.lit("<p>").alias("html")).limit(1)
    assert {r["source_page_url"]: r["problem"] for r in readers.snapshot_pages(pages, saved, "r").collect()} == {"https://h/a/b?x=1": None, "https://h/c": "no_file", "": "no_url"}


def test_points_in_a_source():
    assert evidence.points_of("3") == evidence.points_of("3.0 points") == evidence.points_of("three") == (3.0, 3.0) and evidence.points_of("3 to 4.5 pts") == (3.0, 4.5)
    assert [evidence.points_of(x) for x in ("4-3", "31", "three four", "x", "")] == [None] * 5
    source = "003/12345 for 3 points, 3.0 credits or three credits; 13 points, a3, 3: 2-3 points 3"
    assert [source[a:b] for a, b in evidence.number_spans(source, "3.00")] == ["3 points", "3.0 credits", "three credits", "3"]


def test_evidence_bundle(spark):
    text = "Intro 3 points. FALL 2025 001/111 by Ada, 4 points; Fall 2025\n 002/222 by Bo, 3.0 pts Spring 2026 far " + "x" * 300 + " 003/333 by Cy"
    claims = [(1, None, "points", "3"), (1, None, "title", "intro"), (1, None, "title", ""), (1, None, "description", None), (1, 0, "term", "Fall 2025"), (1, 0, "section_id", "001/111"), (1, 0, "points", "4.0"), (1, 0, "instructor", "Bo"),
              (1, 1, "term", "fall 2025"), (1, 1, "section_id", "002/222"), (1, 1, "points", "three"), (1, 1, "instructor", "bo"), (1, 2, "term", "Spring 2026"), (1, 2, "section_id", "003/333"), (1, 2, "instructor", "Cy"), (2, None, "title", "gone"), (1, None, "title", "intro")]
    rows = evidence.bundle(spark.createDataFrame([(1, text), (3, "x")], "doc_id long, text string"), spark.createDataFrame(claims, "doc_id long, section long, field string, value string")).collect()
    flat = " ".join(text.split())
    got = {(r["doc_id"], r["section"], r["field"], r["value"]): (flat[r["start"] : r["stop"]] if r["verified"] else None, r["identity_associated"]) for r in rows}
    assert len(rows) == len({*claims}) and got == {
        (1, None, "points", "3"): ("3", False), (1, None, "title", "intro"): ("Intro", False), (1, None, "title", ""): (None, False), (1, None, "description", ""): (None, False),
        (1, 0, "term", "Fall 2025"): ("FALL 2025", True), (1, 0, "section_id", "001/111"): ("001/111", True), (1, 0, "points", "4.0"): ("4 points", True), (1, 0, "instructor", "Bo"): (None, True),
        (1, 1, "term", "fall 2025"): ("Fall 2025", True), (1, 1, "section_id", "002/222"): ("002/222", True), (1, 1, "points", "three"): ("3.0 pts", True), (1, 1, "instructor", "bo"): ("Bo", True),
        # Term and id are too far apart to be one place; each is somewhere, the teacher isn't near.
        (1, 2, "term", "Spring 2026"): ("Spring 2026", False), (1, 2, "section_id", "003/333"): ("003/333", False), (1, 2, "instructor", "Cy"): (None, False), (2, None, "title", "gone"): (None, False),
    }
    assert all(r["quote"] in flat and (r["quote"] != "") == r["verified"] for r in rows)


def test_points_of_a_text_are_read_once(monkeypatch):
    import pandas as pd

    from lectern.operators import evidence

    read, real = [], evidence.numbers_said
    monkeypatch.setattr(evidence, "numbers_said", lambda source: read.append(source) or real(source))
    asked = [{"section": n, "field": "points", "value": f"{n}.0"} for n in range(1, 5)]
    texts = pd.DataFrame({"doc_id": [7, 8], "source": ["Fall 2025 001/111 3 points, 4 credits", ""], "asked": [asked, None]})
    rows = pd.concat(evidence.spans_of_claims(iter([texts])))
    assert len(read) == 1 and rows[rows["kind"] == "claim"][["doc_id", "value", "said"]].values.tolist() == [[7, "3.0", "3 points"], [7, "4.0", "4 credits"]]


def test_hulls(spark):
    rows = spark.createDataFrame([("k", 0, 4), ("k", 1, 2), ("k", 6, 8), ("k", 20, 22), ("k", 21, 30), ("j", 5, 6)], "k string, start int, stop int")
    assert sorted(tuple(r) for r in evidence.hulls(rows, "k", 2).collect()) == [("j", 5, 6, 1), ("k", 0, 8, 3), ("k", 20, 30, 2)]


def test_evidence_keeps_packed_spans(spark):
    """Spans are read from packed columns and not from a checkpoint, which took nine times the room."""
    from lectern import record_queries  # noqa: F401  registers its queries
    from lectern.queries import QUERIES

    plan = QUERIES["evidence_bundle"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "said" in plan

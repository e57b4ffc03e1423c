"""Fill-in-middle: boundary sets against plain lists, outputs against brute force, and the edges."""

import hashlib
import random

import numpy as np
import pytest
import regex

from lectern.llm import infill

KIND = "doc_id long, text string, form string, n string, body string, _fim string, `a.b` map<string,int>"


def brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    form = "plain" if not text or any(m in text for m in infill.MARKS) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
    out = {"plain": text, "psm": f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}", "spm": f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"}[form]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, n, form, None if form == "plain" else a, None if form == "plain" else b - a, sha(out), sha(text))


@pytest.mark.parametrize("alphabet", ["a", "aé", "é", "日本a", "😀", "ab日é😀"])
@pytest.mark.parametrize("size", [0, 1, 7, 65_535, 65_536, 65_537, 150_001])
def test_code_points(alphabet, size):
    rng = random.Random(size)
    text = "".join(rng.choices(alphabet, k=size))
    held = infill.code_points(text.encode())
    assert len(held) == size + 1
    for rank in {0, size, size // 2, min(size, 65_536), *(rng.randrange(size + 1) for _ in range(20))}:
        assert held.select(rank) == len(text[:rank].encode())


def test_containers():
    rng = np.random.default_rng(1)
    kinds = set()
    for share in (1.0, 0.001, 0.03, 0.2, 0.5, 0.97, 0.9999):
        member = rng.random(infill.CHUNK) < share
        held, places = infill.Container(member), np.flatnonzero(member)
        kinds.add(held.kind)
        assert held.size == len(places) and held.bytes <= infill.BITMAP
        assert [held.select(int(k)) for k in range(0, len(places), 97)] == places[::97].tolist()
    assert kinds == {"run", "array", "bitmap"}


def test_other_units():
    unit = regex.compile(r"\S+\s*")
    rng = random.Random(4)
    for words in (0, 1, 5, 30_000):
        text = "  " * (words > 1) + " ".join(rng.choices(["é", "word", "日本"], k=words))
        ends = [m.end() for m in unit.finditer(text)]
        cuts = [0, *ends[:-1], *([len(text)] if ends else [])]
        held = infill.matches(text.encode(), unit)
        assert len(held) == words + 1 and [held.select(k) for k in range(0, words + 1, 101)] == [len(text[: cuts[k]].encode()) for k in range(0, words + 1, 101)]


def test_digests(spark):
    rng = random.Random(2)
    texts = [None, "", " ", "a", "é", "<P>", "x<S>y", "x<M", "<<S", "S><P", "<P<S<M", "\n\r\n", "日本" * 50_000, "x" * 200_000]
    texts += ["".join(rng.choices("<PSM>aé😀 ", k=rng.randrange(40))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (7, "a second row"), (7, "a second row"), (-3, "below")]
    df = spark.createDataFrame([(i, t, "f", "n", "b", "c", {"k": 1}) for i, t in rows], KIND)
    got = [tuple(r) for r in infill.digests(df).collect()]
    assert sorted(got, key=repr) == sorted((brute(*r) for r in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"} and all(r[6] == hashlib.sha256((dict(rows)[r[0]] or "").encode()).hexdigest() for r in got if r[0] not in (7, None))
    assert infill.digests(df.limit(0)).count() == 0


def test_transformed_keeps_columns(spark):
    df = spark.createDataFrame([(1, "some text to cut", "f", "n", "b", "c", {"k": 1}), (2, None, "f", "n", "b", "c", None)], KIND)
    out = infill.transformed(df, unit=r"\w+\s*", plain_from=100, spm_below=0)
    assert out.columns == ["doc_id", "text", "body", "a.b", "n", "form", "prefix_units", "middle_units", "output"]
    one, two = out.orderBy("doc_id").collect()
    assert one["n"] == 4 and one["form"] == "psm" and one["body"] == "b" and one["a.b"] == {"k": 1} and (two["n"], two["form"], two["output"]) == (0, "plain", "")
    p, rest = one["output"][3:].split("<S>")
    s, m = rest.split("<M>")
    assert p + m + s == "some text to cut" and len(p.split()) == one["prefix_units"] and len(m.split()) == one["middle_units"]
    for marks in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("ab", "ba", "c"), ("aa", "b", "c"), ("abc", "b", "x")):
        with pytest.raises(ValueError):
            infill.transformed(df, marks=marks)

"""Fill-in-the-middle against plain Python, and the succinct index against counting."""

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomery.llm import fill_middle


def plain(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    low, high = sorted((a % (n + 1), b % (n + 1)))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or c % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    p, m, s = text[:low], text[low:high], text[high:]
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if d % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, n, form, len(p), len(m), sha(out), sha(text)


KEY = lambda r: tuple((x is None, x if x is not None else 0) for x in r)


def same(df, rows):
    got = sorted((tuple(r) for r in fill_middle.fill_digest(df).collect()), key=KEY)
    assert got == sorted((plain(*r) for r in rows), key=KEY)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {plain(*r)[2] for r in rows} == {"plain", "psm", "spm"}
    same(docs, rows)


def test_odd_texts(spark, make_docs):
    texts = [None, "", "a", "é", "😀", "<P>", "x<S>y", "<M", "a<" * 40, "<P" * 9 + "S>", ">" * 50, "日本語の文章" * 30, "é" * 64, "\n", "z" * 511, "é" * 512, "😀" * 513]
    texts += ["long é text 😀 " * 20_000]
    same(make_docs(texts), list(enumerate(texts)))
    same(make_docs([]), [])


def test_null_and_repeated_ids(spark):
    rows = [(None, "some text"), (None, None), (5, "twice é"), (5, "twice é"), (5, "other")]
    same(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_columns_are_kept(spark):
    df = spark.createDataFrame([(1, "abc", "mine", [1], "x")], "doc_id long, text string, form string, n array<int>, row string")
    out = fill_middle.fill_in_middle(df)
    assert out.columns == ["doc_id", "text", "form_", "n_", "row", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert out.select("form_", "n_", "row", "n").first() == ("mine", [1], "x", 3)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=300), max_size=12))
def test_rank_and_select(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    begins = [i for i, b in enumerate(data.tolist()) if b & 0xC0 != 0x80]
    index = fill_middle.Boundaries(data)
    assert index.total == len(begins)
    places = np.arange(len(data) + 1)
    assert index.rank(places).tolist() == np.searchsorted(begins, places).tolist()
    assert index.select(np.arange(len(begins) + 2)).tolist() == [*begins, len(data), len(data)]

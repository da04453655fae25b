"""Counts after edits against counting the edited text anew."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from loomery.llm import token_counts as tc

count = lambda x: len(tc.encoder().encode_ordinary(x))
TEXT = st.text(alphabet=st.sampled_from(list("ab1'. \n\té世!s ")), max_size=120)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(0, 200), st.integers(0, 30), TEXT), max_size=6), st.integers(1, 12))
def test_edits_match_recount(text, edits, leaf):
    tree = tc.TokenTree(text, count, leaf)
    assert tree.total == count(text) and tree.text == text
    for start, size, new in edits:
        start = min(start, len(text))
        end = min(start + size, len(text))
        tree.edit(start, end, new)
        text = text[:start] + new + text[end:]
        assert tree.text == text
        assert tree.total == count(text)


def test_only_touched_leaves_are_encoded():
    text = "some words here and there " * 400
    tree = tc.TokenTree(text, count)
    built = tree.encoded
    tree.edit(5000, 5003, "xyz")
    assert tree.encoded - built <= 3 < built
    assert tree.total == count(tree.text)


def test_query_over_documents(make_docs, spark, sf):
    texts = [None, "", " ", "write to a.b@c.org or +49 30 1234567 now", "at 10.0.0.1 it is", "x" * 5000]
    got = [tuple(r) for r in tc.edited_counts(make_docs(texts)).orderBy("doc_id").collect()]
    for (i, n, edits, after, leaves, again), t in zip(got, texts):
        t = t or ""
        masked = t
        for a, b, new in reversed(tc.mask_edits(t)):
            masked = masked[:a] + new + masked[b:]
        assert (n, after, edits) == (count(t), count(masked), len(tc.mask_edits(t)))
    assert [g[2] for g in got] == [0, 0, 0, 2, 1, 0]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for r, d in zip(tc.edited_counts(docs).orderBy("doc_id").collect(), docs.orderBy("doc_id").collect()):
        masked = d.text
        for a, b, new in reversed(tc.mask_edits(d.text)):
            masked = masked[:a] + new + masked[b:]
        assert (r.n_tokens, r.n_tokens_edited) == (count(d.text), count(masked))
    assert tc.edited_counts(make_docs([])).count() == 0


def test_cuts_are_safe_in_any_text():
    """Counts of leaves add up whatever a text is made of, also without single blanks."""
    rng = random.Random(4)
    parts = ["word", "don't", "'s", "''s", "  ", " ", "\n\n", "\t", "12", "½", "é", "汉字", "。", "...", "'", "I'll", "_", "x1", "😀"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        tree = tc.TokenTree(text, count, leaf=5)
        assert tree.total == count(text) and tree.text == text
    assert len(tc.TokenTree("two  blanks " * 2000, count).leaves) > 30 and len(tc.TokenTree("汉字汉字。" * 2000, count).leaves) > 10


def test_trees_as_a_table(spark):
    rng = random.Random(5)
    texts = {i: " ".join(rng.choice(["alpha", "beta", "don't", "12"]) for _ in range(600)) for i in range(6)} | {6: "", 7: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    edits = [(0, 5, 9, "new words here"), (0, 2000, 2001, ""), (1, 0, 0, "long " * 900), (6, 0, 0, "from nothing"), (99, 0, 1, "x"), (2, 10, 20, "a"), (2, 15, 30, "overlaps"), (3, 10**6, 10**6, " end"), (None, 0, 1, "y")]
    trees = tc.build_trees(docs)
    once = tc.edit_trees(trees, spark.createDataFrame(edits, "doc_id long, start int, end int, text string"))
    again = {r.doc_id: r for r in tc.edit_trees(once, spark.createDataFrame([(1, 100, 4000, "!")], "doc_id long, start int, end int, text string")).collect()}
    first = {r.doc_id: r for r in once.collect()}
    want = {i: t or "" for i, t in texts.items()}
    want[0] = want[0][:5] + "new words here" + want[0][9:2000] + want[0][2001:]
    want[1], want[6], want[2], want[3] = "long " * 900 + want[1], "from nothing", want[2][:10] + "a" + want[2][20:], want[3] + " end"
    for i, text in want.items():
        assert "".join(first[i].leaves) == text and first[i].n_tokens == count(text) == sum(first[i].tokens)
    assert first[0].n_encoded <= 4 and first[4].n_encoded == 0 and max(map(len, first[1].leaves)) < 2 * tc.LEAF
    want[1] = want[1][:100] + "!" + want[1][4000:]
    assert again[1].n_tokens == count(want[1]) and again[1].n_encoded <= 3

"""Similar names: every pair that a comparison of all with all finds, and no other."""

import random

import duckdb
import pytest

from loomery.functions.text import damerau, osa
from loomery.operators import linking


def grams(t):
    padded = f" {t} "
    return {padded[i : i + 3] for i in range(len(t))}


def alike(a, b):
    if not a or not b:
        return 0.0
    n = max(len(a), len(b))
    allowed = min(3, n // 3 + 1)
    d = osa(a, b)
    edits = 1 - d / n if d <= allowed else 0.0
    return edits if edits >= 0.82 else max(edits, len(grams(a) & grams(b)) / len(grams(a) | grams(b)))


@pytest.mark.parametrize("least", [0.5, 0.7, 0.86])
def test_no_pair_is_lost(spark, least):
    rng = random.Random(5)
    words = ["a", "ab", "ba", "abc", "acb", "aaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaa", "abababababababab", "ivanov petr", "petr ivanov", "Птеров", "Петров"]
    for _ in range(25):
        base = "".join(rng.choice("abcd ") for _ in range(rng.choice([4, 7, 11, 12, 13, 14, 17, 30])))
        words.append(base)
        for _ in range(4):  # a few edits of it, swaps among them
            w = list(base)
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(w))
                how = rng.randrange(4)
                if how == 0:
                    w[at] = rng.choice("abcd")
                elif how == 1:
                    w.insert(at, rng.choice("abcd"))
                elif how == 2 and len(w) > 1:
                    del w[at]
                elif at + 1 < len(w):
                    w[at], w[at + 1] = w[at + 1], w[at]
            words.append("".join(w))
    got = {(r.a, r.b): r.similarity for r in linking.similar_names(spark.createDataFrame([(w,) for w in [*words, "", None]], "n string"), "n", least).collect()}
    known = sorted(set(words) - {""})
    want = {(a, b): s for i, a in enumerate(known) for b in known[i + 1 :] if (s := alike(a, b)) >= least}
    # Spark orders strings by their bytes, Python by code points: the same for these
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_no_names(spark):
    assert linking.similar_names(spark.createDataFrame([(None,), ("",)], "n string"), "n", 0.7).collect() == []


def test_a_swap_may_be_parted(spark):
    """Two letters are swapped and one comes between them, or goes from there: two edits, as in the SQL."""
    assert [damerau(*p) for p in (("ca", "abc"), ("abc", "ca"), ("attionea", "thhationea"), ("abcd", "abcd"), ("", "ab"), ("ab", "ba"))] == [2, 2, 3, 0, 2, 1]
    assert damerau("abcdef", "uvwxyz", 3) == 4
    rng = random.Random(9)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(8))) for _ in range(2))
        exact = damerau(a, b)
        assert exact <= osa(a, b) and [damerau(a, b, k) for k in range(4)] == [min(exact, k + 1) for k in range(4)]
        assert exact == duckdb.execute("SELECT damerau_levenshtein(?, ?)", [a, b]).fetchone()[0]
    words = ["attionea", "thhationea", "aonorshth", "ofanorshth", "thntining", "thtionining"]
    got = {(r.a, r.b): round(r.similarity, 4) for r in linking.similar_names(spark.createDataFrame([(w,) for w in words], "n string"), "n", 0.7).collect()}
    assert got == {("attionea", "thhationea"): 0.7, ("aonorshth", "ofanorshth"): 0.8, ("thntining", "thtionining"): 0.7273}

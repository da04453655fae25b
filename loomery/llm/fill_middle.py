"""Fill-in-the-middle: texts cut at two code points and put in the order that teaches infilling.

The cuts are code points and the texts are bytes, so places are looked up in a succinct index. Of a
batch of texts laid end to end one bit a byte says whether a code point begins there; the bits are
packed, 64 to a word, and a directory holds the ones before every block of WORDS words. A text's
number of code points is a difference of two ranks (directory plus popcounts inside one block), and
the byte where its r-th code point begins is a select: a binary search in the directory, then in the
counts of one block's words, then in the counts of one word's bytes, then of its bits. Cuts of all
texts of a batch are looked up together; the index costs an eighth of the bytes and is never kept.

Where the cuts fall, and which form a text gets, is drawn from a sha-256 of a seed and doc_id in the
JVM; so reruns agree, and rows equal in id get equal draws. A null doc_id is drawn as an empty one, a
null text counts as empty. Empty texts, texts that hold a mark and PLAIN_PERCENT of the rest stay
plain. Columns of the documents pass through; one called like a made column gets an underscore.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import own_names, text_or_empty
from .textkit import buffers, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
#: Of a hundred texts that many are cut, and of those cut that many put the suffix first.
CUT_PERCENT = 90
SUFFIX_FIRST_PERCENT = 20
#: Words of 64 bits in a block of the directory.
WORDS = 8

_BYTE_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)
#: Place of the k-th set bit of each byte value.
_BIT_AT = np.zeros((256, 8), np.uint8)
for _b in range(256):
    _on = [i for i in range(8) if _b >> i & 1]
    _BIT_AT[_b, : len(_on)] = _on


class Boundaries:
    """Rank and select over the code point boundaries of a run of UTF-8 bytes."""

    def __init__(self, data: np.ndarray):
        self.size = len(data)
        span = 64 * WORDS
        bits = np.zeros(-(-(self.size + 1) // span) * span, bool)
        np.not_equal(data & 0xC0, 0x80, out=bits[: self.size])
        self.packed = np.packbits(bits, bitorder="little").reshape(-1, WORDS, 8)
        ones = np.bitwise_count(self.packed.view("<u8")[:, :, 0]).astype(np.int64)
        self.inside = np.cumsum(ones, axis=1)  # ones up to and with each word of a block
        self.before = np.concatenate(([0], np.cumsum(self.inside[:, -1])))
        self.total = int(self.before[-1])

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Code points that begin before each place."""
        block, rest = np.divmod(np.asarray(places, np.int64), 64 * WORDS)
        word, bit = np.divmod(rest, 64)
        whole = np.where(word > 0, self.inside[block, np.maximum(word - 1, 0)], 0)
        mask = (np.uint64(1) << bit.astype(np.uint64)) - np.uint64(1)
        part = np.bitwise_count(self.packed.view("<u8")[block, word, 0] & mask)
        return self.before[block] + whole + part

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """Where the code point with so many before it begins; the end of the bytes for the rank behind the last."""
        ranks = np.asarray(ranks, np.int64)
        end = ranks >= self.total
        if not self.total:
            return np.full(len(ranks), self.size, np.int64)
        ranks = np.minimum(ranks, self.total - 1)
        block = np.searchsorted(self.before, ranks, "right") - 1
        left = ranks - self.before[block]
        inside = self.inside[block]
        word = (inside <= left[:, None]).sum(1)
        left = left - np.where(word > 0, inside[np.arange(len(ranks)), np.maximum(word - 1, 0)], 0)
        bytes_ = self.packed[block, word]
        upto = np.cumsum(_BYTE_ONES[bytes_], axis=1, dtype=np.int64)
        byte = (upto <= left[:, None]).sum(1)
        at = np.arange(len(ranks))
        left = left - np.where(byte > 0, upto[at, np.maximum(byte - 1, 0)], 0)
        place = (block * WORDS + word) * 64 + byte * 8 + _BIT_AT[bytes_[at, byte], left]
        return np.where(end, self.size, place)


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a document."""
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(named, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


MADE = ["n", "form", "prefix_chars", "middle_chars", "output"]
_CUT = T.StructType([T.StructField("n", T.LongType()), T.StructField("low", T.LongType()), T.StructField("high", T.LongType()), T.StructField("output", T.StringType())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row's text the number of code points, the two cuts and the output, beside the row."""
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    for whole in batches:
        data, offsets = buffers(whole.column("text"))
        for i, j in slices(np.diff(offsets)):
            batch = whole.slice(i, j - i)
            own = data[offsets[i] : offsets[j]]
            cuts = offsets[i : j + 1] - offsets[i]
            index = Boundaries(own)
            ranks = index.rank(cuts)
            n = np.diff(ranks)
            first, second = (batch.column(c).to_numpy() % (n + 1) for c in ("h1", "h2"))
            low, high = np.minimum(first, second), np.maximum(first, second)
            a, b = index.select(ranks[:-1] + low), index.select(ranks[:-1] + high)
            # a rank at a text's end is the next text's first code point, behind any stray continuation bytes
            a, b = np.minimum(np.where(low == n, cuts[1:], a), cuts[1:]), np.minimum(np.where(high == n, cuts[1:], b), cuts[1:])
            a, b = np.where(low == 0, cuts[:-1], a), np.where(high == 0, cuts[:-1], b)
            raw, out = own.tobytes(), []
            for form, s, x, y, e in zip(batch.column("form").to_pylist(), cuts[:-1].tolist(), a.tolist(), b.tolist(), cuts[1:].tolist(), strict=True):
                if form == "psm":
                    out.append(b"".join((marks[0], raw[s:x], marks[1], raw[y:e], marks[2], raw[x:y])))
                elif form == "spm":
                    out.append(b"".join((marks[1], raw[y:e], marks[0], raw[s:x], marks[2], raw[x:y])))
                else:
                    out.append(raw[s:e])
            made = [pa.array(n), pa.array(low), pa.array(high), pa.array(out, pa.binary()).cast(to_arrow_type(T.StringType()))]
            struct = pa.StructArray.from_arrays(made, fields=list(to_arrow_type(_CUT)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("form"), struct], names=["row", "form", "cut"])


def fill_in_middle(docs: DataFrame, seed: int = SEED, cut_percent: int = CUT_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT) -> DataFrame:
    """docs with n (code points), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output."""
    text = text_or_empty()
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    form = F.when((text == "") | marked | (h3 % 100 >= cut_percent), "plain").when(h4 % 100 < suffix_first_percent, "spm").otherwise("psm")
    rows = docs.select(F.struct(*docs.columns).alias("row"), text.alias("text"), h1.alias("h1"), h2.alias("h2"), form.alias("form"))
    schema = T.StructType([rows.schema["row"], T.StructField("form", T.StringType()), T.StructField("cut", _CUT)])
    cut = rows.mapInArrow(_cut, schema)
    names = own_names(docs.columns, MADE)
    is_cut = F.col("form") != "plain"
    made = [F.col("cut.n").alias("n"), "form", F.when(is_cut, F.col("cut.low")).alias("prefix_chars"), F.when(is_cut, F.col("cut.high") - F.col("cut.low")).alias("middle_chars"), F.col("cut.output").alias("output")]
    return cut.select(*[F.col("row")[c].alias(n) for c, n in names.items()], *made)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No mark can begin in one piece and end in the next, as marks have no common border."""
    part = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def fill_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of every document."""
    made = fill_in_middle(docs.select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = r"""
WITH named AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
drawn AS (
  SELECT doc_id, t, n,
         ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS b,
         ('0x' || substr(h, 17, 8))::BIGINT % 100 AS c, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS d
  FROM named),
cut AS (
  SELECT *, least(a, b) AS lo, greatest(a, b) AS hi,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
pieces AS (SELECT *, substr(t, 1, lo) AS p, substr(t, lo + 1, hi - lo) AS m, substr(t, hi + 1) AS s FROM cut),
made AS (
  SELECT *, CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END AS output
  FROM pieces)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
       sha256(output) AS output_sha256, sha256(t) AS restored_sha256
FROM made
"""

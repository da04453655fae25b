"""The scan view: a text folded for pattern search, with the place in the original of every character.

Folding drops characters that show nothing and composes combining marks with the letter before them (a mark
that makes no single letter is dropped). Every other character becomes its NFKC form, which may be several characters; digits of all scripts
become 0 to 9, every dash or minus a hyphen, and letters put for Russian ones those. In a token that mixes Cyrillic with Latin or Greek letters, lookalikes
become the Cyrillic letters; tokens of one script stay, so that identifiers don't change.

Places count characters as Spark does, from 0. The map has one more entry than the folded text, the original's
length, so that a span [from, to) of the view is [map[from], map[to]) of the original, with what
was dropped behind its last character. A batch is folded together: each distinct character is looked at once, and
the rest are array operations.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Latin, then Greek letters that look like Cyrillic ones: fixed values.
MIXED_FROM = "aceopxy" "ABCEHKMOPTXY" "αεορτκχυ" "ΑΒΕΗΚΜΟΡΤΧΥ"
MIXED_TO = "асеорху" "АВСЕНКМОРТХУ" "аеорткху" "АВЕНКМОРТХУ"
#: Ukrainian and Belarusian letters put in the place of Russian ones: fixed values.
VARIANT_FROM, VARIANT_TO = "іїєґўІЇЄҐЎ", "ииегуИИЕГУ"
#: Zero-width characters, direction marks, the soft hyphen, the byte order mark, variation selectors 15 and 16: fixed values.
DROPPED = frozenset([0xAD, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFEFF, 0xFE0E, 0xFE0F])
VIEW = T.StructType([T.StructField("text", T.StringType()), T.StructField("map", T.ArrayType(T.IntegerType()))])


_VARIANTS = str.maketrans(VARIANT_FROM, VARIANT_TO)
_MIXED = str.maketrans(MIXED_FROM, MIXED_TO)


def fold(char: str) -> str:
    """What one character becomes, without its neighbours."""
    out = []
    for c in unicodedata.normalize("NFKC", char):
        kind = unicodedata.category(c)
        if kind[0] == "M":
            continue
        out.append(str(unicodedata.decimal(c)) if kind == "Nd" else "-" if kind == "Pd" or c in "−⁃" else c)
    return "".join(out).translate(_VARIANTS)


def _script(char: str) -> int:
    """1 Cyrillic, 2 Latin or Greek, 0 another."""
    if not char.isalpha():
        return 0
    name = unicodedata.name(char, "")
    return 1 if name.startswith("CYRILLIC") else 2 if name.startswith(("LATIN", "GREEK")) else 0


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _text(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def scan_views(texts: list[str | None]) -> list[dict | None]:
    """{text, map} of each text."""
    lengths = np.array([len(t or "") for t in texts], np.int64)
    first = np.concatenate(([0], np.cumsum(lengths)))
    codes = _codes("".join(t or "" for t in texts))
    kinds, which = np.unique(codes, return_inverse=True)
    chars = [chr(c) for c in kinds.tolist()]
    mark = np.array([unicodedata.category(c)[0] == "M" for c in chars], bool)
    folded = ["" if ord(c) in DROPPED or m else fold(c) for c, m in zip(chars, mark, strict=True)]
    size = np.array([len(f) for f in folded], np.int64)
    # folded characters of each original one, end to end
    table = _codes("".join(folded))
    start = np.cumsum(size) - size
    many = size[which] if len(codes) else np.zeros(0, np.int64)
    origin = np.repeat(np.arange(len(codes)), many)
    step = np.arange(len(origin)) - np.repeat(np.cumsum(many) - many, many)
    view = table[start[which[origin]] + step].copy() if len(origin) else np.zeros(0, np.uint32)
    text = np.searchsorted(first, origin, "right") - 1
    for at in np.flatnonzero(mark[which]).tolist() if len(codes) else ():
        if ord(chr(codes[at])) in DROPPED:
            continue
        last = int(np.searchsorted(origin, at)) - 1
        if last >= 0 and origin[last] >= first[np.searchsorted(first, at, "right") - 1]:
            composed = unicodedata.normalize("NFC", chr(view[last]) + chr(codes[at]))
            if len(composed) == 1:
                view[last] = ord(composed)
    view = _unmixed(view, text)
    cut = np.searchsorted(text, np.arange(len(texts) + 1))
    out: list[dict | None] = []
    for i, t in enumerate(texts):
        here = slice(cut[i], cut[i + 1])
        out.append(None if t is None else {"text": _text(view[here]), "map": [*(origin[here] - first[i]).tolist(), len(t)]})
    return out


def _unmixed(view: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Lookalikes of tokens that mix scripts, as Cyrillic letters."""
    if not len(view):
        return view
    kinds, which = np.unique(view, return_inverse=True)
    chars = [chr(c) for c in kinds.tolist()]
    word = np.array([c.isalnum() or c == "_" for c in chars])[which]
    script = np.array([_script(c) for c in chars])[which]
    edge = np.ones(len(view), bool)
    edge[1:] = (word[1:] != word[:-1]) | (text[1:] != text[:-1])
    token = np.cumsum(edge) - 1
    mixed = (np.bincount(token, script == 1) > 0) & (np.bincount(token, script == 2) > 0)
    turned = np.array([ord(c.translate(_MIXED)) for c in chars], np.uint32)[which]
    return np.where(mixed[token] & word, turned, view)


@F.pandas_udf(VIEW)
def scan_view(text: pd.Series) -> pd.DataFrame:
    made = scan_views(list(text))
    return pd.DataFrame({"text": [m and m["text"] for m in made], "map": [m and m["map"] for m in made]})


def matches(view: Column, pattern: str) -> Column:
    """array<struct<from, to>> of a pattern's matches, in places of the original, one after another. The view is a column of its own first."""
    found = F.regexp_extract_all(view["text"], F.lit(pattern), F.lit(0))
    kind = "struct<next:int,all:array<struct<from:int,to:int>>>"

    def place(acc: Column, value: Column) -> Column:
        at = F.position(value, view["text"], acc["next"] + 1) - 1
        end = at + F.length(value)
        span = F.struct(F.get(view["map"], at).alias("from"), F.get(view["map"], end).alias("to"))
        return F.struct(end.alias("next"), F.concat(acc["all"], F.array(span)).alias("all")).cast(kind)

    begin = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<from:int,to:int>>").alias("all")).cast(kind)
    return F.aggregate(found, begin, place)["all"]

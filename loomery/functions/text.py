"""Text functions: normalising, trigrams, edit distance, identifiers, prices, endpoints, CSV cells."""

from __future__ import annotations

import html
import re
import unicodedata
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that show nothing: zero-width ones, the soft hyphen, direction marks, the byte order mark.
INVISIBLE = r"[\u00AD\u200B-\u200F\u202A-\u202E\u2060-\u2064\uFEFF]"
#: Latin letters on the keys of a Cyrillic layout, in keyboard order: fixed values.
LAYOUT_FROM = "йцукенгшщзхъфывапролджэячсмитьбю"
LAYOUT_TO = "qwertyuiop[]asdfghjkl;'zxcvbnm,."
#: Digits and signs that stand for letters: fixed values.
LEET_FROM, LEET_TO = "013457@$", "oieastas"
#: Cyrillic letters and their Latin spelling: fixed values.
TRANSLIT = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k",
    "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh",
    "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
#: Cyrillic letters that look like Latin ones: fixed values.
LOOKALIKE_FROM, LOOKALIKE_TO = "авекмнорстух", "abekmhopctyx"


def strip_invisible(text: Column) -> Column:
    return F.regexp_replace(text, INVISIBLE, "")


def words_only(text: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(strip_invisible(text)), r"[^\p{L}\p{N}]+", " "))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition, which Spark has no function for."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def canonical(text: Column) -> Column:
    """nfkc, then lookalike letters folded to Latin, lower case, words only."""
    return words_only(F.translate(F.lower(nfkc(text)), LOOKALIKE_FROM + "ё", LOOKALIKE_TO + "e"))


def collapse_repeats(text: Column) -> Column:
    return F.regexp_replace(text, r"(.)\1+", "$1")


def unfold_leet(text: Column) -> Column:
    return F.translate(F.lower(text), LEET_FROM, LEET_TO)


def from_layout(text: Column) -> Column:
    """What the same keys type in the other layout."""
    return F.translate(F.lower(text), LAYOUT_FROM, LAYOUT_TO)


def transliterate(text: Column) -> Column:
    out = F.lower(text)
    for a, b in TRANSLIT.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def slug(text: Column, size: int = 40) -> Column:
    dashed = F.regexp_replace(transliterate(text), r"[^a-z0-9]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(dashed, r"^-+|-+$", ""), 1, size), r"-+$", "")


def short_id(*parts: Column, size: int = 12) -> Column:
    """A stable id: the head of the sha-256 of the parts."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, size)


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the text with a space on either side."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    at = F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1)))
    return F.array_distinct(F.transform(at, lambda i: F.substring(padded, i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def osa(a: str, b: str, most: int | None = None) -> int:
    """Edits, a swap of neighbours counting one and no part edited twice; most + 1 once it exceeds `most`."""
    if most is not None and abs(len(a) - len(b)) > most:
        return most + 1
    older, old = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
        if most is not None and min(row) > most:
            return most + 1
        older, old = old, row
    return old[-1]


@F.pandas_udf(T.IntegerType())
def osa_within(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
    """osa of two texts, given up once it exceeds `most`."""
    return pd.Series([None if x is None or y is None else osa(x, y, int(m)) for x, y, m in zip(a, b, most, strict=True)], dtype="Int32")


def damerau(a: str, b: str, most: int | None = None) -> int:
    """Edits, a swap of neighbours counting one even if something then comes between them; most + 1 once it exceeds `most`."""
    if most is not None and abs(len(a) - len(b)) > most:
        return most + 1
    far = len(a) + len(b)
    rows, last = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]], {}  # a row and a column before the empty text's
    for i, x in enumerate(a, 1):
        row, same = [far, i], 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), same  # where y was last in a, and x in b
            if x == y:
                same = j
            row.append(min(rows[i][j + 1] + 1, row[j] + 1, rows[i][j] + (x != y), rows[k][m] + (i - k - 1) + 1 + (j - m - 1)))
        if most is not None and min(row) > most:
            return most + 1
        rows.append(row)
        last[x] = i
    return rows[-1][-1] if most is None else min(rows[-1][-1], most + 1)


@F.pandas_udf(T.IntegerType())
def damerau_within(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
    """damerau of two texts, given up once it exceeds `most`."""
    return pd.Series([None if x is None or y is None else damerau(x, y, int(m)) for x, y, m in zip(a, b, most, strict=True)], dtype="Int32")


@F.pandas_udf(T.IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else osa(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def endpoint(verb: Column, path: Column, status: Column) -> Column:
    """A route template: ids become :id; 404s and paths of more than six parts 'unknown', what is not /api 'static'."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\?.*$", ""), "/"), lambda x: x != "")
    named = F.transform(parts, lambda x: F.when(x.rlike(r"^\d+$|^[0-9a-f]{8,}(-[0-9a-f]+)*$|^\d{4}-\d{2}-\d{2}$"), ":id").otherwise(x))
    route = F.concat(F.upper(verb), F.lit(" /"), F.array_join(named, "/"))
    return F.when(status == 404, "unknown").when(~path.startswith("/api"), "static").when(F.size(parts) > 6, "unknown").otherwise(route)


def first_match(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """Name of the first pattern that the text matches."""
    out = F.when(text.rlike(rules[0][0]), rules[0][1])
    for pattern, name in rules[1:]:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise(default)


def metric_name(key: Column) -> Column:
    return F.regexp_extract(key, r"^([^{]+)", 1)


def metric_labels(key: Column) -> Column:
    inside = F.regexp_extract(key, r"\{(.*)\}$", 1)
    return F.when(inside != "", F.str_to_map(inside, F.lit(","), F.lit("="))).otherwise(F.create_map().cast("map<string,string>"))


def metric_key(name: Column, labels: Column) -> Column:
    """name{a=b,c=d} with labels in order of their names; the bare name without labels."""
    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.when(F.size(pairs) > 0, F.concat(name, F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(name)


def csv_cell(text: Column) -> Column:
    """A cell that no spreadsheet takes for a formula, quoted if it holds a delimiter."""
    safe = F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)
    quoted = F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(safe.rlike('[",;\r\n]'), quoted).otherwise(safe), F.lit(""))


_NUMBER = r"(\d[\d  ]*\d|\d)"


def price(text: Column) -> Column:
    """struct(low, high, from): '1 200', '1200-1500', 'from 900'; null when there is no number."""
    number = lambda i: F.regexp_replace(F.regexp_extract(text, rf"{_NUMBER}(?:\s*[-–]\s*{_NUMBER})?", i), r"[  ]", "").try_cast("long")
    low, high = number(1), number(2)
    open_ = F.lower(text).rlike(r"^\s*from\b")
    top = F.when(open_, F.lit(None)).otherwise(F.coalesce(high, low))
    return F.when(low.isNotNull() & (top.isNull() | (top >= low)), F.struct(low.alias("low"), top.alias("high"), open_.alias("from")))


def one_of(text: Column, rules: dict[str, str]) -> Column:
    """The one name whose pattern the text matches; null for none or several."""
    found = F.array_compact(F.array(*[F.when(F.lower(text).rlike(p), F.lit(n)) for n, p in rules.items()]))
    return F.when(F.size(found) == 1, found[0])


def address_key(ip: Column) -> Column:
    """Key of a rate limit: an IPv4 address whole, of an IPv6 address the first four groups."""
    full = F.when(ip.contains("::"), F.concat(F.split(ip, "::")[0], F.repeat(F.lit(":0"), 8))).otherwise(ip)
    groups = F.transform(F.slice(F.filter(F.split(full, ":"), lambda x: x != ""), 1, 4), lambda x: F.coalesce(F.nullif(F.regexp_replace(F.lower(x), "^0+", ""), F.lit("")), F.lit("0")))
    return F.when(ip.contains(":"), F.concat(F.array_join(groups, ":"), F.lit("::/64"))).otherwise(ip)


def negated(text: Column, at: Column, left: int = 28) -> Column:
    """A negation stands in the `left` characters before place `at` (from 1)."""
    before = F.substring(text, F.greatest(at - left, F.lit(1)), at - F.greatest(at - left, F.lit(1)))
    return F.lower(before).rlike(r"(?<![\p{L}\p{N}])(no|not|never|without|except)(?![\p{L}\p{N}])")


def refused(text: Column, after: Column, right: int = 30) -> Column:
    """A refusal stands in the `right` characters from place `after` (from 1)."""
    behind = F.substring(text, after, F.lit(right))
    return F.lower(behind).rlike(r"(?<![\p{L}\p{N}])(not needed|not wanted|no thanks|does not matter|cancel)(?![\p{L}\p{N}])")


def whole_words(words: list[str]) -> str:
    """Pattern of any of the words with no letter or digit on either side, for Java and Python."""
    quoted = "|".join(re.escape(w).replace(r"\ ", r"\s+") for w in sorted(words, key=len, reverse=True))
    return rf"(?<![\p{{L}}\p{{N}}])(?:{quoted})(?![\p{{L}}\p{{N}}])"


def safe_value(text: Column, private: list[str], most: int = 120) -> Column:
    """A log value: redacted if a private pattern is in it, else its first `most` characters."""
    return F.when(text.rlike("|".join(private)), "[redacted]").otherwise(F.substring(text, 1, most))


def code_of(value: Column, codes: dict[str, str], default: str = "unknown") -> Column:
    """Code of an exact value; everything else, nulls too, is the default."""
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.coalesce(F.try_element_at(table, value), F.lit(default))


def stem(word: Column, endings: list[str], least: int = 3) -> Column:
    """The word without its longest ending, if `least` characters remain."""
    return F.regexp_replace(word, rf"^(.{{{least},}}?)(?:{'|'.join(endings)})$", "$1")


def one_edit(a: Column, b: Column) -> Column:
    """At most one character replaced, put in or taken out, or one pair of neighbours swapped."""
    at = F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1)))
    swapped = F.exists(at, lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b)
    return (F.levenshtein(a, b) <= 1) | ((F.length(a) == F.length(b)) & swapped)


def begins_nearly(word: Column, query: Column, least: int = 5) -> Column:
    """The word begins with the query, or (queries of `least` characters on) with one edit of it."""
    heads = F.transform(F.array(*[F.lit(d) for d in (-1, 0, 1)]), lambda d: F.substring(word, F.lit(1), F.length(query) + d))
    return word.startswith(query) | ((F.length(query) >= least) & F.exists(heads, lambda h: one_edit(query, h)))


def phrase_rank(phrase: Column, query: Column) -> Column:
    """How well a phrase fits a query: 0 equal, 1 begins with it, 2 every word begins a word, 3 so without a final vowel,
    4 contains it, 5 every word begins a word but for one edit; null if none.
    """
    words, parts = F.split(query, " "), F.split(phrase, " ")
    root = lambda w: F.when(F.length(w) >= 4, F.regexp_replace(w, "[aeiouy]$", "")).otherwise(w)
    every = lambda fits: F.forall(words, lambda w: F.exists(parts, lambda p: fits(p, w)))
    return (
        F.when(phrase == query, 0)
        .when(phrase.startswith(query), 1)
        .when(every(lambda p, w: p.startswith(w)), 2)
        .when(every(lambda p, w: p.startswith(root(w))), 3)
        .when(F.contains(phrase, query), 4)
        .when(every(lambda p, w: p.startswith(root(w)) | begins_nearly(p, w)), 5)
    )


def merged_ranges(ranges: Column) -> Column:
    """Sorted ranges [from, to) without overlaps; those that touch are one."""
    kind = "array<struct<from:int,to:int>>"

    def add(acc: Column, r: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["from"].alias("from"), F.greatest(last["to"], r["to"]).alias("to"))))
        return F.when((F.size(acc) > 0) & (r["from"] <= F.get(acc, F.size(acc) - 1)["to"]), grown).otherwise(F.concat(acc, F.array(r)))

    return F.aggregate(F.array_sort(ranges.cast(kind)), F.array().cast(kind), add)


def places_of(text: Column, token: Column) -> Column:
    """Ranges [from, to) of the token in the text, case aside, overlapping ones of it too."""
    low, n = F.lower(text), F.length(token)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.length(text) - n, F.lit(0))), lambda i: F.substring(low, i + 1, n) == F.lower(token))
    return F.when((n > 0) & (F.length(text) >= n), F.transform(starts, lambda i: F.struct(i.alias("from"), (i + n).alias("to")))).otherwise(F.array().cast("array<struct<from:int,to:int>>"))


def highlighted(text: Column, tokens: Column) -> Column:
    """array<struct<text, match>>: the text in parts, matched ones merged where they overlap or touch."""
    ranges = merged_ranges(F.flatten(F.transform(tokens, lambda t: places_of(text, t))))
    part = lambda a, b, match: F.struct(F.substring(text, a + 1, b - a).alias("text"), F.lit(match).alias("match"))
    before = lambda i: F.when(i > 0, F.get(ranges, i - 1)["to"]).otherwise(F.lit(0))
    pieces = F.flatten(F.transform(ranges, lambda r, i: F.array(part(before(i), r["from"], False), part(r["from"], r["to"], True))))
    end = F.when(F.size(ranges) > 0, F.element_at(ranges, -1)["to"]).otherwise(F.lit(0))
    return F.filter(F.concat(pieces, F.array(part(end, F.length(text), False))), lambda p: F.length(p["text"]) > 0)


def decode_once(text: str) -> str:
    """One round of entities, percent and backslash-u escapes; what is no valid escape stays."""
    out = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)) if not 0xD800 <= int(m[1], 16) < 0xE000 else m[0], html.unescape(text))
    return unquote(out, errors="strict") if "%" in out and _percent_fine(out) else out


def _percent_fine(text: str) -> bool:
    try:
        unquote(text, errors="strict")
    except UnicodeDecodeError:
        return False
    return True


@F.pandas_udf(T.StringType())
def decoded(text: pd.Series) -> pd.Series:
    """Escapes undone, at most three rounds."""

    def run(t: str | None) -> str | None:
        for _ in range(3):
            if t is None or (new := decode_once(t)) == t:
                break
            t = new
        return t

    return text.map(run)


def run_length(classes: Column, pattern: str) -> Column:
    """Length of the longest match of a pattern in a string of one-letter classes, 0 for none."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(classes, F.lit(pattern), F.lit(0)), lambda r: F.length(r))), F.lit(0))


#: A word torn by pictographs, and a capitalised one torn by a stroke.
TORN = r"\p{L}{2}[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}]+\p{L}{2}|\p{Lu}\p{Ll}{2,}[/|\\]\p{Ll}{2,}"


def obfuscation(text: Column, number_words: list[str]) -> Column:
    """struct(letters, numbers, mixed, broken, suspicious): longest runs of single letters, of number words, and of number words with digits; a torn word."""
    tokens = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    kind = lambda t: F.when(F.lower(t).isin(*number_words), "N").when(t.rlike(r"^\d+$"), "D").when(t.rlike(r"^\p{L}$"), "L").otherwise("x")
    classes = F.array_join(F.transform(tokens, kind), "")
    mixed = F.filter(F.regexp_extract_all(classes, F.lit("[ND]+"), F.lit(0)), lambda r: F.contains(r, F.lit("N")) & F.contains(r, F.lit("D")))
    longest = F.coalesce(F.array_max(F.transform(mixed, lambda r: F.length(r))), F.lit(0))
    letters, numbers = run_length(classes, "L+"), run_length(classes, "N+")
    return F.struct(letters.alias("letters"), numbers.alias("numbers"), longest.alias("mixed"), text.rlike(TORN).alias("broken"), ((letters >= 4) | (numbers >= 5) | (longest >= 5) | text.rlike(TORN)).alias("suspicious"))

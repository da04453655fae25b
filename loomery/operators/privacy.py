"""Personal data in texts: spans by pattern, overlap resolution, redaction, verdicts and leak checks.

Patterns are written from public format descriptions and avoid nested quantifiers. What needs only
presence, counts or replacement stays in built-in expressions; offsets come from one Arrow UDF.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: kind -> (pattern, confidence). Patterns run in Java, Python and RE2 alike.
PATTERNS: dict[str, tuple[str, float]] = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 0.98),
    "ipv4": (r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", 0.9),
    "uuid": (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", 0.95),
    "url": (r"https?://[^\s<>\"]+", 0.9),
    "card": (r"\b[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}\b", 0.9),
    "phone": (r"\+[0-9]{1,3}[ -]?\(?[0-9]{1,4}\)?(?:[ -]?[0-9]{2,4}){2,4}", 0.9),
    "date": (r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b", 0.6),
    "handle": (r"\B@[A-Za-z0-9_]{4,}", 0.7),
    "coordinates": (r"-?[0-9]{1,2}\.[0-9]{4,}, ?-?[0-9]{1,3}\.[0-9]{4,}", 0.85),
    "digits": (r"\b[0-9]{9,}\b", 0.6),
    # formats of documents, accounts and machines
    "iban": (r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}\b", 0.95),
    "social_number": (r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", 0.9),
    "passport": (r"\b[A-Z]{1,2}[0-9]{7}\b", 0.7),
    "document": (r"\b(?:[Pp]assport|[Ll]icen[cs]e|[Pp]olicy|[Cc]ontract) (?:no|number)[.:]? ?[A-Z0-9-]{5,}", 0.9),
    "account": (r"\b[Aa]ccount(?: no| number)?[.:]? ?[0-9]{6,}\b", 0.9),
    "internal_id": (r"\b[A-Z]{2,5}-[0-9]{3,}\b", 0.5),
    "plate": (r"\b[A-Z]{1,3}-[A-Z]{1,2} [0-9]{1,4}\b", 0.7),
    "mac": (r"\b(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}\b", 0.95),
    "ipv6": (r"\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b", 0.9),
    "secret": (r"\b(?:sk|pk|ghp|AKIA)[_-]?[A-Za-z0-9]{16,}\b", 0.9),
    # other ways to write what has a pattern above
    "email_spoken": (r"\b[A-Za-z0-9._%+-]+ ?[\[(]at[\])] ?[A-Za-z0-9-]+ ?(?:[\[(]dot[\])]|\.) ?[A-Za-z]{2,}\b", 0.9),
    "phone_local": (r"\(0[0-9]{2,4}\) ?[0-9]{3,4}[ -]?[0-9]{2,4}\b", 0.85),
    "phone_dotted": (r"\b[0-9]{3}\.[0-9]{3}\.[0-9]{4}\b", 0.85),
    "date_dotted": (r"\b[0-9]{1,2}\.[0-9]{1,2}\.(?:19|20)[0-9]{2}\b", 0.6),
    "date_slashed": (r"\b[0-9]{1,2}/[0-9]{1,2}/(?:19|20)[0-9]{2}\b", 0.6),
    "date_named": (r"\b[0-9]{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December) (?:19|20)[0-9]{2}\b", 0.6),
    "born": (r"\b(?:[Bb]orn on|[Dd]ate of birth:?) [0-9A-Za-z./-]{6,}", 0.9),
    "geo_link": (r"\bgeo:-?[0-9]{1,2}\.[0-9]+,-?[0-9]{1,3}\.[0-9]+", 0.9),
    "degrees": (r"[0-9]{1,2}°[0-9]{1,2}'[NS],? ?[0-9]{1,3}°[0-9]{1,2}'[EW]", 0.9),
    "street": (r"\b[0-9]{1,4} [A-Z][a-z]+ (?:Street|Road|Avenue|Lane|Drive|Square)\b", 0.8),
    "post_box": (r"\bP\.?O\.? ?[Bb]ox [0-9]{1,6}\b", 0.8),
    "post_code": (r"\b[0-9]{5}-[0-9]{4}\b", 0.6),
    # Russian documents, numbers and addresses
    "pension_number": (r"\b[0-9]{3}-[0-9]{3}-[0-9]{3}[ -][0-9]{2}\b", 0.95),
    "health_policy": (r"(?:ОМС|омс|[Пп]олис)[^0-9\n]{0,12}[0-9]{4} ?[0-9]{4} ?[0-9]{4} ?[0-9]{4}", 0.95),
    "passport_series": (r"[Пп]аспорт[^0-9\n]{0,20}[0-9]{2} ?[0-9]{2} ?[0-9]{6}", 0.95),
    "plate_cyrillic": (r"[АВЕКМНОРСТУХ][0-9]{3}[АВЕКМНОРСТУХ]{2} ?[0-9]{2,3}", 0.9),
    "phone_domestic": (r"\b8[ -]?\(?[0-9]{3}\)?[ -]?[0-9]{3}[ -]?[0-9]{2}[ -]?[0-9]{2}\b", 0.85),
    "date_cyrillic": (r"\b[0-9]{1,2} (?:января|февраля|марта|апреля|мая|июня|июля|августа|сентября|октября|ноября|декабря) (?:19|20)[0-9]{2}", 0.6),
    "street_cyrillic": (r"(?:ул\.|улица|проспект|пр-т|переулок|пер\.|шоссе) ?[А-ЯЁ][А-Яа-яЁё-]+(?:,? ?(?:д\.|дом)? ?[0-9]{1,4})?", 0.85),
    "flat": (r"(?:кв\.|квартира) ?[0-9]{1,4}", 0.7),
    "profile_link": (r"\b(?:t\.me|wa\.me|vk\.com)/[A-Za-z0-9_.]{3,}", 0.9),
}
#: Identifiers that may never leave, whatever else a text holds.
HARD = ("card", "phone", "email", "coordinates")
SPAN = T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer").add("confidence", "double").add("value", "string"))


#: What every match of a kind holds, so that most texts need no pattern: fixed values.
HINTS = {"email": "@", "handle": "@", "url": "://", "phone": "+", "degrees": "°", "geo_link": "geo:", "phone_local": "(0"}


def _hinted(text: Column, kind: str, found: Column, none: Column) -> Column:
    return F.when(F.contains(text, F.lit(HINTS[kind])), found).when(text.isNotNull(), none) if kind in HINTS else found


def counts(text: Column, kinds=PATTERNS) -> dict[str, Column]:
    return {k: _hinted(text, k, F.regexp_count(text, F.lit(PATTERNS[k][0])), F.lit(0)) for k in kinds}


def values(docs: DataFrame, keys: list[str], text: str, kinds=PATTERNS) -> DataFrame:
    """(keys, kind, value): every match of every pattern, overlaps included."""
    none = F.array().cast("array<string>")
    found = F.array(*[F.struct(F.lit(k).alias("kind"), _hinted(F.col(text), k, F.regexp_extract_all(text, F.lit(PATTERNS[k][0]), F.lit(0)), none).alias("all")) for k in kinds])
    return docs.select(*keys, F.explode(found).alias("f")).select(*keys, "f.kind", F.explode("f.all").alias("value"))


def resolve(spans: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """Of spans that overlap, in order of start, one replaces the last if it is surer or longer and goes further."""
    out: list[tuple[str, int, int, float]] = []
    for s in sorted(spans, key=lambda s: (s[1], -s[2])):
        if not out or s[1] >= out[-1][2]:
            out.append(s)
            continue
        last = out[-1]
        if s[2] > last[2] and s[3] * 1000 + s[2] - s[1] > last[3] * 1000 + last[2] - last[1]:
            out[-1] = s
    return out


def detector(kinds=tuple(PATTERNS)):
    """A UDF from text to its resolved spans, with offsets in characters."""
    compiled = [(k, re.compile(PATTERNS[k][0], re.ASCII), PATTERNS[k][1]) for k in kinds]

    @F.pandas_udf(SPAN)
    def spans(text: pd.Series) -> pd.Series:
        rows = []
        for t in text:
            found = [(k, m.start(), m.end(), c) for k, p, c in compiled for m in p.finditer(t or "")]
            rows.append([{"kind": k, "start": a, "end": b, "confidence": c, "value": t[a:b]} for k, a, b, c in resolve(found)])
        return pd.Series(rows, dtype=object)

    return spans


def tokens(spans: Column) -> Column:
    """Map from value to token: the same value has the same token, of its first kind, numbered by kind in order of appearance."""
    every = F.array_distinct(F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value"))))
    distinct = F.filter(every, lambda s, i: ~F.exists(F.slice(every, F.lit(1), i), lambda o: o["value"] == s["value"]))
    named = F.transform(distinct, lambda s, i: F.struct(s["value"].alias("key"), F.concat(F.lit("["), s["kind"], F.lit("_"), (F.size(F.filter(F.slice(distinct, 1, i + 1), lambda o: o["kind"] == s["kind"]))).cast("string"), F.lit("]")).alias("value")))
    return F.map_from_entries(named)


def substitute(text: Column, spans: Column, names: Column) -> Column:
    """The text with every span replaced by its token, from the right so that offsets hold."""
    back = F.reverse(spans)
    return F.aggregate(back, text, lambda acc, s: F.concat(F.substring(acc, F.lit(1), s["start"]), F.element_at(names, s["value"]), F.substring(acc, s["end"] + 1, F.length(acc))))


def masked(text: Column, kinds=PATTERNS) -> Column:
    """The text with every match replaced by its kind, pattern by pattern; texts with no match at all are looked through once."""
    out = text
    for k in kinds:
        out = F.regexp_replace(out, PATTERNS[k][0], f"[{k}]")
    return F.when(text.rlike("|".join(f"(?:{PATTERNS[k][0]})" for k in kinds)), out).otherwise(text)


#: Budgets of a text that may leave: fixed values.
MAX_ENTITIES, MAX_DIGIT_SHARE = 12, 0.45


def verdict(hard: Column, entities: Column, digits: Column, length: Column, emergency: Column) -> Column:
    """First rule that holds: emergency, hard identifiers, too many entities, too many digits; else external."""
    return (
        F.when(emergency, "emergency")
        .when(hard > 0, "local_only")
        .when(entities > MAX_ENTITIES, "reject")
        .when(digits > length * MAX_DIGIT_SHARE, "reject")
        .otherwise("allow_external")
    )


def unknown_words(texts: DataFrame, keys: list[str], text: str, vocabulary: DataFrame, word: str) -> DataFrame:
    """(keys, n_words, n_unknown, closed): words outside a vocabulary."""
    split = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    words = texts.select(*keys, F.explode(split).alias(word))
    marked = words.join(vocabulary.select(word, F.lit(True).alias("__known")).distinct(), word, "left")
    out = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_words"), F.count_if(F.col("__known").isNull()).alias("n_unknown"))
    return out.withColumn("closed", F.col("n_unknown") == 0)


def leaks(samples: DataFrame, keys: list[str], sent: str, kind: str, value: str) -> DataFrame:
    """leaked: does what was sent still hold the sensitive value, by a rule of its kind.

    Digits count if any five of a phone's, or six of a document's, stand in a row; words and other
    values whole.
    """
    digits = lambda c: F.regexp_replace(c, r"[^0-9]", "")

    def window(n: int) -> Column:
        d = digits(F.col(value))
        at = F.when(F.length(d) >= n, F.sequence(F.lit(1), F.length(d) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.exists(at, lambda i: F.contains(digits(F.col(sent)), F.substring(d, i, F.lit(n))))

    whole = F.contains(F.lower(sent), F.lower(value))
    hit = F.when(F.col(kind) == "phone", window(5)).when(F.col(kind).isin("card", "digits", "date"), window(6)).otherwise(whole)
    return samples.withColumn("leaked", F.coalesce(hit, F.lit(False)))


def precision_recall(rows: DataFrame, group: str, predicted: Column, actual: Column) -> DataFrame:
    """Per group and for all: hits, misses, precision and recall in percent."""
    from ..functions.numbers import percent

    marked = rows.select(F.explode(F.array(F.col(group), F.lit("all"))).alias(group), predicted.alias("p"), actual.alias("a"))
    out = marked.groupBy(group).agg(F.count_if(F.col("p") & F.col("a")).alias("tp"), F.count_if(F.col("p") & ~F.col("a")).alias("fp"), F.count_if(~F.col("p") & F.col("a")).alias("fn"), F.count(F.lit(1)).alias("n"))
    return out.withColumns({"precision": percent(F.col("tp"), F.col("tp") + F.col("fp")), "recall": percent(F.col("tp"), F.col("tp") + F.col("fn"))})


def window_starts(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """[from, to) of the windows of a text: at most `size` characters, ended at their last space if that is in their second half."""
    out, start = [], 0
    while True:
        end = min(len(text), start + size)
        if end < len(text):
            space = text.rfind(" ", start, end + 1)
            end = space if space > start + size / 2 else end
        out.append((start, end))
        if end >= len(text):
            return out
        start = max(end - overlap, start + 1)


def long_windows(docs: DataFrame, keys: list[str], text: str, size: int = 3500, overlap: int = 200) -> DataFrame:
    """(keys, part, start, window): whole texts in windows of at most `size` characters that overlap and end at spaces; a null text is empty."""

    @F.pandas_udf("array<struct<start:int,window:string>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [(a, (t or "")[a:b]) for a, b in window_starts(t or "", size, overlap)])

    parts = docs.select(*keys, F.posexplode(cut(F.col(text))).alias("part", "w"))
    return parts.select(*keys, "part", "w.start", "w.window")


def bands(score: Column, contextual: Column, sure: float = 0.6, doubtful: float = 0.4) -> Column:
    """mask, doubtful or drop: types that need no context are masked at any score."""
    return F.when((score >= sure) | ~contextual, "mask").when(score >= doubtful, "doubtful").otherwise("drop")


RANGES = "array<struct<type:string,from:int,to:int>>"


def without(ranges: Column, protected: Column) -> Column:
    """Ranges (type, from, to) less the protected ranges (from, to), which may cut one in two."""

    def cut(acc: Column, p: Column) -> Column:
        sides = lambda r: F.array(F.struct(r["type"].alias("type"), r["from"].alias("from"), F.least(r["to"], p["from"]).alias("to")), F.struct(r["type"].alias("type"), F.greatest(r["from"], p["to"]).alias("from"), r["to"].alias("to")))
        return F.filter(F.flatten(F.transform(acc, lambda r: F.when((p["to"] <= r["from"]) | (r["to"] <= p["from"]), F.array(r)).otherwise(sides(r)))), lambda r: r["to"] > r["from"])

    return F.aggregate(protected, ranges.cast(RANGES), cut)


def joined_ranges(text: Column, ranges: Column, priority: list[str]) -> Column:
    """Ranges in order of start; one that overlaps the last, or follows it over nothing but blanks and quotes and has its
    type, is one with it. Of two types that overlap the one further down `priority` stays.
    """
    weight = F.create_map(*[x for i, p in enumerate(priority) for x in (F.lit(p), F.lit(i))])

    def add(acc: Column, r: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        between = F.substring(text, last["to"] + 1, r["from"] - last["to"])
        close = (r["from"] <= last["to"]) | ((r["type"] == last["type"]) & between.rlike(r"^[\s\-\"'.]*$"))
        kind = F.when(weight[r["type"]] > weight[last["type"]], r["type"]).otherwise(last["type"])
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(kind.alias("type"), last["from"].alias("from"), F.greatest(last["to"], r["to"]).alias("to"))))
        return F.when((F.size(acc) > 0) & close, grown).otherwise(F.concat(acc, F.array(r)))

    order = lambda a, b: F.when(a["from"] != b["from"], a["from"] - b["from"]).otherwise(b["to"] - a["to"])
    return F.aggregate(F.array_sort(ranges.cast(RANGES), order), F.array().cast(RANGES), add)


def labelled(text: Column, ranges: Column) -> Column:
    """The text with a label [type] in place of every range, from the right so that places hold."""
    return F.aggregate(F.reverse(ranges), text, lambda acc, r: F.concat(F.substring(acc, F.lit(1), r["from"]), F.lit("["), r["type"], F.lit("]"), F.substring(acc, r["to"] + 1, F.length(acc))))


def reconciled(detected: Column, linked: Column) -> Column:
    """Detected and linked ranges as one list without overlaps: bounds are the union, an address keeps its type, else the link does."""
    kind = "array<struct<from:int,strength:int,to:int,type:string>>"
    strong = lambda xs, n: F.transform(xs, lambda x: F.struct(x["from"].alias("from"), F.lit(n).alias("strength"), x["to"].alias("to"), x["type"].alias("type")))

    def add(acc: Column, r: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        address = F.when(last["type"] == "address", last["type"]).when(r["type"] == "address", r["type"])
        stronger = r["strength"] > last["strength"]
        kind_ = F.coalesce(address, F.when(stronger, r["type"]).otherwise(last["type"]))
        rank = F.when(address.isNotNull(), F.when(last["type"] == "address", last["strength"]).otherwise(r["strength"])).otherwise(F.greatest(last["strength"], r["strength"]))
        grown = F.struct(last["from"].alias("from"), rank.alias("strength"), F.greatest(last["to"], r["to"]).alias("to"), kind_.alias("type"))
        return F.when((F.size(acc) > 0) & (r["from"] < last["to"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(r)))

    def order(a: Column, b: Column) -> Column:
        return F.when(a["from"] != b["from"], a["from"] - b["from"]).when(a["strength"] != b["strength"], b["strength"] - a["strength"]).otherwise(b["to"] - a["to"])

    every = F.array_sort(F.concat(strong(linked, 2), strong(detected, 1)).cast(kind), order)
    merged = F.aggregate(every, F.array().cast(kind), add)
    return F.transform(merged, lambda r: F.struct(r["type"].alias("type"), r["from"].alias("from"), r["to"].alias("to")))


#: Phrases for places that a person means without naming them: fixed values.
LOCATION_WORDS = {"HOME": ["at home", "my home", "my house", "my place"], "HERE": ["right here", "near me", "where i am"], "WORK": ["at work", "my office", "my job"]}


def location_tokens(text: Column, words: dict[str, list[str]] = LOCATION_WORDS) -> Column:
    """Such phrases as tokens: @HOME, @HERE, @WORK."""
    for token, phrases in words.items():
        for _ in range(2):  # a second time, as the space between two phrases belongs to the first
            text = F.regexp_replace(text, rf"(?i)(^|[^\p{{L}}\p{{N}}])(?:{'|'.join(phrases)})($|[^\p{{L}}\p{{N}}])", f"$1@{token}$2")
    return text


def residual_names(text: Column, endings: list[str], ignore: list[str] | None = None) -> Column:
    """Capitalised words of three letters or more that end like a name and are not to be ignored."""
    words = F.regexp_extract_all(text, F.lit(r"\p{Lu}\p{L}{2,}"), F.lit(0))
    like = lambda w: w.rlike(rf"(?:{'|'.join(endings)})$")
    return F.size(F.filter(words, lambda w: like(w) & ~w.isin(*(ignore or [""]))))


def person_cues(text: Column, cues: list[str], endings: list[str]) -> Column:
    """Names by their surroundings: two capitalised words after a self-introduction or another cue, or a word that ends like a name after a capitalised one."""
    cue = rf"(?i:\b(?:{'|'.join(cues)})\s+)((?:\p{{Lu}}\p{{L}}+\s+)?\p{{Lu}}\p{{L}}+)"
    shape = rf"\p{{Lu}}\p{{L}}+\s+\p{{Lu}}\p{{L}}*(?:{'|'.join(endings)})\b"
    return F.array_sort(F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(cue), F.lit(1)), F.regexp_extract_all(text, F.lit(shape), F.lit(0)))))


def closed_gate(turns: DataFrame, keys: list[str], order: str, text: str, most_digits: int = 5, most_run: int = 3, most_pictographs: int = 3) -> DataFrame:
    """fine: of a dialogue so far at most `most_digits` digits, no run over `most_run`, at most `most_pictographs` different pictographs in a turn."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    digits = F.length(F.regexp_replace(text, "[^0-9]", ""))
    run = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)), lambda r: F.length(r))), F.lit(0))
    pictographs = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"), F.lit(0))))
    out = turns.withColumns({"digits": F.sum(digits).over(upto).cast("long"), "run": run, "pictographs": pictographs})
    return out.withColumn("fine", (F.col("digits") <= most_digits) & (F.col("run") <= most_run) & (F.col("pictographs") <= most_pictographs))


def survived(original: Column, sent: Column, terms: dict[str, list[str]]) -> Column:
    """array<struct<kind, said, kept>>: of each kind of term whether the original says it and the sent text still does."""
    says = lambda c, words: F.lower(c).rlike(rf"\b(?:{'|'.join(words)})\b")
    return F.array(*[F.struct(F.lit(k).alias("kind"), says(original, words).alias("said"), (says(original, words) & says(sent, words)).alias("kept")) for k, words in terms.items()])


def full_verdict(emergency: Column, hard: Column, sensitive: Column, suspicious: Column, entities: Column, masked_chars: Column, length: Column, residual: Column, share: float = 0.45, least_chars: int = 8) -> Column:
    """First rule that holds: emergency, hard identifiers, sensitive content, obfuscation, then the budgets of what may leave."""
    return (
        F.when(emergency, "emergency")
        .when(hard > 0, "local_only")
        .when(sensitive, "local_sensitive")
        .when(suspicious, "reject_obfuscated")
        .when(entities > MAX_ENTITIES, "reject_entities")
        .when(masked_chars > length * share, "reject_share")
        .when(length < least_chars, "reject_short")
        .when(residual > 0, "reject_residual")
        .otherwise("allow_external")
    )


#: Budgets of what may leave: fixed values.
MAX_PLACEHOLDERS, MAX_RESIDUAL, MAX_REDACTED, MIN_CHARS = 12, 0, 0.45, 8


def redaction_facts(text: Column, kinds) -> Column:
    """struct(placeholders, kept): how many labels masking by `kinds` puts into a text, and how many of its characters are left beside them; null texts have none."""
    label = rf"\[(?:{'|'.join(kinds)})\]"
    out = F.coalesce(masked(text, kinds), F.lit(""))
    said = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(label))  # labels that the text itself spells are words of its
    return F.struct((F.regexp_count(out, F.lit(label)) - said).alias("placeholders"), F.length(F.regexp_replace(out, label, "")).alias("kept"))


def gateway(emergency: Column, hard: Column, medical: Column, torn: Column, incomplete: Column, placeholders: Column, residual: Column, redacted: Column, chars: Column, structured: Column, plannable: Column, unknown_person: Column) -> Column:
    """struct(decision, reason, triage): may a request leave, why not, and may its masked text be shown for triage.

    redacted is the masked share of the text, chars the length of what is left. First what never leaves: emergencies, hard identifiers, complaints. A
    structured request sends closed values only, so it is held back for torn words, too many placeholders, or nothing to
    plan (a person nobody knows, or no profile, place or condition at all). A text must besides be analysed to its end, and
    keep to the budgets of placeholders, residual names, masked share and length. triage: complaints and what can't be planned, where
    the text keeps to all budgets. Null facts count as unsafe.
    """
    bad = lambda c: F.coalesce(c, F.lit(True))
    torn, incomplete = bad(torn), bad(incomplete)
    crowded, named, bare = bad(placeholders > MAX_PLACEHOLDERS), bad(residual > MAX_RESIDUAL), bad(redacted > MAX_REDACTED)
    triage = ~(torn | incomplete | crowded | named | bare)
    local = lambda reason, shown=None: F.struct(F.lit("local_only").alias("decision"), F.lit(reason).alias("reason"), (F.lit(False) if shown is None else shown).alias("triage"))
    allowed = lambda shown: F.struct(F.lit("allow_external").alias("decision"), F.lit(None).cast("string").alias("reason"), shown.alias("triage"))
    closed = (
        F.when(torn, local("obfuscation"))
        .when(crowded, local("token_budget"))
        .when(~bad(~plannable), allowed(triage))
        .when(bad(unknown_person), local("unknown_person"))
        .otherwise(local("nothing_to_plan", triage))
    )
    free = (
        F.when(torn, local("obfuscation"))
        .when(incomplete, local("residual_risk"))
        .when(crowded, local("token_budget"))
        .when(named, local("residual_risk"))
        .when(bare, local("over_redacted"))
        .when(bad(chars < MIN_CHARS), local("over_redacted"))
        .otherwise(allowed(F.lit(False)))
    )
    return (
        F.when(bad(emergency), F.struct(F.lit("emergency").alias("decision"), F.lit("emergency").alias("reason"), F.lit(False).alias("triage")))
        .when(bad(hard > 0), local("hard_identifier"))
        .when(bad(medical), local("medical_text", triage))
        .when(F.coalesce(structured, F.lit(False)), closed)
        .otherwise(free)
    )


def hmac_pads(secret: str) -> tuple[bytes, bytes]:
    """The two blocks of 64 bytes that HMAC-SHA-256 (RFC 2104) puts before the message and before its digest."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def keyed_hash(secret: str, message: Column) -> Column:
    """HMAC-SHA-256 of a string under a secret, in lower-case hexadecimal, of built-in functions."""
    inner, outer = hmac_pads(secret)
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(message, "utf-8")), 256))), 256)


def mint_tokens(uses: DataFrame, session: str, kind: str, order: str, at: str, secret: str, most: int = 64, ttl: int = 120, request: str | None = None) -> DataFrame:
    """(session_key, request_key, token, expires) beside each use: tokens are numbered by kind in letters that start at an
    offset of the session's own, anew in each request; keys are keyed hashes of session and request. A request (without
    `request`: a session, with the key '-') has at most `most` tokens.
    """
    scope = [session] if request is None else [session, request]
    key = lambda name, c: keyed_hash(secret, F.concat(F.lit(f"{name}:"), F.col(c).cast("string")))
    offset = F.conv(F.substring(key("label", session), 1, 2), 16, 10).cast("int") % 26
    request_key = F.lit("-") if request is None else F.coalesce(F.substring(key("request", request), 1, 16), F.lit("-"))
    rows = uses.withColumn("__n", F.row_number().over(Window.partitionBy(*scope).orderBy(order))).where(F.col("__n") <= most)
    place = (offset + F.row_number().over(Window.partitionBy(*scope, kind).orderBy(order)) - 1) % (26 * 26)
    letter = lambda i: F.char(F.lit(65) + i)
    label = F.concat(F.when(place >= 26, letter(F.floor(place / 26) - 1)).otherwise(F.lit("")), letter(place % 26))
    return rows.select("*", F.substring(key("session", session), 1, 32).alias("session_key"), request_key.alias("request_key"), F.concat(F.lit("@"), F.upper(kind), F.lit("_"), label).alias("token"), (F.col(at) + ttl).alias("expires")).drop("__n")


def redeem(minted: DataFrame, asked: DataFrame, value: str) -> DataFrame:
    """asked (session_key, request_key if there is one, token, at) with the value of its token; null if that session's
    request has none such, or it has run out by then. Without a request_key those minted without a request are meant.
    """
    whole = asked if "request_key" in asked.columns else asked.withColumn("request_key", F.lit("-"))
    live = minted.select("session_key", "request_key", "token", "expires", F.col(value).alias("value"))
    joined = whole.join(live, ["session_key", "request_key", "token"], "left")
    return joined.select(*asked.columns, F.when(F.col("expires") > F.col("at"), F.col("value")).alias("value"))


def rates(rows: DataFrame, groups: dict[str, Column], measures: dict[str, Column]) -> DataFrame:
    """(kind, key, n, each measure, rate) by every group and in all, the rate that of the first measure in percent."""
    from ..functions.numbers import percent

    keys = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in groups.items()], F.struct(F.lit("all").alias("kind"), F.lit("all").alias("key")))
    marked = rows.select(F.explode(keys).alias("k"), *[c.alias(n) for n, c in measures.items()])
    out = marked.groupBy("k.kind", "k.key").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(n).alias(n) for n in measures])
    return out.withColumn("rate", percent(F.col(next(iter(measures))), F.col("n")))


def deidentified(text: Column, chain: list[str], blocked: list[str]) -> Column:
    """struct(blocked, text): the text after the chain's replacements in order; none where a blocked kind is in it."""
    held = F.lit(False)
    for k in blocked:
        held = held | text.rlike(PATTERNS[k][0])
    return F.struct(held.alias("blocked"), F.when(~held, masked(text, chain)).alias("text"))

"""Text queries over documents, conversations, benchmark, labels and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import etl
from ..operators import linking as lk
from ..operators import privacy as pv
from .registry import Tables, query

NORMAL = r"trim(regexp_replace(lower(regexp_replace(text, '[\x{00AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}]', '', 'g')), '[^\p{L}\p{N}]+', ' ', 'g'))"


@query(f"SELECT doc_id, md5(n) AS digest, length(n) AS chars FROM (SELECT doc_id, {NORMAL} AS n FROM documents)")
def text_normalize(t):
    n = tx.words_only(F.col("text"))
    return t.documents.select("doc_id", F.md5(n).alias("digest"), F.length(n).cast("long").alias("chars"))


@query("""
WITH n AS (SELECT DISTINCT p_name AS k FROM part), p AS (SELECT k, ' ' || k || ' ' AS v FROM n),
g AS (SELECT DISTINCT k, substr(v, CAST(i AS BIGINT), 3) AS g FROM p, (SELECT unnest(generate_series(1, 60)) AS i) WHERE i <= length(v) - 2),
c AS (SELECT k, count(*) AS n FROM g GROUP BY k), s AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.k < b.k GROUP BY 1, 2)
SELECT a, b, c * 1.0::DOUBLE / (x.n + y.n - c) AS similarity FROM s JOIN c x ON x.k = a JOIN c y ON y.k = b WHERE c * 1.0::DOUBLE / (x.n + y.n - c) >= 0.3""")
def trigram_similarity(t):
    return lk.similar_by_trigrams(t.part.select(F.col("p_name").alias("k")).distinct(), "k", "k", 0.3)


_WORDS = "SELECT DISTINCT w FROM (SELECT unnest(string_split(lower(text), ' ')) AS w FROM benchmark) WHERE w <> ''"
#: DuckDB counts edits in bytes, so letters of two bytes are told as capitals, which lower-cased words have none of.
_ONE_BYTE = "translate({0}, 'äöüßéèêëçáíóúñàùîïôûâœ¿¡', 'ABCDEFGHIJKLMNOPQRSTUVWX')"
_PAIRS = f"WITH w AS ({{0}}), v AS (SELECT w, {_ONE_BYTE.format('w')} AS v FROM w) SELECT a.w AS a, b.w AS b, CAST({{1}}(a.v, b.v) AS INTEGER) AS distance FROM v a JOIN v b ON substr(a.w, 1, 1) = substr(b.w, 1, 1) AND a.w < b.w WHERE {{1}}(a.v, b.v) <= {{2}}"


@query(_PAIRS.format(_WORDS, "levenshtein", 2))
def levenshtein_block_join(t):
    """Pairs of words with the same first character, at most two edits apart."""
    words = t.benchmark.select(F.explode(F.split(F.lower("text"), " ")).alias("w")).where("w <> ''").distinct()
    pairs = lk.blocked_distance(words.select(F.col("w").alias("a")), words.select(F.col("w").alias("b")), "a", "b", 2)
    return pairs.where("a < b").select("a", "b", "distance")


@query(_PAIRS.format(_WORDS, "levenshtein", 1))
def levenshtein_words(t):
    """Pairs one edit apart, by what is left of a word without one character."""
    return lk.one_edit_pairs(t.benchmark.select(F.explode(F.split(F.lower("text"), " ")).alias("w")), "w")


def _re(kind: str) -> str:
    return "'" + pv.PATTERNS[kind][0].replace("'", "''") + "'"


@query(" UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, {_re(k)})) AS value FROM documents" for k in pv.PATTERNS))
def pii_values(t):
    return pv.values(t.documents, ["doc_id"], "text")


def _places(i: int, kind: str) -> str:
    """Places of all matches of a kind: what stands between them, and they themselves, add up to where each one starts."""
    return f"""SELECT doc_id, {i} AS turn, '{kind}' AS kind, {pv.PATTERNS[kind][1]}::DOUBLE AS sure, v[i] AS value, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS a
 FROM (SELECT doc_id, v, p, unnest(generate_series(1, len(v))) AS i FROM (SELECT doc_id, regexp_extract_all(text, {_re(kind)}) AS v, string_split_regex(text, {_re(kind)}) AS p FROM documents))"""


_STRENGTH = "{0}.sure * 1000 + {0}.b - {0}.a"
RESOLVED_SPANS = f"""
WITH e AS ({' UNION ALL '.join(_places(i, k) for i, k in enumerate(pv.PATTERNS))}), l AS (SELECT doc_id, list([{{'kind': kind, 'a': a, 'b': CAST(a + length(value) AS INTEGER), 'sure': sure, 'value': value}}] ORDER BY a, length(value) DESC, turn) AS l FROM e GROUP BY doc_id),
r AS (SELECT doc_id, list_reduce(l, lambda acc, x: CASE WHEN x[1].a >= acc[-1].b THEN acc || x WHEN x[1].b > acc[-1].b AND {_STRENGTH.format('x[1]')} > {_STRENGTH.format('acc[-1]')} THEN acc[1:len(acc) - 1] || x ELSE acc END) AS l FROM l),
s AS (SELECT doc_id, x.kind AS kind, x.a AS a, x.b AS b, x.sure AS sure, x.value AS value FROM (SELECT doc_id, unnest(l) AS x FROM r))"""


@query(f'{RESOLVED_SPANS} SELECT doc_id, kind, a AS "start", b AS "end", sure AS confidence FROM s')
def pii_spans(t):
    return t.documents.select("doc_id", F.explode(pv.detector()(F.coalesce("text", F.lit("")))).alias("s")).select("doc_id", "s.kind", "s.start", "s.end", "s.confidence")


KINDS = ["email", "ipv4", "url", "card", "phone"]


def _masked_sql(column: str) -> str:
    for k in KINDS:
        column = f"regexp_replace({column}, {_re(k)}, '[{k}]', 'g')"
    return column


@query(f"SELECT doc_id, md5(m) AS digest, m <> text AS changed FROM (SELECT doc_id, text, {_masked_sql('text')} AS m FROM documents)")
def pii_redact(t):
    m = pv.masked(F.col("text"), KINDS)
    return t.documents.select("doc_id", F.md5(m).alias("digest"), (m != F.col("text")).alias("changed"))


@query(f"""{RESOLVED_SPANS}, v AS (SELECT doc_id, value, arg_min(kind, a) AS kind, min(a) AS at_ FROM s GROUP BY 1, 2), n AS (SELECT *, '[' || kind || '_' || row_number() OVER (PARTITION BY doc_id, kind ORDER BY at_) || ']' AS name FROM v),
o AS (SELECT s.doc_id, a, b, name, lag(b, 1, 0) OVER (PARTITION BY s.doc_id ORDER BY a) AS before FROM s JOIN n ON n.doc_id = s.doc_id AND n.value = s.value),
c AS (SELECT o.doc_id, string_agg(substr(text, before + 1, a - before) || name, '' ORDER BY a) || substr(any_value(text), max(b) + 1) AS out FROM o JOIN documents d ON d.doc_id = o.doc_id GROUP BY o.doc_id)
SELECT c.doc_id, CAST(k AS INTEGER) AS n_values, md5(out) AS digest FROM c JOIN (SELECT doc_id, count(*) AS k FROM n GROUP BY 1) USING (doc_id)""")
def pii_token_redaction(t):
    spans = t.documents.select("doc_id", "text", pv.detector()(F.coalesce("text", F.lit(""))).alias("spans")).where(F.size("spans") > 0)
    named = spans.withColumn("names", pv.tokens(F.col("spans")))
    return named.select("doc_id", F.size("names").alias("n_values"), F.md5(pv.substitute(F.col("text"), F.col("spans"), F.col("names"))).alias("digest"))


@query(f"""
WITH c AS (SELECT doc_id, {' + '.join(f'len(regexp_extract_all(text, {_re(k)}))' for k in pv.HARD)} AS hard, {' + '.join(f'len(regexp_extract_all(text, {_re(k)}))' for k in ('url', 'ipv4', 'uuid', 'date'))} AS soft,
 length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits, length(text) AS n, regexp_matches(lower(text), 'idiot.*moron') AS emergency FROM documents)
SELECT doc_id, CASE WHEN emergency THEN 'emergency' WHEN hard > 0 THEN 'local_only' WHEN hard + soft > 12 THEN 'reject' WHEN digits > n * 0.45 THEN 'reject' ELSE 'allow_external' END AS verdict FROM c""")
def policy_verdict(t):
    text = F.col("text")
    n = pv.counts(text)
    hard = sum((n[k] for k in pv.HARD), F.lit(0))
    soft = sum((n[k] for k in ("url", "ipv4", "uuid", "date")), F.lit(0))
    seen = F.struct(hard.alias("hard"), soft.alias("soft"), F.length(F.regexp_replace(text, "[^0-9]", "")).alias("digits"), F.length(text).alias("n"), F.lower(text).rlike("idiot.*moron").alias("emergency"))
    # as a lambda's argument the counts are made once, however often the rules name them
    told = F.transform(F.array(seen), lambda c: pv.verdict(c["hard"], c["hard"] + c["soft"], c["digits"], c["n"], c["emergency"]))
    return t.documents.select("doc_id", F.get(told, 0).alias("verdict"))


@query(r"""
WITH v AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS w FROM benchmark),
x AS (SELECT conv_id, turn, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS w FROM conversations)
SELECT conv_id, turn, count(*) AS n_words, count(*) FILTER (v.w IS NULL) AS n_unknown, count(*) FILTER (v.w IS NULL) = 0 AS closed FROM x LEFT JOIN v USING (w) WHERE x.w <> '' GROUP BY ALL""")
def closed_vocab(t):
    words = t.benchmark.select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("w"))
    return pv.unknown_words(t.conversations, ["conv_id", "turn"], "text", words, "w")


LEAK_KINDS = list(dict.fromkeys([*KINDS, *pv.HARD]))
_ALL_VALUES = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, {_re(k)})) AS value, m FROM s" for k in LEAK_KINDS)
_WINDOW = "CASE WHEN length(d) >= {0} THEN len(list_filter(generate_series(1, length(d) - {1}), lambda i: contains(ds, substr(d, CAST(i AS BIGINT), {0})))) > 0 ELSE false END"
LEAKED = f"""
WITH s AS (SELECT doc_id, text, {_masked_sql('text')} AS m FROM documents), e AS (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS d, CASE WHEN kind IN ('phone', 'card') THEN regexp_replace(m, '[^0-9]', '', 'g') END AS ds FROM ({_ALL_VALUES})),
l AS (SELECT doc_id, kind, CASE WHEN kind = 'phone' THEN {_WINDOW.format(5, 4)} WHEN kind = 'card' THEN {_WINDOW.format(6, 5)} ELSE contains(lower(m), lower(value)) END AS leaked FROM e)"""


@query(f"{LEAKED} SELECT doc_id, kind, count(*) AS n, count(*) FILTER (leaked) AS leaked FROM l GROUP BY doc_id, kind")
def leak_check(t):
    """Leaks by document: of every masked kind and those that may never leave."""
    sent = t.documents.select("doc_id", pv.masked(F.col("text"), KINDS).alias("sent"))
    samples = pv.values(t.documents, ["doc_id"], "text", LEAK_KINDS).join(sent, "doc_id")
    return pv.leaks(samples, ["doc_id"], "sent", "kind", "value").groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("leaked").alias("leaked"))


@query(f"{LEAKED} SELECT kind, count(*) AS n, count(*) FILTER (leaked) AS leaked FROM l GROUP BY kind")
def leak_check_all(t):
    kinds = LEAK_KINDS
    sent = t.documents.select("doc_id", pv.masked(F.col("text"), KINDS).alias("sent"))
    samples = pv.values(t.documents, ["doc_id"], "text", kinds).join(sent, "doc_id")
    return pv.leaks(samples, ["doc_id"], "sent", "kind", "value").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("leaked").alias("leaked"))


INSULTS = "idiot|moron|stupid|trash|scum|loser|clown|worthless|pathetic|disgusting"


@query(f"""
WITH r AS (SELECT lang, regexp_matches(lower(text), '\\b({INSULTS})\\b') AS p, toxic = 1 AS a FROM labels JOIN documents USING (doc_id)),
x AS (SELECT unnest([lang, 'all']) AS lang, p, a FROM r),
c AS (SELECT lang, count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn, count(*) AS n FROM x GROUP BY lang)
SELECT *, CASE WHEN tp + fp <> 0 THEN floor(tp * 1000.0::DOUBLE / (tp + fp) + 0.5) / 10.0::DOUBLE END AS precision, CASE WHEN tp + fn <> 0 THEN floor(tp * 1000.0::DOUBLE / (tp + fn) + 0.5) / 10.0::DOUBLE END AS recall FROM c""")
def eval_precision_recall(t):
    joined = t.labels.join(t.documents, "doc_id")
    return pv.precision_recall(joined, "lang", F.lower("text").rlike(rf"\b({INSULTS})\b"), F.col("toxic") == 1)


@query("""
WITH RECURSIVE w(doc_id, text, part, start, stop) AS (
 SELECT doc_id, t, 0, 0, CASE WHEN length(t) <= 3500 THEN length(t) WHEN 3501 - instr(reverse(substr(t, 1, 3501)), ' ') > 1750 AND instr(reverse(substr(t, 1, 3501)), ' ') > 0 THEN 3501 - instr(reverse(substr(t, 1, 3501)), ' ') ELSE 3500 END FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
 UNION ALL SELECT doc_id, text, part + 1, a, CASE WHEN length(text) <= a + 3500 THEN length(text) WHEN 3501 - back > 1750 AND back > 0 THEN a + 3501 - back ELSE a + 3500 END
 FROM (SELECT *, instr(reverse(substr(text, a + 1, 3501)), ' ') AS back FROM (SELECT *, greatest(stop - 200, start + 1) AS a FROM w WHERE stop < length(text))))
SELECT doc_id, CAST(part AS INTEGER) AS part, CAST(start AS INTEGER) AS start, md5(substr(text, start + 1, stop - start)) AS digest FROM w""")
def long_text_windows(t):
    return pv.long_windows(t.documents, ["doc_id"], "text").select("doc_id", "part", "start", F.md5("window").alias("digest"))


@query(f"""
WITH r AS (SELECT w, label, weight FROM (VALUES ('the', 'en', 1.0), ('and', 'en', 1.0), ('of', 'en', 1.0), ('der', 'de', 1.0), ('die', 'de', 1.0), ('und', 'de', 1.0), ('de', 'fr', 0.5), ('les', 'fr', 1.0), ('et', 'fr', 1.0), ('que', 'es', 1.0), ('los', 'es', 1.0), ('el', 'es', 1.0), ('de', 'es', 0.5)) v(w, label, weight)),
x AS (SELECT doc_id, unnest(string_split(n, ' ')) AS w, generate_subscripts(string_split(n, ' '), 1) - 1 AS place FROM (SELECT doc_id, {NORMAL} AS n FROM documents)),
s AS (SELECT doc_id, label, CAST(sum(CAST(weight * 4 * CASE WHEN place = 0 THEN 1.0 ELSE 0.5 END AS BIGINT)) AS BIGINT) AS score FROM x JOIN r USING (w) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS n, max(score) OVER (PARTITION BY doc_id) AS top FROM s)
SELECT doc_id, label, score, (SELECT count(*) FROM s WHERE s.doc_id = k.doc_id AND s.score = k.top) > 1 AS tied FROM k WHERE n = 1""")
def word_rule_classifier(t):
    rules = [("the", "en", 4.0), ("and", "en", 4.0), ("of", "en", 4.0), ("der", "de", 4.0), ("die", "de", 4.0), ("und", "de", 4.0), ("de", "fr", 2.0), ("les", "fr", 4.0), ("et", "fr", 4.0), ("que", "es", 4.0), ("los", "es", 4.0), ("el", "es", 4.0), ("de", "es", 2.0)]
    tokens = t.documents.select("doc_id", F.posexplode(F.split(tx.words_only(F.col("text")), " ")).alias("place", "word"))
    found = lk.classify(tokens, ["doc_id"], t.spark.createDataFrame(rules, "word string, label string, weight double"))
    return found.select("doc_id", "label", F.col("score").cast("long").alias("score"), "tied")


@query("""
WITH n AS (SELECT c_custkey AS k, lower(c_mktsegment) || ' ' || (c_custkey % 50) || ' ' || (c_nationkey % 5) AS v FROM customer), s AS (SELECT k, string_split(v, ' ') AS w FROM n),
g AS (SELECT DISTINCT k, unnest([w[1], w[2], w[3], w[1] || ' ' || w[2], w[2] || ' ' || w[3], w[1] || ' ' || w[2] || ' ' || w[3]]) AS gram FROM s)
SELECT gram, k FROM g WHERE gram IN (SELECT gram FROM g GROUP BY gram HAVING count(DISTINCT k) <= 8)""")
def ngram_index(t):
    names = t.customer.select(F.col("c_custkey").alias("k"), F.concat_ws(" ", F.lower("c_mktsegment"), (F.col("c_custkey") % 50).cast("string"), (F.col("c_nationkey") % 5).cast("string")).alias("v"))
    return lk.ngram_index(names, "k", "v").select("gram", "k")


@query("""
WITH m AS (SELECT DISTINCT lower(p_name) AS m FROM part), a AS (SELECT m, m AS key, 0 AS i FROM m WHERE m LIKE 'cold%'),
b AS (SELECT m, split_part(m, ' ', 2) AS key, 1 AS i FROM m WHERE split_part(m, ' ', 2) <> '' AND m NOT LIKE '%bolt%'), c AS (SELECT * FROM a UNION ALL SELECT * FROM b),
f AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY i, key) AS n FROM c)
SELECT m.m AS mention, f.key, CASE f.i WHEN 0 THEN 'exact' WHEN 1 THEN 'noun' END AS stage FROM m LEFT JOIN f ON m.m = f.m AND n = 1""")
def lookup_cascade(t):
    m = t.part.select(F.lower("p_name").alias("mention")).distinct()
    exact = m.where("mention LIKE 'cold%'").withColumn("key", F.col("mention"))
    noun = m.withColumn("key", F.split_part("mention", F.lit(" "), F.lit(2))).where("key <> '' AND mention NOT LIKE '%bolt%'")
    return lk.cascade(m, "mention", [("exact", exact), ("noun", noun)])


@query(_PAIRS.format(_WORDS, "damerau_levenshtein", 1))
def osa_join(t):
    return lk.one_edit_pairs(t.benchmark.select(F.explode(F.split(F.lower("text"), " ")).alias("w")), "w", exact_swaps=True)


def _html_sql(column: str) -> str:
    column = f"regexp_replace({column}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in etl.DROPPED:
        column = f"regexp_replace({column}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', ' ', 'g')"
    column = f"regexp_replace({column}, '(?i)</?(?:{etl.BLOCKS})\\b[^>]*>', chr(10), 'g')"
    column = f"regexp_replace({column}, '<[^>]*>', '', 'g')"
    for name, char in etl.ENTITIES.items():
        column = f"replace({column}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    column = f"regexp_replace(regexp_replace({column}, '[ \\t\\r]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g')"
    return f"trim(regexp_replace({column}, '^\\n+|\\n+$', '', 'g'), ' ')"


@query(f"SELECT page_id, md5(x) AS digest, length(x) AS chars FROM (SELECT page_id, {_html_sql('html')} AS x FROM pages)")
def html_to_text(t):
    x = etl.html_text(F.col("html"))
    return t.pages.select("page_id", F.md5(x).alias("digest"), F.length(x).cast("long").alias("chars"))


@query(r"""
WITH l AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1) AS h, regexp_extract_all(html, '(?is)<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2) AS x FROM pages)
SELECT page_id, CAST(i - 1 AS INTEGER) AS place, h[i] AS href, regexp_replace(x[i], '<[^>]*>', '', 'g') AS label FROM (SELECT *, unnest(generate_series(1, len(h))) AS i FROM l)""")
def html_links(t):
    return etl.links(t.pages, ["page_id"], "html")


@query(r"SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '[?&]utm_source=([^&#]*)', 1) AS source FROM pages")
def url_parts(t):
    part = lambda p: F.regexp_extract("url", p, 1)
    return t.pages.select("page_id", part("^(https?)://").alias("scheme"), part("^https?://([^/?#]+)").alias("host"), part("[?&]utm_source=([^&#]*)").alias("source"))


@query(r"""
WITH c AS (SELECT doc_id, text AS v FROM documents), s AS (SELECT doc_id, CASE WHEN regexp_matches(v, '^[=+\-@\t\r]') THEN '''' || v ELSE v END AS s FROM c)
SELECT doc_id, CASE WHEN regexp_matches(s, '[",;\r\n]') THEN '"' || replace(s, '"', '""') || '"' ELSE s END AS cell FROM s""")
def csv_escape(t):
    return t.documents.select("doc_id", tx.csv_cell(F.col("text")).alias("cell"))


@query(r"""
WITH s AS (SELECT doc_id, CASE WHEN regexp_matches(text, '^[=+\-@\t\r]') THEN '''' || text ELSE coalesce(text, '') END AS s FROM documents),
c AS (SELECT doc_id, CASE WHEN regexp_matches(s, '[",;\r\n]') THEN '"' || replace(s, '"', '""') || '"' ELSE s END AS cell FROM s)
SELECT doc_id, md5(cell) AS digest, length(cell) AS chars FROM c""")
def csv_escape_whole(t):
    """Digest and length of the cells."""
    cell = tx.csv_cell(F.col("text"))
    return t.documents.select("doc_id", F.md5(cell).alias("digest"), F.length(cell).cast("long").alias("chars"))


@query("""
WITH e AS (SELECT event_id, event_type, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, CASE WHEN k % 10 = 0 THEN 'unknown' WHEN k % 10 = 1 THEN 'static' WHEN k % 10 = 2 THEN 'unknown' ELSE 'GET /api/' || event_type || '/:id' END AS endpoint FROM e""")
def endpoint_template(t):
    k = F.get_json_object("props", "$.k").cast("long")
    plain = F.concat(F.lit("/api/"), F.col("event_type"), F.lit("/"), F.col("user_id").cast("string"), F.lit("?x="), k.cast("string"))
    path = F.when(k % 10 == 1, "/assets/app.js").when(k % 10 == 2, F.concat(plain.substr(F.lit(1), F.length(plain) - F.length(F.concat(F.lit("?x="), k.cast("string")))), F.lit("/a/b/c/d/e"))).otherwise(plain)
    return t.events.select("event_id", tx.endpoint(F.lit("get"), path, F.when(k % 10 == 0, 404).otherwise(200)).alias("endpoint"))


@query("""
WITH p AS (SELECT p_partkey, p_partkey % 4 AS m, CAST(floor(p_retailprice) AS BIGINT) AS a FROM part)
SELECT p_partkey, CASE WHEN m <> 3 THEN a END AS low, CASE WHEN m = 0 THEN a WHEN m = 1 THEN a + 500 END AS high FROM p""")
def price_parse(t):
    a = F.floor("p_retailprice").cast("long")
    m = F.col("p_partkey") % 4
    spaced = F.regexp_replace(a.cast("string"), r"^(\d+)(\d{3})$", "$1 $2")
    text = F.when(m == 0, spaced).when(m == 1, F.concat(spaced, F.lit(" - "), (a + 500).cast("string"))).when(m == 2, F.concat(F.lit("from "), spaced)).otherwise("on request")
    return t.part.select("p_partkey", tx.price(text).alias("x")).select("p_partkey", "x.low", "x.high")


@query("""
SELECT p_partkey, CASE WHEN (CASE WHEN contains(p_name, 'bolt') THEN 1 ELSE 0 END + CASE WHEN contains(p_name, 'cold') THEN 1 ELSE 0 END + CASE WHEN contains(p_name, 'large') THEN 1 ELSE 0 END) = 1
 THEN CASE WHEN contains(p_name, 'bolt') THEN 'fastening' WHEN contains(p_name, 'cold') THEN 'cooling' ELSE 'bulk' END END AS service FROM part""")
def service_match(t):
    return t.part.select("p_partkey", tx.one_of(F.col("p_name"), {"fastening": "bolt", "cooling": "cold", "bulk": "large"}).alias("service"))


@query("SELECT s_suppkey, lower(regexp_replace(s_name, '[^A-Za-z0-9]+', '-', 'g')) AS slug, substr(sha256(s_name || '|' || s_nationkey), 1, 12) AS id FROM supplier")
def slug_and_id(t):
    return t.supplier.select("s_suppkey", tx.slug(F.col("s_name")).alias("slug"), tx.short_id(F.col("s_name"), F.col("s_nationkey").cast("string")).alias("id"))

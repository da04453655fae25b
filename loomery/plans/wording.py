"""Words, masks and dialogue: text queries over documents, conversations, benchmark, parts and suppliers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scan
from ..functions import text as tx
from ..functions.numbers import unit_hash
from ..operators import grammar as gm
from ..operators import linking as lk
from ..operators import phrases as ph
from ..operators import privacy as pv
from ..operators import requests as rq
from .registry import SQL, Tables, query
from .texts import INSULTS, KINDS, _masked_sql, _re

ENDINGS = ["tions", "tion", "ings", "ing", "edly", "ed", "ly", "es", "s"]
NUMBER_WORDS = ["one", "two", "three", "the", "of", "in"]
BENCH_WORDS = "SELECT DISTINCT w FROM (SELECT unnest(string_split(lower(text), ' ')) AS w FROM benchmark) WHERE w <> ''"


def bench_words(t: Tables):
    return t.benchmark.select(F.explode(F.split(F.lower("text"), " ")).alias("w")).where("w <> ''").distinct()


@query(f"SELECT doc_id, lang, CASE WHEN regexp_matches(text, {' || '.join([chr(39) + '|' + chr(39)]).join(_re(k) for k in pv.HARD)}) THEN '[redacted]' ELSE substr(text, 1, 120) END AS text FROM documents".replace("'|'", " || '|' || "))
def safe_log(t):
    """Whitelisted fields of a log record; texts with personal data are redacted. The cut to 120 is the feature."""
    return t.documents.select("doc_id", "lang", tx.safe_value(F.col("text"), [pv.PATTERNS[k][0] for k in pv.HARD]).alias("text"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'state' WHEN 'MACHINERY' THEN 'private' ELSE 'unknown' END AS code FROM customer")
def ownership_code(t):
    return t.customer.select("c_custkey", tx.code_of(F.col("c_mktsegment"), {"BUILDING": "state", "MACHINERY": "private"}).alias("code"))


@query(f"SELECT w, regexp_replace(w, '^(.{{3,}}?)(?:{'|'.join(ENDINGS)})$', '\\1') AS stem FROM ({BENCH_WORDS})")
def stem_words(t):
    return bench_words(t).select("w", tx.stem(F.col("w"), ENDINGS).alias("stem"))


@query(f"""
WITH w AS ({BENCH_WORDS}), q AS (SELECT unnest(['therou', 'hteron', 'eron', 'thesn', 'ofthe']) AS q)
SELECT w, q FROM w, q WHERE starts_with(w, q) OR length(q) >= 5 AND (damerau_levenshtein(substr(w, 1, length(q) - 1), q) <= 1 OR damerau_levenshtein(substr(w, 1, length(q)), q) <= 1 OR damerau_levenshtein(substr(w, 1, length(q) + 1), q) <= 1)""")
def prefix_one_edit(t):
    q = t.spark.createDataFrame([(x,) for x in ("therou", "hteron", "eron", "thesn", "ofthe")], "q string")
    return bench_words(t).crossJoin(q).where(tx.begins_nearly(F.col("w"), F.col("q"))).select("w", "q")


RANK = """CASE WHEN v = q THEN 0 WHEN starts_with(v, q) THEN 1 WHEN {0} THEN 2 WHEN {1} THEN 3 WHEN contains(v, q) THEN 4 WHEN {2} THEN 5 END"""
_ROOT = "CASE WHEN length(w) >= 4 THEN regexp_replace(w, '[aeiouy]$', '') ELSE w END"
_ALL = "len(list_filter(string_split(q, ' '), lambda w: len(list_filter(string_split(v, ' '), lambda p: {0})) = 0)) = 0"
_NEAR = f"starts_with(p, {_ROOT}) OR starts_with(p, w) OR length(w) >= 5 AND (damerau_levenshtein(substr(p, 1, length(w) - 1), w) <= 1 OR damerau_levenshtein(substr(p, 1, length(w)), w) <= 1 OR damerau_levenshtein(substr(p, 1, length(w) + 1), w) <= 1)"
QUERIES_ASKED = ["cold bolt", "larg", "smalle ring", "igde", "brigt ring", "widgte"]


@query(f"""
WITH n AS (SELECT DISTINCT lower(p_name) AS v FROM part), q AS (SELECT unnest({QUERIES_ASKED}) AS q),
s AS (SELECT v, q, {RANK.format(_ALL.format('starts_with(p, w)'), _ALL.format(f'starts_with(p, {_ROOT})'), _ALL.format(_NEAR))} AS score FROM n, q)
SELECT * FROM s WHERE score IS NOT NULL""")
def phrase_scores(t):
    names = t.part.select(F.lower("p_name").alias("v")).distinct()
    q = t.spark.createDataFrame([(x,) for x in QUERIES_ASKED], "q string")
    return names.crossJoin(q).withColumn("score", tx.phrase_rank(F.col("v"), F.col("q"))).where("score IS NOT NULL")


@query(f"""
WITH n AS (SELECT p_partkey, lower(p_name) AS v, 'brand ' || substr(p_brand, 7) AS b, 'smalle ring' AS q FROM part),
s AS (SELECT p_partkey, v, q, b, {RANK.format(_ALL.format('starts_with(p, w)'), _ALL.format(f'starts_with(p, {_ROOT})'), _ALL.format(_NEAR))} AS score FROM n)
SELECT p_partkey, score FROM s WHERE score IS NOT NULL""")
def entity_search(t):
    items = t.part.select("p_partkey", F.array("p_name", F.concat(F.lit("brand "), F.substring("p_brand", 7, 9))).alias("phrases"))
    return lk.catalog_search(items, "p_partkey", "phrases", " Smalle  RING!", "p_partkey").select("p_partkey", "score")


@query("""
WITH p AS (SELECT p_partkey, p_name AS v FROM part), i AS (SELECT p_partkey, v, unnest(generate_series(1, length(v))) AS i FROM p),
c AS (SELECT p_partkey, i, substr(v, CAST(i AS BIGINT), 1) AS ch,
 EXISTS (SELECT 1 FROM (SELECT unnest(['ol', 'lt', 'r', 'idg', 'old']) AS k) WHERE substr(lower(v), CAST(greatest(i - length(k) + 1, 1) AS BIGINT), CAST(i + length(k) - 1 - greatest(i - length(k) + 1, 1) + 1 AS BIGINT)) LIKE '%' || k || '%') AS m FROM i)
SELECT p_partkey, CAST(coalesce(sum(CASE WHEN m THEN 1 END), 0) AS BIGINT) AS matched, coalesce(string_agg(ch, '' ORDER BY i) FILTER (m), '') AS shown FROM c GROUP BY p_partkey""")
def highlight(t):
    parts = tx.highlighted(F.col("p_name"), F.array(*[F.lit(x) for x in ("ol", "lt", "r", "idg", "old")]))
    shown = F.array_join(F.transform(F.filter(parts, lambda p: p["match"]), lambda p: p["text"]), "")
    return t.part.select("p_partkey", F.length(shown).cast("long").alias("matched"), shown.alias("shown"))


_CLASSES = "list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda w: CASE WHEN lower(w) IN (" + ", ".join(f"'{w}'" for w in NUMBER_WORDS) + ") THEN 'N' WHEN regexp_full_match(w, '[0-9]+') THEN 'D' WHEN regexp_full_match(w, '\\p{L}') THEN 'L' ELSE 'x' END)"


@query(f"""
WITH c AS (SELECT doc_id, array_to_string({_CLASSES}, '') AS c, regexp_matches(text, '\\p{{L}}{{2}}[\\x{{1F300}}-\\x{{1FAFF}}\\x{{2600}}-\\x{{27BF}}\\x{{FE0F}}]+\\p{{L}}{{2}}|\\p{{Lu}}\\p{{Ll}}{{2,}}[/|\\\\]\\p{{Ll}}{{2,}}') AS torn FROM documents),
r AS (SELECT doc_id, torn, coalesce(list_max(list_transform(regexp_extract_all(c, 'L+'), lambda x: length(x))), 0) AS letters, coalesce(list_max(list_transform(regexp_extract_all(c, 'N+'), lambda x: length(x))), 0) AS numbers,
 coalesce(list_max(list_transform(list_filter(regexp_extract_all(c, '[ND]+'), lambda x: contains(x, 'N') AND contains(x, 'D')), lambda x: length(x))), 0) AS mixed FROM c)
SELECT doc_id, CAST(letters AS INTEGER) AS letters, CAST(numbers AS INTEGER) AS numbers, CAST(mixed AS INTEGER) AS mixed, torn AS broken, letters >= 4 OR numbers >= 5 OR mixed >= 5 OR torn AS suspicious FROM r""")
def obfuscation_metrics(t):
    return t.documents.select("doc_id", tx.obfuscation(F.col("text"), NUMBER_WORDS).alias("o")).select("doc_id", "o.*")


NAME_ENDINGS = ["tion", "ing", "heit", "eau"]


@query("SELECT doc_id, CAST(len(list_filter(regexp_extract_all(text, '\\p{Lu}\\p{L}{2,}'), lambda w: regexp_matches(w, '(?:tion|ing|heit|eau)$') AND w <> 'Ation')) AS INTEGER) AS n FROM documents")
def residual_names(t):
    return t.documents.select("doc_id", pv.residual_names(F.col("text"), NAME_ENDINGS, ["Ation"]).alias("n"))


TITLED = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')"


@query(rf"""
WITH x AS (SELECT p_partkey, 'my name is ' || {TITLED} || ', and with Bold ' || {TITLED} || ' i saw ' || p_brand AS text FROM part),
p AS (SELECT p_partkey, list_concat(regexp_extract_all(text, '(?i:\b(?:my name is|i am)\s+)((?:\p{{Lu}}\p{{L}}+\s+)?\p{{Lu}}\p{{L}}+)', 1), regexp_extract_all(text, '\p{{Lu}}\p{{L}}+\s+\p{{Lu}}\p{{L}}*(?:ing|olt)\b')) AS p FROM x)
SELECT p_partkey, array_to_string(list_sort(list_distinct(p)), '|') AS people FROM p WHERE len(p) > 0""")
def person_cues(t):
    name = F.initcap("p_name")
    text = F.concat(F.lit("my name is "), name, F.lit(", and with Bold "), name, F.lit(" i saw "), F.col("p_brand"))
    people = pv.person_cues(text, ["my name is", "i am"], ["ing", "olt"])
    return t.part.select("p_partkey", people.alias("p")).where(F.size("p") > 0).select("p_partkey", F.array_join("p", "|").alias("people"))


def _located(column: str) -> str:
    for token, phrases in (("HOME", "in the|of the"), ("WORK", "de la|und")):
        for _ in range(2):
            column = rf"regexp_replace({column}, '(?i)(^|[^\p{{L}}\p{{N}}])(?:{phrases})($|[^\p{{L}}\p{{N}}])', '\1@{token}\2', 'g')"
    return column


@query(f"SELECT conv_id, turn, md5({_located('text')}) AS digest FROM conversations")
def location_words(t):
    return t.conversations.select("conv_id", "turn", F.md5(pv.location_tokens(F.col("text"), {"HOME": ["in the", "of the"], "WORK": ["de la", "und"]})).alias("digest"))


@query(r"""
WITH d AS (SELECT conv_id, turn, CAST(sum(length(regexp_replace(text, '[^0-9]', '', 'g'))) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS digits,
 CAST(coalesce(list_max(list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: length(x))), 0) AS INTEGER) AS run, CAST(len(list_distinct(regexp_extract_all(text, '[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]'))) AS INTEGER) AS pictographs FROM conversations)
SELECT *, digits <= 5 AND run <= 3 AND pictographs <= 3 AS fine FROM d""")
def closed_vocabulary_gate(t):
    return pv.closed_gate(t.conversations, ["conv_id"], "turn", "text").select("conv_id", "turn", "digits", "run", "pictographs", "fine")


TERMS = {"insult": INSULTS.split("|"), "licence": ["license", "copyright"], "link": ["http", "https"]}


@query(f"""
WITH m AS (SELECT text, {_masked_sql('text')} AS sent FROM documents),
x AS (SELECT unnest(['insult', 'licence', 'link']) AS kind, unnest([{', '.join(f"regexp_matches(lower(text), '\\b(?:{'|'.join(w)})\\b')" for w in TERMS.values())}]) AS said,
 unnest([{', '.join(f"regexp_matches(lower(sent), '\\b(?:{'|'.join(w)})\\b')" for w in TERMS.values())}]) AS still FROM m)
SELECT kind, count(*) FILTER (said) AS said, count(*) FILTER (said AND still) AS kept FROM x GROUP BY kind""")
def coverage_scoring(t):
    """How often what a text says is still said once it is masked."""
    rows = t.documents.select(F.explode(pv.survived(F.col("text"), pv.masked(F.col("text"), KINDS), TERMS)).alias("x"))
    return rows.groupBy("x.kind").agg(F.count_if("x.said").alias("said"), F.count_if("x.kept").alias("kept"))


@query("SELECT doc_id, CASE WHEN CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0 * 3 AS DOUBLE) < 1 THEN 'test' ELSE 'train' END AS part FROM documents")
def hash_split(t):
    from ..functions.numbers import split_of

    return t.documents.select("doc_id", split_of(F.col("doc_id")).alias("part"))


@query("SELECT c_custkey, CAST(('0x' || substr(md5(c_custkey || '|' || c_nationkey), 1, 8))::BIGINT / 4294967296.0 AS DOUBLE) AS unit FROM customer")
def unit_interval(t):
    return t.customer.select("c_custkey", unit_hash(F.col("c_custkey"), F.col("c_nationkey")).alias("unit"))


MENTIONS = [("the", "A1"), ("of the", "A2"), ("the thin", "A3"), ("and", "A4"), ("in", "A5"), ("is of", "A6"), ("that", "A7"), ("that the", "A8")]
_WORDS_OF = r"list_filter(string_split(lower(regexp_replace(text, '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '')"


@query(f"""
WITH w AS (SELECT item_id, {_WORDS_OF} AS w FROM benchmark),
p AS (SELECT p, min(code) AS code, len(string_split(p, ' ')) AS n FROM (SELECT * FROM (VALUES {", ".join(map(str, MENTIONS))}) v(p, code) UNION ALL SELECT array_to_string(list_slice(w, 1, 6), ' '), 'F' || item_id FROM w WHERE len(w) > 5) GROUP BY p),
r AS (SELECT item_id, w, unnest(generate_series(1, len(w))) AS i FROM w), c AS (SELECT item_id, i - 1 AS a, i - 1 + n AS b, n, code FROM r JOIN p ON array_to_string(list_slice(w, i, i + n - 1), ' ') = p.p AND i + n - 1 <= len(w)),
g AS (SELECT item_id, list([{{'a': a, 'b': b, 'code': code}}] ORDER BY n DESC, a) AS c FROM c GROUP BY item_id),
t AS (SELECT item_id, unnest(list_reduce(c, lambda acc, x: CASE WHEN len(list_filter(acc, lambda t: x[1].a < t.b AND t.a < x[1].b)) > 0 THEN acc ELSE acc || x END)) AS t FROM g)
SELECT item_id, CAST(t.a AS INTEGER) AS at, CAST(t.b AS INTEGER) AS "to", t.code AS code FROM t""")
def longest_mentions(t):
    """A few short phrases, and the first six words of every item."""
    first = t.benchmark.select(ph.words_of(F.col("text")).alias("w"), "item_id").where(F.size("w") > 5)
    own = first.select(F.array_join(F.slice("w", 1, 6), " ").alias("p"), F.concat(F.lit("F"), F.col("item_id").cast("string")).alias("code"))
    phrases = t.spark.createDataFrame(MENTIONS, "p string, code string").union(own)
    return ph.longest_mentions(t.benchmark, ["item_id"], "text", phrases, "p", "code")


TRIAGE_RULES = [("of the", 2.0, "alpha", 0), ("of the", 2.0, "beta", 1), ("tion*", 1.0, "beta", 0), ("and", 1.5, "gamma", 0), ("der", 1.0, "delta", 0), ("und ver*", 2.0, "delta", 0), ("de la", 2.5, "epsilon", 0), ("de la", 2.5, "alpha", 1), ("que*", 0.5, "epsilon", 0)]
TRIAGE_FLAGS = [("urgent", 1, 1, 1, "with the", True), ("urgent", 1, 2, 1, "die", False), ("urgent", 1, 2, 2, "heit*", False), ("watch", 2, 1, 1, "in", True), ("watch", 2, 1, 1, "sur", True)]
TRIAGE_CONTEXT = ["was", "est*", "dans"]
_FITS = "CASE WHEN ends_with({p}, '*') THEN starts_with({w}, rtrim({p}, '*')) ELSE {w} = {p} END"


@query(f"""
WITH w AS (SELECT conv_id, turn, {_WORDS_OF} AS w FROM conversations), i AS (SELECT *, unnest(generate_series(1, len(w))) AS i FROM w),
r(phrase, weight, label, place) AS (VALUES {", ".join(map(str, TRIAGE_RULES))}), f(flag, rank, combo, part, phrase, contextual) AS (VALUES {", ".join(map(str, TRIAGE_FLAGS))}), x(phrase) AS (VALUES {", ".join(f"('{c}')" for c in TRIAGE_CONTEXT)}),
p AS (SELECT phrase, string_split(phrase, ' ') AS p FROM (SELECT phrase FROM r UNION SELECT phrase FROM f UNION SELECT phrase FROM x)),
h AS (SELECT conv_id, turn, phrase, i - 1 AS a, i - 1 + len(p) AS b FROM i JOIN p ON {_FITS.format(p='p[1]', w='w[i]')} WHERE i + len(p) - 1 <= len(w) AND len(list_filter(generate_series(1, len(p)), lambda k: {_FITS.format(p='p[k]', w='w[i + k - 1]')})) = len(p)),
s AS (SELECT conv_id, turn, label, sum(weight * CASE WHEN place = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) AS score FROM (SELECT DISTINCT conv_id, turn, phrase FROM h) JOIN r USING (phrase) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, label) AS n, max(score) OVER (PARTITION BY conv_id, turn) AS top, sum(score) OVER (PARTITION BY conv_id, turn) AS total FROM s),
b AS (SELECT conv_id, turn, string_agg(label, '|' ORDER BY n) FILTER (n <= 3) AS labels, floor(least(1.0::DOUBLE, max(top) / 3) * (0.5::DOUBLE + 0.5::DOUBLE * max(top) / max(total)) * 1000 + 0.5::DOUBLE) / 1000 AS confidence, count(*) FILTER (score = top) > 1 AS tied FROM k GROUP BY ALL),
c AS (SELECT conv_id, turn, a, b FROM h JOIN x USING (phrase)),
y AS (SELECT DISTINCT h.conv_id, h.turn, flag, rank, combo, part FROM h JOIN f USING (phrase) WHERE NOT contextual OR NOT EXISTS (SELECT 1 FROM c WHERE c.conv_id = h.conv_id AND c.turn = h.turn AND c.b > h.a - 6 AND c.a < h.b + 5)),
z AS (SELECT conv_id, turn, flag, rank FROM y GROUP BY conv_id, turn, flag, rank, combo HAVING count(DISTINCT part) = (SELECT count(DISTINCT part) FROM f WHERE f.flag = y.flag AND f.combo = y.combo)), g AS (SELECT conv_id, turn, arg_min(flag, rank) AS flag FROM z GROUP BY ALL)
SELECT w.conv_id, w.turn, flag, coalesce(labels, '') AS labels, coalesce(confidence, 0) AS confidence, coalesce(tied, false) AS tied FROM w LEFT JOIN g USING (conv_id, turn) LEFT JOIN b USING (conv_id, turn)""")
def phrase_triage(t):
    """Scores of labels by phrases and stems, flags by combinations that stand away from what excludes them."""
    rules = t.spark.createDataFrame(TRIAGE_RULES, "phrase string, weight double, label string, place int")
    flags = t.spark.createDataFrame(TRIAGE_FLAGS, "flag string, rank int, combo int, part int, phrase string, contextual boolean")
    context = t.spark.createDataFrame([(c,) for c in TRIAGE_CONTEXT], "phrase string")
    out = ph.triage(t.conversations, ["conv_id", "turn"], "text", rules, flags, context)
    return out.withColumn("labels", F.array_join("labels", "|"))


@query(r"""
WITH n AS (SELECT c_custkey, 'no' || chr(8203) || 'te ' || c_mktsegment || ' ' AS a, translate(substr(c_name, 10, 3), '0123456789', '٠١٢٣٤٥٦٧٨٩') || '–' || translate(substr(c_name, 13, 3), '0123456789', '０１２３４５６７８９') || chr(8203) || substr(c_name, 16, 3) AS d FROM customer)
SELECT c_custkey, CAST(length(a) AS INTEGER) AS "from", CAST(length(a) + 11 AS INTEGER) AS "to", d AS found, md5(a || '[NUMBER]' || ' end') AS masked FROM n""")
def scan_spans(t):
    """Numbers written in digits of other scripts with signs that show nothing, found in the scan view and masked in the original."""
    part = lambda at: F.substring("c_name", at, 3)
    number = F.concat(F.translate(part(10), "0123456789", "٠١٢٣٤٥٦٧٨٩"), F.lit("–"), F.translate(part(13), "0123456789", "０１２３４５６７８９"), F.lit("​"), part(16))
    texts = t.customer.select("c_custkey", F.concat(F.lit("no​te "), F.col("c_mktsegment"), F.lit(" "), number, F.lit(" end")).alias("text"))
    spans = texts.withColumn("v", scan.scan_view("text")).select("c_custkey", "text", F.explode(scan.matches(F.col("v"), r"\d{3}-\d{6}")).alias("s"))
    cut = F.substring(F.col("text"), F.col("s.from") + 1, F.col("s.to") - F.col("s.from"))
    masked = F.concat(F.substring(F.col("text"), F.lit(1), F.col("s.from")), F.lit("[NUMBER]"), F.substring(F.col("text"), F.col("s.to") + 1, F.length("text")))
    return spans.select("c_custkey", "s.from", "s.to", cut.alias("found"), F.md5(masked).alias("masked"))


@query("""
WITH n AS (SELECT DISTINCT p_name AS v FROM part), m AS (SELECT DISTINCT unnest([replace(replace(p_name, 'bolt', 'bollt'), 'ring', 'rnig'), substr(p_name, 2, 1) || substr(p_name, 1, 1) || substr(p_name, 3), 'z' || substr(p_name, 2)]) AS m FROM part),
d AS (SELECT m, v, CAST(damerau_levenshtein(m, v) AS INTEGER) AS distance FROM m, n), f AS (SELECT * FROM d WHERE distance <= CASE WHEN length(m) >= 10 THEN 2 WHEN length(m) >= 5 THEN 1 ELSE 0 END)
SELECT m, v, distance FROM f QUALIFY row_number() OVER (PARTITION BY m ORDER BY distance, v) = 1""")
def fuzzy_names(t):
    names = t.part.select(F.col("p_name").alias("v")).distinct()
    swapped = F.concat(F.substring("v", 2, 1), F.substring("v", 1, 1), F.substring(F.col("v"), F.lit(3), F.length("v")))
    other = F.concat(F.lit("z"), F.substring(F.col("v"), F.lit(2), F.length("v")))
    m = names.select(F.explode(F.array(F.replace(F.replace("v", F.lit("bolt"), F.lit("bollt")), F.lit("ring"), F.lit("rnig")), swapped, other)).alias("m"))
    return lk.fuzzy_names(m, names, "m", "v").select("m", "v", "distance")


@query("SELECT DISTINCT p_name AS v, array_to_string(list_transform(list_filter(list_zip(string_split(p_name, ''), list_prepend('', string_split(p_name, ''))), lambda x: x[1] IS NOT NULL AND x[1] <> x[2]), lambda x: x[1]), '') AS collapsed FROM part")
def collapse_repeats(t):
    return t.part.select(F.col("p_name").alias("v"), tx.collapse_repeats(F.col("p_name")).alias("collapsed")).distinct()


_TO, _FROM = tx.LAYOUT_TO.replace("'", "''"), tx.LAYOUT_FROM


@query(f"SELECT DISTINCT p_name || p_size AS v, translate(lower(p_name || p_size), '{tx.LEET_FROM}', '{tx.LEET_TO}') AS unfolded, translate(lower(translate(p_name, '{_TO}', '{_FROM}')), '{_FROM}', '{_TO}') AS typed FROM part")
def leet_and_layout(t):
    v = F.concat("p_name", F.col("p_size").cast("string"))
    return t.part.select(v.alias("v"), tx.unfold_leet(v).alias("unfolded"), tx.from_layout(F.translate("p_name", tx.LAYOUT_TO, tx.LAYOUT_FROM)).alias("typed")).distinct()


def _translit_sql(column: str) -> str:
    for a, b in tx.TRANSLIT.items():
        column = f"replace({column}, '{a}', '{b}')"
    return column


@query(f"SELECT DISTINCT translate(p_name, 'abdegiklmnoprstuw', 'абдегиклмнопрстуж') AS v, {_translit_sql(chr(40) + 'translate(p_name, ' + repr('abdegiklmnoprstuw') + ', ' + repr('абдегиклмнопрстуж') + chr(41) + chr(41))} AS key FROM part")
def translit_key(t):
    v = F.translate("p_name", "abdegiklmnoprstuw", "абдегиклмнопрстуж")
    return t.part.select(v.alias("v"), tx.transliterate(v).alias("key")).distinct()


@query("""
WITH n AS (SELECT DISTINCT p_name AS v FROM part), g AS (SELECT v, list_distinct(list_transform(generate_series(1, length(v)), lambda i: substr(' ' || v || ' ', CAST(i AS BIGINT), 3))) AS g FROM n)
SELECT a.v AS a, b.v AS b, (len(list_intersect(a.g, b.g)) * 1.0::DOUBLE / len(list_distinct(a.g || b.g)) + (1 - levenshtein(a.v, b.v) * 1.0::DOUBLE / greatest(length(a.v), length(b.v), 1))) / 2 AS similarity FROM g a JOIN g b ON substr(a.v, 1, 1) = substr(b.v, 1, 1) AND a.v < b.v""")
def blended_similarity(t):
    n = t.part.select(F.col("p_name").alias("a")).distinct()
    pairs = n.join(n.withColumnRenamed("a", "b"), F.substring("a", 1, 1) == F.substring("b", 1, 1)).where("a < b")
    return pairs.withColumn("similarity", lk.blended(F.col("a"), F.col("b")))


def _keyed(message: str) -> str:
    """HMAC-SHA-256 under the secret 's', out of its two pads."""
    inner, outer = ("'" + "".join(f"\\x{b:02X}" for b in pad) + "'::BLOB" for pad in pv.hmac_pads("s"))
    return f"sha256({outer} || unhex(sha256({inner} || encode({message}))))"


def _minted(scope: str, request: str) -> str:
    return f"""
WITH u AS (SELECT DISTINCT user_id, substr({_keyed("'session:' || user_id")}, 1, 32) AS session_key, ('0x' || substr({_keyed("'label:' || user_id")}, 1, 2))::INTEGER % 26 AS off FROM events),
t AS (SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY {scope} ORDER BY event_id) AS n, row_number() OVER (PARTITION BY {scope}, event_type ORDER BY event_id) AS k FROM events QUALIFY n <= 64),
p AS (SELECT t.*, session_key, {request} AS request_key, (off + k - 1) % 676 AS place FROM t JOIN u USING (user_id)),
m AS (SELECT *, '@' || upper(event_type) || '_' || CASE WHEN place >= 26 THEN chr(CAST(64 + place // 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + place % 26 AS INTEGER)) AS token FROM p)"""


@query(f"{_minted('user_id', chr(39) + '-' + chr(39))} SELECT event_id, session_key, token FROM m")
def token_vault(t):
    rows = t.events.select("event_id", "user_id", "event_type", F.col("event_id").alias("at"))
    return pv.mint_tokens(rows, "user_id", "event_type", "event_id", "at", "s").select("event_id", "session_key", "token")


@query(f"""{_minted("user_id, strftime(ts, '%Y-%m-%d')", f"substr({_keyed(chr(39) + 'request:' + chr(39) + ' || day')}, 1, 16)")},
d AS (SELECT session_key, request_key, lead(request_key) OVER (PARTITION BY session_key ORDER BY day) AS next FROM (SELECT DISTINCT session_key, request_key, day FROM m)),
a AS (SELECT event_id, 'own' AS asked, session_key, request_key, token, event_id + 60 AS then_ FROM m UNION ALL SELECT event_id, 'late', session_key, request_key, token, event_id + 120 FROM m
 UNION ALL SELECT event_id, 'next_request', m.session_key, next, token, event_id + 60 FROM m JOIN d ON d.session_key = m.session_key AND d.request_key = m.request_key WHERE next IS NOT NULL)
SELECT a.event_id, asked, CASE WHEN m.event_id + 120 > then_ THEN m.event_id END AS value FROM a LEFT JOIN m ON m.session_key = a.session_key AND m.request_key = a.request_key AND m.token = a.token""")
def token_redeem(t):
    """A user's day is a request: its tokens asked back in time, too late, and within the user's next request."""
    rows = t.events.select("event_id", "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_id").alias("at"))
    minted = pv.mint_tokens(rows, "user_id", "event_type", "event_id", "at", "s", request="day")
    days = minted.select("session_key", "request_key", "day").distinct()
    after = F.lead("request_key").over(Window.partitionBy("session_key").orderBy("day"))
    ways = minted.join(days.select("session_key", "request_key", after.alias("next")), ["session_key", "request_key"])
    way = lambda name, request, wait: F.struct(F.lit(name).alias("asked"), request.alias("request_key"), (F.col("event_id") + wait).alias("at"))
    asked = ways.select("event_id", "session_key", "token", F.explode(F.array(way("own", F.col("request_key"), 60), way("late", F.col("request_key"), 120), way("next_request", F.col("next"), 60))).alias("w"))
    asked = asked.select("event_id", "session_key", "token", "w.*").where("request_key IS NOT NULL")
    return pv.redeem(minted, asked, "event_id").select(F.col("event_id"), "asked", "value")


@query("""
SELECT conv_id, turn, CAST(length(text) AS INTEGER) AS n, CASE WHEN length(text) % 10 >= 6 OR role <> 'user' THEN 'mask' WHEN length(text) % 10 >= 4 THEN 'doubtful' ELSE 'drop' END AS band FROM conversations""")
def ner_bands(t):
    return t.conversations.select("conv_id", "turn", F.length("text").alias("n"), pv.bands(F.length("text") % 10 / 10.0, F.col("role") == "user").alias("band"))


@query(f"""
WITH c AS (SELECT doc_id, text, {' + '.join(f'len(regexp_extract_all(text, {_re(k)}))' for k in ('card', 'phone'))} AS hard, {' + '.join(f'len(regexp_extract_all(text, {_re(k)}))' for k in ('email', 'url', 'ipv4', 'uuid', 'date'))} AS soft, regexp_matches(lower(text), 'idiot.*moron') AS emergency,
 regexp_matches(lower(text), '\\b(license|copyright)\\b') AS sensitive, array_to_string({_CLASSES}, '') AS c, length(text) AS n, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits, len(list_filter(regexp_extract_all(text, '\\p{{Lu}}\\p{{L}}{{2,}}'), lambda w: regexp_matches(w, '(?:tionheit|ingeau)$'))) AS residual FROM documents)
SELECT doc_id, CASE WHEN emergency THEN 'emergency' WHEN hard > 0 THEN 'local_only' WHEN sensitive THEN 'local_sensitive' WHEN regexp_matches(c, 'LLLL|NNNNN') OR len(list_filter(regexp_extract_all(c, '[ND]+'), lambda x: contains(x, 'N') AND contains(x, 'D') AND length(x) >= 5)) > 0 THEN 'reject_obfuscated'
 WHEN soft > 12 THEN 'reject_entities' WHEN digits > n * 0.45::DOUBLE THEN 'reject_share' WHEN n < 8 THEN 'reject_short' WHEN residual > 0 THEN 'reject_residual' ELSE 'allow_external' END AS verdict FROM c""")
def full_policy(t):
    text = F.col("text")
    n = pv.counts(text, ("card", "phone", "email", "url", "ipv4", "uuid", "date"))
    kept = t.documents.select("doc_id", (n["card"] + n["phone"]).alias("hard"), (n["email"] + n["url"] + n["ipv4"] + n["uuid"] + n["date"]).alias("soft"), F.lower(text).rlike("idiot.*moron").alias("emergency"), F.lower(text).rlike(r"\b(license|copyright)\b").alias("sensitive"), tx.obfuscation(text, NUMBER_WORDS)["suspicious"].alias("hidden"), F.length(F.regexp_replace(text, "[^0-9]", "")).alias("digits"), F.length(text).alias("n"), pv.residual_names(text, ["tionheit", "ingeau"]).alias("residual"))
    c = F.col
    return kept.select("doc_id", pv.full_verdict(c("emergency"), c("hard"), c("sensitive"), c("hidden"), c("soft"), c("digits"), c("n"), c("residual")).alias("verdict"))


GATE_KINDS = ("email", "url", "ipv4", "phone", "card", "date", "uuid")


def _gate_masked() -> str:
    out = "text"
    for k in GATE_KINDS:
        out = f"regexp_replace({out}, {_re(k)}, '[{k}]', 'g')"
    return out


_GATE_LABEL = "'\\[(?:" + "|".join(GATE_KINDS) + ")\\]'"


@query(f"""
WITH c AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), d AS (SELECT *, {_gate_masked()} AS m, array_to_string({_CLASSES}, '') AS c FROM c),
e AS (SELECT doc_id, unnest([true, false]) AS structured, regexp_matches(lower(text), 'idiot.*moron') AS emergency, len(regexp_extract_all(text, {_re('card')})) + len(regexp_extract_all(text, {_re('phone')})) > 0 AS hard, regexp_matches(lower(text), '\\b(license|copyright)\\b') AS medical,
 regexp_matches(c, 'LLLL|NNNNN') OR len(list_filter(regexp_extract_all(c, '[ND]+'), lambda x: contains(x, 'N') AND contains(x, 'D') AND length(x) >= 5)) > 0 OR regexp_matches(text, '\\p{{L}}{{2}}[\\x{{1F300}}-\\x{{1FAFF}}\\x{{2600}}-\\x{{27BF}}\\x{{FE0F}}]+\\p{{L}}{{2}}|\\p{{Lu}}\\p{{Ll}}{{2,}}[/|\\\\]\\p{{Ll}}{{2,}}') AS torn,
 len(regexp_extract_all(text, '\\p{{Lu}}\\p{{L}}+')) > 40 AS incomplete, len(regexp_extract_all(m, {_GATE_LABEL})) - len(regexp_extract_all(text, {_GATE_LABEL})) AS labels, length(regexp_replace(m, {_GATE_LABEL}, '', 'g')) AS kept, length(text) AS n,
 len(list_filter(regexp_extract_all(text, '\\p{{Lu}}\\p{{L}}{{2,}}'), lambda w: regexp_matches(w, '(?:tionheit|ingeau)$'))) AS residual, regexp_matches(lower(text), '(^|\\s)(the|der|le)(\\s|$)') AS plannable FROM d),
f AS (SELECT *, CASE WHEN n > 0 THEN (n - kept) * 1.0::DOUBLE / n ELSE 0 END AS share FROM e), g AS (SELECT *, NOT (torn OR incomplete OR labels > 12 OR residual > 0 OR share > 0.45::DOUBLE) AS shown FROM f),
h AS (SELECT *, CASE WHEN emergency THEN 'emergency' WHEN hard THEN 'hard_identifier' WHEN medical THEN 'medical_text' WHEN torn THEN 'obfuscation' WHEN structured THEN CASE WHEN labels > 12 THEN 'token_budget' WHEN plannable THEN NULL WHEN residual > 0 THEN 'unknown_person' ELSE 'nothing_to_plan' END
 WHEN incomplete THEN 'residual_risk' WHEN labels > 12 THEN 'token_budget' WHEN residual > 0 THEN 'residual_risk' WHEN share > 0.45::DOUBLE OR kept < 8 THEN 'over_redacted' END AS reason FROM g)
SELECT doc_id, structured, CASE WHEN reason IS NULL THEN 'allow_external' WHEN reason = 'emergency' THEN reason ELSE 'local_only' END AS decision, reason, CASE WHEN reason IN ('medical_text', 'nothing_to_plan') OR reason IS NULL AND structured THEN shown ELSE false END AS triage FROM h""")
def gateway_policy(t):
    """Every text as a request, once with its words and once as closed values only."""
    text = F.coalesce("text", F.lit(""))
    n = pv.counts(text, ("card", "phone"))
    facts = t.documents.select("doc_id", F.lower(text).rlike("idiot.*moron").alias("emergency"), (n["card"] + n["phone"]).alias("hard"), F.lower(text).rlike(r"\b(license|copyright)\b").alias("medical"), tx.obfuscation(text, NUMBER_WORDS)["suspicious"].alias("torn"), (F.regexp_count(text, F.lit(r"\p{Lu}\p{L}+")) > 40).alias("incomplete"), pv.redaction_facts(text, GATE_KINDS).alias("r"), F.length(text).alias("n"), pv.residual_names(text, ["tionheit", "ingeau"]).alias("residual"), F.lower(text).rlike(r"(^|\s)(the|der|le)(\s|$)").alias("plannable"))
    rows = facts.withColumn("structured", F.explode(F.array(F.lit(True), F.lit(False))))
    c = F.col
    share = F.when(c("n") > 0, (c("n") - c("r.kept")) / c("n")).otherwise(0.0)
    told = pv.gateway(c("emergency"), c("hard"), c("medical"), c("torn"), c("incomplete"), c("r.placeholders"), c("residual"), share, c("r.kept"), c("structured"), c("plannable"), c("residual") > 0)
    return rows.select("doc_id", "structured", told.alias("told")).select("doc_id", "structured", "told.*")


_SAID = "CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(replace(p_name, 'o', '0'), 'l', 'll') WHEN 2 THEN substr(p_name, 1, 2) || substr(p_name, 4, 1) || substr(p_name, 3, 1) || substr(p_name, 5) WHEN 3 THEN p_name || ' ' || p_brand ELSE 'q' || p_name END"
_FOLD = "array_to_string(list_transform(list_filter(list_zip(string_split({0}, ''), list_prepend('', string_split({0}, ''))), lambda x: x[1] IS NOT NULL AND (x[2] IS NULL OR x[1] <> x[2])), lambda x: x[1]), '')"
_PLAIN = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
RESOLVED = f"""
WITH m AS (SELECT p_partkey // 10 AS doc, p_partkey AS place, {_SAID} AS mention FROM part), n AS (SELECT DISTINCT p_name AS name FROM part),
a AS (SELECT *, {_PLAIN.format('mention')} AS w FROM m), b AS (SELECT *, {_PLAIN.format('name')} AS w FROM n),
a2 AS (SELECT *, translate(w, '{tx.LEET_FROM}', '{tx.LEET_TO}') AS u FROM a), b2 AS (SELECT *, translate(w, '{tx.LEET_FROM}', '{tx.LEET_TO}') AS u FROM b),
a3 AS (SELECT *, {_FOLD.format('u')} AS f FROM a2), b3 AS (SELECT *, {_FOLD.format('u')} AS f FROM b2),
bw AS (SELECT w, min(name) AS x FROM b3 GROUP BY w), bf AS (SELECT f, min(name) AS y FROM b3 GROUP BY f),
e AS (SELECT a3.*, x, y FROM a3 LEFT JOIN bw USING (w) LEFT JOIN bf USING (f)),
t AS (SELECT *, CASE WHEN x IS NULL AND y IS NULL THEN row_number() OVER (PARTITION BY doc, x IS NULL AND y IS NULL ORDER BY place) END AS turn FROM e),
d AS (SELECT q.w, name, damerau_levenshtein(q.w, b3.w) AS d, 1 - damerau_levenshtein(q.w, b3.w) * 1.0::DOUBLE / greatest(length(q.w), length(b3.w)) AS s FROM (SELECT DISTINCT w FROM t WHERE turn <= 2) q, b3),
z AS (SELECT w, name FROM d WHERE d <= 2 AND s >= 0.86 QUALIFY row_number() OVER (PARTITION BY w ORDER BY s DESC, name) = 1),
r AS (SELECT t.doc, t.place, mention, CASE WHEN turn > 2 THEN NULL ELSE coalesce(x, y, z.name) END AS name, CASE WHEN x IS NOT NULL THEN 'exact' WHEN y IS NOT NULL THEN 'folded' WHEN turn > 2 THEN 'over_budget' WHEN z.name IS NOT NULL THEN 'fuzzy' ELSE 'unknown' END AS stage FROM t LEFT JOIN z ON z.w = t.w)"""


def resolved(t: Tables):
    n = F.col("p_name")
    swapped = F.concat(F.substring(n, 1, 2), F.substring(n, 4, 1), F.substring(n, 3, 1), F.substring(n, F.lit(5), F.length(n)))
    said = F.when(F.col("p_partkey") % 5 == 0, F.upper(n)).when(F.col("p_partkey") % 5 == 1, F.replace(F.replace(n, F.lit("o"), F.lit("0")), F.lit("l"), F.lit("ll"))).when(F.col("p_partkey") % 5 == 2, swapped)
    said = said.when(F.col("p_partkey") % 5 == 3, F.concat(n, F.lit(" "), F.col("p_brand"))).otherwise(F.concat(F.lit("q"), n))
    mentions = t.part.select(F.floor(F.col("p_partkey") / 10).alias("doc"), F.col("p_partkey").alias("place"), said.alias("mention"))
    return lk.resolve(mentions, t.part.select("p_name"), "doc", "place", "mention", "p_name", budget=2)


@query(f"{RESOLVED} SELECT * FROM r")
def resolve_mentions(t):
    """Parts named in capitals, with signs for letters, with a swap, with a brand behind, with a letter before."""
    return resolved(t)


@query(f"{RESOLVED} SELECT unnest(['exact', 'folded', 'fuzzy']) AS stage, unnest([count(*), count(*) FILTER (stage <> 'exact'), count(*) FILTER (stage IN ('fuzzy', 'unknown'))]) AS rows_in, unnest([count(*) FILTER (stage = 'exact'), count(*) FILTER (stage = 'folded'), count(*) FILTER (stage = 'fuzzy')]) AS found FROM r")
def resolve_stages(t):
    return lk.stage_rows(resolved(t))


_DAY_NAMES = "['monday', 'tuesday', 'wednesday', 'thursday', 'friday', 'saturday', 'sunday']"


@query(f"""
WITH k AS (SELECT conv_id, turn, length(text) AS n, CAST(conv_id % 7 AS BIGINT) AS a, CAST(turn % 7 AS BIGINT) AS b, CAST((conv_id + 3) % 7 AS BIGINT) AS c FROM conversations)
SELECT conv_id, turn, {_DAY_NAMES}[a + 1] AS days, CASE WHEN b = a AND c = a THEN '' WHEN b = a THEN {_DAY_NAMES}[c + 1] WHEN c = a OR b = c THEN {_DAY_NAMES}[b + 1] WHEN b < c THEN {_DAY_NAMES}[b + 1] || '|' || {_DAY_NAMES}[c + 1] ELSE {_DAY_NAMES}[c + 1] || '|' || {_DAY_NAMES}[b + 1] END AS not_days,
 CAST((n % 12 + 12) * 60 + 30 AS INTEGER) AS after, CAST(CASE WHEN n % 24 < 24 THEN n % 24 * 60 END AS INTEGER) AS before, n * 10 AS most_price, CASE WHEN n % 2 = 0 THEN 'female' ELSE 'male' END AS gender,
 CAST(n % 30 AS INTEGER) AS experience, CAST(n % 90 AS INTEGER) AS travel_minutes, 'foot' AS travel_mode, 'repeat' AS visit, 'distance' AS sort, CAST(n % 9 AS INTEGER) AS "limit" FROM k""")
def conditions_said(t):
    """Every turn's text with a request behind it: negated lists, values taken back and given anew, numbers with and without units."""
    n = F.length("text")
    day = lambda k: F.get(F.array(*[F.lit(d) for d in list(gm.DAYS)[:7]]), (k % 7).cast("int"))
    say = lambda x: x.cast("string")
    said = F.concat(
        F.lit(". Not on "), day(F.col("turn")), F.lit(", or "), day(F.col("conv_id") + 3), F.lit("s but on "), day(F.col("conv_id")), F.lit("; after "), say(n % 12), F.lit(":30 PM. Not before 9 am. Until "), say(n % 24), F.lit(". At most "), say(n * 10),
        F.lit(", a "), F.when(n % 2 == 0, "woman").otherwise("man"), F.lit(" not a lady. With at least "), say(n % 30), F.lit(" years, within "), say(n % 90), F.lit(" minutes on foot, not by car. First visit? No, a repeat one; the cheapest. No, not cheapest but nearest. Show "), say(n % 9),
    )
    said = F.regexp_replace(said, "No, a repeat", "It is a repeat")
    got = t.conversations.select("conv_id", "turn", gm.conditions(F.concat(F.coalesce("text", F.lit("")), said)).alias("c")).select("conv_id", "turn", "c.*")
    return got.withColumns({"days": F.array_join("days", "|"), "not_days": F.array_join("not_days", "|")})


_ASKED = "CASE WHEN role = 'assistant' THEN CASE length(text) % 4 WHEN 0 THEN 'day' WHEN 1 THEN 'price' WHEN 2 THEN 'after' END END"
_NAMED = "CASE WHEN role <> 'assistant' AND length(text) % 5 = 0 THEN CASE WHEN length(text) % 2 = 0 THEN 'price' ELSE 'day' END END"
_BARE = "CASE WHEN role <> 'assistant' AND length(text) % 3 <> 0 THEN CAST(length(text) % 31 AS VARCHAR) END"
_TURN = "{{'turn': {0}, 'asked': {1}, 'said': {2}, 'said_value': {3}, 'bare': {4}, 'field': {5}, 'value': {6}, 'pending': {7}}}"
_NO_TEXT = "CAST(NULL AS VARCHAR)"
_FIELD = "CASE WHEN x[1].said IS NOT NULL THEN x[1].said WHEN x[1].bare IS NOT NULL THEN acc[-1].pending END"


@query(f"""
WITH g AS (SELECT conv_id, list([{_TURN.format('turn', _ASKED, _NAMED, "CAST(length(text) AS VARCHAR)", _BARE, _NO_TEXT, _NO_TEXT, _NO_TEXT)}] ORDER BY turn) AS l FROM conversations GROUP BY conv_id),
f AS (SELECT conv_id, list_reduce(list_prepend([{_TURN.format('CAST(-1 AS BIGINT)', *[_NO_TEXT] * 7)}], l), lambda acc, x: acc || [{_TURN.format('x[1].turn', 'x[1].asked', 'x[1].said', 'x[1].said_value', 'x[1].bare', _FIELD, f"CASE WHEN x[1].said IS NOT NULL THEN x[1].said_value WHEN x[1].bare IS NOT NULL AND acc[-1].pending IS NOT NULL THEN x[1].bare END", f"coalesce(x[1].asked, CASE WHEN acc[-1].pending IS DISTINCT FROM {_FIELD} THEN acc[-1].pending END)")}]) AS f FROM g),
u AS (SELECT conv_id, unnest(f) AS x FROM f) SELECT conv_id, x.turn AS turn, x.field AS field, x.value AS value, x.pending AS pending FROM u WHERE x.turn >= 0""")
def pending_questions(t):
    """What every turn settles: bare answers go to the question that waits."""
    n, asks = F.length("text"), F.col("role") == "assistant"
    rows = t.conversations.select(
        "conv_id", "turn", F.when(asks, F.when(n % 4 == 0, "day").when(n % 4 == 1, "price").when(n % 4 == 2, "after")).alias("asked"), F.when(~asks & (n % 5 == 0), F.when(n % 2 == 0, "price").otherwise("day")).alias("said"),
        n.cast("string").alias("said_value"), F.when(~asks & (n % 3 != 0), (n % 31).cast("string")).alias("bare"),
    )
    return gm.dialogue(rows, "conv_id", "turn", "asked", "said", "said_value", "bare").select("conv_id", "turn", "field", "value", "pending")


_ASKING = "text || '. A ' || CASE length(text) % 3 WHEN 0 THEN 'woman' ELSE 'man' END || ', after ' || (length(text) % 9 + 12) || ', under ' || (length(text) * 20) || '; not on ' || " + _DAY_NAMES + "[conv_id % 7 + 1] || CASE WHEN turn % 2 = 0 THEN '. Cheapest' ELSE '' END || CASE WHEN turn % 3 = 0 THEN '. Show 2' ELSE '' END"


@query(f"""
WITH t AS ({SQL['phrase_triage'].replace('FROM conversations', f'FROM (SELECT conv_id, turn, {_ASKING} AS text FROM conversations)')}),
a AS (SELECT conv_id, turn, flag, CASE WHEN flag IS NULL AND labels <> '' AND confidence >= 0.3 THEN split_part(labels, '|', 1) END AS specialty FROM t),
q AS (SELECT conv_id, turn, CASE length(text) % 3 WHEN 0 THEN 'female' ELSE 'male' END AS gender, (length(text) % 9 + 12) * 60 AS after, length(text) * 20 AS most, conv_id % 7 AS off, turn % 2 = 0 AS cheap, CASE WHEN turn % 3 = 0 THEN 2 ELSE 3 END AS k FROM conversations),
c AS (SELECT s_suppkey AS id, ['alpha', 'beta', 'gamma', 'delta', 'epsilon'][s_suppkey % 5 + 1] AS specialty, CASE s_suppkey % 3 WHEN 0 THEN 'female' WHEN 1 THEN 'male' END AS gender, CASE WHEN s_suppkey % 7 <> 0 THEN CAST(floor(s_acctbal) AS BIGINT) END AS price,
 s_suppkey % 40 AS experience, 960 + s_suppkey % 5 * 60 AS closes, list_filter([0, 1, 2, 3, 4, 5, 6], lambda d: (s_suppkey + d) % 3 <> 0) AS days FROM supplier),
m AS (SELECT conv_id, turn, c.id, k, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY CASE WHEN cheap THEN price END ASC NULLS LAST, experience DESC NULLS LAST, price ASC NULLS LAST, c.id) AS INTEGER) AS rank
 FROM a JOIN q USING (conv_id, turn) JOIN c USING (specialty) WHERE c.gender = q.gender AND price <= most AND closes > after AND len(list_filter(days, lambda d: d <> off)) > 0)
SELECT a.conv_id, a.turn, CASE WHEN flag IS NOT NULL THEN 'emergency' WHEN specialty IS NULL THEN 'unclear' WHEN rank IS NOT NULL THEN 'found' ELSE 'nothing' END AS state, flag, specialty, rank, id
FROM a LEFT JOIN (SELECT * FROM m WHERE rank <= k) m ON a.conv_id = m.conv_id AND a.turn = m.turn""")
def chat_search(t):
    """From every turn's text to its best suppliers: triage, conditions and search in one plan."""
    n, key = F.length("text"), F.col("s_suppkey")
    names = list(gm.DAYS)[:7]
    say = lambda x: x.cast("string")
    asking = F.concat("text", F.lit(". A "), F.when(n % 3 == 0, "woman").otherwise("man"), F.lit(", after "), say(n % 9 + 12), F.lit(", under "), say(n * 20), F.lit("; not on "), F.get(F.array(*[F.lit(d) for d in names]), (F.col("conv_id") % 7).cast("int")), F.when(F.col("turn") % 2 == 0, ". Cheapest").otherwise(""), F.when(F.col("turn") % 3 == 0, ". Show 2").otherwise(""))
    days = F.transform(F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(names)]), lambda x: (key + x["i"]) % 3 != 0), lambda x: x["d"])
    candidates = t.supplier.select(
        key.alias("id"), F.get(F.array(*[F.lit(x) for x in ("alpha", "beta", "gamma", "delta", "epsilon")]), (key % 5).cast("int")).alias("specialty"), F.when(key % 3 == 0, "female").when(key % 3 == 1, "male").alias("gender"),
        F.when(key % 7 != 0, F.floor("s_acctbal")).alias("price"), (key % 40).alias("experience"), days.alias("days"), (480 + key % 4 * 60).alias("opens"), (960 + key % 5 * 60).alias("closes"),
    )
    rules = t.spark.createDataFrame(TRIAGE_RULES, "phrase string, weight double, label string, place int")
    flags = t.spark.createDataFrame(TRIAGE_FLAGS, "flag string, rank int, combo int, part int, phrase string, contextual boolean")
    context = t.spark.createDataFrame([(c,) for c in TRIAGE_CONTEXT], "phrase string")
    return rq.chat_search(t.conversations.select("conv_id", "turn", asking.alias("text")), ["conv_id", "turn"], "text", rules, flags, context, candidates)


@query("""
WITH n AS (SELECT DISTINCT p_name AS a FROM part UNION SELECT DISTINCT unnest(string_split(lower(text), ' ')) FROM benchmark), g AS (SELECT a, list_distinct(list_transform(generate_series(1, length(a)), lambda i: substr(' ' || a || ' ', CAST(i AS BIGINT), 3))) AS g FROM n WHERE a <> ''),
p AS (SELECT x.a, y.a AS b, x.g AS g, y.g AS h, greatest(length(x.a), length(y.a)) AS n, damerau_levenshtein(translate(x.a, 'ßäçèéêíñóöü', 'ABCDEFGHIJK'), translate(y.a, 'ßäçèéêíñóöü', 'ABCDEFGHIJK')) AS d FROM g x JOIN g y ON x.a < y.a),
e AS (SELECT *, CASE WHEN d <= least(3, n // 3 + 1) THEN 1 - d * 1.0::DOUBLE / n ELSE 0 END AS edits FROM p), s AS (SELECT a, b, CASE WHEN edits >= 0.82::DOUBLE THEN edits ELSE greatest(edits, len(list_intersect(g, h)) * 1.0::DOUBLE / len(list_distinct(g || h))) END AS similarity FROM e)
SELECT * FROM s WHERE similarity >= 0.7::DOUBLE""")
def similar_names(t):
    """Names of parts and words of questions that are alike by edits or by trigrams (the SQL's distance counts bytes, so letters of two have one there)."""
    words = t.part.select(F.col("p_name").alias("n")).unionByName(bench_words(t).select(F.col("w").alias("n")))
    return lk.similar_names(words, "n", 0.7)

"""The gateway's rules in order, redaction facts, keyed hashes and the vault of tokens, domestic patterns."""

import hashlib
import hmac
import itertools

import pytest
from pyspark.sql import functions as F

from loomery.operators import privacy

FACTS = dict(emergency=False, hard=0, medical=False, torn=False, incomplete=False, placeholders=0, residual=0, redacted=0.0, chars=40, structured=False, plannable=True, unknown_person=False)


def told(spark, cases):
    names = list(FACTS)
    rows = [tuple([i, *[{**FACTS, **c}[n] for n in names]]) for i, c in enumerate(cases)]
    schema = "i int, emergency boolean, hard int, medical boolean, torn boolean, incomplete boolean, placeholders int, residual int, redacted double, chars int, structured boolean, plannable boolean, unknown_person boolean"
    out = spark.createDataFrame(rows, schema).select("i", privacy.gateway(*[F.col(n) for n in names]).alias("t")).orderBy("i").select("t.*")
    return [tuple(r) for r in out.collect()]


def rules(f):
    """The rules as a plain chain."""
    shown = not f["torn"] and not f["incomplete"] and f["placeholders"] <= 12 and f["residual"] <= 0 and f["redacted"] <= 0.45
    if f["emergency"]:
        return "emergency", "emergency", False
    if f["hard"] > 0:
        return "local_only", "hard_identifier", False
    if f["medical"]:
        return "local_only", "medical_text", shown
    if f["torn"]:
        return "local_only", "obfuscation", False
    if f["structured"]:
        if f["placeholders"] > 12:
            return "local_only", "token_budget", False
        if f["plannable"]:
            return "allow_external", None, shown
        return ("local_only", "unknown_person", False) if f["unknown_person"] else ("local_only", "nothing_to_plan", shown)
    for bad, reason in ((f["incomplete"], "residual_risk"), (f["placeholders"] > 12, "token_budget"), (f["residual"] > 0, "residual_risk"), (f["redacted"] > 0.45, "over_redacted"), (f["chars"] < 8, "over_redacted")):
        if bad:
            return "local_only", reason, False
    return "allow_external", None, False


def test_rules_in_order(spark):
    ways = dict(emergency=[False, True], hard=[0, 1], medical=[False, True], torn=[False, True], incomplete=[False, True], placeholders=[12, 13], residual=[0, 1], redacted=[0.45, 0.46], chars=[8, 7], structured=[False, True], plannable=[True, False])
    cases = [dict(zip(ways, x, strict=True), unknown_person=x[6] > 0) for x in itertools.product(*ways.values())]
    assert told(spark, cases) == [rules({**FACTS, **c}) for c in cases]


@pytest.mark.parametrize("fact", [n for n in FACTS if n not in ("structured", "plannable", "unknown_person")])
def test_unknown_facts_stay_here(spark, fact):
    [(decision, _, triage)] = told(spark, [{fact: None}])
    assert decision != "allow_external" and (not triage or fact == "medical")


def test_unknown_plan(spark):
    assert told(spark, [{"structured": True, "plannable": None, "unknown_person": None}]) == [("local_only", "unknown_person", False)]


def test_redaction_facts(spark):
    texts = ["write to a@b.org or c@d.org now", "plain", "", None, "[email] a@b.org"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", privacy.redaction_facts(F.col("t"), ("email", "url")).alias("r")).orderBy("i").select("r.*").collect()
    assert [tuple(r) for r in got] == [(2, len("write to  or  now")), (0, 5), (0, 0), (0, 0), (1, 1)]


@pytest.mark.parametrize("secret", ["s", "ключ", "x" * 64, "y" * 65])
def test_keyed_hash(spark, secret):
    messages = ["", "session:1", "привет 🙂", "z" * 500]
    got = spark.createDataFrame([(i, m) for i, m in enumerate(messages)], "i int, m string").select("i", privacy.keyed_hash(secret, F.col("m")).alias("h")).orderBy("i").collect()
    assert [r.h for r in got] == [hmac.new(secret.encode(), m.encode(), hashlib.sha256).hexdigest() for m in messages]


def test_tokens_of_requests_stay_apart(spark):
    uses = spark.createDataFrame([("a", "r1", "doctor", 1, 10, "Ann"), ("a", "r2", "doctor", 2, 10, "Bob"), ("b", "r1", "doctor", 3, 10, "Cy")], "session string, request string, kind string, i int, at int, value string")
    minted = privacy.mint_tokens(uses, "session", "kind", "i", "at", "secret", request="request").cache()
    one, two, other = minted.orderBy("i").collect()
    # two requests of one session: one token for two people, told apart by the request
    assert one.token == two.token and one.session_key == two.session_key and one.request_key != two.request_key and one.session_key != other.session_key
    assert one.session_key == hmac.new(b"secret", b"session:a", hashlib.sha256).hexdigest()[:32] and one.request_key == hmac.new(b"secret", b"request:r1", hashlib.sha256).hexdigest()[:16]
    asked = [(one.session_key, one.request_key, one.token, 20), (two.session_key, two.request_key, two.token, 20), (other.session_key, two.request_key, two.token, 21), (one.session_key, one.request_key, one.token, 130), (one.session_key, "-", one.token, 22)]
    got = privacy.redeem(minted, spark.createDataFrame(asked, "session_key string, request_key string, token string, at int"), "value")
    assert sorted((r.at, r.value or "") for r in got.collect()) == [(20, "Ann"), (20, "Bob"), (21, ""), (22, ""), (130, "")]


DOMESTIC = {
    "pension_number": (["112-233-445 95", "112-233-445-95"], ["112-233-4459", "1112-233-445 95"]),
    "health_policy": (["полис ОМС 1234 5678 9012 3456", "Полис: 1234567890123456"], ["1234 5678 9012 3456", "полис скоро"]),
    "passport_series": (["паспорт 45 08 123456", "Паспорт серия 4508 123456"], ["паспорт потерян", "4508 123456"]),
    "plate_cyrillic": (["А123ВС77", "К001ТТ 116"], ["Ж123ВС77", "А12ВС77"]),
    "phone_domestic": (["8 (912) 345-67-89", "89123456789"], ["8 912 345", "78912345678901"]),
    "date_cyrillic": (["3 января 1990"], ["3 января", "января 1990"]),
    "street_cyrillic": (["ул. Баумана, д. 44", "улица Мира 5", "проспект Победы"], ["ул. баумана", "улица"]),
    "flat": (["кв. 17", "квартира 8"], ["квартира большая"]),
    "profile_link": (["t.me/some_one", "https://vk.com/id12345"], ["t.me/", "at.me/abc"]),
}


@pytest.mark.parametrize("kind", DOMESTIC)
def test_domestic_patterns(spark, kind):
    yes, no = DOMESTIC[kind]
    rows = spark.createDataFrame([(t,) for t in yes + no], "t string")
    hits = {r.t: r.n for r in rows.select("t", privacy.counts(F.col("t"), (kind,))[kind].alias("n")).collect()}
    assert [hits[t] > 0 for t in yes + no] == [True] * len(yes) + [False] * len(no)

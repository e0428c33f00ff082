import hashlib
import math
import re
import time
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mileglass.llm import personal_data as P
from mileglass.llm.queries import QUERIES

SHAPES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
          "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
MIX = list("a.@-+ 0()19%é\n") + ["joe@mail.example.com", "10.0.255.1", "256.1.1.1", "4111 1111 1111 1111", "5500-0000-0000-0004", "+1 (555) 010-9999", "@b.c"]


def passes(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return True


def base(text):
    return [(k, m.start(), m.end()) for k, p in SHAPES.items() for m in re.finditer(p, text) if passes(k, m.group())]


def brute(texts, t=P.Thresholds()):
    """All spans of each text, from plain counts over all texts."""
    texts = [x or "" for x in texts]
    seen, n_term, n_entity, n_both = [], Counter(), Counter(), Counter()
    for text in texts:
        shapes = base(text)
        words = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W_]+(?:['’-][^\W_]+)*", text)]
        n_term.update({w for _, _, w in words})
        words = [w for w in words if w[1] - w[0] > 1 and all(b <= w[0] or w[1] <= a for _, a, b in shapes)]
        pairs = set()
        for kind, a, b in shapes:
            value = text[a:b].lower() if kind == "email" else text[a:b] if kind == "ip" else re.sub("[ ().-]", "", text[a:b])
            near = [w for w in words if w[0] < a][-t.reach:] + [w for w in words if w[0] >= b][:t.reach]
            pairs |= {((kind, value), w) for _, _, w in near}
        n_entity.update({e for e, _ in pairs})
        n_both.update(pairs)
        seen.append((shapes, words, pairs))
    n, out = len(texts), []
    for shapes, words, pairs in seen:
        told = {w for e, w in pairs if n_both[e, w] >= t.support and n_entity[e] < n
                and math.log(n_both[e, w] * n / (n_entity[e] * n_term[w])) / math.log(n / n_entity[e]) >= t.generalise}
        out.append(shapes + [("term", a, b) for a, b, w in words if w in told])
    return out


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(MIX), max_size=14).map("".join))
def test_shapes(text):
    assert P.fixed_shapes(text) == base(text)


def test_shapes_of_texts(texts, odd_texts):
    more = ["a@b.c@d.e", "x@a.b.c@d.e", "1.2.3.4.5.6.7.8.9", "00010.0.0.001", "4111111111111111" * 2, "+" + "1" * 15, "+12345678901234567",
            "9" * 4000 + ".1.1.1", "4111 1111 1111 1111 +49 (30) 123456"]
    for text in [t for _, t in texts] + odd_texts + more:
        assert P.fixed_shapes(text or "") == base(text or "")


def test_long_runs_take_linear_time():
    start = time.time()
    for unit in ("a", "1", "1.", "1 ", "+1", "a@", "+1 (", "a.", "-"):
        P.fixed_shapes(unit * 200_000)
    assert time.time() - start < 10


def planted():
    """Jansen stands with one address only; the words around it are common."""
    rows = [f"please write to Dr Jansen at p.jansen{'@'}mail.example.org today, number {i}" for i in range(5)]
    rows += ["please write to the office at desk@mail.example.org today"] * 4
    rows += ["please write to everyone at once today, number 7, the doctor is in", "the office is at sea; Dr No is out"] * 20
    rows += ["Call JANSEN: +1 (555) 010-9999 or p.jansen@mail.example.org. jansen knows", None, "", "10.0.0.1", "jansen alone is not near any value"]
    return rows


def test_terms(spark):
    rows = planted()
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.personal] for r in P.find_personal(df).collect()}
    assert got == dict(enumerate(brute(rows)))
    assert [rows[0][a:b] for k, a, b in got[0] if k == "term"] == ["Jansen"]
    # Every place in a document whose entity the term gives away; none where the entity is not.
    assert [rows[49][a:b] for k, a, b in got[49] if k == "term"] == ["JANSEN", "jansen"] and got[53] == []
    weak = P.Thresholds(reach=3, support=1, generalise=0.3)
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.personal] for r in P.find_personal(df, thresholds=weak).collect()}
    assert got == dict(enumerate(brute(rows, weak)))


def test_a_filter_that_lets_all_through_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(P, "FILTER_BITS", 0)
    monkeypatch.setattr(P, "BLOCK_CHARS", 50)
    df = spark.createDataFrame(list(enumerate(planted())), "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.personal] for r in P.find_personal(df).collect()}
    assert got == dict(enumerate(brute(planted())))


def test_sanitise(spark):
    rows = [(i, t, "s", i, i) for i, t in enumerate(planted())]
    df = spark.createDataFrame(rows, "doc_id long, text string, told string, row int, seen int")
    out = P.sanitise(df)
    assert out.columns == df.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[0] == "please write to Dr [NAME] at [EMAIL] today, number 0" and got[50] is None and got[52] == "[IP]"
    assert got[9] == rows[9][1] and got[53] == rows[53][1]
    assert got[49] == "Call [NAME]: [PHONE] or [EMAIL]. [WORD] knows"
    strict = {r.doc_id: r.text for r in P.sanitise(df, thresholds=P.Thresholds(remove=0.9)).collect()}
    assert strict[0] == "please write to Dr  at [EMAIL] today, number 0"
    # With a card and a phone on the same digits one of them names the stretch.
    assert P._cleaned("a +4111111111111111 b", [("card", 3, 19, 0.0), ("phone", 2, 12, 0.0)], 1.0) == "a [PHONE] b"


def test_nothing_and_odd(spark, odd_texts):
    df = spark.createDataFrame([(None, t) for t in odd_texts] * 2, "doc_id long, text string")
    assert P.find_personal(df.limit(0)).count() == 0 and P.sanitise(df.limit(0)).count() == 0
    assert sorted(len(r.personal) for r in P.find_personal(df).collect()) == sorted(len(s) for s in brute(odd_texts) * 2)
    assert sorted(map(str, (r.text for r in P.sanitise(df).collect()))) == sorted(map(str, odd_texts * 2))


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = dict(zip(docs, brute(docs.values())))
    rows = QUERIES["op11_personal_data"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        spans = want[r.doc_id]
        assert r.spans == joined(spans)
        assert r.base_sha256 == hashlib.sha256(joined([s for s in spans if s[0] != "term"]).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in spans) for k in SHAPES)

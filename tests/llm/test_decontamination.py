import re

from mileglass.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    out = {}
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, item_text in items:
            iw = words(item_text)
            n = min(13, len(iw))
            grams = {tuple(iw[i:i + n]) for i in range(len(iw) - n + 1)} if n else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i:i + n]) in grams:
                    hit |= set(range(i, i + n))
                    if item is not None:
                        found.add(str(item))
        out[doc_id] = (len(w), len(hit), sorted(found))
    return out


def scan(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    rows = D.scan_contamination(d, i, **options).select("doc_id", "text", "contamination").collect()
    return {r.doc_id: r for r in rows}


def fixture(texts, odd_texts):
    lines = [t for _, t in texts]
    items = [(i, " ".join(lines[i].split()[3:40])) for i in range(0, 30)]
    items += [(100, "one two"), (101, "ONE-TWO three"), (102, None), (103, "..."), (None, " ".join(lines[40].split()[:20])),
              (7, " ".join(lines[7].split()[3:40])), (104, "Ünï wörds and 13")]
    docs = [(i, t) for i, t in texts] + [(1000 + i, t) for i, t in enumerate(odd_texts)]
    docs += [(2000, "Zero one, TWO! one two three four"), (2001, "x ünï wörds AND 13 one"), (2002, "one"),
             (2003, " ".join(["one two"] * 3000))]
    return docs, items


def test_brute_force(spark, texts, odd_texts):
    docs, items = fixture(texts, odd_texts)
    got, want = scan(spark, docs, items), brute(docs, items)
    assert {k: (r.contamination.n_words, r.contamination.n_hit, r.contamination.items) for k, r in got.items()} == want
    assert any(n for _, n, _ in want.values())


def test_blocks_agree(spark, texts, odd_texts):
    docs, items = fixture(texts[:60], odd_texts)
    assert scan(spark, docs, items) == scan(spark, docs, items, block_bytes=15000)


def test_spans_cover_the_hit_words(spark, texts, odd_texts):
    docs, items = fixture(texts[:60], odd_texts)
    for r in scan(spark, docs, items).values():
        inside = sum(len(words(r.text[s.start:s.end])) for s in r.contamination.spans)
        assert inside == r.contamination.n_hit


def test_remove(spark):
    docs = spark.createDataFrame([(1, "keep one two keep", "x"), (2, "clean", "y"), (3, None, None)],
                                 "doc_id long, text string, contamination string")
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert [r.doc_id for r in D.decontaminate(docs, items).orderBy("doc_id").collect()] == [2, 3]
    cut = D.decontaminate(docs, items, remove="spans")
    assert [r.text for r in cut.orderBy("doc_id").collect()] == ["keep  keep", "clean", None]
    assert cut.columns == docs.columns


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert D.scan_contamination(docs, items).first().contamination.n_hit == 0
    assert D.scan_contamination(docs.limit(0), items).count() == 0

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mileglass.llm import token_counts as T
from mileglass.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
COUNTER = T.PrefixCounter(T.read_piece_model(PATH))
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
MIX = list("aehinorst.,!?=-/ \n\t019ÉßΣé—▁日本語😀\x00") + ["ing", "  ", "<s>", "<0x0A>", "http://", "    ", ".,."]


def plain(text):
    return [len(LIBRARY.encode(text[:i])) for i in range(len(text) + 1)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(MIX), max_size=30).map("".join), st.integers(0, 20))
def test_every_prefix(text, budget):
    counts = plain(text)
    assert COUNTER.prefixes(text).tolist() == counts
    longest = max(i for i, n in enumerate(counts) if n <= budget)
    assert COUNTER.summaries([text], budget) == [(counts[-1], longest)]


def test_long_runs():
    for text in ("§" * 3000, "a" + "§" * 3000, " " * 500 + "x", "!" * 2000, "日" * 1500, "ab" * 900):
        assert COUNTER.summaries([text], 10)[0][0] == len(LIBRARY.encode(text))


def test_a_small_cache_changes_nothing(texts, monkeypatch):
    monkeypatch.setattr(T, "CACHE_CHUNKS", 50)
    monkeypatch.setattr(T, "CACHE_PAIRS", 50)
    monkeypatch.setattr(T, "CACHE_STEPS", 50)
    monkeypatch.setattr(T, "GROUP_TEXTS", 3)
    fresh = T.PrefixCounter(T.read_piece_model(PATH))
    for _, text in texts[:10]:
        assert fresh.summaries([text], 9)[0][0] == len(LIBRARY.encode(text))


def test_columns(spark, odd_texts):
    short = [(i, t) for i, t in enumerate(odd_texts) if len(t or "") < 300]
    docs = spark.createDataFrame(short, "doc_id long, text string")
    out = (docs.withColumn("counts", T.prefix_counts(spark, F.col("text"), PATH))
           .withColumn("at", T.count_at(F.col("counts"), 3)).withColumn("within", T.longest_within(F.col("counts"), 2))
           .withColumn("c", T.count_tokens(spark, F.col("text"), PATH, 2)))
    for r in out.collect():
        want = plain(r.text or "")
        assert r.counts == want and r.at == want[min(3, len(want) - 1)]
        assert r.within == r.c.budget_chars == max(i for i, n in enumerate(want) if n <= 2)
        assert r.c.n_tokens == want[-1]


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = QUERIES["op5_token_counts"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = len(LIBRARY.encode(docs[r.doc_id]))
        assert (r.n_tokens, r.over_limit, r.n_bytes) == (n, n > 4096, len(docs[r.doc_id].encode()))

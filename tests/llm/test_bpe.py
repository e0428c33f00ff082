import hashlib
import json

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mileglass.llm import bpe as B
from mileglass.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
ENCODER = B.Encoder(B.read_vocabulary(PATH))
LIBRARY = Tokenizer.from_file(PATH)


def library(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def test_same_as_the_library(texts, odd_texts):
    for text in [t for _, t in texts] + odd_texts:
        ids, decoded = library(text)
        assert ENCODER.encode(text or "") == ids
        assert ENCODER.decode(ids) == decoded


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("aehinorst'.,!? \n\t019ÉßΣé—“日本語的😀") + ["ing", "<|endoftext|>", "'ll"]), max_size=40).map("".join))
def test_mixed_texts(text):
    assert ENCODER.encode(text) == library(text)[0]


def test_a_small_memory_changes_nothing(texts, monkeypatch):
    monkeypatch.setattr(B, "CACHE_WORDS", 5)
    monkeypatch.setattr(B, "CACHE_CHARS", 6)
    fresh = B.Encoder(B.read_vocabulary(PATH))
    for _, text in texts[:30]:
        assert fresh.encode(text) == library(text)[0]


def test_plain_merging_agrees():
    ranks = {tuple(m): i for i, m in enumerate(json.load(open(PATH))["model"]["merges"][:3000])}
    for word in ("thethethe", "banana", "aaaaaaa", "intothethin", "x", ""):
        parts = list(word)
        while True:  # the lowest rank, then the leftmost, one merge at a time
            best = min(((ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks), default=None)
            if best is None:
                break
            i = best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        assert B.merge_word(list(word), ranks) == parts


def test_columns(spark, odd_texts):
    docs = spark.createDataFrame(list(enumerate(odd_texts)), "doc_id long, text string")
    out = docs.withColumn("ids", B.encode(spark, F.col("text"), PATH))
    out = out.withColumn("list", B.unpacked(F.col("ids"))).withColumn("back", B.decode(spark, F.col("ids"), PATH))
    out = out.withColumn("both", B.encode_and_decode(spark, F.col("text"), PATH))
    for r in out.collect():
        assert (r.list, r.back) == library(r.text)
        assert (r.both.ids, r.both.decoded) == (r.ids, r.back)
    assert out.filter("false").count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    rows = QUERIES["op10_bpe"](spark, f"/root/testdata/{sf}").collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids, decoded = library(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()

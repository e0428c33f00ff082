import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mileglass.llm import alignment as A
from mileglass.llm.queries import QUERIES

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FIRST = Tokenizer.from_file(FILES[0])
FIRST.encode_special_tokens = True
SECOND = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
LETTERS = dict(zip([chr(c) for c in (*range(33, 127), *range(161, 173), *range(174, 256))],
                   (*range(33, 127), *range(161, 173), *range(174, 256))))
LETTERS |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in LETTERS.values())}
ALIGNER = A.Aligner(A.read_tokenizers(*FILES))
MIX = list("aehinorst'.,!? \n\t019ÉßΣé—“日本語的😀\x00 　\x1c") + ["ing", "  ", " the", "<|endoftext|>", "<0x0A>", "<s>", "'ll", "👩‍👩", " 😀"]


def plain(text):
    """The groups of a whole text from whole-text encodings and decoded bytes alone."""
    a = FIRST.encode(" " + text, add_special_tokens=False)
    b = SECOND.encode(text)
    own = [[bytes(LETTERS[c] for c in FIRST.id_to_token(i)) for i in a.ids],
           [bytes([int(SECOND.id_to_piece(i)[3:-1], 16)]) if SECOND.is_byte(i) else SECOND.id_to_piece(i).replace("▁", " ").encode() for i in b]]
    if not text or any(b"".join(x) != (" " + text).encode() for x in own):
        return []
    ends = [[sum(map(len, x[:i + 1])) for i in range(len(x))] for x in own] if len(text) < 400 else [_ends(x) for x in own]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    out, last = [], 0
    where = [dict(zip(e, range(1, len(e) + 1))) for e in ends]
    i = j = 0
    for c in cuts:
        out.append((a.ids[i:where[0][c]], b[j:where[1][c]]))
        i, j = where[0][c], where[1][c]
    return out


def _ends(pieces):
    out, at = [], 0
    for p in pieces:
        at += len(p)
        out.append(at)
    return out


def brute(texts):
    groups = [plain(t or "") for t in texts]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    count = Counter(p for c in links for p in c)
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    return [(sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()),
             sum(n for p, n in c.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in c.items()),
             hashlib.sha256(";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g).encode()).hexdigest() if g else "")
            for g, c in zip(groups, links)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(MIX), max_size=30).map("".join))
def test_groups(text):
    assert ALIGNER.groups(text) == plain(text)


def test_odd_and_given_texts(texts, odd_texts):
    more = ["under ▁ score", " ", "  ", " a", "a ", "x" * 3000, "日本" * 800, "😀" * 300, "a\u0085 b", "a  b c", "é" * 500 + " é"]
    for text in [t for _, t in texts[:60]] + odd_texts + more:
        assert ALIGNER.groups(text or "") == plain(text or "")


def rows(df):
    return sorted(tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect())


@pytest.mark.parametrize("block_bytes, most", [(A.BLOCK_BYTES, A.BROADCAST_PAIRS), (500, 20), (1, 0)])
def test_counts(spark, odd_texts, block_bytes, most, monkeypatch):
    monkeypatch.setattr(A, "BATCH_CHARS", 40)
    monkeypatch.setattr(A, "ENCODE_CHARS", 15)
    monkeypatch.setattr(A, "LARGE_GROUP", 3)
    many = [t for t in odd_texts if len(t or "") < 6000] + ["the cat and the dog"] * 40 + ["the dog 😀 saw a cat", "naïve cafés"] * 3
    df = spark.createDataFrame([(None if i % 9 == 0 else i // 2, t, i) for i, t in enumerate(many)], "doc_id long, text string, pair int").repartition(3)
    out = A.link_tokens(df, *FILES, block_bytes=block_bytes, most=most)
    assert rows(out) == sorted(brute(many))
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r.doc_id) for r in df.collect())


def test_column_and_nothing(spark):
    df = spark.createDataFrame([("a", "été 😀"), ("b", None)], "id string, text string")
    got = {r.id: [(list(g.a), list(g.b)) for g in r.g] for r in df.select("id", A.token_groups(spark, F.col("text"), *FILES).alias("g")).collect()}
    assert got == {"a": plain("été 😀"), "b": []}
    out = A.link_tokens(df.limit(0), *FILES, id="id")
    assert out.columns[0] == "id" and out.count() == 0


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_token_alignment"](spark, sf_dir).collect()}
    assert got == dict(zip(docs, brute(docs.values())))

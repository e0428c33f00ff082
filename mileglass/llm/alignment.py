"""Which tokens of two tokenizers lie on the same bytes, and in how many documents each pair of ids is linked.

The offsets that both libraries report are coarse cuts; tokens that share a character are told apart by their decoded
bytes.  Texts are cut into words first, at places that no token of either tokenizer crosses, so that each distinct
word of a block of texts is encoded and aligned once.

Counts over the corpus never leave the blocks one document at a time: a block sends each of its distinct pairs once,
and gets the counts of its pairs back once.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mileglass.llm.bpe import byte_letters
from mileglass.llm.text import stored

#: A single blank between two characters that are not blank: neither tokenizer has a token across its left side.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Bytes of text that are counted together.
BLOCK_BYTES = 8 << 20
#: Characters of words that are encoded in one text, and that are aligned together.
ENCODE_CHARS, BATCH_CHARS = 1 << 10, 1 << 18
#: Links of a group from which its equal ids are counted instead of listed.
LARGE_GROUP = 10_000
#: Pairs whose counts are broadcast, the most frequent ones; the others are joined.
BROADCAST_PAIRS = 150_000


@dataclass(frozen=True)
class Tokenizers:
    """The two tokenizer files' contents; their size is that of the files (some MB)."""

    byte_level: str
    pieces: bytes


def read_tokenizers(byte_level: str, pieces: str) -> Tokenizers:
    """Read a byte-level file of the tokenizers library and a sentencepiece model file on the driver."""
    with open(byte_level, encoding="utf-8") as f:
        text = f.read()
    spec = json.loads(text)
    if spec["normalizer"] is not None or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError("the first tokenizer must be byte-level and leave texts as they are")
    with open(pieces, "rb") as f:
        return Tokenizers(text, f.read())


@dataclass
class Words:
    """The alignment of some words: totals, groups as text, and the id pairs linked in each with their links.

    The pairs of word i are those from ``starts[i]`` to ``starts[i + 1]``; a pair may come more than once.
    """

    sound: np.ndarray  # whether both tokenizers give the word back byte for byte; else it has no tokens
    totals: dict[str, np.ndarray]
    texts: list[str]
    starts: np.ndarray
    pairs: np.ndarray
    links: np.ndarray


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _joined(parts: list[Words]) -> Words:
    lengths = np.concatenate([np.diff(p.starts) for p in parts])
    return Words(np.concatenate([p.sound for p in parts]), {c: np.concatenate([p.totals[c] for p in parts]) for c in _COUNTS},
                 [t for p in parts for t in p.texts], np.append(0, np.cumsum(lengths)),
                 np.concatenate([p.pairs for p in parts]), np.concatenate([p.links for p in parts]))


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (lengths[0] numbers), then the same for the others."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


class Aligner:
    """Aligns words with both libraries; one per Python worker."""

    def __init__(self, files: Tokenizers):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(files.byte_level)
        self.a.encode_special_tokens = True  # special strings inside texts are plain text
        self.a.no_padding()
        self.a.no_truncation()
        letters = {c: b for b, c in enumerate(byte_letters())}
        names_a = {i: p for p, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.bytes_a = [bytes(map(letters.get, p)) if all(c in letters for c in p) else p.encode()
                        for p in (names_a.get(i, "") for i in range(max(names_a) + 1))]
        self.b = sentencepiece.SentencePieceProcessor(model_proto=files.pieces)
        # Cutting before a blank is safe for pieces if none holds a blank after another character.
        names_b = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for i, p in enumerate(names_b) if not self.b.is_control(i)):
            raise ValueError("pieces must not hold a blank after another character")
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names_b)]
        self.sizes = [np.array([len(x) for x in names]) for names in (self.bytes_a, self.bytes_b)]
        most = max(len(self.bytes_a), len(self.bytes_b))
        self.names = np.array([str(i) for i in range(most)], dtype=object)
        self.digits = np.array([len(x) for x in self.names])

    def words(self, words: list[str]) -> Words:
        """Align each word by itself, encoding many side by side: no token reaches over a cut."""
        parts, lengths = [], np.cumsum([len(w) + 1 for w in words] or [0])
        at = 0
        while at < len(words):
            end = max(int(np.searchsorted(lengths, (lengths[at - 1] if at else 0) + BATCH_CHARS)), at + 1)
            parts.append(self._batch(words[at:end]))
            at = end
        return _joined(parts or [_no_tokens(0)])

    def _encoded(self, words: list[str]) -> tuple[str, list[int], list[int], list[int], list[int]]:
        """The words with a blank before each, and ids and coarse ends of both sides, the first's in characters.

        Both libraries are quickest on texts of about a thousand characters.  Words with a blank at either end, as a
        text may begin or end, are encoded alone.
        """
        alone = [w[:1].isspace() or w[-1:].isspace() for w in words] + [True]
        texts, ids_a, ends_a, ids_b, ends_b = [], [], [], [], []
        at = chars = size = 0
        for i, w in enumerate(words, 1):
            size += len(w) + 1
            if size < ENCODE_CHARS and not alone[i - 1] and not alone[i]:
                continue
            text = " " + " ".join(words[at:i])
            first = self.a.encode(text, add_special_tokens=False)
            ids_a += first.ids
            ends_a += [chars + end for _, end in first.offsets]
            done = ends_b[-1] if ends_b else 0  # the last end in bytes
            for p in self.b.encode(text[1:], return_type="proto", num_threads=1).pieces:
                ids_b.append(p.id)
                ends_b.append(done + 1 + p.end)
            texts.append(text)
            at, size, chars = i, 0, chars + len(text)
        return "".join(texts), ids_a, ends_a, ids_b, ends_b

    def _batch(self, words: list[str]) -> Words:
        text, ids_a, ends_a, ids_b, ends_b = self._encoded(words)
        raw = text.encode()
        if any(b"".join([names[i] for i in x]) != raw for names, x in ((self.bytes_a, ids_a), (self.bytes_b, ids_b))):
            if len(words) == 1:
                return _no_tokens(1)
            half = len(words) // 2
            return _joined([self._batch(words[:half]), self._batch(words[half:])])
        # Coarse ends in bytes: the first library gives characters, the second bytes without the blank put in front.
        ids = np.array(ids_a, dtype=np.int64), np.array(ids_b, dtype=np.int64)
        ends = [np.array(ends_a, dtype=np.int64), np.array(ends_b, dtype=np.int64)]
        lengths = np.array([len(w) + 1 for w in words])
        if len(raw) != len(text):
            place = np.append(0, np.cumsum(_byte_lengths(text)))
            ends[0], lengths = place[ends[0]], np.diff(place[np.append(0, np.cumsum(lengths))])
        return self._linked(ids, [refined(e, size[x]) for e, size, x in zip(ends, self.sizes, ids)], np.cumsum(lengths))

    def _linked(self, ids: tuple[np.ndarray, np.ndarray], ends: list[np.ndarray], word_ends: np.ndarray) -> Words:
        """Cut both sides where both have a token end."""
        cuts = np.intersect1d(*ends, assume_unique=True)
        group = [np.searchsorted(cuts, e) for e in ends]
        n_a, n_b = (np.bincount(g, minlength=len(cuts)) for g in group)
        word = np.searchsorted(word_ends, cuts)  # of a group
        per_word = {"n_a": np.bincount(word, n_a, len(word_ends)), "n_b": np.bincount(word, n_b, len(word_ends)),
                    "n_groups": np.bincount(word, minlength=len(word_ends)), "n_links": np.bincount(word, n_a * n_b, len(word_ends))}
        # Each token of the first side with all of the second side in its group; large groups by distinct ids.
        large = np.flatnonzero(n_a * n_b > LARGE_GROUP)
        pick = ~np.isin(group[0], large)
        of, own = group[0][pick], ids[0][pick]
        start_b = np.cumsum(n_b) - n_b
        at = _ranges(start_b[of], n_b[of])
        pairs, links, in_word = np.repeat(own, n_b[of]) << 32 | ids[1][at], np.ones(len(at), dtype=np.int64), np.repeat(word[of], n_b[of])
        for g in large:
            (x, nx), (y, ny) = (np.unique(i[k == g], return_counts=True) for i, k in zip(ids, group))
            pairs = np.append(pairs, (x[:, None] << 32 | y).ravel())
            links = np.append(links, np.outer(nx, ny).ravel())
            in_word = np.append(in_word, np.full(len(x) * len(y), word[g]))
        if len(large):
            order = np.argsort(in_word, kind="stable")
            pairs, links, in_word = pairs[order], links[order], in_word[order]
        return Words(np.ones(len(word_ends), dtype=bool), {c: n.astype(np.int64) for c, n in per_word.items()},
                     self._texts(ids, group, word, len(word_ends)), np.searchsorted(in_word, np.arange(len(word_ends) + 1)), pairs, links)

    def _texts(self, ids, group, word, n: int) -> list[str]:
        """The groups of each word as text."""
        all_ids, all_groups = np.concatenate(ids), np.concatenate(group)
        side = np.repeat([0, 1], [len(x) for x in ids])
        order = np.lexsort((side, all_groups))  # stable: tokens keep their order
        all_ids, all_groups, side = all_ids[order], all_groups[order], side[order]
        token_word = word[all_groups]
        mark = np.full(len(all_ids), ",", dtype=object)
        mark[:-1][side[:-1] != side[1:]] = "|"
        mark[:-1][all_groups[:-1] != all_groups[1:]] = ";"
        parts = np.empty(2 * len(all_ids), dtype=object)
        parts[0::2], parts[1::2] = self.names[all_ids], mark
        text, sizes = "".join(parts.tolist()), self.digits[all_ids] + 1
        stops = np.cumsum(np.bincount(token_word, sizes, n).astype(np.int64))
        return [text[a:b - 1] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist())]

    def groups(self, text: str) -> list[tuple[list[int], list[int]]]:
        """The groups of a whole text; none if a tokenizer does not give the text back."""
        found = self.words(_CUT.split(text) if text else [])
        if not found.sound.all():
            return []
        sides = [g.split("|") for t in found.texts for g in t.split(";")]
        return [(list(map(int, a.split(","))), list(map(int, b.split(",")))) for a, b in sides]


def _no_tokens(n: int) -> Words:
    none = np.zeros(0, dtype=np.int64)
    return Words(np.zeros(n, dtype=bool), {c: np.zeros(n, dtype=np.int64) for c in _COUNTS}, [""] * n,
                 np.zeros(n + 1, dtype=np.int64), none, none)


def _byte_lengths(text: str) -> np.ndarray:
    """Bytes of each character in UTF-8."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    return 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)


def refined(ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Exact byte ends of tokens from coarse ends and the sizes of the decoded tokens.

    A token alone at its coarse end ends there.  Tokens that share an end hold parts of one character (or bytes for
    it, reported without a span): theirs are measured in decoded bytes, from the last token that is alone.
    """
    alone = (ends > np.append(0, ends[:-1])) & (np.append(ends[1:], np.iinfo(np.int64).max) > ends)
    if alone.all():
        return ends
    last = np.maximum.accumulate(np.where(alone, np.arange(len(ends)), -1))
    measured = np.cumsum(sizes)
    before = last >= 0
    return np.where(before, ends[last], 0) + measured - np.where(before, measured[last], 0)


_WORKERS: dict[bytes, Aligner] = {}


def _aligner(files: Tokenizers) -> Aligner:
    """The aligner of this Python worker, kept between tasks."""
    key = hashlib.sha256(files.byte_level.encode() + files.pieces).digest()
    if key not in _WORKERS:
        _WORKERS.clear()
        _WORKERS[key] = Aligner(files)
    return _WORKERS[key]


def token_groups(spark: SparkSession, text: Column, byte_level: str, pieces: str) -> Column:
    """array<struct<a: array<int>, b: array<int>>> of each whole text: ids of both tokenizers on the same bytes.

    The groups are the shortest stretches of bytes at whose ends both tokenizers have a token end.  NULL and empty
    texts, and texts that a tokenizer does not give back byte for byte, have none.
    """
    shared = spark.sparkContext.broadcast(read_tokenizers(byte_level, pieces))
    kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    @F.arrow_udf("array<struct<a:array<int>,b:array<int>>>")
    def groups(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = _aligner(shared.value)
        for texts in batches:
            yield pa.array([[{"a": a, "b": b} for a, b in of.groups(t.as_py() or "")] for t in texts], type=kind)

    return groups(text)


# ------------------------------------------------------------------ corpus
class _Block:
    """Texts that are counted together."""

    def __init__(self):
        self.ids, self.texts, self.size = [], [], 0

    def add(self, id, text) -> None:
        self.ids.append(id)
        self.texts.append(text or "")
        self.size += len(self.texts[-1])

    def row(self, number: int, aligner: Aligner) -> dict:
        place: defaultdict[str, int] = defaultdict()
        place.default_factory = place.__len__
        split = [np.array([place[p] for p in _CUT.split(t)] if t else [], dtype=np.int64) for t in self.texts]
        words = aligner.words(list(place))
        sound = np.array([bool(len(seq)) and bool(words.sound[seq].all()) for seq in split])
        split = [seq if ok else seq[:0] for seq, ok in zip(split, sound)]
        digests = [hashlib.sha256(";".join([words.texts[i] for i in seq.tolist()]).encode()).hexdigest() if len(seq) else "" for seq in split]
        doc_of, seqs = np.repeat(np.arange(len(split)), [len(seq) for seq in split]), np.concatenate(split)
        totals = {c: np.zeros(len(split), dtype=np.int64) for c in _COUNTS}
        for c in _COUNTS:
            np.add.at(totals[c], doc_of, words.totals[c][seqs])
        held, times = np.unique(doc_of * max(len(place), 1) + seqs, return_counts=True)
        docs, used = held // max(len(place), 1), held % max(len(place), 1)
        # From words to their id pairs; equal pairs of a document become one.
        keys, local = np.unique(words.pairs, return_inverse=True)
        lengths = np.diff(words.starts)[used]
        at = _ranges(words.starts[used], lengths)
        cell, into = np.unique(np.repeat(docs, lengths) * max(len(keys), 1) + local[at], return_inverse=True)
        # Whole numbers: exact as doubles only below 2**53, so they are summed as integers.
        links = np.zeros(len(cell), dtype=np.int64)
        np.add.at(links, into, words.links[at] * np.repeat(times, lengths))
        doc, pair = cell // max(len(keys), 1), cell % max(len(keys), 1)
        held = np.bincount(pair, minlength=len(keys))
        return {"block": number, "ids": self.ids, **{c: totals[c].tolist() for c in _COUNTS}, "groups_sha256": digests,
                "pairs": keys[held > 0], "n_docs": held[held > 0],
                "cells": _packed(doc, (np.cumsum(held > 0) - 1)[pair], links)}


def _packed(*columns: np.ndarray) -> bytes:
    """Whole numbers, as differences to their predecessors, compressed."""
    return zlib.compress(np.stack([np.diff(c, prepend=0) for c in columns]).astype("<i8").tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), dtype="<i8").reshape(3, -1), axis=1)


def _blocks(docs: DataFrame, id: str, text: str, byte_level: str, pieces: str, block_bytes: int) -> DataFrame:
    """One row for each block of texts: what is known of its documents, its pairs, and who holds them how often."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_tokenizers(byte_level, pieces))
    docs = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    schema = (f"block bigint, ids array<{kind}>, " + "".join(f"{c} array<bigint>, " for c in _COUNTS)
              + "groups_sha256 array<string>, pairs array<bigint>, n_docs array<bigint>, cells binary")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, block, number = _aligner(shared.value), _Block(), TaskContext.get().partitionId() << 32

        def out(arrow_id):
            ints = pa.list_(pa.int64())
            fields = pa.schema([("block", pa.int64()), ("ids", pa.list_(arrow_id)), *((c, ints) for c in _COUNTS),
                                ("groups_sha256", pa.list_(pa.string())), ("pairs", ints), ("n_docs", ints), ("cells", pa.binary())])
            return pa.RecordBatch.from_pylist([block.row(number, of)], schema=fields)

        for batch in batches:
            arrow_id = batch.column(0).type
            for i in range(batch.num_rows):
                block.add(batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                if block.size >= block_bytes:
                    yield out(arrow_id)
                    block, number = _Block(), number + 1
        if block.ids:
            yield out(arrow_id)

    return docs.mapInArrow(count, schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold each pair linked, and whether no pair of its first id is held by more."""
    counts = (blocks.select(F.explode(F.arrays_zip("pairs", "n_docs")).alias("p"))
              .groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.n_docs").alias("n")))
    counts = stored(counts, "pair-counts")
    first = F.shiftright("pair", 32)
    most = counts.groupBy(first.alias("a")).agg(F.max("n").alias("most"))
    # As many rows as the first vocabulary has ids.
    return counts.join(F.broadcast(most), first == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _frequent_from(counts: DataFrame, most: int) -> int:
    """The smallest power of two such that at most ``most`` pairs have a count that large."""
    sizes = {r.power: r.k for r in counts.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count("*").alias("k")).collect()}
    power = 0
    while sum(k for p, k in sizes.items() if p >= power) > most:
        power += 1
    return 1 << power


def link_tokens(docs: DataFrame, byte_level: str, pieces: str, id: str = "doc_id", text: str = "text",
                block_bytes: int = BLOCK_BYTES, most: int = BROADCAST_PAIRS) -> DataFrame:
    """Per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    The first tokenizer reads a blank and the text, the second the text (it puts the blank itself).  A link is a pair
    of token occurrences in one group of ``token_groups``.  The count of an id pair is the number of documents that
    hold it linked.  ``n_best`` are the links whose count is the highest of their first id, ``count_sum`` sums the
    counts over the links.  ``groups_sha256`` is the digest of the groups (``a1,a2|b1;a3|b2``), empty without tokens.

    NULL and empty texts, and texts that a tokenizer does not give back, have zeros.  Ids may be NULL or repeated:
    every row counts as a document.  Other columns are not read.  Counts of frequent pairs are broadcast, at most
    ``most`` of them; the others go through a join in which a pair comes at most once a block, and a block gets its
    own pairs back, so neither a frequent pair nor a frequent text makes a large group.
    """
    spark = docs.sparkSession
    blocks = stored(_blocks(docs, id, text, byte_level, pieces, block_bytes), "token-blocks")
    counts = stored(pair_counts(blocks), "pair-best")
    least = _frequent_from(counts, most)
    table = counts.filter(F.col("n") >= least).orderBy("pair").toArrow()
    shared = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value[0]
        for batch in batches:
            for block, pairs in zip(batch.column(0), batch.column(1)):
                pairs = pairs.values.to_numpy()
                at = np.flatnonzero(~np.isin(pairs, frequent))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block.as_py())), pa.array(at), pa.array(pairs[at])],
                                                 ["block", "at", "pair"])

    # The pairs of one block come together again: their number is bounded by the block's bytes.
    joined = (blocks.select("block", "pairs").mapInArrow(others, "block bigint, at bigint, pair bigint")
              .join(counts.filter(F.col("n") < least), "pair")
              .groupBy("block").agg(F.collect_list(F.struct("at", "n", "best")).alias("found")))
    joined = joined.select("block", *[F.col(f"found.{c}").alias(f"f_{c}") for c in ("at", "n", "best")])
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    names = ["ids", *_COUNTS, "n_best", "count_sum", "groups_sha256"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n_of, best_of = shared.value
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in batch.schema.names}
                pairs = row["pairs"].values.to_numpy()
                n, best = np.zeros(len(pairs), dtype=np.int64), np.zeros(len(pairs), dtype=bool)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
                    hit = keys[at] == pairs
                    n[hit], best[hit] = n_of[at[hit]], best_of[at[hit]]
                if row["f_at"].is_valid:
                    at = row["f_at"].values.to_numpy()
                    n[at] = row["f_n"].values.to_numpy()
                    best[at] = row["f_best"].values.to_numpy(zero_copy_only=False)
                doc, pair, links = _unpacked(row["cells"].as_py())
                sums = [np.zeros(len(row["ids"]), dtype=np.int64) for _ in range(2)]
                np.add.at(sums[0], doc, links * best[pair])
                np.add.at(sums[1], doc, links * n[pair])
                yield pa.RecordBatch.from_arrays(
                    [row["ids"].values, *[row[c].values for c in _COUNTS], *map(pa.array, sums), row["groups_sha256"].values], names)

    out = (blocks.drop("n_docs").join(joined, "block", "left")
           .mapInArrow(score, f"ids {kind}, " + ", ".join(f"{c} bigint" for c in names[1:-1]) + ", groups_sha256 string"))
    return out.withColumnRenamed("ids", id)

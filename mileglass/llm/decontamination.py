"""Benchmark decontamination: broadcast sets of test n-grams, a scan over token windows, verified hits."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mileglass.llm.text import free_name, lower_ascii, replace_spans, stored

WINDOW = 13
#: Words are runs of digits, letters a-z and everything beyond ASCII; the same on UTF-8 bytes and on characters.
WORD_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(WORD_CLASS.encode())
BLOCK_BYTES = 32 << 20

HITS = ("struct<n_words:bigint,n_hit:bigint,items:array<string>,"
        "spans:array<struct<start:bigint,end:bigint>>,words:array<struct<start:bigint,end:bigint>>>")


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", length: int = WINDOW) -> DataFrame:
    """Distinct (gram, item) of all items: each run of ``length`` words, or all words of a shorter item.

    ``gram`` holds the words joined by single blanks.  Items without words have no window.  A NULL id stays NULL.
    """
    words = F.regexp_extract_all(lower_ascii(F.col(text)), F.lit(f"({WORD_CLASS})"), F.lit(1))
    n = F.size("w")
    starts = F.sequence(F.lit(1), F.greatest(n - length + 1, F.lit(1)))
    return (items.select(F.col(item_id).cast("string").alias("item"), words.alias("w"))
            .filter(n > 0)
            .select("item", "w", F.explode(starts).alias("at"))
            .select(F.array_join(F.slice("w", F.col("at"), length), " ").alias("gram"), "item").distinct())


class GramSet:
    """A block of windows ready for scanning: word numbers, hashes by window length, exact windows with their items."""

    def __init__(self, rows: list[tuple[str, str | None]]):
        self.numbers: dict[bytes, int] = {}
        self.exact: dict[bytes, set[str]] = {}
        hashes: dict[int, set[int]] = {}
        for gram, item in rows:
            ids = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in gram.encode().split(b" ")],
                           dtype=np.int64)
            hashes.setdefault(len(ids), set()).add(int(self.hash(ids[None, :])[0]))
            found = self.exact.setdefault(ids.tobytes(), set())
            if item is not None:
                found.add(item)
        self.hashes = {n: np.array(sorted(v), dtype=np.uint64) for n, v in sorted(hashes.items())}

    @staticmethod
    def hash(ids: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each row of word numbers."""
        out = np.zeros(len(ids), dtype=np.uint64)
        for column in ids.T.astype(np.uint64):
            out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie in an occurrence of a window, and the items those windows come from."""
        number = self.numbers.get
        ids = np.fromiter((number(w, 0) for w in words), dtype=np.int64, count=len(words))
        hit = np.zeros(len(ids), dtype=bool)
        items: set[str] = set()
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        for n, known in self.hashes.items():
            if len(ids) < n:
                continue
            starts = np.flatnonzero(unknown[n:] == unknown[:-n])  # windows of known words only
            if not len(starts):
                continue
            for part in np.array_split(starts, len(starts) // 65536 + 1):
                hashed = self.hash(ids[part[:, None] + np.arange(n)])
                place = np.minimum(np.searchsorted(known, hashed), len(known) - 1)
                for at in part[known[place] == hashed]:
                    found = self.exact.get(ids[at:at + n].tobytes())
                    if found is not None:
                        hit[at:at + n] = True
                        items |= found
        return hit, items


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _scanner(broadcast):
    def one(text: bytes | None, before: dict | None, grams: GramSet) -> dict:
        text = (text or b"").lower()  # bytes: only A-Z change
        words = _WORD.findall(text)
        hit, items = grams.scan(words)
        for run in (before or {}).get("words") or ():
            hit[run["start"]:run["end"]] = True
        items |= set((before or {}).get("items") or ())
        runs, spans = _runs(hit), []
        if runs:
            places = [m.span() for m in _WORD.finditer(text)]
            byte_spans = [(places[a][0], places[b - 1][1]) for a, b in runs]
            at = chars = 0
            for edge in (x for span in byte_spans for x in span):  # bytes to characters, in one pass
                chars += len(text[at:edge].decode())
                at = edge
                spans.append(chars)
        return {"n_words": len(words), "n_hit": int(hit.sum()), "items": sorted(items),
                "spans": [{"start": a, "end": b} for a, b in zip(spans[::2], spans[1::2])],
                "words": [{"start": a, "end": b} for a, b in runs]}

    @F.arrow_udf(HITS)
    def scan(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        grams = broadcast.value
        kind = _arrow_type()
        for texts, before in batches:
            yield pa.array([one(t.as_py(), b.as_py(), grams) for t, b in zip(texts, before)], type=kind)

    return scan


def _arrow_type() -> pa.DataType:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
                      ("spans", span), ("words", span)])


def scan_contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                       item_text: str = "text", length: int = WINDOW, into: str = "contamination",
                       block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a struct column ``into``: n_words, n_hit, items, spans and words.

    A word is hit if it lies in any occurrence of a window of an item (``item_windows``).  ``items`` are the sorted
    ids whose windows occur, ``spans`` the character spans of runs of hit words (end exclusive), ``words`` the same
    runs as word positions.

    Documents are only scanned, never shuffled or grouped, so hot sources, copies and long texts stay rows.  The
    windows are broadcast in blocks of at most about ``block_bytes``; their total size is measured first.  One block
    is the usual case; with more, the documents are scanned once for each and what was found is carried along in a
    table in the shared folder.

    NULL and empty texts have no words and are clean.  Windows of an item without an id count as hits but name no
    item.  Repeated items change nothing; without items no word is hit.  Columns of ``docs`` keep their names and
    values, except one named ``into``, which is replaced.
    """
    spark = docs.sparkSession
    grams = stored(item_windows(items, item_id, item_text, length), "decontamination-windows")
    total = grams.agg(F.sum(F.octet_length("gram") + F.coalesce(F.octet_length("item"), F.lit(0)))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    raw, state = free_name(docs, "raw_text"), free_name(docs, "found")
    docs = docs.withColumn(state, F.lit(None).cast(HITS))
    for k in range(blocks):
        block = grams.filter(F.pmod(F.xxhash64("gram", "item"), F.lit(blocks)) == k)
        scan = _scanner(spark.sparkContext.broadcast(GramSet([tuple(r) for r in block.collect()])))
        docs = (docs.withColumn(raw, F.col(text).cast("binary"))
                .withColumn(state, scan(F.col(raw), F.col(state))).drop(raw))
        if k + 1 < blocks:
            docs = stored(docs, "decontamination-scan")
    return docs.withColumn(into, F.col(state)).drop(state)


def contaminated(hits: str | Column = "contamination", percent: int = 5) -> Column:
    """Hit at all, and at least ``percent`` of a hundred words hit."""
    c = F.col(hits) if isinstance(hits, str) else hits
    return (c["n_hit"] > 0) & (100 * c["n_hit"] >= percent * c["n_words"])


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", remove: str = "documents",
                  percent: int = 5, **options) -> DataFrame:
    """``docs`` without contamination, with their own columns.

    ``remove="documents"`` drops contaminated documents and leaves the others alone; ``remove="spans"`` keeps all
    documents and cuts the hit spans out of contaminated ones.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    into = free_name(docs, "contamination")
    scanned = scan_contamination(docs, items, text, into=into, **options)
    bad = contaminated(into, percent)
    if remove == "documents":
        return scanned.filter(~bad).select(*docs.columns)
    clean = replace_spans(F.col(text), F.col(into)["spans"], "")
    return scanned.withColumn(text, F.when(bad, clean).otherwise(F.col(text))).select(*docs.columns)

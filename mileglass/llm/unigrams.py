"""Smoothed word unigrams: the plain score next to which a language model is read."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mileglass.llm.text import BLANKS, free_name, lower_ascii, stored, text_blocks

SMOOTHING = 0.1
#: Words whose counts are broadcast: the most frequent ones, at most so many; the others are joined.
BROADCAST_WORDS = 150_000
#: Longest word, in bytes, that is broadcast: with the number of words this bounds the size.
BROADCAST_BYTES = 64


def word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(word, c) over all whole texts: A-Z in lower case, cut at blanks."""
    words = F.split(lower_ascii(F.coalesce(F.col(text), F.lit(""))), f"[{BLANKS}]+")
    return (texts.select(F.explode(words).alias("word")).filter("word != ''")
            .groupBy("word").agg(F.count("*").alias("c")))


def _frequent(counts: DataFrame, most: int) -> dict[bytes, int]:
    """Counts of at most ``most`` short words: all those counted at least a power of two, the smallest that fits."""
    short = counts.filter(F.octet_length("word") <= BROADCAST_BYTES)
    sizes = {r.power: r.k for r in short.groupBy(F.floor(F.log2("c")).alias("power")).agg(F.count("*").alias("k")).collect()}
    power = 0
    while sum(k for p, k in sizes.items() if p >= power) > most:
        power += 1
    rows = short.filter(F.col("c") >= 1 << power).toArrow()
    return {w.encode(): c for w, c in zip(rows.column("word").to_pylist(), rows.column("c").to_pylist())}


def unigram_scores(docs: DataFrame, training: Column, text: str = "text", keep: dict[str, Column] | None = None,
                   most: int = BROADCAST_WORDS,
                   beside: dict[str, tuple[str, Callable[[pa.Array], pa.Array]]] | None = None) -> DataFrame:
    """The columns ``keep`` of every document with n_tokens, n_known, train_tokens and base_score.

    Tokens are the words of a whole text and one end.  ``base_score`` sums log10((c + 0.1) / (N + 0.1 (V + 1))) over
    them, with counts from the documents where ``training`` holds.  Frequent words are looked up in a broadcast of
    bounded size while a text is read; the other words of a document go through a join on the word, so counts of all
    words are exact at any size.  Rows get a number that is stored, so ids may be NULL or repeated.  Kept columns of the
    added names are replaced.

    ``beside`` names further columns, each with its type and a function from binary texts to values.  They are worked
    out while the texts are read, so that a task needs one Python process and gets each text once.
    """
    beside = beside or {}
    counts = stored(word_counts(docs.filter(training), text), "unigram-counts")
    ends = docs.filter(training).count()
    words, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = words + ends, distinct + (1 if ends else 0)
    log = _log_share(n, v)
    shared = docs.sparkSession.sparkContext.broadcast({w: float(log(c)) for w, c in _frequent(counts, most).items()})
    end_score = float(log(ends))

    parts = ["n", "known", "score", "others", *(f"beside{i}" for i in range(len(beside)))]
    kinds = ["bigint", "bigint", "double", "array<string>", *(kind for kind, _ in beside.values())]

    @F.arrow_udf(f"struct<{','.join(f'{p}:{k}' for p, k in zip(parts, kinds))}>")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = shared.value
        for texts in (block for batch in batches for block in text_blocks(batch)):
            ns, knowns, sums, others = [], [], [], []
            for t in texts:
                tokens = (t.as_py() or b"").lower().split()  # bytes: A-Z only, blanks only
                scores = [table[w] for w in tokens if w in table]
                ns.append(len(tokens))
                knowns.append(len(scores))
                sums.append(sum(scores))
                others.append([w.decode() for w in tokens if w not in table])
            yield pa.StructArray.from_arrays(
                [pa.array(ns, pa.int64()), pa.array(knowns, pa.int64()), pa.array(sums, pa.float64()),
                 pa.array(others, pa.list_(pa.string())), *(f(texts) for _, f in beside.values())], names=parts)

    added = ("n_tokens", "n_known", "train_tokens", "base_score")
    keep = keep or {c: F.col(f"`{c}`") for c in docs.columns if c != text}
    keep = {name: c for name, c in keep.items() if name.lower() not in added and name not in beside}
    row, seen_, known, score = (free_name([*keep, *beside], c) for c in ("__row", "__seen", "__known", "__score"))
    seen = stored(docs.select(*[c.alias(name) for name, c in keep.items()], F.monotonically_increasing_id().alias(row),
                              read(F.col(text).cast("binary")).alias(seen_)), "unigram-rows")
    others = (seen.select(F.col(row).alias("row"), F.explode(f"{seen_}.others").alias("word"))
              .groupBy("row", "word").agg(F.count("*").alias("k")).join(counts, "word", "left").groupBy("row")
              .agg(F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias(known),
                   F.sum(F.col("k") * _log_column(F.coalesce("c", F.lit(0)), n, v)).alias(score))
              .withColumnRenamed("row", row))
    s = F.col(seen_)
    return seen.join(others, row, "left").select(
        *[F.col(f"`{c}`") for c in keep], *[s[p].alias(name) for p, name in zip(parts[4:], beside)], (s["n"] + 1).alias("n_tokens"),
        (s["known"] + F.coalesce(known, F.lit(0)) + (1 if ends else 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (s["score"] + F.coalesce(score, F.lit(0.0)) + F.lit(end_score)).alias("base_score"))


def _log_share(n: int, v: int):
    from math import log10
    return lambda c: log10((c + SMOOTHING) / (n + SMOOTHING * (v + 1)))


def _log_column(c: Column, n: int, v: int) -> Column:
    return F.log10((c + F.lit(SMOOTHING)) / F.lit(n + SMOOTHING * (v + 1)))

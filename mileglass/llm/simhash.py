"""SimHash near-duplicates through an inverted index over byte positions, count filtering and verification."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mileglass.llm.components import components
from mileglass.llm.text import free_name, stored

SHINGLE = 3
MAX_BITS = 3
SEED = 42
#: Postings of up to so many fingerprints are compared pair by pair, longer ones are indexed once more.
SHORT_POSTING = 32
#: Sets of four of eight positions such that any five positions contain one: those whose numbers cancel out.
QUADS = tuple(q for q in combinations(range(8), 4) if q[0] ^ q[1] ^ q[2] ^ q[3] == 0)
_CHUNK = 1 << 16


def fingerprint_bits(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64 bits; each is set if it is set in over half of the XXH64 values of the shingles, repeats included."""
    words = (text or b"").lower().split()  # bytes: only A-Z change, and only blanks split
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    last = max(len(words) - shingle + 1, 1)
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for lo in range(0, last, _CHUNK):
        hi = min(lo + _CHUNK, last)
        hashes = np.fromiter(
            (digest(joined[a:b - 1], SEED) for a, b in
             zip(starts[lo:hi], ends[min(lo + shingle, len(words)) - 1:])), dtype="<u8", count=hi - lo)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > last, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint of a text column as a signed 64-bit integer."""

    @F.arrow_udf("bigint")
    def of_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            bits = np.fromiter((fingerprint_bits(t.as_py(), shingle) for t in texts), dtype="<u8", count=len(texts))
            yield pa.array(bits.view("<i8"))

    return of_text(text.cast("binary"))


def _mask(positions: tuple[int, ...], width: int) -> int:
    value = sum(((1 << width) - 1) << (p * width) for p in positions)
    return value - (1 << 64) if value >> 63 else value


def shared_bytes(a: str, b: str) -> Column:
    """The number of byte positions at which two fingerprints agree."""
    differing = F.col(a).bitwiseXOR(F.col(b))
    equal = [(differing.bitwiseAND(F.lit(_mask((p,), 8))) == 0).cast("int") for p in range(8)]
    return sum(equal[1:], equal[0])


def postings(prints: DataFrame) -> DataFrame:
    """The inverted index: (quad, key, fp) for each distinct fingerprint and each set of four byte positions."""
    entries = F.array(*[F.struct(F.lit(i).cast("byte").alias("quad"),
                                 F.col("fp").bitwiseAND(F.lit(_mask(q, 8))).alias("key"))
                        for i, q in enumerate(QUADS)])
    return prints.select("fp", F.explode(entries).alias("e")).select("e.quad", "e.key", "fp")


def _nibble_quads(quad: tuple[int, ...]) -> list[int]:
    """Masks of a posting's four bytes and, of the eight half bytes of the other four, each set of four."""
    halves = [2 * p + k for p in range(8) if p not in quad for k in (0, 1)]
    fixed = _mask(quad, 8) & (1 << 64) - 1
    values = [fixed | (_mask(tuple(halves[i] for i in q), 4) & (1 << 64) - 1) for q in QUADS]
    return [v - (1 << 64) if v >> 63 else v for v in values]


def forest(values: np.ndarray, max_bits: int) -> np.ndarray:
    """For each of some distinct fingerprints a number; two get the same if steps of ``max_bits`` connect them."""
    n, label = len(values), np.arange(len(values))
    order = np.argsort(values)
    ranked = values[order]
    if n <= 512:
        near = np.bitwise_count(values[:, None] ^ values[None, :]) <= max_bits
        neighbours = [np.nonzero(near)]
    else:
        free = [b for b in range(64) if np.any((values ^ values[0]) >> np.uint64(b) & np.uint64(1))]
        flips = [sum(1 << b for b in c) for k in range(1, max_bits + 1) for c in combinations(free, k)]

        def meet(flip):
            place = np.minimum(np.searchsorted(ranked, values ^ np.uint64(flip)), n - 1)
            found = np.flatnonzero(ranked[place] == values ^ np.uint64(flip))
            return found, order[place[found]]
        neighbours = [meet(f) for f in flips]
    while True:
        before = label.copy()
        for a, b in neighbours:
            np.minimum.at(label, a, label[b])
        label = np.minimum(label, label[label])
        if np.array_equal(before, label):
            return label


def near_links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints (column ``fp``) exactly as differences of ``max_bits`` do.

    Fingerprints at most three bits apart agree in at least five of eight bytes, hence in all four bytes of one of
    the 14 quads: the index is keyed by four positional bytes, which cuts a posting to one in 2**32 where a single
    byte would leave one in 256.  Pairs of a short posting are tallied for shared positional bytes, those with at
    least ``8 - max_bits`` are kept and verified by bits.

    Members of a long posting are indexed once more by half bytes: again one of 14 sets of four must agree, which
    leaves 16 free bits, so a group holds at most 65,536 fingerprints whatever the input.  Such a group returns one
    link from each fingerprint to the first one connected to it, never its pairs.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the index finds differences of 0 to 3 bits")
    index = postings(prints)
    sizes = index.groupBy("quad", "key").agg(F.count("*").alias("n")).filter("n > 1")
    members = stored(index.join(sizes, ["quad", "key"]), "simhash-postings")
    short = members.filter(F.col("n") <= SHORT_POSTING).select("quad", "key", "fp")
    pairs = (short.withColumnRenamed("fp", "a").join(short.withColumnRenamed("fp", "b"), ["quad", "key"])
             .filter("a < b")
             .filter(shared_bytes("a", "b") >= 8 - max_bits)
             .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
             .select("a", "b"))
    halves = F.array(*[F.array(*[F.lit(m) for m in _nibble_quads(q)]) for q in QUADS])
    long = (members.filter(F.col("n") > SHORT_POSTING)
            .select("quad", "fp", F.posexplode(F.get(halves, F.col("quad").cast("int"))).alias("part", "mask"))
            .select("quad", "part", F.col("fp").bitwiseAND(F.col("mask")).alias("half_key"), "fp"))
    single = long.groupBy("quad", "part", "half_key").agg(F.count("*").alias("n")).filter("n > 1")

    def connect(table: pa.Table) -> pa.Table:
        values = table.column("fp").to_numpy().view("<u8")
        first = values[forest(values, max_bits)]
        linked = first != values
        return pa.table({"a": values[linked].view("<i8"), "b": first[linked].view("<i8")})

    dense = (long.join(single, ["quad", "part", "half_key"]).select("quad", "part", "half_key", "fp")
             .groupBy("quad", "part", "half_key").applyInArrow(connect, "a bigint, b bigint"))
    return pairs.union(dense).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """One row (doc_id, fp, component_id) per document.

    Fingerprints link at ``max_bits`` or fewer differing bits; ``component_id`` is the smallest id of all documents
    reachable over links.  Equal fingerprints are one node of the index, however many documents share them.

    NULL, empty and blank texts have the fingerprint 0 and link like any other.  A NULL id is never the smallest; a
    component of NULL ids only has a NULL component_id.  Repeated rows are repeated in the result.
    """
    marked = stored(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), shingle).alias("fp")),
                    "simhash-prints")
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(near_links(classes.select("fp"), max_bits))
    rooted = (classes.join(roots, F.col("fp") == F.col("node"), "left")
              .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
             max_bits: int = MAX_BITS) -> DataFrame:
    """The documents without near-duplicates, with their own columns: of each component the smallest id stays.

    A row is known by its id and its text.  Of rows equal in both, one stays; of a component without ids, the row
    whose text has the smallest hash.
    """
    row, fp = free_name(docs, "row"), free_name(docs, "fp")

    def row_key(frame):
        return F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"),
                        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"))

    marked = stored(docs.select(row_key(docs).alias("row"), fingerprint(F.col(text), shingle).alias("fp")),
                    "simhash-rows")
    classes = marked.groupBy("fp").agg(F.min("row").alias("least"))
    roots = components(near_links(classes.select("fp"), max_bits))
    first = (classes.join(roots, F.col("fp") == F.col("node"), "left")
             .groupBy(F.coalesce("root", "fp")).agg(F.min("least").alias("first"))
             .select("first.*").select(F.col("no_id").alias("k0"), F.col("id").alias("k1"), F.col("h").alias("k2")))
    keyed = docs.withColumn(row, row_key(docs))
    kept = keyed.join(first, (F.col(row)["no_id"] == F.col("k0")) & (F.col(row)["h"] == F.col("k2"))
                      & F.col(row)["id"].eqNullSafe(F.col("k1")), "left_semi")
    same = Window.partitionBy(F.col(row)["no_id"], F.col(row)["id"], F.col(row)["h"]).orderBy(F.lit(1))
    return kept.withColumn(fp, F.row_number().over(same)).filter(F.col(fp) == 1).select(*docs.columns)

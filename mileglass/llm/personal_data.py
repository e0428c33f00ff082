"""Personal data: fixed shapes, and the terms that the corpus shows to give them away.

The values found by the fixed shapes are the protected entities.  How much a term discloses of an entity is their
pointwise mutual information over the corpus as a share of the entity's own information: 1 if the term occurs only
with the entity, 0 if it is independent.  Terms above one threshold are generalised, above a second one removed.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mileglass.llm.text import free_name, stored

#: Kinds in the order in which spans are listed; ``term`` is what the corpus adds.
KINDS = ("email", "ip", "card", "phone", "term")
# Fixed shapes.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_GAPS = str.maketrans("", "", " ().-")

_TERM = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
#: What is counted together before it is shuffled, in characters of text.
BLOCK_CHARS = 4 << 20
#: Places of the filter that keeps words out of the count which no entity has near it.
FILTER_BITS = 20


@dataclass(frozen=True)
class Thresholds:
    """How terms are judged.

    ``reach``: words on either side of an entity that count as being with it.  ``support``: documents in which a term
    has to be with an entity before the corpus says anything about them.  ``generalise``, ``remove``: shares of the
    entity's information from which a term is generalised or removed.
    """

    reach: int = 8
    support: int = 3
    generalise: float = 0.8
    remove: float = 0.95


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d - 9 if d > 9 else d for d in (2 * int(c) for c in digits[-2::-2]))) % 10 == 0


def fixed_shapes(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; leftmost and apart from each other within a kind.

    Every search is linear: an address is found from its sign backwards, numbers only where a run of digits begins.
    """
    out, last = [], 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append(("email", start, m.end()))
            last = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().translate(_GAPS)
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= len(m.group().translate(_GAPS)) - 1 <= 15:
            out.append(("phone", *m.span()))
    return out


def entity(kind: str, value: str) -> str:
    """One name for all spellings of a protected value."""
    return f"{kind}:{value.lower() if kind == 'email' else value if kind == 'ip' else value.translate(_GAPS)}"


def terms_near(text: str, shapes: list[tuple[str, int, int]], reach: int) -> tuple[list[tuple[str, str]], dict[str, list[tuple[int, int]]]]:
    """Distinct (entity, term) pairs of a text, and where each of these terms occurs anywhere in it.

    Terms are words in lower case with two letters or digits at least, outside the fixed shapes; ``reach`` counts them.
    """
    taken = sorted((a, b) for _, a, b in shapes)
    words, at = [], 0
    for m in _TERM.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        # A later shape may start earlier than this one ends; all that start before the word ends are looked at.
        k, free = at, m.end() - m.start() > 1
        while free and k < len(taken) and taken[k][0] < m.end():
            free = taken[k][1] <= m.start()
            k += 1
        if free:
            words.append((m.start(), m.end()))
    starts = [a for a, _ in words]
    lower: dict[int, str] = {}
    pairs = {}
    for kind, a, b in shapes:
        name, first, after = entity(kind, text[a:b]), bisect_left(starts, a), bisect_right(starts, b - 1)
        for i in (*range(max(first - reach, 0), first), *range(after, min(after + reach, len(words)))):
            if i not in lower:
                lower[i] = text[words[i][0]:words[i][1]].lower()
            pairs[name, lower[i]] = None
    wanted: dict[str, list[tuple[int, int]]] = {t: [] for _, t in pairs}
    if wanted:
        for a, b in words:
            spans = wanted.get(text[a:b].lower())
            if spans is not None:
                spans.append((a, b))
    return list(pairs), wanted


_SPAN = "struct<kind:string,start:bigint,end:bigint>"
_SEEN = f"struct<shapes:array<{_SPAN}>,pairs:array<struct<entity:string,term:string>>,terms:array<struct<term:string,spans:array<{_SPAN}>>>>"
_ARROW_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_ARROW_SEEN = pa.struct([("shapes", pa.list_(_ARROW_SPAN)),
                         ("pairs", pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string())]))),
                         ("terms", pa.list_(pa.struct([("term", pa.string()), ("spans", pa.list_(_ARROW_SPAN))])))])


def _looked_at(text: Column, reach: int) -> Column:
    """The fixed shapes of each text, the entities and terms near each other, and where these terms are."""
    def span(kind, a, b):
        return {"kind": kind, "start": a, "end": b}

    @F.arrow_udf(_SEEN)
    def look(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = []
            for t in texts:
                t = t.as_py() or ""
                shapes = fixed_shapes(t)
                pairs, terms = terms_near(t, shapes, reach) if shapes else ([], {})
                rows.append({"shapes": [span(*s) for s in shapes], "pairs": [{"entity": e, "term": w} for e, w in pairs],
                             "terms": [{"term": w, "spans": [span("term", *s) for s in spans]} for w, spans in terms.items()]})
            yield pa.array(rows, type=_ARROW_SEEN)

    return look(text)


def term_counts(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(term, n_term): documents of the whole corpus that hold each term of ``wanted``, and maybe of other terms.

    Words are sifted by a filter of fixed size before they are counted; what passes it by chance is only counted in
    vain.  Equal words of a block of texts are one row before the shuffle.
    """
    places = 1 << FILTER_BITS
    on = wanted.select((F.crc32("term") % places).cast("int").alias("p")).distinct().toArrow()  # at most ``places`` rows
    filter_ = bytearray(places)
    for p in on.column("p").to_pylist():
        filter_[p] = 1
    shared = docs.sparkSession.sparkContext.broadcast(bytes(filter_))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, seen, size = shared.value, Counter(), 0

        def out():
            found = [(w, n) for w, n in seen.items() if kept[crc32(w.encode()) % places]]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], type=pa.string()),
                                               pa.array([n for _, n in found], type=pa.int64())], ["term", "n"])

        for batch in batches:
            for t in batch.column(0):
                t = t.as_py() or ""
                # Each word is folded on its own, as ``terms_near`` does.
                seen.update({w.lower() for w in set(_TERM.findall(t))})
                size += len(t)
                if size >= BLOCK_CHARS:
                    yield out()
                    seen, size = Counter(), 0
        yield out()

    return (docs.select(text).mapInArrow(count, "term string, n bigint")
            .groupBy("term").agg(F.sum("n").alias("n_term")))


def disclosures(near: DataFrame, together: DataFrame, counts: DataFrame, n_docs: int, t: Thresholds) -> DataFrame:
    """(entity, term, disclosure) of the pairs above the lower threshold.

    ``near`` has a row per document with its ``entities``; ``together`` counts the documents of each pair (n_both),
    ``counts`` those of each term (n_term).  An entity that is in every document has no information to disclose.
    """
    entities = near.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    n = F.lit(float(n_docs))
    share = F.log(F.col("n_both") * n / (F.col("n_entity") * F.col("n_term"))) / F.log(n / F.col("n_entity"))
    return (together.join(entities, "entity").join(counts, "term")
            .withColumn("disclosure", F.when(F.col("n_entity") < n, share).otherwise(0.0))
            .filter(F.col("disclosure") >= t.generalise).select("entity", "term", "disclosure"))


def _judged(docs: DataFrame, text: str, kept: list[str], t: Thresholds) -> tuple[DataFrame, str, str]:
    """The columns ``kept`` with two more, whose names are returned: what was looked at, and the disclosure of each
    term that the row has to be told about (NULL if none)."""
    row, seen, told = (free_name(docs, c) for c in ("row", "seen", "told"))
    looked = stored(docs.select(*[docs[f"`{c}`"] for c in kept], F.monotonically_increasing_id().alias(row),
                                _looked_at(docs[f"`{text}`"], t.reach).alias(seen)), "personal-seen")
    near = looked.select(F.col(row), F.col(f"{seen}.pairs").alias("pairs"),
                         F.array_distinct(F.col(f"{seen}.pairs.entity")).alias("entities")).filter(F.size("pairs") > 0)
    frequent = stored(near.select(F.explode("pairs").alias("p")).groupBy("p.entity", "p.term").agg(F.count("*").alias("n_both"))
                      .filter(F.col("n_both") >= t.support), "personal-pairs")
    judged = stored(disclosures(near, frequent, term_counts(docs, text, frequent), looked.count(), t), "personal-disclosures")
    each = near.select(row, F.explode("pairs").alias("p")).select(row, "p.entity", "p.term").join(judged, ["entity", "term"])
    terms = (each.groupBy(row, "term").agg(F.max("disclosure").alias("disclosure"))
             .groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias(told)))
    return looked.join(terms, row, "left").drop(row), seen, told


def find_personal(docs: DataFrame, text: str = "text", keep: list[str] | None = None, name: str = "personal",
                  thresholds: Thresholds = Thresholds()) -> DataFrame:
    """The columns ``keep`` (all, if not given) of every row, and ``name``: array<struct<kind, start, end, disclosure>>.

    Spans are in characters, end exclusive, by kind as in ``KINDS``, then start.  The fixed shapes come first; their
    disclosure is NULL.  A ``term`` span is any place of a term that, over the whole corpus, discloses an entity of
    its own document near which it stands: log(n_both N / (n_entity n_term)) / log(N / n_entity), counted in rows.

    NULL and empty texts have no spans but count as rows.  Repeated rows count each.  A column that is called like the
    result is replaced by it.  Documents without a fixed shape are left alone.

    A text is read twice and shuffled never: once for shapes and the terms near them, which are stored, and once to
    count the terms that matter.  What comes together is pairs of entity and term, summed before the shuffle, and the
    terms of one document.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() != name.lower()]
    found, seen, told = _judged(docs, text, kept, thresholds)

    def span(s, disclosure):
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), disclosure.alias("disclosure"))

    shapes = F.transform(f"{seen}.shapes", lambda s: span(s, F.lit(None).cast("double")))
    chosen = F.filter(f"{seen}.terms", lambda x: F.map_contains_key(F.col(told), x["term"]))
    terms = F.flatten(F.transform(chosen, lambda x: F.transform(x["spans"], lambda s: span(s, F.try_element_at(F.col(told), x["term"])))))
    terms = F.array_sort(terms, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))
    return found.select(*[F.col(f"`{c}`") for c in kept],
                        F.when(F.col(told).isNull(), shapes).otherwise(F.concat(shapes, terms)).alias(name))


def generalised(term: str) -> str:
    """What stands for a term that is generalised: its shape."""
    return "[NUMBER]" if term.isdigit() else "[NAME]" if term[:1].isupper() else "[WORD]"


def _cleaned(text: str, spans: list[tuple[str, int, int, float]], remove: float) -> str:
    out, at = [], 0
    # Of overlapping spans the one that starts first, and then is longest, names the whole stretch.
    for kind, start, end, disclosure in sorted(spans, key=lambda s: (s[1], -s[2])):
        if end <= at:
            continue
        if start >= at:
            out.append(text[at:start])
            out.append(f"[{kind.upper()}]" if kind != "term" else "" if disclosure >= remove else generalised(text[start:end]))
        at = end
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, text: str = "text", thresholds: Thresholds = Thresholds()) -> DataFrame:
    """``docs`` with the personal data of ``text`` taken out.

    Fixed shapes become their kind in brackets, disclosing terms the shape of the word, or nothing from
    ``thresholds.remove`` on.  Rows and columns stay; NULL stays NULL.
    """
    found, seen, told = _judged(docs, text, docs.columns, thresholds)

    @F.arrow_udf("string")
    def clean(texts: pa.Array, looked: pa.Array, judged: pa.Array) -> pa.Array:
        out = []
        for t, s, terms in zip(texts.to_pylist(), looked.to_pylist(), judged.to_pylist()):
            shares = dict(terms or [])
            spans = [(x["kind"], x["start"], x["end"], 0.0) for x in s["shapes"]]
            spans += [("term", x["start"], x["end"], shares[w["term"]]) for w in s["terms"] if w["term"] in shares for x in w["spans"]]
            out.append(_cleaned(t, spans, thresholds.remove) if spans else t)
        return pa.array(out, type=pa.string())

    return found.withColumn(text, clean(F.col(f"`{text}`"), F.col(seen), F.col(told))).select(*[F.col(f"`{c}`") for c in docs.columns])


def span_list(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """``kind:start:end`` of the spans of some kinds, comma-joined."""
    wanted = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(wanted, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

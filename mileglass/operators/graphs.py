"""Repair of tables of JSON node/edge graphs, one payload per row.

Input columns: payload_id, source_agent_id, anchor_message_id, run_id,
payload_json.  Ids may be NULL or repeated: every row is a payload of its own.

Everything happens inside the row, on arrays: nothing is shuffled, grouped or
joined, so no payload id can be a hot key.  Most elements need no repair; one
search in the element's JSON text tells, and only the others are taken apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mileglass.functions import cleaning as X
from mileglass.functions.cleaning import GraphLimits, as_number

KEYS = ("payload_id", "source_agent_id", "anchor_message_id", "run_id")

# The names of all repair actions, in order.
ACTIONS = (
    "defaulted_edges", "defaulted_metadata", "defaulted_nodes", "dropped_blank_text",
    "dropped_dangling_edge", "dropped_duplicate_edge", "dropped_excess_edge", "dropped_excess_node",
    "dropped_excess_property", "dropped_excess_property_item", "dropped_invalid_edge",
    "dropped_invalid_node", "dropped_invalid_properties", "dropped_invalid_property",
    "dropped_invalid_property_item", "dropped_invalid_weight", "dropped_non_text",
    "dropped_unknown_field", "normalized_text", "truncated_text",
)
TEXT_COUNTS = ("non_text", "blank", "normalized", "truncated")
PROPERTY_COUNTS = ("bad_properties", "excess", "bad", "excess_item", "bad_item", "prop_normalized", "prop_truncated")
ELEMENT_COUNTS = (*TEXT_COUNTS, *PROPERTY_COUNTS, "unknown", "bad_weight")

# A number that may grow when rewritten or overflow to infinity has an
# exponent or hundreds of digits.
_UNUSUAL_NUMBER = r"[0-9][eE]|[0-9]{300}"


# ----------------------------------------------------------------- admission
def _overflows(text: Column) -> Column:
    """True if a number with a fraction or exponent is beyond a double.

    Looks outside string literals only.
    """
    bare = F.regexp_replace(text, r'"(\\.|[^"\\])*"', '""')
    numbers = F.regexp_extract_all(bare, F.lit(r"(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"), F.lit(1))
    return F.exists(numbers, lambda n: n.rlike("[.eE]") & (F.abs(n.try_cast("double")) == F.lit(float("inf"))))


def with_budget(payloads: DataFrame, limits: GraphLimits) -> DataFrame:
    """Parse each payload and add ``graph`` (VARIANT) and ``reason``.

    ``reason`` is NULL for payloads that may be repaired.
    """
    text = F.col("payload_json")
    # The compact form is never longer than the text unless a number is
    # written out, so most payloads need no second serialization.
    usual = (F.octet_length(text) <= limits.payload_bytes) & ~text.rlike(_UNUSUAL_NUMBER)
    unfit = F.when(~usual, F.when(F.octet_length(F.to_json("graph")) > limits.payload_bytes, "over_budget")
                   .when(text.rlike(_UNUSUAL_NUMBER) & _overflows(text), "non_finite"))
    reason = (F.when(text.isNull(), "absent")
              .when(F.col("graph").isNull(), "not_json")
              .when(F.is_variant_null("graph"), "absent")
              .otherwise(F.coalesce(unfit, F.when(~text.rlike(r"\A[ \t\r\n]*\{"), "not_object"))))
    return payloads.withColumn("graph", F.try_parse_json(text)).withColumn("reason", reason)


def within_budget(payloads: DataFrame, limits: GraphLimits) -> DataFrame:
    """Only payloads that fit the byte limit and hold finite numbers."""
    checked = with_budget(payloads, limits)
    return checked.filter(F.col("reason").isNull() | (F.col("reason") == "not_object"))


def _list(name: str) -> Column:
    return F.try_variant_get("graph", f"$.{name}", "array<variant>")


def element_counts(payloads: DataFrame, limits: GraphLimits) -> DataFrame:
    """Per payload and kind: elements kept by the cap and elements above it.

    A missing or non-list element list counts as defaulted and empty.
    """
    def row(kind, cap):
        items = F.col(f"_{kind}")
        n = F.when(items.isNull(), 0).otherwise(F.size(items))
        return F.struct(F.lit(kind).alias("kind"), items.isNull().alias("defaulted"),
                        F.least(n, F.lit(cap)).alias("kept"),
                        F.greatest(n - cap, F.lit(0)).alias("excess"))
    objects = with_budget(payloads, limits).filter(F.col("reason").isNull())
    return (objects.select("payload_id", _list("nodes").alias("_nodes"), _list("edges").alias("_edges"))
            .select("payload_id", F.inline(F.array(row("edges", limits.edges), row("nodes", limits.nodes)))))


def explode_elements(payloads: DataFrame, kind: str, limits: GraphLimits) -> DataFrame:
    """One row per raw element of ``nodes`` or ``edges``: payload_id, pos, element."""
    return (with_budget(payloads, limits).filter(F.col("reason").isNull())
            .select("payload_id", F.posexplode(_list(kind)).alias("pos", "element")))


# ------------------------------------------------------------------- texts
def clean_text(df: DataFrame, name: str, value: str, longest: int, applies: Column | None = None,
               is_variant: bool = True) -> DataFrame:
    """Add the cleaned text ``name`` and its four counts ``name_<count>``.

    Text is unchanged if it is visible, within the limit and free of control
    characters.  Otherwise gaps are squeezed, blank text becomes NULL and long
    text is cut to the limit with an ellipsis.  Rows outside ``applies`` get
    NULL and zeros.
    """
    applies = F.lit(True) if applies is None else applies
    raw, short = F.col("_text"), F.col("_squeezed")
    blank, long = short == "", F.length(short) > longest
    return (df
            .withColumn("_text", F.when(applies, X.text_of(F.col(value)) if is_variant else F.col(value)))
            .withColumn("_squeezed", F.when(raw.isNotNull() & ~X.is_identifier(raw, longest), X.squeezed(raw)))
            .withColumns({
                name: F.when(short.isNull(), raw).when(blank, None)
                       .when(long, X.shortened(short, longest)).otherwise(short),
                f"{name}_non_text": as_number(applies & raw.isNull()),
                f"{name}_blank": as_number(blank),
                f"{name}_normalized": as_number(~blank & (short != raw)),
                f"{name}_truncated": as_number(~blank & long)})
            .drop("_text", "_squeezed"))


# ---------------------------------------------------------------- inside a row
def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _counts(**found: Column) -> Column:
    """All counts of an element; those not given are zero."""
    return F.struct(*(found.get(c, F.lit(0)).cast("int").alias(c) for c in ELEMENT_COUNTS))


def _no_counts() -> Column:
    """What an element that needs no repair has instead, since its counts are never read."""
    return F.lit(None).cast(f"struct<{','.join(f'{c}:int' for c in ELEMENT_COUNTS)}>")


def _text_result(value: Column, longest: int) -> Column:
    """struct(text, non_text, blank, normalized, truncated) of a variant that should hold text; see ``clean_text``."""
    def result(text, *numbers):
        return F.struct(text.alias("text"), *(n.cast("int").alias(c) for c, n in zip(TEXT_COUNTS, numbers)))

    none, zero, one = F.lit(None).cast("string"), F.lit(0), F.lit(1)

    def repaired(raw):
        return _let(X.squeezed(raw), lambda short: F.when(short == "", result(none, zero, one, zero, zero)).otherwise(
            result(F.when(F.length(short) > longest, X.shortened(short, longest)).otherwise(short), zero, zero,
                   short != raw, F.length(short) > longest)))

    return _let(X.text_of(value), lambda raw: F.when(raw.isNull(), result(none, one, zero, zero, zero))
                .when(X.is_identifier(raw, longest), result(raw, zero, zero, zero, zero)).otherwise(repaired(raw)))


def _property_value(value: Column, kind: Column, limits: GraphLimits) -> Column:
    """struct(value, kept, prop_normalized, prop_truncated, excess_item, bad_item) of a property of known kind."""
    most, longest = limits.property_array_items, limits.property_string_chars

    def result(value, kept, *numbers):
        names = ("prop_normalized", "prop_truncated", "excess_item", "bad_item")
        return F.struct(value.alias("value"), kept.alias("kept"), *(n.alias(c) for c, n in zip(names, numbers)))

    def total(many, field):
        return F.aggregate(many, F.lit(0), lambda acc, m: acc + m[field])

    def listed(items):
        many = F.transform(F.slice(items, 1, most), lambda v: _let(
            F.schema_of_variant(v), lambda k: X.clean_scalar(v, k, longest)))
        return _let(many, lambda m: result(
            F.transform(F.filter(m, lambda x: x["kept"]), lambda x: x["value"]).cast("variant"), F.lit(True),
            total(m, "normalized"), total(m, "truncated"), F.greatest(F.size(items) - most, F.lit(0)),
            F.size(F.filter(m, lambda x: ~x["kept"]))))

    zero = F.lit(0)
    plain = _let(X.clean_scalar(value, kind, longest), lambda one: result(
        one["value"], one["kept"], one["normalized"], one["truncated"], zero, zero))
    dropped = result(F.lit(None).cast("variant"), F.lit(False), zero, zero, zero, zero)
    return (F.when(kind.isNull(), dropped).when(kind.startswith("ARRAY"), _let(X.items_of(value), listed))
            .otherwise(plain))


def _properties_result(value: Column, cap: int, source: Column, limits: GraphLimits) -> Column:
    """struct(properties, counts of PROPERTY_COUNTS) of a variant that should be an object of properties.

    The cap counts kept entries in input order.  A variant sorts its keys, so an object above the cap takes its key
    order from ``source``, the text it was parsed from; smaller objects never read it.
    """
    def result(properties, **numbers):
        return F.struct(properties.alias("properties"), *(numbers.get(c, F.lit(0)).alias(c) for c in PROPERTY_COUNTS))

    def entry(key, fields):
        usable = X.is_property_key(key, limits.property_key_chars)
        return _let(F.try_element_at(fields, key), lambda v: _let(
            F.when(usable, F.schema_of_variant(v)), lambda kind: F.struct(
                key.alias("key"), _property_value(v, kind, limits).alias("is"))))

    def read(entries):
        """How many entries are looked at until the cap is reached."""
        if cap == 0:
            return F.lit(0)
        places = F.filter(F.transform(entries, lambda e, i: F.when(e["is"]["kept"], i + 1)), lambda p: p.isNotNull())
        return F.coalesce(F.get(places, F.lit(cap - 1)), F.size(entries))

    def total(seen, field):
        return F.aggregate(seen, F.lit(0), lambda acc, e: acc + e["is"][field])

    def summed(seen, excess):
        return result(
            F.map_from_entries(F.transform(F.filter(seen, lambda e: e["is"]["kept"]), lambda e: F.struct(
                e["key"].alias("key"), e["is"]["value"].alias("value")))),
            excess=excess, bad=F.size(F.filter(seen, lambda e: ~e["is"]["kept"])),
            **{c: total(seen, c) for c in ("excess_item", "bad_item", "prop_normalized", "prop_truncated")})

    def of_fields(fields):
        above = F.size(fields) > cap
        keys = F.when(above, F.coalesce(F.json_object_keys(source), F.map_keys(fields))).otherwise(F.map_keys(fields))
        return _let(F.transform(keys, lambda k: entry(k, fields)), lambda entries: F.when(
            above, _let(F.slice(entries, F.lit(1), read(entries)), lambda seen: summed(seen, F.size(entries) - F.size(seen))))
            .otherwise(summed(entries, F.lit(0))))

    none = F.lit(None).cast("map<string,variant>")
    fine = F.to_json(value).rlike(rf"(?U)\A{_properties_pattern(cap, limits)}\z")
    return _let(X.fields_of(value), lambda fields: F.when(fields.isNull(), result(none, bad_properties=F.lit(1)))
                .when(fine, result(fields)).otherwise(of_fields(fields)))


# What JSON text of an element looks like that needs no repair; keys are sorted there.
def _text_pattern(longest: int) -> str:
    return rf'"(?=[^"]*[^\s"])[^"\\\x7f]{{1,{longest}}}"'


def _properties_pattern(cap: int, limits: GraphLimits) -> str:
    forbidden = "|".join(X.FORBIDDEN_KEYS)
    value = rf'(?:"[^"\\\x7f]{{0,{limits.property_string_chars}}}"|-?[0-9]+(?:\.[0-9]+)?|true|false|null)'
    one = rf'(?!"(?:{forbidden})"){_text_pattern(limits.property_key_chars)}:{value}'
    return rf"\{{(?:{one}(?:,{one}){{0,{cap - 1}}})?\}}" if cap else r"\{\}"


def _clean_node(limits: GraphLimits) -> str:
    def optional(name, longest):
        return rf'"{name}":{_text_pattern(longest)}'
    return (rf'(?U)\A\{{(?:{optional("description", limits.description_chars)},)?{optional("id", limits.id_chars)},'
            rf'{optional("label", limits.label_chars)}'
            rf'(?:,"properties":{_properties_pattern(limits.node_properties, limits)})?'
            rf'(?:,{optional("type", limits.type_chars)})?\}}\z')


def _clean_edge(limits: GraphLimits) -> str:
    return (rf'(?U)\A\{{(?:"label":{_text_pattern(limits.label_chars)},)?'
            rf'(?:"properties":{_properties_pattern(limits.edge_properties, limits)},)?'
            rf'"source":{_text_pattern(limits.id_chars)},"target":{_text_pattern(limits.id_chars)}'
            r'(?:,"weight":[0-9]+(?:\.[0-9]+)?)?\}\z')


def _field(value: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, f"$.{name}", kind)


def _opened(value: Column, *texts: str, also: str = "") -> Column:
    """The text fields and properties of an element that needs no repair, taken out in one pass."""
    fields = ",".join(f"{c}:string" for c in texts)
    return F.try_variant_get(value, "$", f"struct<{fields},properties:map<string,variant>{also}>")


def _identifier(fields: Column, name: str, limits: GraphLimits) -> Column:
    return _let(X.text_of(X.member(fields, name)), lambda text: F.when(X.is_identifier(text, limits.id_chars), text))


def _node(v: Column, i: Column, fine: Column, source: Column, limits: GraphLimits) -> Column:
    """struct(fine, pos, valid, id, label, type, description, properties, n) of a raw node; ``fine``: needs no repair."""
    def result(fine, valid, properties, n, **texts):
        return F.struct(fine.alias("fine"), i.alias("pos"), valid.alias("valid"),
                        *(texts[c].alias(c) for c in ("id", "label", "type", "description")),
                        properties.alias("properties"), n.alias("n"))

    names = ("id", "label", "type", "description")
    plain = _let(_opened(v, *names), lambda s: result(
        F.lit(True), F.lit(True), s["properties"], _no_counts(), **{c: s[c] for c in names}))

    def if_present(fields, name, wanted, found):
        return F.when(wanted & X.member(fields, name).isNotNull(), found)

    def parts(fields):
        """id and label first, since the other fields of a node without them are not looked at."""
        return _let(_identifier(fields, "id", limits), lambda id: _let(
            F.when(id.isNotNull(), _text_result(X.member(fields, "label"), limits.label_chars)), lambda label: _let(
                label.isNotNull() & label["text"].isNotNull(), lambda valid: _let(F.struct(
                    if_present(fields, "type", valid, _text_result(X.member(fields, "type"), limits.type_chars)).alias("type"),
                    if_present(fields, "description", valid, _text_result(
                        X.member(fields, "description"), limits.description_chars)).alias("description"),
                    if_present(fields, "properties", valid, _properties_result(
                        X.member(fields, "properties"), limits.node_properties, source, limits)).alias("properties")),
                    lambda more: summed(fields, id, label, valid, more)))))

    def summed(fields, id, label, valid, more):
        texts = (label, more["type"], more["description"])
        numbers = {c: sum(F.coalesce(t[c], F.lit(0)) for t in texts) for c in TEXT_COUNTS}
        numbers |= {c: F.coalesce(more["properties"][c], F.lit(0)) for c in PROPERTY_COUNTS}
        numbers["unknown"] = F.when(fields.isNull(), 0).otherwise(X.unknown_fields(fields, X.NODE_FIELDS))
        return result(F.lit(False), valid, more["properties"]["properties"], _counts(**numbers), id=id, label=label["text"],
                      type=more["type"]["text"], description=more["description"]["text"])

    return F.when(fine, plain).otherwise(_let(X.fields_of(v), parts))


def _edge(v: Column, i: Column, fine: Column, source_json: Column, limits: GraphLimits) -> Column:
    """struct(fine, pos, valid, source, target, label, weight, properties, n) of a raw edge, not linked yet.

    ``fine``: needs no repair unless its weight is above the limit.
    """
    def result(fine, valid, source, target, label, weight, properties, n):
        return F.struct(fine.alias("fine"), i.alias("pos"), valid.alias("valid"), source.alias("source"), target.alias("target"),
                        label.alias("label"), weight.alias("weight"), properties.alias("properties"), n.alias("n"))

    def plain(s):
        return result(F.lit(True), F.lit(True), s["source"], s["target"], s["label"], s["weight"], s["properties"], _no_counts())

    def parts(fields):
        return _let(F.struct(_identifier(fields, "source", limits).alias("source"), _identifier(fields, "target", limits).alias("target")),
                    lambda ends: _let(ends["source"].isNotNull() & ends["target"].isNotNull(), lambda valid: _let(F.struct(
                        F.when(valid & X.member(fields, "label").isNotNull(),
                               _text_result(X.member(fields, "label"), limits.label_chars)).alias("label"),
                        X.usable_weight(X.member(fields, "weight"), limits.weight).alias("weight"),
                        F.when(valid & X.member(fields, "properties").isNotNull(), _properties_result(
                            X.member(fields, "properties"), limits.edge_properties, source_json, limits)).alias("properties")),
                        lambda more: summed(fields, ends, valid, more))))

    def summed(fields, ends, valid, more):
        numbers = {c: F.coalesce(more["label"][c], F.lit(0)) for c in TEXT_COUNTS}
        numbers |= {c: F.coalesce(more["properties"][c], F.lit(0)) for c in PROPERTY_COUNTS}
        numbers["unknown"] = F.when(fields.isNull(), 0).otherwise(X.unknown_fields(fields, X.EDGE_FIELDS))
        numbers["bad_weight"] = as_number(X.member(fields, "weight").isNotNull() & more["weight"].isNull())
        return result(F.lit(False), valid, ends["source"], ends["target"], more["label"]["text"], more["weight"],
                      more["properties"]["properties"], _counts(**numbers))

    def usual(s):
        weight = s["weight"]
        return s.isNotNull() & (weight.isNull() | (F.try_variant_get(weight, "$", "double") <= limits.weight))

    return _let(F.when(fine, _opened(v, "source", "target", "label", also=",weight:variant")), lambda s: F.when(
        usual(s), plain(s)).otherwise(_let(X.fields_of(v), parts)))


# -------------------------------------------------------------------- repair
def _cleaned(payloads: DataFrame, limits: GraphLimits) -> DataFrame:
    """Payloads with ``_nodes``, ``_edges`` (every one within the cap, cleaned) and ``_metadata``, still unlinked."""
    repairable = F.col("reason").isNull()
    nodes, edges, metadata = F.col("_raw_nodes"), F.col("_raw_edges"), F.col("_raw_metadata")
    heads = (with_budget(payloads, limits)
             .withColumns({"_raw_nodes": F.when(repairable, _list("nodes")), "_raw_edges": F.when(repairable, _list("edges")),
                           "_raw_metadata": F.when(repairable, F.try_variant_get("graph", "$.metadata", "variant"))}))
    # One search in the text of an element tells whether it needs repair.
    heads = heads.withColumns({
        "_fine_nodes": F.transform(F.slice(nodes, 1, limits.nodes), lambda v: F.to_json(v).rlike(_clean_node(limits))),
        "_fine_edges": F.transform(F.slice(edges, 1, limits.edges), lambda v: F.to_json(v).rlike(_clean_edge(limits)))})
    fine_nodes, fine_edges = F.col("_fine_nodes"), F.col("_fine_edges")

    # The cap may cut only large objects, and those need repair.  Their key order is read from the text of their
    # element, taken apart once per payload that holds one.
    def some_large(items, fine, cap):
        sizes = F.transform(fine, lambda f, i: F.when(~f, F.size(
            F.try_variant_get(F.get(items, i), "$.properties", "map<string,variant>"))))
        return F.coalesce(F.exists(sizes, lambda n: n > cap), F.lit(False))

    texts = F.from_json("payload_json", "nodes array<string>, edges array<string>, metadata string")
    some = (some_large(nodes, fine_nodes, limits.node_properties) | some_large(edges, fine_edges, limits.edge_properties)
            | F.coalesce(F.size(X.fields_of(metadata)) > limits.metadata_properties, F.lit(False)))
    heads = heads.withColumn("_texts", F.when(some, texts))

    def source(kind, i):
        return F.from_json(F.get(F.col("_texts")[kind], i), "properties string")["properties"]

    return heads.withColumns({
        "_nodes": F.transform(F.slice(nodes, 1, limits.nodes), lambda v, i: _node(
            v, i, F.get(fine_nodes, i), source("nodes", i), limits)),
        "_edges": F.transform(F.slice(edges, 1, limits.edges), lambda v, i: _edge(
            v, i, F.get(fine_edges, i), source("edges", i), limits)),
        "_metadata": F.when(repairable, _properties_result(metadata, limits.metadata_properties, F.col("_texts")["metadata"], limits))})


def sealed(df: DataFrame, *columns: str | Column) -> DataFrame:
    """The columns by way of a generator, which a filter above it is not pushed through.

    Pushed below, the filter would hold a second copy of the whole repair.
    """
    return df.select(F.inline_outer(F.array(F.struct(*columns))))


def repair_graphs(payloads: DataFrame, limits: GraphLimits, seal: bool = True) -> DataFrame:
    """All payloads with ``status``, ``reason``, ``nodes``, ``edges``,
    ``metadata`` and one ``n_<action>`` column per repair action.

    status: accepted, skipped (no node left), quarantined, or absent.
    ``edges`` holds every edge looked at with the test it stopped at; nodes
    holds kept nodes.

    With ``seal``, filters on the result do not repeat the repair, but all columns are made.  Without it, columns that
    nobody reads are not made; seal those that are filtered.  The functions below do so.
    """
    repairable = F.col("reason").isNull()
    # Edges are tested against the nodes of their payload and against each other.
    edges, marks, stages = F.col("_edges"), F.col("_marks"), F.col("_stages")

    def mark(e):
        known = e["valid"] & ~F.array_contains("_unknown", e["source"]) & ~F.array_contains("_unknown", e["target"])
        # No control character can occur in any part, so the key is unambiguous.
        return F.when(known, F.concat_ws("\u0001", e["source"], e["target"], F.coalesce(e["label"], F.lit(""))))

    def stage(e, i):
        m = F.get(marks, i)
        first = ~F.col("_repeats") | (F.array_position(marks, m) == i + 1)
        return F.when(~e["valid"], "invalid").when(m.isNull(), "dangling").when(first, "kept").otherwise("duplicate")

    def staged(e, i):
        s = F.get(stages, i)
        return F.struct(s.alias("stage"), *(e[c].alias(c) for c in ("fine", "pos", "source", "target", "label", "properties", "n")),
                        F.when(s == "kept", e["weight"]).alias("weight"))

    ends = F.array_compact(F.concat(F.col("_edges.source"), F.col("_edges.target")))
    linked = (_cleaned(payloads, limits)
              .withColumn("nodes", F.filter("_nodes", lambda n: n["valid"]))
              .withColumn("_unknown", F.array_except(ends, F.col("nodes.id")))
              .withColumn("_marks", F.transform(edges, mark))
              .withColumn("_repeats", F.size(F.array_distinct(F.array_compact(marks))) < F.size(F.array_compact(marks)))
              .withColumn("_stages", F.transform(edges, stage))
              .withColumn("edges", F.transform(edges, staged))
              # Only elements that were taken apart have something to count.
              .withColumns({"_bad_nodes": F.filter("_nodes", lambda n: ~n["fine"]), "_bad_edges": F.filter("edges", lambda e: ~e["fine"])}))

    def of_nodes(field):
        return F.coalesce(F.aggregate("_bad_nodes", F.lit(0), lambda acc, e: acc + e["n"][field]), F.lit(0))

    def of_edges(field, *wanted):
        return F.coalesce(F.aggregate("_bad_edges", F.lit(0), lambda acc, e: acc + (
            F.when(e["stage"].isin(*wanted), e["n"][field]).otherwise(0) if wanted else e["n"][field])), F.lit(0))

    def of_metadata(field):
        return F.coalesce(F.col("_metadata")[field], F.lit(0))

    def stopped(name):
        return F.coalesce(F.size(F.filter("_stages", lambda s: s == name)), F.lit(0))

    def excess(kind, cap):
        return F.coalesce(F.greatest(F.size(f"_raw_{kind}") - cap, F.lit(0)), F.lit(0))

    text = {c: of_nodes(c) + of_edges(c, "kept", "duplicate") for c in TEXT_COUNTS}
    prop = {c: of_nodes(c) + of_edges(c, "kept") + of_metadata(c) for c in PROPERTY_COUNTS[1:]}
    unknown_top = F.when(repairable, X.unknown_fields(X.fields_of(F.col("graph")), X.GRAPH_FIELDS)).otherwise(0)
    numbers = {
        "defaulted_edges": as_number(repairable & F.col("_raw_edges").isNull()),
        # Missing metadata is defaulted as well, other missing properties are fine.
        "defaulted_metadata": as_number(repairable & F.col("_metadata.properties").isNull()),
        "defaulted_nodes": as_number(repairable & F.col("_raw_nodes").isNull()), "dropped_blank_text": text["blank"],
        "dropped_dangling_edge": stopped("dangling"), "dropped_duplicate_edge": stopped("duplicate"),
        "dropped_excess_edge": excess("edges", limits.edges), "dropped_excess_node": excess("nodes", limits.nodes),
        "dropped_excess_property": prop["excess"], "dropped_excess_property_item": prop["excess_item"],
        "dropped_invalid_edge": stopped("invalid"),
        "dropped_invalid_node": F.coalesce(F.size("_nodes") - F.size("nodes"), F.lit(0)),
        "dropped_invalid_properties": of_nodes("bad_properties") + of_edges("bad_properties", "kept"),
        "dropped_invalid_property": prop["bad"],
        "dropped_invalid_property_item": prop["bad_item"], "dropped_invalid_weight": of_edges("bad_weight", "kept"),
        "dropped_non_text": text["non_text"], "dropped_unknown_field": of_nodes("unknown") + of_edges("unknown") + unknown_top,
        "normalized_text": text["normalized"] + prop["prop_normalized"],
        "truncated_text": text["truncated"] + prop["prop_truncated"],
    }
    has_node = F.coalesce(F.size("nodes") > 0, F.lit(False))
    status = (F.when(F.col("reason") == "absent", "absent").when(F.col("reason").isNotNull(), "quarantined")
              .when(has_node, "accepted").otherwise("skipped"))

    def listed(name):
        return F.coalesce(F.col(name), F.array())

    done = (
        *KEYS, status.alias("status"), F.coalesce("reason", F.when(~has_node, "no_nodes")).alias("reason"),
        listed("nodes").alias("nodes"), listed("edges").alias("edges"),
        F.coalesce("_metadata.properties", F.create_map().cast("map<string,variant>")).alias("metadata"),
        *(numbers[a].cast("bigint").alias(f"n_{a}") for a in ACTIONS))
    return sealed(linked, *done) if seal else linked.select(*done)


def payload_status(payloads: DataFrame, limits: GraphLimits) -> DataFrame:
    """payload_id, source_agent_id, status and reason of each payload, as
    ``repair_graphs`` gives them, without the repair: a payload is accepted if
    some node within the cap has an id and a label, which its row alone tells.
    """
    def usable(node):
        # Read from the node in place: its other fields are not taken out.
        id, label = (_field(node, c, "variant") for c in ("id", "label"))
        return (X.is_identifier(X.text_of(id), limits.id_chars)
                & F.coalesce(X.squeezed(X.text_of(label)) != "", F.lit(False)))

    reason = F.col("reason")
    has_node = F.coalesce(F.exists(F.slice(_list("nodes"), 1, limits.nodes), usable), F.lit(False))
    return with_budget(payloads, limits).withColumn("_usable", F.when(reason.isNull(), has_node)).select(
        "payload_id", "source_agent_id",
        F.when(reason == "absent", "absent").when(reason.isNotNull(), "quarantined")
        .when(F.col("_usable"), "accepted").otherwise("skipped").alias("status"),
        F.coalesce(reason, F.when(~F.col("_usable"), "no_nodes")).alias("reason"))


# ------------------------------------------------------------------- results
# Rows are taken out with the outer form of explode and filtered afterwards.
# The inner form would infer a filter on the array, which the optimizer pushes
# down through the repair and so evaluates the repair twice.
def kept_nodes(repaired: DataFrame) -> DataFrame:
    return repaired.select("payload_id", F.explode_outer("nodes").alias("n")).filter("n IS NOT NULL").select(
        "payload_id", *(f"n.{c}" for c in ("pos", "id", "label", "type", "description", "properties")))


def node_properties(repaired: DataFrame) -> DataFrame:
    return (kept_nodes(repaired).select("payload_id", "pos", F.explode_outer("properties").alias("key", "value"))
            .filter(F.col("key").isNotNull()))


def staged_edges(repaired: DataFrame) -> DataFrame:
    """Every edge looked at, with the test it stopped at."""
    return repaired.select("payload_id", F.explode_outer("edges").alias("e")).filter("e IS NOT NULL").select(
        "payload_id", *(f"e.{c}" for c in ("pos", "stage", "source", "target", "label", "weight", "properties")))


def linked_edges(repaired: DataFrame) -> DataFrame:
    """Edges between two kept nodes, duplicates included."""
    return staged_edges(repaired).filter(F.col("stage").isin("kept", "duplicate"))


def kept_edges(repaired: DataFrame) -> DataFrame:
    """The first edge per source, target and label, in input order."""
    return staged_edges(repaired).filter(F.col("stage") == "kept")


def repair_counts(repaired: DataFrame) -> DataFrame:
    """One row per payload and action that occurred."""
    rows = F.array(*(F.struct(F.lit(a).alias("action"), F.col(f"n_{a}").alias("n")) for a in ACTIONS))
    return repaired.select("payload_id", F.inline(rows)).filter("n > 0")


def repair_totals(repaired: DataFrame) -> DataFrame:
    """Repairs per agent and action over the whole table."""
    sums = repaired.groupBy("source_agent_id").agg(*(F.sum(f"n_{a}").alias(f"n_{a}") for a in ACTIONS))
    return repair_counts(sums.withColumnRenamed("source_agent_id", "payload_id")).withColumnRenamed(
        "payload_id", "source_agent_id")


def unknown_field_counts(repaired: DataFrame) -> DataFrame:
    return sealed(repaired, "payload_id", F.col("n_dropped_unknown_field").alias("n")).filter("n > 0")


def quarantine(repaired: DataFrame) -> DataFrame:
    return repaired.select("payload_id", "source_agent_id", "status", "reason")


def artifacts(repaired: DataFrame, schema_version: int, title_chars: int = 160,
              id_chars: int = 256) -> DataFrame:
    """JSON envelopes of accepted payloads; optional fields only if usable."""
    def usable(text, longest):
        return F.when(text.rlike(X.VISIBLE) & (F.length(text) <= longest), text)

    def element(names):
        return lambda e: F.struct(*(e[n].alias(n) for n in names))

    graph = F.struct(
        F.transform("nodes", element(X.NODE_FIELDS)).alias("nodes"),
        F.transform(F.filter("edges", lambda e: e["stage"] == "kept"), element(X.EDGE_FIELDS)).alias("edges"),
        F.col("metadata"))
    title = X.text_of(F.try_element_at("metadata", F.lit("title")))
    envelope = F.struct(
        F.lit(schema_version).alias("schemaVersion"), F.col("payload_id").alias("artifactId"),
        F.col("source_agent_id").alias("sourceAgentId"), graph.alias("graph"),
        usable(F.col("anchor_message_id"), id_chars).alias("anchorMessageId"),
        usable(F.col("run_id"), id_chars).alias("runId"), usable(title, title_chars).alias("title"))
    needed = sealed(repaired, *KEYS, "status", "nodes", "edges", "metadata")
    return (needed.filter(F.col("status") == "accepted")
            .select("payload_id", F.to_json(envelope).alias("artifact")))

"""Registered queries over graph payloads, one per row of ``orders``.

The SQL counterparts do not parse any JSON: they state per defect class
(``m = o_orderkey % 20``, see the adapter) what the repair has to give.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from mileglass.functions import cleaning as X
from mileglass.functions.cleaning import GraphLimits
from mileglass.operators import graphs as G
from mileglass.sources.adapters import order_payloads
from mileglass.sources.tables import driver_table

LIMITS = GraphLimits(
    payload_bytes=1200, nodes=5, edges=4, id_chars=20, label_chars=20, type_chars=10,
    description_chars=40, node_properties=4, edge_properties=4, metadata_properties=4,
    property_key_chars=10, property_string_chars=30, property_array_items=4, weight=8.0)
TEXT_LIMIT = 60


def _repaired(spark, sf_dir):
    return G.repair_graphs(order_payloads(spark, sf_dir), LIMITS, seal=False)


def _budget(spark, sf_dir):
    checked = G.with_budget(order_payloads(spark, sf_dir), LIMITS)
    return checked.select("payload_id", (F.col("reason").isNull() | (F.col("reason") == "not_object"))
                          .alias("within_budget"))


def _explode(spark, sf_dir):
    payloads = order_payloads(spark, sf_dir)
    both = [G.explode_elements(payloads, kind, LIMITS).select("payload_id", F.lit(kind).alias("kind"), "pos")
            for kind in ("nodes", "edges")]
    return both[0].unionByName(both[1])


def _identifiers(spark, sf_dir):
    raw = G.explode_elements(order_payloads(spark, sf_dir), "nodes", LIMITS)
    text = X.text_of(F.try_variant_get("element", "$.id", "variant"))
    return raw.select("payload_id", "pos", X.is_identifier(text, LIMITS.id_chars).alias("valid"))


def _clean_text(spark, sf_dir):
    talk = driver_table(spark, sf_dir, "documents").select("doc_id", "text")
    return G.clean_text(talk, "clean", "text", TEXT_LIMIT, is_variant=False).drop("text", "clean_non_text")


def _clean_scalar(spark, sf_dir):
    event = driver_table(spark, sf_dir, "events")
    key = F.col("event_id")
    value = (F.when(key % 5 == 0, F.col("value").cast("variant"))
             .when(key % 5 == 1, F.concat(F.col("event_type"), F.lit("\t "), F.col("event_type")).cast("variant"))
             .when(key % 5 == 2, F.parse_json("props"))
             .when(key % 5 == 3, F.parse_json(F.lit("null")))
             .otherwise(F.lit(" ").cast("variant")))
    v = event.select("event_id", value.alias("v")).withColumn("kind", F.schema_of_variant("v"))
    out = v.withColumn("c", X.clean_scalar(F.col("v"), F.col("kind"), 10))
    return out.select("event_id", "c.kept", X.text_of(F.col("c.value")).alias("text"),
                      "c.normalized", "c.truncated")


def _nodes(spark, sf_dir):
    return G.kept_nodes(_repaired(spark, sf_dir)).withColumn(
        "n_properties", F.when(F.col("properties").isNotNull(), F.size("properties"))).drop("properties")


def _properties(spark, sf_dir):
    rows = G.node_properties(_repaired(spark, sf_dir))
    value = F.col("value")
    return rows.select(
        "payload_id", "pos", "key", X.text_of(value).alias("text_value"),
        F.when(X.is_finite(value), F.try_variant_get(value, "$", "double")).alias("number_value"),
        F.size(X.items_of(value)).alias("n_items"), "value").withColumn(
        "n_items", F.when(F.col("n_items") >= 0, F.col("n_items"))).withColumn(
        "list_value", F.when(X.items_of(value).isNotNull(), F.to_json(value))).drop("value")


def _edge_rows(edges):
    return edges.select("payload_id", "pos", "source", "target", "label")


def _weights(spark, sf_dir):
    return G.kept_edges(_repaired(spark, sf_dir)).select(
        "payload_id", "pos", F.try_variant_get("weight", "$", "double").alias("weight"))


def _artifacts(spark, sf_dir):
    text = F.col("artifact")
    graph = F.try_parse_json(text)

    def listed(name, fields, line):
        items = F.try_variant_get(graph, f"$.graph.{name}", f"array<struct<{','.join(f'{c}:string' for c in fields)}>>")
        return [F.size(items).alias(f"n_{name}"), F.array_join(F.transform(items, line), ";").alias(name)]

    def known(value):
        return F.coalesce(value, F.lit(""))

    return G.artifacts(_repaired(spark, sf_dir), 1).select(
        "payload_id",
        *(F.get_json_object(text, f"$.{c}").alias(n) for c, n in (
            ("schemaVersion", "schema_version"), ("artifactId", "artifact_id"), ("sourceAgentId", "agent_id"),
            ("anchorMessageId", "anchor_id"), ("runId", "run_id"), ("title", "title"))),
        *listed("nodes", ("id", "label", "type"), lambda n: F.concat(n["id"], F.lit("="), n["label"], F.lit("/"), known(n["type"]))),
        *listed("edges", ("source", "target", "label", "weight"), lambda e: F.concat(
            e["source"], F.lit(">"), e["target"], F.lit("="), known(e["label"]), F.lit("/"), known(e["weight"]))))


QUERIES = {
    "graph_budget": _budget,
    "graph_explode": _explode,
    "graph_cap": lambda s, d: G.element_counts(order_payloads(s, d), LIMITS),
    "valid_identifier": _identifiers,
    "graph_clean_nodes": _nodes,
    "clean_text": _clean_text,
    "clean_scalar": _clean_scalar,
    "graph_drop_dangling": lambda s, d: _edge_rows(G.linked_edges(_repaired(s, d))),
    "graph_dedupe_edges": lambda s, d: _edge_rows(G.kept_edges(_repaired(s, d))),
    "graph_edge_weight": _weights,
    "graph_clean_properties": _properties,
    "graph_unknown_fields": lambda s, d: G.unknown_field_counts(_repaired(s, d)),
    "graph_repair_counts": lambda s, d: G.repair_counts(_repaired(s, d)),
    "graph_repair_totals": lambda s, d: G.repair_totals(_repaired(s, d)),
    "graph_quarantine": lambda s, d: G.payload_status(order_payloads(s, d), LIMITS),
    "graph_artifacts": _artifacts,
}

# ---------------------------------------------------------------- SQL pieces
_BASE = """
p AS (SELECT o_orderkey AS k, o_orderkey % 20 AS m, 'inv' || o_orderkey AS payload_id,
             'agent' || (o_orderkey % 3) AS source_agent_id, o_custkey, o_orderstatus, o_totalprice,
             o_orderpriority, 'o' || o_orderkey AS o, 'c' || o_custkey AS c, 's' || o_orderstatus AS s
      FROM orders),
-- the number of raw nodes and edges; NULL where there is no list
sized AS (SELECT *, CASE WHEN m < 18 THEN CASE m WHEN 11 THEN 5 WHEN 12 THEN 6 ELSE 3 END END AS raw_nodes,
                    CASE WHEN m < 18 THEN CASE m WHEN 15 THEN 3 WHEN 16 THEN 4 WHEN 12 THEN 5 ELSE 2 END END AS raw_edges
          FROM p),
graphs AS (SELECT * FROM sized WHERE m < 18)"""

_LINKED = """,
-- edges between kept nodes with their position and label
linked AS (
  SELECT payload_id, k, m, 0 AS pos, c AS source, o AS target, 'placed' AS label FROM graphs WHERE m <> 9
  UNION ALL SELECT payload_id, k, m, 1, o, s, NULL FROM graphs
  UNION ALL SELECT payload_id, k, m, 2, c, o, 'placed' FROM graphs WHERE m = 15
  UNION ALL SELECT payload_id, k, m, 2 + i, o, s, NULL FROM graphs, range(2) AS r(i) WHERE m = 12),
kept AS (SELECT * FROM linked WHERE pos < 2)"""

_NODES = """,
kept_nodes AS (
  SELECT payload_id, k, m, 0 AS pos, o AS id, 'order ' || k AS label, CASE WHEN m <> 1 THEN 'order' END AS type,
         CASE m WHEN 4 THEN 3 WHEN 5 THEN 4 WHEN 6 THEN 4 ELSE 2 END AS n_properties FROM graphs
  UNION ALL
  SELECT payload_id, k, m, 1, c, CASE m WHEN 7 THEN 'customer no ' || o_custkey WHEN 8 THEN 'a customer whose la…'
         ELSE 'customer ' || o_custkey END, NULL, NULL FROM graphs WHERE m <> 9
  UNION ALL SELECT payload_id, k, m, 2, s, 'status', NULL, NULL FROM graphs
  UNION ALL SELECT payload_id, k, m, 3 + i, 'x' || (1 + i), 'x', NULL, NULL FROM graphs, range(2) AS r(i) WHERE m = 12)"""

_COUNTS = [
    ("m = 1 OR m = 9", "dropped_blank_text", 1), ("m = 2", "dropped_non_text", 1),
    ("m = 3", "dropped_unknown_field", 1), ("m = 4", "dropped_excess_property_item", 2),
    ("m = 4", "dropped_invalid_property", 2), ("m = 4", "dropped_invalid_property_item", 1),
    ("m = 5", "normalized_text", 2), ("m = 5", "truncated_text", 1), ("m = 6", "dropped_excess_property", 2),
    ("m = 7", "normalized_text", 1), ("m = 8", "truncated_text", 1),
    ("m = 9 OR m = 16", "dropped_dangling_edge", 1), ("m = 9", "dropped_invalid_node", 1),
    ("m = 10", "dropped_invalid_properties", 1), ("m = 11", "dropped_invalid_node", 2),
    ("m = 12", "dropped_excess_node", 1), ("m = 12", "dropped_excess_edge", 1),
    ("m = 12", "dropped_duplicate_edge", 2), ("m = 13 OR m = 14", "dropped_invalid_weight", 1),
    ("m < 18 AND k % 10 = 9 AND m <> 9", "dropped_invalid_weight", 1),
    ("m = 15", "dropped_duplicate_edge", 1), ("m = 16", "dropped_invalid_edge", 1),
    ("m = 17 OR k % 60 = 19", "defaulted_metadata", 1), ("k % 60 = 19", "defaulted_nodes", 1),
    ("k % 60 = 19", "defaulted_edges", 1), ("k % 60 = 19", "dropped_unknown_field", 1),
]
_REPAIRS = ", repairs AS (SELECT payload_id, source_agent_id, action, sum(n)::BIGINT AS n FROM (" + " UNION ALL ".join(
    f"SELECT payload_id, source_agent_id, '{a}' AS action, {n} AS n FROM p WHERE {c}" for c, a, n in _COUNTS) + (
    ") AS u GROUP BY ALL)")

# The gap pattern of the clean-up, spelled out for an engine whose \s is ASCII.
_GAPS = (r"[\x00-\x20\x7f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+")

_TEXT_SQL = f"""
WITH t AS (SELECT doc_id, text,
                  trim(regexp_replace(text, '{_GAPS}', ' ', 'g')) AS short,
                  length(text) <= {TEXT_LIMIT} AND NOT regexp_matches(text, '[\\x00-\\x1f\\x7f]') AS fine FROM documents),
     u AS (SELECT *, fine AND short <> '' AS same, short = '' AS blank, length(short) > {TEXT_LIMIT} AS long FROM t)
SELECT doc_id,
       CASE WHEN same THEN text WHEN blank THEN NULL
            WHEN long THEN rtrim(substring(short, 1, {TEXT_LIMIT - 1})) || '…' ELSE short END AS clean,
       CAST(NOT same AND blank AS INTEGER) AS clean_blank,
       CAST(NOT same AND NOT blank AND short <> text AS INTEGER) AS clean_normalized,
       CAST(NOT same AND NOT blank AND long AS INTEGER) AS clean_truncated
FROM u"""

ORACLES = {
    "graph_budget": """SELECT 'inv' || o_orderkey AS payload_id,
        o_orderkey % 20 <> 18 AND o_orderkey % 60 <> 59 AS within_budget FROM orders""",
    "graph_explode": f"""WITH {_BASE} SELECT payload_id, 'nodes' AS kind, CAST(i AS INTEGER) AS pos
        FROM graphs, range(6) AS r(i) WHERE i < raw_nodes
        UNION ALL SELECT payload_id, 'edges', CAST(i AS INTEGER) FROM graphs, range(6) AS r(i) WHERE i < raw_edges""",
    "graph_cap": f"""WITH {_BASE}, objects AS (SELECT * FROM sized WHERE m < 18 OR k % 60 = 19),
        kinds AS (SELECT payload_id, 'nodes' AS kind, raw_nodes AS n, 5 AS cap FROM objects
                  UNION ALL SELECT payload_id, 'edges', raw_edges, 4 FROM objects)
        SELECT payload_id, kind, n IS NULL AS defaulted, least(coalesce(n, 0), cap) AS kept,
               greatest(coalesce(n, 0) - cap, 0) AS excess FROM kinds""",
    "valid_identifier": f"""WITH {_BASE} SELECT payload_id, CAST(i AS INTEGER) AS pos, NOT (m = 11 AND i >= 3) AS valid
        FROM graphs, range(6) AS r(i) WHERE i < raw_nodes""",
    "graph_clean_nodes": f"""WITH {_BASE}{_NODES} SELECT payload_id, CAST(pos AS INTEGER) AS pos, id, label, type,
        CAST(NULL AS VARCHAR) AS description, n_properties FROM kept_nodes""",
    "clean_text": _TEXT_SQL,
    "clean_scalar": """WITH e AS (SELECT event_id, event_id % 5 AS m, event_type || ' ' || event_type AS short FROM events)
        SELECT event_id, m <> 2 AS kept, CASE WHEN m = 1 THEN CASE WHEN length(short) > 10
                    THEN rtrim(substring(short, 1, 9)) || '…' ELSE short END WHEN m = 4 THEN ' ' END AS text,
               CAST(m = 1 AS INTEGER) AS normalized, CAST(m = 1 AND length(short) > 10 AS INTEGER) AS truncated FROM e""",
    "graph_drop_dangling": f"""WITH {_BASE}{_LINKED}
        SELECT payload_id, CAST(pos AS INTEGER) AS pos, source, target, label FROM linked""",
    "graph_dedupe_edges": f"""WITH {_BASE}{_LINKED}
        SELECT payload_id, CAST(pos AS INTEGER) AS pos, source, target, label FROM kept""",
    "graph_edge_weight": f"""WITH {_BASE}{_LINKED} SELECT payload_id, CAST(pos AS INTEGER) AS pos,
        CASE WHEN pos = 0 AND m NOT IN (13, 14) AND k % 10 <= 8 THEN CAST(k % 10 AS DOUBLE) END AS weight FROM kept""",
    "graph_clean_properties": f"""WITH {_BASE}, props AS (
        SELECT payload_id, 'total' AS key, NULL AS text_value, o_totalprice AS number_value, NULL AS n_items FROM graphs
        UNION ALL SELECT payload_id, 'priority', o_orderpriority, NULL, NULL FROM graphs
        UNION ALL SELECT payload_id, 'tags', NULL, NULL, 3 FROM graphs WHERE m = 4
        UNION ALL SELECT payload_id, 'note', 'two words', NULL, NULL FROM graphs WHERE m = 5
        UNION ALL SELECT payload_id, 'long', 'abcdefghijklmnopqrstuvwxyz012…', NULL, NULL FROM graphs WHERE m = 5
        UNION ALL SELECT payload_id, 'p' || (i + 1), NULL, i + 1.0, NULL FROM graphs, range(2) AS r(i) WHERE m = 6)
        SELECT payload_id, 0 AS pos, key, text_value, CAST(number_value AS DOUBLE) AS number_value,
               CAST(n_items AS INTEGER) AS n_items, CASE WHEN n_items = 3 THEN '["a",true,null]' END AS list_value FROM props""",
    "graph_unknown_fields": f"""WITH {_BASE}{_REPAIRS} SELECT payload_id, n FROM repairs
        WHERE action = 'dropped_unknown_field'""",
    "graph_repair_counts": f"WITH {_BASE}{_REPAIRS} SELECT payload_id, action, n FROM repairs",
    "graph_repair_totals": f"""WITH {_BASE}{_REPAIRS} SELECT source_agent_id, action, sum(n)::BIGINT AS n
        FROM repairs GROUP BY source_agent_id, action""",
    "graph_quarantine": f"""WITH {_BASE} SELECT payload_id, source_agent_id,
        CASE WHEN m < 18 THEN 'accepted' WHEN k % 40 = 18 THEN 'absent' WHEN k % 60 = 19 THEN 'skipped'
             ELSE 'quarantined' END AS status,
        CASE WHEN m < 18 THEN NULL WHEN k % 40 = 18 THEN 'absent' WHEN m = 18 THEN 'not_json'
             WHEN k % 60 = 19 THEN 'no_nodes' WHEN k % 60 = 39 THEN 'not_object' ELSE 'over_budget' END AS reason FROM p""",
    "graph_artifacts": f"""WITH {_BASE}{_LINKED}{_NODES},
        e AS (SELECT payload_id, count(*) AS n_edges, string_agg(source || '>' || target || '=' || coalesce(label, '') || '/'
                  || CASE WHEN pos = 0 AND m NOT IN (13, 14) AND k % 10 <= 8 THEN CAST(k % 10 AS VARCHAR) ELSE '' END, ';' ORDER BY pos) AS edges
              FROM kept GROUP BY 1),
        n AS (SELECT payload_id, count(*) AS n_nodes,
                     string_agg(id || '=' || label || '/' || coalesce(type, ''), ';' ORDER BY pos) AS nodes FROM kept_nodes GROUP BY 1)
        SELECT payload_id, '1' AS schema_version, payload_id AS artifact_id, source_agent_id AS agent_id,
               CASE WHEN k % 7 <> 0 THEN 'msg' || k END AS anchor_id, CASE WHEN k % 5 <> 0 THEN 'run' || (k % 100) END AS run_id,
               CASE WHEN m <> 17 THEN 'order ' || k END AS title, CAST(n_nodes AS INTEGER) AS n_nodes, nodes,
               CAST(n_edges AS INTEGER) AS n_edges, edges FROM graphs JOIN e USING (payload_id) JOIN n USING (payload_id)""",
}

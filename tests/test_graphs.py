"""One hand-made payload per repair action and per admission outcome."""

import json

import pytest

from mileglass.functions.cleaning import GraphLimits
from mileglass.operators import graphs as G

LIMITS = GraphLimits(
    payload_bytes=600, nodes=3, edges=3, id_chars=6, label_chars=8, type_chars=8, description_chars=12,
    node_properties=2, edge_properties=1, metadata_properties=2, property_key_chars=5,
    property_string_chars=6, property_array_items=3, weight=10.0)

A, B = {"id": "a", "label": "A"}, {"id": "b", "label": "B"}
AB = {"source": "a", "target": "b"}


def graph(nodes=(A, B), edges=(), metadata=None, **extra):
    return {"nodes": list(nodes), "edges": list(edges), "metadata": {} if metadata is None else metadata, **extra}


def node(**fields):
    return graph([{**A, **fields}, B])


def edge(**fields):
    return graph(edges=[{**AB, **fields}])


CASES = {
    "clean": (graph(edges=[AB]), {}),
    "unknown at each level": (graph([{**A, "x": 1, "y": 2}, B], [{**AB, "z": 1}], w=1), {"dropped_unknown_field": 4}),
    "no lists": ({"nodes": {}, "edges": None}, {"defaulted_nodes": 1, "defaulted_edges": 1, "defaulted_metadata": 1}),
    "missing lists": ({}, {"defaulted_nodes": 1, "defaulted_edges": 1, "defaulted_metadata": 1}),
    "metadata list": (graph(metadata=[1]), {"defaulted_metadata": 1}),
    # The cap comes before validity, so the bad fourth node is only in excess.
    "excess nodes": (graph([A, B, {"id": "c", "label": "C"}, 7, 8]), {"dropped_excess_node": 2}),
    "excess edges": (graph(edges=[AB, {**AB, "label": "x"}, {**AB, "label": "y"}, 5]), {"dropped_excess_edge": 1}),
    "node not object": (graph([A, 5]), {"dropped_invalid_node": 1}),
    "node null": (graph([A, None]), {"dropped_invalid_node": 1}),
    "node id number": (graph([A, {"id": 1, "label": "x"}]), {"dropped_invalid_node": 1}),
    "node id blank": (graph([A, {"id": " ", "label": "x"}]), {"dropped_invalid_node": 1}),
    "node id long": (graph([A, {"id": "1234567", "label": "x"}]), {"dropped_invalid_node": 1}),
    "node id control": (graph([A, {"id": "a\u0007", "label": "x"}]), {"dropped_invalid_node": 1}),
    "invalid node with extras": (graph([A, {"id": "", "q": 1}]), {"dropped_invalid_node": 1, "dropped_unknown_field": 1}),
    "no label": (graph([A, {"id": "c"}]), {"dropped_invalid_node": 1, "dropped_non_text": 1}),
    "blank label": (graph([A, {"id": "c", "label": "  \t"}]), {"dropped_invalid_node": 1, "dropped_blank_text": 1}),
    "edge not object": (graph(edges=["x"]), {"dropped_invalid_edge": 1}),
    "edge without target": (graph(edges=[{"source": "a"}]), {"dropped_invalid_edge": 1}),
    "dangling": (graph(edges=[{"source": "a", "target": "z", "label": 5}]), {"dropped_dangling_edge": 1}),
    "dangling to a dropped node": (graph([A, {"id": "b"}], [AB]),
                                   {"dropped_dangling_edge": 1, "dropped_invalid_node": 1, "dropped_non_text": 1}),
    "duplicate": (graph(edges=[AB, {**AB, "weight": -1, "properties": 1}, {**AB, "label": "x"}]),
                  {"dropped_duplicate_edge": 1}),
    "duplicate after blank label": (graph(edges=[AB, {**AB, "label": " "}]),
                                    {"dropped_duplicate_edge": 1, "dropped_blank_text": 1}),
    "weight negative": (edge(weight=-0.5), {"dropped_invalid_weight": 1}),
    "weight boolean": (edge(weight=True), {"dropped_invalid_weight": 1}),
    "weight text": (edge(weight="1"), {"dropped_invalid_weight": 1}),
    "weight null": (edge(weight=None), {"dropped_invalid_weight": 1}),
    "weight limits": (graph(edges=[{**AB, "weight": 10}, {"source": "b", "target": "a", "weight": 10.5}]),
                      {"dropped_invalid_weight": 1}),
    "edge label": (edge(label="a\nb"), {"normalized_text": 1}),
    "properties number": (node(properties=1), {"dropped_invalid_properties": 1}),
    "properties null": (node(properties=None), {"dropped_invalid_properties": 1}),
    "edge properties": (edge(properties={"k": 1, "j": 2}), {"dropped_excess_property": 1}),
    # Input order is z, y, a; the variant would read a first.
    "excess in input order": (node(properties={"z": 1, "y": 2, "a": 3}), {"dropped_excess_property": 1}),
    "cap counts kept entries": (node(properties={"z": {}, "__proto__": 1, "y": 2, "toolong": 1, "a": 3, "b": 4, "c": {}}),
                                {"dropped_invalid_property": 3, "dropped_excess_property": 2}),
    "excess values are not cleaned": (node(properties={"p": 1, "q": 2, "r": "a\tb"}), {"dropped_excess_property": 1}),
    "metadata excess": (graph(metadata={"c": 1, "b": 2, "a": 3}), {"dropped_excess_property": 1}),
    "property values": (node(properties={"p": {"x": 1}, "q": None}), {"dropped_invalid_property": 1}),
    "property text": (node(properties={"p": "a\t b", "q": "1234567"}), {"normalized_text": 2, "truncated_text": 1}),
    "blank property stays": (node(properties={"p": " "}), {}),
    "array items": (node(properties={"p": [1, [2], {"x": 1}, 4, 5]}),
                    {"dropped_excess_property_item": 2, "dropped_invalid_property_item": 2}),
    "array texts": (node(properties={"p": ["a\n", "1234567"]}), {"normalized_text": 2, "truncated_text": 1}),
    "type number": (node(type=3), {"dropped_non_text": 1}),
    "type null": (node(type=None), {"dropped_non_text": 1}),
    "description blank": (node(description=""), {"dropped_blank_text": 1}),
    "description long": (node(description="words and words"), {"truncated_text": 1}),
    "long and spaced": (node(description=" words  and words "), {"normalized_text": 1, "truncated_text": 1}),
    "emoji count once": (node(label="😀😀😀😀😀😀😀😀"), {}),
}

OUTCOMES = {
    "absent": (None, "absent", "absent"), "null": ("null", "absent", "absent"),
    "text": ("not json", "quarantined", "not_json"), "nan": ('{"nodes":[NaN]}', "quarantined", "not_json"),
    "list": ("[]", "quarantined", "not_object"), "number": ("5", "quarantined", "not_object"),
    "infinite": ('{"nodes":[{"id":"a","label":"A","x":1e400}]}', "quarantined", "non_finite"),
    "large but finite": ('{"nodes":[{"id":"a","label":"1e400"}],"edges":[],"metadata":{"x":1e4}}', "accepted", None),
    "over": (json.dumps(graph(metadata={"p": "x" * 600})), "quarantined", "over_budget"),
    # Blanks between tokens do not count.
    "padded": ('{"nodes":[{"id":"a","label":"A"}],' + " " * 600 + '"edges":[],"metadata":{}}', "accepted", None),
    "empty": ('{"nodes":[],"edges":[],"metadata":{}}', "skipped", "no_nodes"),
    "all bad": ('{"nodes":[1],"edges":[],"metadata":{}}', "skipped", "no_nodes"),
}
COLUMNS = "payload_id string, source_agent_id string, anchor_message_id string, run_id string, payload_json string"


@pytest.fixture(scope="module")
def repaired(spark):
    rows = [(name, "agent", "m1", None, json.dumps(g)) for name, (g, _) in CASES.items()]
    rows += [(name, "agent", "m1", None, text) for name, (text, _, _) in OUTCOMES.items()]
    return G.repair_graphs(spark.createDataFrame(rows, COLUMNS), LIMITS).cache()


@pytest.fixture(scope="module")
def counts(repaired):
    found = {}
    for r in G.repair_counts(repaired).collect():
        found.setdefault(r.payload_id, {})[r.action] = r.n
    return found


@pytest.fixture(scope="module")
def graphs(repaired):
    return {r.payload_id: json.loads(r.artifact) for r in G.artifacts(repaired, 1).collect()}


@pytest.mark.parametrize("name", CASES)
def test_counts(counts, name):
    assert counts.get(name, {}) == CASES[name][1]


@pytest.mark.parametrize("name", OUTCOMES)
def test_outcomes(repaired, name):
    row = G.quarantine(repaired).filter(f"payload_id = '{name}'").first()
    assert (row.status, row.reason) == OUTCOMES[name][1:]


def test_every_action_is_covered():
    assert {a for _, want in CASES.values() for a in want} == set(G.ACTIONS)


def test_repaired_values(graphs):
    def first(name):
        return graphs[name]["graph"]["nodes"][0]
    assert graphs["clean"]["graph"] == {"nodes": [A, B], "edges": [AB], "metadata": {}}
    assert first("excess in input order")["properties"] == {"z": 1, "y": 2}
    assert first("cap counts kept entries")["properties"] == {"y": 2, "a": 3}
    assert first("property values")["properties"] == {"q": None}
    assert first("property text")["properties"] == {"p": "a b", "q": "12345…"}
    assert first("array items")["properties"] == {"p": [1]}
    assert first("blank property stays")["properties"] == {"p": " "}
    assert first("description long")["description"] == "words and w…"
    assert first("long and spaced")["description"] == "words and w…"
    assert "type" not in first("type null") and "properties" not in first("properties null")
    assert graphs["metadata excess"]["graph"]["metadata"] == {"c": 1, "b": 2}
    assert graphs["weight limits"]["graph"]["edges"] == [{**AB, "weight": 10}, {"source": "b", "target": "a"}]
    assert [e.get("label") for e in graphs["duplicate"]["graph"]["edges"]] == [None, "x"]
    assert graphs["edge label"]["graph"]["edges"][0]["label"] == "a b"


def test_envelope_fields(spark):
    roomy = GraphLimits(**{**LIMITS.__dict__, "payload_bytes": 5000, "property_string_chars": 400})

    def row(name, title, anchor="m", run="r"):
        return (name, "agent", anchor, run, json.dumps(graph(metadata={"title": title})))
    rows = [row("t160", "x" * 160), row("t161", "x" * 161), row("number", 5), row("blank", " "),
            row("anchor", "t", "y" * 257, " ")]
    got = {r.payload_id: json.loads(r.artifact) for r in G.artifacts(
        G.repair_graphs(spark.createDataFrame(rows, COLUMNS), roomy), 3).collect()}
    assert got["t160"]["title"] == "x" * 160 and got["t160"]["schemaVersion"] == 3
    assert all("title" not in got[k] for k in ("t161", "number", "blank"))
    assert "anchorMessageId" not in got["anchor"] and "runId" not in got["anchor"]
    assert (got["t160"]["anchorMessageId"], got["t160"]["runId"]) == ("m", "r")


def test_within_the_row(spark):
    df = spark.createDataFrame([("p", "a", "m", "r", "{}")], COLUMNS)
    repaired = G.repair_graphs(df, LIMITS)
    for result in (G.artifacts(repaired, 1), G.repair_counts(repaired), G.kept_nodes(repaired), G.kept_edges(repaired)):
        plan = result._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Aggregate" not in plan and "Join" not in plan
        # The filter above the repair did not take a second copy of it below.
        assert plan.count("schemaVersion") <= 2 and plan.count("parse_json") <= 4


def test_equal_and_missing_ids_stay_apart(spark):
    graphs = [graph(), {"nodes": [{"id": "z", "label": "Z"}], "edges": [], "metadata": {"k": 1}}]
    rows = [(i, "agent", "m1", "r", json.dumps(g)) for i in ("same", None) for g in graphs for _ in range(2)]
    repaired = G.repair_graphs(spark.createDataFrame(rows, COLUMNS), LIMITS)
    got = sorted((str(r.payload_id), len(r.nodes), len(r.metadata)) for r in repaired.collect())
    assert got == sorted([(i, len(g["nodes"]), len(g["metadata"])) for i in ("same", "None") for g in graphs] * 2)


def test_status_without_repair(spark, repaired):
    rows = [(name, "agent", "m1", None, json.dumps(g)) for name, (g, _) in CASES.items()]
    rows += [(name, "agent", "m1", None, text) for name, (text, _, _) in OUTCOMES.items()]
    status = G.payload_status(spark.createDataFrame(rows, COLUMNS), LIMITS)
    assert "Exchange" not in status._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, status.collect())) == sorted(map(str, G.quarantine(repaired).collect()))


def test_the_last_of_repeated_keys_counts(spark):
    text = '{"nodes":[{"id":"a","label":"A","label":"B","properties":{"p":1,"p":2}}],"edges":[],"metadata":{}}'
    row = G.repair_graphs(spark.createDataFrame([("p", "a", "m", "r", text)], COLUMNS), LIMITS).first()
    assert row.status == "accepted" and row.nodes[0].label == "B"
    assert G.artifacts(G.repair_graphs(spark.createDataFrame([("p", "a", "m", "r", text)], COLUMNS), LIMITS), 1).first().artifact.count('"p":2') == 1


def test_totals(repaired, counts):
    want = {}
    for c in counts.values():
        for a, n in c.items():
            want[a] = want.get(a, 0) + n
    assert {r.action: r.n for r in G.repair_totals(repaired).collect()} == want


def test_only_what_is_read_is_made_and_only_once(spark):
    rows = [(name, "agent", None, None, json.dumps(g)) for name, (g, _) in CASES.items()]
    payloads = spark.createDataFrame(
        rows, "payload_id string, source_agent_id string, anchor_message_id string, run_id string, payload_json string")
    whole, lean = G.repair_graphs(payloads, LIMITS), G.repair_graphs(payloads, LIMITS, seal=False)
    for read in (G.linked_edges, G.unknown_field_counts, lambda r: G.artifacts(r, 1)):
        shown = [read(r).selectExpr("to_json(struct(*)) AS j") for r in (whole, lean)]
        assert sorted(r.j for r in shown[0].collect()) == sorted(r.j for r in shown[1].collect())
        plan = read(lean)._jdf.queryExecution().optimizedPlan().toString()
        assert "n_truncated_text" not in plan and plan.lower().count("parsejson") == 1, plan.lower().count("parsejson")

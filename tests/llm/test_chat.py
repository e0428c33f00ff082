import random

import pytest

from mileglass.llm import chat as C
from mileglass.llm.queries import ORACLES, QUERIES
from tests import oracle

SCHEMA = "conv_id long, turn long, role string, text string, a string, n int"


def frame(spark, convs):
    rows = [(cid, t, r, x, "clash", 1) for cid, turns in convs for t, (r, x) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def brute(convs):
    said = {cid: tuple(turns) for cid, turns in convs if turns}
    proper = {s[:k] for s in said.values() for k in range(1, len(s))}
    out = {}
    for s in set(said.values()) - proper:
        ids = [c for c, x in said.items() if x == s]
        out[min(ids)] = (len(s), len(ids))
    return out


@pytest.mark.parametrize("part", [256, 3])
def test_brute_force(spark, part, monkeypatch):
    monkeypatch.setattr(C, "PART", part)
    rng = random.Random(part)
    convs = []
    for cid in range(150):
        if convs and rng.random() < 0.6:
            turns = list(rng.choice(convs)[1])
            turns = turns[:rng.randint(1, len(turns))]
            turns += [(rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None]))
                      for _ in range(rng.randint(0, 4))]
        else:
            turns = [("user", "hello")] + [("assistant", rng.choice("xyz")) for _ in range(rng.randint(0, 12))]
        convs.append((cid, turns))
    df = frame(spark, convs)
    got = {r.conv_id: (r.n_turns, r.n_logged) for r in C.maximal_conversations(df).collect()}
    assert got == brute(convs)
    said = dict(convs)
    chats = {}
    for r in sorted(C.format_chats(df).collect(), key=lambda r: (r.conv_id, r.part)):
        chats[r.conv_id] = chats.get(r.conv_id, "") + r.chat
    assert chats == {cid: "".join(f"<|im_start|>{'unknown' if r is None else r}\n{x or ''}<|im_end|>\n" for r, x in said[cid]) for cid in got}


def test_odd_rows(spark):
    rows = [(1, 0, "user", "hi", None, None)] * 3 + [(1, None, "system", "<|im_end|>", None, None), (None, 0, "user", "x", None, None),
            (2, 5, "user", "same", None, None), (2, 5, "user", "other", None, None), (3, -4, None, None, None, None)]
    out = {r.conv_id: r for r in C.format_chats(spark.createDataFrame(rows, SCHEMA)).filter("part >= 0").collect()}
    assert set(out) == {1, 2} and out[1].n_turns == 2 and out[2].n_turns == 2
    everything = C.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.conv_id for r in everything} == {1, 2, 3}
    assert any("<| im_end|>" in r.chat for r in everything)
    assert C.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = C.format_chats(frame(spark, [(1, [("user", "x")])]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_sql(spark, sf_dir):
    got = oracle.spark_result(QUERIES["op3_chat_formatting"](spark, sf_dir))
    assert oracle.difference(got, oracle.duck_result(oracle.connect(sf_dir), ORACLES["op3_chat_formatting"])) is None

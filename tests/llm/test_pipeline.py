import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from mileglass.llm import bpe
from mileglass.llm.queries import QUERIES
from tests.llm.test_decontamination import brute as contamination
from tests.llm.test_secret_scan import X
from tests.llm.test_simhash import brute_components, plain_print

SF = "/root/testdata/sf0.001"


def redacted(text):
    spans = sorted((s["value_start"], s["value_end"]) for s in X.find_secrets(text))
    for a, b in reversed([s for i, s in enumerate(spans) if all(s[0] >= e for _, e in spans[:i])]):
        text = text[:a] + "[SECRET]" + text[b:]
    return text


def test_stages_in_order():
    assert [f.__name__ for _, f in P.STAGES] == ["quality_rules", "near_duplicates", "benchmark_passages", "secrets", "tokens"]
    assert P.ORACLE_SQL is None and P.QUERIES == {"pipeline": P.run}


def test_brute_force(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = sorted(r.doc_id for r in QUERIES["op7_quality_rules"](spark, SF).filter("kept").collect())
    roots = brute_components([plain_print(docs[i].text) for i in kept])
    alone = sorted({kept[r] for r in roots})
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = contamination([(i, docs[i].text) for i in alone], items)
    clean = [i for i in alone if not (found[i][1] and 20 * found[i][1] >= found[i][0])]
    library = Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))
    rows = {r.doc_id: r for r in P.run(spark, SF).withColumn("list", bpe.unpacked(F.col("ids"))).collect()}
    assert sorted(rows) == clean and len(clean) < len(alone) < len(kept)
    for i, r in rows.items():
        ids = library.encode(redacted(docs[i].text), add_special_tokens=False).ids
        assert r.list == ids and r.n_tokens == len(ids)
        assert r.decoded == library.decode(ids, skip_special_tokens=False)


def test_stages_keep_the_columns(spark):
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "x" * 5000, "en", "s", 5000)] * 2
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert P.STAGES[-1][1](spark, docs, SF).count() == len(rows)

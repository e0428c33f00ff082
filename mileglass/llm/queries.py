"""The registered queries of this package, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mileglass.llm import alignment as A
from mileglass.llm import bpe as B
from mileglass.llm import chat as C
from mileglass.llm import context_tree as CT
from mileglass.llm import decontamination as D
from mileglass.llm import hard_negatives as H
from mileglass.llm import language as L
from mileglass.llm import personal_data as P
from mileglass.llm import quality as Q
from mileglass.llm import secret_scan as X
from mileglass.llm import simhash as S
from mileglass.llm import token_counts as T
from mileglass.llm import unigrams as W
from mileglass.llm import whole_tree as WT
from mileglass.llm import url_filter as U
from mileglass.llm.text import stored

URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


TOKEN_LIMIT = 4096


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies on the driver; operators take any path."""
    import public_tokenizers
    return public_tokenizers.path(name)


def _fold(parts: int) -> Column:
    """The fold of a document by its id; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % parts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words, items and the verdict of every document against the whole benchmark."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = D.scan_contamination(docs, _table(spark, sf_dir, "benchmark"))
    hits = F.col("contamination")
    return scanned.select("doc_id", hits["n_words"].alias("n_words"), hits["n_hit"].alias("n_hit"),
                          F.size(hits["items"]).cast("long").alias("n_items"),
                          F.sha2(F.array_join(hits["items"], ","), 256).alias("items_sha256"),
                          D.contaminated().alias("contaminated"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = S.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations as training text."""
    return C.format_chats(_table(spark, sf_dir, "conversations"))


OP3_SQL = """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
), whole AS (
  SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY turn) AS said FROM turns GROUP BY conv_id
), prefixes AS (
  SELECT DISTINCT said[1:k] AS said FROM (SELECT said, unnest(range(1, n)) AS k FROM whole)
), kept AS (
  SELECT min(conv_id) AS conv_id, n AS n_turns, count(*) AS n_logged
  FROM whole w WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.said = w.said) GROUP BY said, n
)
SELECT k.conv_id, CAST(floor(t.turn / 256) AS BIGINT) AS part, k.n_turns, k.n_logged,
       string_agg('<|im_start|>' || replace(coalesce(t.role, 'unknown'), '<|im_', '<| im_') || chr(10)
                  || replace(coalesce(t.text, ''), '<|im_', '<| im_') || '<|im_end|>' || chr(10), ''
                  ORDER BY t.turn) AS chat
FROM kept k JOIN turns t USING (conv_id) GROUP BY ALL
"""


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and context-tree scores of every document, learned from nine of ten folds."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    training = _fold(10) != 0
    tree = WT.fit_whole_tree(docs, training)
    scored = W.unigram_scores(docs, training, keep={
        "doc_id": F.col("doc_id"), "held_out": ~training,
        "n_bytes": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"),
    }, beside={"read": (WT.READ, WT.text_reader(tree, spark))})
    scored = WT.with_score(scored, "read", tree)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score",
                         CT.bits_per_byte(F.col("score"), F.col("n_bytes")).alias("bits_per_byte"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document, whether it passes the limit, and the longest prefix within it."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = T.count_tokens(spark, F.col("text"), tokenizer_file("piece_bpe_32k.model"), TOKEN_LIMIT)
    c = F.col("counted")
    return docs.withColumn("counted", counted).select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        c["n_tokens"].alias("n_tokens"), (c["n_tokens"] > TOKEN_LIMIT).alias("over_limit"),
        c["budget_chars"].alias("budget_chars"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the fixed shapes, their digest, and all spans of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", X.scan_secrets(F.col("text")).alias("spans"))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"), count("named"),
                        F.sha2(X.span_list(F.col("spans"), X.KINDS[:3]), 256).alias("base_sha256"),
                        X.span_list(F.col("spans")).alias("spans"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, hard rules and the weakly supervised verdict for every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    # Only the counts are stored, so each text is measured once.
    measured = stored(Q.with_measures(docs).drop("text"), "quality-measures")
    rules = Q.default_rules()
    judged = Q.judge_quality(measured, Q.fit_quality(measured, rules), rules)
    return judged.select("doc_id", *[F.col(f"measures.{c}").alias(c) for c in
                                     ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                         "base_failed", "kept", "quality")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from four of five folds."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = _fold(5) == 0
    model = L.fit_language_model(docs.filter(~held_out).select("text", "lang"))
    found = docs.select("doc_id", held_out.alias("held_out"), L.identify(spark, F.col("text"), model).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, winning rule and verdict of every page."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return (U.filter_urls(pages, U.rule_table(spark, URL_RULES))
            .select("page_id", "host", "path", "rule", "verdict"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text they decode to, as digests."""
    docs, path = _table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file("word_bpe_49k.json")
    done, c = docs.select("doc_id", B.encode_and_decode(spark, F.col("text"), path).alias("bpe")), F.col("bpe")
    return done.select("doc_id", (F.octet_length(c["ids"]) / 4).cast("long").alias("n_tokens"),
                       F.sha2(c["ids"], 256).alias("ids_sha256"), F.sha2(c["decoded"], 256).alias("decoded_sha256"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the fixed shapes, their digest, and all spans of every document, disclosing terms included."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = P.find_personal(docs, keep=["doc_id"])

    def count(kind):
        return F.size(F.filter("personal", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, P.KINDS), F.sha2(P.span_list(F.col("personal"), P.KINDS[:4]), 256).alias("base_sha256"),
                        P.span_list(F.col("personal")).alias("spans"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of byte-level tokens and pieces on the same bytes of every document, and how common their links are."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return A.link_tokens(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector against all vectors."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return H.mine_hard_negatives(rows, F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH rows_ AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id AS id,
         CAST(list_sum(list_transform(list_zip(a.q, r.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM rows_ a JOIN rows_ r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) <= 5
"""

OP9_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
  FROM cut
), rules(rule, rule_host, rule_path, verdict) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
)
SELECT p.page_id, p.host, p.path, max_by(r.rule, length(r.rule)) AS rule,
       coalesce(max_by(r.verdict, length(r.rule)), 'allow') AS verdict
FROM parts p LEFT JOIN rules r
  ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
GROUP BY p.page_id, p.host, p.path
"""

QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_token_counts": op5_token_counts,
    "op6_secret_scans": op6_secret_scans,
    "op7_quality_rules": op7_quality_rules,
    "op8_language_id": op8_language_id,
    "op9_url_filters": op9_url_filters,
    "op10_bpe": op10_bpe,
    "op11_personal_data": op11_personal_data,
    "op12_token_alignment": op12_token_alignment,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES = {
    "op3_chat_formatting": OP3_SQL,
    "op9_url_filters": OP9_SQL,
    "op13_hard_negatives": OP13_SQL,
}

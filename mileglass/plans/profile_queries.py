"""Registered profiling, preparation and modelling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mileglass.functions import features as E
from mileglass.operators import modelling as D
from mileglass.operators import preparation as P
from mileglass.operators import profiling as R
from mileglass.operators.ranking import spearman
from mileglass.operators.layers import with_duration
from mileglass.plans.trip_queries import BRONZE_CTE
from mileglass.sources.adapters import scored_labels, staff_from_customers, trips
from mileglass.session import run_dir
from mileglass.sources.tables import driver_table

LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
TRIP_FEATURES = ["trip_distance", "trip_duration_minutes", "fare_amount"]


def staff(s, d):
    return staff_from_customers(s, d)


def lines(s, d):
    return driver_table(s, d, "lineitem")


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _profile(s, d):
    return rounded(R.profile_table(staff(s, d)), "mean", "stddev", "q25", "q50", "q75")


def _drop_rare(s, d):
    df = staff(s, d).withColumn("age", E.null_where(F.col("age"), F.col("age") < 0))
    for column in ("age", "training_hours"):
        df = P.drop_rare_nulls(df, column)
    return df.select("person_id", "age", "training_hours")


def _split(s, d):
    return P.stratified_split(driver_table(s, d, "orders"), "o_orderstatus", "o_orderkey").select(
        "o_orderkey", "o_orderstatus", "is_train")


def _ratio(s, d):
    return lines(s, d).groupBy("l_returnflag").agg(
        F.count(E.ratio(F.col("l_discount"), F.col("l_tax"))).alias("with_ratio"),
        F.round(F.avg(E.ratio(F.col("l_discount"), F.col("l_tax"))), 6).alias("mean_ratio"))


def _stored(s, df, label):
    """What several models are fitted on is computed once and cut off from its source."""
    path = run_dir(s, label)
    df.write.parquet(path)
    return s.read.schema(df.schema).parquet(path)


MODEL_FEATURES = dict(target="target", numeric=["n_chars", "log_chars", "quality"], categorical=["lang", "source"], weight="class_weight")


def _fitted(s, d):
    """The models and the rows held out from them; class weights come from the training rows."""
    df = P.stratified_split(scored_labels(s, d), "target", "doc_id")
    train = _stored(s, P.class_weights(df.filter("is_train"), "target"), "train")
    return D.fit_baselines(train, **MODEL_FEATURES), _stored(s, df.filter(~F.col("is_train")), "test")


def _reports(s, d):
    models, test = _fitted(s, d)
    parts = [D.model_report(m, test, "target").withColumn("model", F.lit(name)) for name, m in models.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _fit(s, d):
    return rounded(_reports(s, d), "precision", "recall", "f1", "auc")


def _evaluate_models(s, d):
    shares = [F.col(c).between(0, 1) for c in ("precision", "recall", "f1", "auc")]
    return _reports(s, d).select("model", "class", "support", (shares[0] & shares[1] & shares[2] & shares[3]).alias("valid"))


def _cross_validate(s, d):
    df = _stored(s, P.class_weights(D.with_folds(scored_labels(s, d), "target", "doc_id"), "target"), "folds")
    scores = D.cross_validate(df, **MODEL_FEATURES)
    models = F.array(*(F.struct(F.lit(name).alias("model"), F.lit(0 <= auc <= 1).alias("scored")) for name, auc in scores.items()))
    return df.groupBy("fold").agg(F.count(F.lit(1)).alias("fold_rows"), F.sum("target").alias("positives")).select(
        F.inline(models), "fold", "fold_rows", "positives")


def _evaluate(s, d):
    df = scored_labels(s, d).withColumn("guess", (F.col("n_chars") > 500).cast("int"))
    return rounded(D.class_report(df, "target", "guess"), "precision", "recall", "f1")


QUERIES = {
    "profile_table": _profile,
    "wrong_type_columns": lambda s, d: R.wrong_type_columns(staff(s, d)),
    "null_counts": lambda s, d: R.null_counts(staff(s, d)),
    "null_rate_by_group": lambda s, d: rounded(
        R.null_rate_by_group(staff(s, d), "department", "training_hours"), "null_rate"),
    "missingness_class": lambda s, d: rounded(
        R.missingness_class(staff(s, d), "department", "training_hours"), "lowest", "highest"),
    "drop_rare_nulls": _drop_rare,
    "impute_median": lambda s, d: rounded(P.impute(staff(s, d), "training_hours"), "training_hours").select(
        "person_id", "training_hours"),
    "impute_mean": lambda s, d: rounded(P.impute(staff(s, d), "training_hours", "mean"), "training_hours").select(
        "person_id", "training_hours"),
    "impute_group_median": lambda s, d: rounded(
        P.impute_group_median(staff(s, d), "training_hours", "department"), "training_hours").select(
        "person_id", "department", "training_hours"),
    "missing_flag": lambda s, d: staff(s, d).select(
        "person_id", E.missing_flag(F.col("training_hours")).alias("training_hours_missing")),
    "garbage_to_null": lambda s, d: staff(s, d).select(
        "person_id", E.null_where(F.col("age"), F.col("age") < 0).alias("age")),
    "skewness": lambda s, d: rounded(R.skewness(lines(s, d), LINE_FEATURES), "skew"),
    "log1p_col": lambda s, d: lines(s, d).groupBy("l_suppkey").agg(
        F.round(F.avg(F.log1p("l_extendedprice")), 6).alias("mean_log_price")),
    "target_balance": lambda s, d: rounded(R.target_balance(driver_table(s, d, "labels"), "toxic"), "share"),
    "winsorize": lambda s, d: rounded(P.winsorize(lines(s, d), "l_extendedprice"), "l_extendedprice").select(
        "l_orderkey", "l_linenumber", "l_extendedprice"),
    "robust_scale": lambda s, d: rounded(
        P.robust_scale(lines(s, d), ["l_quantity", "l_extendedprice"]), "l_quantity", "l_extendedprice").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"),
    "corr_with_target": lambda s, d: rounded(
        R.correlations_with(lines(s, d), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]), "r"),
    "corr_pairs": lambda s, d: rounded(
        R.correlation_pairs(with_duration(trips(s, d)), TRIP_FEATURES), "r"),
    "corr_matrix": lambda s, d: rounded(R.correlation_pairs(lines(s, d), LINE_FEATURES, None), "r"),
    "spearman": lambda s, d: rounded(spearman(lines(s, d), "l_quantity", "l_extendedprice"), "rho"),
    "group_target_mean": lambda s, d: rounded(
        R.group_target_mean(staff(s, d), "overtime", "attrition"), "target_mean"),
    "ratio_feature": _ratio,
    "combo_flag": lambda s, d: staff(s, d).select("person_id", E.combo_flag(
        F.col("overtime"), F.col("training_hours") < 1000).alias("tired")),
    "stratified_split": _split,
    "class_weights": lambda s, d: rounded(
        P.class_weights(driver_table(s, d, "labels"), "toxic"), "class_weight").select(
        "doc_id", "toxic", "class_weight"),
    "fit_baseline": _fit,
    "cross_validate": _cross_validate,
    "evaluate": _evaluate,
    "evaluate_models": _evaluate_models,
    "evaluate_auc": lambda s, d: rounded(D.auc(scored_labels(s, d), "n_chars", "target"), "auc"),
}

# ---------------------------------------------------------------- SQL pieces
_STAFF = """
staff AS (
  SELECT c_custkey AS person_id, c_mktsegment AS department,
         CASE WHEN c_mktsegment = 'BUILDING' AND c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 40 = 7 THEN NULL
              ELSE c_acctbal END AS training_hours,
         CAST(c_acctbal AS VARCHAR) AS monthly_income,
         CASE WHEN c_custkey % 50 = 3 THEN -1 ELSE CAST(20 + c_custkey % 45 AS INTEGER) END AS age,
         c_custkey % 3 = 0 AS overtime, c_nationkey AS nation, CAST(c_custkey % 25 < 4 AS INTEGER) AS attrition
  FROM customer)"""

_SCORED = """
scored AS (SELECT l.doc_id, CAST(n_chars AS DOUBLE) AS n_chars, CAST(toxic AS INTEGER) AS target
           FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


_SHAPE = """(SELECT count(*) FROM staff) AS n_rows, 8 AS n_columns"""


def _ends(column: str) -> str:
    return f"CAST(min({column}) AS VARCHAR) AS least, CAST(max({column}) AS VARCHAR) AS greatest, {_SHAPE}"


def _numeric_profile(column: str, kind: str) -> str:
    return f"""SELECT '{column}' AS "column", '{kind}' AS data_type, count({column}) AS non_null,
        round(avg({column}), 6) AS mean, round(stddev_samp({column}), 6) AS stddev,
        CAST(min({column}) AS DOUBLE) AS "min", CAST(max({column}) AS DOUBLE) AS "max",
        round(quantile_cont({column}, 0.25), 6) AS q25, round(quantile_cont({column}, 0.5), 6) AS q50,
        round(quantile_cont({column}, 0.75), 6) AS q75,
        CAST(NULL AS BIGINT) AS "distinct", CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS top_count, {_ends(column)} FROM staff"""


def _text_profile(column: str) -> str:
    return f"""SELECT '{column}', 'string', count({column}), NULL, NULL, NULL, NULL, NULL, NULL, NULL,
        count(DISTINCT {column}),
        (SELECT {column} FROM staff WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
        (SELECT count(*) FROM staff WHERE {column} IS NOT NULL GROUP BY {column} ORDER BY count(*) DESC LIMIT 1), {_ends(column)} FROM staff"""


def _other_profile(column: str, kind: str) -> str:
    return f"""SELECT '{column}', '{kind}', count({column}), NULL, NULL, NULL, NULL, NULL, NULL, NULL,
        count(DISTINCT {column}), NULL, NULL, {_ends(column)} FROM staff"""


def _each(columns, row) -> str:
    return " UNION ALL ".join(row(c) for c in columns)


_PAIRS = [(a, b) for i, a in enumerate(LINE_FEATURES) for b in LINE_FEATURES[i + 1:]]
_TRIP_PAIRS = [(a, b) for i, a in enumerate(TRIP_FEATURES) for b in TRIP_FEATURES[i + 1:]]
_RANKED = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE"

ORACLES = {
    "profile_table": f"WITH {_STAFF} " + " UNION ALL ".join(
        [_numeric_profile(c, k) for c, k in (("person_id", "bigint"), ("training_hours", "double"), ("age", "int"),
                                             ("nation", "int"), ("attrition", "int"))]
        + [_text_profile("department"), _text_profile("monthly_income"), _other_profile("overtime", "boolean")]),
    "wrong_type_columns": f"WITH {_STAFF} " + _each(["department", "monthly_income"], lambda c: f"""
        SELECT '{c}' AS "column", count({c}) AS non_null, count(TRY_CAST({c} AS DOUBLE)) AS "numeric",
               count({c}) > 0 AND count({c}) = count(TRY_CAST({c} AS DOUBLE)) AS all_numeric FROM staff"""),
    "null_counts": f"WITH {_STAFF} " + _each(
        ["person_id", "department", "training_hours", "monthly_income", "age", "overtime", "nation", "attrition"],
        lambda c: f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM staff"""),
    "null_rate_by_group": f"""WITH {_STAFF} SELECT department, round(avg((training_hours IS NULL)::INT), 6) AS null_rate,
        count(*) AS group_rows FROM staff GROUP BY department""",
    "missingness_class": f"""WITH {_STAFF}, r AS (SELECT avg((training_hours IS NULL)::INT) AS v FROM staff GROUP BY department)
        SELECT 'training_hours' AS "column", round(min(v), 6) AS lowest, round(max(v), 6) AS highest,
               CASE WHEN max(v) = 0 THEN 'complete' WHEN max(v) - min(v) > 0.1 THEN 'MAR' ELSE 'MCAR' END AS missingness FROM r""",
    "drop_rare_nulls": f"""WITH {_STAFF}, a AS (SELECT person_id, CASE WHEN age >= 0 THEN age END AS age, training_hours FROM staff),
        b AS (SELECT * FROM a WHERE age IS NOT NULL OR (SELECT avg((age IS NULL)::INT) FROM a) >= 0.05)
        SELECT person_id, age, training_hours FROM b
        WHERE training_hours IS NOT NULL OR (SELECT avg((training_hours IS NULL)::INT) FROM b) >= 0.05""",
    "impute_median": f"""WITH {_STAFF} SELECT person_id,
        round(coalesce(training_hours, (SELECT median(training_hours) FROM staff)), 6) AS training_hours FROM staff""",
    "impute_mean": f"""WITH {_STAFF} SELECT person_id,
        round(coalesce(training_hours, (SELECT avg(training_hours) FROM staff)), 6) AS training_hours FROM staff""",
    "impute_group_median": f"""WITH {_STAFF}, m AS (SELECT department, median(training_hours) AS v FROM staff GROUP BY 1)
        SELECT person_id, department, round(coalesce(training_hours, v), 6) AS training_hours
        FROM staff LEFT JOIN m USING (department)""",
    "missing_flag": f"WITH {_STAFF} SELECT person_id, (training_hours IS NULL)::INT AS training_hours_missing FROM staff",
    "garbage_to_null": f"WITH {_STAFF} SELECT person_id, CASE WHEN age >= 0 THEN age END AS age FROM staff",
    "skewness": _each(LINE_FEATURES, lambda c: f"""SELECT '{c}' AS "column", round(skewness({c}), 6) AS skew,
        abs(skewness({c})) > 1 AS skewed FROM lineitem"""),
    "log1p_col": "SELECT l_suppkey, round(avg(ln(1 + l_extendedprice)), 6) AS mean_log_price FROM lineitem GROUP BY 1",
    "target_balance": """SELECT toxic, count(*) AS n, round(count(*) / (SELECT count(*) FROM labels)::DOUBLE, 6) AS share,
        (SELECT max(c) / sum(c) FROM (SELECT count(*) AS c FROM labels GROUP BY toxic)) >= 0.84 AS imbalanced
        FROM labels GROUP BY toxic""",
    "winsorize": """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem)
        SELECT l_orderkey, l_linenumber, round(least(greatest(l_extendedprice, lo), hi), 6) AS l_extendedprice FROM lineitem, q""",
    "robust_scale": """WITH q AS (SELECT median(l_quantity) AS qm, quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS qw,
               median(l_extendedprice) AS em, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS ew FROM lineitem)
        SELECT l_orderkey, l_linenumber, round((l_quantity - qm) / qw, 6) AS l_quantity,
               round((l_extendedprice - em) / ew, 6) AS l_extendedprice FROM lineitem, q""",
    "corr_with_target": _each(["l_quantity", "l_discount", "l_tax"], lambda c: f"""SELECT '{c}' AS "column",
        round(corr({c}, l_extendedprice), 6) AS r FROM lineitem"""),
    "corr_pairs": f"WITH {BRONZE_CTE} SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS r FROM bronze"
        for a, b in _TRIP_PAIRS) + ") AS u WHERE abs(r) > 0.7",
    "corr_matrix": " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in _PAIRS),
    "spearman": f"""WITH r AS (SELECT {_RANKED.format(c='l_quantity')} AS a, {_RANKED.format(c='l_extendedprice')} AS b FROM lineitem)
        SELECT 'l_quantity' AS feature_a, 'l_extendedprice' AS feature_b, round(corr(a, b), 6) AS rho FROM r""",
    "group_target_mean": f"""WITH {_STAFF} SELECT overtime, round(avg(attrition), 6) AS target_mean, count(*) AS group_rows
        FROM staff GROUP BY overtime""",
    "ratio_feature": """SELECT l_returnflag, count(l_discount / nullif(l_tax, 0)) AS with_ratio,
        round(avg(l_discount / nullif(l_tax, 0)), 6) AS mean_ratio FROM lineitem GROUP BY 1""",
    "combo_flag": f"""WITH {_STAFF} SELECT person_id, coalesce(overtime AND training_hours < 1000, FALSE)::INT AS tired FROM staff""",
    "stratified_split": """WITH h AS (SELECT o_orderkey, o_orderstatus,
            row_number() OVER (PARTITION BY o_orderstatus ORDER BY
                ('0x' || substr(md5('42:' || CAST(o_orderkey AS VARCHAR)), 1, 12))::UBIGINT) AS place,
            count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
        SELECT o_orderkey, o_orderstatus, place <= ceil(0.8::DOUBLE * n) AS is_train FROM h""",
    "class_weights": """SELECT doc_id, toxic, round((SELECT count(*) FROM labels)::DOUBLE
        / ((SELECT count(DISTINCT toxic) FROM labels) * count(*) OVER (PARTITION BY toxic)), 6) AS class_weight FROM labels""",
    "cross_validate": f"""WITH {_SCORED}, h AS (SELECT target, count(*) OVER (PARTITION BY target) AS n,
            row_number() OVER (PARTITION BY target ORDER BY
                ('0x' || substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 12))::UBIGINT) AS place FROM scored),
        f AS (SELECT target, {" + ".join(f"(place > ceil({k / 5}::DOUBLE * n))::INT" for k in range(1, 5))} AS fold FROM h),
        m(model) AS (VALUES ('logistic_regression'), ('random_forest'), ('gradient_boosted_trees'))
        SELECT model, TRUE AS scored, CAST(fold AS INTEGER) AS fold, count(*) AS fold_rows, sum(target)::BIGINT AS positives
        FROM f, m GROUP BY model, fold""",
    "evaluate_models": f"""WITH {_SCORED}, h AS (SELECT target, count(*) OVER (PARTITION BY target) AS n,
            row_number() OVER (PARTITION BY target ORDER BY
                ('0x' || substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 12))::UBIGINT) AS place FROM scored),
        m(model) AS (VALUES ('logistic_regression'), ('random_forest'), ('gradient_boosted_trees'))
        SELECT model, target AS class, count(*) AS support, TRUE AS valid FROM h, m WHERE place > ceil(0.8::DOUBLE * n)
        GROUP BY model, target""",
    "evaluate": f"""WITH {_SCORED}, g AS (SELECT target, (n_chars > 500)::INT AS guess FROM scored),
        c AS (SELECT v AS class, (SELECT count(*) FROM g WHERE target = v) AS support,
                     (SELECT count(*) FROM g WHERE guess = v) AS predicted,
                     (SELECT count(*) FROM g WHERE target = v AND guess = v) AS hits FROM (VALUES (0), (1)) AS t(v))
        SELECT class, support, round(coalesce(hits / nullif(predicted, 0)::DOUBLE, 0), 6) AS precision,
               round(coalesce(hits / nullif(support, 0)::DOUBLE, 0), 6) AS recall,
               round(coalesce(2 * hits / nullif(support + predicted, 0)::DOUBLE, 0), 6) AS f1 FROM c""",
    "evaluate_auc": f"""WITH {_SCORED}, r AS (SELECT target, {_RANKED.format(c='n_chars')} AS rk FROM scored),
        s AS (SELECT sum(target)::BIGINT AS p, count(*) AS n, sum(target * rk) AS t FROM r)
        SELECT p AS positives, n - p AS negatives, round((t - p * (p + 1) / 2.0::DOUBLE) / (p * (n - p)), 6) AS auc FROM s""",
}

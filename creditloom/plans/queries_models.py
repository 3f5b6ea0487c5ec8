"""Evaluation, model input, models, explanations and anomalies."""

from pyspark.sql import functions as F

from creditloom.functions.columns import col, ig_label, is_finite
from creditloom.operators import (
    anomaly,
    evaluate,
    explain,
    features as prep,
    models,
    peers,
)
from creditloom.plans import panel_sql as q
from creditloom.plans.panel import panel, panel_key
from creditloom.plans.registry import query, rounded

FEATURES = q.FEATURES
KEYS = '"Company Code", "Year"'
ID = "concat_ws('|', CAST(\"Company Code\" AS VARCHAR), CAST(\"Year\" AS VARCHAR))"

#: Explanations of all rows by all leaves; at the operator's own depth of 30 they take too
#: long for a registered query (the README has figures).
EXPLAINED = {"trees": 400, "max_depth": 8}

_forests: dict[tuple, models.ForestClassifier | None] = {}


def forest(spark, sf_dir, **settings):
    """A forest of the panel, fitted once per application, state of the tables and settings."""
    key = (*panel_key(spark, sf_dir), *sorted(settings.items()))
    if key not in _forests:
        _forests[key] = models.train_rf(model_rows(spark, sf_dir), FEATURES, **settings)
    return _forests[key]


def scored(spark, sf_dir):
    """A fixed score that carries part of the rating."""
    ratio = col("Interest Coverage Ratio")
    rows = panel(spark, sf_dir).where(ratio.isNotNull())
    return rows.select(
        "Company Code",
        "Year",
        ig_label(col("Rating")).alias("label"),
        (ratio / (1 + ratio)).alias("score"),
    )


def model_rows(spark, sf_dir):
    return prep.build_ml(panel(spark, sf_dir), FEATURES)


POINTS = q.SCORED + """, counted AS (
  SELECT score, sum(label) AS pos, count(*) - sum(label) AS neg FROM scored GROUP BY score),
points AS (SELECT score, CAST(pos AS BIGINT) AS pos, CAST(neg AS BIGINT) AS neg,
  CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp
  FROM counted WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
ends AS (SELECT max(tp) AS n_pos, max(fp) AS n_neg FROM points)
"""


@query(
    POINTS
    + """SELECT score AS threshold, fp::DOUBLE / n_neg AS fpr, tp::DOUBLE / n_pos AS tpr
FROM points, ends UNION ALL SELECT NULL, 0.0::DOUBLE, 0.0::DOUBLE"""
)
def roc_points(spark, sf_dir):
    return evaluate.roc_points(scored(spark, sf_dir))


@query(
    POINTS
    + """SELECT score AS threshold, tp::DOUBLE / (tp + fp) AS precision,
tp::DOUBLE / n_pos AS recall FROM points, ends
UNION ALL SELECT NULL, 1.0::DOUBLE, 0.0::DOUBLE"""
)
def pr_points(spark, sf_dir):
    return evaluate.pr_points(scored(spark, sf_dir))


AREA = "round(sum((2 * tp - pos)::DOUBLE * neg) / 2 / (max(n_pos)::DOUBLE * max(n_neg)), 6)"
PRECISION = "round(sum(tp::DOUBLE / (tp + fp) * (pos::DOUBLE / n_pos)), 6)"


@query(POINTS + f"SELECT {AREA} AS auc_roc FROM points, ends")
def auc_roc(spark, sf_dir):
    return rounded(evaluate.auc_roc(scored(spark, sf_dir)), "auc_roc")


@query(POINTS + f"SELECT {PRECISION} AS average_precision FROM points, ends")
def average_precision(spark, sf_dir):
    return rounded(evaluate.average_precision(scored(spark, sf_dir)), "average_precision")


HELD_OUT = POINTS.replace(
    "scored GROUP BY score", f"scored WHERE {q.hash32(ID)} % 100 >= 80 GROUP BY score"
)


@query(
    HELD_OUT
    + f"""SELECT {AREA} AS auc_roc, {PRECISION} AS average_precision,
(SELECT round(avg(CASE WHEN label = (CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) THEN 1.0 ELSE 0.0
  END), 6) FROM scored WHERE {q.hash32(ID)} % 100 >= 80) AS accuracy FROM points, ends"""
)
def holdout_metrics(spark, sf_dir):
    test = prep.split_80_20(scored(spark, sf_dir)).where(~F.col("is_train"))
    metrics = evaluate.holdout_metrics(test)
    return rounded(metrics, "auc_roc", "average_precision", "accuracy")


def _confusion(at: str) -> str:
    return f"""CAST(count(*) FILTER (WHERE label = 0 AND score < {at}) AS BIGINT) AS tn,
CAST(count(*) FILTER (WHERE label = 0 AND score >= {at}) AS BIGINT) AS fp,
CAST(count(*) FILTER (WHERE label = 1 AND score < {at}) AS BIGINT) AS fn,
CAST(count(*) FILTER (WHERE label = 1 AND score >= {at}) AS BIGINT) AS tp"""


RATES = """coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision,
coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall,
coalesce((2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) AS f1"""


@query(
    q.SCORED
    + f", c AS (SELECT {_confusion('0.5::DOUBLE')} FROM scored) SELECT *, {RATES} FROM c"
)
def threshold_metrics(spark, sf_dir):
    return evaluate.threshold_metrics(scored(spark, sf_dir), 0.5)


@query(
    q.SCORED
    + f""", t AS (SELECT i / 100.0::DOUBLE AS threshold FROM range(5, 96) r(i)),
c AS (SELECT threshold, {_confusion('threshold')} FROM scored, t GROUP BY threshold)
SELECT *, {RATES} FROM c"""
)
def threshold_sweep(spark, sf_dir):
    return evaluate.threshold_sweep(scored(spark, sf_dir))


@query(q.COMPLETE + "SELECT * FROM ml")
def prepare_ml(spark, sf_dir):
    return prep.prepare_ml(panel(spark, sf_dir))


@query(q.COMPLETE + f'SELECT {KEYS}, label, "ROA", "Current Ratio" FROM ml')
def build_ml(spark, sf_dir):
    return prep.build_ml(panel(spark, sf_dir), ["ROA", "Quick Ratio", "Current Ratio"])


@query(q.COMPLETE + f"SELECT {KEYS}, label, {q.hash32(ID)} % 100 < 80 AS is_train FROM ml")
def split_80_20(spark, sf_dir):
    return prep.split_80_20(model_rows(spark, sf_dir).select("Company Code", "Year", "label"))


@query(
    q.COMPLETE
    + f""", numbered AS (SELECT {KEYS}, label,
  row_number() OVER (PARTITION BY label ORDER BY {q.hash52(ID)}) AS place,
  count(*) OVER (PARTITION BY label) AS n FROM ml)
SELECT {KEYS}, label, place > ceil(n * 0.2::DOUBLE) AS is_train FROM numbered"""
)
def split_stratified(spark, sf_dir):
    return prep.split_stratified(model_rows(spark, sf_dir).select("Company Code", "Year", "label"))


GAPS = ["Current Ratio", "Interest Coverage Ratio"]


@query(
    q.PANEL
    + f"SELECT {KEYS}, "
    + ", ".join(f'round(coalesce("{n}", (SELECT median("{n}") FROM panel)), 6) AS "{n}"' for n in GAPS)
    + " FROM panel"
)
def impute_median(spark, sf_dir):
    rows = panel(spark, sf_dir).select("Company Code", "Year", *GAPS)
    return rounded(prep.impute_median(rows, GAPS), *GAPS)


@query(
    q.COMPLETE
    + f"SELECT {KEYS}, "
    + ", ".join(
        f'round(("{n}" - avg("{n}") OVER ()) / stddev_pop("{n}") OVER (), 6) AS "{n}"'
        for n in FEATURES
    )
    + " FROM ml"
)
def standardize(spark, sf_dir):
    rows = model_rows(spark, sf_dir).drop("label")
    return rounded(prep.standardize(rows, FEATURES), *FEATURES)


def _z(name: str) -> str:
    return f'("{name}" - avg("{name}") OVER ()) / stddev_pop("{name}") OVER ()'


@query(
    q.PANEL
    + f""", complete AS (SELECT {KEYS}, {q.quoted(FEATURES)} FROM panel
  WHERE {" AND ".join(f'"{f}" IS NOT NULL' for f in FEATURES)}),
z AS (SELECT *, {", ".join(f"{_z(n)} AS z{i}" for i, n in enumerate(FEATURES))} FROM complete),
a AS (SELECT * FROM z ORDER BY {KEYS} LIMIT 1),
far AS (SELECT z."Company Code", z."Year", {", ".join(f'z."{f}"' for f in FEATURES)},
  sqrt({" + ".join(f"(z.z{i} - a.z{i}) ^ 2" for i in range(len(FEATURES)))}) AS distance
  FROM z, a WHERE NOT (z."Company Code" = a."Company Code" AND z."Year" = a."Year"))
SELECT {KEYS}, {q.quoted(FEATURES)}, round(distance, 6) AS distance
FROM far ORDER BY far.distance, {KEYS} LIMIT 10"""
)
def nearest_peers(spark, sf_dir):
    rows = panel(spark, sf_dir).select("Company Code", "Year", *FEATURES)
    chosen = rows.dropna().orderBy("Company Code", "Year").first()
    found = peers.nearest_peers(rows, chosen["Company Code"], chosen["Year"], FEATURES)
    return rounded(found, "distance")


@query(
    q.PANEL
    + f""", complete AS (SELECT {KEYS}, {q.quoted(FEATURES)} FROM panel
  WHERE {" AND ".join(f'"{f}" IS NOT NULL' for f in FEATURES)}),
z AS MATERIALIZED (SELECT "Company Code" AS e, "Year" AS y,
  {", ".join(f"{_z(n)} AS z{i}" for i, n in enumerate(FEATURES))} FROM complete),
near AS (SELECT a.e, a.y, unnest(min({{
    'd': round(sqrt({" + ".join(f"(b.z{i} - a.z{i}) ^ 2" for i in range(len(FEATURES)))}), 9),
    'e': b.e, 'y': b.y}}, 10)) AS p
  FROM z a JOIN z b ON a.e <> b.e OR a.y <> b.y GROUP BY a.e, a.y)
SELECT e AS "Company Code", y AS "Year",
  CAST(row_number() OVER (PARTITION BY e, y ORDER BY p) AS INT) AS rank,
  p.e AS peer_entity, p.y AS peer_year, round(p.d, 6) AS distance FROM near"""
)
def all_peers(spark, sf_dir):
    rows = panel(spark, sf_dir).select("Company Code", "Year", *FEATURES)
    return rounded(peers.all_peers(rows, FEATURES), "distance")


@query(
    q.PANEL
    + f"""SELECT {KEYS}, "Interest Coverage Ratio" AS score FROM panel
WHERE "Interest Coverage Ratio" IS NOT NULL ORDER BY score DESC, {KEYS} LIMIT 20"""
)
def top_anomalies(spark, sf_dir):
    rows = panel(spark, sf_dir).dropna(subset=["Interest Coverage Ratio"])
    return anomaly.top_anomalies(rows, 20, score="Interest Coverage Ratio")


@query(
    q.PANEL
    + f"""SELECT {KEYS}, "Gross Profit Margin" AS score, "ROA" FROM panel
WHERE "Gross Profit Margin" < 20 ORDER BY score, {KEYS} LIMIT 10"""
)
def flagged_anomalies(spark, sf_dir):
    margin = col("Gross Profit Margin")
    rows = panel(spark, sf_dir).withColumns({"decision": margin, "is_anomaly": margin < 20})
    return anomaly.flagged_anomalies(rows, 10, show=["ROA"])


@query(q.PANEL + f'SELECT {KEYS}, "ROA" FROM panel ORDER BY "ROA", {KEYS} LIMIT 10')
def lowest_scores(spark, sf_dir):
    rows = panel(spark, sf_dir).select("Company Code", "Year", "ROA")
    return anomaly.lowest_scores(rows, 10, score="ROA")


@query(
    q.PANEL
    + "SELECT feature, round(importance, 6) AS importance FROM ("
    + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, stddev_pop(\"{f}\") AS importance FROM panel" for f in FEATURES
    )
    + ") ORDER BY importance DESC, feature LIMIT 3"
)
def top_features(spark, sf_dir):
    spread = panel(spark, sf_dir).agg(
        *[F.stddev_pop(col(f)).alias(f"s{i}") for i, f in enumerate(FEATURES)]
    )
    pairs = [
        F.struct(F.lit(f).alias("feature"), F.col(f"s{i}").alias("importance"))
        for i, f in enumerate(FEATURES)
    ]
    importance = spread.select(F.inline(F.array(*pairs)))
    return rounded(explain.top_features(importance, 3), "importance")


TREND_PARTS = ["Gross Profit", "Net Income", "Total Debt", "Operating Cash Flow"]


@query(
    q.PANEL
    + ", parts AS ("
    + " UNION ALL ".join(
        f"SELECT {KEYS}, '{n}' AS feature, \"{n}\" AS value FROM panel" for n in TREND_PARTS
    )
    + f"""), placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY {KEYS}
  ORDER BY abs(value) DESC, feature) AS INT) AS rank FROM parts)
SELECT * FROM placed WHERE rank <= 2"""
)
def top_attributions(spark, sf_dir):
    parts = panel(spark, sf_dir).unpivot(
        ["Company Code", "Year"], [col(n) for n in TREND_PARTS], "feature", "value"
    )
    return explain.top_attributions(parts, 2)


# A fixed linear rule in place of a model.
RULE = ["Interest Coverage Ratio", "Debt-to-Assets Ratio", "ROA"]


def rule_prediction(df):
    coverage, debt = col("Interest Coverage Ratio"), col("Debt-to-Assets Ratio")
    return df.withColumn("prediction", (coverage - 0.5 * debt > 0.9).cast("double"))


def rule_score(df):
    coverage, debt = col("Interest Coverage Ratio"), col("Debt-to-Assets Ratio")
    return df.withColumn("p_ig", 0.3 + 0.05 * coverage - 0.2 * debt)


_TRIAL = """avg(CASE WHEN label = (CASE WHEN {coverage} - 0.5::DOUBLE * {debt} > 0.9::DOUBLE
THEN 1 ELSE 0 END) THEN 1.0 ELSE 0.0 END)"""


def _permuted(names: dict[str, str]) -> str:
    return _TRIAL.format(**{"coverage": "coverage", "debt": "debt", **names})


@query(
    q.COMPLETE
    + f""", test AS (SELECT {ID} AS id, label, "Interest Coverage Ratio" AS coverage,
  "Debt-to-Assets Ratio" AS debt, "ROA" AS roa FROM ml WHERE {q.hash32(ID)} % 100 >= 80),
placed AS (SELECT *, {q.hash32("id", "'bucket'")} %
  (SELECT greatest(1, count(*) // {explain.BUCKET_ROWS}) FROM test) AS bucket FROM test),
linked AS (SELECT p.*, r,
  coalesce(lead(coverage) OVER w, first_value(coverage) OVER w) AS coverage2,
  coalesce(lead(debt) OVER w, first_value(debt) OVER w) AS debt2
  FROM placed p, range(0, 10) t(r)
  WINDOW w AS (PARTITION BY r, bucket ORDER BY {q.hash52("id", "42 + r")}, id)),
base AS (SELECT {_permuted({})} AS accuracy FROM test),
per AS (SELECT 'Interest Coverage Ratio' AS feature, r, {_permuted({"coverage": "coverage2"})}
    AS accuracy FROM linked GROUP BY r
  UNION ALL SELECT 'Debt-to-Assets Ratio', r, {_permuted({"debt": "debt2"})} FROM linked GROUP BY r
  UNION ALL SELECT 'ROA', r, {_permuted({})} FROM linked GROUP BY r)
SELECT feature, round(avg(base.accuracy - per.accuracy), 6) AS importance,
round(stddev_pop(base.accuracy - per.accuracy), 6) AS importance_std
FROM per, base GROUP BY feature"""
)
def permutation_importance(spark, sf_dir):
    test = prep.split_80_20(model_rows(spark, sf_dir)).where(~F.col("is_train"))
    row_id = F.concat_ws("|", F.col("Company Code").cast("string"), F.col("Year").cast("string"))
    result = explain.permutation_importance(test, RULE, rule_prediction, row_id=row_id)
    return rounded(result, "importance", "importance_std")


def _edge(name: str, p: float) -> str:
    at = f"(n * {p} + 0.4 + 0.2 * {p})"
    share = f"({at} - floor({at}))"
    return f"""(SELECT (1 - {share}) * max(CASE WHEN k = floor({at}) THEN x END)
      + {share} * max(CASE WHEN k = floor({at}) + 1 THEN x END) FROM
      (SELECT "{name}" AS x, row_number() OVER (ORDER BY "{name}") AS k,
       (count(*) OVER ())::DOUBLE AS n FROM ml) GROUP BY n)"""


def _dependence(name: str, score: str) -> str:
    return f"""SELECT '{name}' AS feature, v AS grid_value, avg({score}) AS mean_p_ig
FROM ml, (SELECT lo + (hi - lo) * i / 99 AS v FROM (SELECT {_edge(name, 0.05)} AS lo,
{_edge(name, 0.95)} AS hi), range(0, 100) t(i)) GROUP BY v"""


@query(
    q.COMPLETE
    + "SELECT feature, round(grid_value, 6) AS grid_value, round(mean_p_ig, 6) AS mean_p_ig FROM ("
    + _dependence("Interest Coverage Ratio", '0.3 + 0.05 * v - 0.2 * "Debt-to-Assets Ratio"')
    + " UNION ALL "
    + _dependence("Debt-to-Assets Ratio", '0.3 + 0.05 * "Interest Coverage Ratio" - 0.2 * v')
    + ")"
)
def partial_dependence(spark, sf_dir):
    rows = model_rows(spark, sf_dir).select(*[col(f) for f in RULE])
    result = explain.partial_dependence(rows, RULE, rule_score, shown=RULE[:2])
    return rounded(result, "grid_value", "mean_p_ig")


@query()
def train_lr(spark, sf_dir):
    rows = model_rows(spark, sf_dir)
    return models.metrics_or_empty(models.train_lr(rows, FEATURES), rows)


@query()
def cv_lr(spark, sf_dir):
    return models.cv_lr(model_rows(spark, sf_dir), FEATURES)


@query()
def score_ig(spark, sf_dir):
    fitted = models.train_lr(model_rows(spark, sf_dir), FEATURES)
    return models.score_ig(fitted, panel(spark, sf_dir))


@query()
def kmeans_segments(spark, sf_dir):
    return models.kmeans_segments(model_rows(spark, sf_dir), FEATURES)


@query()
def train_rf(spark, sf_dir):
    rows = model_rows(spark, sf_dir)
    return models.metrics_or_empty(forest(spark, sf_dir), rows)


@query()
def rf_score_ig(spark, sf_dir):
    fitted = forest(spark, sf_dir)
    return models.rf_score_ig(fitted, panel(spark, sf_dir))


@query()
def permutation_importance_rf(spark, sf_dir):
    fitted = forest(spark, sf_dir, **EXPLAINED)
    return explain.permutation_importance(fitted.holdout, FEATURES, fitted.predict)


@query()
def shap_global(spark, sf_dir):
    fitted = forest(spark, sf_dir, **EXPLAINED)
    return explain.shap_global(fitted)


@query()
def shap_row(spark, sf_dir):
    fitted = forest(spark, sf_dir, **EXPLAINED)
    return explain.shap_row(fitted, panel(spark, sf_dir))


@query()
def partial_dependence_rf(spark, sf_dir):
    fitted = forest(spark, sf_dir, **EXPLAINED)
    importance = explain.permutation_importance(fitted.holdout, FEATURES, fitted.predict)
    shown = [r["feature"] for r in explain.top_features(importance, 3).head(3)]
    return explain.forest_dependence(fitted, fitted.train, shown=shown)


@query()
def isoforest_fit_rank(spark, sf_dir):
    rows = panel(spark, sf_dir)
    train = prep.build_ml(rows, FEATURES)
    return anomaly.isoforest_fit_rank(train, rows, FEATURES)


@query()
def isoforest_flags(spark, sf_dir):
    return anomaly.isoforest_flags(panel(spark, sf_dir), FEATURES)


@query()
def isoforest_raw(spark, sf_dir):
    return anomaly.isoforest_raw(model_rows(spark, sf_dir), FEATURES)


@query(
    q.PANEL
    + f"""SELECT {KEYS}, "ROA" FROM panel
WHERE "ROA" IS NOT NULL AND "Year" NOT IN (1995, 1996, 1997)"""
)
def finite_rows(spark, sf_dir):
    """Values that are infinite, negative infinite or no number in three of the years."""
    year = F.col("Year")
    odd = F.when(year == 1995, float("inf")).when(year == 1996, float("nan"))
    odd = odd.when(year == 1997, float("-inf")).otherwise(col("ROA"))
    rows = panel(spark, sf_dir).select("Company Code", "Year", odd.alias("ROA"))
    return rows.where(is_finite(col("ROA")))


@query(
    q.COMPLETE
    + f""", parts AS (SELECT label, {q.hash32(ID)} % 100 < 80 AS is_train FROM ml),
counts AS (SELECT count(*) AS n_rows, count(*) FILTER (is_train AND label = 1) AS train_pos,
  count(*) FILTER (is_train AND label = 0) AS train_neg, count(*) FILTER (NOT is_train) AS test
  FROM parts)
SELECT *, least(train_pos, train_neg, test) > 0 AND n_rows >= 200 AS enough_for_lr,
  least(train_pos, train_neg, test) > 0 AND n_rows >= 20 AS enough_for_forest,
  n_rows >= {max(50, 3 * len(FEATURES))} AS enough_for_anomalies FROM counts"""
)
def size_guards(spark, sf_dir):
    return models.size_guards(model_rows(spark, sf_dir), FEATURES)


TERMS = ["intercept", *FEATURES]


@query("SELECT unnest([" + ", ".join(f"'{t}'" for t in TERMS) + "]) AS term, true AS at_optimum")
def lr_optimum(spark, sf_dir):
    """The slope of the loss at the fitted regression, per deviation of each ratio, is 0."""
    fitted = models.train_lr(model_rows(spark, sf_dir), FEATURES)
    copies = {f"z{i}": col(n) for i, n in enumerate(FEATURES)}
    scored = prep.standardize(fitted.predict(fitted.train).withColumns(copies), list(copies))
    off = F.col("p_ig") - F.col("label")
    slopes = [F.avg(off).alias("intercept")]
    slopes += [F.avg(off * F.col(f"z{i}")).alias(n) for i, n in enumerate(FEATURES)]
    pairs = [
        F.struct(F.lit(t).alias("term"), (F.abs(col(t)) < 1e-3).alias("at_optimum")) for t in TERMS
    ]
    return scored.agg(*slopes).select(F.inline(F.array(*pairs)))


@query(
    q.PANEL
    + f"""SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_off FROM panel
WHERE {" AND ".join(f'"{f}" IS NOT NULL' for f in FEATURES)}"""
)
def attribution_totals(spark, sf_dir):
    """Rows whose attributions and base value do not add up to the forest's P(IG)."""
    fitted = forest(spark, sf_dir, **EXPLAINED)
    rows = panel(spark, sf_dir)
    values = explain.tree_attributions(fitted, rows).groupBy("Company Code", "Year").agg(
        (F.sum("value") + F.max("base_value")).alias("total")
    )
    both = models.rf_score_ig(fitted, rows).join(values, ["Company Code", "Year"], "left")
    wrong = F.coalesce(F.abs(F.col("total") - F.col("p_ig")) > 1e-9, F.lit(True))
    return both.agg(F.count("*").alias("n_rows"), F.count_if(wrong).alias("n_off"))

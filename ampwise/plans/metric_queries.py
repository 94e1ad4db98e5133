"""Detection metrics over the order scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ampwise.functions.numeric import array_huber, array_mae, huber, sparse_loss, uniform
from ampwise.operators import metrics
from ampwise.operators.ordering import find_hot
from ampwise.plans import oracle_parts as o
from ampwise.plans.registry import query, r6
from ampwise.session import stage
from ampwise.sources import stores, views
from ampwise.sources.views import order_scores

MAP_PERCENT = 81


def _pct(p: int) -> str:
    return f"quantile_cont(mae, {p / 100})"


@query(
    "score_quartiles",
    o.chain(o.SCORES)
    + f""" SELECT soc, round({_pct(25)}, 6) AS q1, round({_pct(50)}, 6) AS q2, round({_pct(75)}, 6) AS q3
    FROM scores GROUP BY soc""",
)
def score_quartiles(spark, folder):
    return metrics.quartiles(order_scores(spark, folder)).select("soc", r6("q1"), r6("q2"), r6("q3"))


@query(
    "score_boxes",
    o.chain(o.SCORES)
    + f""" SELECT soc, round({_pct(10)}, 6) AS p10, round({_pct(25)}, 6) AS q1, round({_pct(50)}, 6) AS q2,
           round({_pct(75)}, 6) AS q3, round({_pct(90)}, 6) AS p90 FROM scores GROUP BY soc""",
)
def score_boxes(spark, folder):
    boxes = metrics.box_stats(order_scores(spark, folder), ["soc"], "mae")
    return boxes.select("soc", *[r6(c) for c in ("p10", "q1", "q2", "q3", "p90")])


@query(
    "model_summary",
    o.chain(o.SCORES)
    + f""" SELECT model, round(avg(mae), 6) AS mean_mae, round(stddev_pop(mae), 6) AS std_mae, count(*) AS samples,
           {', '.join(f'round({_pct(p)}, 6) AS p{p}' for p in (3, 10, 90, 95, 97))} FROM scores GROUP BY model""",
)
def model_summary(spark, folder):
    table = metrics.model_summary(order_scores(spark, folder))
    numbers = [c for c in table.columns if c not in ("model", "samples")]
    return table.select("model", "samples", *[r6(c) for c in numbers])


@query(
    "best_model",
    o.chain(o.SCORES)
    + """ SELECT model, round(m, 6) AS mean_mae FROM
    (SELECT model, avg(mae) AS m FROM scores WHERE soc = 100 GROUP BY model ORDER BY m, model LIMIT 1)""",
)
def best_model(spark, folder):
    full = order_scores(spark, folder).where(F.col("soc") == 100)
    return metrics.best_model(full).select("model", r6("mean_mae"))


PCT_LIST = ", ".join(str(p / 100) for p in metrics.PERCENTS)
THRESHOLDS = f"""
th AS (
  SELECT model, unnest([{', '.join(str(p) for p in metrics.PERCENTS)}]) AS pct, unnest(v) AS threshold
  FROM (SELECT model, quantile_cont(mae, [{PCT_LIST}]) AS v FROM scores WHERE soc = 100 GROUP BY model)
),
thr AS (SELECT model, pct, round(threshold, 9) AS threshold FROM th)"""


def _thresholds(scores):
    table = metrics.thresholds(scores.where(F.col("soc") == 100))
    return table.withColumn("threshold", F.round("threshold", 9))


@query(
    "threshold_percentiles",
    o.chain(o.SCORES, THRESHOLDS) + " SELECT model, pct, round(threshold, 6) AS threshold FROM thr",
)
def threshold_percentiles(spark, folder):
    return _thresholds(order_scores(spark, folder)).select("model", "pct", r6("threshold"))


@query(
    "single_threshold",
    o.chain(o.SCORES)
    + f""" SELECT model, {MAP_PERCENT} AS pct, round({_pct(MAP_PERCENT)}, 6) AS threshold
    FROM scores WHERE soc = 100 GROUP BY model""",
)
def single_threshold(spark, folder):
    table = metrics.percentile_threshold(order_scores(spark, folder), MAP_PERCENT)
    return table.select("model", "pct", r6("threshold"))


def _confusion_sql(source: str) -> str:
    return f"""
cm AS (
  SELECT t.model, t.pct, t.threshold,
         count(*) FILTER (WHERE soc < 95 AND mae >= threshold) AS tp,
         count(*) FILTER (WHERE soc >= 95 AND mae >= threshold) AS fp,
         count(*) FILTER (WHERE soc >= 95 AND mae < threshold) AS tn,
         count(*) FILTER (WHERE soc < 95 AND mae < threshold) AS fn
  FROM thr t JOIN {source} s ON t.model = s.model GROUP BY t.model, t.pct, t.threshold
),
rt AS (
  SELECT *, tp / nullif(tp + fp, 0) AS prc, tp / nullif(tp + fn, 0) AS rcl, fp / nullif(fp + tn, 0) AS fpr FROM cm
),
sweep AS (SELECT *, 2 * prc * rcl / nullif(prc + rcl, 0) AS f FROM rt)"""


SWEEP = _confusion_sql("scores")
SWEEP_COLUMNS = """model, pct, round(threshold, 6) AS threshold, tp, fp, tn, fn, round(prc, 6) AS precision,
           round(rcl, 6) AS recall, round(fpr, 6) AS fpr, round(f, 6) AS f"""


def _rounded_sweep(sweep):
    rates = ["threshold", "precision", "recall", "fpr", "f"]
    return sweep.select("model", "pct", "tp", "fp", "tn", "fn", *[r6(c) for c in rates])


def _sweep(scores):
    return metrics.rates(metrics.confusion(scores, _thresholds(scores)))


@query("threshold_sweep", o.chain(o.SCORES, THRESHOLDS, SWEEP) + f" SELECT {SWEEP_COLUMNS} FROM sweep")
def threshold_sweep(spark, folder):
    return _rounded_sweep(_sweep(order_scores(spark, folder)))


@query(
    "sweep_table",
    o.chain(o.SCORES, THRESHOLDS, SWEEP)
    + """ SELECT model, pct, round(threshold, 3) AS threshold, round(prc, 3) AS precision, round(rcl, 3) AS recall
    FROM sweep""",
)
def sweep_table(spark, folder):
    return metrics.evaluation_table(_sweep(order_scores(spark, folder)))


@query(
    "box_mode",
    o.chain(o.SCORES, THRESHOLDS, SWEEP) + f" SELECT {SWEEP_COLUMNS} FROM sweep WHERE pct = {metrics.BOX_PERCENT}",
)
def box_mode(spark, folder):
    scores = order_scores(spark, folder)
    one = metrics.percentile_threshold(scores, metrics.BOX_PERCENT).withColumn("threshold", F.round("threshold", 9))
    return _rounded_sweep(metrics.rates(metrics.confusion(scores, one)))


@query(
    "best_threshold",
    o.chain(o.SCORES, THRESHOLDS, SWEEP)
    + f""" SELECT {SWEEP_COLUMNS} FROM
    (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f DESC NULLS LAST, pct) AS k FROM sweep) WHERE k = 1""",
)
def best_threshold(spark, folder):
    return _rounded_sweep(metrics.best_threshold(_sweep(order_scores(spark, folder))))


def _population_sql(cuts) -> str:
    picks = " ".join(f"WHEN u >= {bound}e0 THEN {soc}" for bound, soc in cuts)
    return f"""
pop AS (
  SELECT * FROM (SELECT *, {o.draw(metrics.POPULATION_SEED, 'sample_id')} AS u FROM scores)
  WHERE soc = CASE {picks} ELSE 100 END
)"""


SWEEP_POPULATION = _population_sql(metrics.SWEEP_POPULATION)
MAP_POPULATION = _population_sql(metrics.MAP_POPULATION)


@query(
    "mixed_population",
    o.chain(o.SCORES, SWEEP_POPULATION) + " SELECT model, sample_id, soc, round(mae, 6) AS mae FROM pop",
)
def mixed_population(spark, folder):
    mixed = metrics.mixed_population(order_scores(spark, folder))
    return mixed.select("model", "sample_id", "soc", r6("mae"))


def _population_sweep(spark, folder):
    scores = order_scores(spark, folder)
    return metrics.rates(metrics.confusion(metrics.mixed_population(scores), _thresholds(scores)))


MIXED_SWEEP = _confusion_sql("pop")


@query(
    "roc_points",
    o.chain(o.SCORES, THRESHOLDS, SWEEP_POPULATION, MIXED_SWEEP)
    + " SELECT model, pct, round(fpr, 6) AS fpr, round(rcl, 6) AS recall, CAST(pct AS INTEGER) AS ordinal FROM sweep",
)
def roc_points(spark, folder):
    points = metrics.roc_points(_population_sweep(spark, folder))
    return points.select("model", "pct", r6("fpr"), r6("recall"), "ordinal")


@query(
    "population_sweep_table",
    o.chain(o.SCORES, THRESHOLDS, SWEEP_POPULATION, MIXED_SWEEP)
    + """ SELECT model, pct, round(threshold, 3) AS threshold, round(prc, 3) AS precision, round(rcl, 3) AS recall
    FROM sweep""",
)
def population_sweep_table(spark, folder):
    """The threshold table over the mixed population, as a run of the evaluation prints it."""
    return metrics.evaluation_table(_population_sweep(spark, folder))


@query(
    "population_best_threshold",
    o.chain(o.SCORES, THRESHOLDS, SWEEP_POPULATION, MIXED_SWEEP)
    + f""" SELECT {SWEEP_COLUMNS} FROM
    (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f DESC NULLS LAST, pct) AS k FROM sweep) WHERE k = 1""",
)
def population_best_threshold(spark, folder):
    return _rounded_sweep(metrics.best_threshold(_population_sweep(spark, folder)))


@query(
    "area_under_roc",
    o.chain(o.SCORES, THRESHOLDS, SWEEP_POPULATION, MIXED_SWEEP)
    + """ SELECT model, round(abs(sum((fpr - pf) * (rcl + pr) / 2)), 6) AS auroc FROM
    (SELECT *, lag(fpr) OVER (PARTITION BY model ORDER BY pct) AS pf,
            lag(rcl) OVER (PARTITION BY model ORDER BY pct) AS pr FROM sweep) GROUP BY model""",
)
def area_under_roc(spark, folder):
    points = metrics.roc_points(_population_sweep(spark, folder))
    return metrics.area_under(points).select("model", r6("auroc"))


FLAGS = f"""
lim AS (
  SELECT model, round({_pct(MAP_PERCENT)}, 9) AS threshold FROM scores WHERE soc = 100 GROUP BY model
),
fl AS (
  SELECT p.model, sample_id, soc, mae, CAST(mae >= threshold AND soc < 95 AS INTEGER) AS tp,
         CAST(mae >= threshold AND soc >= 95 AS INTEGER) AS fp, CAST(mae < threshold AND soc >= 95 AS INTEGER) AS tn,
         CAST(mae < threshold AND soc < 95 AS INTEGER) AS fn
  FROM pop p JOIN lim ON p.model = lim.model
)"""
CURVES = """
pc AS (
  SELECT model, sample_id, mae, h / nullif(r, 0) AS rcl, h / nullif(h + m, 0) AS prc FROM (
    SELECT *, sum(tp) OVER w AS h, sum(fp) OVER w AS m FROM
      (SELECT *, sum(tp + fn) OVER (PARTITION BY model) AS r FROM fl) WHERE tp = 1 OR fp = 1
    WINDOW w AS (PARTITION BY model ORDER BY mae DESC, sample_id ROWS UNBOUNDED PRECEDING))
),
nc AS (
  SELECT model, sample_id, mae, h / nullif(r, 0) AS rcl, h / nullif(h + m, 0) AS prc FROM (
    SELECT *, sum(tn) OVER w AS h, sum(fn) OVER w AS m FROM
      (SELECT *, sum(tn + fp) OVER (PARTITION BY model) AS r FROM fl) WHERE tn = 1 OR fn = 1
    WINDOW w AS (PARTITION BY model ORDER BY mae, sample_id ROWS UNBOUNDED PRECEDING))
)"""
MAP_CHAIN = (o.SCORES, MAP_POPULATION, FLAGS, CURVES)


def _flags(spark, folder):
    """Flags of the mixed population, and the measured bounds of its models."""
    scores = order_scores(spark, folder)
    hot = find_hot(scores, ["model"])
    limit = metrics.percentile_threshold(scores, MAP_PERCENT, hot).withColumn("threshold", F.round("threshold", 9))
    return metrics.flagged(metrics.mixed_population(scores, metrics.MAP_POPULATION), limit), hot


@query(
    "map_flags",
    o.chain(*MAP_CHAIN) + " SELECT model, sample_id, soc, round(mae, 6) AS mae, tp, fp, tn, fn FROM fl",
)
def map_flags(spark, folder):
    flags, _ = _flags(spark, folder)
    return flags.select("model", "sample_id", "soc", r6("mae"), "tp", "fp", "tn", "fn")


CURVE_COLUMNS = "model, sample_id, round(mae, 6) AS mae, round(rcl, 6) AS rcl, round(prc, 6) AS prc"


def _rounded_curve(curve):
    return curve.select("model", "sample_id", r6("mae"), r6("rcl"), r6("prc"))


@query("positive_curve", o.chain(*MAP_CHAIN) + f" SELECT {CURVE_COLUMNS} FROM pc")
def positive_curve(spark, folder):
    flags, hot = _flags(spark, folder)
    return _rounded_curve(metrics.running_curve(stage(flags), True, hot))


@query("negative_curve", o.chain(*MAP_CHAIN) + f" SELECT {CURVE_COLUMNS} FROM nc")
def negative_curve(spark, folder):
    flags, hot = _flags(spark, folder)
    return _rounded_curve(metrics.running_curve(stage(flags), False, hot))


@query(
    "precision_at_150",
    o.chain(*MAP_CHAIN)
    + """ SELECT model, round(sum(tp) / 150, 6) AS precision_at_k FROM
    (SELECT *, row_number() OVER (PARTITION BY model ORDER BY mae DESC, sample_id) AS k FROM fl) WHERE k <= 150
    GROUP BY model""",
)
def precision_at_150(spark, folder):
    flags, _ = _flags(spark, folder)
    return metrics.precision_at(flags).select("model", r6("precision_at_k"))


@query(
    "flagged_subsets",
    o.chain(*MAP_CHAIN)
    + """ SELECT model, count(*) FILTER (WHERE tp = 1 OR fp = 1) AS predicted_degraded,
           count(*) FILTER (WHERE tn = 1 OR fn = 1) AS predicted_healthy FROM fl GROUP BY model""",
)
def flagged_subsets(spark, folder):
    flags, _ = _flags(spark, folder)
    hit, miss = (F.col("tp") == 1) | (F.col("fp") == 1), (F.col("tn") == 1) | (F.col("fn") == 1)
    return flags.groupBy("model").agg(
        F.count(F.when(hit, 1)).alias("predicted_degraded"), F.count(F.when(miss, 1)).alias("predicted_healthy")
    )


@query(
    "map_report",
    o.chain(*MAP_CHAIN)
    + """,
    tt AS (SELECT model, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(tn) AS BIGINT) AS tn,
                  CAST(sum(fn) AS BIGINT) AS fn FROM fl GROUP BY model),
    rr AS (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS r, fp / (fp + tn) AS fpr, tn / (tn + fn) AS np,
                  tn / (tn + fp) AS nr FROM tt),
    top AS (SELECT model, sum(tp) / 150 AS pk FROM
      (SELECT *, row_number() OVER (PARTITION BY model ORDER BY mae DESC, sample_id) AS k FROM fl) WHERE k <= 150
      GROUP BY model),
    pa AS (SELECT model, avg(prc) AS a FROM pc GROUP BY model),
    na AS (SELECT model, avg(prc) AS a FROM nc GROUP BY model)
    SELECT rr.model, tp, fp, tn, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(fpr, 6) AS fpr,
           round(2 * p * r / (p + r), 6) AS f, round(np, 6) AS neg_precision, round(nr, 6) AS neg_recall,
           round(2 * np * nr / (np + nr), 6) AS neg_f, round(pa.a, 6) AS pos_ap, round(na.a, 6) AS neg_ap,
           round((pa.a + na.a) / 2, 6) AS map, round(pk, 6) AS precision_at_k
    FROM rr JOIN top USING (model) JOIN pa USING (model) JOIN na USING (model)""",
)
def map_report(spark, folder):
    *_, report = metrics.map_report(order_scores(spark, folder), MAP_PERCENT)
    counts = ["model", "tp", "fp", "tn", "fn"]
    return report.select(*counts, *[r6(c) for c in report.columns if c not in counts])


@query(
    "huber_losses",
    """
    WITH e AS (SELECT l_returnflag, (l_quantity - 25e0) / 10e0 AS e FROM lineitem)
    SELECT l_returnflag, round(avg(CASE WHEN abs(e) < 1 THEN 0.5e0 * e * e ELSE abs(e) - 0.5e0 END), 6) AS huber,
           round(avg(CASE WHEN abs(e) < 0.5e0 THEN 0.5e0 * e * e ELSE 0.5e0 * (abs(e) - 0.25e0) END), 6) AS huber_half,
           round(avg(abs(e)), 6) AS mae
    FROM e GROUP BY l_returnflag""",
)
def huber_losses(spark, folder):
    error = (F.col("l_quantity") - 25.0) / 10.0
    return (
        views.table(spark, folder, "lineitem")
        .groupBy("l_returnflag")
        .agg(
            r6(F.avg(huber(error)), "huber"),
            r6(F.avg(huber(error, 0.5)), "huber_half"),
            r6(F.avg(F.abs(error)), "mae"),
        )
    )


@query(
    "vector_losses",
    """
    WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    h AS (SELECT vec_id, x - round(x, 1) AS d, abs(x) AS a FROM e)
    SELECT vec_id, round(avg(abs(d)), 6) AS mae, round(avg(CASE WHEN abs(d) < 1 THEN 0.5e0 * d * d
           ELSE abs(d) - 0.5e0 END), 6) AS huber,
           round(avg(0.5e0 * d * d) + avg(a), 6) AS sparse
    FROM h GROUP BY vec_id""",
)
def vector_losses(spark, folder):
    vectors = views.table(spark, folder, "embeddings").select(
        "vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x")
    )
    coarse = vectors.withColumn("y", F.transform("x", lambda v: F.round(v, 1)))
    x, y = F.col("x"), F.col("y")
    return coarse.select(
        "vec_id",
        r6(array_mae(x, y), "mae"),
        r6(array_huber(x, y), "huber"),
        r6(sparse_loss(x, y, x), "sparse"),
    )


@query(
    "seeded_draws",
    f"SELECT o_orderkey, round({o.draw(42, 'o_orderkey')}, 9) AS u FROM orders",
)
def seeded_draws(spark, folder):
    orders = views.table(spark, folder, "orders")
    return orders.select("o_orderkey", F.round(uniform(F.col("o_orderkey"), seed=42), 9).alias("u"))


HISTORY = """
hist AS (
  SELECT 'K_' || CAST(1 + l_suppkey % 5 AS VARCHAR) AS model, l_partkey AS epoch,
         CASE WHEN l_linenumber % 2 = 0 THEN 'loss' ELSE 'val_loss' END AS metric, avg(l_discount) AS value
  FROM lineitem GROUP BY ALL
)"""


@query(
    "learning_curve",
    o.chain(HISTORY)
    + """ SELECT model, epoch, metric, round(value, 6) AS value FROM hist
    WHERE epoch < 400 AND ((metric = 'val_loss' AND epoch % 50 = 0) OR (metric = 'loss' AND epoch % 500 = 0))""",
)
def learning_curve(spark, folder):
    """Line items stand in for a training history; the strides are the report's own."""
    lines = views.table(spark, folder, "lineitem")
    history = (
        lines.select(
            F.concat(F.lit("K_"), (1 + F.col("l_suppkey") % 5).cast("string")).alias("model"),
            F.col("l_partkey").alias("epoch"),
            F.when(F.col("l_linenumber") % 2 == 0, "loss").otherwise("val_loss").alias("metric"),
            "l_discount",
        )
        .groupBy("model", "epoch", "metric")
        .agg(F.avg("l_discount").alias("value"))
    )
    return stores.learning_curve(history).select("model", "epoch", "metric", r6("value"))

"""Queries with the draws of a sequential run: the seeded generator's own numbers, found in parallel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ampwise.functions import twister
from ampwise.operators import folds, metrics
from ampwise.operators.numbering import numbered
from ampwise.operators.steps import blow_rows
from ampwise.plans import oracle_parts as o
from ampwise.plans.learning_queries import K, recursive
from ampwise.plans.metric_queries import CURVES, FLAGS, MAP_PERCENT, SWEEP_COLUMNS, THRESHOLDS, _confusion_sql, _rounded_sweep, _thresholds
from ampwise.plans.registry import query, r6
from ampwise.plans.synthetic_queries import DEGRADE_CUTS, SYNTHETIC, synthetic_steps
from ampwise.schema import EPISODE
from ampwise.sources import views

SEED = metrics.POPULATION_SEED


@query(
    "stream_draws",
    recursive(
        "id AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS draw FROM orders)",
        o.twister(SEED, "SELECT 2 * count(*) FROM orders"),
        o.stream_draws(),
    )
    + " SELECT o_orderkey, draw, u FROM id JOIN dr USING (draw)",
)
def stream_draws(spark, folder):
    """A draw for every order, in the order of their keys."""
    orders = views.table(spark, folder, "orders").select("o_orderkey", F.lit(0).alias("_all"))
    named = numbered(orders, "_all", ["o_orderkey"], total="_n", index="draw")
    drawn = twister.draws(spark, orders.count(), SEED)
    return named.join(drawn, "draw").select("o_orderkey", "draw", "u")


def _population(cuts) -> str:
    picks = " ".join(f"WHEN u >= {bound}e0 THEN {soc}" for bound, soc in cuts)
    return f"""
pop AS (
  SELECT s.model, s.soc, s.sample_id, s.mae FROM scores s
  JOIN (SELECT model, sample_id, row_number() OVER (PARTITION BY model ORDER BY sample_id) - 1 AS draw
        FROM (SELECT DISTINCT model, sample_id FROM scores)) USING (model, sample_id)
  JOIN dr USING (draw)
  WHERE s.soc = CASE {picks} ELSE 100 END
)"""


STREAM = (o.SCORES, o.twister(SEED, "SELECT 2 * count(*) FROM orders"), o.stream_draws())


@query(
    "stream_population",
    recursive(*STREAM, THRESHOLDS, _population(metrics.SWEEP_POPULATION), _confusion_sql("pop")) + f" SELECT {SWEEP_COLUMNS} FROM sweep",
)
def stream_population(spark, folder):
    """The threshold sweep over the mixed population that a sequential run draws."""
    scores = views.order_scores(spark, folder)
    return _rounded_sweep(metrics.rates(metrics.confusion(metrics.stream_population(scores), _thresholds(scores))))


@query(
    "stream_map_curve",
    recursive(*STREAM, _population(metrics.MAP_POPULATION), FLAGS, CURVES)
    + " SELECT model, sample_id, round(mae, 6) AS mae, round(rcl, 6) AS rcl, round(prc, 6) AS prc FROM pc",
)
def stream_map_curve(spark, folder):
    """The running precision of the map table's population, as a sequential run draws it."""
    scores = views.order_scores(spark, folder)
    limit = metrics.percentile_threshold(scores, MAP_PERCENT).withColumn("threshold", F.round("threshold", 9))
    flags = metrics.flagged(metrics.stream_population(scores, metrics.MAP_POPULATION), limit)
    curve = metrics.running_curve(flags)
    return curve.select("model", "sample_id", r6("mae"), r6("rcl"), r6("prc"))


def _permuted(seed: int, things: str) -> tuple[str, ...]:
    """``perm`` of the things, in the order of their names, of ``things``; a step takes fewer than two words on average."""
    return (
        f"nm AS (SELECT thing, row_number() OVER (ORDER BY thing) - 1 AS item FROM (SELECT DISTINCT thing FROM {things}))",
        o.twister(seed, f"SELECT 40 * count(*) + 2000 + 2 * (SELECT count(*) FROM (SELECT DISTINCT thing, month_idx, ep_idx FROM {things})) FROM nm"),
        o.stream_permutation("SELECT count(*) FROM nm"),
    )


def _filled(things: str, k: int) -> str:
    return f"""
sz AS (
  SELECT thing, n, place + 1 AS i FROM (SELECT thing, count(*) AS n FROM (SELECT DISTINCT thing, month_idx, ep_idx FROM {things}) GROUP BY thing)
  JOIN nm USING (thing) JOIN perm USING (item)
),
cap AS (SELECT sum(n) // {k} AS cap FROM sz),
fill(i, thing, n, fold, filled) AS (
  SELECT CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT), 0, CAST(0 AS BIGINT)
  UNION ALL
  SELECT sz.i, sz.thing, sz.n,
         CASE WHEN filled + sz.n > cap AND fold < {k - 1} THEN fold + 1 ELSE fold END,
         CASE WHEN filled + sz.n > cap AND fold < {k - 1} THEN sz.n ELSE filled + sz.n END
  FROM fill JOIN sz ON sz.i = fill.i + 1 CROSS JOIN cap
),
fm AS (SELECT thing, n, fold, i - 1 AS place FROM fill WHERE i > 0)"""


CUSTOMERS = "c AS (SELECT CAST(o_custkey AS VARCHAR) AS thing, 0 AS month_idx, o_orderkey AS ep_idx FROM orders)"


@query(
    "stream_fold_map",
    recursive(CUSTOMERS, *_permuted(folds.FOLD_SEED, "c"), _filled("c", K)) + " SELECT thing, n, place, fold FROM fm",
)
def stream_fold_map(spark, folder):
    """Customers in the seeded permutation of their names, filled into folds."""
    rows = views.table(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("thing"), F.lit(0).alias("month_idx"), F.col("o_orderkey").alias("ep_idx")
    )
    return folds.stream_fold_map(folds.thing_sizes(rows), K).select("thing", "n", F.col("order").alias("place"), "fold")


HEALTHY_EPISODES = "he AS (SELECT DISTINCT thing, month_idx, ep_idx FROM syn WHERE soc = 100)"


@query(
    "stream_degraded_folds",
    recursive(
        *SYNTHETIC,
        HEALTHY_EPISODES,
        *_permuted(folds.DEGRADED_FOLD_SEED, "he"),
        o.stream_draws(first="SELECT words FROM used"),
        _filled("he", K),
    )
    + """,
    eps AS (SELECT thing, month_idx, ep_idx, row_number() OVER (ORDER BY place, month_idx, ep_idx) - 1 AS draw FROM he JOIN fm USING (thing)),
    pick AS (SELECT *, CASE WHEN u < 0.1e0 THEN 80 WHEN u < 0.2e0 THEN 85 WHEN u < 0.35e0 THEN 90 ELSE 100 END AS soc FROM eps JOIN dr USING (draw))
    SELECT fold, thing, month_idx, ep_idx, soc, count(*) AS rows FROM syn JOIN pick USING (thing, month_idx, ep_idx, soc) JOIN fm USING (thing)
    GROUP BY ALL""",
)
def stream_degraded_folds(spark, folder):
    """Every episode with the level and the fold that a sequential run gives it."""
    mixed = folds.stream_degraded_folds(blow_rows(synthetic_steps(spark, folder)), DEGRADE_CUTS, K)
    return mixed.groupBy("fold", *EPISODE, "soc").agg(F.count(F.lit(1)).alias("rows"))

"""Folds, scaling, sample arrays and reconstruction over the synthetic blows of the shaped signal."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ampwise.functions.numeric import uniform
from ampwise.operators import folds, group_models, metrics, reconstruct, scaling
from ampwise.operators.quantiles import percentiles
from ampwise.operators.steps import blow_rows
from ampwise.plans import evaluate
from ampwise.plans import oracle_parts as o
from ampwise.plans.metric_queries import PCT_LIST, SWEEP
from ampwise.plans.registry import query, r6
from ampwise.plans.synthetic_queries import (
    DEGRADE_CUTS,
    DEGRADE_SEED,
    DEGRADE_SQL,
    FULL_BOUNDS,
    SYNTHETIC,
    synthetic,
    synthetic_steps,
)
from ampwise.schema import EPISODE
from ampwise.session import stage
from ampwise.sources import views

K = 6
BATCH = 64
ORDER = o.draw(folds.FOLD_SEED, "thing")


def fold_sql(source: str, k: int = K, order: str = ORDER) -> str:
    """``fm``: the greedy fill as a recursion over the ordered things."""
    return f"""
sz AS (
  SELECT thing, n, row_number() OVER (ORDER BY u, thing) AS i FROM (
    SELECT thing, count(*) AS n, {order} AS u
    FROM (SELECT DISTINCT thing, month_idx, ep_idx FROM {source}) GROUP BY thing)
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
fm AS (SELECT thing, n, fold FROM fill WHERE i > 0)"""


def recursive(*parts: str) -> str:
    return o.chain(*parts).replace("WITH ", "WITH RECURSIVE ", 1)


def _order():
    return uniform(F.col("thing"), seed=folds.FOLD_SEED)


HEALTHY = "syn WHERE soc = 100"


def _folded(spark, folder):
    """Synthetic blows with their steps, and the folds of their things."""
    found = synthetic_steps(spark, folder)
    return found, _folds(found)


def _folds(found):
    return folds.fold_map(folds.thing_sizes(found.where(F.col("soc") == 100)), K, _order())


def _healthy_folds(spark, folder):
    """The folds need the blows at full health only."""
    return _folds(synthetic_steps(spark, folder, (100,)))


@query("fold_map", recursive(*SYNTHETIC, fold_sql(HEALTHY)) + " SELECT thing, n, fold FROM fm")
def fold_map(spark, folder):
    return _healthy_folds(spark, folder).select("thing", "n", "fold")


LINE_FOLDS = 5


@query(
    "fold_map_customers",
    recursive(
        "c AS (SELECT CAST(o_custkey AS VARCHAR) AS thing, 0 AS month_idx, o_orderkey AS ep_idx FROM orders)",
        fold_sql("c", LINE_FOLDS),
    )
    + " SELECT thing, n, fold FROM fm",
)
def fold_map_customers(spark, folder):
    """Uneven group sizes: customers as things, orders as episodes."""
    orders = views.table(spark, folder, "orders")
    rows = orders.select(
        F.col("o_custkey").cast("string").alias("thing"), F.lit(0).alias("month_idx"), F.col("o_orderkey").alias("ep_idx")
    )
    return folds.fold_map(folds.thing_sizes(rows), LINE_FOLDS, _order()).select("thing", "n", "fold")


@query(
    "fold_index",
    recursive(*SYNTHETIC, fold_sql(HEALTHY))
    + """ SELECT fold, fm.thing, month_idx, ep_idx, arg_min(us, blow_pos) AS us
    FROM syn JOIN fm ON syn.thing = fm.thing WHERE soc = 100 GROUP BY fold, fm.thing, month_idx, ep_idx""",
)
def fold_index(spark, folder):
    found, fold = _folded(spark, folder)
    index = folds.fold_index(blow_rows(found.where(F.col("soc") == 100)), fold)
    return index.select("fold", *EPISODE, F.unix_micros("start_ts").alias("us"))


@query(
    "fold_splits",
    recursive(*SYNTHETIC, fold_sql(HEALTHY))
    + f""",
    sp AS (SELECT a.v AS split, b.v AS fold FROM (VALUES (0), (1), (2), (3), (4)) a(v) CROSS JOIN
           (VALUES (0), (1), (2), (3), (4)) b(v))
    SELECT split, CASE WHEN split = sp.fold THEN 'valid' ELSE 'train' END AS role, CAST(sum(n) AS BIGINT) AS episodes
    FROM sp JOIN fm ON sp.fold = fm.fold GROUP BY 1, 2""",
)
def fold_splits(spark, folder):
    fold = _healthy_folds(spark, folder)
    plan = folds.leave_one_fold_out(spark, K - 1)
    return plan.join(fold, "fold").groupBy("split", "role").agg(F.sum("n").alias("episodes"))


@query(
    "fold_roles",
    recursive(*SYNTHETIC, fold_sql(HEALTHY))
    + """ SELECT CASE WHEN fold = 5 THEN 'test' ELSE 'learn' END AS role,
           CASE fold WHEN 0 THEN 'unused' WHEN 1 THEN 'valid' ELSE 'train' END AS search_role,
           CAST(sum(n) AS BIGINT) AS episodes, count(*) AS things FROM fm GROUP BY 1, 2""",
)
def fold_roles(spark, folder):
    fold = _healthy_folds(spark, folder)
    roles = [folds.hold_out_role(F.col("fold")).alias("role"), folds.search_role(F.col("fold")).alias("search_role")]
    return fold.groupBy(*roles).agg(F.sum("n").alias("episodes"), F.count(F.lit(1)).alias("things"))


@query(
    "degraded_folds",
    recursive(*SYNTHETIC, DEGRADE_SQL, fold_sql(HEALTHY))
    + """ SELECT fold, soc, count(*) AS rows, count(DISTINCT (fm.thing, month_idx, ep_idx)) AS episodes
    FROM deg JOIN fm ON deg.thing = fm.thing WHERE soc = pick GROUP BY fold, soc""",
)
def degraded_folds(spark, folder):
    mixed = folds.degraded_folds(synthetic(spark, folder), DEGRADE_CUTS, K, DEGRADE_SEED, _order())
    return mixed.groupBy("fold", "soc").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(*EPISODE).alias("episodes")
    )


@query(
    "scaler_bounds",
    o.chain(*SYNTHETIC, o.BOUNDS.format(source="syn"))
    + """ SELECT round(c_lo, 6) AS current_lo, round(v_lo, 6) AS voltage_lo, round(c_hi, 6) AS current_hi,
           round(v_hi, 6) AS voltage_hi FROM sc""",
)
def scaler_bounds(spark, folder):
    bounds = scaling.fit_bounds(synthetic(spark, folder))
    return bounds.select(*[r6(c) for c in bounds.columns])


SAMPLES = """
x AS (
  SELECT soc, thing, month_idx, ep_idx, 2 * blow_pos + k AS i,
         CASE k WHEN 0 THEN (cur - c_lo) * 2 / (c_hi - c_lo) - 1 ELSE (volt - v_lo) * 2 / (v_hi - v_lo) - 1 END AS v
  FROM syn CROSS JOIN sc CROSS JOIN (VALUES (0), (1)) AS side(k)
)"""
SAMPLE_KEYS = ["soc", *EPISODE]


@query(
    "sample_arrays",
    o.chain(*SYNTHETIC, FULL_BOUNDS, SAMPLES)
    + " SELECT soc, thing, month_idx, ep_idx, CAST(i AS INTEGER) AS i, round(v, 6) AS v FROM x",
)
def sample_arrays(spark, folder):
    samples, _ = evaluate.prepare(synthetic_steps(spark, folder))
    return samples.select(*SAMPLE_KEYS, F.posexplode("x").alias("i", "v")).withColumn("v", r6("v"))


@query(
    "batch_compatible",
    o.chain(*SYNTHETIC)
    + f""" SELECT soc, thing, month_idx, ep_idx FROM (
      SELECT *, row_number() OVER (PARTITION BY soc ORDER BY thing, month_idx, ep_idx) AS k,
             count(*) OVER (PARTITION BY soc) AS n
      FROM (SELECT DISTINCT soc, thing, month_idx, ep_idx FROM syn)) WHERE k <= n - n % {BATCH}""",
)
def batch_compatible(spark, folder):
    samples = stage(synthetic_steps(spark, folder).select(*SAMPLE_KEYS))
    return scaling.batch_compatible(samples, EPISODE, BATCH, ["soc"])


@query(
    "batch_compatible_whole",
    o.chain(*SYNTHETIC)
    + f""" SELECT thing, month_idx, ep_idx FROM (
      SELECT *, row_number() OVER (ORDER BY thing, month_idx, ep_idx) AS k, count(*) OVER () AS n
      FROM (SELECT DISTINCT thing, month_idx, ep_idx FROM syn)) WHERE k <= n - n % 128""",
)
def batch_compatible_whole(spark, folder):
    samples = stage(synthetic_steps(spark, folder).select(*EPISODE).distinct())
    return scaling.batch_compatible(samples, EPISODE, 128)


@query(
    "sample_moments",
    recursive(*SYNTHETIC, FULL_BOUNDS, SAMPLES, fold_sql(HEALTHY))
    + """,
    one AS (SELECT thing, month_idx, ep_idx, i + 1 AS i, v FROM x WHERE soc = 100
            UNION ALL SELECT DISTINCT thing, month_idx, ep_idx, 0, 1e0 FROM x WHERE soc = 100)
    SELECT fold, CAST(a.i * 41 + b.i AS INTEGER) AS entry, round(sum(a.v * b.v), 5) AS value
    FROM one a JOIN one b USING (thing, month_idx, ep_idx) JOIN fm ON fm.thing = a.thing GROUP BY 1, 2""",
)
def sample_moments(spark, folder):
    found, fold = _folded(spark, folder)
    samples, _ = evaluate.prepare(found)
    healthy = folds.assign_folds(samples.where(F.col("soc") == 100), fold)
    table = reconstruct.moments(healthy, "fold")
    return table.select("fold", "entry", F.round("value", 5).alias("value"))


def _evaluation(spark, folder) -> evaluate.Evaluation:
    found, fold = _folded(spark, folder)
    return evaluate.run(found, fold)


EVALUATED = recursive(
    *SYNTHETIC,
    FULL_BOUNDS,
    SAMPLES,
    fold_sql(HEALTHY),
    "xf AS MATERIALIZED (SELECT soc, x.thing, month_idx, ep_idx, i, v, fold FROM x JOIN fm ON fm.thing = x.thing)",
    f"split AS (SELECT f FROM range({K - 1}) AS r(f))",
    f"""lin AS (SELECT f, i, sum(v) / count(*) AS m, count(*) AS n FROM xf JOIN split ON fold <> f
            WHERE soc = 100 AND fold < {K - 1} GROUP BY f, i)""",
    f"""mom AS (SELECT a.fold, a.i, b.i AS j, sum(a.v * b.v) AS s FROM xf a JOIN xf b USING (soc, thing, month_idx, ep_idx)
            WHERE soc = 100 AND a.fold < {K - 1} GROUP BY a.fold, a.i, b.i)""",
    """cov AS (SELECT l.f, t.i, t.j, t.s / l.n - l.m * r.m AS v
            FROM (SELECT f, i, j, sum(s) AS s FROM mom JOIN split ON fold <> f GROUP BY f, i, j) t
            JOIN lin l ON l.f = t.f AND l.i = t.i JOIN lin r ON r.f = t.f AND r.i = t.j)""",
    "mat AS (SELECT f, list(v ORDER BY i, j) AS a FROM cov GROUP BY f)",
    o.eigenvectors("mat", 40),
    f"basis AS MATERIALIZED (SELECT f, k, i, v AS c FROM eig WHERE k < {reconstruct.CODE_SIZE})",
)


def _errors_sql(name: str, samples: str) -> str:
    """``name``: mean absolute error of samples (f, soc, thing, month_idx, ep_idx, i, v) under the model of their ``f``."""
    keys = "f, soc, thing, month_idx, ep_idx"
    return f"""
{name}_gap AS MATERIALIZED (SELECT s.*, v - m AS g FROM ({samples}) s JOIN lin USING (f, i)),
{name}_code AS (SELECT {keys}, k, sum(g * c) AS code FROM {name}_gap JOIN basis USING (f, i) GROUP BY {keys}, k),
{name} AS (
  SELECT {keys}, avg(abs(g - hat)) AS mae FROM {name}_gap
  JOIN (SELECT {keys}, i, sum(code * c) AS hat FROM {name}_code JOIN basis USING (f, k) GROUP BY {keys}, i) USING ({keys}, i)
  GROUP BY {keys}
)"""


VALIDATED = EVALUATED + "," + _errors_sql("val", f"SELECT fold AS f, * EXCLUDE (fold) FROM xf WHERE soc = 100 AND fold < {K - 1}")
CHOSEN = f"""{VALIDATED},
best AS (SELECT f FROM val GROUP BY f ORDER BY avg(mae), f LIMIT 1),
thr AS (SELECT 'K_' || (f + 1) AS model, unnest([{", ".join(str(p) for p in metrics.PERCENTS)}]) AS pct,
        unnest(quantile_cont(mae, [{PCT_LIST}])) AS threshold FROM val JOIN best USING (f) GROUP BY f)"""
LEVEL_LIST = ", ".join(str(s) for s in metrics.HEALTH_LEVELS)
SCORED = (
    CHOSEN
    + ","
    + _errors_sql("test", f"SELECT f, xf.* EXCLUDE (fold) FROM xf CROSS JOIN best WHERE fold = {K - 1} AND soc IN ({LEVEL_LIST})")
    + ", scores AS (SELECT 'K_' || (f + 1) AS model, * EXCLUDE (f) FROM test)"
)


@query(
    "validation_scores",
    VALIDATED + " SELECT 'K_' || (f + 1) AS model, f AS fold, thing, month_idx, ep_idx, round(mae, 6) AS mae FROM val",
)
def validation_scores(spark, folder):
    result = _evaluation(spark, folder)
    return result.validation.select("model", "fold", *EPISODE, r6("mae"))


@query(
    "health_scores",
    SCORED
    + """ SELECT model, soc, thing || '/' || CAST(month_idx AS VARCHAR) || '/' || CAST(ep_idx AS VARCHAR) AS sample_id,
           round(mae, 6) AS mae FROM scores""",
)
def health_scores(spark, folder):
    result = _evaluation(spark, folder)
    return result.scores.select("model", "soc", "sample_id", r6("mae"))


@query("health_thresholds", CHOSEN + " SELECT model, pct, round(threshold, 6) AS threshold FROM thr")
def health_thresholds(spark, folder):
    result = _evaluation(spark, folder)
    return result.thresholds.select("model", "pct", r6("threshold"))


@query(
    "health_sweep",
    SCORED
    + ","
    + SWEEP
    + """ SELECT model, pct, tp, fp, tn, fn, round(prc, 6) AS precision, round(rcl, 6) AS recall, round(f, 6) AS f FROM sweep""",
)
def health_sweep(spark, folder):
    result = _evaluation(spark, folder)
    sweep = metrics.rates(metrics.confusion(result.scores, result.thresholds))
    return sweep.select("model", "pct", "tp", "fp", "tn", "fn", r6("precision"), r6("recall"), r6("f"))


@query(
    "health_score_boxes",
    SCORED
    + """ SELECT soc, round(quantile_cont(mae, 0.1), 6) AS p10, round(quantile_cont(mae, 0.25), 6) AS q1,
           round(quantile_cont(mae, 0.5), 6) AS q2, round(quantile_cont(mae, 0.75), 6) AS q3,
           round(quantile_cont(mae, 0.9), 6) AS p90 FROM scores GROUP BY soc""",
)
def health_score_boxes(spark, folder):
    boxes = metrics.box_stats(_evaluation(spark, folder).scores, ["soc"], "mae")
    return boxes.select("soc", *[r6(c) for c in ("p10", "q1", "q2", "q3", "p90")])


def _one_model(samples: str, width: int = 40, size: int = reconstruct.CODE_SIZE) -> str:
    """``lin`` and ``basis`` of one model (f = 0) fitted on ``samples`` (id, i, v)."""
    return f"""
fit AS MATERIALIZED ({samples}),
lin AS (SELECT 0 AS f, i, sum(v) / count(*) AS m, count(*) AS n FROM fit GROUP BY i),
cov AS (SELECT 0 AS f, t.i, t.j, t.s / l.n - l.m * r.m AS v
        FROM (SELECT a.i, b.i AS j, sum(a.v * b.v) AS s FROM fit a JOIN fit b USING (id) GROUP BY a.i, b.i) t
        JOIN lin l ON l.i = t.i JOIN lin r ON r.i = t.j),
mat AS (SELECT f, list(v ORDER BY i, j) AS a FROM cov GROUP BY f),
{o.eigenvectors("mat", width)},
basis AS MATERIALIZED (SELECT f, k, i, v AS c FROM eig WHERE k < {size})"""


SAMPLE_ID = "(soc, thing, month_idx, ep_idx) AS id"


@query(
    "code_projection",
    recursive(*SYNTHETIC, FULL_BOUNDS, SAMPLES, _one_model(f"SELECT {SAMPLE_ID}, i, v FROM x WHERE soc = 100"))
    + """,
    side AS (SELECT k, CASE WHEN arg_max(c, abs(c)) < 0 THEN -1 ELSE 1 END AS sign FROM basis GROUP BY k),
    code AS (SELECT soc, thing, month_idx, ep_idx, k, sum((v - m) * c * sign) AS code
             FROM x JOIN lin USING (i) JOIN basis USING (i) JOIN side USING (k) WHERE k < 2 GROUP BY ALL)
    SELECT soc, thing, month_idx, ep_idx, round(max(CASE WHEN k = 0 THEN code END), 6) AS axis_1,
           round(max(CASE WHEN k = 1 THEN code END), 6) AS axis_2 FROM code GROUP BY ALL""",
)
def code_projection(spark, folder):
    samples, _ = evaluate.prepare(synthetic_steps(spark, folder))
    model = reconstruct.fit_one(samples.where(F.col("soc") == 100), reconstruct.CODE_SIZE)
    shown = reconstruct.project(samples, model)
    return shown.select(*SAMPLE_KEYS, r6("axis_1"), r6("axis_2"))


@query(
    "code_size_search",
    recursive(
        *SYNTHETIC,
        FULL_BOUNDS,
        SAMPLES,
        fold_sql(HEALTHY),
        "xf AS MATERIALIZED (SELECT x.thing, month_idx, ep_idx, i, v, fold FROM x JOIN fm ON fm.thing = x.thing WHERE soc = 100)",
        _one_model("SELECT (thing, month_idx, ep_idx) AS id, i, v FROM xf WHERE fold > 1", size=max(reconstruct.SEARCH_SIZES)),
    )
    + f""",
    held AS (SELECT (thing, month_idx, ep_idx) AS id, i, v - m AS g FROM xf JOIN lin USING (i) WHERE fold = 1),
    code AS MATERIALIZED (SELECT id, k, sum(g * c) AS code FROM held JOIN basis USING (i) GROUP BY id, k),
    hat AS (SELECT size, id, i, sum(code * c) AS hat
            FROM (SELECT unnest([{", ".join(map(str, reconstruct.SEARCH_SIZES))}]) AS size) JOIN basis ON k < size JOIN code USING (k)
            GROUP BY size, id, i),
    err AS (SELECT size, id, avg(abs(g - hat)) AS mae,
                   avg(CASE WHEN abs(g - hat) < 1 THEN 0.5e0 * (g - hat) * (g - hat) ELSE abs(g - hat) - 0.5e0 END) AS huber
            FROM hat JOIN held USING (id, i) GROUP BY size, id)
    SELECT size, round(avg(mae), 6) AS mean_mae, round(quantile_cont(mae, 0.9), 6) AS p90_mae,
           round(avg(mae) + quantile_cont(mae, 0.9), 6) AS score, round(avg(huber), 6) AS mean_huber FROM err GROUP BY size""",
)
def code_size_search(spark, folder):
    found, fold = _folded(spark, folder)
    return evaluate.size_search(found, fold).select("size", r6("mean_mae"), r6("p90_mae"), r6("score"), r6("mean_huber"))


WIDTH = 64
COSINES = 13
COSINE_SIZES = (1, 4, 13)
COSINE_SQL = f"""
v AS (
  SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings
),
b AS (
  SELECT i, k, sqrt(2e0 / {WIDTH}) * cos(pi() * (i + 0.5e0) * k / {WIDTH}) AS c
  FROM range({WIDTH}) AS t(i), range(1, {COSINES + 1}) AS s(k)
),
code AS (SELECT vec_id, k, sum((x - i / 100e0) * c) AS code FROM v JOIN b USING (i) GROUP BY vec_id, k),
gap AS (
  SELECT size, vec_id, i, abs(any_value(x) - any_value(i / 100e0) - sum(code * c)) AS g
  FROM (VALUES {", ".join(f"({s})" for s in COSINE_SIZES)}) AS z(size) JOIN b ON k <= size
  JOIN code USING (k) JOIN v USING (vec_id, i) GROUP BY size, vec_id, i
)"""


def _cosine_model() -> reconstruct.LinearModel:
    """An orthonormal basis given by a formula, which SQL can repeat: what follows from a model can so be checked."""
    i, k = np.arange(WIDTH)[:, None], np.arange(1, COSINES + 1)[None, :]
    return reconstruct.LinearModel("cosine", np.arange(WIDTH) / 100, np.sqrt(2 / WIDTH) * np.cos(np.pi * (i + 0.5) * k / WIDTH))


def _vectors(spark, folder):
    vectors = views.table(spark, folder, "embeddings")
    return vectors.select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))


@query(
    "cosine_scores",
    o.chain(COSINE_SQL) + f" SELECT vec_id, round(avg(g), 6) AS mae FROM gap WHERE size = {COSINES} GROUP BY vec_id",
)
def cosine_scores(spark, folder):
    named = _vectors(spark, folder).withColumn("model", F.lit("cosine"))
    return reconstruct.score(named, [_cosine_model()]).select("vec_id", r6("mae"))


@query(
    "cosine_codes",
    o.chain(COSINE_SQL) + " SELECT vec_id, CAST(k - 1 AS INTEGER) AS k, round(code, 6) AS code FROM code",
)
def cosine_codes(spark, folder):
    named = _vectors(spark, folder).withColumn("model", F.lit("cosine"))
    coded = reconstruct.reconstruct(named, [_cosine_model()])
    return coded.select("vec_id", F.posexplode("code").alias("k", "code")).withColumn("code", r6("code"))


@query(
    "cosine_axes",
    o.chain(COSINE_SQL)
    + """ SELECT vec_id, round(max(CASE WHEN k = 1 THEN code END), 6) AS axis_1,
           round(max(CASE WHEN k = 2 THEN code END), 6) AS axis_2 FROM code GROUP BY vec_id""",
)
def cosine_axes(spark, folder):
    shown = reconstruct.project(_vectors(spark, folder), _cosine_model())
    return shown.select("vec_id", r6("axis_1"), r6("axis_2"))


@query(
    "cosine_sizes",
    o.chain(COSINE_SQL)
    + """ SELECT vec_id, CAST(size AS INTEGER) AS size, round(avg(g), 6) AS mae,
           round(avg(CASE WHEN g < 1 THEN 0.5e0 * g * g ELSE g - 0.5e0 END), 6) AS huber FROM gap GROUP BY vec_id, size""",
)
def cosine_sizes(spark, folder):
    errors = reconstruct.size_errors(_vectors(spark, folder), _cosine_model(), COSINE_SIZES)
    return errors.select("vec_id", "size", r6("mae"), r6("huber"))


@query(
    "fitted_variance",
    """SELECT round(sum(variance), 4) AS total_variance, 0e0 AS full_width_error FROM (
      SELECT i, var_pop(x) AS variance FROM (
        SELECT CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i)""",
)
def fitted_variance(spark, folder):
    """A fitted basis splits the variance: that of the codes and what is left over add up to that of the data, and a basis
    of full width leaves nothing."""
    vectors = _vectors(spark, folder)
    narrow, whole = (reconstruct.fit_one(vectors, n, f"size_{n}") for n in (reconstruct.CODE_SIZE, WIDTH))
    coded = reconstruct.reconstruct(vectors.withColumn("model", F.lit(narrow.name)), [narrow])
    left = F.aggregate(F.zip_with("x", "x_hat", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, g: s + g)
    held = F.aggregate(F.transform("code", lambda c: c * c), F.lit(0.0), lambda s, g: s + g)
    split = coded.agg(F.avg(left + held).alias("total_variance"))
    scored = reconstruct.score(vectors.withColumn("model", F.lit(whole.name)), [whole])
    rest = scored.agg(F.max("mae").alias("full_width_error"))
    return split.join(F.broadcast(rest)).select(F.round("total_variance", 4).alias("total_variance"), r6("full_width_error"))


LABEL_CODE = 16
LABEL_MODELS = recursive(
    """xf AS MATERIALIZED (SELECT vec_id AS id, label AS fold, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v
       FROM embeddings)""",
    "split AS (SELECT DISTINCT fold AS f FROM xf)",
    "lin AS (SELECT f, i, sum(v) / count(*) AS m, count(*) AS n FROM xf JOIN split ON fold <> f GROUP BY f, i)",
    "mom AS (SELECT a.fold, a.i, b.i AS j, sum(a.v * b.v) AS s FROM xf a JOIN xf b USING (id) GROUP BY a.fold, a.i, b.i)",
    """cov AS (SELECT l.f, t.i, t.j, t.s / l.n - l.m * r.m AS v
            FROM (SELECT f, i, j, sum(s) AS s FROM mom JOIN split ON fold <> f GROUP BY f, i, j) t
            JOIN lin l ON l.f = t.f AND l.i = t.i JOIN lin r ON r.f = t.f AND r.i = t.j)""",
    "mat AS (SELECT f, list(v ORDER BY i, j) AS a FROM cov GROUP BY f)",
    o.eigenvectors("mat", WIDTH),
    f"basis AS MATERIALIZED (SELECT f, k, i, v AS c, value FROM eig WHERE k < {LABEL_CODE})",
)


def _label_samples(spark, folder):
    return views.table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("sample_id"), F.col("label").alias("fold"), F.transform("embedding", lambda v: v.cast("double")).alias("x")
    )


@query(
    "reconstruction_by_label",
    LABEL_MODELS
    + """,
    gap AS MATERIALIZED (SELECT f, id, i, v - m AS g FROM (SELECT fold AS f, id, i, v FROM xf) JOIN lin USING (f, i)),
    code AS (SELECT f, id, k, sum(g * c) AS code FROM gap JOIN basis USING (f, i) GROUP BY f, id, k),
    hat AS (SELECT f, id, i, sum(code * c) AS hat FROM code JOIN basis USING (f, k) GROUP BY f, id, i),
    err AS (SELECT f AS fold, id, avg(abs(g - hat)) AS mae FROM gap JOIN hat USING (f, id, i) GROUP BY f, id)
    SELECT fold, round(avg(mae), 6) AS mean_mae, count(*) AS samples FROM err GROUP BY fold""",
)
def reconstruction_by_label(spark, folder):
    """Wide vectors, one left-out model per label; models and samples meet in tasks."""
    vectors = stage(_label_samples(spark, folder))
    models = stage(group_models.fit_left_out(vectors, "fold", LABEL_CODE))
    scored = group_models.score_by(vectors, models, "fold")
    return scored.groupBy("fold").agg(r6(F.avg("mae"), "mean_mae"), F.count(F.lit(1)).alias("samples"))


@query(
    "left_out_models",
    LABEL_MODELS
    + """
    SELECT f AS fold, any_value(n) AS n, CAST(k + 1 AS INTEGER) AS component, round(any_value(value), 6) AS variance,
           round(any_value(trace), 6) AS trace, 0e0 AS residual
    FROM basis JOIN lin USING (f, i) JOIN (SELECT f, sum(v) AS trace FROM cov WHERE i = j GROUP BY f) USING (f)
    GROUP BY f, k""",
)
def left_out_models(spark, folder):
    """Variances of the left-out models, and by how much their components fail to be eigenvectors."""
    models = group_models.fit_left_out(stage(_label_samples(spark, folder)), "fold", LABEL_CODE)
    shown = models.select("fold", "n", "trace", "residual", F.posexplode("variances").alias("k", "variance"))
    return shown.select("fold", "n", (F.col("k") + 1).alias("component"), r6("variance"), r6("trace"), r6("residual"))


@query(
    "error_percentiles_by_supplier",
    """
    SELECT CAST(l_suppkey AS VARCHAR) AS thing, round(quantile_cont(l_extendedprice, 0.03), 6) AS p3,
           round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.97), 6) AS p97
    FROM lineitem GROUP BY l_suppkey""",
)
def error_percentiles_by_supplier(spark, folder):
    lines = views.table(spark, folder, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("thing"), "l_extendedprice"
    )
    table = percentiles(lines, ["thing"], "l_extendedprice", [0.03, 0.5, 0.97])
    return table.select("thing", *[r6(F.col("values")[i], name) for i, name in enumerate(("p3", "p50", "p97"))])

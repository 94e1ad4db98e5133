"""Building blocks of the check SQL. Written from the definitions, row by row, independent of the Spark plans."""

from __future__ import annotations

from ampwise.schema import Params

SOCS = (100, 95, 90, 85, 80)

EVENTS = """
tel AS (
  SELECT CAST(user_id AS VARCHAR) AS thing, ts, event_id AS seq,
         round(40e0 - value, 2) AS cur, value AS volt
  FROM events
)"""


def lines(tick_s: int = 1, shaped: bool = False) -> str:
    if shaped:
        cur = """CAST(CASE (tick % 40) // 10 WHEN 0 THEN 0 WHEN 1 THEN -20 WHEN 2 THEN 20 ELSE 1 END
                  + CASE WHEN l_quantity > 49 THEN 9 ELSE 0 END AS DOUBLE)"""
    else:
        cur = "25e0 - l_quantity"
    return f"""
ticks AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS thing, l_quantity, l_discount,
         row_number() OVER (PARTITION BY l_suppkey
                            ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS tick
  FROM lineitem
),
tel AS (
  SELECT thing, TIMESTAMP '2024-01-01 00:00:00' + (tick * {tick_s}) * INTERVAL 1 SECOND AS ts, tick AS seq,
         {cur} AS cur, 22e0 + l_discount * 40e0 + l_quantity / 10e0 AS volt
  FROM ticks
)"""


def candidates(p: Params, clean: bool = False) -> str:
    """``cand``: thing, yr, mo, start_rn, next_rn, end_rn, status. Also leaves ``s``: all rows with their position."""
    g = "PARTITION BY thing, yr, mo ORDER BY us, seq"

    def cnt(flag: str, lo: str, hi: str) -> str:
        return f"count(*) FILTER (WHERE {flag}) OVER ({g} ROWS BETWEEN {lo} AND {hi})"

    ahead = "CURRENT ROW" if p.eps2 == 1 else f"{p.eps2 - 1} FOLLOWING"
    dis_ahead = "CURRENT ROW" if p.alpha1 == 1 else f"{p.alpha1 - 1} FOLLOWING"
    rows = f"""
r AS (
  SELECT thing, CAST(year(ts) AS INTEGER) AS yr, CAST(month(ts) AS INTEGER) AS mo, epoch_us(ts) AS us, seq, cur, volt,
         cur <= {p.discharge} AS dis, cur >= {p.charge} AS chg, cur BETWEEN -{p.rest} AND {p.rest} AS rest
  FROM tel
),
w AS (
  SELECT *, row_number() OVER ({g}) - 1 AS rn,
         max(CASE WHEN dis THEN us END) OVER ({g} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_dis,
         {cnt('rest', f'{p.eps1} PRECEDING', '1 PRECEDING')} AS rest_before,
         {cnt('dis', 'CURRENT ROW', dis_ahead)} AS dis_ahead,
         {cnt('rest', 'CURRENT ROW', ahead)} AS rest_ahead,
         {cnt('chg', 'UNBOUNDED PRECEDING', '1 PRECEDING')} AS chg_before,
         lag(us, {p.eps1}) OVER ({g}) AS s_us,
         lead(us, {p.eps2}) OVER ({g}) AS e_us
  FROM r
),
v AS (
  SELECT *, lead(chg_before, {p.alpha1}) OVER ({g}) AS chg_at_seek,
         dis AND prev_dis IS NOT NULL AND (us - prev_dis) // 1000000 > {p.gap_s} AS is_start
  FROM w
),
s AS (
  SELECT *, sum(CASE WHEN is_start THEN 1 ELSE 0 END) OVER ({g} ROWS UNBOUNDED PRECEDING) AS seg FROM v
),
starts AS (
  SELECT * FROM (
    SELECT thing, yr, mo, seg, rn AS start_rn, rest_before, dis_ahead, s_us, chg_at_seek,
           lead(rn) OVER (PARTITION BY thing, yr, mo ORDER BY rn) AS next_rn
    FROM s WHERE is_start)
  WHERE next_rn IS NOT NULL
)"""
    if clean:
        ends = """
found AS (
  SELECT a.thing, a.yr, a.mo, a.start_rn, coalesce(min(CASE WHEN s.cur > -10 THEN s.rn END), a.next_rn) AS end_rn
  FROM starts a JOIN s ON a.thing = s.thing AND a.yr = s.yr AND a.mo = s.mo AND a.seg = s.seg
  GROUP BY a.thing, a.yr, a.mo, a.start_rn, a.next_rn
),
ended AS (
  SELECT f.*, s.us AS e_us FROM found f
  JOIN s ON f.thing = s.thing AND f.yr = s.yr AND f.mo = s.mo AND f.end_rn = s.rn
)"""
        end_rn = "e.end_rn"
    else:
        ends = f"""
stops AS (
  SELECT thing, yr, mo, seg, rn, e_us, chg_before FROM s WHERE rest_ahead = {p.eps2}
  UNION ALL
  SELECT thing, yr, mo, seg - 1, rn, e_us, chg_before FROM s WHERE rest_ahead = {p.eps2} AND is_start
),
ended AS (
  SELECT a.thing, a.yr, a.mo, a.start_rn, min(t.rn) AS end_rn, arg_min(coalesce(t.e_us, -1), t.rn) AS e_us_or_none
  FROM starts a JOIN stops t ON a.thing = t.thing AND a.yr = t.yr AND a.mo = t.mo AND a.seg = t.seg
  WHERE t.rn > a.start_rn + {p.alpha1} AND t.rn <= a.next_rn AND t.chg_before - a.chg_at_seek >= {p.alpha2}
  GROUP BY a.thing, a.yr, a.mo, a.start_rn
)"""
        end_rn = f"e.end_rn + {p.eps2}"
    e_us = "e.e_us" if clean else "nullif(e.e_us_or_none, -1)"
    verdict = f"""
judged AS (
  SELECT a.thing, a.yr, a.mo, a.start_rn, a.next_rn, {end_rn} AS end_rn,
         CASE WHEN rest_before <> {p.eps1} THEN 'context'
              WHEN dis_ahead <> {p.alpha1} THEN 'noise'
              WHEN e.end_rn IS NULL OR {e_us} IS NULL THEN 'incomplete'
              WHEN ({e_us} - s_us) // 1000000 > (next_rn - a.start_rn) * {p.period_s} THEN 'inconsistent'
              ELSE 'valid' END AS status
  FROM starts a LEFT JOIN ended e
    ON a.thing = e.thing AND a.yr = e.yr AND a.mo = e.mo AND a.start_rn = e.start_rn
),
cand AS (
  SELECT thing, yr, mo, start_rn, next_rn,
         CASE WHEN status IN ('valid', 'inconsistent') THEN end_rn END AS end_rn, status
  FROM judged
)"""
    return f"{rows},{ends},{verdict}"


def headers(p: Params) -> str:
    """``cal``: month ordinals. ``head``: numbered valid episodes."""
    return f"""
cal AS (
  SELECT thing, yr, mo, CAST(row_number() OVER (PARTITION BY thing ORDER BY yr, mo) - 1 AS INTEGER) AS month_idx
  FROM (SELECT DISTINCT thing, yr, mo FROM r)
),
head AS (
  SELECT c.thing, c.yr, c.mo, cal.month_idx,
         CAST(row_number() OVER (PARTITION BY c.thing, c.yr, c.mo ORDER BY start_rn) - 1 AS INTEGER) AS ep_idx,
         start_rn - {p.eps1} AS lo, start_rn, next_rn, end_rn
  FROM cand c JOIN cal ON c.thing = cal.thing AND c.yr = cal.yr AND c.mo = cal.mo
  WHERE status = 'valid'
)"""


EPISODE_ROWS = """
ep AS (
  SELECT h.thing, h.month_idx, h.ep_idx, CAST(s.rn - h.lo AS INTEGER) AS pos, s.us, s.seq, s.cur, s.volt
  FROM (SELECT thing, yr, mo, month_idx, ep_idx, lo, unnest(range(lo, end_rn)) AS spot FROM head) h
  JOIN s ON h.thing = s.thing AND h.yr = s.yr AND h.mo = s.mo AND s.rn = h.spot
)"""


def blows(p: Params) -> str:
    """``blow``: rows of both parts. Starts never lie before the episode in these views."""
    return f"""
anchor AS (
  SELECT thing, month_idx, ep_idx, count(*) AS n,
         min(CASE WHEN cur <= {p.discharge} THEN pos END) AS d, min(CASE WHEN cur >= {p.charge} THEN pos END) AS c
  FROM ep GROUP BY thing, month_idx, ep_idx
),
bounds AS (
  SELECT * FROM (
    SELECT thing, month_idx, ep_idx,
           CASE WHEN d < {p.eps1} THEN greatest(n + d - {p.eps1}, 0) ELSE d - {p.eps1} END AS d_lo,
           least(d + {p.alpha1}, n) AS d_hi,
           CASE WHEN c < {p.alpha1} THEN greatest(n + c - {p.alpha1}, 0) ELSE c - {p.alpha1} END AS c_lo,
           least(c + {p.alpha2}, n) AS c_hi
    FROM anchor WHERE d IS NOT NULL AND c IS NOT NULL)
  WHERE d_lo < d_hi AND c_lo < c_hi
),
blow AS (
  SELECT e.thing, e.month_idx, e.ep_idx, 'discharge' AS part, CAST(pos - d_lo AS INTEGER) AS part_pos,
         CAST(pos - d_lo AS INTEGER) AS blow_pos, us, cur, volt
  FROM ep e JOIN bounds b ON e.thing = b.thing AND e.month_idx = b.month_idx AND e.ep_idx = b.ep_idx
  WHERE pos >= d_lo AND pos < d_hi
  UNION ALL
  SELECT e.thing, e.month_idx, e.ep_idx, 'charge', CAST(pos - c_lo AS INTEGER),
         CAST(pos - c_lo + d_hi - d_lo AS INTEGER), us, cur, volt
  FROM ep e JOIN bounds b ON e.thing = b.thing AND e.month_idx = b.month_idx AND e.ep_idx = b.ep_idx
  WHERE pos >= c_lo AND pos < c_hi
)"""


def level_table(socs=SOCS) -> str:
    return "(VALUES " + ", ".join(f"({s})" for s in socs) + ") AS lv(soc)"


def traces(socs=SOCS) -> str:
    """``trace``: the episode rows as simulated at each health level."""
    return f"""
trace AS (
  SELECT thing, soc, month_idx, ep_idx, pos, us, cur, volt * soc / 100e0 AS volt
  FROM ep CROSS JOIN {level_table(socs)}
)"""


def synthetic(width: int) -> str:
    """``syn``: synthetic blows, by timestamp, of exactly ``width`` rows."""
    return f"""
looked AS (
  SELECT b.thing, t.soc, b.month_idx, b.ep_idx, b.part, b.blow_pos, b.us, t.cur, t.volt
  FROM blow b JOIN trace t ON b.thing = t.thing AND b.us = t.us
),
syn AS (
  SELECT thing, soc, month_idx, ep_idx, part, blow_pos, us, cur, volt FROM (
    SELECT *, count(*) OVER (PARTITION BY soc, thing, month_idx, ep_idx) AS n FROM looked)
  WHERE n = {width}
)"""


BOUNDS = """
sc AS (
  SELECT least(min(cur), 0e0) AS c_lo, greatest(max(cur), 0e0) AS c_hi,
         least(min(volt), 22e0) AS v_lo, greatest(max(volt), 36e0) AS v_hi
  FROM {source}
)"""

SCORES = f"""
scores AS (
  SELECT 'K_' || CAST(1 + o_custkey % 5 AS VARCHAR) AS model, soc, o_orderkey AS sample_id,
         CAST(CAST(round(o_totalprice * 100e0) AS BIGINT) % 1000 AS DOUBLE) / 1000e0
           * (1e0 + CAST(100 - soc AS DOUBLE) / 20e0) AS mae
  FROM orders CROSS JOIN {level_table()}
)"""


def draw(seed: int, *parts: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"(CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT) / 4294967296e0)"


def chain(*parts: str) -> str:
    return "WITH " + ",".join(part.strip("\n") if i else part for i, part in enumerate(parts))


SWEEPS = 10  # of rotations; a matrix of forty columns is diagonal to the last digits after eight


def eigenvectors(source: str, width: int, name: str = "eig") -> str:
    """``<name>``: (f, k, i, value, v), eigenvectors by falling eigenvalue (k from 0) of symmetric matrices (f, a).

    Jacobi's method: in every round each column is rotated with a partner so that their common entry vanishes; partners
    change as in a tournament. Matrices are lists, row by row. Needs WITH RECURSIVE and an even width.
    """
    last = width - 1
    partner = f"CASE WHEN i = {last} THEN r WHEN i = r THEN {last} ELSE (2 * r - i + {2 * last}) % {last} END"
    return f"""
{name}_turn(f, t, a, v) AS (
  SELECT f, 0, a, list_transform(range({width * width}), lambda z: CASE WHEN z // {width} = z % {width} THEN 1e0 ELSE 0e0 END)
  FROM {source}
  UNION ALL
  SELECT f, t + 1,
         list_transform(range({width * width}), lambda z:
           c[z // {width} + 1] * (c[z % {width} + 1] * a[z + 1] + d[z % {width} + 1] * a[z - z % {width} + p[z % {width} + 1] + 1])
           + d[z // {width} + 1] * (c[z % {width} + 1] * a[p[z // {width} + 1] * {width} + z % {width} + 1]
                                   + d[z % {width} + 1] * a[p[z // {width} + 1] * {width} + p[z % {width} + 1] + 1])),
         list_transform(range({width * width}), lambda z:
           c[z % {width} + 1] * v[z + 1] + d[z % {width} + 1] * v[z - z % {width} + p[z % {width} + 1] + 1])
  FROM (
    SELECT f, t, a, v, p, list_transform(g, lambda y: 1e0 / sqrt(1e0 + y * y)) AS c,
           list_transform(range({width}), lambda i: CASE WHEN i < p[i + 1] THEN -1e0 ELSE 1e0 END * g[i + 1] / sqrt(1e0 + g[i + 1] * g[i + 1])) AS d
    FROM (
      SELECT f, t, a, v, p, list_transform(range({width}), lambda i: CASE
               WHEN a[i * {width} + p[i + 1] + 1] = 0 THEN 0e0
               ELSE (CASE WHEN h[i + 1] < 0 THEN -1e0 ELSE 1e0 END) / (abs(h[i + 1]) + sqrt(1e0 + h[i + 1] * h[i + 1])) END) AS g
      FROM (
        SELECT f, t, a, v, p, list_transform(range({width}), lambda i:
                 (a[greatest(i, p[i + 1]) * {width + 1} + 1] - a[least(i, p[i + 1]) * {width + 1} + 1])
                 / nullif(2e0 * a[i * {width} + p[i + 1] + 1], 0)) AS h
        FROM (SELECT f, t, a, v, list_transform(range({width}), lambda i: {partner}) AS p
              FROM (SELECT *, t % {last} AS r FROM {name}_turn WHERE t < {SWEEPS * last}))))
  )
),
{name} AS (
  SELECT f, row_number() OVER (PARTITION BY f, i ORDER BY value DESC, j) - 1 AS k, i, value, v FROM (
    SELECT f, z // {width} AS i, z % {width} AS j, a[(z % {width}) * {width + 1} + 1] AS value, v[z + 1] AS v
    FROM (SELECT f, a, v, unnest(range({width * width})) AS z FROM {name}_turn WHERE t = {SWEEPS * last}))
)"""


def twister(seed: int, words: str, name: str = "mt") -> str:
    """``<name>``: (pos, w), the words of the seeded generator from its first on, ``words`` (a scalar query) or more.

    The generator as published: its state is filled from the seed, then renewed as a whole; renewal depends on words renewed
    before, so it goes in three stretches. Needs WITH RECURSIVE.
    """

    def step(x: str, y: str) -> str:
        mixed = f"(({x} & 2147483648) | ({y} & 2147483647))"
        return f"xor({mixed} >> 1, CASE WHEN {mixed} & 1 = 1 THEN 2567483615 ELSE 0 END)"

    old = step("x[k + 1]", "x[k + 2]")
    return f"""
{name}_seed(i, s) AS (
  SELECT 0, {seed}::BIGINT UNION ALL
  SELECT i + 1, (1812433253 * xor(s, s >> 30) + i + 1) & 4294967295 FROM {name}_seed WHERE i < 623
),
{name}_block(b, x) AS (
  SELECT 0, list(s ORDER BY i) FROM {name}_seed
  UNION ALL
  SELECT b + 1, list_concat(one, two, three, [xor(two[170], {step("x[624]", "one[1]")})]) FROM (
    SELECT *, list_transform(range(454, 623), lambda k: xor(two[k - 453], {old})) AS three FROM (
      SELECT *, list_transform(range(227, 454), lambda k: xor(one[k - 226], {old})) AS two FROM (
        SELECT *, list_transform(range(227), lambda k: xor(x[k + 398], {old})) AS one
        FROM {name}_block WHERE b * 624 < ({words}))))
),
{name} AS MATERIALIZED (
  SELECT pos, xor(w, w >> 18) AS w FROM (
    SELECT pos, xor(w, (w << 15) & 4022730752) AS w FROM (
      SELECT pos, xor(w, (w << 7) & 2636928640) AS w FROM (
        SELECT (b - 1) * 624 + generate_subscripts(x, 1) - 1 AS pos, unnest(list_transform(x, lambda w: xor(w, w >> 11))) AS w
        FROM {name}_block WHERE b > 0)))
)"""


def stream_draws(name: str = "mt", first: str = "0") -> str:
    """``dr``: (draw, u), the uniform draws from word ``first`` on, two words each."""
    return f"""
dr AS (
  SELECT (pos - ({first})) // 2 AS draw,
         (max(CASE WHEN (pos - ({first})) % 2 = 0 THEN w >> 5 END) * 67108864e0 + max(CASE WHEN (pos - ({first})) % 2 = 1 THEN w >> 6 END))
         / 9007199254740992e0 AS u
  FROM {name} WHERE pos >= ({first}) GROUP BY (pos - ({first})) // 2 HAVING count(*) = 2
)"""


def stream_permutation(count: str, name: str = "mt") -> str:
    """``perm``: (place, item) of 0 .. count - 1, and ``used``: the words it took. Each step takes words, cut to the bits
    needed, until one is in range."""
    return f"""
shuf(i, pos, a) AS (
  SELECT n - 1, 0::BIGINT, range(n) FROM (SELECT ({count}) AS n)
  UNION ALL
  SELECT CASE WHEN j <= i THEN i - 1 ELSE i END, pos + 1,
         CASE WHEN j < i THEN list_transform(range(len(a)), lambda z: CASE WHEN z = i THEN a[j + 1] WHEN z = j THEN a[i + 1] ELSE a[z + 1] END)
              ELSE a END
  FROM (SELECT s.i, s.pos, s.a, mt.w & ((1 << (floor(log2(s.i))::INT + 1)) - 1) AS j FROM shuf s JOIN {name} mt ON mt.pos = s.pos WHERE s.i > 0)
),
used AS (SELECT max(pos) AS words FROM shuf),
perm AS (SELECT generate_subscripts(a, 1) - 1 AS place, unnest(a) AS item FROM shuf WHERE i <= 0)"""

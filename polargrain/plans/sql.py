"""Fragments of the SQL that states the queries' results over the test views."""

from __future__ import annotations

import math

from polargrain.plans.config import GridParams

GRID = GridParams()
POINTS = """p AS (SELECT l_linenumber AS frame, l_orderkey * 10 + l_linenumber AS pid, l_partkey AS k1, l_suppkey AS k2,
  0.526::DOUBLE + 2.4::DOUBLE * (l_partkey % 40) AS r, (((l_suppkey * 7 + l_orderkey) % 36) * 20)::INT AS sector,
  l_quantity / 10 - 2 AS z, ((l_suppkey + l_orderkey) % 4)::INT AS cls FROM lineitem)"""
XYZ = f"""{POINTS}, v AS (SELECT *, (sector + 0.5::DOUBLE) * {math.pi!r}::DOUBLE / 360 - {math.pi!r}::DOUBLE AS theta FROM p),
xyz AS (SELECT *, r * cos(theta) AS x, r * sin(theta) AS y, (pid % 100) / 100.0::DOUBLE AS remission FROM v)"""
EDGES = f"e AS (SELECT unnest(range({GRID.n_rings}))::INT AS ring, unnest({[float(x) for x in GRID.edges[:-1]]}::DOUBLE[]) AS r_in, unnest({[float(x) for x in GRID.edges[1:]]}::DOUBLE[]) AS r_out, unnest({[float(x) for x in GRID.widths]}::DOUBLE[]) AS width)"
MAJORITY = "CASE WHEN c0 = greatest(c0, c1, c2, c3) THEN 0 WHEN c1 = greatest(c0, c1, c2, c3) THEN 1 WHEN c2 = greatest(c0, c1, c2, c3) THEN 2 ELSE 3 END::INT"
TALLIES = ", ".join(f"count(*) FILTER (cls = {k}) AS c{k}" for k in range(4))
CELLS = f"""{POINTS}, {EDGES},
loc AS (SELECT p.*, e.ring FROM p ASOF JOIN e ON p.r >= e.r_in WHERE p.r BETWEEN {GRID.r_min} AND {GRID.r_max} AND z BETWEEN {GRID.z_min} AND {GRID.z_max}),
c0 AS (SELECT frame, ring, sector, (ring::BIGINT * {GRID.n_theta} + sector) AS cell, count(*) AS n_pts, min(z) AS z_min, max(z) AS z_max, avg(z) AS z_mean, {TALLIES} FROM loc GROUP BY ALL),
cells AS (SELECT *, {MAJORITY} AS cls, 1.0::DOUBLE AS occ FROM c0)"""
GROUND = """g0 AS (SELECT frame, count(*) FILTER (r > 1.5 AND r < 15 AND z > -8 AND z < 4) AS n_near, quantile_cont(z, 0.2) FILTER (r > 1.5 AND r < 15 AND z > -8 AND z < 4) AS q FROM p GROUP BY frame),
g AS (SELECT frame, n_near, coalesce(last_value(CASE WHEN n_near >= 128 THEN q END IGNORE NULLS) OVER (ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS ground_z FROM g0)"""


def clip(x: str) -> str:
    return f"least(greatest({x}, 0.0::DOUBLE), 1.0::DOUBLE)"


def d6(x: str) -> str:
    """Six places by way of decimals, which round ties alike everywhere."""
    return f"round(({x})::DECIMAL(28,9), 6)::DOUBLE"


SCORE = "CASE cls WHEN 0 THEN 1.0 WHEN 1 THEN 0.6 WHEN 2 THEN 0.2 WHEN 3 THEN 0.1 ELSE 0 END::DOUBLE"
TRAV = f"t AS (SELECT c.*, g.ground_z, z_max - ground_z AS height, (0.25::DOUBLE * {clip('1 - greatest(z_max - ground_z, 0) / 1.25::DOUBLE')} + 0.25::DOUBLE * {clip('1 - greatest(z_max - ground_z - 0.15::DOUBLE, 0) / 0.4::DOUBLE')} + 0.35::DOUBLE * {SCORE} + 0.15::DOUBLE * {clip('occ')}) / 1.0::DOUBLE AS trav FROM cells c JOIN g USING (frame)), tt AS (SELECT *, CASE WHEN trav >= 0.7 THEN 0 WHEN trav >= 0.4 THEN 1 ELSE 2 END::INT AS tier FROM t)"
SEQUENCE = """s AS (SELECT '00' AS seq_id, ((l_orderkey * 31 + l_linenumber) % 24 + 1)::INT AS frame, (l_partkey % 40) * 720 + (l_suppkey * 7 + l_orderkey) % 12 AS cell,
  0.02::DOUBLE * (l_quantity % 5) AS z, ((l_suppkey + l_orderkey) % 4)::INT AS cls FROM lineitem)"""
SEQ_CELLS = f"{SEQUENCE}, c0 AS (SELECT seq_id, frame, cell, max(z) AS z_max, {TALLIES} FROM s GROUP BY ALL), cells AS (SELECT seq_id, frame, cell, z_max, {MAJORITY} AS cls FROM c0)"
# The cadence unrolled by recursion over the frames: a snapshot after five frames or two drops.
SCHEDULE = """sched AS (WITH RECURSIVE f AS (
  SELECT 1 AS frame, false AS snap, true AS delivered, 0 AS before_drops, 0 AS last_snap, 0 AS drops
  UNION ALL
  SELECT frame + 1, x.snap, x.ok, drops, CASE WHEN x.ok AND x.snap THEN frame + 1 ELSE last_snap END, CASE WHEN x.ok THEN 0 ELSE drops + 1 END
  FROM f, LATERAL (SELECT f.frame + 1 - f.last_snap >= 5 OR f.drops >= 2 AS snap, f.frame + 1 NOT IN (7, 14, 15) AS ok) x WHERE f.frame < 24)
SELECT '00' AS seq_id, frame::INT AS frame, CASE WHEN snap THEN 'snapshot' ELSE 'delta' END AS kind, delivered, before_drops::INT AS drops,
  CASE WHEN delivered THEN count(*) FILTER (delivered) OVER (ORDER BY frame) END AS ordinal FROM f)"""
EVENTS = f"""{SEQ_CELLS}, {SCHEDULE},
r0 AS (SELECT c.*, kind, ordinal FROM cells c JOIN sched USING (seq_id, frame) WHERE delivered),
r1 AS (SELECT *, coalesce(lag(ordinal) OVER w <> ordinal - 1, true) AS gap, coalesce(lead(ordinal) OVER w <> ordinal + 1, true) AS leaves FROM r0 WINDOW w AS (PARTITION BY cell ORDER BY ordinal)),
r2 AS (SELECT *, sum((gap OR kind = 'snapshot')::INT) OVER (PARTITION BY cell ORDER BY ordinal) AS island FROM r1),
r3 AS (SELECT *, row_number() OVER (PARTITION BY cell, island ORDER BY ordinal) AS k FROM r2),
fold AS (WITH RECURSIVE f AS (
  SELECT cell, island, k, frame, CASE WHEN kind = 'snapshot' THEN 'snapshot' ELSE 'added' END AS op, z_max AS sent, cls AS sent_cls FROM r3 WHERE k = 1
  UNION ALL
  SELECT r.cell, r.island, r.k, r.frame, CASE WHEN abs(r.z_max - f.sent) >= 0.05 OR r.cls <> f.sent_cls THEN 'changed' END,
    CASE WHEN abs(r.z_max - f.sent) >= 0.05 OR r.cls <> f.sent_cls THEN r.z_max ELSE f.sent END, CASE WHEN abs(r.z_max - f.sent) >= 0.05 OR r.cls <> f.sent_cls THEN r.cls ELSE f.sent_cls END
  FROM f JOIN r3 r ON r.cell = f.cell AND r.island = f.island AND r.k = f.k + 1) SELECT * FROM f),
ev AS (SELECT '00' AS seq_id, cell, frame, op, sent AS z_max, sent_cls AS cls FROM fold WHERE op IS NOT NULL
  UNION ALL
  SELECT '00', r1.cell, n.frame, 'freed', NULL, NULL FROM r1 JOIN sched n ON n.ordinal = r1.ordinal + 1 AND n.delivered WHERE r1.leaves AND n.kind = 'delta')"""
BAND = "CASE WHEN rng < 5 THEN '0-5m' WHEN rng < 10 THEN '5-10m' WHEN rng < 20 THEN '10-20m' WHEN rng < 40 THEN '20-40m' WHEN rng < 80 THEN '40-80m' END"
PAIRS = "pr AS (SELECT CASE WHEN l_linenumber = 7 THEN 255 ELSE l_suppkey % 5 END::INT AS t, CASE WHEN l_quantity > 10 THEN l_suppkey % 5 ELSE l_partkey % 5 END::INT AS p, 0.526::DOUBLE + 2.4::DOUBLE * (l_partkey % 40) AS rng FROM lineitem)"
ROW = "least(greatest(floor((1 - (asin(z / rng) - radians(-24.8::DOUBLE)) / (radians(2.0::DOUBLE) - radians(-24.8::DOUBLE))) * 63), 0), 63)::INT"
COL = f"least(greatest(floor((atan2(y, x) / {math.pi!r}::DOUBLE + 1) * 0.5 * 2048), 0), 2047)::INT"
PROJECTED = f"{XYZ}, q AS (SELECT *, greatest(sqrt(x * x + y * y + z * z), 1e-6) AS rng FROM xyz), pj AS (SELECT *, {ROW} AS row, {COL} AS col FROM q)"

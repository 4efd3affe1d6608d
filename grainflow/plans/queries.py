"""Every operator bound to the standard tables, with the SQL that gives the same rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainflow.functions import tensors as T
from grainflow.operators import clean, fem, fields, geometry, grains, homogenize, mesh, polylines, spatial, triangulation, waves
from grainflow.operators.components import checkpointed
from grainflow.plans import standard as S
from grainflow.plans.standard import MAP_SQL, PHASES_SQL, PRESENT_SQL

QUERIES: dict = {}
SQL: dict[str, str] = {}
CELLS = [(i, j) for i in (1, 2, 3) for j in (1, 2, 3)]


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits, without negative zeros."""
    return df.select(*((F.round(F.col(n), digits) + F.lit(0.0)).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes))


def _r(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {name}"


# --- maps: cleaning and statistics -------------------------------------------------------------------------------------


@query(f"WITH {MAP_SQL} SELECT phase, count(*) AS points, {_r('count(*) / (SELECT count(*) FROM points)::DOUBLE', 'fraction', 9)} FROM points GROUP BY phase")
def phase_volume_fraction(spark: SparkSession, d: str) -> DataFrame:
    return rounded(homogenize.volume_fractions(S.event_map(spark, d)), 9)


@query(f"WITH {MAP_SQL}, {PHASES_SQL} SELECT {_r('avg(density)', 'density')} FROM points JOIN phases USING (phase)")
def homogenized_density(spark, d):
    return rounded(homogenize.homogenised_density(S.event_map(spark, d), S.phases(spark)))


@query(f"""WITH {MAP_SQL} SELECT count(*) AS points, count(DISTINCT x) AS columns, count(DISTINCT y) AS rows, count(DISTINCT phase) AS phases,
  {", ".join(_r(f"{f}({a})", f"{a}_{f}", 9) for a in ("phi1", "phi", "phi2") for f in ("min", "max"))} FROM points""")
def map_summary(spark, d):
    return rounded(grains.summary(S.event_map(spark, d)), 9)


@query("SELECT s_suppkey AS point_id, dense_rank() OVER (ORDER BY s_nationkey % 7 - 3)::INTEGER AS phase FROM supplier")
def renumber_phases(spark, d):
    raw = S.table(spark, d, "supplier").select(F.col("s_suppkey").alias("point_id"), (F.col("s_nationkey") % 7 - 3).alias("phase"))
    return clean.renumber_phases(raw)


@query(f"WITH {MAP_SQL}, s AS (SELECT point_id, 2.5 * x + 10 AS x, 40 - 2.5 * y AS y FROM points) SELECT point_id, CAST(round((x - (SELECT min(x) FROM s)) / 2.5) AS BIGINT) AS x, CAST(round(((SELECT max(y) FROM s) - y) / 2.5) AS BIGINT) AS y FROM s")
def unit_grid(spark, d):
    raw = S.event_map(spark, d).select("point_id", (2.5 * F.col("x") + 10).alias("x"), (40 - 2.5 * F.col("y")).alias("y"))
    return clean.unit_grid(raw)


def _pass(source: str, dx: int, dy: int) -> str:
    return f"""SELECT p.point_id, p.x, p.y, CASE WHEN p.x > 0 AND p.y > 0 AND p.x < w - 1 AND p.y < w - 1 AND p.phase = c.phase AND p.phase <> s.phase AND p.phase <> l.phase THEN l.phase ELSE p.phase END AS phase
  FROM {source} p, side LEFT JOIN {source} c ON c.x = p.x + {dx} AND c.y = p.y + {dy} LEFT JOIN {source} s ON s.x = p.x + {dx} AND s.y = p.y LEFT JOIN {source} l ON l.x = p.x AND l.y = p.y + {dy}"""


@query(f"WITH {MAP_SQL}, " + ", ".join(f"pass{i + 1} AS ({_pass(f'pass{i}' if i else 'points', *xy)})" for i, xy in enumerate(clean.DIAGONALS)) + " SELECT point_id, x, y, phase FROM pass4")
def stray_pixel_clean(spark, d):
    return clean.remove_strays(S.event_map(spark, d).select("point_id", "x", "y", "phase"), ["phase"])


@query(f"WITH {MAP_SQL}, m AS (SELECT phase, avg(value) AS a, stddev_pop(value) AS s, min(value) AS l, max(value) AS h FROM points GROUP BY phase) SELECT phase, {_r('greatest(a - 2.5 * s, l)', 'low')}, {_r('least(a + 2.5 * s, h)', 'high')} FROM m")
def robust_limits(spark, d):
    return rounded(clean.robust_limits(S.event_map(spark, d), "value", ("phase",)))


# --- grains ------------------------------------------------------------------------------------------------------------

_PAIRS = "SELECT p.point_id AS a, q.point_id AS b FROM points p JOIN points q ON p.phase = q.phase AND abs(p.x - q.x) <= 1 AND abs(p.y - q.y) <= 1 AND p.point_id <> q.point_id"
_GRAINS = f"""WITH RECURSIVE {MAP_SQL}, pairs AS ({_PAIRS}), reach(node, label) AS (
  SELECT point_id, point_id FROM points UNION SELECT pairs.b, reach.label FROM reach JOIN pairs ON reach.node = pairs.a WHERE reach.label < pairs.b
), grained AS (SELECT points.*, g.grain_id FROM points JOIN (SELECT node, min(label) AS grain_id FROM reach GROUP BY node) g ON g.node = points.point_id),
corners AS (SELECT grain_id, x + dx AS x, y + dy AS y, count(*) AS touching FROM grained, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) s(dx, dy) GROUP BY ALL HAVING count(*) < 4)"""


def _grained(spark, d):
    return grains.grains(S.event_map(spark, d), ("phase",))


@query(f"{_GRAINS} SELECT point_id, phase, grain_id FROM grained")
def grain_components(spark, d):
    return _grained(spark, d).select("point_id", "phase", "grain_id")


@query(f"WITH {MAP_SQL} SELECT phase, {', '.join(_r(a, a, 9) for a in ('phi1', 'phi', 'phi2'))}, count(*) AS points, min(point_id) AS first_point FROM points GROUP BY phase, points.phi1, points.phi, points.phi2")
def grain_key_groups(spark, d):
    return rounded(grains.orientation_groups(S.event_map(spark, d)), 9)


@query(f"{_GRAINS} SELECT * FROM corners")
def grain_boundary_corners(spark, d):
    return grains.corners(_grained(spark, d))


@query(f"{_GRAINS}, n AS (SELECT x, y, count(*) AS grains FROM corners GROUP BY x, y) SELECT n.* FROM n, side WHERE grains >= 3 OR (grains >= 2 AND (x IN (0, w) OR y IN (0, w))) OR (x IN (0, w) AND y IN (0, w))")
def junction_points(spark, d):
    return grains.junctions(_grained(spark, d))


@query(f"""{_GRAINS}, n AS (SELECT x, y, count(*) AS grains FROM corners GROUP BY x, y), j AS (SELECT n.x, n.y, w FROM n, side WHERE grains >= 3 OR (grains >= 2 AND (x IN (0, w) OR y IN (0, w))) OR (x IN (0, w) AND y IN (0, w))),
m AS (SELECT x, y, w FROM j UNION SELECT w - x, y, w FROM j WHERE x IN (0, w)) SELECT x, y FROM m UNION SELECT x, w - y FROM m WHERE y IN (0, w)""")
def junction_points_periodic(spark, d):
    return grains.periodic_junctions(_grained(spark, d))


@query(f"WITH {MAP_SQL}, k AS (SELECT DISTINCT phase, phi1, phi, phi2 FROM points) SELECT phase, {', '.join(_r(a, a, 9) for a in ('phi1', 'phi', 'phi2'))}, CAST(dense_rank() OVER w AS INTEGER) AS number, {_r('percent_rank() OVER w', 'shade', 9)} FROM k WINDOW w AS (PARTITION BY phase ORDER BY phi1, phi, phi2)")
def orientation_shades(spark, d):
    return rounded(grains.shades(S.event_map(spark, d)), 9)


_SIDES = f"""{_GRAINS}, sides AS (SELECT grain_id, 2 * x + dx AS x, 2 * y + dy AS y, k AS across FROM grained, (VALUES (1, 0, 'h'), (1, 2, 'h'), (0, 1, 'v'), (2, 1, 'v')) s(dx, dy, k) GROUP BY ALL HAVING count(*) = 1),
adjacent AS (SELECT a.grain_id, b.grain_id AS neighbour, count(*) AS edges FROM sides a JOIN sides b ON a.x = b.x AND a.y = b.y AND a.grain_id <> b.grain_id GROUP BY ALL)"""


@query(f"{_SIDES} SELECT * FROM adjacent")
def grain_adjacency(spark, d):
    return grains.adjacency(_grained(spark, d))


@query(f"""{_SIDES}, sizes AS (SELECT grain_id, count(*) AS size FROM grained GROUP BY grain_id), best AS (
  SELECT a.grain_id, arg_max(a.neighbour, (t.size, a.edges, -a.neighbour)) AS into_id FROM adjacent a JOIN sizes s ON s.grain_id = a.grain_id JOIN sizes t ON t.grain_id = a.neighbour
  WHERE s.size <= 3 AND t.size > s.size GROUP BY a.grain_id)
SELECT g.point_id, coalesce(d.into_id, c.into_id, b.into_id, g.grain_id) AS grain_id, coalesce(t.phase, g.phase) AS phase FROM grained g LEFT JOIN best b USING (grain_id)
LEFT JOIN best c ON c.grain_id = b.into_id LEFT JOIN best d ON d.grain_id = c.into_id
LEFT JOIN (SELECT grain_id, any_value(phase) AS phase FROM grained GROUP BY grain_id) t ON t.grain_id = coalesce(d.into_id, c.into_id, b.into_id)""")
def small_grain_merge(spark, d):
    return grains.merge_small(_grained(spark, d), 3).select("point_id", "grain_id", "phase")


@query(f"{_GRAINS} SELECT grain_id, count(*) AS vertices, row_number() OVER (ORDER BY count(*), grain_id)::INTEGER AS rank FROM corners GROUP BY grain_id")
def grain_rank(spark, d):
    return grains.rank_by_size(_grained(spark, d))


@query(f"{_GRAINS}, v AS (SELECT grain_id, CAST(value AS BIGINT) % 5 AS level FROM grained), c AS (SELECT grain_id, level, count(*) AS n FROM v GROUP BY ALL) SELECT grain_id, level FROM (SELECT *, row_number() OVER (PARTITION BY grain_id ORDER BY n DESC, level) AS k FROM c) WHERE k = 1")
def grain_majority(spark, d):
    return grains.majority(_grained(spark, d).withColumn("level", F.rint("value").cast("long") % 5), "level")


@query(f"""{_SIDES}, box AS (SELECT grain_id, min(x) AS l, max(x) AS r, min(y) AS b, max(y) AS t FROM grained GROUP BY grain_id)
SELECT min(neighbour) AS outer_id, grain_id AS inner_id FROM adjacent JOIN box USING (grain_id), side WHERE l > 0 AND b > 0 AND r < w - 1 AND t < w - 1 GROUP BY grain_id HAVING count(*) = 1""")
def grain_holes(spark, d):
    return grains.enclosed(_grained(spark, d))


@query(f"{_SIDES} SELECT x, y, across, min(phase) AS phase_a, max(phase) AS phase_b FROM sides JOIN (SELECT grain_id, any_value(phase) AS phase FROM grained GROUP BY grain_id) USING (grain_id) GROUP BY x, y, across HAVING count(*) = 2 AND min(phase) < max(phase)")
def phase_boundary_edges(spark, d):
    return grains.phase_boundaries(_grained(spark, d))


@query(f"{_GRAINS} SELECT grain_id, {_r('avg(x)', 'cx')}, {_r('avg(y)', 'cy')}, count(*) AS points FROM grained GROUP BY grain_id")
def grain_centroids(spark, d):
    return rounded(grains.centroids(_grained(spark, d)))


# --- conductivity in expressions ---------------------------------------------------------------------------------------

_ROTATED = f"WITH {MAP_SQL}, {PHASES_SQL}, {S.rotated_sql('points', 'point_id, phase')}"


@query(f"{_ROTATED} SELECT point_id, {', '.join(_r(f'r{i}{j}', f'k{i}{j}') for i, j in CELLS)} FROM rotated")
def rotate_conductivity(spark, d):
    return rounded(homogenize.rotated_conductivity(S.event_map(spark, d).select("point_id", "phase", "phi1", "phi", "phi2"), S.phases(spark)).drop("phase", "phi1", "phi", "phi2"))


def _means(by: str = "") -> str:
    inverse = S.inverse_sql("r")
    group = f" GROUP BY {by}" if by else ""
    keep = f"{by}, " if by else ""
    sym = lambda p, i, j: f"({p}{i}{j} + {p}{j}{i}) / 2"
    return f"""{_ROTATED}, means AS (SELECT {keep}{", ".join([f"avg(r{i}{j}) AS v{i}{j}" for i, j in CELLS] + [f"avg({inverse[i, j]}) AS s{i}{j}" for i, j in CELLS])} FROM rotated{group}),
voigt AS (SELECT {keep}{", ".join([f"{sym('v', i, j)} AS v{i}{j}" for i, j in CELLS] + [f"{sym('s', i, j)} AS s{i}{j}" for i, j in CELLS])} FROM means),
both_ AS (SELECT {keep}{", ".join([f"v{i}{j}" for i, j in CELLS] + [f"{S.inverse_sql('s')[i, j]} AS u{i}{j}" for i, j in CELLS])} FROM voigt)"""


def _estimate(prefix: str) -> str:
    value = {"voigt": "v{}{}", "reuss": "u{}{}", "hill": "(v{0}{1} + u{0}{1}) / 2"}[prefix]
    return f"{_means()} SELECT {', '.join(_r(value.format(i, j), f'k{i}{j}') for i, j in CELLS)} FROM both_"


def _conductivity(method: str):
    return lambda spark, d: rounded(homogenize.conductivity_estimates(S.event_map(spark, d), S.phases(spark)).where(F.col("method") == method).drop("method"))


for _method in ("voigt", "reuss", "hill"):
    QUERIES[f"{_method}_conductivity"] = _conductivity(_method)
    SQL[f"{_method}_conductivity"] = _estimate(_method)


@query(f"{_means('phase')} SELECT phase, {', '.join(_r(f'v{i}{j}', f'k{i}{j}') for i, j in CELLS)} FROM both_")
def per_phase_voigt(spark, d):
    return rounded(_per_phase(spark, d).drop("method"))


def _per_phase(spark, d):
    points = S.event_map(spark, d).withColumn("group", F.col("phase"))
    return homogenize.conductivity_estimates(points, S.phases(spark), ("group",)).where("method = 'voigt'").withColumnRenamed("group", "phase")


_TURN = "degrees(atan2(v12, (v11 - v22) / 2)) / 2"
_RADIUS = "sqrt(((v11 - v22) / 2) * ((v11 - v22) / 2) + v12 * v12)"


@query(f"""{_means("phase")}, p AS (SELECT phase, v11, v12, v22, (v11 + v22) / 2 AS m, {_RADIUS} AS r, {_TURN} AS t FROM both_)
SELECT phase, {_r("m + r", "k_max")}, {_r("m - r", "k_min")}, {_r("CASE WHEN t < 0 THEN t + 180 ELSE t END", "theta_max", 4)}, {_r("CASE WHEN t + 90 >= 180 THEN t - 90 ELSE t + 90 END", "theta_min", 4)},
  {_r("(m + r) / (m - r)", "ratio")}, {_r("sqrt(v11 * v11 + 2 * v12 * v12 + v22 * v22)", "norm")} FROM p""")
def kappa_anisotropy(spark, d):
    k = _per_phase(spark, d)
    return rounded(rounded(k.select("phase", *(v.alias(n) for n, v in T.in_plane_anisotropy(F.col("k11"), F.col("k12"), F.col("k22")).items()))).withColumns({c: F.round(c, 4) for c in ("theta_max", "theta_min")}))


# --- stiffness, expansion, waves ---------------------------------------------------------------------------------------


def _stiffness_sql() -> str:
    """Voigt mean in long form: M_IJ = a_ik a_jl + a_il a_jk (k <> l), C' = M C M^T, averaged with counts."""
    turn = ", ".join(f"{e} AS {n}" for n, e in S.ROTATION_SQL.items())
    pairs = ", ".join(f"({n}, {i + 1}, {j + 1})" for n, (i, j) in enumerate(T.VOIGT, 1))
    return f"""WITH {MAP_SQL}, {PHASES_SQL}, kinds_ AS (SELECT phase, phi1, phi, phi2, count(*) AS n FROM points GROUP BY ALL),
turned AS (SELECT row_number() OVER (ORDER BY phase, phi1, phi, phi2) AS id, phase, n, {turn} FROM kinds_),
a AS (SELECT id, i, k, v FROM turned, LATERAL (VALUES {", ".join(f"({i}, {j}, a{i}{j})" for i, j in CELLS)}) t(i, k, v)),
voigt(v, i, j) AS (VALUES {pairs}),
m AS (SELECT ik.id, r.v AS r, c.v AS c, ik.v * jl.v + CASE WHEN c.i <> c.j THEN il.v * jk.v ELSE 0 END AS v FROM voigt r, voigt c JOIN a ik ON ik.i = r.i AND ik.k = c.i
  JOIN a jl ON jl.id = ik.id AND jl.i = r.j AND jl.k = c.j JOIN a il ON il.id = ik.id AND il.i = r.i AND il.k = c.j JOIN a jk ON jk.id = ik.id AND jk.i = r.j AND jk.k = c.i),
c AS (SELECT phase, (i // 6 + 1) AS r, (i % 6 + 1) AS c, stiffness[i + 1] AS v FROM phases, range(36) t(i)),
mc AS (SELECT m.id, m.r, c.c, sum(m.v * c.v) AS v FROM m JOIN turned USING (id) JOIN c ON c.phase = turned.phase AND c.r = m.c GROUP BY ALL)
SELECT CAST(mc.r AS INTEGER) AS i, CAST(m.r AS INTEGER) AS j, {_r("sum(n * mc.v * m.v) / (SELECT count(*) FROM points)", "value", 5)} FROM mc JOIN m ON m.id = mc.id AND m.c = mc.c JOIN turned ON turned.id = mc.id GROUP BY ALL"""


def _estimates(spark, d):
    return homogenize.property_estimates(S.event_map(spark, d), S.phases(spark))


@query(_stiffness_sql())
def voigt_stiffness(spark, d):
    one = _estimates(spark, d).where("method = 'voigt'").select(F.posexplode("stiffness").alias("p", "value"))
    return rounded(one.select(F.floor(F.col("p") / 6 + 1).cast("int").alias("i"), (F.col("p") % 6 + 1).cast("int").alias("j"), "value"), 5)


@query()
def property_estimates(spark, d):
    return _estimates(spark, d)


@query()
def engineering_properties(spark, d):
    return homogenize.engineering_properties(_estimates(spark, d))


@query(f"WITH {PRESENT_SQL} SELECT phase, t AS angle, {_r('a1 * pow(cos(radians(t)), 2) + a2 * pow(sin(radians(t)), 2)', 'alpha')} FROM phases, range(0, 181, 15) r(t)")
def directional_expansion(spark, d):
    both = S.phases_of_map(spark, d).join(spark.range(0, 181, 15).withColumnRenamed("id", "angle"))
    return rounded(both.select("phase", "angle", T.expansion_along([F.col("alpha")[i] for i in range(6)], F.radians("angle")).alias("alpha")))


@query(f"""WITH {PRESENT_SQL}, c AS (SELECT phase, stiffness[1] AS c11, stiffness[2] AS c12, stiffness[3] AS c13, stiffness[15] AS c33, stiffness[22] AS c44 FROM phases),
s AS (SELECT phase, c44, c33 * (c11 + c12) - 2 * c13 * c13 AS e, c11, c12, c13, c33 FROM c),
u AS (SELECT phase, 0.5 * (c33 / e + 1 / (c11 - c12)) AS s11, 0.5 * (c33 / e - 1 / (c11 - c12)) AS s12, -c13 / e AS s13, (c11 + c12) / e AS s33, 1 / c44 AS s44 FROM s)
SELECT phase, t AS angle, {_r("1 / (s11 * pow(sin(radians(t)), 4) + (2 * s13 + s44) * pow(sin(radians(t)) * cos(radians(t)), 2) + s33 * pow(cos(radians(t)), 4))", "young")} FROM u, range(0, 91, 15) r(t)""")
def directional_young(spark, d):
    """Of each phase, in the plane of axes 1 and 3, by the angle from axis 3."""
    compliance = homogenize_compliance(S.phases_of_map(spark, d))
    both = compliance.join(spark.range(0, 91, 15).withColumnRenamed("id", "angle"))
    n = [F.sin(F.radians("angle")), F.lit(0.0), F.cos(F.radians("angle"))]
    return rounded(both.select("phase", "angle", T.young_along([F.col("compliance")[i] for i in range(36)], n).alias("young")))


def homogenize_compliance(phases: DataFrame) -> DataFrame:
    import numpy as np
    import pandas as pd

    def run(batches):
        for pdf in batches:
            s = np.linalg.inv(np.array(pdf["stiffness"].tolist()).reshape(-1, 6, 6))
            yield pd.DataFrame({"phase": pdf["phase"], "compliance": list(s.reshape(-1, 36))})

    return phases.select("phase", "stiffness").mapInPandas(run, "phase int, compliance array<double>")


@query()
def wave_speeds(spark, d):
    materials = _estimates(spark, d).select("method", (F.transform("stiffness", lambda x: x * 1e9)).alias("stiffness")).join(homogenize.homogenised_density(S.event_map(spark, d), S.phases(spark)))
    return waves.wave_speeds(materials, "method")


@query()
def wave_anisotropy(spark, d):
    return waves.anisotropy(wave_speeds(spark, d), "method")


#: The phases are isotropic about axis 3, where the speeds have a closed form: SH apart, P and SV from a quadratic equation.
_WAVES_SQL = f"""WITH {MAP_SQL}, {PHASES_SQL}, held AS (SELECT phase, count(*) AS points FROM points GROUP BY phase), ij AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, pi() - i * (pi() / 200) AS p, j * (2 * pi() / 200) AS q FROM range(101) a(i), range(201) b(j)),
d AS (SELECT i, j, sin(p) * cos(q) AS x, sin(p) * sin(q) AS y, cos(p) AS z, sin(p) * sin(p) AS s, cos(p) * cos(p) AS c FROM ij),
m AS (SELECT phase, density, i, j, x, y, z, (stiffness[1] - stiffness[2]) / 2 * s + stiffness[22] * c AS h, stiffness[1] * s + stiffness[22] * c AS a, stiffness[22] * s + stiffness[15] * c AS b, pow(stiffness[3] + stiffness[22], 2) * s * c AS k FROM phases, d),
v AS (SELECT phase, i, j, x, y, z, sqrt(1e9 / density * (a + b + sqrt((a - b) * (a - b) + 4 * k)) / 2) AS vp, sqrt(1e9 / density * h) AS vsh, sqrt(1e9 / density * (a + b - sqrt((a - b) * (a - b) + 4 * k)) / 2) AS vsv FROM m),
w AS (SELECT *, greatest(vsh, vsv) AS vs1, least(vsh, vsv) AS vs2, max(vp) OVER (PARTITION BY phase) AS fastest FROM v)"""
_SPEEDS_SQL = ", ".join(_r(c, c, 3) for c in waves.SPEEDS)


@query(f"{_WAVES_SQL} SELECT phase, coalesce(points, 0) AS points, i, j, {', '.join(_r(c, c) for c in 'xyz')}, {_SPEEDS_SQL}, {_r('(vs1 - vs2) / ((vs1 + vs2) / 2) * 100', 'avs')}, {_r('1 / vs2 - 1 / vs1', 'dts', 12)}, {_r('1 / vp - 1 / fastest', 'dtp', 12)} FROM w LEFT JOIN held USING (phase)")
def phase_wave_speeds(spark, d):
    return _rounded_waves(_phase_waves(spark, d))


def _phase_waves(spark, d):
    """Of every phase, with the number of the map's points that have it, which may be none."""
    held = S.event_map(spark, d).groupBy("phase").agg(F.count("*").alias("points"))
    speeds = waves.wave_speeds(S.phases(spark).withColumn("stiffness", F.transform("stiffness", lambda x: x * 1e9)), "phase")
    return speeds.join(F.broadcast(held), "phase", "left").withColumn("points", F.coalesce("points", F.lit(0)))  # eight phases at most


def _rounded_waves(df: DataFrame) -> DataFrame:
    digits = dict.fromkeys(waves.SPEEDS, 3) | {"dts": 12, "dtp": 12}
    return df.select(*((F.round(F.col(n), digits.get(n, 6)) + F.lit(0.0)).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes))


# --- joins by place ----------------------------------------------------------------------------------------------------


@query(f"""WITH {MAP_SQL}, q AS (SELECT point_id, x + 0.25::DOUBLE AS qx, y + 0.125::DOUBLE AS qy FROM points), t AS (SELECT * FROM points WHERE phase = 1),
n AS (SELECT q.point_id AS query_id, min({{'d': (qx - x) * (qx - x) + (qy - y) * (qy - y), 'i': t.point_id}}, 3) AS best FROM q, t GROUP BY q.point_id)
SELECT query_id, CAST(k AS INTEGER) AS rank, best[k].i AS point_id, {_r("best[k].d", "distance2")} FROM n, range(1, 4) r(k) WHERE k <= len(best)""")
def nearest_neighbor(spark, d):
    """Of every point of the map; the squared distances are exact in binary, so ties are too."""
    points = S.event_map(spark, d)
    asked = points.select(F.col("point_id").alias("query_id"), (F.col("x") + 0.25).alias("x"), (F.col("y") + 0.125).alias("y"))
    return rounded(spatial.nearest(asked, points.where("phase = 1"), 3, 2.0))


#: Two elements for each pixel of the event map, cells of 0.75 by 0.8.
_MESH_SQL = f"""{MAP_SQL}, nodes AS (SELECT DISTINCT (y + b) * (w + 1) + x + a AS node_id, (x + a) * 0.75::DOUBLE AS x, (y + b) * 0.8::DOUBLE AS y FROM points, side, range(2) r(a), range(2) s(b)),
elements AS (SELECT 2 * point_id + k AS elem_id, a AS n1, CASE k WHEN 0 THEN a + 1 ELSE a + w + 2 END AS n2, CASE k WHEN 0 THEN a + w + 2 ELSE a + w + 1 END AS n3
  FROM (SELECT point_id, y * (w + 1) + x AS a, w FROM points, side), range(2) r(k)),
placed AS (SELECT e.*, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, c.x AS x3, c.y AS y3 FROM elements e JOIN nodes a ON a.node_id = n1 JOIN nodes b ON b.node_id = n2 JOIN nodes c ON c.node_id = n3)"""


_ENDS_SQL = "ends AS (SELECT max(x) AS x, max(y) AS y FROM nodes)"


def _mesh(spark, d):
    return mesh.pixel_mesh(S.event_map(spark, d), S.map_side(spark, d), 0.75, 0.8)


def _placed(spark, d, keep: tuple[str, ...] = (), parts: int = 0):
    """The elements of `_mesh` with their corners and columns `keep` of their points; in so many ranges of points, if `parts` is given."""
    points = S.event_map(spark, d)
    points = points.select("point_id", "x", "y", *keep).repartitionByRange(parts, "point_id") if parts else points
    return mesh.pixel_corners(points, S.map_side(spark, d), 0.75, 0.8, keep)


@query(f"WITH {_MESH_SQL} SELECT elem_id, n1, n2, n3 FROM elements")
def rect_mesh_elements(spark, d):
    return _mesh(spark, d)[1]


@query(f"WITH {_MESH_SQL}, p AS (SELECT s_suppkey AS point_id, s_acctbal - 9 * floor(s_acctbal / 9) AS px, s_suppkey * 0.37 - 8 * floor(s_suppkey * 0.37 / 8) AS py FROM supplier), t AS (SELECT *, (x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1) AS w FROM placed), b AS (SELECT point_id, elem_id, ((px - x1) * (y3 - y1) - (x3 - x1) * (py - y1)) / w AS b, ((x2 - x1) * (py - y1) - (px - x1) * (y2 - y1)) / w AS c FROM p, t) SELECT point_id, min(elem_id) AS elem_id FROM b WHERE b >= -1e-8 AND c >= -1e-8 AND 1 - b - c >= -1e-8 GROUP BY point_id")
def point_in_triangle(spark, d):
    raw = S.table(spark, d, "supplier")
    y = F.col("s_suppkey") * 0.37
    points = raw.select(F.col("s_suppkey").alias("point_id"), (F.col("s_acctbal") - 9 * F.floor(F.col("s_acctbal") / 9)).alias("x"), (y - 8 * F.floor(y / 8)).alias("y"))
    return spatial.points_in_triangles(points, _placed(spark, d))


_RINGS_SQL = "rings AS (SELECT r_regionkey AS ring, k AS seq, 10 * r_regionkey + 5 + (3 + k % 3) * cos(2 * pi() * k / 12) AS x, 20 + (3 + k % 3) * sin(2 * pi() * k / 12) + r_regionkey AS y FROM region, range(12) t(k))"
_EDGES_SQL = "edges AS (SELECT ring, seq, x AS ax, y AS ay, coalesce(lead(x) OVER w, first_value(x) OVER w) AS bx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS b_y FROM rings WINDOW w AS (PARTITION BY ring ORDER BY seq))"


def _rings(spark, d):
    k, r = F.col("id"), F.col("r_regionkey")
    turn, size = 2 * math.pi * k / 12, 3 + k % 3
    rows = S.table(spark, d, "region").join(spark.range(12))
    return rows.select(r.alias("ring"), k.alias("seq"), (10 * r + 5 + size * F.cos(turn)).alias("x"), (20 + size * F.sin(turn) + r).alias("y"))


@query(f"""WITH {_RINGS_SQL}, {_EDGES_SQL}, p AS (SELECT s_suppkey AS point_id, (s_suppkey % 50) * 1.1 AS px, 12 + (s_suppkey % 17) * 1.3 AS py FROM supplier),
t AS (SELECT *, least(greatest(((px - ax) * (bx - ax) + (py - ay) * (b_y - ay)) / ((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)), 0), 1) AS t FROM p, edges),
g AS (SELECT point_id, ring, sqrt(min((px - ax - t * (bx - ax)) * (px - ax - t * (bx - ax)) + (py - ay - t * (b_y - ay)) * (py - ay - t * (b_y - ay)))) AS dist,
  count(*) FILTER ((ay > py) <> (b_y > py) AND px < (bx - ax) * (py - ay) / (b_y - ay) + ax) AS n FROM t GROUP BY point_id, ring)
SELECT point_id, ring, {_r("CASE WHEN n % 2 = 1 THEN -dist ELSE dist END", "distance")} FROM g""")
def signed_distance(spark, d):
    points = S.table(spark, d, "supplier").select(F.col("s_suppkey").alias("point_id"), (F.col("s_suppkey") % 50 * 1.1).alias("x"), (12 + F.col("s_suppkey") % 17 * 1.3).alias("y"))
    return rounded(spatial.signed_distance(points, _rings(spark, d), "ring"))


# --- lines and rings ---------------------------------------------------------------------------------------------------


@query()
def decimate_polygon(spark, d):
    return geometry.decimate(_rings(spark, d), "ring", 0.5)


@query()
def gradient_limited_size(spark, d):
    h = S.event_map(spark, d).select(F.lit("map").alias("map_id"), F.col("y").alias("i"), F.col("x").alias("j"), (1 + F.col("value") % 20).alias("h"))
    return geometry.limit_gradient(h, "map_id", 0.5)


#: The third crystal axis of every point of the map, turned to the lower half of the sphere.
_POLES_SQL = f"{MAP_SQL}, axis AS (SELECT point_id, {S.ROTATION_SQL['a13']} AS x, {S.ROTATION_SQL['a23']} AS y, {S.ROTATION_SQL['a33']} AS z FROM points), d AS (SELECT point_id, CASE WHEN z > 0 THEN -x ELSE x END AS x, CASE WHEN z > 0 THEN -y ELSE y END AS y, -abs(z) AS z FROM axis)"


def _poles(spark, d):
    turn = T.rotation(F.col("phi1"), F.col("phi"), F.col("phi2"))
    axis = S.event_map(spark, d).select("point_id", *(turn[i][2].alias(n) for i, n in enumerate("xyz")))
    lower = lambda c: F.when(F.col("z") > 0, -F.col(c)).otherwise(F.col(c)).alias(c)
    return axis.select("point_id", *map(lower, "xyz"))


@query(f"WITH {_POLES_SQL} SELECT point_id, {_r('x * sqrt(2 / (1 - z))', 'px')}, {_r('y * sqrt(2 / (1 - z))', 'py')} FROM d")
def lambert_projection(spark, d):
    """The pole figure of the map's third crystal axes, equal in area."""
    px, py = T.lambert(F.col("x"), F.col("y"), F.col("z"))
    return rounded(_poles(spark, d).select("point_id", px.alias("px"), py.alias("py")))


@query(f"WITH {_POLES_SQL} SELECT point_id, {_r('x', 'x')}, {_r('y', 'y')}, {_r('z', 'z')} FROM d UNION ALL SELECT point_id, {_r('-x', 'x')}, {_r('-y', 'y')}, {_r('-z', 'z')} FROM d")
def mirror_sphere(spark, d):
    return rounded(geometry.mirror(_poles(spark, d)))


@query("SELECT p_partkey, CASE WHEN p_retailprice - 905 <> 0 THEN CAST(floor(log10(abs(p_retailprice - 905))) AS INTEGER) END AS power FROM part")
def decimal_order(spark, d):
    return S.table(spark, d, "part").select("p_partkey", T.decimal_order(F.col("p_retailprice") - 905).alias("power"))


# --- meshes ------------------------------------------------------------------------------------------------------------

_QUALITY = "SELECT elem_id, ((x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1)) / 2 AS area, (b + c - a) * (c + a - b) * (a + b - c) / (a * b * c) AS quality, (x1 + x2 + x3) / 3 AS cx, (y1 + y2 + y3) / 3 AS cy FROM (SELECT *, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS a, sqrt(pow(x3 - x2, 2) + pow(y3 - y2, 2)) AS b, sqrt(pow(x3 - x1, 2) + pow(y3 - y1, 2)) AS c FROM placed)"


@query(f"WITH {_MESH_SQL}, q AS ({_QUALITY}) SELECT elem_id, {', '.join(_r(c, c) for c in ('area', 'quality', 'cx', 'cy'))} FROM q")
def mesh_quality(spark, d):
    return rounded(mesh.quality(_placed(spark, d)))


@query(f"WITH {_MESH_SQL}, q AS ({_QUALITY}) SELECT {_r('avg(quality)', 'mean')} FROM (SELECT quality FROM q ORDER BY quality LIMIT (SELECT CAST(ceil(0.05 * count(*)) AS BIGINT) FROM q))")
def mesh_worst_quality(spark, d):
    return rounded(mesh.worst_mean(mesh.quality(_placed(spark, d)), share=0.05))


@query(f"WITH {_MESH_SQL}, e AS (SELECT least(n1, n2) AS a, greatest(n1, n2) AS b FROM elements UNION ALL SELECT least(n2, n3), greatest(n2, n3) FROM elements UNION ALL SELECT least(n1, n3), greatest(n1, n3) FROM elements) SELECT a, b, count(*) AS elements FROM e GROUP BY a, b")
def mesh_edges(spark, d):
    return mesh.edges(_mesh(spark, d)[1])


def _hexagons(spark, d):
    """A hexagonal grid over the extent of the event map, with about as many elements as it has points."""
    size = S.event_map(spark, d).agg(F.max("x") + 1, F.max("y") + 1, F.count("*")).first()
    return mesh.hexagonal_grid(spark, 0.0, float(size[0]), 0.0, float(size[1]), size[2])


@query("SELECT name, 0::BIGINT AS n FROM (VALUES ('clockwise'), ('no area'), ('repeated corner'), ('repeated element'), ('unknown node'), ('unused node'), ('repeated node'), ('crowded edge'), ('crossed edges')) t(name)")
def mesh_checks(spark, d):
    """Of the hexagonal grid, which has to pass them all."""
    nodes, elements = _hexagons(spark, d)
    return mesh.checks(elements, nodes)


@query(f"""WITH side AS (SELECT floor(sqrt(count(*)))::DOUBLE AS w FROM events), size AS (SELECT w, sqrt(4 * w * w / (w * w * sqrt(3))) AS h FROM side), n AS (SELECT w AS width, CAST(round(w / h) AS BIGINT) AS nx, CAST(2 * round(w / (h * sqrt(3))) AS BIGINT) AS ny FROM size),
r AS (SELECT k AS r, nx, ny, width, width / nx AS w FROM n, LATERAL (SELECT unnest(range(ny + 1)) AS k)),
node AS (SELECT r, k, (r // 2) * (2 * nx + 3) + (r % 2) * (nx + 1) + k AS id, CASE WHEN r % 2 = 0 THEN k * w ELSE least(greatest((k - 0.5::DOUBLE) * w, 0), width) END AS x, r * (width / ny) AS y
  FROM r, LATERAL (SELECT unnest(range(nx + 1 + r % 2)) AS k)),
up AS (SELECT a.id AS a, b.id AS b, c.id AS c, a.r // 2 * 2 AS even FROM node a JOIN node b ON b.r = a.r AND b.k = a.k + 1 JOIN node c ON abs(c.r - a.r) = 1 AND c.k = a.k + 1 - a.r % 2),
placed AS (SELECT p.id AS a, q.id AS b, s.id AS c, p.x AS xa, p.y AS ya, q.x AS xb, q.y AS yb, s.x AS xc, s.y AS yc FROM up JOIN node p ON p.id = a JOIN node q ON q.id = b JOIN node s ON s.id = c),
e AS (SELECT unnest([{{'x': xa, 'y': ya}}, {{'x': xb, 'y': yb}}, {{'x': xc, 'y': yc}}]) AS v, a, b, c FROM placed)
SELECT least(a, b, c) AS low, a + b + c - least(a, b, c) - greatest(a, b, c) AS middle, greatest(a, b, c) AS high, {_r('avg(v.x)', 'x')}, {_r('avg(v.y)', 'y')} FROM e GROUP BY a, b, c""")
def hex_mesh_triangles(spark, d):
    """The hexagonal grid's elements by their nodes in order of number, with their centres: each edge of a row has a triangle above and one below."""
    nodes, elements = _hexagons(spark, d)
    n = F.array_sort(F.array("n1", "n2", "n3"))
    middle = lambda c: (F.col(f"{c}1") + F.col(f"{c}2") + F.col(f"{c}3")) / 3
    return rounded(mesh.corners(elements, nodes).select(n[0].alias("low"), n[1].alias("middle"), n[2].alias("high"), middle("x").alias("x"), middle("y").alias("y")))


@query()
def hex_mesh_elements(spark, d):
    nodes, elements = _hexagons(spark, d)
    return rounded(mesh.corners(elements, nodes))


@query(f"WITH {_MESH_SQL}, q AS ({_QUALITY}) SELECT count(*) AS elements, {', '.join(_r(f'{f}({e})', f'{n}_{s}') for n, e in (('area', 'area'), ('root', 'sqrt(abs(area))'), ('quality', 'quality')) for f, s in (('min', 'min'), ('avg', 'mean'), ('max', 'max')))} FROM q")
def mesh_statistics(spark, d):
    return rounded(mesh.statistics(_placed(spark, d)).drop("edge_min", "edge_mean", "edge_max"))


@query(f"WITH {_MESH_SQL}, {_ENDS_SQL} SELECT s.node_id, m.node_id AS master_id FROM ends e JOIN nodes s ON s.x = e.x OR s.y = e.y JOIN nodes m ON m.x = CASE WHEN s.x = e.x THEN 0 ELSE s.x END AND abs(m.y - CASE WHEN s.y = e.y THEN 0 ELSE s.y END) < 1e-9")
def periodic_pairs(spark, d):
    return mesh.periodic_pairs(_mesh(spark, d)[0])


@query(f"WITH {_MESH_SQL} SELECT {_r('x', 'x')}, {_r('y', 'y')} FROM (SELECT x, y FROM nodes UNION SELECT (x1 + x2) / 2, (y1 + y2) / 2 FROM placed UNION SELECT (x2 + x3) / 2, (y2 + y3) / 2 FROM placed UNION SELECT (x1 + x3) / 2, (y1 + y3) / 2 FROM placed)")
def quadratic_nodes(spark, d):
    nodes, elements = _mesh(spark, d)
    return rounded(mesh.quadratic(elements, nodes)[0].select("x", "y"))


@query(f"WITH {_MESH_SQL} SELECT elem_id, {', '.join(_r(f'({c}{a} + {c}{b}) / 2', f'{c}{n}') for n, (a, b) in ((4, (1, 2)), (5, (2, 3)), (6, (1, 3))) for c in 'xy')} FROM placed")
def quadratic_elements(spark, d):
    """Every element's mid-side nodes lie in the middle of their sides."""
    nodes, elements = _mesh(spark, d)
    wide, six = mesh.quadratic(elements, nodes)
    for n in (4, 5, 6):
        six = six.join(wide.select(F.col("node_id").alias(f"n{n}"), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}")), f"n{n}")
    return rounded(six.select("elem_id", *(f"{c}{n}" for n in (4, 5, 6) for c in "xy")))


# --- finite elements and fields ----------------------------------------------------------------------------------------

_POINTS_SQL = "qp AS (SELECT elem_id, q AS qp, l1 * x1 + l2 * x2 + l3 * x3 AS x, l1 * y1 + l2 * y2 + l3 * y3 AS y, w * ((x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1)) / 2 AS weight FROM placed, (VALUES (0, 1 / 3::DOUBLE, 1 / 3::DOUBLE, 1 / 3::DOUBLE, -27 / 48::DOUBLE), (1, 0.2::DOUBLE, 0.6::DOUBLE, 0.2::DOUBLE, 25 / 48::DOUBLE), (2, 0.2::DOUBLE, 0.2::DOUBLE, 0.6::DOUBLE, 25 / 48::DOUBLE), (3, 0.6::DOUBLE, 0.2::DOUBLE, 0.2::DOUBLE, 25 / 48::DOUBLE)) t(q, l1, l2, l3, w))"
_FIELD_SQL = f"WITH {_MESH_SQL}, {_POINTS_SQL}, f AS (SELECT *, x * x + 3 * x * y - y AS f, phase FROM qp JOIN (SELECT point_id AS pixel, phase FROM points) ON pixel = elem_id // 2)"


def _field(spark, d):
    """A field at the quadrature points of the map's elements, with their pixels' phases."""
    x, y = F.col("x"), F.col("y")
    return fem.quadrature_points(_placed(spark, d, ("phase",)), ("phase",)).withColumn("f", x * x + 3 * x * y - y)


@query(f"WITH {_MESH_SQL}, {_POINTS_SQL} SELECT elem_id, qp, {', '.join(_r(c, c) for c in ('x', 'y', 'weight'))} FROM qp")
def quadrature_points(spark, d):
    return rounded(fem.quadrature_points(_placed(spark, d)))


_K_SQL = """k AS (SELECT elem_id, i, j, (b[i] * k11 * b[j] + (b[i] * c[j] + c[i] * b[j]) * k12 + c[i] * k22 * c[j]) / (2 * w) AS value FROM (
  SELECT elem_id, [y2 - y3, y3 - y1, y1 - y2] AS b, [x3 - x2, x1 - x3, x2 - x1] AS c, (x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1) AS w, 2 + elem_id % 2 AS k11, 0.25 AS k12, 3 AS k22 FROM placed), range(1, 4) r(i), range(1, 4) s(j))"""


def _conducting(placed: DataFrame) -> DataFrame:
    return placed.withColumns({"k11": (2 + F.col("elem_id") % 2).cast("double"), "k12": F.lit(0.25), "k22": F.lit(3.0)})


@query(f"WITH {_MESH_SQL}, {_K_SQL} SELECT elem_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {_r('value', 'value')} FROM k")
def element_conductivity_matrix(spark, d):
    return rounded(fem.conduction_matrix(_conducting(_placed(spark, d))))


@query(f"WITH {_MESH_SQL}, {_ENDS_SQL}, {_K_SQL}, p AS (SELECT s.node_id, m.node_id AS master_id FROM ends e JOIN nodes s ON s.x = e.x OR s.y = e.y JOIN nodes m ON m.x = CASE WHEN s.x = e.x THEN 0 ELSE s.x END AND abs(m.y - CASE WHEN s.y = e.y THEN 0 ELSE s.y END) < 1e-9), g AS (SELECT [n1, n2, n3][i] AS a, [n1, n2, n3][j] AS b, value FROM k JOIN elements USING (elem_id)) SELECT coalesce(p.master_id, a) AS \"row\", coalesce(q.master_id, b) AS col, {_r('sum(value)', 'value', 5)} FROM g LEFT JOIN p ON p.node_id = a LEFT JOIN p q ON q.node_id = b GROUP BY 1, 2")
def assembled_matrix(spark, d):
    nodes, elements = _mesh(spark, d)
    # A task sums the entries of so many neighbouring elements, however large the map's files are.
    parts = -(-18 * S.map_side(spark, d) ** 2 // fem.ENTRIES)
    placed = fem.with_masters(_placed(spark, d, parts=parts), mesh.periodic_pairs(nodes))
    return rounded(fem.assemble(fem.conduction_matrix(_conducting(placed), ("n1", "n2", "n3")), elements), 5)


@query(f"{_FIELD_SQL} SELECT {_r('sum(f * weight) / sum(weight)', 'mean')} FROM f")
def field_mean_weighted(spark, d):
    return rounded(fields.weighted_mean(_field(spark, d), "f"))


@query(f"{_FIELD_SQL} SELECT phase, {_r('sum(f * weight) / sum(weight)', 'mean')} FROM f GROUP BY phase")
def field_mean_by_phase(spark, d):
    return rounded(fields.weighted_mean(_field(spark, d), "f", ("phase",)))


@query(f"{_FIELD_SQL} SELECT elem_id, {_r('avg(f)', 'f')} FROM f GROUP BY elem_id")
def qp_to_element(spark, d):
    return rounded(fields.to_elements(_field(spark, d), "f"))


@query(f"{_FIELD_SQL}, e AS (SELECT elem_id, avg(f) AS f FROM f GROUP BY elem_id) SELECT node_id, {_r('avg(f)', 'f')} FROM (SELECT f, unnest([n1, n2, n3]) AS node_id FROM e JOIN elements USING (elem_id)) GROUP BY node_id")
def qp_to_nodal(spark, d):
    return rounded(fields.to_nodes(_field(spark, d), _mesh(spark, d)[1], "f"))


#: Points along a side of a periodic cell of the event map, at most: 9,800 elements for conduction, 2,048 for elasticity.
CONDUCTION_SIDE, ELASTIC_SIDE = 70, 32


def _tiles(spark, d, size: int):
    side = S.map_side(spark, d)
    return fem.tiles(S.event_map(spark, d), size, side, side).withColumn("pixel", F.col("y") * side + F.col("x"))


def _cells(spark, d):
    """The whole event map as periodic cells side by side, two elements for each pixel."""
    turned = homogenize.rotated_conductivity(_tiles(spark, d, CONDUCTION_SIDE), S.phases(spark))
    return fem.pixel_cells(turned.withColumn("kappa", F.array(*(f"k{i}{j}" for i, j in CELLS))), ("kappa",), F.col("pixel"))


@query()
def effective_conductivity_aeh(spark, d):
    return fem.cell_conductivity(_cells(spark, d))


@query()
def heat_flux_field(spark, d):
    return fem.cell_heat_flux(_cells(spark, d), (1.0, 0.0, 0.0))


def _elastic(spark, d):
    properties = S.phases(spark).select("phase", "stiffness", "alpha")
    points = _tiles(spark, d, ELASTIC_SIDE).join(F.broadcast(properties), "phase")  # eight phases
    return fem.pixel_cells(points, ("stiffness", "alpha"), F.col("pixel"))


@query()
def effective_thermoelastic_aeh(spark, d):
    return fem.cell_thermoelastic(_elastic(spark, d))


@query()
def stress_strain_field(spark, d):
    return fem.cell_stress_strain(_elastic(spark, d), (1.0, 0.0, 0.0, 0.0, 0.0, 0.0), 1.0)


def _in_squares(rows: DataFrame) -> DataFrame:
    """Places of the map with the square of 3 by 3.2 that they lie in, which stands for a grain."""
    return rows.withColumn("grain", F.floor(F.col("x") / 3) * 1_000_000 + F.floor(F.col("y") / 3.2))


@query()
def field_interpolation(spark, d):
    targets = mesh.quality(_placed(spark, d)).select(F.col("elem_id").alias("target_id"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    return fields.interpolate(_in_squares(_field(spark, d)), _in_squares(targets), "grain", ["f"])


@query(f"""WITH {MAP_SQL}, c AS (SELECT w * (s_suppkey * 0.6180339887::DOUBLE - floor(s_suppkey * 0.6180339887::DOUBLE)) AS cx, w * (s_suppkey * 0.7548776662::DOUBLE - floor(s_suppkey * 0.7548776662::DOUBLE)) AS cy FROM supplier, side),
k AS (SELECT w / (2 * greatest(1, sqrt((SELECT count(*) FROM supplier)))) AS k FROM side),
f AS (SELECT x, y, sum(exp(-(pow(least(abs(x - cx), w - abs(x - cx)), 2) + pow(least(abs(y - cy), w - abs(y - cy)), 2)) / (2 * k * k))) AS level FROM points, c, side, k GROUP BY x, y)
SELECT x, y, CASE WHEN level > (SELECT quantile_cont(level, 0.6) FROM f) THEN 2 ELSE 1 END AS phase FROM f""")
def random_two_phase_map(spark, d):
    """Over the places of the event map, with a bump for each supplier."""
    from grainflow.sources.maps import random_two_phase

    side = S.map_side(spark, d)
    share = lambda step: side * (F.col("s_suppkey") * step - F.floor(F.col("s_suppkey") * step))
    centres = S.table(spark, d, "supplier").select(share(F.lit(0.6180339887)).alias("cx"), share(F.lit(0.7548776662)).alias("cy"))
    return random_two_phase(S.event_map(spark, d).select("x", "y"), centres, side, 0.4)


# --- elements' material, conforming meshes, further statistics ---------------------------------------------------------


@query(f"""WITH {MAP_SQL}, c AS (SELECT 2 * point_id + k AS elem_id, x + (2 - k) / 3::DOUBLE AS cx, y + (1 + k) / 3::DOUBLE AS cy FROM points, range(2) r(k)),
n AS (SELECT elem_id, arg_min(phase, {{'d': round((cx - x) * (cx - x) + (cy - y) * (cy - y), 9), 'i': point_id}}) AS phase FROM c, range(2) r(a), range(2) s(b), points
  WHERE points.x = floor(cx)::BIGINT + a AND points.y = floor(cy)::BIGINT + b GROUP BY elem_id)
SELECT elem_id, phase FROM n""")
def element_phase_nearest(spark, d):
    """Over the whole map, two elements for each pixel; the nearest point is one of the four around an element's centre."""
    from grainflow.operators import elements as el

    side = S.map_side(spark, d)
    box = (0.0, float(side), 0.0, float(side), side, side)
    return el.material(S.event_map(spark, d), S.phases(spark), mesh.grid_corners(spark, *box), mesh.grid_mesh(spark, *box)[0]).select("elem_id", "phase")


@query()
def element_material_hill(spark, d):
    from grainflow.operators import elements as el

    side = S.map_side(spark, d)
    box = (0.0, float(side), 0.0, float(side), max(1, side // 3), max(1, side // 3))
    return el.material(S.event_map(spark, d), S.phases(spark), mesh.grid_corners(spark, *box), mesh.grid_mesh(spark, *box)[0], "hill")


@query(f"""WITH {_RINGS_SQL}, {_EDGES_SQL}, p AS (SELECT s_suppkey AS point_id, (s_suppkey % 50) * 1.1 AS px, 12 + (s_suppkey % 17) * 1.3 AS py FROM supplier),
t AS (SELECT *, least(greatest(((px - ax) * (bx - ax) + (py - ay) * (b_y - ay)) / ((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)), 0), 1) AS t FROM p, edges),
g AS (SELECT point_id, ring, sqrt(min((px - ax - t * (bx - ax)) * (px - ax - t * (bx - ax)) + (py - ay - t * (b_y - ay)) * (py - ay - t * (b_y - ay)))) AS dist,
  count(*) FILTER ((ay > py) <> (b_y > py) AND px < (bx - ax) * (py - ay) / (b_y - ay) + ax) AS n FROM t GROUP BY point_id, ring),
s AS (SELECT point_id, ring, CASE WHEN n % 2 = 1 THEN -dist ELSE dist END AS distance FROM g)
SELECT point_id, ring FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY round(distance, 9), ring) AS k FROM s) WHERE k = 1""")
def deepest_ring(spark, d):
    from grainflow.operators.elements import deepest

    points = S.table(spark, d, "supplier").select(F.col("s_suppkey").alias("point_id"), (F.col("s_suppkey") % 50 * 1.1).alias("x"), (12 + F.col("s_suppkey") % 17 * 1.3).alias("y"))
    return deepest(spatial.signed_distance(points, _rings(spark, d), "ring").withColumn("distance", F.round("distance", 9)), "ring")


@query(f"{_ROTATED}, e AS (SELECT point_id, (r11 + r22 + r33) / 3 AS m, r11, r22, r33, r12, r13, r23, sqrt((pow(r11 - (r11 + r22 + r33) / 3, 2) + pow(r22 - (r11 + r22 + r33) / 3, 2) + pow(r33 - (r11 + r22 + r33) / 3, 2) + 2 * (r12 * r12 + r13 * r13 + r23 * r23)) / 6) AS s FROM rotated), u AS (SELECT point_id, m, s, acos(least(greatest(((r11 - m) * ((r22 - m) * (r33 - m) - r23 * r23) - r12 * (r12 * (r33 - m) - r23 * r13) + r13 * (r12 * r23 - (r22 - m) * r13)) / (2 * s * s * s), -1), 1)) / 3 AS t FROM e) SELECT point_id, {_r('m + 2 * s * cos(t)', 'k1')}, {_r('m - 2 * s * cos(t) - 2 * s * cos(t + 2 * pi() / 3)', 'k2')}, {_r('m + 2 * s * cos(t + 2 * pi() / 3)', 'k3')} FROM u")
def principal_conductivities(spark, d):
    k = homogenize.rotated_conductivity(S.event_map(spark, d).select("point_id", "phase", "phi1", "phi", "phi2"), S.phases(spark))
    e = T.symmetric_eigenvalues(*(F.col(f"k{i}{j}") for i, j in ((1, 1), (2, 2), (3, 3), (2, 3), (1, 3), (1, 2))))
    return rounded(k.select("point_id", *(v.alias(f"k{i + 1}") for i, v in enumerate(e))))


@query("SELECT s_suppkey, round(-least(x - 10, 40 - x, y - 5, 15 - y), 6) + 0.0 AS outside, round(greatest(-least(x - 10, 40 - x, y - 5, 15 - y), least(x - 20, 30 - x, y - 8, 12 - y)), 6) + 0.0 AS ring FROM (SELECT s_suppkey, (s_suppkey % 50)::DOUBLE AS x, (s_suppkey % 19)::DOUBLE AS y FROM supplier)")
def rectangle_distance(spark, d):
    x, y = (F.col("s_suppkey") % 50).cast("double"), (F.col("s_suppkey") % 19).cast("double")
    outer, hole = spatial.rectangle_distance(x, y, 10, 40, 5, 15), spatial.rectangle_distance(x, y, 20, 30, 8, 12)
    return rounded(S.table(spark, d, "supplier").select("s_suppkey", outer.alias("outside"), spatial.difference_distance(outer, hole).alias("ring")))


@query()
def conforming_mesh_quality(spark, d):
    from grainflow.operators.conforming import conforming_pixels, elements_of

    side = S.map_side(spark, d)
    return mesh.statistics(elements_of(conforming_pixels(spark, _grained(spark, d), side, side), side))


@query(f"""{_GRAINS}, seeds AS (SELECT DISTINCT x, y FROM corners), g AS (SELECT x + a AS j, y + b AS i FROM points, range(2) r(a), range(2) s(b) GROUP BY ALL)
SELECT i, j, {_r('min(0.5::DOUBLE + 0.25::DOUBLE * (least(abs(i - y), w + 1 - abs(i - y)) + least(abs(j - x), w + 1 - abs(j - x))))', 'h')} FROM g, seeds, side GROUP BY i, j""")
def mesh_size_field(spark, d):
    """Over the whole map, with the step along each axis limited."""
    return _sizes(spark, d, along_axes=True)


@query()
def mesh_size_field_gradient(spark, d):
    """Over the whole map, with the gradient's length limited, which SQL can't express."""
    return _sizes(spark, d)


def _sizes(spark, d, **how):
    from grainflow.operators.conforming import size_field

    found = size_field(_grained(spark, d), 0.5, 0.25, **how)
    return rounded(found.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "h"))


@query(f"{_GRAINS} SELECT grain_id, count(*)::DOUBLE AS area FROM grained GROUP BY grain_id")
def grain_outline_area(spark, d):
    """The rings of each grain's boundary, holes running the other way round, enclose just its pixels."""
    rings = polylines.outlines(_grained(spark, d)).withColumn("key", F.concat_ws(":", "grain_id", "ring"))
    parts = geometry.areas(rings, "key").select(F.split("key", ":")[0].cast("long").alias("grain_id"), F.when(F.col("ccw"), F.col("area")).otherwise(-F.col("area")).alias("area"))
    return rounded(parts.groupBy("grain_id").agg(F.sum("area").alias("area")))


@query()
def characteristic_functions(spark, d):
    return fem.characteristic_functions(_cells(spark, d))


@query(f"{_FIELD_SQL}, e AS (SELECT 'f' AS field, f AS v, weight FROM f UNION ALL SELECT 'x', x, weight FROM f) SELECT field, {_r('min(v)', 'low')}, {_r('sum(v * weight) / sum(weight)', 'mean')}, {_r('max(v)', 'high')} FROM e GROUP BY field")
def field_statistics(spark, d):
    return rounded(fields.statistics(_field(spark, d), ["f", "x"]))


@query(f"WITH {PRESENT_SQL}, e AS (SELECT phase, i, [k11, k12, k13, k21, k22, k23, k31, k32, k33][i + 1] AS v, [k11, k21, k31, k12, k22, k32, k13, k23, k33][i + 1] AS t FROM phases, range(9) r(i)), m AS (SELECT phase, max(abs((v + t) / 2)) AS m FROM e GROUP BY phase) SELECT phase, CAST(i AS INTEGER) AS i, CASE WHEN abs((v + t) / 2) < 0.08 * m THEN 0 ELSE round((v + t) / 2, 6) END AS value FROM e JOIN m USING (phase)")
def clean_conductivity(spark, d):
    """With a threshold high enough to act on some entries."""
    return rounded(homogenize.cleaned(S.phases_of_map(spark, d), "kappa", 9 // 3, 0.08).select("phase", F.posexplode("kappa").alias("i", "value")))


@query(f"WITH {_MESH_SQL} SELECT elem_id, {', '.join(_r(f'{c}{i}::DOUBLE', f'{c}{i}') for i in (1, 2, 3) for c in 'xy')} FROM placed")
def mesh_cleanup(spark, d):
    """A mesh given twice, shifted in number and turned round, becomes itself again: elements with the places of their corners."""
    nodes, flat = _mesh(spark, d)
    twice = nodes.unionByName(nodes.withColumn("node_id", F.col("node_id") + (1 << 40)))
    mixed = flat.select("elem_id", F.when(F.col("elem_id") % 2 == 0, F.col("n1")).otherwise(F.col("n1") + (1 << 40)).alias("n1"), F.col("n3").alias("n2"), F.col("n2").alias("n3"))
    return rounded(mesh.cleanup(mixed, twice, placed=True)[0].select("elem_id", *(f"{c}{i}" for i in (1, 2, 3) for c in "xy")))


@query(f"{_WAVES_SQL} SELECT phase, coalesce(points, 0) AS points, i, j, {_r('x * sqrt(2 / (1 - z))', 'px')}, {_r('y * sqrt(2 / (1 - z))', 'py')}, {', '.join(_r(c, c, 3) for c in ('vp', 'vs1', 'vs2'))} FROM w LEFT JOIN held USING (phase)")
def wave_speed_projection(spark, d):
    """Speeds at their places in the equal-area projection, for plotting."""
    px, py = T.lambert(F.col("x"), F.col("y"), F.col("z"))
    return _rounded_waves(_phase_waves(spark, d).select("phase", "points", "i", "j", px.alias("px"), py.alias("py"), "vp", "vs1", "vs2"))


@query()
def field_on_grid(spark, d):
    """The field inside each square of the map on a regular grid, as for arrows or images."""
    field = _field(spark, d)
    return fields.interpolate(_in_squares(field), _in_squares(fields.regular_grid(field)), "grain", ["f"])


# --- meshes triangulated anew --------------------------------------------------------------------------------------------


def _triangulated(spark, d, **how):
    side = S.map_side(spark, d)
    return triangulation.mesh_grains(_grained(spark, d), side, side, **how)


@query()
def polygon_triangulation(spark, d):
    return triangulation.mesh_polygons(_rings(spark, d), "ring", 0.8)


@query(f"WITH {_RINGS_SQL}, {_EDGES_SQL} SELECT ring, {_r('abs(sum(ax * b_y - bx * ay)) / 2', 'area')} FROM edges GROUP BY ring")
def polygon_triangulation_area(spark, d):
    """The triangles' areas add up to the polygons'."""
    return rounded(polygon_triangulation(spark, d).groupBy("ring").agg(F.sum(mesh.signed_area()).alias("area")))


@query()
def conforming_triangulation(spark, d):
    return _triangulated(spark, d)


@query(SQL["mesh_checks"])
def conforming_triangulation_checks(spark, d):
    placed = checkpointed(_triangulated(spark, d))  # read by eight rules
    return mesh.checks(placed.select("elem_id", "n1", "n2", "n3"), triangulation.nodes_of(placed))


@query(f"{_GRAINS} SELECT grain_id, {_r('count(*)::DOUBLE', 'area')} FROM grained GROUP BY grain_id")
def grain_triangulation_area(spark, d):
    """Without smoothing, each grain's triangles have its pixels' area."""
    return rounded(_triangulated(spark, d, smoothing=0).groupBy("grain_id").agg(F.sum(mesh.signed_area()).alias("area")))


@query(f"""{_SIDES}, between AS (SELECT x, y, across FROM sides GROUP BY ALL HAVING count(*) = 2),
ends AS (SELECT CASE across WHEN 'h' THEN (x - 1) // 2 ELSE x // 2 END AS x, CASE across WHEN 'h' THEN y // 2 ELSE (y - 1) // 2 END AS y, CASE across WHEN 'h' THEN 1 ELSE w + 1 END AS step, w FROM between, side)
SELECT y * (w + 1) + x AS a, y * (w + 1) + x + step AS b FROM ends""")
def conforming_triangulation_boundaries(spark, d):
    """Edges between elements of two grains: just the sides of pixels of two grains, each of them one edge."""
    each = F.explode(F.array(*(F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in (("n1", "n2"), ("n2", "n3"), ("n1", "n3")))))
    found = _triangulated(spark, d).select("grain_id", each.alias("e")).groupBy("e.a", "e.b").agg(F.min("grain_id").alias("low"), F.max("grain_id").alias("high"))
    return found.where("low < high").select("a", "b")


@query(f"WITH {MAP_SQL}, corner AS (SELECT k % (w + 1) AS x, k // (w + 1) AS y, k AS node_id, w FROM side, LATERAL (SELECT unnest(range((w + 1) * (w + 1))) AS k)) SELECT node_id, (y % w) * (w + 1) + x % w AS master_id FROM corner WHERE x = w OR y = w")
def conforming_triangulation_periodic(spark, d):
    return mesh.periodic_pairs(checkpointed(triangulation.nodes_of(_triangulated(spark, d))))


@query()
def conforming_triangulation_quality(spark, d):
    return mesh.statistics(_triangulated(spark, d).select("elem_id", "n1", "n2", "n3", *triangulation.PLACES))


@query()
def grain_contours(spark, d):
    return triangulation.grain_contours(_grained(spark, d))


from grainflow.plans import bound_queries, boundary_queries, source_queries  # noqa: E402, F401 (they register their queries)

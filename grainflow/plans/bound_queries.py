"""Voigt, Reuss and Hill bounds of stiffness and expansion, moduli and the geometric conductivity of the event map, with SQL in long form."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from grainflow.functions import tensors as T
from grainflow.operators import homogenize
from grainflow.plans import standard as S
from grainflow.plans.queries import CELLS, _estimates, _r, query, rounded
from grainflow.plans.standard import MAP_SQL, PHASES_SQL

BOUNDS = ("voigt", "reuss", "hill")


def _inverse(source: str, name: str) -> str:
    """CTEs that end in `name`(r, c, v), the inverse of the 6 x 6 matrix in `source`(r, c, v), pivot by pivot."""
    steps = [f"{name}0 AS (SELECT r, c, v FROM {source} UNION ALL SELECT r, 6 + c, CASE WHEN r = c THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM {source})"]
    for k in range(1, 7):
        g = f"{name}{k - 1}"
        steps.append(f"{name}{k} AS (SELECT g.r, g.c, CASE WHEN g.r = {k} THEN g.v / p.v ELSE g.v - q.v * w.v / p.v END AS v FROM {g} g JOIN {g} p ON p.r = {k} AND p.c = {k} JOIN {g} q ON q.r = g.r AND q.c = {k} JOIN {g} w ON w.r = {k} AND w.c = g.c)")
    return ", ".join([*steps, f"{name} AS (SELECT r, c - 6 AS c, v FROM {name}6 WHERE c > 6)"])


def _bounds_sql() -> str:
    """CTEs of the map's Voigt, Reuss and Hill stiffness `bound`(method, r, c, v) and expansion `alpha`(method, r, v)."""
    turn = ", ".join(f"{e} AS {n}" for n, e in S.ROTATION_SQL.items())
    pairs = ", ".join(f"({n}, {i + 1}, {j + 1})" for n, (i, j) in enumerate(T.VOIGT, 1))
    return f"""WITH {MAP_SQL}, {PHASES_SQL}, kinds_ AS (SELECT phase, phi1, phi, phi2, count(*) AS n FROM points GROUP BY ALL), whole AS (SELECT sum(n) AS n FROM kinds_),
turned AS (SELECT row_number() OVER (ORDER BY phase, phi1, phi, phi2) AS id, phase, n, {turn} FROM kinds_),
a AS (SELECT id, i, k, v FROM turned, LATERAL (VALUES {", ".join(f"({i}, {j}, a{i}{j})" for i, j in CELLS)}) t(i, k, v)),
voigt(v, i, j) AS (VALUES {pairs}),
m AS (SELECT ik.id, r.v AS r, c.v AS c, ik.v * jl.v + CASE WHEN c.i <> c.j THEN il.v * jk.v ELSE 0 END AS v FROM voigt r, voigt c JOIN a ik ON ik.i = r.i AND ik.k = c.i
  JOIN a jl ON jl.id = ik.id AND jl.i = r.j AND jl.k = c.j JOIN a il ON il.id = ik.id AND il.i = r.i AND il.k = c.j JOIN a jk ON jk.id = ik.id AND jk.i = r.j AND jk.k = c.i),
e AS (SELECT id, r, c, v * CASE WHEN r > 3 THEN 2 ELSE 1 END / CASE WHEN c > 3 THEN 2 ELSE 1 END AS v FROM m),
stiff AS (SELECT phase, (i // 6 + 1) AS r, (i % 6 + 1) AS c, stiffness[i + 1] AS v FROM phases, range(36) t(i)),
crystal AS (SELECT phase, stiffness[1] AS c11, stiffness[2] AS c12, stiffness[3] AS c13, stiffness[15] AS c33, stiffness[22] AS c44, stiffness[36] AS c66 FROM phases),
soft AS (SELECT phase, 0.5 * (c33 / d + 1 / (c11 - c12)) AS s11, 0.5 * (c33 / d - 1 / (c11 - c12)) AS s12, -c13 / d AS s13, (c11 + c12) / d AS s33, 1 / c44 AS s44, 1 / c66 AS s66 FROM (SELECT *, c33 * (c11 + c12) - 2 * c13 * c13 AS d FROM crystal)),
comply AS (SELECT phase, r, c, CASE WHEN r > 3 OR c > 3 THEN CASE WHEN r <> c THEN 0 WHEN r = 6 THEN s66 ELSE s44 END WHEN r = 3 AND c = 3 THEN s33 WHEN r = 3 OR c = 3 THEN s13 WHEN r = c THEN s11 ELSE s12 END AS v FROM soft, range(1, 7) i(r), range(1, 7) j(c)),
mc AS (SELECT m.id, m.r, c.c, sum(m.v * c.v) AS v FROM m JOIN turned USING (id) JOIN stiff c ON c.phase = turned.phase AND c.r = m.c GROUP BY ALL),
es AS (SELECT e.id, e.r, c.c, sum(e.v * c.v) AS v FROM e JOIN turned USING (id) JOIN comply c ON c.phase = turned.phase AND c.r = e.c GROUP BY ALL),
own AS (SELECT mc.id, mc.r, m.r AS c, sum(mc.v * m.v) AS v FROM mc JOIN m ON m.id = mc.id AND m.c = mc.c GROUP BY ALL),
upper AS (SELECT own.r, own.c, sum(n * own.v) / (SELECT n FROM whole) AS v FROM own JOIN turned USING (id) GROUP BY own.r, own.c),
lower AS (SELECT es.r, e.r AS c, sum(n * es.v * e.v) / (SELECT n FROM whole) AS v FROM es JOIN e ON e.id = es.id AND e.c = es.c JOIN turned ON turned.id = es.id GROUP BY es.r, e.r),
{_inverse("lower", "reuss")}, two AS (SELECT 'voigt' AS method, r, c, v FROM upper UNION ALL SELECT 'reuss', r, c, v FROM reuss),
bound AS (SELECT * FROM two UNION ALL SELECT 'hill', r, c, avg(v) FROM two GROUP BY r, c),
grow AS (SELECT e.id, e.r, sum(e.v * CASE e.c WHEN 1 THEN a1 WHEN 2 THEN a2 WHEN 3 THEN a3 ELSE 0 END) AS v FROM e JOIN turned USING (id) JOIN phases USING (phase) GROUP BY e.id, e.r),
press AS (SELECT own.r, sum(n * own.v * g.v) / (SELECT n FROM whole) AS v FROM own JOIN turned USING (id) JOIN grow g ON g.id = own.id AND g.r = own.c GROUP BY own.r),
{_inverse("upper", "supple")},
ends AS (SELECT 'voigt' AS method, s.r, sum(s.v * p.v) AS v FROM supple s JOIN press p ON p.r = s.c GROUP BY s.r UNION ALL SELECT 'reuss', g.r, sum(n * g.v) / (SELECT n FROM whole) FROM grow g JOIN turned USING (id) GROUP BY g.r),
alpha AS (SELECT * FROM ends UNION ALL SELECT 'hill', r, avg(v) FROM ends GROUP BY r)"""


_BOUNDS = _bounds_sql()


def _bounds(spark, d):
    return _estimates(spark, d).where(F.col("method").isin(*BOUNDS))


@query(f"{_BOUNDS} SELECT method, CAST(r AS INTEGER) AS i, CAST(c AS INTEGER) AS j, {_r('v', 'value', 5)} FROM bound")
def stiffness_bounds(spark, d):
    each = _bounds(spark, d).select("method", F.posexplode("stiffness").alias("p", "value"))
    return rounded(each.select("method", F.floor(F.col("p") / 6 + 1).cast("int").alias("i"), (F.col("p") % 6 + 1).cast("int").alias("j"), "value"), 5)


@query(f"""{_BOUNDS}, pull AS (SELECT b.method, b.r, sum(b.v * a.v) AS v FROM bound b JOIN alpha a ON a.method = b.method AND a.r = b.c WHERE b.method <> 'hill' GROUP BY b.method, b.r),
beta AS (SELECT * FROM pull UNION ALL SELECT 'hill', r, avg(v) FROM pull GROUP BY r)
SELECT method, CAST(r AS INTEGER) AS i, {_r('a.v', 'alpha', 5)}, {_r('b.v', 'beta', 4)} FROM alpha a JOIN beta b USING (method, r)""")
def expansion_bounds(spark, d):
    """Thermal expansion and stress-temperature moduli."""
    each = _bounds(spark, d).select("method", F.posexplode(F.arrays_zip("alpha", "beta")).alias("p", "v"))
    return each.select("method", (F.col("p") + 1).alias("i"), (F.round("v.alpha", 5) + F.lit(0.0)).alias("alpha"), (F.round("v.beta", 4) + F.lit(0.0)).alias("beta"))


def _moduli_sql() -> str:
    parts = [", ".join(f"of_{m} AS (SELECT r, c, v FROM bound WHERE method = '{m}'), {_inverse(f'of_{m}', f'soft_{m}')}" for m in BOUNDS)]
    every = " UNION ALL ".join(f"SELECT '{m}' AS method, r, c, v FROM soft_{m}" for m in BOUNDS)
    return f"""{_BOUNDS}, {parts[0]}, every AS ({every}), main AS (SELECT method, r, v AS own FROM every WHERE r = c)
SELECT method, CASE r WHEN 4 THEN 'G23' WHEN 5 THEN 'G13' WHEN 6 THEN 'G12' ELSE 'E' || r END AS name, {_r('1 / own', 'value', 5)} FROM main
UNION ALL SELECT method, 'nu' || r || c AS name, {_r('-v / own', 'value')} FROM every JOIN main USING (method, r) WHERE r <= 3 AND c <= 3 AND r <> c"""


@query(_moduli_sql())
def moduli_bounds(spark, d):
    """Young's and shear moduli and Poisson's ratios of the bounds."""
    found = homogenize.engineering_properties(_bounds(spark, d))
    digits = F.when(F.col("name").startswith("nu"), F.round("value", 6)).otherwise(F.round("value", 5))
    return found.select("method", "name", (digits + F.lit(0.0)).alias("value"))


def _geometric_sql() -> str:
    """The logarithm turns with the tensor, so that of each phase stands here; the exponential of the mean is its series."""
    logs = []
    for phase, *_, kappa in S.phase_rows():
        m = np.array(kappa).reshape(3, 3)
        value, vector = np.linalg.eigh((m + m.T) / 2)
        logs.append((phase, *((vector * np.log(value)) @ vector.T).ravel().tolist()))
    rows = ", ".join(f"({p}, {', '.join(f'{v!r}::DOUBLE' for v in log)})" for p, *log in logs)
    turn = ", ".join(f"{e} AS {n}" for n, e in S.ROTATION_SQL.items())
    entry = lambda i, j: " + ".join(f"a{i}{p} * l{p}{q} * a{j}{q}" for p in (1, 2, 3) for q in (1, 2, 3))
    step = lambda i, j: "(" + " + ".join(f"t{i}{k} * m{k}{j}" for k in (1, 2, 3)) + f") / (k + 1) AS t{i}{j}"
    one = ", ".join(f"{float(i == j)}::DOUBLE AS t{i}{j}" for i, j in CELLS)
    return f"""WITH RECURSIVE {MAP_SQL}, logs(phase, {", ".join(f"l{i}{j}" for i, j in CELLS)}) AS (VALUES {rows}), turned AS (SELECT phase, {turn} FROM points),
mean AS (SELECT {", ".join(f"avg({entry(i, j)}) AS m{i}{j}" for i, j in CELLS)} FROM turned JOIN logs USING (phase)),
term(k, {", ".join(f"t{i}{j}" for i, j in CELLS)}) AS (SELECT 0, {one} UNION ALL SELECT k + 1, {", ".join(step(i, j) for i, j in CELLS)} FROM term, mean WHERE k < 40)
SELECT {", ".join(_r(f"sum(t{i}{j})", f"k{i}{j}") for i, j in CELLS)} FROM term"""


@query(_geometric_sql())
def geometric_conductivity(spark, d):
    """The exponential of the mean logarithm of the points' conductivities."""
    k = F.col("kappa_geometric")
    return rounded(_estimates(spark, d).where("method = 'geometric'").select(*(k[3 * i + j - 4].alias(f"k{i}{j}") for i, j in CELLS)))


def _waves_sql() -> str:
    """Squares of the speeds as eigenvalues of C_ijkl n_j n_l, in closed form."""
    voigt = lambda i, j: i if i == j else 9 - i - j
    g = lambda i, k: " + ".join(f"c[{6 * voigt(i, j) - 6 + voigt(k, m)}] * n{j} * n{m}" for j in (1, 2, 3) for m in (1, 2, 3))
    return f"""{_BOUNDS}, density AS (SELECT avg(density) AS density FROM points JOIN phases USING (phase)), solid AS (SELECT method, list(v ORDER BY r, c) AS c FROM bound GROUP BY method),
ij AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, pi() - i * (pi() / 200) AS p, j * (2 * pi() / 200) AS q FROM range(101) a(i), range(201) b(j)),
way AS (SELECT i, j, sin(p) * cos(q) AS n1, sin(p) * sin(q) AS n2, cos(p) AS n3 FROM ij),
g AS (SELECT method, i, j, n1, n2, n3, {", ".join(f"{g(i, k)} AS g{i}{k}" for i, k in ((1, 1), (2, 2), (3, 3), (1, 2), (1, 3), (2, 3)))} FROM solid, way),
s AS (SELECT *, (g11 + g22 + g33) / 3 AS m FROM g), t AS (SELECT *, sqrt((pow(g11 - m, 2) + pow(g22 - m, 2) + pow(g33 - m, 2) + 2 * (g12 * g12 + g13 * g13 + g23 * g23)) / 6) AS s FROM s),
u AS (SELECT *, acos(least(greatest(((g11 - m) * ((g22 - m) * (g33 - m) - g23 * g23) - g12 * (g12 * (g33 - m) - g23 * g13) + g13 * (g12 * g23 - (g22 - m) * g13)) / (2 * s * s * s), -1), 1)) / 3 AS t FROM t),
k AS (SELECT *, m + 2 * s * cos(t) AS k1, m + 2 * s * cos(t + 2 * pi() / 3) AS k3 FROM u),
v AS (SELECT method, i, j, sqrt(1e9 * k1 / density) AS vp, sqrt(1e9 * (3 * m - k1 - k3) / density) AS vs1, sqrt(1e9 * k3 / density) AS vs2 FROM k, density),
w AS (SELECT *, max(vp) OVER (PARTITION BY method) AS fastest FROM v)"""


_WAVES = _waves_sql()


def _speeds(spark, d):
    from grainflow.operators import waves

    materials = _bounds(spark, d).select("method", F.transform("stiffness", lambda x: x * 1e9).alias("stiffness")).join(homogenize.homogenised_density(S.event_map(spark, d), S.phases(spark)))
    return waves.wave_speeds(materials, "method")


@query(f"{_WAVES} SELECT method, i, j, {', '.join(_r(c, c, 2) for c in ('vp', 'vs1', 'vs2'))}, {_r('(vs1 - vs2) / ((vs1 + vs2) / 2) * 100', 'avs', 5)}, {_r('1 / vs2 - 1 / vs1', 'dts', 11)}, {_r('1 / vp - 1 / fastest', 'dtp', 11)} FROM w")
def wave_speed_bounds(spark, d):
    """Of the map's bounds in every direction of the default grid."""
    digits = {"vp": 2, "vs1": 2, "vs2": 2, "avs": 5, "dts": 11, "dtp": 11}
    return _speeds(spark, d).select("method", "i", "j", *((F.round(c, n) + F.lit(0.0)).alias(c) for c, n in digits.items()))


@query(f"{_WAVES} SELECT method, {', '.join(_r(f'(max({c}) - min({c})) / ((max({c}) + min({c})) / 2) * 100', f'a_{c}', 5) for c in ('vp', 'vs1', 'vs2'))}, {_r('max((vs1 - vs2) / ((vs1 + vs2) / 2) * 100)', 'max_avs', 5)} FROM w GROUP BY method")
def wave_anisotropy_bounds(spark, d):
    from grainflow.operators import waves

    return rounded(waves.anisotropy(_speeds(spark, d), "method").select("method", "a_vp", "a_vs1", "a_vs2", "max_avs"), 5)


@query(f"""WITH {S.PRESENT_SQL}, e AS (SELECT phase, i, stiffness[i + 1] AS v, stiffness[i % 6 * 6 + i // 6 + 1] AS t FROM phases, range(36) r(i)), m AS (SELECT phase, max(abs((v + t) / 2)) AS m FROM e GROUP BY phase)
SELECT phase, CAST(i AS INTEGER) AS i, CASE WHEN abs((v + t) / 2) < 0.3 * m THEN 0 ELSE round((v + t) / 2, 6) END AS value FROM e JOIN m USING (phase)""")
def clean_stiffness(spark, d):
    """With a threshold high enough to act on some entries."""
    return rounded(homogenize.cleaned(S.phases_of_map(spark, d), "stiffness", 6, 0.3).select("phase", F.posexplode("stiffness").alias("i", "value")))

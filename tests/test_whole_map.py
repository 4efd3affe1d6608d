"""Queries bound to the event map read all of it."""

import numpy as np
import pytest

from grainflow.plans import queries as core
from grainflow.plans import standard as S

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def side(spark):
    return S.map_side(spark, SF)


@pytest.mark.parametrize("cells", [core._cells, core._elastic])
def test_cell_problems_take_every_pixel(spark, side, cells):
    got = cells(spark, SF)
    assert {r["elem_id"] for r in got.select("elem_id").collect()} == set(range(2 * side * side))
    assert got.select("map_id").distinct().count() == 1


def test_flux_rows_cover_the_map(spark, side):
    q = core.heat_flux_field(spark, SF).toPandas()
    assert len(q) == 4 * 2 * side * side and q["weight"].sum() == pytest.approx(side * side)
    assert (q["q1"] * q["weight"]).sum() / q["weight"].sum() == pytest.approx(1.0)


def test_every_point_gets_its_neighbours(spark):
    """Against brute force; the distances are exact in binary, so ties are too."""
    points = S.event_map(spark, SF).select("point_id", "x", "y", "phase").toPandas()
    target = points[points["phase"] == 1]
    want = set()
    for p in points.itertuples():
        d2 = (p.x + 0.25 - target["x"]) ** 2 + (p.y + 0.125 - target["y"]) ** 2
        best = sorted(zip(d2, target["point_id"], strict=True))[:3]
        want |= {(p.point_id, k + 1, i, round(d, 6)) for k, (d, i) in enumerate(best)}
    got = [tuple(r) for r in core.nearest_neighbor(spark, SF).select("query_id", "rank", "point_id", "distance2").collect()]
    assert len(got) == len(want) == 3 * len(points) and set(got) == want


def test_mesh_and_material_cover_the_map(spark, side):
    q = core.conforming_mesh_quality(spark, SF).first()
    assert q["elements"] == 2 * side * side and q["area_mean"] == pytest.approx(0.5) and q["area_min"] > 0
    hill = core.element_material_hill(spark, SF).select("elem_id").toPandas()["elem_id"]
    assert sorted(hill) == list(range(2 * (side // 3) ** 2))


def test_elements_take_the_nearest_phase(spark, side):
    points = S.event_map(spark, SF).select("point_id", "x", "y", "phase").toPandas().sort_values("point_id")
    px, py = points["x"].to_numpy(float), points["y"].to_numpy(float)
    want = {}
    for e in range(2 * side * side):  # centres of the lower right and upper left half of each pixel
        x, y = e // 2 % side + (2 / 3, 1 / 3)[e % 2], e // 2 // side + (1 / 3, 2 / 3)[e % 2]
        want[e] = int(points["phase"].iloc[int(np.argmin(np.round((px - x) ** 2 + (py - y) ** 2, 9)))])
    got = {r["elem_id"]: r["phase"] for r in core.element_phase_nearest(spark, SF).collect()}
    assert got == want


def test_size_field_covers_the_map(spark, side):
    from grainflow.operators.conforming import size_field

    grained = core._grained(spark, SF)
    seeds = core.grains.corners(grained).select("x", "y").distinct().toPandas()
    i, j = np.mgrid[: side + 1, : side + 1]
    di, dj = abs(i[..., None] - seeds["y"].to_numpy()), abs(j[..., None] - seeds["x"].to_numpy())
    di, dj = np.minimum(di, side + 1 - di), np.minimum(dj, side + 1 - dj)
    grid = lambda df: df.toPandas().sort_values(["i", "j"])["h"].to_numpy().reshape(side + 1, side + 1)
    assert np.allclose(grid(size_field(grained, 0.5, 0.25, along_axes=True)), 0.5 + 0.25 * (di + dj).min(-1))
    h = grid(core.mesh_size_field_gradient(spark, SF))
    # The upwind form is at most the way along the axes and keeps the gradient's limit, and reaches it wherever no boundary is.
    assert (h >= 0.5 - 1e-6).all() and (h <= 0.5 + 0.25 * (di + dj).min(-1) + 1e-6).all()
    down = [np.maximum(h - np.minimum(np.roll(h, 1, k), np.roll(h, -1, k)), 0) for k in (0, 1)]
    assert np.hypot(*down).max() <= 0.25 + 1e-5
    assert np.allclose(h[(di + dj).min(-1) == 0], 0.5) and np.allclose(np.hypot(*down)[(di + dj).min(-1) > 0], 0.25, atol=1e-5)


def test_waves_take_the_whole_grid(spark):
    """101 x 201 directions of each material, as the operator's default."""
    for name, key, materials in (("wave_speeds", "method", 4), ("phase_wave_speeds", "phase", S.PHASES), ("wave_speed_projection", "phase", S.PHASES)):
        got = core.QUERIES[name](spark, SF).groupBy(key).count().collect()
        assert len(got) == materials and {r["count"] for r in got} == {101 * 201}, name
    assert core.wave_anisotropy(spark, SF).count() == 4


def test_pixel_cells_equal_the_general_mesh(spark):
    """A tile's elements, numbered from the pixels alone, have the effective tensors of the same mesh built with joins; tiles cover the map."""
    from grainflow.operators import fem, mesh

    points = S.event_map(spark, SF).where("x < 7 and y < 5")
    properties = S.phases(spark).select("phase", "stiffness", "alpha", "kappa")
    tiled = fem.tiles(points, 9, 7, 5).join(properties, "phase")
    direct = fem.pixel_cells(tiled, ("stiffness", "alpha", "kappa"), core.F.col("y") * 7 + core.F.col("x"))
    nodes, flat = mesh.grid_mesh(spark, 0.0, 7.0, 0.0, 5.0, 7, 5)
    wide, six = mesh.quadratic(flat, nodes)
    general = fem.place_elements(six, wide, mesh.periodic_pairs(wide), direct.select("elem_id", "stiffness", "alpha", "kappa")).withColumn("map_id", core.F.lit("0:0"))
    a, b = (fem.effective_conductivity(fem.solve_conduction(x)).first() for x in (direct, general))
    assert a["map_id"] == "0:0" and np.allclose(a["kappa"], b["kappa"], rtol=1e-7)
    a, b = (fem.effective_thermoelastic(fem.solve_thermoelastic(x)).first() for x in (direct, general))
    assert np.allclose(a["stiffness"], b["stiffness"], rtol=1e-6, atol=1e-6) and np.allclose(a["alpha"], b["alpha"], rtol=1e-6, atol=1e-8)
    for side, size in ((7, 3), (316, 70), (100, 32), (5, 5), (4, 1)):
        got = fem.tiles(spark.range(side).select(core.F.col("id").alias("x"), core.F.lit(0).alias("y")), size, side, 1).toPandas()
        assert ((got["x"] >= got["x0"]) & (got["x"] < got["x0"] + got["w"])).all() and got["w"].max() <= size and got["w"].max() - got["w"].min() <= 1
        assert got.groupby("x0")["w"].agg(["count", "first"]).eval("count == first").all()


def test_laminate_tiles_have_the_closed_form(spark):
    """Layers across y: the mean along them and the harmonic mean across, in every tile."""
    from grainflow.operators import fem

    grid = spark.range(64).select((core.F.col("id") % 8).alias("x"), core.F.floor(core.F.col("id") / 8).alias("y"))
    k = core.F.when(core.F.col("y") % 2 == 0, 1.0).otherwise(4.0)
    zero = core.F.lit(0.0)
    tiled = fem.tiles(grid, 4, 8, 8).withColumn("kappa", core.F.array(k, zero, zero, zero, k, zero, zero, zero, k))
    for r in fem.effective_conductivity(fem.solve_conduction(fem.pixel_cells(tiled, ("kappa",), core.F.col("y") * 8 + core.F.col("x")))).collect():
        assert np.allclose(r["kappa"], [2.5, 0, 0, 0, 1.6, 0, 0, 0, 2.5], atol=1e-6)


def test_property_estimates_equal_brute_force(spark):
    """Each point's tensors turned index by index, averaged, for the whole map."""
    from grainflow.functions import tensors as T

    points = S.event_map(spark, SF).toPandas()
    rows = {r["phase"]: r for r in S.phases(spark).collect()}
    pairs, full = T.VOIGT, lambda m: np.array([[[[m[T.VOIGT.index(tuple(sorted((i, j))))][T.VOIGT.index(tuple(sorted((k, l))))] for l in range(3)] for k in range(3)] for j in range(3)] for i in range(3)])  # noqa: E731, E741
    two = np.array([1, 1, 1, 2, 2, 2.0])
    c_sum, s_sum, logs, n = np.zeros((6, 6)), np.zeros((6, 6)), np.zeros((6, 6)), 0
    for (phase, p1, p, p2), part in points.groupby(["phase", "phi1", "phi", "phi2"]):
        z = lambda t: np.array([[np.cos(t), -np.sin(t), 0], [np.sin(t), np.cos(t), 0], [0, 0, 1]])
        a = z(p1) @ np.array([[1, 0, 0], [0, np.cos(p), -np.sin(p)], [0, np.sin(p), np.cos(p)]]) @ z(p2)
        c = np.array(rows[phase]["stiffness"]).reshape(6, 6)
        turn = lambda m: np.einsum("ia,jb,kc,ld,abcd->ijkl", a, a, a, a, full(m))  # noqa: E731, B023
        flat = lambda t: np.array([[t[i, j, k, l] for k, l in pairs] for i, j in pairs])  # noqa: E731, E741
        stiff = flat(turn(c))
        c_sum += len(part) * stiff
        s_sum += len(part) * flat(turn(np.linalg.inv(c) / two / two[:, None])) * two * two[:, None]
        w, v = np.linalg.eigh(stiff)
        logs += len(part) * (v * np.log(w)) @ v.T
        n += len(part)
    w, v = np.linalg.eigh(logs / n)
    want = {"voigt": c_sum / n, "reuss": np.linalg.inv(s_sum / n), "geometric": (v * np.exp(w)) @ v.T}
    want["hill"] = (want["voigt"] + want["reuss"]) / 2
    got = {r["method"]: r for r in core.property_estimates(spark, SF).collect()}
    for method, m in want.items():
        assert np.allclose(np.array(got[method]["stiffness"]).reshape(6, 6), m, rtol=1e-8, atol=1e-8), method
    for r in core.engineering_properties(spark, SF).collect():
        s = np.linalg.inv(want[r["method"]])
        name, i = r["name"], int(r["name"][-1]) - 1
        value = 1 / s[i, i] if name[0] == "E" else 1 / s[{"G23": 3, "G13": 4, "G12": 5}[name], {"G23": 3, "G13": 4, "G12": 5}[name]] if name[0] == "G" else -s[i, int(name[2]) - 1] / s[int(name[2]) - 1, int(name[2]) - 1]
        assert r["value"] == pytest.approx(value, rel=1e-7), r


def test_wave_speeds_solve_the_christoffel_equation(spark):
    """All directions of one method: the squares of the speeds, times the density, are the eigenvalues, by trace, squares and determinant."""
    import itertools

    from grainflow.functions import tensors as T

    got = core.wave_speeds(spark, SF).where("method = 'hill'").toPandas()
    c = np.array(core.property_estimates(spark, SF).where("method = 'hill'").first()["stiffness"]).reshape(6, 6)
    rho = core.homogenized_density(spark, SF).first()["density"]
    n = got[["x", "y", "z"]].to_numpy()
    v = lambda i, j: T.VOIGT.index(tuple(sorted((i, j))))
    g = np.zeros((len(n), 3, 3))
    for i, j, k, m in itertools.product(range(3), repeat=4):
        g[:, i, k] += c[v(i, j), v(k, m)] * n[:, j] * n[:, m]
    e = rho * got[["vp", "vs1", "vs2"]].to_numpy() ** 2 / 1e9  # stiffness is in GPa
    assert np.allclose(e.sum(1), np.trace(g, axis1=1, axis2=2), rtol=1e-6) and np.allclose((e**2).sum(1), (g**2).sum((1, 2)), rtol=1e-6)
    assert np.allclose(e.prod(1), np.linalg.det(g), rtol=1e-6) and (got["vp"] >= got["vs1"]).all() and (got["vs1"] >= got["vs2"]).all()


def test_curvature_at_ends_takes_the_next_two_points(spark):
    from grainflow.operators import geometry

    arc = spark.createDataFrame([("a", k, float(3 * np.cos(t)), float(3 * np.sin(t))) for k, t in enumerate(np.linspace(0, 1, 40))] + [("b", 0, 0.0, 0.0), ("b", 1, 1.0, 0.0)], "key string, seq int, x double, y double")
    got = geometry.curvature(arc, "key").toPandas()
    assert np.allclose(got[got["key"] == "a"]["curvature"], 1 / 3, rtol=2e-3) and got[got["key"] == "b"]["curvature"].isna().all()


def test_small_grains_follow_their_neighbours(spark):
    """A grain of one point merges into one of two, which merges into one of three, which merges into a large one: all end there."""
    from grainflow.operators import grains

    sizes = [(1, 1), (2, 2), (3, 3), (4, 9)]
    xs = [g for g, n in sizes for _ in range(n)]
    rows = [(i, i, 0, g, float(g), 0.0, 0.0, 100 * g) for i, g in enumerate(xs)]
    df = spark.createDataFrame(rows, "point_id long, x long, y long, phase int, phi1 double, phi double, phi2 double, grain_id long")
    got = grains.merge_small(df, 3).collect()
    assert {r["grain_id"] for r in got} == {400} and {r["phase"] for r in got} == {4} and {r["phi1"] for r in got} == {4.0}


def test_side_numbers_stay_whole_for_large_nodes(spark):
    """Numbers of mid-side nodes of nodes beyond 2**28 don't collide, as they would as doubles."""
    from grainflow.operators import mesh

    base = 3 * 10**8 + 1
    nodes = spark.createDataFrame([(base + k, float(k % 2), float(k // 2)) for k in range(4)], "node_id long, x double, y double")
    flat = spark.createDataFrame([(0, base, base + 1, base + 3), (1, base, base + 3, base + 2)], "elem_id long, n1 long, n2 long, n3 long")
    wide, six = mesh.quadratic(flat, nodes)
    assert wide.select("node_id").distinct().count() == 9 == wide.count()
    assert {r["n6"] for r in six.collect() if r["elem_id"] == 0} == {r["n4"] for r in six.collect() if r["elem_id"] == 1}


@pytest.mark.parametrize("kind", ["conduction", "thermoelastic"])
def test_solutions_solve_the_assembled_problem(spark, kind):
    """The characteristic functions, found without a matrix, balance the assembled forces; the matrix is symmetric."""
    from grainflow.operators import fem

    points = S.event_map(spark, SF).where("x < 5 and y < 4").join(S.phases(spark).select("phase", "stiffness", "alpha", "kappa"), "phase")
    cells = fem.pixel_cells(fem.tiles(points, 9, 5, 4), ("stiffness", "alpha", "kappa"), core.F.col("y") * 5 + core.F.col("x"))
    matrix, forces = (x.toPandas() for x in fem.assembled(cells, kind))
    width, sides = (1, 3) if kind == "conduction" else (3, 7)
    n = matrix["row"].max() + 1
    a, f, chi = np.zeros((n, n)), np.zeros((n, sides)), np.zeros((n, sides))
    a[matrix["row"], matrix["col"]] = matrix["value"]
    f[forces["row"], forces["k"]] = forces["value"]
    got = fem.characteristic_functions(cells, kind).toPandas()
    chi[got["node_id"] * width + got["dof"], got["k"]] = got["value"]
    assert np.allclose(a, a.T) and np.allclose(a @ chi, f, atol=1e-6 * np.abs(f).max())


def test_minorities_go(spark):
    """No point is left that fewer than `least` of its own kind surround, unless the rounds end at an equal count."""
    got = core.QUERIES["clean_two_phase_map"](spark, SF).toPandas()
    assert len(got) == S.map_side(spark, SF) ** 2 and 0.25 < (got["phase"] == 2).mean() < 0.55
    grid = got.pivot(index="y", columns="x", values="phase").to_numpy()
    own = sum((np.roll(grid, (a, b), (0, 1)) == grid).astype(int) for a in range(-2, 3) for b in range(-2, 3))
    assert (own < 11).sum() <= 2


def test_fitted_spacing_takes_the_best_of_its_rounds(spark):
    from grainflow.operators import mesh

    df = spark.createDataFrame([(31.0, 17.0, 2000), (500.0, 1.0, 90), (3.0, 3.0, 3000)], "w double, h double, target long")
    fit = lambda count: df.select("target", mesh.fitted_spacing(count, core.F.col("target"), 30.0).alias("f")).select("target", "f.*").collect()
    for r in fit(mesh.rectangular_count(core.F.col("w"), core.F.col("h"))):
        assert abs(r["count"] - r["target"]) <= 0.05 * r["target"] and 1 <= r["round"] <= 6
    assert {(r["count"], r["round"], r["length"]) for r in fit(lambda h: core.F.lit(7))} == {(7, 1, 30.0)}


def test_order_statistics_by_histograms(spark, monkeypatch):
    import random

    from grainflow.operators import quantiles

    rng = random.Random(1)
    values = [rng.gauss(0, 1) for _ in range(300)] + [0.25] * 200 + [1e300, -1e300, 1e-300] + [rng.lognormvariate(0, 9) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    monkeypatch.setattr(quantiles, "FEW", 5)
    ranked = sorted(values)
    for k in (0, 1, 150, 350, 351, 500, 701, len(values) - 1):
        assert quantiles.order_statistic(df, "v", k) == ranked[k]
    assert quantiles.order_statistic(df, "v", len(values)) is None and quantiles.quantile(df.where("v is null"), "v", 0.5) is None


@pytest.mark.parametrize("method", ["voigt", "reuss", "hill", "geometric"])
def test_element_material_equals_the_estimates_of_its_points(spark, method):
    """Two large triangles: each one's material is that of a map made of its points."""
    from grainflow.operators import elements, homogenize

    points = S.event_map(spark, SF).where("x < 8 and y < 8").withColumn("x", core.F.col("x") + 0.6).withColumn("y", core.F.col("y") + 0.3)
    nodes = spark.createDataFrame([(0, 0.0, 0.0), (1, 9.0, 0.0), (2, 9.0, 9.0), (3, 0.0, 9.0)], "node_id long, x double, y double")
    flat = spark.createDataFrame([(0, 0, 1, 2), (1, 0, 2, 3)], "elem_id long, n1 long, n2 long, n3 long")
    inside = elements.points_of_elements(points, flat, nodes)
    got = {r["elem_id"]: r for r in elements.material(points, S.phases(spark), flat, nodes, method).collect()}
    assert len(got) == 2
    for e, r in got.items():
        own = points.join(inside.where(core.F.col("elem_id") == e), "point_id")
        want = homogenize.property_estimates(own, S.phases(spark)).where(core.F.col("method") == method).first()
        assert np.allclose(r["stiffness"], want["stiffness"], rtol=1e-9, atol=1e-9)
        counts = own.groupBy("phase").count().collect()
        assert r["phase"] == min(counts, key=lambda c: (-c["count"], c["phase"]))["phase"]

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainflow.functions import kernels as K
from grainflow.functions import tensors as T
from grainflow.operators import fem, homogenize, mesh, waves
from grainflow.plans import standard as S
from grainflow.sources.properties import isotropic


def points(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "point_id long, x long, y long, phase int, phi1 double, phi double, phi2 double")


def test_rotations_agree_and_are_orthogonal(spark):
    rng = np.random.default_rng(0)
    e = rng.random((20, 3)) * 6
    a = K.rotations(e)
    assert np.allclose(a @ a.transpose(0, 2, 1), np.eye(3))
    df = spark.createDataFrame(e.tolist(), "a double, b double, c double")
    got = df.select(*T.named(T.rotation(F.col("a"), F.col("b"), F.col("c")), "r")).toPandas().to_numpy().reshape(-1, 3, 3)
    assert np.allclose(got, a)


def test_bond_matrices_turn_tensors():
    rng = np.random.default_rng(1)
    a = K.rotations(rng.random((5, 3)) * 6)
    v = rng.random((5, 6))
    assert np.allclose(np.einsum("nij,nj->ni", K.stress_bond(a), v), K.to_voigt(a @ K.to_tensor(v) @ a.transpose(0, 2, 1)))
    assert np.allclose(np.einsum("nij,nj->ni", K.strain_bond(a), v), K.to_voigt(a @ K.to_tensor(v, 2.0) @ a.transpose(0, 2, 1), 2.0))
    assert np.allclose(K.strain_bond(a), np.linalg.inv(K.stress_bond(a)).transpose(0, 2, 1))


def test_estimates_are_ordered_and_exact_for_one_crystal(spark):
    rng = np.random.default_rng(2)
    rows = [(i, 0, 1 + i % 3, *map(float, rng.random(3) * 3)) for i in range(60)]
    got = {r["method"]: np.array(r["stiffness"]).reshape(6, 6) for r in homogenize.property_estimates(points(spark, rows), S.phases(spark)).collect()}
    for low, high in (("reuss", "hill"), ("hill", "voigt"), ("reuss", "geometric"), ("geometric", "voigt")):
        assert np.linalg.eigvalsh(got[high] - got[low]).min() > -1e-9
    one = {r["method"]: r for r in homogenize.property_estimates(points(spark, [(0, 0, 2, 0.0, 0.0, 0.0)]), S.phases(spark)).collect()}
    for r in one.values():
        assert np.allclose(np.array(r["stiffness"]), S.phase_rows()[1][3], atol=1e-9)
    for m in ("voigt", "reuss", "hill"):
        assert np.allclose(one[m]["alpha"], S.phase_rows()[1][4])


def test_trace_and_empty_map(spark):
    p = points(spark, [(0, 0, 1, 0.3, 0.4, 0.5)])
    r = homogenize.rotated_conductivity(p, S.phases(spark)).first()
    k = S.phase_rows()[0][5]
    assert r["k11"] + r["k22"] + r["k33"] == pytest.approx(k[0] + k[4] + k[8])
    assert homogenize.conductivity_estimates(p.limit(0), S.phases(spark), ("phase",)).count() == 0


def test_waves_of_an_isotropic_solid(spark):
    c = np.array(isotropic(200e9, 0.3))
    df = spark.createDataFrame([("a", c.tolist(), 8000.0), ("b", c.tolist(), 0.0), ("c", None, 1.0)], "m string, stiffness array<double>, density double")
    got = waves.wave_speeds(df, "m", 8).toPandas()
    assert len(got) == 5 * 9 and set(got["m"]) == {"a"}
    assert np.allclose(got["vp"], np.sqrt(c[0] / 8000)) and np.allclose(got["vs1"], np.sqrt(c[35] / 8000))


def cells(spark, kappa, side=4):
    nodes, elements = mesh.grid_mesh(spark, 0.0, float(side), 0.0, float(side), side, side)
    wide, six = mesh.quadratic(elements, nodes)
    material = spark.range(2 * side * side).select(F.col("id").alias("elem_id"), kappa)
    return fem.place_elements(six, wide, mesh.periodic_pairs(wide), material).withColumn("map_id", F.lit("m"))


def test_uniform_cell_changes_nothing(spark):
    k = [2.0, 0.1, 0.0, 0.1, 3.0, 0.0, 0.0, 0.0, 4.0]
    local = fem.solve_conduction(cells(spark, F.array(*map(F.lit, k)).alias("kappa")))
    assert np.allclose(fem.effective_conductivity(local).first()["kappa"], k)
    q = fem.heat_flux(local, (1.0, 2.0, 0.0)).toPandas()
    assert np.allclose(q["q1"], 1) and np.allclose(q["q2"], 2)


def test_laminate(spark):
    """Layers along axis 1: arithmetic mean along them, harmonic across."""
    row = F.floor(F.col("id") / 8) % 2
    k = F.when(row == 0, F.array(*map(F.lit, [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0]))).otherwise(F.array(*map(F.lit, [4.0, 0, 0, 0, 4.0, 0, 0, 0, 4.0]))).cast("array<double>").alias("kappa")
    local = fem.solve_conduction(cells(spark, k))
    got = np.array(fem.effective_conductivity(local).first()["kappa"]).reshape(3, 3)
    assert np.allclose(np.diag(got), [2.5, 1.6, 2.5])
    q = fem.heat_flux(local, (0.0, 1.0, 0.0)).toPandas()
    assert np.average(q["q2"], weights=q["weight"]) == pytest.approx(1.0)


def test_thermoelastic_cell(spark):
    nodes = cells(spark, F.lit(1).alias("one")).drop("one")
    c = np.array(isotropic(100.0, 0.25)).tolist()
    both = nodes.withColumn("stiffness", F.array(*map(F.lit, c))).withColumn("alpha", F.array(*map(F.lit, [1.0, 1.0, 1.0, 0.0, 0.0, 0.0])))
    local = fem.solve_thermoelastic(both)
    eff = fem.effective_thermoelastic(local).first()
    assert np.allclose(eff["stiffness"], c) and np.allclose(eff["alpha"], [1, 1, 1, 0, 0, 0])
    field = fem.stress_strain(local, (5.0, 0, 0, 0, 0, 0), 2.0).toPandas()
    assert np.allclose(field["s11"], 5) and np.allclose(field["e11"], 5 / 100 + 2) and np.allclose(field["me11"], 5 / 100)


def test_hexagonal_mesh_covers_its_rectangle(spark):
    nodes, elements = mesh.hexagonal_grid(spark, 0.0, 5.0, 0.0, 4.0, 150)
    q = mesh.quality(mesh.corners(elements, nodes)).toPandas()
    assert q["area"].sum() == pytest.approx(20) and q["area"].min() > 0 and q["quality"].median() > 0.9
    assert set(mesh.edges(elements).groupBy("elements").count().toPandas()["elements"]) == {1, 2}


def test_compact_closes_gaps(spark):
    nodes, elements = mesh.grid_mesh(spark, 0.0, 1.0, 0.0, 1.0, 2, 2)
    wide, six = mesh.quadratic(elements, nodes)
    e, n = mesh.compact(six, wide, [f"n{i}" for i in range(1, 7)])
    assert sorted(r["node_id"] for r in n.collect()) == list(range(25)) and e.count() == 8


def test_worst_mean_is_exact(spark):
    rng = np.random.default_rng(3)
    v = rng.random(1000) ** 3
    df = spark.createDataFrame([(float(x),) for x in v], "quality double")
    for share in (0.0001, 0.05, 0.5, 1.0):
        n = max(1, int(np.ceil(share * 1000)))
        assert mesh.worst_mean(df, share=share).first()["mean"] == pytest.approx(np.sort(v)[:n].mean())
    assert mesh.worst_mean(df.limit(0)).count() == 0
    assert mesh.worst_mean(spark.createDataFrame([(0.5,)] * 3, "quality double")).first()["mean"] == 0.5


def test_cells_of_pixels_need_few_rounds_and_are_solved_once(spark):
    """The inverse of a uniform cell leaves a few rounds; fields and means that a task makes itself equal those from the localised tensors."""
    from grainflow.plans import queries as core

    points = S.event_map(spark, "/root/testdata/sf0.001").where("x < 12 and y < 9")
    cells = fem.pixel_cells(fem.tiles(points, 6, 12, 9).join(S.phases(spark), "phase"), ("stiffness", "alpha", "kappa"), core.F.col("y") * 12 + core.F.col("x")).cache()
    one = cells.where("map_id = '0:0'").toPandas()
    xy, dofs, kappa = (np.array(one[c].tolist()) for c in ("xy", "dofs", "kappa"))
    xy, kappa = xy.reshape(-1, 3, 2), kappa.reshape(-1, 3, 3)
    assert fem.pixel_shape(dofs, xy) == (6, 5) and fem.pixel_shape(dofs[1:], xy[1:]) is None and fem.pixel_shape(dofs[::-1], xy) is None
    area, g = fem.gradients(xy)
    stiff = np.einsum("eq,eqni,eij,eqmj->enm", fem.WEIGHTS * area[:, None], g, kappa, g)
    right = np.random.default_rng(1).normal(size=(dofs.max() + 1, 2))
    right -= right.mean(0)
    x = fem.conjugate_gradients(stiff, dofs, right, np.full(2, 1e-8), most=30, near=fem.uniform_inverse(stiff, dofs, xy, 1, (6, 5)))
    y = np.zeros_like(right)
    np.add.at(y, dofs, stiff @ x[dofs])
    assert np.abs(y - right).max() < 1e-7
    for made, plain in (
        (fem.cell_conductivity(cells), fem.effective_conductivity(fem.solve_conduction(cells))),
        (fem.cell_heat_flux(cells, (1.0, 0.5, 0.0)), fem.heat_flux(fem.solve_conduction(cells), (1.0, 0.5, 0.0))),
        (fem.cell_thermoelastic(cells), fem.effective_thermoelastic(fem.solve_thermoelastic(cells))),
        (fem.cell_stress_strain(cells, (1.0, 0, 0, 0, 0, 0.5), 2.0), fem.stress_strain(fem.solve_thermoelastic(cells), (1.0, 0, 0, 0, 0, 0.5), 2.0)),
    ):
        assert made.dtypes == plain.dtypes
        keys = [c for c in ("map_id", "elem_id", "qp") if c in made.columns]
        a, b = (df.toPandas().sort_values(keys, ignore_index=True) for df in (made, plain))
        assert len(a) == len(b) and all(np.allclose(np.array(a[c].tolist(), float), np.array(b[c].tolist(), float), rtol=1e-7, atol=1e-7) for c in made.columns if c != "map_id")


def test_matrices_of_small_maps_are_summed_in_their_tasks(spark, monkeypatch):
    from grainflow.plans import queries as core

    points = S.event_map(spark, "/root/testdata/sf0.001").where("x < 5 and y < 4")
    cells = fem.pixel_cells(fem.tiles(points, 3, 5, 4).join(S.phases(spark), "phase"), ("stiffness", "alpha", "kappa"), core.F.col("y") * 5 + core.F.col("x"))
    near = [df.toPandas() for df in fem.assembled(cells, "thermoelastic")]
    assert "FlatMapGroupsInArrow" in fem.assembled(cells)[0]._jdf.queryExecution().toString()
    monkeypatch.setattr(fem, "ASSEMBLED", 9)
    far = [df.toPandas() for df in fem.assembled(cells, "thermoelastic")]
    for a, b in zip(near, far, strict=True):
        key = list(a.columns[:3])
        a, b = (df.sort_values(key, ignore_index=True) for df in (a, b))
        assert a[key].equals(b[key]) and np.allclose(a["value"], b["value"], atol=1e-9)

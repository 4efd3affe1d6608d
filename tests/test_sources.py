import pytest

from grainflow.operators import clean, geometry, grains, mesh, spatial
from grainflow.plans.config import JobConfig
from grainflow.sources import maps, properties, sinks


def test_maps(spark, tmp_path):
    (tmp_path / "a.ang").write_text("# head\n\n1.0\t0.5\t0.2\t0\t0\t2\n1.0 0.5 0.2 2 0 2\n0.1 0.2 0.3 0 2 1\nnot a line\n")
    got = maps.read_ang(spark, str(tmp_path / "a.ang"))
    assert sorted((r["x"], r["y"], r["phase"], r["phi1"]) for r in got.collect()) == [(0.0, 0.0, 2, 1.0), (0.0, 2.0, 1, 0.1), (2.0, 0.0, 2, 1.0)]
    assert sorted((r["x"], r["y"]) for r in clean.unit_grid(got, ("map_id",)).collect()) == [(0, 0), (0, 1), (1, 1)]
    (tmp_path / "b.txt").write_text("0 0 0 0 0 0\n0 0 0 0 1 1\n")
    assert sorted((r["y"], r["phase"]) for r in maps.read_plain(spark, str(tmp_path / "b.txt")).collect()) == [(0.0, 2), (1.0, 1)]
    (tmp_path / "c.ctf").write_text("Phase X Y Bands Error Euler1 Euler2 Euler3\n1 0 0 8 0 180 90 0 0.5 1 1\n0 1 0 0 3 0 0 0 0 0 0\n")
    assert [(r["phase"], round(r["phi1"], 6)) for r in maps.read_ctf(spark, str(tmp_path / "c.ctf")).collect()] == [(1, 3.141593)]


def test_parts_of_a_table_are_one_map(spark, tmp_path):
    lines = spark.createDataFrame([(f"0 0 0 {x} {y} {y}",) for y in range(4) for x in range(3)], "value string")
    lines.repartitionByRange(4, "value").write.text(str(tmp_path / "map.txt"))
    assert len(list((tmp_path / "map.txt").glob("part-*"))) > 1
    got = maps.read_plain(spark, str(tmp_path / "map.txt"))
    assert {r["map_id"] for r in got.collect()} == {"map.txt"}
    assert sorted((r["x"], r["y"], r["phase"]) for r in got.collect()) == sorted((float(x), 3.0 - y, y + 1) for y in range(4) for x in range(3))


def test_properties(spark, tmp_path):
    rows = "\n".join(" ".join(str(float(i == j) * 5) for j in range(6)) for i in range(6))
    (tmp_path / "iron.txt").write_text(f"# *density 3\n*Phase\nIron  alpha\n*DENSITY\n# source: [1]\n7.8e3\n*stiffness_matrix\n{rows}\n")
    (tmp_path / "bare.txt").write_text("*phase\n\n*thermal_expansion 1 2 3 4 5 6\n*thermal_conductivity # W\n1\n0 2\n0 0 3\n")
    (tmp_path / "bad.txt").write_text("*density 1 2\n")
    a, b = properties.read_properties(spark, [str(tmp_path / "iron.txt"), str(tmp_path / "bare.txt")]).orderBy("phase").collect()
    assert (a["name"], a["density"], a["stiffness"][7], a["alpha"]) == ("Iron alpha", 7800.0, 5.0, [0.0] * 6)
    assert (b["name"], b["density"], b["kappa"], b["alpha"]) == ("bare", 1.0, [1.0, 0, 0, 0, 2.0, 0, 0, 0, 3.0], [1.0, 2, 3, 4, 5, 6])
    assert a["kappa"] == [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0]
    assert properties.asymmetric(properties.read_properties(spark, [str(tmp_path / "iron.txt")])).count() == 0
    with pytest.raises(Exception, match="needs 1 numbers"):
        properties.read_properties(spark, [str(tmp_path / "bad.txt")]).collect()


def test_mesh_store(spark, tmp_path):
    nodes = spark.range(3).toDF("node_id")
    sinks.save_mesh(str(tmp_path / "m"), {"nodes": nodes}, {"sum": "1"})
    assert sinks.load_mesh(spark, str(tmp_path / "m"), ["nodes"], {"sum": "1"})["nodes"].count() == 3
    assert sinks.load_mesh(spark, str(tmp_path / "m"), ["nodes"], {"sum": "2"}) is None
    assert sinks.load_mesh(spark, str(tmp_path / "none"), ["nodes"], {}) is None


def test_config_names_every_problem():
    assert JobConfig("a", ("p",)).validate()
    with pytest.raises(ValueError, match="map_path.*phase_paths.*wave_grid"):
        JobConfig("", (), wave_grid=3).validate()


def test_image_and_strays(spark):
    pixels = spark.createDataFrame([(0, 0, "r"), (0, 1, "b"), (1, 0, "b"), (1, 1, "r")], "row int, col int, colour string")
    got = {(r["x"], r["y"]): r["phase"] for r in maps.from_colours(pixels).collect()}
    assert len(got) == 9 and got[0, 0] == got[2, 2] == got[2, 0] == 1 and got[1, 0] == 2
    rows = [(5 * y + x, x, y, 2 if (x, y) in ((2, 2), (3, 3)) else 1) for x in range(5) for y in range(5)]
    points = spark.createDataFrame(rows, "point_id long, x long, y long, phase int")
    assert {r["phase"] for r in clean.remove_strays(points, ["phase"]).where("x = 2 and y = 2").collect()} == {1}


def test_too_many_phases(spark):
    with pytest.raises(Exception, match="more than 8 phases"):
        clean.renumber_phases(spark.range(9).toDF("phase")).collect()


def test_nearest_beyond_the_first_bucket(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0), (3, 100.0, 0.0)], "point_id long, x double, y double")
    asked = spark.createDataFrame([(1, 70.0, 0.0), (2, -500.0, 3.0)], "query_id long, x double, y double")
    got = sorted((r["query_id"], r["rank"], r["point_id"]) for r in spatial.nearest(asked, points, 2).collect())
    assert got == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 2)]
    assert spatial.nearest(asked, points.limit(0)).count() == 0


def test_long_chain_is_one_component(spark):
    from grainflow.operators.components import connected_components

    chain = spark.range(1, 200).select(F_col("id").alias("a"), (F_col("id") - 1).alias("b"))
    assert {r["component"] for r in connected_components(chain).collect()} == {0}


def F_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_rings(spark):
    square = spark.createDataFrame([("a", i, float(x), float(y)) for i, (x, y) in enumerate(((0, 0), (0, 2), (2, 2), (2, 0)))], "ring string, seq long, x double, y double")
    assert geometry.areas(square, "ring").first()["ccw"] is False
    assert geometry.areas(geometry.counter_clockwise(square, "ring"), "ring").first()["ccw"] is True
    got = sorted((r["seq"], r["x"], r["y"]) for r in geometry.resample(square, "ring", 8, closed=True).collect())
    assert [g[1:] for g in got] == [(0, 0), (0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (2, 0), (1, 0)]
    line = geometry.resample(square, "ring", 4)
    assert sorted((r["seq"], r["x"], r["y"]) for r in line.collect())[-1] == (3, 2.0, 0.0)
    assert grains.STEPS[0] == (1, 0)


def test_mat_files(spark, tmp_path):
    """Types, both byte orders, compression, several arrays, files of other kinds and files that end early."""
    import struct

    import numpy as np

    from grainflow.sources import mat

    given = {"a": np.arange(6, dtype=np.float64).reshape(2, 3), "b": np.array([[-5], [300]], np.int16), "c": np.array([[2**40]], np.int64), "d": np.array([[1, 0]], np.uint8), "e": np.zeros((0, 3)), "f": np.array([[1.5]], np.float32)}
    for compress in (False, True):
        back = dict(mat.arrays(mat.to_bytes(given, compress)))
        assert list(back) == list(given) and all((back[k] == v).all() and back[k].shape == v.shape for k, v in given.items())
    whole = mat.to_bytes(given)
    for cut in range(0, len(whole), 7):
        names = [k for k, _ in mat.arrays(whole[:cut])]
        assert names == list(given)[: len(names)]
    # Big-endian, with the small elements that other writers use for names and single values.
    big = b"x".ljust(124) + struct.pack(">H", 0x0100) + b"MI"
    body = struct.pack(">II", 6, 8) + struct.pack(">II", 6, 0) + struct.pack(">II", 5, 8) + struct.pack(">ii", 1, 1) + struct.pack(">HH", 1, 1) + b"k\0\0\0" + struct.pack(">HH", 2, 3) + struct.pack(">h", -7) + b"\0\0"
    assert [(k, v.tolist()) for k, v in mat.arrays(big + struct.pack(">II", 14, len(body)) + body)] == [("k", [[-7]])]
    (tmp_path / "one.mat").write_bytes(mat.to_bytes({"x": np.array([[1.0], [2.0]]), "y": np.array([[5.0]])}, True))
    (tmp_path / "two.mat").write_bytes(b"not a file of this kind" * 20)
    (tmp_path / "three.txt").write_bytes(whole)
    cells = mat.read_mat(spark, str(tmp_path))
    assert sorted((r["name"], r["row"], r["col"], r["value"]) for r in cells.collect()) == [("x", 0, 0, 1.0), ("x", 1, 0, 2.0), ("y", 0, 0, 5.0)]
    assert sorted((r["row"], r["x"], r["y"]) for r in mat.points(cells, ("x", "y")).collect()) == [(0, 1.0, 5.0), (1, 2.0, None)]


def test_images(spark, tmp_path):
    import numpy as np

    from grainflow.plans.source_queries import _png
    from grainflow.sources import maps

    rng = np.random.default_rng(0)
    pixels = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    (tmp_path / "a.png").write_bytes(_png(pixels))
    (tmp_path / "broken.png").write_bytes(_png(pixels)[:40])
    got = {(r["row"], r["col"]): r["colour"] for r in maps.read_images(spark, str(tmp_path)).collect()}
    assert got == {(i, j): bytes(pixels[i, j][::-1]).hex().upper() for i in range(5) for j in range(7)}


def test_nearest_sends_each_query_once(spark, monkeypatch):
    """In tiles, and for crowded ones by the join: against brute force, with ties, far queries and its own point left out."""
    import random

    from pyspark.sql.functions import col

    draw = random.Random(3)
    rows = [(i, draw.randrange(-80, 280) / 2, draw.randrange(40) / 2) for i in range(900)] + [(900, 400.0, -300.0)]
    points = spark.createDataFrame(rows, "point_id long, x double, y double")
    asked = points.withColumnRenamed("point_id", "query_id")
    for crowd in (500_000, 60):
        monkeypatch.setattr(spatial, "CROWD", crowd)
        for k, own in ((1, False), (3, True)):
            want = set()
            for q, x, y in rows:
                best = sorted(((x - u) ** 2 + (y - v) ** 2, i) for i, u, v in rows if not own or i != q)[:k]
                want |= {(q, r + 1, i, d) for r, (d, i) in enumerate(best)}
            got = [tuple(r) for r in spatial.nearest(asked, points, k, 1.0, own).collect()]
            assert len(got) == len(want) and set(got) == want
    monkeypatch.setattr(spatial, "CROWD", 500_000)
    shapes = []
    group = type(asked).groupBy
    monkeypatch.setattr(type(asked), "groupBy", lambda df, *by: (shapes.append((by, df)), group(df, *by))[1])
    spatial.nearest(asked, points.where(col("point_id") < 900))
    monkeypatch.undo()
    sent = [df for by, df in shapes if by == ("u", "v") and "query_id" in df.columns]
    assert sent and all(df.count() == len(rows) for df in sent)  # nine copies of each before


def test_points_of_elements_are_found_once(spark, monkeypatch):
    """Elements that all hold points look for no nearest one, and large triangles stand in few buckets."""
    from grainflow.operators import elements

    points = spark.createDataFrame([(40 * y + x, x + 0.5, y + 0.25) for x in range(40) for y in range(40)], "point_id long, x double, y double")
    cells, real = [], spatial.points_in_triangles
    monkeypatch.setattr(spatial, "points_in_triangles", lambda p, t, cell: (cells.append(cell), real(p, t, cell))[1])
    monkeypatch.setattr(spatial, "nearest", None)
    got = elements.points_of_elements(points, mesh.grid_corners(spark, 0.0, 40.0, 0.0, 40.0, 4, 4), mesh.grid_mesh(spark, 0.0, 40.0, 0.0, 40.0, 4, 4)[0])
    want = {((y // 10 * 4 + x // 10) * 2 + int(y % 10 + 0.25 > x % 10 + 0.5), 40 * y + x) for x in range(40) for y in range(40)}
    assert {(r["elem_id"], r["point_id"]) for r in got.collect()} == want and got.count() == 1600
    assert cells == [20.0]


def test_corners_in_closed_form(spark):
    """Bit for bit those that the joins give."""
    read = lambda df: sorted(map(tuple, df.collect()))
    box = (0.1, 7.3, -1.0, 2.2, 5, 3)
    nodes, flat = mesh.grid_mesh(spark, *box)
    assert read(mesh.grid_corners(spark, *box)) == read(mesh.corners(flat, nodes))
    points = spark.createDataFrame([(x, y, x * y) for x in range(5) for y in range(4)], "x long, y long, phase long")
    nodes, flat = mesh.pixel_mesh(points, 5, 0.75, 0.8)
    assert read(mesh.pixel_corners(points, 5, 0.75, 0.8)) == read(mesh.corners(flat, nodes))
    assert all(r["phase"] == r["elem_id"] // 2 % 5 * (r["elem_id"] // 10) for r in mesh.pixel_corners(points, 5, keep=("phase",)).collect())


def test_matrix_with_its_nodes_is_summed_without_joins(spark):
    """Slaves are replaced on elements; then sums are the only shuffle, and equal those of the matrix alone."""
    from grainflow.operators import fem

    box = (0.0, 4.0, 0.0, 3.0, 4, 3)
    nodes, placed = mesh.grid_mesh(spark, *box)[0], mesh.grid_corners(spark, *box).selectExpr("*", "2D + elem_id % 2 AS k11", "0.25D AS k12", "3D AS k22")
    pairs = mesh.periodic_pairs(nodes)
    own = fem.assemble(fem.conduction_matrix(fem.with_masters(placed, pairs), ("n1", "n2", "n3")), placed)
    assert own._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 1
    assert own.count() == 7 * 12
    read = lambda df: {(r["row"], r["col"]): pytest.approx(r["value"]) for r in df.collect()}
    assert read(own) == read(fem.assemble(fem.conduction_matrix(placed), placed, pairs))
    assert all(r["t"] == pytest.approx(0) for r in own.groupBy("row").sum("value").toDF("row", "t").collect())


def test_small_grains_are_solved_together(spark, monkeypatch):
    """As grain by grain before: repeated places, grains of one place, without targets or places, and larger than what waits."""
    import numpy as np

    from grainflow.operators import fields

    draw = np.random.default_rng(5)
    at = [(g, float(x), float(y)) for g, n in (("a", 9), ("b", 9), (None, 4), ("c", 1), ("d", 3), ("long", 50)) for x, y in draw.random((n, 2)).round(3)]
    field = [(g, x, y, 2 * x + y, x * y) for g, x, y in at] + [("a", at[0][1], at[0][2], 7.0, 1.0)]
    asked = [(g, i, float(x), float(y)) for i, (g, (x, y)) in enumerate(zip(["a", "b", None, "c", "long", "none", "a"] * 3, draw.random((21, 2)), strict=True))]
    want = {}
    for g in {r[0] for r in asked}:
        places = {}
        for r in field:
            if r[0] == g:
                places.setdefault(r[1:3], []).append(r[3:])
        if places:
            p, f = np.array(list(places)), np.array([np.mean(v, 0) for v in places.values()])
            far = lambda a, b: np.sqrt(np.hypot(*(a[:, None] - b[None]).transpose(2, 0, 1)) + 1)
            t = [r for r in asked if r[0] == g]
            want |= {r[1]: (g, *v) for r, v in zip(t, far(np.array([r[2:] for r in t]), p) @ np.linalg.lstsq(far(p, p), f, rcond=None)[0], strict=True)}
    known, targets = spark.createDataFrame(field, "grain string, x double, y double, f double, g double"), spark.createDataFrame(asked, "grain string, target_id long, x double, y double")
    got = fields.interpolate(known, targets, "grain", ["f", "g"]).collect()
    assert len(got) == len(want) == 18 and all((r["grain"], r["f"], r["g"]) == (want[r["target_id"]][0], *map(pytest.approx, want[r["target_id"]][1:])) for r in got)
    # Well conditioned matrices need no singular values; one with two places at once does.
    calls, real = [], np.linalg.lstsq
    monkeypatch.setattr(np.linalg, "lstsq", lambda *a, **k: (calls.append(1), real(*a, **k))[1])
    p = draw.random((3, 20, 2)) * 3
    a = np.sqrt(np.hypot(*(p[:, :, None] - p[:, None]).transpose(3, 0, 1, 2)) + 1)
    fields._weights(a, draw.random((3, 20, 1)))
    assert not calls
    a[1, 0], a[1, :, 0] = a[1, 1], a[1, :, 1]
    assert np.isfinite(fields._weights(a, np.ones((3, 20, 1)))).all() and calls


def test_grains_go_on_across_batches(spark, monkeypatch):
    """Batches of three rows, and hardly any waiting."""
    from grainflow.operators import fields

    rows = [(i % 4, float(i // 4 % 5), float(i // 20), float(i)) for i in range(120)]
    field = spark.createDataFrame(rows, "grain long, x double, y double, f double")
    targets = field.selectExpr("grain", "x * 31 + y AS target_id", "x", "y")
    monkeypatch.setattr(fields, "WAITING", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {(r["grain"], r["x"], r["y"]): r["f"] for r in fields.interpolate(field, targets, "grain", ["f"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(g, x, y): pytest.approx(f) for g, x, y, f in rows}  # at its places the field is met


def test_cleanup_keeps_the_places(spark):
    """Merged, turned round, without flat elements and those of unknown nodes; the corners meet their nodes twice, and their places come along."""
    nodes = spark.createDataFrame([(5, 0.0, 0.0), (7, 1.0, 0.0), (9, 1.0, 1.0), (11, 0.0, 1.0), (20, 0.0, 0.0), (21, 1.0, 1.0), (30, 4.0, 4.0)], "node_id long, x double, y double")
    flat = spark.createDataFrame([(0, 20, 9, 7), (1, 5, 21, 11), (2, 5, 20, 7), (3, 5, 7, 99), (4, 5, 9, 21)], "elem_id long, n1 long, n2 long, n3 long")
    elements, kept = mesh.cleanup(flat, nodes, placed=True)
    assert sorted(map(tuple, elements.collect())) == [(0, 0, 1, 2, 0.0, 0.0, 1.0, 0.0, 1.0, 1.0), (1, 0, 2, 3, 0.0, 0.0, 1.0, 1.0, 0.0, 1.0)]
    assert sorted(map(tuple, kept.collect())) == [(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 1.0, 1.0), (3, 0.0, 1.0)]
    plain = mesh.cleanup(flat, nodes)[0]
    assert plain.columns == ["elem_id", "n1", "n2", "n3"]
    assert plain._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 3  # each corner by node and by element

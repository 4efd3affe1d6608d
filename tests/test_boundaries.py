import math
import random

from pyspark.sql import functions as F

from grainflow.operators import grains, polylines


def points(spark, rows):
    """The map whose phases are the letters of `rows`, the last row at the top."""
    cells = [(100 * y + x, x, y, ord(c), 0.0, 0.0, 0.0) for y, row in enumerate(reversed(rows)) for x, c in enumerate(row) if c != " "]
    df = spark.createDataFrame(cells, "point_id long, x long, y long, phase int, phi1 double, phi double, phi2 double")
    return grains.grains(df, ("phase",))


def lines_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["polyline_id"], []).append((r["seq"], (r["x"], r["y"]), r["grain_a"], r["grain_b"]))
    found = []
    for rows in out.values():
        rows.sort()
        assert [r[0] for r in rows] == list(range(len(rows))) and len({r[2:] for r in rows}) == 1
        found.append((rows[0][2], rows[0][3], [r[1] for r in rows]))
    return sorted(found, key=repr)


def test_lines_of_a_small_map(spark):
    """Two halves, and an island in the right one."""
    got = lines_of(polylines.polylines(points(spark, ["aabbbb", "aabcbb", "aabbbb"])))
    a, b, c = 0, 2, 103
    assert got == sorted(
        [
            (a, b, [(2, 0), (2, 1), (2, 2), (2, 3)]),
            (b, c, [(3, 1), (3, 2), (4, 2), (4, 1), (3, 1)]),
            (a, None, [(0, 0), (1, 0), (2, 0)]), (a, None, [(0, 0), (0, 1), (0, 2), (0, 3)]), (a, None, [(0, 3), (1, 3), (2, 3)]),
            (b, None, [(2, 0), (3, 0), (4, 0), (5, 0), (6, 0)]), (b, None, [(6, 0), (6, 1), (6, 2), (6, 3)]), (b, None, [(2, 3), (3, 3), (4, 3), (5, 3), (6, 3)]),
        ],
        key=repr,
    )


def test_crossing_corners_and_one_grain(spark):
    got = lines_of(polylines.polylines(points(spark, ["aab", "aba", "baa"])))
    assert all(len(line) <= 4 for _, _, line in got)
    assert sum(1 for _, b, _ in got if b is not None) == 6  # lines end where the two grains cross
    assert len(lines_of(polylines.polylines(points(spark, ["aa", "aa"])))) == 4  # the four sides of the map
    assert polylines.polylines(points(spark, ["aa"]).where("x > 9")).count() == 0


def test_long_lines_and_circles_take_few_rounds(spark):
    """A spiral and a comb: chains of hundreds of edges, and circles among them."""
    n = 24
    cells = [["a"] * n for _ in range(n)]
    for y in range(2, n - 2, 3):
        for x in range(2, n - 2):
            cells[y][x] = "b"
    for y in range(2, n - 3):
        cells[y][2 if y % 2 else 3] = "b"
    got = lines_of(polylines.polylines(points(spark, ["".join(r) for r in cells])))
    for _, _, line in got:
        assert all(abs(p[0] - q[0]) + abs(p[1] - q[1]) == 1 for p, q in zip(line, line[1:], strict=False))
        assert line[0] <= line[-1]
    edges = [frozenset(e) for _, _, line in got for e in zip(line, line[1:], strict=False)]
    assert len(edges) == len(set(edges))


def test_ranked_breaks_circles_at_the_least(spark):
    rng = random.Random(0)
    ids = list(range(200))
    rng.shuffle(ids)
    chains = [ids[:1], ids[1:3], ids[3:90]]
    circles = [ids[90:94], ids[94:200]]
    rows = [(a, b) for c in chains for a, b in zip(c, c[1:] + [None], strict=True)] + [(a, b) for c in circles for a, b in zip(c, c[1:] + c[:1], strict=True)]
    got = {r["at"]: (r["last"], r["left"], r["closed"]) for r in polylines.ranked(spark.createDataFrame(rows, "at long, nxt long")).collect()}
    want = {}
    for c in chains + circles:
        closed = c in circles
        if closed:
            k = c.index(min(c))
            c = c[k:] + c[:k]
        want |= {a: (c[-1], len(c) - 1 - i, closed) for i, a in enumerate(c)}
    assert got == want


def test_maps_side_by_side(spark):
    one = points(spark, ["aab", "abb", "bbb"])
    both = one.selectExpr("'p' AS map", "*").unionByName(one.selectExpr("'q' AS map", "*"))
    got = polylines.polylines(both, ("map",))
    assert lines_of(got.where("map = 'p'")) == lines_of(got.where("map = 'q'")) == lines_of(polylines.polylines(one))
    assert polylines.resampled(got, 1.0, ("map",)).select("map").distinct().count() == 2


def test_rings_turn_left_and_enclose_their_grain(spark):
    grained = points(spark, ["aaaaa", "abaca", "aacba", "aaaaa"])
    got = polylines.rings(grained)
    by = {}
    for r in got.collect():
        by.setdefault((r["grain_id"], r["ring_id"]), []).append((r["seq"], r["x"], r["y"], r["area"]))
    size = {r["grain_id"]: r["count"] for r in grained.groupBy("grain_id").count().collect()}
    total = dict.fromkeys(size, 0)
    for (grain, _), rows in by.items():
        rows.sort()
        xy = [r[1:3] for r in rows]
        assert min(xy) == xy[0] and all(abs(p[0] - q[0]) + abs(p[1] - q[1]) == 1 for p, q in zip(xy, xy[1:] + xy[:1], strict=True))
        total[grain] += rows[0][3]
        assert math.isclose(rows[0][3], sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(xy, xy[1:] + xy[:1], strict=True)) / 2)
    assert total == size


def test_size_field_in_tiles_equals_one_tile(spark):
    """Tiles of any size give the field of a single one, and sizes that reach far take more rounds."""
    from pyspark.sql import functions as F

    from grainflow.operators import geometry

    rng = random.Random(3)
    n, m = 23, 17
    cells = [("a", i, j, 50.0 + (rng.random() if (i, j) != (3, 4) else -49.0)) for i in range(n) for j in range(m)] + [("b", i, j, float(1 + (i * j) % 7)) for i in range(5) for j in range(4)]
    df = spark.createDataFrame(cells, "grid string, i int, j int, h double")
    for along in (True, False):
        rounds = []
        one, many = (sorted(map(tuple, geometry.limit_gradient(df, "grid", 0.5, 0.0, along, tile=t, rounds=rounds).collect())) for t in (100, 6))
        assert [r[:3] for r in one] == [r[:3] for r in many] and len(one) == len(cells)
        assert max(abs(p[3] - q[3]) for p, q in zip(one, many, strict=True)) < 1e-12
        assert rounds[0] <= 1 + 3 * (not along) + 30 and rounds[1] >= 3
        if along:
            seeds = [(i, j, h) for g, i, j, h in cells if g == "a"]
            ring = lambda a, b, k: min(abs(a - b), k - abs(a - b))
            want = {(i, j): min(h + 0.5 * (ring(i, p, n) + ring(j, q, m)) for p, q, h in seeds) for i, j, _ in seeds}
            assert all(abs(h - want[i, j]) < 1e-9 for g, i, j, h in one if g == "a")
    assert geometry.limit_gradient(df.where(F.lit(False)), "grid", 0.5).count() == 0


def test_colours(spark):
    """Neighbours differ, the order of priorities decides, hubs and isolated maps work, and reruns agree."""
    import hashlib

    rng = random.Random(5)
    pairs = {(a, b) for a in range(120) for b in rng.sample(range(120), 4) if a != b} | {(500, k) for k in range(120)} | {(900, 901)}
    both = sorted(pairs | {(b, a) for a, b in pairs})
    df = spark.createDataFrame(both, "grain_id long, neighbour long")
    got = {r["grain_id"]: r["colour"] for r in grains.colours(df).collect()}
    assert got == {r["grain_id"]: r["colour"] for r in grains.colours(df.repartition(5)).collect()}
    near = {}
    for a, b in both:
        near.setdefault(a, set()).add(b)
    assert set(got) == set(near) and all(got[a] != got[b] for a, b in both)
    want = {}
    for g in sorted(near, key=lambda k: (hashlib.md5(str(k).encode()).hexdigest(), k), reverse=True):
        used = {want[b] for b in near[g] if b in want}
        want[g] = next(c for c in range(len(near)) if c not in used)
    assert got == want and max(got.values()) <= max(map(len, near.values()))
    assert grains.colours(df.limit(0)).count() == 0


def test_crossings(spark):
    """Crossing, touching, overlapping and nearly touching segments, long ones among short, against exact arithmetic on all pairs."""
    from fractions import Fraction

    from grainflow.operators import spatial

    rng = random.Random(8)
    rows = [(2 * k, 2 * k + 1, *(rng.uniform(-3, 3) for _ in range(4))) for k in range(60)]
    rows += [(200, 201, 0.0, 0.0, 3.0, 3.0), (202, 203, 1.0, 1.0, 2.0, 2.0), (204, 205, 1.5, 1.5, 0.0, 3.0), (206, 207, 3.0, 3.0, 4.0, 3.0), (200, 209, 0.0, 0.0, -1.0, 2.0), (210, 211, 0.1, 0.1, 0.1, 0.1)]
    rows += [(212, 213, 0.1, 0.3 + 5, 0.7, 0.9 + 5), (214, 215, 0.4, 0.6 + 5, 0.4, 9.0), (216, 217, 0.4, 5.6 + 1e-15, 0.4, 8.0), (218, 219, -40.0, 0.5, 40.0, 0.5001), (201, 200, 3.0, 3.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "a long, b long, ax double, ay double, bx double, by double")

    def side(p, q, r):
        v = (Fraction(q[0]) - Fraction(p[0])) * (Fraction(r[1]) - Fraction(p[1])) - (Fraction(q[1]) - Fraction(p[1])) * (Fraction(r[0]) - Fraction(p[0]))
        return (v > 0) - (v < 0)

    lines = {(min(r[0], r[1]), max(r[0], r[1])): ((r[2], r[3]), (r[4], r[5])) if r[0] < r[1] else ((r[4], r[5]), (r[2], r[3])) for r in rows}
    want = set()
    for e, (p, q) in lines.items():
        for f, (r, s) in lines.items():
            boxes = all(max(min(p[k], q[k]), min(r[k], s[k])) <= min(max(p[k], q[k]), max(r[k], s[k])) for k in (0, 1))
            if e < f and not set(e) & set(f) and boxes and side(p, q, r) * side(p, q, s) <= 0 and side(r, s, p) * side(r, s, q) <= 0:
                want.add((*e, *f))
    for cell in (0.7, 3.0, 100.0):
        assert {tuple(r) for r in spatial.crossings(df, cell).collect()} == want
    assert (200, 201, 202, 203) in want and not any({200, 201} == set(w[:2]) and 209 in w for w in want)


def test_mesh_checks_find_a_planted_crossing(spark):
    from grainflow.operators import mesh

    nodes, flat = mesh.grid_mesh(spark, 0.0, 4.0, 0.0, 4.0, 4, 4)
    told = lambda n: {r["name"]: r["n"] for r in mesh.checks(flat, n).collect()}
    assert set(told(nodes).values()) == {0}
    moved = nodes.selectExpr("node_id", "IF(node_id = 12, x + 1.75, x) AS x", "y")
    assert told(moved)["crossed edges"] > 0


def test_points_meet_few_edges_of_a_long_ring(spark):
    """Twice the edges, the same pairs for each point; the distances are those to all edges."""
    from grainflow.operators import spatial

    ring = lambda n: [(7, k, (9 + math.sin(40 * math.pi * k / n)) * math.cos(2 * math.pi * k / n), (9 + math.sin(40 * math.pi * k / n)) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    rng = random.Random(2)
    pts = [(i, rng.uniform(-12, 12), rng.uniform(-12, 12)) for i in range(300)]
    points = spark.createDataFrame(pts, "point_id long, x double, y double")
    met = {}
    for n in (400, 800, 1600):
        vertices = spark.createDataFrame(ring(n), "ring long, seq long, x double, y double")
        edges = spatial.ring_edges(vertices, "ring")
        met[n] = spatial.near_edges(points, edges, "ring", 0.25).count() / len(pts)
        if n == 400:
            got = {r["point_id"]: r["distance"] for r in spatial.signed_distance(points, vertices, "ring", 0.5).collect()}
            xy = [r[2:] for r in ring(n)]
            for i, x, y in pts:
                d, inside = math.inf, False
                for (ax, ay), (bx, by) in zip(xy, xy[1:] + xy[:1], strict=True):
                    t = min(1, max(0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
                    d = min(d, math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)))
                    inside ^= (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax
                assert abs(got[i] - (-d if inside else d)) < 1e-9
    assert met[400] < 60 and met[1600] < 0.2 * 1600
    assert spatial.signed_distance(points.limit(0), vertices, "ring").count() == 0


ISLANDS = ["aaaaaaaaaa", "abbbbbbbba", "abccccdeba", "abcffcdeba", "abcffcdeba", "abccccddba", "abbbbbbbba", "aaaaaaaaaa"]


def test_holes_nesting_and_labels_of_planted_islands(spark):
    grained = points(spark, ISLANDS)
    name = {r["grain_id"]: chr(r["phase"]) for r in grained.collect()}
    at = {(r["x"], r["y"]): name[r["grain_id"]] for r in grained.collect()}
    inside = {}
    for r in polylines.hole_pixels(grained).collect():
        inside.setdefault(name[r["grain_id"]], set()).add(at[r["x"], r["y"]])
    assert inside == {"a": set("bcdef"), "b": set("cdef"), "c": {"f"}}
    assert {name[r["grain_id"]]: name[r["parent_id"]] for r in polylines.nesting(grained).collect()} == {"b": "a", "c": "b", "d": "b", "e": "b", "f": "c"}
    labels = {name[r["grain_id"]]: (r["x"], r["y"], r["clearance"]) for r in polylines.label_points(grained).collect()}
    assert all(at[x, y] == g for g, (x, y, _) in labels.items()) and labels["f"][2] == 1
    # The corners where c, d and e meet each other and b, but no corner of an island alone.
    got = {(r["x"], r["y"]) for r in polylines.hole_junctions(grained).collect()}
    assert {(6, 2), (6, 6), (7, 6)} <= got and (3, 3) not in got and (1, 1) not in got


def test_diagonal_rings_close_their_holes(spark):
    """A ring of pixels that touch at corners alone encloses its middle, as pixels of a grain hold together across corners."""
    got = polylines.hole_pixels(points(spark, ["xxxxx", "xxaxx", "xabax", "xxaxx", "xxxxx"]))
    grained = points(spark, ["xxxxx", "xxaxx", "xabax", "xxaxx", "xxxxx"])
    a = grained.where("phase = 97").first()["grain_id"]
    assert {(r["x"], r["y"]) for r in got.where(f"grain_id = {a}").collect()} == {(2, 2)}


def test_clearance_counts_erosions(spark):
    n = 9
    grained = points(spark, ["a" * n] * n)
    got = {(r["x"], r["y"]): r["clearance"] for r in polylines.clearances(grained).collect()}
    assert got == {(x, y): 1 + min(x, y, n - 1 - x, n - 1 - y) for x in range(n) for y in range(n)}
    label = polylines.label_points(grained).first()
    assert (label["x"], label["y"], label["clearance"]) == (4, 4, 5)


def test_numbers_in_order(spark):
    from grainflow.operators.ranking import numbered

    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.randrange(1000), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, k int").repartition(7)
    got = numbered(df, ["v", "k"], "n", ("g",)).collect()
    for g in "ab":
        assert [(r["v"], r["k"]) for r in sorted(got, key=lambda r: r["n"]) if r["g"] == g] == sorted((v, k) for h, v, k in rows if h == g)
        assert sorted(r["n"] for r in got if r["g"] == g) == list(range(sum(h == g for h, *_ in rows)))
    assert [r["k"] for r in sorted(numbered(df, ["k"], "n").collect(), key=lambda r: r["n"])] == list(range(500))
    assert numbered(df.limit(0), ["k"], "n").count() == 0


def test_small_grains_are_ranked_where_they_stand_and_large_ones_in_rounds(spark, monkeypatch):
    """No round is needed as long as a grain's edges fit a task; with the bound lowered to a few edges the rows stay the same."""
    grained = points(spark, ["aabbbb", "aabcba", "acbbab", "aaabbb"])
    forms = {"rings": polylines.rings, "lines": polylines.polylines, "holes": lambda g: polylines.ring_darts(g, joined=True)}
    rows = lambda f: sorted(map(tuple, f(grained).collect()), key=repr)
    rounds = polylines.ranked
    monkeypatch.setattr(polylines, "ranked", None)
    near = {n: rows(f) for n, f in forms.items()}
    monkeypatch.setattr(polylines, "ranked", rounds)
    for bound in (0, 12):
        monkeypatch.setattr(polylines, "WITHIN", bound)
        assert {n: rows(f) for n, f in forms.items()} == near
    maps = grained.withColumn("m", F.lit("one")).unionByName(grained.withColumn("m", F.lit("two")))
    monkeypatch.setattr(polylines, "WITHIN", 500_000)
    both = sorted(map(tuple, polylines.rings(maps, ("m",)).collect()), key=repr)
    assert both == sorted([(m, *r) for m in ("one", "two") for r in near["rings"]], key=repr)


def test_points_meet_the_polygons_around_them_alone(spark):
    """A row of squares: what is looked at doesn't grow with the number of squares to the right of a point."""
    from grainflow.operators import spatial

    n = 60
    square = [(k, s, 3.0 * k + 2 * a, 2.0 * b) for k in range(n) for s, (a, b) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))]
    rings = spark.createDataFrame(square, "ring long, seq int, x double, y double")
    middle = spark.createDataFrame([(k, 3.0 * k + 1, 1.0) for k in range(n)], "point_id long, x double, y double")
    found = spatial.points_in_polygons(middle, rings, "ring")
    assert sorted(map(tuple, found.collect())) == [(k, k) for k in range(n)]
    assert "square" in found._jdf.queryExecution().optimizedPlan().toString()

"""Lines, rings, colours, label points, holes and sizes of the grains of the event map, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainflow.operators import geometry, grains, mesh, polylines, spatial
from grainflow.plans import standard as S
from grainflow.plans.queries import _GRAINS, _MESH_SQL, _grained, _mesh, _r, query, rounded

#: Pixels' sides as numbered edges with their grain on the left, and the edges between two grains, the smaller one on the left.
_EDGES = f"""{_GRAINS}, each AS (SELECT grain_id AS g, x + ex AS ex, y + ey AS ey, up, ((x + sx) * 2147483648 + y + sy) * 4 + d AS dart
  FROM grained, (VALUES (0, 0, 0, 0, 0, 0), (1, 0, 1, 1, 0, 1), (0, 1, 0, 1, 1, 2), (0, 0, 1, 0, 1, 3)) s(ex, ey, up, sx, sy, d)),
shared AS (SELECT min(g) AS a, CASE WHEN count(*) = 2 THEN max(g) END AS b, arg_min(dart, g) AS at_a, arg_max(dart, g) AS at_b FROM each GROUP BY ex, ey, up HAVING count(*) = 1 OR min(g) < max(g))"""
_WAY = "[2147483648, 1, -2147483648, -1][dart % 4 + 1]"
#: Chains walked edge by edge: from their heads, and from every edge of a circle as long as no lower one comes.
_WALKS = """heads AS (SELECT dart FROM linked WHERE dart NOT IN (SELECT nxt FROM linked WHERE nxt IS NOT NULL)),
walk(first, dart, seq) AS (SELECT dart, dart, 0 FROM heads UNION ALL SELECT walk.first, l.nxt, walk.seq + 1 FROM walk JOIN linked l ON l.dart = walk.dart WHERE l.nxt IS NOT NULL),
circle(first, dart, seq) AS (SELECT dart, dart, 0 FROM linked WHERE dart NOT IN (SELECT dart FROM walk) UNION ALL SELECT circle.first, l.nxt, circle.seq + 1 FROM circle JOIN linked l ON l.dart = circle.dart WHERE l.nxt > circle.first),
chains AS (SELECT first, dart, seq FROM walk UNION ALL SELECT first, dart, seq FROM circle WHERE first IN (SELECT circle.first FROM circle JOIN linked l ON l.dart = circle.dart WHERE l.nxt = circle.first))"""
_LINES = f"""{_EDGES}, edges AS (SELECT a, b, at_a AS dart, at_a // 4 AS u, at_a // 4 + {_WAY.replace("dart", "at_a")} AS w FROM shared),
met AS (SELECT corner, count(*) AS n, bool_or(b IS NULL) AND min(k) < max(k) AS bent, min(o) AS nxt FROM (SELECT u AS corner, b, dart % 2 AS k, dart AS o FROM edges UNION ALL SELECT w, b, dart % 2, NULL FROM edges) GROUP BY corner),
linked AS (SELECT e.*, CASE WHEN m.n = 2 AND NOT m.bent THEN m.nxt END AS nxt FROM edges e JOIN met m ON m.corner = e.w), {_WALKS},
whole AS (SELECT first, max(seq) AS n, arg_max(dart, seq) AS last FROM chains GROUP BY first),
placed AS (SELECT first, seq, e.u AS corner, a, b FROM chains JOIN edges e USING (dart) UNION ALL SELECT first, n + 1, e.w, a, b FROM whole JOIN edges e ON e.dart = whole.last),
lines AS (SELECT p.first AS polyline_id, CASE WHEN (SELECT e.w FROM edges e WHERE e.dart = o.last) < p.first // 4 THEN n + 1 - p.seq ELSE p.seq END AS seq, corner // 2147483648 AS x, corner % 2147483648 AS y, a AS grain_a, b AS grain_b
  FROM placed p JOIN whole o USING (first))"""


def _lines(spark, d):
    return polylines.polylines(_grained(spark, d))


@query(f"{_LINES} SELECT * FROM lines")
def grain_polylines(spark, d):
    """Every line between two grains of the whole map, point by point."""
    return _lines(spark, d)


@query(f"""{_LINES}, kind AS (SELECT grain_id, arg_min(phase, point_id) AS phase FROM grained GROUP BY grain_id)
SELECT lines.*, p.phase AS phase_a, q.phase AS phase_b FROM lines JOIN kind p ON p.grain_id = grain_a JOIN kind q ON q.grain_id = grain_b WHERE p.phase <> q.phase""")
def phase_polylines(spark, d):
    """The lines that separate different phases."""
    grained = _grained(spark, d)
    return polylines.between_phases(polylines.polylines(grained), grained)


@query(f"""{_LINES}, steps AS (SELECT polyline_id, seq, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1, max(seq) OVER (PARTITION BY polyline_id) AS length FROM lines WINDOW w AS (PARTITION BY polyline_id ORDER BY seq)),
n AS (SELECT *, greatest(2, CAST(round(length / 2.5) AS INTEGER)) AS n FROM steps), k AS (SELECT *, unnest(range(n)) AS k FROM n WHERE x1 IS NOT NULL), t AS (SELECT *, k * length / (n - 1)::DOUBLE - seq AS t FROM k)
SELECT polyline_id, CAST(k AS INTEGER) AS seq, {_r('x + t * (x1 - x)', 'x')}, {_r('y + t * (y1 - y)', 'y')} FROM t WHERE (t >= -1e-9 AND t < 1 - 1e-9) OR (k = n - 1 AND seq = length - 1)""")
def shared_line_points(spark, d):
    """Points at equal distances along every line, the same for the grains on both sides."""
    return rounded(polylines.resampled(_lines(spark, d), 2.5))


_RINGS = f"""{_EDGES}, darts AS (SELECT a AS g, at_a AS dart FROM shared UNION ALL SELECT b, at_b FROM shared WHERE b IS NOT NULL),
turn AS (SELECT g, dart, dart // 4 + {_WAY} AS w, unnest([1, 0, 3]) AS k FROM darts),
linked AS (SELECT t.dart, arg_min(n.dart, CASE t.k WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END) AS nxt FROM turn t JOIN darts n ON n.g = t.g AND n.dart = t.w * 4 + (t.dart + t.k) % 4 GROUP BY t.dart), {_WALKS},
places AS (SELECT first, seq, g, dart // 4 // 2147483648 AS x, dart // 4 % 2147483648 AS y, (dart // 4 + {_WAY}) // 2147483648 AS x1, (dart // 4 + {_WAY}) % 2147483648 AS y1 FROM chains JOIN darts USING (dart)),
sized AS (SELECT first, sum(x * y1 - x1 * y) / 2 AS area FROM places GROUP BY first)"""


@query(f"{_RINGS} SELECT g AS grain_id, first AS ring_id, seq, x, y, area::DOUBLE AS area FROM places JOIN sized USING (first)")
def grain_rings(spark, d):
    """The corners of every grain's rings in their order, outer ones counter-clockwise, holes clockwise."""
    return polylines.rings(_grained(spark, d)).withColumn("area", F.col("area").cast("double"))


# --- the outer rings of all grains as lines ------------------------------------------------------------------------------

_OUTER = f"{_RINGS}, rings AS (SELECT first AS ring, seq, x::DOUBLE AS x, y::DOUBLE AS y FROM places JOIN sized USING (first) WHERE area > 0)"
_SEGMENTS = f"{_OUTER}, edges AS (SELECT ring, seq, x AS ax, y AS ay, coalesce(lead(x) OVER w, first_value(x) OVER w) AS bx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS b_y FROM rings WINDOW w AS (PARTITION BY ring ORDER BY seq))"


def _outer(spark, d):
    rings = polylines.rings(_grained(spark, d)).where("area > 0")
    return rings.select(F.col("ring_id").alias("ring"), "seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


@query(f"{_OUTER}, s AS (SELECT ring, seq, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS step FROM rings WINDOW w AS (PARTITION BY ring ORDER BY seq)) SELECT ring, seq, {_r('sum(step) OVER (PARTITION BY ring ORDER BY seq)', 's')} FROM s")
def arc_length(spark, d):
    return rounded(geometry.arc_length(_outer(spark, d), "ring").select("ring", "seq", "s"))


@query(f"{_SEGMENTS} SELECT ring, {_r('sum(sqrt(pow(bx - ax, 2) + pow(b_y - ay, 2)))', 'length')} FROM edges GROUP BY ring")
def polygon_length(spark, d):
    return rounded(geometry.lengths(_outer(spark, d), "ring", closed=True))


@query(f"{_SEGMENTS} SELECT ring, {_r('abs(sum(ax * b_y - bx * ay)) / 2', 'area')}, sum(ax * b_y - bx * ay) > 0 AS ccw FROM edges GROUP BY ring")
def polygon_area(spark, d):
    return rounded(geometry.areas(_outer(spark, d), "ring"))


@query(f"""{_SEGMENTS}, l AS (SELECT *, sqrt(pow(bx - ax, 2) + pow(b_y - ay, 2)) AS len FROM edges), s AS (SELECT *, sum(len) OVER (PARTITION BY ring ORDER BY seq) - len AS s0, sum(len) OVER (PARTITION BY ring) AS total FROM l)
SELECT ring, CAST(k AS INTEGER) AS seq, {_r("ax + (k * total / 20 - s0) / len * (bx - ax)", "x", 5)}, {_r("ay + (k * total / 20 - s0) / len * (b_y - ay)", "y", 5)} FROM s, range(20) t(k)
WHERE k * total / 20 >= s0 - 1e-9 AND k * total / 20 < s0 + len - 1e-9""")
def resample_polygon(spark, d):
    return rounded(geometry.resample(_outer(spark, d), "ring", 20, closed=True), 5)


@query(f"""{_OUTER}, n AS (SELECT ring, seq, coalesce(lag(x) OVER w, lead(x, 2) OVER w) - x AS xa, coalesce(lag(y) OVER w, lead(y, 2) OVER w) - y AS ya, coalesce(lead(x) OVER w, lag(x, 2) OVER w) - x AS xb, coalesce(lead(y) OVER w, lag(y, 2) OVER w) - y AS yb,
  CASE WHEN lag(seq) OVER w IS NULL THEN 1 ELSE -1 END AS sa, CASE WHEN lead(seq) OVER w IS NULL THEN -1 ELSE 1 END AS sb FROM rings WINDOW w AS (PARTITION BY ring ORDER BY seq)),
t AS (SELECT *, sa * sqrt(xa * xa + ya * ya) AS ta, sb * sqrt(xb * xb + yb * yb) AS tb FROM n),
p AS (SELECT ring, seq, (xa * tb * tb - xb * ta * ta) / (ta * tb * (tb - ta)) AS x1, (ya * tb * tb - yb * ta * ta) / (ta * tb * (tb - ta)) AS y1, 2 * (xb * ta - xa * tb) / (ta * tb * (tb - ta)) AS x2, 2 * (yb * ta - ya * tb) / (ta * tb * (tb - ta)) AS y2 FROM t)
SELECT ring, seq, {_r("(x1 * y2 - y1 * x2) / pow(x1 * x1 + y1 * y1, 1.5)", "curvature")} FROM p""")
def line_curvature(spark, d):
    return rounded(geometry.curvature(_outer(spark, d), "ring"))


@query(f"""{_OUTER}, n AS (SELECT ring, seq, x - lag(x) OVER w AS xa, y - lag(y) OVER w AS ya, lead(x) OVER w - x AS xb, lead(y) OVER w - y AS yb FROM rings WINDOW w AS (PARTITION BY ring ORDER BY seq)),
t AS (SELECT ring, seq, coalesce(xa / (xa * xa + ya * ya), 0) + coalesce(xb / (xb * xb + yb * yb), 0) AS tx, coalesce(ya / (xa * xa + ya * ya), 0) + coalesce(yb / (xb * xb + yb * yb), 0) AS ty FROM n)
SELECT ring, seq, {_r("-ty / sqrt(tx * tx + ty * ty)", "nx")}, {_r("tx / sqrt(tx * tx + ty * ty)", "ny")} FROM t""")
def line_normals(spark, d):
    return rounded(geometry.normals(_outer(spark, d), "ring"))


@query(f"""{_SEGMENTS}, c AS (SELECT ring, seq, 3 * ax AS x, 3 * ay AS y, 3 * (bx - ax) AS dx, 3 * (b_y - ay) AS dy FROM edges)
SELECT ring, seq * 1000000 + k AS seq, x + k * sign(dx) AS x, y + k * sign(dy) AS y FROM c, range(3) t(k) WHERE k < greatest(abs(dx), abs(dy))""")
def densify_ring(spark, d):
    """Three times as large, so that every side gains two points."""
    return rounded(geometry.densify(_outer(spark, d).withColumns({"x": 3 * F.col("x"), "y": 3 * F.col("y")}), "ring"))


@query(f"""{_SEGMENTS}, up AS (SELECT ring, ax, least(ay, b_y) AS low FROM edges WHERE ax = bx), p AS (SELECT point_id, x + 0.5::DOUBLE AS px, y FROM points)
SELECT point_id, ring FROM p JOIN up ON low = p.y AND ax > px GROUP BY point_id, ring HAVING count(*) % 2 = 1""")
def point_in_polygon(spark, d):
    """The outer rings that hold each pixel's centre: its own grain's and those of all grains around it."""
    middle = S.event_map(spark, d).select("point_id", (F.col("x") + 0.5).alias("x"), (F.col("y") + 0.5).alias("y"))
    return spatial.points_in_polygons(middle, _outer(spark, d), "ring", 1.0)


# --- labels, colours, holes ----------------------------------------------------------------------------------------------


@query(f"""{_GRAINS}, seeds AS (SELECT p.x, p.y FROM grained p, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) s(dx, dy) LEFT JOIN grained q ON q.x = p.x + dx AND q.y = p.y + dy GROUP BY p.x, p.y, p.grain_id HAVING bool_or(q.grain_id IS DISTINCT FROM p.grain_id)),
clear AS (SELECT p.point_id, 1 + min(abs(p.x - s.x) + abs(p.y - s.y)) AS clearance FROM grained p, seeds s GROUP BY p.point_id),
m AS (SELECT grain_id, sum(x) AS sx, sum(y) AS sy, count(*) AS n FROM grained GROUP BY grain_id)
SELECT grain_id, x, y, clearance FROM (SELECT grain_id, x, y, clearance, row_number() OVER (PARTITION BY grain_id ORDER BY -clearance, (n * x - sx) * (n * x - sx) + (n * y - sy) * (n * y - sy), point_id) AS k FROM grained JOIN clear USING (point_id) JOIN m USING (grain_id)) WHERE k = 1""")
def grain_label_points(spark, d):
    return polylines.label_points(_grained(spark, d))


_NEAR = f"{_EDGES}, near AS (SELECT DISTINCT a AS g, b AS h FROM shared WHERE b IS NOT NULL UNION SELECT DISTINCT b, a FROM shared WHERE b IS NOT NULL)"


@query(f"""{_NEAR}, higher AS (SELECT g, h FROM near WHERE md5(h::VARCHAR) > md5(g::VARCHAR)), every AS (SELECT DISTINCT g FROM near),
state(g, colour) AS (SELECT g, CASE WHEN g NOT IN (SELECT g FROM higher) THEN 0 END FROM every
  UNION ALL SELECT s.g, CASE WHEN s.colour IS NOT NULL THEN s.colour WHEN n.waits = 0 THEN list_min(list_filter(range(len(used) + 1), lambda c: NOT list_contains(used, c))) END
  FROM state s LEFT JOIN (SELECT k.g, count(*) FILTER (t.colour IS NULL) AS waits, list(t.colour) AS used FROM higher k JOIN state t ON t.g = k.h GROUP BY k.g) n ON n.g = s.g WHERE (SELECT bool_or(colour IS NULL) FROM state))
SELECT g AS grain_id, CAST(max(colour) AS INTEGER) AS colour FROM state GROUP BY g""")
def grain_colours(spark, d):
    """A colour for every grain that has neighbours, other than theirs."""
    return grains.colours(grains.adjacency(_grained(spark, d)))


_HOLES = """box AS (SELECT grain_id AS g, min(x) - 1 AS x0, max(x) + 1 AS x1, min(y) - 1 AS y0, max(y) + 1 AS y1 FROM grained GROUP BY grain_id),
outside(g, x, y) AS (SELECT g, x0, y0 FROM box UNION SELECT o.g, o.x + dx, o.y + dy FROM outside o JOIN box USING (g), (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) s(dx, dy) LEFT JOIN grained p ON p.x = o.x + dx AND p.y = o.y + dy
  WHERE o.x + dx BETWEEN x0 AND x1 AND o.y + dy BETWEEN y0 AND y1 AND p.grain_id IS DISTINCT FROM o.g),
holes AS (SELECT b.g, p.x, p.y, p.grain_id FROM box b JOIN grained p ON p.x BETWEEN x0 AND x1 AND p.y BETWEEN y0 AND y1 AND p.grain_id <> b.g LEFT JOIN outside o ON o.g = b.g AND o.x = p.x AND o.y = p.y WHERE o.g IS NULL),
sizes AS (SELECT grain_id, count(*) AS size FROM grained GROUP BY grain_id), filled AS (SELECT h.g, s.size + count(*) AS filled FROM holes h JOIN sizes s ON s.grain_id = h.g GROUP BY h.g, s.size),
nested AS (SELECT h.grain_id, arg_min(h.g, {'f': f.filled, 'g': h.g}) AS parent_id FROM (SELECT grain_id, g FROM holes JOIN sizes USING (grain_id) GROUP BY grain_id, g, size HAVING count(*) = size) h JOIN filled f ON f.g = h.g GROUP BY h.grain_id)"""


@query(f"{_GRAINS}, {_HOLES} SELECT g AS grain_id, x, y FROM holes")
def grain_hole_pixels(spark, d):
    """What fills the holes of every grain."""
    return polylines.hole_pixels(_grained(spark, d))


@query(f"{_GRAINS}, {_HOLES} SELECT grain_id, parent_id FROM nested")
def grain_nesting(spark, d):
    return polylines.nesting(_grained(spark, d))


@query(f"""{_RINGS}, {_HOLES}, bends AS (SELECT (c.dart // 4 + {_WAY.replace('dart', 'c.dart')}) AS corner, (l.nxt % 4 - c.dart % 4 + 4) % 4 AS turn FROM chains c JOIN sized z USING (first) JOIN darts k ON k.dart = c.dart JOIN nested n ON n.grain_id = k.g JOIN linked l ON l.dart = c.dart WHERE z.area > 0)
SELECT corner // 2147483648 AS x, corner % 2147483648 AS y FROM bends GROUP BY corner HAVING count(*) > 1 AND sum(CASE turn WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END) <> 0""")
def hole_junction_points(spark, d):
    return polylines.hole_junctions(_grained(spark, d))


#: Nodes moved by sixteenths, so that products are exact and some edges cross, touch or overlap.
_MOVED = f"""WITH {_MESH_SQL}, moved AS (SELECT node_id, (node_id % (w + 1)) * 16 + node_id * 7 % 23 AS x, (node_id // (w + 1)) * 16 + node_id * 5 % 19 AS y FROM nodes, side),
e AS (SELECT DISTINCT least(p, q) AS a, greatest(p, q) AS b FROM (SELECT unnest([n1, n2, n1]) AS p, unnest([n2, n3, n3]) AS q FROM elements)),
s AS (SELECT a, b, p.x AS ax, p.y AS ay, q.x AS bx, q.y AS b_y, least(p.x, q.x) // 64 AS i, least(p.y, q.y) // 64 AS j FROM e JOIN moved p ON p.node_id = a JOIN moved q ON q.node_id = b),
t AS (SELECT s.*, i + di AS ni, j + dj AS nj FROM s, range(-1, 2) r(di), range(-1, 2) u(dj)),
pairs AS (SELECT s.a AS a1, s.b AS b1, t.a AS a2, t.b AS b2, sign((s.bx - s.ax) * (t.ay - s.ay) - (s.b_y - s.ay) * (t.ax - s.ax)) AS s1, sign((s.bx - s.ax) * (t.b_y - s.ay) - (s.b_y - s.ay) * (t.bx - s.ax)) AS s2,
  sign((t.bx - t.ax) * (s.ay - t.ay) - (t.b_y - t.ay) * (s.ax - t.ax)) AS s3, sign((t.bx - t.ax) * (s.b_y - t.ay) - (t.b_y - t.ay) * (s.bx - t.ax)) AS s4
  FROM s JOIN t ON t.ni = s.i AND t.nj = s.j AND (s.a < t.a OR (s.a = t.a AND s.b < t.b)) AND s.a <> t.a AND s.a <> t.b AND s.b <> t.a AND s.b <> t.b
  WHERE greatest(least(s.ax, s.bx), least(t.ax, t.bx)) <= least(greatest(s.ax, s.bx), greatest(t.ax, t.bx)) AND greatest(least(s.ay, s.b_y), least(t.ay, t.b_y)) <= least(greatest(s.ay, s.b_y), greatest(t.ay, t.b_y)))"""


@query(f"{_MOVED} SELECT a1, b1, a2, b2 FROM pairs WHERE s1 * s2 <= 0 AND s3 * s4 <= 0")
def crossed_mesh_edges(spark, d):
    """Of the map's mesh with nodes moved out of their places."""
    nodes, flat = _mesh(spark, d)
    wide, n = S.map_side(spark, d) + 1, F.col("node_id")
    moved = nodes.select("node_id", (n % wide * 16 + n * 7 % 23).cast("double").alias("x"), (F.floor(n / wide) * 16 + n * 5 % 19).cast("double").alias("y"))
    return mesh.crossed_edges(flat, moved)

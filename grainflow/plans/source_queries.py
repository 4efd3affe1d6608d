"""Readers, sinks, jobs and small operators bound to the standard tables: files are written from them first, and read back."""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainflow.functions import tensors as T
from grainflow.operators import clean, conforming, elements, fem, geometry, homogenize, mesh
from grainflow.plans import analysis
from grainflow.plans import standard as S
from grainflow.plans.config import JobConfig
from grainflow.plans.queries import _MESH_SQL, CELLS, SQL, _estimate, _mesh, _r, query, rounded
from grainflow.plans.standard import MAP_SQL, PHASES_SQL, PRESENT_SQL, ROTATION_SQL
from grainflow.session import checkpoint_folder
from grainflow.sources import maps, mat, properties, sinks


def _folder(spark, name: str) -> str:
    """A new place in the shared folder."""
    return f"{checkpoint_folder(spark)}/files-{uuid.uuid4().hex}/{name}"


def _written(lines: DataFrame, name: str) -> str:
    path = _folder(lines.sparkSession, name)
    lines.write.text(path)
    return path


def _line(*columns) -> DataFrame:
    return F.concat_ws(" ", *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns)).alias("value")


# --- maps --------------------------------------------------------------------------------------------------------------

_ANGLES_SQL = ", ".join(_r(a, a, 9) for a in ("phi1", "phi", "phi2"))


@query(f"WITH {MAP_SQL} SELECT x::DOUBLE AS x, y::DOUBLE AS y, phase, {_ANGLES_SQL} FROM points")
def read_ang_map(spark, d):
    """The whole event map as .ang text, with a comment and a line of words, read back."""
    points = S.event_map(spark, d).select(_line("phi1", "phi", "phi2", "x", "y", "phase"))
    extra = spark.createDataFrame([("# a comment 1 2 3 4 5 6",), ("x y phase",), ("",)], "value string")
    read = maps.read_ang(spark, _written(points.unionByName(extra), "map.ang"))
    return rounded(read.select("x", "y", "phase", "phi1", "phi", "phi2"), 9)


@query(f"WITH {MAP_SQL} SELECT x::DOUBLE AS x, ((SELECT max(y) FROM points) - y)::DOUBLE AS y, phase, {_ANGLES_SQL} FROM points")
def read_plain_map(spark, d):
    """Phases that count from 0 and tabs between the columns."""
    parts = [F.col(c).cast("string") for c in ("phi1", "phi", "phi2", "x", "y")] + [(F.col("phase") - 1).cast("string")]
    read = maps.read_plain(spark, _written(S.event_map(spark, d).select(F.concat_ws("\t", *parts).alias("value")), "map.txt"))
    return rounded(read.select("x", "y", "phase", "phi1", "phi", "phi2"), 9)


@query(f"WITH {MAP_SQL} SELECT x::DOUBLE AS x, y::DOUBLE AS y, phase - 1 AS phase, {_ANGLES_SQL} FROM points WHERE phase > 1")
def read_ctf_map(spark, d):
    """Angles in degrees; phase 0 isn't indexed."""
    degrees = [F.degrees(a) for a in ("phi1", "phi", "phi2")]
    lines = S.event_map(spark, d).select(_line(F.col("phase") - 1, "x", "y", F.lit(8), F.lit(0), *degrees, F.lit(0.5), F.lit(120), F.lit(255)))
    return rounded(maps.read_ctf(spark, _written(lines, "map.ctf")).select("x", "y", "phase", "phi1", "phi", "phi2"), 9)


@query(f"""WITH {MAP_SQL}, k AS (SELECT event_type, row_number() OVER (ORDER BY min(event_id)) AS phase FROM events, side WHERE event_id < w * w GROUP BY event_type),
p AS (SELECT event_id % w AS x, event_id // w AS y, k.phase, w FROM events JOIN k USING (event_type), side WHERE event_id < w * w),
q AS (SELECT x, y, phase, w FROM p UNION ALL SELECT w, y, phase, w FROM p WHERE x = 0)
SELECT x::DOUBLE AS x, y::DOUBLE AS y, CAST(phase AS INTEGER) AS phase FROM (SELECT x, y, phase FROM q UNION ALL SELECT x, w, phase FROM q WHERE y = 0)""")
def map_from_colours(spark, d):
    side = S.map_side(spark, d)
    pixels = S.table(spark, d, "events").where(F.col("event_id") < side * side).select(F.floor(F.col("event_id") / side).alias("row"), (F.col("event_id") % side).alias("col"), F.col("event_type").alias("colour"))
    return maps.from_colours(pixels).select("x", "y", "phase")


#: Rows of the map in a file of its own.
BAND = 32


@query(f"WITH {MAP_SQL} SELECT {', '.join(f'{c}::DOUBLE AS {c}' for c in ('x', 'y', 'phase'))}, {_ANGLES_SQL} FROM points")
def read_mat_map(spark, d):
    """The event map as column vectors in .mat files, a band of rows in each and every other one compressed, read back."""
    names = ("x", "y", "phase", "phi1", "phi", "phi2")

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        band = int(pdf["band"].iloc[0])
        columns = {c: pdf[[c]].to_numpy(np.int32 if c == "phase" else np.float64) for c in names}
        return pd.DataFrame({"path": [f"band-{band}.mat"], "content": [mat.to_bytes(columns, compress=band % 2 == 1)]})

    bands = S.event_map(spark, d).select(F.floor(F.col("y") / BAND).alias("band"), *names)
    files = bands.groupBy("band").applyInPandas(packed, "path string, content binary")
    return rounded(mat.points(mat.values(files), names).drop("path", "row"), 9)


def _png(pixels: np.ndarray) -> bytes:
    """An image file of pixels (row, column, red green blue)."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


@query(SQL["map_from_colours"])
def map_from_image(spark, d):
    """The event map as PNG images, a band of rows in each, decoded by Spark."""

    def drawn(pdf: pd.DataFrame) -> pd.DataFrame:
        pixels = np.zeros((pdf["y"].max() % BAND + 1, pdf["x"].max() + 1, 3), np.uint8)
        pixels[pdf["y"] % BAND, pdf["x"]] = np.stack([20 * pdf["phase"], 255 - 20 * pdf["phase"], np.full(len(pdf), 7)], 1)
        return pd.DataFrame({"band": pdf["band"].iloc[:1], "content": [_png(pixels)]})

    folder = _folder(spark, "images")
    bands = S.event_map(spark, d).select(F.floor(F.col("y") / BAND).alias("band"), "x", "y", "phase").groupBy("band").applyInPandas(drawn, "band long, content binary")
    hadoop = spark._jvm.org.apache.hadoop.fs
    for r in bands.toLocalIterator():  # files as they would lie there, one at a time
        path = hadoop.Path(f"{folder}/band-{r['band']}.png")
        out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(r["content"]))
        out.close()
    pixels = maps.read_images(spark, folder)
    band = F.regexp_extract("origin", r"band-(\d+)\.png", 1).cast("long")
    return maps.from_colours(pixels.withColumn("row", band * BAND + F.col("row"))).select("x", "y", "phase")


@query(f"WITH {MAP_SQL}, c AS (SELECT * FROM points, side WHERE x BETWEEN 2 AND w / 2 AND y BETWEEN 1 AND w - 3), e AS (SELECT min(x) AS x0, max(y) AS y1 FROM c) SELECT point_id, CAST(x - x0 AS BIGINT) AS x, CAST(y1 - y AS BIGINT) AS y FROM c, e")
def crop_offset(spark, d):
    side = S.map_side(spark, d)
    return clean.unit_grid(clean.crop(S.event_map(spark, d), 2, side / 2, 1, side - 3)).select("point_id", "x", "y")


# --- phases ------------------------------------------------------------------------------------------------------------


def _phase_files(spark, d) -> list[str]:
    """A property file for each phase of the event map, in its usual form."""
    out = []
    for r in S.phases_of_map(spark, d).orderBy("phase").collect():  # eight at most
        _, name, density, stiffness, alpha, kappa = r
        rows = lambda v, n: "\n".join(" ".join(map(repr, v[i : i + n])) for i in range(0, len(v), n))
        text = f"# made from a rule\n*Phase\n{name}\n*density\n{density}  # kg/m3\n*STIFFNESS_MATRIX\n{rows(stiffness, 6)}\n*thermal_expansion\n{rows(alpha, 6)}\n*thermal_conductivity\n{rows(kappa, 3)}\n"
        path = _folder(spark, f"{name.replace(' ', '_')}.txt")
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
        out.append(path)
    return out


@query(f"WITH {PRESENT_SQL} SELECT phase, 'phase ' || phase AS name, density, a1, a3, k12, k33, stiffness[1] AS c11, stiffness[36] AS c66 FROM phases")
def read_phase_files(spark, d):
    read = properties.read_properties(spark, _phase_files(spark, d))
    return read.select("phase", "name", "density", F.col("alpha")[0].alias("a1"), F.col("alpha")[2].alias("a3"), F.col("kappa")[1].alias("k12"), F.col("kappa")[8].alias("k33"), F.col("stiffness")[0].alias("c11"), F.col("stiffness")[35].alias("c66"))


@query(f"WITH {PRESENT_SQL} SELECT phase FROM phases WHERE phase % 2 = 1")
def asymmetric_phases(spark, d):
    bent = F.transform("stiffness", lambda v, i: F.when((i == 1) & (F.col("phase") % 2 == 1), v * 1.01).otherwise(v))
    return properties.asymmetric(S.phases_of_map(spark, d).withColumn("stiffness", bent)).select("phase")


@query(f"""WITH {MAP_SQL}, e AS (SELECT phase, avg(value) AS young, 0.1::DOUBLE + phase / 20::DOUBLE AS nu FROM points GROUP BY phase), c AS (SELECT phase, young * nu / ((1 + nu) * (1 - 2 * nu)) AS l, young / (2 * (1 + nu)) AS g FROM e)
SELECT phase, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(CASE WHEN i < 3 AND j < 3 THEN l + CASE WHEN i = j THEN 2 * g ELSE 0 END WHEN i = j THEN g ELSE 0 END, 6) + 0.0 AS value FROM c, range(6) a(i), range(6) b(j)""")
def isotropic_stiffness(spark, d):
    """Of materials whose Young's modulus is the mean value of the map's points of a phase."""
    means = S.event_map(spark, d).groupBy("phase").agg(F.avg("value").alias("young"))
    c = F.array(*properties.isotropic(F.col("young"), F.lit(0.1) + F.col("phase") / F.lit(20.0)))
    each = means.select("phase", F.posexplode(c).alias("k", "value"))
    return rounded(each.select("phase", F.floor(F.col("k") / 6).cast("int").alias("i"), (F.col("k") % 6).cast("int").alias("j"), "value"))


# --- sinks -------------------------------------------------------------------------------------------------------------


@query(f"WITH {PRESENT_SQL}, r AS (SELECT phase, i, CASE i WHEN 0 THEN [k11, k12, k13] WHEN 1 THEN [k21, k22, k23] ELSE [k31, k32, k33] END AS v FROM phases, range(3) t(i)) SELECT phase, CAST(i AS INTEGER) AS i, printf('%15.6e %15.6e %15.6e', v[1], v[2], v[3]) AS value FROM r")
def matrix_text(spark, d):
    rows = S.phases_of_map(spark, d).select("phase", F.posexplode(F.array(*(F.slice("kappa", 3 * i + 1, 3) for i in range(3)))).alias("i", "row"))
    keyed = rows.withColumn("at", F.struct("phase", "i"))
    return sinks.matrix_lines(keyed, "at").select("at.phase", "at.i", "value")


@query(" UNION ALL ".join(f"SELECT '{m}' AS method, * FROM ({_estimate(m)})" for m in ("voigt", "reuss", "hill")))
def results_by_method(spark, d):
    """The map's conductivity by every method, written as a result, method by method, and read back."""
    path = _folder(spark, "results")
    found = homogenize.conductivity_estimates(S.event_map(spark, d), S.phases(spark))
    sinks.write_results(found, path)
    back = spark.read.parquet(path).withColumn("method", F.col("method").cast("string"))
    return rounded(back.select("method", *(f"k{i}{j}" for i, j in CELLS)))


@query("SELECT s_suppkey AS node_id, s_acctbal AS x, 'same' AS store FROM supplier UNION ALL SELECT NULL, NULL, 'none'")
def mesh_store(spark, d):
    """A stored mesh is found again by what it was made from, and by nothing else."""
    path = _folder(spark, "mesh")
    nodes = S.table(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id"), F.col("s_acctbal").alias("x"))
    sinks.save_mesh(path, {"nodes": nodes}, {"map": "a", "side": "3"})
    other = sinks.load_mesh(spark, path, ["nodes"], {"map": "b", "side": "3"})
    same = sinks.load_mesh(spark, path, ["nodes"], {"map": "a", "side": "3"})["nodes"].withColumn("store", F.lit("same"))
    return same if other is not None else same.unionByName(spark.createDataFrame([(None, None, "none")], same.schema))


# --- jobs --------------------------------------------------------------------------------------------------------------


@query(f"""WITH {MAP_SQL}, {PHASES_SQL}, {", ".join(f"{n}_ AS ({e})" for n, e in (("turned", f"SELECT point_id, density, k11, k12, k13, k21, k22, k23, k31, k32, k33, {', '.join(f'{e} AS {n}' for n, e in ROTATION_SQL.items())} FROM points JOIN phases USING (phase)"),))}
SELECT count(*) AS points, {_r("avg(density)", "density")}, {", ".join(_r("avg(" + " + ".join(f"a{i}{m} * k{m}{n} * a{j}{n}" for m in (1, 2, 3) for n in (1, 2, 3)) + ")", f"k{i}{j}") for i, j in CELLS)} FROM turned_""")
def whole_job(spark, d):
    """A job from the files of the whole event map and its phases: points, density and the Voigt conductivity."""
    lines = S.event_map(spark, d).select(_line("phi1", "phi", "phi2", "x", "y", "phase"))
    config = JobConfig(map_path=_written(lines, "map.txt"), phase_paths=tuple(_phase_files(spark, d)), thermoelastic=False)
    tables = analysis.run(spark, config)
    voigt = tables["conductivity"].where("method = 'voigt'").select(*(f"k{i}{j}" for i, j in CELLS))
    return rounded(tables["summary"].select("points").join(tables["density"]).join(voigt))


# --- tensors and places ------------------------------------------------------------------------------------------------


@query(f"""WITH {MAP_SQL}, {PHASES_SQL}, turned AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in ROTATION_SQL.items())} FROM points JOIN phases USING (phase)),
r AS (SELECT point_id, {", ".join(" + ".join(f"a{i}{m} * k{m}{n} * a{j}{n}" for m in (1, 2, 3) for n in (1, 2, 3)) + f" AS r{i}{j}" for i, j in CELLS)} FROM turned)
SELECT point_id, {_r("r22", "k11")}, {_r("r11", "k22")}, {_r("r33", "k33")}, {_r("-r21", "k12")}, {_r("-r23", "k13")}, {_r("r13", "k23")} FROM r""")
def frame_rotation(spark, d):
    """The map's frame turned by 90 degrees."""
    turned = homogenize.rotated_conductivity(S.event_map(spark, d).select("point_id", "phase", "phi1", "phi", "phi2"), S.phases(spark), 90.0)
    return rounded(turned.select("point_id", "k11", "k22", "k33", "k12", "k13", "k23"))


@query(f"WITH {MAP_SQL}, p AS (SELECT point_id, 1 + x % 3 AS i, 1 + y % 3 AS j FROM points) SELECT point_id, i, j, CASE WHEN i = j THEN i ELSE 9 - i - j END AS voigt FROM p")
def voigt_numbers(spark, d):
    """Of the index pairs that the places of the map give."""
    pairs = S.event_map(spark, d).select("point_id", (1 + F.col("x") % 3).alias("i"), (1 + F.col("y") % 3).alias("j"))
    return pairs.withColumn("voigt", T.contract(F.col("i"), F.col("j")))


@query("SELECT s_suppkey, round(x * sqrt(greatest(1 - (x * x + y * y) / 4, 0)), 6) + 0.0 AS x, round(y * sqrt(greatest(1 - (x * x + y * y) / 4, 0)), 6) + 0.0 AS y, round((x * x + y * y) / 2 - 1, 6) + 0.0 AS z FROM (SELECT s_suppkey, (s_suppkey % 13 - 6)::DOUBLE / 7 AS x, (s_suppkey % 11 - 5)::DOUBLE / 6 AS y FROM supplier)")
def inverse_lambert_projection(spark, d):
    x, y = (F.col("s_suppkey") % 13 - 6).cast("double") / 7, (F.col("s_suppkey") % 11 - 5).cast("double") / 6
    return rounded(S.table(spark, d, "supplier").select("s_suppkey", *(c.alias(n) for c, n in zip(T.inverse_lambert(x, y), "xyz", strict=True))))


@query("SELECT s_suppkey, round(2 * y + 3 * x + x * y, 6) + 0.0 AS h FROM (SELECT s_suppkey, (s_suppkey % 17)::DOUBLE / 2 + 0.25 AS x, (s_suppkey % 13)::DOUBLE / 2 AS y FROM supplier)")
def size_look_up(spark, d):
    """Bilinear interpolation gives a bilinear field exactly."""
    sizes = S.event_map(spark, d).select(F.col("x").alias("j"), F.col("y").alias("i")).withColumn("h", 2.0 * F.col("i") + 3.0 * F.col("j") + F.col("i") * F.col("j"))
    places = S.table(spark, d, "supplier").select("s_suppkey", ((F.col("s_suppkey") % 17).cast("double") / 2 + 0.25).alias("x"), ((F.col("s_suppkey") % 13).cast("double") / 2).alias("y"))
    return rounded(conforming.look_up(sizes, places, "s_suppkey"))


@query("SELECT p_partkey, CAST(k AS INTEGER) AS k, round(3 + cos(t) * u - sin(t) * v, 6) + 0.0 AS x, round(4 + sin(t) * u + cos(t) * v, 6) + 0.0 AS y FROM (SELECT p_partkey, k, p_partkey * 0.3::DOUBLE AS t, [-1, 1, 1, -1][k + 1] * p_size / 2::DOUBLE AS u, [-0.5, -0.5, 0.5, 0.5][k + 1]::DOUBLE AS v FROM part, range(4) s(k))")
def turned_rectangle(spark, d):
    """A rectangle for each part, as wide as its size."""
    corners = geometry.rectangle(F.lit(3.0), F.lit(4.0), F.col("p_size").cast("double"), F.lit(1.0), F.col("p_partkey") * F.lit(0.3))
    each = S.table(spark, d, "part").select("p_partkey", F.posexplode(corners).alias("k", "c"))
    return rounded(each.select("p_partkey", "k", "c.x", "c.y"))


@query("SELECT p_partkey, round(sqrt(4 * p_size::DOUBLE * 20 / ((100 + p_partkey) * sqrt(3))), 6) + 0.0 AS spacing FROM part")
def mesh_spacing(spark, d):
    """Edge lengths for rectangles as wide as a part's size and 20 high."""
    target = 100 + F.col("p_partkey")
    return rounded(S.table(spark, d, "part").select("p_partkey", mesh.spacing(F.col("p_size").cast("double"), F.lit(20.0), target).alias("spacing")))


@query(f"WITH {_MESH_SQL} SELECT elem_id, CAST(CASE WHEN x1 + x2 + x3 > 1.5 * e.x THEN 1 ELSE 0 END + CASE WHEN y1 + y2 + y3 > 1.5 * e.y THEN 2 ELSE 0 END AS BIGINT) AS grain FROM placed, (SELECT max(x) AS x, max(y) AS y FROM nodes) e")
def elements_in_grains(spark, d):
    """The elements of a mesh over four grains, rectangles that share their sides."""
    nodes, flat = _mesh(spark, d)
    corner = lambda k, v: F.element_at(F.array(*map(F.lit, v)), (F.col(k) + 1).cast("int"))
    half = nodes.agg((F.max("x") / 2).alias("w"), (F.max("y") / 2).alias("h")).first()
    place = lambda at, step, c: (at + corner("seq", c)) * step
    squares = spark.range(16).select(F.floor(F.col("id") / 4).alias("grain"), (F.col("id") % 4).alias("seq"))
    squares = squares.withColumn("x", place(F.col("grain") % 2, half["w"], [0, 1, 1, 0])).withColumn("y", place(F.floor(F.col("grain") / 2), half["h"], [0, 0, 1, 1]))
    return elements.grain_of_elements(flat, nodes, squares, "grain", half["w"]).select("elem_id", "grain")


@query(f"""WITH {MAP_SQL}, p AS (SELECT point_id, x, y, CASE WHEN phase > 2 THEN 2 ELSE 1 END AS phase FROM points),
n AS (SELECT a.point_id, count(*) AS own FROM p a, side, (SELECT i - 2 AS dx FROM range(5) t(i)) u, (SELECT i - 2 AS dy FROM range(5) t(i)) v JOIN p b ON b.x = (a.x + dx + w) % w AND b.y = (a.y + dy + w) % w AND b.phase = a.phase GROUP BY a.point_id)
SELECT point_id, x, y, CAST(CASE WHEN own < 11 THEN 3 - phase ELSE phase END AS INTEGER) AS phase FROM p JOIN n USING (point_id)""")
def minority_points(spark, d):
    """One round of the clean-up of random maps."""
    side = S.map_side(spark, d)
    two = S.event_map(spark, d).select("point_id", "x", "y", F.when(F.col("phase") > 2, 2).otherwise(1).alias("phase"))
    return clean.majority_round(two, side, side, 11)


@query()
def clean_two_phase_map(spark, d):
    """A random map of two phases without points that few of their own kind surround."""
    from grainflow.plans import queries as core

    side = S.map_side(spark, d)
    points = core.random_two_phase_map(spark, d).withColumn("point_id", F.col("y") * side + F.col("x"))
    return clean.remove_minorities(points, side, side, 11)


@query("SELECT p_partkey, true AS fits FROM part")
def fitted_element_counts(spark, d):
    """Edge lengths of a rectangle as wide as a part's size plus 30, scaled until the number of elements is within 5 % of a target, within six rounds."""
    target = 2000 + 7 * F.col("p_partkey")
    count = mesh.rectangular_count(F.col("p_size") + 30.0, F.lit(37.0))
    return S.table(spark, d, "part").withColumn("target", target).select("p_partkey", (F.abs(mesh.fitted_spacing(count, F.col("target"), 3.0)["count"] - F.col("target")) <= 0.05 * F.col("target")).alias("fits"))


def _assembled(spark, d, kind: str):
    from grainflow.plans import queries as core

    return fem.assembled((core._cells if kind == "conduction" else core._elastic)(spark, d), kind)


@query()
def assembled_cell_matrix(spark, d):
    return _assembled(spark, d, "thermoelastic")[0]


@query()
def assembled_cell_forces(spark, d):
    return _assembled(spark, d, "thermoelastic")[1]


@query()
def assembled_conduction_forces(spark, d):
    return _assembled(spark, d, "conduction")[1]


@query(f"WITH {PRESENT_SQL} SELECT 'phase ' || phase AS method, CAST(line AS INTEGER) AS line, CASE WHEN line = 0 THEN 'method phase ' || phase WHEN line = 1 THEN 'stiffness' WHEN line = 8 THEN 'thermal expansion' WHEN line = 9 THEN printf('%12.4f %12.4f %12.4f %12.4f %12.4f %12.4f', a1, a2, a3, 0.0, 0.0, 0.0) ELSE printf('%12.4f %12.4f %12.4f %12.4f %12.4f %12.4f', stiffness[6 * line - 11], stiffness[6 * line - 10], stiffness[6 * line - 9], stiffness[6 * line - 8], stiffness[6 * line - 7], stiffness[6 * line - 6]) END AS value FROM phases, range(10) t(line)")
def summary_log(spark, d):
    return sinks.log_lines(S.phases_of_map(spark, d).withColumnRenamed("name", "method"))

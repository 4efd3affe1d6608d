"""Maps, phases and shapes made from the standard tables, so that every operator can be run and checked on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Number of test phases; their properties follow from rules (`phases`).
PHASES = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stiffness(p: int) -> list[float]:
    """A transversely isotropic stiffness in GPa, stable for every p."""
    c11, c12, c13, c33, c44 = 80.0 + 5 * p, 20.0 + p, 15.0 + p, 100.0 + 4 * p, 30.0 + 2 * p
    block = [[c11, c12, c13], [c12, c11, c13], [c13, c13, c33]]
    shear = [c44, c44, (c11 - c12) / 2]
    return [block[i][j] if i < 3 and j < 3 else shear[i - 3] * (i == j) if i >= 3 else 0.0 for i in range(6) for j in range(6)]


def phase_rows() -> list[tuple]:
    return [(p, f"phase {p}", 2500.0 + 150 * p, _stiffness(p), [8.0 + p, 8.0 + p, 14.0 - p, 0.0, 0.0, 0.0], [2.0 + 0.7 * p, 0.1 * p, 0.0, 0.1 * p, 3.0 + 0.4 * p, 0.2, 0.0, 0.2, 4.0 + 0.3 * p]) for p in range(1, PHASES + 1)]


def phases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(phase_rows(), "phase int, name string, density double, stiffness array<double>, alpha array<double>, kappa array<double>")


def phases_of_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phases that the event map holds."""
    return phases(spark).join(event_map(spark, sf_dir).select("phase").distinct(), "phase", "left_semi")


def map_side(spark: SparkSession, sf_dir: str) -> int:
    """Points along a side of the event map."""
    return int(table(spark, sf_dir, "events").count() ** 0.5)


def event_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """points(point_id, x, y, phase, phi1, phi, phi2, value): events laid out row by row on a square, the last incomplete
    row left out; the type is the phase, and a user's number stands for an orientation."""
    events = table(spark, sf_dir, "events")
    side = map_side(spark, sf_dir)
    kinds = events.select("event_type").distinct().withColumn("phase", F.row_number().over(Window.orderBy("event_type")))  # a few types
    angle = lambda step, whole: F.radians((F.col("user_id") * step % whole).cast("double"))
    return events.where(F.col("event_id") < side * side).join(F.broadcast(kinds), "event_type").select(
        F.col("event_id").alias("point_id"), (F.col("event_id") % side).alias("x"), F.floor(F.col("event_id") / side).alias("y"), F.col("phase").cast("int").alias("phase"),
        angle(37, 360).alias("phi1"), angle(53, 180).alias("phi"), angle(71, 360).alias("phi2"), "value",
    )


MAP_SQL = """
side AS (SELECT CAST(floor(sqrt(count(*))) AS BIGINT) AS w FROM events),
kinds AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) AS INTEGER) AS phase FROM (SELECT DISTINCT event_type FROM events)),
points AS (
  SELECT event_id AS point_id, event_id % w AS x, event_id // w AS y, phase, radians(CAST(user_id * 37 % 360 AS DOUBLE)) AS phi1,
    radians(CAST(user_id * 53 % 180 AS DOUBLE)) AS phi, radians(CAST(user_id * 71 % 360 AS DOUBLE)) AS phi2, value
  FROM events JOIN kinds USING (event_type), side WHERE event_id < w * w
)"""

PHASES_SQL = "phases(phase, density, a1, a2, a3, k11, k12, k13, k21, k22, k23, k31, k32, k33, stiffness) AS (VALUES " + ", ".join(f"({p}, {d}::DOUBLE, {', '.join(f'{v}::DOUBLE' for v in [*a[:3], *k])}, {[float(v) for v in c]}::DOUBLE[])" for p, _, d, c, a, k in phase_rows()) + ")"

PRESENT_SQL = f"{MAP_SQL}, every_{PHASES_SQL}, phases AS (SELECT * FROM every_phases WHERE phase IN (SELECT phase FROM points))"

ROTATION_SQL = {
    "a11": "cos(phi1) * cos(phi2) - sin(phi1) * cos(phi) * sin(phi2)", "a12": "-cos(phi1) * sin(phi2) - sin(phi1) * cos(phi) * cos(phi2)", "a13": "sin(phi1) * sin(phi)",
    "a21": "sin(phi1) * cos(phi2) + cos(phi1) * cos(phi) * sin(phi2)", "a22": "cos(phi1) * cos(phi) * cos(phi2) - sin(phi1) * sin(phi2)", "a23": "-cos(phi1) * sin(phi)",
    "a31": "sin(phi) * sin(phi2)", "a32": "sin(phi) * cos(phi2)", "a33": "cos(phi)",
}


def rotated_sql(source: str, keep: str) -> str:
    """CTE bodies `turned` (rotation) and `rotated` (r11 ... r33) over `source`, which has phase and angles."""
    turn = ", ".join(f"{e} AS {n}" for n, e in ROTATION_SQL.items())
    entry = lambda i, j: " + ".join(f"a{i}{m} * k{m}{n} * a{j}{n}" for m in (1, 2, 3) for n in (1, 2, 3))
    cells = ", ".join(f"{entry(i, j)} AS r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3))
    return f"turned AS (SELECT *, {turn} FROM {source} JOIN phases USING (phase)), rotated AS (SELECT {keep}, {cells} FROM turned)"


def inverse_sql(prefix: str) -> dict[tuple[int, int], str]:
    """Entries of the inverse of the 3 x 3 matrix with columns prefix11 ... prefix33."""
    m = lambda i, j: f"{prefix}{i}{j}"
    other = {1: (2, 3), 2: (1, 3), 3: (1, 2)}
    det = f"({m(1, 1)} * ({m(2, 2)} * {m(3, 3)} - {m(2, 3)} * {m(3, 2)}) - {m(1, 2)} * ({m(2, 1)} * {m(3, 3)} - {m(2, 3)} * {m(3, 1)}) + {m(1, 3)} * ({m(2, 1)} * {m(3, 2)} - {m(2, 2)} * {m(3, 1)}))"

    def cofactor(i: int, j: int) -> str:
        (a, b), (c, d) = other[i], other[j]
        return f"{'' if (i + j) % 2 == 0 else '-'}({m(a, c)} * {m(b, d)} - {m(a, d)} * {m(b, c)})"

    return {(i, j): f"{cofactor(j, i)} / {det}" for i in (1, 2, 3) for j in (1, 2, 3)}

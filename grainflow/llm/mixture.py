"""Mixing sources to target weights along a time-varying curriculum.

A source has a weight schedule over training time t in [0, 1]: a piecewise-linear curve given by
knots (t, weight). Its integral is the source's weight, which sets its share of all words; a
share is limited to `most` times the source's size, and the excess is shared again by weight.
A source's documents stand in a fixed pseudo-random order and are taken epoch by epoch until
the target is met. A document's place in its source's running total of words, as a fraction of
the whole, is inverted through the integral of the schedule: that is its training position.

Running totals are built in two steps, so that no source lands in one task: each source is cut
into buckets of the order, the buckets' totals are summed over the (small) bucket table, and rows are
summed within their bucket alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainflow.llm.common import WORD_PATTERN, fresh, materialise, small, table

#: Knots (t, weight) of the schedules; the integrals are 5, 2 and 1. Sources take them in turn.
CURRICULUM = (((0.0, 7.0), (1.0, 3.0)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 0.0), (0.5, 1.0), (1.0, 2.0)))
#: Rows that a bucket holds on average, over all sources.
BUCKET_ROWS = 4096


def integral(knots: tuple[tuple[float, float], ...]) -> float:
    """The area under a piecewise-linear schedule."""
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False))


def inverse(knots: tuple[tuple[float, float], ...], share: Column) -> Column:
    """The time by which `share` of the schedule's integral has passed."""
    total, passed = integral(knots), 0.0
    out = F.lit(float(knots[-1][0]))
    pieces = []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        area = (t1 - t0) * (w0 + w1) / 2
        pieces.append((passed, area, t0, w0, (w1 - w0) / (t1 - t0) if t1 > t0 else 0.0))
        passed += area
    for start, area, t0, w0, slope in reversed(pieces):
        rest = F.greatest(share * total - start, F.lit(0.0))  # of w0 * x + slope * x * x / 2
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * rest, F.lit(0.0)))
        step = F.when(rest <= 0, 0.0).otherwise(2 * rest / (F.lit(w0) + root))
        out = F.when(share * total <= start + area, t0 + step).otherwise(out)
    return out


def word_count(text: Column) -> Column:
    """Number of runs without white space (space, code points 9 to 13); null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[float], most: int) -> DataFrame:
    """(source, source_size) -> with weight, target and turn, a source's number in code point order, nulls last.

    Sources by rising ratio of limit to weight: the first few stand at their limit and the rest
    share what is left by weight, so the level follows from running sums.
    """
    w = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("turn", F.row_number().over(w) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("turn") % len(weights) + 1).cast("int")))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "turn")
    everyone = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    limit = most * F.col("source_size")
    left = (F.sum("source_size").over(everyone) - F.coalesce(F.sum(limit).over(before), F.lit(0))).cast("double")
    rest = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # Level if exactly the sources before this one stand at their limit; the first that stays below its limit is right.
    level = F.when(left * F.col("weight") / rest <= limit, left / rest)
    return ranked.withColumn("level", F.first(level, ignorenulls=True).over(everyone)).withColumn(
        "target", F.coalesce(F.least(limit.cast("double"), F.col("level") * F.col("weight")), limit.cast("double"))
    ).drop("level")


def _sized(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(row, mix): a row's columns as one struct, so that none can clash, and a struct of size, order (a hash of key and text,
    so that rows which repeat a key don't stand together), key and source."""
    order = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")))))
    parts = [word_count(F.col(text)).alias("size"), order.alias("order"), F.col(key).alias("key"), F.col(source).alias("source")]
    return docs.select(F.struct(*docs.columns).alias("row"), F.struct(*parts).alias("mix"))


def position(schedules, copy: Column) -> Column:
    """The training position of the middle of a row's copy of that number: its words before, of the target, inverted through the schedule."""
    m = lambda name: F.col(f"mix.{name}")
    share = F.least((copy * m("source_size") + m("start") + m("size") / 2) / m("target"), F.lit(1.0))
    at = F.lit(None).cast("double")
    for i, knots in enumerate(schedules):
        at = F.when(m("turn") % len(schedules) == i, inverse(knots, share)).otherwise(at)
    return at


def take(docs: DataFrame, key: str, text: str, source: str, schedules=CURRICULUM, most: int = 3, whole: bool = True) -> DataFrame:
    """(row, mix), or (mix) without `whole`: the documents and a struct of size, order, key, source,
    source_size, target, turn, start (words of the source before the row), copies and taken.

    Every row takes part; a null or empty text has size 0 and takes no words. Null sources are one source.
    A row is taken once for every whole epoch. The partial epoch takes the leading rows that fit,
    then the one row left whose size is nearest to the gap, if that brings the total nearer; so
    a source's total is near its target by far less than a document, where it has many. Rows that
    repeat a key have places of their own; rows that repeat key and text have neighbouring ones. Texts may be of any length.
    """
    weights = [integral(k) for k in schedules]
    m = lambda name: F.col(f"mix.{name}")
    thin = materialise(_sized(docs, key, text, source).select("mix"))
    total, digits = thin.count(), 2
    while 16**digits * BUCKET_ROWS < total and digits < 8:
        digits += 1  # buckets are ranges of the order
    bucket = F.substring(m("order"), 1, digits)
    per_bucket = thin.groupBy(m("source").alias("source"), bucket.alias("bucket")).agg(F.sum(m("size")).alias("words"))
    shares = targets(per_bucket.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = shares.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.withColumn("offset", F.coalesce(F.sum("words").over(running), F.lit(0)))
    plans = offsets.alias("o").join(goals.alias("g"), F.col("o.source").eqNullSafe(F.col("g.source")))
    plans = materialise(plans.select(*(F.col(c).alias(f"__{c.rpartition('.')[2]}") for c in ("o.source", "o.bucket", "offset", "source_size", "target", "turn", "epochs", "rest"))))
    inside = Window.partitionBy(m("source"), bucket).orderBy(m("order"), m("key"), m("size")).rowsBetween(Window.unboundedPreceding, -1)

    def placed(rows: DataFrame) -> DataFrame:
        before = rows.withColumn("__before", F.coalesce(F.sum(m("size")).over(inside), F.lit(0)))
        at = before.join(small(plans), m("source").eqNullSafe(F.col("__source")) & (bucket == F.col("__bucket"))).withColumn("__start", F.col("__offset") + F.col("__before"))
        return at.withColumn("__fits", (m("size") > 0) & (F.col("__start") + m("size") <= F.col("__rest")))

    # The row that fills the gap of each source.
    tried = placed(thin)
    gaps = tried.groupBy("__source").agg(F.first("__rest").alias("rest"), F.coalesce(F.sum(F.when(F.col("__fits"), m("size"))), F.lit(0)).alias("got"))
    gaps = gaps.select(F.col("__source").alias("gap_source"), (F.col("rest") - F.col("got")).alias("gap"))
    off = F.abs(m("size") - F.col("gap"))
    near = tried.where(~F.col("__fits") & (m("size") > 0)).join(small(materialise(gaps)), F.col("__source").eqNullSafe(F.col("gap_source"))).where(off < F.col("gap"))
    fill = near.groupBy("gap_source").agg(F.min(F.struct(off.alias("off"), m("order").alias("order"), m("key").alias("key"), "__start")).alias("__fill"))

    rows = placed(_sized(docs, key, text, source)) if whole else tried
    rows = rows.join(small(materialise(fill)), F.col("__source").eqNullSafe(F.col("gap_source")), "left")
    chosen = ~F.col("__fits") & (m("size") > 0) & (F.col("__start") == F.col("__fill.__start")) & (m("order") == F.col("__fill.order"))
    copies = F.when(m("size") > 0, F.col("__epochs") + (F.col("__fits") | F.coalesce(chosen, F.lit(False))).cast("long")).otherwise(0).cast("long")
    parts = [m(n).alias(n) for n in ("size", "order", "key", "source")] + [F.col(f"__{n}").alias(n) for n in ("source_size", "target", "turn", "start")]
    done = rows.withColumn("mix", F.struct(*parts, copies.alias("copies"), (copies * m("size")).alias("taken")))
    return done.select(*(["row"] if whole else []), "mix")


def mix_summary(docs: DataFrame, key: str, text: str, source: str, schedules=CURRICULUM, most: int = 3) -> DataFrame:
    """(key, size, source_size, target, taken, copies, first_position, last_position) of every row, range-sorted by the position of its
    first copy; rows that aren't taken have no position and come last, by the order."""
    taken = take(docs, key, text, source, schedules, most, whole=False)
    m = lambda name: F.col(f"mix.{name}")
    some = m("copies") > 0
    first, last = F.when(some, position(schedules, F.lit(0))), F.when(some, position(schedules, m("copies") - 1))
    rows = taken.withColumn("first_position", first).withColumn("last_position", last).orderBy(F.col("first_position").asc_nulls_last(), m("order"), m("key"))
    return rows.select(F.col("mix.key").alias(key), *(m(n).alias(n) for n in ("size", "source_size", "target", "taken", "copies")), "first_position", "last_position")


def mixture(docs: DataFrame, key: str, text: str, source: str, schedules=CURRICULUM, most: int = 3) -> DataFrame:
    """The mix itself: every taken copy of every row, with `copy` (from 0) and `position` in [0, 1], range-sorted by position.

    The two columns get other names if `docs` has them. Ties in position fall to the order, then the key, then the copy.
    """
    taken = take(docs, key, text, source, schedules, most)
    m = lambda name: F.col(f"mix.{name}")
    rows = taken.where(m("copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), m("copies") - 1)))
    ordered = rows.withColumn("position", position(schedules, F.col("copy"))).orderBy("position", m("order"), m("key"), "copy")
    names = [F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return ordered.select(*names, F.col("copy").alias(fresh("copy", docs.columns)), F.col("position").alias(fresh("position", docs.columns)))


def query(spark, sf_dir: str) -> DataFrame:
    return mix_summary(table(spark, sf_dir, "documents"), "doc_id", "text", "source")


_SHARE = "least((({copy}) * source_size + start + size / 2) / target, 1.0::DOUBLE)"


def _piece(share: str, total: float, start: float, t0: float, w0: float, slope: float) -> str:
    rest = f"greatest({share} * {total}::DOUBLE - {start}::DOUBLE, 0.0::DOUBLE)"
    return f"{t0}::DOUBLE + CASE WHEN {rest} <= 0 THEN 0.0::DOUBLE ELSE 2 * {rest} / ({w0}::DOUBLE + sqrt(greatest({w0 * w0}::DOUBLE + {2 * slope}::DOUBLE * {rest}, 0.0::DOUBLE))) END"


def _position(copy: str) -> str:
    """The three schedules, inverted by hand: 7 - 4 t, 2, and 2 t."""
    s = _SHARE.format(copy=copy)
    return f"CASE turn % 3 WHEN 0 THEN {_piece(s, 5.0, 0.0, 0.0, 7.0, -4.0)} WHEN 1 THEN {_piece(s, 2.0, 0.0, 0.0, 2.0, 0.0)} ELSE CASE WHEN {s} <= 0.25 THEN {_piece(s, 1.0, 0.0, 0.0, 0.0, 2.0)} ELSE {_piece(s, 1.0, 0.25, 0.5, 1.0, 2.0)} END END"


SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || md5(coalesce(text, ''))) AS k,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS turn FROM s
), w AS (
  SELECT *, CASE turn % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM r
), l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0) AS DOUBLE) AS rest_words,
    sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS rest_weight, row_number() OVER (ORDER BY source_size / weight, turn) AS n
  FROM w WINDOW o AS (ORDER BY source_size / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (
  SELECT source, source_size, turn, coalesce(least(CAST(3 * source_size AS DOUBLE), weight * (
    SELECT x.rest_words / x.rest_weight FROM l x WHERE x.rest_words * x.weight / x.rest_weight <= 3 * x.source_size ORDER BY n LIMIT 1)), CAST(3 * source_size AS DOUBLE)) AS target
  FROM l
), p AS (
  SELECT d.*, source_size, target, turn, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), f AS (
  SELECT *, size > 0 AND start + size <= target - epochs * source_size AS fits FROM p
), h AS (
  SELECT *, target - epochs * source_size - coalesce(sum(CASE WHEN fits THEN size END) OVER (PARTITION BY source), 0) AS gap FROM f
), c AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY NOT fits AND size > 0 AND abs(size - gap) < gap DESC, abs(size - gap), k, doc_id) AS n FROM h
)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies, CASE WHEN copies > 0 THEN """ + _position("0") + """ END AS first_position,
  CASE WHEN copies > 0 THEN """ + _position("copies - 1") + """ END AS last_position
FROM (SELECT *, CASE WHEN size > 0 THEN CAST(epochs + CAST(fits OR (n = 1 AND abs(size - gap) < gap) AS BIGINT) AS BIGINT) ELSE 0 END AS copies FROM c)
"""

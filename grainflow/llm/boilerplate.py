"""Site-relative line dedup: drop the lines that stand on too many pages of their host.

Built-in expressions only. A page sends each different line once, as a 128-bit hash, and
pages of a host with the same text count once; so copies of a page don't turn its lines
into boilerplate. Counts are added up before the shuffle. What a host drops is at most its mean number of
lines a page divided by the ratio, so the hosts' lists are short; they are broadcast if
their measured size allows it, and otherwise joined on the host and a salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainflow.llm.common import BROADCAST_BYTES, fresh, materialise, table

RATIO = 0.05
#: A line of one page alone is no repetition, whatever its share of a small host.
MIN_PAGES = 2
#: Bytes that a host and a line's hash take in the broadcast table.
HOST_BYTES, LINE_BYTES = 128, 48
SALTS = 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hash(line: Column) -> Column:
    return F.md5(F.trim(line))


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, lines): hashes of the lines on more than `ratio` of the host's pages and on `min_pages` at least."""
    keyed = pages.where(F.col(text).isNotNull()).select(F.col(host).alias("host"), F.md5(text).alias("page"), F.array_distinct(F.transform(F.filter(_lines(F.col(text)), lambda x: F.trim(x) != ""), _hash)).alias("lines"))
    unique = keyed.groupBy("host", "page").agg(F.first("lines").alias("lines"))
    totals = unique.groupBy("host").agg(F.count("*").alias("pages"))
    counts = unique.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    frequent = counts.alias("c").join(totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host"))).where(F.col("n") > ratio * F.col("pages"))
    return frequent.groupBy(F.col("c.host").alias("host")).agg(F.collect_list("line").alias("lines"))


def drop_lines(docs: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """`docs` with the boilerplate taken out of `text`, and the counts n_lines and n_dropped.

    Lines end at line feeds and are compared without the spaces around them; blank lines are neither counted
    nor dropped. Every row stays, whatever is left of its text; a null text stays null with both counts 0,
    an empty one has one line. Null hosts form one host. Repeated rows count as one page. The
    counts get other names if `docs` has such columns.
    """
    found = materialise(boilerplate(docs, host, text, ratio, min_pages))
    size = found.agg(F.coalesce(F.sum(HOST_BYTES + F.coalesce(F.octet_length(F.col("host").cast("string")), F.lit(0)) + LINE_BYTES * F.size("lines")), F.lit(0))).first()[0]
    low = found.select(F.col("host").alias("__host"), F.col("lines").alias("__lines"))
    packed = docs.select(F.struct(*docs.columns).alias("row"))  # so that no column can clash
    own_host, own_text = F.col(f"row.`{host}`"), F.col(f"row.`{text}`")
    if size <= BROADCAST_BYTES:
        joined = packed.join(F.broadcast(low), own_host.eqNullSafe(F.col("__host")), "left")
    else:
        salted = low.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        packed = packed.withColumn("__own", F.pmod(F.xxhash64(own_text), F.lit(SALTS)).cast("int"))
        joined = packed.join(salted, own_host.eqNullSafe(F.col("__host")) & (F.col("__own") == F.col("__salt")), "left")
    kept = F.filter(_lines(own_text), lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("__lines"), _hash(x)))
    done = joined.withColumn("__kept", F.when(F.col("__lines").isNotNull(), kept))
    lines = F.size(_lines(own_text))
    count = F.when(own_text.isNull(), 0).otherwise(lines).cast("long")
    dropped = F.when(F.col("__kept").isNull(), 0).otherwise(lines - F.size("__kept")).cast("long")
    cleaned = F.when(F.col("__kept").isNull(), own_text).otherwise(F.array_join("__kept", "\n"))
    columns = [cleaned.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return done.select(*columns, count.alias(fresh("n_lines", docs.columns)), dropped.alias(fresh("n_dropped", docs.columns)))


def query(spark, sf_dir: str) -> DataFrame:
    """Every document, its source standing for the host."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_lines(docs, "source", "text")


SQL = f"""
WITH d AS (
  SELECT doc_id, source, text, row_number() OVER () AS r FROM documents
), u AS (
  SELECT DISTINCT source, text FROM d WHERE text IS NOT NULL
), t AS (
  SELECT source, count(*) AS pages FROM u GROUP BY source
), c AS (
  SELECT source, line, count(*) AS n
  FROM (SELECT DISTINCT source, text, trim(unnest(string_split(text, chr(10)))) AS line FROM u) WHERE line <> '' GROUP BY source, line
), b AS (
  SELECT c.source, list(line) AS lines FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
  WHERE n >= {MIN_PAGES} AND n > {RATIO}::DOUBLE * pages GROUP BY c.source
), k AS (
  SELECT d.*, string_split(text, chr(10)) AS whole,
    list_filter(string_split(text, chr(10)), lambda x: trim(x) = '' OR lines IS NULL OR NOT list_contains(lines, trim(x))) AS kept
  FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, source, array_to_string(kept, chr(10)) AS text, CAST(coalesce(len(whole), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(whole) - len(kept), 0) AS BIGINT) AS n_dropped
FROM k
"""

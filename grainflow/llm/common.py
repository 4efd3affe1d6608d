"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ByteType, DataType, DecimalType, IntegerType, LongType, ShortType, StructType

from grainflow.session import checkpoint_folder

#: The white space that ends a word: space and code points 9 to 13.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Rows and bytes in an Arrow batch sent to a Python worker. Texts may be long, so batches are short.
ARROW_ROWS, ARROW_BYTES = 512, 16 << 20
#: Bytes of a table that is broadcast at most, see `small`.
BROADCAST_BYTES = 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of texts can hold in a Python worker.

    All operators set the same two values, so it doesn't matter which of them was built last; kernels cut
    batches further by themselves (`by_size`) and never rely on a batch's number of rows.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def materialise(df: DataFrame) -> DataFrame:
    """Compute `df` once and cut its lineage with a reliable checkpoint.

    The folder is the session's spark.checkpoint.dir, which all executors share. Where that is unset, a local
    master (as in tests) gets a temporary folder and any other an error, see `checkpoint_folder`.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def as_schema(*fields: tuple[str, DataType]) -> tuple[StructType, pa.Schema]:
    """The Spark and the Arrow schema of these columns, whatever their types are."""
    struct = StructType()
    for name, kind in fields:
        struct = struct.add(name, kind)
    return struct, to_arrow_schema(struct)


def whole_number(kind: DataType) -> bool:
    """Whether every value of this type fits a long without loss."""
    return isinstance(kind, ByteType | ShortType | IntegerType | LongType) or (isinstance(kind, DecimalType) and kind.scale == 0 and kind.precision <= 18)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A materialised `df`, to be broadcast if its rows, 64 bytes each and their values as text, take up to `limit` bytes;
    a larger one is joined by a shuffle, with the same rows."""
    size = df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))) + 64), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= limit else df


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def crc_bucket(key: str, modulus: int) -> Column:
    """crc32 of the key's decimal text modulo `modulus`; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


def fresh(name: str, taken: list[str]) -> str:
    """`name`, with underscores added until no column in `taken` has it (case is ignored)."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


def by_size(batch: pa.RecordBatch, text: str, chars: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about `chars` bytes of text; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > chars:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if batch.num_rows > start:
        yield batch.slice(start)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

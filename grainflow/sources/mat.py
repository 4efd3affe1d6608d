"""Level-5 .mat files: numeric arrays as rows, and maps made of them.

A file is a header of 128 bytes and elements with a tag of type and size; a matrix element holds its class, its size, its name and its values, column by
column; an element may be compressed as a whole. Text, cells, structures, sparse and complex parts are passed over.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: NumPy's names of the number types 1, 2, ..., the classes of numeric arrays with theirs, and the elements' types.
_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
_CLASSES = {6: "f8", 7: "f4", 8: "i1", 9: "u1", 10: "i2", 11: "u2", 12: "i4", 13: "u4", 14: "i8", 15: "u8"}
_MATRIX, _COMPRESSED = 14, 15
#: Values of an Arrow batch.
BATCH = 65_536
ROWS = "path string, name string, row long, col long, value double"


def _elements(data: memoryview, order: str) -> Iterator[tuple[int, memoryview]]:
    """(type, content) of the elements; one that the data's end cuts short ends them."""
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(order + "II", data, at)
        if kind >> 16:  # a small element: size, type and content in eight bytes
            kind, size, start, end = kind & 0xFFFF, kind >> 16, at + 4, at + 8
            if size > 4:
                return
        else:
            start = at + 8
            end = start + size + (-size % 8 if kind != _COMPRESSED else 0)
        if start + size > len(data):
            return
        yield kind, data[start : start + size]
        at = end


def arrays(content: bytes) -> Iterator[tuple[str, np.ndarray]]:
    """(name, array) of the real numeric arrays with two dimensions in a file; others, and a file of another kind, give nothing."""
    if len(content) < 128 or content[126:128] not in (b"IM", b"MI"):
        return
    order = "<" if content[126:128] == b"IM" else ">"
    for kind, body in _elements(memoryview(content)[128:], order):
        if kind == _COMPRESSED:
            try:
                inner = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
            kind, body = next(_elements(memoryview(inner), order), (0, body))
        if kind != _MATRIX:
            continue
        parts = [*_elements(body, order)]
        if len(parts) < 4 or len(parts[0][1]) < 4 or parts[0][1][0 if order == "<" else 3] not in _CLASSES or parts[3][0] not in _TYPES:
            continue
        shape = np.frombuffer(parts[1][1], order + "i4")
        values = np.frombuffer(parts[3][1], order + _TYPES[parts[3][0]])
        if len(shape) == 2 and len(values) == int(shape[0]) * int(shape[1]):
            yield bytes(parts[2][1]).decode("latin-1"), values.reshape(tuple(shape), order="F")


def to_bytes(named: dict[str, np.ndarray], compress: bool = False) -> bytes:
    """A file with these arrays of two dimensions."""

    def element(kind: int, body: bytes) -> bytes:
        return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)

    out = [b"arrays".ljust(116) + b"\0" * 8 + struct.pack("<H", 0x0100) + b"IM"]
    for name, array in named.items():
        kind = array.dtype.str[1:]
        number = next(k for k, t in _TYPES.items() if t == kind)
        cls = next(k for k, t in _CLASSES.items() if t == kind)
        parts = [(6, struct.pack("<II", cls, 0)), (5, struct.pack("<ii", *array.shape)), (1, name.encode("latin-1")), (number, array.astype("<" + kind).tobytes(order="F"))]
        whole = element(_MATRIX, b"".join(element(*p) for p in parts))
        if compress:
            packed = zlib.compress(whole)
            whole = struct.pack("<II", _COMPRESSED, len(packed)) + packed
        out.append(whole)
    return b"".join(out)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for name, array in arrays(content.as_py() or b""):
                flat = array.ravel(order="F")
                for at in range(0, len(flat), BATCH):
                    place = np.arange(at, min(at + BATCH, len(flat)))
                    n = len(place)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array([name] * n, pa.string()), pa.array(place % array.shape[0]), pa.array(place // array.shape[0]), pa.array(flat[place].astype(np.float64))], names=["path", "name", "row", "col", "value"])


def values(files: DataFrame) -> DataFrame:
    """(path, name, row, col, value) of every value of the arrays of two dimensions in files (path, content). A file is one row, and one task reads it; its
    values leave in batches. A null, broken or foreign content gives nothing. A matrix name that a file repeats repeats its rows."""
    return files.select("path", "content").mapInArrow(_rows, ROWS)


def read_mat(spark: SparkSession, path: str) -> DataFrame:
    """The values of .mat files below `path`, read by Spark, so that they may be in any store."""
    return values(spark.read.format("binaryFile").option("pathGlobFilter", "*.mat").load(path))


def points(cells: DataFrame, names: tuple[str, ...] = ("x", "y", "phase", "phi1", "phi", "phi2")) -> DataFrame:
    """(path, row, names...) of values as `values` gives them: a row of each file's column vectors with these names, null where a vector is shorter or missing."""
    wanted = cells.where(F.col("name").isin(*names) & (F.col("col") == 0))
    return wanted.groupBy("path", "row").agg(*(F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names))

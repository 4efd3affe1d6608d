"""Token counts per section of a document, by offset mapping.

A whole document is encoded once. The character span of every token follows from the byte
lengths of the tokens, as a byte-level vocabulary loses nothing. The spans are joined to the
sections' spans by interval, both being sorted, and a token that crosses a boundary is allocated by
an explicit rule:

- "first": to the section that holds its first character;
- "largest": to the section that holds most of its characters, the earlier one on a tie;
- "proportional": to each section in proportion to its characters.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import DoubleType, IntegerType, LongType

from grainflow.llm.common import as_schema, by_size, short_batches, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenisation pattern that the vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RESULT = (("section", IntegerType()), ("char_start", LongType()), ("char_end", LongType()), ("n_tokens", DoubleType()), ("n_crossing", LongType()))
# The characters with the Unicode property White_Space, the pattern's \s.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of white space of this length are cut out of the text that the pattern sees: it goes back over such a run character by character.
_LONG_RUN = re.compile(f"[{_WHITE}]{{64,}}")


@lru_cache(maxsize=2)
def _encoder(ranks: bytes):
    import tiktoken

    pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    lengths = np.zeros(max(pairs.values()) + 1, np.int64)
    for token, rank in pairs.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("sections", pat_str=PATTERN, mergeable_ranks=pairs, special_tokens={}), lengths


def encode(encoding, text: str) -> list[int]:
    """Token ids of a whole text. By the pattern, a run of white space but for its last character is a piece of its
    own, and all of it at the text's end; so long runs are encoded as such pieces and the text between them by the pattern."""
    out, at = [], 0
    for run in _LONG_RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        out += encoding.encode_ordinary(text[at : run.start()])
        out += encoding._core_bpe.encode_single_piece(run.group()[: end - run.start()].encode())
        at = end
    return out + encoding.encode_ordinary(text[at:])


def token_spans(ranks: bytes, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Character spans [start, end) of the tokens of a whole text; a token inside one character spans it.
    A lone surrogate is read as U+FFFD."""
    encoding, lengths = _encoder(ranks)
    data = text.encode("utf-8", "replace") if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace").encode("utf-8")
    sizes = lengths[np.asarray(encode(encoding, data.decode()), np.int64)]
    end = np.cumsum(sizes)
    if len(data) == len(text):
        return end - sizes, end
    char = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1
    return char[end - sizes], char[end - 1] + 1


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the lines, each with the line feed that ends it; an empty text has one empty line."""
    ends = np.cumsum([len(x) + 1 for x in text.split("\n")])
    ends[-1] -= 1
    starts = np.concatenate([[0], ends[:-1]])
    keep = (ends > starts) | (np.arange(len(ends)) == 0)
    return starts[keep].astype(np.int64), ends[keep].astype(np.int64)


def allocate(start: np.ndarray, end: np.ndarray, lows: np.ndarray, highs: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, float]:
    """(tokens, crossing tokens) of each section and the tokens outside all sections.

    Sections are sorted and don't overlap; gaps between them are allowed. A crossing token
    counts in `crossing` of every section that it touches.
    """
    tokens, crossing = np.zeros(len(lows)), np.zeros(len(lows), np.int64)
    if not len(start) or not len(lows):
        return tokens, crossing, float(len(start))
    first = np.searchsorted(highs, start, side="right")  # the first section that ends after the start
    last = np.searchsorted(lows, end, side="left") - 1  # the last one that starts before the end
    whole = (first == last) & (lows[np.minimum(first, len(lows) - 1)] <= start) & (highs[np.minimum(first, len(lows) - 1)] >= end)
    np.add.at(tokens, first[whole], 1)
    outside = 0.0
    for i in np.flatnonzero(~whole):
        touched = [j for j in range(first[i], last[i] + 1) if highs[j] > lows[j]]
        if not touched:
            outside += 1
            continue
        overlap = np.array([min(end[i], highs[j]) - max(start[i], lows[j]) for j in touched])
        crossing[touched] += 1
        if rule == "proportional":
            tokens[touched] += overlap / (end[i] - start[i])
            outside += 1 - overlap.sum() / (end[i] - start[i])
        elif rule == "largest":
            tokens[touched[int(np.argmax(overlap))]] += 1
        elif lows[touched[0]] <= start[i]:
            tokens[touched[0]] += 1
        else:
            outside += 1
    return tokens, crossing, outside


def _kernel(ranks, key: str, text: str, sections: str | None, rule: str, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, text, 4_000_000):
                yield one(part)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, section, lows, highs, tokens, crossing = [], [], [], [], [], []
        spans = batch.column(sections).to_pylist() if sections else None
        for i, t in enumerate(batch.column(text).to_pylist()):
            if t is None or (spans is not None and spans[i] is None):
                low, high = np.zeros(1, np.int64), np.zeros(1, np.int64)
                count, cross, outside = np.zeros(1), np.zeros(1, np.int64), 0.0
            else:
                low, high = line_sections(t) if spans is None else (np.array([s[k] for s in spans[i]], np.int64) for k in ("start", "end"))
                count, cross, outside = allocate(*token_spans(ranks.value, t), low, high, rule)
            number = np.arange(len(low))
            if outside > 1e-9:
                number, low, high = np.append(number, -1), np.append(low, -1), np.append(high, -1)
                count, cross = np.append(count, outside), np.append(cross, 0)
            rows.append(np.full(len(low), i))
            for out, x in zip((section, lows, highs, tokens, crossing), (number, low, high, count, cross), strict=True):
                out.append(x)
        flat = [np.concatenate(x) for x in (section, lows, highs, tokens, crossing)]
        return pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(np.concatenate(rows)))] + [pa.array(x).cast(f.type) for x, f in zip(flat, list(schema)[1:], strict=True)], schema=schema)

    return run


def count_tokens(df: DataFrame, key: str, text: str, sections: str | None = None, rule: str = "largest", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, section, char_start, char_end, n_tokens, n_crossing): a row for every section.

    `sections` names an array of structs (start, end), in characters, sorted and apart; without it, every
    line is a section with the line feed that ends it. Tokens outside all sections make a
    row with section -1. A null text or null array gives one row of section 0 with no tokens, an
    empty text likewise; repeated rows give repeated results; keys may be of any type and null; texts may be of any length and
    hold runs of any one character; other columns aren't read.
    The vocabulary file, of a fixed size, is read on the driver and broadcast.
    """
    if rule not in ("first", "largest", "proportional"):
        raise ValueError(f"unknown rule: {rule}")
    spark = df.sparkSession
    short_batches(spark)
    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    data = df.select(F.col(key).alias("key"), F.col(text).alias("text"), *([F.col(sections).alias("sections")] if sections else []))
    result, schema = as_schema(("key", data.schema["key"].dataType), *RESULT)
    return data.mapInArrow(_kernel(ranks, "key", "text", "sections" if sections else None, rule, schema), result).withColumnRenamed("key", key)


def query(spark, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("n_tokens", F.col("n_tokens").cast("long"))

"""Benchmark decontamination by the q-gram lemma and banded alignment.

A benchmark item is cut into overlapping patterns. A text region within k edits of a pattern of m characters shares
at least m + 1 - q (k + 1) of its q-grams, all on diagonals that differ by k at most. So: every q-gram of a text that some
pattern has is a hit on a diagonal; hits are counted, one for each pattern position, in
overlapping bands of diagonals; bands that reach the bound are kept, and each is verified by
a banded alignment of the pattern to the text. A band whose pattern isn't there as a whole is searched for a run of
RUN characters copied word for word: patterns overlap by so much that each such run of an item lies in one of
them, and its q-grams alone reach the bound. So every verbatim copy of RUN characters or more is found, wherever it starts; one with
edits is if it holds such a run, or a whole pattern within its edits, as every part of an item of a pattern and a stride does whose edits are spread. Texts are compared in lower case, with each white space
character as a space. The items' index is broadcast in blocks of bounded size; texts are mapped row by
row, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import IntegerType, LongType

from grainflow.llm.common import as_schema, by_size, mix64, short_batches, table

#: Characters of a pattern at most, and between the starts of two; edits allowed per character; q.
PATTERN, STRIDE, RATE, Q = 69, 9, 0.1, 8
#: Characters of a verbatim copy that are always found; patterns overlap by as many at least.
RUN = 60
#: Characters of items in one broadcast block.
BLOCK_CHARS = 4_000_000
#: Characters of a text searched at once; segments overlap by a pattern and its edits.
SEGMENT = 16_384
#: Pairs of q-grams that a task holds at once; characters of a window where there are more; q-grams of a second bound, cheaper to count.
HITS, WINDOW, Q_SHORT = 1_000_000, 512, 4
_FILTER_BITS = 20
RESULT = (("char_start", LongType()), ("char_end", LongType()), ("edits", IntegerType()), ("patterns", IntegerType()))


#: Every white space character but the space itself; all are below U+3001.
_SPACES = [chr(i) for i in range(0x3001) if chr(i).isspace() and i != 0x20]


def normalise(text: str) -> str:
    """Lower case, white space as spaces; every character keeps its place."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(x := c.lower()) != 1 else x for c in text)
    for c in _SPACES:  # each a search in C, and a copy only where it is found
        if c in low:
            low = low.replace(c, " ")
    return low


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """64-bit hashes of all q-grams."""
    n = max(0, len(codes) - q + 1)
    x = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(q):
            x = x * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
        return mix64(x)


@dataclass(frozen=True)
class Index:
    """Patterns of a block of items, and where each of their q-grams stands."""

    item: np.ndarray
    offset: np.ndarray  # of the pattern in its item
    text: list[str]
    budget: np.ndarray  # edits
    least: np.ndarray  # shared q-grams
    gram: np.ndarray  # sorted, distinct
    first: np.ndarray  # of each gram's places, and one more
    pattern: np.ndarray
    place: np.ndarray
    filter: np.ndarray
    longest: int  # pattern's characters
    short_gram: np.ndarray  # hashes of the patterns' Q_SHORT-grams, pattern by pattern
    short_first: np.ndarray  # of each pattern's, and one more
    short: dict[int, Short]  # by length: items for which the lemma says nothing, found by the hash of the whole


@dataclass(frozen=True)
class Short:
    """Items of one length: their hashes in order, and the items of each."""

    gram: np.ndarray
    items: list[list[tuple[int, str]]]


def _short(items: list[tuple[int, str]]) -> dict[int, Short]:
    by: dict[int, dict[int, list[tuple[int, str]]]] = {}
    for number, whole in items:
        codes = _codes(whole)
        by.setdefault(len(codes), {}).setdefault(int(grams(codes, len(codes))[0]), []).append((number, whole))
    return {n: Short(np.array(sorted(own), np.uint64), [own[g] for g in sorted(own)]) for n, own in by.items()}


def short_places(index: Index, plain: str, codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(item, start, end) of the first place of each short item in the text: a pass for each length, however many items have it."""
    for n, own in index.short.items():
        left = {i for i, _ in enumerate(own.gram)}
        for at in range(0, max(0, len(codes) - n + 1), 1 << 20):
            g = grams(codes[at : at + (1 << 20) + n - 1], n)
            spot = np.minimum(np.searchsorted(own.gram, g), len(own.gram) - 1)
            hit = np.flatnonzero(own.gram[spot] == g)
            found, first = np.unique(spot[hit], return_index=True)
            for i, place in zip(found.tolist(), (at + hit[first]).tolist(), strict=True):
                if i in left:
                    left.discard(i)
                    for item, pattern in own.items[i]:
                        if (start := plain.find(pattern, place)) >= 0:  # at `place`, but for a clash of hashes
                            yield item, start, start + len(pattern)


def build(items: list[tuple[int, str]], size: int = PATTERN, stride: int = STRIDE, rate: float = RATE, q: int = Q) -> Index:
    item, offset, text, short = [], [], [], []
    for number, raw in items:
        whole = normalise(raw).strip()
        if not whole:
            continue
        if len(whole) + 1 - q * (int(rate * len(whole)) + 1) < 1:
            short.append((number, whole))
            continue
        starts = list(range(0, max(1, len(whole) - size + 1), stride))
        if starts[-1] + size < len(whole):
            starts.append(len(whole) - size)
        for s in starts:
            item.append(number)
            offset.append(s)
            text.append(whole[s : s + size])
    budget = np.array([int(rate * len(t)) for t in text], np.int64)
    length = np.array([len(t) for t in text], np.int64)
    all_grams = [grams(_codes(t), q) for t in text]
    counts = np.array([len(g) for g in all_grams], np.int64)
    flat = np.concatenate(all_grams) if text else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    gram, first = np.unique(flat[order], return_index=True)
    pattern = np.repeat(np.arange(len(text)), counts)[order]
    place = (np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts))[order]
    keep = np.zeros(1 << _FILTER_BITS, bool)
    keep[(gram >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
    short_grams = [_short_grams(_codes(t)) for t in text]
    short_first = np.concatenate([[0], np.cumsum([len(g) for g in short_grams])]).astype(np.int64)
    short_gram = np.concatenate(short_grams) if text else np.zeros(0, np.uint16)
    return Index(np.array(item, np.int64), np.array(offset, np.int64), text, budget, length + 1 - q * (budget + 1), gram, np.append(first, len(flat)), pattern.astype(np.int32), place.astype(np.int32), keep, int(length.max(initial=0)), short_gram, short_first, _short(short))


def _short_grams(codes: np.ndarray) -> np.ndarray:
    """16-bit hashes of all Q_SHORT-grams."""
    return (grams(codes, Q_SHORT) >> np.uint64(48)).astype(np.uint16)


def regions(index: Index, codes: np.ndarray, q: int = Q, known: Callable[[int], bool] = lambda p: False) -> Iterator[tuple[int, int, int]]:
    """(pattern, lowest and highest diagonal) of the bands that reach the bound.

    Where a q-gram is frequent on both sides, so that there are more than HITS pairs of its places, the text is cut into short windows, each
    as long as a whole pattern more, and the patterns of a window are those that reach the bounds there.
    What is left is held in slices of HITS pairs at most, or one pattern's. Patterns that are `known` to be there are left out.
    """
    g = grams(codes, q)
    at = np.flatnonzero(index.filter[(g >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
    if not len(at) or not len(index.gram):
        return
    spot = np.minimum(np.searchsorted(index.gram, g[at]), len(index.gram) - 1)
    hit = index.gram[spot] == g[at]
    at, spot = at[hit], spot[hit]
    # Each q-gram of the text once, with its places there and in the patterns.
    order = np.argsort(spot, kind="stable")
    at, spot = at[order], spot[order]
    gram, first, times = np.unique(spot, return_index=True, return_counts=True)
    size = index.first[gram + 1] - index.first[gram]
    if not size.sum():
        return
    row = np.repeat(index.first[gram] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    pattern, place = index.pattern[row], index.place[row]
    first, times = np.repeat(first, size), np.repeat(times, size)
    # A pattern with too few places that the text has anywhere can't have a band that reaches the bound.
    enough = np.bincount(pattern, minlength=len(index.item)) >= index.least
    _keep_by_short_grams(index, enough, codes)
    enough[[p for p in np.flatnonzero(enough).tolist() if known(p)]] = False
    some = enough[pattern]
    order = np.flatnonzero(some)[np.argsort(pattern[some], kind="stable")]
    pattern, place, first, times = pattern[order], place[order], first[order], times[order]
    if not len(pattern):
        return
    start = np.flatnonzero(np.concatenate([[True], pattern[1:] != pattern[:-1]]))
    total = np.cumsum(np.add.reduceat(times, start))
    longest = index.longest + int(index.budget.max())
    if total[-1] > HITS and len(codes) > 2 * (WINDOW + longest):
        for off in range(0, len(codes), WINDOW):
            for p, a, b in regions(index, codes[off : off + WINDOW + longest], q, known):
                yield p, a + off, b + off
        return
    low = 0
    while low < len(start):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + HITS, side="right")))
        part = slice(start[low], start[high] if high < len(start) else len(pattern))
        yield from _bands(index, at, pattern[part], place[part], first[part], times[part])
        low = high


def _keep_by_short_grams(index: Index, enough: np.ndarray, codes: np.ndarray) -> None:
    """Unmark patterns with too few of their Q_SHORT-grams in the text, be it for a whole pattern within its edits, for which the lemma holds
    as well, or for a verbatim run."""
    left = np.flatnonzero(enough)
    if not len(left):
        return
    there = np.zeros(1 << 16, bool)
    there[_short_grams(codes)] = True
    first, size = index.short_first[left], index.short_first[left + 1] - index.short_first[left]
    at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
    count = np.add.reduceat(there[index.short_gram[at]].astype(np.int64), np.cumsum(size) - size)
    enough[left[count < np.minimum(size - Q_SHORT * index.budget[left], RUN + 1 - Q_SHORT)]] = False


def _bands(index: Index, at: np.ndarray, pattern: np.ndarray, place: np.ndarray, first: np.ndarray, times: np.ndarray) -> Iterator[tuple[int, int, int]]:
    which = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(times.sum())
    pattern, place = np.repeat(pattern, times), np.repeat(place, times)
    diagonal = at[which] - place
    width = index.budget[pattern] + 1
    band = diagonal // width  # every band is two widths wide, so that each run of `width` diagonals is inside one
    pattern, place, band = np.tile(pattern, 2), np.tile(place, 2), np.concatenate([band, band - 1])
    order = np.lexsort((place, band, pattern))
    pattern, place, band = pattern[order], place[order], band[order]
    new_band = np.concatenate([[True], (pattern[1:] != pattern[:-1]) | (band[1:] != band[:-1])])
    new_place = np.concatenate([[True], place[1:] != place[:-1]]) | new_band
    start = np.flatnonzero(new_band)
    count = np.add.reduceat(new_place.astype(np.int64), start)
    good = count >= index.least[pattern[start]]
    held = None
    for p, b in zip(pattern[start][good].tolist(), band[start][good].tolist(), strict=True):
        w = int(index.budget[p]) + 1
        if held and held[0] == p and b * w <= held[2] + 1:
            held = (p, held[1], (b + 2) * w - 1)
        else:
            if held:
                yield held
            held = (p, b * w, (b + 2) * w - 1)
    if held:
        yield held


def banded(pattern: str, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best alignment of the whole pattern to a part of the text whose path stays within
    the diagonals low - budget to high + budget, if it has at most `budget` edits; the leftmost end wins."""
    low, high = low - budget, high + budget
    p = _codes(pattern)
    far = budget + 1
    # Column d of a row i stands for text position i + low + d; before the text and after it nothing matches.
    width = high - low + 1
    step = np.arange(width)
    inside = lambda i: (step + i + low >= 0) & (step + i + low <= len(text))
    cost = np.where(inside(0), 0, far)
    begin = np.where(inside(0), step + low, -1)
    padded = np.concatenate([np.full(max(0, -low) + 1, 0xFFFFFFFF, np.uint32), text, np.full(max(0, high + len(p) + 1 - len(text)) + 1, 0xFFFFFFFF, np.uint32)])
    base = max(0, -low) + 1 + low
    for i in range(1, len(p) + 1):
        other = padded[base + i - 1 : base + i - 1 + width] != p[i - 1]
        match = cost + other
        skip = np.append(cost[1:], far) + 1  # a pattern character without a partner
        use = skip < match
        best = np.where(use, skip, match)
        start = np.where(use, np.append(begin[1:], -1), begin)
        # Text characters without a partner: running minima along the row.
        reach = best - step
        run = np.minimum.accumulate(reach)
        source = np.maximum.accumulate(np.where(reach == run, step, -1))
        cost = np.where(inside(i), np.minimum(run + step, far), far)
        begin = start[source]
        if cost.min() >= far:
            return None
    d = int(np.argmin(cost))
    return (int(cost[d]), int(begin[d]), d + len(p) + low) if cost[d] <= budget else None


def verbatim(pattern: str, text: np.ndarray, low: int, high: int, least: int = RUN) -> tuple[int, int] | None:
    """(start, end) in the text of the longest run that it shares with the pattern on one of the diagonals low to high, if it
    has at least `least` characters; the lowest diagonal wins, then the first run."""
    p = _codes(pattern)
    low, high = max(low, least - len(p)), min(high, len(text) - least)
    best = None
    for at in range(low, high + 1, 4096):  # a bounded number of diagonals at once
        diagonals = np.arange(at, min(high + 1, at + 4096))
        column = diagonals[:, None] + np.arange(len(p))
        inside = (column >= 0) & (column < len(text))
        differ = ~inside | (text[np.where(inside, column, 0)] != p)
        # The characters since the last difference.
        run = np.arange(1, len(p) + 1) - np.maximum.accumulate(np.where(differ, np.arange(1, len(p) + 1), 0), axis=1)
        longest = run.max(1)
        d = int(np.argmax(longest))
        if longest[d] >= least and (best is None or longest[d] > best[1] - best[0]):
            end = int(diagonals[d]) + int(np.argmax(run[d])) + 1
            best = (end - int(longest[d]), end)
    return best


def find(index: Index, text: str) -> list[tuple[int, int, int, int, int]]:
    """(item, start, end, edits, patterns) of every item that a pattern or a verbatim run of is in the text: the best
    place of a pattern, or the longest run if no pattern is there as a whole."""
    plain = normalise(text)
    whole = _codes(plain)
    best: dict[int, tuple[int, int, int]] = {}
    seen: dict[int, set[int]] = {}
    runs: dict[int, tuple[int, int]] = {}
    overlap = 2 * (index.longest + int(index.budget.max(initial=0)))
    exact: dict[str, int] = {}  # of each pattern, its first place or -1

    def there(p: int) -> bool:
        pattern = index.text[p]
        if pattern not in exact:
            exact[pattern] = plain.find(pattern)
        if (place := exact[pattern]) < 0:
            return False
        item, found = int(index.item[p]), (0, place, place + len(pattern))
        seen.setdefault(item, set()).add(p)
        best[item] = min(best.get(item, found), found)
        return True

    at = 0
    while index.text:
        codes = whole[at : at + SEGMENT + overlap]
        for p, low, high in regions(index, codes, known=there):
            item = int(index.item[p])
            if hit := banded(index.text[p], codes, low, high, int(index.budget[p])):
                found = (hit[0], at + hit[1], at + hit[2])
                seen.setdefault(item, set()).add(p)
                best[item] = min(best.get(item, found), found)
            elif run := verbatim(index.text[p], codes, low, high):
                place = (at + run[0], at + run[1])
                runs[item] = min(runs.get(item, place), place, key=lambda r: (r[0] - r[1], r))
        at += SEGMENT
        if at >= len(whole):
            break
    for item, start, end in short_places(index, plain, whole):
        seen.setdefault(item, set()).add(-1)
        best[item] = min(best.get(item, (0, start, end)), (0, start, end))
    for item, place in runs.items():
        best.setdefault(item, (0, *place))
    return [(item, s, e, edits, len(seen.get(item, ()))) for item, (edits, s, e) in sorted(best.items())]


def _kernel(index, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, items = index.value
        ids = pa.array(ids, schema.field("item_id").type)
        for batch in batches:
            for part in by_size(batch, "text", 8_000_000):
                rows, found = [], []
                for i, t in enumerate(part.column("text").to_pylist()):
                    for hit in find(items, t) if t else ():
                        rows.append(i)
                        found.append(hit)
                number, *columns = list(zip(*found, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(rows, pa.int64())), ids.take(pa.array(number, pa.int64())), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[2:], strict=True))], schema=schema)

    return run


def _blocks(rows: Iterator, chars: int) -> Iterator[tuple[list, list[tuple[int, str]]]]:
    """(ids, texts with their ids' numbers) of runs of rows, sorted by id, with at most `chars` characters; the texts of one id stay
    together, however long they are."""
    ids, texts, total = [], [], 0
    for r in rows:
        if texts and r["id"] != ids[-1]:
            if total + len(r["text"]) > chars:
                yield ids, texts
                ids, texts, total = [], [], 0
            ids.append(r["id"])
        ids = ids or [r["id"]]
        texts.append((len(ids) - 1, r["text"]))
        total += len(r["text"])
    if texts:
        yield ids, texts


def contaminated(docs: DataFrame, key: str, text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(key, item_id, char_start, char_end, edits, patterns): a row for every text and item it holds a part of, with the
    best place of a pattern, its edits and how many of the item's patterns were found. Where none was found as a whole (patterns 0), it is
    the place of the longest verbatim run of RUN characters or more.

    Items too short for the bound are found only exactly (but for case and kind of white space), empty and null ones
    never. Null and empty texts hold nothing, long ones are searched whole. Items that repeat an id are one item; repeated texts repeat their rows. Keys and ids may be of any type, and keys null; items with a null id
    are left out. Other columns aren't read. Without items the result is empty. The items go to the tasks in blocks of bounded size,
    cut on the driver as they arrive; every block is a pass over the texts.
    """
    spark = docs.sparkSession
    short_batches(spark)
    known = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).alias("id"), F.col(item_text).alias("text")).distinct()
    result, schema = as_schema(("key", docs.schema[key].dataType), ("item_id", items.schema[item_id].dataType), *RESULT)
    data = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = None
    for ids, texts in _blocks(known.orderBy("id", "text").toLocalIterator(), BLOCK_CHARS):
        index = spark.sparkContext.broadcast((ids, build(texts)))
        found = data.mapInArrow(_kernel(index, schema), result)
        out = found if out is None else out.unionByName(found)
    return (spark.createDataFrame([], result) if out is None else out).withColumnRenamed("key", key)


def query(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")

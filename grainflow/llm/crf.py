"""Language identification by a linear-chain conditional random field over words.

A word is a run of letters of the lower-cased text. Its features are its character bigrams and trigrams,
prefixes and suffixes of one to three characters, and the word itself (the lexicon), all hashed into one table of
weights per language. Transitions between the languages of neighbouring words are learned too, on
sequences spliced from texts of several languages, so that code-switched text is labelled word by
word. Forward-backward gives each word's posterior; a document's language is the one with the largest sum.

All steps are array operations over a batch of whole documents; chains of many
documents run side by side. Prediction is a map over rows: no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from grainflow.llm.common import as_schema, by_size, crc_bucket, fresh, short_batches, table

BITS = 16
#: Labelled texts of a language that are learned from, as wholes.
SAMPLE = 400
UNKNOWN = "und"
#: Steps of the learning, sequences of a step and their words, and the chance that the language changes after a word.
STEPS, _BATCH, _SEQUENCE, _SWITCH = 200, 128, 64, 1 / 12
_RATE, _RIDGE = 0.3, 1e-6
#: Characters whose features a worker holds at once.
_CHARS = 500_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points of the first 17 planes are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _slot(salt: int, *parts: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = np.uint32(salt * 0x9E3779B1 & 0xFFFFFFFF)
        for i, part in enumerate(parts):
            x = (x ^ part.astype(np.uint32)) * np.uint32((0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)[i % 3])
            x = x ^ (x >> np.uint32(15))
        return ((x * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)).astype(np.int32)


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all texts in a row, first and last + 1 letter of every word, its text's number)."""
    lowered = [(t or "").lower() for t in texts]
    codes = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = np.concatenate([[False], _letters()[codes], [False]])
    edge = np.flatnonzero(letter[1:] != letter[:-1])
    starts, ends = edge[::2], edge[1::2]
    return codes, starts, ends, np.searchsorted(np.cumsum([len(t) + 1 for t in lowered]), starts, side="right")


def features(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots in the table: (letters, 2) for the n-grams that end at each letter, the first letter's
    row of every word, and (words, 7) for its affixes and the word itself."""
    size = ends - starts
    first = np.cumsum(size) - size
    at = np.arange(size.sum()) - np.repeat(first - starts, size)
    place = np.arange(len(at)) - np.repeat(first, size)
    c = codes[at].astype(np.uint32)
    mark = np.uint32(1)
    before = np.where(place >= 1, codes[np.maximum(at - 1, 0)], mark)
    before2 = np.where(place >= 2, codes[np.maximum(at - 2, 0)], mark)
    grams = np.stack([_slot(1, before, c), _slot(2, before2, before, c)], 1)

    def near(base: np.ndarray, shift: int, inside: np.ndarray) -> np.ndarray:
        return np.where(inside, codes[np.clip(base + shift, 0, len(codes) - 1)], mark)

    p = [near(starts, i, size > i) for i in range(3)]
    s = [near(ends, -1 - i, size > i) for i in range(3)]
    with np.errstate(over="ignore"):
        mixed = (c.astype(np.uint64) + np.uint64(1)) * (np.uint64(0x9E3779B97F4A7C15) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)))
        mixed = mixed ^ (mixed >> np.uint64(29))
        whole = np.add.reduceat(mixed * np.uint64(0xBF58476D1CE4E5B9), first) if len(first) else np.zeros(0, np.uint64)
    own = [_slot(3, p[0]), _slot(4, p[0], p[1]), _slot(5, p[0], p[1], p[2]), _slot(6, s[0]), _slot(7, s[0], s[1]), _slot(8, s[0], s[1], s[2]), _slot(9, whole & np.uint64(0xFFFFFFFF), whole >> np.uint64(32))]
    return grams, first, np.stack(own, 1)


def emissions(weights: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(words, languages): the sum of the weights of each word's features."""
    out = np.zeros((len(starts), weights.shape[1]), np.float32)
    total = np.cumsum(ends - starts)
    at = 0
    while at < len(starts):  # a bounded number of letters at a time
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _CHARS, side="right")))
        grams, first, own = features(codes, starts[at:to], ends[at:to])
        out[at:to] = np.add.reduceat(weights[grams[:, 0]] + weights[grams[:, 1]], first, axis=0)
        for j in range(own.shape[1]):
            out[at:to] += weights[own[:, j]]
        at = to
    return out


def forward_backward(scores: np.ndarray, counts: np.ndarray, transition: np.ndarray, start: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(posteriors of every word, expected transitions if `pairs`) for chains that stand one after the other.

    `counts` has the length of every chain. Chains run side by side, the longest first; messages are
    scaled to sum to 1, so chains of any length keep their precision.
    """
    e = np.exp(scores - scores.max(1, keepdims=True)).astype(np.float32)
    order = np.argsort(-counts, kind="stable")
    lengths = counts[order]
    firsts = (np.cumsum(counts) - counts)[order]
    steps = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(steps), side="left") if steps else np.zeros(0, int)
    t = np.exp(transition - transition.max()).astype(np.float32)
    forward, backward = np.empty_like(e), np.empty_like(e)
    expected = np.zeros_like(t, np.float64)
    a = np.exp(start - start.max()).astype(np.float32)[None, :]
    for i in range(steps):
        rows = firsts[: active[i]] + i
        a = (a if i == 0 else a[: active[i]] @ t) * e[rows]
        a = a / a.sum(1, keepdims=True)
        forward[rows] = a
    lasts = firsts + lengths - 1
    b = np.ones((int(active[0]) if steps else 0, e.shape[1]), np.float32)
    for i in range(steps):
        rows = lasts[: active[i]] - i
        if i:
            later = b[: active[i]] * e[rows + 1]
            if pairs:
                joint = forward[rows][:, :, None] * t[None] * later[:, None, :]
                expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            b = later @ t.T
            b = b / b.sum(1, keepdims=True)
        backward[rows] = b[: active[i]]
    posterior = forward * backward
    return posterior / posterior.sum(1, keepdims=True), expected


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray
    transition: np.ndarray
    start: np.ndarray


def _all_features(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`features` of any number of words, made from a bounded number of letters at a time."""
    total = np.cumsum(ends - starts)
    parts, at = [], 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _CHARS, side="right")))
        parts.append(features(codes, starts[at:to], ends[at:to]))
        at = to
    return np.concatenate([p[0] for p in parts]), total - (ends - starts), np.concatenate([p[2] for p in parts])


def fit(sample: list[tuple[str, str]], seed: int = 7) -> Model:
    """Learn from (language, text) rows by a fixed number of stochastic gradients of the likelihood (AdaGrad)."""
    languages = tuple(sorted({x for x, _ in sample}))
    n = len(languages)
    weights, transition, start = np.zeros((2**BITS, max(n, 1)), np.float32), np.zeros((n, n)), np.zeros(n)
    codes, starts, ends, text = words([t for _, t in sample])
    if n < 2 or not len(starts):
        return Model(languages, weights, transition, start)
    grams, first, own = _all_features(codes, starts, ends)
    size = ends - starts
    label = np.array([languages.index(x) for x, _ in sample])[text]
    by_label = [np.flatnonzero(label == k) for k in range(n)]
    usable = [k for k in range(n) if len(by_label[k])]
    rng = np.random.default_rng(seed)
    squares, squares_t, squares_s = np.full_like(weights, 1e-3), np.full_like(transition, 1e-3), np.full_like(start, 1e-3)
    for _ in range(STEPS):
        # Runs of words of one language follow each other; lengths are geometric.
        change = rng.random((_BATCH, _SEQUENCE)) < _SWITCH
        change[:, 0] = True
        run = np.cumsum(change.ravel()) - 1
        pick = rng.choice(usable, run[-1] + 1)
        origin = np.array([by_label[k][rng.integers(len(by_label[k]))] for k in pick])
        offset = np.arange(len(run)) - np.flatnonzero(change.ravel())[run]
        word = origin[run] + offset
        word = np.where((word < len(label)) & (label[np.minimum(word, len(label) - 1)] == pick[run]), word, origin[run])
        truth = label[word]
        letters = size[word]
        at = np.arange(letters.sum()) - np.repeat(np.cumsum(letters) - letters - first[word], letters)
        which = np.repeat(np.arange(len(word)), letters)
        idx = np.concatenate([grams[at, 0], grams[at, 1], own[word].ravel()])
        whose = np.concatenate([which, which, np.repeat(np.arange(len(word)), own.shape[1])])
        score = np.stack([np.bincount(whose, weights[idx, k], len(word)) for k in range(n)], 1)
        posterior, expected = forward_backward(score, np.full(_BATCH, _SEQUENCE), transition, start, pairs=True)
        error = -posterior.astype(np.float64)
        error[np.arange(len(word)), truth] += 1
        pairs = truth.reshape(_BATCH, _SEQUENCE)
        seen = np.zeros((n, n))
        np.add.at(seen, (pairs[:, :-1].ravel(), pairs[:, 1:].ravel()), 1)
        gradient = np.stack([np.bincount(idx, error[whose, k], 2**BITS) for k in range(n)], 1) / _BATCH - _RIDGE * weights
        squares += gradient**2
        weights += (_RATE * gradient / np.sqrt(squares)).astype(np.float32)
        step = (seen - expected) / _BATCH
        squares_t += step**2
        transition += _RATE * step / np.sqrt(squares_t)
        step_s = (np.bincount(pairs[:, 0], minlength=n) - posterior.reshape(_BATCH, _SEQUENCE, n)[:, 0].sum(0)) / _BATCH
        squares_s += step_s**2
        start += _RATE * step_s / np.sqrt(squares_s)
    return Model(languages, weights, transition.astype(np.float32), start.astype(np.float32))


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """(language, mean posterior) of every text; `und` and 0 without a letter."""
    codes, starts, ends, text = words(texts)
    if not len(starts) or not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    counts = np.bincount(text, minlength=len(texts))
    some = np.flatnonzero(counts)
    posterior, _ = forward_backward(emissions(model.weights, codes, starts, ends), counts[some], model.transition, model.start)
    sums = np.stack([np.bincount(text, posterior[:, k], len(texts)) for k in range(posterior.shape[1])], 1)
    best = sums.argmax(1)
    share = sums[np.arange(len(texts)), best] / np.maximum(counts, 1)
    return [model.languages[b] if c else UNKNOWN for b, c in zip(best, counts, strict=True)], np.clip(share, 0.0, 1.0)


def label_words(model: Model, text: str) -> list[tuple[str, str, float]]:
    """(word, language, posterior) of every word of a text."""
    codes, starts, ends, _ = words([text])
    if not len(starts):
        return []
    posterior, _ = forward_backward(emissions(model.weights, codes, starts, ends), np.array([len(starts)]), model.transition, model.start)
    whole = codes.tobytes().decode("utf-32-le", "surrogatepass")
    return [(whole[s:e], model.languages[k], float(p[k])) for s, e, p, k in zip(starts, ends, posterior, posterior.argmax(1), strict=True)]


def train(docs: DataFrame, key: str, text: str, language: str, sample: int = SAMPLE) -> Model:
    """Fit on `sample` texts of each language, those with the least hashes of key and text, each as a whole.

    Rows with a null key, text or language don't count, and rows that repeat key and text count once, however many they are. Every language is learned: the
    model and the driver's sample grow with their number. A first draw by hash leaves some more than `sample` different rows of each
    language, and these alone are ranked.
    """
    whole = docs.where(F.col(key).isNotNull() & F.col(language).isNotNull() & F.col(text).isNotNull())
    known = whole.select(F.xxhash64(key, text).alias("h"), F.col(key).alias("key"), F.col(text).alias("text"), F.col(language).alias("language"))
    counts = known.groupBy("language").agg(F.count_distinct("h").alias("count")).collect()
    shares = F.create_map(*(F.lit(x) for r in counts for x in (r["language"], min(1.0, (2 * sample + 100) / r["count"]))))
    share = shares[F.col("language")] if counts else F.lit(0.0)
    drawn = known.where(F.pmod("h", F.lit(1 << 20)) / float(1 << 20) < share).distinct()
    first = Window.partitionBy("language").orderBy("h", "key", "text")
    rows = drawn.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= sample)
    return fit([(r["language"], r["text"]) for r in rows.select("language", "rank", "text").orderBy("language", "rank").collect()])


def _kernel(model, key: str, text: str, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, text, 2_000_000):
                found, score = predict(model.value, part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names if c in key), pa.array(found, pa.string()), pa.array(score)], schema=schema)

    return run


def identify(docs: DataFrame, model: Model, text: str, keep: list[str]) -> DataFrame:
    """The columns `keep` with lang_pred and score (under other names if `keep` has them, see `fresh`), for every row of `docs`; whole texts are read.

    A null or empty text, or one without a letter, is `und` with score 0. Repeated rows give the same
    answer. The model, of a fixed size, is broadcast.
    """
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    inner = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text).alias("text"))
    names = [f"k{i}" for i in range(len(keep))]
    out, schema = as_schema(*((n, inner.schema[n].dataType) for n in names), ("lang_pred", StringType()), ("score", DoubleType()))
    done = inner.mapInArrow(_kernel(shared, names, "text", schema), out)
    return done.select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)), *(F.col(n).alias(fresh(n, keep)) for n in ("lang_pred", "score")))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(crc_bucket("doc_id", 4) != 2), "doc_id", "text", "lang")
    held_out = F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False))
    return identify(docs, model, "text", ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")

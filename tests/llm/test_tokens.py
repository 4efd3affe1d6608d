import os
import random
from fractions import Fraction

import numpy as np
import pytest

from grainflow.llm import tokens
from tests.llm.helpers import documents

TEXTS = ["One line.\nTwo  lines\n\n\nfive", "", None, "é" * 50 + "\n日本語\U0001f600 text", "no feed", "\n", "x " * 20_000 + "\n" + "y" * 30_000, "<|endoftext|> is text"]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(os.path.dirname(tokens.VOCABULARY), "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_spans_equal_the_other_library(reference):
    with open(tokens.VOCABULARY, "rb") as f:
        ranks = f.read()
    for t in TEXTS:
        if t:
            start, end = tokens.token_spans(ranks, t)
            got = reference.encode(t, add_special_tokens=False)
            assert len(start) == len(got.ids)
            whole = [(a, b) for (a, b), (c, d) in zip(got.offsets, zip(start, end, strict=True), strict=True) if (a, b) != (c, d)]
            assert not t.isascii() or not whole


@pytest.mark.parametrize("rule", ["first", "largest", "proportional"])
def test_every_token_is_counted_once(spark, reference, rule):
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(TEXTS)])
    got = tokens.count_tokens(docs.withColumnRenamed("lang", "section"), "doc_id", "text", rule=rule).toPandas()
    for i, t in enumerate(TEXTS):
        own = got[got["doc_id"] == i]
        assert own["n_tokens"].sum() == pytest.approx(len(reference.encode(t, add_special_tokens=False).ids) if t else 0)
        assert len(own) >= 1 and (own["char_end"].max() == len(t or ""))


def test_rules_differ_at_a_boundary():
    start, end = np.array([0, 4]), np.array([4, 8])
    low, high = np.array([0, 3]), np.array([3, 7])
    assert tokens.allocate(start, end, low, high, "first")[0].tolist() == [1, 1]
    assert tokens.allocate(start, end, low, high, "largest")[0].tolist() == [1, 1]
    count, cross, outside = tokens.allocate(start, end, low, high, "proportional")
    assert count.tolist() == [0.75, 1.0] and cross.tolist() == [1, 2] and outside == 0.25


def test_given_sections_with_gaps(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma", [(0, 5), (11, 16)]), (2, "alpha", []), (3, "a", None)], "k int, t string, s array<struct<start:int,end:int>>")
    got = {(r["k"], r["section"]): r["n_tokens"] for r in tokens.count_tokens(df, "k", "t", "s").collect()}
    assert got[2, -1] >= 1 and got[3, 0] == 0 and {(1, 0), (1, 1), (1, -1)} <= set(got)
    assert tokens.count_tokens(df.limit(0), "k", "t").count() == 0


@pytest.fixture(scope="module")
def ranks():
    with open(tokens.VOCABULARY, "rb") as f:
        return f.read()


def test_long_runs_give_the_same_tokens(ranks):
    encoding, _ = tokens._encoder(ranks)
    rng = random.Random(3)
    parts = ["a", "B", " ", "\n", "\t", "\u3000", "1", "'s", "-", "é", "\x85", "\x1c"]
    for _ in range(500):
        text = "".join(rng.choice(parts) * rng.choice([1, 1, 2, 63, 64, 130]) for _ in range(rng.randrange(12)))
        assert tokens.encode(encoding, text) == encoding.encode_ordinary(text), text


@pytest.mark.parametrize("text", [" " * 5_000_000, "\n" * 5_000_000 + "a", "b" + " \t" * 2_500_000 + "c", "y" * 5_000_000])
def test_runs_of_any_length(ranks, text):
    start, end = tokens.token_spans(ranks, text)
    assert start[0] == 0 and end[-1] == len(text) and (start[1:] == end[:-1]).all()


def brute(spans, sections, rule):
    """Tokens of each section and outside of all, a character at a time."""
    owner = {}
    for j, (a, b) in enumerate(sections):
        owner |= dict.fromkeys(range(a, b), j)
    out = dict.fromkeys(range(-1, len(sections)), Fraction(0))
    for a, b in spans:
        held = [owner.get(i, -1) for i in range(a, b)]
        inside = sorted({x for x in held if x >= 0})
        if rule == "proportional":
            for x in held:
                out[x] += Fraction(1, b - a)
        elif rule == "first" or not inside:
            out[held[0]] += 1
        else:
            out[max(inside, key=lambda x: (held.count(x), -x))] += 1
    return out


@pytest.mark.parametrize("rule", ["first", "largest", "proportional"])
def test_allocation_equals_brute_force(rule):
    rng = random.Random(5)
    for _ in range(200):
        cuts = sorted({0, *(rng.randrange(60) for _ in range(rng.randrange(1, 20)))})
        spans = list(zip(cuts, cuts[1:], strict=False))
        edges = sorted(rng.randrange(60) for _ in range(2 * rng.randrange(6)))
        sections = [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True)]
        got, _, outside = tokens.allocate(*(np.array([x[k] for x in spans], np.int64) for k in (0, 1)), *(np.array([x[k] for x in sections], np.int64) for k in (0, 1)), rule)
        want = brute(spans, sections, rule)
        assert outside == pytest.approx(float(want[-1])) and got.tolist() == pytest.approx([float(want[j]) for j in range(len(sections))])


def test_query_equals_brute_force(spark, reference):
    """Every line of every document: a token belongs to the line with most of its characters."""
    from tests.llm.helpers import SF

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = tokens.query(spark, SF).collect()
    found = {(r["doc_id"], r["section"]): (r["char_start"], r["char_end"], r["n_tokens"]) for r in rows}
    assert len(found) == len(rows)
    for i in sorted(texts)[:60]:
        text = texts[i] or ""
        lines, at = [], 0
        for line in text.splitlines(keepends=True) if not set(text) & set("\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029") else [x + "\n" for x in text.split("\n")]:
            lines.append((at, min(len(text), at + len(line))))
            at += len(line)
        lines = [x for x in lines if x[1] > x[0]] or [(0, 0)]
        spans = reference.encode(text, add_special_tokens=False).offsets if text.isascii() else None
        assert [found[i, j][:2] for j in range(len(lines))] == lines
        if spans is not None:
            want = brute(spans, lines, "largest")
            assert [found[i, j][2] for j in range(len(lines))] == [want[j] for j in range(len(lines))], i


def test_keys_of_any_type(spark):
    from pyspark.sql import functions as F

    for kind, value in (("smallint", 3), ("decimal(10,2)", 3), ("string", "k"), ("bigint", None)):
        df = spark.createDataFrame([("a b",)], "t string").withColumn("k", F.lit(value).cast(kind))
        assert [(r["k"] is None, r["n_tokens"]) for r in tokens.count_tokens(df, "k", "t").collect()] == [(value is None, 2)]

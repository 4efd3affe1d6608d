import random
import time

import pytest
from pyspark.sql import functions as F

from grainflow.llm import decontamination as D
from tests.llm.helpers import documents

rng = random.Random(1)
ITEM = "The early ferry carries letters, milk and two sleepy dogs across the cold sound before the harbour lights go out and the gulls begin."
OTHER = "A second question about rivers that never meet the sea, asked of pupils who have only ever seen the desert from a train."


def found(spark, texts, items=((1, ITEM), (2, OTHER))):
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]).withColumn("item_id", F.lit("mine")).repartition(2)
    bench = spark.createDataFrame(list(items), "item_id long, text string").withColumn("doc_id", F.lit(1))
    return {(r["doc_id"], r["item_id"]): r for r in D.contaminated(docs, "doc_id", "text", bench, "item_id", "text").collect()}


def edited(text, n, seed=0):
    r, out = random.Random(seed), list(text)
    for _ in range(n):
        i = r.randrange(len(out))
        kind = r.randrange(3)
        if kind == 0:
            out[i] = "#"
        elif kind == 1:
            del out[i]
        else:
            out.insert(i, "~")
    return "".join(out)


def noise(n):
    return " ".join("".join(rng.choice("aeioutrn") for _ in range(5)) for _ in range(n))


def edit_distance_inside(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_finds_copies_and_edited_passages(spark):
    texts = [noise(50) + "\n" + ITEM + " " + noise(50), noise(30) + ITEM.upper().replace(" ", "\n") + noise(3), noise(200), None, "", edited(ITEM, 6) + noise(20), noise(9000) + OTHER + noise(9000), ITEM + OTHER, ITEM[:40] + noise(40)]
    got = found(spark, texts + [texts[0]])
    assert set(got) == {(0, 1), (1, 1), (5, 1), (6, 2), (7, 1), (7, 2), (9, 1)}
    assert got[0, 1]["edits"] == 0 and texts[0][got[0, 1]["char_start"] : got[0, 1]["char_end"]] == ITEM[: D.PATTERN]
    assert texts[6][got[6, 2]["char_start"] : got[6, 2]["char_end"]] == OTHER[: D.PATTERN] and got[5, 1]["edits"] >= 1


def test_empty_tables_and_short_items(spark):
    assert found(spark, [], ((1, ITEM),)) == {} and found(spark, [ITEM], ()) == {}
    got = found(spark, ["say Rare Word now", "nothing"], ((1, None), (2, ""), (3, "rare word"), (None, ITEM), (4, ITEM), (4, ITEM)))
    assert set(got) == {(0, 3)}


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_CHARS", 100)
    assert set(found(spark, [noise(5) + ITEM, OTHER])) == {(0, 1), (1, 2)}


@pytest.mark.parametrize("edits", range(0, 16, 3))
def test_lemma_loses_nothing_within_the_budget(edits):
    """Whatever is within the budget by brute force is found, and nothing else."""
    index = D.build([(1, ITEM[:110])], 120, 60)
    for seed in range(12):
        text = D.normalise(noise(8) + edited(ITEM[:110], edits, seed) + noise(8))
        best = edit_distance_inside(index.text[0], text)
        hits = D.find(index, text)
        assert bool(hits) == (best <= index.budget[0])
        if hits:
            assert hits[0][3] == best


def test_segments_overlap():
    index = D.build([(1, ITEM)])
    for shift in (-150, -60, -1, 0, 1):
        text = (noise(4000))[: D.SEGMENT + shift] + ITEM + noise(3000)
        assert [h[0] for h in D.find(index, text)] == [1]


def test_normalise_keeps_places():
    assert D.normalise("AİB\tc\n") == "aİb c " and len(D.normalise("İ" * 5)) == 5


@pytest.mark.parametrize("size", [59, 60, 90, 119, 130])
def test_verbatim_runs_are_found_at_every_offset(size):
    item = D.normalise(" ".join("".join(random.Random(7 * i).choice("bcdfgklmps") for _ in range(1 + i % 7)) for i in range(80)))[:290].strip()
    index = D.build([(1, item)])
    for s in range(len(item) - size + 1):
        text = "\u2016" * 30 + item[s : s + size] + "\u2016" * 30
        hits = D.find(index, text)
        assert bool(hits) == (size >= D.RUN), s
        if hits and not hits[0][4]:
            a, b = hits[0][1:3]
            assert b - a >= D.RUN and text[a:b] in item


def test_frequent_qgrams_cost_neither_memory_nor_results():
    """3,000 items that share a run of spaces, against a text with a long one."""
    import resource

    r = random.Random(2)
    words = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(n))
    items = [(i, words(12) + " " * 40 + words(12)) for i in range(3000)]
    index = D.build(items)
    began, before = time.perf_counter(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert D.find(index, words(50) + " " * 100_000 + words(50)) == []
    text = words(30) + " " * 30_000 + edited(items[77][1], 3) + " " * 30_000 + items[99][1]
    assert [h[0] for h in D.find(index, text)] == [77, 99]
    assert time.perf_counter() - began < 20 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000


def test_slices_and_windows_lose_nothing(monkeypatch):
    """However few pairs are held at once, the same is found."""
    items = [(i, noise(3) + "-" * (20 + 7 * i) + noise(18)) for i in range(12)]
    texts = [noise(100) + "-" * 300 + items[i][1] + noise(20) + edited(items[i - 1][1], 4, i) + "-" * 900 for i in range(12)]
    index = D.build(items)
    want = [{h[0] for h in D.find(index, t)} for t in texts]
    assert all({i, (i - 1) % 12} <= w for i, w in enumerate(want))
    monkeypatch.setattr(D, "HITS", 50)
    assert [{h[0] for h in D.find(index, t)} for t in texts] == want
    monkeypatch.setattr(D, "WINDOW", 64)
    assert [{h[0] for h in D.find(index, t)} for t in texts] == want


def test_items_of_several_patterns_equal_brute_force():
    """An item is found if some pattern is within its edits anywhere or a verbatim run is shared; else it isn't."""
    r = random.Random(9)
    words = lambda n: " ".join("".join(r.choice("bcdfghklmnprst") for _ in range(r.randrange(2, 7))) for _ in range(n))
    items = [(i, words(60)) for i in range(6)]
    index = D.build(items)
    for trial in range(25):
        item = r.randrange(6)
        start = r.randrange(len(items[item][1]) - 60)
        text = D.normalise(words(4) + edited(items[item][1][start : start + r.randrange(40, 200)], r.randrange(0, 14), trial) + words(4))
        want = set()
        for p in range(len(index.text)):
            pattern = index.text[p]
            run = any(pattern[k : k + D.RUN] in text for k in range(len(pattern) - D.RUN + 1))
            if run or edit_distance_inside(pattern, text) <= index.budget[p]:
                want.add(int(index.item[p]))
        assert {h[0] for h in D.find(index, text)} == want, trial


def test_keys_and_ids_of_any_type(spark):
    for kind, value in (("smallint", 3), ("decimal(10,2)", 3), ("string", "k"), ("bigint", None)):
        docs = spark.createDataFrame([(ITEM,)], "t string").withColumn("k", F.lit(value).cast(kind))
        bench = spark.createDataFrame([(ITEM,)], "t string").withColumn("i", F.lit(7).cast(kind if kind != "bigint" else "string"))
        rows = D.contaminated(docs, "k", "t", bench, "i", "t").collect()
        assert [(r["k"] is None, r["item_id"] is None) for r in rows] == [(value is None, False)]
        assert D.contaminated(docs, "k", "t", bench.limit(0), "i", "t").schema == D.contaminated(docs, "k", "t", bench, "i", "t").schema


def _edited(rng, text):
    """An edit every 20 characters."""
    out = list(text)
    for i in range(10, len(out), 20):
        out[i] = rng.choice(["#", "", out[i] + "#"])
    return "".join(out)


@pytest.mark.parametrize(("length", "least"), [(70, 0.9), (77, 1.0), (90, 1.0), (120, 1.0), (150, 1.0), (178, 1.0), (220, 1.0)])
def test_recall_of_edited_parts(length, least):
    rng = random.Random(length)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9)))
    words = [word() for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))[:n]
    item = prose(1200)
    index = D.build([(1, item)])
    found = 0
    for _ in range(100):
        at = rng.randrange(len(item) - length)
        found += bool(D.find(index, f"{prose(300)} {_edited(rng, item[at : at + length])} {prose(300)}"))
    assert found >= least * 100
    assert not any(D.find(index, prose(2000)) for _ in range(30))


def test_many_short_items_take_a_pass_a_length():
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n)).strip() or "a"
    items = [(i, word(rng.choice([3, 5, 11, 12]))) for i in range(20_000)]
    text = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    index = D.build(items)
    start = time.time()
    got = {(i, s) for i, s, *_ in D.find(index, text)}
    assert time.time() - start < 2
    plain = D.normalise(text)
    assert got == {(i, plain.find(t)) for i, t in items if t in plain}


def test_query_against_runs_and_alignments(spark):
    """Every document that shares a verbatim run with an item is there, and what is there aligns, checked without any index."""
    sf = "/root/testdata/sf0.001"
    items = {r["item_id"]: D.normalise(r["text"]).strip() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r["text"]}
    docs = {r["doc_id"]: D.normalise(r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r["text"]}
    got = {(r["doc_id"], r["item_id"]): r for r in D.query(spark, sf).collect()}
    runs = {}
    for i, t in items.items():
        for at in range(len(t) - D.RUN + 1):
            runs.setdefault(t[at : at + D.RUN], set()).add(i)
    want = {(d, i) for d, t in docs.items() for at in range(len(t) - D.RUN + 1) for i in runs.get(t[at : at + D.RUN], ())}
    assert want <= set(got) and want
    for (d, i), r in got.items():
        part, item = docs[d][r["char_start"] : r["char_end"]], items[i]
        # Edits of the part against any stretch of the item, by the plain recurrence.
        row = [0] * (len(item) + 1)
        for k, c in enumerate(part, 1):
            new = [k]
            for j, e in enumerate(item, 1):
                new.append(min(row[j - 1] + (c != e), row[j] + 1, new[j - 1] + 1))
            row = new
        assert min(row) <= max(1, round(D.RATE * (len(part) + r["edits"])))

"""Near-duplicate groups by SuperMinHash signatures, banding, verification and union-find.

1. One scan turns each whole text into the set of its hashed word shingles and sends on the set's size, a
   128-bit fingerprint and a signature. Equal fingerprints are one class: copies are never paired.
2. Signatures are cut into bands; classes that share a band's key may be linked. In each key's group only
   the pairs with one pivot, the class with the most copies, are made: a star, not all pairs.
3. Pairs whose signatures leave hope are verified on the full sets, which a second scan rebuilds for just the classes in
   question. Verified links give components by union-find.
4. A key whose members now lie in several components may hide further links. The members of each such key, and
   no others, are compared by signature in blocks, a large key's as many pairs of blocks; a pair that shares several keys is compared in
   the first of them. Only classes with a hopeful partner in a pair of blocks come back there with their full sets
   to be verified. Only links come out, so the rows stay few, and none is lost between the classes that meet in a band.
5. The components of all links, by union-find within bounded parts and star contraction between them.

A pair at the threshold is missed only if it shares no band; see `bands`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainflow.llm.common import by_size, materialise, mix64, short_batches, table, whole_number

WORDS = 5
#: At similarity 0.8 a pair shares no band with probability (1 - 0.8**4)**24 = 3e-6; at 0.85, 2e-8.
BANDS, ROWS = 24, 4
SLOTS = BANDS * ROWS
#: Pairs whose signatures agree in fewer slots than expected at the threshold by this many standard deviations are given up.
DEVIATIONS = 5.0
#: Classes in a block of step 4, edges in a part of step 5.
BLOCK, PART = 128, 200_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles; A-Z is lower-cased, words end at
    space or code points 9 to 13. With fewer words all together are one shingle; without any, none."""
    if not text:
        return np.zeros(0, np.uint64)
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=len(found))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    with np.errstate(over="ignore"):
        n = len(h) - words + 1
        x = h[:n] * _MULTIPLIERS[0]
        for i in range(1, words):
            x = mix64(x) + h[i : i + n] * _MULTIPLIERS[i % len(_MULTIPLIERS)] if i == 1 else x * _GOLDEN + h[i : i + n] * _MULTIPLIERS[i % len(_MULTIPLIERS)]
    return np.unique(mix64(x))


def superminhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """(sets, slots) of 32-bit ranks: an element's j-th draw goes to the j-th slot of a random permutation
    of its own with the value j + r, r in [0, 1), and each slot keeps its least value.

    Values of draw j are at least j, so a set is done as soon as all its slots hold less than
    the next draw's number: after one or two draws for long texts.
    """
    out = np.full((len(sets), slots), np.iinfo(np.uint32).max, np.uint32)
    alive = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    permutation: dict[int, np.ndarray] = {}  # of each element, for the few sets that need a second draw
    for j in range(slots):
        if not len(alive):
            break
        size = np.array([len(sets[i]) for i in alive])
        spans = list(zip(alive.tolist(), (np.cumsum(size) - size).tolist(), size.tolist(), strict=True))
        with np.errstate(over="ignore"):
            z = mix64(np.concatenate([sets[i] for i in alive]) + _GOLDEN * np.uint64(j + 1))
        k = j + (((z >> np.uint64(32)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)
        value = (np.uint32(j) << np.uint32(24)) | (z & np.uint64(0xFFFFFF)).astype(np.uint32)
        slot = k if j == 0 else np.concatenate([permutation[i][np.arange(n), k[a : a + n]] for i, a, n in spans])
        np.minimum.at(out.reshape(-1), np.repeat(alive * slots, size) + slot, value)
        going = (out[alive] >= np.uint32((j + 1) << 24)).any(1)
        for (i, a, n), more in zip(spans, going.tolist(), strict=True):
            if not more:
                permutation.pop(i, None)
                continue
            if j == 0:
                permutation[i] = np.tile(np.arange(slots, dtype=np.uint8), (n, 1))
            p = permutation[i]
            p[np.arange(n), k[a : a + n]] = p[:, j]  # the other half of the swap is never read again
        alive = alive[going]
    return out


def _scan(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, "text", 2_000_000):
                sets = [shingles(t, words) for t in part.column("text").to_pylist()]
                prints = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array([s.tobytes() for s in superminhash(sets)], pa.binary())], names=["id", "n", "print", "sign"])

    return run


def _sets(words: int, wanted) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Full sets of the rows whose id may be wanted: a bitmap of hashed ids, so that some more may come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            spot = batch.column("spot").to_numpy()
            hit = np.flatnonzero(bits[spot >> 3] >> (spot & 7) & 1)
            for part in by_size(batch.take(pa.array(hit)), "text", 2_000_000):
                sets = [shingles(t, words) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "print", "items"])

    return run


#: Bits of the bitmap of wanted ids at most (64 MB); beyond, it only lets more rows through.
_MOST_BITS = 1 << 29


def _spot(bits: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(5)), F.lit(bits))


def _full_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(class, items) of the classes in `ids` (class, print), from a second scan of the texts."""
    spark = docs.sparkSession
    bits = 1 << 15
    count = ids.count()
    while bits < min(_MOST_BITS, 16 * count):
        bits *= 2
    # Native bitmaps of 32,768 bits each: a few KB to 64 MB in all.
    spots = ids.select(F.col("class").alias("id")).select(_spot(bits).alias("spot"))
    found = spots.groupBy((F.bitmap_bucket_number(F.col("spot") + 1)).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("spot") + 1)).alias("map"))
    whole = np.zeros(bits // 8, np.uint8)
    for r in found.toLocalIterator():
        at = (r["bucket"] - 1) * 4096
        whole[at : at + 4096] = np.frombuffer(bytes(r["map"]), np.uint8)
    wanted = spark.sparkContext.broadcast(whole.tobytes())
    rebuilt = docs.withColumn("spot", _spot(bits)).mapInArrow(_sets(words, wanted), "id long, print binary, items binary")
    # Of rows that repeat an id with the same text, one will do.
    return ids.join(rebuilt, F.col("class") == F.col("id")).where(ids["print"] == rebuilt["print"]).select("class", "items").dropDuplicates(["class"])


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    short, long_ = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(short) < percent * len(long_):
        return False
    at = np.searchsorted(long_, short)
    shared = int(np.count_nonzero(long_[np.minimum(at, len(long_) - 1)] == short)) if len(long_) else 0
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def least_agreement(percent: int) -> int:
    p = percent / 100
    return max(1, int(np.floor(SLOTS * p - DEVIATIONS * np.sqrt(SLOTS * p * (1 - p)))))


def _hopeful(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs (a, b) whose sizes and signatures allow the threshold."""
    least = least_agreement(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, SLOTS) for c in ("sign_a", "sign_b"))
            n, m = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            ok = ((x == y).sum(1) >= least) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


def _verified(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [jaccard_at_least(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(batch.column("items_a"), batch.column("items_b"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


class _Union:
    """Union-find over any integers; the least member stands for its group."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (p := self.up.get(root, root)) != root:
            root = p
        while x != root:
            self.up[x], x = root, self.up.get(x, x)
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.up.setdefault(min(a, b), min(a, b))
        return True


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a part, replaced by one edge from each node to its group's least node."""
    groups = _Union()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            groups.join(a, b)
    nodes = [x for x in groups.up if groups.find(x) != x]
    for at in range(0, len(nodes), 50_000):
        part = nodes[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([groups.find(x) for x in part], pa.int64())], names=["a", "b"])


def components(edges: DataFrame, part: int = PART) -> DataFrame:
    """(node, component): each node of the edges (a, b) and the least node that it is connected to.

    Parts of bounded size are contracted by union-find. With one part that is all; otherwise large-star and small-star
    rounds follow until nothing changes, each checkpointed. No task or driver ever holds all edges.
    """
    edges = materialise(edges)
    parts = -(-edges.count() // part)
    edges = materialise(edges.repartition(max(1, parts)).mapInArrow(_forest, "a long, b long"))
    before = None
    while parts > 1:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where(F.col("a") != F.col("b")).distinct()
        least = materialise(down.groupBy("a").agg(F.min("b").alias("m")))
        small = down.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialise(small.unionByName(least.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    star = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return star.unionByName(star.select(F.col("component").alias("node"), "component").distinct())


#: The columns that name a pair of blocks, and what a class brings to it: `part` is 0 for the first block, 1 for the second and 2 for a block that meets itself.
_MEETING = "band long, kind int, x int, y int"
_MEMBER = "part int, slot int, class long, component long, n long, sign binary"


def _meetings(names: list[str], each: Callable[[dict[str, pa.Array]], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Call `each` for every pair of blocks, whose rows stand together in a partition but may go over the end of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            last = [batch.column(c)[-1] for c in ("band", "kind", "x", "y")] if batch.num_rows else None
            if last is None or [held[0].column(c)[0] for c in ("band", "kind", "x", "y")] == last:
                continue
            *done, rest = _cut(held)
            held = [rest]
            yield from (found for t in done if (found := each({n: t.column(n) for n in names})) is not None)
        if held and sum(b.num_rows for b in held):
            yield from (found for t in _cut(held) if (found := each({n: t.column(n) for n in names})) is not None)

    return run


def _cut(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    whole = pa.Table.from_batches(batches).combine_chunks().to_batches(max_chunksize=None)
    whole = whole[0] if len(whole) == 1 else pa.concat_batches(whole)
    keys = [whole.column(c).to_numpy() for c in ("band", "kind", "x", "y")]
    change = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    edges = np.concatenate([[0], np.flatnonzero(change) + 1, [whole.num_rows]])
    return [whole.slice(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _hopeful_pairs(t: dict[str, pa.Array], percent: int) -> Iterator[tuple[int, int]]:
    """Rows of a pair of blocks whose sizes and signatures allow the threshold, which lie in different components and share no earlier key."""
    least = least_agreement(percent)
    part, comp, n, slot = (t[c].to_numpy() for c in ("part", "component", "n", "slot"))
    sign = np.frombuffer(b"".join(t["sign"].to_pylist()), np.uint32).reshape(-1, SLOTS)
    right = np.flatnonzero(part >= 1)
    for i in np.flatnonzero(part != 1).tolist():
        others = right[(comp[right] != comp[i]) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))]
        others = others[(part[others] == 1) | (others > i)]
        same = sign[others] == sign[i]
        some = same.sum(1) >= least
        first = same[some].reshape(-1, BANDS, ROWS).all(2).argmax(1)
        for j in others[some][first == slot[i]].tolist():
            yield i, j


def _involved(percent: int) -> Callable:
    """The classes of a pair of blocks that have a hopeful partner there."""

    def each(t: dict[str, pa.Array]) -> pa.RecordBatch | None:
        rows = np.unique([x for pair in _hopeful_pairs(t, percent) for x in pair]).astype(np.int64)
        names = ["band", "kind", "x", "y", "part", "slot", "class", "component", "n", "sign"]
        return pa.RecordBatch.from_arrays([t[c].take(pa.array(rows)) for c in names], names=names) if len(rows) else None

    return each


def _linked(percent: int) -> Callable:
    """The links in a pair of blocks that join different components."""

    def each(t: dict[str, pa.Array]) -> pa.RecordBatch | None:
        ids, comp = (t[c].to_numpy() for c in ("class", "component"))
        items, groups, out = t["items"], _Union(), []
        for i, j in _hopeful_pairs(t, percent):
            a, b = int(comp[i]), int(comp[j])
            if groups.find(a) != groups.find(b) and jaccard_at_least(np.frombuffer(items[i].as_py(), np.uint64), np.frombuffer(items[j].as_py(), np.uint64), percent):
                groups.join(a, b)
                out.append((int(ids[i]), int(ids[j])))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"]) if out else None

    return each


def near_duplicates(docs: DataFrame, key: str, text: str, percent: int = 85, words: int = WORDS) -> DataFrame:
    """(key, n_shingles, component, kept) of every row: linked are rows whose shingle sets
    have 100 * intersection >= percent * union, a component is named by its least key, and `kept` marks that row.

    Empty and null texts have no shingles and stand alone. A null key belongs to no group: its component is null
    and it isn't kept. Keys should be unique; rows that repeat one with the same text are one member,
    each marked alike. Keys that are whole numbers come back as longs; with keys of another type rows are numbered first, which
    writes the texts once. Other columns aren't read. An empty table gives an empty result.
    """
    if not whole_number(docs.schema[key].dataType):
        return _by_number(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), key, percent, words)
    spark = docs.sparkSession
    short_batches(spark)
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    rows = materialise(source.mapInArrow(_scan(words), "id long, n long, print binary, sign binary"))
    real = rows.where((F.col("n") > 0) & F.col("id").isNotNull())
    prints = materialise(real.groupBy("print").agg(F.min("id").alias("class"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sign").alias("sign")))
    # Bands: the keys that several classes share, and the pivot of each.
    keys = F.array(*(F.xxhash64(F.lit(i), F.substring("sign", 4 * ROWS * i + 1, 4 * ROWS)) for i in range(BANDS)))
    banded = prints.select("class", F.least(F.col("copies"), F.lit(1 << 20)).alias("copies"), F.posexplode(keys).alias("slot", "band"))
    order = F.col("copies") * (1 << 40) + F.shiftrightunsigned(F.xxhash64("class"), 24)
    # Small tables that hot keys are joined with are materialised, so that skewed joins can be split.
    shared = materialise(banded.groupBy("band").agg(F.max_by("class", order).alias("pivot"), F.count("*").alias("members")).where(F.col("members") > 1))
    members = materialise(banded.join(shared, "band").select("band", "slot", "class", "pivot"))
    stars = members.where(F.col("class") != F.col("pivot")).select(F.col("class").alias("a"), F.col("pivot").alias("b")).distinct()
    side = lambda name: prints.select(F.col("class").alias(name), F.col("n").alias(f"n_{name}"), F.col("sign").alias(f"sign_{name}"))
    hopeful = materialise(stars.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "sign_a", "sign_b").mapInArrow(_hopeful(percent), "a long, b long"))
    links = components(_verify(source, prints, hopeful, percent, words))
    # Keys whose members still lie apart.
    placed = members.join(links, members["class"] == links["node"], "left").select("band", "slot", "class", F.coalesce("component", "class").alias("component"))
    placed = materialise(placed)
    apart = materialise(placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where(F.col("low") < F.col("high")))
    open_ = materialise(placed.join(apart, "band").select("band", "slot", "class", "component"))
    grouped = links
    if not open_.isEmpty():
        known = links.select(F.col("node").alias("a"), F.col("component").alias("b")).where(F.col("a") != F.col("b"))
        grouped = components(known.unionByName(_between(source, prints, open_, percent, words)))
    final = prints.join(grouped, prints["class"] == grouped["node"], "left").select("print", F.coalesce("component", "class").alias("component"))
    out = rows.select("id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("print")).alias("print")).join(final, "print", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _verify(source: DataFrame, prints: DataFrame, pairs: DataFrame, percent: int, words: int) -> DataFrame:
    ids = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    sets = materialise(_full_sets(source, ids.join(prints.select("class", "print"), "class"), words))
    side = lambda name: sets.select(F.col("class").alias(name), F.col("items").alias(f"items_{name}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "items_a", "items_b").mapInArrow(_verified(percent), "a long, b long")


def _by_number(docs: DataFrame, key: str, percent: int, words: int) -> DataFrame:
    rows = materialise(docs.withColumn("id", F.when(F.col("key").isNotNull(), F.monotonically_increasing_id())))
    found = near_duplicates(rows, "id", "text", percent, words).withColumnRenamed("component", "group")
    named = materialise(found.join(rows.select("id", "key"), "id", "left"))
    least = named.where(F.col("group").isNotNull()).groupBy("group").agg(F.min("key").alias("component"))
    out = named.join(least, "group", "left")
    return out.select(F.col("key").alias(key), "n_shingles", "component", F.coalesce(F.col("key") == F.col("component"), F.lit(False)).alias("kept"))


def _between(source: DataFrame, prints: DataFrame, open_: DataFrame, percent: int, words: int) -> DataFrame:
    """Links between classes that share an open key but no component yet; `open_` has a row (band, slot, class, component) for each class of such a key."""
    # Members of a key's largest component need not meet each other: they only meet the rest.
    shares = materialise(open_.groupBy("band", "component").agg(F.count("*").alias("size")))
    sizes = materialise(shares.groupBy("band").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.max("size").alias("mains"), F.sum("size").alias("size")))
    many = lambda c: F.ceil(c / BLOCK).cast("int")
    dealt = open_.join(sizes, "band").withColumn("in_main", F.col("component") == F.col("main")).withColumn("main_blocks", many(F.col("mains"))).withColumn("rest_blocks", many(F.col("size") - F.col("mains")))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("class"), F.when(F.col("in_main"), F.col("main_blocks")).otherwise(F.col("rest_blocks"))).cast("int"))
    block, numbers = F.col("block"), lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    meeting = lambda kind, x, y, part: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), part.cast("int").alias("part"))
    with_rest = F.transform(numbers("rest_blocks"), lambda o: meeting(0, F.least(block, o), F.greatest(block, o), F.when(o == block, 2).when(block < o, 0).otherwise(1)))
    with_main = F.transform(numbers("main_blocks"), lambda o: meeting(1, block, o, F.lit(0)))
    as_main = F.transform(numbers("rest_blocks"), lambda o: meeting(1, o, block, F.lit(1)))
    meeting_key = ["band", "kind", "x", "y"]
    signed = dealt.join(prints.select("class", "n", "sign"), "class")
    met = signed.withColumn("at", F.explode(F.when(F.col("in_main"), as_main).otherwise(F.concat(with_rest, with_main))))
    met = met.select("band", "at.kind", "at.x", "at.y", "at.part", "slot", "class", "component", "n", "sign")
    together = lambda rows: rows.repartition(*meeting_key).sortWithinPartitions(*meeting_key, "component", "class")
    names = [x.split()[0] for x in f"{_MEETING}, {_MEMBER}".split(", ")]
    hopeful = materialise(together(met).mapInArrow(_meetings(names, _involved(percent)), f"{_MEETING}, {_MEMBER}"))
    sets = _full_sets(source, hopeful.select("class").distinct().join(prints.select("class", "print"), "class"), words)
    return together(hopeful.join(sets, "class")).select(*names, "items").mapInArrow(_meetings([*names, "items"], _linked(percent)), "a long, b long")


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", 85)
    return found.withColumnRenamed("component", "component_id")

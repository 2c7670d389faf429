"""Near-duplicate removal by an LSH forest over MinHash signatures.

A document is its set of distinct word shingles. Documents of one set are one class from the start. Each class gets N_HASHES MinHash
values, 16 bits of each, and a sketch of one bit a value. A tree is an order of these values; the forest is the sorted list of all
labels (a tree's number and its values), dealt out by range. In each tree, the NEIGHBOURS next classes with a common prefix of
MIN_DEPTH values or more are candidates. The best candidate of each class, and the smallest of its close ones, are verified on the
full sets and join components.

Regions (labels with one prefix) that still hold several components are then compared as a whole: every pair of different components in
them, without a cap. The depth adapts to the region: where it has CROWD classes or fewer, MIN_DEPTH values in one of TREES trees; the
classes of a more crowded one go DEEP values down in DEEP_TREES trees, so many that about as few links are missed. Within a region, only
classes outside its largest component ask, in blocks that are bounded in classes and in shingles. A pair is dropped if the sketches or the
signatures are far apart, left to the first tree that has it, and else verified on the full sets. A block gives only the links that connect something.

Sketches and signatures lose a pair at the threshold with a chance under 1e-6; a pair at similarity 0.8 meets in no region with a chance
of 6e-7 (MIN_DEPTH) or 4e-7 (DEEP).

Texts without words have the empty set: no links, a component of their own. Rows without id get no component and are kept. Rows
that repeat an id count as one document, linked with whatever one of its texts is linked with. Ties: the smallest id stands for a component.
Ids may be of any type that sorts. An empty table gives an empty result; extra columns are ignored (and kept by `deduplicate`).
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import discard, map_rows, materialise, maybe_among, release, spread, without_ids

TREES = 20
DEPTH = 8
N_HASHES = TREES * DEPTH
MIN_DEPTH = 3
DEEP = 8
DEEP_TREES = 80
NEIGHBOURS = 4
#: Classes of a region that is compared at MIN_DEPTH, at most.
CROWD = 4096
#: Classes, and shingles of all classes together, in one block.
BLOCK = 512
BLOCK_SHINGLES = 1 << 20
THRESHOLD = (80, 100)
#: Sketch bits that must agree: at similarity s, (1 + s) / 2 of them do; at 0.8, 90 % with a deviation of 2.4 %.
MIN_AGREE = round(0.78 * N_HASHES)
#: Values that must agree: at 0.8, 80 % with a deviation of 3.2 %.
MIN_EQUAL = round(0.64 * N_HASHES)
SEED = 20240229


# --- sets and signatures ----------------------------------------------------------------------------------------------


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_A = _odd(N_HASHES, SEED)[:, None].astype(np.uint32) | np.uint32(1)
_B = (_odd(N_HASHES, SEED + 1)[:, None] >> np.uint64(32)).astype(np.uint32)
_WORD = _odd(16, SEED + 2)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles (of the whole sequence where there are fewer words)."""
    import xxhash

    # bytes know ASCII only: A-Z are lowered, \x20 and \x09-\x0D separate
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known: dict[bytes, int] = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(h) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)], np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = _mix(out * _WORD[i] + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values of a set that isn't empty: of each permutation x -> a x + b of the shingles' upper 32 bits, the least."""
    low, upper = np.full(N_HASHES, 0xFFFFFFFF, np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    for s in range(0, len(upper), 1024):
        low = np.minimum(low, (upper[None, s : s + 1024] * _A + _B).min(axis=1))
    return low


def _orders() -> np.ndarray:
    """The values' places in each tree: the first TREES trees share none, each further round of trees deals all out anew."""
    rounds = [np.arange(N_HASHES), *(np.random.default_rng(SEED + r).permutation(N_HASHES) for r in range(3, 3 + DEEP_TREES // TREES - 1))]
    return np.concatenate([r.reshape(TREES, DEPTH) for r in rounds])


ORDERS = _orders()


def wide_and_sketch(sig: np.ndarray) -> tuple[np.ndarray, bytes]:
    """16 bits of each value, big-endian, and the sketch (one bit of each value)."""
    mixed = sig * np.uint32(2654435761)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(2246822519)
    return (mixed >> np.uint32(16)).astype(">u2"), np.packbits(((mixed >> np.uint32(8)) & np.uint32(1)).astype(np.uint8)).tobytes()


def tree_labels(wide: np.ndarray, trees: int, depth: int, first: int = 0) -> list[bytes]:
    """The number (from `first` on) and the leading values of each tree."""
    return [bytes([first + t]) + wide[ORDERS[t, :depth]].tobytes() for t in range(trees)]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return THRESHOLD[1] * both >= THRESHOLD[0] * (len(a) + len(b) - both)


def sketches(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """doc, t (hash of the text), n (set size), fp (identity of the set; null for the empty set), sig."""

    def make():
        def f(key, t, text):
            s = shingle_set(text, k)
            if not len(s):
                return [(key, t, 0, None, None)]
            return [(key, t, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), signature(s).tobytes())]

        return f

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(spread(docs.select(F.col(id_col), F.xxhash64(text_col), F.col(text_col))), make, f"doc {kind}, t bigint, n int, fp binary, sig binary")


def forest(classes: DataFrame) -> DataFrame:
    """key, cid, n, sketch: TREES rows for each class."""

    def make():
        def f(cid, n, sig):
            wide, sketch = wide_and_sketch(np.frombuffer(sig, np.uint32))
            return [(key, cid, n, sketch) for key in tree_labels(wide, TREES, DEPTH)]

        return f

    return map_rows(classes.select("cid", "n", "sig"), make, "key binary, cid bigint, n int, sketch binary", chunk=4000)


#: Tree numbers of deep regions start here.
DEEP_FIRST = 100


def regions(classes: DataFrame, deep: bool = False) -> DataFrame:
    """prefix, cid, comp, n: the regions of each class (cid, comp, n, sig)."""
    trees, depth, first = (DEEP_TREES, DEEP, DEEP_FIRST) if deep else (TREES, MIN_DEPTH, 0)

    def make():
        def f(cid, comp, n, sig):
            return [(p, cid, comp, n) for p in tree_labels(wide_and_sketch(np.frombuffer(sig, np.uint32))[0], trees, depth, first)]

        return f

    return map_rows(classes.select("cid", "comp", "n", "sig"), make, "prefix binary, cid bigint, comp bigint, n int", chunk=4000)


# --- candidates ----------------------------------------------------------------------------------------------------------


def _agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return N_HASHES - np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def _fits(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can reach the threshold."""
    return THRESHOLD[1] * np.minimum(n, m) >= THRESHOLD[0] * np.maximum(n, m)


PREFIX_BYTES = 1 + 2 * MIN_DEPTH


def _columns(batch):
    keys = np.array([k[:PREFIX_BYTES] for k in batch.column(0).to_pylist()], dtype=f"V{PREFIX_BYTES}")
    sketch = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, N_HASHES // 8)
    return keys, batch.column(1).to_numpy(), batch.column(2).to_numpy(), sketch


def _walk(batches):
    """Pairs of near neighbours in a sorted stretch of the forest. (What stands on two sides of a cut is met among the open regions.)"""
    import pyarrow as pa

    tail = None
    for batch in batches:
        old = 0 if tail is None else tail.num_rows
        joined = batch if tail is None else pa.Table.from_batches([tail, batch]).combine_chunks().to_batches()[0]
        keys, doc, n, sketch = _columns(joined)
        a, b, agree = [], [], []
        for s in range(1, NEIGHBOURS + 1):
            lo = max(0, old - s)
            if len(doc) - s <= lo:
                break
            i = np.flatnonzero(keys[lo : len(doc) - s] == keys[lo + s :]) + lo
            i = i[(i + s >= old) & (doc[i] != doc[i + s]) & _fits(n[i], n[i + s])]
            close = _agree(sketch[i], sketch[i + s])
            ok = close >= MIN_AGREE
            a.append(np.minimum(doc[i], doc[i + s])[ok])
            b.append(np.maximum(doc[i], doc[i + s])[ok])
            agree.append(close[ok])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64()), pa.array(np.concatenate(agree), pa.int32())], names=["a", "b", "agree"])
        tail = joined.slice(max(0, joined.num_rows - NEIGHBOURS))


def neighbours(classes: DataFrame) -> DataFrame:
    """a, b, agree: pairs of classes (a < b) that stand near each other in some tree."""
    ordered = forest(classes).repartitionByRange("key", "cid").sortWithinPartitions("key", "cid")
    return ordered.mapInArrow(_walk, "a bigint, b bigint, agree int").groupBy("a", "b").agg(F.max("agree").alias("agree"))


def _groups(batches, keys: int):
    """Rows of each run of equal first columns, from sorted batches."""
    key, rows = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield key, rows


class _Union:
    """Components of what one task has seen; the smallest member stands for each."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


ASKS, ANSWERS = 1, 2


def _alike(rows: list[tuple], tree: int):
    """(i, indices of the rows that it asks and that may be linked to it) of a block: other component, fitting size, near sketch and signature, first met in this tree.

    rows: role, cid, comp, n, sketch, wide.
    """
    depth, tree = (DEEP, tree - DEEP_FIRST) if tree >= DEEP_FIRST else (MIN_DEPTH, tree)
    role, cid, comp, n = (np.array([r[c] for r in rows]) for c in range(4))
    sketch = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), -1)
    wide = np.frombuffer(b"".join(r[5] for r in rows), np.uint16).reshape(len(rows), N_HASHES)
    answers = np.flatnonzero(role & ANSWERS)
    for i in np.flatnonzero(role & ASKS).tolist():
        # of two that ask each other, the one of the smaller number does
        other = answers[(comp[answers] != comp[i]) & ((cid[answers] > cid[i]) | ((role[answers] & MINOR) == 0))]
        other = other[_fits(n[other], n[i])]
        other = other[_agree(sketch[other], sketch[i]) >= MIN_AGREE]
        if len(other):
            equal = wide[other] == wide[i]
            enough = equal.sum(axis=1) >= MIN_EQUAL
            if tree:
                enough &= ~equal[:, ORDERS[:tree, :depth]].all(axis=2).any(axis=1)
            other = other[enough]
        if len(other):
            yield i, other


#: Role of a class outside its region's largest component.
MINOR = 4


def _open(forest: DataFrame) -> DataFrame:
    """prefix, m of the regions (prefix, cid, comp, n) with several components."""
    return forest.groupBy("prefix").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).where("lo < hi").select("prefix", "m")


def _dealt(members: DataFrame) -> DataFrame:
    """Members (prefix, cid, comp, n) of open regions in blocks: prefix, b1, b2, role, cid.

    Askers (all but the largest component) go in blocks b1, all classes in blocks b2; a class goes to each pair of blocks it has a part in.
    """
    sizes = members.groupBy("prefix", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    per = sizes.groupBy("prefix").agg(F.sum("c").alias("m"), F.sum("w").alias("w"), F.max(F.struct("c", "comp", "w")).alias("major"))
    count = lambda c, w: F.ceil(F.greatest(c / BLOCK, w / BLOCK_SHINGLES)).cast("int")
    per = per.select("prefix", F.col("major.comp").alias("major"), count(F.col("m") - F.col("major.c"), F.col("w") - F.col("major.w")).alias("n1"), count(F.col("m"), F.col("w")).alias("n2"))
    minor = F.col("comp") != F.col("major")
    b1, b2 = (F.pmod(F.xxhash64(F.lit(x), "cid"), F.col(x)).cast("int") for x in ("n1", "n2"))
    rank = F.when(minor, F.lit(MINOR)).otherwise(F.lit(0))
    asks = F.when(minor, F.transform(F.sequence(F.lit(0), F.col("n2") - 1), lambda j: F.struct(b1.alias("b1"), j.alias("b2"), F.when(j == b2, F.lit(ASKS + ANSWERS)).otherwise(F.lit(ASKS)).alias("role")))).otherwise(F.array())
    answers = F.transform(F.sequence(F.lit(0), F.col("n1") - 1), lambda i: F.struct(i.alias("b1"), b2.alias("b2"), F.lit(ANSWERS).alias("role")))
    answers = F.filter(answers, lambda x: ~(minor & (x["b1"] == b1)))  # there it asks and answers
    return members.join(per, "prefix").select("prefix", "cid", "comp", "n", rank.alias("_rank"), F.explode(F.concat(asks, answers)).alias("x")).select("prefix", "x.b1", "x.b2", (F.col("x.role") + F.col("_rank")).alias("role"), "cid")


def _with_values(dealt: DataFrame, labelled: DataFrame) -> DataFrame:
    """Dealt rows with comp, n, sketch and wide of their classes."""

    def make():
        def f(cid, comp, n, sig):
            wide, sketch = wide_and_sketch(np.frombuffer(sig, np.uint32))
            return [(cid, comp, n, sketch, wide.tobytes())]

        return f

    values = map_rows(labelled.join(dealt.select("cid").distinct(), "cid", "left_semi").select("cid", "comp", "n", "sig"), make, "cid bigint, comp bigint, n int, sketch binary, wide binary")
    return dealt.join(values.hint("merge"), "cid").select("prefix", "b1", "b2", "role", "cid", "comp", "n", "sketch", "wide")


def open_links(classes: DataFrame, comps: DataFrame, source: DataFrame, k: int) -> DataFrame:
    """a, b: components that a link between two of their classes connects; enough to connect all that are linked. source: doc, t, text."""
    import pyarrow as pa

    labelled = classes.select("cid", "n", "sig").join(comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    shallow = regions(labelled)
    open_shallow = materialise(_open(shallow), "open", narrow=True)
    members = shallow.join(open_shallow.where(F.col("m") <= CROWD), "prefix").drop("m")
    large = open_shallow.where(F.col("m") > CROWD)
    if not large.isEmpty():
        crowded = shallow.join(large, "prefix").select("cid").distinct()
        deep = materialise(regions(labelled.join(crowded, "cid", "left_semi"), deep=True), "deep", narrow=True)
        members = members.unionByName(deep.join(_open(deep), "prefix").drop("m"))
    members = materialise(members, "members", narrow=True)
    dealt = materialise(_dealt(members), "dealt", narrow=True)
    columns = ["prefix", "b1", "b2", "role", "cid", "comp", "n", "sketch", "wide"]
    sorted_ = lambda df: df.repartition("prefix", "b1", "b2").sortWithinPartitions("prefix", "b1", "b2")
    kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]

    def near(batches):
        for (prefix, b1, b2), rows in _groups(batches, 3):
            wanted = {x for i, other in _alike(rows, prefix[0]) for x in (i, *other.tolist())}
            if wanted:
                kept = [(prefix, b1, b2, *rows[x]) for x in sorted(wanted)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), kinds)], names=columns)
        release()

    alike = materialise(sorted_(_with_values(dealt, labelled)).mapInArrow(near, "prefix binary, b1 int, b2 int, role int, cid bigint, comp bigint, n int, sketch binary, wide binary"), "alike")
    texts = texts_of(source, classes, alike.select("cid").distinct())
    told = sorted_(alike.join(texts.hint("merge"), "cid").select(*columns, "text"))

    def verified(batches):
        for (prefix, _, _), rows in _groups(batches, 3):
            sets: dict[int, np.ndarray] = {}
            joined, found, held = _Union(), [], 0

            def set_of(x):
                nonlocal held
                if x not in sets:
                    if held > BLOCK_SHINGLES:
                        sets.clear()
                        held = 0
                    sets[x] = shingle_set(rows[x][6], k)
                    held += len(sets[x])
                return sets[x]

            for i, other in _alike([r[:6] for r in rows], prefix[0]):
                for x in other.tolist():
                    a, b = rows[i][2], rows[x][2]
                    if joined.find(a) != joined.find(b) and similar(set_of(i), set_of(x)):
                        joined.join(a, b)
                        found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])
        release()

    links = materialise(told.mapInArrow(verified, "a bigint, b bigint"), "links")
    discard(open_shallow, members, dealt, alike)
    return links


# --- verification and components ---------------------------------------------------------------------------------------------


def texts_of(source: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """cid, text of the wanted classes. Most other texts are dropped before they are shuffled.

    Here and wherever texts or signatures are joined they are merged, never broadcast: Spark would go by their compressed size, which bounds nothing.
    """
    keys = classes.select("cid", "doc", "t").join(wanted, "cid", "left_semi")
    told = maybe_among(source, keys, ["doc", "t"]).groupBy("doc", "t").agg(F.first("text").alias("text"))
    return told.hint("merge").join(keys, ["doc", "t"]).select("cid", "text")


def verify(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """The pairs whose full sets reach the threshold. Both are written tables, so that a class with very many pairs can be split among tasks."""

    def make():
        last: dict = {}

        def f(a, b, s, t):
            if a not in last:
                last.clear()
                last[a] = shingle_set(s, k)
            return [(a, b)] if similar(last[a], shingle_set(t, k)) else []

        return f

    first = pairs.select("a", "b").join(texts.select(F.col("cid").alias("a"), F.col("text").alias("s")).hint("merge"), "a")
    both = first.join(texts.select(F.col("cid").alias("b"), F.col("text").alias("t")).hint("merge"), "b").select("a", "b", "s", "t")
    return map_rows(both, make, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """cid, comp: the smallest number that each node of the graph can reach. Alternates large-star and small-star steps.

    What a join needs is written first, so that the edges of one node can be split among tasks.
    """

    def contract(batches):
        import pyarrow as pa

        seen = _Union()
        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns)):
                seen.join(a, b)
        stars = [(x, seen.find(x)) for x in list(seen.up)]
        yield pa.RecordBatch.from_arrays([pa.array([s[i] for s in stars], pa.int64()) for i in (0, 1)], names=["u", "v"])

    # each task first joins what its own edges connect; that leaves short paths
    now = materialise(edges.select("a", "b").mapInArrow(contract, "u bigint, v bigint").where("u > v").distinct(), "edges", narrow=True)
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low", narrow=True)
        large = materialise(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large", narrow=True)
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "least", narrow=True)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        before, now = now, materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "star", narrow=True)
        discard(before, low, large, least)
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == seen:
            break
        seen = mark
    roots = now.select(F.col("v").alias("cid"), F.col("v").alias("comp")).distinct()
    return now.select(F.col("u").alias("cid"), F.col("v").alias("comp")).unionByName(roots)


def _same_id(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: classes that one id connects, where rows repeat an id with another text."""
    rows = sets.where("fp is not null and doc is not null")
    again = rows.groupBy("doc").agg(F.min(F.xxhash64("fp")).alias("lo"), F.max(F.xxhash64("fp")).alias("hi")).where("lo < hi").select("doc")
    held = materialise(rows.select("doc", "fp").join(again, "doc", "left_semi").distinct().join(classes.select("fp", "cid"), "fp").select("doc", "cid"), "again", narrow=True)
    least = materialise(held.groupBy("doc").agg(F.min("cid").alias("a")), "least", narrow=True)
    return materialise(held.join(least, "doc").where("cid > a").select("a", F.col("cid").alias("b")), "same", narrow=True)


def near_duplicates(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept for every row."""
    sets = materialise(sketches(docs, k, id_col, text_col), "sets")
    first = sets.where("fp is not null and doc is not null").groupBy("fp").agg(F.min(F.struct("doc", "t", "n", "sig")).alias("x"))
    classes = materialise(first.select("fp", "x.*", F.monotonically_increasing_id().alias("cid")), "classes")
    pairs = materialise(neighbours(classes), "pairs", narrow=True)

    # for each class its closest neighbour, and the smallest of those that are close
    sides = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "agree"))
    best = sides.groupBy("a").agg(F.max(F.struct("agree", (-F.col("b")).alias("b"))).alias("x"), F.min(F.when(F.col("agree") >= round(0.9 * N_HASHES), F.col("b"))).alias("least"))
    early = materialise(best.select("a", F.explode(F.array_compact(F.array(-F.col("x.b"), "least"))).alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "early", narrow=True)

    source = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    ends = early.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    texts = materialise(texts_of(source, classes, ends), "texts")
    near, same = materialise(verify(early, texts, k), "links"), _same_id(sets, classes)
    comps = materialise(components(near.unionByName(same)), "comps", narrow=True)
    discard(pairs, early, texts, near, same)

    # links between components: all that counts is what they connect
    links = open_links(classes, comps, source, k)
    if not links.isEmpty():
        before, above = comps, materialise(components(links).select(F.col("cid").alias("comp"), F.col("comp").alias("top")), "above", narrow=True)
        alone = links.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(before, "cid", "left_anti").select("cid", F.col("cid").alias("comp"))
        comps = materialise(before.unionByName(alone).join(above, "comp", "left").select("cid", F.coalesce("top", "comp").alias("comp")), "comps", narrow=True)
        discard(before, above)

    # the smallest id of each component, then of each set; written before they are joined, so that a set or component of very many rows can be split among tasks
    labelled = materialise(classes.select("cid", "fp", "doc").join(comps, "cid", "left").select("fp", "doc", F.coalesce("comp", "cid").alias("comp")), "labelled", narrow=True)
    least = materialise(labelled.groupBy("comp").agg(F.min("doc").alias("least")), "least", narrow=True)
    reps = materialise(labelled.join(least, "comp").select("fp", "least"), "reps", narrow=True)
    discard(links, comps, labelled, least, classes)
    rows = sets.select("doc", "n", "fp")
    out = rows.where("fp is not null").join(reps, "fp", "left").unionByName(rows.where("fp is null").withColumn("least", F.lit(None).cast(rows.schema["doc"].dataType)))
    component = F.when(F.col("doc").isNotNull(), F.coalesce("least", "doc"))
    return out.select(F.col("doc").alias(id_col), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with all columns; rows without id stay."""
    gone = materialise(near_duplicates(docs, k, id_col, text_col).where("not kept").select(id_col).distinct(), "gone", narrow=True)
    return without_ids(docs, gone, id_col)

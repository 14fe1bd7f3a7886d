"""MinHash near-duplicates by a multi-index Hamming join.

Every document's set of word shingles gets a signature of K b-bit minwise values. Two signatures are near if at most T values
differ. By the pigeonhole principle, a signature cut into M chunks with 2 M > T has a chunk with at most one difference for
every near pair, so the keys (chunk with one of its places blanked), one for each choice of the place, bring every near pair
together: no pair within the threshold is missed. What shares a key is a candidate.

Of a candidate pair, signatures are held against the threshold, and two more tests reject pairs that cannot be links: set sizes
too far apart, and more differing bits in the sets' odd sketches (one parity bit for each class of hashes; Mitzenmacher, Pagh
and Pham, 2014) than a link's symmetric difference has elements. What passes is confirmed on the full shingle sets.

Documents with equal sets are one class, and buckets with equal members are one bucket. A bucket's members are not compared with
each other at first, but with a pivot: the member that shares buckets with most others, so that a group of near copies has one
pivot in all its buckets, most likely the text that they were made from. While that finds many links, the members outside a
bucket's largest component get a pivot again. Only then are members of different components compared, in tiles of bounded size.
So a large group of near copies is joined by a linear number of links, and yet no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import forget, free, row_keys, stored

#: Words kept in a task's word -> hash memory before it is emptied.
MEMORY = 100_000
#: Texts taken out of an Arrow batch at a time.
SLICE = 256
#: A chunk is a long of four places: the bits of a value, and of its lane, of which the highest stays 0.
PLACES, VALUE, LANE = 4, 14, 15
#: Members of a bucket on either side of a tile, at most about.
TILE = 512
#: Edges of a graph whose components are found in one partition, at most; some 3 MB. A larger graph is shuffled in each round.
FEW = 50_000


@dataclass(frozen=True)
class Settings:
    """words: shingle length; percent: link if 100 * |A and B| >= percent * |A or B|.

    At similarity 0.8 a value differs with probability 0.2. Of 48 values more than 23 do in 3 of a million such pairs, and in
    fewer of more similar ones. 12 chunks of 4 values with one error each cover 23 differences. A value has 14 bits, so a key
    has 42 that tell, and texts that have nothing in common don't meet. again: pivots are chosen anew while they find at least
    this share of the members without one.
    """

    words: int = 4
    percent: int = 80
    chunks: int = 12
    distance: int = 23
    sketch_bits: int = 1024
    again: float = 0.05

    @property
    def values(self) -> int:
        return self.chunks * PLACES

    @property
    def signature(self) -> list[str]:
        """The columns of a signature, a long for each chunk."""
        return [f"s{k}" for k in range(self.chunks)]

    def seeds(self) -> tuple[np.ndarray, np.ndarray]:
        r = np.random.RandomState(20240229)
        draw = lambda: r.randint(0, 2**32, (self.values, 1), dtype=np.uint64).astype(np.uint32)
        return draw() | np.uint32(1), draw()


class _Words(dict):
    """word -> 64-bit hash."""

    def __missing__(self, w: bytes) -> int:
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


class Shingler:
    """UTF-8 text -> sorted distinct 64-bit hashes of its word shingles. bytes.lower() and bytes.split() know ASCII only, as is wanted."""

    def __init__(self, words: int):
        self.words, self.known = words, _Words()

    def __call__(self, text: bytes | None) -> np.ndarray:
        found = (text or b"").lower().split()
        if not found:
            return np.empty(0, np.uint64)
        if len(self.known) > MEMORY:
            self.known.clear()
        at = np.fromiter(map(self.known.__getitem__, found), np.uint64, len(found))
        n = min(self.words, len(at))
        out = np.full(len(at) - n + 1, n, np.uint64)
        for k in range(n):
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += at[k : len(at) - n + 1 + k]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
        out.sort()
        return out[np.concatenate([[True], out[1:] != out[:-1]])]


def _texts(column: pa.Array) -> Iterator[bytes | None]:
    """A column's values, of which few are copied out of it at once."""
    for k in range(0, len(column), SLICE):
        yield from column.slice(k, SLICE).to_pylist()


def minwise(sets: np.ndarray, seeds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The minwise values of a set of hashes, ``VALUE`` bits each, four to a long."""
    a, b = seeds
    x = (sets >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(x), 1024):  # a text's length doesn't show in the memory
        h = a * x[None, k : k + 1024]
        h += b
        np.minimum(least, h.min(axis=1), out=least)
    values = ((least * np.uint32(0x9E3779B1)) >> np.uint32(32 - VALUE)).astype(np.int64)
    return np.bitwise_or.reduce(values.reshape(-1, PLACES) << np.arange(0, PLACES * LANE, LANE), axis=1)


def odd_sketch(sets: np.ndarray, bits: int) -> np.ndarray:
    """One bit for each class of hashes: whether the set has an odd number of its members. Each element by which two sets differ changes one bit."""
    return np.packbits((np.bincount((sets & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8))


def signatures(docs: DataFrame, s: Settings, doc_id: str, text: str, others: list[str]) -> DataFrame:
    """(doc_id, r0, r1, n_shingles, node, odd, s0, s1, ...): r0 and r1 stand for a row's content, node is 128 bits of its set's hash, null without words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seeds = Shingler(s.words), s.seeds()
        for batch in batches:
            n, node, odd, sig = [], [], [], []
            for t in _texts(batch.column(3)):
                x = shingles(t)
                n.append(len(x))
                node.append(xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None)
                odd.append(odd_sketch(x, s.sketch_bits).tobytes() if len(x) else None)
                sig.append(minwise(x, seeds))
            sig = np.stack(sig) if sig else np.empty((0, s.chunks), np.int64)
            new = [pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(odd, pa.binary()), *[pa.array(c) for c in sig.T]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *new], ["doc_id", "r0", "r1", "n_shingles", "node", "odd", *s.signature])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), *row_keys(doc_id, text, *others), F.col(f"`{text}`").cast("binary").alias("text"))
    return rows.mapInArrow(work, f"doc_id {kind}, r0 long, r1 long, n_shingles long, node binary, odd binary, " + ", ".join(f"{c} long" for c in s.signature))


def keys(classes: DataFrame, s: Settings) -> DataFrame:
    """(key, node): each chunk of each signature with one place blanked, where the key's number stands instead."""
    each = []
    for k, chunk in enumerate(s.signature):
        for place in range(PLACES):
            at = place * LANE
            others = 2 ** (PLACES * LANE) - 1 - ((2**LANE - 1) << at)
            number = (k * PLACES + place + 1) << at
            each.append(F.col(chunk).bitwiseAND(F.lit(others)).bitwiseOR(F.lit(number).cast("long")))
    return classes.select(F.explode(F.array(*each)).alias("key"), "node")


def _told(classes: DataFrame, s: Settings, side: str) -> DataFrame:
    """The classes' columns that ``may_link`` asks for, under names that begin with the side's."""
    return classes.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("n_shingles", "odd", *s.signature)])


def _arrays(f: pd.DataFrame, s: Settings, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, odd sketches and signatures of a frame's rows."""
    odd = np.frombuffer(b"".join(f[f"{side}_odd"]), np.uint64).reshape(len(f), -1)
    return f[f"{side}_n_shingles"].to_numpy(np.int64), odd, f[[f"{side}_{c}" for c in s.signature]].to_numpy(np.int64)


def far_apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many values signatures differ: adding the lower bits sets a lane's highest bit where the lane of the difference isn't zero."""
    low, high = (np.int64(sum(v << (k * LANE) for k in range(PLACES))) for v in (2**VALUE - 1, 2**VALUE))
    return np.bitwise_count(((x ^ y) + low) & high).sum(axis=-1)


def may_link(s: Settings, x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...]) -> np.ndarray:
    """Whether pairs of rows of equal shape may be links: near by signature, and neither sizes nor odd sketches rule it out."""
    (n, p, u), (m, q, v) = x, y
    bits = np.bitwise_count(p ^ q).sum(axis=-1, dtype=np.int64)
    ok = (100 * n >= s.percent * m) & (100 * m >= s.percent * n) & (bits * (100 + s.percent) <= (n + m) * (100 - s.percent))
    return ok & (far_apart(u, v) <= s.distance)


def near(pairs: DataFrame, classes: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) that may be links. Many pairs may share b, a pivot."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield f.loc[may_link(s, _arrays(f, s, "a"), _arrays(f, s, "b")), ["a", "b"]]

    return pairs.join(_told(classes, s, "a"), "a").join(_told(classes, s, "b"), "b").mapInPandas(work, "a binary, b binary")


def sets_of(docs: DataFrame, nodes: DataFrame, classes: DataFrame, s: Settings, doc_id: str, text: str, others: list[str]) -> DataFrame:
    """(node, set) of the nodes: each class's text is fetched and shingled once. Rows that only share a row's 128 bits are told apart by their node."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(s.words)
        for batch in batches:
            node, sets = [], []
            for want, t in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), strict=True):
                x = shingles(t).tobytes()
                if xxhash.xxh3_128_digest(x) == want:
                    node.append(want)
                    sets.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(sets, pa.binary())], ["node", "set"])

    rows = docs.select(*row_keys(doc_id, text, *others), F.col(f"`{text}`").cast("binary").alias("text"))
    wanted = classes.join(nodes, "node", "left_semi").select("node", "row.*")
    return rows.join(wanted, ["r0", "r1"]).select("node", "text").mapInArrow(work, "node binary, set binary").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) that are links, on the full shingle sets."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keep = []
            for p, q in zip(f["x"], f["y"], strict=True):
                x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= s.percent * (len(x) + len(y) - both))
            yield f.loc[keep, ["a", "b"]]

    t = lambda c, name: sets.select(F.col("node").alias(c), F.col("set").alias(name))
    return pairs.join(t("a", "x"), "a").join(t("b", "y"), "b").mapInPandas(work, "a binary, b binary")


def forest(edges: DataFrame) -> DataFrame:
    """Of each partition's edges (a, b), a spanning forest: as many as it has nodes, at most, and the same components."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[bytes, bytes] = {}

        def root(x: bytes) -> bytes:
            while (y := parent.get(x, x)) != x:
                parent[x] = parent.get(y, y)
                x = y
            return x

        for f in frames:
            keep = []
            for a, b in zip(f["a"], f["b"], strict=True):
                x, y = root(bytes(a)), root(bytes(b))
                keep.append(x != y)
                parent[max(x, y)] = min(x, y)
            yield f.loc[keep, ["a", "b"]]

    return edges.select("a", "b").mapInPandas(work, "a binary, b binary")


def _few(edges: DataFrame, n: int) -> DataFrame:
    """The edges in one partition if they are ``FEW`` at most: their rounds then need no shuffle. More stay as they are dealt."""
    return edges.coalesce(1) if n <= FEW else edges


def components(edges: DataFrame, scratch: list[str]) -> DataFrame:
    """(node, comp): the smallest node of each node's component, by large-star and small-star rounds (Kiveris et al., 2014).

    A hub's edges are read once for its minimum, which is summed up before the shuffle, and joined to it again by a join that
    Spark may split; no task has to hold a hub's edges.
    """
    at = stored(forest(edges).select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v"), scratch)
    at = _few(at, at.count())
    mark = None
    while True:
        both = at.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("v"), F.col("v").alias("u"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("m").alias("v"), F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"))
        at = stored(small.where("u <> v").distinct(), scratch)
        new = at.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        at = _few(at, new[0])
        if new == mark:
            break
        mark = new
    return at.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(at.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _open(buckets: DataFrame, comps: DataFrame) -> DataFrame:
    """The members (key, node, weight, comp, most, size, minor) of the buckets that have several components; most is the largest of them, size the bucket's, minor how many members lie outside most."""
    named = buckets.where("n > 2").join(comps, "node", "left").select("key", "node", "weight", "n", F.coalesce("comp", "node").alias("comp"))
    sizes = named.groupBy("key", "comp").agg(F.count("*").alias("c"))
    split = sizes.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("m"), F.count("*").alias("k")).where("k > 1")
    return named.join(split.select("key", F.col("m.comp").alias("most"), F.col("m.c").alias("c")), "key").select("key", "node", "weight", "comp", "most", F.col("n").alias("size"), (F.col("n") - F.col("c")).alias("minor"))


def _with_pivots(members: DataFrame, among: Column) -> DataFrame:
    """(a, b) of each member and its bucket's pivot, the heaviest member of those that ``among`` says, where their components differ."""
    pivot = members.where(among).groupBy("key").agg(F.max(F.struct("weight", "node", "comp")).alias("p"))
    both = members.select("key", "node", "comp").join(pivot, "key").where(F.col("comp") != F.col("p.comp"))
    return both.select(F.col("node").alias("a"), F.col("p.node").alias("b")).distinct()


def _in_tiles(members: DataFrame, classes: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) of a bucket's members in different components that may be links: those outside the largest component against all.

    A bucket of n members, m of them outside, is cut into about n / TILE by m / TILE tiles, so that no bucket lies in one task. The
    rows of a tile come one after another, those of its outer side first.
    """
    told = members.join(_told(classes, s, "x").withColumnRenamed("x", "node"), "node").withColumn("outside", F.col("comp") != F.col("most"))
    cut = lambda c: F.ceil(F.col(c) / TILE).cast("int")
    block = lambda c: F.pmod(F.xxhash64("node"), cut(c)).cast("int")
    upto = lambda c: F.explode(F.sequence(F.lit(0), cut(c) - 1))
    kept = ["node", "comp", "outside", "x_n_shingles", "x_odd", *[f"x_{c}" for c in s.signature]]
    x = told.where("outside").withColumn("i", block("minor")).withColumn("j", upto("size")).select("key", "i", "j", F.lit(0).alias("side"), *kept)
    y = told.withColumn("j", block("size")).withColumn("i", upto("minor")).select("key", "i", "j", F.lit(1).alias("side"), *kept)

    def compare(tile: pd.DataFrame) -> pd.DataFrame:
        x, y = tile[tile["side"] == 0], tile[tile["side"] == 1]
        (n, p, u), (m, q, v) = _arrays(x, s, "x"), _arrays(y, s, "x")
        code = {c: k for k, c in enumerate(dict.fromkeys(tile["comp"]))}
        of_x, of_y = (np.array([code[c] for c in f["comp"]], np.int64) for f in (x, y))
        order = np.argsort(np.argsort(np.array([*x["node"], *y["node"]], object), kind="stable"), kind="stable")
        place, other, inner = order[: len(x)], order[len(x) :], y["outside"].to_numpy(bool)
        a, b = [], []
        for k in range(len(x)):
            ok = (of_y != of_x[k]) & (~inner | (place[k] < other)) & (100 * n[k] >= s.percent * m) & (100 * m >= s.percent * n[k])
            at = np.flatnonzero(ok)
            at = at[may_link(s, (n[k], p[k], u[k]), (m[at], q[at], v[at]))]
            a.append(np.full(len(at), k))
            b.append(at)
        a, b = np.concatenate(a), np.concatenate(b)
        return pd.DataFrame({"a": x["node"].to_numpy()[a], "b": y["node"].to_numpy()[b]})

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for f in frames:
            f = f if held is None else pd.concat([held, f], ignore_index=True)
            tile = f[["key", "i", "j"]].to_numpy(np.int64)
            cuts = np.flatnonzero((tile[1:] != tile[:-1]).any(axis=1)) + 1
            begin = [0, *cuts.tolist()]
            for lo, hi in zip(begin, begin[1:], strict=False):
                yield compare(f.iloc[lo:hi])
            held = f.iloc[begin[-1] :]
        if held is not None and len(held):
            yield compare(held)

    tiles = x.unionByName(y).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
    return tiles.mapInPandas(work, "a binary, b binary").distinct()


def grouped(docs: DataFrame, settings: Settings | None = None, doc_id: str = "doc_id", text: str = "text", others: list[str] | None = None, kept: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, r0, r1, n_shingles, node, comp, class_size; comp is the smallest node of its component, null without words.

    r0 and r1 are ``row_keys`` of doc_id, text and the columns ``others``. ``kept`` gets the paths of the tables that the result reads.
    """
    s = settings or Settings()
    others = others or []
    scratch: list[str] = []
    signed = stored(signatures(docs, s, doc_id, text, others), kept)
    classes = signed.where("node is not null").groupBy("node").agg(F.min(F.struct("r0", "r1")).alias("row"), *[F.first(c).alias(c) for c in ("n_shingles", "odd", *s.signature)], F.count("*").alias("class_size"))
    classes = stored(classes, scratch)

    # Buckets with two members or more, one for all that have the same members. Whatever their size, they are summed up before the shuffle.
    every = keys(classes, s)
    shared = every.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("h"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("g")).where("n > 1")
    shared = shared.groupBy("n", "h", "g").agg(F.min("key").alias("key")).select("key", "n")
    buckets = stored(every.join(shared, "key"), scratch)
    weights = buckets.groupBy("node").agg(F.sum(F.col("n") - 1).alias("weight"))
    buckets = stored(buckets.join(weights, "node"), scratch)

    tried = stored(near(_with_pivots(buckets.withColumn("comp", F.col("node")), F.lit(True)), classes, s), scratch)
    needed = tried.select(F.col("a").alias("node")).union(tried.select("b")).union(buckets.where("n > 2").select("node")).distinct()
    sets = stored(sets_of(docs, needed, classes, s, doc_id, text, others), scratch)
    links = stored(confirmed(tried, sets, s), scratch)
    comps = stored(components(links, scratch), scratch)
    while True:
        members = stored(_open(buckets, comps), scratch)
        waiting = members.where("comp <> most").select("node").distinct().count()
        if not waiting:
            break
        more = stored(confirmed(near(_with_pivots(members, F.col("comp") != F.col("most")), classes, s), sets, s), scratch)
        found = more.count()
        if found:
            comps = stored(components(more.union(comps.toDF("a", "b")), scratch), scratch)
        if found < s.again * waiting:
            members = stored(_open(buckets, comps), scratch) if found else members
            rest = stored(confirmed(_in_tiles(members, classes, s), sets, s), scratch)
            if not rest.isEmpty():
                comps = stored(components(rest.union(comps.toDF("a", "b")), scratch), scratch)
            break

    named = stored(classes.select("node", "class_size").join(comps, "node", "left").select("node", "class_size", F.coalesce("comp", "node").alias("comp")), kept)
    forget(docs.sparkSession, scratch)
    return signed.select("doc_id", "r0", "r1", "n_shingles", "node").join(named, "node", "left")


def near_duplicates(docs: DataFrame, settings: Settings | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, class_size.

    component_id is the smallest doc_id that links reach, itself included; documents without words, with null texts too, are
    linked with nothing and keep their own id. Null ids are never the smallest where there is another. Rows that repeat a
    doc_id all appear. class_size counts the documents with the same shingle set. Empty tables give no rows. Other columns of
    the input don't matter, whatever their names.
    """
    kept: list[str] = []
    rows = stored(grouped(docs, settings, doc_id, text, kept=kept).select("doc_id", "n_shingles", "comp", "class_size"))
    forget(docs.sparkSession, kept)
    ids = rows.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    component = F.coalesce("component_id", "doc_id")
    return rows.join(ids, "comp", "left").select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), F.coalesce("class_size", F.lit(1)).alias("class_size"))


def survivors(docs: DataFrame, settings: Settings | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The input without all rows but one of each group of near duplicates, that with the smallest doc_id; a null id is the largest.

    Rows go, not ids: of rows that share an id but no group all may stay, and of rows that are equal throughout one stays, if
    they have words. Rows without words stay. Columns of any name stay as they are; those of types that can't be cast to text
    don't tell rows with the same id and text apart.
    """
    plain = [f.name for f in docs.schema.fields if f.name not in (doc_id, text) and f.dataType.typeName() not in ("array", "map", "struct", "variant")]
    scratch: list[str] = []
    rows = stored(grouped(docs, settings, doc_id, text, plain, scratch).where("comp is not null").select("comp", "r0", "r1", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "r0", "r1").alias("place")), scratch)
    groups = rows.groupBy("comp").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    each = rows.join(groups, "comp").groupBy("r0", "r1").agg(F.bool_or(F.col("place").eqNullSafe(F.col("first"))).alias("stays"), F.count("*").alias("copies"))
    fates = stored(each.where("not stays or copies > 1"))
    forget(docs.sparkSession, scratch)
    names = [F.col(f"`{c}`") for c in docs.columns]
    at = [free("__r0", docs.columns), free("__r1", docs.columns)]
    keyed = docs.select(*names, *[k.alias(a) for k, a in zip(row_keys(doc_id, text, *plain), at, strict=True)])
    fates = fates.select("stays", F.col("r0").alias(at[0]), F.col("r1").alias(at[1]))
    out = keyed.join(fates, at, "left_anti").select(*names)
    # Rows that are equal throughout and stay: one of them.
    again = keyed.join(fates.where("stays"), at, "left_semi").dropDuplicates(at).select(*names)
    return out.unionAll(again)

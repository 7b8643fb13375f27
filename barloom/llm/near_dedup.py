"""Near-duplicate documents by MinHash bands, verified with odd sketches and then on full shingle sets.

1. Every text becomes its set of hashed word shingles, the set's MinHash samples in bands, and an odd sketch: the
   samples are folded into a bitmap by flipping one bit each, so that the bits in which two sketches differ (the population count of
   their XOR) tell how many samples differ, most precisely where few do.
2. Documents with equal sets form classes; only one representative of each goes on.
3. Representatives that share a band are candidates. A bucket's members are first compared with its smallest one, which is linear in
   its size; pairs whose sketches leave the threshold possible are verified on their full sets.
4. Candidates that sketches find possible form families: the pairs of step 3, and where a bucket holds several families, what
   joins them. Two documents that share a band and may be similar are thus in one family, and families of unrelated documents do not grow together.
5. Where verified links leave a family in several components, the members outside its largest one are held against all of it, in
   blocks, by sketches and then on full sets, which only go where a sketch has found a partner; a task emits only pairs that join components it has not joined yet. So no link that
   matters is left out, however large a bucket or a family is, and what is emitted grows with the members, not with their pairs.
6. An id with several texts is one document: it is linked with the representatives of all of them. Components are found by passing on the smallest id and jumping to the label's own label; all state is in written tables.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, split_hot_join

SAMPLES = 200
#: From the lowest percent down: samples in a band, and how far below the threshold a sketch's estimate may lie before the pair is dropped (six standard deviations).
#: A pair at the lowest percent of a line shares no band with a probability of 1e-7, 1e-7 and 3e-8.
SCHEMES = {80: (5, 0.2), 60: (3, 0.33), 40: (2, 0.33)}
#: Bits of an odd sketch.
BITS = 1024
#: Members that are compared at once.
BLOCK = 512

_rng = np.random.default_rng(20240501)
_FACTORS = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_POSITION = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_word_hash = _WordHashes()


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles of `size` words; of one shingle if it has fewer words, none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_word_hash.__getitem__, words), np.uint64, n)
    k = min(size, n)
    out = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        out += w[j : n - k + 1 + j] * _POSITION[j]
    return np.unique(_mix(out))


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(out, (_FACTORS[:, None] * x[None, at : at + 512]).min(axis=1), out=out)
    return out


def scheme(percent: int) -> tuple[int, float]:
    """Samples in a band and the sketch's margin for links at `percent` and more."""
    for least, found in SCHEMES.items():
        if percent >= least:
            return found
    raise ValueError(f"links under {min(SCHEMES)} % are out of reach of {SAMPLES} samples")


def bands_of(samples: np.ndarray, width: int) -> np.ndarray:
    n = SAMPLES // width
    rows = samples[: n * width].reshape(n, width).astype(np.uint64)
    h = np.arange(n, dtype=np.uint64) + np.uint64(1)
    for j in range(width):
        h = _mix(h * _M1 + rows[:, j])
    return h.view(np.int64)


def odd_sketch(samples: np.ndarray) -> bytes:
    bits = (_mix(samples.astype(np.uint64) ^ _SALT) % np.uint64(BITS)).astype(np.int64)
    return np.packbits(np.bincount(bits, minlength=BITS) & 1).tobytes()


def estimate(differing: np.ndarray) -> np.ndarray:
    """Similarity from the number of differing bits: each differing sample flips a bit in either sketch."""
    share = np.minimum(2.0 * differing / BITS, 1 - 1e-9)
    return 1 + BITS / (4.0 * SAMPLES) * np.log1p(-share)


def most_differing(similarity: float) -> int:
    """The number of differing bits at which the estimate is `similarity`."""
    return math.ceil(BITS / 2 * -math.expm1((similarity - 1) * 4 * SAMPLES / BITS))


def _sign(batches: Iterator[pa.RecordBatch], size: int, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, digests, bands, sketches = [], [], [], []
        for text in batch.column("_text"):
            s = shingle_set(text.as_py(), size)
            n.append(len(s))
            if len(s):
                samples = min_hashes(s)
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                bands.append(bands_of(samples, width))
                sketches.append(odd_sketch(samples))
            else:
                digests.append(None)
                bands.append(None)
                sketches.append(None)
        made = [pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), *made], ["_id", "n", "digest", "bands", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t.as_py(), size).tobytes() for t in batch.column("_text")]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(sets, pa.binary())], ["_id", "payload"])


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 x intersection >= percent x union, on sorted distinct hashes."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _alike_sets(a: bytes, b: bytes, percent: int) -> bool:
    return jaccard_at_least(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent)


def _alike_sketches(a: bytes, b: bytes, most: int) -> bool:
    return (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() <= most


def _compare(batches: Iterator[pa.RecordBatch], alike: Callable[[bytes, bytes], bool]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (a, salt, member): first the payload of a (all of them, should its id repeat), then those of the members."""
    group, pivots = None, []
    for batch in batches:
        left, right = [], []
        for a, salt, b, payload in zip(*(batch.column(i) for i in range(4))):
            a, b, payload = a.as_py(), b.as_py(), payload.as_py()
            if (a, salt.as_py()) != group:
                group, pivots = (a, salt.as_py()), []
            if b is None:
                pivots.append(payload)
            elif any(alike(p, payload) for p in pivots):
                left.append(a)
                right.append(b)
        kind = batch.schema.field(0).type
        yield pa.RecordBatch.from_arrays([pa.array(left, kind), pa.array(right, kind)], ["a", "b"])


class _Joined:
    """Union-find over the labels of one group of rows."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x


def _cross(batches: Iterator[pa.RecordBatch], most: int, percent: int | None) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (group, bx, by, minor first): pairs of a minor member and any other of another component, alike by their sketches and,
    with a percent, by their sets. Pairs whose components the block's earlier pairs have joined are passed over.
    """
    group, minor, joined = None, ([], [], [], []), _Joined()
    for batch in batches:
        kind = batch.schema.field("_id").type
        left, right = [], []
        columns = [batch.column(c).to_pylist() for c in ("group", "bx", "by", "side", "_id", "label", "sketch", "payload")]
        rows = list(zip(*columns))
        at = 0
        while at < len(rows):
            key = rows[at][:3]
            if key != group:
                group, minor, joined = key, ([], [], [], []), _Joined()
            end = at
            while end < len(rows) and rows[end][:3] == key:
                end += 1
            others = []
            for r in rows[at:end]:
                if r[3]:
                    others.append(r)
                else:
                    for column, value in zip(minor, (r[4], r[5], r[6], np.frombuffer(r[7], np.uint64) if percent else None)):
                        column.append(value)
            if others and minor[0]:
                x = np.frombuffer(b"".join(minor[2]), np.uint64).reshape(-1, BITS // 64)
                for _, _, _, _, i, label, sketch, payload in others:
                    near = np.flatnonzero(np.bitwise_count(x ^ np.frombuffer(sketch, np.uint64)).sum(axis=1) <= most)
                    own = np.frombuffer(payload, np.uint64) if percent and len(near) else None
                    for k in near:
                        p, q = joined.root(minor[1][k]), joined.root(label)
                        if p != q and (percent is None or jaccard_at_least(minor[3][k], own, percent)):
                            joined.up[p] = q
                            left.append(min(i, minor[0][k]))
                            right.append(max(i, minor[0][k]))
            at = end
        yield pa.RecordBatch.from_arrays([pa.array(left, kind), pa.array(right, kind)], ["a", "b"])


def _near_members(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (group, bx, by, minor first): those that are alike by their sketches to one of the other side with another label, each once."""
    key, minor, sketches, labels, marked = None, [], np.empty((0, BITS // 64), np.uint64), np.empty(0), np.empty(0, bool)

    def settled() -> Iterator[pa.RecordBatch]:
        if marked.any():
            whole = pa.Table.from_batches(minor).combine_chunks().filter(pa.array(marked))
            yield from whole.to_batches()

    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("group", "bx", "by"))))
        side = np.array(batch.column("side").to_pylist())
        own = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(-1, BITS // 64)
        label = np.array(batch.column("label").to_pylist())
        at = 0
        while at < len(keys):
            end = at
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            if keys[at] != key:
                yield from settled()
                key, minor, sketches, labels, marked = keys[at], [], own[:0], label[:0], np.empty(0, bool)
            cut = at + int((side[at:end] == 0).sum())
            if cut > at:
                minor.append(batch.slice(at, cut - at))
                sketches, labels = np.concatenate([sketches, own[at:cut]]), np.concatenate([labels, label[at:cut]])
                marked = np.concatenate([marked, np.zeros(cut - at, bool)])
            found = []
            for i in range(cut, end if len(marked) else cut):
                near = (np.bitwise_count(sketches ^ own[i]).sum(axis=1) <= most) & (labels != label[i])
                if near.any():
                    marked |= near
                    found.append(i)
            if found:
                yield batch.take(pa.array(found))
            at = end
    yield from settled()


@contextmanager
def _small_batches(spark: SparkSession, rows: int = 500):
    """While it holds, Python gets so many rows at once: sets of long texts are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _verified(pairs: DataFrame, payloads: DataFrame, alike: Callable[[bytes, bytes], bool], scratch: Scratch, tag: str) -> DataFrame:
    """The pairs (a, b) whose payloads are alike. A pivot a with many partners is dealt out in blocks of them."""
    kind = pairs.schema["a"].dataType.simpleString()
    total = pairs.count()
    limit = max(BLOCK, total // 4096)
    hot = pairs.groupBy("a").agg(F.count("*").alias("_n")).where(F.col("_n") > limit)  # fewer than 4096 rows
    salted = pairs.join(F.broadcast(hot), "a", "left")
    salted = salted.select("a", F.expr(f"pmod(xxhash64(b), coalesce(ceil(_n / {BLOCK}), 1))").cast("int").alias("salt"), "b")
    payload = payloads.select(F.col("_id").alias("_key"), "payload")
    pivots = salted.select("a", "salt").distinct().join(payload, F.col("a") == F.col("_key"))
    members = salted.join(payload, F.col("b") == F.col("_key"))
    rows = pivots.select("a", "salt", F.lit(None).cast(kind).alias("b"), "payload").unionByName(members.select("a", "salt", "b", "payload"))
    dealt = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    with _small_batches(rows.sparkSession):
        return scratch.write(dealt.mapInArrow(partial(_compare, alike=alike), f"a {kind}, b {kind}").distinct(), tag)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(_id, label): the smallest id that each end of an edge can reach. edges: (a, b).

    Every node is hung under its smallest neighbour, or stays where it is smaller than all of them; the trees are
    shortened once and drawn together, and what edges remain between them go on. A star is gone after two rounds, and the edges left shrink with every round.
    """
    live = scratch.write(edges.where("a <> b").select("a", "b").distinct(), "live")
    labels = None
    while n := live.count():
        arcs = live.select(F.col("a").alias("u"), F.col("b").alias("v")).union(live.select("b", "a"))
        hung = arcs.groupBy("u").agg(F.min("v").alias("_least"), F.count("*").alias("degree")).select("u", F.least("u", "_least").alias("parent"), "degree")
        hung = scratch.write(hung, "hung")
        sizes = hung.groupBy("parent").agg(F.count("*").alias("size"))
        up = sizes.join(hung.select(F.col("u").alias("parent"), F.col("parent").alias("further")), "parent")
        hung = scratch.write(split_hot_join(hung, up, "parent", "size", 2 * n).select("u", F.col("further").alias("parent"), "degree"), "hung")

        ends = lambda c: hung.select(F.col("u").alias(c), F.col("parent").alias(f"p{c}"), F.col("degree").alias(f"d{c}"))  # noqa: B023, E731  used at once
        drawn = split_hot_join(split_hot_join(live, ends("a"), "a", "da", n), ends("b"), "b", "db", n)
        drawn = drawn.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).where("a <> b").distinct()
        next_live = scratch.write(drawn, "live")
        if labels is None:
            labels = scratch.write(hung.select(F.col("u").alias("_id"), F.col("parent").alias("label")), "labels")
        else:
            sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
            moved = sizes.join(hung.select(F.col("u").alias("label"), "parent"), "label", "left").withColumn("parent", F.coalesce("parent", "label"))
            labels = scratch.write(split_hot_join(labels, moved, "label", "size", 2 * n).select("_id", F.col("parent").alias("label")), "labels")
        scratch.drop(live)
        live = next_live
    return labels if labels is not None else live.select(F.col("a").alias("_id"), F.col("b").alias("label"))


def link_documents(docs: DataFrame, size: int = 5, percent: int = 80, broadcast_rows: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (the smallest id reachable over links, itself included) and kept (id = component_id) of every row.

    Two documents are linked if 100 x intersection >= percent x union of their sets of `size`-word shingles; percent is 40 or more. Null, empty and
    wordless texts have empty sets and are linked with nothing. An id that repeats stands for one document with the links of all
    its texts, and all its rows have the same component_id. Rows without an id have no component_id and are kept. Repeated rows are repeated in
    the result, an empty table gives an empty one. Texts of any length are taken whole: one worker holds a few of them with their sets.
    Only the id and the text are read.
    """
    spark = docs.sparkSession
    width, margin = scheme(percent)
    scratch = Scratch(spark, "near")
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = slim.schema["_id"].dataType.simpleString()
    signed = slim.mapInArrow(partial(_sign, size=size, width=width), f"_id {kind}, n long, digest binary, bands array<long>, sketch binary")
    signed = scratch.write(signed, "signed")
    full = signed.where("digest is not null and _id is not null")

    classes = scratch.write(full.groupBy("digest").agg(F.min("_id").alias("_id"), F.count("*").alias("copies")), "classes")
    chosen = full.join(classes.select("digest", "_id"), ["digest", "_id"], "left_semi").select("_id", "bands", "sketch")
    chosen = scratch.write(chosen, "chosen")
    sketches = chosen.select("_id", F.col("sketch").alias("payload"))

    in_band = chosen.select("_id", F.explode("bands").alias("band"))
    shared = in_band.groupBy("band").agg(F.min("_id").alias("first"), F.max("_id").alias("last"), F.count("*").alias("size")).where("first < last")
    shared = scratch.write(shared, "shared")
    n_rows = chosen.count() * (SAMPLES // width)
    members = scratch.write(split_hot_join(in_band, shared.select("band", "first", "size"), "band", "size", n_rows), "members")

    most = most_differing(percent / 100 - margin)
    stars = members.where("_id != first").select(F.col("first").alias("a"), F.col("_id").alias("b")).distinct()
    stars = scratch.write(stars, "stars")
    alike = partial(_alike_sketches, most=most)
    likely = _verified(stars, sketches, alike, scratch, "likely")

    def sets_of(ids: DataFrame) -> DataFrame:
        """(_id, payload): the sets of some documents, made anew from their texts."""
        ids = scratch.write(ids.distinct(), "ids")
        few = ids.count() <= broadcast_rows
        wanted = slim.join(F.broadcast(ids) if few else ids, "_id", "left_semi")
        return wanted.mapInArrow(partial(_sets, size=size), f"_id {kind}, payload binary")

    both = likely.select(F.col("a").alias("_id")).union(likely.select("b"))
    links = _verified(likely, sets_of(both), partial(_alike_sets, percent=percent), scratch, "links")
    several_texts, own = _own_links(signed, classes, scratch)
    if own is not None:
        links = scratch.write(links.unionByName(own).distinct(), "links")
    labels = components(links, scratch)

    def bridges(rows: DataFrame, n: int, payloads: Callable[[DataFrame], DataFrame] | None, tag: str) -> DataFrame:
        """Pairs that join the labels of a group. rows: (group, _id, label), n of them."""
        parts = rows.groupBy("group", "label").agg(F.count("*").alias("n"))
        several = parts.groupBy("group").agg(F.sum("n").alias("size"), F.max("n").alias("largest"), F.max_by("label", F.struct("n", "label")).alias("major"), F.count("*").alias("k"))
        several = scratch.write(several.where("k > 1").drop("k"), f"{tag}-several")
        open_ = scratch.write(split_hot_join(rows, several, "group", "size", n), f"{tag}-open")
        held = open_.join(sketches.withColumnRenamed("payload", "sketch"), "_id")
        held = held.withColumns({"nx": F.ceil((F.col("size") - F.col("largest")) / BLOCK).cast("int"), "ny": F.ceil(F.col("size") / BLOCK).cast("int")})
        own = lambda c: F.pmod(F.xxhash64("_id"), F.col(c)).cast("int")
        each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        minor = held.where("label != major").select("group", own("nx").alias("bx"), each("ny").alias("by"), F.lit(0).alias("side"), "_id", "label", "sketch")
        other = held.select("group", each("nx").alias("bx"), own("ny").alias("by"), F.lit(1).alias("side"), "_id", "label", "sketch")
        deal = lambda rows: rows.repartition("group", "bx", "by").sortWithinPartitions("group", "bx", "by", "side")
        rows, payload = minor.unionByName(other), F.lit(None).cast("binary")
        if payloads:
            # Sketches alone go to all blocks. The sets, which are larger by far, follow for those that have a partner there.
            near = scratch.write(deal(rows).mapInArrow(partial(_near_members, most=most), rows.schema), f"{tag}-near")
            rows, payload = near.join(payloads(near), "_id"), F.col("payload")
        rows = rows.select("group", "bx", "by", "side", "_id", "label", "sketch", payload.alias("payload"))
        with _small_batches(spark):
            found = deal(rows).mapInArrow(partial(_cross, most=most, percent=percent if payloads else None), f"a {kind}, b {kind}")
            return scratch.write(found.distinct(), tag)

    families = components(likely, scratch)
    in_family = members.select(F.col("band").alias("group"), "_id").join(families, "_id", "left").withColumn("label", F.coalesce("label", "_id"))
    more = bridges(scratch.write(in_family, "in-family"), n_rows, None, "bridges")
    if not more.isEmpty():
        families = components(scratch.write(likely.unionByName(more).distinct(), "possible"), scratch)
    kin = families.withColumnRenamed("label", "group").join(labels, "_id", "left").withColumn("label", F.coalesce("label", "_id"))
    more = bridges(scratch.write(kin, "kin"), n_rows, lambda rows: sets_of(rows.select("_id")), "joins")
    if not more.isEmpty():
        labels = components(scratch.write(links.unionByName(more).distinct(), "all"), scratch)

    named = classes.join(labels, "_id", "left").select("digest", "copies", F.coalesce("label", "_id").alias("component"))
    named = scratch.write(named, "named")
    rows = full.select("_id", "n", "digest")
    out = split_hot_join(rows, named, "digest", "copies", signed.count()).select("_id", "n", "component")
    alone = signed.where("digest is null or _id is null").select("_id", "n")
    if several_texts is None:
        alone = alone.withColumn("component", F.col("_id"))
    else:  # a wordless text of an id that has others, too
        of_id = several_texts.join(labels, "_id", "left").select("_id", "copies", F.coalesce("label", "_id").alias("component"))
        of_id = scratch.write(of_id, "of-id")
        named_alone = split_hot_join(alone, of_id, "_id", "copies", signed.count(), how="left").select("_id", "n", F.coalesce("component", "_id").alias("component"))
        alone = named_alone.unionByName(alone.where("_id is null").withColumn("component", F.col("_id")))
    out = out.unionByName(alone)
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("_id").eqNullSafe(F.col("component")).alias("kept"))


def _own_links(signed: DataFrame, classes: DataFrame, scratch: Scratch) -> tuple[DataFrame | None, DataFrame | None]:
    """(_id, copies) of the ids that have different sets, and links (a, b) from each of them to the representatives of its sets' classes."""
    name = F.coalesce("digest", F.lit("").cast("binary"))
    several = signed.where("_id is not null").groupBy("_id").agg(F.count("*").alias("copies"), F.min(name).alias("_least"), F.max(name).alias("_most"))
    several = scratch.write(several.where("_least != _most").select("_id", "copies"), "several-texts")
    if several.isEmpty():
        return None, None
    n = signed.count()
    texts = split_hot_join(signed.where("digest is not null").select("_id", "digest"), several, "_id", "copies", n).select("_id", "digest").distinct()
    met = split_hot_join(texts, classes.select("digest", F.col("_id").alias("first"), "copies"), "digest", "copies", n)
    own = met.select(F.least("_id", "first").alias("a"), F.greatest("_id", "first").alias("b")).where("a <> b").distinct()
    return several, scratch.write(own, "own-links")


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, that with the smallest id, with its columns. Of rows that share that id one stays, the
    one with the longest text, for an id is one document; rows without an id all stay, and so do wordless texts of different ids.
    An empty table gives an empty one; columns may have any names.
    """
    scratch = Scratch(docs.sparkSession, "kept")
    linked = link_documents(docs, size, percent, id_col=id_col, text_col=text_col).select(F.col(id_col).alias("_id"), "kept")
    kept = scratch.write(linked.where("kept and _id is not null").groupBy("_id").agg(F.count("*").alias("copies")), "kept")
    rows = docs.select(F.col(id_col).alias("_id"), F.struct((-F.coalesce(F.length(text_col), F.lit(-1))).alias("n"), F.xxhash64(text_col).alias("h")).alias("_hash"), F.struct(*docs.columns).alias("_row"))
    n = docs.count()
    out = split_hot_join(rows, kept.where("copies = 1"), "_id", "copies", n).select("_row").unionByName(rows.where("_id is null").select("_row"))
    again = kept.where("copies > 1")
    if not again.isEmpty():
        # Which text stays is found first; of the rows that have it, which are alike in their texts, the one with the least hash is taken.
        repeated = split_hot_join(rows, again, "_id", "copies", n)
        least = repeated.groupBy("_id").agg(F.min("_hash").alias("_least"), F.max("copies").alias("copies"))
        chosen = split_hot_join(repeated.drop("copies"), least, "_id", "copies", n).where("_hash = _least")
        out = out.unionByName(chosen.groupBy("_id").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row")).select("_row"))
    return out.select("_row.*")

"""Filter interaction audit: what each filter of a chain removes, in every order of the filters.

The texts are read once, straight from the Arrow buffers of a batch: a table gives every byte its classes, prefix sums of the classes over
the documents' offsets count words, capitals, symbols and code points, and the words' hashes, sorted within each document and
verified byte by byte, give its distinct words. What leaves Python is a bit mask of the filters that a document fails and a digest of its text.
The rest is counting: documents by part, mask and labels, then one product of mask tables for all orders.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch, split_hot_join

FILTERS = "ABCDE"
N_MASKS = 1 << len(FILTERS)
COPY = 16  # the mask bit of filter E, which no text shows by itself
_SPACE, _CAPITAL, _SYMBOL, _POINT = 1, 2, 4, 8
#: Bytes that are scanned at once; a longer document is scanned in pieces that end between words.
PIECE = 1 << 20
_WINDOWS = 32  # words of more than so many windows of 8 bytes are hashed and compared one by one
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Limits:
    """A: fewer words than min_words. B: distinct words under distinct_percent of the words. C: capitals over capital_percent of the
    code points. D: any of `symbols`."""

    min_words: int = 200
    distinct_percent: int = 50
    capital_percent: int = 2
    symbols: bytes = b"#$%&*|"

    def classes(self) -> np.ndarray:
        """The classes of each byte."""
        table = np.zeros(256, np.uint8)
        table[list(SPACE)] |= _SPACE
        table[ord("A") : ord("Z") + 1] |= _CAPITAL
        table[list(self.symbols)] |= _SYMBOL
        table[[b for b in range(256) if b & 0xC0 != 0x80]] |= _POINT
        return table


@dataclass
class Words:
    """Words by place in one padded buffer: document number, start, length, hash."""

    data: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    length: np.ndarray

    def windows(self) -> np.ndarray:
        """The 8 bytes that begin at each place."""
        return np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))

    def hashes(self) -> np.ndarray:
        view, h, live = self.windows(), self.length.astype(np.uint64) * _MIX, np.arange(len(self.start))
        for k in range(_WINDOWS):
            if not len(live):
                return h
            left = self.length[live] - 8 * k
            x = (h[live] ^ (view[self.start[live] + 8 * k] & _LOW[np.minimum(left, 8)])) * _MIX
            h[live] = x ^ (x >> np.uint64(29))
            live = live[left > 8]
        for i in live.tolist():
            h[i] = xxhash.xxh3_64_intdigest(self.bytes(i))
        return h

    def bytes(self, i: int) -> bytes:
        return self.data[self.start[i] : self.start[i] + self.length[i]].tobytes()

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the pairs (a, b) are one word of one document, byte by byte."""
        view = self.windows()
        out = (self.doc[a] == self.doc[b]) & (self.length[a] == self.length[b])
        live = np.flatnonzero(out)
        for k in range(_WINDOWS):
            if not len(live):
                return out
            left = self.length[a[live]] - 8 * k
            differ = (view[self.start[a[live]] + 8 * k] ^ view[self.start[b[live]] + 8 * k]) & _LOW[np.minimum(left, 8)]
            out[live[differ != 0]] = False
            live = live[(left > 8) & (differ == 0)]
        for i in live.tolist():
            out[i] = self.bytes(a[i]) == self.bytes(b[i])
        return out

    def distinct(self) -> np.ndarray:
        """The indices of one word for each distinct word of each document."""
        key = self.hashes() ^ (self.doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        order = np.argsort(key)
        again = np.zeros(len(order), bool)
        at = np.flatnonzero(key[order[1:]] == key[order[:-1]]) + 1
        again[at] = self.same(order[at - 1], order[at])
        if again.sum() == len(at):
            return order[~again]
        # Unlike words share a key. Those that share one are told apart by their bytes.
        runs = np.cumsum(np.r_[True, key[order[1:]] != key[order[:-1]]])
        seen: set[tuple[int, int, bytes]] = set()
        keep = []
        for i, run in zip(order.tolist(), runs.tolist()):
            if (word := (run, int(self.doc[i]), self.bytes(i))) not in seen:
                seen.add(word)
                keep.append(i)
        return np.array(keep, np.int64)

    def only(self, at: np.ndarray) -> Words:
        return Words(self.data, self.doc[at], self.start[at], self.length[at])


def _words(data: np.ndarray, space: np.ndarray, first: np.ndarray, doc: np.ndarray) -> Words:
    """The words of the documents that begin at `first`; a document ends where the next begins. data is padded, space is not."""
    word = ~space
    begins = word.copy()
    begins[1:] &= space[:-1]
    edge = first[first < len(space)]
    begins[edge] = word[edge]
    ends = word.copy()
    ends[:-1] &= space[1:]
    last = edge[edge > 0] - 1
    ends[last] = word[last]
    start = np.flatnonzero(begins)
    return Words(data, doc[np.searchsorted(first, start, side="right") - 1], start, np.flatnonzero(ends) + 1 - start)


def _padded(data: np.ndarray) -> np.ndarray:
    return np.concatenate([data, np.zeros(8, np.uint8)])


def _pieces(data: np.ndarray, table: np.ndarray, piece: int) -> Iterator[np.ndarray]:
    """A long document cut between words; a piece is longer than `piece` only where a word is."""
    at = 0
    while at < len(data):
        end = min(at + piece, len(data))
        if end < len(data):
            spaces = np.flatnonzero(table[data[at:end]] & _SPACE)
            if len(spaces):
                end = at + int(spaces[-1]) + 1
            while not len(spaces) and end < len(data):
                spaces = np.flatnonzero(table[data[end : end + piece]] & _SPACE)
                end = min(end + piece, len(data)) if not len(spaces) else end + int(spaces[0]) + 1
        yield data[at:end]
        at = end


def _long(data: np.ndarray, table: np.ndarray, piece: int) -> list[int]:
    """The counts of one document, piece by piece: only its distinct words are kept from one piece to the next."""
    counts, held, size, parts = np.zeros(5, np.int64), [], 0, []
    for part in _pieces(data, table, piece):
        kinds = table[part]
        words = _words(_padded(part), (kinds & _SPACE) > 0, np.zeros(1, np.int64), np.zeros(1, np.int64))
        counts += [len(words.start), 0, *(np.count_nonzero(kinds & k) for k in (_CAPITAL, _SYMBOL, _POINT))]
        words = words.only(words.distinct())
        # The distinct words of the piece, packed, so that the piece itself can go.
        picked = np.repeat(words.start - np.r_[0, np.cumsum(words.length)[:-1]], words.length) + np.arange(int(words.length.sum()))
        held.append((words.data[picked], words.length, size))
        size += len(picked)
        parts.append(np.r_[0, np.cumsum(words.length)[:-1]] + held[-1][2] if len(words.length) else np.zeros(0, np.int64))
    length = np.concatenate([h[1] for h in held])
    all_ = Words(_padded(np.concatenate([h[0] for h in held])), np.zeros(len(length), np.int64), np.concatenate(parts).astype(np.int64), length)
    counts[1] = len(all_.distinct())
    return counts.tolist()


def count_texts(texts: pa.Array, table: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """Rows (words, distinct words, capitals, symbols, code points) of the texts of one Arrow array; a null text is empty."""
    data, offsets = buffers_of(texts)
    out = np.zeros((len(texts), 5), np.int64)
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + piece, side="right")) - 1)
        lo, hi = int(offsets[at]), int(offsets[upto])
        if hi - lo > piece:
            out[at] = _long(data[lo:hi], table, piece)
        elif hi > lo:
            own, first = data[lo:hi], offsets[at : upto + 1].astype(np.int64) - lo
            kinds = table[own]
            words = _words(_padded(own), (kinds & _SPACE) > 0, first[:-1], np.arange(upto - at))
            sums = [np.r_[0, np.cumsum((kinds & k) > 0)] for k in (_CAPITAL, _SYMBOL, _POINT)]
            out[at:upto, 0] = np.bincount(words.doc, minlength=upto - at)
            out[at:upto, 1] = np.bincount(words.doc[words.distinct()], minlength=upto - at)
            out[at:upto, 2:] = np.stack([s[first[1:]] - s[first[:-1]] for s in sums], axis=1)
        at = upto
    return out


def buffers_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, without a copy, and the offsets of its texts. Nulls become empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, kind)
    own = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), own


def _scan(batches: Iterator[pa.RecordBatch], limits: Limits) -> Iterator[pa.RecordBatch]:
    table = limits.classes()
    for batch in batches:
        texts = batch.column("_text")
        words, distinct, capitals, symbols, points = count_texts(texts, table).T
        failed = [words < limits.min_words, 100 * distinct < limits.distinct_percent * words, 100 * capitals > limits.capital_percent * points, symbols > 0]
        mask = sum(f.astype(np.int32) << k for k, f in enumerate(failed))
        data, offsets = buffers_of(texts)
        view = memoryview(data)
        digests = [xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        columns = [batch.column("_id"), batch.column("part"), pa.array(digests, pa.binary()), pa.array(mask, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["_id", "part", "digest", "mask"])


def failed_masks(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(_id, part, digest, mask) of every row: bit k of the mask is set if the text fails filter k of ABCD; digest: 128 bits of the text.

    A null text is empty and has no words; a null part is the empty string. Texts of any length are read whole.
    """
    slim = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("_text"))
    kind = slim.schema["_id"].dataType.simpleString()
    return slim.mapInArrow(partial(_scan, limits=limits), f"_id {kind}, part string, digest binary, mask int")


def _orders() -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """For each order and step: the order, the step, the bit of its filter, the bits of the filters before."""
    names, steps, own, before = [], [], [], []
    for order in permutations(range(len(FILTERS))):
        past = 0
        for step, k in enumerate(order, 1):
            names.append("".join(FILTERS[j] for j in order))
            steps.append(step)
            own.append(1 << k)
            before.append(past)
            past |= 1 << k
    return names, np.array(steps, np.int32), np.array(own), np.array(before)


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the counts of a part's masks to its 600 rows."""
    names, steps, own, before = _orders()
    mask = np.arange(N_MASKS)
    hits, earlier = (mask & own[:, None]) > 0, (mask & before[:, None]) > 0
    tables = {"kept": ~hits & ~earlier, "removed": hits & ~earlier, "redundant": hits & earlier, "unique_fails": mask == own[:, None]}
    for batch in batches:
        for part, rows in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
            n = np.zeros((N_MASKS, 3), np.int64)
            for r in rows:
                n[r["mask"]] += [r["n"], r["good"], r["toxic"]]
            made = {k: t @ n[:, 0] for k, t in tables.items()} | {"good_lost": tables["removed"] @ n[:, 1], "toxic_lost": tables["removed"] @ n[:, 2]}
            by_filter = {int(bit): int(made["removed"][own == bit].sum()) for bit in np.unique(own)}
            made["shapley"] = np.array([by_filter[int(bit)] for bit in own])
            head = [pa.array([part] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(steps)]
            yield pa.RecordBatch.from_arrays(head + [pa.array(v, pa.int64()) for v in made.values()], ["part", "filter_order", "step", *made])


def audit_filters(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row for each part, each of the 120 orders of the filters ABCDE and each step: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley.

    E fails where a smaller id anywhere in the table has the same text. Rows that share an id share its labels, and are no copies of each other; a row
    without an id is a copy of none and none is of it, and it has no labels. An id that labels name several times is good, or toxic, if one of its
    rows says so; null labels say nothing. Null texts are empty, so they are copies of each other and of empty ones. A null part and an empty one are
    the same. Ties do not matter, repeated rows count as often as they stand there. An empty table gives no rows. Only the columns
    named are read.

    Hot groups: equal texts meet as counts by part, mask and labels, never as rows, and those of one digest are joined in parts.
    """
    scratch = Scratch(docs.sparkSession, "audit")
    rows = failed_masks(docs, limits, id_col, text_col, part_col).groupBy("_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    says = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    named = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    rows = rows.join(named, "_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})

    # Of the rows that are alike: how many, how many have no id, the least id and how many have that.
    alike = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"),
        F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "n"))).alias("first"),
    )
    alike = scratch.write(alike, "alike")
    least = alike.groupBy("digest").agg(F.min("first._id").alias("least"), F.count("*").alias("copies"))
    alike = split_hot_join(alike, least.where("copies > 1"), "digest", "copies", alike.count(), how="left")
    original = F.when(F.col("first._id") == F.coalesce("least", "first._id"), F.col("first.n")).otherwise(0) + F.col("unnamed")
    both = F.array(F.struct(F.col("mask").alias("mask"), original.alias("n")), F.struct((F.col("mask") + COPY).alias("mask"), (F.col("n") - original).alias("n")))
    counted = alike.select("part", "good", "toxic", F.inline(both))
    counted = counted.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    of_part = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))  # 32 at most
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return of_part.mapInArrow(_reports, schema)


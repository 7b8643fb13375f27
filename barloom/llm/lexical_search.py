"""Ranked lexical search over inverted treaps.

The index is a table of segments, each of a bounded number of documents, numbered by id. A segment holds for every term an inverted treap: a
binary tree over the documents that have the term, a search tree by document number and a heap by impact, the term's share of a document's
score before its weight. The root of a subtree thus bounds the impact of every document below it.

A query walks the treaps of its terms at once, best first. A state is a range of document numbers with the subtree root of each term in it; the sum of the weighted root impacts
bounds every score in the range, and a range whose bound cannot enter the top k is dropped whole. Others are split at the document of the heaviest root,
short ones are summed at once. A task keeps each query's best scores from one segment to the next, so later segments are pruned by
earlier ones. Neither building nor searching shuffles texts or postings; only the best k of each query and task meet.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch
from .filter_audit import buffers_of

#: Bounds of a segment: documents (numbers fit two bytes, the last marks a missing child) and bytes of text; a longer document has its own.
SEGMENT_DOCS, SEGMENT_BYTES = 8192, 16 << 20
#: Ranges of so few documents are summed at once.
LEAF = 1024
#: Bytes of text that are cut into terms at once.
PIECE = 4 << 20
#: A pass over the index takes queries of so many terms in all; more queries go in further passes.
BLOCK_TERMS = 200_000
NONE = 0xFFFF

# Digits, letters in lower case and everything past ASCII stay; all other bytes part terms.
_TERM = [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]
_IS_TERM = np.zeros(256, bool)
_IS_TERM[_TERM] = True
_TABLE = bytes(ord(chr(b).lower()) if b < 0x80 and b in _TERM else b if b in _TERM else 0x20 for b in range(256))


def terms_of(text: str | None) -> Counter[bytes]:
    """The terms of a whole text with their counts."""
    data, out, at = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE), Counter(), 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        out.update(data[at : end if end >= 0 else len(data)].split())
        at = end if end >= 0 else len(data)
    return out


def count_terms(texts: pa.Array, piece: int = PIECE) -> np.ndarray:
    """How many terms each text of an Arrow array has, from its buffers."""
    data, offsets = buffers_of(texts)
    out = np.zeros(len(texts), np.int64)
    if not len(texts):
        return out
    for at in range(int(offsets[0]), int(offsets[-1]), piece):
        upto = min(at + piece, int(offsets[-1]))
        term = _IS_TERM[data[at:upto]]
        begins = term.copy()
        begins[1:] &= ~term[:-1]
        if at > offsets[0] and _IS_TERM[data[at - 1]]:
            begins[0] = False
        lo, hi = int(np.searchsorted(offsets, at)), int(np.searchsorted(offsets, upto))
        first = offsets[lo:hi] - at  # documents that begin here
        begins[first] = term[first]
        places = np.flatnonzero(begins)
        np.add.at(out, np.searchsorted(offsets, places + at, side="right") - 1, 1)
    return out


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = terms = 0
    for batch in batches:
        n = count_terms(batch.column(0))
        docs, terms = docs + int((n > 0).sum()), terms + int(n.sum())
    yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([terms], pa.int64())], ["docs", "terms"])


def treap(priority: list[int]) -> tuple[list[int], list[int], int]:
    """Left and right children, and the root, of the heap by priority over the positions in order."""
    left, right, path = [NONE] * len(priority), [NONE] * len(priority), []
    for i, p in enumerate(priority):
        last = NONE
        while path and priority[path[-1]] < p:
            last = path.pop()
        left[i] = last
        if path:
            right[path[-1]] = i
        path.append(i)
    return left, right, path[0]


class Builder:
    """Documents of a segment to be. Terms are numbered as they come, so that a document is held as two small arrays."""

    def __init__(self):
        self.docs: list[tuple[object, np.ndarray, np.ndarray]] = []
        self.number: dict[bytes, int] = defaultdict(count().__next__)

    def add(self, name: object, found: Counter[bytes]) -> None:
        self.docs.append((name, np.fromiter(map(self.number.__getitem__, found), np.int32, len(found)), np.fromiter(found.values(), np.int32, len(found))))

    def segment(self, n_docs: int, n_terms: int) -> dict[str, object]:
        """The columns of the segment. Document numbers follow the ids, nulls last."""
        docs = sorted(self.docs, key=lambda d: (d[0] is None, d[0]))
        length = np.array([75 + 25 * int(n.sum(dtype=np.int64)) * n_docs // n_terms for _, _, n in docs], np.int64)
        doc = np.repeat(np.arange(len(docs), dtype=np.int32), [len(t) for _, t, _ in docs])
        names = sorted(self.number)
        place = np.empty(len(names), np.int32)
        place[[self.number[n] for n in names]] = np.arange(len(names), dtype=np.int32)
        term = place[np.concatenate([t for _, t, _ in docs])]
        order = np.argsort(term, kind="stable")
        doc, term, freq = doc[order], term[order], np.concatenate([n for _, _, n in docs])[order].astype(np.int64)
        impact = 1_000_000_000 * freq // (1000 * freq + 12 * length[doc])
        starts = np.searchsorted(term, np.arange(len(names) + 1))
        # Equal impacts are put in order by a scrambled number, so that no tree becomes a list.
        priority = impact << 16 | doc.astype(np.int64) * 40503 & 0xFFFF
        left, right, roots = np.full(len(doc), NONE, np.uint16), np.full(len(doc), NONE, np.uint16), np.zeros(len(names), np.uint16)
        bounds = starts.tolist()
        for t in np.flatnonzero(np.diff(starts) > 1).tolist():
            a, b = bounds[t], bounds[t + 1]
            left[a:b], right[a:b], roots[t] = treap(priority[a:b].tolist())
        return {
            "ids": [d[0] for d in docs], "terms": b" ".join(names), "starts": starts.astype("<u4").tobytes(), "docs": doc.astype("<u2").tobytes(), "impacts": impact.astype("<u4").tobytes(),
            "lefts": left.astype("<u2").tobytes(), "rights": right.astype("<u2").tobytes(), "roots": roots.astype("<u2").tobytes(),
        }


COLUMNS = ("terms", "starts", "docs", "impacts", "lefts", "rights", "roots")


def _index(batches: Iterator[pa.RecordBatch], n_docs: int, n_terms: int, segment_docs: int) -> Iterator[pa.RecordBatch]:
    held, size = Builder(), 0
    kind: pa.DataType = pa.null()

    def row() -> pa.RecordBatch:
        made = held.segment(n_docs, n_terms)
        return pa.RecordBatch.from_arrays([pa.array([made["ids"]], pa.list_(kind)), *(pa.array([made[c]], pa.binary()) for c in COLUMNS)], ["ids", *COLUMNS])

    for batch in batches:
        kind = batch.column(0).type
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            if found := terms_of(text):
                held.add(i, found)
                size += len(text)
            if len(held.docs) >= segment_docs or size >= SEGMENT_BYTES:
                yield row()
                held, size = Builder(), 0
    if held.docs:
        yield row()


@dataclass
class LexicalIndex:
    """The segments, with the number of documents that have terms and of all their terms."""

    segments: DataFrame
    n_docs: int
    n_terms: int

    def save(self, path: str) -> None:
        spark = self.segments.sparkSession
        self.segments.write.parquet(f"{path}/segments")
        spark.createDataFrame([(self.n_docs, self.n_terms)], "docs long, terms long").write.parquet(f"{path}/totals")


def open_index(spark: SparkSession, path: str) -> LexicalIndex:
    docs, terms = spark.read.parquet(f"{path}/totals").first()
    return LexicalIndex(spark.read.parquet(f"{path}/segments"), docs, terms)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_docs: int = SEGMENT_DOCS) -> LexicalIndex:
    """An index of every row with at least one term, written to the shared folder. Each task reads its own rows and writes their segments; nothing is shuffled.

    About 10 bytes for each document and term of it, before compression; a worker holds one segment. Null, empty and termless texts are in no
    segment and count nowhere. Ids may repeat or be null: each row is a document of its own.
    """
    totals = docs.select(F.col(text_col).alias("text")).mapInArrow(_totals, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    n_docs, n_terms = (int(x or 0) for x in totals)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"ids array<{slim.schema['id'].dataType.simpleString()}>, " + ", ".join(f"{c} binary" for c in COLUMNS)
    # (without terms no segment is made, and the totals are not divided by)
    made = slim.mapInArrow(partial(_index, n_docs=n_docs, n_terms=n_terms, segment_docs=segment_docs), schema)
    return LexicalIndex(Scratch(docs.sparkSession, "lexical").write(made, "segments"), n_docs, n_terms)


class Segment:
    """One segment as its row was read; the terms that are asked for can be walked."""

    def __init__(self, row: dict[str, object], wanted: dict[bytes, int]):
        names = row["terms"].split(b" ")
        self.n_docs = len(row["ids"])
        starts, roots = np.frombuffer(row["starts"], "<u4").tolist(), np.frombuffer(row["roots"], "<u2")
        docs, impacts, lefts, rights = (memoryview(row[c]).cast(k) for c, k in (("docs", "H"), ("impacts", "I"), ("lefts", "H"), ("rights", "H")))
        doc_array, impact_array = np.frombuffer(row["docs"], "<u2"), np.frombuffer(row["impacts"], "<u4")
        self.lists: dict[bytes, tuple] = {}
        for t, name in enumerate(names):
            if name in wanted:
                a, b = starts[t], starts[t + 1]
                self.lists[name] = (docs[a:b], impacts[a:b], lefts[a:b], rights[a:b], int(roots[t]), doc_array[a:b], impact_array[a:b])

    def best(self, query: dict[bytes, int], k: int, least: int) -> list[tuple[int, int]]:
        """(score, number) of the k best documents of score `least` and more. query: each term's weight times its count."""
        lists = [(*self.lists[t], f) for t, f in query.items() if f > 0 and t in self.lists]
        top: list[tuple[int, int]] = []  # a heap of (score, -number)
        least = max(least, 1)

        def offer(score: int, number: int) -> None:
            if len(top) < k:
                heapq.heappush(top, (score, -number))
            elif (score, -number) > top[0]:
                heapq.heapreplace(top, (score, -number))

        def state(lo: int, hi: int, nodes: list[int]) -> None:
            """Push the range, with the subtree roots in it found from those of a wider one."""
            own, bound = [], 0
            for (docs, impacts, lefts, rights, *_, f), x in zip(lists, nodes):
                while x != NONE:
                    d = docs[x]
                    if d < lo:
                        x = rights[x]
                    elif d >= hi:
                        x = lefts[x]
                    else:
                        bound += f * impacts[x]
                        break
                own.append(x)
            if bound >= floor():
                heapq.heappush(open_, (-bound, lo, hi, own))

        def floor() -> int:
            return max(least, top[0][0]) if len(top) == k else least

        open_: list[tuple[int, int, int, list[int]]] = []
        state(0, self.n_docs, [x[4] for x in lists])
        while open_:
            bound, lo, hi, nodes = heapq.heappop(open_)
            if -bound < floor():
                break
            if len(top) == k and -bound == top[0][0] and lo > -top[0][1]:
                continue  # ties go to smaller numbers
            if hi - lo <= LEAF:
                total = np.zeros(hi - lo, np.int64)
                for (docs, *_, doc_array, impact_array, f), x in zip(lists, nodes):
                    if x != NONE:
                        a = bisect_left(docs, lo)
                        b = bisect_left(docs, hi, a)
                        total[doc_array[a:b] - np.int64(lo)] += f * impact_array[a:b].astype(np.int64)
                for at in np.flatnonzero(total >= floor()).tolist():
                    offer(int(total[at]), lo + at)
                continue
            # Split at the document of the heaviest root, which is scored in full.
            heaviest = max((i for i, x in enumerate(nodes) if x != NONE), key=lambda i: lists[i][-1] * lists[i][1][nodes[i]])
            pivot = lists[heaviest][0][nodes[heaviest]]
            score = 0
            for (docs, impacts, *_, f), x in zip(lists, nodes):
                if x != NONE:
                    at = bisect_left(docs, pivot)
                    if at < len(docs) and docs[at] == pivot:
                        score += f * impacts[at]
            if score >= floor():
                offer(score, pivot)
            if lo < pivot:
                state(lo, pivot, nodes)
            if pivot + 1 < hi:
                state(pivot + 1, hi, nodes)
        return [(score, -number) for score, number in top]


def _order(found: tuple[int, object]) -> tuple:
    score, name = found
    return -score, name is None, name


def _frequencies(batches: Iterator[pa.RecordBatch], wanted) -> Iterator[pa.RecordBatch]:
    """(term, df) of the terms asked for, summed over the segments of a task."""
    out: Counter[bytes] = Counter()
    for batch in batches:
        for terms, starts in zip(batch.column(0), batch.column(1)):
            n = np.diff(np.frombuffer(starts.as_py(), "<u4")).tolist()
            for name, df in zip(terms.as_py().split(b" "), n):
                if name in wanted.value:
                    out[name] += df
    yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array(list(out.values()), pa.int64())], ["term", "df"])


def _search(batches: Iterator[pa.RecordBatch], shared, k: int) -> Iterator[pa.RecordBatch]:
    """(query, id, score): the k best of each query over all segments of a task."""
    queries, wanted = shared.value
    best: dict[int, list[tuple[int, object]]] = {}
    kind: pa.DataType = pa.null()
    for batch in batches:
        kind = batch.schema.field("ids").type.value_type
        for at in range(batch.num_rows):
            row = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
            segment = Segment(row, wanted)
            for number, query in queries:
                so_far = best.get(number, [])
                found = segment.best(query, k, so_far[-1][0] if len(so_far) == k else 1)
                if found:
                    best[number] = sorted(so_far + [(s, row["ids"][n]) for s, n in found], key=_order)[:k]
    rows = [(number, name, score) for number, found in best.items() for score, name in found]
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), kind, pa.int64()))]
    if rows:
        yield pa.RecordBatch.from_arrays(columns, ["_query", "_id", "score"])


def _blocks(queries: DataFrame, block_terms: int) -> Iterator[list[tuple[int, Counter[bytes]]]]:
    """Queries by number, as many at a time as the bound allows, or one."""
    held: list[tuple[int, Counter[bytes]]] = []
    size = 0
    for row in queries.select("_query", "_text").toLocalIterator():
        found = terms_of(row["_text"])
        if held and size + len(found) > block_terms:
            yield held
            held, size = [], 0
        if found:
            held.append((row["_query"], found))
            size += len(found)
    if held:
        yield held


def search(index: LexicalIndex, queries: DataFrame, k: int = 20, block_terms: int = BLOCK_TERMS, query_col: str = "item_id", text_col: str = "text", id_name: str = "doc_id") -> DataFrame:
    """query_col, rank (from 1), id and score of the k documents with the highest scores above 0 for every row of queries; fewer where fewer have one.

    Equal scores go by ascending id, null ids last. Every row of queries is a query of its own, so a repeated one has its results twice; null, empty and termless ones have
    none, and so has an index of no documents. Queries go through the driver in blocks of block_terms distinct terms (some 50 MB), each a pass over the index, and are read
    from a written table, so that a lost executor changes none of them.
    """
    spark = queries.sparkSession
    scratch = Scratch(spark, "search")
    id_kind = index.segments.schema["ids"].dataType.elementType.simpleString()
    numbered = queries.select(F.monotonically_increasing_id().alias("_query"), F.col(query_col).alias("_name"), F.col(text_col).alias("_text"))
    numbered = scratch.write(numbered, "queries")
    found = None
    for block in _blocks(numbered, block_terms) if index.n_terms else ():
        terms = frozenset(t for _, q in block for t in q)
        asked = spark.sparkContext.broadcast(terms)
        df = index.segments.select("terms", "starts").mapInArrow(partial(_frequencies, wanted=asked), "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
        weight = {bytes(r.term): math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * r.df + 1))) for r in df.collect()}
        weighted = [(number, {t: n * weight[t] for t, n in q.items() if t in weight}) for number, q in block]
        shared = spark.sparkContext.broadcast((weighted, {t: 1 for t in weight}))
        part = index.segments.mapInArrow(partial(_search, shared=shared, k=k), f"_query long, _id {id_kind}, score long")
        place = F.row_number().over(Window.partitionBy("_query").orderBy(F.desc("score"), F.asc_nulls_last("_id")))
        part = scratch.write(part.withColumn("rank", place).where(F.col("rank") <= k), "found")
        found = part if found is None else found.unionByName(part)
        asked.unpersist()
        shared.unpersist()
    if found is None:
        found = spark.createDataFrame([], f"_query long, _id {id_kind}, score long, rank int")
    named = found.join(numbered.select("_query", "_name"), "_query")
    return named.select(F.col("_name").alias(query_col), "rank", F.col("_id").alias(id_name), "score")

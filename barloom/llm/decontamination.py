"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of a benchmark item: `window` consecutive words, or all of an item that has fewer. Patterns are grouped
by length. For each length, a table tells for every block of two words that occurs in a pattern how far
its last occurrence lies before the pattern's end; any other block lets the search move on by the
whole pattern. Only where a block ends a pattern (shift 0) is the bucket of that suffix and of the first block looked up and its patterns
compared word by word.

The windows are made, deduplicated and numbered in Spark, apart from the items that have them, so that neither a long item nor a window that many items share
makes a large group. Numbers are taken to the texts in groups of about `block_windows` windows, each a pass of its own over the texts that writes what it hit and nothing
else: driver and workers hold one group at a time (about half a kilobyte a window), however large the benchmark is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, split_hot_join

#: Rows of small tables (a number with an item's name, a text's digest) that may be broadcast.
BROADCAST_ROWS = 1_000_000
_LOWER = bytes(range(256)).lower()
#: Every byte of `[\x00-\x2F\x3A-\x60\x7B-\x7F]`, once A-Z are lower-cased, parts words; all bytes of other characters belong to words.
_WORDS = bytes(32 if c < 0x30 or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in _LOWER)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


class WuManber:
    """The patterns of one length, as tuples of word numbers, each with its window's number."""

    def __init__(self, length: int, patterns: dict[tuple[int, ...], int]):
        self.length, self.patterns = length, patterns
        self.block = min(2, length)
        self.most = length - self.block + 1
        self.shift: dict[tuple[int, ...], int] = {}
        self.bucket: dict[tuple[int, ...], list[tuple[int, ...]]] = {}
        for p in patterns:
            for end in range(self.block, length + 1):
                b = p[end - self.block : end]
                self.shift[b] = min(self.shift.get(b, self.most), length - end)
            self.bucket.setdefault(p[-self.block :] + p[: self.block], []).append(p)

    def search(self, ids: list[int]) -> Iterator[tuple[int, tuple[int, ...]]]:
        """(start, pattern) of every occurrence."""
        length, most, shift, bucket = self.length, self.most, self.shift.get, self.bucket
        n, at = len(ids), self.length
        if self.block == 1:
            for i, x in enumerate(ids):
                if (x, x) in bucket:
                    yield i, (x,)
            return
        while at <= n:
            block = (ids[at - 2], ids[at - 1])
            step = shift(block, most)
            if step:
                at += step
                continue
            start = at - length
            for p in bucket.get((*block, ids[start], ids[start + 1]), ()):
                if tuple(ids[start:at]) == p:
                    yield start, p
            at += 1


class Patterns:
    """One group of windows; words that no window has share the number -1."""

    def __init__(self, windows: dict[tuple[bytes, ...], int]):
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], int]] = {}
        for w, window in windows.items():
            ids = tuple(self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w)
            by_length.setdefault(len(w), {})[ids] = window
        self.searches = [WuManber(length, patterns) for length, patterns in sorted(by_length.items())]

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(start, end, window) of every occurrence."""
        number = self.vocabulary.get
        ids = [number(w, -1) for w in words]
        for search in self.searches:
            for start, p in search.search(ids):
                yield start, start + search.length, search.patterns[p]


def windows_of(text: str | None, window: int) -> Iterator[tuple[bytes, ...]]:
    words = words_of(text)
    if words:
        for i in range(max(1, len(words) - window + 1)):
            yield tuple(words[i : i + window])


def _windows(batches: Iterator[pa.RecordBatch], window: int, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """(item, window) with the window's words joined by spaces; an item of any length leaves in batches."""
    items: list[str] = []
    found: list[bytes] = []

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(found, pa.binary())], ["item", "window"])
        items.clear()
        found.clear()
        return made

    for batch in batches:
        for name, text in zip(batch.column("item").to_pylist(), batch.column("text")):
            for w in windows_of(text.as_py(), window):
                items.append(name)
                found.append(b" ".join(w))
                if len(items) == rows:
                    yield out()
    yield out()


def _add(spans: list[tuple[int, int]]) -> list[list[int]]:
    """The union of [start, end) spans."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _texts(spans: list[list[int]]) -> list[str]:
    return [f"{s}:{e}" for s, e in spans]


def digest(text: str | None) -> str:
    """As digest_of: 128 bits of SHA-256, empty for a null text."""
    return "" if text is None else hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:32]


def digest_of(text: Column) -> Column:
    return F.when(text.isNull(), "").otherwise(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def _search(batches: Iterator[pa.RecordBatch], patterns, only_hits: bool) -> Iterator[pa.RecordBatch]:
    """The columns but the text, with its digest, its words, and the spans and windows that were hit."""
    found = patterns.value
    for batch in batches:
        digests, n_words, spans, windows = [], [], [], []
        for text in batch.column("_text"):
            text = text.as_py()
            words = words_of(text)
            own: list[list[int]] = []
            hit: set[int] = set()
            for s, e, window in found.find(words):
                if own and own[-1][0] <= s <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], e)
                else:
                    own.append([s, e])
                hit.add(window)
            digests.append(digest(text))
            n_words.append(len(words))
            spans.append(_texts(_add(own)))
            windows.append(sorted(hit))
        rest = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n != "_text"]
        rest += [("_digest", pa.array(digests, pa.string())), ("_n_words", pa.array(n_words, pa.int64())), ("_spans", pa.array(spans, pa.list_(pa.string()))), ("_windows", pa.array(windows, pa.list_(pa.int64())))]
        out = pa.RecordBatch.from_arrays([c for _, c in rest], [n for n, _ in rest])
        yield out.filter(pa.array([bool(w) for w in windows])) if only_hits else out


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hits that several passes found in a text, as one."""
    for batch in batches:
        spans = [_texts(_add([tuple(map(int, s.split(":"))) for s in row])) for row in batch.column("_spans").to_pylist()]
        columns = [batch.column("_digest"), pa.array(spans, pa.list_(pa.string())), batch.column("_windows")]
        yield pa.RecordBatch.from_arrays(columns, ["_digest", "_spans", "_windows"])


_HITS = "_digest string, _n_words long, _spans array<string>, _windows array<long>"


def _numbered(benchmark: DataFrame, window: int, block_windows: int, scratch: Scratch, item_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int]:
    """windows (number, window) in folders by group; members (number, item); how many groups there are. A window, and an item of it, stands there once."""
    named = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))
    pairs = scratch.write(named.mapInArrow(partial(_windows, window=window), "item string, window binary").distinct(), "pairs")
    counted = scratch.write(pairs.groupBy("window").agg(F.count("*").alias("copies")).withColumn("number", F.monotonically_increasing_id()), "counted")
    groups = max(1, -(-counted.count() // block_windows))
    group = F.pmod(F.xxhash64("window"), F.lit(groups)).cast("int")
    windows = scratch.write(counted.select("number", "window", group.alias("group")), "windows", ("group",))
    members = scratch.write(split_hot_join(pairs, counted, "window", "copies", pairs.count()).select("number", "item"), "members")
    return windows, members, groups


def _scanned(rows: DataFrame, windows: DataFrame, groups: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """rows (with _text) without their texts, but with _digest, _n_words, and what the first group hit; and (_digest, _spans, _windows) of every text that any group hits."""
    spark = rows.sparkSession
    carried = rows.drop("_text")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in carried.schema.fields)
    scanned = hits = None
    for group in range(groups):
        held = {tuple(bytes(r.window).split(b" ")): r.number for r in windows.where(F.col("group") == group).select("number", "window").collect()}
        patterns = spark.sparkContext.broadcast(Patterns(held))
        if scanned is None:
            scanned = scratch.write(rows.mapInArrow(partial(_search, patterns=patterns, only_hits=False), fields + _HITS), "scanned")
            found = scanned.where(F.size("_windows") > 0)
        else:
            found = rows.select("_text").mapInArrow(partial(_search, patterns=patterns, only_hits=True), _HITS)
        # Equal texts have equal hits: one of them is enough.
        found = scratch.write(found.groupBy("_digest").agg(F.first("_spans").alias("_spans"), F.first("_windows").alias("_windows")), "hits")
        hits = found if hits is None else hits.unionByName(found)
        patterns.destroy()
    if groups > 1:
        joined = hits.groupBy("_digest").agg(F.flatten(F.collect_list("_spans")).alias("_spans"), F.array_sort(F.flatten(F.collect_list("_windows"))).alias("_windows"))
        hits = scratch.write(joined.mapInArrow(_united, joined.schema), "united")
    return scanned, hits


_N_HIT = "aggregate(_spans, 0L, (n, s) -> n + bigint(split_part(s, ':', 2)) - bigint(split_part(s, ':', 1)))"


def mark_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    min_share: int = 20,
    block_windows: int = 100_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """id, the columns in keep, n_words, n_hit, hit_spans (word numbers, "start:end"), items, contaminated of every row.

    contaminated: a word is hit and min_share x n_hit >= n_words. Null and empty texts have no words and are not
    contaminated; items without words have no window; a null item_id counts as an empty one. Rows with the same text get the same
    answer, ids may repeat or be null. An empty benchmark hits nothing, an empty table gives an empty one. A text of any length is searched whole by one worker.

    Items are looked up once for each set of windows that texts have hit, and texts that are equal share their hits. A list of items is as long as the
    items that have one of the windows.
    """
    scratch = Scratch(docs.sparkSession, "contamination")
    windows, members, groups = _numbered(benchmark, window, block_windows, scratch, item_col, item_text_col)
    scanned, hits = _scanned(docs.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_text")), windows, groups, scratch)

    hits = scratch.write(hits.withColumn("set", F.sha2(F.array_join("_windows", ","), 256)), "sets")
    few = members.count() <= BROADCAST_ROWS
    sets = scratch.write(hits.groupBy("set").agg(F.first("_windows").alias("_windows"), F.count("*").alias("texts")), "of-sets")
    numbers = sets.select("set", "texts", F.explode("_windows").alias("number"))
    items = numbers.join(F.broadcast(members) if few else members, "number").groupBy("set", "texts").agg(F.array_sort(F.collect_set("item")).alias("items"))
    items = scratch.write(items, "items")
    copies = scanned.groupBy("_digest").agg(F.count("*").alias("copies"))
    known = split_hot_join(hits, items, "set", "texts", hits.count()).join(copies, "_digest").select("_digest", F.col("_spans").alias("_all"), "items", "copies")
    known = scratch.write(known, "known")
    rows = split_hot_join(scanned.drop("_windows", "_spans"), known, "_digest", "copies", scanned.count(), how="left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"_spans": F.coalesce("_all", none), "items": F.coalesce("items", none)}).withColumn("_n_hit", F.expr(_N_HIT))
    return rows.select(
        F.col("_id").alias(id_col),
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)],
        F.col("_n_words").alias("n_words"),
        F.col("_n_hit").alias("n_hit"),
        F.col("_spans").alias("hit_spans"),
        "items",
        ((F.col("_n_hit") > 0) & (F.col("_n_hit") * min_share >= F.col("_n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, min_share: int = 20, block_windows: int = 100_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs that mark_contamination finds clean, with their columns, whatever they are called; null and empty texts are clean.

    The digests of contaminated texts are found first; the rows then pass by them and are never shuffled while those digests can be broadcast.
    """
    scratch = Scratch(docs.sparkSession, "clean")
    windows, _, groups = _numbered(benchmark, window, block_windows, scratch, item_col, item_text_col)
    scanned, hits = _scanned(docs.select(F.col(text_col).alias("_text")), windows, groups, scratch)
    lengths = scanned.groupBy("_digest").agg(F.first("_n_words").alias("_n_words"))
    bad = hits.withColumn("_n_hit", F.expr(_N_HIT)).join(lengths, "_digest").where(F.col("_n_hit") * min_share >= F.col("_n_words")).select("_digest")
    bad = scratch.write(bad, "bad")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), digest_of(F.col(text_col)).alias("_digest"))
    return rows.join(F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad, "_digest", "left_anti").select("_row.*")

"""Token counts by a two-tier lookup of pre-tokens.

A byte-level BPE splits a text into pre-tokens by a pattern and encodes each of them by itself, so a text has as many
tokens as its pre-tokens have together. The lengths of the most frequent pre-tokens are broadcast as
one table (at most `table_rows` entries, the bound of what is broadcast and of what reaches the driver); what it lacks is encoded by the library and remembered in a
cache of the worker. No pre-token of the documents is shuffled; the counts that choose the table are, and they come from a sample of about `sample_rows`
documents at any size. The table decides on speed alone: with any table, or none, the counts are the same.

Texts with a character that the pattern and the library could take for different things, or with the string of a special
token, are given to the library whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Scratch, least_count

#: Entries that a worker's cache may reach before it starts anew.
CACHE = 300_000


@lru_cache(maxsize=4)
def library(path: str) -> Tokenizer:
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


class Splitter:
    """Pre-tokens of a text, or None where only the library may split it.

    The library's notion of letters, numbers and white space may be of another Unicode version. Each character
    that occurs is tried once, beside one of every kind, and texts with one that is split differently are left alone.
    """

    def __init__(self, path: str, pattern: str):
        self.find = regex.compile(pattern).findall
        self.pre = library(path).pre_tokenizer
        self.special = [t.content for t in library(path).get_added_tokens_decoder().values()]
        self.same: set[str] = set()
        self.odd: set[str] = set()
        self.learn({chr(c) for c in range(128)})

    def learn(self, chars: set[str]) -> None:
        for c in chars:
            probe = f"a{c}a1{c}1!{c}! {c}{c} {c}"
            alike = [len(x) for x in self.find(probe)] == [e - s for _, (s, e) in self.pre.pre_tokenize_str(probe)]
            (self.same if alike else self.odd).add(c)

    def __call__(self, text: str) -> list[str] | None:
        if any(s in text for s in self.special):
            return None
        if self.odd or not text.isascii():
            chars = set(text) - self.same
            self.learn(chars - self.odd)
            if chars & self.odd:
                return None
        return self.find(text)


@lru_cache(maxsize=4)
def splitter(path: str, pattern: str) -> Splitter:
    return Splitter(path, pattern)


def _frequent(batches: Iterator[pa.RecordBatch], pattern: str, held: int) -> Iterator[pa.RecordBatch]:
    split, counts = regex.compile(pattern), Counter()
    for batch in batches:
        for text in batch.column(0):
            counts.update(split.findall(text.as_py() or ""))
        if len(counts) > CACHE:
            counts = Counter(dict(counts.most_common(held)))
    top = counts.most_common(held)
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])


class PieceLengths(dict):
    """Tokens of a pre-token: what the broadcast table lacks is encoded once and kept."""

    def __init__(self, table: dict[str, int], tokenizer: Tokenizer):
        super().__init__(table)
        self.table, self.tokenizer = table, tokenizer

    def __missing__(self, piece: str) -> int:
        if len(self) > len(self.table) + CACHE:
            self.clear()
            self.update(self.table)
        n = self[piece] = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        return n


_lengths: dict[int, PieceLengths] = {}


def _tokens(batches: Iterator[pa.RecordBatch], path: str, pattern: str, table) -> Iterator[pa.RecordBatch]:
    tokenizer = library(path)
    split = splitter(path, pattern)
    if table.id not in _lengths:
        _lengths.clear()
        _lengths[table.id] = PieceLengths(table.value, tokenizer)
    length = _lengths[table.id].__getitem__
    for batch in batches:
        n_bytes, n_tokens = [], []
        for text in batch.column("_text"):
            text = text.as_py() or ""
            n_bytes.append(len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass")))
            pieces = split(text)
            if pieces is None:
                n_tokens.append(len(tokenizer.encode(text, add_special_tokens=False).ids))
            else:
                n_tokens.append(sum(map(length, pieces)))
        rest = [(batch.column(i), name) for i, name in enumerate(batch.schema.names) if name != "_text"]
        made = [pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())]
        yield pa.RecordBatch.from_arrays([c for c, _ in rest] + made, [*(n for _, n in rest), "n_bytes", "n_tokens"])


class _Table:
    """A broadcast table with a name that workers can cache by."""

    def __init__(self, broadcast, name: int):
        self.broadcast, self.id = broadcast, name

    @property
    def value(self) -> dict[str, int]:
        return self.broadcast.value


_made = 0


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    pattern: str,
    table_rows: int = 50_000,
    sample_rows: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """id, n_bytes (UTF-8) and n_tokens of every row's whole text, without added special tokens.

    tokenizer: the path of a byte-level BPE file, the same on all machines; pattern: its pre-token pattern.
    Null texts count as empty: 0 and 0. Repeated rows and null ids are counted like any other, and an empty table gives an empty one. Other columns are not read.
    A text of any length is split whole by one worker.
    """
    global _made
    spark = docs.sparkSession
    texts = docs.select(id_col, F.col(text_col).alias("_text"))
    share = min(1.0, sample_rows / max(1, docs.count()))
    some = texts.select("_text").sample(withReplacement=False, fraction=share, seed=1) if share < 1 else texts.select("_text")
    pieces = some.mapInArrow(partial(_frequent, pattern=pattern, held=table_rows), "piece string, n long")
    counts = Scratch(spark, "tokens").write(pieces.groupBy("piece").agg(F.sum("n").alias("n")), "pieces")
    names = sorted(r.piece for r in counts.where(F.col("n") >= least_count(counts, table_rows)).select("piece").collect())
    local = library(tokenizer)
    lengths = [len(e.ids) for e in local.encode_batch(names, add_special_tokens=False)]
    _made += 1
    table = _Table(spark.sparkContext.broadcast(dict(zip(names, lengths))), _made)
    id_type = texts.schema[id_col].dataType.simpleString()
    return texts.mapInArrow(partial(_tokens, path=tokenizer, pattern=pattern, table=table), f"`{id_col}` {id_type}, n_bytes long, n_tokens long")

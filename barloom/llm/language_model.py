"""Language-model scoring by prediction by partial matching.

The model is a trie of byte contexts up to `order` bytes, with the counts of what followed each of them in the
training texts. A symbol that a context has not seen costs an escape (method C: as many escapes as distinct symbols) and is looked for in the
next shorter context, where the symbols that the longer one has seen are excluded; below the empty context all symbols left are
equally likely. A text ends with a symbol of its own. Counts are complete at every order, so what a longer context
has seen its suffix has seen too, and every exclusion is a constant of the longer context: the trie is kept as sorted arrays and
a hash table, and whole batches of texts are scored at once.

The order never falls. All that a symbol needs from contexts of two bytes or more is in the contexts that share its last two bytes, so the trie
falls into independent groups below the counts of single bytes (66,049 at most). The groups with the most symbols an entry are broadcast;
the grams a text has in the others are scored where those groups lie, and joined.

Beside it stands a smoothed unigram score over words. The counts of frequent words are broadcast; the others a text has are joined.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, least_count, split_hot_join

#: Bits of a symbol in a key; 256 is the end of a text, and fills the contexts before its start.
BITS, END = 9, 256
SYMBOLS = 257
#: Symbols that are handled at once, and distinct words that a worker holds.
CHUNK, HELD = 1_000_000, 300_000
GRAM, WORD = 0, 1
END_WORD = -1
#: Two bytes of context name a group of the trie.
GROUPS = 1 << 2 * BITS
#: Logarithms of grams that are joined are summed as integers, so that equal rows get equal scores.
UNIT = 1 << 32
#: What a word adds that no training text has.
UNSEEN = math.log10(0.5)


def _data(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _word_key(word: bytes) -> int:
    """A signed 64-bit hash; -1 is the end token's."""
    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def gram_keys(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol of each text: its `order` predecessors and itself, in one key. Also where each text starts."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths + 1 + order)[:-1]])
    symbols = np.full(int((lengths + 1 + order).sum()), END, np.int64)
    inside = np.ones(len(symbols), bool)
    for k in range(order):
        inside[starts + k] = False
    last = starts + order + lengths
    body = inside.copy()
    body[last] = False
    symbols[body] = np.frombuffer(b"".join(texts), np.uint8)
    keys = symbols[order:].copy()
    for k in range(1, order + 1):
        keys |= symbols[order - k : len(symbols) - k] << (BITS * k)
    keys = keys[inside[order:]]
    return keys, np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _count(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """Rows (kind, key, n) of the texts' grams and words."""
    words: Counter[bytes] = Counter()
    n_texts = 0
    grams: list[tuple[np.ndarray, np.ndarray]] = []
    waiting: list[bytes] = []
    size = 0

    def rows(kind: int, keys, counts) -> pa.RecordBatch:
        keys = pa.array(keys, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), keys, pa.array(counts, pa.int64())], ["kind", "key", "n"])

    def settle() -> None:
        nonlocal size
        if waiting:
            grams.append(np.unique(gram_keys(waiting, order)[0], return_counts=True))
            waiting.clear()
            size = 0
        if len(grams) > 1:
            merged = _summed(np.concatenate([k for k, _ in grams]), np.concatenate([c for _, c in grams]))
            grams[:] = [merged]

    for batch in batches:
        for text in batch.column(0):
            data = _data(text.as_py())
            words.update(data.split())
            n_texts += 1
            waiting.append(data)
            size += len(data)
            if size >= CHUNK:
                settle()
                if len(grams[0][0]) > 2 * CHUNK:
                    yield rows(GRAM, *grams.pop())
            if len(words) > HELD:
                yield rows(WORD, list(map(_word_key, words)), list(words.values()))
                words.clear()
    settle()
    if grams:
        yield rows(GRAM, *grams.pop())
    yield rows(WORD, [*map(_word_key, words), END_WORD], [*words.values(), n_texts])


class HashTable:
    """Keys to values by open addressing, looked up in whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, math.ceil(math.log2(2 * len(keys) + 1)))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.float32)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[at[todo]] == -1]
            self.keys[at[free]] = keys[free]
            placed = self.keys[at[todo]] == keys[todo]
            self.values[at[todo[placed]]] = values[todo[placed]]
            todo = todo[~placed]
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values, and the places of keys that the table lacks."""
        at = self._slot(keys)
        held = self.keys[at]
        out = self.values[at]
        todo = np.flatnonzero(held != keys)
        lacking = []
        at = at[todo]
        while len(todo):
            empty = self.keys[at] == -1
            lacking.append(todo[empty])
            todo, at = todo[~empty], (at[~empty] + 1) & (len(self.keys) - 1)
            found = self.keys[at] == keys[todo]
            out[todo[found]] = self.values[at[found]]
            todo, at = todo[~found], at[~found]
        return out, np.concatenate(lacking) if lacking else np.empty(0, np.int64)


@dataclass
class _Order:
    """One order: its (context, symbol) entries with counts, and its contexts."""

    keys: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    total: np.ndarray
    distinct: np.ndarray
    total_left: np.ndarray  # of the suffix context, without the symbols that this one has seen
    distinct_left: np.ndarray

    def context(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the keys' contexts, and whether they exist."""
        c = keys >> BITS
        at = np.minimum(np.searchsorted(self.contexts, c), max(0, len(self.contexts) - 1))
        return at, (self.contexts[at] == c) if len(self.contexts) else np.zeros(len(keys), bool)

    def count(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], 0)


class PPM:
    """The trie, from the counts of its highest order; or whole groups of it, with the counts of order 1 of all groups as `base`."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int, base: tuple[np.ndarray, np.ndarray] | None = None):
        self.order = order
        levels: list[tuple[np.ndarray, np.ndarray]] = [_summed(keys.astype(np.int64), counts.astype(np.int64))]
        for k in range(order, 0, -1):
            low = base if base and k == 2 else (levels[0][0] & ((1 << BITS * k) - 1), levels[0][1])
            levels.insert(0, _summed(*low))
        self.orders: list[_Order] = []
        for k, (own, n) in enumerate(levels):
            contexts, first, distinct = np.unique(own >> BITS, return_index=True, return_counts=True)
            total = np.add.reduceat(n, first) if len(first) else n
            if k:
                up = self.orders[k - 1]
                suffix = own & ((1 << BITS * k) - 1)
                excluded = np.add.reduceat(up.count(suffix), first) if len(first) else n
                above, _ = up.context((contexts & ((1 << BITS * (k - 1)) - 1)) << BITS)
                total_left = up.total[above] - excluded if len(first) else n
                distinct_left = up.distinct[above] - distinct if len(first) else n
            else:
                total_left = np.zeros(len(contexts), np.int64)
                distinct_left = SYMBOLS - distinct
            self.orders.append(_Order(own, n, contexts, total, distinct, total_left, distinct_left))
        top = self.orders[-1]
        at, _ = top.context(top.keys)
        self.table = HashTable(top.keys, np.log10(top.counts / (top.total[at] + top.distinct[at])))

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each key's symbol after its context."""
        out, todo = self.table.get(keys)
        out = out.astype(np.float64)
        if not len(todo):
            return out
        out[todo] = 0.0
        # Total and distinct symbols of the context at hand, without those a longer one has seen; -1: no longer context exists.
        total, distinct = np.full(len(todo), -1, np.int64), np.zeros(len(todo), np.int64)
        for k in range(self.order, -1, -1):
            level = self.orders[k]
            own = keys[todo] & ((1 << BITS * (k + 1)) - 1)
            at, exists = level.context(own)
            fresh = exists & (total < 0)
            if not len(level.contexts):
                continue
            total, distinct = np.where(fresh, level.total[at], total), np.where(fresh, level.distinct[at], distinct)
            n = level.count(own)
            seen = exists & (n > 0)
            out[todo[seen]] += np.log10(n[seen] / (total[seen] + distinct[seen]))
            escaped = exists & ~seen & (total + distinct > 0)  # with nothing left here the escape is certain
            out[todo[escaped]] += np.log10(distinct[escaped] / (total[escaped] + distinct[escaped]))
            left = ~seen
            total = np.where(exists, level.total_left[at], total)[left]
            distinct = np.where(exists, level.distinct_left[at], distinct)[left]
            todo = todo[left]
        out[todo] -= np.log10(np.where(total < 0, SYMBOLS, distinct))
        return out

    def score(self, texts: list[bytes], left_out: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """The score of each text without its grams in groups that are left out; those grams, and how often each occurs."""
        keys, starts = gram_keys(texts, self.order)
        if left_out is None:
            none = [np.empty(0, np.int64)] * len(texts)  # no view: that would hold the keys
            return np.add.reduceat(self.log10(keys), starts), none, none
        is_open = left_out[_group(keys)]
        logs = np.zeros(len(keys))
        logs[~is_open] = self.log10(keys[~is_open])
        at = np.append(starts, len(keys))
        found = [np.unique(keys[a:b][is_open[a:b]], return_counts=True) for a, b in zip(at[:-1], at[1:])]
        return np.add.reduceat(logs, starts), [k for k, _ in found], [n for _, n in found]


def _group(keys: np.ndarray) -> np.ndarray:
    return (keys >> BITS) & (GROUPS - 1)


def _open_logs(keys: pa.Table, grams: pa.Table, order: int, base) -> pa.Table:
    """The logarithms of open grams, from the groups of the trie that hold their contexts."""
    ppm = PPM(grams["key"].to_numpy(), grams["n"].to_numpy(), order, base.value)
    wanted = keys["key"].to_numpy()
    return pa.table({"key": keys["key"], "copies": keys["copies"], "log": pa.array(ppm.log10(wanted), pa.float64())})


def _score(batches: Iterator[pa.RecordBatch], model, frequent, complete: bool) -> Iterator[pa.RecordBatch]:
    """Scores, with the grams of groups that the model leaves out left open, and unless `frequent` is complete the words that it lacks. _row names a row of the written result."""
    (ppm, left_out), logs = model.value, _logs(frequent)
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        texts = [_data(t.as_py()) for t in batch.column("_text")]
        n_tokens, n_known, part, open_words, open_counts, scores, open_grams, gram_counts = [], [], [], [], [], [], [], []
        for data in texts:
            counts = Counter(map(xxhash.xxh3_64_intdigest, data.split()))
            known, total, words, times = 1, 0.0, [], []
            for h, n in counts.items():
                log = logs.get(h)
                if log is None and complete:
                    total += n * UNSEEN
                elif log is None:
                    words.append(h)
                    times.append(n)
                else:
                    known += n
                    total += n * log
            n_tokens.append(counts.total() + 1)
            n_known.append(known)
            part.append(total)
            open_words.append(np.array(words, np.uint64).view(np.int64))
            open_counts.append(times)
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
                size += len(texts[end])
                end += 1
            found, grams, times = ppm.score(texts[at:end], left_out)
            scores.extend(found.tolist())
            open_grams.extend(grams)
            gram_counts.extend(times)
            at = end
        made = {
            "_row": pa.array(range(row, row + len(texts)), pa.int64()),
            "n_tokens": pa.array(n_tokens, pa.int64()),
            "_known": pa.array(n_known, pa.int64()),
            "_part": pa.array(part, pa.float64()),
            "score": pa.array(scores, pa.float64()),
            "_words": pa.array(open_words, pa.list_(pa.int64())),
            "_times": pa.array(open_counts, pa.list_(pa.int64())),
            "_grams": pa.array(open_grams, pa.list_(pa.int64())),
            "_gram_times": pa.array(gram_counts, pa.list_(pa.int64())),
        }
        row += len(texts)
        kept = [n for n in batch.schema.names if n != "_text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *made.values()], [*kept, *made])


_held: list = [None, None]


def _logs(frequent) -> dict[int, float]:
    """The broadcast words as a dictionary, made once a worker."""
    if _held[0] is not frequent.value:
        keys, counts = frequent.value
        _held[:] = frequent.value, dict(zip(keys.view(np.uint64).tolist(), np.log10(counts + 0.5).tolist()))
    return _held[1]


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 1) -> Column:
    """Whether crc32 of the id as text, mod folds, is fold; a null id counts as an empty text."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(name.cast("binary")) % folds == fold


def score_documents(
    docs: DataFrame,
    training: Column | None = None,
    order: int = 3,
    max_entries: int = 2_000_000,
    frequent_words: int = 400_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 of the text's probability) of every row.

    training: which rows to learn from, by default those that held_out() does not name. The trie has the same order at every size.
    max_entries decides on speed alone: so many of its entries are broadcast (below order 2 all, 66,049 at most), about 100 bytes each in the driver and in
    every worker, and as many words as frequent_words says, about 150 bytes each; the others stay in the written counts and are met by join. Null texts count as empty: one end token.
    With nothing to learn from, every symbol is equally likely and base_score is that of unseen tokens. Equal rows get equal scores.
    Ids may repeat or be null; an empty table gives an empty one. A text of any length is scored whole, a million symbols or one text at a time.
    Words are told apart by 64-bit hashes. order: 1 to 6; a higher one knows more of its context and has a larger trie.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    training = ~held_out(id_col) if training is None else training
    learn = docs.where(training).select(F.col(text_col).alias("text"))
    counted = learn.mapInArrow(partial(_count, order=order), "kind int, key long, n long")
    counted = scratch.write(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")

    grams = counted.where(F.col("kind") == GRAM).select("key", "n")
    base, left_out, n_entries, kept = None, None, 0, grams
    if order >= 2:
        low = grams.groupBy(F.col("key").bitwiseAND(F.lit(GROUPS - 1)).alias("key")).agg(F.sum("n").alias("n")).toPandas()
        base = low["key"].to_numpy(np.int64), low["n"].to_numpy(np.int64)
        group = F.shiftright("key", BITS).bitwiseAND(F.lit(GROUPS - 1))
        sums = grams.groupBy(group.alias("g")).agg(F.count("*").alias("entries"), F.sum("n").alias("n")).toPandas()
        n_entries = int(sums["entries"].sum())
        if n_entries > max_entries:
            g, entries = sums["g"].to_numpy(np.int64), sums["entries"].to_numpy(np.int64)
            by = np.lexsort([g, -sums["n"].to_numpy(np.int64) / entries])
            chosen = g[by[np.cumsum(entries[by]) <= max_entries]]
            left_out = np.zeros(GROUPS, bool)
            left_out[np.setdiff1d(g, chosen)] = True
            names = spark.createDataFrame([(x,) for x in chosen.tolist()], "g long")
            kept = grams.withColumn("g", group).join(F.broadcast(names), "g", "left_semi").select("key", "n")
    found = kept.toPandas()
    model = spark.sparkContext.broadcast((PPM(found["key"].to_numpy(np.int64), found["n"].to_numpy(np.int64), order, base), left_out))
    del found

    words = counted.where(F.col("kind") == WORD).select("key", "n")
    sums = words.agg(F.sum("n").alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
    train_tokens, distinct = int(sums["n"] or 0), int(sums["v"])
    ends = words.where(F.col("key") == END_WORD).agg(F.sum("n")).first()[0] or 0
    plain = words.where((F.col("key") != END_WORD) & (F.col("n") > 0))
    common = plain.where(F.col("n") >= least_count(plain, frequent_words)).toPandas()
    complete = len(common) == plain.count()
    frequent = spark.sparkContext.broadcast((common["key"].to_numpy(np.int64), common["n"].to_numpy(np.int64)))

    slim = docs.select(id_col, F.coalesce(~training, F.lit(True)).alias("held_out"), F.col(text_col).alias("_text"))
    kind = slim.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, held_out boolean, _row long, n_tokens long, _known long, _part double, score double, _words array<long>, _times array<long>, _grams array<long>, _gram_times array<long>"
    scored = scratch.write(slim.mapInArrow(partial(_score, model=model, frequent=frequent, complete=complete), schema), "scored")

    joined, score = scored, F.col("score")
    if complete:
        joined = scored.withColumns({"_more": F.lit(0).cast("long"), "_rest": F.lit(0.0)})
    else:
        open_words = scored.select("_row", F.explode(F.arrays_zip("_words", "_times")).alias("w")).select("_row", F.col("w._words").alias("key"), F.col("w._times").alias("times"))
        wanted = open_words.groupBy("key").agg(F.count("*").alias("copies"))
        wanted = scratch.write(wanted.join(plain.select("key", F.col("n").alias("c")), "key", "left").select("key", "copies", F.coalesce("c", F.lit(0)).alias("c")), "open-words")
        n_open = wanted.agg(F.sum("copies")).first()[0] or 0
        rest = split_hot_join(open_words, wanted, "key", "copies", n_open).groupBy("_row").agg(
            F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("_more"), F.sum(F.col("times") * F.log10(F.col("c") + F.lit(0.5))).alias("_rest")
        )
        joined = scored.join(rest, "_row", "left")
    base_score = F.col("_part") + F.coalesce("_rest", F.lit(0.0)) + math.log10(ends + 0.5) - F.col("n_tokens") * math.log10(train_tokens + 0.5 * (distinct + 1))
    end_known = 0 if ends else 1
    if left_out is not None:
        open_grams = scored.select("_row", F.explode(F.arrays_zip("_grams", "_gram_times")).alias("g")).select("_row", F.col("g._grams").alias("key"), F.col("g._gram_times").alias("times"))
        shard = F.pmod(F.xxhash64(group), F.lit(8 + n_entries // 250_000)).alias("shard")
        asked = open_grams.groupBy("key").agg(F.count("*").alias("copies")).select("key", "copies", shard)
        others = grams.join(F.broadcast(names), group == F.col("g"), "left_anti").select("key", "n", shard)
        logs = asked.groupBy("shard").cogroup(others.groupBy("shard")).applyInArrow(partial(_open_logs, order=order, base=spark.sparkContext.broadcast(base)), "key long, copies long, log double")
        logs = scratch.write(logs, "logs")
        n_open = logs.agg(F.sum("copies")).first()[0] or 0
        met = split_hot_join(open_grams, logs, "key", "copies", n_open)
        more = met.groupBy("_row").agg(F.sum(F.round(F.col("times") * F.col("log") * UNIT).cast("long")).alias("_open"))
        joined, score = joined.join(more, "_row", "left"), score + F.coalesce("_open", F.lit(0)) / F.lit(float(UNIT))
    return joined.select(
        id_col,
        "held_out",
        "n_tokens",
        (F.col("_known") + F.coalesce("_more", F.lit(0)) - end_known).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        base_score.alias("base_score"),
        score.alias("score"),
    )

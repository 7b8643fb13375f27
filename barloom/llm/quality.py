"""Quality rules: plain rules first, then gradient-boosted trees over document statistics.

The trees are fitted here on labelled documents (at most `fit_rows` of them, taken in a seeded order) with the logistic loss,
on binned features, and with monotonic constraints: a higher share of symbols, say, never raises the score. All
trees are flattened into numpy node arrays that score a batch of documents at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
WINDOW = 5

#: Features, each with the sign of its constraint: -1 where more of it must not raise the score, 0 where it is free.
FEATURES = {
    "log_words": 0,
    "mean_word_chars": 0,
    "symbol_share": -1,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_word_share": -1,
    "distinct_word_share": 0,
    "upper_share": -1,
    "digit_share": 0,
    "mean_line_words": 0,
    "end_share": 0,
    "top_word_share": -1,
    "bang_share": -1,
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_DIGITS = b"0123456789"


def repeat_words(ids: np.ndarray, n_ids: int, window: int = WINDOW) -> int:
    """How many words stand in a window that occurs twice or more."""
    n = len(ids) - window + 1
    if n < 2 or n_ids == len(ids):
        return 0
    codes, size = ids, n_ids
    for k in range(1, window):
        if size * n_ids >= 1 << 62:  # keep the codes exact: number those that occur
            codes = np.unique(codes, return_inverse=True)[1]
            size = len(codes)
        codes = codes[:-1] * n_ids + ids[k:]
        size *= n_ids
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """COUNTS and FEATURES of one whole text; a null text has no words."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    lines = data.split(b"\n")
    seen: set[bytes] = set()
    n_dup = n_lines = 0
    for line in lines:
        if line.strip():
            n_lines += 1
            if line in seen:
                n_dup += 1
            else:
                seen.add(line)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    n_symbols = len(data) - len(data.translate(None, SYMBOLS))
    n_repeat = repeat_words(ids, len(number))
    per_word, per_char, per_line = max(1, n), max(1, chars), max(1, n_lines)
    top = int(np.bincount(ids).max()) if n else 0
    features = (
        float(np.log1p(n)),
        chars / per_word,
        n_symbols / per_char,
        n_symbols / per_word,
        n_dup / per_line,
        n_repeat / per_word,
        len(number) / per_word,
        (len(data) - len(data.translate(None, _UPPER))) / per_char,
        (len(data) - len(data.translate(None, _DIGITS))) / per_char,
        n / per_line,
        (data.count(b".") + data.count(b"?")) / per_word,
        top / per_word,
        data.count(b"!") / per_word,
    )
    return (n, chars, n_symbols, n_dup, n_repeat), features


@dataclass
class Trees:
    """Node arrays of all trees; node 0 of a tree is roots[t], a leaf is its own child."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    bias: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """The log-odds of each row."""
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, signs: np.ndarray, n_trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: int = 5) -> Trees:
    """Boosted trees for 0/1 labels y. With one class, or no rows, the trees say that class for all."""
    share = float(y.mean()) if len(y) else 1.0
    bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    nodes: list[list[float]] = []
    roots: list[int] = []
    if len(y) and 0 < share < 1:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        margin = np.full(len(y), bias)

        def weight(g: np.ndarray, h: np.ndarray, lo: float, hi: float) -> np.ndarray:
            return np.clip(-g / (h + ridge), lo, hi)

        def gain(g: np.ndarray, h: np.ndarray, w: np.ndarray) -> np.ndarray:
            return -(2 * g * w + (h + ridge) * w * w)

        def grow(rows: np.ndarray, level: int, lo: float, hi: float) -> int:
            g, h = grad[rows], hess[rows]
            own = float(weight(g.sum(), h.sum(), lo, hi))
            me = len(nodes)
            nodes.append([0, np.inf, me, me, own * rate])
            best = (1e-6, -1, -1, 0.0, 0.0)
            if level < depth and len(rows) >= 2 * least:
                base = float(gain(g.sum(), h.sum(), np.float64(own)))
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = binned[rows, f]
                    gl, hl, nl = (np.bincount(b, z, len(c) + 1).cumsum()[:-1] for z in (g, h, None))
                    gr, hr = g.sum() - gl, h.sum() - hl
                    wl, wr = weight(gl, hl, lo, hi), weight(gr, hr, lo, hi)
                    better = gain(gl, hl, wl) + gain(gr, hr, wr) - base
                    better[(nl < least) | (len(rows) - nl < least) | (signs[f] * (wr - wl) < 0)] = -np.inf
                    k = int(better.argmax())
                    if better[k] > best[0]:
                        best = (float(better[k]), f, k, float(wl[k]), float(wr[k]))
            if best[1] >= 0:
                _, f, k, wl, wr = best
                middle, go = (wl + wr) / 2, binned[rows, f] <= k
                bounds = [(lo, hi), (lo, hi)] if not signs[f] else [(lo, middle), (middle, hi)] if signs[f] > 0 else [(middle, hi), (lo, middle)]
                nodes[me][:2] = [f, float(cuts[f][k])]
                nodes[me][2] = grow(rows[go], level + 1, *bounds[0])
                nodes[me][3] = grow(rows[~go], level + 1, *bounds[1])
            return me

        for _ in range(n_trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = p - y, p * (1 - p)
            roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
            part = _arrays(nodes, roots[-1:], 0.0, depth)
            margin += part.score(x)
    return _arrays(nodes, roots, bias, depth)


def _arrays(nodes: list[list[float]], roots: list[int], bias: float, depth: int) -> Trees:
    a = np.array(nodes, dtype=np.float64).reshape(-1, 5)
    whole = [a[:, k].astype(np.int64) for k in (0, 2, 3)]
    return Trees(np.array(roots, dtype=np.int64), whole[0], a[:, 1], whole[1], whole[2], a[:, 4], bias, depth)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [list(statistics(t.as_py())[1]) for t in batch.column("_text")]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_y"), pa.array(rows, pa.list_(pa.float64()))], ["id", "y", "x"])


def lowest_digests(named: DataFrame, rows: int) -> DataFrame:
    """The `rows` rows with the lowest digests of `_id`, which is unique. No more than a fifth over that many digests reach the driver."""
    digest = F.md5(F.col("_id").cast("string"))
    total = named.count()
    if total <= rows:
        return named
    share = min(1.0, (1.2 * rows + 100) / total)
    low = named.select(digest.alias("d")).where(F.col("d") < f"{int(share * (1 << 64)):016x}" if share < 1 else F.lit(True))
    cut = sorted(r.d for r in low.collect())[rows - 1]
    return named.where(digest <= cut)


def fit_quality(
    docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **how
) -> Trees:
    """Trees from labelled documents. fit_rows bounds how many labelled ids are used; those with the lowest digests are.

    Null ids, null labels, labels without a document, and ids whose labels disagree are left out; without any, all documents pass. An id that
    several documents have counts once, with the least of their features.
    """
    named = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_y"), F.max(label_col).alias("_most"))
    named = lowest_digests(named.where("_y = _most").select("_id", "_y"), fit_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(named), "_id")
    kind = rows.schema["_id"].dataType.simpleString()
    found = rows.select("_id", F.col("_y").cast("int").alias("_y"), "_text").mapInArrow(_features, f"id {kind}, y int, x array<double>")
    found = found.groupBy("id").agg(F.min(F.struct("y", "x")).alias("one")).select("one.*").toPandas()
    x = np.stack(found["x"].to_list()) if len(found) else np.zeros((0, len(FEATURES)))
    y = found["y"].to_numpy(np.float64)
    order = np.lexsort((*x.T, y))  # the order in which rows arrive must not matter
    return fit_trees(x[order], y[order], np.array(list(FEATURES.values())), **how)


def _judge(batches: Iterator[pa.RecordBatch], trees, least_score: float, only_kept: bool, extra: bool) -> Iterator[pa.RecordBatch]:
    model = trees.value
    for batch in batches:
        if not batch.num_rows:
            continue
        found = [statistics(t.as_py()) for t in batch.column("_text")]
        counts = np.array([c for c, _ in found], np.int64)
        score = model.score(np.array([f for _, f in found]))
        failed = (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])
        kept = ~failed & (score >= least_score)
        rest = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n != "_text"]
        if extra:
            rest += [(n, pa.array(counts[:, i])) for i, n in enumerate(COUNTS)]
            rest += [("base_failed", pa.array(failed)), ("score", pa.array(score)), ("kept", pa.array(kept))]
        out = pa.RecordBatch.from_arrays([c for _, c in rest], [n for n, _ in rest])
        yield out.filter(pa.array(kept)) if only_kept else out


def judge_quality(docs: DataFrame, trees: Trees, least_score: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, COUNTS, base_failed, score and kept of every row's whole text.

    base_failed: fewer than 10 words, or more than 20 % of the words in repeated 5-word windows; that overrules the trees.
    A null or empty text has no words and fails. Equal texts get equal verdicts; ids may repeat or be null. An empty table gives an empty one. A text of
    any length is judged whole by one worker.
    """
    slim = docs.select(id_col, F.col(text_col).alias("_text"))
    kind = slim.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, kept boolean"
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    return slim.mapInArrow(partial(_judge, trees=shared, least_score=least_score, only_kept=False, extra=True), schema)


def filter_quality(docs: DataFrame, trees: Trees, least_score: float = 0.0, text_col: str = "text") -> DataFrame:
    """The rows of docs that judge_quality keeps, with their columns, whatever they are called: not those with null, empty or short texts. Repeated
    rows are judged alike; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).alias("_text"))
    kept = rows.mapInArrow(partial(_judge, trees=shared, least_score=least_score, only_kept=True, extra=False), rows.select("_row").schema)
    return kept.select("_row.*")

"""Search against scores of every document, and the treaps against their definition."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from barloom.llm import lexical_search
from barloom.llm.lexical_search import NONE, Builder, build_index, count_terms, open_index, search, terms_of, treap

from .conftest import ROWS, frame, words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", "...", "A a", "Überraß É\u0085x", "a\x00b-c_d", "x" * 100_000, "q " * 5000, "9z\U0001d4d0", "tail"]


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(rows, queries, k=20):
    """rows: (id, text); queries: (item, text)."""
    docs = [(i, Counter(terms(t))) for i, t in rows]
    n_docs, total = sum(bool(c) for _, c in docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in queries:
        scored = []
        for i, c in docs:
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * (100 - 25 + 25 * c.total() * n_docs // total)))
            if score > 0:
                scored.append((-score, i is None, i))
        scored.sort()
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def result(df, item="item_id"):
    return sorted((tuple(r) for r in df.select(item, "rank", "doc_id", "score").collect()), key=str)


def test_terms():
    for t in [*ODD, *(t for _, t, _ in ROWS)]:
        assert {k.decode(): n for k, n in terms_of(t).items()} == Counter(terms(t))
    for piece in (4 << 20, 1000, 3):
        assert count_terms(pa.array(ODD), piece).tolist() == [len(terms(t)) for t in ODD]
        assert count_terms(pa.array(ODD)[2:6], piece).tolist() == [len(terms(t)) for t in ODD[2:6]]


def test_terms_of_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(lexical_search, "PIECE", 50)
    text = words(3000, 1) + "," + "z" * 500
    assert {k.decode(): n for k, n in terms_of(text).items()} == Counter(terms(text))


def test_treap_is_a_search_tree_and_a_heap():
    r = random.Random(1)
    for n in (1, 2, 3, 50, 400):
        priority = [r.randrange(1 << 30) for _ in range(n)]
        left, right, root = treap(priority)

        def walk(x):
            if x == NONE:
                return []
            for child in (left[x], right[x]):
                assert child == NONE or priority[child] <= priority[x]
            return [*walk(left[x]), x, *walk(right[x])]

        assert walk(root) == list(range(n))


@pytest.mark.parametrize("leaf", [1, 4, 1000])
def test_segment_against_all_scores(leaf, monkeypatch):
    """Every document of a segment, with ties, hot terms, and a least score given."""
    monkeypatch.setattr(lexical_search, "LEAF", leaf)
    r = random.Random(leaf)
    texts = [words(r.randrange(1, 60), i) for i in range(250)] + ["tie alpha0"] * 40 + ["the hot " * 3] * 60
    docs = [(i, terms_of(t)) for i, t in enumerate(texts)]
    n_docs, total = len(docs), sum(c.total() for _, c in docs)
    held = Builder()
    for doc in docs:
        held.add(*doc)
    row = held.segment(n_docs, total)
    for seed in range(25):
        query = dict.fromkeys(terms_of(words(r.randrange(1, 12), seed) + r.choice([" tie", " hot the", " none", ""])), 0)
        query = {t: r.randrange(0, 5000) for t in query}
        segment = lexical_search.Segment(row, dict.fromkeys(query, 1))
        scores = sorted(((sum(f * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * (75 + 25 * c.total() * n_docs // total))) for t, f in query.items() if c[t]), i) for i, c in docs), key=lambda x: (-x[0], x[1]))
        scores = [x for x in scores if x[0] > 0]
        for k in (1, 5, 300):
            assert sorted(segment.best(query, k, 1), key=lambda x: (-x[0], x[1])) == scores[:k]
            if scores:
                least = scores[min(3, len(scores) - 1)][0]
                assert sorted(segment.best(query, k, least), key=lambda x: (-x[0], x[1])) == [x for x in scores if x[0] >= least][:k]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    made = [(1000 + i, words(r.randrange(1, 80), i), "hot") for i in range(400)] + [(2000 + i, "same short text", "hot") for i in range(200)]
    return ROWS + made + [(3000 + i, t, "odd") for i, t in enumerate(ODD)]


QUERIES = [(1, words(12, 3)), (2, "same SAME text"), (3, "the-of;and"), (4, None), (5, ""), (6, "unknownterm"), (None, "Überraß"), (7, words(200, 5)), (7, "one two"), (1, words(12, 3)), (8, "?!"), (9, "q")]


@pytest.mark.parametrize("segment_docs", [5, 64, 8192])
def test_search_like_brute_force(spark, rows, segment_docs):
    queries = spark.createDataFrame([(i, t, "x", 1) for i, t in QUERIES], "item_id long, text string, _query string, rank int")
    index = build_index(frame(spark, rows).repartition(5), segment_docs=segment_docs)
    assert result(search(index, queries)) == brute([x[:2] for x in rows], QUERIES)
    assert result(search(index, queries, k=3, block_terms=10)) == brute([x[:2] for x in rows], QUERIES, 3)


def test_saved_index_text_ids_and_empty_tables(spark, rows, empty, tmp_path):
    named = frame(spark, rows).selectExpr("'d' || doc_id as doc_id", "text")
    index = build_index(named)
    index.save(f"file://{tmp_path}/index")
    again = open_index(spark, f"file://{tmp_path}/index")
    queries = spark.createDataFrame([(str(i), t) for i, t in QUERIES], "item_id string, text string")
    want = brute([(i if i is None else f"d{i}", t) for i, t, _ in rows], [(str(i), t) for i, t in QUERIES])
    assert result(search(again, queries)) == want
    assert search(build_index(empty), queries).count() == 0
    assert search(index, queries.limit(0)).count() == 0
    assert search(index, queries).columns == ["item_id", "rank", "doc_id", "score"]

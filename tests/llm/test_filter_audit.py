"""The audit against a plain count of every order, and the buffer scan against plain text functions."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from barloom.llm import filter_audit
from barloom.llm.filter_audit import Limits, audit_filters, count_texts

from .conftest import ROWS, frame, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    None, "", " ", "\n\t \x0b\x0c\r", "a", "a a a", "ab abc abcd abcdefgh abcdefghi abcdefgh abcdefghi", "x" * 700 + " " + "x" * 700 + " " + "x" * 699 + "y", "Überraß \U0001d4d0 naïve É É", "\x1c\x85 a\x00b",
    "A#B$ c%", "12345678 123456789 1234567\x00 1234567", "same words " * 300, words(5000, 3), "q" * 5000,
]


def plain(text):
    text = text or ""
    found = WORD.findall(text)
    return [len(found), len(set(found)), len(re.findall("[A-Z]", text)), len(re.findall(r"[#$%&*|]", text)), len(text)]


@pytest.mark.parametrize("piece", [1 << 20, 1000, 64, 7])
@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_scan_counts_like_plain_text(piece, kind):
    """Pieces of any size, nulls, words over many windows, sliced arrays."""
    texts = pa.array(ODD, kind)
    assert count_texts(texts, Limits().classes(), piece).tolist() == [plain(t) for t in ODD]
    assert count_texts(texts[4:9], Limits().classes(), piece).tolist() == [plain(t) for t in ODD[4:9]]
    assert count_texts(texts[:0], Limits().classes(), piece).tolist() == []


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(filter_audit.Words, "hashes", lambda self: self.length.astype(np.uint64) % np.uint64(3))
    for piece in (1 << 20, 50):
        assert count_texts(pa.array(ODD), Limits().classes(), piece).tolist() == [plain(t) for t in ODD]


def brute(rows, labels):
    """rows: (id, text, part); labels: (id, quality, toxic)."""
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    docs = []
    for i, t, part in rows:
        n, distinct, capitals, symbols, points = plain(t)
        fails = {"A": n < 200, "B": 100 * distinct < 50 * n, "C": 100 * capitals > 2 * points, "D": symbols > 0, "E": i is not None and i > least[t or ""]}
        docs.append((part or "", frozenset(f for f in fails if fails[f]), i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        removed_at = defaultdict(int)
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            before = set()
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                own = [d for d in docs if d[0] == part]
                left = [d for d in left if f not in d[1]]
                removed_at[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in d[1] and bool(d[1] & before) for d in own), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone), f]
                before.add(f)
        for key, v in out.items():
            if key[0] == part:
                v[6] = removed_at[v[6]]
    return out


def result(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    texts = [t for t in ODD if t is None or len(t) < 6000] + [words(n, 50 + n) for n in (199, 200, 201, 260)] + ["A " * 150 + words(100, 9), words(300, 8) + " #", ""]
    made = [(i, r.choice(texts), r.choice(["hot", "hot", "b", "", None])) for i in range(120)]
    return ROWS + made + made[:5] + [(None, texts[4], "b"), (None, None, None), (made[3][0], "another text", "c")]


def test_audit_like_brute_force(spark, rows):
    labels = [(i, i % 2 if i % 5 else None, int(i % 7 == 0)) for i in range(0, 130, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (999999, 1, 1)]
    named = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert result(audit_filters(frame(spark, rows).repartition(5), named)) == brute(rows, labels)


def test_audit_without_labels_or_documents(spark, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_filters(empty, none).count() == 0
    assert result(audit_filters(frame(spark), none)) == brute(ROWS, [])


def test_audit_of_a_hot_text(spark):
    """A third of all rows has one text, in many parts."""
    rows = [(i, "copy" if i % 3 == 0 else words(20, i), f"s{i % 7}") for i in range(3000)]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = result(audit_filters(frame(spark, rows), none))
    assert found == brute(rows, [])
    assert sum(v[1] for (_, order, step), v in found.items() if order == "EABCD" and step == 1) == 999

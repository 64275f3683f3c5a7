"""Removal of repeated byte strings against plain loops over all strings."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.llm import suffixes

KIND = "doc_id long, text string"


def plain_removal(rows, length):
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row."""
    data = [(d, (t or "").encode()) for d, t in rows]
    order = [(d is None, d or 0) for d, _ in data]
    first = {}
    for (_, x), o in zip(data, order):
        for i in range(len(x) - length + 1):
            w = x[i : i + length]
            first[w] = min(first.get(w, o), o)
    out = []
    for (d, x), o in zip(data, order):
        gone, seen = [False] * len(x), set()
        for i in range(len(x) - length + 1):
            w = x[i : i + length]
            if first[w] < o or w in seen:
                gone[i : i + length] = [True] * length
            seen.add(w)
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out.append((d, len(x), sum(gone), spans, bytes(b for b, g in zip(x, gone) if not g)))
    return sorted(out, key=repr)


def removal(df):
    return sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.select("doc_id", *suffixes.ADDED).collect()), key=repr)


def documents(seed, n, alphabet="ab"):
    rng = random.Random(seed)
    some = ["".join(rng.choice(alphabet) for _ in range(rng.randint(6, 40))) for _ in range(6)]
    ids = [*range(n), None, None, 3, 3]
    rows = [(i, "".join(rng.choice(some) if rng.random() < 0.6 else rng.choice(alphabet) for _ in range(rng.randint(0, 9)))) for i in ids]
    rows += [rows[2], rows[2], (None, rows[1][1]), (50, None), (51, ""), (52, "a" * 300), (53, "ab" * 90), (54, "ä€" * 20), (55, "x" + "ä€" * 20)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, length, gram, alphabet", [(1, 8, 3, "ab"), (2, 9, 2, "abcdefgh"), (3, 5, 8, "ab"), (4, 16, 4, "abc")])
def test_removal_is_that_of_plain_loops(spark, seed, length, gram, alphabet):
    rows = documents(seed, 25, alphabet)
    assert removal(suffixes.remove_strings(spark.createDataFrame(rows, KIND).repartition(3), length, gram)) == plain_removal(rows, length)


@pytest.mark.parametrize("seed", [5, 6])
def test_frequent_names_are_spread_with_the_same_result(spark, monkeypatch, seed):
    monkeypatch.setattr(suffixes, "SAMPLE", 1)
    monkeypatch.setattr(suffixes, "FREQUENT", 2)
    monkeypatch.setattr(suffixes, "SHARE", 1 << 20)
    rows = documents(seed, 25)
    assert removal(suffixes.remove_strings(spark.createDataFrame(rows, KIND).repartition(3), 8, 3)) == plain_removal(rows, 8)


def test_small_batches_and_segments_change_nothing(spark, monkeypatch):
    rng = random.Random(9)
    data = np.array([rng.randint(0, 3) for _ in range(4000)], np.uint8)
    edges = np.array([0, 3, 700, 700, 2500, 4000])
    whole = suffixes.blocks_of(data, edges, 20, [5, 10])
    monkeypatch.setattr(suffixes, "SEGMENT", 64)
    for a, b in zip(whole, suffixes.blocks_of(data, edges, 20, [5, 10])):
        assert (a == b).all()
    key, check, start, size = whole
    assert size.sum() == sum(max(0, b - a - 19) for a, b in zip(edges, edges[1:]))  # every string is in one block
    monkeypatch.setattr(suffixes, "BATCH_ROWS", 7)
    rows = documents(7, 15)
    assert removal(suffixes.remove_strings(spark.createDataFrame(rows, KIND), 8, 3)) == plain_removal(rows, 8)


def test_strings_of_the_production_length(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij ") for _ in range(rng.randint(80, 160))) for _ in range(12)]
    rows = [(i, " ".join(rng.choice(words)[rng.randint(0, 30) :] for _ in range(rng.randint(0, 6)))) for i in range(60)]
    rows += [(60, "z" * 5000), (61, "z" * 99), (62, "z" * 100), (63, words[0][:100]), (64, words[0] * 3), (None, words[1] + words[2])]
    assert removal(suffixes.remove_strings(spark.createDataFrame(rows, KIND))) == plain_removal(rows, 100)


def test_empty_tables_and_clashing_names(spark):
    none = suffixes.remove_strings(spark.createDataFrame([], KIND))
    assert none.columns == ["doc_id", "text", *suffixes.ADDED] and none.count() == 0
    rows = [(1, "abcdefghabcdefgh", "q", 7, 8), (2, "xabcdefghx", None, 9, 1)]
    df = spark.createDataFrame(rows, f"{KIND}, spans string, ref int, N_removed int").withColumn("doc", F.lit("d"))
    got = suffixes.remove_strings(df, 8, 3).orderBy("doc_id").collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "spans", "ref", "doc", *suffixes.ADDED}
    assert [(r.spans, r.ref, r.doc, r.n_removed, bytes(r.kept)) for r in got] == [("q", 7, "d", 8, b"abcdefgh"), (None, 9, "d", 8, b"xx")]

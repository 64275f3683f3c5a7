"""The convolution of the toxicity model against plain loops, and samples with very long labelled texts."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest

from wayline.llm import common, queries, toxicity


def plain_pool(net, ids):
    """Greatest and third greatest activations, filter by filter and word by word."""
    rows = [np.concatenate([t[w[p]] for p, t in enumerate(net.tables)]) for w in ids]
    rows += [np.zeros(toxicity.PARTS * toxicity.DIM)] * (max(toxicity.WIDTHS) + max(toxicity.RANKS) - 1 - len(rows))
    out = []
    for f, b in zip(net.filters, net.bias):
        for r in toxicity.RANKS:
            for k in range(toxicity.FILTERS):
                a = sorted(sum(float(rows[i + j] @ f[j][:, k]) for j in range(len(f))) for i in range(len(rows) - len(f) + 1))
                out.append(max(0.0, a[-r] + b[k]))
    return np.array(out)


def network(seed=1):
    rng = random.Random(seed)
    docs = [toxicity.word_ids(" ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randint(0, 40))) + (" vile" * 4 if i % 3 == 0 else ""), toxicity._Buckets()) for i in range(30)]
    return toxicity.Convolution(docs, np.array([int(i % 3 == 0) for i in range(30)]), np.ones(30)), docs


def test_pooling_is_that_of_plain_loops(monkeypatch):
    net, docs = network()
    for ids in docs[:12]:
        assert np.allclose(net._pool(ids)[0], plain_pool(net, ids), atol=1e-4)
    whole = [net._pool(ids) for ids in docs]
    monkeypatch.setattr(toxicity, "PART", 7)  # long texts are pooled part by part, with the same result
    for ids, (pooled, where) in zip(docs, whole):
        got, at = net._pool(ids)
        assert np.allclose(got, pooled, atol=1e-5)
        assert net.score(ids) == pytest.approx(float(1 / (1 + np.exp(-(pooled @ net.out + net.base)))), abs=1e-5)


def test_training_tells_the_classes_apart():
    net, docs = network(2)
    scores = np.array([net.score(d) for d in docs])
    assert scores[::3].min() > np.delete(scores, np.s_[::3]).max()


@pytest.mark.parametrize("known", [1, 2, 40])
def test_labelled_texts_beyond_the_bound_are_cut_and_no_class_is_lost(spark, monkeypatch, known):
    monkeypatch.setattr(toxicity, "SAMPLE_WORDS", 200)
    rng = random.Random(known)
    text = [" ".join([rng.choice(["vile", "foul"]) if i % 2 else rng.choice(["kind", "calm"])] * 150 + ["tree"] * 100) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(text)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(known)], "doc_id long, label int")
    got = [r.score for r in toxicity.score_toxicity(docs, toxicity.train(docs, labels)).orderBy("doc_id").collect()]
    if known == 1:
        assert set(got) == {0.0}
    else:
        assert max(got) < 0.99 and np.mean(got[1::2]) >= np.mean(got[::2])


@pytest.mark.parametrize("shard", [16, 16_000])
def test_every_labelled_document_is_learnt_from_and_calibrates(spark, monkeypatch, shard):
    monkeypatch.setattr(toxicity, "SAMPLE_DOCS", shard)
    seen, real = [], toxicity.calibration
    monkeypatch.setattr(toxicity, "calibration", lambda x, y, w: seen.append(float(w.sum())) or real(x, y, w))
    rng = random.Random(3)
    text = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(20)) + (" vile" * 4 if i % 2 else " kind" * 4) for i in range(64)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(text)], "doc_id long, text string, lang string")
    model = toxicity.train(docs, spark.createDataFrame([(i, i % 2) for i in range(64)], "doc_id long, label int"))
    logits = np.array([model.network.logit(toxicity.word_ids(t, toxicity._Buckets())) for t in text])
    assert seen == [64.0] and logits[1::2].min() > logits[::2].max()


def test_words_of_many_texts_are_hashed_as_one_by_one(monkeypatch):
    texts = ["", None, "  ", "a", "x" * 64 + " " + "y" * 65 + " z", "é ü" * 5, "a\x00b\x1fc", "ABC deF, abcdefgh", " lead trail  ", "q" * 5000, "漢字かな" * 30, "vile " * 300]
    want = [toxicity.word_ids(t, toxicity._Buckets()) for t in texts]
    for at_once in (1, 100, 1 << 20):
        monkeypatch.setattr(toxicity, "AT_ONCE", at_once)
        got = list(toxicity.many_word_ids(pa.array(texts)))
        assert len(got) == len(want) and all(np.array_equal(g, w) for g, w in zip(got, want))
    assert not list(toxicity.many_word_ids(pa.array([], pa.string())))


def test_a_step_moves_words_of_pooled_places_once_for_each_filter():
    net, docs = network(3)
    ids = docs[0][-8:]  # with the telling word; short texts lose no words at random
    pooled, at = net._pool(ids)
    before, rows, out = net.tables.copy(), [f.copy() for f in net.filters], net.out.copy()
    g = 1 / (1 + np.exp(-(pooled @ out + net.base)))  # a toxic one, taken for clean
    want = np.zeros_like(before)
    back = (g * out * (pooled > 0)).reshape(len(toxicity.WIDTHS), len(toxicity.RANKS), toxicity.FILTERS)
    for k, f in enumerate(rows):
        for r in range(len(toxicity.RANKS)):
            for i in range(toxicity.FILTERS):
                for j in range(len(f)):
                    place = at[r, k * toxicity.FILTERS + i] + j
                    for p in range(toxicity.PARTS if place < len(ids) else 0):
                        want[p, ids[place, p]] += -0.02 * back[k, r, i] * f[j, p * toxicity.DIM : (p + 1) * toxicity.DIM, i]
    net.learn([ids], np.array([0]), np.ones(1), 1, 5)
    assert np.abs(want).max() > 1e-6 and np.allclose(net.tables - before, want, atol=1e-5)


def test_a_training_task_reads_its_own_network_only():
    class Broadcast:
        def __init__(self, k):
            self.k = k

        @property
        def value(self):
            read.append(self.k)
            return net

    (net, docs), read = network(4), []
    n = len(docs)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([3] * n, pa.int32()), pa.array([i % 2 for i in range(n)], pa.int32()), pa.array(["en"] * n), pa.array([d.tobytes() for d in docs], pa.binary())], names=["network", "label", "lang", "ids"]
    )
    before = net.tables.copy()
    moved = pa.Table.from_batches(toxicity._trained(iter([batch]), [Broadcast(k) for k in range(6)], {(0, "en"): 1.0, (1, "en"): 1.0}, 1, 5))
    assert set(read) == {3} and set(moved["network"].to_pylist()) == {3} and max(moved["place"].to_pylist()) > 0
    assert np.array_equal(net.tables, before)  # networks of a broadcast are not changed


def test_a_worker_gives_back_what_a_task_has_freed():
    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20

    pins = []

    def work(batches):
        texts = [bytes(2000) for _ in range(100_000)]
        pins.append(bytes(1500))  # stays above them, so that the C library can't shrink its heap by itself
        del texts
        held.append(resident())
        yield from batches

    held, before = [], resident()
    batch = pa.RecordBatch.from_arrays([pa.array([1])], names=["a"])
    assert list(common.tidy(work)(iter([batch]))) == [batch]
    if held[0] - before > 100:  # else the C library has given it back already
        assert resident() - before < 50


def test_batches_of_long_texts_are_bounded_and_smaller_settings_stay(spark):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    try:
        for set_to, want in (((10_000, "64m", 4096), (2_000, 4 << 20, 512)), ((-1, "512kb", 7), (2_000, 512 << 10, 7)), ((5, "100b", 512), (5, 100, 512))):
            for k, v in zip(keys, set_to, strict=True):
                spark.conf.set(k, v)
            queries.for_long_texts(spark)
            assert tuple(queries._number(spark.conf.get(k)) for k in keys) == want
    finally:
        for k in keys:
            spark.conf.unset(k)


def test_networks_of_training_leave_the_driver_with_it(spark, monkeypatch):
    made, real = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: made.append(real(self, value)) or made[-1])
    docs = spark.createDataFrame([(i, "vile " * 4 if i % 2 else "kind " * 4, "en") for i in range(20)], "doc_id long, text string, lang string")
    toxicity.train(docs, spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, label int"))
    assert len(made) > 6 and not any(os.path.exists(b._path) for b in made)

"""The ten registered queries and the pipeline, with their own parameters, on the given tables."""

import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_corpus import brute_hits, rows
from tokenizers import Tokenizer

import corpus_pipeline
from wayline.llm import decontaminate, queries, simhash, toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_has_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = con.execute(queries.ORACLE_SQL[name])
    cols = [d[0] for d in found.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    assert rows(got, *cols) == sorted(found.fetchall(), key=repr)


def test_bpe_query(spark, documents):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))

    def want(d, t):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        said = tokenizer.decode(ids, skip_special_tokens=False)
        return d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()

    got = rows(queries.op4_bpe(spark, SF), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == sorted((want(d, t) for d, t in documents), key=repr)


def test_token_query(spark, documents):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [(d, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 1024) for d, t in documents]
    assert rows(queries.op5_token_counts(spark, SF), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)


def components(texts):
    """Position of each text's component, by all pairs."""
    prints = [simhash.fingerprint(t) for t in texts]
    distinct, group = sorted(set(prints)), {}
    for p in distinct:
        near = {group[q] for q in group if (p ^ q).bit_count() <= 3}
        group[p] = p
        for q in [q for q in group if group[q] in near]:
            group[q] = p
    return prints, [group[p] for p in prints]


def test_simhash_query(spark, documents):
    prints, group = components([t for _, t in documents])
    least = {g: min(d for (d, _), x in zip(documents, group) if x == g) for g in group}
    want = sorted(((d, f"{p:016x}", least[g]) for (d, _), p, g in zip(documents, prints, group)), key=repr)
    assert rows(queries.op6_simhash(spark, SF), "doc_id", "fingerprint", "component_id") == want


def auc(scores, labels):
    order = np.argsort(np.argsort(scores))
    ones = labels == 1
    return (order[ones].mean() - (ones.sum() - 1) / 2) / (~ones).sum()


def held_out(spark, found, sf, label):
    """Scores and labels of the held-out rows, with their language."""
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    return found.join(labels, "doc_id").join(docs, "doc_id").where("held_out").toPandas()


def test_held_out_rows_are_those_of_the_contract(spark):
    import zlib

    for name, n, k in (("op3_quality", 3, 1), ("op10_toxicity", 5, 0)):
        got = queries.QUERIES[name](spark, SF).collect()
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == k) for r in got)
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
        assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_quality_on_real_labels(spark):
    sf = "/root/testdata/sf0.01"
    r = held_out(spark, queries.op3_quality(spark, sf), sf, "quality")
    assert auc(r.score.values, r.y.values) >= 0.9


def test_toxicity_on_real_labels(spark):
    sf = "/root/testdata/sf0.1"
    r = held_out(spark, queries.op10_toxicity(spark, sf), sf, "toxic")
    assert auc(r.score.values, r.y.values) >= 0.94
    assert r.predicted[r.y == 1].mean() >= 0.88 and r.predicted[r.y == 0].mean() <= 0.04
    for lang, own in r.groupby("lang"):
        assert own.threshold.nunique() == 1
        if (own.y == 1).sum() >= 10:
            assert own.toxic[own.y == 1].mean() >= 0.8, lang
    assert r.groupby("lang").threshold.first().nunique() == r.lang.nunique()


# the pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The small tables, and documents with nulls, ties, repeated rows, long and empty texts and a further column."""
    base = tmp_path_factory.mktemp("tables")
    for p in Path(SF).glob("*.parquet"):
        if p.stem != "documents":
            os.symlink(p, base / p.name)
    rng = random.Random(12)
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text IS NOT NULL").first().text
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(20_000))
    odd = [(None, None), (10_001, None), (10_002, ""), (None, " \n"), (10_003, long), (None, docs[3][1]), (docs[4][0], docs[4][1]), (docs[5][0], "another text of the same id " + long[:400]), (10_004, item), (10_005, "x" * 30_000)]
    docs += [(d, t, rng.choice(["en", None, "xx"]), "odd", None if t is None else len(t)) for d, t in odd]
    df = spark.createDataFrame([(*r, "own") for r in docs], "doc_id long, text string, lang string, source string, n_chars long, spans string")
    df.repartition(3).write.parquet(str(base / "documents.parquet"))
    return str(base)


@pytest.fixture(scope="module")
def steps(spark, folder):
    """The input and the rows after every stage, each written as the driver does."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        out.append(docs)
    return out


def test_stages_keep_the_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    assert all(s.where("spans <> 'own'").count() == 0 for s in steps[:-1])


def test_toxic_documents_go(spark, folder, steps):
    scored = toxicity.score_toxicity(steps[0], toxicity.train(steps[0], queries.toxic_labels(spark, folder))).collect()
    want = Counter((r.doc_id, r.text) for r in scored if r.score < r.threshold)
    assert Counter((r.doc_id, r.text) for r in steps[1].collect()) == want and len(want) > 150


def keyed(r):
    return r.doc_id is None, r.doc_id or 0


def test_copies_go(steps):
    groups = defaultdict(list)
    for r in steps[1].collect():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")].append(keyed(r))
    got = defaultdict(list)
    for r in steps[2].collect():
        got[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")].append(keyed(r))
    assert got == {t: [min(ids)] for t, ids in groups.items()}


def test_near_copies_go(steps):
    before = steps[2].collect()
    _, group = components([r.text for r in before])
    want = {}
    for r, g in zip(before, group):
        want[g] = min(want.get(g, (True, math.inf)), keyed(r))
    of = {(r.doc_id, r.text): g for r, g in zip(before, group)}
    assert sorted((of[r.doc_id, r.text], keyed(r)) for r in steps[3].collect()) == sorted(want.items())


def test_benchmark_passages_go(spark, folder, steps):
    bench = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    before, after = (Counter((r.doc_id, r.text) for r in s.collect()) for s in steps[3:5])
    hits = {h[0] for h in brute_hits(list(before), bench) if h[2]}
    untouched = {k for k in before if k[0] not in hits}
    assert untouched <= set(after) and sum(before.values()) == sum(after.values())
    words = {d: len(decontaminate.words_of(t)) for d, t in after}
    for d, n, hit, _ in brute_hits(list(before), bench):
        if d is not None and hit:
            assert words[d] == n - hit
    assert all(r.n_chars == len(r.text) for r in steps[4].where("text IS NOT NULL").collect())


def test_the_rest_is_encoded(steps):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))

    def want(r):
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        return r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    assert rows(steps[5], "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(map(want, steps[4].collect()), key=repr)


def test_run_is_the_stages_in_turn(spark, folder, steps):
    cols = steps[5].columns
    assert rows(corpus_pipeline.run(spark, folder), *cols) == rows(steps[5], *cols)


def test_stages_take_an_empty_table(spark, folder, steps):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, steps[0].limit(0), folder).collect() == []

"""Corpus operators against brute force on small texts with nulls, ties, repeats, long texts and odd columns."""

import hashlib
import os
import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wayline.llm import bpe, chat_format, common, decontaminate, exact_dedup, quality, simhash, substring, token_counts, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, n_words string, kept string, ids string, score string, host string"
WORDS = "the of and in on thing re stone über größe año ça va bien 12 x".split()


def say(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [say(rng, rng.randint(1, 160)) for _ in range(24)]
    shared = say(rng, 70)
    odd = [None, "", " ", "\t\n", "<|endoftext|> a<|endoftext|>b", "é" * 30, "ΑΣ İ ſ", "a  b\r\nc", "a b c", base[0], base[0].replace(" ", "  "), base[1].upper(), shared + " end", "begin " + shared, say(rng, 6000)]
    rows = [(i, t) for i, t in enumerate([*base, *odd])]
    return [*rows, (5, base[5]), (None, base[2]), (None, "only here " + say(rng, 60))]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "w", "k", "i", "s", "h") for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# exact dedup


def brute_copies(texts):
    groups = defaultdict(list)
    for i, (d, t) in enumerate(texts):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append((d is None, d or 0, i))
    out = []
    for t, members in groups.items():
        first = min(members)
        out += [(d if not none else None, None if first[0] else first[1], len(members), (none, d, i) == first, hashlib.sha256(t.encode()).hexdigest()) for none, d, i in members]
    return sorted(((a, b, n, k, h) for a, b, n, k, h in out), key=repr)


def test_copies(docs, texts):
    got = rows(exact_dedup.find_copies(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in brute_copies(texts)]
    assert sum(r[3] for r in got) == sum(r[3] for r in brute_copies(texts))


def test_colliding_digests_are_told_apart(docs, texts):
    weak = exact_dedup.find_copies(docs, digest=lambda t: F.substring(F.unhex(F.sha2(t, 256)), 1, 0))
    got = rows(weak, "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in brute_copies(texts)]


def test_drop_copies_keeps_one_of_each(docs, texts):
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    assert out.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in texts})


def test_index_takes_batches(spark):
    index = exact_dedup.DigestIndex(spark, memtable_rows=2, fanout=2)
    for k in range(4):
        index.add(spark.createDataFrame([(bytes([j % 3]), 10 * k + j, 100 * k + j) for j in range(4)], "digest binary, doc_id long, row long"))
    assert rows(index.table(), "digest", "doc_id", "n") == [(b"\x00", 0, 8), (b"\x01", 1, 4), (b"\x02", 2, 4)]
    assert rows(index.lookup([b"\x01"]), "doc_id", "n") == [(1, 4)]
    again = exact_dedup.DigestIndex.reopen(spark, index.path)
    assert again.runs == index.runs and rows(again.table(), "digest", "n") == rows(index.table(), "digest", "n")
    more = spark.createDataFrame([(b"\x02", 1), (b"\x07", 2)], "digest binary, inside long")
    assert rows(again.known(more), "digest") == [(b"\x02",)]
    again.add(spark.createDataFrame([(b"\x07", 3, 1000)], "digest binary, doc_id long, row long"))
    assert rows(again.repeated(more), "digest") == [(b"\x02",)] and len(again.runs) == 1


# decontamination


def brute_hits(texts, bench):
    def ws(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    windows = defaultdict(set)
    for item, t in bench:
        w = ws(t)
        for i in range(max(1, len(w) - 9)) if w else []:
            windows[tuple(w[i : i + 10])].add(str(item) if item is not None else "")
    out = []
    for d, t in texts:
        w, hit, items = ws(t), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    items |= windows[k]
        out.append((d, len(w), len(hit), ",".join(sorted(items))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1_000, 3])
def test_contamination(spark, docs, texts, block):
    bench = [(1, " ".join(texts[3][1].split()[:25])), (22, "the OF, and"), (3, None), (4, "..."), (None, texts[4][1]), (6, "nowhere to be found"), (6, texts[7][1])]
    table = spark.createDataFrame(bench, "item_id long, text string")
    found = decontaminate.find_contamination(docs, table, block_windows=block)
    got = sorted(((r.doc_id, r.n_words, sum(s.stop - s.start for s in r.spans), ",".join(r["items"])) for r in found.collect()), key=repr)
    assert got == brute_hits(texts, bench)
    cleaned = decontaminate.remove_contamination(docs, table)
    assert cleaned.columns == docs.columns and cleaned.count() == len(texts)
    left = decontaminate.find_contamination(spark.createDataFrame([(1, texts[3][1])], "doc_id long, text string"), table.where("item_id = 1"), clean=True).first()
    assert left.text.split() == texts[3][1].split()[25:] or len(texts[3][1].split()) < 10


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(0)
    text = rng.integers(0, 4, 400)
    text[-1] = 0
    index = decontaminate.FMIndex(text, 3)
    phrases = [p for p in {tuple(rng.integers(1, 4, n)) for n in (1, 2, 3, 5) for _ in range(12)}]
    table = np.zeros((len(phrases), 5), np.int64)
    for i, p in enumerate(phrases):
        table[i, -len(p) :] = p
    at, lo, hi = index.search(table, np.array([len(p) for p in phrases]))
    got = {int(a): sorted(index.locate(np.arange(x, y)).tolist()) for a, x, y in zip(at, lo, hi)}
    for i, p in enumerate(phrases):
        want = [k for k in range(len(text) - len(p) + 1) if tuple(text[k : k + len(p)]) == p]
        assert got.get(i, []) == want


# simhash


def test_components(docs, texts):
    prints = [simhash.fingerprint(t) for _, t in texts]
    words = (texts[1][1]).lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)] or [xxhash.xxh64_intdigest(" ".join(words), 42)]
    assert prints[1] == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min((d for (d, _), x in zip(texts, group) if x == g and d is not None), default=None) for g in group}
    want = sorted(((d, least[g]) for (d, _), g in zip(texts, group)), key=repr)
    assert rows(simhash.components(docs), "doc_id", "component_id") == want
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(group))


def test_components_without_ids_of_their_own_keep_a_text_each(spark):
    rng = random.Random(8)
    alone = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(60)) for _ in range(16)]
    texts = [(None, t) for t in alone[:8]] + [(4, alone[8]), (4, alone[9]), (4, alone[10]), (None, alone[11]), (9, alone[11]), (7, alone[12]), (8, alone[12])]
    texts += [(None, alone[13]), (None, alone[13]), (4, alone[14]), (4, alone[14]), (None, alone[15]), (None, alone[15].upper()), (6, "A " + alone[0]), (4, alone[10].upper())]
    prints = [simhash.fingerprint(t) for _, t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    kept = rows(simhash.drop_near_copies(spark.createDataFrame(texts, "doc_id long, text string")), "doc_id", "text")
    assert sorted(group[texts.index(r)] for r in kept) == sorted(set(group))
    for d, t in kept:
        ids = [x for (x, _), g in zip(texts, group) if g == group[texts.index((d, t))]]
        assert d == min((x for x in ids if x is not None), default=None)


def test_links_of_random_fingerprints(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(30)]
    near = [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(3)]
    signed = sorted({x - (1 << 64) if x >> 63 else x for x in [*base, *near]})
    got = rows(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")), "a", "b")
    want = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3]
    assert got == sorted(want, key=repr)


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = dict(rows(simhash.star_components(edges), "node", "root"))
    assert {v for k, v in got.items() if k <= 40} == {0} and got[101] == 100


# substring dedup


def brute_removed(texts, window):
    first = {}
    for d, t in texts:
        w = (t or "").encode().split()
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, float("inf")), float("inf") if d is None else d)
    out = []
    for d, t in texts:
        w, gone = (t or "").encode().split(), set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (float("inf") if d is None else d):
                gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("window", "batches"), [(50, 1), (8, 3), (1, 1)])
def test_repeats(docs, texts, window, batches):
    got = substring.remove_repeats(docs, window, batches)
    assert rows(got, "doc_id", "n_words", "n_removed", "kept") == brute_removed(texts, window)


@pytest.mark.parametrize(("window", "batches"), [(8, 1), (8, 3), (50, 2)])
def test_repeats_inside_a_document(spark, window, batches):
    rng = random.Random(window)

    def new(n):
        return " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))

    texts = []
    for k in range(12):
        passages = [new(window + rng.randint(0, 2 * window)) for _ in range(4)]
        texts.append((k, " ".join(f"{new(window)} {p} {new(window)}" for p in passages)))
        inside, equal, null, both = (f"{new(window)} {p} {new(window)}" for p in passages)
        texts.append((100 + k, f"{inside} {new(5)} {inside} {inside}"))
        texts += [(200 + k, f"{equal} {new(9)}"), (200 + k, f"{new(3)} {equal}")]
        texts += [(None, f"{null} {new(9)}"), (None, f"{new(3)} {null} {null}")]
        texts += [(300 + k, both), (300 + k, both), (None, f"{both} {both}")]
    got = substring.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string"), window, batches)
    assert rows(got, "doc_id", "n_words", "n_removed", "kept") == brute_removed(texts, window)


def test_compaction_keeps_first_blocks(spark, docs, texts):
    index, held = substring.SubstringIndex(spark, 8, fanout=1), docs.select("doc_id", "text")
    parts = [held.where("doc_id < 10"), held.where("doc_id >= 10 AND doc_id < 20"), held.where("doc_id >= 20")]
    found = 0
    for i, part in enumerate(parts):
        found += index.add(part, held.where(f"doc_id < {10 * i}") if i else None).count()
        index = substring.SubstringIndex.reopen(spark, index.path)  # as another session would
    assert len(index.runs) == 1
    blocks = index.table()
    assert blocks.count() == blocks.select("hash", "check", "key").distinct().count()
    once = substring.SubstringIndex(spark, 8)
    once.add(held.where("doc_id IS NOT NULL"))
    assert blocks.count() == once.table().count()
    assert found == len({(d, t) for (d, t) in texts if d is not None and any(r[0] == d and r[2] for r in brute_removed([x for x in texts if x[0] is not None], 8))} - {(5, None)})


# tokens


def test_bpe_round_trip(docs, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    want = []
    for d, t in texts:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), np.array(ids, "<u4").tobytes(), tokenizer.decode(ids, skip_special_tokens=False)))
    for words in (200_000, 5):
        got = rows(bpe.round_trip(docs, path, block_words=words), "doc_id", "n_tokens", "ids", "decoded")
        assert [(a, b, bytes(c), e) for a, b, c, e in got] == sorted(want, key=repr)
    two = bpe.decode(bpe.encode(docs, path), path)
    assert rows(two, "doc_id", "decoded") == sorted(((w[0], w[3]) for w in want), key=repr)


def test_a_distinct_word_reaches_the_encoder_once():
    seen = []

    class Spy:
        def __init__(self, path):
            pass

        def __call__(self, word):
            seen.append(word)
            return len(word).to_bytes(4, "little")

    texts = [" ".join(random.Random(k).choice(WORDS) for _ in range(50)) for k in range(9)]
    docs = [pa.RecordBatch.from_pydict({"doc_id": list(range(k, k + 3)), "text": texts[k : k + 3]}) for k in (0, 3, 6)]
    blocks = list(bpe._blocks(iter(docs), ["doc_id"], ["block", "codes", "words"], 60))
    assert len(blocks) > 3
    parts = pa.Table.from_batches(list(bpe._parted((b.select(["block", "words"]).slice(0, 1) for b in blocks), 4))).sort_by("part")
    out = pa.Table.from_batches(list(bpe._encoded(iter(parts.to_batches(max_chunksize=3)), "", Spy)))
    assert sorted(seen) == sorted({w.lower().encode() for t in texts for w in t.split()})
    unpack = zstandard.ZstdDecompressor().decompress
    entries = sum(len(unpack(x.as_py())) // 4 for x in out["codes"])
    assert entries == sum(len(b.column("words")[0].as_py()) for b in blocks) > len(seen)


def test_words_of_a_part_meet_in_one_task(spark, docs):
    parts = docs.select(F.xxhash64("doc_id").alias("block"), F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "").cast("array<binary>").alias("words"))
    unpacked = F.udf(lambda x: zstandard.ZstdDecompressor().decompress(x).split(b"\n"), "array<binary>")
    rows_ = parts.mapInArrow(lambda b: bpe._parted(b, 8), "part int, block long, words binary, codes binary").repartitionById(4, F.pmod("part", F.lit(4)).cast("int"))
    rows_ = rows_.withColumn("task", F.spark_partition_id()).select("task", "part", F.explode(unpacked("words")).alias("word"))
    assert rows_.groupBy("word").agg(F.count_distinct("task").alias("n"), F.count_distinct("part").alias("p")).where("n > 1 OR p > 1").count() == 0


def test_counts_at_every_prefix():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, counts = Tokenizer.from_file(path), token_counts.PrefixCounter(path)
    rng = random.Random(2)
    parts = ["a", "the", "'", "'re", "'r", "ll", " ", "  ", "\n", "\t", "\x85", "\x1c", "12", "²", "é", "日本", "<|endoftext|>", "<|endof", "!", "...", "$$$", "Hello", "\u3000", "😀", "\r\n"]
    for _ in range(150):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        held = np.cumsum(counts.changes(text), dtype=int)
        for j in range(1, len(text) + 1):
            assert held[len(text[:j].encode()) - 1] == len(tokenizer.encode(text[:j], add_special_tokens=False).ids), (text, j)


def test_token_counts(docs, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    got = token_counts.count_tokens(docs, path, limit=20).collect()
    for r in got:
        text = r.text or ""
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 20)
        assert len(tokenizer.encode(text.encode()[: r.cut_bytes].decode(), add_special_tokens=False).ids) <= 20
    stored = token_counts.prefix_counts(docs, path)
    places = stored.withColumn("n", F.explode(F.array(*(F.lit(k) for k in (0, 1, 7, 40, 10**6)))))
    for r in places.withColumn("tokens", token_counts.tokens_at("prefixes", "n")).collect():
        whole = (r.text or "").encode()[: r.n]
        if whole.decode("utf-8", "ignore").encode() == whole:
            assert r.tokens == len(tokenizer.encode(whole.decode(), add_special_tokens=False).ids)


def test_long_words_are_counted_alike():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, counts = Tokenizer.from_file(path), token_counts.PrefixCounter(path)
    for text in ("x" * 3000, "日本語" * 700, "aGVsbG8gd29ybGQ" * 150, "-" * 2000, " " * 1500 + "a"):
        held = np.cumsum(counts.changes(text), dtype=int)
        for j in (1, 2, 255, 256, 257, 300, 1200, len(text)):
            assert held[len(text[:j].encode()) - 1] == len(tokenizer.encode(text[:j], add_special_tokens=False).ids), (text[:5], j)
    assert not counts.words and not counts.tree or max(map(len, counts.words), default=0) <= token_counts.LONGEST


def invented(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    parts = ["on", "tion", "th", "er", "an", "ciö", "sh", "ü", "ent", "heit", "wh", "ly", "eau", "Q", "st", "ing"]
    return ["".join(rng.choices(parts, k=rng.randint(4, 7))) + rng.choice(["", ",", ".", "!?", "'s", "...", "7"]) for _ in range(n)]


def test_new_words_share_what_is_known_of_others(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, counts = Tokenizer.from_file(path), token_counts.PrefixCounter(path)
    texts = [" ".join(invented(k, 1000)) for k in range(12)]
    asked = []
    follows = counts._follows
    monkeypatch.setattr(counts, "_follows", lambda a, b: asked.append(1) or follows(a, b))
    for k, text in enumerate(texts):
        asked.clear()
        assert counts.changes(text).sum(dtype=int) == len(tokenizer.encode(text, add_special_tokens=False).ids), k
    assert len(asked) < 1500  # pairs of tokens looked at for 1,000 words, nearly all new


def test_counts_with_steps_forgotten_inside_words(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, counts = Tokenizer.from_file(path), token_counts.PrefixCounter(path)
    monkeypatch.setattr(token_counts, "STEPS", 5, raising=False)
    for text in (" ".join(invented(1, 60)), "aGVsbG8gd29ybGQ" * 40, "=-" * 70 + "-" * 200 + "!", " don't 'reo we're 've  \n\n 'll", "ªa, µm. ×y ÷z Ñandú! º1 ÿ-ß a²"):
        held = np.cumsum(counts.changes(text), dtype=int)
        for j in range(1, len(text) + 1):
            assert held[len(text[:j].encode()) - 1] == len(tokenizer.encode(text[:j], add_special_tokens=False).ids), (text[:j], j)
    assert len(counts.steps) <= 5 and len(counts.states) <= 7 and counts.held <= 5 * token_counts.WIDTH + 400


# classifiers


def test_quality_tells_junk_from_prose(spark):
    rng = random.Random(5)
    made = [(i, say(rng, 60) if i % 2 else " ".join(rng.choice(WORDS) + "%%%" for _ in range(40)), i % 2) for i in range(160)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in made] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in made if i < 100] + [(3, None)], "doc_id long, label int")
    got = dict(rows(quality.score_quality(docs, labels), "doc_id", "score"))
    assert len(got) == 162 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, _, y in made if i >= 100]) >= 0.95


def test_toxicity_tells_insults(spark):
    rng = random.Random(6)
    made = [(i, say(rng, 50) + (" you moron " if i % 3 == 0 else " ") + say(rng, 20), int(i % 3 == 0)) for i in range(240)]
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in made] + [(900, None, None), (901, "", "xx")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, y) for i, _, y in made if i < 150], "doc_id long, label int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, toxicity.train(docs, labels)).collect()}
    assert np.mean([got[i].toxic == bool(y) for i, _, y in made if i >= 150]) >= 0.95
    assert not got[900].toxic and not got[901].toxic
    none = toxicity.score_toxicity(docs, toxicity.train(docs, labels.where("label = 0")))
    assert none.where("toxic").count() == 0


# chats and URLs


def test_layouts_become_the_same_turns(spark):
    a = spark.createDataFrame([(1, "hi", "yo")], "conv_id long, instruction string, output string")
    b = spark.createDataFrame([(1, "hi", "", "yo", 9)], "conv_id long, instruction string, input string, output string, extra int")
    c = spark.createDataFrame([(1, [("human", "hi"), ("gpt", "yo")])], "conv_id long, conversations array<struct<from:string,value:string>>")
    d = spark.createDataFrame([(1, [("user", "hi"), ("assistant", "yo")])], "conv_id long, messages array<struct<role:string,content:string>>")
    want = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo")]
    for x in (a, b, c, d):
        assert rows(chat_format.canonical_turns(x), "conv_id", "turn", "role", "text") == sorted(want, key=repr)
    with pytest.raises(ValueError):
        chat_format.canonical_turns(spark.createDataFrame([(1,)], "conv_id long"))


def test_every_record_follows_its_own_fingerprint(spark):
    schema = "conv_id long, prompt string, completion string, messages array<struct<role:string,content:string>>, extra string"
    records = [(1, "hi", "yo", None, "x"), (2, None, None, [("user", "a"), ("assistant", None)], None), (3, None, None, [], None), (4, None, None, None, "x")]
    df = spark.createDataFrame(records, schema)
    turns = chat_format.canonical_turns(df)
    assert rows(turns, "conv_id", "turn", "role", "text") == sorted([(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "a"), (2, 1, "assistant", ""), (3, None, None, None), (4, None, None, None)], key=repr)
    formatted = dict(rows(chat_format.format_chats(turns), "conv_id", "formatted"))
    assert formatted[3] == formatted[4] == "" and "hi" in formatted[1]
    both = spark.createDataFrame([(5, "hi", "yo", [("user", "a")], None)], schema)
    with pytest.raises(Exception, match="beside"):
        chat_format.canonical_turns(both).collect()
    assert rows(chat_format.canonical_turns(both, strict=False), "role", "text") == [("user", "a")]  # the first of the declared mappings
    selected, fits = chat_format.choose(spark.createDataFrame([], "conv_id long, prompt string, completion string, other int").schema)
    assert selected.name == "prompt and completion" and fits == [selected]


def test_formatting_is_reversible(spark):
    odd = ["<|im_end|>\n", "<~|im_end|>", "<", "[INST] [~~/INST]", "</s>", "<<SYS>>", None, "", "a\n<|im_start|>user\nb", "&lt;", "é" * 5000]
    turns = [(c, i, "assistant" if i % 2 else "us%er\n", t) for c in range(3) for i, t in enumerate(odd[c:])] + [(None, 0, None, "x"), (0, 0, "us%er\n", odd[0])]
    df = chat_format.canonical_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    out = chat_format.format_chats(df).select("conv_id", chat_format.read_back(F.col("formatted")).alias("ts"), chat_format.learned_text(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()
    for r in out:
        own = sorted(((t, x or "", y or "") for c, t, x, y in turns if c == r.conv_id))
        assert [(t.role, t.text) for t in r.ts] == [(x, y) for _, x, y in own]
        assert r.l == "".join(y for _, x, y in own if x == "assistant")


def test_url_rules(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en", "block"), ("b.example.com", "/", "allow"), ("dup.net", "/", "allow"), ("dup.net", "/", "block")]
    urls = [None, "", "no host", "http://", "HTTP://EXAMPLE.com/english", "http://b.example.com/en", "http://xexample.com/en?q=://y", "http://a.example.com/en#x", "http://dup.net/", "http://com", "http://a..com/\nz", "http://b.example.com/en"]

    def judge(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
        fit = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=None)
        return host, path, best and best[3], best[4] if best else "allow"

    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    want = sorted(((i, *judge(u)) for i, u in enumerate(urls)), key=repr)
    for most in (100, 0):  # broadcast or shuffled rules
        assert rows(url_filter.filter_urls(pages, table, broadcast_rules=most), "page_id", "host", "path", "rule", "verdict") == want


def test_empty_tables(spark, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, label int")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    pages, rules = spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "host string, path string, verdict string")
    for df in (
        exact_dedup.find_copies(empty), exact_dedup.drop_copies(empty), decontaminate.remove_contamination(empty, bench), simhash.components(empty), simhash.drop_near_copies(empty),
        substring.remove_repeats(empty, batches=2), bpe.round_trip(empty, path), bpe.encode(empty, path), token_counts.count_tokens(empty, public_tokenizers.path("byte_bpe_50k.json")),
        quality.score_quality(empty, labels), toxicity.drop_toxic(empty, labels), chat_format.format_chats(chat_format.canonical_turns(turns)), url_filter.filter_urls(pages, rules),
    ):
        assert df.collect() == []


# names, and texts without spaces

#: Names that operators give to columns of their own.
INNER = (
    "key", "maybe", "k_id", "k_key", "hash", "word", "bits", "bm_word", "bm_bits", "ref", "s_ref", "spans", "items", "N_WORDS", "kept", "n_removed", "block", "codes", "words", "part", "seq", "pos", "piece", "piece_id", "v_id", "ids", "n_tokens", "decoded",
    "n_bytes", "prefixes", "cut_bytes", "over_limit", "score", "threshold", "TOXIC", "text_key", "doc", "row", "digest", "t", "fp", "root", "component_id", "keep_id", "label", "l_id", "nth", "best", "b_host", "rule", "layout", "x", "_key", "_maybe", "_ref",
)


@pytest.fixture(scope="module")
def odd(spark, texts):
    """Documents with a column of every inner name, and texts without white space."""
    long = ["日本語のテキスト" * 4000, "aGVsbG8gd29ybGQ" * 3000, "x" * 50_000]
    held = [*texts, *((500 + i, t) for i, t in enumerate(long)), (7, texts[7][1]), (7, texts[7][1])]
    df = spark.createDataFrame(held, "doc_id long, text string")
    return df.select("doc_id", "text", *(F.lit(f"own {c}").alias(c) for c in INNER), F.lit("en").alias("lang")), held


def own(df, *without):
    """Whether further columns came through as they were."""
    taken = {w.lower() for w in without}
    names = [c for c in INNER if c.lower() not in taken]
    return df.where(" OR ".join(f"`{c}` IS NULL OR `{c}` <> 'own {c}'" for c in names)).count() == 0


def test_any_column_names_pass(spark, odd):
    df, held = odd
    path = public_tokenizers.path("word_bpe_49k.json")
    bench = spark.createDataFrame([(1, held[3][1])], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, label int")
    for out, added in (
        (exact_dedup.drop_copies(df), ()),
        (simhash.drop_near_copies(df), ()),
        (decontaminate.remove_contamination(df, bench), ()),
        (decontaminate.find_contamination(df, bench), ("n_words", "spans", "items")),
        (substring.remove_repeats(df, 8), ("n_words", "n_removed", "kept")),
        (bpe.round_trip(df, path), ("ids", "n_tokens", "decoded")),
        (token_counts.count_tokens(df, public_tokenizers.path("byte_bpe_50k.json")), ("n_bytes", "n_tokens", "over_limit", "cut_bytes", "prefixes")),
        (toxicity.score_toxicity(df, toxicity.train(df, labels)), ("score", "threshold", "toxic")),
    ):
        assert len({c.lower() for c in out.columns}) == len(out.columns) and own(out, *added)
    assert quality.score_quality(df, labels).count() == len(held)
    pages = df.select(*INNER, F.concat(F.lit("http://a.com/"), "doc_id").alias("url"))
    rules = spark.createDataFrame([("com", "/", "block")], "host string, path string, verdict string")
    assert own(url_filter.filter_urls(pages, rules), "rule", "host", "path", "verdict")


def test_texts_without_spaces(odd):
    df, held = odd
    long = df.where("doc_id >= 500").select("doc_id", "text")
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in bpe.round_trip(long, path).collect()}
    for d, t in held:
        if d is not None and d >= 500:
            ids = tokenizer.encode(t, add_special_tokens=False).ids
            assert bytes(got[d].ids) == np.array(ids, "<u4").tobytes() and got[d].decoded == tokenizer.decode(ids, skip_special_tokens=False)
    assert rows(substring.remove_repeats(long), "n_words", "n_removed") == [(1, 0)] * 3
    byte = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(byte)
    for r in token_counts.count_tokens(long, byte).collect():
        assert r.n_tokens == len(tokenizer.encode(r.text, add_special_tokens=False).ids)


def test_repeats_after_decontamination(spark, docs, texts):
    marked = decontaminate.find_contamination(docs, spark.createDataFrame([(1, texts[3][1])], "item_id long, text string"))
    out = substring.remove_repeats(marked, 8)
    assert "spans" in out.columns and rows(out, "doc_id", "n_words", "n_removed", "kept") == brute_removed(texts, 8)


def test_text_ids(spark, texts):
    named = spark.createDataFrame([(None if d is None else f"id{d:03}", t) for d, t in texts], "doc_id string, text string")
    got = simhash.components(named)
    assert got.schema["component_id"].dataType.simpleString() == "string" and got.count() == len(texts)


def test_a_language_has_a_threshold_of_its_own(spark):
    rng = random.Random(9)
    made = [(i, " ".join(f"{rng.choice(WORDS)}{rng.randrange(40)}" for _ in range(40)) + (f" {'dumm' if i % 2 else 'idiot'}{rng.randrange(9)}" * 4 if i % 4 < 2 else ""), "de" if i % 2 else "en", int(i % 4 < 2)) for i in range(400)]
    docs = spark.createDataFrame([m[:3] for m in made], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(m[0], m[3]) for m in made if m[0] < 300], "doc_id long, label int")
    model = toxicity.train(docs, labels)
    assert set(model.by_language) == {"de", "en"}
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert np.mean([got[m[0]].toxic == bool(m[3]) for m in made if m[0] >= 300]) >= 0.95
    assert {r.threshold for r in got.values()} == set(model.by_language.values())


def test_a_long_document_trains(spark):
    rng = random.Random(4)
    made = [(i, say(rng, 30_000 if i < 4 else 30) + (" moron moron moron " if i % 2 else "") + say(rng, 10), int(i % 2)) for i in range(60)]
    docs = spark.createDataFrame([m[:2] for m in made], "doc_id long, text string")
    labels = spark.createDataFrame([(m[0], m[2]) for m in made], "doc_id long, label int")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, toxicity.train(docs, labels)).collect()}
    assert np.mean([(got[m[0]] >= 0.5) == bool(m[2]) for m in made]) >= 0.9


def test_intermediate_tables_can_be_dropped(spark, docs):
    with common.workspace(spark, "test") as folder:
        n = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json")).count()
    assert n == docs.count() and os.path.isdir(folder)
    common.drop(spark, folder)
    assert not os.path.exists(folder) and not any(t.startswith(folder) for t in common._tables.values())


def test_a_cluster_must_name_its_folder():
    class Elsewhere:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(Elsewhere(), "x")

"""SimHash near-duplicates by multi-index hashing, and their connected components.

A text's words are joined to shingles; a fingerprint bit is set where more than half of the shingles'
XXH64 (seed 42) have it. Fingerprints within ``distance`` bits are linked. Each fingerprint is cut into two
segments, so linked ones agree up to ``distance // 2`` bits in one of them: tables keyed by segment value are
probed with the small Hamming ball around each value and hits are verified over all bits.

The nodes of the graph are the distinct fingerprints, so copies are never paired with each other, and a
fingerprint has a bounded number of neighbours however many documents there are. Components come from
alternating star contractions, each written to the shared folder.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; fewer words than a
shingle make one shingle; repeated rows are repeated in the result; ids may be of any type that has an order; a null doc_id is
never a component's id unless all its members' are null; an empty table gives no rows; further columns are ignored by ``components``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.llm.common import drop, keep_rows, shared_dir, stored, text_key, written

SHINGLE, DISTANCE, SEED = 3, 3, 42


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined, of = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = [of(joined, SEED)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        stops = np.cumsum(sizes + 1) - 1
        starts = stops - sizes
        hashes = [of(joined[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), stops[shingle - 1 :].tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    held = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    for k in range(0, len(held), 1 << 16):
        counts += np.unpackbits(held[k : k + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.array([fingerprint(t.as_py(), shingle) for t in b.column("text")], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(prints)], names=["doc_id", "text_key", "fp"])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_key, fp (64 bits, as a signed long) of every document."""
    rows = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    return rows.mapInArrow(partial(_fingerprints, shingle=shingle), T.StructType([docs.schema["doc_id"], T.StructField("text_key", T.LongType()), T.StructField("fp", T.LongType())]))


def links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b) with a < b of fingerprints (column fp, distinct) that differ in 1 to distance bits.

    Of two values that differ in one bit only the one without it probes, so each pair meets once per segment.
    """
    if distance > 3:
        raise ValueError("two segments and balls of radius one find up to 3 differing bits")
    halves = F.array(F.struct(F.lit(0).alias("seg"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("v")), F.struct(F.lit(1).alias("seg"), F.shiftrightunsigned("fp", 32).alias("v")))
    table = nodes.select("fp", F.explode(halves).alias("s")).select("fp", "s.seg", "s.v")
    bits = F.array(*(F.lit(1 << i).cast("long") for i in range(32)))
    ball = F.concat(F.array(F.col("v")), F.transform(F.filter(bits, lambda b: F.col("v").bitwiseAND(b) == 0), lambda b: F.col("v") + b))
    probes = table.select(F.col("fp").alias("p_fp"), F.col("seg").alias("p_seg"), F.explode(ball).alias("p_v"), F.col("v").alias("p_own"))
    near = (F.bit_count(F.col("fp").bitwiseXOR(F.col("p_fp"))) <= distance) & ((F.col("p_own") != F.col("p_v")) | (F.col("p_fp") < F.col("fp")))
    found = probes.join(table, (F.col("seg") == F.col("p_seg")) & (F.col("v") == F.col("p_v")) & near)
    return found.select(F.least("fp", "p_fp").alias("a"), F.greatest("fp", "p_fp").alias("b")).distinct()


def star_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge (a, b); root: the smallest node that it reaches.

    Joins are between plain tables, so Spark splits the one key of a giant component's root. A round's tables go when the next is written.
    """
    spark, at = edges.sparkSession, shared_dir(edges.sparkSession, "stars")
    edges, seen, turn = stored(edges.select("a", "b"), f"{at}/edges0"), None, 0
    while True:
        turn += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("m")), f"{at}/low{turn}")
        large = both.where("b > a").join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a <> b").distinct(), f"{at}/large{turn}")
        # now each row is (node, smaller node)
        least = stored(large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")), f"{at}/least{turn}")
        small = large.join(least, F.col("a") == F.col("n")).select(F.col("b").alias("x"), F.col("m"))
        small = small.where("x <> m").unionByName(least.select(F.col("n").alias("x"), "m")).distinct()
        edges = stored(small.select(F.col("m").alias("a"), F.col("x").alias("b")), f"{at}/edges{turn}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        for name in (f"edges{turn - 1}", f"low{turn}", f"large{turn}", f"least{turn}"):
            drop(spark, f"{at}/{name}")
        if now == seen:
            return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        seen = now


def components(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, text_key, fp, component_id (smallest doc_id reachable over links), root (smallest fp reachable) of every row of docs.

    Only root tells components apart: ids may be null or shared.
    """
    prints = written(fingerprints(docs, shingle), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = star_components(links(nodes.select("fp"), distance))
    # the nodes of one component share a root: both sides of the join on it are plain tables
    rooted = written(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    smallest = written(rooted.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id")), "smallest")
    named = rooted.join(smallest, F.col("root") == F.col("r")).select(F.col("fp").alias("n_fp"), "component_id", "root")
    return prints.join(named, F.col("fp") == F.col("n_fp")).select("doc_id", "text_key", "fp", "component_id", "root")


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row of each component: that with the component's id."""
    found = written(components(docs, shingle, distance), "components")
    # of rows that share the id of their component, by several texts, one text stays
    text = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("root").alias("c")).agg(F.min("text_key").alias("k"), F.count("*").alias("n"))
    ties = text.where("n > 1")
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("k").isNull() | (F.col("text_key") == F.col("k")))
    decided = found.join(ties, F.col("root") == F.col("c"), "left").select("doc_id", "text_key", kept.alias("kept"), "n")
    # identical rows: mark one decision as dropped, so that keep_rows lets one of them stay
    again = decided.where("kept AND n > 1").select("doc_id", "text_key", F.lit(False).alias("kept"))
    return keep_rows(docs, decided.select("doc_id", "text_key", "kept").unionByName(again))

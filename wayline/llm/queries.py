"""Registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm import bpe, chat_format, clustering, decontaminate, exact_dedup, quality, simhash, substring, suffixes, token_counts, toxicity, url_filter, whitening

#: Rules of the URL query: fixed values.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: A conversation that says control strings: fixed values.
ODD_CHAT = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


#: Rows of a batch that Spark hands to Python, and of one that it reads from Parquet: texts are long, so batches of Spark's default size would take much memory.
BATCH_ROWS, READ_ROWS = 2_000, 512
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20, "spark.sql.parquet.columnarReaderBatchSize": READ_ROWS}


def _number(value: str) -> int:
    """A setting's number, of bytes with a unit (1m, 512kb, 64b) or plain."""
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", value.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def for_long_texts(spark: SparkSession) -> None:
    """Bound the session's batches of rows; a smaller setting stays."""
    for key, most in BATCHES.items():
        now = _number(spark.conf.get(key))
        spark.conf.set(key, str(min(now, most) if now > 0 else most))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for_long_texts(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, _table(spark, sf_dir, "benchmark"), keep=("doc_id",))
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(_table(spark, sf_dir, "documents")).drop("text_key")


def _part(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").where(_part(3) != 1).select("doc_id", F.col("quality").alias("label"))
    scored = quality.score_quality(_table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", (F.coalesce(_part(3), F.lit(0)) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "labels").where(_part(5) != 0).select("doc_id", F.col("toxic").alias("label"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    scored = toxicity.score_toxicity(docs, toxicity.train(docs, toxic_labels(spark, sf_dir)), keep=("doc_id",))
    return scored.select("doc_id", (F.coalesce(_part(5), F.lit(1)) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "toxic")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    found = bpe.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), path, keep=("doc_id",))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=1024, keep=("doc_id",))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), batches=3, keep=("doc_id",), fanout=1)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = spark.createDataFrame(ODD_CHAT, "conv_id long, turn long, role string, text string")
    turns = chat_format.canonical_turns(_table(spark, sf_dir, "conversations")).unionByName(chat_format.canonical_turns(odd))
    read = chat_format.format_chats(turns).select(
        "conv_id",
        "formatted",
        chat_format.read_back(F.col("formatted")).alias("ts"),
        chat_format.learned_text(F.col("formatted"), F.col("loss_spans")).alias("learned"),
    )
    said = F.concat_ws("", F.transform("ts", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        "conv_id",
        F.size("ts").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.remove_strings(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=("doc_id",))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustering.cluster(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", clustering.digest(F.col("centroid")).alias("centroid_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    each = found.select("vec_id", "n", F.col("deviation").cast("long").alias("deviation"), "explained", "identity_error", F.posexplode("whitened").alias("k", "whitened"))
    return each.select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("k")).alias("explained"), "identity_error")


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_quality": op3_quality,
    "op4_bpe": op4_bpe,
    "op5_token_counts": op5_token_counts,
    "op6_simhash": op6_simhash,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_chat_format": op8_chat_format,
    "op9_url_filter": op9_url_filter,
    "op10_toxicity": op10_toxicity,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_centroids": op12_centroids,
    "op13_whitening": op13_whitening,
}

#: A round of clustering in SQL: z has a row for each component of each centroid, e one for each component of each vector.
_NEAREST = """
n{i} AS MATERIALIZED (SELECT k, c, dist FROM (SELECT k, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS dist FROM e JOIN z{i} USING (d) GROUP BY k, c)
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY dist, c) = 1)"""
_MOVED = """,
z{j} AS MATERIALIZED (SELECT z.c, z.d, CAST(coalesce((s - ((s % m) + m) % m) // m, y) AS BIGINT) AS y
  FROM z{i} AS z LEFT JOIN (SELECT c, d, sum(x) AS s, count(*) AS m FROM e JOIN n{i} USING (k) GROUP BY c, d) AS t ON z.c = t.c AND z.d = t.d),"""

ORACLE_SQL = {
    "op1_decontaminate": r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
      FROM documents),
b AS (SELECT item_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
      FROM benchmark),
w AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(list_slice(ws, i, i + least(len(ws), 10) - 1), ' ') AS win
      FROM b, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS u(i) WHERE len(ws) > 0),
g AS (SELECT k, i, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS win
      FROM d, (SELECT DISTINCT n FROM w) AS l, unnest(range(1, len(ws) - n + 2)) AS u(i)),
h AS (SELECT g.k, g.i, g.n, w.item_id FROM g JOIN w USING (win, n)),
c AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT k, i, n FROM h) AS s, unnest(range(i, i + n)) AS u(p) GROUP BY k),
t AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY k)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (k) LEFT JOIN t USING (k)""",
    "op2_exact_dedup": r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d""",
    "op7_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT k, doc_id, i, array_to_string(list_slice(ws, i, i + 49), ' ') AS win FROM d, unnest(range(1, len(ws) - 48)) AS u(i)),
f AS (SELECT win, min(doc_id) AS first_id FROM w GROUP BY win),
h AS (SELECT DISTINCT w.k, p FROM w JOIN f USING (win), unnest(range(w.i, w.i + 50)) AS u(p) WHERE w.doc_id > f.first_id),
c AS (SELECT k, count(*) AS n_removed FROM h GROUP BY k),
x AS (SELECT d.k, string_agg(ws[p], ' ' ORDER BY p) AS kept
      FROM d, unnest(range(1, len(ws) + 1)) AS u(p) WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.k = d.k AND h.p = u.p) GROUP BY d.k)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN c USING (k) LEFT JOIN x USING (k)""",
    "op8_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(text, '([<\[])(~*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|SYS>>|/SYS>>)', '\1~\2\3', 'g') AS body FROM c
), g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS learned,
         sum(12 + length(role) + 1 + length(body) + 11) AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g""",
    "op9_url_filter": r"""
WITH r(r_host, r_path, r_verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), p AS (
  SELECT page_id, row_number() OVER () AS k,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), m AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY length(r_host) + length(r_path) DESC) AS n
  FROM p LEFT JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
)
SELECT page_id, host, path, r_host || r_path AS rule, coalesce(r_verdict, 'allow') AS verdict FROM m WHERE n = 1""",
    "op11_suffix_dedup": """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT k, doc_id, base, len(h) // 2 AS n, substring(h, 2 * base + 1, 1198) AS part FROM d, unnest(range(0, len(h) // 2, 500)) AS u(base)),
w AS (SELECT k, doc_id, base + i AS i, md5_number(substring(part, 2 * i + 1, 200)) AS win FROM b, unnest(range(0, least(500, n - 99 - base))) AS u(i)),
f AS (SELECT win, min(doc_id) AS first_id FROM w GROUP BY win HAVING count(*) > 1),
r AS (SELECT DISTINCT k, i FROM (SELECT k, i, coalesce(doc_id > first_id, first_id IS NOT NULL) AS later, min(i) OVER (PARTITION BY win, k) AS own FROM w JOIN f USING (win)) WHERE later OR i > own),
g AS (SELECT k, i, sum(CASE WHEN i <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY i) AS run FROM (SELECT k, i, lag(i) OVER (PARTITION BY k ORDER BY i) AS before FROM r)),
s AS (SELECT k, min(i) AS lo, max(i) + 100 AS hi FROM g GROUP BY k, run),
n AS (SELECT k, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans FROM s GROUP BY k),
p AS (SELECT k, hi AS a, coalesce(lead(lo) OVER (PARTITION BY k ORDER BY lo), 1000000000) AS b FROM s UNION ALL SELECT k, 0, min(lo) FROM s GROUP BY k),
c AS (SELECT k, string_agg(substring(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS kept FROM p JOIN d USING (k) GROUP BY k)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN n USING (k) LEFT JOIN c USING (k)""",
    "op12_centroids": """
WITH r AS (SELECT row_number() OVER () AS k, vec_id, embedding FROM embeddings WHERE len(embedding) = 64),
u AS (SELECT k, unnest(range(1, 65)) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM r),
w AS (SELECT k FROM u GROUP BY k HAVING count(*) FILTER (WHERE x IS NOT NULL AND isfinite(x)) = 64),
e AS MATERIALIZED (SELECT k, d, CAST(floor(1024 * x) AS BIGINT) AS x FROM u JOIN w USING (k)),
f AS (SELECT k, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM r JOIN w USING (k) QUALIFY c < 8),
z0 AS MATERIALIZED (SELECT c, d, x AS y FROM f JOIN e USING (k)),"""
    + "".join(_NEAREST.format(i=i) + _MOVED.format(i=i, j=i + 1) for i in range(clustering.ROUNDS))
    + _NEAREST.format(i=clustering.ROUNDS)
    + f""",
h AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM z{clustering.ROUNDS} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, dist AS distance, CAST(sum(dist) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(dist) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM n{clustering.ROUNDS} JOIN r USING (k) JOIN h USING (c)""",
}

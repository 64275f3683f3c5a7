"""Concatenation, merging, alignment and core axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.frame import LaneFrame
from wayline.functions import vectors as vec
from wayline.operators import combine as cb
from wayline.plans.catalog import lanes, query, rounded, table


def _kinds(spark: SparkSession, sf_dir: str) -> dict[str, LaneFrame]:
    f = lanes(spark, sf_dir, "event_type")
    return {k: f.over(f.df.where(F.col("event_type") == k)).set_roles(fields=("value",)).renumbered().select("value") for k in ("view", "click")}


KINDS = "k AS (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY seq) - 1 AS seq, t, value FROM e WHERE event_type IN ('view', 'click'))"


@query(f"WITH {{e}}, {KINDS} SELECT event_type AS batch, user_id, seq, round(t, 6) AS t, value FROM k")
def concat_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cb.concat_batch(_kinds(spark, sf_dir)).df)


@query(f"WITH {{e}}, {KINDS} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY p, seq) - 1 AS seq, round(t, 6) AS t, value FROM (SELECT *, 0 AS p FROM e WHERE t < 1000000 UNION ALL SELECT *, 1 FROM e WHERE t >= 1000000)")
def concat_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lanes(spark, sf_dir)
    return rounded(cb.concat_sequence([f.over(f.df.where("t < 1000000")), f.over(f.df.where("t >= 1000000"))]).df)


@query(f"WITH {{e}}, {KINDS} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_type DESC, seq) - 1 AS seq, round(t, 6) AS t, value FROM k")
def concat_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cb.concat_sequence(list(_kinds(spark, sf_dir).values()), overlap="sort").df)


def _pair(spark: SparkSession, sf_dir: str) -> tuple[LaneFrame, LaneFrame]:
    k = _kinds(spark, sf_dir)
    return k["view"].rename(value="a"), k["click"].rename(value="b")


PAIR = f"{KINDS}, a AS (SELECT user_id, seq, t, value AS a FROM k WHERE event_type = 'view'), b AS (SELECT user_id, seq, t, value AS b FROM k WHERE event_type = 'click')"


@query(f"WITH {{e}}, {PAIR} SELECT a.user_id, a.seq, round(a.t, 6) AS t, a, b FROM a JOIN b ON a.user_id = b.user_id AND a.seq = b.seq")
def merge_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cb.merge(*_pair(spark, sf_dir), samples="inner").df)


@query(f"WITH {{e}}, {PAIR} SELECT user_id, seq, round(coalesce(a.t, b.t), 6) AS t, coalesce(a, -1) AS a, coalesce(b, -1) AS b FROM a FULL JOIN b USING (user_id, seq)")
def merge_outer_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cb.merge(*_pair(spark, sf_dir), lanes="outer", samples="outer", fill=-1.0).df)


@query(f"WITH {{e}}, {PAIR} SELECT user_id, seq, round(coalesce(a.t, b.t), 6) AS t, coalesce(a, b) AS value FROM a FULL JOIN b USING (user_id, seq)")
def merge_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _kinds(spark, sf_dir)
    return rounded(cb.merge(k["view"], k["click"], lanes="outer", samples="outer", compat="override").df)


@query(f"WITH {{e}}, {PAIR}, i AS (SELECT user_id, seq FROM a UNION SELECT user_id, seq FROM b) SELECT user_id, seq, CASE WHEN a.seq IS NULL THEN 0 ELSE a END AS a, b FROM i LEFT JOIN a USING (user_id, seq) LEFT JOIN (SELECT user_id, seq, b FROM b) AS b USING (user_id, seq)")
def align_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _pair(spark, sf_dir)
    x, _ = cb.align_many([a, b], lanes="outer", samples="outer", fill=0.0)
    _, y = cb.align_pair(a, b, lanes="outer", samples="outer")
    return rounded(x.df.select("user_id", "seq", "a").join(y.df.select("user_id", "seq", "b"), ["user_id", "seq"]))


@query(f"WITH {{e}}, {PAIR} SELECT a.user_id, a.seq, round(a - b, 6) AS value FROM a JOIN b ON a.user_id = b.user_id AND a.seq = b.seq")
def binary_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _kinds(spark, sf_dir)
    return rounded(cb.binary(k["view"], k["click"], lambda x, y: x - y, "inner", "inner").df.drop("t"))


@query("WITH {e} SELECT user_id, seq, round(value - avg(value) OVER (PARTITION BY user_id), 6) AS value FROM e")
def binary_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lanes(spark, sf_dir)
    means = LaneFrame(f.df.groupBy("user_id").agg(F.avg("value").alias("value")).withColumn("seq", F.lit(0)), ("user_id",), "seq", None, ("value",))
    return rounded(cb.binary(f, means, lambda x, m: x - m, broadcast=True).df.select("user_id", "seq", "value"))


def _items(spark: SparkSession, sf_dir: str) -> LaneFrame:
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_linenumber", "seq")
    return LaneFrame.of(li.withColumn("seq", F.col("seq").cast("long")), ["l_orderkey"], None, ["l_quantity", "l_discount", "l_tax"])


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS seq, l_quantity AS first, l_tax AS last FROM lineitem")
def stack_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = cb.stack_core(_items(spark, sf_dir), ["l_quantity", "l_discount", "l_tax"], "v")
    return f.df.select("l_orderkey", "seq", F.get("v", F.lit(0)).alias("first"), F.get("v", F.lit(2)).alias("last"))


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS seq, 4 AS n, l_quantity AS back FROM lineitem")
def concat_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _items(spark, sf_dir).with_fields(u=F.array("l_tax", "l_discount"), v=F.array("l_discount", "l_quantity")).select("u", "v")
    return cb.concat_core(f, ["u", "v"], "w").df.select("l_orderkey", "seq", F.size("w").alias("n"), F.get("w", F.lit(3)).alias("back"))


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS seq, l_discount AS d FROM lineitem")
def decompose_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = cb.stack_core(_items(spark, sf_dir), ["l_quantity", "l_discount", "l_tax"], "v")
    return cb.decompose_core(f, "v", ["q", "d", "t"])["d"].df


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS seq, l_quantity AS q, -l_discount AS d FROM lineitem")
def overlay_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = cb.stack_core(_items(spark, sf_dir), ["l_quantity", "l_discount", "l_tax"], "v")
    out = cb.overlay_core(f, "v", ["q", "d", "t"], [{"d": -F.get("v", F.lit(1))}])
    return out.df.select("l_orderkey", "seq", F.get("v", F.lit(0)).alias("q"), F.get("v", F.lit(1)).alias("d"))


@query("""
WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS v FROM embeddings)
SELECT a.vec_id, round(list_dot_product(a.v, b.v), 6) AS d FROM x AS a JOIN x AS b ON b.vec_id = a.vec_id + 1""")
def vec_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    y = x.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rounded(x.join(y, "vec_id").select("vec_id", vec.dot(F.col("embedding"), F.col("other")).alias("d")))


@query("""
WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: abs(v::DOUBLE)) AS v FROM embeddings)
SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS two, round(list_sum(v), 6) AS one, round(list_max(v), 6) AS most FROM x""")
def vec_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return rounded(table(spark, sf_dir, "embeddings").select("vec_id", vec.norm(e).alias("two"), vec.norm(e, 1).alias("one"), vec.norm(e, float("inf")).alias("most")))


def _matrix() -> Column:
    q, d, t, n = (F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber"))
    return F.array(F.array(q, d), F.array(t, n))


@query("""
SELECT l_orderkey, l_linenumber, round(l_quantity * l_quantity + l_discount * l_tax, 6) AS a, round(l_quantity * l_discount + l_discount * l_linenumber, 6) AS b,
       round(l_tax * l_quantity + l_linenumber * l_tax, 6) AS c, round(l_tax * l_discount + l_linenumber * l_linenumber, 6) AS d FROM lineitem""")
def matmul(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", _matrix().alias("m"))
    p = m.withColumn("p", vec.matmul_fixed(F.col("m"), F.col("m"), 2, 2, 2))
    cells = {n: F.get(F.get("p", F.lit(i)), F.lit(j)).alias(n) for n, i, j in (("a", 0, 0), ("b", 0, 1), ("c", 1, 0), ("d", 1, 1))}
    return rounded(p.select("l_orderkey", "l_linenumber", *cells.values()))


#: A factor that keeps quotients of round numbers off the ties of rounding.
OFF_TIES = 0.123456789
DET = "(l_quantity * l_linenumber - l_discount * l_tax)"


@query(f"SELECT l_orderkey, l_linenumber, round((l_linenumber * l_extendedprice - l_discount * 2) / {DET} * 0.123456789::DOUBLE, 5) AS x, round((l_quantity * 2 - l_tax * l_extendedprice) / {DET} * 0.123456789::DOUBLE, 5) AS y FROM lineitem")
def solve_2x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", vec.solve(_matrix(), F.array("l_extendedprice", F.lit(2.0))).alias("s"))
    return rounded(m.select("l_orderkey", "l_linenumber", (F.get("s", F.lit(0)) * OFF_TIES).alias("x"), (F.get("s", F.lit(1)) * OFF_TIES).alias("y")), 5)


@query(f"SELECT l_orderkey, l_linenumber, round(l_linenumber / {DET}, 6) AS a, round(l_tax / {DET}, 6) AS c FROM lineitem")
def inv_2x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", vec.inv_small(_matrix(), 2).alias("i"))
    return rounded(m.select("l_orderkey", "l_linenumber", F.get(F.get("i", F.lit(0)), F.lit(0)).alias("a"), F.abs(F.get(F.get("i", F.lit(1)), F.lit(0))).alias("c")))


@query(f"SELECT l_orderkey, l_linenumber, round(l_linenumber / {DET}, 6) AS a FROM lineitem")
def pinv_2x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", vec.pinv(_matrix()).alias("i"))
    return rounded(m.select("l_orderkey", "l_linenumber", F.get(F.get("i", F.lit(0)), F.lit(0)).alias("a")))

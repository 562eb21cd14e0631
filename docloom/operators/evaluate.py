"""IR metrics, grid search and latency statistics."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def metrics(hits: DataFrame, truth: DataFrame, k: int = 10, by: tuple = ()) -> DataFrame:
    """AGG-05: recall, precision, hit, mrr, ndcg for every query of truth(query_id, chunk_id, grade); hits(query_id, chunk_id, rank).

    Precision divides by k; gain is 2^grade - 1; the ideal uses all grades. `by`: further columns of hits
    (configurations), each evaluated against all of truth.
    """
    keys = ["query_id", *by]
    found = hits.where(F.col("rank") <= k).join(truth, ["query_id", "chunk_id"])
    per = found.groupBy(*keys).agg(F.count("*").alias("n"), F.min("rank").alias("first"), F.sum((F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("rank") + 1)).alias("dcg"))
    w = Window.partitionBy("query_id").orderBy(F.desc("grade"), "chunk_id")
    ideal = truth.withColumn("r", F.row_number().over(w)).groupBy("query_id").agg(F.count("*").alias("expected"), F.sum(F.when(F.col("r") <= k, (F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("r") + 1))).alias("idcg"))
    base = ideal if not by else ideal.join(hits.select(*by).distinct())  # every query under every configuration asked for
    return _metrics(base.join(per, keys, "left"), keys, k)


def _metrics(out: DataFrame, keys: list, k: int) -> DataFrame:
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(
        *keys,
        F.round(z(F.col("n") / F.col("expected")), 6).alias("recall"),
        F.round(z(F.col("n") / k), 6).alias("precision"),
        F.when(F.col("n") > 0, 1.0).otherwise(0.0).alias("hit"),
        F.round(z(1 / F.col("first")), 6).alias("mrr"),
        F.round(F.when(F.col("idcg") > 0, z(F.col("dcg") / F.col("idcg"))).otherwise(0.0), 6).alias("ndcg"),
    )


def label_metrics(hits: DataFrame, queries: DataFrame, rows: DataFrame, k: int = 10) -> DataFrame:
    """metrics() where a query's truth is every other row of its label: queries(query_id, label), rows(chunk_id, label, grade).

    The pairs of queries and rows, quadratic in the input, are never made: the ideal needs a label's count of each
    grade, less the query's own row, and the hits are looked up by their id. Ids are unique.
    """
    gain = lambda g: F.pow(F.lit(2.0), g) - 1
    rows = rows.where("label is not null")
    queries = queries.where("query_id is not null and label is not null")
    of = rows.groupBy("label").agg(F.count("*").alias("all")).join(rows.groupBy("label", "grade").agg(F.count("*").alias("m")).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("grade", "m")), asc=False).alias("grades")), "label")
    own = rows.select(F.col("chunk_id").alias("query_id"), F.col("grade").alias("own"), F.col("label").alias("own_label"))
    asked = queries.join(own, "query_id", "left").withColumn("own", F.when(F.col("own_label") == F.col("label"), F.col("own"))).join(of, "label")
    asked = asked.withColumn("expected", F.col("all") - F.col("own").isNotNull().cast("bigint")).where("expected > 0")
    # the grades of the best k, best first
    best = F.slice(F.flatten(F.transform("grades", lambda g: F.array_repeat(g["grade"], F.least(F.lit(k), g["m"] - F.when(g["grade"] == F.col("own"), 1).otherwise(0)).cast("int")))), 1, k)
    idcg = F.aggregate(F.transform(best, lambda g, i: gain(g) / F.log2(i + 2)), F.lit(0.0), lambda s, x: s + x)
    ideal = asked.select("query_id", "label", "expected", idcg.alias("idcg"))
    found = hits.where(F.col("rank") <= k).join(ideal.select("query_id", "label"), "query_id").where("query_id <> chunk_id").join(rows, ["chunk_id", "label"])
    per = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("rank").alias("first"), F.sum(gain(F.col("grade")) / F.log2(F.col("rank") + 1)).alias("dcg"))
    return _metrics(ideal.join(per, "query_id", "left"), ["query_id"], k)


NAMES = ("recall", "precision", "hit", "mrr", "ndcg")


def macro(per_query: DataFrame, *by: str) -> DataFrame:
    """AGG-06/07."""
    return per_query.groupBy(*by).agg(*[F.round(F.avg(c), 6).alias(c) for c in NAMES], F.count("*").alias("queries"))


def objective():
    """AGG-08."""
    return F.round(0.45 * F.col("recall") + 0.25 * F.col("mrr") + 0.20 * F.col("ndcg") + 0.10 * F.col("hit"), 6)


# The tuning grid.
RRF_KS, WEIGHTS, POOLS = (20, 40, 60, 80, 100), ((0.3, 0.7), (0.4, 0.6), (0.5, 0.5), (0.6, 0.4), (0.7, 0.3), (0.8, 0.2)), (20, 30, 50, 75, 100)


def grid(spark) -> DataFrame:
    """The 600 configurations."""
    rows = [(i, k, d, s, p, st, q) for i, (k, (d, s), p, st, q) in enumerate(product(RRF_KS, WEIGHTS, POOLS, ("rrf", "weighted_score"), (True, False)))]
    return spark.createDataFrame(rows, "config int, rrf_k int, wd double, ws double, pool int, strategy string, tuned boolean")


def grid_search(merged: DataFrame, truth: DataFrame, configs: DataFrame, intents: DataFrame, k: int = 10) -> DataFrame:
    """AGG-09: configurations ranked by objective, recall, smaller pool, RRF; one plan over pools of at most 100 a side.

    merged: fused pool (query_id, chunk_id, dense_score, dense_rank, sparse_score, sparse_rank);
    intents(query_id, kind, dense_weight, sparse_weight, pool_factor).
    """
    rows = merged.join(intents, "query_id").join(F.broadcast(configs))  # 600 rows at most
    depth = F.floor(F.col("pool") * F.col("pool_factor"))
    deep = lambda kind: F.when(F.col("tuned") & (F.col("kind") == kind), depth).otherwise(F.col("pool"))
    has_d, has_s = F.col("dense_rank") <= deep("semantic_question"), F.col("sparse_rank") <= deep("exact_identifier")
    rows = rows.withColumn("dr", F.when(has_d, F.col("dense_rank"))).withColumn("sr", F.when(has_s, F.col("sparse_rank"))).where("dr is not null or sr is not null")
    rows = rows.withColumn("ds", F.when(F.col("dr").isNotNull(), F.col("dense_score"))).withColumn("ss", F.when(F.col("sr").isNotNull(), F.col("sparse_score")))
    rows = rows.withColumn("w1", F.when(F.col("tuned"), F.col("dense_weight")).otherwise(F.col("wd"))).withColumn("w2", F.when(F.col("tuned"), F.col("sparse_weight")).otherwise(F.col("ws")))
    w = Window.partitionBy("config", "query_id")

    def norm(c):
        low, high = F.min(c).over(w), F.max(c).over(w)
        return F.when(F.col(c).isNull(), 0.0).when(high > low, (F.col(c) - low) / (high - low)).otherwise(1.0)

    part = lambda v, r: F.coalesce(F.col(v) / (F.col("rrf_k") + F.col(r)), F.lit(0.0))
    fused = F.when(F.col("strategy") == "rrf", part("w1", "dr") + part("w2", "sr")).otherwise(F.col("w1") * norm("ds") + F.col("w2") * norm("ss"))
    rows = rows.withColumn("fused", F.round(fused, 9))
    order = w.orderBy(F.desc("fused"), F.desc(F.coalesce("ds", F.lit(-1.0))), F.desc(F.coalesce("ss", F.lit(-1.0))), F.col("chunk_id") % 1000000, "chunk_id")
    hits = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("config", "query_id", "chunk_id", "rank")
    scored = macro(metrics(hits, truth, k, ("config",)), "config").withColumn("objective", objective())
    out = scored.join(F.broadcast(configs), "config")
    best = Window.orderBy(F.desc("objective"), F.desc("recall"), "pool", F.when(F.col("strategy") == "rrf", 0).otherwise(1), "config")  # 600 rows
    return out.withColumn("place", F.row_number().over(best))


def baselines(merged: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """AGG-10: macro metrics of the four plain strategies over one fused pool (as in grid_search)."""
    from docloom.operators import retrieval as R

    runs = {
        "dense_only": R.rrf(merged.where("dense_rank is not null"), k, dense_weight=1.0, sparse_weight=0.0), "sparse_only": R.rrf(merged.where("sparse_rank is not null"), k, dense_weight=0.0, sparse_weight=1.0),
        "default_rrf": R.rrf(merged, k), "default_weighted_score": R.weighted(merged, k),
    }
    out = None
    for name, hits in runs.items():
        one = macro(metrics(hits.select("query_id", "chunk_id", "rank"), truth, k)).withColumn("strategy", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("objective", objective())


def decide(tuned: DataFrame, default: DataFrame) -> DataFrame:
    """AGG-10: one row from macro metrics on the validation set: the tuned configuration is kept if its recall is no lower."""
    both = tuned.select(F.col("recall").alias("tuned_recall")).join(F.broadcast(default.select(F.col("recall").alias("default_recall"))))  # one row each
    return both.withColumn("decision", F.when(F.col("tuned_recall") >= F.col("default_recall"), "tuned configuration confirmed").otherwise("default configuration retained"))


#: A quantile's rank is first bracketed to this share of a group on each side.
BRACKET = 0.002


def latency(rows: DataFrame, *by: str) -> DataFrame:
    """AGG-11: mean, median, and p95/p99 as the sorted value at index floor(n p); rows(ms).

    A sketch of each group brackets every wanted rank; only the values inside the brackets are counted and
    ranked, each distinct value once, so that no task sorts a group.
    """
    if not by:
        return latency(rows.withColumn("_all", F.lit(1)), "_all").drop("_all")
    rows = rows.where("ms is not null")
    share = (0.5, 0.95, 0.99)
    ends = F.array(*[F.lit(min(1.0, max(0.0, p + d))) for p in share for d in (-BRACKET, BRACKET)])
    stats = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("ms").alias("mean"), F.percentile_approx("ms", ends, F.lit(10000)).alias("ends"))
    n = F.col("n")
    # the median is between two ranks where n is even
    ranks = [F.floor((n - 1) / 2), F.floor(n / 2), F.floor(n * 0.95), F.floor(n * 0.99)]
    wanted = [F.struct(F.lit(i).alias("i"), F.least(r, n - 1).alias("at"), F.get("ends", F.lit(2 * k)).alias("low"), F.get("ends", F.lit(2 * k + 1)).alias("high")) for i, (r, k) in enumerate(zip(ranks, (0, 0, 1, 2)))]
    asked = stats.select(*by, "n", "mean", F.explode(F.array(*wanted)).alias("w")).select(*by, "n", "mean", "w.*")
    values = rows.groupBy(*by, "ms").agg(F.count("*").alias("m"))
    met = values.join(asked.select(*by, "i", "at", "low", "high"), list(by)).where("ms <= high")
    below = met.where("ms < low").groupBy(*by, "i").agg(F.sum("m").alias("below"))
    w = Window.partitionBy(*by, "i").orderBy("ms").rowsBetween(Window.unboundedPreceding, 0)
    inside = met.where("ms >= low").withColumn("upto", F.sum("m").over(w)).join(below, [*by, "i"], "left").withColumn("upto", F.col("upto") + F.coalesce("below", F.lit(0)))
    got = inside.where("upto > at").groupBy(*by, "i").agg(F.min("ms").alias("v"))
    pick = lambda i: F.max(F.when(F.col("i") == i, F.col("v")))
    found = got.groupBy(*by).agg(((pick(0) + pick(1)) / 2).alias("median"), pick(2).alias("p95"), pick(3).alias("p99"))
    return stats.join(found, list(by)).select(*by, F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "p95", "p99")

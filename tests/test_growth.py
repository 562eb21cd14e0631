"""Steps that must not grow faster than their input: plans, memory bounds, and results against the plain way."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.functions import entities as E
from docloom.operators import compare, evaluate, retrieval


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


WORDS = ["must", "may", "token", "_token_", "**mfa**", "Backup", "is", "optional", "é", "30", "days", "a.b-c", "Straße", "of", "the"]


def _clauses(spark, seed=1, pairs=12):
    rng = random.Random(seed)
    text = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 1, 2, 5, 9])))
    rows = [(str(p), s, i, rng.choice(["Section 1: Terms", "2. Access > Rules", "General", "Access"]), text(), rng.random() < 0.2) for p in range(pairs) for s in "ab" for i in range(1, rng.choice([1, 3, 8]))]
    from docloom.functions import text as T

    df = spark.createDataFrame(rows, "pair_id string, side string, idx int, section string, raw string, is_table boolean")
    return df.withColumn("norm", T.normalize_clause(F.col("raw"))).cache()


def test_align_is_one_pass(spark):
    p = plan(compare.align(_clauses(spark)))
    assert p.count("Exchange hashpartitioning") == 1 and "Join" not in p


@pytest.mark.parametrize("rows", [1, 7, 4096])
def test_align_equals_scored_pairs(spark, rows):
    c = _clauses(spark)
    got = sorted(map(tuple, compare.align(c).where("score is not null").select("pair_id", "ia", "ib", "head", "lex", "sem", "score", "method").collect()))
    want = sorted(map(tuple, compare.greedy(compare.scored_pairs(c)).collect()))
    assert got == want and got
    # the same in process, for parts of any size
    t = c.select("pair_id", "side", "idx", "section", "raw", F.lower(F.trim("norm")).alias("norm"), "is_table", compare.T.normalize_heading(F.col("section")).alias("heading")).orderBy("pair_id", "side", "idx").toArrow()
    before, compare.ROWS = compare.ROWS, rows
    try:
        out = [x for w in compare._whole_pairs(t.combine_chunks().to_batches()) for x in compare._aligned(w).to_pylist()]
    finally:
        compare.ROWS = before
    assert sorted((x["pair_id"], x["ia"], x["ib"], x["head"], x["lex"], x["sem"], x["score"], x["method"]) for x in out if x["score"] is not None) == want
    assert len(out) == compare.align(c).count() == c.count() - len(want)


@pytest.mark.parametrize("hold", [1, 3, 16])
def test_match_of_a_large_pair(hold):
    class Given:
        def __init__(self, m):
            self.m = m

        def of(self, a, b):
            c = self.m[a, b - len(self.m)]
            return None, None, None, c, c > 0.3

    rng = np.random.default_rng(hold)
    for n, k in ((30, 40), (40, 25), (1, 5)):
        m = np.round(rng.random((n, k)), 1)
        want, ua, ub = set(), set(), set()
        for s, i, j in sorted((-m[i, j], i, j) for i in range(n) for j in range(k) if m[i, j] > 0.3):
            if i not in ua and j not in ub:
                ua.add(i)
                ub.add(j)
                want.add((i, j + n))
        assert set(compare._match_pair(Given(m), np.arange(n), np.arange(n, n + k), hold)) == want


def test_compare_leaves_out_pairs_with_a_blank_side(spark):
    docs = spark.createDataFrame([("p", "a", "Logs must be kept."), ("p", "b", "  "), ("q", "a", "Users shall sign in now."), ("q", "b", "Users shall sign in now."), ("r", "b", "Nothing else.")], "pair_id string, side string, text string")
    assert {r["pair_id"] for r in compare.compare(docs).collect()} == {"q"}
    assert compare.align(compare.extract(docs)).where("pair_id = 'r'").count() == 1


def test_rounding_is_half_up_of_decimals():
    assert compare.rounded(np.array([0.63125, 0.00005, 0.12344999, 1.0])).tolist() == [0.6313, 0.0001, 0.1234, 1.0]


def test_jaccard_pairs_in_many_tasks(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, None]), k, [rng.choice("abcdefghi") for _ in range(rng.choice([0, 1, 4]))]) for k in range(90)] + [(1, 5, ["a"])]
    df = spark.createDataFrame(rows, "block int, key long, words array<string>").withColumn("words", F.array_distinct("words"))
    p, q = df.toDF("block", "a", "w"), df.toDF("block", "b", "v")
    want = sorted(map(tuple, p.join(q, "block").where("a < b").select("a", "b", F.round(compare.T.jaccard(F.col("w"), F.col("v")), 6)).collect()))
    for chunk in (1024, 7):
        monkeypatch.setattr(compare, "CHUNK", chunk)
        assert sorted(map(tuple, compare.jaccard_pairs(df).collect())) == want
    assert compare.jaccard_pairs(df).rdd.getNumPartitions() > 8


def test_postings_shuffle_text_not_terms(spark):
    c = spark.createDataFrame([(1, "a b a"), (2, "b"), (1, "a c"), (3, None)], "chunk_id long, content string")
    p = retrieval.postings(c)
    made = plan(p)
    assert made.count("Exchange hashpartitioning") == 1 and made.index("Exchange") > made.index("Generate")
    assert sorted(map(tuple, p.collect())) == [(1, "a", 3), (1, "b", 1), (1, "c", 1), (2, "b", 1)]


def test_label_metrics_equal_metrics_of_all_pairs(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([0, 0, 1, 2, None]), rng.choice([1, 2])) for i in range(60)] + [(99, 7, 1)]
    r = spark.createDataFrame(rows, "chunk_id long, label int, grade int")
    q = r.where("chunk_id % 3 = 0").select(F.col("chunk_id").alias("query_id"), "label")
    h = spark.createDataFrame([(i, c, k + 1) for i in range(0, 100, 3) for k, c in enumerate(rng.sample([j for j in range(60) if j != i], 12))], "query_id long, chunk_id long, rank int")
    truth = q.join(r, "label").where("query_id <> chunk_id").select("query_id", "chunk_id", "grade")
    got = evaluate.label_metrics(h, q, r)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, evaluate.metrics(h, truth).collect()))


def test_dense_in_small_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(50)], "chunk_id long, vec array<double>")
    q = v.where("chunk_id < 20").toDF("query_id", "qvec")
    want = sorted(map(tuple, retrieval.dense(v, q, 5).collect()))
    monkeypatch.setattr(retrieval, "SCORES", 100)
    assert sorted(map(tuple, retrieval.dense(v, q, 5).collect())) == want and len(want) == 100


def _texts(n=3000):
    rng = random.Random(7)
    number = lambda: rng.choice(["1", "30", "1,200", "7", "30", "007", "1.50", "2.0", "10%", "0", "12,034", "999"])
    word = ["days", "day", "business days", "USD", "$", "dollars", "%", "Section", "clause_4", "RFC-77", "ISO-9001", "HIPAA", "v1.2-b3", "2024-01-02", "Mar 3, 2020", "1/2/99", "€", "é", "must ", "HOURS", "business  days", "_", "-", ".", ",", "\n", "gdpr"]
    return ["".join(x + rng.choice([" ", "" if len(x) < 4 else "%", " "]) for x in (rng.choice([number(), rng.choice(word)]) for _ in range(rng.randrange(9)))) for _ in range(n)] + [None, ""]


def test_entities_of_shapes_equal_the_expressions(spark):
    texts = _texts()
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(texts, texts[1:] + texts[:1]))], "id int, a string, b string").repartition(3)
    want = df.select("id", F.explode(E.entities(F.col("a"))).alias("type", "f")).select("id", "type", F.posexplode("f").alias("pos", "e")).select("id", "type", "pos", "e.raw", "e.norm")
    order = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert order(E.entity_rows(df.select("id", "a"), "a")) == order(want)
    none = F.expr("cast(map() as map<string,array<struct<raw:string,norm:string>>>)")
    diffs = E.entity_diffs(*(F.coalesce(E.entities(F.col(c)), none) for c in "ab"))
    want = df.select("id", F.explode(diffs).alias("d")).select("id", "d.type", "d.pos", "d.norm_a", "d.norm_b", "d.divergent")
    assert order(E.diff_rows(df, "a", "b")) == order(want)
    aligned = df.select("id", F.col("a").alias("raw_a"), F.col("b").alias("raw_b"), F.lit(0.96).alias("lex"), F.lit(0.9).alias("score"))
    assert order(compare.classify(aligned, diffs=False).select("id", "diff_type", "severity")) == order(compare.classify(aligned).select("id", "diff_type", "severity"))
    # most of such text is not odd, and shapes are shared
    assert 0 < df.where(E.odd(F.col("a"))).count() < df.count()


def test_shapes_are_forgotten(monkeypatch):
    monkeypatch.setattr(E, "SHAPES", 5)
    known = E._Shapes()
    for i in range(30):
        known.of([b"a" * i + b" 0 days", b"x"])
        assert len(known.number) <= 7


def test_clause_queries_call_no_pattern_for_plain_text(spark):
    import __spark_entry__ as e

    for name in ("entity_extract", "entity_diff_positional", "comparison_stats", "conflicts_only", "divergence_index", "document_comparison"):
        assert "MapInArrow" in plan(e.queries()[name](spark, "/root/testdata/sf0.001")), name


def test_hits_are_sent_to_the_documents(spark):
    from docloom.plans import analysis

    sf = "/root/testdata/sf0.001"
    got = analysis._ranked(spark, sf)
    made = plan(got)
    assert "SortMergeJoin" not in made and "Generate" not in made
    hits = retrieval.bm25(analysis.index(spark, sf), analysis.items(spark, sf), 25).withColumnRenamed("score", "fused")
    lines = retrieval.line_chunks(spark.read.parquet(f"{sf}/documents.parquet")).select("chunk_id", "doc_id", "department", "content")
    columns = ["query_id", "chunk_id", "doc_id", "department", "content", "fused", "rank", "query"]
    want = hits.join(lines, "chunk_id").join(analysis.items(spark, sf), "query_id")
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(map(tuple, want.select(columns).collect()), key=str)

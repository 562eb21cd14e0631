"""Core operators against hand-computed values."""

import math

import pytest
from pyspark.sql import functions as F

from docloom.functions import entities as E
from docloom.functions import text as T
from docloom.operators import audit, chunking, compare, evaluate, evidence, retrieval, structure
from docloom.sources import sinks


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, T.tokens(F.lit("C++ and RFC-4821 v2.1.0, Straße"))) == ["c++", "and", "rfc-4821", "v2.1.0", "straße"]
    assert one(spark, T.tokens(F.lit(None).cast("string"))) == []


def test_text_functions(spark):
    assert one(spark, T.normalize_heading(F.lit("Section 4.1.2: Backup  Policy > 3. Rules"))) == "backup policy > rules"
    assert one(spark, T.normalize_heading(F.lit(""))) == "general"
    assert one(spark, T.citation_ids(F.lit("a [1, 3] b [2-4] c [9-40] d [x]"))) == [1, 2, 3, 4]
    assert one(spark, T.sentences(F.lit("It costs 3.5 dollars. See e.g. this one. Done!"))) == ["It costs 3.5 dollars.", "See e.g. this one.", "Done!"]
    assert one(spark, T.redact(F.lit("Bearer abc.def ok"))) == "Bearer [REDACTED] ok"
    assert one(spark, T.query_fingerprint(F.lit("  "))) is None
    assert one(spark, T.lexical_similarity(F.lit("a b"), F.lit(" a b "))) == 1.0
    assert one(spark, T.redact_map(F.create_map(F.lit("api_key"), F.lit("x"), F.lit("n"), F.lit("y")))) == {"api_key": "[REDACTED]", "n": "y"}


@pytest.mark.parametrize(
    "q,kind", [("", "keyword_search"), ("RFC-123 rules", "exact_identifier"), ("how long is retention", "semantic_question"), ("data retention", "keyword_search"), ("backup retention for legal archives", "mixed")]
)
def test_intent(spark, q, kind):
    assert one(spark, retrieval.intent(F.lit(q)))["kind"] == kind


def test_fusion(spark):
    d = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.5, 2)], "query_id long, chunk_id long, score double, rank int")
    s = spark.createDataFrame([(1, 11, 7.0, 1), (1, 12, 3.0, 2)], "query_id long, chunk_id long, score double, rank int")
    got = {r["chunk_id"]: r["fused"] for r in retrieval.fuse(d, s).collect()}
    assert got[11] == pytest.approx(0.6 / 62 + 0.4 / 61, abs=1e-8) and got[10] == pytest.approx(0.6 / 61, abs=1e-8)
    w = {r["chunk_id"]: r["fused"] for r in retrieval.fuse(d, s, "weighted_score").collect()}
    assert w == {10: 0.6, 11: 0.4, 12: 0.0}


def test_access_fails_closed(spark):
    c = spark.createDataFrame([(1, 1, "a", 2), (2, 2, "b", 1)], "doc_id long, chunk_id long, department string, clearance int")
    assert retrieval.allowed(c, []).count() == 0
    assert retrieval.allowed(c, [], strict=False).count() == 2
    assert retrieval.allowed(c, ["a", "b"], clearance=1).count() == 1


def test_metrics(spark):
    hits = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "query_id long, chunk_id long, rank int")
    truth = spark.createDataFrame([(1, 6, 1), (1, 7, 1), (2, 9, 1)], "query_id long, chunk_id long, grade int")
    got = {r["query_id"]: r for r in evaluate.metrics(hits, truth).collect()}
    ideal = 1 + 1 / math.log2(3)
    assert got[1]["recall"] == 0.5 and got[1]["mrr"] == 0.5 and got[1]["precision"] == 0.1
    assert got[1]["ndcg"] == pytest.approx((1 / math.log2(3)) / ideal, abs=1e-6)
    assert got[2]["hit"] == 0.0 and got[2]["ndcg"] == 0.0


def test_entities(spark):
    e = one(spark, E.entities(F.lit("Keep 30 days, pay $1,200.50 or 5% under RFC-77 v1.2 and 9 more; 30 again")))
    norm = {k: [x["norm"] for x in v] for k, v in e.items()}
    assert norm["duration"] == ["30 days"] and norm["currency"] == ["USD 1200.50"] and norm["percentage"] == ["5%"]
    assert norm["rfc"] == ["RFC-77"] and "v1.2" in norm["version"]
    assert "9" in norm["number"] and "30" not in norm["number"]


def test_polarity_and_divergence(spark):
    assert one(spark, E.polarity_conflict(F.lit("It must be kept"), F.lit("It is optional"))) == "mandate"
    assert one(spark, E.polarity_conflict(F.lit("Sharing is forbidden"), F.lit("Sharing is allowed"))) == "permission"
    assert one(spark, E.divergence(*[F.lit(x) for x in (4, 4, 1, 0, 1, 1)])) == 0.5625


def test_compare(spark):
    a = "# Doc\n\n## 1. Retention\nLogs must be kept for 30 days.\n\n## 2. Access\nUsers shall sign in."
    b = "# Doc\n\n## 1. Retention\nLogs must be kept for 90 days.\n\n## 3. Other\nNothing at all here applies to cats."
    docs = spark.createDataFrame([("p", "a", a), ("p", "b", b)], "pair_id string, side string, text string")
    rows = {(r["raw_a"], r["raw_b"]): r["diff_type"] for r in compare.compare(docs).collect()}
    assert rows[("Logs must be kept for 30 days.", "Logs must be kept for 90 days.")] == "conflict"
    assert "removed" in rows.values() and "added" in rows.values()


def test_greedy_against_brute_force(spark):
    import random

    rng = random.Random(4)
    rows = [(str(p), i, j, 0.0, 0.0, 0.0, rng.choice([0.7, 0.8, 0.9, rng.random()]), "m") for p in range(12) for i in range(6) for j in range(5)]
    got = {(r["pair_id"], r["ia"], r["ib"]) for r in compare.greedy(spark.createDataFrame(rows, "pair_id string, ia int, ib int, head double, lex double, sem double, score double, method string")).collect()}
    want, ua, ub = set(), set(), set()
    for p, i, j, *_, s, _m in sorted(rows, key=lambda r: (-r[6], r[1], r[2])):
        if (p, i) not in ua and (p, j) not in ub:
            ua.add((p, i))
            ub.add((p, j))
            want.add((p, i, j))
    assert got == want


def test_chunk_limits():
    text = " ".join(f"Sentence number {i} has some words here." for i in range(200))
    out = chunking.fold([(1, "paragraph", text, "A > B"), (2, "paragraph", "Short end.", "A > B")], 100, 128, 20)
    assert len(out) > 5 and all(n <= 128 for _, n, _ in out)
    assert all(c.startswith("[Context: A > B]") for c, _, _ in out)
    table = "| a | b |\n| :--- | :--- |\n" + "\n".join(f"| {i} | x |" for i in range(60))
    parts = chunking.table_slices(table, 60)
    assert all(p.startswith("| a | b |\n| :--- | :--- |") for p in parts)
    assert sum(p.count("\n") - 1 for p in parts) == 60
    with pytest.raises(ValueError):
        chunking.table_slices(table, 5)


def test_pack(spark):
    rows = [(1, 1, 1, 1, "s", "a b c d", 10), (1, 2, 2, 1, "s", "a b c d", 10), (1, 3, 3, 1, "s", "e f", 2000), (1, 4, 4, 1, "s", "g h", 10), (1, 5, 5, 1, "s", "i j", 10)]
    df = spark.createDataFrame(rows, "query_id long, rank int, chunk_id long, doc_id long, section string, text string, tokens int")
    assert [r["chunk_id"] for r in evidence.pack(df).orderBy("citation_id").collect()] == [1, 4]


def test_claims_and_grounding(spark):
    items = spark.createDataFrame([(1, 1, "Backups are kept for 30 days by policy.")], "answer_id long, citation_id int, text string")
    answers = spark.createDataFrame([(1, "- Backups are kept for 30 days [1].\n- Backups are kept for 45 days [1].\n- Nothing cited here at all.", [3])], "answer_id long, answer string, ids array<int>")
    rows = {r["claim"]: r["status"] for r in evidence.verify_claims(evidence.claims(answers), items).collect()}
    assert sorted(rows.values()) == ["supported", "unsupported", "unsupported"]
    c = evidence.verify_citations(answers, items).first()
    assert c["valid"] == [1] and c["invalid"] == [3]


def test_structure(spark):
    e = spark.createDataFrame([(1, 1, "h1", "A"), (1, 2, "h2", "B"), (1, 3, "paragraph", "x"), (1, 4, "h1", "C"), (1, 5, "paragraph", "y")], "doc_id long, ord long, type string, text string")
    got = {r["ord"]: r["section"] for r in structure.breadcrumbs(e).collect()}
    assert got[3] == "A > B" and got[5] == "C"
    i = structure.islands if hasattr(structure, "islands") else chunking.islands
    rows = i(structure.breadcrumbs(e).withColumn("page", F.lit(1))).collect()
    assert len({r["island"] for r in rows}) == 2


def test_audit_chain(spark):
    ev = spark.createDataFrame([(i, 7, "error", f"2024-01-01 00:0{i}:00") for i in range(6)], "event_id long, user_id long, event_type string, t string").withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t")
    log = audit.chain(audit.from_events(ev)).cache()
    assert audit.verify(log).count() == 0
    forged = log.withColumn("action", F.when(F.col("event_id") == 3, "x").otherwise(F.col("action")))
    assert [(r["event_id"], r["kind"]) for r in audit.verify(forged).collect()] == [(3, "changed_row")]
    assert {r["kind"] for r in audit.verify(log.where("event_id <> 3")).collect()} == {"broken_link"}
    assert audit.sliding(audit.from_events(ev)).count() == 2
    assert audit.bursts(audit.from_events(ev)).count() == 1


def test_sinks(spark):
    new = spark.createDataFrame([(1, "h1", 1), (2, "h1", 2), (3, "h2", 3)], "document_id long, file_hash string, created_at int")
    old = spark.createDataFrame([(9, "h2", 0)], "document_id long, file_hash string, created_at int")
    ins, dup = sinks.dedup_upsert(new, old)
    assert [r["document_id"] for r in ins.collect()] == [1]
    assert {r["document_id"]: r["duplicate_of"] for r in dup.collect()} == {2: 1, 3: 9}
    t = spark.createDataFrame([(1, None, "a"), (1, 2, "b")], "document_id long, version_id long, x string")
    assert [r["x"] for r in sinks.delete_version(t, 1).collect()] == ["b"]
    assert sinks.delete_version(t, 1, whole_document=True).count() == 0
    assert {r["x"] for r in sinks.replace(t, spark.createDataFrame([(1, None, "n")], t.schema), ["document_id", "version_id"]).collect()} == {"b", "n"}


def test_stream_equals_batch(spark, tmp_path):
    from docloom.streaming.bursts import burst_alerts

    rows = [(i, i % 3, f"2024-01-01 00:{(i * 7) % 60:02d}:00") for i in range(60)]
    ev = spark.createDataFrame(rows, "event_id long, user_id long, t string").withColumn("created_at", F.col("t").cast("timestamp")).drop("t")
    ev.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    q = burst_alerts(stream, minutes=10, threshold=4).writeStream.format("memory").queryName("alerts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r["user_id"], r["event_id"]) for r in spark.table("alerts").collect()}
    want = {(r["user_id"], r["event_id"]) for r in audit.bursts(ev, minutes=10, threshold=4).collect()}
    assert got == want and want


def test_registry():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and len([k for k in q if not k.startswith("op")]) > 50

"""Near-duplicates by shingle similarity against brute force."""

import random

import numpy as np
from test_ops import SCHEMA, union, words

from docloom.llm import common, simhash, similar
from docloom.llm.common import mix


def brute(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_similar(spark):
    rng = random.Random(11)
    docs = []
    for k in range(30):
        base = words(rng, 60 + 10 * k, 3000).split()
        for v in range(5):
            t = list(base)
            for _ in range(v * (1 + len(t) // 150)):
                t[rng.randrange(len(t))] = "changed"
            docs.append((len(docs), "  ".join(t) if v == 2 else " ".join(t)))
    docs += [(900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "ONE TWO "), (905, "one two three"), (None, docs[0][1]), (906, docs[7][1].upper())]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], SCHEMA).repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(df).collect()}
    sets = {i: brute(t) for i, t in docs if i is not None}
    similarity = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    pairs = {(a, b): similarity(x, y) for a, x in sets.items() for b, y in sets.items() if a < b}
    assert sum(0.8 <= j < 0.95 for j in pairs.values()) > 20 and sum(0.6 < j < 0.8 for j in pairs.values()) > 20
    assert got == union([p for p, j in pairs.items() if j >= 0.8], sets)
    kept = similar.deduplicate(df)
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(set(got.values()))
    assert kept.where("doc_id is null").count() == 1
    assert similar.deduplicate(df.where("false")).count() == 0


def test_similar_in_parts(spark, monkeypatch):
    monkeypatch.setattr(similar, "PART", 200)
    test_similar(spark)


def test_linked_against_brute_force():
    rng = np.random.default_rng(13)
    sets = [np.unique(rng.integers(0, 12, rng.integers(1, 12))) for _ in range(60)]
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    comp, part = rng.integers(0, 9, 60), rng.integers(0, 2, 60)
    similarity = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    prints = simhash.wide_prints(mix(np.concatenate(sets).astype(np.uint64) + np.uint64(99)), at)
    for alike in (True, False):
        want = {(i, j) for i in range(60) for j in range(i + 1, 60) if comp[i] != comp[j] and (alike or part[i] != part[j]) and similarity(sets[i], sets[j]) >= 0.8}
        assert {(i, j) for u, v in similar.linked(np.concatenate(sets), at, comp, part, alike, prints) for i, j in zip(u.tolist(), v.tolist())} == want and want


def test_wide_prints_and_bit_sliced_distances():
    rng = np.random.default_rng(14)
    sizes = [0, 1, 4, 5, 70, 65534, 65536, 140000, 0]
    at = np.concatenate([[0], np.cumsum(sizes)])
    h = rng.integers(0, 2**63, at[-1], dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, at[-1], dtype=np.uint64)
    got = simhash.wide_prints(h, at)
    for i, n in enumerate(sizes):
        for k in range(simhash.WIDE // 64):
            g = mix(h[at[i] : at[i + 1]] ^ simhash._WORDS[k])
            ones = [int(((g >> np.uint64(b)) & np.uint64(1)).sum()) for b in range(64)]
            assert int(got[i, k]) == sum(1 << b for b in range(64) if 2 * ones[b] > n)
    prints = rng.integers(0, 2**63, (150, 4), dtype=np.uint64)
    for i in range(1, 150):  # near the one before, by a growing number of bits
        prints[i] = prints[i - 1] if i % 7 else prints[i]
        for b in rng.choice(256, i % 9 * 8, replace=False).tolist():
            prints[i, b // 64] ^= np.uint64(1 << b % 64)
    apart = np.bitwise_count(prints[:, None] ^ prints[None]).sum(2)
    for radius in (0, 3, 64, 80, 127):
        assert (simhash.within(simhash.vertical(prints), prints[:70], radius)[:, :150] == (apart[:70] <= radius)).all()


def test_pipeline_stage_drops_edited_copies(spark):
    import corpus_pipeline

    rng = random.Random(12)
    base = words(rng, 200, 3000).split()
    edited = base[:40] + ["a"] + base[41:110] + ["b"] + base[111:170] + ["c"] + base[171:]
    assert 0.8 <= len(brute(" ".join(base)) & brute(" ".join(edited))) / len(brute(" ".join(base)) | brute(" ".join(edited))) < 0.95
    docs = spark.createDataFrame([(1, " ".join(base), "en", "s", 1), (2, " ".join(edited), "en", "s", 1), (3, words(rng, 200, 3000), "en", "s", 1)], SCHEMA)
    assert sorted(r["doc_id"] for r in corpus_pipeline.deduplicate(spark, docs, "").collect()) == [1, 3]


def test_components_held_by_one_task(spark):
    rng = random.Random(15)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    pairs += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 2000 + i) for i in range(50)] + [(7, 7), (2**62, -(2**62)), (3000, 3001), (3001, 3000)]
    want = union([p for p in pairs if p[0] != p[1]], {n for p in pairs if p[0] != p[1] for n in p})
    df = spark.createDataFrame(pairs, "a bigint, b bigint").repartition(3)
    tables = len(common._TABLES)
    for held in (0, 340, 1 << 19):  # in rounds; in rounds, then in one task; in one task
        assert {r["node"]: r["component"] for r in common.components(df, held=held).collect()} == want
    assert len(common._TABLES) == tables + 3
    assert common.components(df.where("false"), held=9).count() == 0


def test_few_links_cost_the_driver_no_rounds(spark):
    rng = random.Random(16)
    base = [words(rng, 80, 3000).split() for _ in range(12)]
    docs = [(12 * v + k, " ".join(t[: 40 + v] + ["new"] * (v > 0) + t[40 + v :]), "en", "s", 1) for v in range(4) for k, t in enumerate(base)]
    sc = spark.sparkContext
    sc.setJobGroup("links", "links")
    try:
        got = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(spark.createDataFrame(docs, SCHEMA)).collect()}
        jobs = len(sc.statusTracker().getJobIdsForGroup("links"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == {i: i % 12 for i in range(48)}
    assert jobs < 60, jobs  # 75 where rounds join the links

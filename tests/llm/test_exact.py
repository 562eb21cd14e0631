"""Exactness where hashes, rows or names could confuse: collisions, repeated ids, clashing columns, neighbours."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ops import DOCS, SCHEMA, brute_hits, union, words

from docloom.llm import common, cover_tree, decontaminate, packing, pii, secrets, simhash, similar, token_counts, toxicity, url_filter


def thue_morse(n, a, b):
    """Two words of n letters that every polynomial hash modulo 2**64 takes for one."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join(a if x else b for x in bits), "".join(b if x else a for x in bits)


def laid(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


@pytest.mark.parametrize("broken", [False, True])
def test_distinct_chunks(monkeypatch, broken):
    if broken:
        monkeypatch.setattr(common, "_fold", lambda h, w: np.zeros(len(h), np.uint64))
    rng = random.Random(1)
    chunks = ["".join(rng.choice("ab\0") for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 31, 32, 33, 40]))) for _ in range(400)] + list(thue_morse(2048, "a", "b")) * 2
    data, offsets = laid(chunks)
    first, which = common.distinct_chunks(data, offsets[:-1], offsets[1:])
    assert [chunks[first[k]] for k in which] == chunks and len(first) == len(set(chunks))


PAIRS = [thue_morse(n, a, b) for n in (1024, 2048) for a, b in (("a", "b"), ("q", "z"), ("a", "e"))]


def test_collisions_decontaminate(spark):
    x, y = PAIRS[1]
    docs = [(1, f"one {x} two"), (2, f"one {y} two"), (3, f"{x} {y}")]
    bench = [(7, f"one {x} two"), (8, f"{y} {x}")]
    d, b = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS), spark.createDataFrame(bench, "item_id bigint, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in decontaminate.search(decontaminate.build_index(d), b).collect()), key=str)
    assert got == brute_hits(docs, bench) and got[0][2] == 3 and got[1][2] == 0


def test_collisions_of_term_hashes(monkeypatch):
    monkeypatch.setattr(decontaminate, "hash_chunks", lambda d, s, e: np.zeros(len(s), np.uint64))
    seg = decontaminate.segment(*laid(["a b c", "b a c", "c"]))
    q = decontaminate.phrases([(1, "b c"), (2, "a c"), (3, "d")])
    p, d, _ = decontaminate.find(seg, q)
    assert sorted(zip(q["item"][p], d.tolist())) == [("1", 0), ("2", 1)]


def test_collisions_tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    word, lib = packing.WordTokenizer(packing.default_tokenizer()), Tokenizer.from_file(packing.default_tokenizer())
    prefix, sp = token_counts.PrefixCounter(token_counts.default_model()), sentencepiece.SentencePieceProcessor(model_file=token_counts.default_model())
    for x, y in PAIRS:
        texts = [f"{x} {y} {x}", f"in {y}, {x}"]
        data, offsets = laid(texts)
        ids, rows = word.of(data, offsets)
        assert [ids[a:b].tolist() for a, b in zip(rows, rows[1:])] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
        total = np.concatenate([[0], np.cumsum(prefix.of(data, offsets), dtype=np.int64)])
        assert np.diff(total[offsets]).tolist() == [len(sp.encode(t)) for t in texts]


def test_token_counts_keep_chunks():
    """Chunks that open a text and the others are kept side by side."""
    c, asked = token_counts.PrefixCounter(token_counts.default_model()), []
    value = c.cache.value
    c.cache.value = lambda chunks: asked.extend(chunks) or value(chunks)
    texts = ["one two three", "two threes", "", "three"]
    got = c.of(*laid(texts)).tolist()
    assert asked
    asked.clear()
    assert c.of(*laid(texts)).tolist() == got and not asked


def test_token_counts_share_prefixes():
    """A chunk goes on from the prefix it shares with the chunk before it in order."""
    c, steps = token_counts.PrefixCounter(token_counts.default_model()), []
    counts = c.counts
    c.counts = lambda s, count, last: steps.append(len(s) + 1 - len(count)) or counts(s, count, last)
    c.changes([b" threes", b" three", b"\xffthreefold", b"a"])
    assert steps == [1, 6, 4, 1]


def test_token_counts_of_wide_characters():
    """Texts are cut beside characters of several bytes too, and every prefix counts as in the library."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=token_counts.default_model())
    c, rng = token_counts.PrefixCounter(token_counts.default_model()), random.Random(12)
    assert len(token_counts.cut(*laid(["schön früh süß, déjà là"]), c.safe)) >= 5
    pieces = [p.replace("▁", rng.choice(" ▁")) for p in c.score]
    wide = [p for p in pieces if not p.isascii()]
    single = sorted({x for p in wide for x in p}) + list("  ▁\u00c1\u0781\u2581\u3041\U0001f601\U0001f600\u0301\n\t%")
    for _ in range(60):
        texts = ["".join(rng.choice(rng.choice([pieces, wide, single, single])) for _ in range(rng.randrange(1, 12))) for _ in range(20)]
        data, offsets = laid(texts)
        got = c.of(data, offsets)
        for t, a, b in zip(texts, offsets.tolist(), offsets[1:].tolist()):
            assert [token_counts.count_at(got[a:b].tobytes(), len(t[:k].encode())) for k in range(len(t) + 1)] == [len(sp.encode(t[:k])) for k in range(len(t) + 1)], t


def test_token_counts_of_long_spaces():
    """Merges of equal score are made leftmost first, as in the library: runs of 14 spaces and more."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=token_counts.default_model())
    c, rng = token_counts.PrefixCounter(token_counts.default_model()), random.Random(13)
    texts = [a + " " * n + b for n in range(70) for a, b in (("", ""), ("", "the"), ("a", ""), ("if x:\n", "return"), ("é", "日"))]
    texts += ["".join(rng.choice([" " * rng.randrange(1, 40), "▁" * rng.randrange(1, 20), "\n", "\t", "x", "the", "1", "é"]) for _ in range(8)) for _ in range(200)]
    data, offsets = laid(texts)
    total = np.concatenate([[0], np.cumsum(c.of(data, offsets), dtype=np.int64)])
    for t, a, b in zip(texts, offsets.tolist(), offsets[1:].tolist()):
        assert [total[a + len(t[:k].encode())] - total[a] for k in range(len(t) + 1)] == [len(sp.encode(t[:k])) for k in range(len(t) + 1)], t


def test_collisions_toxicity():
    x, y = (w.encode() for w in PAIRS[0])
    model = toxicity.Model(toxicity.KneserNey([x, b"ab", b"ba"], np.array([[1.0, 2.0, 1.0], [3.0, 1.0, 1.0]])), np.array([1.0, 1.0, 0.1, 0.0]), 0.5)
    apart = [model.score(*laid([t]))[0] for t in (x.decode(), y.decode())]
    assert apart[0] != apart[1] and model.score(*laid([x.decode(), y.decode()])).tolist() == apart


def test_proximity_stays_inside_a_document(spark):
    docs = [(1, "alpha foo"), (2, "bar beta"), (3, "foo x bar"), (4, "bar"), (5, "foo"), (6, ""), (7, "bar foo"), (8, "foo bar"), (9, "x foo y y bar")]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS).coalesce(1)
    b = spark.createDataFrame([(1, "foo bar")], "item_id bigint, text string")
    for slop in (0, 1, 2):
        got = {r["doc_id"]: r["n_hit"] for r in decontaminate.search(decontaminate.build_index(d), b, slop=slop).collect()}
        want = {i for i, t in docs for w in [t.split()] for p, u in enumerate(w) for q, v in enumerate(w) if (u, v) == ("foo", "bar") and abs(q - p - 1) <= slop}
        assert {i for i, n in got.items() if n} == want


CLASH = "doc_id bigint, text string, score double, row bigint, key bigint, doc string, n_chars bigint, _toxicity double, fp bigint, component_id bigint, gone bigint"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, 1, 2, "d", 3, 0.1, 4, 5, 6) for i, t in rows], CLASH)


@pytest.mark.parametrize("module", [simhash, similar])
def test_deduplicate_by_row(spark, module):
    rng = random.Random(2)
    a, b = words(rng, 80, 4000), words(rng, 80, 4000)
    rows = [(3, a), (5, a), (5, b), (5, b), (6, b), (None, a), (7, None), (8, "")]
    kept = module.deduplicate(clashing(spark, rows).repartition(3)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([(3, a), (5, b), (7, None), (None, a)], key=str)
    assert list(kept[0].asDict()) == [c.split()[0] for c in CLASH.split(", ")]
    assert module.deduplicate(clashing(spark, rows).where("false")).count() == 0


def test_decontaminate_by_row(spark):
    rng = random.Random(3)
    item, clean = words(rng, 20, 4000), words(rng, 60, 4000)
    long = f"{words(rng, 4000, 4000)} {' '.join(item.split()[2:15])} {words(rng, 4000, 4000)}"
    rows = [(1, clean), (1, f"{clean} {item}"), (2, long), (3, None), (4, ""), (None, item), (5, clean + " short one"), (6, words(rng, 30000, 4000))]
    bench = spark.createDataFrame([(1, item), (2, "short one"), (3, None)], "item_id bigint, text string")
    kept = decontaminate.decontaminate(clashing(spark, rows), bench)
    assert kept.columns == [c.split()[0] for c in CLASH.split(", ")]
    # a full window takes a text of any length; a short item only a text that it covers by a twentieth
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 3, 4, 5, 6]
    assert decontaminate.decontaminate(clashing(spark, []), bench).count() == 0
    assert decontaminate.decontaminate(clashing(spark, rows), bench.where("false")).count() == len(rows)


def test_toxicity_keeps_clashing_names(spark):
    rng = random.Random(4)
    docs = [(k, words(rng, 30) + (" moron idiot" if k % 2 else "")) for k in range(60)]
    d = clashing(spark, docs + [(100, None), (101, "")])
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id bigint, toxic int")
    kept = toxicity.remove_toxic(d, labels)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {k for k in range(0, 60, 2)} | {100, 101}
    model = toxicity.train(d, labels)
    assert toxicity.score(d, model).columns.count("score") == 1


def test_secret_candidates_against_brute_force(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("aB3_+/=- .\n\"é") if rng.random() < 0.2 else rng.choice("abcdefgh12") for _ in range(rng.randrange(400))) for _ in range(150)]
    texts += ["a1" * 9 + " " + "b2" * 9, "x" * 16, "1" + "x" * 15, " ".join(f"{k:020d}" for k in range(1500))]
    want = set()
    for i, t in enumerate(texts):
        for m in re.finditer(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}", t):
            if re.search(r"[0-9]", m[0]):
                want.add((i, m.start(), m[0], t[max(0, m.start() - 48) : m.start()], t[m.end() : m.end() + 48]))
    df = spark.createDataFrame([(i, t, "s", 1, "f") for i, t in enumerate(texts)], "doc_id bigint, text string, source string, start int, found string")
    got = {(r["doc_id"], r["start"], r["found"], r["before"], r["after"]) for r in secrets.candidates(df).collect()}
    cut = lambda rows: {(i, s, f) for i, s, f, _, _ in rows}
    assert cut(got) == cut(want)
    # neighbours reach to the next candidate at most
    full = {(i, s): (b, a) for i, s, _, b, a in want}
    assert all(full[i, s][0].endswith(b) and full[i, s][1].startswith(a) for i, s, _, b, a in got)


def test_base_spans_against_re():
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def fits(kind, s):
        digits = [int(c) for c in s if c in "0123456789"]
        if kind == "ip":
            return all(int(x) <= 255 for x in s.split("."))
        if kind == "phone":
            return 9 <= len(digits) <= 15
        if kind == "card":
            return 13 <= len(digits) <= 19 and sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))) % 10 == 0
        return True

    rng = random.Random(6)
    for alphabet in ("ab@.-+ ", "0123.", "01 -", "+1( )-.2", "a@b.c1+0 -()é٣"):
        for _ in range(1500):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
            want = [(k, *m.span()) for k, p in patterns.items() for m in re.finditer(p, t) if fits(k, m[0])]
            assert pii.base_spans(t) == want, t


def test_vectors_of_one_digest(spark, monkeypatch):
    from test_ops import test_cover_tree

    monkeypatch.setattr(cover_tree, "_digest", lambda: {"h1": F.lit(1).cast("bigint"), "h2": F.lit(2).cast("bigint")})
    test_cover_tree(spark, 5)


def test_hot_vectors(spark):
    v = [(i, [1.0, 0.0]) for i in range(3000)] + [(9000 + i, None) for i in range(3000)] + [(5000, [0.999, 0.01]), (5001, [0.0, 1.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in cover_tree.near_duplicates(spark.createDataFrame(v, "vec_id bigint, embedding array<double>")).collect()}
    assert got[7] == (3000, 0) and got[5000] == (3000, 0) and got[5001] == (0, 5001) and got[9001] == (0, 9001) and len(got) == len(v)


def test_vectors_move_a_fixed_number_of_times(spark, monkeypatch):
    """Four times the vectors without clusters shuffle about four times the bytes, and rounds lose no link."""
    monkeypatch.setattr(cover_tree, "BLOCK", 64)
    monkeypatch.setattr(cover_tree, "FOLD", 1, raising=False)
    store, wait = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty
    moved = []
    for n in (400, 1600):
        rng = np.random.default_rng(n)
        x = rng.normal(size=(n, 64))
        x[n // 2 :: 5] = x[: len(x[n // 2 :: 5])] + rng.normal(size=x[n // 2 :: 5].shape) * 0.1
        wait()
        before = store.executorSummary("driver").totalShuffleWrite()
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in cover_tree.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")).collect()}
        wait()
        moved.append(store.executorSummary("driver").totalShuffleWrite() - before)
        u = x.astype(np.float32).astype(float)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        link = u @ u.T >= 0.95
        least = np.arange(n)
        for _ in range(20):
            least = np.where(link, least[None, :], n).min(1)
        assert got == {i: (int(link[i].sum()) - 1, int(least[i])) for i in range(n)} and link.sum() > n
    assert moved[1] < 6 * moved[0]


def test_a_worker_keeps_few_chunks():
    """A cache is bounded, forgets what is no longer used first, and gives way to the next stage's cache."""
    from docloom.llm.chunks import ChunkCache

    asked = []
    one, two = (ChunkCache(lambda c: asked.extend(c) or [x * 2 for x in c], 100) for _ in range(2))
    for i in range(1000):
        assert one.many([b"often", b"%d" % i]) == [b"oftenoften", b"%d%d" % (i, i)]
        assert len(one.kept) + len(one.older) <= 100
    assert asked.count(b"often") == 1
    assert two.many([b"x"]) == [b"xx"] and not one.kept and not one.older and one.many([b"often"]) == [b"oftenoften"]


def test_toxicity_model_keeps_few_words():
    kn = toxicity.KneserNey([b"good", b"bad"], np.array([[1.0, 0.0], [0.0, 1.0]]))
    model, fresh = (toxicity.Model(kn, np.array([1.0, 1.0, 0.0, 0.0]), 0.5) for _ in range(2))
    got = []
    for k in range(9):
        text = " ".join(f"w{k}x{i}" for i in range(100_000)).encode()
        got.append(model.score(np.frombuffer(text + b" bad", np.uint8), np.array([0, len(text) + 4]))[0])
        assert len(model.cache.kept) + len(model.cache.older) <= toxicity.KEPT
    assert got[-1] == fresh.score(np.frombuffer(text + b" bad", np.uint8), np.array([0, len(text) + 4]))[0]


def test_bloom_passes_all_and_little_else(spark):
    keys = spark.range(5000).select(F.concat(F.lit("=k"), F.col("id").cast("string")).alias("key"))
    table, blocks = url_filter.bloom(keys)
    assert url_filter.possible(keys, table, blocks).count() == 5000 and table.count() <= blocks
    assert url_filter.possible(spark.range(20000).select(F.concat(F.lit("other"), F.col("id").cast("string")).alias("key")), table, blocks).count() < 200


def test_pipeline_stages_on_odd_tables(spark):
    """Nulls in every column, empty texts, repeated rows and empty tables pass every stage."""
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, "s", 0), (1, "", None, "s", 0), (2, "call +1 (603) 555-8791 now", "en", None, 26), (2, "other words entirely", "en", "s", None)], SCHEMA)
    for docs, n in ((odd, 4), (odd.where("false"), 0)):
        for name, stage in p.STAGES[:-1]:
            docs = common.stored(stage(spark, docs, sf))
            assert docs.columns == odd.columns, name
        assert docs.count() == n
        packed = p.STAGES[-1][1](spark, docs, sf)
        assert packed.count() == n


def test_pipeline_against_brute_force(spark):
    """The rows that each stage keeps, on a small table with planted copies and passages."""
    import corpus_pipeline as p

    rng = random.Random(7)
    sf = "/root/testdata/sf0.001"
    items = [r["text"] for r in common.read(spark, sf, "benchmark").limit(2).collect()]  # two known items of the small fixture
    docs = [(10_000 + k, words(rng, 60, 5000)) for k in range(40)]
    docs += [(20_000, docs[3][1].upper()), (20_001, docs[4][1] + " more"), (20_002, f"{words(rng, 3000, 5000)} {items[0]}"), (20_003, items[1])]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], SCHEMA)
    kept = {r["doc_id"] for r in p.deduplicate(spark, df, sf).collect()}
    grams = lambda t: {tuple(w[k : k + 5]) for w in [t.lower().split()] for k in range(max(1, len(w) - 4))}
    pairs = [(a, b) for a, t in docs for b, u in docs if a < b for x, y in [(grams(t), grams(u))] if len(x & y) >= 0.8 * len(x | y)]
    assert kept == set(union(pairs, [i for i, _ in docs]).values())
    left = {r["doc_id"] for r in p.remove_benchmark(spark, df, sf).collect()}
    bench = [(r["item_id"], r["text"]) for r in common.read(spark, sf, "benchmark").collect()]
    assert left == {d for d, _, hit, _ in brute_hits(docs, bench) if not hit} and 20_002 not in left
    masked = {r["doc_id"]: r["text"] for r in p.mask_personal_data(spark, df, sf).collect()}
    assert all(masked[i] == t for i, t in docs if i < 20_000)

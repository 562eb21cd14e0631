"""The ten operators against brute force, round trips and the edge cases of their docstrings."""

import hashlib
import random
import re
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import chat, common, cover_tree, decontaminate, packing, pii, secrets, simhash, token_counts, toxicity, url_filter

DOCS = "doc_id bigint, text string, lang string, item_id int"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n, pool=200):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def union(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    want = union(edges, linked | {x for e in edges for x in e})
    assert {k: v for k, v in got.items()} == {k: want[k] for k in linked}
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_fingerprint(text):
    from xxhash import xxh64_intdigest

    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    rng = random.Random(2)
    docs = []
    for k in range(25):
        base = words(rng, 120).split()
        for v in range(4):
            t = list(base)
            for _ in range(v % 3):
                t[rng.randrange(len(t))] = "changed"
            docs.append((len(docs), " ".join(t)))
    docs += [(900, None), (901, ""), (902, "One"), (903, "ONE"), (904, "É One Two"), (None, "One"), (3, docs[3][1])]
    rows = [(i, t, "en", 1) for i, t in docs]
    got = [(r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()]
    assert len(got) == len(docs)
    want = {(i, brute_fingerprint(t)) for i, t in docs}
    assert {(i, f) for i, f, _ in got} == want
    ids = [(i, f) for i, f in want if i is not None]
    pairs = [(a, b) for a, f in ids for b, g in ids if a < b and bin(f ^ g).count("1") <= 3]
    comp = union(pairs, {i for i, _ in ids})
    assert {i: c for i, _, c in got if i is not None} == comp
    kept = simhash.deduplicate(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], SCHEMA))
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(set(comp.values()))
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_simhash_split_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 8)
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(5)]
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(3))) for b in base for _ in range(40)})
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    edges = [(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(s,) for s in signed], "fp bigint")).collect()]
    want = union([(a, b) for a, f in zip(signed, fps) for b, g in zip(signed, fps) if a < b and bin(f ^ g).count("1") <= 3], signed)
    assert union(edges, signed) == want


def brute_hits(docs, bench):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    wins = defaultdict(set)
    for i, t in bench:
        if i is None or t is None:
            continue
        w = split(t)
        n = min(13, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[s : s + n])].add(str(i))
    out = []
    for d, t in docs:
        w, hit, items = split(t), set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in wins:
                    hit |= set(range(s, s + n))
                    items |= wins[tuple(w[s : s + n])]
        out.append((d, len(w), len(hit), tuple(sorted(items))))
    return sorted(out, key=str)


def test_decontaminate(spark):
    rng = random.Random(4)
    bench = [(k, words(rng, 30)) for k in range(12)] + [(50, "Zwölf Boxkämpfer jagen"), (51, ""), (52, None), (None, "w1 w2"), (3, words(rng, 20))]
    docs = []
    for k in range(60):
        t = words(rng, rng.randrange(1, 80)).split()
        if k % 3 == 0:
            src = bench[rng.randrange(12)][1].split()
            at, n = rng.randrange(10), rng.randrange(10, 20)
            t[5:5] = src[at : at + n]
        docs.append((k, (", " if k % 2 else " ").join(t).upper() if k % 5 == 0 else " ".join(t)))
    docs += [(100, None), (101, ""), (102, "zwölf BOXKÄMPFER jagen w1"), (102, "zwölf"), (None, bench[0][1])]
    d = spark.createDataFrame([(i, t, "x", 7) for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, "y") for i, t in bench], "item_id bigint, text string, doc_id string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in decontaminate.search(decontaminate.build_index(d), b).collect()), key=str)
    assert got == brute_hits(docs, bench)
    kept = {r["doc_id"] for r in decontaminate.decontaminate(d, b).collect()}
    assert 100 in kept and 0 not in kept
    empty = spark.createDataFrame([], DOCS)
    assert decontaminate.search(decontaminate.build_index(empty), b).count() == 0
    near = decontaminate.search(decontaminate.build_index(spark.createDataFrame([(1, "zwölf starke boxkämpfer jagen", "x", 1)], DOCS)), b, slop=1).first()
    assert near["items"] == ["50"]


def test_urls(spark):
    urls = ["https://a.example.net/en/x?q", "http://EXAMPLE.NET/en/", "http://b.net/", "http://b.net", "https://x.org/fr/1#t", "https://x.org/de/", "nohost", None, "", "http://fakenet/", "http://example.com/de/a", "http://u@h.net:80/p"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)] + [(2, "http://b.net/", "h", "r")], "page_id bigint, url string, host string, rule string")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, url_filter.rules_frame(spark)).collect())
    assert len(got) == 13 and got.count((2, "b.net", "/", "net/", "block")) == 2
    by = {g[0]: g for g in got}
    assert by[0][3:] == ("example.net/en/", "allow") and by[1][1:4] == ("example.net", "/en/", "example.net/en/") and by[3][2:] == ("", None, "allow")
    assert by[4][4] == "allow" and by[4][3] == "org/fr/" and by[5][3] is None and by[7][1:] == ("", "", None, "allow") and by[9][3] is None and by[10][4] == "block" and by[11][3] is None
    listed = spark.createDataFrame([("http://B.NET/x",), ("https://x.org/de/",)], "url string")
    more = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages, url_filter.rules_frame(spark), listed).collect()}
    assert more[5] == "block" and more[8] == "allow"
    assert {r["verdict"] for r in url_filter.filter_urls(pages, url_filter.rules_frame(spark, [("zz/", "block")]).where("false")).collect()} == {"allow"}


@pytest.mark.parametrize("dim", [3, 24])
def test_cover_tree(spark, dim):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, dim))
    x = np.concatenate([base, np.repeat(base[:6], 15, axis=0) + rng.normal(size=(90, dim)) * 0.05, base[:4] * 3, base[:3]])
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * dim, 1), (n + 2, [float("nan")] * dim, 1), (n + 3, [None] + [1.0] * (dim - 1), 1), (n + 4, [float("inf")] * dim, 1), (n + 5, [], 1), (n + 6, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, n_links int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in cover_tree.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.95 - 1e-12
    comp = union([(i, j) for i in range(n) for j in range(i + 1, n) if link[i, j]], range(n))
    assert {i: got[i] for i in range(n)} == {i: (int(link[i].sum()) - 1, comp[i], comp[i] == i) for i in range(n)}
    assert all(got[k] == (0, k, True) for k in range(n, n + 7))
    assert cover_tree.near_duplicates(df.where("false")).count() == 0


def test_cover_tree_blocks(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK", 16)
    test_cover_tree(spark, 8)


def test_secrets(spark):
    model = secrets.train(secrets.labelled_findings(spark, 120))
    held = secrets.judge(secrets.labelled_findings(spark, 40, seed=9), model)
    assert held.where((F.col("label") == 1) == F.col("secret")).count() / held.count() > 0.95
    k = "9a8b99b6f89edc9746a2ef7e89e21f68bcb4543d"
    t = f'{k} at é start; token = "{k}" and token = "{k}" plus commit {k} end'
    docs = spark.createDataFrame([(1, t, "s", 1), (2, None, "s", 1), (3, "", None, 1), (4, "x" * 50000 + "1", "s", 1)], "doc_id bigint, text string, source string, found int")
    got = secrets.scan(docs, model).where("doc_id = 1").orderBy("start").collect()
    assert [r["start"] for r in got] == [m.start() for m in re.finditer(k, t)] and all(r["found"] == k for r in got)
    assert got[1]["secret"] and got[2]["secret"] and not got[3]["secret"]
    assert secrets.candidates(docs).where("doc_id = 4").first()["found"] == "x" * 50000 + "1"
    assert secrets.candidates(docs.where("false")).count() == 0


def test_chat(spark):
    rng = random.Random(6)
    bits = ["</s>", "[INST] ", " [/INST]", "\\", "<<SYS>>", ">>", "a", "é", "\n", " ", "<<ROLE x>> "]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "to>ol", "assistant"]), "".join(rng.choice(bits) for _ in range(rng.randrange(8)))) for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(99, 0, None, None), (99, 1, "assistant", None), (None, 0, "user", "x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, example int")
    written = chat.materialize(chat.expand(df))
    got = {r["conv_id"]: r for r in chat.digests(written).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in by.items():
        turns.sort()
        reply = "".join(t for _, r, t in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(reply), sha(reply))
    mark = lambda r, t: {"user": f"[INST] {t} [/INST]", "assistant": f" {t}</s>", "system": f"<<SYS>> {t} <</SYS>>"}.get(r)
    esc = lambda t: re.sub(r"([\\<\[\]>])", r"\\\1", t)
    texts = defaultdict(list)
    for r in written.orderBy("conv_id", "example").collect():
        texts[r["conv_id"]].append(r)
    for c, turns in by.items():
        want, said = [], ""
        for _, role, t in sorted(turns):
            said += mark(role, esc(t)) or f"<<ROLE {esc(role)}>> {esc(t)} <</ROLE>>"
            if role == "assistant":
                want.append((said, esc(t)))
        # every example is all preceding turns and its reply; turns without a reply end in a row of their own
        assert [(r["text"], r["text"][r["loss_start"] : r["loss_start"] + r["loss_chars"]]) for r in texts[c] if r["loss_chars"] is not None] == want
        rest = [r["text"] for r in texts[c] if r["loss_chars"] is None]
        assert rest == ([said] if not want or want[-1][0] != said else [])
        assert got[c]["formatted_chars"] == sum(len(x) for x, _ in want) + sum(map(len, rest))
    broken = written.withColumn("text", F.when((F.col("conv_id") == 1) & (F.col("example") == 0), "[INST] other [/INST]").otherwise(F.col("text")))
    assert len(texts[1]) > 1 and chat.digests(broken).where("conv_id = 1").first()["turns_sha256"] is None
    assert chat.digests(chat.materialize(chat.expand(df.where("false")))).count() == 0


def test_toxicity(spark):
    rng = random.Random(7)
    bad = ["worthless", "pathetic", "moron"]
    docs, labels = [], []
    for k in range(240):
        t = [rng.choice("abcdefg") + rng.choice(["an", "er", "ing", "tion"]) * rng.randrange(1, 4) for _ in range(60)]
        toxic = k % 3 == 0
        if toxic:
            for _ in range(3):
                t.insert(rng.randrange(len(t)), rng.choice(bad))
        docs.append((k, " ".join(t)))
        labels.append((k, int(toxic)))
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs] + [(900, None, "x", 1), (901, "", "x", 1), (902, "a" * 100000, "x", 1)], DOCS)
    lab = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    model = toxicity.train(d, lab.where("doc_id % 4 <> 0 or doc_id is null"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(d, model).collect()}
    held = [k for k in range(0, 240, 4)]
    assert sum((got[k] >= 0.5) == (k % 3 == 0) for k in held) / len(held) > 0.95
    assert all(0 <= v <= 1 for v in got.values()) and len(got) == 243
    none = toxicity.train(d, lab.where("toxic = 0"))
    assert {r["score"] for r in toxicity.score(d, none).collect()} == {0.0}
    assert toxicity.score(d.where("false"), model).count() == 0


def test_kneser_ney_prefers_the_class():
    model = toxicity.KneserNey([b"abc", b"abd", b"b"], np.array([[3.0, 1.0, 2.0], [1.0, 2.0, 0.0]]))
    abc, abd, unknown = model.difference([b"abc", b"abd", b"zzz"])
    assert abd > abc and abs(unknown) < abs(abd)


def test_pii(spark):
    t = "é mail a.b+c@x-y.example.com, ip 10.0.0.256 or 10.0.0.25, card 4111 1111 1111 1111, call +1 (603) 555-8791. phone: 555-0142 ok; ssn 078-05-1120."
    rows = [(1, t, "x", 1), (2, None, "x", 1), (3, "", "x", 1), (4, "1" * 200000 + "@", "x", 1)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in pii.detect(df).collect()}
    assert [got[1][f"n_{k}"] for k in pii.BASE] == [1, 1, 1, 1]
    spans = [s.split(":") for s in got[1]["spans"].split(",")]
    texts = {k: t[int(a) : int(b)] for k, a, b in spans}
    assert texts == {"email": "a.b+c@x-y.example.com", "ip": "10.0.0.25", "card": "4111 1111 1111 1111", "phone": "+1 (603) 555-8791", "local_phone": "555-0142", "id_number": "078-05-1120"}
    assert got[2]["spans"] == "" and got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    masked = {r["doc_id"]: r["text"] for r in pii.mask(df).collect()}
    assert "[EMAIL]" in masked[1] and "4111" not in masked[1] and masked[2] is None and masked[3] == ""
    assert pii.detect(df.where("false")).count() == 0


def test_pii_viterbi_against_brute_force():
    from itertools import product

    field = pii.train(steps=60)
    words_ = "a 555-0142 078-05-1120 12 b".split()
    run = [pii._features(words_, k) for k in range(1, 4)]
    e, _ = field.scores([run])
    best = max(product(range(len(pii.LABELS)), repeat=3), key=lambda y: sum(e[0, t, y[t]] for t in range(3)) + sum(field.move[a, b] for a, b in zip((0, *y), (*y, 0))))
    assert field.decode([run])[0] == list(best)


def test_packing(spark):
    rng = random.Random(8)
    docs = [(k, " ".join(rng.choice(["Hello", "don't", "été", "x1", "…!", "Ünï"]) for _ in range(rng.choice([0, 3, 40, 300, 6000])))) for k in range(60)]
    docs += [(100, None), (101, ""), (102, "<|endoftext|> a"), (None, "x"), (5, docs[5][1])]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    ids = [(i, tok.encode(t or "", add_special_tokens=False).ids + [packing.END]) for i, t in docs]
    rows = packing.pack(df).collect()
    want = sorted((i is None, i, s, len(v), min(4096, len(v) - s), crc32(np.array(v[s : s + 4096], "<u4").tobytes())) for i, v in ids for s in range(0, len(v), 4096))
    assert sorted((r["doc_id"] is None, r["doc_id"], r["start"], r["doc_tokens"], r["length"], r["ids_crc32"]) for r in rows) == want
    seqs = defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in seqs.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 4096
    total = sum(len(v) for _, v in ids)
    assert len(seqs) <= -(-total // 4096) + 2
    assert packing.pack(df.where("false")).count() == 0


def test_token_counts(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=token_counts.default_model())
    rng = random.Random(9)
    texts = ["".join(rng.choice("abethn  .,\né日x1-'▁</s>") for _ in range(rng.randrange(50))) for _ in range(200)] + ["", None, "word " * 5000]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r for r in token_counts.prefix_counts(df).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        assert got[i]["n_tokens"] == len(sp.encode(t)) and got[i]["n_bytes"] == len(t.encode())
        for k in range(0, min(len(t), 50) + 1, 7):
            assert token_counts.count_at(got[i]["changes"], len(t[:k].encode())) == len(sp.encode(t[:k]))
    last = got[len(texts) - 1]
    assert len(sp.encode(texts[-1][: last["limit_bytes"]])) <= 4096 < len(sp.encode(texts[-1][: last["limit_bytes"] + 1]))
    assert token_counts.prefix_counts(df.where("false")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = common.read(spark, sf, "documents")
    n = docs.count()
    for name, stage in p.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert n / 2 < docs.count() < n
    packed = p.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.count()

"""Clause extraction, alignment and comparison of document pairs."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import entities as E
from docloom.functions import text as T
from docloom.operators.retrieval import cosine

TAU = 0.65
CLAUSES = "pair_id string, side string, idx int, section string, raw string, norm string, is_table boolean"

# Line formats of the clause extractor.
CONTEXT = re.compile(r"^\[Context:\s*(.*?)\]$", re.I)
HEADING = re.compile(r"^(#{1,6})\s+(.*)$")
PLAIN = re.compile(
    r"^(?:(?:Section|Chapter|Article|Clause|Part|Policy)\s+\d+(?:\.\d+)*\s*[:.\-–]?\s*.+|\d+(?:\.\d+)+\s+[A-Z].+|\d+\.\s+[A-Z][A-Za-z0-9\s&/\-_,'\"]{2,80})$", re.I
)
MODAL = (" must ", " shall ", " cannot ", " is required ", " are required ")


def plain_heading(line: str) -> bool:
    """FLT-10."""
    return bool(line) and len(line) <= 100 and not (line.endswith(".") and len(line.split()) > 6) and bool(PLAIN.match(line))


def title_candidate(line: str, seen: bool) -> bool:
    """FLT-10: a short line without closing mark or modal verb, before any section heading."""
    return not seen and bool(line) and len(line) <= 80 and line[-1] not in ".:;" and len(line.split()) <= 8 and not any(m in line.lower() for m in MODAL)


def clauses_of(text: str) -> list[tuple[str, str, bool]]:
    """CMP-01: (section path, text, is table) of each block; the first matching line rule wins."""
    out: list[tuple[str, str, bool]] = []
    stack: list[str] = []
    block: list[str] = []
    table = seen = False

    def flush() -> None:
        nonlocal block
        body = "\n".join(block).strip()
        if body:
            out.append((" > ".join(stack) or "General", body, table))
        block = []

    for line in (text or "").split("\n"):
        s = line.strip()
        if s[:1] == "[" and (m := CONTEXT.match(s)):
            flush()
            stack, seen = [p.strip() for p in m[1].split(">") if p.strip()], True
        elif s[:1] == "#" and (m := HEADING.match(s)):
            flush()
            level = len(m[1])
            stack = stack[: level - 1] if level <= len(stack) else stack
            stack, seen = [*stack, m[2].strip()], True
        elif plain_heading(s):
            flush()
            stack, seen = [s], True
        elif not block and title_candidate(s, seen):
            stack = [s]
        elif s.startswith("|"):
            if block and not table:
                flush()
            table = True
            block.append(s)
        elif not s:
            flush()
            table = False
        else:
            if block and table:
                flush()
            table = False
            block.append(s)
    flush()
    return out


def extract(docs: DataFrame, paired: bool = False) -> DataFrame:
    """Clauses of docs(pair_id, side, text); one fold a document, in Arrow batches.

    paired: the documents of a pair stand together in one partition, side a first, and so do its clauses; a pair
    with a missing or blank side gives none.
    """

    def clauses(rows) -> list:
        return [(p, s, i, *c) for p, s, t in rows for i, c in enumerate(clauses_of(t), 1)]

    def usable(pair: list) -> bool:
        return pair[0][0] is None or all(any(s == side and (t or "").strip(" ") for _, s, t in pair) for side in "ab")

    kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_())

    def frame(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)], names=["pair_id", "side", "idx", "section", "raw", "is_table"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair: list = []
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in range(3))))
            if paired:
                given, rows = rows, []
                for r in given:
                    if pair and pair[0][0] != r[0]:
                        rows += pair if usable(pair) else []
                        pair = []
                    pair.append(r)
            yield frame(clauses(rows))
        if pair and usable(pair):
            yield frame(clauses(pair))

    found = docs.select(F.col("pair_id").cast("string").alias("pair_id"), "side", "text").mapInArrow(run, "pair_id string, side string, idx int, section string, raw string, is_table boolean")
    return found.withColumn("norm", T.normalize_clause(F.col("raw")))


def scored_pairs(clauses: DataFrame, vec: str | None = None) -> DataFrame:
    """JON-06, CMP-02..04: clause pairs of each document pair with scores, acceptance and method.

    The join is on pair_id: its size is the product of two documents' clauses, not of the corpus.
    """
    terms = F.array(*[F.lit(t) for t in T.POLICY_TERMS])
    # sets are made once a clause, before the join
    made = clauses.select(
        "pair_id", "side", "idx", F.trim("raw").alias("raw"), F.trim("norm").alias("norm"), "is_table", T.words(T.normalize_heading(F.col("section"))).alias("heads"),
        T.words(F.col("norm")).alias("words"), T.trigrams(F.col("norm")).alias("grams"), F.array_intersect(T.words(F.col("raw")), terms).alias("terms"), *([F.col(vec).alias("vec")] if vec else []),
    )
    keep = [c for c in made.columns if c not in ("pair_id", "side", "idx")]
    a = made.where("side = 'a'").select("pair_id", F.col("idx").alias("ia"), *[F.col(c).alias(f"{c}_a") for c in keep])
    b = made.where("side = 'b'").select("pair_id", F.col("idx").alias("ib"), *[F.col(c).alias(f"{c}_b") for c in keep])
    p = a.join(b, "pair_id")
    jac = lambda c: T.jaccard(F.col(f"{c}_a"), F.col(f"{c}_b"))
    blank = (F.col("norm_a") == "") | (F.col("norm_b") == "")
    lex = F.when(blank, 0.0).when(F.col("norm_a") == F.col("norm_b"), 1.0).otherwise(F.round(0.7 * jac("words") + 0.3 * jac("grams"), 4))
    # without vectors the lexical score stands in, as it does where an embedder fails
    sem = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), cosine(F.col("vec_a"), F.col("vec_b")))), 4) if vec else None
    same = F.col("raw_a") == F.col("raw_b")
    first = F.struct(F.round(jac("heads"), 4).alias("head"), lex.alias("lex"), jac("terms").alias("kw"), *([sem.alias("sem")] if vec else []))

    def score(m: Column) -> Column:
        s = F.when(same, 1.0).otherwise(m["sem"] if vec else m["lex"])
        return F.struct(m["head"].alias("head"), m["lex"].alias("lex"), s.alias("sem"), pair_score(m["head"], m["lex"], s, m["kw"]).alias("score"))

    p = p.withColumn("m", T.let(T.let(first, score), lambda m: F.struct(m["head"].alias("head"), m["lex"].alias("lex"), m["sem"].alias("sem"), m["score"].alias("score"), accepted(m).alias("ok"))))
    return p.where("m.ok").select("pair_id", "ia", "ib", "m.head", "m.lex", "m.sem", "m.score", method(F.col("m")).alias("method"))


def pair_score(h: Column, x: Column, s: Column, k: Column) -> Column:
    """CMP-02: six ordered cases over heading, lexical, semantic and keyword similarity."""
    v = (
        F.when(F.col("is_table_a") & F.col("is_table_b"), 0.3 * h + 0.7 * x)
        .when(F.col("is_table_a") != F.col("is_table_b"), 0.4 * x + 0.1 * s)
        .when(x >= 0.95, x)
        .when(s >= 0.85, 0.65 * s + 0.25 * x + 0.1 * h)
        .when((h >= 0.8) & ((s >= 0.45) | (x >= 0.35)), 0.35 * h + 0.4 * s + 0.25 * x)
        .otherwise(0.2 * h + 0.8 * (0.5 * s + 0.3 * x + 0.2 * k))
    )
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)), 4)


def accepted(m: Column, tau: float = TAU) -> Column:
    """CMP-04."""
    h, x, s, c = (m[n] for n in ("head", "lex", "sem", "score"))
    return (c >= tau) | ((h >= 0.8) & ((s >= 0.45) | (x >= 0.35))) | ((s >= 0.6) & ((c >= 0.4) | (h >= 0.3) | (x >= 0.1)))


def method(m: Column) -> Column:
    return F.when(m["lex"] >= 0.95, "exact").when(m["head"] >= 0.8, "structural").otherwise("semantic")


def greedy(pairs: DataFrame) -> DataFrame:
    """JON-07: one-to-one matching, best score first (ties: lower ia, then ib), as a fold over each document pair's accepted pairs."""
    rows = pairs.select("pair_id", "ia", "ib", "head", "lex", "sem", "score", "method")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used_a, used_b = None, set(), set()
        for b in batches:
            keep = []
            for p, i, j in zip(*(b.column(c).to_pylist() for c in range(3))):
                if p != now:
                    now, used_a, used_b = p, set(), set()
                keep.append(i not in used_a and j not in used_b)
                if keep[-1]:
                    used_a.add(i)
                    used_b.add(j)
            yield b.filter(pa.array(keep, pa.bool_()))

    return rows.repartition("pair_id").sortWithinPartitions("pair_id", F.desc("score"), "ia", "ib").mapInArrow(run, rows.schema)


#: Of an aligned batch: clauses, pairs of clauses scored at once, numbers of a matrix.
ROWS, PAIRS, CELLS = 4096, 1 << 18, 1 << 24
ALIGNED = "pair_id string, ib int, ia int, raw_a string, section_a string, head double, lex double, sem double, score double, method string, raw_b string, section_b string"


def rounded(v: np.ndarray, places: int = 4) -> np.ndarray:
    """Half up of the shortest decimal, as SQL rounds doubles; for values of 0 to 1."""
    scaled = v * 10.0**places
    out = np.floor(scaled + 0.5) / 10.0**places
    near = np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6
    if near.any():
        ties, at = np.unique(v[near], return_inverse=True)
        out[near] = np.array([float(Decimal(repr(x)).quantize(Decimal(10) ** -places, ROUND_HALF_UP)) for x in ties.tolist()])[at]
    return out


class Sets:
    """Sets of numbers below n as rows of bits, from (row, number) in any order, repeats included."""

    def __init__(self, count: int, row: np.ndarray, number: np.ndarray, n: int) -> None:
        self.bits = np.zeros((count, max(1, -(-n // 64))), np.uint64)
        order = np.argsort(row, kind="stable") if len(row) and (row[1:] < row[:-1]).any() else slice(None)
        row, number = row[order], number[order]
        step = max(1, CELLS // (self.bits.shape[1] * 64))
        for a in range(0, count, step):
            i, j = np.searchsorted(row, (a, a + step))
            own = np.zeros((min(step, count - a), self.bits.shape[1] * 64), np.uint8)
            own[row[i:j] - a, number[i:j]] = 1
            self.bits[a : a + step] = np.packbits(own, axis=1).view(np.uint64)
        self.size = np.bitwise_count(self.bits).sum(1, dtype=np.int64)

    def jaccard(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """TXT-04 of rows a with rows b."""
        both = np.empty(len(a), np.int64)
        step = max(1, CELLS // 32 // self.bits.shape[1])
        for i in range(0, len(a), step):
            both[i : i + step] = np.bitwise_count(self.bits[a[i : i + step]] & self.bits[b[i : i + step]]).sum(1, dtype=np.int64)
        union = self.size[a] + self.size[b] - both
        return np.where((self.size[a] == 0) | (self.size[b] == 0), 0.0, both / np.maximum(union, 1))


#: The bytes of TXT-02's words; none is part of a longer character.
WORD_BYTES = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789_-.", np.uint8))


def _word_sets(text: pa.Array) -> tuple[Sets, np.ndarray, pa.Array]:
    """TXT-02 of lower-case text: the sets, and (row, word) of every word."""
    ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    own = WORD_BYTES[data]
    first = own.copy()
    first[1:] &= ~own[:-1]
    at = ends[:-1][ends[:-1] < len(data)]
    first[at] = own[at]
    starts = np.flatnonzero(first)
    offsets = np.append(np.cumsum(own)[starts] - 1, np.count_nonzero(own)).astype(np.int32)
    coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[own])).dictionary_encode()
    row = np.searchsorted(ends, starts, "right") - 1
    return Sets(len(text), row, coded.indices.to_numpy(), len(coded.dictionary)), row, coded


def _gram_sets(text: pa.Array) -> Sets:
    """TXT-03 of trimmed lower-case text."""
    if (whole := " ".join(text.to_pylist())) and ("  " in whole or re.search(r"[\t\n\x0b\f\r]", whole)):
        text = pc.replace_substring_regex(text, r"[ \t\n\x0b\f\r]+", " ")
    n = np.asarray(pc.utf8_length(text)).astype(np.int64)
    # three slots at least: a shorter text is one gram with empty slots, whose number is 0
    width = np.maximum(n, 3)
    start = np.cumsum(width) - width
    code = np.frombuffer("".join(text.to_pylist()).encode("utf-32-le"), np.uint32)
    seen = np.zeros(int(code.max(initial=0)) + 1, bool)
    seen[code] = True
    number = np.cumsum(seen)  # from 1
    base = int(number[-1]) + 1
    flat = np.zeros(int(width.sum()), np.int64)
    flat[np.arange(len(code)) + np.repeat(start - (np.cumsum(n) - n), n)] = number[code]
    gram = (flat[:-2] * base + flat[1:-1]) * base + flat[2:]
    row = np.repeat(np.arange(len(n)), width - 2)
    gram = gram[np.arange(len(row)) + np.repeat(start - (np.cumsum(width - 2) - (width - 2)), width - 2)]
    if base**3 <= CELLS >> 3:
        known = np.zeros(base**3, bool)
        known[gram] = True
        number = np.cumsum(known) - 1
        return Sets(len(n), row, number[gram], int(number[-1]) + 1)
    known, gram = np.unique(gram, return_inverse=True)
    return Sets(len(n), row, gram, len(known))


class Scores:
    """CMP-02..04 of a batch of clauses(raw, norm, is_table, heading), all in one process, as scored_pairs() has them."""

    def __init__(self, t: pa.Table) -> None:
        raw, norm, heading = (pc.fill_null(t[c].combine_chunks(), "") for c in ("raw", "norm", "heading"))
        self.heads, self.grams = _word_sets(heading)[0], _gram_sets(norm)
        self.words, row, coded = _word_sets(norm)
        # emphasis marks may be parts of a raw word
        marked = np.flatnonzero(pc.or_(pc.match_substring(raw, "*"), pc.match_substring(raw, "_")).to_numpy(zero_copy_only=False))
        number = {w: i for i, w in enumerate(T.POLICY_TERMS)}
        of = np.array([number.get(w, -1) for w in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.int64)
        keep = (of >= 0) & ~np.isin(row, marked)
        own = [(i, number[w]) for i in marked for w in re.findall(T.WORD, raw[int(i)].as_py().lower()) if w in number]
        self.terms = Sets(len(raw), np.concatenate([row[keep], np.array([x[0] for x in own], np.int64)]), np.concatenate([of[keep], np.array([x[1] for x in own], np.int64)]), len(number))
        self.raw = pc.utf8_trim(raw, " ").dictionary_encode().indices.to_numpy()
        self.blank = pc.equal(norm, "").to_numpy(zero_copy_only=False)
        self.norm = norm.dictionary_encode().indices.to_numpy()
        self.table = t["is_table"].combine_chunks().to_numpy(zero_copy_only=False)

    def of(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        """(head, lex, sem, score, accepted) of rows a with rows b."""
        h = rounded(self.heads.jaccard(a, b))
        x = rounded(0.7 * self.words.jaccard(a, b) + 0.3 * self.grams.jaccard(a, b))
        x = np.where(self.blank[a] | self.blank[b], 0.0, np.where(self.norm[a] == self.norm[b], 1.0, x))
        s = np.where(self.raw[a] == self.raw[b], 1.0, x)
        k = self.terms.jaccard(a, b)
        p, q = self.table[a], self.table[b]
        v = np.select(
            [p & q, p != q, x >= 0.95, s >= 0.85, (h >= 0.8) & ((s >= 0.45) | (x >= 0.35))],
            [0.3 * h + 0.7 * x, 0.4 * x + 0.1 * s, x, 0.65 * s + 0.25 * x + 0.1 * h, 0.35 * h + 0.4 * s + 0.25 * x], 0.2 * h + 0.8 * (0.5 * s + 0.3 * x + 0.2 * k),
        )
        c = rounded(np.minimum(1.0, np.maximum(0.0, v)))
        return h, x, s, c, (c >= TAU) | ((h >= 0.8) & ((s >= 0.45) | (x >= 0.35))) | ((s >= 0.6) & ((c >= 0.4) | (h >= 0.3) | (x >= 0.1)))


def _match_pair(scores: Scores, a: np.ndarray, b: np.ndarray, hold: int = 16) -> list[tuple[int, int]]:
    """JON-07 of one large pair of documents: each clause of a holds its best partners, and is scored again when they are taken.

    Memory grows with the clauses, not with their pairs.
    """
    free = np.ones(len(b), bool)
    best: dict[int, list] = {}
    heap: list = []

    def refill(rows: np.ndarray) -> None:
        at = np.flatnonzero(free)
        _, _, _, c, ok = scores.of(np.repeat(a[rows], len(at)), np.tile(b[at], len(rows)))
        c = np.where(ok, c, -1.0).reshape(len(rows), len(at))
        for i, own in zip(rows.tolist(), c):
            least = np.partition(own, -hold)[-hold] if len(own) > hold else -1.0
            near = np.flatnonzero((own >= least) & (own >= 0))
            near = near[np.argsort(-own[near], kind="stable")][:hold]
            best[i] = list(zip(own[near].tolist(), at[near].tolist()))[::-1]
            push(i)

    def push(i: int) -> None:
        if best[i]:
            heapq.heappush(heap, (-best[i][-1][0], i, best[i][-1][1]))

    step = max(1, PAIRS // len(b))
    for i in range(0, len(a), step):
        refill(np.arange(i, min(len(a), i + step)))
    out = []
    while heap:
        _, i, j = heapq.heappop(heap)
        if free[j]:
            free[j] = False
            out.append((int(a[i]), int(b[j])))
            continue
        while best[i] and not free[best[i][-1][1]]:
            best[i].pop()
        if best[i]:
            push(i)
        elif free.any():
            refill(np.array([i]))
    return out


def _matches(scores: Scores, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> list[tuple[int, int]]:
    """JON-07 of many pairs of documents: rows a[k]..a[k]+na[k] against b[k]..b[k]+nb[k]."""
    out: list = []
    size = na * nb
    large = size > PAIRS
    for k in np.flatnonzero(large):
        out += _match_pair(scores, np.arange(a[k], a[k] + na[k]), np.arange(b[k], b[k] + nb[k]))
    todo = np.flatnonzero(~large & (size > 0))
    cut = np.flatnonzero(np.diff(np.cumsum(size[todo]) // PAIRS, prepend=0)) if len(todo) else []
    for part in np.split(todo, cut):
        if not len(part):
            continue
        own = np.repeat(part, size[part])
        at = np.arange(len(own)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
        i, j = a[own] + at // nb[own], b[own] + at % nb[own]
        _, _, _, c, ok = scores.of(i, j)
        at = np.flatnonzero(ok)
        at = at[np.lexsort((-c[at], own[at]))]  # stable: ties stay in the order of ia, ib
        used = bytearray(len(scores.raw))
        for x, y in zip(i[at].tolist(), j[at].tolist()):
            if not used[x] and not used[y]:
                used[x] = used[y] = 1
                out.append((x, y))
    return out


def _aligned(t: pa.Table) -> pa.RecordBatch:
    """CMP-05, JON-08 of whole pairs of documents, whose clauses stand together, side a first."""
    side = pc.equal(t["side"], "b").combine_chunks().to_numpy(zero_copy_only=False)
    pair = t["pair_id"].combine_chunks().dictionary_encode().indices
    code = pc.fill_null(pair, -1).to_numpy()
    new = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    nb = np.add.reduceat(side, new, dtype=np.int64)
    n = np.diff(np.append(new, len(code)))
    na = np.where(code[new] < 0, 0, n - nb)  # as in a join, a null pair meets nothing
    scores = Scores(t)
    m = np.array(_matches(scores, new, na, new + n - nb, nb), np.int64).reshape(-1, 2)
    head, lex, sem, score, _ = scores.of(m[:, 0], m[:, 1])
    method = np.where(lex >= 0.95, "exact", np.where(head >= 0.8, "structural", "semantic"))
    alone = np.ones(len(code), bool)
    alone[m.ravel()] = False
    only_a, only_b = np.flatnonzero(alone & ~side), np.flatnonzero(alone & side)
    a, b = (pa.array(np.concatenate(x), pa.int64(), mask=np.concatenate(x) < 0) for x in ([m[:, 0], only_a, np.full(len(only_b), -1)], [m[:, 1], np.full(len(only_a), -1), only_b]))
    pad = pa.nulls(len(only_a) + len(only_b), pa.float64())
    score_of = lambda v: pa.concat_arrays([pa.array(v, pa.float64()), pad])
    t = t.combine_chunks()
    take = lambda c, i: t[c].combine_chunks().take(i)
    names = ["pair_id", "ib", "ia", "raw_a", "section_a", "head", "lex", "sem", "score", "method", "raw_b", "section_b"]
    columns = [
        take("pair_id", pc.coalesce(a, b)), take("idx", b), take("idx", a), take("raw", a), take("section", a), *map(score_of, (head, lex, sem, score)),
        pa.concat_arrays([pa.array(method.tolist(), pa.string()), pad.cast(pa.string())]), take("raw", b), take("section", b),
    ]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _whole_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of some ROWS rows that end where a pair ends."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        for x in range(0, b.num_rows, ROWS):
            part = b.slice(x, ROWS)
            ids = part.column(0)
            # the last pair of a part may go on
            last, i = ids[part.num_rows - 1], part.num_rows - 1
            same = pc.fill_null(pc.equal(ids, last), False).to_numpy(zero_copy_only=False) if last.is_valid else ids.is_null().to_numpy(zero_copy_only=False)
            i = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if i or (held and not held[-1].column(0)[held[-1].num_rows - 1].equals(last)):
                whole = [*held, part.slice(0, i)] if i else held
                yield pa.Table.from_batches(whole)
                held = []
            held.append(part.slice(i))
    if held:
        yield pa.Table.from_batches(held)


#: Rows of a chunk; two chunks are compared at once.
CHUNK = 1024


def jaccard_pairs(rows: DataFrame) -> DataFrame:
    """JON-06, JON-15: (a, b, similarity) of all pairs a < b of rows(block, key, words) of one block.

    A block is dealt into chunks of some CHUNK rows, and each two chunks are compared by one task as sets of bits,
    so that tasks follow the pairs, not the bytes of the rows. The result itself is quadratic in a block.
    """
    rows = rows.where("block is not null and key is not null")
    sizes = rows.groupBy("block").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
    tiles = sizes.agg(F.coalesce(F.sum(F.col("parts") * (F.col("parts") + 1.0) / 2), F.lit(0.0))).first()[0]
    dealt = rows.join(sizes, "block").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("block", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "key", "words")
    kind = rows.schema["key"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        part, low, high = t["part"].to_numpy(), t["low"][0].as_py(), t["high"][0].as_py()
        words = pc.fill_null(t["words"].combine_chunks(), [])
        coded = pc.list_flatten(words).dictionary_encode()
        sets = Sets(len(words), pc.list_parent_indices(words).to_numpy(), coded.indices.to_numpy(), len(coded.dictionary))
        key = t["key"].combine_chunks()
        rank = np.empty(len(part), np.int64)
        rank[np.asarray(pc.sort_indices(key))] = np.arange(len(part))
        same = pc.rank(key, tiebreaker="min").to_numpy()
        x, y = np.flatnonzero(part == low), np.flatnonzero(part == high)
        i, j = np.repeat(x, len(y)), np.tile(y, len(x))
        if low == high:
            keep = rank[i] < rank[j]
            i, j = i[keep], j[keep]
        i, j = np.where(rank[i] < rank[j], i, j), np.where(rank[i] < rank[j], j, i)
        keep = same[i] != same[j]
        i, j = i[keep], j[keep]
        return pa.table({"a": key.take(pa.array(i)), "b": key.take(pa.array(j)), "similarity": rounded(sets.jaccard(i, j), 6)})

    # a number that is asked for stays: small rows with many pairs are not put into one task
    return dealt.repartition(int(min(20000, max(1, tiles // 4))), "block", "low", "high").groupBy("block", "low", "high").applyInArrow(run, f"a {kind}, b {kind}, similarity double")


def align(clauses: DataFrame, vec: str | None = None, paired: bool = False) -> DataFrame:
    """CMP-05, JON-08: matched pairs, then removed and added clauses, with raw texts.

    Without vectors a pair of documents is scored and matched in one pass over its clauses. paired: a pair's
    clauses stand together already, side a first, in order (see extract).
    """
    if vec:
        m = greedy(scored_pairs(clauses, vec))
        a = clauses.where("side = 'a'").select("pair_id", F.col("idx").alias("ia"), F.col("raw").alias("raw_a"), F.col("section").alias("section_a"))
        b = clauses.where("side = 'b'").select("pair_id", F.col("idx").alias("ib"), F.col("raw").alias("raw_b"), F.col("section").alias("section_b"))
        return a.join(m, ["pair_id", "ia"], "left").join(b, ["pair_id", "ib"], "full_outer")
    rows = clauses.where("side in ('a', 'b')").select(
        "pair_id", "side", "idx", "section", "raw", F.lower(F.trim(F.coalesce("norm", F.lit("")))).alias("norm"), "is_table", F.lower(T.normalize_heading(F.col("section"))).alias("heading")
    )
    if not paired:
        rows = rows.repartition("pair_id").sortWithinPartitions("pair_id", "side", "idx")
    return rows.mapInArrow(lambda batches: map(_aligned, _whole_pairs(batches)), ALIGNED)


def classify(aligned: DataFrame, llm_conflict: Column | None = None, diffs: bool = True) -> DataFrame:
    """CMP-08..11: diff_type, severity and entity diffs of aligned rows; without `diffs` only what the types need is made of them."""
    if diffs:
        none = F.expr("cast(map() as map<string,array<struct<raw:string,norm:string>>>)")
        ea = F.coalesce(E.entities(F.col("raw_a")), none)
        eb = F.coalesce(E.entities(F.col("raw_b")), none)
        out = aligned.withColumn("diffs", E.entity_diffs(ea, eb))
        divergent = F.exists("diffs", lambda d: d["divergent"])
        duration = F.exists("diffs", lambda d: d["divergent"] & (d["type"] == "duration"))
    else:
        out = E.divergences(aligned, "raw_a", "raw_b")
        divergent, duration = F.col("divergent"), F.col("duration_divergent")
    # each text is lowered once, not for every term
    out = out.withColumns({"_low_a": F.lower("raw_a"), "_low_b": F.lower("raw_b")}).withColumn("polarity", E.polarity_of_lower(F.col("_low_a"), F.col("_low_b"))).drop("_low_a", "_low_b")
    sure = F.col("polarity").isNotNull() | duration
    hit = sure | (F.coalesce(llm_conflict, F.lit(False)) & divergent) if llm_conflict is not None else sure
    kind = (
        F.when(F.col("raw_a").isNull(), "added").when(F.col("raw_b").isNull(), "removed").when(hit, "conflict")
        .when((F.greatest("lex", "score") >= 0.95) & ~divergent, "unchanged").otherwise("modified")
    )
    return out.withColumn("diff_type", kind).withColumn("severity", F.when(F.col("diff_type") == "conflict", "high"))


def statistics(rows: DataFrame) -> DataFrame:
    """CMP-13: counts a pair, clause totals and the divergence index."""
    n = lambda k: F.count_if(F.col("diff_type") == k)
    out = rows.groupBy("pair_id").agg(
        F.count("raw_a").alias("n_a"), F.count("raw_b").alias("n_b"), *[n(k).alias(k) for k in ("added", "removed", "unchanged", "modified", "conflict")]
    )
    return out.withColumn("divergence", E.divergence(*[F.col(c) for c in ("n_a", "n_b", "added", "removed", "modified", "conflict")]))


def compare(docs: DataFrame, conflicts_only: bool = False, paired: bool = False, diffs: bool = True) -> DataFrame:
    """CMP-14: classified rows of docs(pair_id, side, text); pairs with a missing or blank side give none, see problems().

    paired: a pair's documents stand together already, side a first, in one partition.
    """
    if not paired:
        docs = docs.withColumn("pair_id", F.col("pair_id").cast("string")).repartition("pair_id").sortWithinPartitions("pair_id", "side")
    rows = classify(align(extract(docs, paired=True), paired=True), diffs=diffs)
    return rows.where("diff_type = 'conflict'") if conflicts_only else rows


def problems(docs: DataFrame) -> DataFrame:
    """CMP-14: (pair_id, error) of the pairs that cannot be compared: both sides must have text."""
    has = lambda side: F.coalesce(F.max((F.col("side") == side) & (F.trim(F.coalesce("text", F.lit(""))) != "")), F.lit(False))
    sides = docs.groupBy(F.col("pair_id").cast("string").alias("pair_id")).agg(has("a").alias("a"), has("b").alias("b"))
    lost = F.concat_ws(", ", F.when(~F.col("a"), "document a has no text"), F.when(~F.col("b"), "document b has no text"))
    return sides.select("pair_id", lost.alias("error")).where("error <> ''")


def summary(stats: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """CMP-13/14: statistics() with titles and the executive summary; titles(pair_id, title_a, title_b), by default Document A and B."""
    rows = stats.withColumns({"title_a": F.lit("Document A"), "title_b": F.lit("Document B")}) if titles is None else (
        stats.join(titles, "pair_id", "left").withColumns({"title_a": F.coalesce("title_a", F.lit("Document A")), "title_b": F.coalesce("title_b", F.lit("Document B"))})
    )
    same = F.format_string("Documents '%s' and '%s' are identical across all %d clauses (0.0 divergence).", "title_a", "title_b", "n_a")
    found = F.format_string(
        "Comparison between '%s' and '%s' identified %d policy conflicts, %d modified clauses, %d additions, and %d removals (Divergence Index: %.2f).",
        "title_a", "title_b", "conflict", "modified", "added", "removed", "divergence",
    )
    return rows.withColumn("summary", F.when(F.col("divergence") == 0, same).otherwise(found))

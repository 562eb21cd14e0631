"""Personal data: base patterns, and spans that a linear-chain conditional random field adds.

The base finds e-mail addresses, IPv4 addresses, payment cards and international phone numbers by fixed
rules. The field labels the other number-bearing tokens over word-shape features as local phone numbers or
identity and account numbers; it is trained from the small labelled table below and decoded by Viterbi in
numpy batches. A token without a digit can only be outside (a hard constraint in training too), so the chain
falls apart exactly at such tokens and only runs of number-bearing tokens are decoded.

Edge rules: null and empty texts have no spans; added spans never overlap base spans and have kinds of their
own, so the four counts are the base's; rows are judged one by one; very long texts and runs are read whole;
an empty table gives no rows; other columns are ignored (mask() keeps them), whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import read

BASE = ("email", "ip", "card", "phone")
ADDED = ("local_phone", "id_number")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match can only begin where a run of digits does
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"\S+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(t: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of the base patterns, by kind as listed, then start."""
    out = []
    pos, a = 0, t.find("@")
    while a >= 0:
        s = a
        while s > pos and t[s - 1] in _LOCAL:
            s -= 1
        if s < a and (m := _DOMAIN.match(t, a + 1)):
            out.append(("email", s, m.end()))
            pos = m.end()
        a = t.find("@", max(a + 1, pos))
    if _DIGIT.search(t):
        out += [("ip", *m.span()) for m in _IP.finditer(t) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(t):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
        if "+" in t:
            out += [("phone", *m.span()) for m in _PHONE.finditer(t) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


# ---------------------------------------------------------------- the field

#: The labelled table: {kind:...} marks a span. All lines and numbers are made up or documented example numbers.
LABELLED = (
    "call me at {local_phone:555-0142} after six",
    "phone: {local_phone:(212) 555-0187} or write",
    "tel. {local_phone:555 0199}, ask for the desk",
    "Telefon {local_phone:030 5550134} abends",
    "mobile {local_phone:07700 900123} only",
    "teléfono {local_phone:91 555 01 23} por la tarde",
    "téléphone {local_phone:01 55 50 12 34} le matin",
    "fax {local_phone:555-0111} is off",
    "reach us on {local_phone:(415) 555-0100} today",
    "my number is {local_phone:555-867-5309} ok",
    "cell {local_phone:202.555.0173} anytime",
    "phone: {local_phone:555-0163} ok",
    "at 12:30 phone: {local_phone:555-0175} please",
    "in 2020 call {local_phone:212 555 0116} now",
    "Tel: {local_phone:040 5550122}; next",
    "ssn {id_number:078-05-1120} on file",
    "since 1999 ssn: {id_number:123-45-6789}; thanks",
    "social security number {id_number:219-09-9999} given",
    "passport {id_number:X12345678} expires soon",
    "passport no. {id_number:C01X00T47} was issued",
    "account {id_number:000123456789} is closed",
    "IBAN {id_number:DE89370400440532013000} please",
    "iban: {id_number:GB82WEST12345698765432} please",
    "Konto {id_number:0532013000} gesperrt",
    "cuenta {id_number:2100041845020005} cerrada",
    "compte {id_number:30006000011234567890189} fermé",
    "tax id {id_number:12-3456789} applies",
    "driver license {id_number:D1234567} valid",
    "born in 1984 and moved in 2003 to the coast",
    "version 2.0 of the License was released",
    "Apache License, Version 2.0, see 2004 text",
    "price 19.99 or 1,200 dollars in 2021",
    "chapter 12 page 345 lines 6-9",
    "between 1914 and 1918 there were 4 winters",
    "it was 45.5 degrees at 12:30 on 2024-05-17",
    "server 10.0.0.12 answered in 35 ms",
    "host 192.168.10.45 port 8080 closed",
    "card 4111111111111111 was declined",
    "order 48213 shipped with 3 items",
    "section 4.2.1 of rfc 2616 applies",
    "token = \"5d41c8f09b7e36a2d1846bb0c3f7259ea4106d8e\" here",
    "commit 9fceb02 fixed issue 1423",
    "rows 7300000000000012 and 9150000000000044 differ",
    "mail me at ann.43@mail7.example.com today",
    "dial +1 (603) 555-8791 from abroad",
    "room 101 on floor 7 of building B2",
    "a b c 555 trees and 1200 birds",
    "score 3-1 after 90 minutes",
    "id 7 of 12 rows",
    "population 1,204,332 in 2010 and 1,300,000 in 2020",
    "x1 x2 x3 are inputs",
    "checksum 40000000000071 against 700000000000093 failed",
)
LABELS = ["O", *(f"{p}-{k}" for k in ADDED for p in "BI")]
_MARK = re.compile(r"\{(\w+):([^}]*)\}")


def _shape(w: str) -> str:
    out = []
    for c in w:
        s = "d" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c
        out.append(s)
    s = "".join(out)
    return s if len(s) <= 16 else f"{s[:4]}~{len(s) // 8}~{s[-4:]}"


def _features(words: list[str], i: int) -> list[str]:
    w = words[i]
    core = w.strip(".,;:!?\"'")
    back = words[i - 1].lower().strip(".,;:!?\"'") if i else "^"
    back2 = words[i - 2].lower().strip(".,;:!?\"'") if i > 1 else "^"
    digits = sum("0" <= c <= "9" for c in core)
    shape = _shape(core)
    return [
        "bias", f"s={shape}", f"r={re.sub(r'(.)\1+', r'\1', shape)}", f"n={min(digits, 12)}", f"l={min(len(core), 24) // 3}",
        f"b={back}" if not _DIGIT.search(back) else f"bs={_shape(back)}", f"c={back2}" if not _DIGIT.search(back2) else "c=#", f"b+r={back}|{min(digits, 12)}", f"stop={w != core}",
    ]


def _runs(words: list[str]) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of words that hold a digit."""
    i = 0
    while i < len(words):
        if _DIGIT.search(words[i]):
            j = i + 1
            while j < len(words) and _DIGIT.search(words[j]):
                j += 1
            yield i, j
            i = j
        else:
            i += 1


class Field:
    """A linear-chain conditional random field over runs that stand between outside tokens."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.names, self.emit, self.move = names, emit, move

    def scores(self, runs: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """Padded emission scores (run, step, label) and lengths."""
        n = np.array([len(r) for r in runs])
        out = np.zeros((len(runs), int(n.max(initial=0)), len(LABELS)))
        for a, r in enumerate(runs):
            for t, fs in enumerate(r):
                ids = [self.names[f] for f in fs if f in self.names]
                if ids:
                    out[a, t] = self.emit[ids].sum(0)
        return out, n

    def decode(self, runs: list[list[list[str]]]) -> list[list[int]]:
        """Best labels of each run; runs of like length share a batch."""
        out: list[list[int]] = [[] for _ in runs]
        by: dict[int, list[int]] = {}
        for a, r in enumerate(runs):
            by.setdefault(len(r).bit_length(), []).append(a)
        for group in by.values():
            for at in range(0, len(group), 4096):
                part = group[at : at + 4096]
                e, n = self.scores([runs[a] for a in part])
                best = e[:, 0] + self.move[0]
                came = []
                for t in range(1, e.shape[1]):
                    s = best[:, :, None] + self.move[None]
                    arg = s.argmax(1)
                    step = np.take_along_axis(s, arg[:, None], 1)[:, 0] + e[:, t]
                    live = (t < n)[:, None]
                    came.append(np.where(live, arg, np.arange(len(LABELS))))
                    best = np.where(live, step, best)
                tag = (best + self.move[:, 0]).argmax(1)
                tags = [tag]
                for arg in reversed(came):
                    tag = np.take_along_axis(arg, tag[:, None], 1)[:, 0]
                    tags.append(tag)
                table = np.stack(tags[::-1], axis=1)
                for k, a in enumerate(part):
                    out[a] = table[k, : n[k]].tolist()
        return out


def _table(lines) -> tuple[list[list[list[str]]], list[list[int]]]:
    runs, tags = [], []
    for line in lines:
        spans, plain, last = [], "", 0
        for m in _MARK.finditer(line):
            plain += line[last : m.start()]
            spans.append((m[1], len(plain), len(plain) + len(m[2])))
            plain += m[2]
            last = m.end()
        plain += line[last:]
        found = list(_TOKEN.finditer(plain))
        words = [m[0] for m in found]
        label = []
        for m in found:
            y = 0
            for kind, a, b in spans:
                if m.start() < b and m.end() > a:
                    y = LABELS.index(("B-" if m.start() <= a else "I-") + kind)
            label.append(y)
        for i, j in _runs(words):
            runs.append([_features(words, k) for k in range(i, j)])
            tags.append(label[i:j])
    return runs, tags


def train(lines=LABELLED, steps: int = 400, rate: float = 0.1, decay: float = 5e-4) -> Field:
    """Maximum likelihood with a ridge, by Adam on the exact forward-backward gradient."""
    runs, tags = _table(lines)
    names = {f: i for i, f in enumerate(sorted({f for r in runs for fs in r for f in fs}))}
    k = len(LABELS)
    field = Field(names, np.zeros((len(names), k)), np.zeros((k, k)))
    n = np.array([len(r) for r in runs])
    steps_max = int(n.max())
    x = np.zeros((len(runs), steps_max, len(names)))
    y = np.zeros((len(runs), steps_max), int)
    for a, (r, t) in enumerate(zip(runs, tags)):
        y[a, : len(t)] = t
        for s, fs in enumerate(r):
            x[a, s, [names[f] for f in fs]] = 1
    live = np.arange(steps_max) < n[:, None]
    gold = np.eye(k)[y] * live[:, :, None]
    gold_move = np.zeros((k, k))
    for t in tags:
        for a, b in zip([0, *t], [*t, 0]):
            gold_move[a, b] += 1
    params = [field.emit, field.move]
    moment = [[np.zeros_like(p), np.zeros_like(p)] for p in params]

    def lse(v, axis):
        m = v.max(axis, keepdims=True)
        return (m + np.log(np.exp(v - m).sum(axis, keepdims=True))).squeeze(axis)

    for step in range(1, steps + 1):
        e = x @ field.emit
        fwd = np.zeros((len(runs), steps_max, k))
        bwd = np.zeros_like(fwd)
        fwd[:, 0] = field.move[0] + e[:, 0]
        for t in range(1, steps_max):
            fwd[:, t] = lse(fwd[:, t - 1][:, :, None] + field.move[None], 1) + e[:, t]
        for t in range(steps_max - 1, -1, -1):
            if t + 1 < steps_max:
                inner = lse(field.move[None] + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
            else:
                inner = np.zeros((len(runs), k))
            bwd[:, t] = np.where((t == n - 1)[:, None], field.move[:, 0][None], inner)
        z = lse(np.take_along_axis(fwd, (n - 1)[:, None, None], 1)[:, 0] + field.move[:, 0], 1)
        unary = np.exp(fwd + bwd - z[:, None, None]) * live[:, :, None]
        move = np.zeros((k, k))
        move[0] += unary[:, 0].sum(0)
        move[:, 0] += np.take_along_axis(unary, (n - 1)[:, None, None], 1)[:, 0].sum(0)
        for t in range(1, steps_max):
            both = fwd[:, t - 1][:, :, None] + field.move[None] + (e[:, t] + bwd[:, t])[:, None, :] - z[:, None, None]
            move += (np.exp(both) * (t < n)[:, None, None]).sum(0)
        grads = [np.einsum("atf,atk->fk", x, gold - unary) - decay * len(runs) * field.emit, gold_move - move - decay * len(runs) * field.move]
        for p, g, (m1, m2) in zip(params, grads, moment):
            m1 *= 0.9
            m1 += 0.1 * g
            m2 *= 0.999
            m2 += 0.001 * g * g
            p += rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return field


def _trim(t: str, a: int, b: int) -> tuple[int, int]:
    while a < b and not (t[a].isalnum() or t[a] in "+("):
        a += 1
    while b > a and not t[b - 1].isalnum():
        b -= 1
    return a, b


def find(texts: list[str], field: Field) -> list[list[tuple[str, int, int]]]:
    """All spans of each text: base spans by kind as listed, then the added ones, each kind by start."""
    out = [base_spans(t) if "@" in t or _DIGIT.search(t) else [] for t in texts]
    runs, where = [], []
    for d, t in enumerate(texts):
        if not _DIGIT.search(t):
            continue
        found = list(_TOKEN.finditer(t))
        words = [m[0] for m in found]
        for i, j in _runs(words):
            runs.append([_features(words, k) for k in range(i, j)])
            where.append((d, [found[k].span() for k in range(i, j)]))
    added: dict[int, list[tuple[str, int, int]]] = {}
    for tags, (d, spans) in zip(field.decode(runs), where):
        i = 0
        while i < len(tags):
            if tags[i] == 0:
                i += 1
                continue
            kind, j = LABELS[tags[i]][2:], i + 1
            while j < len(tags) and LABELS[tags[j]] == f"I-{kind}":
                j += 1
            a, b = _trim(texts[d], spans[i][0], spans[j - 1][1])
            if a < b and all(b <= x or y <= a for _, x, y in out[d]):
                added.setdefault(d, []).append((kind, a, b))
            i = j
    for d, spans in added.items():
        out[d] = out[d] + sorted(spans, key=lambda s: (ADDED.index(s[0]), s[1]))
    return out


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(field or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                found = find([t or "" for t in part.column(1).to_pylist()], shared.value)
                base = [[s for s in x if s[0] in BASE] for x in found]
                counts = [pa.array([sum(s[0] == k for s in x) for x in base], pa.int64()) for k in BASE]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *counts, pa.array([hashlib.sha256(_joined(x).encode()).hexdigest() for x in base]), pa.array([_joined(x) for x in found], pa.string())],
                    names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
                )

    schema = "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in BASE) + ", base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _mask(t: str, spans) -> str:
    parts, pos = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= pos:
            continue
        parts += [t[pos : max(a, pos)], f"[{k.upper()}]"]
        pos = b
    return "".join([*parts, t[pos:]])


def mask(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs with every span of its text replaced by [KIND] and n_chars, where it is a column, counted anew."""
    shared = docs.sparkSession.sparkContext.broadcast(field or train())
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                texts = part.column(at).to_pylist()
                found = find([t or "" for t in texts], shared.value)
                columns = list(part.columns)
                columns[at] = pa.array([t and _mask(t, s) if s else t for t, s in zip(texts, found)], columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    out = docs.mapInArrow(run, StructType(docs.schema.fields))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(read(spark, sf_dir, "documents"))

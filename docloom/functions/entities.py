"""Entity extraction, polarity and divergence as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from docloom.functions.text import let

# The entity classes' formats.
DURATION = r"(?i)\b(\d+(?:\.\d+)?)\s*(days?|months?|years?|weeks?|hours?|minutes?|secs?|seconds?|business\s+days?)\b"
CURRENCY = r"(?i)(?:([$€£¥₹])\s*(\d+(?:,\d{3})*(?:\.\d+)?)|(?:USD|EUR|GBP|INR|dollars?|cents?)\s*(\d+(?:,\d{3})*(?:\.\d+)?)|(\d+(?:,\d{3})*(?:\.\d+)?)\s*(?:USD|EUR|GBP|INR|dollars?|cents?))\b"
PERCENT = r"\b(\d+(?:\.\d+)?)\s*%"
VERSION = r"(?i)\bv?(\d+(?:\.\d+)+(?:-[a-z0-9]+)?)\b"
STANDARD = r"(?i)\b(?:RFC-\d+|ISO-\d+|SOC-\d+|HIPAA|GDPR|NIST-\d+)\b"
CLAUSE = r"(?i)\b(?:Clause_\d+(?:\.\d+)*|Clause\s+\d+(?:\.\d+)*|Section\s+\d+(?:\.\d+)*)\b"
DATE_ISO = r"\b\d{4}-\d{2}-\d{2}\b"
DATE_OTHER = r"(?i)\b(?:(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4}|\d{1,2}/\d{1,2}/\d{2,4})\b"
NUMBER = r"\b\d+(?:,\d{3})*(?:\.\d+)?\b"
MANDATORY = ("mandatory", "required", "must ", "shall ")
OPTIONAL = ("optional", "discretionary", "may ", "not required")
PROHIBITED = ("prohibited", "forbidden", "must not", "shall not", "cannot")
PERMITTED = ("permitted", "allowed", "may ")
TYPES = ("clause_reference", "currency", "date", "duration", "iso", "number", "percentage", "rfc", "version")


def _all(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), 0), F.expr("cast(array() as array<string>)"))


def _number(s: Column) -> Column:
    """A number's text as a program prints it: 30 -> 30, 1.50 -> 1.5, 2.0 -> 2.0."""
    return F.when(s.contains("."), s.cast("double").cast("string")).otherwise(s.cast("bigint").cast("string"))


def normalize_duration(raw: Column) -> Column:
    """CMP-07: number and unit; no unit is converted."""
    n = _number(F.regexp_extract(raw, DURATION, 1))
    unit = F.regexp_replace(F.lower(F.regexp_extract(raw, DURATION, 2)), r"s+$", "")
    one = F.regexp_extract(raw, DURATION, 1).cast("double") == 1
    return F.when(unit == "business day", F.concat(n, F.lit(" business_days"))).when(one, F.concat_ws(" ", n, unit)).otherwise(F.concat(n, F.lit(" "), unit, F.lit("s")))


def normalize_currency(raw: Column) -> Column:
    """CMP-07: only symbols choose a code; words count as USD."""
    sign = F.regexp_extract(raw, CURRENCY, 1)
    amount = F.replace(F.concat(*[F.regexp_extract(raw, CURRENCY, k) for k in (2, 3, 4)]), F.lit(","), F.lit(""))
    code = F.when(sign == "€", "EUR").when(sign == "£", "GBP").when(sign == "₹", "INR").when(sign == "¥", "JPY").otherwise("USD")
    return F.concat_ws(" ", code, amount)


def entities(text: Column) -> Column:
    """CMP-06: map of type to array of (raw, norm) in order of occurrence; absent types have no key."""
    bare = lambda r: F.replace(r, F.lit(","), F.lit(""))
    each = lambda found, norm: F.transform(found, lambda r: F.struct(r.alias("raw"), norm(r).alias("norm")))

    def build(f: Column) -> Column:
        taken = F.transform(F.flatten(F.transform(F.concat(f["dur"], f["cur"], f["pct"], f["ver"]), lambda r: _all(r, NUMBER))), bare)
        numbers = let(taken, lambda t: F.filter(f["num"], lambda r: ~F.array_contains(t, bare(r))))
        by = {
            "clause_reference": each(f["ref"], lambda r: F.regexp_replace(F.lower(r), r"\s+", "_")),
            "currency": each(f["cur"], normalize_currency),
            "date": each(f["day"], lambda r: r),
            "duration": each(f["dur"], normalize_duration),
            "iso": each(F.filter(f["std"], lambda r: ~F.upper(r).contains("RFC")), F.upper),
            "number": each(numbers, bare),
            "percentage": each(f["pct"], lambda r: F.concat(F.regexp_extract(r, PERCENT, 1), F.lit("%"))),
            "rfc": each(F.filter(f["std"], lambda r: F.upper(r).contains("RFC")), F.upper),
            "version": each(f["ver"], lambda r: F.concat(F.lit("v"), F.regexp_extract(r, VERSION, 1))),
        }
        entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in by.items()])
        return F.map_from_entries(F.filter(entries, lambda e: F.size(e["value"]) > 0))

    days = F.concat(_all(text, DATE_ISO), _all(text, DATE_OTHER))
    found = {"dur": DURATION, "cur": CURRENCY, "pct": PERCENT, "ver": VERSION, "std": STANDARD, "ref": CLAUSE, "num": NUMBER}
    return let(F.struct(*[_all(text, p).alias(n) for n, p in found.items()], days.alias("day")), build)


def entity_diffs(a: Column, b: Column) -> Column:
    """CMP-08, JON-09: array of (type, pos, raw_a, raw_b, norm_a, norm_b, divergent), paired by position."""
    none = F.expr("cast(array() as array<struct<raw:string,norm:string>>)")

    def at(kind: Column, i: Column, p: Column, q: Column) -> Column:
        divergent = F.coalesce(p["norm"] != q["norm"], F.lit(False))
        return F.struct(kind.alias("type"), i.alias("pos"), p["raw"].alias("raw_a"), q["raw"].alias("raw_b"), p["norm"].alias("norm_a"), q["norm"].alias("norm_b"), divergent.alias("divergent"))

    def of(m: Column, kind: str) -> Column:
        both = F.arrays_zip(F.coalesce(F.try_element_at(m["a"], F.lit(kind)), none).alias("p"), F.coalesce(F.try_element_at(m["b"], F.lit(kind)), none).alias("q"))
        return F.transform(both, lambda z, i: at(F.lit(kind), i, z["p"], z["q"]))

    return let(F.struct(a.alias("a"), b.alias("b")), lambda m: F.concat(*[of(m, kind) for kind in TYPES]))


# The formats, compiled as the JVM reads them; only ASCII text is read with them.
_RE = {n: re.compile(p, re.A) for n, p in {"dur": DURATION, "cur": CURRENCY, "pct": PERCENT, "ver": VERSION, "std": STANDARD, "ref": CLAUSE, "iso": DATE_ISO, "day": DATE_OTHER, "num": NUMBER}.items()}
#: Text that the shapes of entity_rows() do not cover: other than ASCII, and numbers whose printed form may differ from their text.
ODD = r"\d(?:\.\d|(?<=(?<!\d)0)\d|\d{17})"
#: Distinct shapes of text that a worker keeps.
SHAPES = 20000
_DIGITS = np.arange(256, dtype=np.uint8)
_DIGITS[ord("0") : ord("9") + 1] = ord("0")


def odd(text: Column) -> Column:
    return (F.length(text) != F.octet_length(text)) | text.rlike(ODD)


def _shape(text: str) -> tuple[list, list]:
    """Entities of a shape, a text whose digits are all 0: [(kind, start, end, norm, norm of "1" or None)] in order, and the
    pairs of numbers (entry, start, end of a taken number) that may be equal. A norm is a list of bytes: a place in the text, or -1 - byte.

    Every format reads all digits alike, so texts of one shape have their entities in the same places.
    """
    at = lambda a, b: list(range(a, b))
    said = lambda s: [-1 - ord(c) for c in s]
    put = lambda a, b, f=lambda c: c: [i if text[i].isdigit() else -1 - ord(f(text[i])) for i in at(a, b)]
    spans = {n: [m.span() for m in p.finditer(text)] for n, p in _RE.items()}
    out, taken = [], []
    for k, kind in enumerate(TYPES):
        if kind == "clause_reference":
            for a, b in spans["ref"]:
                norm, space = [], False
                for i in at(a, b):
                    if text[i] in " \t\n\x0b\f\r":
                        norm += [] if space else said("_")
                        space = True
                    else:
                        norm += put(i, i + 1, str.lower)
                        space = False
                out.append((k, a, b, norm, None))
        elif kind == "currency":
            for a, b in spans["cur"]:
                m = _RE["cur"].search(text[a:b])
                amount = [i for g in (2, 3, 4) if m and m[g] for i in at(a + m.start(g), a + m.end(g)) if text[i] != ","]
                out.append((k, a, b, said("USD ") + _put(text, amount), None))
        elif kind == "date":
            out += [(k, a, b, at(a, b), None) for n in ("iso", "day") for a, b in spans[n]]
        elif kind == "duration":
            for a, b in spans["dur"]:
                m = _RE["dur"].search(text[a:b])
                unit, n = re.sub(r"s+$", "", m[2].lower()), at(a + m.start(1), a + m.end(1))
                if unit == "business day":
                    out.append((k, a, b, n + said(" business_days"), None))
                else:
                    out.append((k, a, b, n + said(f" {unit}s"), n + said(" " + unit) if len(n) == 1 else None))
        elif kind in ("iso", "rfc"):
            out += [(k, a, b, put(a, b, str.upper), None) for a, b in spans["std"] if ("RFC" in text[a:b].upper()) == (kind == "rfc")]
        elif kind == "number":
            used = [(x + a, y + a) for n in ("dur", "cur", "pct", "ver") for a, b in spans[n] for x, y in (m.span() for m in _RE["num"].finditer(text[a:b]))]
            for a, b in spans["num"]:
                bare = [i for i in at(a, b) if text[i] != ","]
                # a number is left out where a taken one is equal; equal ones have as many digits
                rivals = [[i for i in at(x, y) if text[i] != ","] for x, y in used]
                if (a, b) in used:
                    continue
                taken += [(len(out), bare, o) for o in rivals if len(o) == len(bare)]
                out.append((k, a, b, _put(text, bare), None))
        elif kind == "percentage":
            for a, b in spans["pct"]:
                m = _RE["pct"].search(text[a:b])
                out.append((k, a, b, at(a + m.start(1), a + m.end(1)) + said("%"), None))
        elif kind == "version":
            for a, b in spans["ver"]:
                m = _RE["ver"].search(text[a:b])
                out.append((k, a, b, said("v") + at(a + m.start(1), a + m.end(1)), None))
    return out, taken


def _put(text: str, places: list) -> list:
    return [i if text[i].isdigit() else -1 - ord(text[i]) for i in places]


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0]..start[0]+n[0], start[1]..., one after the other."""
    return np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)


def _strings(data: np.ndarray, n: np.ndarray) -> pa.StringArray:
    return pa.StringArray.from_buffers(len(n), pa.py_buffer(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


class _Shapes:
    """The entities of the shapes met so far, as flat arrays."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.clear()

    def clear(self) -> None:
        self.number.clear()
        self.entries, self.norms, self.pairs = [], [], []  # of each shape
        self.flat = None

    def of(self, shapes: list[bytes]) -> np.ndarray:
        if len(self.number) > SHAPES:
            self.clear()
        for s in shapes:
            if s not in self.number:
                self.number[s] = len(self.number)
                found, taken = _shape(s.decode("ascii"))
                self.entries.append(found)
                self.pairs.append(taken)
                self.flat = None
        if self.flat is None:
            every = [e for f in self.entries for e in f]
            programs = [p for e in every for p in (e[3], e[4] or e[3])]
            n = np.array([len(f) for f in self.entries], np.int64)
            m = np.array([len(p) for p in self.pairs], np.int64)
            all_pairs = [p for f in self.pairs for p in f]
            width = np.array([len(p[1]) for p in all_pairs], np.int64)
            self.flat = {
                "n": n, "at": np.cumsum(n) - n, "kind": np.array([e[0] for e in every], np.int8), "start": np.array([e[1] for e in every], np.int64), "len": np.array([e[2] - e[1] for e in every], np.int64),
                "one": np.array([e[3][0] if e[4] is not None else -1 for e in every], np.int64),
                "plen": np.array([len(p) for p in programs], np.int64), "program": np.array([x for p in programs for x in p], np.int64),
                "pn": m, "pat": np.cumsum(m) - m, "entry": np.array([p[0] for p in all_pairs], np.int64), "width": width,
                "left": np.array([x for p in all_pairs for x in p[1]], np.int64), "right": np.array([x for p in all_pairs for x in p[2]], np.int64),
            }
            f = self.flat
            f["pstart"], f["wstart"] = np.cumsum(f["plen"]) - f["plen"], np.cumsum(width) - width
        return np.array([self.number[s] for s in shapes], np.int64)


_KNOWN = _Shapes()


def found_in(text: pa.Array, strings: bool = True) -> dict[str, np.ndarray | pa.Array]:
    """Entities of ASCII texts (a null one has none): row, kind, pos, raw, norm, by row, kind and pos, as entities() has them for text that is not odd()."""
    text = pc.fill_null(text, "")
    ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    shape = pa.BinaryArray.from_buffers(pa.binary(), len(text), [None, pa.py_buffer((ends - ends[0]).astype(np.int32)), pa.py_buffer(_DIGITS[data[ends[0] : ends[-1]]])]).dictionary_encode()
    of = _KNOWN.of(shape.dictionary.to_pylist())[shape.indices.to_numpy()]
    f = _KNOWN.flat
    n = f["n"][of]
    row, e = np.repeat(np.arange(len(text)), n), _ranges(f["at"][of], n)
    # numbers that equal a taken one
    m = f["pn"][of]
    prow, p = np.repeat(np.arange(len(text)), m), _ranges(f["pat"][of], m)
    keep = np.ones(len(row), bool)
    if len(p):
        w = f["width"][p]
        at, base = _ranges(f["wstart"][p], w), np.repeat(ends[prow], w)
        same = np.logical_and.reduceat(data[base + f["left"][at]] == data[base + f["right"][at]], np.cumsum(w) - w)
        keep[((np.cumsum(n) - n)[prow] + f["entry"][p])[same]] = False
    row, e = row[keep], e[keep]
    kind = f["kind"][e]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (kind[1:] != kind[:-1])])) if len(row) else np.empty(0, np.int64)
    pos = np.arange(len(row)) - np.repeat(new, np.diff(np.append(new, len(row))))
    one = f["one"][e]
    use = 2 * e
    if len(e):
        use = use + ((one >= 0) & (data[np.minimum(ends[row] + np.maximum(one, 0), len(data) - 1)] == ord("1")))
    n = f["plen"][use]
    code, base = f["program"][_ranges(f["pstart"][use], n)], np.repeat(ends[row], n)
    norm = _strings(np.where(code >= 0, data[np.minimum(base + np.maximum(code, 0), max(0, len(data) - 1))] if len(data) else 0, -1 - code).astype(np.uint8), n)
    raw = _strings(data[_ranges(ends[row] + f["start"][e], f["len"][e])], f["len"][e]) if strings else None
    return {"row": row, "kind": kind, "pos": pos, "raw": raw, "norm": norm}


def entity_columns(text: pa.Array, slow: pa.Array, strings: bool = True) -> dict:
    """found_in() for all texts: those of odd text are taken from `slow`, entities() of them, which is null for the others."""
    given = np.flatnonzero(slow.is_valid().to_numpy(zero_copy_only=False))
    if not len(given):
        return found_in(text, strings)
    mask = np.zeros(len(text), bool)
    mask[given] = True
    out = found_in(pc.if_else(pa.array(mask), pa.scalar(None, pa.string()), text))
    rows = [(i, TYPES.index(k), j, x["raw"], x["norm"]) for i in given.tolist() for k, v in sorted(slow[i].as_py()) for j, x in enumerate(v)]
    more = list(zip(*rows)) if rows else [()] * 5
    row, kind, pos = (np.concatenate([out[c], np.array(v, out[c].dtype)]) for c, v in zip(("row", "kind", "pos"), more))
    order = np.lexsort((pos, kind, row))
    joined = lambda c, v: pa.concat_arrays([out[c], pa.array(v, pa.string())]).take(pa.array(order))
    return {"row": row[order], "kind": kind[order], "pos": pos[order], "raw": joined("raw", more[3]) if strings else None, "norm": joined("norm", more[4])}


def with_slow(df: DataFrame, *names: str) -> DataFrame:
    """df with a column _slow_<name> for each named text: its entities() where the text is odd(), else null."""
    return df.select("*", *[F.when(odd(F.col(c)), entities(F.col(c))).alias(f"_slow_{c}") for c in names])


KINDS = pa.array(TYPES)


def entity_rows(df: DataFrame, text: str) -> DataFrame:
    """CMP-06: the other columns of df with type, pos, raw, norm: a row for each entity of df's column `text`, as entities() finds them."""
    keys = [c for c in df.columns if c != text]
    fields = [df.schema[c] for c in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = entity_columns(b.column(text), b.column(f"_slow_{text}"))
            row = pa.array(f["row"])
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(row) for c in keys), KINDS.take(pa.array(f["kind"])), pa.array(f["pos"], pa.int32()), f["raw"], f["norm"]], names=[*keys, "type", "pos", "raw", "norm"])

    kind = lambda n, t: S.StructField(n, t)
    return with_slow(df, text).mapInArrow(run, S.StructType([*fields, kind("type", S.StringType()), kind("pos", S.IntegerType()), kind("raw", S.StringType()), kind("norm", S.StringType())]))


def _paired(b: pa.RecordBatch, left: str, right: str) -> dict:
    """JON-09: entities of two texts by row, kind and position: row, kind, pos, norm_a, norm_b, divergent."""
    p, q = (entity_columns(b.column(c), b.column(f"_slow_{c}"), strings=False) for c in (left, right))
    most = max(int(x["pos"].max(initial=0)) for x in (p, q)) + 1
    key = lambda x: (x["row"].astype(np.int64) * len(TYPES) + x["kind"]) * most + x["pos"]
    ka, kb = key(p), key(q)
    both = np.union1d(ka, kb)

    def place(k: np.ndarray) -> pa.Array:
        at = np.searchsorted(k, both)
        hit = at < len(k)
        hit[hit] = k[at[hit]] == both[hit]
        return pa.array(at, pa.int64(), mask=~hit)

    norm_a, norm_b = p["norm"].take(place(ka)), q["norm"].take(place(kb))
    return {"row": both // most // len(TYPES), "kind": both // most % len(TYPES), "pos": both % most, "norm_a": norm_a, "norm_b": norm_b, "divergent": pc.fill_null(pc.not_equal(norm_a, norm_b), False)}


def diff_rows(df: DataFrame, a: str, b: str) -> DataFrame:
    """CMP-08, JON-09: the other columns of df with type, pos, norm_a, norm_b, divergent: a row for each pair of entities, as entity_diffs() pairs them."""
    keys = [c for c in df.columns if c not in (a, b)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            f = _paired(x, a, b)
            row = pa.array(f["row"])
            yield pa.RecordBatch.from_arrays([*(x.column(c).take(row) for c in keys), KINDS.take(pa.array(f["kind"])), pa.array(f["pos"], pa.int32()), f["norm_a"], f["norm_b"], f["divergent"]], names=[*keys, "type", "pos", "norm_a", "norm_b", "divergent"])

    more = [("type", S.StringType()), ("pos", S.IntegerType()), ("norm_a", S.StringType()), ("norm_b", S.StringType()), ("divergent", S.BooleanType())]
    return with_slow(df, a, b).mapInArrow(run, S.StructType([*(df.schema[c] for c in keys), *(S.StructField(n, t) for n, t in more)]))


def divergences(df: DataFrame, a: str, b: str) -> DataFrame:
    """df with divergent and duration_divergent: whether any pair of entities of the two texts differs, and any of durations."""

    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            f = _paired(x, a, b)
            d = f["divergent"].to_numpy(zero_copy_only=False)
            every, lasts = np.zeros(x.num_rows, bool), np.zeros(x.num_rows, bool)
            every[f["row"][d]] = True
            lasts[f["row"][d & (f["kind"] == TYPES.index("duration"))]] = True
            yield pa.RecordBatch.from_arrays([*(x.column(c) for c in names), pa.array(every), pa.array(lasts)], names=[*names, "divergent", "duration_divergent"])

    return with_slow(df, a, b).mapInArrow(run, S.StructType([*df.schema.fields, S.StructField("divergent", S.BooleanType()), S.StructField("duration_divergent", S.BooleanType())]))


def _has(low: Column, terms) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | low.contains(t)
    return out


def polarity_of_lower(a: Column, b: Column) -> Column:
    """polarity_conflict() of texts in lower case."""
    cross = lambda x, y: (_has(a, x) & _has(b, y)) | (_has(a, y) & _has(b, x))
    return F.when(cross(MANDATORY, OPTIONAL), "mandate").when(cross(PROHIBITED, PERMITTED), "permission")


def polarity_conflict(a: Column, b: Column) -> Column:
    """CMP-09: mandate, permission or null. Substring based: "not required" holds "required"."""
    return polarity_of_lower(F.lower(a), F.lower(b))


def divergence(n_a: Column, n_b: Column, added: Column, removed: Column, modified: Column, conflicts: Column) -> Column:
    """CMP-12: weighted share of changed clauses, clamped to 0..1, to 4 places."""
    value = (conflicts + 0.75 * (added + removed) + 0.5 * modified) / F.greatest(n_a, n_b, F.lit(1))
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)), 4)

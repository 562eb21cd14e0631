"""Token-bounded chunks of elements."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TARGET, MOST, OVERLAP = 450, 512, 50
_TOKEN = re.compile(r"\w+|[^\w\s]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def count(text: str) -> int:
    """CHK-01: the offline counter; another may be passed to chunk()."""
    return len(_TOKEN.findall(text or ""))


def truncate(text: str, n: int) -> str:
    """CHK-02: the first n tokens, as they stand in the text."""
    ends = [m.end() for m, _ in zip(_TOKEN.finditer(text), range(n))]
    return text[: ends[-1]] if len(ends) == n and ends else ("" if n <= 0 else text)


def islands(elements: DataFrame) -> DataFrame:
    """CHK-04: headings and titles dropped; consecutive rows of one section share an island number. elements(doc_id, ord, type, text, section, page)."""
    rows = elements.where(~F.col("type").isin("title", "h1", "h2", "h3"))
    w = Window.partitionBy("doc_id").orderBy("ord")
    change = F.when(F.lag("section").over(w).eqNullSafe(F.col("section")) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return rows.withColumn("change", change).withColumn("island", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("change")


def table_slices(table: str, most: int, tokens: Callable[[str], int] = count) -> list[str]:
    """CHK-08: row slices of a Markdown table with its two header lines repeated; a header that does not fit raises."""
    lines = [x for x in table.split("\n") if x.strip()]
    head, rows = lines[:2], lines[2:]
    if tokens("\n".join(head)) >= most:
        raise ValueError("the table's header alone exceeds the limit")
    out, now = [], []
    for r in rows:
        if now and tokens("\n".join([*head, *now, r])) > most:
            out.append("\n".join([*head, *now]))
            now = []
        now.append(r)
    if now or not rows:
        out.append(truncate("\n".join([*head, *now]), most))
    return out


def fold(rows: list[tuple], target: int, most: int, overlap: int, tokens: Callable[[str], int] = count) -> list[tuple[str, int, list[int]]]:
    """CHK-05..07: (content, tokens, element ords) of one island's rows (ord, type, text, section)."""
    section = rows[0][3] or ""
    crumb = f"[Context: {section}]\n\n" if section else ""
    if tokens(crumb) >= most:
        crumb = truncate(crumb, 50) + "\n\n"
    room = max(1, min(target, most - tokens(crumb)))
    out: list[tuple[str, int, list[int]]] = []
    now: list[str] = []
    ords: list[int] = []
    tail = ""

    def flush(sep: str = "\n\n", table: bool = False) -> None:
        nonlocal now, ords, tail
        if not now:
            return
        body = sep.join(now)
        lead = f"[...{tail}]\n" if tail and not table and tokens(crumb + tail + body) <= most else ""
        text = crumb + lead + body
        text = text if tokens(text) <= most else truncate(text, most)
        out.append((text, tokens(text), sorted(set(ords))))
        last = [s for s in _SENTENCE.split(body.strip()) if s.strip()][-1:]
        tail = last[0] if last and not table and tokens(last[0]) <= overlap else ""
        now, ords = [], []

    for o, kind, text, _ in rows:
        if kind == "table":
            flush()
            for part in table_slices(text, most - tokens(crumb), tokens):
                now, ords = [part], [o]
                flush(table=True)
            tail = ""
        elif tokens(text) > room:
            flush()
            for s in (s.strip() for s in _SENTENCE.split(text) if s.strip()):
                if now and tokens(" ".join([*now, s])) > room:
                    flush(" ")
                now.append(s if tokens(s) <= room else truncate(s, room))
                ords.append(o)
            flush(" ")
        else:
            if now and tokens("\n\n".join([*now, text])) > room:
                flush()
            now.append(text)
            ords.append(o)
    flush()
    return out


def chunk(elements: DataFrame, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP, tokens: Callable[[str], int] = count) -> DataFrame:
    """CHK-04..10: chunks of elements(doc_id, ord, type, text, section, page); a document is one group of work."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        made, page = [], dict(zip(pdf.ord, pdf.page))
        kind = dict(zip(pdf.ord, pdf.type))
        for _, g in pdf.groupby("island", sort=True):
            for content, n, ords in fold(list(zip(g.ord, g.type, g.text, g.section)), target, most, overlap, tokens):
                i = len(made)
                pages = sorted({int(page[o]) for o in ords})
                doc = int(g.doc_id.iloc[0])
                digest = hashlib.sha256(f"{doc}:none:{i}:{content}".encode()).hexdigest()
                made.append((doc, i, content, n, g.section.iloc[0], pages, sorted({kind[o] for o in ords}), [int(o) for o in ords], digest))
        return pd.DataFrame(made, columns=["doc_id", "chunk_index", "content", "tokens", "section", "pages", "types", "ords", "hash"])

    schema = "doc_id bigint, chunk_index int, content string, tokens int, section string, pages array<int>, types array<string>, ords array<bigint>, hash string"
    return islands(elements).groupBy("doc_id").applyInPandas(run, schema)

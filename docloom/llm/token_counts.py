"""Exact sentencepiece token counts at every prefix of every text.

Prefix dynamic programming: the last token of a prefix's encoding is the one vocabulary piece that ends the
prefix and is compatible with the last token of the prefix before it (the pair encodes to itself), so
count[i] = count[i - len(last)] + 1 and one pass over a text gives the count of every prefix. It is exact
because piece merges are local. The pass runs once for each distinct chunk, and once for the prefix that
chunks in order share; chunks are cut where no vocabulary piece holds the two neighbouring characters, so
no merge can cross a cut, and a text's prefix counts are its chunks' counts added up. One signed byte a text byte is stored: the change of the count at
that byte (a character's change stands at its last byte); the running sum answers truncation and budget
questions without encoding again.

Edge rules: null and empty texts have no tokens; special strings inside a text are ordinary text, as the
library's default has it; rows are judged one by one, so repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import ChunkCache, cut, gather
from .common import read, slices, utf8_column

LIMIT = 4096
SPACE = "▁"
OPENS = b"\xff"  # in no UTF-8 text


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PrefixCounter:
    """Prefix token counts under one sentencepiece BPE model with byte fallback and a leading space."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        self.tails = {p[k:] for p in self.score for k in range(len(p))}
        pairs = {(a, b) for p in self.score for a, b in zip(p, p[1:])}
        # a cut is safe before a character's first byte, unless a piece holds two characters with these bytes at their border
        self.safe = np.zeros((256, 256), bool)
        self.safe[:192, :128] = self.safe[:192, 194:245] = True
        for x, y in pairs:
            for u in (x, " ") if x == SPACE else (x,):
                for v in (y, " ") if y == SPACE else (y,):
                    self.safe[u.encode()[-1], v.encode()[0]] = False
        self.agree: dict[tuple[str, str], bool] = {}
        # equal scores (the model's runs of spaces) share a rank, as their merges are made leftmost first
        place = {v: k for k, v in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.rank = {p: place[v] for p, v in self.score.items()}
        self.parts: dict[str, tuple[str, str] | None] = {}
        # one cache for both kinds of chunk, as a process keeps one: those that open a text stand behind OPENS
        self.cache = ChunkCache(self.changes)

    def merged(self, s: str) -> list[str]:
        """The encoding of a short string: merge the best-scored neighbours, leftmost first."""
        parts = list(s)
        score = self.score
        self.made = None
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                v = score.get(parts[i] + parts[i + 1])
                if v is not None and (best is None or v > best):
                    best, at = v, i
            if at < 0:
                break
            self.made = parts[at], parts[at + 1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge makes a piece, by its own encoding; None for one character."""
        if piece not in self.parts:
            whole = self.merged(piece) == [piece]
            self.parts[piece] = self.made if whole and len(piece) > 1 else None
        return self.parts[piece]

    def compatible(self, a: str, b: str) -> bool:
        """Whether a followed by b encodes to just these two: no merge across their border comes first.

        The border is followed back through the merges that made both sides, latest first; a merge across
        it that outranks the one just undone would have been made before.
        """
        got = self.agree.get((a, b))
        if got is not None:
            return got
        rank, split = self.rank, self.split
        x, y, limit, got = a, b, 1 << 60, True
        while True:
            r = rank.get(x + y)
            if r is not None and r < limit:
                got = False
                break
            sx, sy = split(x), split(y)
            rx = rank[x] if sx else -1
            ry = rank[y] if sy else -1
            if rx < 0 and ry < 0:
                break
            # a merge of equal rank is made leftmost first
            if rx > ry:
                limit, x = rx, sx[1]
            else:
                limit, y = ry + 1, sy[0]
        if len(self.agree) > 1_000_000:
            self.agree.clear()
        self.agree[a, b] = got
        return got

    def counts(self, s: str, count: list[int], last: list[str]) -> None:
        """Carry count and last on to the end of s, which has its spaces replaced, from the prefix they hold.

        count[i]: tokens of the encoding of s[:i]; last[i]: its last token.
        """
        score, tails, agree, compatible = self.score, self.tails, self.agree, self.compatible
        for i in range(len(count), len(s) + 1):
            piece = s[i - 1]
            fits = [piece]
            for k in range(i - 2, -1, -1):
                piece = s[k:i]
                if piece not in tails:
                    break
                if piece in score:
                    fits.append(piece)
            for piece in reversed(fits):
                n = len(piece)
                before = last[i - n]
                if before:
                    # the piece must not merge with what stands before it
                    ok = agree.get((before, piece))
                    if ok is None:
                        ok = compatible(before, piece)
                else:
                    ok = n == 1 or self.split(piece)
                if ok:
                    count.append(count[i - n] + (1 if n > 1 or piece in score else len(piece.encode())))
                    last.append(piece)
                    break
            else:
                raise AssertionError("a prefix has no last token")

    def changes(self, chunks: list[bytes]) -> list[bytes]:
        """One signed byte a byte of each chunk; behind OPENS: the chunk opens its text, after the model's own space.

        Chunks are taken in order, so that each goes on from the prefix it shares with the one before it.
        """
        texts = [(SPACE + c[1:].decode() if c[:1] == OPENS else c.decode()).replace(" ", SPACE) for c in chunks]
        out, before, count, last = [b""] * len(chunks), "", [0], [""]
        for k in sorted(range(len(chunks)), key=texts.__getitem__):
            s, raw = texts[k], chunks[k]
            same, most = 0, min(len(s), len(before))
            while same < most and s[same] == before[same]:
                same += 1
            del count[same + 1 :], last[same + 1 :]
            self.counts(s, count, last)
            before, c = s, count
            if raw[:1] == OPENS:
                raw, c = raw[1:], [0, *count[2:]]
            step = bytes([(b - a) & 0xFF for a, b in zip(c, c[1:])])
            if not raw.isascii():
                at = np.frombuffer(raw, np.uint8)
                wide = np.zeros(len(at), np.uint8)
                wide[np.append((at[1:] & 0xC0) != 0x80, True)] = np.frombuffer(step, np.uint8)
                step = wide.tobytes()
            out[k] = step
        return out

    def of(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Changes for rows laid end to end, one signed byte a byte."""
        starts = cut(data, offsets, self.safe)
        opening = np.isin(starts, offsets[:-1])
        out, _ = gather(data, starts, self.cache, 1)
        out = out.reshape(-1).view(np.int8).copy()
        # chunks that open a text are counted with the model's leading space
        at = starts[opening]
        ends = np.append(starts[1:], len(data))[opening]
        raw = memoryview(data)
        for a, b, v in zip(at.tolist(), ends.tolist(), self.cache.many([OPENS + raw[a:b] for a, b in zip(at.tolist(), ends.tolist())])):
            out[a:b] = np.frombuffer(v, np.int8)
        return out


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(model: str) -> PrefixCounter:
    """The worker's counter of a model, loaded once a process."""
    if model not in _COUNTERS:
        _COUNTERS[model] = PrefixCounter(model)
    return _COUNTERS[model]


def prefix_counts(docs: DataFrame, model: str | None = None, limit: int = LIMIT, store: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, limit_bytes, changes) for each row of docs(doc_id, text).

    limit_bytes: bytes of the longest prefix of at most `limit` tokens; changes (if store): the count's
    change at each byte as signed bytes, read by count_at() and longest_prefix().
    """
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model)
        for b in batches:
            data, offsets = utf8_column(b.column(1))
            for i, j in slices(offsets):
                o = offsets[i : j + 1] - offsets[i]
                d = data[offsets[i] : offsets[j]]
                ch = c.of(d, o)
                total = np.concatenate([[0], np.cumsum(ch, dtype=np.int64)])
                tokens = total[o[1:]] - total[o[:-1]]
                fits = np.diff(o)
                for r in np.flatnonzero(np.maximum(tokens, fits) > limit).tolist():
                    fits[r] = longest_prefix(ch[o[r] : o[r + 1]].tobytes(), limit, d[o[r] : o[r + 1]].tobytes())
                cols = [b.column(0).slice(i, j - i), pa.array(np.diff(o)), pa.array(tokens), pa.array(fits)]
                names = ["doc_id", "n_bytes", "n_tokens", "limit_bytes"]
                if store:
                    cols.append(pa.array([ch[x:y].tobytes() for x, y in zip(o[:-1], o[1:])], pa.binary()))
                    names.append("changes")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id bigint, n_bytes bigint, n_tokens bigint, limit_bytes bigint" + ", changes binary" * store
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def count_at(changes: bytes, n_bytes: int) -> int:
    """Tokens of the prefix of n_bytes bytes (a whole number of characters)."""
    return int(np.frombuffer(changes, np.int8)[:n_bytes].sum(dtype=np.int64))


def longest_prefix(changes: bytes, budget: int, text: bytes) -> int:
    """Bytes of the longest prefix of text that takes at most budget tokens."""
    count = np.cumsum(np.frombuffer(changes, np.int8), dtype=np.int64)
    raw = np.frombuffer(text, np.uint8)
    whole = np.ones(len(raw), bool)  # the byte ends a character
    whole[:-1] = (raw[1:] & 0xC0) != 0x80
    fits = np.flatnonzero((count <= budget) & whole)
    return int(fits[-1]) + 1 if len(fits) else 0


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefix_counts(read(spark, sf_dir, "documents"), store=False)
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "limit_bytes")

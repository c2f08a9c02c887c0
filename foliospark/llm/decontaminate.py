"""Benchmark decontamination by the q-gram lemma, over characters.

Texts are lower-cased, and runs of white space are one space. Items are cut into segments of `SEGMENT` characters, one
every `STEP`, so that a part of an item counts too; a shorter item is one segment. A segment of m characters with
at most e edits shares m - q + 1 - q e of its q-grams with the text. Per document, in numpy: positions whose q-gram
stands in the benchmark, regions dense enough for the lemma, counts of shared q-grams in half-overlapping diagonal
bands, segments that meet the edit budget's bound in a band, and banded alignment of what is left.

Any exact part of SEGMENT + STEP - 1 characters is found, and any segment within its budget. Items under `SHORTEST`
characters have no budget: they are found where they stand whole, between characters that are no word characters.

The benchmark is a stated query set. It is read in blocks of about `BLOCK` characters, one after another, so that what
the driver and a task hold is bounded; documents are read once per block and never shuffled. Null and empty texts are
clean; null or blank items, and those without an id, match nothing. Repeated rows give repeated results. Only the
named columns are read; `clean` passes all others through.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import stored

Q, SEGMENT, EDITS, STEP, SHORTEST, BLOCK = 8, 80, 6, 10, 40, 4_000_000
#: Pairs of a text's and the benchmark's q-grams that are counted at once.
SLICE = 1 << 20
OUT = "item_id long, start long, n_segments long, edits long"
_BASE = 0x9E3779B97F4A7C15
_UP = [np.uint64(pow(_BASE, k, 1 << 64)) for k in (1, 2, 4)]


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the q-gram at each position."""
    if len(x) < Q:
        return np.empty(0, np.uint64)
    h = x.astype(np.uint64) + np.uint64(1)
    for k, up in zip((1, 2, 4), _UP, strict=True):  # of 2, 4 and 8 characters
        h = h[:-k] * up + h[k:]
    return h ^ (h >> np.uint64(29))


def budget(m: int) -> int:
    return m * EDITS // SEGMENT


def align(a: np.ndarray, b: np.ndarray, edits: int, slack: int) -> int:
    """Least edits to turn a into a piece of b that starts in b's first 2 * slack + 1 places; edits + 1 if more.

    The band holds the diagonals of those starts, and `edits` more on both sides.
    """
    width = 2 * slack + 2 * edits + 1
    b = np.concatenate([np.full(edits, -1, np.int64), b, np.full(max(0, len(a) + width - len(b)), -1, np.int64)])
    ramp = np.arange(width)
    row = np.maximum(0, ramp - 2 * slack - edits)
    for i, c in enumerate(a):
        down = np.append(row[1:], edits + 1) + 1  # a's character left out of b
        row = np.minimum(row + (b[i : i + width] != c), down)
        row = np.minimum.accumulate(row - ramp) + ramp  # b's character left out of a
        if row.min() > edits:
            return edits + 1
    return int(row.min())


class Index:
    """q-gram postings of a block of items, and the items that are too short for them."""

    def __init__(self, items: list[tuple[int, str]]):
        short = [(i, t) for i, t in items if len(t) < SHORTEST]
        self.short: dict[str, list[int]] = {}
        for i, t in short:
            self.short.setdefault(t, []).append(i)
        by_size = sorted(self.short, key=len, reverse=True)
        self.words = re.compile(r"(?<!\w)(?=(" + "|".join(map(re.escape, by_size)) + r")(?!\w))") if short else None
        self.ids = [i for i, t in items if len(t) >= SHORTEST]
        self.texts = [letters(t) for _, t in items if len(t) >= SHORTEST]
        self.codes = [grams(t) for t in self.texts]
        code = np.concatenate([*self.codes, np.empty(0, np.uint64)])
        item = np.repeat(np.arange(len(self.ids)), [len(c) for c in self.codes])
        pos = np.concatenate([*(np.arange(len(c)) for c in self.codes), np.empty(0, np.int64)])
        order = np.argsort(code, kind="stable")
        self.item, self.pos = item[order].astype(np.int64), pos[order].astype(np.int64)
        self.code, self.first = np.unique(code[order], return_index=True)
        self.end = np.append(self.first[1:], len(code))
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self.slot(self.code)] = True
        sizes = [min(SEGMENT, len(t)) for t in self.texts] or [SEGMENT]
        self.need = min(m - Q + 1 - Q * budget(m) for m in sizes)
        self.span = max(sizes) - Q + 1 + EDITS

    @staticmethod
    def slot(code: np.ndarray) -> np.ndarray:
        return (code * np.uint64(_BASE)) >> np.uint64(42)

    def search(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, first character, segments found, least edits) for each item that the text holds."""
        norm = normal(text)
        out: dict[int, list[int]] = {}
        if self.words:
            for m in self.words.finditer(norm):
                place, found = m.start(1), m.group(1)
                while found:  # shorter items may begin at the same place
                    if found in self.short and re.match(r"\w", norm[place + len(found) : place + len(found) + 1]) is None:
                        for i in self.short[found]:
                            out.setdefault(i, [place, 1, 0])
                    found = found[:-1]
        if self.ids and norm:
            for i, found in self._segments(letters(norm)).items():
                begin, n, edits = min(b for b, _ in found.values()), len(found), min(e for _, e in found.values())
                old = out.setdefault(self.ids[i], [begin, 0, edits])
                out[self.ids[i]] = [min(old[0], begin), old[1] + n, min(old[2], edits)]
        return [(i, *o) for i, o in sorted(out.items())]

    def _segments(self, x: np.ndarray) -> dict[int, dict[int, tuple[int, int]]]:
        """For each item found: its segments (by start) with the place in the text and the edits."""
        code = grams(x)
        out: dict[int, dict[int, tuple[int, int]]] = {}
        if len(code) < self.need:
            return out
        hit = self.bits[self.slot(code)]
        total = np.concatenate([[0], np.cumsum(hit)])
        n = min(self.span, len(code))
        dense = np.flatnonzero(total[n:] - total[:-n] >= self.need)
        if not len(dense):
            return out
        mark = np.zeros(len(code) + 1, np.int32)
        np.add.at(mark, dense, 1)
        np.add.at(mark, dense + n, -1)
        inside = np.concatenate([[False], np.cumsum(mark[:-1]) > 0, [False]])
        for a, b in zip(np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1]), strict=True):
            where = np.flatnonzero(hit[a:b]) + a
            slot = np.searchsorted(self.code, code[where])
            slot[slot == len(self.code)] = 0
            good = self.code[slot] == code[where]
            if good.sum() >= self.need:
                self._region(x, code, where[good], slot[good], out)
        return out

    def _pairs(self, where: np.ndarray, slot: np.ndarray):
        """(place in the text, item, place in the item) of equal q-grams, SLICE at a time or those of one place."""
        many = self.end[slot] - self.first[slot]
        upto = np.cumsum(many)
        a = 0
        while a < len(where):
            b = max(a + 1, int(np.searchsorted(upto, upto[a] - many[a] + SLICE, "right")))
            m = many[a:b]
            post = np.repeat(self.first[slot[a:b]] - np.cumsum(m) + m, m) + np.arange(m.sum())
            yield np.repeat(where[a:b], m), self.item[post], self.pos[post]
            a = b

    def _region(self, x: np.ndarray, code: np.ndarray, where: np.ndarray, slot: np.ndarray, out: dict) -> None:
        half = EDITS + 1
        shares = np.zeros(len(self.ids), np.int64)
        for _, item, _ in self._pairs(where, slot):
            shares += np.bincount(item, minlength=len(self.ids))
        items = np.flatnonzero(shares >= self.need)
        longest = max((len(self.codes[i]) for i in items), default=0)
        low, bands = int(where[0]) - longest, (int(where[-1]) - int(where[0]) + longest) // half + 3
        for k in range(0, len(items), group := max(1, SLICE // bands)):
            own = items[k : k + group]
            local = np.full(len(self.ids), -1)
            local[own] = np.arange(len(own))
            count = np.zeros(len(own) * bands, np.int64)
            for at, item, pos in self._pairs(where, slot):
                mine = local[item] >= 0
                count += np.bincount(local[item[mine]] * bands + (at[mine] - pos[mine] - low) // half, minlength=len(count))
            count = count.reshape(len(own), bands)
            both = count[:, :-1] + count[:, 1:]
            for i, band in zip(*np.nonzero(both >= self.need), strict=True):
                self._band(x, code, int(own[i]), low + int(band) * half, out)

    def _band(self, x: np.ndarray, code: np.ndarray, i: int, low: int, out: dict) -> None:
        """Segments of item i that the text holds along the diagonals low .. low + 2 * half - 1."""
        half, own, gram = EDITS + 1, self.texts[i], self.codes[i]
        m = min(SEGMENT, len(own))
        e = budget(m)
        same = np.zeros(len(gram), bool)
        for d in range(low, low + 2 * half):
            a, b = max(0, -d), min(len(gram), len(code) - d)
            if a < b:
                same[a:b] |= gram[a:b] == code[a + d : b + d]
        total = np.concatenate([[0], np.cumsum(same)])
        starts = np.array(sorted({*range(0, len(own) - m, STEP), len(own) - m}))
        shared = total[starts + m - Q + 1] - total[starts]
        found = out.get(i, {})
        for p in starts[shared >= m - Q + 1 - Q * e].tolist():
            if p in found:
                continue
            begin = low + half + p - half - e
            piece = x[max(0, begin) : max(0, begin + m + 2 * half + 4 * e + 1)].astype(np.int64)
            edits = align(own[p : p + m].astype(np.int64), np.concatenate([np.full(max(0, -begin), -1, np.int64), piece]), e, half + e)
            if edits <= e:
                out.setdefault(i, found)[p] = (max(0, low + p), edits)


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text"):
    """Index after index, each over a block of items."""
    b = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("item_id is not null and text is not null")
    total = b.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // BLOCK)
    for k in range(n):
        rows = b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield Index(sorted({(r.item_id, t) for r in rows if (t := normal(r.text))}))


def _search(docs: DataFrame, index: Index, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for m in index.search(t.as_py())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "item_id", "start", "n_segments", "edits"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id long, {OUT}")


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, start, n_segments, edits) for each document and item found in it.

    `start` is the first character in the lower-cased text with single spaces, give or take the band's width.
    """
    out = None
    for index in blocks(benchmark):
        found = _search(docs, index, id_col, text_col)
        if out is not None:  # several blocks: each is done and stored before the next is read
            found = stored(found)
        out = found if out is None else out.union(found)
    return docs.sparkSession.createDataFrame([], f"doc_id long, {OUT}") if out is None else out


def _leaks(index: Index):
    @F.arrow_udf(T.BooleanType())
    def leaks(texts: pa.Array) -> pa.Array:
        return pa.array([bool(index.search(t.as_py())) for t in texts], pa.bool_())

    return leaks


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no benchmark segment; all columns stay, nothing is shuffled."""
    for k, index in enumerate(blocks(benchmark)):
        if k:  # several blocks: no task holds two of them
            docs = stored(docs)
        docs = docs.where(~_leaks(index)(F.coalesce(F.col(text_col), F.lit(""))))
    return docs

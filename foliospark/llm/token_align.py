"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Both tokenizers cut the bytes of `space + text`; a token is known by the byte offset at which it ends. The shorter list
of ends is looked up in the longer one by galloping (doubled steps from the last find, then binary search between the
last two probes). Common ends cut the text into groups; the differences of ranks give the range of tokens that a token
of the shorter list overlaps. A pair of tokens that end together is a link.

Links are counted over the whole corpus: tasks write tiles of documents with the dictionary of the tile's distinct
pairs, only dictionaries are shuffled to be summed up, and each tile gets back the sums of its own dictionary.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import stored

#: Where the public vocabularies are; read by the driver alone and sent with the code (about 2 MB).
VOCABULARIES = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Fixed value: the pattern by which byte-level tokenizers of this kind cut a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Links a tile gathers before it is written; a longer document is a tile of its own. Bytes of text aligned at once.
TILE, SLICE = 1 << 20, 1 << 20


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 is itself, the others follow."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def byte_tokenizer(byte_bpe: bytes):
    """A byte-level tokenizer from the content of its file, and its tokens' ids by their bytes; special tokens are left out."""
    import tiktoken

    raw = json.loads(byte_bpe)
    special = {t["id"] for t in raw["added_tokens"] if t["special"]}
    byte_of = _byte_of()
    ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in raw["model"]["vocab"].items() if i not in special}
    return tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}), ranks


class Pair:
    """Both tokenizers, made from the contents of their files, with each id's bytes."""

    def __init__(self, byte_bpe: bytes, piece_bpe: bytes):
        import sentencepiece

        self.a, ranks = byte_tokenizer(byte_bpe)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_bpe)
        self.a_bytes = [b""] * (1 + max(ranks.values()))
        for t, i in ranks.items():
            self.a_bytes[i] = t
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.b.vocab_size()) for p in [self.b.id_to_piece(i)]]
        self.a_len, self.b_len = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        most = max(len(self.a_bytes), len(self.b_bytes)) - 1
        names = np.array([str(i).encode() for i in range(most + 1)], f"S{len(str(most))}")
        #: Each id in decimal digits: their number, and the digits left-aligned, with room for a sign.
        self.width = np.char.str_len(names)
        self.digits = np.zeros((most + 1, len(str(most)) + 1), np.uint8)
        self.digits[:, :-1] = names.view(np.uint8).reshape(most + 1, -1)

    def encode(self, texts: list[bytes | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of space + text by both; none where the text is null, empty, or not what the tokens' bytes spell."""
        plain = []
        for t in texts:
            try:
                plain.append((t or b"").decode())
            except UnicodeDecodeError:
                plain.append("")
        ids_a = [self.a.encode_ordinary(" " + t) if t else [] for t in plain]
        ids_b = self.b.encode(plain, num_threads=1)
        for k, (t, a, b) in enumerate(zip(texts, ids_a, ids_b, strict=True)):
            if a and (b"".join(map(self.a_bytes.__getitem__, a)) != (whole := b" " + t) or b"".join(map(self.b_bytes.__getitem__, b)) != whole):
                ids_a[k] = []
        return [np.array(a, np.int64) for a in ids_a], [np.array(b if a else [], np.int64) for a, b in zip(ids_a, ids_b, strict=True)]


def gallop(short: np.ndarray, long: np.ndarray, steps: int = 64) -> np.ndarray:
    """For each value of short its first index in long that is not smaller. Both ascend; long's last is no smaller than short's.

    The values are taken in strips of `steps` (2 or more). All strips walk on together: each doubles its step from where it found
    its last value, until it is past the next one, and then halves the gap. Strips start where their first values are
    found, by the same search over the first values alone.
    """
    n, last = len(short), len(long) - 1
    if n == 0:
        return np.empty(0, np.int64)
    out = np.empty(n, np.int64)
    heads = np.arange(0, n, steps)
    at = gallop(short[heads], long, steps) if len(heads) > 1 else np.zeros(1, np.int64)
    for k in range(min(steps, n)):
        rows = heads[heads + k < n] + k
        value, low = short[rows], at[: len(rows)]
        high, step = low, 1
        behind = long[high] < value
        while behind.any():
            low = np.where(behind, high + 1, low)
            high = np.where(behind, np.minimum(high + step, last), high)
            step *= 2
            behind &= long[high] < value
        while (low < high).any():
            middle = (low + high) >> 1
            less = long[middle] < value
            low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
        out[rows] = at[: len(rows)] = low
    return out


class Aligned:
    """Tokens of many documents end to end, and the places where both cut."""

    def __init__(self, tokenizers: Pair, texts: list[bytes | None]):
        self.tokenizers = tokenizers
        a, b = tokenizers.encode(texts)
        self.n_a, self.n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a, b))
        self.a, self.b = (np.concatenate([np.empty(0, np.int64), *ids]) for ids in (a, b))
        ends = np.cumsum(tokenizers.a_len[self.a]), np.cumsum(tokenizers.b_len[self.b])
        self.a_at, self.b_at = (np.concatenate([[0], np.cumsum(n)]) for n in (self.n_a, self.n_b))
        at = list(zip(self.a_at, self.a_at[1:], self.b_at, self.b_at[1:], strict=False))
        #: Of each document the shorter list is looked up in the longer one.
        self.swapped = self.n_a > self.n_b
        short = [ends[s][(f0, f1)[s] : (t0, t1)[s]] for s, (f0, t0, f1, t1) in zip(self.swapped.astype(int), at, strict=True)]
        long = [ends[1 - s][(f0, f1)[1 - s] : (t0, t1)[1 - s]] for s, (f0, t0, f1, t1) in zip(self.swapped.astype(int), at, strict=True)]
        self.short_at = np.concatenate([[0], np.cumsum(np.minimum(self.n_a, self.n_b))])
        self.long_at = np.concatenate([[0], np.cumsum(np.maximum(self.n_a, self.n_b))])
        empty = np.empty(0, np.int64)
        short, long = np.concatenate([empty, *short]), np.concatenate([empty, *long])
        self.rank = gallop(short, long)
        self.common = long[self.rank] == short
        rows = np.flatnonzero(self.common)
        doc = np.searchsorted(self.short_at, rows, "right") - 1
        self.n_groups = np.bincount(doc, minlength=len(texts))
        self.at = np.concatenate([[0], np.cumsum(self.n_groups)])
        s, l, swap = rows - self.short_at[doc], self.rank[rows] - self.long_at[doc], self.swapped[doc]
        #: The last tokens of each group, counted from the start of all tokens.
        self.a_cut, self.b_cut = np.where(swap, l, s) + self.a_at[doc], np.where(swap, s, l) + self.b_at[doc]

    def overlaps(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last token of document k's longer list that each token of its shorter one overlaps."""
        rank = self.rank[self.short_at[k] : self.short_at[k + 1]] - self.long_at[k]
        common = self.common[self.short_at[k] : self.short_at[k + 1]]
        return np.concatenate([[0], rank[:-1] + common[:-1]])[: len(rank)], rank

    def pairs(self) -> np.ndarray:
        """The links, as A id * 2 ** 32 + B id."""
        return (self.a[self.a_cut] << 32) | self.b[self.b_cut]

    def groups(self) -> list[bytes]:
        """`a1,a2|b1;a3|b2,b3` for each document."""
        n_a, n_b, n = len(self.a), len(self.b), len(self.a_cut)
        if not n:
            return [b""] * len(self.n_a)
        group_a = np.concatenate([[0], np.cumsum(np.bincount(self.a_cut, minlength=n_a))])[:-1]
        group_b = np.concatenate([[0], np.cumsum(np.bincount(self.b_cut, minlength=n_b))])[:-1]
        place_a = np.arange(n_a) + np.concatenate([[0], self.b_cut + 1])[group_a]
        place_b = np.arange(n_b) + self.a_cut[group_b] + 1
        ids, sign = np.empty(n_a + n_b, np.int64), np.full(n_a + n_b, ord(","), np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        sign[place_a[self.a_cut]], sign[place_b[self.b_cut]] = ord("|"), ord(";")
        text, width = self.tokenizers.digits[ids], self.tokenizers.width[ids]
        text[np.arange(len(ids)), width] = sign
        flat = text[text > 0].tobytes()
        ends = np.concatenate([[0], np.cumsum(width + 1)])[self.a_at + self.b_at]
        return [flat[s : max(s, e - 1)] for s, e in zip(ends, ends[1:], strict=False)]


def content(path: str, name: str) -> bytes:
    """A vocabulary file, read by the driver."""
    with open(f"{path}/{name}", "rb") as f:
        return f.read()


def _parts(batches: Iterator[pa.RecordBatch], files: tuple[bytes, bytes]) -> Iterator[tuple[pa.RecordBatch, Aligned]]:
    """Rows of about SLICE bytes of text (a longer one alone, and whole) with their alignment."""
    tokenizers = Pair(*files)
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary()).to_pylist()
        start, size = 0, 0
        for k, t in enumerate(texts):
            if size and size + len(t or b"") > SLICE:
                yield batch.slice(start, k - start), Aligned(tokenizers, texts[start:k])
                start, size = k, 0
            size += len(t or b"")
        if start < len(texts):
            yield batch.slice(start), Aligned(tokenizers, texts[start:])


def align(docs: DataFrame, path: str = VOCABULARIES, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """(doc_id, a_ids, b_ids, a_cuts, b_cuts, shorter, first, last) for every row of docs (doc_id, text).

    a_cuts and b_cuts have the index of each group's last token; `first` and `last` the tokens of the longer list that
    each token of the shorter one ('a' or 'b'; 'a' where both are as long) overlaps. Texts that are null, empty, or not
    what the tokens spell have empty arrays. Rows are kept as they are: repeated or null ids do no harm, other columns
    are left out. Very long texts are aligned whole, alone.
    """
    files = content(path, byte_bpe), content(path, piece_bpe)

    def rows(batches):
        for part, al in _parts(batches, files):
            lists = [[] for _ in range(6)]
            for k in range(part.num_rows):
                a, b, g = (slice(x[k], x[k + 1]) for x in (al.a_at, al.b_at, al.at))
                for out, x in zip(lists, (al.a[a], al.b[b], al.a_cut[g] - al.a_at[k], al.b_cut[g] - al.b_at[k], *al.overlaps(k)), strict=True):
                    out.append(x.astype(np.int32))
            shorter = pa.array(["b" if s else "a" for s in al.swapped], pa.string())
            a_ids, b_ids, a_cuts, b_cuts, first, last = (pa.array(x, pa.list_(pa.int32())) for x in lists)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), a_ids, b_ids, a_cuts, b_cuts, shorter, first, last], ["doc_id", "a_ids", "b_ids", "a_cuts", "b_cuts", "shorter", "first", "last"])

    ints = "array<int>"
    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, a_ids {ints}, b_ids {ints}, a_cuts {ints}, b_cuts {ints}, shorter string, first {ints}, last {ints}")


def _tiles(batches: Iterator[pa.RecordBatch], files: tuple[bytes, bytes]) -> Iterator[pa.RecordBatch]:
    """One row for documents of about TILE links: per document its figures and distinct pairs, as slots of the dictionary."""
    held, links, number = [], 0, 0

    def tile():
        pairs = np.concatenate([al.pairs() for _, al in held])
        n_links = np.concatenate([al.n_groups for _, al in held])
        dictionary, slot, total = np.unique(pairs, return_inverse=True, return_counts=True)
        own, times = np.unique(np.repeat(np.arange(len(n_links)), n_links) * max(1, len(dictionary)) + slot, return_counts=True)
        doc, slot = np.divmod(own, max(1, len(dictionary)))
        ids = pa.concat_arrays([part.column("doc_id") for part, _ in held])
        figures = [np.concatenate([getattr(al, name) for _, al in held]) for name in ("n_a", "n_b", "n_groups")]
        row = {
            "tile": pa.array([(TaskContext.get().partitionId() << 32) + number], pa.int64()), "dictionary": _one(pa.array(dictionary)), "totals": _one(pa.array(total)),
            "doc_ids": _one(ids), **{name: _one(pa.array(x)) for name, x in zip(("n_a", "n_b", "n_groups"), figures, strict=True)}, "sha": _one(pa.array(digests, pa.string())),
            "sizes": _one(pa.array(np.bincount(doc, minlength=len(n_links)))), "slots": pa.array([slot.astype(np.int32).tobytes()], pa.binary()), "times": pa.array([times.astype(np.int32).tobytes()], pa.binary()),
        }
        return pa.RecordBatch.from_arrays(list(row.values()), list(row))

    digests = []
    for part, al in _parts(batches, files):
        digests += [hashlib.sha256(g).hexdigest() if g else "" for g in al.groups()]
        held.append((part, al))
        links += len(al.a_cut)
        if links >= TILE:
            yield tile()
            held, digests, links, number = [], [], 0, number + 1
    if held:
        yield tile()


def _one(values: pa.Array) -> pa.Array:
    """A list column of a single row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _scored(tile: pa.Table, counts: pa.Table) -> pa.Table:
    """A tile's documents with their sums over the corpus-wide counts of the tile's dictionary."""
    row = {c: tile.column(c)[0] for c in tile.column_names}
    place = counts.column("pos").to_numpy()
    count, best = np.zeros((2, len(place)), np.int64)
    count[place], best[place] = counts.column("n").to_numpy(), counts.column("best").cast(pa.int64()).to_numpy()
    slot, times = (np.frombuffer(row[c].as_py(), np.int32) for c in ("slots", "times"))
    doc = np.repeat(np.arange(len(row["sizes"])), row["sizes"].values.to_numpy())

    def total(values):
        out = np.zeros(len(row["sizes"]), np.int64)
        np.add.at(out, doc, values[slot] * times)
        return pa.array(out)

    own = {c: row[c].values for c in ("doc_ids", "n_a", "n_b", "n_groups", "sha")}
    return pa.table([own["doc_ids"], own["n_a"], own["n_b"], own["n_groups"], own["n_groups"], total(best), total(count), own["sha"]], FIGURES)


FIGURES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def link_figures(docs: DataFrame, path: str = VOCABULARIES, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of docs (doc_id, text).

    A link's count is the number of links in all of docs with its two ids; n_best is how many of a document's links
    have the highest count of their B id (ties included), count_sum the sum over its links. groups_sha256 digests the
    groups as `a1,a2|b1;a3|b2,b3`. Rows without tokens (see `align`) have zeros and the digest ''.
    Every row counts, repeated ones too; other columns are left out. An empty table gives an empty result.

    A tile holds about TILE links or one document, so that memory is bounded by the longest text.
    """
    files, kind = (content(path, byte_bpe), content(path, piece_bpe)), docs.schema["doc_id"].dataType.simpleString()
    longs = "array<bigint>"
    tiles = stored(docs.select("doc_id", "text").mapInArrow(lambda batches: _tiles(batches, files), f"tile bigint, dictionary {longs}, totals {longs}, doc_ids array<{kind}>, n_a {longs}, n_b {longs}, n_groups {longs}, sha array<string>, sizes {longs}, slots binary, times binary"))
    counts = stored(tiles.select(F.explode(F.arrays_zip("dictionary", "totals")).alias("x")).groupBy(F.col("x.dictionary").alias("pair")).agg(F.sum("x.totals").alias("n")))
    of_b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")
    # one row for each B id that occurs: the size of a vocabulary
    highest = F.broadcast(counts.groupBy(of_b).agg(F.max("n").alias("most")))
    ranked = counts.withColumn("b", of_b).join(highest, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    back = tiles.select(F.col("tile").alias("home"), F.posexplode("dictionary").alias("pos", "pair")).join(ranked.hint("merge"), "pair").select("home", "pos", "n", "best")
    out = f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in FIGURES[1:-1]) + ", groups_sha256 string"
    return tiles.drop("dictionary", "totals").groupBy("tile").cogroup(back.groupBy("home")).applyInArrow(_scored, out)

"""SimHash near-duplicates by anchor-point covering.

Two fingerprints within 4 bits agree to within 2 bits in one of their 32-bit halves, so some word lies
within 1 bit of both halves. The anchors of a half are the words of a covering code of radius 1: a
Hamming code on 31 bits, with the last bit free. Every half is therefore replicated to all anchors within
covering radius plus one bit (2 bits; 17 anchors at most), and any linked pair meets at an anchor.

Equal fingerprints are merged first, so copies never multiply. Fingerprints of an anchor arrive sorted and
are compared in numpy; a larger cluster gives a spanning tree, not all its pairs. An anchor with more than
`HOT` fingerprints is dealt again, in pairs of blocks, so that no task holds it whole.

Null and blank texts have fingerprint zero and are linked like any other. Rows with a null id are linked
too, but a component is named by its smallest id that is not null; `one_of_each` needs no ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import hot_join, row_key, stored
from .components import components

WORDS, BITS, HOT = 4, 4, 8192
_SHIFTS = np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Bit i is set when over half the shingle hashes have it set; repeats count, no words give zero."""
    found = (text or "").encode().lower().split()  # on bytes, lower() and split() know ASCII only
    if not found:
        return 0
    whole, ends = b" ".join(found), np.cumsum([len(w) + 1 for w in found]).tolist()
    starts = [0, *ends[:-1]]
    n = max(1, len(found) - words + 1)
    ends = ends[words - 1 :] or ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(whole[s : e - 1], 42) for s, e in zip(starts[:n], ends, strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 65536):
        counts += np.unpackbits(hashes[k : k + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((2 * counts > n).astype(np.uint64) << _SHIFTS).sum())


@F.arrow_udf(T.LongType())
def fingerprint_col(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64))


def _anchors(half: np.ndarray) -> np.ndarray:
    """(n, 17) anchors within 2 bits of each 32-bit word, repeated where there are fewer."""
    code, at = half & np.uint64(0x7FFFFFFF), np.arange(1, 32, dtype=np.uint64)
    syndrome = np.zeros_like(code)
    for i in at:
        syndrome ^= np.where((code >> (i - np.uint64(1))) & np.uint64(1), i, np.uint64(0))
    bit = lambda p: np.where(p > 0, np.uint64(1) << (np.maximum(p, 1) - np.uint64(1)), np.uint64(0))
    nearest = half ^ bit(syndrome)
    other = syndrome[:, None] ^ at[None, :]
    pairs = half[:, None] ^ bit(np.broadcast_to(at, other.shape)) ^ bit(other)
    good = (syndrome[:, None] > 0) & (other > at[None, :])
    order = np.argsort(~good, axis=1, kind="stable")[:, :15]
    pairs = np.where(np.take_along_axis(good, order, 1), np.take_along_axis(pairs, order, 1), nearest[:, None])
    return np.column_stack([nearest, nearest ^ np.uint64(1 << 31), pairs])


def _replicate(batches):
    for b in batches:
        fp = b.column(0).to_numpy().view(np.uint64)
        for k in range(0, len(fp), 4096):
            part = fp[k : k + 4096]
            for side in (0, 1):
                half = (part >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFF)
                keys = np.sort(_anchors(half), axis=1)
                new = np.column_stack([np.ones(len(keys), bool), keys[:, 1:] != keys[:, :-1]])
                key = (keys << np.uint64(1) | np.uint64(side))[new]
                own = np.broadcast_to(part[:, None], keys.shape)[new]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(own.view(np.int64))], ["key", "fp"])


def _tree(fp: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what lies within BITS of each other, at most one for each fingerprint."""
    edges, left, queue = [], fp, []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= BITS
            if near.any():
                found, left = left[near], left[~near]
                edges += [(x, y) for y in found]
                queue += list(found)
    return edges


def _runs(batches, n_keys: int):
    """(columns, run starts, is a piece) of sorted batches, whole runs only; with one key, runs over HOT come in pieces."""
    rest = None
    for b in _with_end(batches):
        cols = None if b is None else [c.to_numpy() for c in b.columns]
        if rest is not None:
            cols = rest if cols is None else [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        if cols is None or not len(cols[0]):
            continue
        change = np.zeros(len(cols[0]), bool)
        change[0] = True
        for c in cols[:n_keys]:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        last = len(cols[0]) if b is None else starts[-1]
        if last:
            yield [c[:last] for c in cols], starts[starts < last], False
        rest = [c[last:] for c in cols]
        if n_keys == 1 and len(rest[0]) > HOT:
            yield rest, np.array([0]), True
            rest = [c[:0] for c in rest]


def _with_end(batches):
    yield from batches
    yield None


def _links(cols: list[np.ndarray], starts: np.ndarray) -> list[np.ndarray]:
    """Pairs of linked fingerprints inside runs: short runs by shifting the whole column, longer ones as trees."""
    fp, n = cols[-1].view(np.uint64), len(cols[0])
    length = np.diff(np.append(starts, n))
    run = np.repeat(np.arange(len(starts)), length)
    short = (length <= 8)[run]
    out = [np.empty((0, 2), np.uint64)]
    for lag in range(1, 8):
        if lag >= n:
            break
        i = np.flatnonzero((run[lag:] == run[:-lag]) & short[lag:])
        if not len(i):
            break
        i = i[np.bitwise_count(fp[i] ^ fp[i + lag]) <= BITS]
        out.append(np.column_stack([fp[i], fp[i + lag]]))
    for r in np.flatnonzero(length > 8):
        if edges := _tree(fp[starts[r] : starts[r] + length[r]]):
            out.append(np.array(edges, np.uint64))
    return out


def _compare(batches):
    """Edges (key null), and the members of anchors over HOT as (key, fp) to be dealt again."""
    hot_key = None
    for cols, starts, piece in _runs(batches, 1):
        key, fp = cols
        first = key[: len(key) if len(starts) < 2 else starts[1]]
        if piece or (hot_key is not None and first[0] == hot_key):
            yield pa.RecordBatch.from_arrays([pa.array(key[: len(first)]), pa.array(fp[: len(first)]), pa.nulls(len(first), pa.int64())], ["key", "a", "b"])
            hot_key = first[0]
            cols, starts = [c[len(first) :] for c in cols], starts[1:] - len(first)
            if piece or not len(cols[0]):
                continue
        for pairs in _links(cols, starts):
            if len(pairs):
                pairs = pairs.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["key", "a", "b"])


def _compare_blocks(batches):
    for cols, starts, _ in _runs(batches, 3):
        for pairs in _links(cols, starts):
            if len(pairs):
                pairs = pairs.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])


def fingerprint_edges(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints fps(fp) within BITS of each other, over each anchor a spanning set."""
    at_anchor = fps.select("fp").mapInArrow(_replicate, "key long, fp long")
    found = stored(at_anchor.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_compare, "key long, a long, b long"))
    hot = found.where("key is not null").select("key", F.col("a").alias("fp"))
    blocks = hot.groupBy("key").agg(F.ceil(F.count("*") / HOT).cast("int").alias("n"))
    own = hot.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("fp"), "n").cast("int"))
    dealt = own.select("key", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"), "fp").select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    more = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp").mapInArrow(_compare_blocks, "a long, b long")
    return found.where("key is null").select("a", "b").union(more)


def _roots(reps: DataFrame) -> DataFrame:
    """reps, a row for each fingerprint fp, with the root of its component; a fingerprint without links is its own."""
    roots = components(fingerprint_edges(reps))
    return reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id), a row for each row of docs."""
    own = stored(docs.select(F.col(id_col).alias("doc_id"), fingerprint_col(F.coalesce(F.col(text_col), F.lit(""))).alias("fp")))
    linked = stored(_roots(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))).select("fp", "least", "n", "root"))
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    name_of = hot_join(linked.withColumnRenamed("n", "copies"), named, ["root"], ["fp"]).select("fp", "component_id", F.col("copies").alias("n"))
    return hot_join(own, name_of, ["fp"], ["doc_id"]).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component one row of docs: the first by id (null last), then by hashes of the text and of the whole row.

    Rows are told apart by 128 bits over all their columns, so rows with a null or repeated id count like any other.
    """
    keyed = docs.withColumns(row_key(docs))
    order = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"), F.col("_row_a").alias("a"), F.col("_row_b").alias("b"))
    own = stored(keyed.select(order.alias("row"), fingerprint_col(F.coalesce(F.col(text_col), F.lit(""))).alias("fp")))
    reps = _roots(stored(own.groupBy("fp").agg(F.min("row").alias("row"))))
    keep = reps.groupBy("root").agg(F.min("row").alias("row")).select(F.col("row.a").alias("_row_a"), F.col("row.b").alias("_row_b"))
    return keyed.join(keep, ["_row_a", "_row_b"], "left_semi").dropDuplicates(["_row_a", "_row_b"]).select(*[f"`{c}`" for c in docs.columns])

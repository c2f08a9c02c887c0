"""Language identification with error-correcting output codes.

Every language has a codeword; each bit has a binary naive Bayes classifier over hashed byte n-grams of the
lower-cased text. A text's mean log ratio for a bit, centred and scaled by the languages' own expected values,
is the bit's margin. Loss-weighted decoding sums the logistic losses of a codeword's bits, weighted by how far
the bit separates the languages; the least loss wins, and a small lead over the next is flagged `ambiguous`.

Counts are gathered over a bounded hash sample of the labelled documents, as partial sums in Spark. Texts that
are null or without a letter are `und` with score 0. With no labelled document everything is `und`; with one
learned language every text with a letter is in it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import buffers, held_out, slices

#: Bound of the fitting sample per language in documents, bins of the hash, n-gram lengths, least lead.
SAMPLE, BINS, LENGTHS, LEAD = 3000, 1 << 15, (2, 3), 0.2

_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[[i for i in range(128) if not chr(i).isalpha()]] = 32


def codewords(n: int) -> np.ndarray:
    """(n, bits) of +-1: all distinct splits for up to 7 languages, else seeded columns that hold both signs."""
    if n <= 7:
        columns = [[1] + [1 if k >> i & 1 else -1 for i in range(n - 1)] for k in range(2 ** (n - 1) - 1)]
        return np.array(columns, np.int8).reshape(-1, n).T
    bits = 4 * math.ceil(math.log2(n)) + 3
    draw = np.random.default_rng(7).permuted(np.tile(np.resize([1, -1], n)[:, None], bits), axis=0)
    return draw.astype(np.int8)


def bins(texts: pa.Array):
    """Slices of rows as (first row, row offsets, [bins of each n-gram length]); bin 0 stands where no n-gram lies inside a row."""
    raw, at = buffers(pc.utf8_lower(texts))
    for a, b in slices(at):
        x, own = _TABLE[raw[at[a] : at[b]]].astype(np.uint32), at[a : b + 1] - at[a]
        out = []
        for n in LENGTHS:
            if len(x) < n:
                out.append(np.zeros(len(x), np.uint32))
                continue
            code = np.zeros(len(x) - n + 1, np.uint32)
            for k in range(n):
                code = (code << np.uint32(8)) | x[k : len(x) - n + 1 + k]
            h = np.zeros(len(x), np.uint32)
            h[: len(code)] = 1 + ((code * np.uint32(0x9E3779B1) + np.uint32(n)) >> np.uint32(17)) % np.uint32(BINS - 1)
            for k in range(1, n):  # n-grams that would run into the next row
                last = own[1:] - k
                h[last[last >= own[:-1]]] = 0
            out.append(h)
        yield a, own, out


def _count(batches):
    total: dict[str, np.ndarray] = {}
    for b in batches:
        lang = np.array(b.column("lang").to_pylist(), object)
        for a, own, hashes in bins(b.column("text")):
            rows = lang[a : a + len(own) - 1]
            for value in dict.fromkeys(rows):
                inside = np.repeat(rows == value, np.diff(own))
                c = total.setdefault(value, np.zeros(len(LENGTHS) * BINS, np.int64))
                for j, h in enumerate(hashes):
                    c[j * BINS : (j + 1) * BINS] += np.bincount(h[inside], minlength=BINS)
    for value, c in total.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([value] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "bin", "n"])


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray):
        """counts: (languages, lengths * BINS)."""
        self.langs = langs
        if len(langs) < 2:
            return
        self.code = codewords(len(langs))
        p = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
        w = np.zeros((p.shape[1], self.code.shape[1]))
        for b in range(self.code.shape[1]):
            up = self.code[:, b] > 0
            w[:, b] = np.clip(np.log(p[up].mean(axis=0) / p[~up].mean(axis=0)), -4, 4)
        w[np.arange(len(LENGTHS)) * BINS] = 0
        usual = p @ w  # (languages, bits): the margins to expect
        low = np.array([usual[self.code[:, b] > 0, b].min() for b in range(w.shape[1])])
        high = np.array([usual[self.code[:, b] < 0, b].max() for b in range(w.shape[1])])
        gap = np.maximum(low - high, 1e-3)
        self.centre, self.scale, self.trust = (low + high) / 2, 6 / gap, gap / gap.sum() if len(gap) else gap
        self.table = w.reshape(len(LENGTHS), BINS, -1).astype(np.float32)

    def __call__(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        n = len(texts)
        letters = pc.match_substring_regex(texts, r"\pL").fill_null(False).to_numpy(zero_copy_only=False)
        if len(self.langs) < 2:
            return [self.langs[0] if self.langs and x else "und" for x in letters], letters.astype(float) * bool(self.langs), np.zeros(n, bool)
        margin, grams = np.zeros((n, self.code.shape[1])), np.zeros(n)
        for a, own, hashes in bins(texts):
            full = np.flatnonzero(np.diff(own))
            if not len(full):
                continue
            for j, h in enumerate(hashes):
                margin[a + full] += np.add.reduceat(self.table[j][h], own[full], axis=0)
                grams[a + full] += np.add.reduceat((h > 0).astype(np.int64), own[full])
        margin = margin / np.maximum(grams, 1)[:, None]
        f = (margin - self.centre) * self.scale * np.sqrt(np.minimum(1, grams / 200))[:, None]
        loss = (np.logaddexp(0, -f[:, None, :] * self.code[None]) * self.trust).sum(axis=2)
        best, ordered = loss.argmin(axis=1), np.sort(loss, axis=1)
        share = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
        score = np.where(letters, 1 / share.sum(axis=1), 0.0)
        return [self.langs[i] if x else "und" for i, x in zip(best, letters, strict=True)], score, letters & (ordered[:, 1] - ordered[:, 0] < LEAD)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    have = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not have:
        return Model([], np.zeros((0, len(LENGTHS) * BINS)))
    rate = F.element_at(F.create_map(*(F.lit(x) for k, n in sorted(have.items()) for x in (k, min(1.0, SAMPLE / n)))), F.col("lang"))
    place = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 63) - 1)) / float(1 << 63)
    sample = known.where(place <= rate).select("text", "lang")
    rows = sample.mapInArrow(_count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    counts = np.zeros((len(langs), len(LENGTHS) * BINS))
    counts[rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int), rows["bin"].to_numpy(int)] = rows["n"].to_numpy()
    return Model(langs, counts)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous."""
    model = train(docs, id_col, text_col, lang_col)  # BINS rows for each bit of a codeword

    @F.arrow_udf("struct<lang_pred:string,score:double,ambiguous:boolean>")
    def predict(texts: pa.Array) -> pa.Array:
        langs, score, ambiguous = model(texts)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(score), pa.array(ambiguous)], ["lang_pred", "score", "ambiguous"])

    out = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), predict(F.coalesce(F.col(text_col), F.lit(""))).alias("p"))
    return out.select("doc_id", "held_out", "p.*")

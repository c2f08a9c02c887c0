"""Source divergence audit: how the sources of each language differ in their use of terms.

Strings come late. Only 64-bit digests of terms are counted and shuffled, one row for each group and digest. Digests of
terms that are frequent enough get their smallest and their largest string; where these differ, two terms share the
digest, and it is split by counting its terms as strings. Texts are joined back to the rows that are given out alone.

Shares are integers in billionths with 5 added to each count, so that all results are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import ascii_lower, stored

#: A term is a run of ASCII letters and all characters beyond ASCII; what stands between terms.
TERM, BETWEEN = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of its language in which a term must stand; added to each count; terms listed of each group.
LEAST_DOCS, ADDED, LISTED = 30, 5, 50
#: Cells (terms x sources) that one task compares at once.
CELLS = 1 << 21
#: So many digests (8 bytes each, about 50 MB in a join) may be sent to all tasks; beyond, tables are joined by shuffle.
SENT = 1 << 20


def _terms(docs: DataFrame) -> DataFrame:
    text = F.array_remove(F.split(ascii_lower(F.col("text")), BETWEEN), "")
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), text.alias("terms"))


def _digest(term: Column, bits: int) -> Column:
    return _cut(F.xxhash64(term), bits)


def _cut(digest: Column, bits: int) -> Column:
    return digest if bits == 64 else digest.bitwiseAND(F.lit((1 << bits) - 1))


def _counted(words: DataFrame, bits: int, least: int) -> DataFrame:
    """(lang, source, d, n) of digests in at least `least` documents of their language; n occurrences.

    A document gives two lists, its digests and its different digests, and both are counted in one pass.
    """
    digests = words.select("lang", "source", F.transform("terms", lambda t: F.xxhash64(t)).alias("ds"))
    lists = digests.select("lang", "source", F.posexplode(F.array("ds", F.array_distinct("ds"))).alias("first", "ds"))
    rows = lists.select("lang", "source", "first", F.explode("ds").alias("d")).withColumn("d", _cut(F.col("d"), bits))
    counts = rows.groupBy("lang", "source", "d").agg(F.sum(1 - F.col("first")).alias("n"), F.sum("first").alias("docs"))
    # a term has one row for each source here
    return counts.withColumn("docs", F.sum("docs").over(Window.partitionBy("lang", "d"))).where(F.col("docs") >= least).drop("docs")


def _with_digest(words: DataFrame, wanted: DataFrame, bits: int, each: str) -> DataFrame:
    """(lang, source, doc's row, d, term) of the terms whose digest is wanted; each: all terms of a document, or different ones."""
    terms = F.array_distinct("terms") if each == "different" else F.col("terms")
    rows = words.select("lang", "source", F.explode(terms).alias("term")).withColumn("d", _digest(F.col("term"), bits))
    few = wanted.limit(SENT + 1).count() <= SENT
    return rows.join(F.broadcast(wanted) if few else wanted.hint("merge"), "d", "left_semi")


def _kept(words: DataFrame, bits: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, source, d, k, n) of kept terms, and (d, k, term): k tells terms of one digest apart, and is 0 where there is one."""
    counts = stored(_counted(words, bits, least))
    digests = stored(counts.select("d").distinct())
    texts = _with_digest(words, digests, bits, "different").select("d", "term").distinct()
    texts = stored(texts.groupBy("d").agg(F.min("term").alias("low"), F.max("term").alias("high")))
    shared = stored(texts.where("low <> high").select("d"))
    k = F.lit(0).cast("int").alias("k")
    if shared.isEmpty():
        return counts.select("lang", "source", "d", k, "n"), texts.select("d", k, F.col("low").alias("term"))
    every = _with_digest(words, shared, bits, "all").groupBy("lang", "source", "d", "term").agg(F.count("*").alias("n"))
    first = _with_digest(words, shared, bits, "different").groupBy("lang", "d", "term").agg(F.count("*").alias("docs")).where(F.col("docs") >= least)
    split = stored(every.join(first.drop("docs"), ["lang", "d", "term"]))
    own = stored(split.select("d", "term").distinct().withColumn("k", F.row_number().over(Window.partitionBy("d").orderBy("term"))))
    counts = counts.join(shared.hint("merge"), "d", "left_anti").select("lang", "source", "d", k, "n").unionByName(split.join(own, ["d", "term"]).select("lang", "source", "d", "k", "n"))
    return stored(counts), texts.where("low = high").select("d", k, F.col("low").alias("term")).unionByName(own.select("d", "k", "term"))


def _share(n: str, total: str, kept: str) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 kept)), in whole numbers of 38 digits."""
    return F.expr(f"1 + (cast(1000000000 as decimal(38,0)) * (cast({n} as decimal(20,0)) + {ADDED})) div (cast({total} as decimal(20,0)) + {ADDED} * {kept})")


def _compared(rows: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums of the differences of shares over the terms of one block, between its own sources and all of the language.

    rows: (source, d, k, p) for counts over 0; groups: (lang, source, p0, own), p0 the share of a count of 0.
    """
    names = groups.column("source").to_pylist()
    place = {s: i for i, s in enumerate(names)}
    keys = np.column_stack([rows.column("d").to_numpy(), rows.column("k").to_numpy()])
    terms, term = np.unique(keys, axis=0, return_inverse=True) if len(keys) else (keys, np.empty(0, np.int64))
    p = np.tile(groups.column("p0").to_numpy().astype(np.int64)[:, None], (1, len(terms)))
    p[np.array([place[s] for s in rows.column("source").to_pylist()], np.int64), term.ravel()] = rows.column("p").to_numpy()
    own = np.flatnonzero(groups.column("own").to_numpy(zero_copy_only=False))
    sums = np.concatenate([np.empty(0, np.int64), *(np.abs(p - p[i]).sum(axis=1) for i in own)])
    n = len(names)
    return pa.table([pa.array([groups.column("lang")[0].as_py()] * len(sums), pa.string()), pa.array([names[i] for i in own for _ in range(n)], pa.string()), pa.array(names * len(own), pa.string()), pa.array(sums)], ["lang", "source", "item", "value"])


def _pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language.

    The terms of a language are dealt over blocks of CELLS cells, and so are its sources where their pairs are more.
    A block gives one sum for each pair, however many terms it has.
    """
    size = groups.groupBy("lang").agg(F.count("*").alias("s"), F.max("kept").alias("kept"))
    size = size.select("lang", F.ceil(F.greatest(F.lit(1), F.col("s") * F.col("kept") / CELLS)).cast("bigint").alias("parts"), F.ceil(F.col("s") * F.col("s") / CELLS).cast("bigint").alias("shares"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    rows = counts.join(size, "lang").withColumn("part", F.pmod(F.xxhash64("d", "k"), "parts")).withColumn("share", every("shares"))
    own = F.pmod(F.xxhash64("source"), "shares") == F.col("share")
    sides = groups.join(size, "lang").withColumn("part", every("parts")).withColumn("share", every("shares")).select("lang", "part", "share", "source", F.when(F.col("kept") > 0, _share("0", "total", "kept")).otherwise(0).alias("p0"), own.alias("own"))
    rows = rows.select(F.col("lang").alias("_lang"), F.col("part").alias("_part"), F.col("share").alias("_share"), "source", "d", "k", "p")
    sums = rows.groupBy("_lang", "_part", "_share").cogroup(sides.groupBy("lang", "part", "share")).applyInArrow(_compared, "lang string, source string, item string, value bigint")
    return sums.where("source <> item").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = LEAST_DOCS, listed: int = LISTED, bits: int = 64) -> DataFrame:
    """(lang, source, part, item, value, rank) over docs (text, lang, source).

    Part `pair`: for each source of a language every other one with the sum of the differences of their shares over the
    kept terms. Part `term`: the `listed` terms that a source uses most above its language's share. Ranks go from the
    largest value down, ties to the smaller item in UTF-8. Kept are terms in at least `least` documents of the language.

    Null text, lang and source are empty strings; each row is a document, repeated ones too; ids and other columns are
    not read. Groups without kept terms stand in the pairs, with a value of 0 if their language keeps none. Very long
    texts count whole. An empty table gives an empty result. `bits` of the digest are 64; tests take few to make collisions.
    """
    words = _terms(docs)
    counts, texts = _kept(words, bits, least)
    groups = words.select("lang", "source").distinct()
    kept = counts.select("lang", "d", "k").distinct().groupBy("lang").agg(F.count("*").alias("kept"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = stored(groups.join(totals, ["lang", "source"], "left").join(kept, "lang", "left").fillna(0, ["total", "kept"]))
    counts = stored(counts.join(groups, ["lang", "source"]).withColumn("p", _share("n", "total", "kept")).select("lang", "source", "d", "k", "n", "p"))
    of_lang = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("kept").alias("kept"))
    own = Window.partitionBy("lang", "d", "k")
    terms = counts.withColumn("all", F.sum("n").over(own)).join(of_lang, "lang").withColumn("value", F.col("p") - _share("`all`", "total", "kept")).where("value > 0")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    terms = terms.select("lang", "source", "d", "k", "value", F.rank().over(by_value).alias("rank")).where(F.col("rank") <= listed)
    terms = terms.join(texts, ["d", "k"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    pairs = _pairs(counts, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", ranked).unionByName(terms.withColumn("rank", ranked).where(F.col("rank") <= listed))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  unnest(regexp_extract_all({_LOWER}, '{TERM}')) AS t FROM documents),
k AS (SELECT lang, t FROM d GROUP BY lang, t HAVING count(DISTINCT r) >= {LEAST_DOCS}),
c AS (SELECT lang, source, t, count(*) AS n FROM d SEMI JOIN k USING (lang, t) GROUP BY ALL),
g AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
gt AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
lt AS (SELECT lang, sum(n) AS total FROM c GROUP BY lang),
p AS (SELECT g.lang, g.source, k.t, coalesce(c.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + {ADDED})) // (coalesce(gt.total, 0) + {ADDED} * v.v) AS p
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN gt USING (lang, source) LEFT JOIN c USING (lang, source, t)),
q AS (SELECT lang, t, 1 + (1000000000::HUGEINT * (sum(n) + {ADDED})) // (any_value(lt.total) + {ADDED} * any_value(v.v)) AS q
      FROM c JOIN lt USING (lang) JOIN v USING (lang) GROUP BY lang, t),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p AS a JOIN p AS b USING (lang, t)
         WHERE a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
      FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN sums AS s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', t, p - q FROM p JOIN q USING (lang, t) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value,
       (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM o QUALIFY part = 'pair' OR rank <= {LISTED}
"""

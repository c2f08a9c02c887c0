"""Line dedup by winnowing over line hashes.

Lines are compared without ASCII white space at their ends; blank lines take no part. A window is a least run of
lines, read forwards from a line or backwards from it, that holds `CHARS` characters or `WINDOW` lines.

1. Every window selects its smallest line hash, the rightmost of equal ones, as its fingerprint. Windows that
   select one position give one row: the fingerprint, its place, and the lines around it that a window can reach.
2. Positions are joined on the fingerprint; those whose fingerprint stands nowhere else go no further. A window
   that repeats selects the same line in both places, so none is missed.
3. A joined position extends to both sides: the windows that hold it are compared, line by line in 128 bits, with
   the first place (by document, then line) where the same lines stand. The lines of every later window go.

Every line of a repeated run that is a window or longer lies in a window inside that run, so later repeated runs are
deleted whole. A repeated run under `CHARS` characters and under `WINDOW` lines stays. Of lines that repeat without
end inside a text one period's beginning stays.

First places are partial aggregates by key, never pairs, and lines that very many documents hold are dealt over tasks. Null texts stay null. Documents without an id count as the
latest. Rows with the same id and the same text count as one document: each of them keeps what it keeps. A text whose
lines all repeat becomes empty. Other columns pass through whatever their names, but n_lines and n_removed, which
the result replaces.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import hot_join

#: Lines and characters of a window: it ends at whichever comes first.
WINDOW, CHARS = 4, 40
SPACE = " \t\n\x0b\x0c\r"


def _document(id_col: str, text_col: str) -> Column:
    return F.struct(F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.xxhash64(text_col).alias("t"))


def _kept(text_col: str) -> Column:
    """Lines that are not blank: number in the text, two hashes, characters."""
    trimmed = F.transform(F.split(F.col(text_col), "\n", -1), lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(SPACE)).alias("x")))
    return F.transform(
        F.filter(trimmed, lambda s: s.x != ""),
        lambda s: F.struct(s.i.alias("i"), F.xxhash64(s.x).alias("a"), F.xxhash64(F.lit(1), s.x).alias("b"), F.length(s.x).alias("n")),
    )


def _is_window(lines: list[Column]) -> Column:
    """Whether these lines are a window: all there, long enough, and too short without the last or without the first."""
    there = reduce(lambda x, y: x & y, [x.isNotNull() for x in lines])
    if len(lines) == 1:
        return there & (lines[0].n >= CHARS)
    total = lambda some: reduce(lambda x, y: x + y, [x.n for x in some])
    short = (total(lines[:-1]) < CHARS) | (total(lines[1:]) < CHARS)
    return there & short if len(lines) == WINDOW else there & short & (total(lines) >= CHARS)


def _selected(lines: list[Column]) -> Column:
    """The offset of a window's smallest hash, the rightmost of equal ones."""
    if len(lines) == 1:
        return F.lit(0)
    least = F.least(*(x.a for x in lines))
    return F.greatest(*(F.when(x.a == least, F.lit(k)) for k, x in enumerate(lines)))


def positions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(fingerprint, doc, around): a row for each selected position; `around` holds WINDOW - 1 lines on each side of it."""
    near = lambda p, k: F.get(F.col("_kept"), p + k)

    def chosen(p: Column) -> Column:
        """Positions that the windows from line p select."""
        runs = [[near(p, k) for k in range(m)] for m in range(1, WINDOW + 1)]
        return F.array(*(F.when(_is_window(run), p + _selected(run)) for run in runs))

    every = F.when(F.size("_kept") > 0, F.sequence(F.lit(0), F.size("_kept") - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    at = F.array_distinct(F.array_compact(F.flatten(F.transform(every, chosen))))
    lines = docs.select(_document(id_col, text_col).alias("doc"), _kept(text_col).alias("_kept"))
    around = F.transform(at, lambda p: F.array(*(near(p, k) for k in range(1 - WINDOW, WINDOW))))
    return lines.select("doc", F.explode(around).alias("around")).select(F.col("around")[WINDOW - 1].a.alias("fingerprint"), "doc", "around")


def windows(joined: DataFrame) -> DataFrame:
    """(c1, c2, doc, rows): the windows that hold a position and select it; c1 and c2 hash their lines."""

    def window(first: int, size: int) -> Column:
        run = [F.col("around")[WINDOW - 1 + first + k] for k in range(size)]
        cell = F.struct(F.xxhash64(*(x.a for x in run)).alias("c1"), F.xxhash64(F.lit(2), *(x.b for x in run)).alias("c2"), F.array(*(x.i for x in run)).alias("rows"))
        return F.when(_is_window(run) & (_selected(run) == -first), cell)

    found = F.array_compact(F.array(*(window(-k, m) for m in range(1, WINDOW + 1) for k in range(m))))
    return joined.select("doc", F.explode(found).alias("w")).select("w.c1", "w.c2", "doc", "w.rows")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, gone): for each document with later repeated runs, the numbers of their lines."""
    selected = positions(docs, id_col, text_col)
    shared = selected.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1")
    win = windows(hot_join(selected, shared, ["fingerprint"], ["doc", "around"], "left_semi"))
    place = F.struct("doc", F.col("rows")[0].alias("row"))
    first = win.groupBy("c1", "c2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = hot_join(win, first, ["c1", "c2"], ["doc", "rows"]).where(place != F.col("first"))
    return later.select("doc", F.explode("rows").alias("row")).groupBy("doc").agg(F.collect_set("row").alias("gone"))


def _applied(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(own, text, n_lines, n_removed): every row of docs as a struct, and what becomes of its text."""
    plain = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), _document(id_col, text_col).alias("doc"))
    # a merge join whatever the size of the right side: texts move once, and small and large tables take one way
    out = plain.join(repeated(docs, id_col, text_col).hint("merge"), "doc", "left").select("own", "gone", F.split(F.col("own")[text_col], "\n", -1).alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("own")[text_col]).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n"))
    n_lines = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines"))
    n_removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    return out.select("own", text.alias("text"), n_lines.cast("long").alias("n_lines"), n_removed.cast("long").alias("n_removed"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text's later repeated runs deleted, and n_lines, n_removed (long) added; other columns stay."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    cols = [(F.col("text") if c == text_col else F.col("own")[c]).alias(c) for c in names]
    return _applied(docs, id_col, text_col).select(*cols, "n_lines", "n_removed")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs with the text's later repeated runs deleted and no column more; length_col follows the texts that change."""
    length = F.when(F.col("n_removed") > 0, F.length("text").cast("long"))
    cell = lambda c: F.col("text") if c == text_col else F.coalesce(length, F.col("own")[c]) if c == length_col else F.col("own")[c]
    return _applied(docs, id_col, text_col).select(*(cell(c).alias(c) for c in docs.columns))


ORACLE = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x,
           generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
t AS (SELECT doc_id, i, trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x FROM l),
nb AS (SELECT doc_id, i, x, length(x) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k,
       sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM t WHERE x <> ''),
long_enough AS (SELECT a.doc_id, a.k AS first, b.k AS last FROM nb a JOIN nb b
    ON a.doc_id = b.doc_id AND b.k BETWEEN a.k AND a.k + {WINDOW - 1}
    WHERE b.upto - a.upto + a.n >= {CHARS} OR b.k - a.k = {WINDOW - 1}),
window_of AS (SELECT doc_id, first, min(last) AS last FROM long_enough GROUP BY doc_id, first
    UNION SELECT doc_id, max(first), last FROM long_enough GROUP BY doc_id, last),
content AS (SELECT w.doc_id, first, last, string_agg(x, chr(10) ORDER BY k) AS lines
    FROM window_of w JOIN nb ON nb.doc_id = w.doc_id AND nb.k BETWEEN first AND last GROUP BY w.doc_id, first, last),
placed AS (SELECT *, row_number() OVER (PARTITION BY lines ORDER BY doc_id, first) AS place FROM content),
gone AS (SELECT DISTINCT nb.doc_id, nb.i FROM placed p JOIN nb ON nb.doc_id = p.doc_id AND nb.k BETWEEN first AND last
    WHERE place > 1)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(string_agg(x, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') END AS text,
       count(l.i)::BIGINT AS n_lines, count(g.i)::BIGINT AS n_removed
FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i
GROUP BY d.doc_id, d.text
"""

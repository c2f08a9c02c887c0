"""Structure operators over the layout fixtures."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import structure as op
from ..operators.layout import ocr_placeholders as ocr_placeholders_of
from ..sources.fixtures import fixture, oracle
from .registry import query

PAGE = op.PAGE
KEY = [*PAGE, "block_id"]


def fx(spark, d, *names):
    return [fixture(spark, d, f"fx_{n}") for n in names]


GAP = "(CASE WHEN least({a}x1,{b}x1)>greatest({a}x0,{b}x0) AND least({a}y1,{b}y1)>greatest({a}y0,{b}y0) THEN 0 ELSE sqrt(greatest(0::DOUBLE,{b}x0-{a}x1,{a}x0-{b}x1)**2+greatest(0::DOUBLE,{b}y0-{a}y1,{a}y0-{b}y1)**2) END)"


def gap(a, b):
    return GAP.format(a=a, b=b)


@query("group_captions", oracle("fx_boxes", f", s AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_id ORDER BY block_id) AS i FROM fx_boxes), nx AS (SELECT a.doc_id, a.page_id, a.i, a.block_id FROM s a JOIN s b ON a.doc_id=b.doc_id AND a.page_id=b.page_id AND b.i=a.i+1 WHERE a.block_type IN ('Table','Figure','Picture') AND b.block_type IN ('Caption','Footnote') AND {gap('a.', 'b.')}<0.05*792), pv AS (SELECT a.doc_id, a.page_id, a.i, a.block_id FROM s a JOIN s b ON a.doc_id=b.doc_id AND a.page_id=b.page_id AND b.i=a.i-1 WHERE a.block_type IN ('Table','Figure','Picture') AND b.block_type IN ('Caption','Footnote') AND {gap('a.', 'b.')}<0.05*792 AND NOT EXISTS (SELECT 1 FROM nx WHERE nx.doc_id=a.doc_id AND nx.page_id=a.page_id AND nx.i=a.i-2)) SELECT s.doc_id, s.page_id, s.block_id, coalesce((SELECT block_id FROM nx WHERE nx.doc_id=s.doc_id AND nx.page_id=s.page_id AND nx.i=s.i), (SELECT block_id FROM pv WHERE pv.doc_id=s.doc_id AND pv.page_id=s.page_id AND pv.i=s.i), (SELECT block_id FROM nx WHERE nx.doc_id=s.doc_id AND nx.page_id=s.page_id AND nx.i=s.i-1), (SELECT block_id FROM pv WHERE pv.doc_id=s.doc_id AND pv.page_id=s.page_id AND pv.i=s.i+1)) AS group_of FROM s"))
def group_captions(spark, d):
    return op.group_captions(*fx(spark, d, "boxes", "pages")).select(*KEY, "group_of")


@query("reorder_sliced", oracle("fx_boxes fx_pages fx_spans", ", k AS (SELECT doc_id, page_id, block_no, (arg_min(minimum_position, line_no*10+span_id)+arg_max(maximum_position, line_no*10+span_id))/2 AS key FROM fx_spans WHERE block_no%3<>1 GROUP BY ALL), x AS (SELECT b.doc_id, b.page_id, b.block_id, row_number() OVER (PARTITION BY b.doc_id, b.page_id ORDER BY b.block_id) AS i, key FROM fx_boxes b JOIN fx_pages p ON p.doc_id=b.doc_id AND p.page_id=b.page_id AND p.layout_sliced AND p.method='embedded' LEFT JOIN k ON k.doc_id=b.doc_id AND k.page_id=b.page_id AND k.block_no=b.block_id), y AS (SELECT a.*, coalesce(a.key, (SELECT arg_max(b.key,b.i)+a.i-max(b.i) FROM x b WHERE b.doc_id=a.doc_id AND b.page_id=a.page_id AND b.i<a.i AND b.key IS NOT NULL), (SELECT arg_min(b.key,b.i)-(min(b.i)-a.i) FROM x b WHERE b.doc_id=a.doc_id AND b.page_id=a.page_id AND b.i>a.i AND b.key IS NOT NULL), 0) AS kk FROM x a) SELECT doc_id, page_id, block_id, row_number() OVER (PARTITION BY doc_id, page_id ORDER BY kk, block_id)::INT AS place FROM y"))
def reorder_sliced(spark, d):
    boxes, spans, pages = fx(spark, d, "boxes", "spans", "pages")
    return op.reorder_sliced(boxes, spans.where("block_no % 3 <> 1"), pages)


@query("linenum_edges", oracle("fx_spans", ", s AS (SELECT doc_id, page_id, block_no, line_no, span_id, text FROM fx_spans UNION ALL SELECT doc_id, page_id, block_no, line_no, CASE WHEN page_id%2=0 THEN -1 ELSE 9 END, line_no::VARCHAR FROM fx_spans WHERE span_id=0), l AS (SELECT doc_id, page_id, block_no, line_no, count(*) AS n, sum(length(text)) AS ch, arg_min(text,span_id) AS f, arg_max(text,span_id) AS z FROM s GROUP BY ALL), m AS (SELECT *, regexp_matches(trim(f),'^[0-9]+$') AND n>=2 AND ch-length(trim(f))>10 AS st, regexp_matches(trim(z),'^[0-9]+$') AND n>=2 AND ch-length(trim(z))>10 AS en FROM l), r AS (SELECT *, avg(st::INT) OVER w AS a, avg(en::INT) OVER w AS b, count(*) OVER w AS c FROM m WINDOW w AS (PARTITION BY doc_id, page_id, block_no)) SELECT doc_id, page_id, block_no, line_no, 'start' AS edge FROM r WHERE c>=4 AND st AND a>0.6 UNION ALL SELECT doc_id, page_id, block_no, line_no, 'end' FROM r WHERE c>=4 AND en AND b>0.6"))
def linenum_edges(spark, d):
    (s,) = fx(spark, d, "spans")
    s = s.select(*PAGE, "block_no", "line_no", "span_id", "text")
    numbers = s.where("span_id = 0").select(*PAGE, "block_no", "line_no", F.when(F.col("page_id") % 2 == 0, -1).otherwise(9).alias("span_id"), F.col("line_no").cast("string").alias("text"))
    return op.linenum_edges(s.unionByName(numbers))


@query("text_continuation", oracle("fx_boxes fx_lines fx_pages", ", g AS (SELECT doc_id, page_id, block_no AS block_id, count(*) AS n, ceil(min(x0)) AS mn, arg_min(x0,line_no) AS fx, floor(max(x1) FILTER (x1-x0>1)) AS mx, arg_max(x1,line_no) FILTER (x1-x0>1) AS lx, arg_max(text,line_no) FILTER (x1-x0>1) AS lt FROM fx_lines GROUP BY ALL), b AS (SELECT a.*, n, mn, fx, mx, lx, lt FROM fx_boxes a LEFT JOIN g USING (doc_id, page_id, block_id)), q AS (SELECT *, lead(page_id) OVER w AS np, lead(block_type) OVER w AS nt, lead(x0) OVER w AS nx, lead(y0) OVER w AS ny, lead(n) OVER w AS nn, lead(mn) OVER w AS nmn, lead(fx) OVER w AS nfx FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY page_id, block_id)) SELECT doc_id, page_id, block_id, coalesce(block_type='Text' AND n>=2 AND nt='Text' AND nn IS NOT NULL AND (lx>=mx OR regexp_matches(trim(lt),'[\\p{Ll}0-9][-\\x{2014}\\x{AC}]\\s?$')) AND NOT nfx>nmn AND ((np<>page_id AND nx<306 AND ny<396) OR (np=page_id AND floor(ny)<=ceil(y0) AND nx>x1+(x1-x0)*0.02)), false) AS has_continuation FROM q"))
def text_continuation(spark, d):
    return op.text_continuation(*fx(spark, d, "boxes", "lines", "pages"))


def _items(spark, d):
    """All blocks as list items in one group a page, indented by a rule."""
    x = F.col("x0") + F.col("block_id") * 37 % 5 * 20
    return fx(spark, d, "boxes")[0].select(*KEY, F.lit(1).alias("group_id"), x.alias("x0"), "y0", (x + 30).alias("x1"))


ITEMS = ", it AS (SELECT doc_id, page_id, block_id, x0+block_id*37%5*20 AS x0, y0, x0+block_id*37%5*20+30 AS x1, row_number() OVER (PARTITION BY doc_id, page_id ORDER BY block_id) AS i, lead(x0+block_id*37%5*20) OVER (PARTITION BY doc_id, page_id ORDER BY block_id) AS nx FROM fx_boxes), sg AS (SELECT *, sum(CASE WHEN br THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_id ORDER BY i) AS seg FROM (SELECT *, coalesce(lag(nx>x1) OVER (PARTITION BY doc_id, page_id ORDER BY i), false) AS br FROM it)) "
# In a segment between column breaks an item's parent is the closest item before it that is left of it with nothing
# between that isn't right of the parent; levels count parents that are above.
LEVELS = ITEMS + ", pr AS (SELECT a.doc_id, a.page_id, a.i, (SELECT max(b.i) FROM sg b WHERE b.doc_id=a.doc_id AND b.page_id=a.page_id AND b.seg=a.seg AND b.i<a.i AND b.x0+6.12<a.x0) AS p FROM sg a) "


# A recursive walk over a page's items with the stack as two lists; an item after a column break stands alone on it.
INDENTS = """, it AS (SELECT doc_id, page_id, block_id, x0+block_id*37%5*20 AS x0, y0, x0+block_id*37%5*20+30 AS x1, row_number() OVER w AS i, lead(x0+block_id*37%5*20) OVER w AS nx, lead(y0) OVER w AS ny
        FROM fx_boxes WINDOW w AS (PARTITION BY doc_id, page_id ORDER BY block_id)),
    go AS (WITH RECURSIVE g AS (SELECT doc_id, page_id, 0::BIGINT AS i, NULL::BIGINT AS block_id, NULL::INT AS level, [{'x': x0, 'y': y0, 'l': 0}] AS st FROM it WHERE i=1
        UNION ALL SELECT doc_id, page_id, i, block_id, lv, CASE WHEN coalesce(nx>x1, false) THEN [{'x': nx, 'y': ny, 'l': 0}] ELSE list_append(k, {'x': x0, 'y': y0, 'l': lv}) END
        FROM (SELECT *, CASE WHEN len(k)>0 AND y0>k[-1].y THEN k[-1].l+1 ELSE 0 END AS lv
            FROM (SELECT it.*, list_filter(g.st, lambda s: s.x+6.12<it.x0) AS k FROM g JOIN it ON it.doc_id=g.doc_id AND it.page_id=g.page_id AND it.i=g.i+1) a) b) SELECT * FROM g)
    SELECT doc_id, page_id, block_id, level AS list_indent_level FROM go WHERE i>0"""


@query("list_indent", oracle("fx_boxes", INDENTS))
def list_indent(spark, d):
    return op.list_indent(_items(spark, d), fx(spark, d, "pages")[0]).select(*KEY, "list_indent_level")


NESTED = """, p AS (SELECT a.*, (SELECT max(b.block_id) FROM fx_boxes AS b WHERE b.doc_id=a.doc_id AND b.page_id=a.page_id AND b.block_id<a.block_id AND b.block_id*37%5<a.block_id*37%5) AS parent_id FROM fx_boxes AS a),
    r AS (SELECT doc_id, page_id, parent_id AS block_id, min(x0) AS u0, min(y0) AS v0, max(x1) AS u1, max(y1) AS v1 FROM p WHERE parent_id IS NOT NULL GROUP BY ALL)
    SELECT doc_id, page_id, block_id, parent_id, least(x0, coalesce(u0, x0)) AS x0, least(y0, coalesce(v0, y0)) AS y0, greatest(x1, coalesce(u1, x1)) AS x1, greatest(y1, coalesce(v1, y1)) AS y1 FROM p LEFT JOIN r USING (doc_id, page_id, block_id)"""


@query("list_nest", oracle("fx_boxes", NESTED))
def list_nest(spark, d):
    items = fx(spark, d, "boxes")[0].select(*KEY, F.lit(1).alias("group_id"), (F.col("block_id") * 37 % 5).alias("list_indent_level"), "x0", "y0", "x1", "y1")
    return op.list_nest(items).select(*KEY, "parent_id", "x0", "y0", "x1", "y1")


@query("blockquote", "WITH RECURSIVE " + oracle("fx_btext", ", b AS (SELECT doc_id, page_id, block_id, block_type, n_lines, x0+CASE block_id%4 WHEN 1 THEN 60 WHEN 2 THEN 60 WHEN 3 THEN 120 ELSE 0 END AS x0, 40+block_id*70 AS y0, x1+CASE block_id%4 WHEN 3 THEN 60 ELSE 0 END AS x1, 40+block_id*70+40 AS y1 FROM fx_btext), q AS (SELECT *, row_number() OVER w AS i, coalesce(block_type='Text' AND n_lines>=2 AND lead(block_type) OVER w='Text', false) AS pr, coalesce(lead(x0) OVER w>x0+0.1*(x1-x0) AND lead(y0) OVER w>y1, false) AS op, coalesce(abs(lead(x1) OVER w-x1)<0.01*(x1-x0) AND abs(lead(x0) OVER w-x0)<0.01*(x1-x0), false) AS ev, coalesce(lead(n_lines) OVER w>=2, false) AS tl FROM b WINDOW w AS (PARTITION BY doc_id, page_id ORDER BY block_id)), f AS (SELECT doc_id, page_id, i, block_id, 0 AS lv, pr, op, ev, tl FROM q WHERE i=1 UNION ALL SELECT q.doc_id, q.page_id, q.i, q.block_id, CASE WHEN NOT f.pr THEN 0 WHEN f.lv>0 THEN CASE WHEN f.op THEN f.lv+1 WHEN f.ev THEN f.lv ELSE 0 END WHEN f.tl AND f.op THEN 1 ELSE 0 END, q.pr, q.op, q.ev, q.tl FROM f JOIN q ON q.doc_id=f.doc_id AND q.page_id=f.page_id AND q.i=f.i+1) SELECT doc_id, page_id, block_id, lv AS blockquote_level FROM f")[5:])
def blockquote(spark, d):
    m = F.col("block_id") % 4
    b = fx(spark, d, "btext")[0].withColumns({"x0": F.col("x0") + F.when(m.isin(1, 2), 60).when(m == 3, 120).otherwise(0), "x1": F.col("x1") + F.when(m == 3, 60).otherwise(0), "y0": 40.0 + F.col("block_id") * 70, "y1": 80.0 + F.col("block_id") * 70})
    return op.blockquote(b).select(*KEY, "blockquote_level")


@query("math_candidates", oracle("fx_boxes fx_lines", ", h AS (SELECT DISTINCT doc_id, page_id, block_no AS block_id FROM fx_lines WHERE (line_no+doc_id)%7=0), t AS (SELECT b.doc_id, b.page_id, b.block_id, b.block_type, h.block_id IS NOT NULL AS m FROM fx_boxes b LEFT JOIN h ON h.doc_id=b.doc_id AND h.page_id=b.page_id AND h.block_id=b.block_id WHERE b.block_type IN ('Text','Caption','Footnote')), s AS (SELECT *, avg(m::INT) OVER (PARTITION BY doc_id, page_id) AS share FROM t) SELECT doc_id, page_id, block_id FROM s WHERE m OR (share>=0.4 AND block_type='Text')"))
def math_candidates(spark, d):
    boxes, lines = fx(spark, d, "boxes", "lines")
    return op.math_candidates(boxes, lines.withColumn("has_math", (F.col("line_no") + F.col("doc_id")) % 7 == 0))


@query("contained_blocks", "WITH RECURSIVE " + oracle("fx_boxes", ", t AS (SELECT doc_id, page_id, block_id, CASE WHEN block_id>0 THEN (block_id-1)//2 END AS parent_id, block_id=2 AS removed FROM fx_boxes), r AS (SELECT doc_id, page_id, block_id AS root_id, block_id, 0 AS depth FROM t WHERE parent_id IS NULL AND NOT removed UNION ALL SELECT t.doc_id, t.page_id, r.root_id, t.block_id, r.depth+1 FROM r JOIN t ON t.doc_id=r.doc_id AND t.page_id=r.page_id AND t.parent_id=r.block_id AND NOT t.removed) SELECT * FROM r")[5:])
def contained_blocks(spark, d):
    parent = F.when(F.col("block_id") > 0, F.floor((F.col("block_id") - 1) / 2).cast("int"))
    return op.contained_blocks(fx(spark, d, "boxes")[0].select(*KEY, parent.alias("parent_id"), (F.col("block_id") == 2).alias("removed")))


TABLES = ", t0 AS (SELECT table_id, max(col_id)+1 AS columns, min(x0) AS x0, max(x1) AS x1, min(y0)+table_id%3*250 AS y0, max(y1)+table_id%3*250 AS y1 FROM fx_cells GROUP BY table_id), t AS (SELECT table_id%50 AS doc_id, table_id, row_number() OVER (PARTITION BY table_id%50 ORDER BY table_id) AS place, columns, x0, x1, y0, y1 FROM t0), u AS (SELECT *, (place-1)//3 AS page_id, place%4=0 AS sole FROM t), l AS (SELECT *, lag(page_id) OVER w AS pp, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1, lag(y0) OVER w AS py0, lag(y1) OVER w AS py1, lag(columns) OVER w AS pc, lag(sole) OVER w AS ps FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY place)), j AS (SELECT *, coalesce((pp+1=page_id AND greatest((y1-y0)/792,(py1-py0)/792)>0.6 AND (sole OR ps)) OR (pp=page_id AND (((py1-py0)/(y1-y0)>0.75 AND (py1-py0)/(y1-y0)<1.25 AND abs(x0-px1)<20 AND abs(y0-py0)<20) OR ((px1-px0)/(x1-x0)>0.75 AND (px1-px0)/(x1-x0)<1.25 AND abs(columns-pc)<2 AND ((abs(y0-py1)<10 AND abs(x0-px0)<10) OR (abs(x0-px1)<50 AND y0<py1))))), false) AS joins FROM l) "


@query("table_runs", oracle("fx_cells", TABLES + "SELECT doc_id, table_id, place::INT AS place, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY place)::BIGINT AS run_id FROM j"))
def table_runs(spark, d):
    t = fx(spark, d, "cells")[0].groupBy("table_id").agg((F.max("col_id") + 1).alias("columns"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), (F.min("y0") + F.first("table_id") % 3 * 250).alias("y0"), (F.max("y1") + F.first("table_id") % 3 * 250).alias("y1"))
    t = t.withColumn("doc_id", F.col("table_id") % 50).withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("table_id")))
    t = t.withColumns({"page_id": F.floor((F.col("place") - 1) / 3), "sole": F.col("place") % 4 == 0, "page_height": F.lit(792.0)})
    return op.table_runs(t).select("doc_id", "table_id", "place", "run_id")


@query("align_cells", oracle("fx_cells", "SELECT table_id, cell_id, y0-4 AS y0, CASE WHEN row_id < max(row_id) OVER (PARTITION BY table_id) THEN y1-2 ELSE y1 END AS y1 FROM fx_cells"))
def align_cells(spark, d):
    c = fx(spark, d, "cells")[0]
    lines = c.select("table_id", F.col("cell_id").alias("line_id"), (F.col("x0") + 2).alias("x0"), (F.col("y0") - 4).alias("y0"), (F.col("x1") - 2).alias("x1"), (F.col("y1") - 6).alias("y1"))
    return op.align_cells(c, lines)


@query("attach_chars", oracle("fx_spans", "SELECT doc_id, line_no, span_id, generate_subscripts(string_split(text,''),1)-1 AS idx, unnest(string_split(text,'')) AS char FROM fx_spans WHERE span_id=0 AND length(text)>0"))
def attach_chars(spark, d):
    s = fx(spark, d, "spans")[0]
    chars = s.select("doc_id", "line_no", "span_id", F.posexplode(F.regexp_extract_all("text", F.lit("(?s)(.)"), 1)).alias("idx", "char"))
    return op.attach_chars(chars, s.where("span_id = 0"), keep=True).select("doc_id", "line_no", "span_id", "idx", "char")


@query("ocr_work_items", oracle("fx_boxes fx_lines", "SELECT doc_id, page_id, block_id, NULL::INT AS line_no, trunc(x0*2)::INT AS x0, trunc(y0*2)::INT AS y0, trunc(x1*2)::INT AS x1, trunc(y1*2)::INT AS y1 FROM fx_boxes WHERE block_id%2=0 UNION ALL SELECT l.doc_id, l.page_id, l.block_no, l.line_no, trunc(l.x0*2)::INT, trunc(l.y0*2)::INT, trunc(l.x1*2)::INT, trunc(l.y1*2)::INT FROM fx_lines l JOIN fx_boxes b ON b.doc_id=l.doc_id AND b.page_id=l.page_id AND b.block_id=l.block_no AND b.block_id%2=1"))
def ocr_work_items(spark, d):
    boxes, lines = fx(spark, d, "boxes", "lines")
    modes = boxes.select(*KEY, F.when(F.col("block_id") % 2 == 0, "block").otherwise("line").alias("mode"))
    return op.ocr_work_items(boxes, lines, modes, 2.0)


@query("ocr_placeholders", oracle("fx_lines fx_pages", "SELECT l.doc_id, l.page_id, row_number() OVER (PARTITION BY l.doc_id, l.page_id ORDER BY round_even(l.y0/2/1.25,0), l.x0/2, line_no)::INT AS place, round(l.x0/2,6) AS x0, round(l.y0/2,6) AS y0 FROM fx_lines l JOIN fx_pages p ON p.doc_id=l.doc_id AND p.page_id=l.page_id AND p.method='ocr'"))
def ocr_placeholders(spark, d):
    """Detected boxes of pages that are read become empty lines in reading order, in page scale."""
    x = ocr_placeholders_of(*fx(spark, d, "lines", "pages"))
    return x.select(*PAGE, "place", F.round("x0", 6).alias("x0"), F.round("y0", 6).alias("y0"))


@query("apply_ocr", oracle("fx_lines", "SELECT doc_id, page_id, line_no, CASE WHEN line_no%3=0 AND line_no%2=1 THEN 'read' ELSE text END AS text, CASE WHEN line_no%3=0 AND line_no%2=1 THEN 'ocr' ELSE 'embedded' END AS method FROM fx_lines"))
def apply_ocr(spark, d):
    lines = fx(spark, d, "lines")[0]
    results = lines.where("line_no % 3 <> 1").select(*PAGE, "line_no", F.when(F.col("line_no") % 3 == 0, "read").otherwise("").alias("text"), (F.col("line_no") % 2 == 0).alias("original_good"))
    return op.apply_ocr(lines, results)


@query("page_object_check", oracle("fx_pages", "SELECT doc_id, page_id, (doc_id+page_id)%3<>0 AND (doc_id+page_id)%5<>0 AND (doc_id+page_id)%7<>0 AS ok FROM fx_pages"))
def page_object_check(spark, d):
    p = fx(spark, d, "pages")[0].withColumn("m", F.col("doc_id") + F.col("page_id"))
    text = p.where("m % 3 <> 0").select(*PAGE, F.lit("text").alias("kind"), F.lit("Times").alias("font"), F.lit(True).alias("embedded"), F.when(F.col("m") % 5 == 0, "invisible").otherwise("fill").alias("render_mode"), F.lit(10.0).alias("area"))
    image = p.select(*PAGE, F.lit("image").alias("kind"), F.lit(""), F.lit(False), F.lit("none"), F.when(F.col("m") % 7 == 0, 400000.0).otherwise(100.0))
    return op.page_object_check(text.union(image), p)


@query("notes_box_filter", oracle("fx_lines", "SELECT doc_id AS file_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY y0, x0+line_no/1000)::INT AS place FROM fx_lines WHERE 40+6*(line_no%10)>=50 AND (x0+line_no/1000+x1)/2<=0.5*612"))
def notes_box_filter(spark, d):
    b = fx(spark, d, "lines")[0].select(F.col("doc_id").alias("file_id"), "line_no", (F.col("x0") + F.col("line_no") / 1000).alias("x0"), "y0", "x1", "y1", ((40 + 6 * (F.col("line_no") % 10)) / 100).alias("confidence"), F.lit(612.0).alias("crop_width"))
    return op.notes_box_filter(b, 0.5, 0.5).select("file_id", "line_no", "place")

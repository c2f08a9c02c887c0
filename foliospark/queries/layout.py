"""Joins between lines, blocks, pages and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import Box
from ..operators import layout as op
from ..sources.fixtures import fixture, oracle
from .registry import query

PAGE = op.PAGE
BASE = "fx_lines fx_boxes fx_pages"
INTER = ", i AS (SELECT l.doc_id, l.page_id, l.line_no, b.block_id, greatest(0,least(l.x1,b.x1)-greatest(l.x0,b.x0))*greatest(0,least(l.y1,b.y1)-greatest(l.y0,b.y0)) AS area FROM fx_lines l JOIN fx_boxes b USING (doc_id, page_id)) "
ASSIGN = INTER + ", asg AS (SELECT doc_id, page_id, line_no, block_id, area FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_id, line_no ORDER BY area DESC, block_id) AS k FROM i WHERE area>0) WHERE k=1), una AS (SELECT l.* FROM fx_lines l WHERE NOT EXISTS (SELECT 1 FROM asg a WHERE a.doc_id=l.doc_id AND a.page_id=l.page_id AND a.line_no=l.line_no)) "


def fx(spark, d, *names):
    return [fixture(spark, d, f"fx_{n}") for n in names]


def r6(*cols):
    return [F.round(F.col(c), 6).alias(c) for c in cols]


@query("box_intersections", oracle(BASE, INTER + "SELECT doc_id, page_id, line_no, block_id, round(area,6) AS area FROM i WHERE area>0"))
def box_intersections(spark, d):
    lines, boxes = fx(spark, d, "lines", "boxes")
    return op.box_intersections(lines, boxes).select(*PAGE, F.col("a_line_no").alias("line_no"), F.col("b_block_id").alias("block_id"), *r6("area"))


@query("box_distances", oracle(BASE, "SELECT a.doc_id, a.page_id, a.block_id, b.block_id AS other, round(sqrt(((a.x0+a.x1)/2-(b.x0+b.x1)/2)**2+((a.y0+a.y1)/2-(b.y0+b.y1)/2)**2),6) AS distance FROM fx_boxes a JOIN fx_boxes b USING (doc_id, page_id)"))
def box_distances(spark, d):
    (b,) = fx(spark, d, "boxes")
    return op.box_distances(b, b).select(*PAGE, F.col("a_block_id").alias("block_id"), F.col("b_block_id").alias("other"), *r6("distance"))


@query("line_to_block", oracle(BASE, ASSIGN + "SELECT doc_id, page_id, line_no, block_id, round(area,6) AS area FROM asg"))
def line_to_block(spark, d):
    return op.line_to_block(*fx(spark, d, "lines", "boxes")).select(*PAGE, "line_no", "block_id", *r6("area"))


@query("argmax_assign", oracle(BASE, ASSIGN + "SELECT doc_id, page_id, block_id, count(*) AS n FROM asg GROUP BY ALL"))
def argmax_assign(spark, d):
    return op.line_to_block(*fx(spark, d, "lines", "boxes")).groupBy(*PAGE, "block_id").agg(F.count("*").alias("n"))


@query("except_assigned", oracle(BASE, ASSIGN + "SELECT doc_id, page_id, line_no FROM una"))
def except_assigned(spark, d):
    lines, boxes = fx(spark, d, "lines", "boxes")
    return op.except_assigned(lines, op.line_to_block(lines, boxes)).select(*PAGE, "line_no")


NEAR = ASSIGN + ", nd AS (SELECT u.doc_id, u.page_id, u.line_no, b.block_id, sqrt(((u.x0+u.x1)/2-(b.x0+b.x1)/2)**2*5+((u.y0+u.y1)/2-(b.y0+b.y1)/2)**2) AS distance FROM una u JOIN fx_boxes b USING (doc_id, page_id)) "


@query("line_nearest_block", oracle(BASE, NEAR + "SELECT doc_id, page_id, line_no, block_id, round(distance,6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_id, line_no ORDER BY distance, block_id) AS k FROM nd) WHERE k=1 AND distance<60"))
def line_nearest_block(spark, d):
    lines, boxes = fx(spark, d, "lines", "boxes")
    rest = op.except_assigned(lines, op.line_to_block(lines, boxes))
    return op.line_nearest_block(rest, boxes, 60.0).select(*PAGE, "line_no", "block_id", *r6("distance"))


BREAKS = ", un2 AS (SELECT * REPLACE (CASE WHEN line_no%3=1 THEN x0+1/12::DOUBLE WHEN line_no%3=2 AND (doc_id%2=0) THEN x0+2 ELSE x1 END AS x1, CASE WHEN line_no%3>0 THEN chr(10) ELSE text END AS text) FROM una), un3 AS (SELECT * FROM un2 WHERE NOT (text=chr(10) AND (x1-x0)*(y1-y0)<=1)) "
ISLANDS = lambda lines: ASSIGN + (BREAKS if lines == "un3" else "") + f", isl AS (SELECT *, sum(CASE WHEN p=line_no-1 AND sqrt(((px0+px1)/2-(x0+x1)/2)**2+((py0+py1)/2-(y0+y1)/2)**2)<20 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_id ORDER BY line_no) AS island FROM (SELECT *, lag(line_no) OVER w AS p, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1, lag(y0) OVER w AS py0, lag(y1) OVER w AS py1 FROM {lines} WINDOW w AS (PARTITION BY doc_id, page_id ORDER BY line_no))) "


@query("missing_blocks", oracle(BASE, ISLANDS("un3") + "SELECT doc_id, page_id, line_no, island::BIGINT AS island FROM isl"))
def missing_blocks(spark, d):
    """Of the lines left over two in three are lone newlines, some of them too large to be left out."""
    lines, boxes = fx(spark, d, "lines", "boxes")
    rest = op.except_assigned(lines, op.line_to_block(lines, boxes))
    m = F.col("line_no") % 3
    thin = F.when(m == 1, F.col("x0") + 1 / 12).when((m == 2) & (F.col("doc_id") % 2 == 0), F.col("x0") + 2).otherwise(F.col("x1"))
    rest = rest.withColumn("x1", thin).withColumn("text", F.when(m > 0, "\n").otherwise(F.col("text")))
    return op.missing_blocks(rest).select(*PAGE, "line_no", "island")


@query("place_missing", oracle(BASE, ISLANDS("una") + ", nb AS (SELECT doc_id, page_id, island, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM isl GROUP BY ALL), pm AS (SELECT n.doc_id, n.page_id, n.island, b.block_id, abs((n.x0+n.x1)/2-(b.x0+b.x1)/2)*5+abs((n.y0+n.y1)/2-(b.y0+b.y1)/2) AS distance FROM nb n JOIN fx_boxes b USING (doc_id, page_id)) SELECT doc_id, page_id, island::BIGINT AS island, block_id AS after_block, round(distance,6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_id, island ORDER BY round(distance,9), block_id) AS k FROM pm) WHERE k=1"))
def place_missing(spark, d):
    lines, boxes = fx(spark, d, "lines", "boxes")
    new = op.missing_blocks(op.except_assigned(lines, op.line_to_block(lines, boxes))).groupBy(*PAGE, "island").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return op.place_missing(new, boxes).select(*PAGE, "island", "after_block", *r6("distance"))


@query(
    "attach_lines",
    oracle(
        BASE,
        ASSIGN
        + """, ml AS (SELECT * REPLACE (y0 + CASE line_no%3 WHEN 0 THEN 40 ELSE 0 END AS y0, y1 + CASE line_no%3 WHEN 0 THEN 40 ELSE 0 END AS y1), CASE WHEN line_no%7=0 THEN 'ocr' ELSE 'embedded' END AS method FROM fx_lines),
        g AS (SELECT a.doc_id, a.page_id, a.block_id, count(*) AS n_lines, CASE WHEN count(DISTINCT method)=1 THEN string_agg(line_no, ',' ORDER BY line_no) ELSE string_agg(line_no, ',' ORDER BY round_even(y0/1.25,0), x0, line_no) END AS line_order,
            min(x0) AS lx0, min(y0) AS ly0, max(x1) AS lx1, max(y1) AS ly1 FROM asg a JOIN ml l USING (doc_id, page_id, line_no) GROUP BY ALL)
        SELECT b.doc_id, b.page_id, b.block_id, b.block_type, coalesce(n_lines,0) AS n_lines, line_order, CASE WHEN n_lines>0 THEN p.method END AS text_extraction_method,
            round(least(x0,lx0),6) AS x0, round(least(y0,ly0),6) AS y0, round(greatest(x1,lx1),6) AS x1, round(greatest(y1,ly1),6) AS y1
        FROM fx_boxes b JOIN fx_pages p USING (doc_id, page_id) LEFT JOIN g ON b.doc_id=g.doc_id AND b.page_id=g.page_id AND b.block_id=g.block_id""",
    ),
)
def attach_lines(spark, d):
    """Every seventh line was recognised from an image; every third one stands lower than its number says."""
    lines, boxes, pages = fx(spark, d, "lines", "boxes", "pages")
    lower = F.when(F.col("line_no") % 3 == 0, 40).otherwise(0)
    moved = lines.withColumn("y0", F.col("y0") + lower).withColumn("y1", F.col("y1") + lower).withColumn("method", F.when(F.col("line_no") % 7 == 0, "ocr").otherwise("embedded"))
    x = op.attach_lines(op.line_to_block(lines, boxes), boxes, moved, pages)
    return x.select(*PAGE, "block_id", "block_type", "n_lines", F.array_join("line_order", ",").alias("line_order"), "text_extraction_method", *r6("x0", "y0", "x1", "y1"))


@query("reading_order", oracle("fx_lines", "SELECT doc_id, page_id, line_no, row_number() OVER (PARTITION BY doc_id, page_id ORDER BY round_even(y0/1.25,0), x0, line_no)::INT AS place FROM fx_lines"))
def reading_order(spark, d):
    return op.reading_order(fx(spark, d, "lines")[0]).select(*PAGE, "line_no", "place")


OVERLAP = ", ov AS (SELECT a.doc_id, a.page_id, a.line_no, count(*) AS n FROM fx_lines a JOIN fx_lines b USING (doc_id, page_id) WHERE greatest(0,least(a.x1,b.x1)-greatest(a.x0,b.x0))*greatest(0,least(a.y1,b.y1)-greatest(a.y0,b.y0))>0.1 GROUP BY ALL), ovp AS (SELECT p.doc_id, p.page_id, coalesce(max(n),0)<=2 AS ok FROM fx_pages p LEFT JOIN ov USING (doc_id, page_id) GROUP BY ALL) "
COVER = ", cv AS (SELECT p.doc_id, p.page_id, (SELECT count(*) FROM fx_lines l WHERE l.doc_id=p.doc_id AND l.page_id=p.page_id) AS nl, count(b.block_id) AS nb, count(*) FILTER (b.block_id IS NOT NULL AND EXISTS (SELECT 1 FROM fx_lines l WHERE l.doc_id=b.doc_id AND l.page_id=b.page_id AND least(l.x1,b.x1)>greatest(l.x0,b.x0) AND least(l.y1,b.y1)>greatest(l.y0,b.y0))) AS met FROM fx_pages p LEFT JOIN fx_boxes b ON b.doc_id=p.doc_id AND b.page_id=p.page_id AND b.block_type<>'Table' GROUP BY p.doc_id, p.page_id), cvp AS (SELECT doc_id, page_id, CASE WHEN nb=0 THEN true WHEN nl=0 THEN false ELSE met/nb>=0.25 END AS ok FROM cv) "


@query("line_overlap_check", oracle(BASE, OVERLAP + "SELECT * FROM ovp"))
def line_overlap_check(spark, d):
    return op.line_overlap_check(*fx(spark, d, "lines", "pages"))


@query("layout_coverage", oracle(BASE, COVER + "SELECT * FROM cvp"))
def layout_coverage(spark, d):
    lines, boxes, pages = fx(spark, d, "lines", "boxes", "pages")
    return op.layout_coverage(boxes, lines, pages)


@query("route_pages", oracle(BASE, OVERLAP + COVER + "SELECT p.doc_id, p.page_id, CASE WHEN NOT p.ocr_errors_detected AND c.ok AND o.ok THEN 'embedded' ELSE 'ocr' END AS method FROM fx_pages p JOIN cvp c USING (doc_id, page_id) JOIN ovp o USING (doc_id, page_id)"))
def route_pages(spark, d):
    lines, boxes, pages = fx(spark, d, "lines", "boxes", "pages")
    return op.route_pages(pages, op.layout_coverage(boxes, lines, pages), op.line_overlap_check(lines, pages))


MAXO = ", mo AS (SELECT a.doc_id, a.page_id, max(CASE WHEN (a.x1-a.x0)*(a.y1-a.y0)>0 THEN greatest(0,least(a.x1,b.x1)-greatest(a.x0,b.x0))*greatest(0,least(a.y1,b.y1)-greatest(a.y0,b.y0))/((a.x1-a.x0)*(a.y1-a.y0)) ELSE 0 END) AS m FROM fx_boxes a JOIN fx_boxes b ON a.doc_id=b.doc_id AND a.page_id=b.page_id AND a.block_id<>b.block_id GROUP BY ALL) "


@query("page_max_overlap", oracle(BASE, MAXO + "SELECT p.doc_id, p.page_id, round(coalesce(m,0),6) AS max_overlap FROM (SELECT DISTINCT doc_id, page_id FROM fx_boxes) p LEFT JOIN mo USING (doc_id, page_id)"))
def page_max_overlap(spark, d):
    return op.page_max_overlap(fx(spark, d, "boxes")[0]).select(*PAGE, *r6("max_overlap"))


@query("contained_in_table", oracle(BASE, "SELECT doc_id, page_id, block_id FROM fx_boxes a WHERE block_type='Text' AND NOT EXISTS (SELECT 1 FROM fx_boxes b WHERE b.doc_id=a.doc_id AND b.page_id=a.page_id AND b.block_type IN ('Table','Code') AND greatest(0,least(a.x1,b.x1+20)-greatest(a.x0,b.x0-20))*greatest(0,least(a.y1,b.y1+80)-greatest(a.y0,b.y0-20))/greatest(1,(a.x1-a.x0)*(a.y1-a.y0))>0.95)"))
def contained_in_table(spark, d):
    (b,) = fx(spark, d, "boxes")
    tables = b.where(F.col("block_type").isin("Table", "Code")).select(*PAGE, (F.col("x0") - 20).alias("x0"), (F.col("y0") - 20).alias("y0"), (F.col("x1") + 20).alias("x1"), (F.col("y1") + 80).alias("y1"))
    return op.contained_in_table(b, tables).select(*PAGE, "block_id")


@query("ref_to_block", oracle(BASE, ", r AS (SELECT doc_id, page_id, 'page-'||page_id||'-0' AS ref, 72+page_id%5*40 AS x, 40+page_id%7*90 AS y FROM fx_pages), dd AS (SELECT r.doc_id, r.page_id, r.ref, b.block_id, sqrt((b.x0-r.x)**2+(b.y0-r.y)**2) AS distance FROM r JOIN fx_boxes b USING (doc_id, page_id)) SELECT doc_id, page_id, ref, block_id, round(distance,6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_id, ref ORDER BY distance, block_id) AS k FROM dd) WHERE k=1"))
def ref_to_block(spark, d):
    pages, boxes = fx(spark, d, "pages", "boxes")
    refs = pages.select(*PAGE, F.concat(F.lit("page-"), "page_id", F.lit("-0")).alias("ref"), (72 + F.col("page_id") % 5 * 40).alias("x"), (40 + F.col("page_id") % 7 * 90).alias("y"))
    return op.ref_to_block(refs, boxes).select(*PAGE, "ref", "block_id", *r6("distance"))


@query("place_layout", oracle(BASE, "SELECT doc_id, page_id, (row_number() OVER (PARTITION BY doc_id, page_id ORDER BY 100-position, block_id)-1)::INT AS block_id, block_type, block_type||CASE WHEN doc_id%2=1 AND block_type<>'Table' THEN ',Table' ELSE '' END AS labels, round(least(greatest(x0*612/1224,0),612),6) AS x0, round(least(greatest(y0*792/1584,0),792),6) AS y0, round(least(greatest(x1*612/1224,0),612),6) AS x1, round(least(greatest(y1*792/1584,0),792),6) AS y1 FROM fx_boxes"))
def place_layout(spark, d):
    """Each box has its own label, one that is no block type, and in odd documents one more."""
    boxes, pages = fx(spark, d, "boxes", "pages")
    two = F.create_map(F.concat("block_type", F.lit("Like")), F.lit(0.5), F.col("block_type"), F.lit(0.25))
    three = F.map_concat(two, F.create_map(F.when(F.col("block_type") == "Table", "Unknown").otherwise("Table"), F.lit(0.1)))
    boxes = boxes.withColumn("position", 100 - F.col("position")).withColumn("top_k", F.when(F.col("doc_id") % 2 == 1, three).otherwise(two))
    x = op.place_layout(boxes, pages)
    return x.select(*PAGE, "block_id", "block_type", F.array_join(F.map_keys("top_k"), ",").alias("labels"), *r6("x0", "y0", "x1", "y1"))


@query("forced_layout", oracle(BASE, "SELECT doc_id, page_id, 0 AS block_id, 'Table' AS block_type, 0::DOUBLE AS x0, 0::DOUBLE AS y0, width AS x1, height AS y1, 1::DOUBLE AS confidence FROM fx_pages"))
def forced_layout(spark, d):
    return op.forced_layout(fx(spark, d, "pages")[0], "Table")


ORDER = "doc_id, page_id, block_id"


@query("next_block", oracle(BASE, "SELECT a.doc_id, a.page_id, a.block_id, n.page_id AS next_page, n.block_id AS next_block FROM fx_boxes a LEFT JOIN LATERAL (SELECT b.page_id, b.block_id FROM fx_boxes b WHERE b.doc_id=a.doc_id AND b.block_type NOT IN ('Caption','Footnote') AND b.page_id*100+b.block_id > a.page_id*100+a.block_id ORDER BY b.page_id, b.block_id LIMIT 1) n ON true"))
def next_block(spark, d):
    return op.next_block(fx(spark, d, "boxes")[0], ["Caption", "Footnote"], ["page_id", "block_id"]).select(*PAGE, "block_id", "next_page", "next_block")


@query("prev_block", oracle(BASE, "SELECT a.doc_id, a.page_id, a.block_id, n.page_id AS prev_page, n.block_id AS prev_block FROM fx_boxes a LEFT JOIN LATERAL (SELECT b.page_id, b.block_id FROM fx_boxes b WHERE b.doc_id=a.doc_id AND b.block_type NOT IN ('Caption','Footnote') AND b.page_id*100+b.block_id < a.page_id*100+a.block_id ORDER BY b.page_id DESC, b.block_id DESC LIMIT 1) n ON true"))
def prev_block(spark, d):
    return op.prev_block(fx(spark, d, "boxes")[0], ["Caption", "Footnote"], ["page_id", "block_id"]).select(*PAGE, "block_id", "prev_page", "prev_block")


@query("remove_items", oracle(BASE, "SELECT doc_id, page_id, block_id FROM fx_boxes WHERE block_type NOT IN ('Caption','Footnote')"))
def remove_items(spark, d):
    (b,) = fx(spark, d, "boxes")
    return op.remove_items(b, b.where(F.col("block_type").isin("Caption", "Footnote")).select(*PAGE, "block_id")).select(*PAGE, "block_id")


@query("replace_block", oracle(BASE, ", m AS (SELECT *, max(block_id) OVER (PARTITION BY doc_id, page_id) AS top FROM fx_boxes) SELECT doc_id, page_id, block_id, block_type, block_id AS seq, block_type='Caption' AS removed FROM m UNION ALL SELECT doc_id, page_id, (top+row_number() OVER (PARTITION BY doc_id, page_id ORDER BY block_id))::INT, 'Text', block_id, false FROM m WHERE block_type='Caption'"))
def replace_block(spark, d):
    (b,) = fx(spark, d, "boxes")
    return op.replace_block(b, b.where("block_type = 'Caption'").select(*PAGE, "block_id", F.lit("Text").alias("new_type")))


@query("expand_layout", oracle(BASE, ", b AS (SELECT doc_id, page_id, block_id, CASE WHEN block_type='Table' THEN 'Picture' ELSE block_type END AS t, x0, y0, x1, y1 FROM fx_boxes), gp AS (SELECT a.doc_id, a.page_id, a.block_id, min(CASE WHEN least(a.x1,c.x1)>greatest(a.x0,c.x0) AND least(a.y1,c.y1)>greatest(a.y0,c.y0) THEN 0 ELSE sqrt(greatest(0::DOUBLE, c.x0-a.x1, a.x0-c.x1)**2+greatest(0::DOUBLE, c.y0-a.y1, a.y0-c.y1)**2) END) AS gap FROM b a JOIN b c ON a.doc_id=c.doc_id AND a.page_id=c.page_id AND a.block_id<>c.block_id WHERE a.t='Picture' GROUP BY ALL), f AS (SELECT b.*, CASE WHEN gap IS NULL THEN 0.05 WHEN gap>0 AND x1>x0 THEN least(0.05::DOUBLE,gap/(x1-x0)) ELSE 0 END AS fx, CASE WHEN gap IS NULL THEN 0.05 WHEN gap>0 AND y1>y0 THEN least(0.05::DOUBLE,gap/(y1-y0)) ELSE 0 END AS fy FROM b LEFT JOIN gp USING (doc_id, page_id, block_id)) SELECT doc_id, page_id, block_id, t AS block_type, round(CASE WHEN t='Picture' THEN greatest(0,x0-fx*(x1-x0)) ELSE x0 END,6) AS x0, round(CASE WHEN t='Picture' THEN greatest(0,y0-fy*(y1-y0)) ELSE y0 END,6) AS y0, round(CASE WHEN t='Picture' THEN least(612,x1+fx*(x1-x0)) ELSE x1 END,6) AS x1, round(CASE WHEN t='Picture' THEN least(792,y1+fy*(y1-y0)) ELSE y1 END,6) AS y1 FROM f"))
def expand_layout(spark, d):
    boxes, pages = fx(spark, d, "boxes", "pages")
    boxes = boxes.withColumn("block_type", F.when(F.col("block_type") == "Table", "Picture").otherwise(F.col("block_type")))
    return op.expand_layout(boxes, pages).select(*PAGE, "block_id", "block_type", *r6("x0", "y0", "x1", "y1"))


@query("notes_order", oracle(BASE, "SELECT doc_id, page_id, block_id, row_number() OVER (PARTITION BY doc_id, page_id ORDER BY y0, x0, block_id)::INT AS place FROM fx_boxes"))
def notes_order(spark, d):
    from pyspark.sql import Window

    return fx(spark, d, "boxes")[0].select(*PAGE, "block_id", F.row_number().over(Window.partitionBy(*PAGE).orderBy(Box.of().y0, "x0", "block_id")).alias("place"))

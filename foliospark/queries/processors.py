"""Block processors over the layout fixtures."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.text import indel_ratios as indel
from ..operators import aggregates as agg, layout, processors as op
from ..sources.fixtures import fixture, oracle
from .registry import query

PAGE = op.PAGE
KEY = [*PAGE, "block_id"]


def fx(spark, d, *names):
    return [fixture(spark, d, f"fx_{n}") for n in names]


@query("parse_relabel_rules", oracle("fx_boxes", "SELECT 'Text' AS old_type, 'Caption' AS new_type, 0.6::DOUBLE AS threshold, count(*) FILTER (block_type='Text') AS n FROM fx_boxes UNION ALL SELECT 'Code', 'Text', 0.55::DOUBLE, count(*) FILTER (block_type='Code') FROM fx_boxes"))
def parse_relabel_rules(spark, d):
    """The rules of a specification with a malformed entry, with the blocks each applies to."""
    rules = spark.createDataFrame(op.parse_relabel_rules("Text:Caption:0.6,Oops,Code:Text:0.55"), "old_type string, new_type string, threshold double")
    n = fx(spark, d, "boxes")[0].groupBy("block_type").agg(F.count("*").alias("n"))
    return rules.join(n, rules["old_type"] == n["block_type"], "left").select("old_type", "new_type", "threshold", F.coalesce("n", F.lit(0)).alias("n"))


@query("relabel_blocks", oracle("fx_boxes", "SELECT doc_id, page_id, block_id, CASE WHEN block_type='Text' AND (50+5*(block_id%10))/100<=0.6 THEN 'Caption' WHEN block_type='Code' AND (50+5*(block_id%10))/100<=0.65 THEN 'Text' ELSE block_type END AS new_type FROM fx_boxes"))
def relabel_blocks(spark, d):
    b = fx(spark, d, "boxes")[0].withColumn("top_k", F.create_map("block_type", (50 + 5 * (F.col("block_id") % 10)) / 100))
    return op.relabel_blocks(b, op.parse_relabel_rules("Text:Caption:0.6,Code:Text:0.65")).select(*KEY, "new_type")


@query("headers_first", oracle("fx_boxes", "SELECT doc_id, page_id, block_id, row_number() OVER (PARTITION BY doc_id, page_id ORDER BY block_type<>'Caption', block_id)::INT AS place FROM fx_boxes"))
def headers_first(spark, d):
    return op.stable_first(fx(spark, d, "boxes")[0], "Caption").select(*KEY, "place")


@query("footnotes_last", oracle("fx_boxes", "SELECT doc_id, page_id, block_id, row_number() OVER (PARTITION BY doc_id, page_id ORDER BY block_type='Equation', block_id)::INT AS place FROM fx_boxes"))
def footnotes_last(spark, d):
    return op.stable_last(fx(spark, d, "boxes")[0], "Equation").select(*KEY, "place")


CLEAN = "regexp_replace(regexp_replace(regexp_replace(replace(rtext,chr(10),''),'^\\s+|\\s+$','','g'),'^[0-9]+\\s*',''),'\\s*[0-9]+$','')"
COMMON = f", fb AS (SELECT doc_id, page_id, {CLEAN} AS text FROM fx_running WHERE block_id=first_id), cn AS (SELECT doc_id, text, count(*) AS k FROM fb GROUP BY ALL), tt AS (SELECT doc_id, count(*) AS n FROM fb GROUP BY ALL), st AS (SELECT doc_id, text, max(c) AS longest FROM (SELECT doc_id, text, g, count(*) AS c FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_id)-row_number() OVER (PARTITION BY doc_id, text ORDER BY page_id) AS g FROM fb) GROUP BY ALL) GROUP BY ALL), co AS (SELECT doc_id, text, k FROM cn JOIN tt USING (doc_id) JOIN st USING (doc_id, text) WHERE n>=3 AND (k>=0.2*n OR longest>=3) AND k>3) "


def _common(spark, d):
    r = fx(spark, d, "running")[0]
    return op.common_elements(r.where("block_id = first_id").select(*PAGE, F.col("rtext").alias("text"))), r


@query("common_elements", oracle("fx_running", COMMON + "SELECT * FROM co"))
def common_elements(spark, d):
    return _common(spark, d)[0]


@query("ignore_common", oracle("fx_running", COMMON + f"SELECT DISTINCT r.doc_id, r.page_id, r.block_id FROM fx_running r JOIN co USING (doc_id) WHERE {CLEAN.replace('rtext', 'r.rtext')}=co.text"))
def ignore_common(spark, d):
    common, r = _common(spark, d)
    return op.ignore_common(r.select(*KEY, F.col("rtext").alias("text")), common)


# The row of bits in two words of 120 bits; a step for each character of the other text.
RATIO = """, s AS (SELECT doc_id, line_no, text AS a, lead(text) OVER (PARTITION BY doc_id ORDER BY line_no) AS b FROM fx_lines),
    x AS (SELECT doc_id, line_no, string_split(a, '') AS xs, string_split(b, '') AS ys FROM s WHERE b IS NOT NULL),
    go AS (WITH RECURSIVE g AS (SELECT doc_id, line_no, xs, ys, 1 AS i, (1::HUGEINT<<120)-1 AS lo, (1::HUGEINT<<120)-1 AS hi FROM x
        UNION ALL SELECT doc_id, line_no, xs, ys, i+1, ((lo+m0)|(lo-m0))&ones, ((hi+m1+((lo+m0)>>120))|(hi-m1))&ones
        FROM (SELECT *, (1::HUGEINT<<120)-1 AS ones,
                lo & coalesce(list_sum([CASE WHEN xs[k]=ys[i] THEN 1::HUGEINT<<(k-1) ELSE 0::HUGEINT END FOR k IN generate_series(1, least(120, len(xs)))]), 0)::HUGEINT AS m0,
                hi & coalesce(list_sum([CASE WHEN xs[k]=ys[i] THEN 1::HUGEINT<<(k-121) ELSE 0::HUGEINT END FOR k IN generate_series(121, len(xs))]), 0)::HUGEINT AS m1 FROM g WHERE i<=len(ys)) q)
        SELECT doc_id, line_no, len(xs) AS n, len(ys) AS m, 240-bit_count(lo)-bit_count(hi) AS lcs FROM g WHERE i=len(ys)+1)
    SELECT doc_id, line_no, round(200.0*lcs/(n+m), 6) AS score FROM go"""


@query("indel_ratio", oracle("fx_lines", RATIO))
def indel_ratio(spark, d):
    """Each line of a document against the next one."""
    x = fx(spark, d, "lines")[0].withColumn("other", F.lead("text").over(Window.partitionBy("doc_id").orderBy("line_no")))
    return x.where("other is not null").select("doc_id", "line_no", F.round(indel(F.col("text"), F.col("other")), 6).alias("score"))


LISTS = ", b AS (SELECT *, lag(block_type) OVER w AS pt, lag(x0) OVER w AS u0, lag(y0) OVER w AS v0, lag(x1) OVER w AS u1, lag(y1) OVER w AS v1 FROM fx_boxes WINDOW w AS (PARTITION BY doc_id, page_id ORDER BY block_id)), r AS (SELECT *, sum(CASE WHEN block_type='ListItem' AND pt='ListItem' AND (CASE WHEN least(x1,u1)>greatest(x0,u0) AND least(y1,v1)>greatest(y0,v0) THEN 0 ELSE sqrt(greatest(0::DOUBLE,u0-x1,x0-u1)**2+greatest(0::DOUBLE,v0-y1,y0-v1)**2) END)<0.1*792 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_id ORDER BY block_id) AS run FROM b), g AS (SELECT doc_id, page_id, block_id, CASE WHEN count(*) OVER (PARTITION BY doc_id, page_id, run)>1 THEN run::BIGINT END AS list_group FROM r WHERE block_type='ListItem') "


@query("group_lists", oracle("fx_boxes", LISTS + "SELECT * FROM g"))
def group_lists(spark, d):
    return op.group_lists(*fx(spark, d, "boxes", "pages")).select(*KEY, "list_group")


@query("unmark_lists", oracle("fx_boxes", LISTS + "SELECT doc_id, page_id, block_id, CASE WHEN list_group IS NULL THEN 'Text' ELSE 'ListItem' END AS block_type FROM g"))
def unmark_lists(spark, d):
    return op.unmark_lists(op.group_lists(*fx(spark, d, "boxes", "pages"))).select(*KEY, "block_type")


@query("code_format", oracle("fx_lines", ", k AS (SELECT *, x0 + 15*(line_no%3) AS x, sum(x1-x0) OVER w / sum(length(text)) OVER w AS ch FROM fx_lines WHERE block_type='Code' WINDOW w AS (PARTITION BY doc_id, page_id, block_no)), q AS (SELECT *, min(x) OVER (PARTITION BY doc_id, page_id, block_no) AS lo, sum(x1+15*(line_no%3)-x) OVER (PARTITION BY doc_id, page_id, block_no)/sum(length(text)) OVER (PARTITION BY doc_id, page_id, block_no) AS c FROM k) SELECT doc_id, page_id, block_no, rtrim(string_agg(repeat(' ', CASE WHEN c>0 THEN trunc((x-lo)/c)::INT ELSE 0 END) || text, chr(10) ORDER BY line_no)) AS code FROM q GROUP BY ALL"))
def code_format(spark, d):
    lines = fx(spark, d, "lines")[0].where("block_type = 'Code'")
    return op.code_format(lines.withColumns({"x0": F.col("x0") + 15 * (F.col("line_no") % 3), "x1": F.col("x1") + 15 * (F.col("line_no") % 3)}))


@query("footnote_superscript", oracle("fx_spans fx_boxes", """, s AS (SELECT doc_id, page_id, block_no, line_no, span_id,
        CASE doc_id%3 WHEN 0 THEN '1 '||text WHEN 1 THEN '* '||text ELSE text||' 1' END AS text FROM fx_spans),
    f AS (SELECT s.doc_id, s.page_id, s.block_no, arg_min(text, line_no*10+span_id) AS text FROM s JOIN fx_boxes b ON b.doc_id=s.doc_id AND b.page_id=s.page_id
        AND b.block_id=s.block_no AND b.block_type='Footnote' GROUP BY ALL)
    SELECT *, regexp_matches(text, '^([0-9]|[^\\p{L}\\p{N}_])') AS has_superscript FROM f"""))
def footnote_superscript(spark, d):
    spans, boxes = fx(spark, d, "spans", "boxes")
    mark = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("1 "), "text")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("* "), "text")).otherwise(F.concat("text", F.lit(" 1")))
    return op.footnote_superscript(spans.withColumn("text", mark), boxes)


def _numbered(spans):
    """Pages where each line starts, by x, with a number that is its last span by id."""
    own = spans.select(*PAGE, "line_no", "span_id", (F.col("span_id") * 10.0).alias("x0"), "text")
    lead = spans.where("page_id % 3 = 1 AND span_id = 0").select(*PAGE, "line_no", F.lit(99).alias("span_id"), F.lit(-5.0).alias("x0"), F.concat(F.lit(" "), F.col("line_no").cast("string"), F.lit("½")).alias("text"))
    return own.unionByName(lead)


@query("linenum_spans", oracle("fx_spans", """, s AS (SELECT doc_id, page_id, line_no, span_id, span_id*10 AS x, text FROM fx_spans
        UNION ALL SELECT doc_id, page_id, line_no, 99, -5, ' '||line_no||'½' FROM fx_spans WHERE page_id%3=1 AND span_id=0),
    f AS (SELECT doc_id, page_id, line_no, arg_min(span_id, x) AS span_id, regexp_full_match(trim(arg_min(text, x)), '\\p{N}+') AS num FROM s GROUP BY ALL)
    SELECT doc_id, page_id, line_no, span_id FROM f QUALIFY num AND avg(num::INT) OVER (PARTITION BY doc_id, page_id) > 0.6"""))
def linenum_spans(spark, d):
    return op.linenum_spans(_numbered(fx(spark, d, "spans")[0]))


@query("linenum_blocks", oracle("fx_btext", ", n AS (SELECT doc_id, page_id, block_id, CASE WHEN block_id%2=0 THEN '1 2 3 4 x' ELSE text END AS text, x0, y0, CASE WHEN block_id%4=0 THEN x0+10 ELSE x1 END AS x1, y1 FROM fx_btext), k AS (SELECT *, list_filter(string_split_regex(text,'\\s+'), lambda x: x<>'') AS tk FROM n) SELECT doc_id, page_id, block_id FROM k WHERE len(tk)>=4 AND len(list_filter(tk, lambda x: regexp_matches(x,'^[0-9]+$')))/len(tk)>0.6 AND y1-y0>x1-x0"))
def linenum_blocks(spark, d):
    b = fx(spark, d, "btext")[0].withColumns({"text": F.when(F.col("block_id") % 2 == 0, "1 2 3 4 x").otherwise(F.col("text")), "x1": F.when(F.col("block_id") % 4 == 0, F.col("x0") + 10).otherwise(F.col("x1"))})
    return op.linenum_blocks(b).select(*KEY)


LEVELS = ", h AS (SELECT doc_id, page_id, block_id, 10 + (page_id*7)%13 + 0.5*(block_id%2) AS lh FROM fx_boxes WHERE block_type='SectionHeader' OR block_type='ListItem'), h1 AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER w AS i, coalesce(lag(lh) OVER w - lh, 0) AS gap FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY lh DESC, page_id, block_id)), h2 AS (SELECT *, CASE WHEN gap>0 AND row_number() OVER (PARTITION BY doc_id ORDER BY gap DESC, i)<=3 THEN 1 ELSE 0 END AS cut FROM h1), h3 AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY i) AS cl FROM h2), c AS (SELECT doc_id, cl, avg(lh) AS mean, min(lh) AS low FROM h3 GROUP BY ALL), c2 AS (SELECT *, sum(CASE WHEN lag_mean*0.75>=mean OR lag_mean IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY cl) AS lv FROM (SELECT *, lag(mean) OVER (PARTITION BY doc_id ORDER BY cl) AS lag_mean FROM c)), rg AS (SELECT doc_id, lv, min(low) AS low FROM c2 GROUP BY ALL) "


@query("heading_levels", oracle("fx_boxes", LEVELS + "SELECT doc_id, page_id, block_id, lh::DOUBLE AS line_height, (CASE WHEN n>4 THEN coalesce((SELECT min(lv) FROM rg WHERE rg.doc_id=h3.doc_id AND rg.low*0.99<=h3.lh),2) ELSE 2 END)::INT AS heading_level FROM h3"))
def heading_levels(spark, d):
    h = fx(spark, d, "boxes")[0].where("block_type IN ('SectionHeader', 'ListItem')").select(*KEY, (10 + F.col("page_id") * 7 % 13 + 0.5 * (F.col("block_id") % 2)).alias("line_height"))
    return op.heading_levels(h)


@query("toc", oracle("fx_btext", "SELECT doc_id, regexp_replace(text,'^\\s+|\\s+$','','g') AS title, 1+page_id%3 AS heading_level, page_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_id, block_id)::INT AS place FROM fx_btext WHERE block_type='SectionHeader'"))
def toc(spark, d):
    return op.toc(fx(spark, d, "btext")[0].where("block_type = 'SectionHeader'").withColumn("heading_level", 1 + F.col("page_id") % 3))


@query("list_continuation", oracle("fx_boxes", "SELECT doc_id, page_id, block_id, coalesce(nt=block_type AND ((np=page_id AND ny<=y1) OR (np<>page_id AND nx<306 AND ny<396)), false) AS has_continuation FROM (SELECT *, lead(page_id) OVER w AS np, lead(block_type) OVER w AS nt, lead(x0) OVER w AS nx, lead(y0) OVER w AS ny FROM fx_boxes WINDOW w AS (PARTITION BY doc_id ORDER BY page_id, block_id))"))
def list_continuation(spark, d):
    boxes, pages = fx(spark, d, "boxes", "pages")
    return op.list_continuation(boxes.join(pages.select(*PAGE, "width", "height"), PAGE)).select(*KEY, "has_continuation")


@query("blank_page", oracle("fx_boxes", "SELECT doc_id, page_id FROM (SELECT doc_id, page_id, count(*) AS n FROM fx_boxes GROUP BY ALL) WHERE n=1 AND (doc_id+page_id)%2=0"))
def blank_page(spark, d):
    boxes, pages = fx(spark, d, "boxes", "pages")
    blank = pages.select(*PAGE, ((F.col("doc_id") + F.col("page_id")) % 2 == 0).alias("is_blank"))
    return op.blank_page(boxes.withColumn("block_type", F.lit("Picture")), blank, pages)


@query("fix_latex", oracle("fx_btext", "SELECT doc_id, page_id, block_id, CASE WHEN block_id%2=0 THEN '<math display=\"block\">' || regexp_replace(text,'^\\s+|\\s+$','','g') || '</math>' ELSE '' END AS html FROM fx_btext"))
def fix_latex(spark, d):
    x = F.when(F.col("block_id") % 2 == 0, F.concat(F.lit("<math>\\n "), "text", F.lit(" \\n<br/></math>"))).otherwise(F.col("text"))
    return fx(spark, d, "btext")[0].select(*KEY, F.regexp_replace(op.fix_latex(x), r"(\\n|\s)+</math>", "</math>").alias("html"))


@query("equation_candidates", oracle("fx_boxes", "SELECT doc_id, page_id, block_id FROM fx_boxes WHERE block_type='Equation' AND (y1-y0)/792>=0.06"))
def equation_candidates(spark, d):
    return op.equation_candidates(*fx(spark, d, "boxes", "pages")).select(*KEY)


@query("handwriting_candidates", oracle("fx_boxes", "SELECT doc_id, page_id, block_id FROM fx_boxes WHERE block_type='Text' AND block_id=1"))
def handwriting_candidates(spark, d):
    boxes, lines = fx(spark, d, "boxes", "lines")
    return op.handwriting_candidates(boxes, lines.where("block_no <> 1")).select(*KEY)


@query("picture_candidates", oracle("fx_boxes", "SELECT doc_id, page_id, block_id FROM fx_boxes WHERE block_type IN ('Picture','Figure','Table')"))
def picture_candidates(spark, d):
    b = fx(spark, d, "boxes")[0].withColumn("block_type", F.when(F.col("block_type") == "Table", "Figure").otherwise(F.col("block_type")))
    return op.picture_candidates(b, extract_images=False).select(*KEY)


FULL, SKIP = ["SectionHeader", "ListItem", "Footnote", "Text", "Caption"], ["Table", "Equation"]


@query("ocr_mode", oracle("fx_boxes fx_lines", ", mo AS (SELECT a.doc_id, a.page_id, max(CASE WHEN (a.x1-a.x0)*(a.y1-a.y0)>0 THEN greatest(0,least(a.x1,b.x1)-greatest(a.x0,b.x0))*greatest(0,least(a.y1,b.y1)-greatest(a.y0,b.y0))/((a.x1-a.x0)*(a.y1-a.y0)) ELSE 0 END) AS m FROM fx_boxes a JOIN fx_boxes b ON a.doc_id=b.doc_id AND a.page_id=b.page_id AND a.block_id<>b.block_id GROUP BY ALL), n AS (SELECT doc_id, page_id, block_no, count(*) AS n FROM fx_lines GROUP BY ALL) SELECT b.doc_id, b.page_id, b.block_id, CASE WHEN coalesce(m,0)>0.5 OR b.block_type='Code' OR coalesce(n,0)>15 OR b.y1-b.y0>=396 THEN 'line' ELSE 'block' END AS mode FROM fx_boxes b LEFT JOIN mo USING (doc_id, page_id) LEFT JOIN n ON n.doc_id=b.doc_id AND n.page_id=b.page_id AND n.block_no=b.block_id WHERE b.block_type NOT IN ('Table','Equation')"))
def ocr_mode(spark, d):
    boxes, lines, pages = fx(spark, d, "boxes", "lines", "pages")
    return op.ocr_mode(boxes, lines, pages, layout.page_max_overlap(boxes), FULL, SKIP)


@query("det_conf_filter", oracle("fx_lines", "SELECT doc_id, page_id, line_no FROM fx_lines WHERE 40+6*(line_no%10)>80"))
def det_conf_filter(spark, d):
    return op.det_conf_filter(fx(spark, d, "lines")[0].withColumn("confidence", (40 + 6 * (F.col("line_no") % 10)) / 100)).select(*PAGE, "line_no")


META = """, bl AS (SELECT *, block_id%3 AS q, coalesce(length(html), 0) AS tk FROM fx_tree),
    bt AS (SELECT doc_id, page_id, block_type, count(*) AS n, min(block_id) AS first, sum(q) AS q, sum(tk) AS tk FROM bl GROUP BY ALL),
    ps AS (SELECT doc_id, page_id, string_agg('{"block_type":"'||block_type||'","n":'||n||'}', ',' ORDER BY n DESC, first) AS c, sum(q) AS q, sum(tk) AS tk FROM bt GROUP BY ALL),
    pg AS (SELECT doc_id, '['||string_agg('{"page_id":'||page_id||',"text_extraction_method":"'||method||'","block_counts":['||coalesce(c, '')||'],"block_metadata":{"llm_request_count":'||coalesce(q, 0)||',"llm_error_count":0,"llm_tokens_used":'||coalesce(tk, 0)||'}}', ',' ORDER BY page_id)||']' AS stats
        FROM fx_pages LEFT JOIN ps USING (doc_id, page_id) GROUP BY doc_id),
    tc AS (SELECT doc_id, string_agg('{"title":'||to_json(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '^\\s+|\\s+$', '', 'g'))||',"heading_level":'||(1+page_id%3)||',"page_id":'||page_id
        ||printf(',"polygon":[[%.1f,%.1f],[%.1f,%.1f],[%.1f,%.1f],[%.1f,%.1f]]}', x0, y0, x1, y0, x1, y1, x0, y1), ',' ORDER BY page_id, block_id) AS toc FROM fx_tree WHERE block_type='SectionHeader' GROUP BY doc_id)
    SELECT doc_id, '{"table_of_contents":['||coalesce(toc, '')||'],"page_stats":'||stats||'}' AS metadata FROM pg LEFT JOIN tc USING (doc_id)"""


@query("doc_metadata", oracle("fx_tree fx_pages", META))
def doc_metadata(spark, d):
    """Contents with boxes, and per page the method, block types by falling count and summed counters, as JSON."""
    blocks, pages = fx(spark, d, "tree", "pages")
    heads = blocks.where("block_type = 'SectionHeader'").withColumn("text", F.regexp_replace("html", "<[^>]+>", "")).withColumn("heading_level", 1 + F.col("page_id") % 3)
    counted = blocks.withColumn("llm_request_count", F.col("block_id") % 3).withColumn("llm_tokens_used", F.length("html"))
    out = agg.doc_metadata(counted, pages, op.toc(heads, boxes=True))
    return out.withColumn("metadata", F.to_json("metadata"))

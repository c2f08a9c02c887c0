"""Rendering over spans, lines and blocks."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import text as t
from ..operators import aggregates as agg, render as op, trees
from ..sources.fixtures import fixture, on_written, oracle
from .registry import query

PAGE = op.PAGE
KEY = [*PAGE, "block_id"]
LINE = ["doc_id", "page_id", "block_no", "line_no"]
ESC = lambda x: f"replace(replace(replace(replace(replace({x},'&','&amp;'),'<','&lt;'),'>','&gt;'),'\"','&quot;'),'''','&#x27;')"
FMT = "CASE WHEN font='Times-Ital' THEN 'i' WHEN font='Times-Bold' THEN 'b' END"
SUP = lambda x: f"CASE WHEN has_superscript THEN CASE WHEN regexp_matches({x},'^[^\\p{{L}}_]+') THEN regexp_replace({x},'^([^\\p{{L}}_]+)','<sup>\\1</sup>') ELSE '<sup>'||{x}||'</sup>' END ELSE {x} END"
BODY = f", sp AS (SELECT *, {SUP(ESC('text'))} AS e FROM fx_spans), sl AS (SELECT *, CASE WHEN url IS NOT NULL THEN '<a href='''||url||'''>'||e||'</a>' ELSE e END AS l FROM sp), sh AS (SELECT *, CASE WHEN {FMT} IS NULL THEN l ELSE '<'||({FMT})||'>'||l||'</'||({FMT})||'>' END AS html FROM sl) "


def _spans(spark, d):
    formats = F.when(F.col("font") == "Times-Ital", F.array(F.lit("italic"))).when(F.col("font") == "Times-Bold", F.array(F.lit("bold"))).otherwise(F.array(F.lit("plain")))
    return fixture(spark, d, "fx_spans").withColumn("formats", formats)


def _html(text="text"):
    return op.span_html(F.col(text), F.col("formats"), F.col("has_superscript"), F.col("url"), F.lit(False), F.lit(None).cast("string"))


@query("span_html", oracle("fx_spans", BODY + "SELECT doc_id, line_no, span_id, html FROM sh"))
def span_html(spark, d):
    return _spans(spark, d).select("doc_id", "line_no", "span_id", _html().alias("html"))


LINES = BODY + ", ln2 AS (SELECT doc_id, page_id, block_no, line_no, string_agg(html,'' ORDER BY span_id) AS html, string_agg(text,'' ORDER BY span_id) AS text FROM sh GROUP BY ALL), lh AS (SELECT doc_id, page_id, block_no, line_no, CASE WHEN nx IS NULL THEN trim(html) WHEN regexp_matches(trim(regexp_replace(html,'<[^>]+>','','g')),'[a-z][-\\x{2014}\\x{AC}]\\s?$') AND regexp_matches(nx,'^[a-z]') THEN reverse(regexp_replace(reverse(html),'\\s?[-\\x{2014}\\x{AC}]','')) ELSE html END AS html FROM (SELECT *, lead(text) OVER (PARTITION BY doc_id, page_id, block_no ORDER BY line_no) AS nx FROM ln2)) "


@query("line_html", oracle("fx_spans", LINES + "SELECT * FROM lh"))
def line_html(spark, d):
    return op.line_html(_spans(spark, d).withColumn("html", _html()), ["doc_id", "page_id", "block_no"])


@query("formatted_text", oracle("fx_spans", BODY + "SELECT doc_id, page_id, block_no, line_no, string_agg(html,'' ORDER BY span_id) AS text FROM sh GROUP BY ALL"))
def formatted_text(spark, d):
    return op.formatted_text(_spans(spark, d), LINE)


@query("ocr_input_text", oracle("fx_spans", f"SELECT doc_id, page_id, block_no, line_no, regexp_replace(string_agg(CASE WHEN {FMT} IS NULL THEN text ELSE '<'||({FMT})||'>'||text||'</'||({FMT})||'>' END,'' ORDER BY span_id),'^\\s+|\\s+$','','g') AS text FROM fx_spans GROUP BY ALL"))
def ocr_input_text(spark, d):
    return op.ocr_input_text(_spans(spark, d), LINE)


def _block_query(name, make, sql, fx="fx_btext"):
    @query(name, oracle(fx, f"SELECT doc_id, page_id, block_id, {sql} FROM {fx}"))
    def run(spark, d):
        return fixture(spark, d, fx).select(*KEY, *make(F.col("text")))


FLAT = "replace(text,chr(10),' ')"
_block_query("block_html_text", lambda x: [op.text_html(F.col("block_type"), x, F.col("page_id") % 2 == 0, F.col("block_id") % 3).alias("html")], f"repeat('<blockquote>',block_id%3)||'<p block-type='''||block_type||''''||CASE WHEN page_id%2=0 THEN ' class=''has-continuation''' ELSE '' END||'>'||{FLAT}||'</p>'||repeat('</blockquote>',block_id%3) AS html")
_block_query("block_html_header", lambda x: [op.header_html(x, F.when(F.col("block_id") > 2, F.col("block_id") % 4 + 1), F.col("block_id") == 9).alias("html")], f"CASE WHEN block_id=9 THEN '' ELSE '<h'||CASE WHEN block_id>2 THEN block_id%4+1 ELSE 2 END||'>'||{FLAT}||'</h'||CASE WHEN block_id>2 THEN block_id%4+1 ELSE 2 END||'>' END AS html")
_block_query("block_html_list", lambda x: [op.list_item_html(x, F.col("block_id") % 3).alias("html")], f"CASE WHEN block_id%3>0 THEN '<ul><li block-type=''ListItem'' class=''list-indent-'||(block_id%3)||'''>'||{FLAT}||'</li></ul>' ELSE '<li block-type=''ListItem''>'||{FLAT}||'</li>' END AS html")
_block_query("bullet_strip", lambda x: [op.bullet_strip(F.concat(F.lit("• "), x, F.lit(" – b-c"))).alias("html")], r"regexp_replace('• '||text||' – b-c', '(^|[\n ]|<[^>]*>)[•●○ഠ ം◦■▪▫–—-]( )', '\1\2', 'g') AS html")
_block_query("block_html_code", lambda x: [op.code_html(x).alias("html")], f"'<pre>'||{ESC('text')}||'</pre>' AS html")
_block_query("block_html_equation", lambda x: [op.equation_html(F.when(F.col("block_id") == 1, F.lit("<math>x</math>")), x).alias("html")], "'<p block-type=''Equation''>'||CASE WHEN block_id=1 THEN '<math>x</math>' ELSE text END||'</p>' AS html")
_block_query("block_html_caption_footnote", lambda x: [op.plain_html(x).alias("html")], f"'<p>'||{FLAT}||'</p>' AS html")
_block_query("block_html_figure", lambda x: [op.figure_html(F.lit("<a></a>"), F.when(F.col("block_id") % 2 == 0, x), F.col("block_id").cast("string")).alias("html")], "'<a></a>'||CASE WHEN block_id%2=0 THEN '<p role=''img''>Image '||block_id||' description: '||text||'</p>' ELSE '' END AS html")
_block_query("block_html_region", lambda x: [op.region_html(F.when(F.col("block_id") == 1, x), x).alias("html")], "CASE WHEN block_id=1 THEN text ELSE '<p>'||text||'</p>' END AS html")
_block_query("block_html_reference", lambda x: [op.reference_html(F.concat(F.lit("page-"), F.col("page_id").cast("string")), x).alias("html")], "'<span id=''page-'||page_id||'''>'||text||'</span>' AS html")
_block_query("html_override", lambda x: [F.concat(F.lit("<span id='r'></span>"), F.coalesce(F.when(F.col("block_id") % 4 == 0, F.lit("<p>new</p>")), x)).alias("html")], "'<span id=''r''></span>'||CASE WHEN block_id%4=0 THEN '<p>new</p>' ELSE text END AS html")
_block_query("header_footer_visibility", lambda x: [op.hidden(F.when(F.col("block_id") == 0, "PageHeader").when(F.col("block_id") == 9, "PageFooter").otherwise(F.col("block_type")), False, True).alias("hidden")], "block_id=0 AS hidden")
_block_query("add_block_ids", lambda x: [op.with_block_ids(F.when(F.col("block_id") % 2 == 0, F.concat(F.lit("<p>"), x, F.lit("</p>"))).otherwise(x), F.concat(F.lit("/page/"), F.col("page_id").cast("string"), F.lit("/Text/"), F.col("block_id").cast("string"))).alias("html")], "CASE WHEN text='' AND block_id%2=1 THEN '' WHEN block_id%2=0 THEN '<p data-block-id=''/page/'||page_id||'/Text/'||block_id||'''>'||text||'</p>' ELSE '<span data-block-id=''/page/'||page_id||'/Text/'||block_id||'''>'||text||'</span>' END AS html")
_block_query("image_refs", lambda x: [op.image_refs(F.col("page_id"), F.when(F.col("block_id") == 2, "Figure").otherwise("Text"), F.col("block_id"), x).alias("html")], "CASE WHEN block_id=2 THEN '<p>'||text||'<img src=''_page_'||page_id||'_Figure_2.jpeg''></p>' ELSE text END AS html")

TYPED = f", bh AS (SELECT *, CASE block_type WHEN 'SectionHeader' THEN '<h2>'||{FLAT}||'</h2>' WHEN 'ListItem' THEN '<li block-type=''ListItem''>'||{FLAT}||'</li>' WHEN 'Code' THEN '<pre>'||{ESC('text')}||'</pre>' WHEN 'Equation' THEN '<p block-type=''Equation''>'||text||'</p>' WHEN 'Caption' THEN '<p>'||{FLAT}||'</p>' WHEN 'Footnote' THEN '<p>'||{FLAT}||'</p>' WHEN 'Table' THEN '<p>'||{FLAT}||'</p>' ELSE '<p block-type='''||block_type||'''>'||{FLAT}||'</p>' END AS html FROM fx_btext) "


def _typed(spark, d, overrides=None):
    return fixture(spark, d, "fx_btext").withColumn("html", op.block_html(F.col("block_type"), F.col("text"), F.lit(None).cast("int"), overrides=overrides))


@query("page_div", oracle("fx_btext", TYPED + "SELECT doc_id, page_id, '<div class=''page'' data-page-id='''||page_id||'''>'||string_agg(html,'' ORDER BY block_id)||'</div>' AS html FROM bh GROUP BY doc_id, page_id"))
def page_div(spark, d):
    pages = _typed(spark, d).groupBy(*PAGE).agg(agg.joined(F.col("html"), "", "block_id").alias("html"))
    return pages.select(*PAGE, op.page_div(F.col("html"), F.col("page_id")).alias("html"))


@query("doc_html", oracle("fx_btext", TYPED + "SELECT doc_id, string_agg(html,'' ORDER BY page_id, block_id) AS html FROM bh GROUP BY ALL"))
def doc_html(spark, d):
    return op.doc_html(_typed(spark, d))


@query("block_type_override", oracle("fx_btext", TYPED + "SELECT doc_id, page_id, block_id, CASE WHEN block_type='Caption' THEN '<figcaption>'||text||'</figcaption>' ELSE html END AS html FROM bh"))
def block_type_override(spark, d):
    own = {"Caption": F.concat(F.lit("<figcaption>"), "text", F.lit("</figcaption>"))}
    return _typed(spark, d, own).select(*KEY, "html")


@query("table_only", oracle("fx_btext", TYPED + "SELECT doc_id, page_id, block_id, html FROM bh WHERE block_type IN ('Table','Form','TableOfContents')"))
def table_only(spark, d):
    b = fixture(spark, d, "fx_btext").where(F.col("block_type").isin("Table", "Form", "TableOfContents"))
    return b.select(*KEY, op.block_html(F.col("block_type"), F.col("text"), F.lit(None).cast("int")).alias("html"))


MD = r""", md AS (SELECT *, regexp_replace(regexp_replace(text,'([_*$])','\\\1','g'),'\s+',' ','g') AS e FROM fx_btext), m2 AS (SELECT *, CASE block_type WHEN 'SectionHeader' THEN chr(10)||chr(10)||'## '||e||chr(10)||chr(10) WHEN 'ListItem' THEN '- '||e||chr(10) WHEN 'Code' THEN '```'||chr(10)||text||chr(10)||'```'||chr(10)||chr(10) WHEN 'Equation' THEN chr(10)||'$$'||text||'$$'||chr(10) ELSE e||chr(10)||chr(10) END AS md FROM md) """
CLEANED = lambda x: rf"regexp_replace(regexp_replace(regexp_replace({x}, '\n{{3,}}', chr(10)||chr(10), 'g'), '(\n\s){{3,}}', chr(10)||chr(10), 'g'), '^\s+|\s+$', '', 'g')"


def markdown(spark, d, paginate=False):
    b = fixture(spark, d, "fx_btext").withColumn("md", op.block_md(F.col("block_type"), F.col("text"), F.lit(None).cast("int")))
    return op.md_document(b, paginate)


@query("md_document", oracle("fx_btext", MD + f"SELECT doc_id, count(DISTINCT page_id) AS n_pages, {CLEANED('''string_agg(md,'' ORDER BY page_id, block_id)''')} AS md FROM m2 GROUP BY doc_id"))
def md_document(spark, d):
    return markdown(spark, d)


PAGED = MD + f", pg AS (SELECT doc_id, page_id, chr(10)||chr(10)||'{{'||page_id||'}}'||repeat('-',48)||chr(10)||chr(10)||string_agg(md,'' ORDER BY block_id) AS md FROM m2 GROUP BY doc_id, page_id), pd AS (SELECT doc_id, chr(10)||chr(10)||{CLEANED('''string_agg(md,'' ORDER BY page_id)''')} AS md FROM pg GROUP BY doc_id) "


@query("split_pages_md", oracle("fx_btext", PAGED + r", sp AS (SELECT doc_id, string_split_regex(md, '\{[0-9]+\}-{48}\n\n') AS p FROM pd) SELECT doc_id, unnest(p[2:]) AS md, (generate_subscripts(p[2:],1)-1)::INT AS page FROM sp"))
def split_pages_md(spark, d):
    from ..operators.responses import split_pages_md as split

    return split(markdown(spark, d, paginate=True))


# Blocks as a tree (fx_tree): paths from the top, the next node's depth, references of children.
POLY = lambda x0, y0, x1, y1: f"printf('[[%.1f,%.1f],[%.1f,%.1f],[%.1f,%.1f],[%.1f,%.1f]],\"bbox\":[%.1f,%.1f,%.1f,%.1f]', {x0},{y0}, {x1},{y0}, {x1},{y1}, {x0},{y1}, {x0},{y0},{x1},{y1})"
TREE = f""", walk AS (
        SELECT doc_id, page_id, block_id, [place*1000+block_id] AS path FROM fx_tree WHERE parent_id IS NULL
        UNION ALL SELECT t.doc_id, t.page_id, t.block_id, list_append(walk.path, t.place*1000+t.block_id)
        FROM fx_tree AS t JOIN walk ON t.doc_id=walk.doc_id AND t.page_id=walk.page_id AND t.parent_id=walk.block_id),
    nd AS (SELECT t.*, path, len(path) AS depth, lead(len(path)) OVER (PARTITION BY doc_id, page_id ORDER BY path) AS nx,
        page_ref||block_type||'/'||block_id AS id, {POLY('x0', 'y0', 'x1', 'y1')} AS boxes,
        CASE WHEN below THEN '{{"1":"'||page_ref||'SectionHeader/0"}}' ELSE '{{}}' END AS hier,
        CASE WHEN image IS NULL THEN '{{}}' ELSE '{{"'||page_ref||block_type||'/'||block_id||'":"'||image||'"}}' END AS own_image
        FROM fx_tree AS t JOIN walk USING (doc_id, page_id, block_id)),
    kd AS (SELECT doc_id, page_id, parent_id AS block_id, string_agg('<content-ref src='''||id||'''></content-ref>', '' ORDER BY path) AS refs
        FROM nd WHERE depth>1 GROUP BY ALL)"""
DECODED = "replace(replace(replace(n.html, '&eacute;', 'é'), '&#8212;', '—'), '&amp;', '&')"


def _levels(leaf: str, h: str = "h") -> str:
    """From the deepest level up: the markup of a node with its children's in it."""
    out = f", {h}5 AS (SELECT doc_id, page_id, parent_id, path, id, html AS whole FROM nd WHERE FALSE)"
    for k in (4, 3, 2, 1):
        out += f""", {h}{k} AS (SELECT n.doc_id, n.page_id, n.block_id, n.parent_id, n.path, n.id, n.block_type, n.boxes, n.hier,
            CASE WHEN ks IS NULL THEN {leaf} WHEN n.html IS NULL THEN array_to_string(ws, '')
                ELSE replace(replace({DECODED}, ks[1], ws[1]), coalesce(ks[2], '~'), coalesce(ws[2], '~')) END AS whole, ks IS NOT NULL AS inner_
            FROM nd AS n LEFT JOIN (SELECT doc_id, page_id, parent_id AS block_id, list('<content-ref src='''||id||'''></content-ref>' ORDER BY path) AS ks,
                list(whole ORDER BY path) AS ws FROM {h}{k + 1} GROUP BY ALL) AS k USING (doc_id, page_id, block_id) WHERE n.depth={k})"""
    return out


WHOLE = _levels("CASE WHEN n.block_type='Figure' THEN '<p>'||n.html||'<img src='''||n.id||'''></p>' ELSE coalesce(n.html, '') END")
BELOW = """, im AS (SELECT a.doc_id, a.page_id, a.block_id, '{'||string_agg('"'||f.id||'":"'||f.image||'"', ',' ORDER BY f.path)||'}' AS images
    FROM nd AS a JOIN nd AS f ON a.doc_id=f.doc_id AND a.page_id=f.page_id AND f.image IS NOT NULL AND f.path[1:len(a.path)]=a.path GROUP BY ALL)"""
PAGES_JSON = f""", pj AS (SELECT p.doc_id, p.page_id, '{{"id":"/page/'||p.page_id||'","block_type":"Page","html":'||to_json(coalesce(string_agg('<content-ref src='''||id||'''></content-ref>', '' ORDER BY path) FILTER (depth=1), ''))
        ||',"polygon":'||{POLY("0.0", "0.0", "612.0", "792.0")}||',"children":['||coalesce(string_agg('{{"id":"'||id||'","block_type":"'||block_type||'","html":'||to_json(coalesce(html, refs, ''))||',"polygon":'||boxes||',"section_hierarchy":'||hier
            ||CASE WHEN nx>depth THEN ',"children":[' ELSE ',"images":'||own_image||'}}'||repeat(']}}', depth-coalesce(nx, 1))||CASE WHEN nx IS NULL THEN '' ELSE ',' END END, '' ORDER BY path), '')||']}}' AS j
        FROM fx_pages AS p LEFT JOIN (nd LEFT JOIN kd USING (doc_id, page_id, block_id)) AS n USING (doc_id, page_id) GROUP BY p.doc_id, p.page_id)"""
JSON_DOCS = """SELECT doc_id, '{"children":['||string_agg(j, ',' ORDER BY page_id)||'],"block_type":"Document"%s}' AS json FROM pj GROUP BY doc_id"""


def _tree(spark, d):
    x = on_written(spark, d, "fx_tree1", "fx_tree")[1]
    return x.withColumn("section_hierarchy", F.when(F.col("below"), F.create_map(F.lit("1"), F.concat("page_ref", F.lit("SectionHeader/0")))))


@query("resolve_refs", oracle("fx_tree", TREE + WHOLE + "".join(f" {'UNION ALL' if k > 1 else ''} SELECT doc_id, page_id, block_id::INT AS block_id, whole AS html FROM h{k} WHERE inner_" for k in (1, 2, 3, 4))))
def resolve_refs(spark, d):
    return trees.resolve_refs(_tree(spark, d))


@query("collect_images", oracle("fx_tree", TREE + BELOW + " SELECT doc_id, page_id, block_id::INT AS block_id, images FROM im"))
def collect_images(spark, d):
    return trees.collect_images(_tree(spark, d)).withColumn("images", F.to_json("images"))


@query("render_json", oracle("fx_tree fx_pages", TREE + PAGES_JSON + JSON_DOCS % ""","metadata":{"pages":'||count(*)||'}"""))
def render_json(spark, d):
    pages = fixture(spark, d, "fx_pages")
    metadata = pages.groupBy("doc_id").agg(F.struct(F.count("*").alias("pages")).alias("metadata"))
    return op.render_json(_tree(spark, d), pages, metadata)


@query(
    "block_dump",
    oracle(
        "fx_tree fx_pages",
        """, ch AS (SELECT doc_id, page_id, string_agg('{"block_id":'||block_id||',"block_type":"'||block_type||'"'||coalesce(',"parent_id":'||parent_id, '')||coalesce(',"html":'||to_json(html), '')||'}', ',' ORDER BY block_id) AS c FROM fx_tree GROUP BY ALL)
        SELECT doc_id, '['||string_agg('{"page_id":'||page_id||',"width":612.0,"height":792.0,"method":"'||method||'","children":['||coalesce(c, '')||']}', ',' ORDER BY page_id)||']' AS dump FROM fx_pages LEFT JOIN ch USING (doc_id, page_id) GROUP BY doc_id""",
    ),
)
def block_dump(spark, d):
    blocks = _tree(spark, d).select(*KEY, "block_type", "parent_id", "html", "image")
    return op.block_dump(blocks, fixture(spark, d, "fx_pages").select(*PAGE, "width", "height", "method"))


CHUNK = f"""{TREE}{WHOLE}{BELOW}, ck AS (SELECT h1.*, coalesce(images, '{{}}') AS images FROM h1 LEFT JOIN im USING (doc_id, page_id, block_id))"""


@query("render_chunks", oracle("fx_tree", CHUNK + """ SELECT doc_id, id, block_type, whole AS html, page_id AS page, '{"polygon":'||boxes||'}' AS boxes, hier AS hierarchy, images, '[0.0,0.0,612.0,792.0]' AS page_bbox FROM ck"""))
def render_chunks(spark, d):
    """Chunks with the boxes of their pages; nested columns as JSON."""
    x = op.render_chunks(_tree(spark, d))
    info = op.page_info(fixture(spark, d, "fx_pages")).select("doc_id", "page", F.to_json("bbox").alias("page_bbox"))
    x = x.select("doc_id", "id", "block_type", "html", "page", F.to_json(F.struct("polygon", "bbox")).alias("boxes"), F.to_json("section_hierarchy").alias("hierarchy"), F.to_json("images").alias("images"))
    return x.join(info, ["doc_id", "page"])


CHUNKS_JSON = f""", cb AS (SELECT doc_id, string_agg('{{"id":"'||id||'","block_type":"'||block_type||'","html":'||to_json(whole)||',"page":'||page_id||',"polygon":'||boxes||',"section_hierarchy":'||hier||',"images":'||images||'}}', ',' ORDER BY page_id, path) AS b FROM ck GROUP BY doc_id),
    pi AS (SELECT doc_id, string_agg('"'||page_id||'":{{"bbox":[0.0,0.0,612.0,792.0],"polygon":[[0.0,0.0],[612.0,0.0],[612.0,792.0],[0.0,792.0]]}}', ',' ORDER BY page_id) AS i FROM fx_pages GROUP BY doc_id)"""
PLAIN_TEXT = "string_agg(regexp_replace(html, '<[^>]+>', '', 'g')||chr(10)||chr(10), '' ORDER BY page_id, block_id)"


@query(
    "format_dispatch",
    oracle(
        "fx_tree fx_pages",
        CHUNK + _levels("coalesce(n.html, '')", "g") + PAGES_JSON + CHUNKS_JSON
        + f""" SELECT doc_id, {CLEANED(PLAIN_TEXT)} AS text, 'md' AS ext FROM fx_tree WHERE block_id<100 AND html IS NOT NULL AND doc_id%4=0 GROUP BY doc_id
        UNION ALL SELECT doc_id, string_agg(whole, '' ORDER BY page_id, path), 'html' FROM g1 WHERE doc_id%4=1 GROUP BY doc_id
        UNION ALL SELECT doc_id, json, 'json' FROM ({JSON_DOCS % ''}) WHERE doc_id%4=2
        UNION ALL SELECT doc_id, '{{"blocks":['||coalesce(b, '')||'],"page_info":{{'||i||'}}}}', 'json' FROM pi LEFT JOIN cb USING (doc_id) WHERE doc_id%4=3""",
    ),
)
def format_dispatch(spark, d):
    """Each document in the format that it asks for."""
    md = F.when(F.col("block_id") < 100, F.concat(t.strip_tags(F.col("html")), F.lit("\n\n")))
    blocks, pages = _tree(spark, d).withColumn("md", md), fixture(spark, d, "fx_pages")
    texts = [op.document_texts(blocks.where(F.col("doc_id") % 4 == k), pages.where(F.col("doc_id") % 4 == k), fmt) for k, fmt in enumerate(op.FORMATS)]
    return texts[0].unionByName(texts[1]).unionByName(texts[2]).unionByName(texts[3])


@query("md_cell_text", oracle("fx_cells", "SELECT table_id, cell_id, replace(replace(text,'$','\\$'),'<br>','<br>') AS md FROM fx_cells"))
def md_cell_text(spark, d):
    x = F.regexp_replace(F.col("text"), r"\$", r"\\\$")
    return fixture(spark, d, "fx_cells").select("table_id", "cell_id", t.strip(x).alias("md"))

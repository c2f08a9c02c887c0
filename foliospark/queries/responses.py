"""Requests, responses and extraction over block texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import responses as op
from ..sources.fixtures import fixture, oracle
from .registry import query
from .render import PAGED, markdown

PAGE = op.PAGE
KEY = [*PAGE, "block_id"]


def _blocks(spark, d):
    return fixture(spark, d, "fx_btext").withColumn("html", F.concat(F.lit("<p>"), "text", F.lit("</p>")))


# Kind of each block's request in the queries, and the template of the kind.
KIND = "CASE (block_id + page_id) % 6 WHEN 0 THEN 'form' WHEN 1 THEN 'math' WHEN 2 THEN 'complex' WHEN 3 THEN 'handwriting' WHEN 4 THEN 'equation' ELSE 'image_description' END"
TEMPLATES = {
    "form": "Fix: {block_html}",
    "table": "Table {block_html}, again {block_html}",
    "complex": "Region {extracted_text}",
    "image_description": "Describe {raw_text}.",
    "equation": "Formula {equation}",
    "handwriting": "Read it.",
    "math": "Mark up {extracted_html}",
    "table_merge": "{{table1}} and {{table2}}",
}
KINDS = list(TEMPLATES)
OLD = "'<p>'||text||'</p>' AS html, text||' *' AS formatted"


@query(
    "build_requests",
    oracle(
        "fx_btext",
        f""", b AS (SELECT *, {OLD}, '<t>'||n_lines||'</t>' AS before_html FROM fx_btext),
        k AS (SELECT *, unnest(['form','table','complex','image_description','equation','handwriting','math','table_merge']) AS processor FROM b)
        SELECT processor||'/'||doc_id||'/'||page_id||'/'||block_id AS req_id, processor, doc_id, page_id, block_id,
            CASE processor WHEN 'form' THEN 'Fix: '||html WHEN 'table' THEN 'Table '||html||', again '||html
                WHEN 'complex' THEN 'Region '||text WHEN 'image_description' THEN 'Describe '||text||'.'
                WHEN 'equation' THEN 'Formula '||CASE WHEN block_id%2=0 THEN html ELSE text END WHEN 'handwriting' THEN 'Read it.'
                WHEN 'math' THEN 'Mark up '||formatted ELSE before_html||' and '||html END AS prompt FROM k""",
    ),
)
def build_requests(spark, d):
    """All kinds for each block; blocks with odd numbers have no html of their own when an equation is asked for."""
    b = _blocks(spark, d).withColumn("formatted", F.concat("text", F.lit(" *"))).withColumn("before_html", F.concat(F.lit("<t>"), F.col("n_lines").cast("string"), F.lit("</t>")))
    bare = b.withColumn("html", F.when(F.col("block_id") % 2 == 0, F.col("html")).otherwise(""))
    parts = [op.build_requests(bare if k == "equation" else b, k, t) for k, t in TEMPLATES.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# A coordinate in thousandths, as its whole part: JSON numbers are written differently by the two engines.
BOX = "x0/612*1000 AS b0, y0/792*1000 AS b1, x1/612*1000 AS b2, y1/792*1000 AS b3"
JSON_BOX = "struct<id:string,block_type:string,html:string,page:string,width:double,height:double,bbox:array<double>>"


def _listed(df, key):
    """The JSON of requests as rows, numbers rounded."""
    rows = F.from_json("prompt", f"array<{JSON_BOX}>")
    x = df.select(*key, F.posexplode(rows).alias("n", "r")).select(*key, "n", "r.*")
    return x.select("*", *[F.round(F.get("bbox", F.lit(i)), 4).alias(f"b{i}") for i in range(4)]).drop("bbox")


@query(
    "header_requests",
    oracle(
        "fx_btext",
        f"""SELECT doc_id, n, id, html, page, round(b2-b0,4) AS width, round(b3-b1,4) AS height, round(b0,4) AS b0, round(b1,4) AS b1, round(b2,4) AS b2, round(b3,4) AS b3
        FROM (SELECT *, {BOX}, '<p>'||text||'</p>' AS html, page_id::VARCHAR AS page, '/page/'||page_id||'/SectionHeader/'||block_id AS id,
            (row_number() OVER (PARTITION BY doc_id ORDER BY page_id, block_id)-1)::INT AS n FROM fx_btext WHERE block_type='SectionHeader')""",
    ),
)
def header_requests(spark, d):
    x = op.header_requests(_blocks(spark, d).where("block_type = 'SectionHeader'"), fixture(spark, d, "fx_pages"))
    x = _listed(x, ["doc_id"]).drop("block_type")
    return x.withColumn("width", F.round("width", 4)).withColumn("height", F.round("height", 4))


@query(
    "page_requests",
    oracle(
        "fx_btext",
        f"""SELECT doc_id, page_id, n, id, block_type, html, 'Reorder. ["b", "i"]' AS words, round(b0,4) AS b0, round(b1,4) AS b1, round(b2,4) AS b2, round(b3,4) AS b3
        FROM (SELECT *, {BOX}, '<p>'||text||'</p>' AS html, '/page/'||page_id||'/'||block_type||'/'||block_id AS id,
            (row_number() OVER (PARTITION BY doc_id, page_id ORDER BY block_id)-1)::INT AS n FROM fx_btext)""",
    ),
)
def page_requests(spark, d):
    x = op.page_requests(_blocks(spark, d), fixture(spark, d, "fx_pages"), "Reorder.", "{{user_prompt}} {{format_tags}}\n{{page_json}}", ["b", "i"])
    cut = F.instr("prompt", "\n")
    x = x.select(*PAGE, F.substring("prompt", F.lit(1), cut - 1).alias("words"), F.substring("prompt", cut + 1, F.length("prompt")).alias("prompt"))
    return _listed(x, [*PAGE, "words"]).drop("page", "width", "height")


# Answers of several lengths and forms, by the number of words in a block's first line.
ANSWER = """CASE (length(text) + block_id) % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'No corrections needed.' WHEN 3 THEN 'no corrections'
    WHEN 4 THEN concat('<math>x</math> <math>', translate(text, '*_[]`', '')) WHEN 5 THEN concat('<math>', translate(text, '*_[]`', ''), '</math>') WHEN 6 THEN concat('```html', translate(text, '*_[]`', ''), '```')
    WHEN 7 THEN substring(translate(text, '*_[]`', ''), 1, cast(floor(length(translate(text, '*_[]`', '')) * (block_id + 1) / 10) AS int)) ELSE concat(' ```markdown', translate(text, '*_[]`', ''), '``` ') END"""


@query(
    "accept_html",
    oracle(
        "fx_btext",
        f""", b AS (SELECT *, {OLD}, {KIND} AS kind, {ANSWER} AS c FROM fx_btext), s AS (SELECT *, length(c) AS n,
            CASE kind WHEN 'form' THEN length(html) WHEN 'math' THEN length(formatted) WHEN 'equation' THEN length(html) ELSE length(text) END AS old,
            CASE WHEN kind IN ('form','math','equation') THEN lower(c) LIKE '%no corrections needed%' WHEN kind='complex' THEN lower(c) LIKE '%no corrections%' ELSE FALSE END AS keep FROM b),
        e AS (SELECT *, c IS NULL OR (NOT keep AND CASE kind WHEN 'form' THEN n<0.33*old WHEN 'math' THEN n=0 OR n<0.6*old WHEN 'equation' THEN
            n=0 OR n<=0.3*old OR len(string_split(c,'<math'))<>len(string_split(c,'</math>')) WHEN 'image_description' THEN n<10 ELSE n<0.5*old END) AS failed FROM s),
        f AS (SELECT *, CASE WHEN kind='form' THEN 'html' WHEN kind IN ('complex','handwriting') THEN 'markdown' END AS fence FROM e)
        SELECT doc_id, page_id, block_id, failed::INT AS errors, CASE WHEN kind='image_description' AND NOT failed THEN c END AS description,
            CASE WHEN failed OR keep OR kind='image_description' THEN html WHEN fence IS NULL THEN c
                WHEN fence='html' THEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(c,'^\\s+|\\s+$','','g'),'^```(html)?',''),'`+$',''),'^\\s+|\\s+$','','g')
                WHEN plain LIKE '<math>%' THEN plain WHEN plain='' THEN '' ELSE '<p>'||replace(plain, '&', '&amp;')||'</p>' END AS html
        FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(c,'^\\s+|\\s+$','','g'),'^```(markdown)?',''),'`+$',''),'^\\s+|\\s+$','','g') AS plain FROM f) p""",
    ),
)
def accept_html(spark, d):
    """Each block gets one of nine answers to a request of one of six kinds."""
    b = _blocks(spark, d).withColumn("formatted", F.concat("text", F.lit(" *"))).withColumn("kind", F.expr(KIND)).withColumn("corrected", F.expr(ANSWER))
    out = None
    for kind in op.ACCEPT:
        own = b.where(F.col("kind") == kind)
        part = op.accept_html(own.drop("corrected"), own.where("corrected is not null").select(*KEY, "corrected"), kind)
        out = part if out is None else out.unionByName(part)
    return out


@query("response_json", oracle("fx_btext", "SELECT doc_id, page_id, block_id, CASE WHEN block_id%4=3 THEN NULL ELSE 'v'||block_id END AS value FROM fx_btext"))
def response_json(spark, d):
    plain = F.concat(F.lit('{"value":"v'), F.col("block_id").cast("string"), F.lit('"}'))
    m = F.col("block_id") % 4
    body = F.when(m == 0, plain).when(m == 1, F.concat(F.lit("```json\n"), plain, F.lit("\n```"))).when(m == 2, F.concat(F.lit(" "), plain)).otherwise(F.lit("not json {"))
    return _blocks(spark, d).select(*KEY, op.response_json(body, "struct<value:string>").getField("value").alias("value"))


@query("rewrites_join", oracle("fx_btext", "SELECT doc_id, page_id, block_id, CASE WHEN block_id%3=0 THEN '<p>new</p>' ELSE '<p>'||text||'</p>' END AS html FROM fx_btext"))
def rewrites_join(spark, d):
    b = _blocks(spark, d)
    ref = F.concat(F.lit("/page/"), F.col("page_id").cast("string"), F.lit("/Text/"), (F.col("block_id") + F.when(F.col("block_id") % 3 == 0, 0).otherwise(900)).cast("string"))
    return op.apply_rewrites(b, b.select("doc_id", ref.alias("ref"), F.lit("<p>new</p>").alias("html")))


@query("accept_headers", oracle("fx_btext", "SELECT doc_id, page_id, block_id, CASE WHEN doc_id%2=0 AND page_id=0 AND block_id=0 THEN '<h1>t</h1>' ELSE '<p>'||text||'</p>' END AS html FROM fx_btext"))
def accept_headers(spark, d):
    b = _blocks(spark, d)
    kind = F.when(F.col("doc_id") % 2 == 0, "corrections_needed").otherwise("no_corrections")
    body = F.concat(F.lit('{"correction_type":"'), kind, F.lit('","blocks":[{"id":"/page/0/Text/0","html":"<h1>t</h1>"},{"id":"/page/999/Text/0","html":"x"}]}'))
    return op.accept_headers(b, b.select("doc_id").distinct().select("doc_id", body.alias("body")))


# Answer of each page in the queries: which correction, and what is wrong with its ids.
SORT = "CASE (doc_id + page_id) % 4 WHEN 0 THEN 'reorder' WHEN 1 THEN 'reorder_first' WHEN 2 THEN 'rewrite' ELSE 'no_corrections' END"


@query(
    "accept_page",
    oracle(
        "fx_btext",
        f"""SELECT doc_id, page_id, block_id, '<p>'||text||'</p>' || CASE WHEN sort='rewrite' AND block_id%2=0 THEN '!' ELSE '' END AS html, sort='reorder_first' AS again,
            CASE WHEN sort IN ('reorder','reorder_first') AND (page_id%2=0 OR n=1) THEN (row_number() OVER (PARTITION BY doc_id, page_id ORDER BY block_id DESC)-1)::INT ELSE block_id END AS place
        FROM (SELECT *, {SORT} AS sort, count(*) OVER (PARTITION BY doc_id, page_id) AS n FROM fx_btext)""",
    ),
)
def accept_page(spark, d):
    """Ids in reverse, on odd pages without the last block; rewritten blocks end in `!`, on every other page as a text in the text."""
    b = _blocks(spark, d)
    sort = F.expr(SORT)
    ref = F.concat_ws("/", "page_id", "block_type", "block_id")
    new = F.when(F.col("block_id") % 2 == 0, F.concat("html", F.lit("!"))).otherwise(F.col("html"))
    row = F.struct("block_id", F.struct(F.when(sort == "rewrite", F.concat(F.lit(" /page/"), ref)).otherwise(ref).alias("id"), F.when(sort == "rewrite", new).alias("html")).alias("r"))
    page = b.groupBy(*PAGE).agg(F.reverse(F.array_sort(F.collect_list(row))).alias("rows"))
    kept = F.when((F.col("page_id") % 2 == 1) & (F.size("rows") > 1) & (sort != "rewrite"), F.slice("rows", 2, F.size("rows"))).otherwise(F.col("rows"))
    items = F.to_json(F.transform(kept, lambda r: r["r"]))
    whole = F.to_json(F.struct(sort.alias("correction_type"), items.alias("blocks")))
    body = F.when(F.col("page_id") % 2 == 0, whole).otherwise(F.concat(F.lit('{"correction_type":"'), sort, F.lit('","blocks":'), items, F.lit("}")))
    return op.accept_page(b, page.select(*PAGE, body.alias("body")))


PAGES = PAGED + r", sp AS (SELECT doc_id, string_split_regex(md, '\{[0-9]+\}-{48}\n\n') AS p FROM pd), pp AS (SELECT doc_id, unnest(p[2:]) AS md, (generate_subscripts(p[2:],1)-1)::INT AS page FROM sp), ch AS (SELECT doc_id, floor(page/3)::INT AS chunk, string_agg(md, chr(10)||chr(10) ORDER BY page) AS md FROM pp GROUP BY ALL) "


def _chunks(spark, d):
    return op.page_chunks(op.split_pages_md(markdown(spark, d, paginate=True)))


@query("page_chunks", oracle("fx_btext", PAGES + "SELECT * FROM ch"))
def page_chunks(spark, d):
    return _chunks(spark, d)


@query("chunk_requests", oracle("fx_btext", PAGES + "SELECT doc_id, chunk, md||chr(10)||'{\"type\":\"object\"}' AS prompt FROM ch"))
def chunk_requests(spark, d):
    return op.chunk_requests(_chunks(spark, d), '{"type":"object"}')


@query("assemble_notes", oracle("fx_btext", PAGES + "SELECT doc_id, string_agg('Page '||(chunk+1)||chr(10)||'n'||length(md), chr(10)||chr(10) ORDER BY chunk) AS notes FROM ch GROUP BY doc_id"))
def assemble_notes(spark, d):
    return op.assemble_notes(_chunks(spark, d).select("doc_id", "chunk", F.concat(F.lit("n"), F.length("md").cast("string")).alias("detailed_notes")))


@query("extraction_result", oracle("fx_btext", PAGED + "SELECT doc_id, CASE WHEN doc_id%3<>0 THEN 'a'||doc_id END AS analysis, CASE WHEN doc_id%3<>0 THEN '{}' END AS document_json, md FROM pd"))
def extraction_result(spark, d):
    md = markdown(spark, d, paginate=True).select("doc_id", "md")
    whole = F.concat(F.lit('{"analysis":"a'), F.col("doc_id").cast("string"), F.lit('","document_json":"```json\\n{}\\n```"}'))
    return op.extraction_result(md.select("doc_id", F.when(F.col("doc_id") % 3 != 0, whole).otherwise(F.lit('{"analysis":"x"}')).alias("body")), md)


@query("call_service")
def call_service(spark, d):
    """The echo of a service: length of each prompt."""
    requests = op.build_requests(_blocks(spark, d), "complex", "{extracted_text}")
    return op.call_service(requests, lambda prompt: {"length": len(prompt), "tokens": len(prompt.split())})


@query("predict_pages")
def predict_pages(spark, d):
    """A page model slot with a small rule in place of a model: the share of a page that its blocks cover."""
    pages = fixture(spark, d, "fx_btext").select(*PAGE, "block_id", "x0", "y0", "x1", "y1")

    def share(b):
        return b[[*PAGE, "block_id"]].assign(share=(b["x1"] - b["x0"]) * (b["y1"] - b["y0"]) / (612.0 * 792.0))

    return op.predict_pages(pages, share, "doc_id long, page_id int, block_id int, share double", batch_size=64)


@query("text_error_labels", oracle("fx_btext", r"SELECT doc_id, page_id, block_id, CASE WHEN length(text)=0 OR len(regexp_extract_all(text,'\s+'))/greatest(1,len(regexp_extract_all(text,'\s+'))+len(regexp_extract_all(text,'\S')))>0.7 OR len(regexp_extract_all(text,'\n+'))/greatest(1,len(regexp_extract_all(text,'\n+'))+len(regexp_extract_all(text,'[^\n]')))>0.6 OR (length(replace(replace(text,' ',''),chr(10),''))>0 AND len(regexp_extract_all(text,'[\p{L}\p{N}]'))/greatest(1,length(replace(replace(text,' ',''),chr(10),'')))<0.3) THEN 'bad' ELSE 'good' END AS label FROM fx_btext"))
def text_error_labels(spark, d):
    """Good or bad per text; a user's model can stand in for the rule."""
    return op.text_error_labels(fixture(spark, d, "fx_btext")).select(*KEY, "label")

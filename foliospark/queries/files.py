"""Sources, admission and routing over file arrivals, pages and documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import markup
from ..sources import files as f, outputs
from ..sources.fixtures import fixture, oracle
from .registry import query

EXT = r"lower(regexp_extract(name, '(\.[^./]+)$', 1))"
MIME = "CASE WHEN head_hex LIKE '255044462D%' THEN 'application/pdf' WHEN head_hex LIKE 'FFD8FF%' THEN 'image/jpeg' WHEN head_hex LIKE '89504E470D0A1A0A%' THEN 'image/png' WHEN head_hex LIKE '504B0304%' THEN 'application/zip' END"


def _files(spark, d):
    return fixture(spark, d, "fx_arrivals")


def _file_query(name, make, sql):
    @query(name, oracle("fx_arrivals", f"SELECT file_id, {sql} FROM fx_arrivals"))
    def run(spark, d):
        return _files(spark, d).select("file_id", *make(F.col("name"), F.col("head_hex")))


_file_query("file_ext", lambda n, h: [f.file_ext(n).alias("ext")], f"{EXT} AS ext")
_file_query("sanitize_name", lambda n, h: [f.sanitize_name(F.concat(F.lit("../up/"), n)).alias("clean")], "name AS clean")
_file_query("file_type", lambda n, h: [f.file_type(n).alias("file_type")], "CASE WHEN lower(name) LIKE '%.pdf' THEN 'pdf' ELSE 'image' END AS file_type")
_file_query("sniff_mime", lambda n, h: [f.sniff_mime(h).alias("mime")], f"{MIME} AS mime")
_file_query("route_provider", lambda n, h: [f.route_provider(n, h, F.when(F.col("file_id") % 5 == 0, F.lit("<p>x</p>")).otherwise(F.lit("x"))).alias("provider")], f"""CASE WHEN {MIME} LIKE 'image/%' THEN 'image' WHEN {MIME}='application/pdf' THEN 'pdf' WHEN {MIME}='application/zip' AND name LIKE '%.docx' THEN 'docx'
  WHEN file_id%5=0 THEN 'html' WHEN regexp_matches(name,'\\.(jpg|jpeg|png|gif|webp|bmp|tiff|tif)$') THEN 'image' WHEN name LIKE '%.docx' THEN 'docx' ELSE 'pdf' END AS provider""")
_file_query("output_path", lambda n, h: [f.output_path(n, "out").alias("path")], "'out/' || regexp_replace(name, '\\.[^.]*$', '') AS path")
_file_query("result_name", lambda n, h: [f.result_name(n, k).alias(k) for k in ("markdown", "notes", "crop")], "regexp_replace(name,'\\.[^.]+$','.md') AS markdown, regexp_replace(name,'\\.[^.]+$','_notes.txt') AS notes, regexp_replace(name,'\\.[^.]+$','_notes_crop.png') AS crop")

REASON = f"CASE WHEN {EXT} NOT IN ('.pdf','.jpg','.jpeg','.png','.gif','.webp','.bmp','.tiff','.tif') THEN 'Unsupported file type' WHEN size > 52428800 THEN 'File too large (max 50MB)' WHEN coalesce({MIME},'') NOT IN ('application/pdf','image/jpeg','image/png') THEN 'File content does not match a supported type' END"


@query("admit_files", oracle("fx_arrivals", f"SELECT file_id, name, CASE WHEN ({REASON})='Unsupported file type' THEN 0 ELSE size END AS size, {REASON} AS reason, ({REASON}) IS NULL AS admitted FROM fx_arrivals"))
def admit_files(spark, d):
    return f.admit_files(_files(spark, d)).select("file_id", "name", "size", "reason", "admitted")


@query("cap_batch", oracle("fx_arrivals", "SELECT file_id, user_id, batch_size FROM (SELECT file_id, split_part(name,'.',1) AS user_id, count(*) OVER (PARTITION BY split_part(name,'.',1)) AS batch_size FROM fx_arrivals) WHERE batch_size <= 50"))
def cap_batch(spark, d):
    return f.cap_batch(_files(spark, d).select("file_id", F.split_part("name", F.lit("."), F.lit(1)).alias("user_id")), "user_id").select("file_id", "user_id", "batch_size")


HALVES = ", e AS (SELECT file_id, name, size%1000 AS size FROM fx_arrivals WHERE success), n AS (SELECT file_id, name, size%1000 AS size FROM fx_arrivals WHERE NOT success OR name LIKE '%.pdf') "


@query("dedup_selection", oracle("fx_arrivals", f"{HALVES} SELECT * FROM e UNION ALL SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.name=n.name AND e.size=n.size)"))
def dedup_selection(spark, d):
    a = _files(spark, d).withColumn("size", F.col("size") % 1000)
    pick = lambda x: x.select("file_id", "name", "size")
    return f.dedup_selection(pick(a.where(~F.col("success") | F.col("name").endswith(".pdf"))), pick(a.where("success")))


@query("select_by_name", oracle("fx_arrivals", "SELECT file_id, name FROM fx_arrivals WHERE name IN (SELECT name FROM fx_arrivals WHERE NOT success)"))
def select_by_name(spark, d):
    a = _files(spark, d)
    return f.select_by_name(a.select("file_id", "name"), a.where(~F.col("success")))


@query("client_type_filter", oracle("fx_arrivals", f"SELECT coalesce({MIME},'') IN ('application/pdf','image/jpeg','image/png') OR regexp_matches(lower(name),'\\.(pdf|jpe?g|png|gif|webp|bmp|tiff?)$') AS kept, count(*) AS n FROM fx_arrivals GROUP BY 1"))
def client_type_filter(spark, d):
    return _files(spark, d).groupBy(f.client_type_ok(f.sniff_mime(F.col("head_hex")), F.col("name")).alias("kept")).agg(F.count("*").alias("n"))


CHUNKS = ", c AS (SELECT file_id, name, split_part(name,'.',2) AS folder, row_number() OVER (PARTITION BY split_part(name,'.',2) ORDER BY name, file_id) AS rn, count(*) OVER (PARTITION BY split_part(name,'.',2)) AS n FROM fx_arrivals) "


def _chunks(spark, d):
    return f.chunk_assign(_files(spark, d).select("file_id", "name", F.split_part("name", F.lit("."), F.lit(2)).alias("folder")), 4, "folder", ["name", "file_id"])


@query("chunk_assign", oracle("fx_arrivals", f"{CHUNKS} SELECT file_id, folder, floor((rn-1)/ceil(n/4))::INT AS chunk FROM c"))
def chunk_assign(spark, d):
    return _chunks(spark, d).select("file_id", "folder", "chunk")


@query("limit_files", oracle("fx_arrivals", f"{CHUNKS} SELECT file_id, folder, chunk FROM (SELECT *, row_number() OVER (PARTITION BY folder, chunk ORDER BY name, file_id) AS k FROM (SELECT *, floor((rn-1)/ceil(n/4))::INT AS chunk FROM c)) WHERE k <= 10"))
def limit_files(spark, d):
    return f.limit_files(_chunks(spark, d), ["folder", "chunk"], ["name", "file_id"], 10).select("file_id", "folder", "chunk")


@query("skip_existing", oracle("fx_arrivals fx_outputs", "SELECT file_id, name FROM fx_arrivals WHERE regexp_replace(name,'\\.[^.]*$','') NOT IN (SELECT base FROM fx_outputs WHERE ext IN ('md','html','json'))"))
def skip_existing(spark, d):
    return f.skip_existing(_files(spark, d), fixture(spark, d, "fx_outputs")).select("file_id", "name")


@query("page_range", oracle("fx_pages", "SELECT doc_id, page_id FROM fx_pages WHERE page_id IN (0, 2, 3, 4, 7)"))
def page_range(spark, d):
    return f.select_pages(fixture(spark, d, "fx_pages"), "0,2-4,7").select("doc_id", "page_id")


@query("check_page_range", oracle("fx_pages", "SELECT doc_id, count(DISTINCT page_id) AS n_pages, 4 >= count(DISTINCT page_id) AS violation FROM fx_pages GROUP BY doc_id"))
def check_page_range(spark, d):
    return f.check_page_range(fixture(spark, d, "fx_pages"), "0,2-4")


@query("html_escape5", "SELECT page_id, replace(replace(replace(replace(replace(html,'&','&amp;'),'<','&lt;'),'>','&gt;'),'\"','&quot;'),'''','&#39;') AS escaped FROM pages")
def html_escape5(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", t.escape5(F.col("html")).alias("escaped"))


@query("latex_md_clean", r"SELECT page_id, replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace('::: [a] `\cite`' || html, '[\x{A0}\x{2002}\x{2003}]', ' ', 'g'), '`\cite`', ''), '<[^>]*>', '', 'g'), '\{[^}]*\}', '', 'g'), '\\cite\{[^}]*\}', '', 'g'), '::: ', ''), '[', ''), ']', '') AS text FROM pages")
def latex_md_clean(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", t.latex_md_clean(F.concat(F.lit("::: [a] `\\cite`"), "html")).alias("text"))


ANCHORS = ", r AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS src FROM pages), i AS (SELECT DISTINCT src AS file_name, 'data:' || src AS data FROM r WHERE length(src)%2=0) "


@query("epub_image_join", "WITH x AS (SELECT 1)" + ANCHORS + "SELECT page_id, coalesce(i.data, r.src2) AS src FROM (SELECT page_id, CASE WHEN page_id%2=1 THEN '../' || src ELSE src END AS src2 FROM r) r LEFT JOIN i ON replace(r.src2,'../','')=i.file_name")
def epub_image_join(spark, d):
    """A source with every ../ removed is looked up among the images; without a match it stays."""
    refs = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("src"))
    images = refs.where(F.length("src") % 2 == 0).select(F.col("src").alias("file_name"), F.concat(F.lit("data:"), "src").alias("data")).distinct()
    refs = refs.withColumn("src", F.when(F.col("page_id") % 2 == 1, F.concat(F.lit("../"), "src")).otherwise(F.col("src")))
    return markup.epub_image_join(refs, images, ["page_id"])


LISTED = f"""WITH x AS (SELECT 'p'||page_id||CASE page_id%3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.html' ELSE '.exe' END AS name, CASE page_id%6 WHEN 0 THEN '%PDF-' ELSE '' END||html AS content FROM pages),
    y AS (SELECT name, octet_length(encode(content)) AS size, left(hex(content), 16) AS head_hex FROM x),
    z AS (SELECT name, size, {REASON} AS reason FROM y) SELECT name, CASE WHEN reason='Unsupported file type' THEN 0 ELSE size END AS size, reason FROM z"""


@query("scan_files", LISTED)
def scan_files(spark, d):
    """The pages as files of one folder, with another folder inside; listed, and each asked whether it is admitted."""
    folder, n = f"{outputs.shared_folder(spark)}/scan-{uuid.uuid4().hex}", F.col("page_id")
    name = F.concat(F.lit("p"), n.cast("string"), F.when(n % 3 == 0, ".pdf").when(n % 3 == 1, ".html").otherwise(".exe"))
    content = F.encode(F.concat(F.when(n % 6 == 0, "%PDF-").otherwise(""), "html"), "utf-8")
    docs = spark.read.parquet(f"{d}/pages.parquet").select(F.lit("in").alias("name"), F.lit("txt").alias("ext"), F.lit("").alias("text"), F.create_map(name, content).alias("images"))
    outputs.write_documents(docs, folder)
    outputs.write_documents(docs.limit(1), f"{folder}/in")
    found = outputs.scan_files(spark, f"{folder}/in", head=8).where(F.col("name").startswith("p"))
    return f.admit_files(found).select("name", "size", "reason")

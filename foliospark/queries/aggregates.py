"""Statistics, windows, sets."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import aggregates as op
from ..sources.files import admission_reason
from ..sources.fixtures import fixture, oracle
from .registry import query

PAGE = op.PAGE


def r6(*cols):
    return [F.round(F.col(c), 6).alias(c) for c in cols]


@query("raw_text", oracle("fx_lines", "SELECT doc_id, page_id, block_no, string_agg(text || chr(10), '' ORDER BY line_no) AS text FROM fx_lines GROUP BY ALL"))
def raw_text(spark, d):
    return op.raw_text(fixture(spark, d, "fx_lines"))


@query("line_height", oracle("fx_lines fx_boxes", "SELECT doc_id, page_id, block_id, round((b.y1-b.y0)/(SELECT count(*) FROM fx_lines l WHERE l.doc_id=b.doc_id AND l.page_id=b.page_id AND l.block_no=b.block_id),6) AS line_height FROM fx_boxes b"))
def line_height(spark, d):
    return op.line_height(fixture(spark, d, "fx_boxes"), fixture(spark, d, "fx_lines")).select(*PAGE, "block_id", *r6("line_height"))


@query("header_line_height", oracle("fx_lines fx_boxes", "SELECT doc_id, page_id, block_id, round((b.y1-b.y0)/(SELECT count(*) FROM fx_lines l WHERE l.doc_id=b.doc_id AND l.page_id=b.page_id AND l.block_no=b.block_id),6) AS line_height FROM fx_boxes b WHERE block_type='SectionHeader'"))
def header_line_height(spark, d):
    return op.line_height(fixture(spark, d, "fx_boxes").where("block_type = 'SectionHeader'"), fixture(spark, d, "fx_lines")).select(*PAGE, "block_id", *r6("line_height"))


COUNTS = ", c AS (SELECT doc_id, page_id, block_type, count(*) AS n FROM fx_boxes GROUP BY ALL) "


@query("page_stats", oracle("fx_pages fx_boxes", COUNTS + "SELECT p.doc_id, p.page_id, p.method, coalesce(string_agg(block_type||':'||n, ',' ORDER BY n DESC, block_type),'') AS block_counts FROM fx_pages p LEFT JOIN c USING (doc_id, page_id) GROUP BY ALL"))
def page_stats(spark, d):
    return op.page_stats(fixture(spark, d, "fx_boxes"), fixture(spark, d, "fx_pages"))


@query("block_type_topk", oracle("fx_boxes", "SELECT doc_id, block_type, n, rank::INT AS rank FROM (SELECT doc_id, block_type, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, block_type) AS rank FROM fx_boxes GROUP BY doc_id, block_type) WHERE rank<=2"))
def block_type_topk(spark, d):
    return op.block_type_topk(fixture(spark, d, "fx_boxes"), 2)


EVENTS = ", ev AS (SELECT doc_id, page_id, block_id, CASE WHEN (doc_id+block_id)%4=0 THEN 'error' ELSE 'request' END AS kind, length(text) AS tokens FROM fx_btext WHERE block_id<>5 UNION ALL SELECT doc_id, page_id, block_id, 'request', 10 FROM fx_btext WHERE block_id<3) , ct AS (SELECT b.doc_id, b.page_id, b.block_id, count(*) FILTER (kind='request') AS q, count(*) FILTER (kind='error') AS e, coalesce(sum(tokens),0) AS t FROM fx_btext b LEFT JOIN ev USING (doc_id, page_id, block_id) GROUP BY ALL) "


def _counters(spark, d):
    b = fixture(spark, d, "fx_btext")
    kind = F.when((F.col("doc_id") + F.col("block_id")) % 4 == 0, "error").otherwise("request").alias("kind")
    events = b.where("block_id <> 5").select(*PAGE, "block_id", kind, F.length("text").alias("tokens")).union(b.where("block_id < 3").select(*PAGE, "block_id", F.lit("request"), F.lit(10)))
    return op.update_metadata(b, events)


@query("update_metadata", oracle("fx_btext", EVENTS + "SELECT doc_id, page_id, block_id, q::BIGINT AS llm_request_count, e::BIGINT AS llm_error_count, t::BIGINT AS llm_tokens_used FROM ct"))
def update_metadata(spark, d):
    return _counters(spark, d)


@query("merge_metadata", oracle("fx_btext", EVENTS + "SELECT doc_id, page_id, sum(q)::BIGINT AS llm_request_count, sum(e)::BIGINT AS llm_error_count, sum(t)::BIGINT AS llm_tokens_used FROM ct GROUP BY ALL"))
def merge_metadata(spark, d):
    return op.merge_metadata(_counters(spark, d))


@query("token_usage", oracle("fx_btext", EVENTS + "SELECT doc_id, sum(q)::BIGINT AS requests, sum(t)::BIGINT AS tokens FROM ct GROUP BY ALL"))
def token_usage(spark, d):
    return _counters(spark, d).groupBy("doc_id").agg(F.sum("llm_request_count").alias("requests"), F.sum("llm_tokens_used").alias("tokens"))


def _arrivals(spark, d):
    return fixture(spark, d, "fx_arrivals").withColumn("batch", F.split_part("name", F.lit("."), F.lit(1)))


@query("batch_summary", oracle("fx_arrivals", "SELECT split_part(name,'.',1) AS batch, count(*) AS total, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed FROM fx_arrivals GROUP BY 1"))
def batch_summary(spark, d):
    return op.batch_summary(_arrivals(spark, d), ["batch"])


@query("total_time", oracle("fx_arrivals", "SELECT split_part(name,'.',1) AS batch, round(sum(processing_time),4) AS total, round(sum(CASE WHEN success THEN processing_time ELSE 0 END),4) AS succeeded, round(sum(CASE WHEN success THEN 0 ELSE processing_time END),4) AS failed FROM fx_arrivals GROUP BY 1"))
def total_time(spark, d):
    return op.total_time(_arrivals(spark, d), ["batch"]).select("batch", *[F.round(c, 4).alias(c) for c in ("total", "succeeded", "failed")])


@query("total_size", oracle("fx_arrivals", "SELECT split_part(name,'.',1) AS batch, sum(size)::BIGINT AS total_size FROM fx_arrivals GROUP BY 1"))
def total_size(spark, d):
    return _arrivals(spark, d).groupBy("batch").agg(F.sum("size").alias("total_size"))


@query("throughput", oracle("fx_arrivals", "SELECT split_part(name,'.',1) AS batch, sum(size%20)::BIGINT AS pages, sum(size%97)::BIGINT AS seconds, round(CASE WHEN sum(size%97)>0 THEN sum(size%20)/sum(size%97) END,6) AS pages_per_second FROM fx_arrivals GROUP BY 1"))
def throughput(spark, d):
    a = _arrivals(spark, d).select("batch", (F.col("size") % 20).alias("pages"), (F.col("size") % 97).alias("seconds"))
    return op.throughput(a, "batch").select("batch", "pages", "seconds", *r6("pages_per_second"))


@query("timeout_rows", oracle("fx_arrivals", "SELECT file_id, success AND processing_time<=60 AS success, CASE WHEN processing_time>60 THEN 'Processing timed out after 60s' END AS error FROM fx_arrivals"))
def timeout_rows(spark, d):
    return op.timeout_rows(_arrivals(spark, d), 60.0).select("file_id", "success", "error")


@query("conversion_results", oracle("fx_arrivals", """SELECT file_id, error IS NULL AS success, error, processing_time FROM (SELECT file_id, processing_time, CASE WHEN lower(regexp_extract(name,'(\\.[^./]+)$',1)) NOT IN ('.pdf','.jpg','.jpeg','.png','.gif','.webp','.bmp','.tiff','.tif') THEN 'Unsupported file type' WHEN size>52428800 THEN 'File too large (max 50MB)'
 WHEN NOT coalesce(head_hex LIKE '255044462D%' OR head_hex LIKE 'FFD8FF%' OR head_hex LIKE '89504E47%',false) THEN 'File content does not match a supported type' WHEN size%7=0 THEN 'Quality check failed' WHEN processing_time>40 THEN 'Processing timed out' WHEN NOT success THEN 'Conversion failed' END AS error FROM fx_arrivals)"""))
def conversion_results(spark, d):
    a = _arrivals(spark, d)
    files = a.select("file_id", admission_reason(F.col("name"), F.col("size"), F.col("head_hex")).alias("reason"))
    return op.conversion_results(files, a.select("file_id", (F.col("size") % 7 != 0).alias("passed")), a, 40.0)


HEAD = ", h AS (SELECT doc_id, page_id, block_id, CASE WHEN block_type='SectionHeader' THEN 1+page_id%3 WHEN block_type='Equation' THEN 4 END AS lv FROM fx_boxes) "


@query("section_hierarchy", oracle("fx_boxes", HEAD + "SELECT b.doc_id, b.page_id, b.block_id, coalesce((SELECT string_agg(x.lv||':'||x.page_id||'/'||x.block_id, ',' ORDER BY x.lv) FROM h x WHERE x.doc_id=b.doc_id AND x.lv IS NOT NULL AND x.page_id*100+x.block_id<=b.page_id*100+b.block_id AND NOT EXISTS (SELECT 1 FROM h y WHERE y.doc_id=b.doc_id AND y.lv<=x.lv AND y.page_id*100+y.block_id>x.page_id*100+x.block_id AND y.page_id*100+y.block_id<=b.page_id*100+b.block_id)),'') AS hierarchy FROM h b"))
def section_hierarchy(spark, d):
    level = F.when(F.col("block_type") == "SectionHeader", 1 + F.col("page_id") % 3).when(F.col("block_type") == "Equation", 4)
    return op.section_hierarchy(fixture(spark, d, "fx_boxes").withColumn("heading_level", level)).select(*PAGE, "block_id", "hierarchy")


def _in_document():
    return Window.partitionBy("doc_id").orderBy("page_id", "block_id")


@query("win_rank", oracle("fx_boxes", "SELECT doc_id, page_id, block_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_id, block_id)::INT AS place FROM fx_boxes"))
def win_rank(spark, d):
    return fixture(spark, d, "fx_boxes").select(*PAGE, "block_id", F.row_number().over(_in_document()).alias("place"))


@query("win_dense", oracle("fx_cells", "SELECT cell_id, table_id, (dense_rank() OVER (PARTITION BY table_id ORDER BY row_id)-1)::INT AS row_index FROM fx_cells"))
def win_dense(spark, d):
    return fixture(spark, d, "fx_cells").select("cell_id", "table_id", (F.dense_rank().over(Window.partitionBy("table_id").orderBy("row_id")) - 1).alias("row_index"))


@query("win_lag_lead", oracle("fx_boxes", "SELECT doc_id, page_id, block_id, lag(block_type) OVER w AS before, lead(block_type) OVER w AS after FROM fx_boxes WINDOW w AS (PARTITION BY doc_id ORDER BY page_id, block_id)"))
def win_lag_lead(spark, d):
    return fixture(spark, d, "fx_boxes").select(*PAGE, "block_id", F.lag("block_type").over(_in_document()).alias("before"), F.lead("block_type").over(_in_document()).alias("after"))


@query("win_last_known", oracle("fx_boxes", "SELECT a.doc_id, a.page_id, a.block_id, coalesce((SELECT max(b.block_id) FROM fx_boxes b WHERE b.doc_id=a.doc_id AND b.page_id=a.page_id AND b.block_id<=a.block_id AND b.block_type<>'Text'), (SELECT min(b.block_id) FROM fx_boxes b WHERE b.doc_id=a.doc_id AND b.page_id=a.page_id AND b.block_id>a.block_id AND b.block_type<>'Text')) AS known FROM fx_boxes a"))
def win_last_known(spark, d):
    w = Window.partitionBy(*PAGE).orderBy("block_id")
    key = F.when(F.col("block_type") != "Text", F.col("block_id"))
    before, after = F.last(key, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(key, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return fixture(spark, d, "fx_boxes").select(*PAGE, "block_id", F.coalesce(before, after).alias("known"))


STREAK = ", g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_id, block_id) - row_number() OVER (PARTITION BY doc_id, block_type ORDER BY page_id, block_id) AS grp FROM fx_boxes), s AS (SELECT doc_id, block_type, grp, count(*) AS n FROM g GROUP BY ALL) "


@query("win_streak", oracle("fx_boxes", STREAK + "SELECT doc_id, block_type, max(n) AS longest FROM s GROUP BY ALL"))
def win_streak(spark, d):
    from ..operators.processors import longest_streak

    return longest_streak(fixture(spark, d, "fx_boxes"), ["doc_id"], "block_type", ["page_id", "block_id"])


@query("win_running_shift", oracle("fx_cells", "SELECT DISTINCT table_id, row_id, coalesce(sum(d) OVER (PARTITION BY table_id ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::BIGINT AS shift FROM (SELECT table_id, row_id, max(len(string_split(text,'<br>')))-1 AS d FROM fx_cells GROUP BY ALL)"))
def win_running_shift(spark, d):
    rows = fixture(spark, d, "fx_cells").groupBy("table_id", "row_id").agg((F.max(F.size(F.split("text", "<br>"))) - 1).alias("d"))
    w = Window.partitionBy("table_id").orderBy("row_id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("table_id", "row_id", F.coalesce(F.sum("d").over(w), F.lit(0)).alias("shift"))


@query("win_ratio", oracle("fx_lines", "SELECT DISTINCT doc_id, page_id, round(avg(CASE WHEN length(text)>40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_id),6) AS ratio FROM fx_lines"))
def win_ratio(spark, d):
    return fixture(spark, d, "fx_lines").groupBy(*PAGE).agg(F.round(F.avg((F.length("text") > 40).cast("int")), 6).alias("ratio"))


@query("cell_order", oracle("fx_cells", "SELECT table_id, string_agg(text, ',' ORDER BY row_id, col_id) AS cells FROM fx_cells GROUP BY table_id"))
def cell_order(spark, d):
    return fixture(spark, d, "fx_cells").groupBy("table_id").agg(op.joined(F.col("text"), ",", "row_id", "col_id").alias("cells"))


@query("union_lines", oracle("fx_lines", "SELECT doc_id, page_id, line_no, rank, row_number() OVER (PARTITION BY doc_id, page_id ORDER BY rank, line_no)::INT AS place FROM (SELECT doc_id, page_id, line_no, 0 AS rank FROM fx_lines UNION ALL SELECT doc_id, page_id, line_no, 1 FROM fx_lines WHERE block_type='Table')"))
def union_lines(spark, d):
    lines = fixture(spark, d, "fx_lines")
    both = lines.select(*PAGE, "line_no", F.lit(0).alias("rank")).unionByName(lines.where("block_type = 'Table'").select(*PAGE, "line_no", F.lit(1).alias("rank")))
    return both.withColumn("place", F.row_number().over(Window.partitionBy(*PAGE).orderBy("rank", "line_no")))


@query("same_set", oracle("fx_boxes", "SELECT doc_id, page_id, count(*)=10 AS same FROM fx_boxes GROUP BY ALL"))
def same_set(spark, d):
    """Per page, whether its block ids are 0 .. 9: each side contains the other."""
    own = fixture(spark, d, "fx_boxes").groupBy(*PAGE).agg(F.array_sort(F.collect_set("block_id")).alias("ids"))
    want = F.sequence(F.lit(0), F.lit(9))
    return own.select(*PAGE, ((F.size(F.array_except("ids", want)) == 0) & (F.size(F.array_except(want, "ids")) == 0)).alias("same"))


@query("distinct_dedup", oracle("fx_notes", "SELECT file_id, ord, text FROM (SELECT *, row_number() OVER (PARTITION BY file_id, lower(text) ORDER BY ord) AS k FROM fx_notes) WHERE k=1"))
def distinct_dedup(spark, d):
    w = Window.partitionBy("file_id", F.lower("text")).orderBy("ord")
    return fixture(spark, d, "fx_notes").withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")

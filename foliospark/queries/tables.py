"""Table operators over the cell fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import processors, tables as op
from ..sources.fixtures import fixture, oracle
from .registry import query


def _cells(spark, d):
    return fixture(spark, d, "fx_cells")


@query("text_to_cell", oracle("fx_cells", "SELECT table_id, cell_id, text FROM fx_cells WHERE col_id<>3 OR row_id>0 UNION ALL SELECT table_id, cell_id, text FROM fx_cells WHERE col_id=3 AND row_id=0"))
def text_to_cell(spark, d):
    c = _cells(spark, d)
    lines = c.select("table_id", F.col("cell_id").alias("line_id"), "text", (F.col("x0") + 3).alias("x0"), (F.col("y0") + 2).alias("y0"), (F.col("x1") + 5).alias("x1"), (F.col("y1") + 1).alias("y1"))
    return op.text_to_cell(lines, c)


DIMS = ", rw AS (SELECT table_id, max(n) AS row_count FROM (SELECT table_id, col_id, sum(rowspan) AS n FROM fx_cells GROUP BY ALL) GROUP BY ALL), cl AS (SELECT table_id, max(n) AS column_count FROM (SELECT table_id, row_id, sum(colspan) AS n FROM fx_cells GROUP BY ALL) GROUP BY ALL), dm AS (SELECT table_id, row_count::BIGINT AS row_count, column_count::BIGINT AS column_count FROM rw JOIN cl USING (table_id)) "


@query("table_dims", oracle("fx_cells", DIMS + "SELECT * FROM dm"))
def table_dims(spark, d):
    return op.table_dims(_cells(spark, d))


@query("validate_merge", oracle("fx_cells", DIMS + "SELECT a.table_id, CASE WHEN a.table_id%2=0 THEN 'right' ELSE 'bottom' END AS direction, CASE WHEN a.table_id%2=0 THEN abs(a.row_count-b.row_count)<5 ELSE abs(a.column_count-b.column_count)<2 END AS ok FROM dm a JOIN dm b ON b.table_id=a.table_id+1"))
def validate_merge(spark, d):
    dims = op.table_dims(_cells(spark, d))
    nxt = dims.select((F.col("table_id") - 1).alias("table_id"), F.col("row_count").alias("rows2"), F.col("column_count").alias("cols2"))
    pairs = dims.select("table_id", F.col("row_count").alias("rows1"), F.col("column_count").alias("cols1")).join(nxt, "table_id").withColumn("direction", F.when(F.col("table_id") % 2 == 0, "right").otherwise("bottom"))
    return op.validate_merge(pairs).select("table_id", "direction", "ok")


@query("join_cells", oracle("fx_cells", DIMS + ", sh AS (SELECT table_id, floor(table_id/8)::BIGINT AS run_id, coalesce(sum(row_count) OVER (PARTITION BY floor(table_id/8) ORDER BY table_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS shift FROM dm) SELECT run_id, table_id, (row_id+shift)::BIGINT AS row_id, col_id, text FROM fx_cells JOIN sh USING (table_id)"))
def join_cells(spark, d):
    c = _cells(spark, d)
    runs = c.select("table_id").distinct().select("table_id", F.floor(F.col("table_id") / 8).alias("run_id"), F.col("table_id").alias("place"))
    return op.join_cells(c, runs, "bottom").select("run_id", "table_id", "row_id", "col_id", "text")


@query("split_combined_rows", oracle("fx_cells", ", s AS (SELECT *, string_split(text,'<br>') AS ln FROM fx_cells), e AS (SELECT *, len(ln) AS n, unnest(ln) AS line, generate_subscripts(ln,1)-1 AS i FROM s) SELECT table_id, (row_id*n+i)::BIGINT AS row_id, col_id, is_header AND i=0 AS is_header, line AS text FROM e"))
def split_combined_rows(spark, d):
    return op.split_combined_rows(_cells(spark, d))


@query("combine_dollar_column", oracle("fx_cells", ", k AS (SELECT table_id, bool_and(text='$') AND count(*)>1 AS fold FROM fx_cells WHERE col_id=1 GROUP BY 1) SELECT c.table_id, c.row_id, CASE WHEN fold AND col_id>=2 THEN col_id-1 ELSE col_id END::INT AS col_id, CASE WHEN fold AND col_id=2 THEN '$' || text ELSE text END AS text FROM fx_cells c JOIN k USING (table_id) WHERE NOT (fold AND col_id=1)"))
def combine_dollar_column(spark, d):
    return op.combine_dollar_column(_cells(spark, d))


@query("table_batches", oracle("fx_cells", ", r AS (SELECT *, dense_rank() OVER (PARTITION BY table_id ORDER BY row_id) AS k, min(y0) OVER (PARTITION BY table_id) AS top FROM fx_cells), q AS (SELECT *, max(k) OVER (PARTITION BY table_id) AS n FROM r) SELECT table_id, floor((k-1)/3)::INT AS chunk, CASE WHEN floor((k-1)/3)=0 THEN 0 ELSE min(y0-top) END::DOUBLE AS y0, max(y1-top) AS y1 FROM q WHERE n<=6 GROUP BY table_id, floor((k-1)/3)"))
def table_batches(spark, d):
    return op.table_batches(_cells(spark, d), 3, 6)


@query("table_rotation", oracle("fx_cells", "SELECT table_id, CASE WHEN table_id%3=0 THEN 90 WHEN table_id%3=1 THEN 270 ELSE 0 END AS rotation FROM fx_cells GROUP BY table_id"))
def table_rotation(spark, d):
    m = F.col("table_id") % 3
    y = F.when(m == 0, 60.0 + 200 * F.col("col_id")).when(m == 1, 900.0 - 200 * F.col("col_id")).otherwise(F.col("y0"))
    c = _cells(spark, d).withColumn("y0", y).withColumn("y1", F.col("y0") + F.when(m == 2, 18.0).otherwise(190.0))
    return op.table_rotation(c)


TD = "'<' || CASE WHEN is_header THEN 'th' ELSE 'td' END || CASE WHEN col_id=2 AND table_id%4=0 THEN ' colspan=2' ELSE '' END || '>' || text || '</' || CASE WHEN is_header THEN 'th' ELSE 'td' END || '>'"


def _spanned(spark, d):
    return _cells(spark, d).withColumn("colspan", F.when((F.col("col_id") == 2) & (F.col("table_id") % 4 == 0), 2).otherwise(1))


@query("cell_html", oracle("fx_cells", f"SELECT table_id, cell_id, {TD} AS html FROM fx_cells"))
def cell_html(spark, d):
    return op.cell_html(_spanned(spark, d)).select("table_id", "cell_id", "html")


@query("table_html", oracle("fx_cells", f", r AS (SELECT table_id, row_id, '<tr>' || string_agg({TD}, '' ORDER BY col_id) || '</tr>' AS html FROM fx_cells GROUP BY ALL) SELECT table_id, '<table><tbody>' || string_agg(html, chr(10) ORDER BY row_id) || '</tbody></table>' AS html FROM r GROUP BY ALL"))
def table_html(spark, d):
    return op.table_html(_spanned(spark, d))


@query("md_table", oracle("fx_cells", ", g AS (SELECT table_id, row_id, col_id, trim(regexp_replace(replace(text,'<br>',' '),'[\\n|]',' ','g')) AS t FROM fx_cells), w AS (SELECT *, max(length(t)) OVER (PARTITION BY table_id, col_id) AS w FROM g), r AS (SELECT table_id, row_id, '| ' || string_agg(rpad(t,w::INT,' '), ' | ' ORDER BY col_id) || ' |' AS line, '|' || string_agg('-'||repeat('-',w)||'-', '|' ORDER BY col_id) || '|' AS rule FROM w GROUP BY ALL) SELECT table_id, string_agg(CASE WHEN row_id=0 THEN line||chr(10)||rule ELSE line END, chr(10) ORDER BY row_id) AS md FROM r GROUP BY ALL"))
def md_table(spark, d):
    return op.md_table(_cells(spark, d))


@query("cells_need_ocr", oracle("fx_cells", "SELECT table_id, cell_id FROM fx_cells WHERE col_id=3 AND table_id%2=0"))
def cells_need_ocr(spark, d):
    c = _cells(spark, d).withColumn("text", F.when(F.col("col_id") != 3, F.col("text")))
    flags = c.select("table_id", (F.col("table_id") % 2 == 0).alias("ocr_block")).distinct()
    return op.cells_need_ocr(c, flags).select("table_id", "cell_id")


@query("table_ocr_flag", oracle("fx_cells", "SELECT DISTINCT table_id, table_id%5=0 OR table_id%7=0 OR table_id%4=0 AS ocr_block FROM fx_cells"))
def table_ocr_flag(spark, d):
    c = _cells(spark, d)
    t = c.select("table_id", F.when(F.col("table_id") % 5 == 0, "ocr").otherwise("embedded").alias("method"), (F.col("table_id") % 7 == 0).alias("ocr_errors_detected")).distinct()
    return op.table_ocr_flag(t, c.where("table_id % 4 <> 0"))


@query("ocr_cell_reject", oracle("fx_cells", "SELECT table_id, cell_id, CASE WHEN row_id%5=3 OR col_id=2 AND table_id%3=1 THEN '' ELSE text END AS text FROM fx_cells"))
def ocr_cell_reject(spark, d):
    c = _cells(spark, d).withColumn("y1", F.when(F.col("row_id") % 5 == 3, F.col("y0") + 4).otherwise(F.col("y1"))).withColumn("is_blank", (F.col("col_id") == 2) & (F.col("table_id") % 3 == 1))
    return op.ocr_cell_reject(c).select("table_id", "cell_id", "text")


@query("ocr_cell_fill", oracle("fx_cells", "SELECT table_id, cell_id, CASE WHEN col_id=3 THEN 'read '||(row_id+1) ELSE text END AS text, CASE WHEN col_id=3 THEN 1 ELSE len(string_split(text,'<br>')) END::INT AS n_lines FROM fx_cells"))
def ocr_cell_fill(spark, d):
    c = _cells(spark, d).withColumn("text", F.when(F.col("col_id") != 3, F.col("text")))
    read = c.where("col_id = 3").select("table_id", (F.col("row_id") + 1).alias("place"), F.concat(F.lit("read "), (F.col("row_id") + 1).cast("string")).alias("text"))
    return op.ocr_cell_fill(c, read).select("table_id", "cell_id", "text", F.size("text_lines").alias("n_lines"))


@query("cell_rebase", oracle("fx_cells", ", t AS (SELECT table_id, min(x0)-0.01*(max(x1)-min(x0)) AS tx, min(y0)-0.01*(max(y1)-min(y0)) AS ty FROM fx_cells GROUP BY 1) SELECT table_id, cell_id, round(x0*0.5+tx,6) AS x0, round(y0*0.5+ty,6) AS y0, round(x1*0.5+tx,6) AS x1, round(y1*0.5+ty,6) AS y1 FROM fx_cells JOIN t USING (table_id)"))
def cell_rebase(spark, d):
    c = _cells(spark, d)
    t = c.groupBy("table_id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return op.cell_rebase(c, t, (1224.0, 1584.0), (612.0, 792.0)).select("table_id", "cell_id", *[F.round(k, 6).alias(k) for k in ("x0", "y0", "x1", "y1")])


@query("form_candidates", oracle("fx_tree", "SELECT doc_id, page_id, block_id FROM fx_tree AS t WHERE block_type='Table' AND page_id%2=0 AND EXISTS (SELECT 1 FROM fx_tree AS c WHERE c.doc_id=t.doc_id AND c.page_id=t.page_id AND c.parent_id=t.block_id)"))
def form_candidates(spark, d):
    """The tables of even pages are taken for forms."""
    b = fixture(spark, d, "fx_tree")
    forms = b.withColumn("block_type", F.when((F.col("block_type") == "Table") & (F.col("page_id") % 2 == 0), "Form").otherwise(F.col("block_type")))
    cells = b.where("block_type = 'TableCell'").select("doc_id", "page_id", F.col("parent_id").alias("block_id"))
    return processors.form_candidates(forms, cells).select("doc_id", "page_id", "block_id")


@query("sheet_to_html", "WITH o AS (SELECT o_orderpriority AS sheet, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey)-1 AS row, o_orderkey, o_orderstatus, o_custkey FROM orders), r AS (SELECT sheet, row, '<tr>' || CASE WHEN row=0 THEN '<td rowspan=\"2\" colspan=\"2\">' || o_orderkey || '</td>' WHEN row=1 THEN '' ELSE '<td>' || o_orderkey || '</td><td>' || o_orderstatus || '</td>' END || '<td>' || o_custkey || '</td></tr>' AS html FROM o) SELECT sheet, '<h1>' || sheet || '</h1><table>' || string_agg(html, '' ORDER BY row) || '</table>' AS html FROM r GROUP BY sheet")
def sheet_to_html(spark, d):
    from pyspark.sql import Window

    o = spark.read.parquet(f"{d}/orders.parquet")
    row = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderkey")) - 1
    values = F.array(F.col("o_orderkey").cast("string"), F.col("o_orderstatus").cast("string"), F.col("o_custkey").cast("string"))
    cells = o.select(F.col("o_orderpriority").alias("sheet"), row.alias("row"), values.alias("v")).select("sheet", "row", F.posexplode("v").alias("col", "value"))
    merged = o.select(F.col("o_orderpriority").alias("sheet")).distinct().select("sheet", *[F.lit(v).alias(k) for k, v in (("min_row", 0), ("min_col", 0), ("max_row", 1), ("max_col", 1))])
    return op.sheet_to_html(cells, merged)

"""Table cells as rows: assignment of text, repair of rows and columns, merging, rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .aggregates import joined
from .layout import argmax_assign

CELL = ["table_id", "row_id", "col_id"]


def text_to_cell(lines: DataFrame, cells: DataFrame) -> DataFrame:
    """Per cell its text lines in order; a line goes to the cell that covers most of it, lines over no cell are dropped.

    lines(table_id, line_id, text, x0..y1), cells(table_id, cell_id, x0..y1).
    """
    a = lines.select("table_id", "line_id", "text", *[F.col(k).alias(f"a_{k}") for k in ("x0", "y0", "x1", "y1")])
    b = cells.select("table_id", "cell_id", *[F.col(k).alias(f"b_{k}") for k in ("x0", "y0", "x1", "y1")])
    side = lambda k: F.greatest(F.lit(0.0), F.least(f"a_{k}1", f"b_{k}1") - F.greatest(f"a_{k}0", f"b_{k}0"))
    pairs = a.join(b, "table_id").withColumn("area", side("x") * side("y")).where("area > 0")
    best = argmax_assign(pairs, ["table_id", "line_id", "text"], "area", "cell_id", ["cell_id"])
    return best.groupBy("table_id", "cell_id").agg(joined(F.col("text"), "\n", "line_id").alias("text"))


def table_dims(cells: DataFrame) -> DataFrame:
    """row_count: most row spans in a column; column_count: most column spans in a row."""
    rows = cells.groupBy("table_id", "col_id").agg(F.sum("rowspan").alias("n")).groupBy("table_id").agg(F.max("n").alias("row_count"))
    cols = cells.groupBy("table_id", "row_id").agg(F.sum("colspan").alias("n")).groupBy("table_id").agg(F.max("n").alias("column_count"))
    return rows.join(cols, "table_id")


def validate_merge(pairs: DataFrame) -> DataFrame:
    """pairs(rows1, cols1, rows2, cols2, direction): right needs rows within 5, bottom columns within 2."""
    ok = F.when(F.col("direction") == "right", F.abs(F.col("rows1") - F.col("rows2")) < 5).otherwise(F.abs(F.col("cols1") - F.col("cols2")) < 2)
    return pairs.withColumn("ok", ok)


def join_cells(cells: DataFrame, runs: DataFrame, direction: str) -> DataFrame:
    """Cells of runs(table_id, run_id, place) as one table: ids are shifted by the sizes of the tables before."""
    dims = table_dims(cells)
    size = F.col("column_count") if direction == "right" else F.col("row_count")
    w = Window.partitionBy("run_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    shift = runs.join(dims, "table_id").withColumn("shift", F.coalesce(F.sum(size).over(w), F.lit(0))).select("table_id", "run_id", "shift")
    moved = "col_id" if direction == "right" else "row_id"
    return cells.join(shift, "table_id").withColumn(moved, (F.col(moved) + F.col("shift")).cast("long"))


def split_combined_rows(cells: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows that hold several rows' text are split: one row a text line, later rows move down.

    A row can be split when all its cells have the same number of lines over one, or when it has over three cells
    of which exactly one has one line. Rows with row spans can't, nor is a table touched with less than half of its
    rows splittable.
    """
    c = cells.withColumn("_lines", F.split("text", "<br>")).withColumn("_n", F.size("_lines"))
    rows = c.groupBy("table_id", "row_id").agg(F.min("_n").alias("low"), F.max("_n").alias("high"), F.count("*").alias("cells"), F.count_if(F.col("_n") == 1).alias("single"), F.max("rowspan").alias("span"), F.min(F.when(F.col("_n") > 1, F.col("_n"))).alias("multi"))
    same = (F.col("low") > 1) & (F.col("low") == F.col("high"))
    one = (F.col("cells") > 3) & (F.col("single") == 1) & (F.col("multi") == F.col("high")) & (F.col("high") > 1)
    rows = rows.withColumn("_ok", ((same | one) & (F.col("span") == 1)).cast("int"))
    share = F.avg("_ok").over(Window.partitionBy("table_id"))
    before = Window.partitionBy("table_id").orderBy("row_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_split", F.when(share >= threshold, F.col("_ok")).otherwise(0))
    rows = rows.withColumn("_shift", F.coalesce(F.sum(F.when(F.col("_split") == 1, F.col("high") - 1).otherwise(0)).over(before), F.lit(0)))
    x = c.join(rows.select("table_id", "row_id", "_split", "_shift", "high"), ["table_id", "row_id"])
    parts = F.when(F.col("_split") == 1, F.col("_lines")).otherwise(F.array("text"))
    x = x.select("table_id", "row_id", "col_id", "is_header", "_shift", F.posexplode(parts).alias("_i", "text"))
    return x.select("table_id", (F.col("row_id") + F.col("_shift") + F.col("_i")).cast("long").alias("row_id"), "col_id", (F.col("is_header") & (F.col("_i") == 0)).alias("is_header"), "text")


def combine_dollar_column(cells: DataFrame) -> DataFrame:
    """Columns of nothing but '' and '$' go into the next column's texts, later columns move left.

    A chain of such columns goes into the next ordinary column; the last column stays.
    """
    w = Window.partitionBy("table_id")
    cols = cells.groupBy("table_id", "col_id").agg(F.bool_and(F.col("text").isin("", "$")).alias("dollar"), F.count("*").alias("n"), F.max("colspan").alias("span"), F.array_sort(F.collect_set("row_id")).alias("rows"))
    cols = cols.withColumn("last", F.max("col_id").over(w))
    same_rows = F.lead("rows").over(w.orderBy("col_id")) == F.col("rows")
    cols = cols.withColumn("fold", F.coalesce(F.col("dollar") & (F.col("n") > 1) & (F.col("span") == 1) & (F.col("col_id") < F.col("last")) & same_rows, F.lit(False)).cast("int"))
    cols = cols.withColumn("shift", F.coalesce(F.sum("fold").over(w.orderBy("col_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("table_id", "col_id", "fold", "shift")
    x = cells.join(cols, ["table_id", "col_id"]).withColumn("_to", F.col("col_id") - F.col("shift"))
    return x.groupBy("table_id", "row_id", F.col("_to").cast("int").alias("col_id")).agg(joined(F.col("text"), "", "col_id").alias("text"))


def table_batches(cells: DataFrame, rows: int = 60, most: int = 175) -> DataFrame:
    """Tables up to `most` rows in chunks of `rows` rows: (table_id, chunk, y0, y1), the first chunk from 0."""
    rank = F.dense_rank().over(Window.partitionBy("table_id").orderBy("row_id"))
    x = cells.withColumn("_r", rank)
    x = x.withColumn("_n", F.max("_r").over(Window.partitionBy("table_id"))).where(F.col("_n") <= most)
    top = F.min("y0").over(Window.partitionBy("table_id"))
    x = x.withColumn("_top", top).withColumn("chunk", F.floor((F.col("_r") - 1) / rows).cast("int"))
    return x.groupBy("table_id", "chunk").agg((F.min("y0") - F.min("_top")).alias("y0"), (F.max("y1") - F.min("_top")).alias("y1")).withColumn("y0", F.when(F.col("chunk") == 0, 0.0).otherwise(F.col("y0")))


def table_rotation(cells: DataFrame, most: float = 0.6) -> DataFrame:
    """0, 90 or 270 by the first and last column's height, for tables of tall cells only."""
    tall = F.bool_and((F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0")) < most)
    x = cells.groupBy("table_id").agg(F.count("*").alias("n"), tall.alias("tall"), F.min_by("y0", F.struct("col_id", "row_id")).alias("first"), F.max_by("y0", F.struct("col_id", -F.col("row_id"))).alias("last"))
    angle = F.when((F.col("n") < 2) | ~F.col("tall"), 0).when(F.col("first") > F.col("last"), 270).when(F.col("first") < F.col("last"), 90).otherwise(0)
    return x.select("table_id", angle.alias("rotation"))


def cell_html(cells: DataFrame) -> DataFrame:
    """Adds html: th or td, spans only over one, lines joined by <br>."""
    tag = F.when(F.col("is_header"), "th").otherwise("td")
    span = lambda k: F.when(F.col(k) > 1, F.concat(F.lit(f" {k}="), F.col(k).cast("string"))).otherwise("")
    return cells.withColumn("html", F.concat(F.lit("<"), tag, span("rowspan"), span("colspan"), F.lit(">"), "text", F.lit("</"), tag, F.lit(">")))


def table_html(cells: DataFrame) -> DataFrame:
    rows = cell_html(cells).groupBy("table_id", "row_id").agg(F.concat(F.lit("<tr>"), joined(F.col("html"), "", "col_id"), F.lit("</tr>")).alias("html"))
    return rows.groupBy("table_id").agg(F.concat(F.lit("<table><tbody>"), joined(F.col("html"), "\n", "row_id"), F.lit("</tbody></table>")).alias("html"))


def md_table(cells: DataFrame) -> DataFrame:
    """Markdown per table: spans fill their grid with blanks, columns are padded, a rule follows the first row that isn't empty."""
    text = F.trim(F.regexp_replace(F.replace("text", F.lit("<br>"), F.lit(" ")), r"[\n|]", " "))
    grid = cells.withColumn("_t", text).withColumn("_r", F.explode(F.sequence(F.lit(0), F.col("rowspan") - 1))).withColumn("_c", F.explode(F.sequence(F.lit(0), F.col("colspan") - 1)))
    grid = grid.select("table_id", (F.col("row_id") + F.col("_r")).alias("row"), (F.col("col_id") + F.col("_c")).alias("col"), F.when((F.col("_r") == 0) & (F.col("_c") == 0), F.col("_t")).otherwise("").alias("text"))
    width = F.max(F.length("text")).over(Window.partitionBy("table_id", "col"))
    padded = grid.withColumn("_w", width).withColumn("cell", F.expr("rpad(text, _w, ' ')")).withColumn("rule", F.repeat(F.lit("-"), F.col("_w")))
    rows = padded.groupBy("table_id", "row").agg(F.concat(F.lit("| "), joined(F.col("cell"), " | ", "col"), F.lit(" |")).alias("line"), F.concat(F.lit("|"), joined(F.concat(F.lit("-"), "rule", F.lit("-")), "|", "col"), F.lit("|")).alias("rule"), F.bool_or(F.col("text") != "").alias("full"))
    w = Window.partitionBy("table_id").orderBy("row")
    rows = rows.withColumn("_seen", F.count_if("full").over(w)).where("_seen > 0")
    first = F.row_number().over(w) == 1
    line = F.when(first, F.concat("line", F.lit("\n"), "rule")).otherwise(F.col("line"))
    return rows.withColumn("line", line).groupBy("table_id").agg(joined(F.col("line"), "\n", "row").alias("md"))


def cells_need_ocr(cells: DataFrame, flags: DataFrame, disable: bool = False) -> DataFrame:
    """Cells without text of tables flagged for reading."""
    null = cells.where(F.col("text").isNull())
    return null.join(flags.where("ocr_block"), "table_id", "left_semi").where(F.lit(not disable))


def table_ocr_flag(tables: DataFrame, text: DataFrame) -> DataFrame:
    """ocr_block: page read by machine, page text wrong, or no text in the table."""
    t = text.groupBy("table_id").agg(F.sum(F.length(F.trim("text"))).alias("chars"))
    x = tables.join(t, "table_id", "left")
    return x.select("table_id", ((F.col("method") == "ocr") | F.col("ocr_errors_detected") | (F.coalesce("chars", F.lit(0)) == 0)).alias("ocr_block"))


def ocr_cell_reject(cells: DataFrame, least: float = 6.0) -> DataFrame:
    """Blank or flat cells get an empty text, and keep their place."""
    return cells.withColumn("text", F.when((F.col("y1") - F.col("y0") < least) | F.col("is_blank"), F.lit("")).otherwise(F.col("text")))


def ocr_cell_fill(cells: DataFrame, read: DataFrame) -> DataFrame:
    """Null cells take the read texts (table_id, place, text) by their order, split at <br>."""
    place = F.row_number().over(Window.partitionBy("table_id").orderBy("row_id", "col_id"))
    empty = cells.where("text is null").withColumn("place", place).drop("text").join(read, ["table_id", "place"], "left").drop("place")
    return cells.where("text is not null").unionByName(empty.select(*cells.columns)).withColumn("text_lines", F.split("text", "<br>"))


def cell_rebase(cells: DataFrame, tables: DataFrame, image: tuple, page: tuple) -> DataFrame:
    """Cell boxes from image to page scale, moved by the origin of the table's box grown 1 %."""
    t = tables.select("table_id", (F.col("x0") - 0.01 * (F.col("x1") - F.col("x0"))).alias("tx"), (F.col("y0") - 0.01 * (F.col("y1") - F.col("y0"))).alias("ty"))
    sx, sy = page[0] / image[0], page[1] / image[1]
    x = cells.join(t, "table_id")
    return x.withColumns({"x0": F.col("x0") * sx + F.col("tx"), "x1": F.col("x1") * sx + F.col("tx"), "y0": F.col("y0") * sy + F.col("ty"), "y1": F.col("y1") * sy + F.col("ty")}).drop("tx", "ty")


def sheet_to_html(cells: DataFrame, merged: DataFrame) -> DataFrame:
    """One table per sheet with its name as a heading; covered cells of merged ranges are left out."""
    m = merged.select("sheet", "min_row", "min_col", "max_row", "max_col")
    inside = (F.col("row") >= F.col("min_row")) & (F.col("row") <= F.col("max_row")) & (F.col("col") >= F.col("min_col")) & (F.col("col") <= F.col("max_col"))
    x = cells.join(m, "sheet", "left").withColumn("_in", F.coalesce(inside, F.lit(False)))
    corner = F.col("_in") & (F.col("row") == F.col("min_row")) & (F.col("col") == F.col("min_col"))
    x = x.groupBy("sheet", "row", "col").agg(F.first("value").alias("value"), F.bool_or(F.col("_in") & ~corner).alias("covered"), F.max(F.when(corner, F.col("max_row") - F.col("min_row") + 1)).alias("rs"), F.max(F.when(corner, F.col("max_col") - F.col("min_col") + 1)).alias("cs"))
    span = F.when(F.col("rs").isNotNull(), F.concat(F.lit(' rowspan="'), F.col("rs").cast("string"), F.lit('" colspan="'), F.col("cs").cast("string"), F.lit('"'))).otherwise("")
    td = F.concat(F.lit("<td"), span, F.lit(">"), F.coalesce("value", F.lit("")), F.lit("</td>"))
    rows = x.where("not covered").groupBy("sheet", "row").agg(F.concat(F.lit("<tr>"), joined(td, "", "col"), F.lit("</tr>")).alias("html"))
    return rows.groupBy("sheet").agg(joined(F.col("html"), "", "row").alias("body")).select("sheet", F.concat(F.lit("<h1>"), "sheet", F.lit("</h1><table>"), "body", F.lit("</table>")).alias("html"))

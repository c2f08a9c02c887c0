"""Ordered concatenation, counts and statistics per block, page, document and batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

PAGE = ["doc_id", "page_id"]


def joined(value: Column, sep: str, *order: str) -> Column:
    """Aggregate: the values joined in order. A group is one line, block, page or document."""
    rows = F.array_sort(F.collect_list(F.struct(*[F.col(o) for o in order], value.alias("_v"))))
    return F.array_join(F.transform(rows, lambda r: r["_v"]), sep)


def raw_text(lines: DataFrame) -> DataFrame:
    """Per block its lines, each ended by one newline."""
    line = F.when(F.col("text").endswith("\n"), F.col("text")).otherwise(F.concat("text", F.lit("\n")))
    return lines.groupBy(*PAGE, "block_no").agg(joined(line, "", "line_no").alias("text"))


def line_height(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """Block height over its number of lines, 0 without lines."""
    n = lines.groupBy(*PAGE, F.col("block_no").alias("block_id")).agg(F.count("*").alias("n"))
    return blocks.join(n, [*PAGE, "block_id"], "left").select(*PAGE, "block_id", F.coalesce((F.col("y1") - F.col("y0")) / F.col("n"), F.lit(0.0)).alias("line_height"))


def page_stats(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Per page the method and its block types by falling count, as one string."""
    counts = blocks.groupBy(*PAGE, "block_type").agg(F.count("*").alias("n"))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "block_type", F.col("n").cast("string").alias("n"))))
    per = counts.groupBy(*PAGE).agg(F.array_join(F.transform(rows, lambda r: F.concat_ws(":", r["block_type"], r["n"])), ",").alias("block_counts"))
    return pages.select(*PAGE, "method").join(per, PAGE, "left").select(*PAGE, "method", F.coalesce("block_counts", F.lit("")).alias("block_counts"))


def doc_metadata(blocks: DataFrame, pages: DataFrame, toc: DataFrame) -> DataFrame:
    """(doc_id, metadata): table_of_contents and page_stats of each document, as structs.

    pages(doc_id, page_id, method); toc(doc_id, page_id, place, title, heading_level, x0, y0, x1, y1). A page's block
    types stand by falling count, equal ones as they first stand on the page; its counters are summed over blocks'
    llm_request_count, llm_error_count and llm_tokens_used, 0 where they are missing.
    """
    names = ["llm_request_count", "llm_error_count", "llm_tokens_used"]
    counters = [F.sum(F.coalesce(F.col(c), F.lit(0)) if c in blocks.columns else F.lit(0)).cast("long").alias(c) for c in names]
    types = blocks.groupBy(*PAGE, "block_type").agg(F.count("*").alias("n"), F.min("block_id").alias("first"), *counters)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "first", "block_type", "n")))
    counts = F.transform(ordered, lambda r: F.struct(r["block_type"].alias("block_type"), r["n"].alias("n")))
    per = types.groupBy(*PAGE).agg(counts.alias("block_counts"), F.struct(*[F.sum(c).alias(c) for c in names]).alias("block_metadata"))
    none = F.array().cast("array<struct<block_type:string,n:bigint>>")
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in names])
    page = F.struct("page_id", F.col("method").alias("text_extraction_method"), F.coalesce("block_counts", none).alias("block_counts"), F.coalesce("block_metadata", zero).alias("block_metadata"))
    stats = pages.select(*PAGE, "method").join(per, PAGE, "left").groupBy("doc_id").agg(F.array_sort(F.collect_list(page)).alias("page_stats"))
    polygon = F.array(F.array("x0", "y0"), F.array("x1", "y0"), F.array("x1", "y1"), F.array("x0", "y1"))
    items = toc.select("doc_id", F.struct("page_id", "place", F.struct("title", "heading_level", "page_id", polygon.alias("polygon")).alias("item")).alias("i"))
    items = items.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list("i")), lambda i: i["item"]).alias("toc"))
    return stats.join(items, "doc_id", "left").select("doc_id", F.struct(F.coalesce("toc", F.array()).alias("table_of_contents"), "page_stats").alias("metadata"))


def block_type_topk(blocks: DataFrame, k: int) -> DataFrame:
    counts = blocks.groupBy("doc_id", "block_type").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "block_type"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def update_metadata(blocks: DataFrame, events: DataFrame) -> DataFrame:
    """Counters per block from request events (kind, tokens)."""
    e = events.groupBy(*PAGE, "block_id").agg(F.count_if(F.col("kind") == "request").alias("llm_request_count"), F.count_if(F.col("kind") == "error").alias("llm_error_count"), F.sum("tokens").alias("llm_tokens_used"))
    names = ["llm_request_count", "llm_error_count", "llm_tokens_used"]
    return blocks.join(e, [*PAGE, "block_id"], "left").select(*PAGE, "block_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names])


def merge_metadata(counters: DataFrame) -> DataFrame:
    names = ["llm_request_count", "llm_error_count", "llm_tokens_used"]
    return counters.groupBy(*PAGE).agg(*[F.sum(c).alias(c) for c in names])


def batch_summary(results: DataFrame, batch: list[str]) -> DataFrame:
    return results.groupBy(*batch).agg(F.count("*").alias("total"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"))


def total_time(results: DataFrame, batch: list[str]) -> DataFrame:
    t = F.coalesce("processing_time", F.lit(0.0))
    return results.groupBy(*batch).agg(F.sum(t).alias("total"), F.sum(F.when(F.col("success"), t).otherwise(0.0)).alias("succeeded"), F.sum(F.when(~F.col("success"), t).otherwise(0.0)).alias("failed"))


def throughput(results: DataFrame, by: str) -> DataFrame:
    return results.groupBy(by).agg(F.sum("pages").alias("pages"), F.sum("seconds").alias("seconds")).withColumn("pages_per_second", F.when(F.col("seconds") > 0, F.col("pages") / F.col("seconds")))


def timeout_rows(results: DataFrame, limit: float = 600.0) -> DataFrame:
    late = F.col("processing_time") > limit
    return results.withColumn("error", F.when(late, F.concat(F.lit("Processing timed out after "), F.lit(str(int(limit))), F.lit("s")))).withColumn("success", F.col("success") & ~late)


def section_hierarchy(blocks: DataFrame) -> DataFrame:
    """Adds `hierarchy`: level:page/block of the headings above each block, as a string in level order.

    heading_level is null for other blocks. A heading of level L ends all of level L and deeper, which is the
    last heading of a level counting only if no later heading of a smaller level came: a window per level.
    """
    w = Window.partitionBy("doc_id").orderBy("page_id", "block_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.struct("page_id", "block_id")
    cols, last = [], {}
    for level in (1, 2, 3, 4):
        last[level] = F.last(F.when(F.col("heading_level") == level, place), ignorenulls=True).over(w)
        cut = F.last(F.when(F.col("heading_level") < level, place), ignorenulls=True).over(w)
        alive = last[level].isNotNull() & (cut.isNull() | (last[level] > cut))
        cols.append(F.when(alive, F.concat_ws(":", F.lit(str(level)), F.concat_ws("/", last[level]["page_id"].cast("string"), last[level]["block_id"].cast("string")))))
    return blocks.withColumn("hierarchy", F.concat_ws(",", *cols))


def conversion_results(files: DataFrame, quality: DataFrame, outcomes: DataFrame, limit: float = 600.0) -> DataFrame:
    """One row a submitted file with the first failure of admission, quality, time and conversion."""
    x = files.select("file_id", "reason").join(quality.select("file_id", "passed"), "file_id", "left").join(outcomes.select("file_id", "success", "processing_time"), "file_id", "left")
    error = F.coalesce(F.col("reason"), F.when(F.col("passed") == F.lit(False), "Quality check failed"), F.when(F.col("processing_time") > limit, "Processing timed out"), F.when(~F.coalesce("success", F.lit(False)), "Conversion failed"))
    return x.select("file_id", error.isNull().alias("success"), error.alias("error"), F.coalesce("processing_time", F.lit(0.0)).alias("processing_time"))

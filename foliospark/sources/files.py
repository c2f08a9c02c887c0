"""File listings: admission, routing and naming."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

# Accepted extensions, types by leading bytes, and the service's limits.
EXTENSIONS = [".pdf", ".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp", ".tiff", ".tif"]
MAGIC = [("255044462D", "application/pdf"), ("FFD8FF", "image/jpeg"), ("89504E470D0A1A0A", "image/png"), ("474946", "image/gif"), ("424D", "image/bmp"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff"), ("504B0304", "application/zip")]
ACCEPTED = ["application/pdf", "image/jpeg", "image/png", "image/gif", "image/webp", "image/bmp", "image/tiff"]
MAX_SIZE, MAX_BATCH = 50 * 1024 * 1024, 50
PROVIDERS = [("image", ["jpg", "jpeg", "png", "gif", "webp", "bmp", "tiff", "tif"]), ("pdf", ["pdf"]), ("docx", ["docx", "doc", "odt"]), ("xlsx", ["xlsx", "xls", "ods"]), ("pptx", ["pptx", "ppt", "odp"]), ("epub", ["epub"]), ("html", ["html"])]


def sanitize_name(name: Column) -> Column:
    return F.element_at(F.split(name, "/"), -1)


def file_ext(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))


def file_type(name: Column) -> Column:
    return F.when(file_ext(name) == ".pdf", "pdf").otherwise("image")


def sniff_mime(head_hex: Column) -> Column:
    """Type by the hexadecimal of the leading bytes; null where unknown."""
    first = reduce(lambda c, m: c.when(F.startswith(head_hex, F.lit(m[0])), m[1]), MAGIC, F.when(F.startswith(head_hex, F.lit("52494646")) & (F.substring(head_hex, 17, 8) == "57454250"), "image/webp"))
    return first


def route_provider(name: Column, head_hex: Column, text: Column) -> Column:
    """By leading bytes, else html where the text has a tag, else by the extension as written, else pdf."""
    mime = sniff_mime(head_hex)
    ext = F.regexp_extract(name, r"\.([^.]*)$", 1)
    by_ext = reduce(lambda c, p: c.when(ext.isin(p[1]), p[0]), PROVIDERS, F.when(F.lit(False), ""))
    by_ext = by_ext.otherwise("pdf")
    zipped = F.when(mime == "application/zip", F.when(ext.isin("docx", "xlsx", "pptx", "epub"), ext))
    return F.coalesce(F.when(F.startswith(mime, F.lit("image/")), "image"), F.when(mime == "application/pdf", "pdf"), zipped, F.when(F.regexp_like(text, F.lit(r"<[a-zA-Z][^>]*>")), "html"), by_ext)


def admission_reason(name: Column, size: Column, head_hex: Column, max_size: int = MAX_SIZE) -> Column:
    """The first failing rule, null for admitted files."""
    return (
        F.when(~file_ext(name).isin(EXTENSIONS), "Unsupported file type")
        .when(size > max_size, "File too large (max 50MB)")
        .when(~F.coalesce(sniff_mime(head_hex).isin(ACCEPTED), F.lit(False)), "File content does not match a supported type")
    )


def admit_files(files: DataFrame, max_size: int = MAX_SIZE) -> DataFrame:
    reason = admission_reason(F.col("name"), F.col("size"), F.col("head_hex"), max_size)
    return files.withColumn("reason", reason).withColumn("size", F.when(F.col("reason") == "Unsupported file type", F.lit(0)).otherwise(F.col("size"))).withColumn("admitted", F.col("reason").isNull())


def cap_batch(files: DataFrame, batch: str, most: int = MAX_BATCH) -> DataFrame:
    """Batches over the limit are rejected whole."""
    sizes = files.groupBy(batch).agg(F.count("*").alias("batch_size"))
    return files.join(sizes.where(F.col("batch_size") <= most), batch)


def dedup_selection(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New files whose name and size aren't there yet, after the existing ones; repeats among the new stay."""
    return existing.unionByName(new.join(existing.select("name", "size").distinct(), ["name", "size"], "left_anti").select(*existing.columns))


def select_by_name(files: DataFrame, names: DataFrame) -> DataFrame:
    return files.join(names.select("name"), "name", "left_semi").select(*files.columns)


def client_type_ok(mime: Column, name: Column) -> Column:
    return F.coalesce(mime.isin(ACCEPTED), F.lit(False)) | F.regexp_like(name, F.lit(r"(?i)\.(pdf|jpe?g|png|gif|webp|bmp|tiff?)$"))


def chunk_assign(files: DataFrame, chunks: int, group: str, order: list[str]) -> DataFrame:
    """Contiguous slices of each group's listing, in order: chunk = place / ceil(n / chunks)."""
    w = Window.partitionBy(group)
    size = F.ceil(F.count("*").over(w) / chunks)
    return files.withColumn("chunk", F.floor((F.row_number().over(w.orderBy(*order)) - 1) / size).cast("int"))


def limit_files(files: DataFrame, group: list[str], order: list[str], most: int) -> DataFrame:
    return files.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(f"_n <= {most}").drop("_n")


def base_name(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def skip_existing(files: DataFrame, outputs: DataFrame) -> DataFrame:
    done = outputs.where(F.col("ext").isin("md", "html", "json")).select("base").distinct()
    return files.withColumn("base", base_name(F.col("name"))).join(done, "base", "left_anti").select(*files.columns)


def output_path(name: Column, folder: str) -> Column:
    return F.concat(F.lit(folder + "/"), base_name(sanitize_name(name)))


def page_range(spec: str) -> list[int]:
    """'0,5-10,20' as sorted distinct numbers, ranges inclusive."""
    out: set[int] = set()
    for part in spec.split(","):
        low, _, high = part.partition("-")
        out |= set(range(int(low), int(high or low) + 1))
    return sorted(out)


def select_pages(pages: DataFrame, spec: str) -> DataFrame:
    """A filter on page_id, which reaches the scan."""
    return pages.where(F.col("page_id").isin(page_range(spec)))


def check_page_range(pages: DataFrame, spec: str) -> DataFrame:
    """Per document, whether the range leaves its pages."""
    wanted = page_range(spec)
    return pages.groupBy("doc_id").agg(F.countDistinct("page_id").alias("n_pages")).withColumn("violation", (F.lit(min(wanted)) < 0) | (F.lit(max(wanted)) >= F.col("n_pages")))


def result_name(name: Column, kind: str) -> Column:
    # Endings of the results.
    ending = {"markdown": ".md", "notes": "_notes.txt", "crop": "_notes_crop.png"}[kind]
    return F.regexp_replace(name, r"\.[^.]+$", ending)

"""Block clean-up as windows over pages and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geometry import Box, bbox_gap
from ..functions.text import RAISED, clean_header_text, indel_ratio, strip

PAGE = ["doc_id", "page_id"]


def longest_streak(df: DataFrame, part: list[str], value: str, order: list[str]) -> DataFrame:
    """Longest run of equal consecutive values, per value: runs are where two row numbers keep their difference."""
    whole, own = Window.partitionBy(*part).orderBy(*order), Window.partitionBy(*part, value).orderBy(*order)
    runs = df.withColumn("_run", F.row_number().over(whole) - F.row_number().over(own))
    return runs.groupBy(*part, value, "_run").agg(F.count("*").alias("n")).groupBy(*part, value).agg(F.max("n").alias("longest"))


def parse_relabel_rules(spec: str) -> list[tuple[str, str, float]]:
    """'A:B:0.5,...'; malformed rules are skipped."""
    out = []
    for rule in spec.split(","):
        part = rule.split(":")
        try:
            out.append((part[0].strip(), part[1].strip(), float(part[2])))
        except (IndexError, ValueError):
            continue
    return out


def relabel_blocks(blocks: DataFrame, rules: list[tuple[str, str, float]]) -> DataFrame:
    """A block whose confidence in its own type is at most the rule's threshold takes the rule's type. top_k is a map column."""
    new = F.col("block_type")
    for old, to, threshold in rules:
        new = F.when((F.col("block_type") == old) & (F.element_at("top_k", F.lit(old)) <= threshold), F.lit(to)).otherwise(new)
    return blocks.withColumn("new_type", new)


def stable_first(blocks: DataFrame, block_type: str) -> DataFrame:
    """Blocks of a type to the start of their page, all else in order: adds `place`."""
    w = Window.partitionBy(*PAGE).orderBy((F.col("block_type") != block_type).cast("int"), "block_id")
    return blocks.withColumn("place", F.row_number().over(w))


def stable_last(blocks: DataFrame, block_type: str) -> DataFrame:
    w = Window.partitionBy(*PAGE).orderBy((F.col("block_type") == block_type).cast("int"), "block_id")
    return blocks.withColumn("place", F.row_number().over(w))


def common_elements(first_texts: DataFrame, ratio: float = 0.2, least: int = 3, streak: int = 3) -> DataFrame:
    """(doc_id, text) that repeat over a document's pages; input is (doc_id, page_id, text), one block a page, in page order."""
    c = first_texts.withColumn("text", clean_header_text(F.col("text")))
    total = c.groupBy("doc_id").agg(F.count("*").alias("n"))
    counts = c.groupBy("doc_id", "text").agg(F.count("*").alias("k"))
    runs = longest_streak(c, ["doc_id"], "text", ["page_id"])
    x = counts.join(total, "doc_id").join(runs, ["doc_id", "text"])
    return x.where((F.col("n") >= least) & ((F.col("k") >= ratio * F.col("n")) | (F.col("longest") >= streak)) & (F.col("k") > 3)).select("doc_id", "text", "k")


def ignore_common(blocks: DataFrame, common: DataFrame, score: float = 90.0) -> DataFrame:
    """Blocks whose cleaned text is nearly a common text of their document. Lengths that can't reach the score are left out first."""
    c = common.select("doc_id", F.col("text").alias("common"))
    b = blocks.withColumn("_clean", clean_header_text(F.col("text")))
    short, long_ = F.least(F.length("_clean"), F.length("common")), F.greatest(F.length("_clean"), F.length("common"))
    pairs = b.join(c, "doc_id").where(200.0 * short >= score * (short + long_))
    hit = pairs.where(indel_ratio(F.col("_clean"), F.col("common")) > score).select(*PAGE, "block_id").distinct()
    return hit


def group_lists(blocks: DataFrame, pages: DataFrame, gap: float = 0.1) -> DataFrame:
    """List items with `list_group`: runs of items whose gap to the one before is small; single items have none."""
    b = blocks.join(pages.select(*PAGE, "height"), PAGE)
    return with_list_groups(b, gap).where("block_type = 'ListItem'").drop("height")


def with_list_groups(b: DataFrame, gap: float = 0.1) -> DataFrame:
    """Blocks with the height of their page get list_group; blocks that are no list items have none."""
    w = Window.partitionBy(*PAGE).orderBy("block_id")
    before = Box(*(F.lag(k).over(w) for k in ("x0", "y0", "x1", "y1")))
    joins = (F.lag("block_type").over(w) == "ListItem") & (bbox_gap(before, Box.of()) < gap * F.col("height"))
    b = b.withColumn("_new", F.when((F.col("block_type") == "ListItem") & F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    b = b.withColumn("_run", F.sum("_new").over(w))
    n = F.count("*").over(Window.partitionBy(*PAGE, "_run"))
    return b.withColumn("list_group", F.when((n > 1) & (F.col("block_type") == "ListItem"), F.col("_run"))).drop("_new", "_run")


def unmark_lists(items: DataFrame) -> DataFrame:
    return items.withColumn("block_type", F.when(F.col("list_group").isNull(), F.lit("Text")).otherwise(F.col("block_type")))


def code_format(lines: DataFrame) -> DataFrame:
    """Code per block: each line indented by its distance from the leftmost one in average characters."""
    by = [*PAGE, "block_no"]
    size = lines.groupBy(*by).agg((F.sum(F.col("x1") - F.col("x0")) / F.sum(F.length("text"))).alias("char"), F.min("x0").alias("left"))
    x = lines.join(size, by).withColumn("line", F.concat(F.repeat(F.lit(" "), F.when(F.col("char") > 0, ((F.col("x0") - F.col("left")) / F.col("char")).cast("int")).otherwise(0)), "text"))
    from .aggregates import joined

    return x.groupBy(*by).agg(F.rtrim(joined(F.col("line"), "\n", "line_no")).alias("code"))


def code_text(lines: Column) -> Column:
    """code_format for an array of lines(line_no, x0, x1, text) in order."""
    total = lambda f: F.aggregate(lines, F.lit(0.0), lambda s, x: s + f(x))
    size = total(lambda x: x.x1 - x.x0) / F.nullif(total(lambda x: F.length(x.text).cast("double")), F.lit(0.0))
    left = F.array_min(F.transform(lines, lambda x: x.x0))
    indent = lambda x: F.when(size > 0, ((x.x0 - left) / size).cast("int")).otherwise(0)
    return F.rtrim(F.array_join(F.transform(lines, lambda x: F.concat(F.repeat(F.lit(" "), indent(x)), x.text)), "\n"))


def with_running(blocks: DataFrame, ratio: float = 0.2, least: int = 3, streak: int = 3, score: float = 90.0) -> DataFrame:
    """Adds `running` to first and last blocks of pages whose text repeats over the document, or nearly does.

    common_elements and ignore_common as windows over documents, for first blocks and for last ones by themselves. The
    common texts of a document are few: each stands on more than three pages.
    """
    page = Window.partitionBy(*PAGE)
    b = blocks.withColumn("_t", clean_header_text(F.col("text")))
    for side, edge in (("_f", F.min), ("_l", F.max)):
        b = b.withColumn(side, F.col("block_id") == edge("block_id").over(page))
        own, same = ["doc_id", side], ["doc_id", side, "_t"]
        in_order = lambda keys: Window.partitionBy(*keys).orderBy("page_id")
        b = b.withColumns({"_n": F.count("*").over(Window.partitionBy(*own)), "_k": F.count("*").over(Window.partitionBy(*same)), "_run": F.row_number().over(in_order(own)) - F.row_number().over(in_order(same))})
        b = b.withColumn("_long", F.count("*").over(Window.partitionBy(*same, "_run"))).withColumn("_longest", F.max("_long").over(Window.partitionBy(*same)))
        common = F.col(side) & (F.col("_n") >= least) & ((F.col("_k") >= ratio * F.col("_n")) | (F.col("_longest") >= streak)) & (F.col("_k") > 3)
        b = b.withColumn(f"_c{side}", F.collect_set(F.when(common, F.col("_t"))).over(Window.partitionBy("doc_id")))
    n = F.length("_t")
    reach = lambda c: 200.0 * F.least(n, F.length(c)) >= score * (n + F.length(c))
    near = lambda c: (c == F.col("_t")) | (reach(c) & (indel_ratio(F.col("_t"), c) > score))
    hit = (F.col("_f") & F.exists("_c_f", near)) | (F.col("_l") & F.exists("_c_l", near))
    return b.withColumn("running", hit).drop("_t", "_f", "_l", "_n", "_k", "_run", "_long", "_longest", "_c_f", "_c_l")


def footnote_superscript(spans: DataFrame, blocks: DataFrame) -> DataFrame:
    """The first span of each footnote, and whether it begins with digits or marks."""
    foot = blocks.where("block_type = 'Footnote'").select(*PAGE, F.col("block_id").alias("block_no"))
    first = spans.join(foot, [*PAGE, "block_no"], "left_semi").groupBy(*PAGE, "block_no").agg(F.min_by("text", F.struct("line_no", "span_id")).alias("text"))
    return first.withColumn("has_superscript", F.regexp_like("text", F.lit(rf"(?U)^{RAISED}")))


def linenum_spans(spans: DataFrame, ratio: float = 0.6) -> DataFrame:
    """Numeric leftmost spans of pages where most lines have one; spans are (doc_id, page_id, line_no, span_id, x0, text)."""
    first = spans.groupBy(*PAGE, "line_no").agg(F.min(F.struct("x0", "span_id", "text")).alias("s")).select(*PAGE, "line_no", "s.*")
    first = first.withColumn("numeric", F.regexp_like(strip(F.col("text")), F.lit(r"^\p{N}+$")))
    share = F.avg(F.col("numeric").cast("int")).over(Window.partitionBy(*PAGE))
    return first.withColumn("share", share).where((F.col("share") > ratio) & F.col("numeric")).select(*PAGE, "line_no", "span_id")


def is_line_numbers(ratio: float = 0.6) -> Column:
    """A tall narrow block made of numbers."""
    tokens = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    digits = F.filter(tokens, lambda x: x.rlike(r"^\d+$"))
    share = F.try_divide(F.size(digits), F.size(tokens))
    return F.coalesce((F.size(tokens) >= 4) & (share > ratio) & (F.col("y1") - F.col("y0") > F.col("x1") - F.col("x0")), F.lit(False))


def linenum_blocks(blocks: DataFrame, ratio: float = 0.6) -> DataFrame:
    return blocks.where(is_line_numbers(ratio))


def heading_levels(heights: DataFrame, levels: int = 4, merge: float = 0.25, default: int = 2, tol: float = 0.99) -> DataFrame:
    """Adds heading_level. heights is (doc_id, page_id, block_id, line_height) of headings.

    With more headings than levels, a document's heights are cut at their `levels - 1` largest gaps, and adjacent
    clusters merge unless the taller mean less a quarter is still above the smaller mean. Levels count from the
    tallest cluster; a heading takes the first whose least height times `tol` it reaches, else the default.
    """
    return with_heading_levels(heights, F.lit(True), levels, merge, default, tol)


def with_heading_levels(blocks: DataFrame, heading: Column, levels: int = 4, merge: float = 0.25, default: int = 2, tol: float = 0.99) -> DataFrame:
    """heading_levels over blocks of which some are headings; the others get null. Windows over documents, no join."""
    own = ["doc_id", "_heading"]
    w = Window.partitionBy(*own).orderBy(F.desc("line_height"), "page_id", "block_id")
    gap = F.coalesce(F.lag("line_height").over(w) - F.col("line_height"), F.lit(0.0))
    h = blocks.withColumn("_heading", heading).withColumns({"_n": F.count("*").over(Window.partitionBy(*own)), "_gap": gap, "_i": F.row_number().over(w)})
    cut_rank = F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("_gap"), "_i"))
    in_order = Window.partitionBy(*own).orderBy("_i")
    h = h.withColumn("_cut", ((cut_rank <= levels - 1) & (F.col("_gap") > 0)).cast("int")).withColumn("_cluster", F.sum("_cut").over(in_order))
    h = h.withColumn("_mean", F.avg("line_height").over(Window.partitionBy(*own, "_cluster")))
    # at the first of a cluster the one before is the cluster above
    apart = (F.col("_cut") == 1) & (F.lag("_mean").over(in_order) * (1 - merge) >= F.col("_mean"))
    h = h.withColumn("_level", 1 + F.sum(F.coalesce(apart, F.lit(False)).cast("int")).over(in_order))
    h = h.withColumn("_low", F.min("line_height").over(Window.partitionBy(*own, "_level")))
    # at most as many as levels
    lows = F.collect_set(F.struct("_level", "_low")).over(Window.partitionBy(*own))
    h = h.withColumn("_lows", F.when(F.col("_heading"), lows))
    found = F.array_min(F.transform(F.filter("_lows", lambda r: r["_low"] * tol <= F.col("line_height")), lambda r: r["_level"]))
    level = F.when(F.col("_n") > levels, F.coalesce(found, F.lit(default))).otherwise(F.lit(default))
    return h.withColumn("heading_level", F.when(F.col("_heading"), level.cast("int"))).drop("_heading", "_n", "_gap", "_i", "_cut", "_cluster", "_mean", "_level", "_low", "_lows")


def toc(headers: DataFrame, boxes: bool = False) -> DataFrame:
    """(doc_id, title, level, page_id, place) of section headers in order; with boxes, x0, y0, x1, y1 as well."""
    w = Window.partitionBy("doc_id").orderBy("page_id", "block_id")
    return headers.select("doc_id", F.regexp_replace("text", r"(?U)^\s+|\s+$", "").alias("title"), "heading_level", "page_id", F.row_number().over(w).alias("place"), *(["x0", "y0", "x1", "y1"] if boxes else []))


def list_continuation(groups: DataFrame) -> DataFrame:
    """Adds has_continuation: the next list stands beside on the page, or in the first quadrant of a later page."""
    w = Window.partitionBy("doc_id").orderBy("page_id", "block_id")
    n = {k: F.lead(k).over(w) for k in ("page_id", "block_type", "x0", "y0")}
    column = (n["page_id"] == F.col("page_id")) & (n["y0"] <= F.col("y1"))
    quadrant = (n["page_id"] != F.col("page_id")) & (n["x0"] < F.col("width") / 2) & (n["y0"] < F.col("height") / 2)
    return groups.withColumn("has_continuation", F.coalesce((n["block_type"] == F.col("block_type")) & (column | quadrant), F.lit(False)))


def blank_page(blocks: DataFrame, blank: DataFrame, pages: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pages whose only block is a picture on a blank image, with an intersection area over the threshold."""
    only = blocks.groupBy(*PAGE).agg(F.count("*").alias("n"), *[F.first(k).alias(k) for k in ("block_type", "x0", "y0", "x1", "y1")])
    x = only.join(pages.select(*PAGE, "width", "height"), PAGE).join(blank, PAGE)
    over = F.greatest(F.lit(0.0), F.least("x1", "width") - F.greatest("x0", F.lit(0.0))) * F.greatest(F.lit(0.0), F.least("y1", "height") - F.greatest("y0", F.lit(0.0)))
    return x.where((F.col("n") == 1) & F.col("block_type").isin("Picture", "Figure") & F.col("is_blank") & (over > threshold)).select(*PAGE)


def fix_latex(html: Column) -> Column:
    """Nothing without a math tag; display is block, literal newlines at the edges and line breaks go."""
    x = F.regexp_replace(html, r"<math[^>]*>", '<math display="block">')
    x = F.regexp_replace(F.regexp_replace(x, r"(<math[^>]*>)(\\n|\s)+", "$1"), r"(\\n|\s)+</math>", "</math>")
    return F.when(~F.contains(html, F.lit("<math")), F.lit("")).otherwise(F.regexp_replace(x, r"<br\s*/?>", ""))


def equation_candidates(blocks: DataFrame, pages: DataFrame, least: float = 0.06, redo: bool = False) -> DataFrame:
    x = blocks.where("block_type = 'Equation'").join(pages.select(*PAGE, "height"), PAGE)
    return x.where(F.lit(redo) | ((F.col("y1") - F.col("y0")) / F.col("height") >= least)).drop("height")


def picture_candidates(blocks: DataFrame, extract_images: bool = True, types: tuple[str, ...] = ("Picture", "Figure")) -> DataFrame:
    """Blocks that get a description: pictures and figures, but none where images are taken out as files."""
    return blocks.where(F.col("block_type").isin(*types) & F.lit(not extract_images))


def form_candidates(blocks: DataFrame, cells: DataFrame, types: tuple[str, ...] = ("Form",)) -> DataFrame:
    """Forms that hold table cells: cells(doc_id, page_id, block_id) name the form that they stand in."""
    return blocks.where(F.col("block_type").isin(*types)).join(cells.select(*PAGE, "block_id").distinct(), [*PAGE, "block_id"], "left_semi")


def det_conf_filter(lines: DataFrame, least: float = 0.8) -> DataFrame:
    """Detected lines whose confidence is above the least; a null confidence is not."""
    return lines.where(F.col("confidence") > least)


def handwriting_candidates(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    n = lines.groupBy(*PAGE, F.col("block_no").alias("block_id")).agg(F.count("*").alias("n"))
    x = blocks.join(n, [*PAGE, "block_id"], "left")
    return x.where((F.col("block_type") == "Handwriting") | ((F.col("block_type") == "Text") & F.col("n").isNull())).drop("n")


def ocr_mode(blocks: DataFrame, lines: DataFrame, pages: DataFrame, overlap: DataFrame, full_types: list[str], skipped: list[str]) -> DataFrame:
    """`line` or `block` for each block that is read: whole blocks only where they are plain, short and apart."""
    n = lines.groupBy(*PAGE, F.col("block_no").alias("block_id")).agg(F.count("*").alias("n"))
    x = blocks.where(~F.col("block_type").isin(skipped)).join(n, [*PAGE, "block_id"], "left").join(pages.select(*PAGE, F.col("height").alias("ph")), PAGE).join(overlap, PAGE)
    by_line = (F.col("max_overlap") > 0.5) | ~F.col("block_type").isin(full_types) | (F.coalesce("n", F.lit(0)) > 15) | (F.col("y1") - F.col("y0") >= 0.5 * F.col("ph"))
    return x.select(*PAGE, "block_id", F.when(by_line, "line").otherwise("block").alias("mode"))

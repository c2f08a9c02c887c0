"""Block structure: captions with their figures, reading order, continuations, indentation, marked quotes, line numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geometry import Box, bbox_gap, intersection_area
from .layout import PAGE, renamed

GROUPED, CAPTIONS = ["Table", "Figure", "Picture"], ["Caption", "Footnote"]


def _page():
    return Window.partitionBy(*PAGE).orderBy("block_id")


def group_captions(blocks: DataFrame, pages: DataFrame, gap: float = 0.05) -> DataFrame:
    """Adds group_of: the block_id of the table, figure or picture that a block is grouped with, null for others.

    A caption before a block belongs to it unless the block before that caption has taken it as its next one.
    """
    return with_caption_groups(blocks.join(pages.select(*PAGE, "height"), PAGE), gap).drop("height")


def with_caption_groups(b: DataFrame, gap: float = 0.05) -> DataFrame:
    """group_captions for blocks with the height of their page."""
    w = _page()
    side = lambda f: Box(*(f(k).over(w) for k in ("x0", "y0", "x1", "y1")))
    main = F.col("block_type").isin(GROUPED)
    near = lambda other: F.coalesce(bbox_gap(other, Box.of()) < gap * F.col("height"), F.lit(False))
    takes_next = main & F.coalesce(F.lead("block_type").over(w).isin(CAPTIONS), F.lit(False)) & near(side(F.lead))
    b = b.withColumn("_next", takes_next).withColumn("_near_prev", main & F.coalesce(F.lag("block_type").over(w).isin(CAPTIONS), F.lit(False)) & near(side(F.lag)))
    free = ~F.coalesce(F.lag("_next", 2).over(w), F.lit(False))
    b = b.withColumn("_prev", F.col("_near_prev") & free)
    owner = F.when(F.col("_next") | F.col("_prev"), F.col("block_id")).when(F.lag("_next").over(w), F.lag("block_id").over(w)).when(F.lead("_prev").over(w), F.lead("block_id").over(w))
    return b.withColumn("group_of", owner).drop("_next", "_prev", "_near_prev")


def reorder_sliced(blocks: DataFrame, spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds `place` on text pages whose layout was sliced: by the mean of a block's first and last span position.

    Blocks without spans follow the nearest keyed block before (plus their distance), else precede the next one.
    """
    keys = spans.groupBy(*PAGE, F.col("block_no").alias("block_id")).agg(F.min_by("minimum_position", F.struct("line_no", "span_id")).alias("a"), F.max_by("maximum_position", F.struct("line_no", "span_id")).alias("z"))
    x = blocks.join(pages.where("layout_sliced AND method = 'embedded'").select(*PAGE), PAGE, "left_semi").join(keys, [*PAGE, "block_id"], "left")
    x = x.withColumn("_i", F.row_number().over(_page())).withColumn("_key", (F.col("a") + F.col("z")) / 2)
    known = F.when(F.col("_key").isNotNull(), F.struct("_i", "_key"))
    before = F.last(known, ignorenulls=True).over(_page().rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(known, ignorenulls=True).over(_page().rowsBetween(1, Window.unboundedFollowing))
    x = x.withColumn("_b", before).withColumn("_a", after)
    key = F.coalesce("_key", F.col("_b._key") + F.col("_i") - F.col("_b._i"), F.col("_a._key") - (F.col("_a._i") - F.col("_i")), F.lit(0.0))
    return x.select(*PAGE, "block_id", F.row_number().over(Window.partitionBy(*PAGE).orderBy(key, "block_id")).alias("place"))


def linenum_edges(spans: DataFrame, least_lines: int = 4, least_length: int = 10, ratio: float = 0.6) -> DataFrame:
    """(doc_id, page_id, block_no, line_no, edge) of numbers at the starts or ends of a block's lines."""
    line = spans.groupBy(*PAGE, "block_no", "line_no").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.min_by("text", "span_id").alias("first"), F.max_by("text", "span_id").alias("last"))
    digits = lambda c: F.regexp_like(F.trim(c), F.lit(r"^\d+$")) & (F.col("n") >= 2) & (F.col("chars") - F.length(F.trim(c)) > least_length)
    line = line.withColumns({"start": digits("first"), "end": digits("last")})
    w = Window.partitionBy(*PAGE, "block_no")
    share = lambda c: F.avg(F.col(c).cast("int")).over(w)
    line = line.withColumns({"_s": share("start"), "_e": share("end"), "_lines": F.count("*").over(w)}).where(F.col("_lines") >= least_lines)
    edge = F.array_compact(F.array(F.when(F.col("start") & (F.col("_s") > ratio), "start"), F.when(F.col("end") & (F.col("_e") > ratio), "end")))
    return line.select(*PAGE, "block_no", "line_no", F.explode(edge).alias("edge"))


def text_continuation(blocks: DataFrame, lines: DataFrame, pages: DataFrame, gap: float = 0.02) -> DataFrame:
    """Adds has_continuation to text blocks: the text goes on in the next column or on the next page."""
    rows = F.array_sort(F.collect_list(F.struct("line_no", "x0", "x1", "text")))
    own = lines.groupBy(*PAGE, F.col("block_no").alias("block_id")).agg(rows.alias("lines"))
    b = blocks.where(~F.col("block_type").isin("PageHeader", "PageFooter")).join(own, [*PAGE, "block_id"], "left").join(pages.select(*PAGE, "width", "height"), PAGE)
    return with_continuation(b, gap).select(*PAGE, "block_id", "has_continuation")


def line_edges() -> dict[str, Column]:
    """What with_continuation needs to know of a block's lines; with these columns there, it does without the lines."""
    wide = F.filter("lines", lambda x: x.x1 - x.x0 > 1)
    return {
        "_e_n": F.when(F.size("lines") > 0, F.size("lines")),
        "_e_min_x": F.ceil(F.array_min(F.transform("lines", lambda x: x.x0))),
        "_e_first_x": F.get("lines", F.lit(0)).x0,
        "_e_max_x": F.floor(F.array_max(F.transform(wide, lambda x: x.x1))),
        "_e_last_x": F.try_element_at(wide, F.lit(-1)).x1,
        "_e_last_text": F.try_element_at(wide, F.lit(-1)).text,
        "_e_aside": F.col("block_type").isin("PageHeader", "PageFooter"),
    }


def with_continuation(blocks: DataFrame, gap: float = 0.02) -> DataFrame:
    """text_continuation for blocks with their lines(line_no, x0, x1, text) in order and the size of their page.

    Headers and footers of pages are passed over.
    """
    edges = line_edges()
    b = blocks if set(edges) <= set(blocks.columns) else blocks.withColumns(edges)
    w = Window.partitionBy("doc_id", "_e_aside").orderBy("page_id", "block_id")
    n = {k: F.lead(k).over(w) for k in ("page_id", "block_type", "x0", "y0", "_e_n", "_e_min_x", "_e_first_x", "width", "height")}
    column = (n["page_id"] == F.col("page_id")) & (F.floor(n["y0"]) <= F.ceil("y0")) & (n["x0"] > F.col("x1") + (F.col("x1") - F.col("x0")) * gap)
    page = n["page_id"] != F.col("page_id")
    quadrant = (n["x0"] < F.floor(n["width"] / 2)) & (n["y0"] < F.floor(n["height"] / 2))
    indented = F.when(n["_e_n"].isNotNull(), n["_e_first_x"] > n["_e_min_x"]).otherwise(True)
    open_end = (F.col("_e_last_x") >= F.col("_e_max_x")) | F.regexp_like(F.trim("_e_last_text"), F.lit(r"[\p{Ll}\d][-—¬]\s?$"))
    goes = (F.col("block_type") == "Text") & (F.col("_e_n") >= 2) & (n["block_type"] == "Text") & n["_e_n"].isNotNull() & open_end & ~indented & ((quadrant & page) | column)
    return b.withColumn("has_continuation", F.coalesce(goes, F.lit(False))).drop(*edges)


def list_indent(items: DataFrame, pages: DataFrame, indent: float = 0.01) -> DataFrame:
    """Adds list_indent_level: a stack of x starts per group, folded in order inside the row of a group.

    items are (doc_id, page_id, group_id, block_id, x0, y0, x1). The stack starts over after a column break.
    """
    rows = F.array_sort(F.collect_list(F.struct("block_id", "x0", "y0", "x1")))
    g = items.join(pages.select(*PAGE, "width"), PAGE).groupBy(*PAGE, "group_id").agg(rows.alias("items"), F.first("width").alias("width"))
    after = lambda i: F.get(F.col("items"), i + 1)
    g = g.withColumn("items", F.transform("items", lambda x, i: F.struct(x.block_id.alias("block_id"), x.x0.alias("x0"), x.y0.alias("y0"), x.x1.alias("x1"), after(i).x0.alias("nx0"), after(i).y0.alias("ny0"))))
    out = g.select(*PAGE, "group_id", F.explode(indent_levels(F.col("items"), F.col("width") * indent)).alias("o"))
    return out.select(*PAGE, "group_id", "o.block_id", F.col("o.level").alias("list_indent_level"))


def indent_levels(items: Column, tol: Column) -> Column:
    """(block_id, level) of the items of one group in order; nx0 and ny0 are where the next one starts."""
    kind = "struct<stack:array<struct<x0:double,y0:double,level:int>>,out:array<struct<block_id:int,level:int>>>"
    entry = "struct<x0:double,y0:double,level:int>"
    first = F.get(items, 0)
    start = F.struct(F.array(F.struct(first.x0.alias("x0"), first.y0.alias("y0"), F.lit(0).alias("level"))).alias("stack"), F.array().cast("array<struct<block_id:int,level:int>>").alias("out")).cast(kind)

    def step(acc, x):
        # of a stack in order, what stays is the part before the first entry that isn't left of the item
        keep = F.filter(acc.stack, lambda s: s.x0 + tol < x.x0)
        level = F.when((F.size(keep) > 0) & (x.y0 > F.try_element_at(keep, F.lit(-1)).y0), F.try_element_at(keep, F.lit(-1)).level + 1).otherwise(0)
        me = F.struct(x.x0.alias("x0"), x.y0.alias("y0"), level.alias("level")).cast(entry)
        reset = F.array(F.struct(x.nx0.alias("x0"), x.ny0.alias("y0"), F.lit(0).alias("level")).cast(entry))
        stack = F.when(F.coalesce(x.nx0 > x.x1, F.lit(False)), reset).otherwise(F.array_append(keep, me))
        return F.struct(stack.alias("stack"), F.array_append(acc.out, F.struct(x.block_id.alias("block_id"), level.alias("level"))).alias("out")).cast(kind)

    return F.aggregate(items, start, step).out


def list_nest(items: DataFrame) -> DataFrame:
    """Adds parent_id: the closest item before that is less indented, in its group; boxes grow by those of their children.

    items are (doc_id, page_id, group_id, block_id, list_indent_level) and, where there, x0, y0, x1, y1. An item's box
    takes in its own children as they were, not what these take in themselves. A group is folded once, with the stack of
    items that are still open; the boxes are a second aggregation of the same partitioning.
    """
    rows = F.array_sort(F.collect_list(F.struct("block_id", "list_indent_level")))
    kind = "struct<open:array<struct<block_id:int,level:int>>,out:array<struct<block_id:int,parent_id:int>>>"
    start = F.struct(F.array().cast("array<struct<block_id:int,level:int>>").alias("open"), F.array().cast("array<struct<block_id:int,parent_id:int>>").alias("out")).cast(kind)

    def step(acc, x):
        # levels rise along the stack, so that what stays is its beginning
        kept = F.filter(acc.open, lambda o: o.level < x.list_indent_level)
        me = F.struct(x.block_id.cast("int").alias("block_id"), x.list_indent_level.cast("int").alias("level"))
        pair = F.struct(x.block_id.cast("int").alias("block_id"), F.try_element_at(kept, F.lit(-1)).block_id.alias("parent_id"))
        return F.struct(F.array_append(kept, me).alias("open"), F.array_append(acc.out, pair).alias("out")).cast(kind)

    group, box = [*PAGE, "group_id"], ["x0", "y0", "x1", "y1"]
    whole = F.array_sort(F.collect_list(F.struct("block_id", F.struct(*items.columns).alias("item"))))
    g = items.groupBy(*group).agg(whole.alias("r"), F.aggregate(rows, start, step).out.alias("out"))
    both = F.zip_with("r", "out", lambda r, o: F.struct(r.item.alias("item"), o.parent_id.alias("parent_id")))
    out = g.select(F.explode_outer(both).alias("b")).select("b.item.*", "b.parent_id")
    if not set(box) <= set(items.columns):
        return out
    grown = [f(c).alias(f"_{c}") for c, f in zip(box, (F.min, F.min, F.max, F.max), strict=True)]
    key = [F.col(c).alias(f"_k_{c}") for c in group]
    reach = out.where("parent_id is not null").groupBy(*key, F.col("parent_id").alias("_k_block_id")).agg(*grown)
    same = [F.col(c) == F.col(f"_k_{c}") for c in (*group, "block_id")]
    wide = {c: (F.least if c in ("x0", "y0") else F.greatest)(F.col(c), F.coalesce(F.col(f"_{c}"), F.col(c))) for c in box}
    return out.join(reach, same, "left").withColumns(wide).select(*items.columns, "parent_id")


def blockquote(blocks: DataFrame, indent: float = 0.1, tol: float = 0.01) -> DataFrame:
    """Adds blockquote_level (0 for none), folded over the blocks of each page in order.

    blocks are (doc_id, page_id, block_id, block_type, n_lines, x0, y0, x1, y1). A block of two lines or more opens
    a quote at the next text block when that is indented and below; the quote goes on while edges align.
    """
    rows = F.array_sort(F.collect_list(F.struct("block_id", *quote_flags(indent, tol))))
    g = blocks.withColumns({f"_{k}": F.lead(k).over(_page()) for k in QUOTED}).groupBy(*PAGE).agg(rows.alias("rows"))
    out = g.select(*PAGE, F.explode(quote_levels(F.col("rows"))).alias("o"))
    return out.select(*PAGE, "o.block_id", F.col("o.level").alias("blockquote_level"))


QUOTED = ("block_type", "n_lines", "x0", "y0", "x1")


def quote_flags(indent: float = 0.1, tol: float = 0.01) -> list[Column]:
    """What a block and its next one (columns with _ before them) have to do with each other."""
    c, width = F.col, F.col("x1") - F.col("x0")
    flags = {
        "_pair": (c("block_type") == "Text") & (c("n_lines") >= 2) & (c("_block_type") == "Text"),
        "_open": (c("_x0") > c("x0") + indent * width) & (c("_y0") > c("y1")),
        "_even": (F.abs(c("_x1") - c("x1")) < tol * width) & (F.abs(c("_x0") - c("x0")) < tol * width),
        "_tall": c("_n_lines") >= 2,
    }
    return [F.coalesce(f, F.lit(False)).alias(k) for k, f in flags.items()]


def quote_levels(rows: Column) -> Column:
    """(block_id, level) of a page's blocks (block_id and quote_flags) in order."""
    kind = "struct<next:int,out:array<struct<block_id:int,level:int>>>"
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<block_id:int,level:int>>").alias("out")).cast(kind)

    def step(acc, x):
        level = acc.next
        going = F.when(x["_open"], level + 1).when(x["_even"], level).otherwise(0)
        new = F.when(~x["_pair"], 0).when(level > 0, going).when(x["_tall"] & x["_open"], 1).otherwise(0)
        return F.struct(new.alias("next"), F.array_append(acc.out, F.struct(x.block_id.alias("block_id"), level.alias("level"))).alias("out")).cast(kind)

    return F.aggregate(rows, start, step).out


def math_candidates(blocks: DataFrame, lines: DataFrame, ratio: float = 0.4) -> DataFrame:
    """Inline-math blocks, blocks with math in their lines, and all text of pages where such are common."""
    has = lines.where("has_math").select(*PAGE, F.col("block_no").alias("block_id")).distinct().withColumn("_m", F.lit(True))
    text = blocks.where(F.col("block_type").isin("Text", "TextInlineMath", "Caption", "Footnote")).join(has, [*PAGE, "block_id"], "left")
    text = text.withColumn("_math", F.coalesce("_m", F.lit(False)) | (F.col("block_type") == "TextInlineMath"))
    share = F.avg(F.col("_math").cast("int")).over(Window.partitionBy(*PAGE))
    return text.withColumn("_share", share).where(F.col("_math") | ((F.col("_share") >= ratio) & (F.col("block_type") == "Text"))).select(*PAGE, "block_id")


def contained_blocks(blocks: DataFrame, depth: int = 6) -> DataFrame:
    """(doc_id, page_id, root_id, block_id, depth): all blocks below each root, those under removed blocks left out.

    blocks are (doc_id, page_id, block_id, parent_id, removed); one join a level.
    """
    live = blocks.where("not removed")
    level = live.where("parent_id is null").select(*PAGE, F.col("block_id").alias("root_id"), "block_id", F.lit(0).alias("depth"))
    out = level
    edges = live.where("parent_id is not null").select(*PAGE, F.col("parent_id").alias("_up"), F.col("block_id").alias("_down"))
    for d in range(1, depth + 1):
        up = level.withColumnRenamed("block_id", "_up")
        level = up.join(edges, [*PAGE, "_up"]).select(*PAGE, "root_id", F.col("_down").alias("block_id"), F.lit(d).alias("depth"))
        out = out.unionByName(level)
    return out


def table_runs(tables: DataFrame) -> DataFrame:
    """Adds run_id: consecutive tables that belong together.

    tables are (doc_id, page_id, table_id, place, x0..y1, columns, sole, page_height). Any of four rules joins a table
    to the one before: on the next page (tall, alone), beside it, below it, in a new column.
    """
    w = Window.partitionBy("doc_id").orderBy("place")
    p = {k: F.lag(k).over(w) for k in ("page_id", "x0", "y0", "x1", "y1", "columns", "sole", "page_height")}
    h, ph, wd, pw = F.col("y1") - F.col("y0"), p["y1"] - p["y0"], F.col("x1") - F.col("x0"), p["x1"] - p["x0"]
    like = lambda before, now: F.try_divide(before, now).between(0.75, 1.25) & ~F.try_divide(before, now).isin(0.75, 1.25)
    cols = F.abs(F.col("columns") - p["columns"]) < 2
    same = p["page_id"] == F.col("page_id")
    across = (p["page_id"] + 1 == F.col("page_id")) & (F.greatest(h, ph) / F.col("page_height") > 0.6) & (F.col("sole") | p["sole"])
    beside = same & like(ph, h) & (F.abs(F.col("x0") - p["x1"]) < 20) & (F.abs(F.col("y0") - p["y0"]) < 20)
    below = same & like(pw, wd) & (F.abs(F.col("y0") - p["y1"]) < 10) & (F.abs(F.col("x0") - p["x0"]) < 10) & cols
    column = same & (F.abs(F.col("x0") - p["x1"]) < 50) & (F.col("y0") < p["y1"]) & like(pw, wd) & cols
    joins = F.coalesce(across | beside | below | column, F.lit(False))
    return tables.withColumn("_new", (~joins).cast("int")).withColumn("run_id", F.sum("_new").over(w)).drop("_new")


def align_cells(cells: DataFrame, lines: DataFrame) -> DataFrame:
    """Cells grown in y over their own lines, then drawn back from lines that belong to other cells.

    lines are (table_id, line_id, x0..y1); a line belongs to the cell that covers most of it.
    """
    a, b = renamed(lines, "a_", ["table_id"]), renamed(cells.select("table_id", "cell_id", "x0", "y0", "x1", "y1"), "b_", ["table_id"])
    pairs = a.join(b, "table_id").withColumn("area", intersection_area(Box.of("a_"), Box.of("b_"))).where("area > 0")
    rank = F.row_number().over(Window.partitionBy("table_id", "a_line_id").orderBy(F.desc("area"), "b_cell_id"))
    pairs = pairs.withColumn("own", rank == 1)
    mid = (F.col("a_y0") + F.col("a_y1")) / 2
    agg = pairs.groupBy("table_id", F.col("b_cell_id").alias("cell_id")).agg(
        F.min(F.when(F.col("own"), F.col("a_y0"))).alias("up"), F.max(F.when(F.col("own"), F.col("a_y1"))).alias("down"),
        F.max(F.when(~F.col("own") & (mid < (F.col("b_y0") + F.col("b_y1")) / 2), F.col("a_y1"))).alias("top"), F.min(F.when(~F.col("own") & (mid >= (F.col("b_y0") + F.col("b_y1")) / 2), F.col("a_y0"))).alias("bottom"))
    x = cells.join(agg, ["table_id", "cell_id"], "left")
    y0, y1 = F.least("y0", "up"), F.greatest("y1", "down")
    s0, s1 = F.coalesce(F.greatest(y0, F.col("top")), y0), F.coalesce(F.least(y1, F.col("bottom")), y1)
    fits = s1 > s0
    return x.select("table_id", "cell_id", F.when(fits, s0).otherwise(y0).alias("y0"), F.when(fits, s1).otherwise(y1).alias("y1"))


def attach_chars(chars: DataFrame, spans: DataFrame, keep: bool) -> DataFrame:
    """Characters of known spans; none unless they are to be kept."""
    return chars.join(spans.select("doc_id", "line_no", "span_id"), ["doc_id", "line_no", "span_id"], "left_semi").where(F.lit(keep))


def ocr_work_items(blocks: DataFrame, lines: DataFrame, modes: DataFrame, scale: float) -> DataFrame:
    """Boxes to read, in whole image pixels: blocks in block mode, lines in line mode."""
    m = modes.select(*PAGE, "block_id", "mode")
    px = [F.greatest(F.lit(0), (F.col(k) * scale).cast("int")).alias(k) for k in ("x0", "y0", "x1", "y1")]
    whole = blocks.join(m.where("mode = 'block'"), [*PAGE, "block_id"]).select(*PAGE, "block_id", F.lit(None).cast("int").alias("line_no"), *px)
    part = lines.withColumnRenamed("block_no", "block_id").join(m.where("mode = 'line'"), [*PAGE, "block_id"]).select(*PAGE, "block_id", "line_no", *px)
    return whole.unionByName(part)


def apply_ocr(lines: DataFrame, results: DataFrame) -> DataFrame:
    """results(doc_id, page_id, line_no, text, original_good): the text of read lines, kept where the original is good or nothing was read."""
    r = results.where("not original_good and text <> ''").select(*PAGE, "line_no", F.col("text").alias("_new"))
    return lines.join(r, [*PAGE, "line_no"], "left").select(*PAGE, "line_no", F.coalesce("_new", "text").alias("text"), F.when(F.col("_new").isNotNull(), "ocr").otherwise("embedded").alias("method"))


def page_object_check(objects: DataFrame, pages: DataFrame, strip_existing_ocr: bool = True) -> DataFrame:
    """objects(doc_id, page_id, kind, font, embedded, render_mode, area): whether a page's text can be used."""
    text = F.col("kind") == "text"
    agg = objects.groupBy(*PAGE).agg(F.bool_or(text).alias("text"), F.bool_or(text & F.col("render_mode").isin("invisible", "unknown")).alias("hidden"), F.bool_and(~text | ~F.col("embedded")).alias("loose"), F.bool_and(~text | F.contains(F.lower("font"), F.lit("glyphless"))).alias("glyphless"), F.max(F.when(~text, F.col("area"))).alias("image"))
    x = pages.join(agg, PAGE, "left")
    bad = F.col("hidden") | F.col("loose") | F.col("glyphless") | (F.coalesce("image", F.lit(0.0)) >= 0.65 * F.col("width") * F.col("height"))
    ok = F.coalesce("text", F.lit(False)) & (~bad if strip_existing_ocr else F.lit(True))
    return x.select(*PAGE, F.coalesce(ok, F.lit(False)).alias("ok"))


def notes_box_filter(boxes: DataFrame, least: float = 0.5, most_column: float | None = 0.8) -> DataFrame:
    """boxes(file_id, confidence, x0..y1, crop_width): kept detections with their place by (top, left)."""
    keep = F.col("confidence") >= least
    if most_column is not None:
        keep = keep & ((F.col("x0") + F.col("x1")) / 2 <= most_column * F.col("crop_width"))
    w = Window.partitionBy("file_id").orderBy("y0", "x0")
    return boxes.where(keep).withColumn("place", F.row_number().over(w))

"""Page-bounded joins between boxes: every join has doc_id and page_id as equal keys, the geometry is the residual."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.geometry import Box, bbox_gap, center_distance, intersection_area, intersection_pct

PAGE = ["doc_id", "page_id"]


def renamed(df: DataFrame, prefix: str, keep: list[str] = PAGE) -> DataFrame:
    """Every column but the keys gets a prefix."""
    return df.select(*keep, *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c not in keep])


def box_intersections(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs with a common area, a's columns as a_*, b's as b_*, and area."""
    pairs = renamed(a, "a_").join(renamed(b, "b_"), PAGE)
    return pairs.withColumn("area", intersection_area(Box.of("a_"), Box.of("b_"))).where("area > 0")


def box_distances(a: DataFrame, b: DataFrame, x_weight: float = 1.0, y_weight: float = 1.0, absolute: bool = False) -> DataFrame:
    return renamed(a, "a_").join(renamed(b, "b_"), PAGE).withColumn("distance", center_distance(Box.of("a_"), Box.of("b_"), x_weight, y_weight, absolute))


def argmax_assign(pairs: DataFrame, left: list[str], score: str, order: str, take: list[str]) -> DataFrame:
    """Per left key the row with the highest score, the first by order on ties."""
    best = pairs.groupBy(*left).agg(F.max(F.struct(F.col(score), (-F.col(order)).alias("_o"), *[F.col(c) for c in take])).alias("b"))
    return best.select(*left, F.col(f"b.{score}").alias(score), *[F.col(f"b.{c}").alias(c) for c in take])


def argmin_assign(pairs: DataFrame, left: list[str], score: str, order: str, take: list[str]) -> DataFrame:
    best = pairs.groupBy(*left).agg(F.min(F.struct(F.col(score), F.col(order).alias("_o"), *[F.col(c) for c in take])).alias("b"))
    return best.select(*left, F.col(f"b.{score}").alias(score), *[F.col(f"b.{c}").alias(c) for c in take])


def line_to_block(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, page_id, line_no, block_id, area): the block that covers most of a line; lines over no block are absent."""
    pairs = box_intersections(lines.select(*PAGE, "line_no", "x0", "y0", "x1", "y1"), blocks.select(*PAGE, "block_id", "x0", "y0", "x1", "y1"))
    out = argmax_assign(pairs, [*PAGE, "a_line_no"], "area", "b_block_id", ["b_block_id"])
    return out.select(*PAGE, F.col("a_line_no").alias("line_no"), F.col("b_block_id").alias("block_id"), "area")


def except_assigned(lines: DataFrame, assigned: DataFrame) -> DataFrame:
    return lines.join(assigned.select(*PAGE, "line_no"), [*PAGE, "line_no"], "left_anti")


def line_nearest_block(unassigned: DataFrame, blocks: DataFrame, most: float = 20.0) -> DataFrame:
    """For lines over no block: the nearest centre, x counted five times, only under `most`."""
    pairs = box_distances(unassigned.select(*PAGE, "line_no", "x0", "y0", "x1", "y1"), blocks.select(*PAGE, "block_id", "x0", "y0", "x1", "y1"), 5.0)
    out = argmin_assign(pairs, [*PAGE, "a_line_no"], "distance", "b_block_id", ["b_block_id"]).where(F.col("distance") < most)
    return out.select(*PAGE, F.col("a_line_no").alias("line_no"), F.col("b_block_id").alias("block_id"), "distance")


def missing_blocks(unassigned: DataFrame, most: float = 20.0) -> DataFrame:
    """Remaining lines with an island number: consecutive lines whose centres are close form one new block.

    Lines of a lone newline with an area of 1 or less are left out, and the lines around them are not consecutive.
    """
    if "text" in unassigned.columns:
        area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
        unassigned = unassigned.where(~((F.col("text") == "\n") & (area <= 1)) | F.col("text").isNull())
    w = Window.partitionBy(*PAGE).orderBy("line_no")
    now = Box.of()
    before = Box(*(F.lag(k).over(w) for k in ("x0", "y0", "x1", "y1")))
    follows = (F.lag("line_no").over(w) == F.col("line_no") - 1) & (center_distance(before, now) < most)
    return unassigned.withColumn("_new", (~F.coalesce(follows, F.lit(False))).cast("int")).withColumn("island", F.sum("_new").over(w)).drop("_new")


# Fixed value: lines whose y, divided by this, rounds to one number are one row.
ROW = 1.25


def reading_order(lines: DataFrame, tol: float = ROW, order: str = "line_no") -> DataFrame:
    """Adds `place`: by rows of equal rounded y, then x."""
    w = Window.partitionBy(*PAGE).orderBy(F.rint(F.col("y0") / tol), "x0", order)
    return lines.withColumn("place", F.row_number().over(w))


def attach_lines(assigned: DataFrame, blocks: DataFrame, lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks grown over their lines: n_lines, line_order, the outer box, and the page's text_extraction_method.

    lines(.., method): lines of one method stand in the order of their numbers, those of several in reading order, by
    rows of equal rounded y, then x. A block without lines keeps its box and has no order and no method.
    """
    inside = assigned.select(*PAGE, "line_no", "block_id").join(lines.select(*PAGE, "line_no", "method", "x0", "y0", "x1", "y1"), [*PAGE, "line_no"])
    read = F.array_sort(F.collect_list(F.struct(F.rint(F.col("y0") / ROW).alias("row"), "x0", "line_no")))
    one = F.size(F.collect_set("method")) <= 1
    order = F.when(one, F.array_sort(F.collect_list("line_no"))).otherwise(F.transform(read, lambda r: r.line_no))
    sides = [F.min("x0").alias("lx0"), F.min("y0").alias("ly0"), F.max("x1").alias("lx1"), F.max("y1").alias("ly1")]
    own = inside.groupBy(*PAGE, "block_id").agg(F.count("*").alias("n_lines"), order.alias("line_order"), *sides)
    own = own.join(pages.select(*PAGE, F.col("method").alias("text_extraction_method")), PAGE, "left")
    b = blocks.select(*PAGE, "block_id", "block_type", "x0", "y0", "x1", "y1").join(own, [*PAGE, "block_id"], "left")
    box = [F.least("x0", "lx0").alias("x0"), F.least("y0", "ly0").alias("y0"), F.greatest("x1", "lx1").alias("x1"), F.greatest("y1", "ly1").alias("y1")]
    return b.select(*PAGE, "block_id", "block_type", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "line_order", "text_extraction_method", *box)


def line_overlap_check(lines: DataFrame, pages: DataFrame, most: int = 2, least_area: float = 0.1, margin: float = 5.0) -> DataFrame:
    """Per page: no line outside the expanded page, none that meets more than `most` lines, itself included."""
    hits = box_intersections(lines, lines).where(F.col("area") > least_area).groupBy(*PAGE, "a_line_no").agg(F.count("*").alias("n"))
    crowded = hits.groupBy(*PAGE).agg(F.max("n").alias("most"))
    p = pages.select(*PAGE, "width", "height")
    inside = (F.col("x0") >= -margin * F.col("width")) & (F.col("y0") >= -margin * F.col("height")) & (F.col("x1") <= (1 + margin) * F.col("width")) & (F.col("y1") <= (1 + margin) * F.col("height"))
    placed = lines.join(p, PAGE).groupBy(*PAGE).agg(F.bool_and(inside).alias("inside"))
    return p.select(*PAGE).join(placed, PAGE, "left").join(crowded, PAGE, "left").select(*PAGE, (F.coalesce("inside", F.lit(True)) & (F.coalesce("most", F.lit(0)) <= most)).alias("ok"))


# Block types without text lines of their own.
NOT_COVERED = ["Figure", "Picture", "Table", "FigureGroup", "PictureGroup", "TableGroup"]


def gathered(tables: dict[str, DataFrame]) -> DataFrame:
    """One row a page with an array of rows for each table, empty where a page has none: a single shuffle of them all."""
    rows = [t.select(*PAGE, F.struct(*[c for c in t.columns if c not in PAGE]).alias(name)) for name, t in tables.items()]
    both = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), rows)
    return both.groupBy(*PAGE).agg(*[F.collect_list(name).alias(name) for name in tables])


def ocr_placeholders(detected: DataFrame, pages: DataFrame, scale: float = 2.0) -> DataFrame:
    """Detected lines of pages that are to be read as empty lines, their boxes in page scale, with place in reading order.

    pages has method, `ocr` for pages to read; scale is that of the image that the lines were found in.
    """
    x = detected.join(pages.where("method = 'ocr'").select(*PAGE), PAGE, "left_semi")
    return reading_order(x.withColumns({k: F.col(k) / scale for k in ("x0", "y0", "x1", "y1")}).withColumn("text", F.lit("")))


def layout_coverage(blocks: DataFrame, lines: DataFrame, pages: DataFrame, least: float = 0.25) -> DataFrame:
    """Per page: enough of the text blocks meet a line; without blocks yes, without lines no; one Text block over most of the page passes."""
    sides = ["x0", "y0", "x1", "y1"]
    text = blocks.where(~F.col("block_type").isin(NOT_COVERED)).select(*PAGE, "block_type", *sides)
    g = gathered({"blocks": text, "lines": lines.select(*PAGE, *sides), "sizes": pages.select(*PAGE, "width", "height")})
    box = lambda x: Box(*(x[k] for k in sides))
    met = F.size(F.filter("blocks", lambda b: F.exists("lines", lambda x: intersection_area(box(b), box(x)) > 0)))
    n = F.size("blocks")

    def fills(b, size):
        return (b.block_type == "Text") & (intersection_pct(Box(F.lit(0.0), F.lit(0.0), size.width, size.height), box(b)) > 0.8)

    whole = F.exists("blocks", lambda b: fills(b, F.get("sizes", F.lit(0))))
    ok = F.when(n == 0, True).when(F.size("lines") == 0, False).otherwise((met / n >= least) | ((n == 1) & whole))
    return g.where(F.size("sizes") > 0).select(*PAGE, ok.alias("ok"))


def route_pages(pages: DataFrame, coverage: DataFrame, overlaps: DataFrame, disable_ocr: bool = False, force_ocr: bool = False) -> DataFrame:
    p = pages.select(*PAGE, "ocr_errors_detected").join(renamed(coverage, "c_"), PAGE, "left").join(renamed(overlaps, "o_"), PAGE, "left")
    good = ~F.col("ocr_errors_detected") & F.coalesce("c_ok", F.lit(False)) & F.coalesce("o_ok", F.lit(False))
    method = F.lit("ocr") if force_ocr else F.when(good | F.lit(disable_ocr), "embedded").otherwise("ocr")
    return p.select(*PAGE, method.alias("method"))


def page_max_overlap(blocks: DataFrame) -> DataFrame:
    """Per page the largest share of a block that lies under another block."""
    b = blocks.select(*PAGE, "block_id", "x0", "y0", "x1", "y1")
    pairs = box_intersections(b, b).where("a_block_id <> b_block_id")
    share = pairs.withColumn("share", F.when(Box.of("a_").area > 0, F.col("area") / Box.of("a_").area).otherwise(0.0))
    most = share.groupBy(*PAGE).agg(F.max("share").alias("share"))
    return b.select(*PAGE).distinct().join(most, PAGE, "left").select(*PAGE, F.coalesce("share", F.lit(0.0)).alias("max_overlap"))


def contained_in_table(blocks: DataFrame, tables: DataFrame, pct: float = 0.95) -> DataFrame:
    """Text blocks without those that lie in a table."""
    text = blocks.where(F.col("block_type").isin("Text", "TextInlineMath"))
    inside = renamed(text, "a_").join(renamed(tables.select(*PAGE, "x0", "y0", "x1", "y1"), "b_"), PAGE)
    share = intersection_area(Box.of("a_"), Box.of("b_")) / F.greatest(F.lit(1.0), Box.of("a_").area)
    gone = inside.where(share > pct).select(*PAGE, F.col("a_block_id").alias("block_id")).distinct()
    return text.join(gone, [*PAGE, "block_id"], "left_anti")


def ref_to_block(refs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each reference's nearest block by top-left corner, the first on ties."""
    pairs = renamed(refs, "a_").join(renamed(blocks.select(*PAGE, "block_id", "x0", "y0"), "b_"), PAGE)
    d = F.sqrt((F.col("b_x0") - F.col("a_x")) ** 2 + (F.col("b_y0") - F.col("a_y")) ** 2)
    out = argmin_assign(pairs.withColumn("distance", d), [*PAGE, "a_ref"], "distance", "b_block_id", ["b_block_id"])
    return out.select(*PAGE, F.col("a_ref").alias("ref"), F.col("b_block_id").alias("block_id"), "distance")


# The names of block types; other labels of a layout model are unknown.
LABELS = [
    "Line", "Span", "Char", "FigureGroup", "TableGroup", "ListGroup", "PictureGroup", "Page", "Caption", "Code", "Figure", "Footnote", "Form", "Equation",
    "Handwriting", "TextInlineMath", "ListItem", "PageFooter", "PageHeader", "Picture", "SectionHeader", "Table", "Text", "TableOfContents", "Document",
    "ComplexRegion", "TableCell", "Reference",
]


def place_layout(boxes: DataFrame, pages: DataFrame, image: tuple = (1224.0, 1584.0)) -> DataFrame:
    """Boxes in order of position get ids 0, 1, ...; coordinates go from image to page and are clipped to it.

    top_k (map of label to probability) keeps the labels that are block types.
    """
    b = boxes.join(pages.select(*PAGE, "width", "height"), PAGE)
    clip = lambda c, size, of: F.least(F.greatest(F.col(c) * F.col(size) / of, F.lit(0.0)), F.col(size))
    seq = F.row_number().over(Window.partitionBy(*PAGE).orderBy("position", "block_id")) - 1
    known = F.map_filter("top_k", lambda label, p: label.isin(LABELS))
    box = [clip("x0", "width", image[0]).alias("x0"), clip("y0", "height", image[1]).alias("y0"), clip("x1", "width", image[0]).alias("x1"), clip("y1", "height", image[1]).alias("y1")]
    return b.select(*PAGE, seq.alias("block_id"), "block_type", known.alias("top_k"), *box)


def forced_layout(pages: DataFrame, block_type: str) -> DataFrame:
    return pages.select(*PAGE, F.lit(0).alias("block_id"), F.lit(block_type).alias("block_type"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("width").alias("x1"), F.col("height").alias("y1"), F.lit(1.0).alias("confidence"))


def place_missing(new: DataFrame, blocks: DataFrame) -> DataFrame:
    """The existing block after which a new one goes: 5 |dx| + |dy| of the centres, least wins."""
    pairs = box_distances(new, blocks.select(*PAGE, "block_id", "x0", "y0", "x1", "y1"), 5.0, 1.0, absolute=True)
    out = argmin_assign(pairs, [*PAGE, "a_island"], "distance", "b_block_id", ["b_block_id"])
    return out.select(*PAGE, F.col("a_island").alias("island"), F.col("b_block_id").alias("after_block"), "distance")


def expand_layout(blocks: DataFrame, pages: DataFrame, frac: float = 0.05) -> DataFrame:
    """Pictures, figures and complex regions grow by `frac`, less when a neighbour is near; clipped to the page."""
    grown = ["Picture", "Figure", "ComplexRegion"]
    b = blocks.select(*PAGE, "block_id", "block_type", "x0", "y0", "x1", "y1")
    pairs = renamed(b.where(F.col("block_type").isin(grown)), "a_").join(renamed(b, "b_"), PAGE).where("a_block_id <> b_block_id")
    gaps = pairs.groupBy(*PAGE, F.col("a_block_id").alias("block_id")).agg(F.min(bbox_gap(Box.of("a_"), Box.of("b_"))).alias("gap"))
    x = b.join(gaps, [*PAGE, "block_id"], "left").join(pages.select(*PAGE, "width", "height"), PAGE)
    box = Box.of()
    part = lambda size: F.when(F.col("gap").isNull(), F.lit(frac)).when((F.col("gap") > 0) & (size > 0), F.least(F.lit(frac), F.col("gap") / size)).otherwise(F.lit(0.0))
    dx, dy = box.width * part(box.width), box.height * part(box.height)
    is_grown = F.col("block_type").isin(grown)
    side = lambda c, moved, low, high: F.when(is_grown, F.least(F.greatest(moved, low), high)).otherwise(F.col(c)).alias(c)
    return x.select(*PAGE, "block_id", "block_type", side("x0", box.x0 - dx, F.lit(0.0), F.col("width")), side("y0", box.y0 - dy, F.lit(0.0), F.col("height")), side("x1", box.x1 + dx, F.lit(0.0), F.col("width")), side("y1", box.y1 + dy, F.lit(0.0), F.col("height")))


def next_block(blocks: DataFrame, ignored: list[str], order: list[str]) -> DataFrame:
    """Adds next_page, next_block: the following block of the document that isn't of an ignored type."""
    w = Window.partitionBy("doc_id").orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    ok = ~F.col("block_type").isin(ignored) if ignored else F.lit(True)
    nxt = F.first(F.when(ok, F.struct("page_id", "block_id")), ignorenulls=True).over(w)
    return blocks.withColumn("_next", nxt).withColumns({"next_page": F.col("_next.page_id"), "next_block": F.col("_next.block_id")}).drop("_next")


def prev_block(blocks: DataFrame, ignored: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ok = ~F.col("block_type").isin(ignored) if ignored else F.lit(True)
    prev = F.last(F.when(ok, F.struct("page_id", "block_id")), ignorenulls=True).over(w)
    return blocks.withColumn("_prev", prev).withColumns({"prev_page": F.col("_prev.page_id"), "prev_block": F.col("_prev.block_id")}).drop("_prev")


def remove_items(blocks: DataFrame, ids: DataFrame) -> DataFrame:
    return blocks.join(ids, [*PAGE, "block_id"], "left_anti")


def replace_block(blocks: DataFrame, mapping: DataFrame) -> DataFrame:
    """mapping(doc_id, page_id, block_id, new_type): the old row is marked removed, a new row takes its place with a fresh id."""
    b = blocks.join(mapping, [*PAGE, "block_id"], "left")
    top = Window.partitionBy(*PAGE)
    fresh = F.max("block_id").over(top) + F.row_number().over(top.orderBy(F.col("new_type").isNull(), "block_id"))
    b = b.withColumn("_fresh", fresh)
    old = b.select(*PAGE, "block_id", "block_type", F.col("block_id").alias("seq"), F.col("new_type").isNotNull().alias("removed"))
    new = b.where("new_type is not null").select(*PAGE, F.col("_fresh").alias("block_id"), F.col("new_type").alias("block_type"), F.col("block_id").alias("seq"), F.lit(False).alias("removed"))
    return old.unionByName(new)

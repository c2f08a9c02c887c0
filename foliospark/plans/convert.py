"""Laid-out lines to Markdown: lines go to blocks, and a chain of processors works on the blocks where they are.

Lines, boxes, pages and finished tables of a document are brought together once, by document. All that follows is done
on that layout, in the row of a page or in windows over pages and documents, without moving a block again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as t
from ..functions.geometry import Box, center_distance, intersection_area
from ..operators import processors, render, structure
from ..operators.trees import optional

PAGE = render.PAGE
SIDES = ("x0", "y0", "x1", "y1")


@dataclass(frozen=True)
class Corpus:
    """The tables of a corpus: lines, layout boxes, pages, and blocks once they are made.

    tables(doc_id, page_id, block_id, md) has the Markdown of tables whose cells are known (`operators.tables.md_table`),
    by the number of their box.
    """

    lines: DataFrame
    boxes: DataFrame
    pages: DataFrame
    blocks: DataFrame | None = None
    tables: DataFrame | None = None


Processor = Callable[[Corpus], Corpus]


def _box(x: Column) -> Box:
    return Box(*(x[k] for k in SIDES))


def _together(c: Corpus) -> DataFrame:
    """One row a page with its size, lines and boxes in order and its tables; partitioned by document."""
    box = [F.col(k).cast("double").alias(k) for k in SIDES]
    line = F.struct(F.col("line_no").cast("long").alias("line_no"), *box, F.col("text").alias("text"))
    frame = F.struct(F.col("block_id").cast("int").alias("block_id"), "block_type", *box)
    size = F.struct(optional(c.pages, "width", "double").alias("width"), optional(c.pages, "height", "double").alias("height"))
    parts = [c.lines.select(*PAGE, line.alias("line")), c.boxes.select(*PAGE, frame.alias("box")), c.pages.select(*PAGE, size.alias("size"))]
    if c.tables is not None:
        parts.append(c.tables.select(*PAGE, F.struct(F.col("block_id").cast("int").alias("block_id"), "md").alias("table")))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if "table" not in rows.columns:
        rows = rows.withColumn("table", F.lit(None).cast("struct<block_id:int,md:string>"))
    ordered = [F.array_sort(F.collect_list(k)).alias(f"{k}s") for k in ("line", "box", "table")]
    far = [F.max(F.greatest(F.col(f"line.{k}"), F.col(f"box.{k}"))).alias(f"_{k}") for k in ("x1", "y1")]
    pages = rows.repartition("doc_id").groupBy(*PAGE).agg(*ordered, F.max("size").alias("size"), *far)
    return pages.select(*PAGE, "lines", "boxs", "tables", F.coalesce("size.width", "_x1").alias("width"), F.coalesce("size.height", "_y1").alias("height"))


def _blocks(near: float = 60.0, apart: float = 20.0) -> tuple[Column, Column, Column]:
    """Of a page with lines and boxs: its lines with their box, lines left over in runs, and its blocks in order."""
    boxes = F.col("boxs")

    def owner(x: Column) -> Column:
        over = F.array_max(F.transform(boxes, lambda b: F.when(intersection_area(_box(x), _box(b)) > 0, F.struct(intersection_area(_box(x), _box(b)).alias("a"), (-b.block_id).alias("b")))))
        close = F.array_min(F.transform(boxes, lambda b: F.struct(center_distance(_box(x), _box(b), 5.0).alias("d"), b.block_id.alias("b"))))
        return F.coalesce(-over.b, F.when(close.d < near, close.b))

    owned = F.transform("lines", lambda x: F.struct(x.alias("line"), owner(x).alias("to")))
    lone = lambda x: F.coalesce((x.text == "\n") & (_box(x).area <= 1), F.lit(False))
    rest = F.transform(F.filter("owned", lambda o: o.to.isNull() & ~lone(o.line)), lambda o: o.line)
    kind = "array<array<struct<line_no:bigint,x0:double,y0:double,x1:double,y1:double,text:string>>>"

    def joined_on(runs: Column, x: Column) -> Column:
        last = F.try_element_at(runs, F.lit(-1))
        before = F.try_element_at(last, F.lit(-1))
        goes_on = (before.line_no == x.line_no - 1) & (center_distance(_box(before), _box(x)) < apart)
        longer = F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(F.array_append(last, x)))
        return F.when((F.size(runs) > 0) & F.coalesce(goes_on, F.lit(False)), longer).otherwise(F.array_append(runs, F.array(x)))

    runs = F.aggregate(rest, F.array().cast(kind), joined_on)

    def extent(lines: Column) -> list[Column]:
        # a field of an array of structs is an array
        return [f(lines[k]).alias(k) for k, f in zip(SIDES, (F.array_min, F.array_min, F.array_max, F.array_max), strict=True)]

    def block(after: Column, run: Column, block_type: Column, box: list[Column], lines: Column) -> Column:
        return F.struct(after.cast("int").alias("after"), run.cast("int").alias("run"), block_type.alias("block_type"), *box, lines.alias("lines"))

    own = lambda b: F.transform(F.filter("owned", lambda o: o.to == b.block_id), lambda o: o.line)
    old = F.transform(boxes, lambda b: block(b.block_id, F.lit(0), b.block_type, [b[k].alias(k) for k in SIDES], own(b)))

    def new(lines: Column, i: Column) -> Column:
        box = F.struct(*extent(lines))
        place = F.array_min(F.transform(boxes, lambda b: F.struct(center_distance(_box(box), _box(b), 5.0, 1.0, absolute=True).alias("d"), b.block_id.alias("b"))))
        return block(F.coalesce(place.b, F.lit(-1)), i + 1, F.lit("Text"), extent(lines), lines)

    all_ = F.array_sort(F.concat(F.filter(old, lambda b: F.size(b.lines) > 0), F.transform("runs", new)))
    return owned, runs, all_


def make_blocks(c: Corpus) -> Corpus:
    """Each line goes to the block that covers most of it, or to the nearest one; a block's text is its lines in order.

    Lines left over form new text blocks, each placed after the existing block nearest to it, on pages without
    blocks in line order. Blocks are numbered anew in that order. Boxes without lines are left out.
    """
    owned, runs, all_ = _blocks()
    pages = _together(c).withColumn("owned", owned).withColumn("runs", runs).withColumn("blocks", all_)
    # an inner explode would put a filter with all of this written out in it below
    rows = pages.select(*PAGE, "width", "height", "tables", F.posexplode_outer("blocks").alias("at", "b")).where("at IS NOT NULL")
    md = F.try_element_at(F.filter("tables", lambda x: (x.block_id == F.col("b.after")) & (F.col("b.run") == 0)), F.lit(1)).md
    text = F.array_join(F.transform("b.lines", lambda x: x.text), "\n")
    number = (F.col("at") + 1).cast("int")
    blocks = rows.select(*PAGE, "width", "height", number.alias("block_id"), F.col("b.block_type"), *[F.col(f"b.{k}") for k in SIDES], F.col("b.lines"), text.alias("text"), F.size("b.lines").cast("long").alias("n_lines"), md.alias("table_md"))
    return replace(c, blocks=blocks)


def drop_line_numbers(c: Corpus) -> Corpus:
    """Tall narrow blocks of numbers go."""
    return replace(c, blocks=c.blocks.where(~processors.is_line_numbers()))


def format_code(c: Corpus) -> Corpus:
    """Adds code: the text of code blocks, each line indented as it stands on the page."""
    return replace(c, blocks=c.blocks.withColumn("code", F.when(F.col("block_type") == "Code", processors.code_text(F.col("lines")))))


def measure_lines(c: Corpus) -> Corpus:
    """Blocks keep what later steps need to know of their lines, instead of the lines."""
    return replace(c, blocks=c.blocks.withColumns(structure.line_edges()).drop("lines"))


def group_lists(c: Corpus) -> Corpus:
    """Adds list_group to runs of list items; single items become text, laid_type keeps what they were."""
    b = processors.with_list_groups(c.blocks.withColumn("laid_type", F.col("block_type")))
    alone = (F.col("block_type") == "ListItem") & F.col("list_group").isNull()
    return replace(c, blocks=b.withColumn("block_type", F.when(alone, "Text").otherwise(F.col("block_type"))))


def group_captions(c: Corpus) -> Corpus:
    """Adds group_of: the block that a caption or a captioned block belongs to."""
    return replace(c, blocks=structure.with_caption_groups(c.blocks))


def indent_blocks(c: Corpus) -> Corpus:
    """Adds blockquote_level and list_indent_level, folded over each page's blocks."""
    kind = "laid_type" if "laid_type" in c.blocks.columns else "block_type"
    page, group = Window.partitionBy(*PAGE).orderBy("block_id"), Window.partitionBy(*PAGE, "list_group").orderBy("block_id")
    of = {"block_type": F.col(kind)} | {k: F.col(k) for k in structure.QUOTED if k != "block_type"}
    b = c.blocks.withColumns({f"_{k}": F.lead(v).over(page) for k, v in of.items()}).withColumns({f"n{k}": F.lead(k).over(group) for k in ("x0", "y0")})
    typed = b.withColumn("_own_type", F.col("block_type")).withColumn("block_type", F.col(kind))
    whole = F.struct("block_id", *structure.quote_flags(), F.struct(*typed.columns).alias("block"))
    pages = typed.select(*PAGE, whole.alias("r")).groupBy(*PAGE).agg(F.array_sort(F.collect_list("r"), lambda a, b: a.block_id - b.block_id).alias("rows"))
    items = F.filter(F.transform("rows", lambda r: r.block), lambda x: x.list_group.isNotNull())
    pages = pages.withColumn("quotes", structure.quote_levels(F.col("rows"))).withColumn("items", items)
    tol = F.get("items", F.lit(0)).width * 0.01
    levels = lambda g: structure.indent_levels(F.filter("items", lambda x: x.list_group == g), tol)
    groups = F.array_distinct(F.transform("items", lambda x: x.list_group))
    pages = pages.withColumn("levels", F.flatten(F.transform(groups, levels)))
    both = F.zip_with("rows", "quotes", lambda r, q: F.struct(r.block.alias("b"), q.level.alias("quote")))
    rows = pages.select(*PAGE, "levels", F.explode_outer(both).alias("x"))
    indent = F.try_element_at(F.filter("levels", lambda e: e.block_id == F.col("x.b.block_id")), F.lit(1)).level
    kept = [F.col(f"x.b.{'_own_type' if k == 'block_type' else k}").alias(k) for k in c.blocks.columns if k not in PAGE]
    return replace(c, blocks=rows.select(*PAGE, *kept, F.col("x.quote").alias("blockquote_level"), indent.alias("list_indent_level")))


def drop_running(c: Corpus) -> Corpus:
    """First and last blocks of pages that repeat over a document's pages go."""
    return replace(c, blocks=processors.with_running(c.blocks).where(~F.col("running")).drop("running"))


def join_paragraphs(c: Corpus) -> Corpus:
    """Adds has_continuation to text that goes on in the next column or on the next page."""
    return replace(c, blocks=structure.with_continuation(c.blocks))


def set_levels(c: Corpus) -> Corpus:
    """Adds heading_level to section headers, by the heights of their lines."""
    b = c.blocks.withColumn("line_height", (F.col("y1") - F.col("y0")) / F.col("n_lines"))
    return replace(c, blocks=processors.with_heading_levels(b, F.col("block_type") == "SectionHeader").drop("line_height"))


def order_blocks(c: Corpus) -> Corpus:
    """Adds place: headers of a page first, footnotes last, all else in order."""
    rank = F.when(F.col("block_type") == "PageHeader", 0).when(F.col("block_type") == "Footnote", 2).otherwise(1)
    return replace(c, blocks=c.blocks.withColumn("place", F.row_number().over(Window.partitionBy(*PAGE).orderBy(rank, "block_id"))))


DEFAULT: list[Processor] = [make_blocks, format_code, measure_lines, drop_running, drop_line_numbers, group_lists, group_captions, indent_blocks, set_levels, join_paragraphs, order_blocks]


def with_processors(corpus: Corpus, functions: list[Processor] | None = None) -> Corpus:
    """The functions in order; a list of one's own replaces the default."""
    return reduce(lambda c, f: f(c), DEFAULT if functions is None else functions, corpus)


def markdown_of(blocks: DataFrame) -> Column:
    """A block's Markdown, by what the processors have found; headers and footers of pages have none."""
    own = lambda name, kind, default: optional(blocks, name, kind, F.lit(default))
    body = t.md_escape(F.col("text"))
    level = optional(blocks, "heading_level", "int", F.lit(2))
    quote = F.repeat(F.lit("> "), own("blockquote_level", "int", 0))
    code = F.concat(F.lit("```\n"), optional(blocks, "code", "string", F.col("text")), F.lit("\n```\n\n"))
    table = optional(blocks, "table_md", "string")
    kind = F.col("block_type")
    return (
        F.when(kind.isin("PageHeader", "PageFooter"), "")
        .when((kind == "Table") & table.isNotNull(), F.concat(table, F.lit("\n\n")))
        .when(kind == "SectionHeader", t.md_heading(body, level))
        .when(kind == "ListItem", t.md_list(body, own("list_indent_level", "int", 0)))
        .when(kind == "Code", code)
        .when(kind == "Equation", t.md_math(F.col("text"), F.lit("block")))
        .otherwise(F.concat(quote, t.md_paragraph(body, own("has_continuation", "boolean", False))))
    )


def to_markdown(corpus: Corpus, functions: list[Processor] | None = None) -> DataFrame:
    """(doc_id, n_pages, md)."""
    blocks = with_processors(corpus, functions).blocks
    order = "place" if "place" in blocks.columns else "block_id"
    return render.md_document(blocks.select(*PAGE, F.col(order).alias("block_id"), markdown_of(blocks).alias("md")))

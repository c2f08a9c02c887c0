"""The plan from lines to Markdown loses no line."""

from pyspark.sql import functions as F

from foliospark.operators import layout, processors, structure
from foliospark.plans import convert
from foliospark.queries.pipelines import _corpus

from .conftest import SF

LINES = "doc_id long, page_id long, line_no long, x0 double, y0 double, x1 double, y1 double, text string"
BOXES = "doc_id long, page_id long, block_id long, block_type string, x0 double, y0 double, x1 double, y1 double"


def test_each_line_is_in_one_block(spark):
    c = _corpus(spark, SF)
    got = convert.make_blocks(c).blocks
    assert got.select("doc_id", "page_id", "block_id").distinct().count() == got.count()
    assert got.agg(F.sum("n_lines")).first()[0] == c.lines.count()


def test_lines_far_from_boxes_and_pages_without(spark):
    line = lambda page, no, y, text: (1, page, no, 50.0, y, 500.0, y + 10.0, text)
    lines = [line(0, 1, 100.0, "in box"), line(0, 2, 300.0, "far away"), line(0, 3, 312.0, "and on"), line(0, 4, 700.0, "last box"), line(1, 1, 100.0, "no boxes here"), line(1, 2, 600.0, "nor here")]
    boxes = [(1, 0, 0, "Text", 40.0, 90.0, 510.0, 120.0), (1, 0, 1, "Text", 40.0, 690.0, 510.0, 720.0)]
    c = convert.Corpus(spark.createDataFrame(lines, LINES), spark.createDataFrame(boxes, BOXES), spark.createDataFrame([(1, 0), (1, 1)], "doc_id long, page_id long"))
    md = convert.to_markdown(c).collect()[0].md
    assert [md.count(r[-1]) for r in lines] == [1] * 6
    at = [md.index(r[-1]) for r in lines]
    assert at == sorted(at)


def test_running_footers_go(spark):
    blocks = [(1, p, b, "Text", 0.0, 9.0, t, 1) for p in range(6) for b, t in ((0, f"body {'abcdef'[p] * 9}"), (1, "the same footer"))]
    c = convert.Corpus(None, None, None, spark.createDataFrame(blocks, "doc_id long, page_id long, block_id int, block_type string, y0 double, y1 double, text string, n_lines long"))
    assert {r.block_id for r in convert.drop_running(c).blocks.collect()} == {0}


def test_chain_agrees_with_the_operators(spark):
    """What the processors add on one layout is what the operators, each held against SQL, make of the same blocks."""
    c = _corpus(spark, SF)
    made = convert.make_blocks(c)
    kept = convert.drop_line_numbers(convert.format_code(made))
    blocks = kept.blocks.checkpoint()
    key = ["doc_id", "page_id", "block_id"]
    lines = blocks.select(*key[:2], F.col("block_id").alias("block_no"), F.explode("lines").alias("x")).select(*key[:2], "block_no", "x.*")
    plain = blocks.drop("width", "height", "lines")
    got = convert.with_processors(convert.replace(c, blocks=blocks), [convert.group_lists, convert.group_captions, convert.indent_blocks, convert.set_levels, convert.join_paragraphs, convert.order_blocks]).blocks.checkpoint()

    def same(ours, theirs):
        a, b = (sorted(map(str, x.collect())) for x in (ours, theirs))
        assert a == b and len(a) > 0

    groups = processors.group_lists(plain, c.pages)
    same(got.where("laid_type = 'ListItem'").select(*key, "list_group", "block_type"), processors.unmark_lists(groups).select(*key, "list_group", "block_type"))
    items = groups.where("list_group is not null").withColumn("group_id", F.col("list_group"))
    same(got.where("list_group is not null").select(*key, "list_indent_level"), structure.list_indent(items, c.pages).select(*key, "list_indent_level"))
    same(got.select(*key, "blockquote_level"), structure.blockquote(plain).select(*key, "blockquote_level"))
    unmarked = plain.drop("block_type").join(got.select(*key, "block_type"), key)
    same(got.where("group_of is not null").select(*key, "group_of"), structure.group_captions(unmarked, c.pages).where("group_of is not null").select(*key, "group_of"))
    same(got.select(*key, "has_continuation"), structure.text_continuation(unmarked, lines, c.pages).select(*key, "has_continuation"))
    heads = plain.where("block_type = 'SectionHeader'").withColumn("line_height", (F.col("y1") - F.col("y0")) / F.col("n_lines"))
    same(got.where("block_type = 'SectionHeader'").select(*key, "heading_level"), processors.heading_levels(heads).select(*key, "heading_level"))
    same(blocks.where("block_type = 'Code'").select(*key, "code"), processors.code_format(lines).join(blocks.where("block_type = 'Code'").select(*key[:2], F.col("block_id").alias("block_no")), [*key[:2], "block_no"]).select(*key[:2], F.col("block_no").alias("block_id"), "code"))


def test_layout_agrees_with_the_operators(spark):
    """Lines find the same boxes as in the joins that SQL checks."""
    c = _corpus(spark, SF)
    sure = layout.line_to_block(c.lines, c.boxes).select("doc_id", "page_id", "line_no", "block_id")
    near = layout.line_nearest_block(layout.except_assigned(c.lines, sure), c.boxes, 60.0).select("doc_id", "page_id", "line_no", "block_id")
    owned, _, _ = convert._blocks()
    mine = convert._together(c).select("doc_id", "page_id", F.explode_outer(owned).alias("o")).where("o.to is not null").select("doc_id", "page_id", F.col("o.line.line_no").alias("line_no"), F.col("o.to").alias("block_id"))
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, sure.unionByName(near).collect()))


def test_one_document(spark):
    line = lambda page, no, x, y, text: (1, page, no, x, y, x + 5.0 * len(text), y + 10.0, text)
    lines, boxes = [], []

    def block(page, number, kind, x, y, *texts):
        boxes.append((1, page, number, kind, x, y, x + 5.0 * max(map(len, texts)), y + 14.0 * len(texts)))
        lines.extend(line(page, 100 * number + k, x + 5.0 * (len(s) - len(s.lstrip())), y + 14.0 * k, s.lstrip()) for k, s in enumerate(texts))

    for page in range(5):
        block(page, 0, "Text", 50.0, 10.0, "Annual report")
    block(0, 1, "SectionHeader", 50.0, 60.0, "Title")
    block(1, 2, "Footnote", 50.0, 40.0, "1 a note")
    block(0, 3, "ListItem", 60.0, 200.0, "outer item of the list")
    block(0, 4, "ListItem", 90.0, 216.0, "inner")
    block(0, 5, "Code", 50.0, 300.0, "if x:", "    y()")
    block(0, 6, "Table", 50.0, 400.0, "cells as lines")
    block(0, 7, "Caption", 50.0, 416.0, "Table 1")
    block(0, 8, "Text", 300.0, 500.0, "1", "2", "3", "4", "5")
    block(0, 9, "Text", 50.0, 700.0, "a text that goes on after", "the end of the page with-")
    block(1, 1, "Text", 50.0, 60.0, "out a stop", "and then ends")
    tables = spark.createDataFrame([(1, 0, 6, "| a | b |\n|---|---|\n| 1 | 2 |")], "doc_id long, page_id long, block_id long, md string")
    sizes = spark.createDataFrame([(1, p, 600.0, 800.0) for p in range(5)], "doc_id long, page_id long, width double, height double")
    c = convert.Corpus(spark.createDataFrame(lines, LINES), spark.createDataFrame(boxes, BOXES), sizes, tables=tables)
    md = convert.to_markdown(c).first().md
    assert md == (
        "## Title\n\n- outer item of the list\n  - inner\n```\nif x:\n    y()\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\nTable 1\n\n"
        "a text that goes on after the end of the page without a stop and then ends\n\n1 a note"
    )

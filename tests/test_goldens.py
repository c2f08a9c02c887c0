"""Hand-computed rows for the edges: ties, empty texts, zero area, odd spaces, plans."""

import json

from pyspark.sql import functions as F

from foliospark.functions import geometry as g, text as t
from foliospark.operators import layout, notes, processors, render, responses, tables
from foliospark.queries import QUERIES
from foliospark.sources import files

from .conftest import SF


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_gap_and_overlap(spark):
    box = lambda *v: g.Box(*(F.lit(float(x)) for x in v))
    a = box(0, 0, 10, 10)
    r = one(spark, *(g.bbox_gap(a, b).alias(n) for n, b in (("touch", box(10, 0, 20, 10)), ("right", box(13, 0, 20, 10)), ("corner", box(13, 14, 20, 20)), ("inside", box(2, 2, 3, 3)))))
    assert tuple(r) == (0.0, 3.0, 5.0, 0.0)
    assert one(spark, g.intersection_pct(box(1, 1, 1, 5), a).alias("x")).x == 0.0


def test_bad_text(spark):
    rows = [("",), ("plain words here",), ("�" * 7,), ("�" * 6 + "a" * 20,), ("a     \n\n\n\n",), ("*** ***",)]
    got = [r.b for r in spark.createDataFrame(rows, "x string").select(t.detect_bad_text(F.col("x")).alias("b")).collect()]
    assert got == [True, False, True, False, False, True]


def test_spaces_and_header(spark):
    r = one(spark, t.normalize_spaces(F.lit("a b　c")).alias("a"), t.clean_header_text(F.lit("12 Report\n 7")).alias("b"), t.unwrap_math(F.lit("<math>\\text{x} 5\\%</math>")).alias("c"), t.unwrap_math(F.lit("<math>x^2</math>")).alias("d"))
    assert tuple(r) == ("a b c", "Report", "x 5%", "<math>x^2</math>")


def test_argmax_ties_take_the_first(spark):
    pairs = spark.createDataFrame([(1, 5.0, 2), (1, 5.0, 1), (1, 4.0, 0)], "k int, area double, o int")
    assert layout.argmax_assign(pairs, ["k"], "area", "o", ["o"]).first().o == 1


def test_line_touching_no_block(spark):
    lines = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 10.0, 10.0), (1, 0, 1, 500.0, 500.0, 510.0, 510.0)], "doc_id long, page_id int, line_no int, x0 double, y0 double, x1 double, y1 double")
    blocks = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 20.0, 20.0)], "doc_id long, page_id int, block_id int, x0 double, y0 double, x1 double, y1 double")
    sure = layout.line_to_block(lines, blocks)
    assert [r.line_no for r in sure.collect()] == [0]
    assert layout.line_nearest_block(layout.except_assigned(lines, sure), blocks).count() == 0


def test_streak_and_common(spark):
    texts = spark.createDataFrame([(1, p, "Head 1" if p < 4 else f"T{p}x") for p in range(8)], "doc_id long, page_id int, text string")
    assert [r.text for r in processors.common_elements(texts).collect()] == ["Head"]


def test_indel(spark):
    df = spark.createDataFrame([("abcd", "abcd"), ("abcd", "abxd"), ("", "a")], "a string, b string")
    got = [round(r[0], 3) for r in df.select(processors.indel_ratio("a", "b")).collect()]
    assert got == [100.0, 75.0, 0.0]


def test_dollar_chain_folds_to_the_next_ordinary_column(spark):
    cells = [(1, r, c, 1, x) for r in (0, 1) for c, x in enumerate(["a", "$", "$", "5"])]
    df = spark.createDataFrame(cells, "table_id int, row_id int, col_id int, colspan int, text string")
    got = sorted((r.row_id, r.col_id, r.text) for r in tables.combine_dollar_column(df).collect())
    assert got == [(0, 0, "a"), (0, 1, "$$5"), (1, 0, "a"), (1, 1, "$$5")]


def test_fraction_before_and_after_item_one(spark):
    rows = [(1, 0, "1/4: C10 early"), (1, 1, "1. Material steel"), (1, 2, "5/16: C10 late")]
    c = notes.notes_classify(spark.createDataFrame(rows, "file_id long, ord int, text string"))
    assert {r.ord: r.to_first for r in notes.notes_continue(c).collect()} == {0: False, 2: True}


def test_notes_by_hand(spark):
    """A file of every rule, put together by hand from the rules' description."""
    given = ["Drawing No. 7", "general NOTES : all", "3. Core hardness HRC 30", "1 Material: steel", "#5/16: C10B21", "MIN", "12.5 ± 0.1", "Impact test needed", "(材質 鋼)", "（芯部硬度）", "(衝擊)", "(other 彎)", "Head free of cracks", "plain line", "3) second three", "core hardness-HRC 30!", "__", "12/3: x"]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(given)], "file_id long, ord int, text string")
    want = ["Notes:", "1. Material: steel", "#5/16: C10B21", "(材質 鋼)", "2. Impact test needed", "(衝擊)", "3. Core hardness HRC 30", "（芯部硬度）", "4. Head free of cracks", "5. core hardness-HRC 30!", "plain line", "(other 彎)"]
    assert notes.notes_assemble(lines).first().notes.split("\n") == want


def test_file_of_exactly_the_limit(spark):
    rows = [("a.pdf", files.MAX_SIZE, "255044462D"), ("a.pdf", files.MAX_SIZE + 1, "255044462D"), ("a.exe", 1, None), ("a.png", 1, None)]
    got = [r.reason for r in files.admit_files(spark.createDataFrame(rows, "name string, size long, head_hex string")).collect()]
    assert got == [None, "File too large (max 50MB)", "Unsupported file type", "File content does not match a supported type"]


def test_no_cartesian_products(spark):
    for name in ("line_to_block", "line_nearest_block", "layout_coverage", "contained_in_table", "text_to_cell", "notes_attach"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan, name


def test_markdown_marks(spark):
    got = one(spark, t.md_escape(F.lit("a_b  $ <pre>p_q\n\n r</pre> <i class='x_y'>1*2</i> <code>c_d  e</code> 3 < 4_5 <math>k_1")).alias("x")).x
    assert got == "a\\_b \\$ <pre>p_q\n\n r</pre> <i class='x_y'>1\\*2</i> <code>c_d e</code> 3 < 4\\_5 <math>k\\_1"


def test_answers_by_kind(spark):
    """One block with 20 characters of text and an answer of each kind at the edge of its rule."""
    block = spark.createDataFrame([(1, 0, 0, "<p>" + "x" * 13 + "</p>", "y" * 20, "y" * 20)], "doc_id int, page_id int, block_id int, html string, text string, formatted string")

    def answer(kind, corrected):
        r = spark.createDataFrame([(1, 0, 0, corrected)], "doc_id int, page_id int, block_id int, corrected string")
        row = responses.accept_html(block, r, kind).first()
        return row.errors, row.html if row.html != block.first().html else None, row.description

    assert answer("form", None) == (1, None, None)
    assert answer("form", "a" * 6) == (1, None, None) and answer("form", "a" * 7) == (0, "a" * 7, None)
    assert answer("form", "```html\n<p>new text</p>\n```") == (0, "<p>new text</p>", None)
    assert answer("complex", "No corrections") == (0, None, None) and answer("form", "No corrections") == (0, "No corrections", None)
    assert answer("math", "") == (1, None, None) and answer("math", "a" * 12) == (0, "a" * 12, None)
    assert answer("handwriting", "no corrections needed") == (0, "<p>no corrections needed</p>", None)
    assert answer("equation", "a" * 6) == (1, None, None) and answer("equation", "a" * 7) == (0, "a" * 7, None)
    assert answer("equation", "<math>a</math><math>") == (1, None, None)
    assert answer("image_description", "a" * 9) == (1, None, None) and answer("image_description", "a" * 10) == (0, None, "a" * 10)


def test_page_corrections(spark):
    blocks = spark.createDataFrame([(1, p, b, "Text", "h") for p in range(5) for b in range(2)], "doc_id int, page_id int, block_id int, block_type string, html string")
    bodies = [
        (1, 0, '{"correction_type":"reorder_first","blocks":[{"id":"0/Text/1"},{"id":"0/Text/0"},{"id":"nonsense"}]}'),
        (1, 1, '{"correction_type":"reorder","blocks":[{"id":"1/Text/1"},{"id":"2/Text/0"}]}'),
        (1, 2, '{"correction_type":"rewrite","blocks":"[{\\"id\\":\\" /page/2/Text/1\\",\\"html\\":\\"n\\"},{\\"id\\":\\"/page/9/Text/1\\",\\"html\\":\\"m\\"}]"}'),
        (1, 3, "no JSON"),
    ]
    out = responses.accept_page(blocks, spark.createDataFrame(bodies, "doc_id int, page_id int, body string")).orderBy("page_id", "block_id").collect()
    assert [(r.place, r.html, r.again) for r in out[:2]] == [(1, "h", True), (0, "h", True)]
    assert [(r.place, r.html) for r in out[2:6]] == [(0, "h"), (1, "h"), (0, "h"), (1, "n")]
    assert [(r.place, r.html, r.again) for r in out[6:]] == [(0, "h", False), (1, "h", False)] * 2


def test_trees_and_lines(spark):
    schema = "doc_id int, page_id int, block_id int, block_type string, html string, x0 double, y0 double, x1 double, y1 double, parent_id int, place int"
    rows = [(1, 0, 9, "ListGroup", None, 0.0, 0.0, 2.0, 2.0, None, 0), (1, 0, 4, "ListItem", "a &lt;", 0.0, 0.0, 2.0, 1.0, 9, 1), (1, 0, 3, "ListItem", "b", 0.0, 1.0, 2.0, 2.0, 9, 2), (1, 0, 1, "Text", "t &lt;", 0.0, 3.0, 2.0, 4.0, None, 5)]
    blocks = spark.createDataFrame(rows, schema)
    chunks = render.render_chunks(blocks).orderBy("id").collect()
    assert [(c.id, c.html) for c in chunks] == [("/page/0/ListGroup/9", "a &lt;b"), ("/page/0/Text/1", "t &lt;")]
    pages = spark.createDataFrame([(1, 0, 10.0, 10.0), (1, 1, 10.0, 10.0)], "doc_id int, page_id int, width double, height double")
    tree = json.loads(render.render_json(blocks, pages).first().json)
    assert [p["id"] for p in tree["children"]] == ["/page/0", "/page/1"] and tree["children"][1]["children"] == []
    assert [[c["id"] for c in b.get("children", [])] for b in tree["children"][0]["children"]] == [["/page/0/ListItem/4", "/page/0/ListItem/3"], []]

    lines = spark.createDataFrame([(1, 0, 0, "a", 0.0, 0.0, 5.0, 5.0), (1, 0, 1, "\n", 0.0, 6.0, 0.1, 7.0), (1, 0, 2, "b", 0.0, 8.0, 5.0, 12.0), (1, 0, 3, "\n", 0.0, 9.0, 5.0, 12.0)], "doc_id int, page_id int, line_no int, text string, x0 double, y0 double, x1 double, y1 double")
    assert [(r.line_no, r.island) for r in layout.missing_blocks(lines).orderBy("line_no").collect()] == [(0, 1), (2, 2), (3, 2)]

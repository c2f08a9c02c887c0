"""Trees of blocks, markup folds, character references, files: plain cases and brute force."""

import html
import json
import pathlib
import random
import uuid

from pyspark.sql import functions as F

from foliospark.functions import text as t
from foliospark.operators import markup, render, structure, trees
from foliospark.sources import outputs

BLOCKS = "doc_id long, page_id int, block_id int, block_type string, parent_id int, html string, image string, x0 double, y0 double, x1 double, y1 double"


def ref(page, kind, block):
    return f"<content-ref src='/page/{page}/{kind}/{block}'></content-ref>"


def blocks(spark):
    group = f"<div>R &lt;{ref(0, 'Caption', 5)}&amp;&eacute;{ref(0, 'Table', 2)}&#8212;</div>"
    rows = [(1, "TableGroup", None, group, None), (2, "Table", 1, None, None), (3, "TableCell", 2, "<td>&lt;3</td>", None), (4, "TableCell", 2, "<td>4</td>", None), (5, "Caption", 1, "cap", None)]
    rows += [(6, "Text", 99, "no parent", None), (7, "Figure", 4, "fig", "IMG"), (8, "Text", 9, "round", None), (9, "Text", 8, "about", None), (10, "Text", 9, "below", None)]
    rows = [(1, 0, b, kind, parent, text, image, 0.0, float(b), 10.0, b + 1.0) for b, kind, parent, text, image in rows]
    return spark.createDataFrame([*rows, (1, 1, 1, "Text", None, None, None, 0.0, 0.0, 1.0, 1.0)], BLOCKS)


def pages(spark):
    return spark.createDataFrame([(1, 0, 600.0, 800.0), (1, 1, 600.0, 800.0), (1, 2, 600.0, 800.0)], "doc_id long, page_id int, width double, height double")


def shape(node):
    return node["id"].split("/")[-1] if not node.get("children") else {node["id"].split("/")[-1]: [shape(c) for c in node["children"]]}


def test_json_nests_to_any_depth(spark):
    tree = json.loads(render.render_json(blocks(spark), pages(spark)).first().json)
    assert [len(p["children"]) for p in tree["children"]] == [4, 1, 0]
    # a circle of parents is cut where it closes, what hangs from it stays
    assert [shape(n) for n in tree["children"][0]["children"]] == [{"1": [{"2": ["3", {"4": ["7"]}]}, "5"]}, "6", "8", {"9": ["10"]}]
    table = tree["children"][0]["children"][0]["children"][0]
    assert table["html"] == ref(0, "TableCell", 3) + ref(0, "TableCell", 4) and "images" not in table
    assert table["children"][1]["children"][0]["images"] == {"/page/0/Figure/7": "IMG"}


def test_json_of_a_long_chain_and_a_wide_page(spark):
    rows = [(1, 0, b, "Text", b - 1 if b else None, None, None, 0.0, 0.0, 1.0, 1.0) for b in range(40)] + [(1, 1, b, "TableCell", 0 if b else None, str(b), None, 0.0, 0.0, 1.0, 1.0) for b in range(300)]
    tree = json.loads(render.render_json(spark.createDataFrame(rows, BLOCKS), pages(spark)).first().json)
    node, depth = tree["children"][0], 0
    while node.get("children"):
        node, depth = node["children"][0], depth + 1
    assert depth == 40 and node["id"].endswith("/39")
    assert [c["html"] for c in tree["children"][1]["children"][0]["children"]] == [str(b) for b in range(1, 300)]


def test_references_and_images(spark):
    whole = {r.block_id: r.html for r in trees.resolve_refs(blocks(spark)).collect()}
    cells = "<td>&lt;3</td><td>4</td>"
    assert whole[2] == cells and whole[1] == f"<div>R <cap&é{cells}—</div>"
    chunks = {r.id: r for r in render.render_chunks(blocks(spark)).collect()}
    assert chunks["/page/0/TableGroup/1"].html == whole[1]
    assert chunks["/page/0/TableGroup/1"].images == {"/page/0/Figure/7": "IMG"}
    assert chunks["/page/0/Text/6"].html == "no parent" and chunks["/page/1/Text/1"].html == ""
    images = {r.block_id: r.images for r in trees.collect_images(blocks(spark)).collect()}
    assert images == {b: {"/page/0/Figure/7": "IMG"} for b in (1, 2, 4, 7)}


def test_empty_tree(spark):
    none = blocks(spark).where("false")
    assert [len(p["children"]) for p in json.loads(render.render_json(none, pages(spark)).first().json)["children"]] == [0, 0, 0]
    assert render.render_chunks(none).count() == trees.resolve_refs(none).count() == trees.collect_images(none).count() == 0


def test_character_references_as_in_the_standard_library(spark):
    texts = ["a &lt;b&gt; &amp;amp; &eacute;&#8212;&#x1F600; &nbsp;x &copy 2020 &unknown; & &; &#150; &#0; no", "plain", "&AMP;x;y;", "AT&T;", "&#xD800;&#55;7", "x&mdash;y&hellip", ""]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", t.html_unescape(F.col("x")).alias("y")).collect()
    assert [r.y for r in rows] == [html.unescape(r.x) for r in rows]


def spans(spark, text):
    rows = markup.html_to_spans(spark.createDataFrame([(1, text)], "id int, html string"), ["id"]).orderBy("seq").collect()
    return [(r.type, r.content, r.url) if r.url else (r.type, r.content) for r in rows]


def test_spans_of_nested_markup(spark):
    assert spans(spark, "<b>a<b>c</b>d</b> e") == [("bold", "acd"), ("plain", " e")]
    assert spans(spark, "x<i>open <b>to the end") == [("plain", "x"), ("italic", "open to the end")]
    assert spans(spark, "</b>a</i>") == [("plain", "a")]
    assert spans(spark, "<a href='u>v'><u><i>one</i></u></a>") == [("plain", "one", "u>v")]
    assert spans(spark, "<a href=w>x<b>y</b></a>z<!-- <b> -->") == [("plain", "z")]
    assert spans(spark, "<math>a\tb &lt; c</math><br> \n ") == [("math", "a\\tb < c"), ("plain", "\n")]
    assert spans(spark, "<I><B>x</I>y") == [("italic", "x"), ("plain", "y")]
    assert spans(spark, "<sup></sup>") == [("plain", "")] and spans(spark, "") == []


def test_tag_runs_merge_until_none_are_left(spark):
    cases = {"<b>a</b><b>b</b> <b>c</b>\n<b>d</b><b>e</b>": "<b>ab c de</b>", "<b><b>a</b></b> <b><b>b</b></b>": "<b><b>a b</b></b>", "<i>x</i></b><b><i>y</i>": "<i>x</i><i>y</i>", "none": "none", "": ""}
    cases["<b><b><b>a</b> </b></b><b> <b><b>b</b></b></b>"] = "<b><b><b>a b</b></b></b>"
    got = spark.createDataFrame([(k,) for k in cases], "h string").select("h", render.merged_tags(F.col("h")).alias("m")).collect()
    # bold goes first, so that italics that meet through it merge as well
    cases["<i>x</i></b><b><i>y</i>"] = "<i>xy</i>"
    assert {r.h: r.m for r in got} == cases


def test_nested_lists_grow(spark):
    rows = [(1, 0, 1, b, level, float(b), 10.0 * b, 50.0 + b, 10.0 * b + 5) for b, level in enumerate([0, 1, 2, 1, 0, 2])]
    got = structure.list_nest(spark.createDataFrame(rows, "doc_id long, page_id int, group_id int, block_id int, list_indent_level int, x0 double, y0 double, x1 double, y1 double")).orderBy("block_id").collect()
    assert [r.parent_id for r in got] == [None, 0, 1, 0, None, 4]
    # the first takes in its own children (1, 3), not the child of 1 by way of 1
    assert [(r.x0, r.y0, r.x1, r.y1) for r in got[:2]] == [(0.0, 0.0, 53.0, 35.0), (1.0, 10.0, 52.0, 25.0)]


def lcs(x, y):
    row = [0] * (len(y) + 1)
    for c in x:
        new = [0]
        for j, d in enumerate(y):
            new.append(max(row[j + 1], new[j], row[j] + (c == d)))
        row = new
    return row[-1]


def test_ratio_brute_force(spark):
    rnd = random.Random(1)
    text = lambda letters: "".join(rnd.choices(letters, k=rnd.choice([0, 1, 5, 61, 62, 63, 124, 130])))
    rows = [(text("abc é🙂"), text("abc é🙂x")) for _ in range(60)] + [(None, ""), ("ab", None), ("same", "same")]
    for r in spark.createDataFrame(rows, "a string, b string").select("a", "b", t.indel_ratio(F.col("a"), F.col("b")).alias("s")).collect():
        a, b = r.a or "", r.b or ""
        assert abs(r.s - (200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0)) < 1e-9


def test_one_file_a_document(spark):
    folder = f"{outputs.shared_folder(spark)}/test-{uuid.uuid4().hex}"
    docs = spark.createDataFrame([("a b", "md", "Grün ≤ 1", '{"n": [1]}', {"_page_0.jpeg": bytearray(b"\xff\xd8x")}), ("c", "html", None, None, None)], "name string, ext string, text string, metadata string, images map<string,binary>")
    for _ in range(2):  # written again, the same files stand there
        outputs.write_documents(docs.repartition(2), folder, "latin-1")
    root = pathlib.Path(folder.removeprefix("file:"))
    files = {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file()}
    assert files == {"a b/a b.md": "Grün ? 1".encode("latin-1"), "a b/a b_meta.json": b'{\n  "n": [\n    1\n  ]\n}', "a b/_page_0.jpeg": b"\xff\xd8x", "c/c.html": b"", "c/c_meta.json": b"{}"}
    listed = outputs.scan_files(spark, f"{folder}/c", head=2).orderBy("name").collect()
    assert [(r.name, r.size, r.head_hex) for r in listed] == [("c_meta.json", 2, "7B7D")]
    assert outputs.scan_files(spark, folder).count() == 0 and outputs.scan_files(spark, folder, recursive=True).count() == 3


def test_written_documents_are_read_by_their_folders(spark):
    folder = f"{outputs.shared_folder(spark)}/test-{uuid.uuid4().hex}"
    docs = spark.createDataFrame([("a b", "md", "Grün", None, {"_page_0.jpeg": bytearray(b"\xff\xd8x")}), ("c", "txt", "", '{"n": 1}', None)], "name string, ext string, text string, metadata string, images map<string,binary>")
    outputs.write_documents(docs, folder)
    pathlib.Path(folder.removeprefix("file:"), "a b", ".a b.md.1").write_bytes(b"half")
    names = docs.select("name").union(docs.select("name")).union(spark.createDataFrame([("none",)], "name string"))
    got = sorted((r.doc, r.name, bytes(r.content)) for r in outputs.read_documents(names, folder).collect())
    assert got == [("a b", "_page_0.jpeg", b"\xff\xd8x"), ("a b", "a b.md", "Grün".encode()), ("a b", "a b_meta.json", b"{}"), ("c", "c.txt", b""), ("c", "c_meta.json", b'{\n  "n": 1\n}')]


def test_no_list_of_all_written_files_is_made(spark, tmp_path):
    """Files are found by tasks: the plan of write_outputs holds no listed files."""
    from foliospark.queries import QUERIES

    from .conftest import SF

    assert "binaryFile" not in QUERIES["write_outputs"](spark, SF)._jdf.queryExecution().toString()

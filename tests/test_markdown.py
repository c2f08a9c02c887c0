"""Markdown to HTML, and spans in tables of cells."""

import pytest
from pyspark.sql import functions as F

from foliospark.functions.markdown import markdown_html
from foliospark.operators import markup, processors

CASES = {
    "# Title\ntext *it* **bo** `a<b *c*` x & y < z &amp;\nmore": "<h1>Title</h1>\n<p>text <em>it</em> <strong>bo</strong> <code>a&lt;b *c*</code> x &amp; y &lt; z &amp;\nmore</p>",
    "- a\n- b\n  - c\n  - d\n- e\n\npara": "<ul>\n<li>a</li>\n<li>b\n<ul>\n<li>c</li>\n<li>d</li>\n</ul>\n</li>\n<li>e</li>\n</ul>\n<p>para</p>",
    "| a | b |\n|---|:-:|\n| 1 | **2** |\n| 3\\|4 |\nend": "<table>\n<thead>\n<tr><th>a</th><th>b</th></tr>\n</thead>\n<tbody>\n<tr><td>1</td><td><strong>2</strong></td></tr>\n<tr><td>3|4</td></tr>\n</tbody>\n</table>\n<p>end</p>",
    "1. x\n2. y\n   z\n\n   w\n\nout": "<ol>\n<li>x</li>\n<li>y\nz\nw</li>\n</ol>\n<p>out</p>",
    "```python\nif a<b:\n  c": "<pre><code>if a&lt;b:\n  c\n</code></pre>",
    "> q\n> r\n\n---\n<table><tr>\n<td>x</td></table>\n\n![i](p.png) [l](u)": '<blockquote>\n<p>q\nr</p>\n</blockquote>\n<hr />\n<table><tr>\n<td>x</td></table>\n<p><img src="p.png" alt="i" /> <a href="u">l</a></p>',
    "a_b_c and _d_": "<p>a_b_c and <em>d</em></p>",
    "## H ##\n- a\n    1. b\n    2. c": "<h2>H</h2>\n<ul>\n<li>a\n<ol>\n<li>b</li>\n<li>c</li>\n</ol>\n</li>\n</ul>",
    " \n\n": "",
    "": "",
}


def test_markdown(spark):
    rows = spark.createDataFrame([(k,) for k in CASES], "md string").select("md", markdown_html(F.col("md")).alias("html")).collect()
    assert {r.md: r.html for r in rows} == CASES
    assert spark.createDataFrame([(None,)], "md string").select(markdown_html(F.col("md"))).first()[0] is None


@pytest.mark.parametrize("width", [4, 60])
def test_spans_hold_their_columns(spark, width):
    """Brute force over a set of places, on tables with many spans."""
    import random

    rnd = random.Random(width)
    spans = [[(rnd.choice([1, 1, 1, 2, 3]), rnd.choice([1, 1, 1, 2])) for _ in range(rnd.randint(1, width))] for _ in range(8)]
    html = "".join("<tr>" + "".join(f"<td rowspan={r} colspan={c}>x</td>" for r, c in row) + "</tr>" for row in spans)
    most, held, want = max(sum(c for _, c in row) for row in spans), set(), []
    for y, row in enumerate(spans):
        begin = 0
        for r, c in row:
            free = [k for k in range(begin, most) if (y, k) not in held]
            if free:
                x, r, c = free[0], min(r, len(spans) - y), min(c, most - free[0])
                held |= {(q, k) for q in range(y, y + r) for k in range(x, x + c)}
                want.append((y, x, r, c))
                begin = x + c
    got = markup.parse_html_table(spark.createDataFrame([(1, html)], "table_id int, html string"))
    assert sorted((r.row_id, r.col_id, r.rowspan, r.colspan) for r in got.collect()) == sorted(want)


def test_candidates(spark):
    b = spark.createDataFrame([(1, 0, 1, "Picture"), (1, 0, 2, "Form"), (1, 0, 3, "Form"), (1, 0, 4, "Text")], "doc_id long, page_id int, block_id int, block_type string")
    ids = lambda df: sorted(r.block_id for r in df.collect())
    assert ids(processors.picture_candidates(b)) == [] and ids(processors.picture_candidates(b, extract_images=False)) == [1]
    cells = spark.createDataFrame([(1, 0, 2), (1, 0, 2), (1, 0, 4)], "doc_id long, page_id int, block_id int")
    assert ids(processors.form_candidates(b, cells)) == [2]
    lines = spark.createDataFrame([(1, 0.8), (2, 0.81), (3, None)], "block_id int, confidence double")
    assert ids(processors.det_conf_filter(lines)) == [2]

"""Spans of tokens and of links: against plain Python, and how often rows move."""

import random

from foliospark.operators import markup
from foliospark.queries import QUERIES
from foliospark.sources.fixtures import fixture

from .conftest import SF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def spans_of(tokens):
    """Formats and lines as they stand at each character, one after another."""
    on, line, runs = {"bold": False, "italic": False, "math": False}, 0, []
    tags = {"b": "bold", "i": "italic", "math": "math"}
    for t in tokens:
        if t == "<br>":
            line += 1
        elif t.strip("</>") in tags and t.startswith("<") and len(t) > 1:
            on[tags[t.strip("</>")]] = not t.startswith("</")
        else:
            formats = ",".join(["plain", *(k for k in on if on[k])])
            if runs and runs[-1][:2] == [line, formats]:
                runs[-1][2] += t
            else:
                runs.append([line, formats, t])
    lines = sorted({r[0] for r in runs})
    out = []
    for n, x in enumerate(lines):
        own = [r for r in runs if r[0] == x]
        out += [(n, i, text + ("\n" if i == len(own) - 1 else ""), formats) for i, (_, formats, text) in enumerate(own)]
    return out


def test_token_spans_against_plain_python(spark):
    rnd, rows, want = random.Random(5), [], set()
    for key in range(60):
        tokens = rnd.choices(["a", "é", " ", "🙂", "<", "<b>", "</b>", "<i>", "</i>", "<math>", "</math>", "<br>"], k=rnd.choice([1, 2, 9, 40]))
        want |= {(key, *s) for s in spans_of(tokens)}
        rows += [(key, 3 * i + 7, t) for i, t in enumerate(tokens)]
    rnd.shuffle(rows)
    got = markup.char_runs_to_spans(spark.createDataFrame(rows, "key int, idx long, token string").repartition(3), ["key"]).collect()
    assert len(got) == len(want) and {(r.key, r.line, r.span, r.text, r.formats) for r in got} == want


def test_tokens_move_once(spark):
    """One exchange by key, after tokens of a key were put together; no rows of single characters are sorted for windows."""
    p = plan(QUERIES["char_runs_to_spans"](spark, SF))
    assert "Window" not in p and p.count("Exchange hashpartitioning") == 1


def test_links_move_by_line(spark):
    p = plan(QUERIES["link_reinsert"](spark, SF))
    assert p.count("Exchange hashpartitioning") == 2


def test_spans_are_cut_in_their_row(spark):
    assert "Exchange" not in plan(fixture(spark, SF, "fx_spans"))


def test_links_of_one_text(spark):
    """Of links with one text the first span gives the place and the last the url."""
    new = spark.createDataFrame([(1, 0, "x b a b")], "key int, span_id int, text string")
    old = spark.createDataFrame([(1, 0, "b", "u0"), (1, 1, "a", "u1"), (1, 2, "b", "u2"), (1, 3, "", "u3"), (1, 4, "x", None)], "key int, span_id int, text string, url string")
    got = [(r.text, r.url) for r in markup.link_reinsert(new, old, ["key"]).orderBy("seq").collect()]
    assert got == [("x ", None), ("b", "u2"), (" ", None), ("a", "u1"), (" b", None)]

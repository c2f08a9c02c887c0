"""indel_ratios against plain dynamic programming and against indel_ratio."""

import random

from pyspark.sql import functions as F

from foliospark.functions import text as t
from foliospark.queries import QUERIES

from .conftest import SF
from .test_trees import lcs


def test_ratios_brute_force(spark):
    rnd = random.Random(2)
    text = lambda letters: "".join(rnd.choices(letters, k=rnd.choice([0, 1, 5, 63, 64, 65, 128, 129, 200])))
    rows = [(text("abc é🙂"), text("abc é🙂x")) for _ in range(120)] + [(None, ""), ("ab", None), (None, None), ("same", "same"), ("ab" * 900, "ba" * 3)]
    for r in spark.createDataFrame(rows, "a string, b string").select("a", "b", t.indel_ratios(F.col("a"), F.col("b")).alias("s"), t.indel_ratio("a", "b").alias("one")).collect():
        a, b = r.a or "", r.b or ""
        assert r.s == r.one and abs(r.s - (200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0)) < 1e-9


def test_lines_are_scored_in_batches(spark):
    """The query folds no arrays for each pair."""
    p = QUERIES["indel_ratio"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in p and "aggregate(" not in p

"""Queries against their SQL on documents that are blank or end with a rule."""

import pathlib

import pytest
from pyspark.sql import functions as F

from foliospark.operators import render, responses
from foliospark.queries import ORACLES, QUERIES

from .conftest import SF
from .helpers import TABLES, same

RULE = "-" * 48
WORDS = " ".join(f"w{i}" for i in range(900))
TEXTS = ["", None, "   ", "\n", "a", f" -{RULE}", f"{WORDS} {RULE}", RULE, WORDS, "x\ty\n\nz", "\n \n"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    for t in set(TABLES) - {"documents"}:
        (folder / f"{t}.parquet").symlink_to(pathlib.Path(SF, f"{t}.parquet"))
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "length(text) AS n_chars")
    docs.toPandas().to_parquet(folder / "documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["md_document", "split_pages_md", "page_chunks", "chunk_requests", "assemble_notes", "extraction_result"])
def test_pages_of_odd_documents(spark, odd, name):
    same(QUERIES[name](spark, odd), ORACLES[name], odd)


def test_closed_pages(spark):
    blocks = spark.createDataFrame([(1, 0, 0, "a"), (1, 1, 0, " "), (2, 0, 0, "b")], "doc_id long, page_id int, block_id int, md string")
    docs = render.md_document(blocks, paginate=True)
    pages = lambda x: sorted((r.doc_id, r.page, r.md) for r in responses.split_pages_md(x).collect())
    assert pages(docs) == [(1, 0, f"a\n\n{{1}}{RULE}"), (2, 0, "b")]
    assert pages(docs.withColumn("md", render.closed_pages(F.col("md")))) == [(1, 0, "a\n\n"), (1, 1, ""), (2, 0, "b")]

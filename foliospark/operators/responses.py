"""Model requests and responses as tables: built, parsed, accepted, joined back. The call itself is a user's function."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import block_ref
from ..functions.markdown import markdown_html
from ..functions.text import detect_bad_text, strip
from .aggregates import joined

PAGE = ["doc_id", "page_id"]


# For each kind of request the placeholder in its template and the text of the block put there.
PLACES = {
    "form": ("{block_html}", "html"),
    "table": ("{block_html}", "html"),
    "complex": ("{extracted_text}", "text"),
    "image_description": ("{raw_text}", "text"),
    "equation": ("{equation}", "html or text"),
    "handwriting": (None, None),
    "math": ("{extracted_html}", "formatted"),
    "table_merge": ("{{table2}}", "html"),
}


def old_text(source: str) -> Column:
    """The text of a block that a request holds and its response is measured by."""
    if source == "html or text":
        return F.coalesce(F.nullif(F.col("html"), F.lit("")), F.col("text"), F.lit(""))
    return F.coalesce(F.col(source), F.lit(""))


def build_requests(blocks: DataFrame, kind: str, template: str) -> DataFrame:
    """One request for each block: its text in the template, at the kind's placeholder.

    blocks need the columns html, text or formatted, as the kind reads; for table_merge also before_html, the table
    that the block may continue, which goes to {{table1}}.
    """
    place, source = PLACES[kind]
    prompt = F.lit(template)
    if kind == "table_merge":
        prompt = F.replace(prompt, F.lit("{{table1}}"), F.coalesce("before_html", F.lit("")))
    if place:
        prompt = F.replace(prompt, F.lit(place), old_text(source))
    req = F.concat_ws("/", F.lit(kind), "doc_id", "page_id", "block_id")
    return blocks.select(req.alias("req_id"), F.lit(kind).alias("processor"), *PAGE, "block_id", prompt.alias("prompt"))


def thousandths(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """blocks with `id` and `bbox`, the box in thousandths of its page."""
    x = blocks.join(pages.select(*PAGE, "width", "height"), PAGE)
    part = lambda c, size: F.col(c) / F.col(size) * 1000
    box = F.array(part("x0", "width"), part("y0", "height"), part("x1", "width"), part("y1", "height"))
    return x.select(*PAGE, "block_id", "block_type", "html", block_ref(F.col("page_id"), F.col("block_type"), F.col("block_id")).alias("id"), box.alias("bbox"))


def header_requests(headers: DataFrame, pages: DataFrame, template: str = "{{section_header_json}}") -> DataFrame:
    """One request a document: its headings as JSON, with box, width and height in thousandths of the page."""
    b = F.col("bbox")
    row = F.struct("page_id", "block_id", F.struct("id", "bbox", "html", F.col("page_id").cast("string").alias("page"), (b[2] - b[0]).alias("width"), (b[3] - b[1]).alias("height")).alias("row"))
    rows = F.transform(F.array_sort(F.collect_list(row)), lambda r: r["row"])
    return thousandths(headers, pages).groupBy("doc_id").agg(F.replace(F.lit(template), F.lit("{{section_header_json}}"), F.to_json(rows)).alias("prompt"))


def page_requests(blocks: DataFrame, pages: DataFrame, user_prompt: str, template: str = "{{page_json}}\n{{user_prompt}}", tags: list[str] | None = None) -> DataFrame:
    """One request a page: all its blocks as JSON, the tags allowed and the user's own words put into the template."""
    row = F.struct("block_id", F.struct("id", "block_type", "bbox", "html").alias("row"))
    rows = F.transform(F.array_sort(F.collect_list(row)), lambda r: r["row"])
    prompt = F.replace(F.lit(template), F.lit("{{page_json}}"), F.to_json(rows))
    prompt = F.replace(prompt, F.lit("{{format_tags}}"), F.lit(json.dumps(tags or [])))
    prompt = F.replace(prompt, F.lit("{{user_prompt}}"), F.lit(user_prompt))
    return thousandths(blocks, pages).groupBy(*PAGE).agg(prompt.alias("prompt"))


def response_json(body: Column, schema: str) -> Column:
    """The struct in a body: as it is, else without a code fence, else with doubled backslashes; null where none parses."""
    bare = F.regexp_replace(F.regexp_replace(strip(body), r"^```json\s*", ""), r"\s*```$", "")
    doubled = F.replace(bare, F.lit("\\"), F.lit("\\\\"))
    parsed = lambda c: F.when(F.get_json_object(c, "$").isNotNull(), F.from_json(c, schema))
    return F.coalesce(parsed(body), parsed(bare), parsed(doubled))


# Per kind the phrase that leaves a block as it is, the least share of the old text's length, and the
# language of a fence around the answer.
ACCEPT = {
    "form": ("no corrections needed", 0.33, "html"),
    "math": ("no corrections needed", 0.6, None),
    "complex": ("no corrections", 0.5, "markdown"),
    "handwriting": (None, 0.5, "markdown"),
    "equation": ("no corrections needed", 0.3, None),
    "image_description": (None, 0.0, None),
}
LEAST_DESCRIPTION = 10


def accept_html(blocks: DataFrame, responses: DataFrame, kind: str) -> DataFrame:
    """blocks and responses(doc_id, page_id, block_id, corrected) of one kind: (.., html, description, errors).

    A missing answer and one that is too short count as an error and leave the block as it is; so does an equation
    that is empty, not longer than the share or without equally many opened and closed formulas. An answer that says
    that nothing needs a correction leaves it without an error. Descriptions go to their own column; answers in
    Markdown (complex, handwriting) become HTML.
    """
    keep_phrase, least, fence = ACCEPT[kind]
    source = {"image_description": "text", "handwriting": "text"}.get(kind) or PLACES[kind][1]
    new, size = F.col("corrected"), F.length(old_text(source))
    keep = F.contains(F.lower(new), F.lit(keep_phrase)) if keep_phrase else F.lit(False)
    if kind == "equation":
        balanced = F.regexp_count(new, F.lit("<math")) == F.regexp_count(new, F.lit("</math>"))
        bad = ~((F.length(new) > 0) & balanced & (F.length(new) > least * size))
    elif kind == "image_description":
        bad = F.length(new) < LEAST_DESCRIPTION
    else:
        bad = F.length(new) < least * size
        bad = bad | (F.length(new) == 0) if kind == "math" else bad
    failed = new.isNull() | (~keep & bad)
    text = new
    if fence:
        text = strip(F.regexp_replace(F.regexp_replace(strip(new), rf"^```({fence})?", ""), r"`+$", ""))
        text = markdown_html(text) if fence == "markdown" else text
    good = ~failed & ~keep
    describes = kind == "image_description"
    html = F.col("html") if describes else F.when(good, text).otherwise(F.col("html"))
    description = F.when(good, text) if describes else F.lit(None).cast("string")
    x = blocks.join(responses.select(*PAGE, "block_id", "corrected"), [*PAGE, "block_id"], "left")
    return x.select(*PAGE, "block_id", html.alias("html"), description.alias("description"), failed.cast("int").alias("errors"))


def accept_headers(blocks: DataFrame, responses: DataFrame) -> DataFrame:
    """responses(doc_id, body) with a list of {id, html}: rewrites by block reference, unknown ids skipped."""
    schema = "struct<correction_type:string,blocks:array<struct<id:string,html:string>>>"
    r = responses.select("doc_id", response_json(F.col("body"), schema).alias("r")).where("r.correction_type <> 'no_corrections'").select("doc_id", F.explode("r.blocks").alias("b"))
    part = lambda i: F.get(F.split("b.id", "/"), F.lit(i))
    r = r.select("doc_id", part(2).cast("int").alias("page_id"), part(4).cast("int").alias("block_id"), F.col("b.html").alias("new_html"))
    return blocks.join(r, [*PAGE, "block_id"], "left").select(*PAGE, "block_id", F.coalesce("new_html", "html").alias("html"))


def apply_rewrites(blocks: DataFrame, rewrites: DataFrame) -> DataFrame:
    """rewrites(doc_id, ref, html) set the html of known blocks."""
    part = lambda i: F.get(F.split("ref", "/"), F.lit(i))
    r = rewrites.select("doc_id", part(2).cast("int").alias("page_id"), part(4).cast("int").alias("block_id"), F.col("html").alias("new_html"))
    return blocks.join(r, [*PAGE, "block_id"], "left").select(*PAGE, "block_id", F.coalesce("new_html", "html").alias("html"))


def accept_page(blocks: DataFrame, responses: DataFrame) -> DataFrame:
    """blocks(.., block_type, html) and responses(doc_id, page_id, body): (.., place, html, again).

    By the answer's correction_type: `no_corrections` and unknown ones leave the page as it is; `reorder` and
    `reorder_first` put its blocks in the order of ids page/Type/block if these are the page's own, all of them;
    reorder_first asks for the page again; `rewrite` sets the html of known blocks of ids /page/page/Type/block.
    `blocks` in an answer is a list or a text that holds one; an id that stands twice counts where it stands first.
    """
    item = "array<struct<id:string,html:string>>"
    r = response_json(F.col("body"), "struct<correction_type:string,blocks:string>")
    r = responses.select(*PAGE, r.alias("r")).select(*PAGE, F.col("r.correction_type").alias("kind"), F.from_json("r.blocks", item).alias("answer"))
    own = blocks.groupBy(*PAGE).agg(F.array_sort(F.collect_set(F.concat_ws("/", "page_id", "block_type", "block_id"))).alias("own"))
    known = F.filter(F.transform("answer", lambda a: a.id), lambda i: F.regexp_like(i, F.lit(r"^[^/]*/[^/]*/[^/]*$")))
    r = r.join(own, PAGE).withColumn("ids", F.array_distinct(known))
    orders = F.col("kind").isin("reorder", "reorder_first")
    r = r.select(*PAGE, "kind", F.when(orders & (F.array_sort("ids") == F.col("own")), F.col("ids")).alias("ids"), F.when(F.col("kind") == "rewrite", F.col("answer")).alias("answer"))
    x = blocks.join(r, PAGE, "left")
    mine = F.concat_ws("/", "page_id", "block_type", "block_id")
    written = F.filter("answer", lambda a: F.regexp_replace(strip(a.id), "^/+", "") == F.concat(F.lit("page/"), mine))
    html = F.coalesce(F.get(F.reverse(written), F.lit(0))["html"], F.col("html"))
    place = F.coalesce(F.array_position("ids", mine).cast("int") - 1, F.col("block_id"))
    return x.select(*PAGE, "block_id", place.alias("place"), html.alias("html"), F.coalesce(F.col("kind") == "reorder_first", F.lit(False)).alias("again"))


def split_pages_md(docs: DataFrame) -> DataFrame:
    """(doc_id, page, md) of paginated Markdown."""
    parts = F.split("md", r"\{\d+\}-{48}\n\n")
    return docs.select("doc_id", F.posexplode(F.slice(parts, 2, F.greatest(F.lit(1), F.size(parts) - 1))).alias("page", "md"))


def page_chunks(pages: DataFrame, size: int = 3) -> DataFrame:
    x = pages.withColumn("chunk", F.floor(F.col("page") / size).cast("int"))
    return x.groupBy("doc_id", "chunk").agg(joined(F.col("md"), "\n\n", "page").alias("md"))


def chunk_requests(chunks: DataFrame, schema: str, template: str = "{page_md}\n{schema}") -> DataFrame:
    if not schema.strip():
        raise ValueError("a page schema is needed")
    return chunks.select("doc_id", "chunk", F.replace(F.replace(F.lit(template), F.lit("{page_md}"), F.col("md")), F.lit("{schema}"), F.lit(schema)).alias("prompt"))


def assemble_notes(notes: DataFrame) -> DataFrame:
    """notes(doc_id, chunk, detailed_notes) of each document under 'Page i' headings."""
    one = F.concat(F.lit("Page "), (F.col("chunk") + 1).cast("string"), F.lit("\n"), "detailed_notes", F.lit("\n\n"))
    return notes.groupBy("doc_id").agg(strip(joined(one, "", "chunk")).alias("notes"))


def extraction_result(responses: DataFrame, md: DataFrame) -> DataFrame:
    """analysis and document_json of each response beside the Markdown; null unless both keys are there."""
    r = response_json(F.col("body"), "struct<analysis:string,document_json:string>")
    x = md.join(responses.select("doc_id", r.alias("r")), "doc_id", "left")
    ok = F.col("r.analysis").isNotNull() & F.col("r.document_json").isNotNull()
    fence = F.regexp_replace(F.regexp_replace(F.col("r.document_json"), r"^```json\s*", ""), r"\s*```$", "")
    return x.select("doc_id", F.when(ok, F.col("r.analysis")).alias("analysis"), F.when(ok, fence).alias("document_json"), "md")


def call_service(requests: DataFrame, fn: Callable[[str], dict], retries: int = 2, wait: float = 3.0, concurrency: int = 3) -> DataFrame:
    """(req_id, body, tokens): the user's function on each prompt, `concurrency` tasks at once.

    A function that raises ConnectionError (a rate limit) is tried again after wait, 2 * wait ...; any other error,
    or too many tries, gives {} and no tokens. The function loads what it needs once per task.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for req, prompt in zip(b["req_id"], b["prompt"], strict=True):
                answer: dict = {}
                for attempt in range(retries + 1):
                    try:
                        answer = fn(prompt)
                        break
                    except ConnectionError:
                        if attempt < retries:
                            time.sleep(wait * (attempt + 1))
                    except Exception:
                        break
                rows.append((req, json.dumps(answer), int(answer.get("tokens", 0)) if answer else 0))
            yield pd.DataFrame(rows, columns=["req_id", "body", "tokens"])

    return requests.select("req_id", "prompt").repartition(concurrency).mapInPandas(run, "req_id string, body string, tokens long")


def predict_pages(pages: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, batch_size: int | None = None) -> DataFrame:
    """A batched model slot: the user's function on at most batch_size pages at once; without it on whole Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            step = batch_size or max(1, len(b))
            for at in range(0, len(b), step):
                yield fn(b.iloc[at : at + step])

    return pages.mapInPandas(run, schema)


def text_error_labels(texts: DataFrame, text: str = "text", fn: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """Adds label, good or bad. fn is the user's model, on Arrow batches of texts; without it the rule of detect_bad_text."""
    label = F.when(detect_bad_text(F.col(text)), "bad").otherwise("good") if fn is None else F.pandas_udf(fn, "string")(F.col(text))
    return texts.withColumn("label", label)

"""Layout tables derived from the given parquet tables, the same rows in Spark SQL and in ANSI SQL.

A fixture is a common table expression; `chain` puts those that are needed in order. `{words}` and `{agg}`
differ by dialect only in the name of the function.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from .outputs import shared_folder

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def agg(dialect: str, expr: str, sep: str, order: str) -> str:
    """Ordered concatenation."""
    return f"listagg({expr}, {sep}) WITHIN GROUP (ORDER BY {order})" if dialect == "spark" else f"string_agg({expr}, {sep} ORDER BY {order})"


def words(dialect: str) -> str:
    if dialect == "spark":
        return "SELECT doc_id, source, pos, word FROM documents LATERAL VIEW posexplode(split(trim(text), '\\\\s+')) t AS pos, word"
    return "SELECT doc_id, source, unnest(string_split_regex(trim(text), '\\s+')) AS word, generate_subscripts(string_split_regex(trim(text), '\\s+'), 1) - 1 AS pos FROM documents"


def lines_of_words(dialect: str) -> str:
    """Ten words a line. Spark cuts a text within its row, without moving words about; an outer view adds no filter below it."""
    if dialect == "spark":
        cut = "transform(sequence(0, cast(ceil(size(ws)/10) AS int)-1), i -> array_join(slice(ws, i*10+1, 10), ' '))"
        return f"SELECT doc_id, source, cast(line_no AS int) AS line_no, line AS text FROM (SELECT doc_id, source, split(trim(text), '\\\\s+') AS ws FROM documents) d LATERAL VIEW OUTER posexplode({cut}) t AS line_no, line WHERE line_no IS NOT NULL"
    return f"SELECT doc_id, max(source) AS source, cast(floor(pos/10) AS int) AS line_no, {agg(dialect, 'word', chr(39) + ' ' + chr(39), 'pos')} AS text FROM w GROUP BY doc_id, cast(floor(pos/10) AS int)"


def spans_of_words(dialect: str) -> str:
    """Three words a span, the fourth span of a line has its last word. Spark cuts lines within their text's row, as in lines_of_words."""
    if dialect == "spark":
        first, last = "div(k, 4)*10+(k%4)*3+1", "least(if(k%4=3, 1, 3), size(ws)-(div(k, 4)*10+(k%4)*3))"
        first, last = (x.replace("div(k, 4)", "(k div 4)") for x in (first, last))
        line = "(size(ws)-1) div 10"
        k = f"filter(sequence(0, cast({line} AS int)*4+3), k -> {first} <= size(ws))"
        cut = f"transform({k}, k -> struct(k div 4 AS line_no, k%4 AS span_id, array_join(slice(ws, cast({first} AS int), cast({last} AS int)), ' ') AS text))"
        return f"""SELECT doc_id, cast(floor(s.line_no/40) AS int) AS page_id, cast(floor((s.line_no%40)/4) AS int) AS block_no, cast(s.line_no AS int) AS line_no, cast(s.span_id AS int) AS span_id, s.text AS text
            FROM (SELECT doc_id, split(trim(text), '\\\\s+') AS ws FROM documents) d LATERAL VIEW OUTER explode({cut}) t AS s WHERE s IS NOT NULL"""
    return f"""SELECT w.doc_id, cast(floor(floor(pos/10)/40) AS int) AS page_id, cast(floor((floor(pos/10)%40)/4) AS int) AS block_no, cast(floor(pos/10) AS int) AS line_no, cast(floor((pos%10)/3) AS int) AS span_id, {agg(dialect, 'word', chr(39) + ' ' + chr(39), 'pos')} AS text
                  FROM w GROUP BY w.doc_id, floor(pos/10), floor((pos%10)/3)"""


def numbered_items(dialect: str) -> str:
    """Items by order. Spark partitions by the name that later steps group by, so that rows move once."""
    if dialect == "spark":
        return """SELECT table_id, row_number() OVER (PARTITION BY table_id ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS row_id, l_quantity, l_extendedprice, l_returnflag, l_linestatus
            FROM (SELECT l_orderkey AS table_id, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus FROM lineitem) i"""
    return """SELECT l_orderkey AS table_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS row_id, l_quantity, l_extendedprice, l_returnflag, l_linestatus FROM lineitem"""


def cells_of_items(dialect: str) -> str:
    """Four cells an item. Spark makes them of each row; the rows are numbered once and stay where their table is."""
    if dialect == "spark":
        cells = "concat(cast(cast(l_quantity AS int) AS varchar(20)), e), concat('$', e), concat(cast(cast(floor(l_extendedprice) AS bigint) AS varchar(20)), e), concat(l_returnflag, e)"
        return f"SELECT table_id, row_id, col_id, text FROM (SELECT *, CASE WHEN table_id%3=0 THEN concat('<br>', l_linestatus) ELSE '' END AS e FROM fx_cells0) c LATERAL VIEW posexplode(array({cells})) x AS col_id, text"
    return """SELECT table_id, row_id, 0 AS col_id, concat(cast(cast(l_quantity AS int) AS varchar(20)), CASE WHEN table_id%3=0 THEN concat('<br>', l_linestatus) ELSE '' END) AS text FROM fx_cells0
            UNION ALL SELECT table_id, row_id, 1, concat('$', CASE WHEN table_id%3=0 THEN concat('<br>', l_linestatus) ELSE '' END) FROM fx_cells0
            UNION ALL SELECT table_id, row_id, 2, concat(cast(cast(floor(l_extendedprice) AS bigint) AS varchar(20)), CASE WHEN table_id%3=0 THEN concat('<br>', l_linestatus) ELSE '' END) FROM fx_cells0
            UNION ALL SELECT table_id, row_id, 3, concat(l_returnflag, CASE WHEN table_id%3=0 THEN concat('<br>', l_linestatus) ELSE '' END) FROM fx_cells0"""


def fixtures(dialect: str) -> dict[str, str]:
    a = lambda *x: agg(dialect, *x)
    modulo = "%"
    return {
        "w": words(dialect),
        "l0": lines_of_words(dialect),
        "ln": f"SELECT doc_id, source, line_no, cast(floor(line_no/40) AS int) AS page_id, line_no{modulo}40 AS rw, cast(floor((line_no{modulo}40)/4) AS int) AS block_no, text FROM l0",
        "ty": """SELECT *, CASE WHEN block_no=0 AND (doc_id+page_id)%3=0 THEN 'SectionHeader' WHEN block_no=9 AND (doc_id+page_id)%4=0 THEN 'Footnote'
            WHEN block_no IN (4,5,6) AND (doc_id+page_id)%5=0 THEN 'ListItem' WHEN block_no=7 AND (doc_id+page_id)%6=1 THEN 'Table'
            WHEN block_no=8 AND (doc_id+page_id)%6=1 THEN 'Caption' WHEN block_no=3 AND (doc_id+page_id)%7=2 THEN 'Code'
            WHEN block_no=2 AND (doc_id+page_id)%11=3 THEN 'Equation' ELSE 'Text' END AS block_type FROM ln""",
        "fx_g": """SELECT doc_id, source, page_id, block_no, line_no, block_type, text,
            cast(72 + CASE WHEN block_type='ListItem' THEN 18*(block_no-4) ELSE 0 END + CASE WHEN doc_id%2=1 AND block_no>=5 THEN 250 ELSE 0 END AS double) AS x0,
            cast(40 + CASE WHEN doc_id%2=1 THEN rw%20 ELSE rw END * 18 AS double) AS y0 FROM ty""",
        "fx_lines": "SELECT doc_id, source, page_id, block_no, line_no, block_type, x0, y0, least(cast(540 AS double), x0+cast(5 AS double)*length(text)) AS x1, y0+cast(12 AS double) AS y1, text FROM fx_g",
        "fx_boxes": """SELECT doc_id, page_id, block_no AS block_id, max(block_type) AS block_type, block_no AS position, min(x0) AS x0, min(y0)+2 AS y0, max(x1) AS x1, max(y1)-2 AS y1
            FROM fx_lines GROUP BY doc_id, page_id, block_no HAVING NOT (block_no=6 AND (doc_id+page_id)%8=0)""",
        "fx_pages": """SELECT DISTINCT doc_id, page_id, cast(612 AS double) AS width, cast(792 AS double) AS height, (doc_id+page_id)%4=1 AS layout_sliced, (doc_id+page_id)%13=0 AS ocr_errors_detected,
            CASE WHEN (doc_id+page_id)%9=4 THEN 'ocr' ELSE 'embedded' END AS method FROM fx_lines""",
        "fx_btext": f"""SELECT doc_id, page_id, block_no AS block_id, max(block_type) AS block_type, max(source) AS source, {a('text', 'chr(10)', 'line_no')} AS text, count(*) AS n_lines,
            min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM fx_lines GROUP BY doc_id, page_id, block_no""",
        # Blocks inside blocks, four deep: a list whose items hold the next item, a table with cells and its caption in a
        # group with markup of its own (the caption first, which may be missing), a figure in a group.
        "fx_tree0": """SELECT *, max(block_id) OVER (PARTITION BY doc_id, page_id) AS last_id, max(CASE WHEN block_type='SectionHeader' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_id) AS headed,
            concat('/page/', cast(page_id AS varchar(12)), '/') AS page_ref, chr(39) AS q FROM fx_btext""",
        "fx_tree1": """SELECT doc_id, page_id, block_id, CASE WHEN block_id=2 THEN 'Figure' ELSE block_type END AS block_type,
            CASE WHEN block_type='ListItem' AND block_id<6 AND block_id<last_id THEN concat('<li>', replace(text, chr(10), ' '), '<content-ref src=', q, page_ref, 'ListItem/', cast(block_id+1 AS varchar(12)), q, '></content-ref></li>')
                WHEN block_type='Table' THEN NULL ELSE concat('<p>', replace(text, chr(10), ' '), '</p>') END AS html,
            x0, y0, x1, y1, block_id AS place, CASE WHEN block_type='ListItem' THEN CASE WHEN block_id=4 THEN 100 ELSE block_id-1 END WHEN block_type IN ('Table','Caption') THEN 101 WHEN block_id=2 THEN 102 END AS parent_id,
            CASE WHEN block_id=2 THEN 'QQ==' END AS image, headed=1 AND block_id>0 AS below, page_ref, q, text FROM fx_tree0""",
        "fx_tree": """SELECT doc_id, page_id, block_id, block_type, html, x0, y0, x1, y1, place, parent_id, image, below, page_ref FROM fx_tree1
            UNION ALL SELECT doc_id, page_id, 100, 'ListGroup', NULL, min(x0), min(y0), max(x1), max(y1), min(place), NULL, NULL, FALSE, max(page_ref) FROM fx_tree1 WHERE block_type='ListItem' GROUP BY doc_id, page_id
            UNION ALL SELECT doc_id, page_id, 101, 'TableGroup', concat('<div>&eacute;<content-ref src=', max(q), max(page_ref), 'Caption/8', max(q), '></content-ref>&amp;&#8212;<content-ref src=', max(q), max(page_ref), 'Table/7', max(q), '></content-ref></div>'),
                min(x0), min(y0), max(x1), max(y1), min(place), NULL, NULL, FALSE, max(page_ref) FROM fx_tree1 WHERE block_type IN ('Table','Caption') GROUP BY doc_id, page_id
            UNION ALL SELECT doc_id, page_id, 102, 'FigureGroup', NULL, x0, y0, x1, y1, place, NULL, NULL, FALSE, page_ref FROM fx_tree1 WHERE block_id=2
            UNION ALL SELECT doc_id, page_id, 110+c, 'TableCell', concat('<td>', cast(c AS varchar(2)), ' &lt; ', substring(text, 1, 5), '</td>'), x0, y0, x1, y1, 1-c, 7, NULL, FALSE, page_ref
                FROM fx_tree1, (SELECT 0 AS c UNION ALL SELECT 1) k WHERE block_type='Table'""",
        "fx_running": """SELECT *, CASE WHEN block_id = first_id AND doc_id%3=0 THEN concat(source, ' report ', cast(page_id AS varchar(12))) WHEN block_id = last_id THEN cast(page_id AS varchar(12)) ELSE text END AS rtext
            FROM (SELECT *, min(block_id) OVER (PARTITION BY doc_id, page_id) AS first_id, max(block_id) OVER (PARTITION BY doc_id, page_id) AS last_id FROM fx_btext) t""",
        "fx_spans": f"""SELECT doc_id, page_id, block_no, line_no, span_id, text, span_id AS seq, CASE (length(text))%8 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 64 WHEN 3 THEN 262144 WHEN 4 THEN 66 WHEN 5 THEN 4 WHEN 6 THEN 32 ELSE 524288 END AS flags,
            CASE span_id%3 WHEN 0 THEN 'Times-Bold' WHEN 1 THEN 'Times-Ital' ELSE 'Times-Roman' END AS font,
            CASE WHEN (line_no*4+span_id)%17=0 THEN concat('http://x.example/(', cast(line_no AS varchar(12)), ')') END AS url, (line_no*4+span_id)%23=0 AS has_superscript, line_no*40+span_id*10 AS minimum_position, line_no*40+span_id*10+9 AS maximum_position
            FROM ({spans_of_words(dialect)}) t""",
        "fx_cells0": numbered_items(dialect),
        "fx_cells": f"""SELECT table_id, cast(row_id AS bigint) AS row_id, col_id, row_id*4+col_id AS cell_id, 1 AS rowspan, 1 AS colspan, row_id=0 AS is_header, text, cast(72+80*col_id AS double) AS x0, cast(60+20*row_id AS double) AS y0, cast(148+80*col_id AS double) AS x1, cast(78+20*row_id AS double) AS y1
            FROM ({cells_of_items(dialect)}) t""",
        "fx_arrivals": """SELECT event_id AS file_id, ts AS arrived_at, concat('f', cast(user_id AS varchar(20)), CASE event_type WHEN 'view' THEN '.PDF' WHEN 'click' THEN '.png' WHEN 'purchase' THEN '.pdf' WHEN 'signup' THEN '.docx' ELSE '.jpeg' END) AS name,
            cast(floor(value*1000000) AS bigint) AS size, event_type <> 'error' AS success, value AS processing_time,
            CASE WHEN event_id%41=0 THEN NULL WHEN event_id%37=0 THEN '504B0304' WHEN event_type IN ('view','purchase') THEN '255044462D' WHEN event_type='click' THEN '89504E470D0A1A0A' WHEN event_type='signup' THEN '504B0304' ELSE 'FFD8FF' END AS head_hex FROM events""",
        "fx_outputs": "SELECT concat('f', cast(file_id AS varchar(20))) AS base, CASE file_id%4 WHEN 0 THEN 'md' WHEN 1 THEN 'html' WHEN 2 THEN 'json' ELSE 'txt' END AS ext FROM fx_arrivals",
        "fx_notes": """SELECT c_custkey AS file_id, ord, CASE ord WHEN 0 THEN concat('Drawing NO ', c_name) WHEN 1 THEN 'Notes:' WHEN 2 THEN '2. Surface hardness HV 550' WHEN 3 THEN '1) Material: steel'
            WHEN 4 THEN '1/4: C10B21 grade' WHEN 5 THEN '(材質: 鋼)' WHEN 6 THEN '12.5 3.2' WHEN 7 THEN 'Thread rolled after plating' WHEN 8 THEN concat('Core hardness per ', c_name)
            WHEN 9 THEN concat('remark ', c_mktsegment) WHEN 10 THEN '--' WHEN 11 THEN '2. surface  HARDNESS hv 550' WHEN 12 THEN '  general   notes :  see sheet ' WHEN 13 THEN 'torsional'
            WHEN 14 THEN '（表面硬度 與 其他）' WHEN 15 THEN '12/3: odd numerator' WHEN 16 THEN '(氫脆)' WHEN 17 THEN '#5 / 16 : M8 test' WHEN 18 THEN 'Eht 400 HV0.3' WHEN 19 THEN '10 Hydrogen embrittlement'
            WHEN 20 THEN '(no item 螺紋)' ELSE '芯部硬度 alone' END AS text
            FROM customer, (SELECT cast(n_nationkey AS int) AS ord FROM nation WHERE n_nationkey < 22) o
            WHERE (c_custkey+ord)%5<>0""",
    }


def chain(dialect: str, *names: str) -> str:
    """WITH clause of the named fixtures and all they need."""
    all_ = fixtures(dialect)
    need, todo = set(), list(names)
    while todo:
        if (n := todo.pop()) not in need:
            need.add(n)
            todo += [k for k in all_ if k != n and re.search(rf"\b{k}\b", all_[n])]
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in all_.items() if k in need)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = chain("spark", name) + f" SELECT * FROM {name}"
    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    for t in used:
        sql = re.sub(rf"(FROM|,) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def on_written(spark: SparkSession, sf_dir: str, base: str, *names: str) -> list[DataFrame]:
    """base, made once and written to the shared folder, and fixtures that are made from it alone."""
    path = f"{shared_folder(spark)}/{base}-{uuid.uuid4().hex}"
    fixture(spark, sf_dir, base).write.parquet(path)
    first = spark.read.parquet(path)
    return [first, *(spark.sql(re.sub(rf"\b{base}\b", f"{{{base}}}", fixtures("spark")[name]), **{base: first}) for name in names)]


def oracle(names: str, sql: str) -> str:
    """Oracle text: fixtures, then the rule; sql may start with further table expressions and a comma."""
    head = chain("duckdb", *names.split())
    if re.search(r"\bJOIN walk\b", sql):
        head = head.replace("WITH ", "WITH RECURSIVE ", 1)
    return f"{head} {sql}" if not sql.lstrip().startswith(",") else f"{head}{sql}"

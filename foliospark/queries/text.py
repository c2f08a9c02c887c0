"""Text predicates and scalar markup functions over block texts, spans and cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..sources.fixtures import fixture, oracle
from .registry import query

KEY = ["doc_id", "page_id", "block_id"]
SP = r"[\s\x{A0}\x{2000}-\x{200A}\x{3000}]"
TRIM = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _block_query(name, make, sql, fx="fx_btext"):
    @query(name, oracle(fx, f"SELECT doc_id, page_id, block_id, {sql} FROM {fx}"))
    def run(spark, d):
        return fixture(spark, d, fx).select(*KEY, *make(F.col("text")))


_block_query("normalize_spaces", lambda x: [t.normalize_spaces(F.replace(x, F.lit(" t"), F.lit(" t"))).alias("text")], "replace(replace(text, ' t', chr(160)||'t'), chr(160), ' ') AS text")
_block_query("alphanum_ratio", lambda x: [F.round(t.alphanum_ratio(x), 6).alias("ratio")], r"round(CASE WHEN length(replace(replace(text,' ',''),chr(10),''))=0 THEN 1 ELSE len(regexp_extract_all(text,'[\p{L}\p{N}]'))/length(replace(replace(text,' ',''),chr(10),'')) END,6) AS ratio")
BAD = r"""(length(x)=0 OR (len(regexp_extract_all(x,'\s+'))/greatest(1,len(regexp_extract_all(x,'\s+'))+len(regexp_extract_all(x,'\S')))>0.7) OR (len(regexp_extract_all(x,'\n+'))/greatest(1,len(regexp_extract_all(x,'\n+'))+len(regexp_extract_all(x,'[^\n]')))>0.6)
 OR (length(replace(replace(x,' ',''),chr(10),''))>0 AND len(regexp_extract_all(x,'[\p{L}\p{N}]'))/greatest(1,length(replace(replace(x,' ',''),chr(10),'')))<0.3) OR length(x)-length(replace(x,chr(65533),''))>greatest(6,0.03*length(x)))"""


def _spoiled(x):
    """Block texts, some of them spoiled: odd characters, nothing, marks only."""
    return F.when(F.col("block_id") == 2, F.concat(F.repeat(F.lit("�"), 7), x)).when(F.col("block_id") == 3, F.lit("")).when(F.col("block_id") == 4, F.regexp_replace(x, "[a-z]", "*")).otherwise(x)


@query("detect_bad_text", oracle("fx_btext", ", s AS (SELECT doc_id, page_id, block_id, CASE block_id WHEN 2 THEN repeat(chr(65533),7)||text WHEN 3 THEN '' WHEN 4 THEN regexp_replace(text,'[a-z]','*','g') ELSE text END AS x FROM fx_btext) SELECT doc_id, page_id, block_id, " + BAD + " AS bad FROM s"))
def detect_bad_text(spark, d):
    return fixture(spark, d, "fx_btext").select(*KEY, t.detect_bad_text(_spoiled(F.col("text"))).alias("bad"))


@query("page_text_check", oracle("fx_lines", ", pt AS (SELECT doc_id, page_id, string_agg(' ' || text || chr(10), '' ORDER BY line_no) AS x FROM fx_lines GROUP BY ALL) SELECT doc_id, page_id, trim(x)='' OR " + BAD + " AS bad FROM pt"))
def page_text_check(spark, d):
    """Per page, its spans joined in order, judged as one text."""
    from ..operators.aggregates import joined

    pages = fixture(spark, d, "fx_lines").groupBy("doc_id", "page_id").agg(joined(F.concat(F.lit(" "), "text", F.lit("\n")), "", "line_no").alias("x"))
    return pages.select("doc_id", "page_id", ((t.strip(F.col("x")) == "") | t.detect_bad_text(F.col("x"))).alias("bad"))


@query("page_text", oracle("fx_spans", ", l AS (SELECT doc_id, page_id, line_no, string_agg(text,' ' ORDER BY span_id) AS text FROM fx_spans GROUP BY ALL) SELECT doc_id, page_id, string_agg(text, chr(10) ORDER BY line_no) AS text FROM l GROUP BY ALL"))
def page_text(spark, d):
    """Spans joined by a space, lines by a newline."""
    from ..operators.aggregates import joined

    lines = fixture(spark, d, "fx_spans").groupBy("doc_id", "page_id", "line_no").agg(joined(F.col("text"), " ", "span_id").alias("text"))
    return lines.groupBy("doc_id", "page_id").agg(joined(F.col("text"), "\n", "line_no").alias("text"))


FLAGS = "list_filter([CASE WHEN flags&1>0 THEN 'FixedPitch' END, CASE WHEN flags&2>0 THEN 'Serif' END, CASE WHEN flags&4>0 THEN 'Symbolic' END, CASE WHEN flags&8>0 THEN 'Script' END, CASE WHEN flags&32>0 THEN 'Nonsymbolic' END, CASE WHEN flags&64>0 THEN 'Italic' END, CASE WHEN flags&65536>0 THEN 'AllCap' END, CASE WHEN flags&131072>0 THEN 'SmallCap' END, CASE WHEN flags&262144>0 THEN 'ForceBold' END, CASE WHEN flags&524288>0 THEN 'UseExternAttr' END], lambda x: x IS NOT NULL)"
FORMATS = f"CASE WHEN len({FLAGS})=0 OR {FLAGS} IN (['Symbolic','Italic'],['Symbolic','Italic','UseExternAttr'],['UseExternAttr']) THEN ['plain'] ELSE list_filter([CASE WHEN list_contains({FLAGS},'Italic') THEN 'italic' END, CASE WHEN list_contains({FLAGS},'ForceBold') THEN 'bold' END, CASE WHEN list_has_any({FLAGS},['FixedPitch','Serif','Script','Nonsymbolic','AllCap','SmallCap','UseExternAttr']) THEN 'plain' END], lambda x: x IS NOT NULL) END"
SPAN = ["doc_id", "line_no", "span_id"]


def _span_query(name, make, sql):
    @query(name, oracle("fx_spans", f"SELECT doc_id, line_no, span_id, {sql} FROM fx_spans"))
    def run(spark, d):
        return fixture(spark, d, "fx_spans").select(*SPAN, *make())


_span_query("font_flag_formats", lambda: [F.array_join(t.font_flag_formats(F.col("flags")), ",").alias("formats")], f"array_to_string({FORMATS}, ',') AS formats")
_span_query("font_name_formats", lambda: [F.array_join(F.array_sort(t.font_name_formats(F.col("font"), F.col("flags"))), ",").alias("formats")], f"array_to_string(list_sort(list_distinct(list_concat({FORMATS}, list_filter([CASE WHEN lower(font) LIKE '%bold%' THEN 'bold' END, CASE WHEN lower(font) LIKE '%ital%' THEN 'italic' END], lambda x: x IS NOT NULL)))), ',') AS formats")
_span_query("array_sets", lambda: [F.array_join(F.array_intersect(t.font_flag_names(F.col("flags")), F.array(*map(F.lit, t.PLAIN_FLAGS))), ",").alias("common")], f"array_to_string(list_filter({FLAGS}, lambda x: x IN ('FixedPitch','Serif','Script','Nonsymbolic','AllCap','SmallCap','UseExternAttr')), ',') AS common")
_span_query("md_link", lambda: [t.md_link(F.col("text"), F.coalesce("url", F.lit("#"))).alias("md")], r"'[' || regexp_replace(text, '([\[\]()])', '\\\1', 'g') || '](' || regexp_replace(coalesce(url,'#'), '([\[\]()])', '\\\1', 'g') || ')' AS md")
_span_query("md_anchor", lambda: [t.md_anchor(F.col("text"), F.col("url")).alias("md")], "CASE WHEN url IS NOT NULL THEN '<span id=\"' || url || '\">' || text || '</span>' ELSE text END AS md")
_span_query("superscript_mark", lambda: [t.superscript_mark(F.concat(F.when(F.col("has_superscript"), F.lit("12 ")).otherwise(F.lit("")), "text")).alias("html")], r"CASE WHEN regexp_matches((CASE WHEN has_superscript THEN '12 ' ELSE '' END) || text, '^[^\p{L}_]+') THEN regexp_replace((CASE WHEN has_superscript THEN '12 ' ELSE '' END) || text, '^([^\p{L}_]+)', '<sup>\1</sup>') ELSE '<sup>' || text || '</sup>' END AS html")
_span_query("tag_kind", lambda: t.tag_kind(F.concat(F.lit("<"), F.when(F.col("span_id") % 2 == 0, "/").otherwise(""), F.element_at(F.array(*map(F.lit, ["math", "i", "b", "u"])), F.col("line_no") % 4 + 1), F.lit(">"))), "CASE WHEN line_no%4<3 THEN CASE WHEN span_id%2=0 THEN 'close' ELSE 'open' END END AS kind, CASE line_no%4 WHEN 0 THEN 'math' WHEN 1 THEN 'italic' WHEN 2 THEN 'bold' END AS format")

_block_query("span_cleanup", lambda x: [t.span_cleanup(F.concat(x, F.lit("\n \n \n x y"))).alias("text")], r"replace(regexp_replace(text || chr(10)||' '||chr(10)||' '||chr(10)||' x'||chr(160)||'y', '(\n\s){3,}', chr(10)||chr(10), 'g'), chr(160), ' ') AS text")
_block_query("math_display", lambda x: [t.math_display(F.when(F.col("block_id") % 3 == 0, F.concat(F.lit("\\begin{align}"), x)).otherwise(x)).alias("display")], "CASE WHEN block_id%3=0 THEN 'block' ELSE 'inline' END AS display")
_block_query("replace_last", lambda x: [t.replace_last(x, "th", "TH").alias("text")], "CASE WHEN strpos(text,'th')>0 THEN reverse(regexp_replace(reverse(text),'ht','HT')) ELSE text END AS text")
_block_query("escape_control", lambda x: [t.escape_control(x).alias("text")], r"replace(replace(replace(text,chr(10),'\n'),chr(9),'\t'),chr(13),'\r') AS text")
_block_query("clean_header_text", lambda x: [t.clean_header_text(F.concat(F.lit("12 "), x, F.lit(" 7"))).alias("text")], rf"regexp_replace(regexp_replace({TRIM("replace('12 '||text||' 7',chr(10),'')")}, '^[0-9]+\s*', ''), '\s*[0-9]+$', '') AS text")
_block_query("md_paragraph", lambda x: [t.md_paragraph(F.concat(x, F.when(F.col("block_id") % 2 == 0, F.lit("a-")).otherwise(F.lit(""))), F.col("page_id") % 2 == 0).alias("md")], r"CASE WHEN page_id%2=0 THEN CASE WHEN block_id%2=0 THEN text||'a' WHEN regexp_matches(text,'[\p{Ll}\p{N}]-$') THEN text[:-2] ELSE text||' ' END ELSE text || CASE WHEN block_id%2=0 THEN 'a-' ELSE '' END || chr(10)||chr(10) END AS md")
_block_query("md_heading", lambda x: [t.md_heading(x, F.col("block_id") % 4 + 1).alias("md")], "chr(10)||chr(10)||repeat('#',block_id%4+1)||' '||text||chr(10)||chr(10) AS md")
_block_query("md_list", lambda x: [t.md_list(x, F.col("block_id") % 3).alias("md")], "repeat('  ',block_id%3)||'- '||text||chr(10) AS md")
_block_query("md_math", lambda x: [t.md_math(x, F.when(F.col("block_id") % 2 == 0, "block").otherwise("inline")).alias("md")], "CASE WHEN block_id%2=0 THEN chr(10)||'$$'||text||'$$'||chr(10) ELSE ' $'||text||'$ ' END AS md")
# A text with marks outside and inside of every kind of verbatim element, and a lone angle bracket.
MARKED = "concat(text, ' a_b*c$d', chr(10), ' e <code>x_y  z</code> 1 < 2_3 <pre>p_q', chr(10), chr(10), 'r</pre><b>u_v</b> <math>k_1', chr(10), '</math> $', text)"
_block_query(
    "md_escape",
    lambda x: [t.md_escape(F.expr(MARKED)).alias("md")],
    r"""array_to_string(list_transform(regexp_extract_all("""
    + MARKED
    + r""", '(?is)(<pre>.*?</pre>|<code>.*?</code>|<math>.*?</math>|<[a-z/][^>]*>|[^<]+|<)'), lambda k: CASE WHEN k LIKE '<pre>%' THEN k
        WHEN regexp_matches(k, '^<[a-z/]') THEN regexp_replace(k,'\s+',' ','g') ELSE regexp_replace(regexp_replace(k,'\s+',' ','g'),'([_*$])','\\\1','g') END), '') AS md""",
)
_block_query("md_cleanup", lambda x: [t.md_cleanup(F.concat(F.lit("\n\n\n\n"), F.replace(x, F.lit(". "), F.lit("\n\n\n\n")), F.lit(" \n \n \n \n"))).alias("md")], rf"{TRIM(r"regexp_replace(regexp_replace(repeat(chr(10),4)||replace(text,'. ',repeat(chr(10),4))||' '||chr(10)||' '||chr(10)||' '||chr(10)||' '||chr(10), '\n{3,}', chr(10)||chr(10), 'g'), '(\n\s){3,}', chr(10)||chr(10), 'g')")} AS md")
_block_query("unwrap_outer_p", lambda x: [t.unwrap_outer_p(F.when(F.col("block_id") % 2 == 0, F.concat(F.lit("<p class='a'>"), x, F.lit("</p>"))).otherwise(F.concat(F.lit("<p>a</p><p>"), x, F.lit("</p>")))).alias("html")], "CASE WHEN block_id%2=0 THEN text ELSE '<p>a</p><p>'||text||'</p>' END AS html")
_block_query("unwrap_math", lambda x: [t.unwrap_math(F.when(F.col("block_id") % 2 == 0, F.concat(F.lit("<math display='inline'>\\\\ \\text{a} 5\\% "), F.regexp_replace(x, r"[\^_\\{}]", ""), F.lit("</math>"))).otherwise(F.concat(F.lit("<math>x^2 "), x, F.lit("</math>")))).alias("text")], rf"CASE WHEN block_id%2=0 THEN {TRIM(r"'a 5% '||regexp_replace(text,'[\^_\\{}]','','g')")} ELSE '<math>x^2 '||text||'</math>' END AS text")
_block_query("strip_fences", lambda x: [t.strip_fences(F.concat(F.lit("```html\n"), x, F.lit("\n```")), "html").alias("text")], f"{TRIM('text')} AS text")


@query("strip_tags", "SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS text FROM pages")
def strip_tags(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", t.strip_tags(F.col("html")).alias("text"))


@query("finalize_cell_text", oracle("fx_cells", "SELECT cell_id, table_id, CASE WHEN col_id=0 THEN '' ELSE replace(text,'<br>','|') || '|<b>12.5</b>' END AS text FROM fx_cells"))
def finalize_cell_text(spark, d):
    """Leaders, dots and command wrappers go; column 0 holds leaders only."""
    lines = F.when(F.col("col_id") == 0, F.array(F.lit(" "), F.lit("."), F.lit(". . . ."))).otherwise(F.concat(F.split("text", "<br>"), F.array(F.lit(" . "), F.lit("\\mathbf{12.5}\\phantom{x}\\quad"))))
    return fixture(spark, d, "fx_cells").select("cell_id", "table_id", F.array_join(t.finalize_cell_text(lines), "|").alias("text"))

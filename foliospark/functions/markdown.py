"""Markdown to HTML as a column function: a fold over the lines of a text, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import escape3, strip

# Elements that begin a block of HTML.
BLOCK = "p|div|h[1-6]|blockquote|pre|table|dl|ol|ul|script|noscript|form|fieldset|iframe|math|ins|del|hr|section|article|figure"
SEPARATOR = r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$"
_STACK = "array<struct<indent:int,tag:string>>"
_STATE = f"struct<mode:string,para:string,gap:boolean,stack:{_STACK},out:string>"


def inline_html(text: Column) -> Column:
    """Code spans, images, links, bold and italic; tags stay, other ampersands and angle brackets are escaped."""

    def one(part: Column) -> Column:
        code = F.concat(F.lit("<code>"), escape3(F.regexp_replace(part, "^`+|`+$", "")), F.lit("</code>"))
        x = F.regexp_replace(part, r"&(?!#?[A-Za-z0-9]+;)", "&amp;")
        x = F.regexp_replace(x, r"<(?![A-Za-z/!])", "&lt;")
        for pattern, new in (
            (r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)", '<img src="$2" alt="$1" />'),
            (r"\[([^\]]*)\]\(([^)\s]+)[^)]*\)", '<a href="$2">$1</a>'),
            (r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1", "<strong>$2</strong>"),
            (r"\*(?=\S)(.+?)(?<=\S)\*|(?<![A-Za-z0-9])_(?=\S)(.+?)(?<=\S)_(?![A-Za-z0-9])", "<em>$1$2</em>"),
            (r" {2,}\n", "<br />\n"),
        ):
            x = F.regexp_replace(x, "(?s)" + pattern, new)
        return F.when(part.rlike("^`"), code).otherwise(x)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(?s)(`+[^`]+`+|[^`]+|`)"), 1), one), "")


def _line(raw: Column, after: Column) -> Column:
    """What a line is by itself and by the one after it."""
    piped = lambda x: F.contains(x, F.lit("|"))
    kind = (
        F.when(raw.rlike(r"^\s*$"), "blank")
        .when(raw.rlike(r"^\s*```"), "fence")
        .when(raw.rlike(r"^#{1,6}\s"), "heading")
        .when(raw.rlike(r"^\s*((\*\s*){3,}|(-\s*){3,}|(_\s*){3,})$"), "rule")
        .when(raw.rlike(r"^\s*([-*+]|\d+[.)])\s+\S"), "item")
        .when(raw.rlike("^>"), "quote")
        .when(piped(raw) & raw.rlike(SEPARATOR), "separator")
        .when(piped(raw) & piped(after) & after.rlike(SEPARATOR), "head")
        .when(raw.rlike(rf"(?i)^</?({BLOCK})\b"), "html")
        .otherwise("text")
    )
    body = F.regexp_replace(raw, r"^#{1,6}\s+|\s+#*\s*$|^\s*([-*+]|\d+[.)])\s+|^>\s?", "")
    numbered = raw.rlike(r"^\s*\d+[.)]\s")
    indent = F.length(raw) - F.length(F.ltrim(raw))
    level = F.length(F.regexp_extract(raw, "^(#*)", 1))
    return F.struct(kind.alias("kind"), raw.alias("raw"), body.alias("body"), indent.alias("indent"), level.alias("level"), F.when(numbered, "ol").otherwise("ul").alias("tag"))


def _cells(raw: Column, tag: str) -> Column:
    inner = F.regexp_replace(strip(raw), r"^\||(?<!\\)\|$", "")
    cells = F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.concat(F.lit(f"<{tag}>"), inline_html(strip(F.replace(c, F.lit("\\|"), F.lit("|")))), F.lit(f"</{tag}>")))
    return F.concat(F.lit("<tr>"), F.array_join(cells, ""), F.lit("</tr>\n"))


def _closing(stack: Column) -> Column:
    return F.array_join(F.transform(F.reverse(stack), lambda s: F.concat(F.lit("</li>\n</"), s.tag, F.lit(">\n"))), "")


def _closed(s: Column) -> Column:
    """The text so far, with what is open in it ended."""
    part = (
        F.when(s.mode == "p", F.concat(F.lit("<p>"), inline_html(s.para), F.lit("</p>\n")))
        .when(s.mode == "quote", F.concat(F.lit("<blockquote>\n<p>"), inline_html(s.para), F.lit("</p>\n</blockquote>\n")))
        .when(s.mode == "list", F.concat(inline_html(s.para), _closing(s.stack)))
        .when(s.mode == "table", "</tbody>\n</table>\n")
        .when(s.mode == "code", "</code></pre>\n")
        .when(s.mode == "html", F.concat(s.para, F.lit("\n")))
        .otherwise("")
    )
    return F.concat(s.out, part)


def markdown_html(text: Column) -> Column:
    """Headings, paragraphs, nested lists, tables, quotes, fenced code, rules, blocks of HTML and what stands in lines.

    A list item keeps lines under it, and after a blank line those that are indented. A table needs a row of dashes
    under its head. What is open at the end is closed. Null stays null; a blank text is empty.
    """
    none = F.array().cast(_STACK)
    lines = F.split(text, r"\r?\n")
    lines = F.transform(F.zip_with(lines, F.concat(F.slice(lines, 2, F.size(lines)), F.array(F.lit(""))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: _line(x.a, x.b))

    def state(mode, para=None, stack=None, out=None, gap=None):
        return F.struct((F.lit(mode) if isinstance(mode, str) else mode).alias("mode"), (F.lit("") if para is None else para).alias("para"), (F.lit(False) if gap is None else gap).alias("gap"), (none if stack is None else stack).alias("stack"), out.alias("out")).cast(_STATE)

    def step(s, x):
        closed = _closed(s)
        tail = F.try_element_at(s.stack, F.lit(-1))
        kept = F.filter(s.stack, lambda e: e.indent <= x.indent)
        kept = F.when(F.size(kept) > 0, kept).otherwise(F.slice(s.stack, 1, 1))
        dropped = F.slice(s.stack, F.size(kept) + 1, F.size(s.stack))
        entry = F.array(F.struct(x.indent.cast("int").alias("indent"), x.tag.alias("tag")).cast("struct<indent:int,tag:string>"))
        opened = F.concat(F.lit("<"), x.tag, F.lit(">\n<li>"))
        more = F.concat(s.para, F.lit("\n"), x.raw)
        h = F.concat(F.lit("h"), x.level.cast("string"), F.lit(">"))
        return (
            F.when((s.mode == "code") & (x.kind != "fence"), state("code", out=F.concat(s.out, escape3(x.raw), F.lit("\n"))))
            .when(x.kind == "fence", F.when(s.mode == "code", state("", out=closed)).otherwise(state("code", out=F.concat(closed, F.lit("<pre><code>")))))
            .when((x.kind == "blank") & (s.mode == "list"), state("list", s.para, s.stack, s.out, F.lit(True)))
            .when(x.kind == "blank", state("", out=closed))
            .when((s.mode == "html"), state("html", more, out=s.out))
            .when(x.kind == "heading", state("", out=F.concat(closed, F.lit("<"), h, inline_html(x.body), F.lit("</"), h, F.lit("\n"))))
            .when(x.kind == "rule", state("", out=F.concat(closed, F.lit("<hr />\n"))))
            .when(x.kind == "head", state("table", out=F.concat(closed, F.lit("<table>\n<thead>\n"), _cells(x.raw, "th"), F.lit("</thead>\n<tbody>\n"))))
            .when((s.mode == "table") & (x.kind == "separator"), s)
            .when((s.mode == "table") & F.contains(x.raw, F.lit("|")), state("table", out=F.concat(s.out, _cells(x.raw, "td"))))
            .when((x.kind == "item") & (s.mode != "list"), state("list", x.body, entry, F.concat(closed, opened)))
            .when((x.kind == "item") & (x.indent > tail.indent + 1), state("list", x.body, F.concat(s.stack, entry), F.concat(s.out, inline_html(s.para), F.lit("\n"), opened)))
            .when(x.kind == "item", state("list", x.body, kept, F.concat(s.out, inline_html(s.para), _closing(dropped), F.lit("</li>\n<li>"))))
            .when((x.kind == "quote") & (s.mode == "quote"), state("quote", F.concat(s.para, F.lit("\n"), x.body), out=s.out))
            .when(x.kind == "quote", state("quote", x.body, out=closed))
            .when((x.kind == "html") & ~s.mode.isin("p", "list"), state("html", x.raw, out=closed))
            .when(s.mode.isin("p", "quote"), state(s.mode, more, out=s.out))
            .when((s.mode == "list") & ~(s.gap & (x.indent == 0)), state("list", F.concat(s.para, F.lit("\n"), F.ltrim(x.raw)), s.stack, s.out))
            .otherwise(state("p", x.raw, out=closed))
        )

    return F.when(text.isNotNull(), F.rtrim(F.aggregate(lines, state("", out=F.lit("")), step, _closed), F.lit("\n")))

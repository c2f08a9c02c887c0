"""Text predicates and clean-up as column functions. `(?U)` makes \\s, \\w, \\d follow Unicode."""

from __future__ import annotations

import html.entities
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

# Code points that count as a plain space: em, en, no-break, zero-width, ideographic.
ODD_SPACES = "\u2003\u2002\u00a0\u200b\u3000"


def chain(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Regular-expression replacements, one after another."""
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, text)


def strip(text: Column) -> Column:
    """Without white space at both ends, any Unicode kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_spaces(text: Column) -> Column:
    return F.translate(text, ODD_SPACES, " " * len(ODD_SPACES))


def alphanum_ratio(text: Column) -> Column:
    """Share of letters and digits among what is neither space nor newline; 1 for nothing."""
    rest = F.translate(text, " \n", "")
    return F.when(F.length(rest) == 0, F.lit(1.0)).otherwise(F.regexp_count(rest, F.lit(r"[\p{L}\p{N}]")) / F.length(rest))


def detect_bad_text(text: Column, space: float = 0.7, newline: float = 0.6, alphanum: float = 0.3) -> Column:
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("double")
    spaces, visible = count(r"(?U)\s+"), count(r"(?U)\S")
    lines, other = count(r"\n+"), count(r"[^\n]")
    share = lambda a, b: F.when(a + b == 0, F.lit(0.0)).otherwise(a / (a + b))
    broken = count("\ufffd") > F.greatest(F.lit(6.0), F.length(text) * 0.03)
    return (F.length(text) == 0) | (share(spaces, visible) > space) | (share(lines, other) > newline) | (alphanum_ratio(text) < alphanum) | broken


def escape5(text: Column) -> Column:
    """The five reserved characters of HTML as entities."""
    # Characters and entities, ampersand first.
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def _entities() -> dict[str, str]:
    """Names of character references as the standard library has them, and numbers that stand for Windows characters."""
    windows = {f"#{n}": bytes([n]).decode("cp1252", "ignore") or "\ufffd" for n in range(0x80, 0xA0)}
    return {k: v for k, v in html.entities.html5.items()} | windows


def html_unescape(text: Column) -> Column:
    """All named and numbered character references decoded; unknown names stay, and so do names run into a word."""
    parts = F.split(text, r"(?=&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});?)|(?<=;)")
    # both lists are folded into one literal
    names = F.map_from_arrays(*(F.split(F.lit("\u0001".join(x)), "\u0001") for x in zip(*_entities().items())))

    def one(p: Column) -> Column:
        ref = F.regexp_extract(p, r"^&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31};?)", 1)
        number = F.when(F.lower(F.substring(ref, 2, 1)) == "x", F.conv(F.substring(ref, 3, 6), 16, 10)).otherwise(F.substring(ref, 2, 7)).cast("int")
        known = F.element_at(names, F.when(ref.startswith("#"), F.concat(F.lit("#"), number.cast("string"))).otherwise(ref))
        bad = (number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
        char = F.when(bad, "\ufffd").otherwise(F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        rest = F.substring(p, F.length(ref) + 2, F.length(p))
        rest = F.when(ref.startswith("#"), F.regexp_replace(rest, "^;", "")).otherwise(rest)
        return F.when(ref == "", p).when(known.isNotNull(), F.concat(known, rest)).when(ref.startswith("#"), F.concat(char, rest)).otherwise(p)

    return F.when(text.contains("&"), F.array_join(F.transform(parts, one), "")).otherwise(text)


def escape3(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


# Deletions of the LaTeX-to-Markdown clean-up, in order.
LATEX_RULES = [("[\u00a0\u2002\u2003]", " "), (r"`\\cite`", ""), (r"<[^>]*>", ""), (r"\{[^}]*\}", ""), (r"\\cite\{[^}]*\}", ""), (r"::: ", ""), (r"\[", ""), (r"\]", "")]


def latex_md_clean(text: Column) -> Column:
    return chain(text, LATEX_RULES)


def clean_header_text(text: Column) -> Column:
    """Newlines out, trimmed, digits at both ends off with the white space beside them."""
    whole = strip(F.replace(text, F.lit("\n"), F.lit("")))
    return F.regexp_replace(F.regexp_replace(whole, r"(?U)^\d+\s*", ""), r"(?U)\s*\d+$", "")


def span_cleanup(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, r"(\n\s){3,}", "\n\n"), F.lit("\u00a0"), F.lit(" "))


# Fixed value: the leading run of a footnote that is raised.
RAISED = r"[0-9\W]+"


def superscript_mark(text: Column) -> Column:
    """A leading run of digits and marks is raised; the whole text where there is none."""
    lead = rf"(?Us)^({RAISED})(.*)$"
    return F.when(F.regexp_like(text, F.lit(lead)), F.regexp_replace(text, lead, "<sup>$1</sup>$2")).otherwise(F.concat(F.lit("<sup>"), text, F.lit("</sup>")))


def math_display(text: Column) -> Column:
    return F.when(F.regexp_like(text, F.lit(r"\\begin\{(split|align|gather|multline)\}")), "block").otherwise("inline")


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", "")


def replace_last(text: Column, pattern: str, new: str) -> Column:
    return F.regexp_replace(text, f"(?s)^(.*){pattern}", f"$1{new}")


def escape_control(text: Column) -> Column:
    for raw, shown in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        text = F.replace(text, F.lit(raw), F.lit(shown))
    return text


def md_paragraph(text: Column, continues: Column) -> Column:
    """A paragraph ends in a blank line; one that continues loses its hyphen after a lower-case letter or digit, else gets a space."""
    hyphen = F.regexp_like(text, F.lit(r"[\p{Ll}\p{N}]-$"))
    open_end = F.when(hyphen, F.regexp_replace(text, "-$", "")).otherwise(F.concat(text, F.lit(" ")))
    return F.when(continues, open_end).otherwise(F.concat(text, F.lit("\n\n")))


def md_heading(text: Column, level: Column) -> Column:
    return F.concat(F.lit("\n\n"), F.repeat(F.lit("#"), level), F.lit(" "), text, F.lit("\n\n"))


def md_list(text: Column, level: Column) -> Column:
    return F.concat(F.repeat(F.lit("  "), level), F.lit("- "), text, F.lit("\n"))


def md_math(text: Column, display: Column, inline: tuple = ("$", "$"), block: tuple = ("$$", "$$")) -> Column:
    return F.when(display == "block", F.concat(F.lit("\n" + block[0]), text, F.lit(block[1] + "\n"))).otherwise(F.concat(F.lit(" " + inline[0]), text, F.lit(inline[1] + " ")))


def md_link(text: Column, url: Column) -> Column:
    mark = lambda c: F.regexp_replace(c, r"([\[\]()])", r"\\$1")
    return F.concat(F.lit("["), mark(text), F.lit("]("), mark(url), F.lit(")"))


def md_anchor(text: Column, anchor: Column) -> Column:
    return F.when(anchor.isNotNull() & (anchor != ""), F.concat(F.lit('<span id="'), anchor, F.lit('">'), text, F.lit("</span>"))).otherwise(text)


def md_cleanup(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"(\n\s){3,}", "\n\n"))


# Fixed value: elements whose text keeps its marks. Text in pre keeps its white space too.
VERBATIM = ["pre", "code", "kbd", "samp", "math"]


def md_escape(text: Column) -> Column:
    """Underscore, star and dollar escaped outside verbatim elements and tags; white space collapsed outside pre.

    An element that is not closed, or one inside another of its own kind, ends at the first end tag or not at all.
    """
    whole = "|".join(rf"<{tag}\b[^>]*>.*?</{tag}>" for tag in VERBATIM)
    tokens = F.regexp_extract_all(text, F.lit(rf"(?is)({whole}|<[a-z/][^>]*>|[^<]+|<)"), F.lit(1))

    def one(token: Column) -> Column:
        thin = F.regexp_replace(token, r"\s+", " ")
        verbatim = F.regexp_like(token, F.lit(r"(?i)^<[a-z/]"))
        return F.when(F.regexp_like(token, F.lit(r"(?i)^<pre\b")), token).when(verbatim, thin).otherwise(F.regexp_replace(thin, r"([_*$])", r"\\$1"))

    plain = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"([_*$])", r"\\$1")
    return F.when(F.contains(text, F.lit("<")), F.array_join(F.transform(tokens, one), "")).otherwise(plain)


def unwrap_outer_p(html: Column) -> Column:
    """The sole outer paragraph tag removed."""
    sole = (F.regexp_count(html, F.lit(r"<p[ >]")) == 1) & F.regexp_like(html, F.lit(r"(?s)^\s*<p[^>]*>.*</p>\s*$"))
    return F.when(sole, F.regexp_replace(html, r"(?s)^\s*<p[^>]*>(.*)</p>\s*$", "$1")).otherwise(html)


def unwrap_math(text: Column) -> Column:
    r"""Plain text where a leading math tag holds no markup: edge \\ and \text{} off, escapes undone."""
    inner = F.regexp_replace(text, r"(?s)^\s*<math\b[^>]*>|</math>\s*$", "")
    inner = chain(inner, [(r"^\s*\\\\\s*|\s*\\\\\s*$", ""), (r"\\text[a-zA-Z]*\s*\{(.*?)\}", "$1"), (r"\\([%$_&#\u2030])", "$1")])
    starts = F.regexp_like(text, F.lit(r"(?s)^<math\b[^>]*>.*?</math>"))
    return F.when(starts & ~F.regexp_like(inner, F.lit(r"[\^_\\{}]")), strip(inner)).otherwise(text)


def tag_kind(tag: Column) -> list[Column]:
    """(open or close, format) of a tag; only math, i and b are formats."""
    name = F.lower(F.regexp_extract(tag, r"^</?([a-zA-Z]+)", 1))
    fmt = F.when(name == "math", "math").when(name == "i", "italic").when(name == "b", "bold")
    return [F.when(fmt.isNull(), None).when(F.startswith(tag, F.lit("</")), "close").otherwise("open").alias("kind"), fmt.alias("format")]


def strip_fences(text: Column, lang: str) -> Column:
    return strip(chain(strip(text), [(rf"^```({lang})?", ""), (r"```$", "")]))


# Deletions and unwrappings of table cell text, in order.
CELL_RULES = [
    (r"(\s?[.\-_\u2026]){2,}", ""),
    (r"[.\-_\u2026]{2,}", ""),
    (r"\\mathbf\{([0-9.,$\u20ac\u00a3]+)\}", "<b>$1</b>"),
    (r"\\[a-zA-Z]+\{\s*\}", ""),
    (r"\\phantom\{.*?\}", ""),
    (r"\\quad", ""),
    (r"\\,", ""),
    (r"\\mathsf\{([^}]*)\}", "$1"),
    (r"\\[a-zA-Z]+\{([^}]*)$", "$1"),
    (r"^\s*\\text\{([^}]*)\}\s*$", "$1"),
]


def finalize_cell_text(lines: Column) -> Column:
    """Blank and lone-dot lines dropped; leaders, empty commands and wrappers off; odd spaces plain."""
    kept = F.filter(lines, lambda x: ~F.trim(x).isin("", "."))
    return F.transform(kept, lambda x: normalize_spaces(unwrap_math(chain(F.trim(x), CELL_RULES))))


# PDF font descriptor bits.
FONT_FLAGS = [("FixedPitch", 0), ("Serif", 1), ("Symbolic", 2), ("Script", 3), ("Nonsymbolic", 5), ("Italic", 6), ("AllCap", 16), ("SmallCap", 17), ("ForceBold", 18), ("UseExternAttr", 19)]
PLAIN_SETS = [["Symbolic", "Italic"], ["Symbolic", "Italic", "UseExternAttr"], ["UseExternAttr"]]
PLAIN_FLAGS = ["FixedPitch", "Serif", "Script", "Nonsymbolic", "AllCap", "SmallCap", "UseExternAttr"]


def font_flag_names(flags: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.getbit(flags, F.lit(bit)) == 1, F.lit(name)) for name, bit in FONT_FLAGS]))


def font_flag_formats(flags: Column) -> Column:
    """Formats of the font flags; an array in the order italic, bold, plain."""
    names = font_flag_names(flags)
    has = lambda n: F.array_contains(names, n)
    plain = F.size(F.array_intersect(names, F.array(*map(F.lit, PLAIN_FLAGS)))) > 0
    out = F.array_compact(F.array(F.when(has("Italic"), F.lit("italic")), F.when(has("ForceBold"), F.lit("bold")), F.when(plain, F.lit("plain"))))
    only_plain = reduce(lambda a, b: a | b, [F.size(names) == 0, *(names == F.array(*map(F.lit, x)) for x in PLAIN_SETS)])
    return F.when(flags.isNull() | only_plain, F.array(F.lit("plain"))).otherwise(out)


def font_name_formats(font: Column, flags: Column) -> Column:
    name = F.lower(F.coalesce(font, F.lit("")))
    own = F.array_compact(F.array(F.when(F.contains(name, F.lit("bold")), F.lit("bold")), F.when(F.contains(name, F.lit("ital")), F.lit("italic"))))
    return F.array_union(font_flag_formats(flags), own)


#: Bits of a word in indel_ratio: a sum of two words and a carry fits a long.
WORD = 62


def indel_ratio(a: Column | str, b: Column | str) -> Column:
    """100 * 2 LCS / (both lengths), 100 for two empty texts; null counts as empty.

    The longest common subsequence is found with a bit for each character of `a`, as longs: each character of `b` adds
    the words of its own places to the row, with a carry from word to word, and the bits that end as 0 are the length.
    """
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    x, y = (F.split(F.coalesce(c, F.lit("")), "") for c in (a, b))
    x, y = F.array_remove(x, ""), F.array_remove(y, "")
    words = lambda chars: F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(chars) / WORD).cast("int") - 1))
    bits = lambda chars, c: F.aggregate(F.reverse(chars), F.lit(0).cast("long"), lambda s, k: F.shiftleft(s, 1) + (k == c).cast("long"))
    full = F.lit((1 << WORD) - 1)

    def counted(s: Column) -> Column:
        places = F.transform(s["letters"], lambda c: F.transform(words(s["x"]), lambda w: bits(F.slice(s["x"], w * WORD + 1, WORD), c)))
        return F.struct(s["x"].alias("x"), s["y"].alias("y"), F.map_from_arrays(s["letters"], places).alias("places"))

    def length(s: Column) -> Column:
        def step(row, c):
            mine = F.element_at(s["places"], c)

            def word(acc, i):
                v, m = F.get(row, i), F.get(mine, i)
                total = v + v.bitwiseAND(m) + acc["carry"]
                kept = total.bitwiseOR(v - v.bitwiseAND(m)).bitwiseAND(full)
                return F.struct(F.shiftright(total, WORD).alias("carry"), F.array_append(acc["out"], kept).alias("out"))

            start = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<bigint>").alias("out"))
            return F.when(mine.isNull(), row).otherwise(F.aggregate(words(s["x"]), start, word, lambda acc: acc["out"]))

        row = F.aggregate(s["y"], F.transform(words(s["x"]), lambda _: full), step)
        ones = F.aggregate(row, F.lit(0).cast("int"), lambda n, v: n + F.bit_count(v))
        return F.size(row) * WORD - ones

    # each struct is made once and read by the next lambda: names for values that are used several times
    once = lambda value, f: F.get(F.transform(F.array(value), f), 0)
    state = once(F.struct(x.alias("x"), y.alias("y"), F.array_distinct(x).alias("letters")), counted)
    ratio = lambda s: F.when(F.size(s["x"]) + F.size(s["y"]) == 0, 100.0).otherwise(200.0 * length(s) / (F.size(s["x"]) + F.size(s["y"])))
    return F.when(a == b, 100.0).otherwise(once(state, ratio))


def indel_ratios(a: Column, b: Column) -> Column:
    """indel_ratio for pairs of columns, in Arrow batches; it can't stand inside a lambda, where indel_ratio can.

    The same row of bits for many pairs at once: each step takes one character of every pair's shorter text.
    """

    def codes(texts: list[str], size: int, beyond: int) -> np.ndarray:
        out = np.full((len(texts), size), beyond, np.uint32)
        for row, text in zip(out, texts, strict=True):
            row[: len(text)] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return out

    def common(short: list[str], long: list[str]) -> np.ndarray:
        """Lengths of the longest common subsequences; the carry goes from word to word."""
        steps, size = max(map(len, short)), max(map(len, long))
        x, y = codes(long, -(-size // 64) * 64, 0x110000), codes(short, steps, 0x110001)
        y = np.ascontiguousarray(y.T)
        row = np.full((x.shape[1] // 64, len(x)), ~np.uint64(0))
        for c in y:
            marks = np.packbits(x == c[:, None], axis=1, bitorder="little").view("<u8").T
            carry = np.zeros(len(x), bool)
            for v, m in zip(row, marks, strict=True):
                total = v + (v & m)
                more = total < v
                total += carry
                carry = more | (total < carry)
                v[:] = total | (v & ~m)
        return row.shape[0] * 64 - np.bitwise_count(row).sum(axis=0, dtype=np.int64)

    def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = [sorted(p, key=len) for p in zip(a.fillna(""), b.fillna(""), strict=True)]
        out = np.full(len(pairs), 100.0)
        left = sorted((i for i, (s, t) in enumerate(pairs) if s != t), key=lambda i: len(pairs[i][1]))
        while left:
            # pairs of like size, about a million characters at once
            n = max(1, min(4096, (1 << 20) // (len(pairs[left[-1]][1]) or 1)))
            some, left = left[-n:], left[:-n]
            short, long = ([pairs[i][k] for i in some] for k in (0, 1))
            sizes = np.array([len(s) + len(t) for s, t in zip(short, long, strict=True)])
            out[some] = 200.0 * common(short, long) / sizes if max(map(len, short)) else 0.0
        return pd.Series(out)

    return F.pandas_udf(ratios, "double")(a, b)

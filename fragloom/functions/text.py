
from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fragloom import schema
from fragloom.operators.xmltokens import XmlError, tokens, unescape

# -- decoding


def encoding(raw: Column) -> Column:
    """[A2] Name of the encoding that the byte order mark tells; UTF-8 without one."""
    starts = lambda n, mark: F.substring(raw, 1, n) == F.unhex(F.lit(mark))
    return F.when(starts(2, "FFFE"), "UTF-16LE").when(starts(2, "FEFF"), "UTF-16BE").otherwise(F.lit("UTF-8"))


def has_mark(raw: Column) -> Column:
    return (encoding(raw) != "UTF-8") | (F.substring(raw, 1, 3) == F.unhex(F.lit("EFBBBF")))


#: Bytes of UTF-16, read one a character, from where the last match ended: whole characters, and what is none.
_PAIRS = {"UTF-16LE": (r"(?s).[^Ø-ß]", r"(?s).[Ø-Û].[Ü-ß]", "ýÿ"), "UTF-16BE": (r"(?s)[^Ø-ß].", r"(?s)[Ø-Û].[Ü-ß].", "ÿý")}


def _utf16(body: Column, name: str) -> Column:
    """Text of UTF-16 bytes; halves of characters, and an odd last byte, become U+FFFD. The built-in decode() fails on these, so bytes are checked
    first: whole characters are taken off from the front, and something is left only if one is not whole."""
    one, two, bad = _PAIRS[name]
    plain = F.decode(body, "ISO-8859-1")
    left = F.regexp_replace(plain, rf"\G(?:(?:{one}){{1,500}}|{two})", "")
    units = F.regexp_extract_all(plain, F.lit(rf"(?s)\G(?:{one}|{two}|..|.)"), F.lit(0))
    mended = F.array_join(F.transform(units, lambda u: F.when(u.rlike(rf"^(?:{one}|{two})$"), u).otherwise(F.lit(bad))), "")
    return F.decode(F.when(left == "", body).otherwise(F.encode(mended, "ISO-8859-1")), name)


def decoded(raw: Column) -> Column:
    """[A1, A2] Text of a file: by its mark, bad bytes replaced, line ends as LF, UTF-8 in its declaration. Built-in functions only."""
    marked = lambda mark, n: F.substring(raw, 1, n) == F.lit(mark)
    body = lambda n: F.substring(raw, F.lit(n), F.octet_length(raw))
    text = F.when(marked(b"\xff\xfe", 2), _utf16(body(3), "UTF-16LE")).when(marked(b"\xfe\xff", 2), _utf16(body(3), "UTF-16BE"))
    text = text.otherwise(F.make_valid_utf8(F.when(marked(b"\xef\xbb\xbf", 3), body(4)).otherwise(raw).cast("string")))
    text = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    for quote in "\"'":
        text = F.replace(text, F.lit(f"encoding={quote}UTF-16{quote}"), F.lit(f"encoding={quote}UTF-8{quote}"))
    return text


# -- class of a file


def normal_name(name: Column) -> Column:
    """[B2] Collection that a spelling names, else null."""
    text, out = F.lower(F.trim(name)), F.lit(None).cast("string")
    for known, spellings in reversed(schema.SPELLINGS.items()):
        for spelling in spellings:
            out = F.when(text.contains(spelling), F.lit(known)).otherwise(out)
    return out


def collection(content: Column) -> Column:
    """[B1] Collection of a file, from its first collection paragraph; null if that is absent or unknown."""
    return normal_name(F.regexp_extract(content, r'(?s)<p rend="nikaya">(.*?)</p>', 1))


def levels(nikaya: Column) -> Column:
    """[B3] Level types of a collection."""
    out = F.lit(None).cast("array<string>")
    for name, kinds in schema.LEVELS.items():
        out = F.when(nikaya == name, F.array(*map(F.lit, kinds))).otherwise(out)
    return out


def file_kind(cst_file: Column) -> Column:
    """[B4, B5] mula, atthakatha or tika, by the file name."""
    name = F.lower(cst_file)
    return F.when(name.endswith(".att.xml"), "atthakatha").when(name.endswith(".tik.xml"), "tika").otherwise(F.lit("mula"))


def file_class(nikaya: Column, cst_file: Column) -> Column:
    """[B4] `samyutta tika`; the last collection has one class, an unknown one is general."""
    return F.when(nikaya == "khuddaka", nikaya).when(nikaya.isin(*schema.LEVELS), F.concat_ws(" ", nikaya, file_kind(cst_file))).otherwise(F.lit("general"))


def strategy(nikaya: Column, cst_file: Column) -> Column:
    """[B6] Which rules the scan follows."""
    return F.when(nikaya == "samyutta", F.when(file_kind(cst_file) == "mula", "grouped").otherwise(F.lit("deferred"))).otherwise(F.lit("general"))


def display_name(nikaya: Column) -> Column:
    """[C31]"""
    out = nikaya
    for known, shown in schema.DISPLAY.items():
        out = F.when(nikaya == known, F.lit(shown)).otherwise(out)
    return out


def display_order(nikaya: Column) -> Column:
    """[C31] From 1; unknown collections last."""
    at = F.array_position(F.array(*map(F.lit, schema.DISPLAY)), nikaya)
    return F.when(at > 0, at).otherwise(F.lit(len(schema.DISPLAY) + 1))


# -- titles in fragments (slices with unbalanced tags: patterns, not an XML reader)


def _numbered(content: Column, tags: str, rend: str) -> Column:
    found = F.regexp_extract_all(content, F.lit(rf'<(?:{tags})\s(?:[^>]*\s)?rend="{rend}"[^>]*>([^<]+)'), F.lit(1))
    first = F.get(F.filter(F.transform(found, lambda t: F.trim(t, F.lit(" \n\t\r"))), lambda t: t.rlike(r"^\p{N}")), F.lit(0))
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        first = F.replace(first, F.lit(entity), F.lit(char))
    return first


def vagga_title(content: Column) -> Column:
    """[C6] First numbered chapter head."""
    return _numbered(content, "head", "chapter")


def first_paragraph_number(content: Column) -> Column:
    """[C7] `n` of the first body paragraph that has one, in either order of attributes."""
    found = F.regexp_extract(content, r'<p\s(?=[^>]*\brend="bodytext")(?:[^>]*\s)?n="([^"]*)"', 1)
    return F.when(content.rlike(r'<p\s(?=[^>]*\brend="bodytext")(?:[^>]*\s)?n="'), found)


def section_title(content: Column) -> Column:
    """[C8] First numbered subhead, else first numbered chapter head."""
    return F.coalesce(_numbered(content, "p|head", "subhead"), _numbered(content, "head", "chapter"))


# -- positions


def end_position(content: Column, line: Column, column: Column, unit: str = "bytes") -> Column:
    """[C28] struct(line, column) where content that starts at (line, column) ends. unit: bytes, as the scan counts, or chars."""
    size = F.octet_length if unit == "bytes" else F.char_length
    breaks = F.regexp_count(content, F.lit("\n"))
    tail = size(F.substring_index(content, "\n", -1))
    return F.struct((line + breaks).cast("int").alias("line"), F.when(breaks > 0, tail).otherwise(column + tail).cast("int").alias("column"))


# -- text


def escape_tsv(text: Column) -> Column:
    """[C27]"""
    for raw, shown in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(raw), F.lit(shown))
    return text


def squeeze_lines(text: Column) -> Column:
    """[C26] No more than one empty line in a row."""
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def consistent(text: Column) -> Column:
    """[C29] Placeholder of a spelling rule: null to empty, nothing else."""
    return F.coalesce(text, F.lit(""))


def levels_json(levels_column: Column) -> Column:
    """[C30] With nulls, in the order group_type, group_number, title, id."""
    return F.to_json(levels_column, {"ignoreNullFields": "false"})


def json_levels(text: Column) -> Column:
    """[C30] Bad JSON gives no levels."""
    return F.coalesce(F.from_json(text, f"array<{schema.LEVEL.simpleString()}>"), F.array().cast(f"array<{schema.LEVEL.simpleString()}>"))


def rendered_html(content: str | None) -> str | None:
    """[C25] A fragment as HTML; unknown tags go, their text stays."""
    if content is None:
        return None
    out: list[str] = []
    number: str | None = None
    closing: dict[str, list[str]] = {}
    heads = {"chapter": "h2", "book": "h2", "subhead": "h3", "subsubhead": "h4"}

    def opens(name: str, start: str, end: str, empty: bool) -> None:
        out.append(start + (end if empty else ""))
        if not empty:
            closing.setdefault(name, []).append(end)

    try:
        for t in tokens(content.encode(), strict=False):
            q = {k: html.escape(v) for k, v in t.attrs.items()}
            empty, rend = t.kind == "empty", q.get("rend")
            if t.kind == "text":
                if number is not None and t.text.strip():
                    out.append(f'<span class="paranum">{number}</span> ')
                    number = None
                out.append(html.escape(unescape(t.text), quote=False))
            elif t.kind == "end":
                if ends := closing.get(t.name):
                    out.append(ends.pop())
            elif t.kind == "other":
                continue
            elif t.name == "p":
                kind = "centered" if rend in ("centre", "center") else rend or "bodytext"
                number = q.get("n")
                opens("p", f'<p class="{kind}">', "</p>\n", empty)
            elif t.name == "hi":
                opens("hi", f'<span class="{rend or "bold"}">', "</span>", empty)
            elif t.name == "note":
                opens("note", '<span class="note">[', "]</span>", empty)
            elif t.name == "pb":
                out.append(f'<span class="pagebreak" data-ed="{q.get("ed", "")}" data-n="{q.get("n", "")}"></span>')
            elif t.name == "head":
                tag = heads.get(rend or "", "h3")
                opens("head", f"<{tag}>", f"</{tag}>\n", empty)
            elif t.name == "div":
                named = "".join(f' {k}="{q[a]}"' for k, a in (("class", "type"), ("id", "id")) if a in q)
                opens("div", f"<div{named}>", "</div>\n", empty)
            elif t.name == "trailer":
                opens("trailer", f'<p class="{rend or "trailer"}">', "</p>\n", empty)
    except XmlError:
        pass
    return "".join(out)


@F.pandas_udf(T.StringType())
def to_html(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """[C25] Arrow batches: fragments are not well-formed, so no built-in XML function reads them."""
    for series in contents:
        yield series.map(rendered_html)

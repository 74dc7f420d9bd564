"""A pull tokenizer for possibly unbalanced XML, over bytes, with line and column of every position."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

_TOKEN = re.compile(
    rb"""(?P<text>[^<]+)
    |<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![^>]*>
    |</(?P<end>[^\s>]+)\s*>
    |<(?P<tag>[^\s/>!?]+)(?P<attrs>(?:[^<>"']|"[^"]*"|'[^']*')*?)(?P<empty>/?)>""",
    re.X | re.S,
)
_ATTR = re.compile(rb"""([^\s=]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_ENTITY = re.compile(r"&([^;&\s]*);?")


class Token(NamedTuple):
    kind: str  # start, empty, text, end or other
    name: str
    attrs: dict[str, str]
    text: str
    start: int
    end: int


class XmlError(ValueError):
    pass


def unescape(text: str) -> str:
    """Predefined and numeric entities; any other is an error."""
    if "&" not in text:
        return text

    def one(m: re.Match) -> str:
        if m[0].endswith(";") and (m[1] in ("lt", "gt", "amp", "quot", "apos") or re.fullmatch(r"#(\d+|x[0-9a-fA-F]+)", m[1])):
            return html.unescape(m[0])
        raise XmlError(f"unknown entity {m[0]}")

    return _ENTITY.sub(one, text)


def attributes(raw: bytes) -> dict[str, str]:
    return {k.decode(): unescape((a or b).decode()) for k, a, b in _ATTR.findall(raw)}


def tokens(content: bytes, strict: bool = True) -> Iterator[Token]:
    """Tokens that cover content without gaps. strict: end tags must match and no tag may be cut off; else what cannot be
    read ends the stream."""
    at, open_tags = 0, []
    while at < len(content):
        m = _TOKEN.match(content, at)
        if not m:
            if strict:
                raise XmlError(f"malformed markup at byte {at}")
            return
        if m["text"] is not None:
            yield Token("text", "", {}, m["text"].decode(), at, m.end())
        elif m["tag"] is not None:
            name = m["tag"].decode()
            yield Token("empty" if m["empty"] else "start", name, attributes(m["attrs"]), "", at, m.end())
            if not m["empty"]:
                open_tags.append(name)
        elif m["end"] is not None:
            name = m["end"].decode()
            if strict and (not open_tags or open_tags.pop() != name):
                raise XmlError(f"unexpected </{name}> at byte {at}")
            yield Token("end", name, {}, "", at, m.end())
        else:
            yield Token("other", "", {}, "", at, m.end())
        at = m.end()


class Lines:
    """Bytes to (line from 1, byte column from 0) and back."""

    def __init__(self, content: bytes):
        self.size = len(content)
        self.starts = [0, *(m.end() for m in re.finditer(b"\n", content))]

    def at(self, byte: int) -> tuple[int, int]:
        line = bisect_right(self.starts, byte)
        return line, byte - self.starts[line - 1]

    def byte(self, line: int, column: int) -> int:
        """The end of content where there is no such place."""
        if not 1 <= line <= len(self.starts):
            return self.size
        place = self.starts[line - 1] + column
        after = self.starts[line] if line < len(self.starts) else self.size + 1
        return place if place < after else self.size

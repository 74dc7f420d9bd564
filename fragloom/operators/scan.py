"""The ordered scan that cuts one file into fragments: an event fold with one set of rules per collection and kind of file.

Fragments form a chain: each starts where the one before ends, the first at byte 0, the last ends with the file. Where a cut
would leave nothing but white space, the white space joins the next fragment, so nothing is lost.
"""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

from fragloom import schema
from fragloom.operators.xmltokens import Lines, Token, XmlError, tokens, unescape

HEADER, SUTTA = "Header", "Sutta"
#: A slice holds text of a section if one of these is in it.
_SECTION_MARKS = (b'rend="subhead"', b'rend="chapter"', b'rend="bodytext"')


class CriticalError(ValueError):
    """Stops the whole run, unlike an error of one file."""


class Level(NamedTuple):
    group_type: str
    title: str
    id: str | None

    def row(self) -> dict:
        return {"group_type": self.group_type, "group_number": None, "title": self.title, "id": self.id}


def numeric(text: str) -> bool:
    return bool(text) and all(unicodedata.category(c)[0] == "N" for c in text)


def number_or_range(text: str) -> bool:
    return all(map(numeric, text.split("-")))


def leading_number(title: str) -> str | None:
    """`5-7` of `5-7. Title` or `5-7.Title`; None without the full stop."""
    first = title.split(maxsplit=1)[:1]
    if first and first[0].endswith(".") and number_or_range(first[0][:-1]):
        return first[0][:-1]
    m = re.match(r"([0-9]+(?:-[0-9]+)*)\.", title)
    return m[1] if m else None


def is_commentary(cst_file: str) -> bool:
    return cst_file.endswith((".att.xml", ".tik.xml"))


def opens_section(text: str, nikaya: str, cst_file: str) -> bool:
    """Whether a subhead with this text opens a section."""
    if not is_commentary(cst_file):
        return leading_number(text) is not None
    if text.endswith(schema.SECTION_ENDINGS):
        return True
    return nikaya == "samyutta" and leading_number(text) is not None and text.endswith(schema.NUMBERED_ENDINGS)


#: (tag, rend) or ("div", type) to level, for all collections and then for some. Fixed values.
_LEVELS = {("p", "nikaya"): "Nikaya", ("head", "nikaya"): "Nikaya", ("p", "book"): "Book", ("head", "book"): "Book"} | {
    ("div", kind): kind.capitalize() for kind in ("book", "samyutta", "pannasaka", "vagga", "sutta")
}
_LEVELS_OF = {
    ("head", "title"): {"anguttara": "Pannasaka"},
    ("head", "chapter"): {"digha": "Sutta", "samyutta": "Samyutta", "majjhima": "Vagga", "anguttara": "Vagga", "khuddaka": "Vagga"},
    ("p", "title"): {"samyutta": "Vagga", "anguttara": "Pannasaka"},
    ("p", "chapter"): {"anguttara": "Vagga"},
    ("p", "subhead"): {"majjhima": "Sutta", "samyutta": "Sutta", "anguttara": "Sutta"},
}


def boundary(tag: str, attrs: dict[str, str], nikaya: str) -> tuple[str, str | None] | None:
    """(level, id) that an element opens."""
    mark = (tag, attrs.get("type" if tag == "div" else "rend", ""))
    level = _LEVELS.get(mark) or _LEVELS_OF.get(mark, {}).get(nikaya)
    return (level, attrs.get("id") if tag == "div" else None) if level else None


def section_start(tag: str, attrs: dict[str, str], nikaya: str, cst_file: str) -> bool:
    """Whether an element may open a section."""
    div, chapter, subhead = tag == "div" and attrs.get("type") == "sutta", tag == "head" and attrs.get("rend") == "chapter", tag == "p" and attrs.get("rend") == "subhead"
    if nikaya == "digha":
        return chapter if is_commentary(cst_file) else div
    return subhead if nikaya in ("majjhima", "samyutta", "anguttara") else div or subhead


class Hierarchy:
    """The path of levels at a place."""

    def __init__(self, nikaya: str):
        self.order, self.path = schema.LEVELS[nikaya], ()

    def enter(self, kind: str, title: str, id_: str | None) -> None:
        if kind not in self.order:
            return
        kinds = [x.group_type for x in self.path]
        if kind == "Nikaya" and self.path:
            # It may stand inside the book: it goes on top and drops nothing.
            self.path = (Level(kind, title, id_), *(self.path[1:] if kinds[0] == kind else self.path))
        elif kind in kinds:
            at = kinds.index(kind)
            old = self.path[at]
            below = () if id_ is not None or old.title != title else self.path[at + 1 :]
            self.path = (*self.path[:at], Level(kind, title, old.id if id_ is None else id_), *below)
        else:
            self.path = (*self.path[: self.order.index(kind)], Level(kind, title, id_))


class Fold:
    """What the scan knows between events. Positions are bytes."""

    def __init__(self, content: str, nikaya: str, cst_file: str, overrides: dict[str, dict], inserted: list[dict]):
        self.raw, self.nikaya, self.cst_file = content.encode(), nikaya, cst_file
        self.lines, self.hierarchy = Lines(self.raw), Hierarchy(nikaya)
        self.overrides, self.inserted = overrides, {}
        for row in sorted(inserted, key=lambda r: parse_index(r["frag_idx_code"])):
            major, minor = parse_index(row["frag_idx_code"])
            if minor > 0:
                self.inserted.setdefault(major, []).append(row)
        comment = is_commentary(cst_file)
        self.deferring = nikaya == "samyutta" and comment  # groups wait for the section that they introduce
        self.clearing = nikaya == "samyutta" and not comment  # headings of a group belong to its first section
        self.out: list[dict] = []
        self.start, self.kind, self.levels = 0, HEADER, self.hierarchy.path
        self.in_body = self.seen_body = self.seen_section = self.seen_group = False
        self.title: tuple[str, str | None] | None = None
        self.subhead: int | None = None
        self.section_div: int | None = None
        self.vagga_div: int | None = None
        self.vagga_title: int | None = None
        self.vagga_waiting: tuple[str, str | None] | None = None
        self.group_div: int | None = None
        self.group_waiting: tuple[str, str | None] | None = None

    # -- cutting

    def adjusted(self, at: int) -> tuple[int, int, bool]:
        """(end, start of the next, collapsed) of the open fragment, corrections applied."""
        index = len(self.out)
        fix = self.overrides.get(f"{index}.0") or {}
        if fix.get("collapse"):
            return self.start, self.start, True
        own = fix.get("end_line") is not None
        end = self.lines.byte(fix["end_line"], fix.get("end_char") or 0) if own else at
        after = self.inserted.get(index)
        if after and not own:
            end = min(end, self.lines.byte(after[0]["start_line"], after[0]["start_char"]))
        if end < self.start:
            raise CriticalError(f"{self.cst_file} {index}.0: its end, byte {end}, lies before its start, byte {self.start}")
        return end, self.lines.byte(after[-1]["end_line"], after[-1]["end_char"]) if after else end, False

    def cut(self, at: int) -> int:
        """Ends the open fragment at a byte, or where corrections say, and opens the next. Returns the end."""
        end, chain, collapsed = self.adjusted(at)
        content = self.raw[self.start : end]
        if collapsed or content.strip():
            (line, column), (to_line, to_column) = self.lines.at(self.start), self.lines.at(end)
            self.out.append(
                {
                    "frag_idx_code": f"{len(self.out)}.0", "frag_type": self.kind or SUTTA, "content_xml": content.decode(), "levels": self.levels,
                    "start_line": line, "start_char": column, "end_line": to_line, "end_char": to_column,
                }
            )
            self.start = chain
        return end

    def has_section(self, at: int) -> bool:
        if self.start >= at:
            # Corrections pushed the start past this place: cutting keeps the numbering of later fragments.
            return self.nikaya == "anguttara"
        part = self.raw[self.start : at]
        return any(m in part for m in _SECTION_MARKS)

    def refresh(self) -> None:
        self.levels = self.hierarchy.path

    def take(self, name: str):
        value = getattr(self, name)
        setattr(self, name, None)
        return value

    # -- events

    def opened(self, t: Token) -> None:
        if t.name == "body" and not self.seen_body:
            self.cut(t.end)
            self.kind, self.seen_body, self.in_body = SUTTA, True, True
            self.refresh()
        found = boundary(t.name, t.attrs, self.nikaya)
        if found and t.name == "div" and found[1] is not None:
            self.group(t, *found)
        elif found:
            self.heading(t, *found)
        if t.name == "div":
            if self.nikaya == "digha" and is_commentary(self.cst_file) and t.attrs.get("type") == "sutta":
                self.section_div = t.start
            if self.nikaya in ("majjhima", "samyutta") and t.attrs.get("type") == "vagga":
                self.vagga_div = t.start
        if section_start(t.name, t.attrs, self.nikaya, self.cst_file):
            if t.name == "p" and self.nikaya in ("majjhima", "samyutta", "anguttara"):
                self.subhead = t.start  # its text decides
            elif self.seen_section:
                place = self.take("section_div")
                self.cut(t.start if place is None or place < self.start else place)
                self.kind = SUTTA
                self.refresh()
            elif self.in_body:
                self.seen_section = True

    def group(self, t: Token, level: str, id_: str) -> None:
        """A division with an id. The first vagga or section keeps what precedes it."""
        if level in ("Vagga", "Sutta") and not self.seen_group:
            self.seen_group = True
        elif self.deferring and level == "Samyutta" and self.in_body and self.seen_section:
            self.flush_group()
            self.group_div, self.group_waiting = t.start, ("", id_)
            return
        elif level in ("Samyutta", "Vagga", "Sutta") and not (self.deferring and level == "Samyutta") and self.in_body and self.kind == SUTTA and self.has_section(t.start):
            self.cut(t.start)
            self.kind = None if self.clearing and level == "Samyutta" else SUTTA
        self.hierarchy.enter(level, "", id_)
        self.refresh()

    def flush_group(self) -> None:
        """A waiting group that no section has taken ends where it began."""
        place = self.take("group_div")
        if place is not None and self.kind == SUTTA and self.start < place:
            self.cut(place)
            if waiting := self.take("group_waiting"):
                self.hierarchy.enter("Samyutta", *waiting)
            self.refresh()

    def heading(self, t: Token, level: str, id_: str | None) -> None:
        """An element whose text will be a title."""
        paragraph, rend = t.name == "p", t.attrs.get("rend")
        vagga_title = self.nikaya == "samyutta" and paragraph and rend == "title"
        if ((self.nikaya == "anguttara" and paragraph and rend == "chapter") or (vagga_title and self.clearing)) and self.in_body:
            if not self.seen_group:
                self.seen_group = True
            elif self.kind == SUTTA and self.has_section(t.start):
                end = self.cut(t.start)
                if vagga_title:
                    self.vagga_title = end
        if vagga_title and self.deferring and self.in_body and self.seen_section:
            self.vagga_title, self.vagga_waiting = t.start, ("", id_)
        elif not (level == "Sutta" and paragraph and rend == "subhead"):
            self.title = (level, id_)

    def place_of_section(self, subhead: int) -> tuple[int, bool]:
        """Where the section that a subhead opens begins, and whether it takes the waiting group. Places before the open
        fragment are stale: the subhead's own counts."""

        def first_of(*names: str) -> int:
            for name in names:
                if (place := self.take(name)) is not None:
                    return subhead if place < self.start else place
            return subhead

        if not self.deferring:
            return first_of("vagga_div", "vagga_title") if self.clearing else first_of("vagga_div"), False
        if (place := self.take("group_div")) is not None:
            if self.start < place:
                self.vagga_title = self.vagga_waiting = self.vagga_div = None
                return place, True
            self.group_waiting = None
            return subhead, False
        if (place := self.take("vagga_title")) is not None:
            if self.start < place:
                return place, False
            self.vagga_waiting = None
        return first_of("vagga_div"), False

    def text(self, t: Token) -> None:
        text = unescape(t.text).strip()
        subhead = self.take("subhead")
        if subhead is not None and opens_section(text, self.nikaya, self.cst_file):
            if self.seen_section:
                place, takes_group = self.place_of_section(subhead)
                if self.kind is not None:
                    self.cut(place)
                if takes_group and (waiting := self.take("group_waiting")):
                    self.hierarchy.enter("Samyutta", *waiting)
                if (waiting := self.take("vagga_waiting")) and waiting[0]:
                    self.hierarchy.enter("Vagga", *waiting)
                self.hierarchy.enter("Sutta", text, None)
                self.kind = SUTTA
                self.refresh()
            elif self.in_body:
                self.seen_section, self.vagga_div = True, None
                self.hierarchy.enter("Sutta", text, None)
                self.kind = self.kind or SUTTA
                self.refresh()
        if self.vagga_waiting and text:
            self.vagga_waiting = (text, self.vagga_waiting[1])
        title = self.take("title")
        if title and text:
            level, id_ = title
            if level == "Samyutta" and self.group_div is not None:
                self.group_waiting = (text, (self.group_waiting or ("", None))[1] or id_)
                return
            self.hierarchy.enter(level, text, id_)
            of_next = self.clearing and level in ("Vagga", "Samyutta") and self.kind == SUTTA and any(x.group_type == level for x in self.levels)
            if not of_next:
                self.refresh()

    def closed(self, t: Token) -> None:
        if t.name == "body" and self.seen_body:
            self.cut(t.start)
            self.kind, self.in_body = HEADER, False
            self.refresh()

    def run(self) -> list[dict]:
        for t in tokens(self.raw):
            if t.kind in ("start", "empty"):
                self.opened(t)
            elif t.kind == "text":
                self.text(t)
            elif t.kind == "end":
                self.closed(t)
        self.cut(len(self.raw))
        return self.out


def parse_index(code: str) -> tuple[int, int]:
    """(major, minor) of a fragment index like `21.3`; anything else is an error."""
    parts = code.split(".")
    if len(parts) != 2 or not all(p.isascii() and p.isdigit() for p in parts):
        raise ValueError(f"not a fragment index: {code!r}")
    return int(parts[0]), int(parts[1])


# -- fields derived from a fragment


def titled_text(content: str, tags: tuple[str, ...], rend: str) -> str | None:
    """Text right after the first `<tag rend=...>` that begins with a number."""
    wanted = False
    for t in tokens(content.encode(), strict=False):
        if wanted and t.kind == "text":
            try:
                text = unescape(t.text).strip()
            except XmlError:
                text = ""
            if text and numeric(text[0]):
                return text
        wanted = t.kind == "start" and t.name in tags and t.attrs.get("rend") == rend
    return None


def vagga_title(content: str) -> str | None:
    return titled_text(content, ("head",), "chapter")


def section_title(content: str) -> str | None:
    return titled_text(content, ("head", "p"), "subhead") or titled_text(content, ("head",), "chapter")


def first_paragraph_number(content: str) -> str | None:
    """`n` of the first body paragraph that has one."""
    for t in tokens(content.encode(), strict=False):
        if t.kind in ("start", "empty") and t.name == "p" and t.attrs.get("rend") == "bodytext" and "n" in t.attrs:
            return t.attrs["n"]
    return None


def _tail_number(id_: str | None) -> str | None:
    tail = (id_ or "").rpartition("_")[2]
    return tail if numeric(tail) else None


def cst_code(levels: tuple[Level, ...], nikaya: str, cst_file: str, title: str | None) -> str | None:
    """The dotted code of a fragment: its section's id, or the book's id and the numbers of the levels below."""
    first = {x.group_type: x for x in reversed(levels)}
    last = {x.group_type: x for x in levels}
    for level in levels:
        if level.group_type == "Sutta" and level.id is not None:
            return level.id.replace("_", ".")
    book = next((x.id for x in levels if x.group_type == "Book" and x.id is not None), None)
    if book is None:
        return None
    inner = last if nikaya == "samyutta" and cst_file.endswith(".mul.xml") else first

    def single(kind: str) -> str | None:
        """Of a group: a number before a full stop and white space, or the end of its id."""
        level = first.get(kind)
        if level is None:
            return None
        word = level.title.split(maxsplit=1)[:1]
        return word[0][:-1] if word and word[0].endswith(".") and numeric(word[0][:-1]) else _tail_number(level.id)

    vagga = inner.get("Vagga")
    vagga_no = (leading_number(vagga.title) or _tail_number(vagga.id)) if vagga else None
    section = inner.get("Sutta")
    number = (leading_number(section.title) if section else None) or (leading_number(title) if title else None)
    if nikaya == "majjhima":
        parts = (vagga_no, number or "0") if vagga_no else None
    elif nikaya == "samyutta":
        group = single("Samyutta")
        parts = (group, vagga_no or "1", number or "0") if group is not None and (vagga_no or number) else None
    elif nikaya == "anguttara":
        group = single("Pannasaka")
        parts = (group, vagga_no, number or "0") if group is not None and vagga_no else None
    else:
        parts = (number,) if number else None
    return ".".join((book, *parts)) if parts else None


def derived(row: dict, nikaya: str, cst_file: str) -> dict:
    """cst_code, cst_vagga, cst_sutta and cst_paranum of a fragment; nulls for headers."""
    if row["frag_type"] != SUTTA:
        return dict.fromkeys(("cst_code", "cst_vagga", "cst_sutta", "cst_paranum"))
    levels, content = row["levels"], row["content_xml"]
    last = nikaya == "samyutta" and cst_file.endswith(".mul.xml")
    path = levels[::-1] if last else levels
    named = {k: next((x.title for x in path if x.group_type == k), "") for k in ("Vagga", "Sutta")}
    vagga = None
    if "Vagga" in schema.LEVELS[nikaya]:
        vagga = named["Vagga"] if named["Vagga"].strip() else None if last else vagga_title(content)
    section = named["Sutta"] if named["Sutta"].strip() else section_title(content)
    return {"cst_code": cst_code(levels, nikaya, cst_file, section), "cst_vagga": vagga, "cst_sutta": section, "cst_paranum": first_paragraph_number(content)}


def segment(content: str, nikaya: str, cst_file: str, overrides: dict[str, dict] | None = None, inserted: list[dict] | None = None) -> list[dict]:
    """Fragments of one file, in order, with the derived fields; corrected fragments have the boundaries that were given."""
    rows = Fold(content, nikaya, cst_file, overrides or {}, inserted or []).run()
    for row in rows:
        row |= derived(row, nikaya, cst_file)
        row["group_levels"] = [x.row() for x in row.pop("levels")]
        row |= {"cst_file": cst_file, "nikaya": nikaya, "frag_review": None, "sc_code": None, "sc_sutta": None}
    return rows

"""Row-by-row versions of the rules that the engine states as columns: what tests compare it with."""

from __future__ import annotations

import re
from typing import NamedTuple

_SC = r"^([a-z]{2})(\d+)(?:\.(\d+))?$"
_RANGE = r"^(.*(?:^|\.)[0-9]+)-([0-9]+)$"


class Sc(NamedTuple):
    prefix: str
    group: int | None
    number: int | None


def parse_sc(code: str) -> Sc | None:
    m = re.match(_SC, code)
    if not m:
        return None
    grouped = m[1] in ("sn", "an")
    return Sc(m[1], int(m[2]) if grouped else None, int(m[3]) if grouped and m[3] else None if grouped else int(m[2]))



def parse_cst_range(code: str) -> tuple[str, int] | None:
    m = re.match(_RANGE, code)
    return (m[1], int(m[2])) if m else None



def widened(sc: str, cst: str) -> str:
    span, base = parse_cst_range(cst), sc.split("-")[0]
    if not span or "." not in span[0] or "." not in base:
        return sc
    size = span[1] - int(span[0].rpartition(".")[2])
    head, _, tail = base.rpartition(".")
    start = int(tail) if tail.isdigit() else 1
    return f"{head}.{start}-{start + size}" if size > 0 else sc



def sc_from_previous(cst: str, previous_sc: str, previous_cst: str | None) -> str | None:
    """[C17] The sc code that follows previous_sc, for a cst code of four parts or more."""
    whole = lambda c: (parse_cst_range(c) or (c, None))
    number = lambda parts, k: int(parts[k]) if len(parts) > 3 and re.fullmatch(r"[+-]?\d+", parts[k]) else None
    base, end = whole(cst)
    parts = base.split(".")
    group, first = number(parts, 1), number(parts, 3)
    if group is None or first is None:
        return None
    last = parse_sc(previous_sc)
    if last is None:
        head, dash, tail = previous_sc.partition("-")
        last = parse_sc(head) if dash and tail.isdigit() else None
        last = last and last._replace(number=int(tail))
    if last is None or last.number is None:
        return None
    if last.prefix in ("dn", "mn"):
        return f"{last.prefix}{first}" if first == last.number + 1 else None
    if last.prefix not in ("sn", "an") or last.group is None:
        return None
    code = lambda g, start, stop: f"{last.prefix}{g}.{start}" + (f"-{stop}" if end is not None else "")
    before = number(whole(previous_cst)[0].split("."), 1) if previous_cst and last.prefix == "sn" else None
    if before is not None:
        start = last.number + 1
        return code(last.group, start, start + (end or 0) - first) if before == group else code(last.group + 1, 1, end)
    if (first == 1 and last.number != 0) or first < last.number:
        return code(last.group + 1, 1, end)
    return code(last.group, first, end) if first == last.number + 1 else None


def propagated(rows: list[dict], titles: dict[str, str]) -> list[tuple[str | None, str | None]]:
    """(sc_code, sc_sutta) of a file's rows in order."""
    ranges = {uid.split("-")[0]: uid for uid in sorted(titles, reverse=True) if "-" in uid}
    codes, sutta, cst = ([r[c] for r in rows] for c in ("sc_code", "sc_sutta", "cst_code"))
    for i in range(1, len(rows)):
        if codes[i] is not None or cst[i] is None or codes[i - 1] is None:
            continue
        new = sc_from_previous(cst[i], codes[i - 1], cst[i - 1])
        if new is None:
            continue
        if parse_cst_range(cst[i]):
            new = widened(new, cst[i])
            title = titles.get(new, titles.get(new.split("-")[0]))
            found = (new, title) if title is not None else None
        else:
            uid = new if new in titles else ranges.get(new)
            found = (uid, titles[uid]) if uid else None
        if found:
            codes[i], sutta[i] = found
    return list(zip(codes, sutta))

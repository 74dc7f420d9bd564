"""Logs of edits folded in the JVM against edits of lists in plain Python, and against the edits of one file."""

import random

from pyspark.sql import functions as F

from fragloom import schema
from fragloom.operators import edit_log, edits
from tests.test_operators import fragment


def index(row):
    return tuple(map(int, row["frag_idx_code"].split(".")))


def merged(row, other, prev):
    a, b = (other, row) if prev else (row, other)
    return other | {"content_xml": a["content_xml"] + b["content_xml"], "start_line": a["start_line"], "start_char": a["start_char"], "end_line": b["end_line"], "end_char": b["end_char"]}


def applied(rows, e):
    """(rows, reason) of rows in order."""
    rows = [dict(r) for r in rows]
    action, direction, nudge = e["action"], e["direction"], e["nudge"]
    if action not in edit_log.ACTIONS or (action != "delete" and direction not in ("prev", "next")) or (action == "nudge" and nudge not in edits.ACTIONS):
        return rows, "no such edit"
    i = next((k for k, r in enumerate(rows) if r["frag_idx_code"] == e["frag_idx_code"]), None)
    if i is None:
        return rows, f"no fragment {e['frag_idx_code']}"
    near = {"prev": next((k for k in range(i - 1, -1, -1) if rows[k]["frag_review"] != "moved"), None), "next": next((k for k in range(i + 1, len(rows)) if rows[k]["frag_review"] != "moved"), None)}
    if action == "delete":
        direction = "prev" if near["prev"] is not None else "next"
    j, prev, row = near[direction], direction == "prev", rows[i]
    other = rows[j] if j is not None else None
    if other is None and action in ("move", "merge", "nudge"):
        return rows, f"no {direction} fragment"
    if action == "merge" and index(row)[1] == 0:
        return rows, "a generated fragment cannot be merged away"
    if action == "move":
        rows[j] = merged(row, other, prev)
        rows[i] = row | dict.fromkeys(schema.CODES) | {"content_xml": "", "frag_review": "moved"} | dict.fromkeys(("start_line", "start_char", "end_line", "end_char"), 0)
    elif action in ("merge", "delete"):
        if other is not None:
            rows[j] = merged(row, other, prev)
        del rows[i]
    elif action == "insert":
        if row["frag_review"] == "moved":
            return rows, "nothing can be inserted next to a moved fragment"
        major = (index(other)[0] if other else index(row)[0] - 1) if prev else index(row)[0]
        if major < 0:
            return rows, "nothing can be inserted before the first fragment"
        free = next(n for n in range(1, 1000) if (major, n) not in map(index, rows))
        side = "start" if prev else "end"
        at = {"start_line": row[f"{side}_line"], "start_char": row[f"{side}_char"]}
        if not prev and other:
            rows[j] = other | at | {"frag_review": other["frag_review"] or "checked"}
        source = (other or row) if prev else row
        rows.append(source | at | {"frag_idx_code": f"{major}.{free}", "frag_review": "checked", "content_xml": "", "end_line": at["start_line"], "end_char": at["start_char"]})
        rows.sort(key=index)
    elif action == "create":
        middle, at = (row["start_line"] + row["end_line"]) // 2, index(row)
        new = row | {"frag_type": "Sutta", "frag_review": None, "cst_paranum": None, "content_xml": "<!-- New fragment content -->"}
        up = lambda r: r | {"frag_idx_code": f"{index(r)[0] + 1}.{index(r)[1]}"}
        rows = [up(r) if index(r) > at or (prev and r is row) else r for r in rows]
        if prev:
            rows[i] |= {"start_line": middle, "start_char": 0}
            new |= {"end_line": middle, "end_char": 0}
        else:
            rows[i] = rows[i] | {"end_line": middle, "end_char": 0}
            new |= {"frag_idx_code": f"{at[0] + 1}.0", "start_line": middle, "start_char": 0}
        rows = [r for r in rows if index(r) < index(new)] + [new] + [r for r in rows if index(r) >= index(new)]
    else:
        first, second = (other, row) if prev else (row, other)
        a, b = first["content_xml"], second["content_xml"]
        cut = {"line_up": a.rfind("\n") if "\n" in a else len(a), "line_down": len(a) + b.find("\n") + 1, "char_left": len(a) - (1 if a and first["end_char"] > 0 else 0), "char_right": len(a) + (1 if b else 0)}[nudge]
        a, b = (a + b)[:cut], (a + b)[cut:]
        line, column = first["start_line"] + a.count("\n"), len(a.rpartition("\n")[2].encode()) + (0 if "\n" in a else first["start_char"])
        checked = lambda r: "checked" if r["frag_review"] is None else r["frag_review"]
        rows[j if prev else i] = first | {"content_xml": a, "end_line": line, "end_char": column, "frag_review": checked(first)}
        rows[i if prev else j] = second | {"content_xml": b, "start_line": line, "start_char": column, "frag_review": checked(second)}
    return rows, None


def made(draw, files):
    rows = []
    for f in range(files):
        for i in range(draw.randrange(1, 7)):
            for minor in range(draw.choice((1, 1, 2))):
                text = "".join(draw.choices("ab\né😀", k=draw.randrange(6)))
                rows.append(fragment(f"{i}.{minor}", cst_file=f"{f}.xml", content_xml=text, frag_review=draw.choice((None, "", "checked", "moved", "x")), cst_code=f"c{i}", start_line=i + 1, start_char=draw.randrange(3), end_line=i + draw.randrange(1, 9), end_char=draw.randrange(3)))
    return rows


def test_logs_fold_as_lists_do(spark):
    draw = random.Random(21)
    rows = [r if isinstance(r, dict) else dict(zip(schema.COLUMNS, r)) for r in made(draw, 120)]
    log = []
    for f in range(0, 125):
        for seq in range(draw.randrange(8)):
            code = f"{draw.choice((0, 1, 2, 3, 4, 9))}.{draw.choice((0, 0, 0, 1, 2))}"
            log.append((f"{f}.xml", seq * 2, draw.choice((*edit_log.ACTIONS, *edit_log.ACTIONS, "odd")), code, draw.choice(("prev", "next", "prev", "next", "up")), draw.choice((*edits.ACTIONS, None))))
    expected, refused = [], []
    for name in sorted({f"{f}.xml" for f in range(125)}):
        own = sorted((r for r in rows if r["cst_file"] == name), key=index)
        for e in sorted((dict(zip(("cst_file", "seq", "action", "frag_idx_code", "direction", "nudge"), e)) for e in log if e[0] == name), key=lambda e: e["seq"]):
            own, reason = applied(own, e)
            refused += [(name, e["seq"], reason)] if reason else []
        expected += own
    shown = ["cst_file", "frag_idx_code", "frag_type", "frag_review", "content_xml", "cst_code", "cst_paranum", "start_line", "start_char", "end_line", "end_char"]
    fragments = spark.createDataFrame([tuple(r[c] for c in schema.COLUMNS) for r in rows], schema.FRAGMENT)
    done = edit_log.folded(fragments, spark.createDataFrame(draw.sample(log, len(log)), edit_log.LOG)).cache()
    assert sorted(map(str, (tuple(r) for r in edit_log.rejected(done).collect()))) == sorted(map(str, refused)) and len(refused) > 50
    assert sorted(str(tuple(r)) for r in edit_log.fragments_of(fragments, done).select(*shown).collect()) == sorted(str(tuple(r[c] for c in shown)) for r in expected)
    assert "Python" not in done._jdf.queryExecution().toString()


def test_one_file_alike(spark):
    """The edits of edits.py on one file, one after another, and the log of them."""
    rows = [r if isinstance(r, dict) else dict(zip(schema.COLUMNS, r)) for r in (fragment(f"{i}.0", content_xml=f"line {i}\nend{i}", start_line=i + 1, start_char=0, end_line=i + 2, end_char=3) for i in range(4))]
    fragments = spark.createDataFrame([tuple(r[c] for c in schema.COLUMNS) for r in rows], schema.FRAGMENT)
    one = edits.delete(edits.insert(edits.move_content(edits.nudge(fragments, "1.0", "prev", "line_up"), "2.0", "prev", True), "0.0", "next"), "3.0", True)
    name = rows[0]["cst_file"]
    log = spark.createDataFrame([(name, 1, "nudge", "1.0", "prev", "line_up"), (name, 2, "move", "2.0", "prev", None), (name, 3, "insert", "0.0", "next", None), (name, 4, "delete", "3.0", None, None)], edit_log.LOG)
    both = edit_log.fragments_of(fragments, edit_log.folded(fragments, log, compat=True))
    assert sorted(map(str, both.collect())) == sorted(map(str, one.select(*schema.COLUMNS).collect()))
    assert edit_log.folded(fragments, log.limit(0)).select(F.explode("rejected")).count() == 0

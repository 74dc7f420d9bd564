"""Codes, lookups, checks, edits, diff, store and runs."""

import random

import pytest
from pyspark.sql import functions as F

from fragloom import config, log, schema
from fragloom.functions import codes as cd
from fragloom.functions import text as tx
from fragloom.operators import checks, diff, edits, lookups, ordered, propagation, segment
from fragloom.operators.scan import CriticalError
from fragloom.plans import runs
from fragloom.sources import files as fs
from fragloom.sources.store import Conflict, FragmentStore, downgraded, upgraded
from fragloom.streaming.inbox import absorb, arrivals, watch
from tests import plain_fold
from tests.test_scan import ANGUTTARA, DIGHA, MAJJHIMA, SAMYUTTA


def values(spark, data, column, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(data)], f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def fragment(code, **more):
    row = dict.fromkeys(schema.COLUMNS) | {"cst_file": "a.xml", "frag_idx_code": code, "frag_type": "Sutta", "nikaya": "samyutta", "content_xml": "", "start_line": 1, "start_char": 0, "end_line": 1, "end_char": 0, "group_levels": []}
    return tuple((row | more)[c] for c in schema.COLUMNS)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), schema.FRAGMENT)


# -- codes


def test_index_helpers(spark):
    assert [tuple(x) for x in values(spark, ["21.3", "0.0"], cd.index_parts)] == [(21, 3), (0, 0)]
    rows = spark.createDataFrame([("21.10",), ("21.9",), ("3.0",)], "x string")
    assert [r["x"] for r in rows.orderBy(*cd.version_order(F.col("x"))).collect()] == ["3.0", "21.9", "21.10"]
    assert values(spark, [[0, 2], [0], [1, 2, 3]], cd.next_minor, "array<int>") == [1, 1, 4]
    assert values(spark, ["21.3"], cd.next_index) == ["22.0"]
    for bad in ("21", "a.b", "1.2.3"):
        with pytest.raises(Exception, match="not a fragment index"):
            values(spark, [bad], cd.index_parts)


def test_sc_codes(spark):
    got = values(spark, ["dn1", "mn41", "sn5.1", "an3.1", "sn12.93-103", "xx7", "s5", "sn5"], cd.sc_parts)
    assert [tuple(g) if g else None for g in got] == [("dn", None, None, 1), ("mn", None, None, 41), ("sn", 5, None, 1), ("an", None, 3, 1), None, ("xx", None, None, 7), None, ("sn", 5, None, None)]
    assert tuple(values(spark, ["sn12.93-103"], cd.sc_range_parts)[0]) == ("sn", 12, None, 103)
    assert values(spark, ["sn5.1", "an3.1", "dn1", "sn5"], lambda c: cd.format_sc(cd.sc_parts(c))) == ["sn5.1", "an3.1", "dn1", "sn5"]
    got = values(spark, ["dn1:1.2", "sn1.55-57", "an10", "10", "sn", "sn1.", "kp2.12-15"], cd.check_parts)
    assert [tuple(g) if g else None for g in got] == [("dn", None, 1, 1), ("sn", 1, 55, 57), ("an", None, 10, 10), None, None, None, ("kp", 2, 12, 15)]
    assert values(spark, ["sn1.55-57", "sn1.55", "dn1-3", "an1.1:2-3"], cd.is_sc_range) == [True, False, True, False]
    assert values(spark, ["sn1.55-57", "dn1-3", "sn1.5", "sn1.5:x"], cd.expand) == [["sn1.55", "sn1.56", "sn1.57"], ["dn1-3"], ["sn1.5"], ["sn1.5:x"]]
    assert [len(x) for x in values(spark, ["sn12.93-103", "sn23.1-60", "sn43.14-46"], cd.expand)] == [11, 60, 33]
    assert values(spark, ["sn30.3-12", "sn30.3"], cd.non_range_base) == ["sn30.3", None]


def test_ranges_of_cst_codes(spark):
    got = values(spark, ["sn3.2.3.1-11", "sn3.2.3.1", "5-7", "a.x-3", "sn1.1-2-3"], cd.cst_range)
    assert [tuple(g) if g else None for g in got] == [("sn3.2.3.1", 11), None, ("5", 7), None, None]
    pairs = [("sn23.23", "sn3.2.3.1-11"), ("sn23.23-30", "sn3.2.3.1-11"), ("sn5.1", "sn1.1.1.4"), ("dn2", "a.1-3"), ("sn5.1", "sn1.1.1.4-4")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, s string, c string")
    got = [r["w"] for r in rows.select("i", cd.widen(F.col("s"), F.col("c")).alias("w")).orderBy("i").collect()]
    assert got == ["sn23.23-33", "sn23.23-33", "sn5.1", "dn2", "sn5.1"] == [plain_fold.widened(*p) for p in pairs]


def test_codes_from_context_and_previous(spark):
    rows = spark.createDataFrame([("sn3.8.1.11-20", "sn", 29), ("sn1.2.1.5", "sn", 7), ("dn1.4", "dn", None), ("sn1.1.0", "sn", 7)], "c string, p string, g int")
    assert [r["x"] for r in rows.select(cd.sc_from_context(F.col("c"), F.col("p"), F.col("g"), F.col("g")).alias("x")).collect()] == ["sn29.11-20", "sn7.5", "dn4", None]
    f = plain_fold.sc_from_previous
    assert f("sn4.5.1.2", "sn39.1-15", "sn4.5.1.1") == "sn39.16"
    assert f("sn4.6.1.1", "sn39.16", "sn4.5.1.2") == "sn40.1"
    assert f("sn3.5.1.5", "sn25.1-10", "sn3.4.1.1-10") == "sn26.1"
    assert f("sn1.1.1", "sn1.1", None) is None and f("sn1.1.1.9", "sn1.3", None) is None
    assert f("sn1.1.1.4", "sn1.3", None) == "sn1.4" and f("an1.1.1.4-6", "an1.3", "an1.1.1.3") == "an1.4-6"
    assert f("sn1.1.1.4-6", "sn1.9", "sn1.1.1.3") == "sn1.10-12"


def test_text_functions(spark):
    assert values(spark, ["Dīghanikāyo", "DIGHA", "Saṃyuttanikāye", "?", None], tx.normal_name) == ["digha", "digha", "samyutta", None, None]
    assert values(spark, ["a.mul.xml", "a.ATT.XML", "a.tik.xml", "a.xml"], tx.file_kind) == ["mula", "atthakatha", "tika", "mula"]
    contents = ['<head rend="chapter">Intro</head><head n="1" rend="chapter">2. Sīla &amp; x</head><p n="7" rend="bodytext">t</p><p rend="subhead">Uddeso</p>', '<p rend="subhead">1. A</p><head rend="chapter">3. B</head><p rend="bodytext">x</p><p rend="bodytext" n="2-10">']
    from fragloom.operators import scan

    for column, plain in ((tx.vagga_title, scan.vagga_title), (tx.section_title, scan.section_title), (tx.first_paragraph_number, scan.first_paragraph_number)):
        assert values(spark, contents, column) == [plain(c) for c in contents]
    assert tx.rendered_html('<p rend="centre" n="3">a &lt;<hi rend="x">b</hi><note>c</note><pb ed="M" n="1"/></p><odd>t</odd>') == '<p class="centered"><span class="paranum">3</span> a &lt;<span class="x">b</span><span class="note">[c]</span><span class="pagebreak" data-ed="M" data-n="1"></span></p>\nt'
    assert tx.rendered_html('<div type="sutta" id="s"><head rend="chapter">T</head><hi>b</hi><trailer rend="e">z</trailer>') == '<div class="sutta" id="s"><h2>T</h2>\n<span class="bold">b</span><p class="e">z</p>\n'
    assert values(spark, ["a\n\n\n\nb", "a\n\nb"], tx.squeeze_lines) == ["a\n\nb", "a\n\nb"]
    assert values(spark, ["a\tb\nc\rd"], tx.escape_tsv) == ["a\\tb\\nc\\rd"]
    levels = [[("Book", None, "T", None)]]
    text = values(spark, levels, tx.levels_json, f"array<{schema.LEVEL.simpleString()}>")[0]
    assert text == '[{"group_type":"Book","group_number":null,"title":"T","id":null}]'
    assert values(spark, [text, "bad", None], lambda c: F.size(tx.json_levels(c))) == [1, 0, 0]


# -- lookups

TITLES = [("sn12.72-81", "a"), ("sn12.71", "b"), ("sn35.171-173", "c"), ("sn29.11-20", "d"), ("sn30.3", "e"), ("sn30.1", "f"), ("sn29.21-50", "g"), ("sn1.2", "h"), ("sn1.4", "i"), ("sn2.1", "j")]


def test_titles(spark):
    titles = spark.createDataFrame(TITLES, schema.TITLES)
    rows = spark.createDataFrame([("sn12.72",), ("sn12.81",), ("sn12.82",), ("sn12.50",), ("sn12.71",), ("sn35.172",), ("sn29.11",), ("sn30.3-12",)], "c string")
    assert sorted(r["c"] for r in lookups.in_titles(rows, titles, "c").collect()) == ["sn12.71", "sn12.72", "sn12.81", "sn29.11", "sn35.172"]
    found = {r["c"]: r["found_code"] for r in lookups.resolve(rows, titles, "c").collect()}
    assert found["sn29.11"] == "sn29.11-20" and found["sn30.3-12"] == "sn30.3" and found["sn12.82"] is None
    gone = lookups.missing_codes(rows.withColumn("k", F.col("c")), titles, "c", ["k"]).collect()
    assert {r["k"]: r["missing"] for r in gone} == {"sn12.82": ["sn12.82"], "sn12.50": ["sn12.50"], "sn30.3-12": [f"sn30.{i}" for i in range(4, 13)]}


def test_mapping_fills_and_widens(spark):
    mapping = spark.createDataFrame([("sn1.1.7.2", "sn1.62", "T62", 1), ("sn1.1.7.3", "sn1.63", "T63", 2), ("dn1.1", "dn9", "old", 3), ("dn1.1", "dn1", "1. B", 4), ("x", "", "", 5)], "cst_code string, code string, sutta string, row_idx long")
    rows = frame(spark, fragment("1.0", cst_code="sn1.1.7.2-3"), fragment("2.0", cst_code="dn1.1"), fragment("3.0", cst_code="dn1.1", sc_code="own"), fragment("4.0", cst_code="sn1.1.7.2-9"), fragment("5.0"))
    got = {r["frag_idx_code"]: (r["sc_code"], r["sc_sutta"]) for r in lookups.fill_sc(rows, lookups.code_map(mapping)).collect()}
    assert got == {"1.0": ("sn1.62-63", "T62"), "2.0": ("dn1", "1. B"), "3.0": ("own", None), "4.0": (None, None), "5.0": (None, None)}


def test_codes_propagate_from_filled_rows(spark):
    titles = spark.createDataFrame(TITLES, schema.TITLES)
    rows = frame(spark, fragment("1.0", cst_code="sn1.1.1.1", sc_code="sn1.1"), fragment("2.0", cst_code="sn1.1.1.2"), fragment("10.0", cst_code="sn1.2.1.1"), fragment("3.0", cst_code="sn1.1.1.3"), fragment("9.0", cst_code="sn1.1.1.4", sc_code="sn1.4"))
    got = {r["frag_idx_code"]: (r["sc_code"], r["sc_sutta"]) for r in propagation.propagate(rows, titles).collect()}
    assert got["2.0"] == ("sn1.2", "h") and got["3.0"] == (None, None) and got["10.0"] == ("sn2.1", "j")
    assert propagation.propagate(rows, None) is rows


def test_overrides_carry_their_group(spark):
    rows = frame(spark, *(fragment(f"{k}.0", cst_code=f"sn1.4.1.{k}" if k != 4 else "sn1.4.1.4-6", sc_code="sn9.9" if k == 6 else None) for k in range(1, 8)))
    fixes = spark.createDataFrame([tuple({"cst_file": "a.xml", "frag_idx_code": "2.0", "sc_code": "sn5.2", "frag_review": "checked", "frag_type": "Sutta"}.get(c) for c in schema.OVERRIDE.names)], schema.OVERRIDE)
    got = {r["frag_idx_code"]: r["sc_code"] for r in lookups.apply_overrides(rows, fixes, None).collect()}
    assert got == {"1.0": None, "2.0": "sn5.2", "3.0": "sn5.3", "4.0": "sn5.4-6", "5.0": "sn5.5", "6.0": "sn9.9", "7.0": None}
    titles = spark.createDataFrame([("sn5.3", "T3")], schema.TITLES)
    got = {r["frag_idx_code"]: (r["sc_code"], r["sc_sutta"]) for r in lookups.apply_overrides(rows, fixes, titles).collect()}
    assert got["3.0"] == ("sn5.3", "T3") and got["5.0"] == (None, None)
    none = spark.createDataFrame([], schema.TITLES)
    assert lookups.apply_overrides(rows, fixes, none).where("frag_idx_code = '3.0'").first()["sc_code"] is None


def test_carry_is_the_loop(spark):
    rng, rows, expected = random.Random(1), [], []
    for g in range(40):
        value = None
        for k in range(12):
            point, stop = rng.random() < 0.2, rng.random() < 0.2
            rows.append((g, k, point, stop))
            value = k if point else None if stop else value
            expected.append((g, k, value))
    df = spark.createDataFrame(rows, "g int, k int, p boolean, s boolean")
    got = ordered.carry(df, ["g"], ["k"], F.col("p"), F.col("k"), F.col("s"), "v")
    assert sorted((r["g"], r["k"], r["v"]) for r in got.collect()) == expected or sorted(map(str, expected)) == sorted(str((r["g"], r["k"], r["v"])) for r in got.collect())


def test_title_codes(spark):
    mapping = spark.createDataFrame([("s1m.mul.xml", "1. V", "1. Asuttaṃ", "sn1.1", 1), ("s1m.mul.xml", "2. V", "1. Asuttaṃ", "sn1.2", 2)], "cst_file string, cst_vagga string, cst_sutta string, code string, row_idx long")
    rows = spark.createDataFrame([("s1a.att.xml", 1, "2. V", "7. Asuttavaṇṇanā"), ("s1m.mul.xml", 2, "1. V", "1. Asuttaṃ"), ("s1m.mul.xml", 3, None, "zzz")], "cst_file string, seq int, cst_vagga string, cst_sutta string")
    assert {(r["cst_file"], r["code"]) for r in lookups.find_codes(rows, mapping).collect()} == {("s1a.att.xml", "sn1.2"), ("s1m.mul.xml", "sn1.1")}


# -- checks


def messages(found):
    return {r["frag_idx_code"]: r["message"] for r in found.collect()}


def test_sequence_check(spark):
    codes = ["sn1.1", "sn1.2-4", "sn1.5", "sn1.7", None, "??", "sn2.1", "sn3.2", "sn5.1", "dn1", "dn2", "dn4-5", "dn6"]
    rows = frame(spark, *(fragment(f"{k}.0", sc_code=c) for k, c in enumerate(codes)))
    assert messages(checks.code_sequence(rows)) == {
        "3.0": "Sutta number jump from sn1.5 to sn1.7 - expected step of 1", "5.0": "Cannot parse sc_code '??' format", "7.0": "Group changed from 2 to 3 but sutta starts at 2 instead of 1",
        "8.0": "Group jump from 3 to 5 - expected step of 1", "9.0": "Nikaya changed from 'sn' to 'dn' - expected same nikaya within file", "11.0": "Sutta number jump from dn2 to dn4-5 - expected step of 1",
    }
    one = frame(spark, fragment("1.0", sc_code="sn1.1"), fragment("2.0", sc_code="sn1.3", frag_review="checked"), fragment("3.0", sc_code="sn4"))
    assert set(messages(checks.code_sequence(one))) == {"3.0"} and set(messages(checks.code_sequence(one, True))) == {"2.0", "3.0"}


def test_other_checks(spark):
    rows = frame(
        spark, fragment("0.0", frag_type="Header"), fragment("1.0", sc_code="sn1.1", cst_code="a.1"), fragment("2.0", sc_code="sn1.1", cst_code="a.1-2"), fragment("3.0", sc_code="", frag_review="needs-review"),
        fragment("4.0", sc_code="sn1.1", frag_review="moved"), fragment("5.0", frag_review="checked"), fragment("6.0", sc_code="sn9.1-2", sc_sutta="t"), fragment("7.0", frag_review="unchecked", sc_code="sn8.1"),
    )
    assert set(messages(checks.missing_sc_code(rows))) == {"3.0"} and set(messages(checks.missing_sc_code(rows, True))) == {"3.0", "5.0"}
    assert set(messages(checks.missing_sc_sutta(rows))) == {"1.0", "2.0", "7.0"}
    assert set(messages(checks.review_status(rows))) == {"3.0", "7.0"}
    assert messages(checks.code_uniqueness(rows)) == {k: "Duplicate sc_code 'sn1.1' found (appears 2 times in this file)" for k in ("1.0", "2.0")}
    assert set(messages(checks.range_consistency(rows))) == {"2.0"}
    titles = spark.createDataFrame([("sn1.1", "x"), ("sn9.1", "y"), ("sn8.1-3", "z")], schema.TITLES)
    assert messages(checks.not_in_titles(rows, titles)) == {"6.0": "sc_code 'sn9.2' not found in titles"}
    assert messages(checks.not_in_titles(rows, None)) == {} and len(messages(checks.not_in_titles(rows, titles.limit(0)))) == 4
    assert {(r["frag_idx_code"], r["suggested_value"]) for r in checks.auto_fixes(rows, titles).collect()} == {("1.0", "x"), ("2.0", "x")}
    assert set(checks.NAMES) >= {r["check_id"] for r in checks.findings_by_file(checks.run_all(rows, titles)).collect()}
    assert [tuple(r) for r in checks.store_stats(rows).collect()] == [(7, 5, 2)]
    assert checks.header_ends(rows).count() == 1 and checks.header_ends(rows.where("frag_type = 'Header'")).count() == 0


# -- edits


@pytest.fixture
def file_rows(spark):
    parts = ["<a>é\n", "two\nlines\n", "third ṃ", "\nlast"]
    rows = edits.recalculated(frame(spark, *(fragment(f"{k}.0", content_xml=p, cst_code=f"c{k}", frag_type="Header" if k in (0, 3) else "Sutta") for k, p in enumerate(parts))))
    return rows, "".join(parts)


def state(rows):
    return {r["frag_idx_code"]: r for r in rows.collect()}


def whole(rows):
    """Contents in order, and the chain of boundaries of rows that are not moved."""
    s = sorted(rows.collect(), key=lambda r: tuple(map(int, r["frag_idx_code"].split("."))))
    place = (1, 0)
    for r in (r for r in s if r["frag_review"] != "moved"):
        assert (r["start_line"], r["start_char"]) == place, r
        place = (r["end_line"], r["end_char"])
    return "".join(r["content_xml"] for r in s)


def test_move_delete_merge(file_rows):
    rows, text = file_rows
    for direction, target in (("prev", "1.0"), ("next", "3.0")):
        after = edits.move_content(rows, "2.0", direction)
        s = state(after)
        assert whole(after) == text and s["2.0"]["frag_review"] == "moved" and s["2.0"]["cst_code"] is None and "third" in s[target]["content_xml"]
        again = edits.move_content(after, "1.0", "next")
        assert "two" in state(again)["3.0"]["content_xml"]  # the moved row is skipped
    assert state(edits.move_content(rows, "1.0", "prev", compat=True))["0.0"]["content_xml"] == "<a>é\n\ntwo\nlines\n"
    with pytest.raises(edits.EditError):
        edits.move_content(rows, "0.0", "prev")
    assert whole(edits.delete(rows, "1.0")) == text and whole(edits.delete(rows, "0.0")) == text
    with pytest.raises(edits.EditError):
        edits.merge_delete(rows, "1.0", "prev")


def test_insert_nudge_merge(file_rows):
    rows, text = file_rows
    after = edits.insert(rows, "1.0", "next")
    s = state(after)
    assert s["1.1"]["content_xml"] == "" and s["1.1"]["frag_review"] == "checked" and s["2.0"]["frag_review"] == "checked"
    assert set(state(edits.insert(after, "1.0", "next"))) - set(s) == {"1.2"}
    for action, got in (("line_up", "\nthird"), ("char_left", "third"), ("char_right", "hird"), ("line_down", "third ṃ")):
        moved = edits.nudge(rows, "2.0", "prev", action)
        assert whole(moved) == text, action
        assert state(moved)["2.0"]["content_xml"].startswith(got) or action == "line_down"
    moved = edits.nudge(rows, "3.0", "prev", "char_left")  # a character of three bytes
    assert whole(moved) == text and state(moved)["3.0"]["content_xml"] == "ṃ\nlast"
    filled = edits.nudge(after, "1.1", "next", "char_right")
    assert state(filled)["1.1"]["content_xml"] == "t" and whole(edits.merge_delete(filled, "1.1", "prev")) == text
    with pytest.raises(edits.EditError):
        edits.insert(rows, "0.0", "prev")
    assert set(state(edits.create(rows, "1.0", "prev"))) == {"0.0", "1.0", "2.0", "3.0", "4.0"}


def test_patch_keeps_null_and_blank_apart(spark, file_rows):
    rows, _ = file_rows
    patch = spark.createDataFrame([("1.0", None, "new", ""), ("2.0", "needs-review", None, None)], "frag_idx_code string, frag_review string, cst_code string, sc_code string")
    patch = patch.withColumns({c: F.lit(None).cast("string") for c in schema.CODES if c not in patch.columns})
    s = state(edits.patch(rows, patch))
    assert (s["1.0"]["frag_review"], s["1.0"]["cst_code"], s["1.0"]["sc_code"]) == ("checked", "new", "")
    assert (s["2.0"]["frag_review"], s["2.0"]["cst_code"], s["0.0"]["frag_review"]) == ("needs-review", "c2", None)


def test_diff(spark):
    fields = "cst_file string, frag_idx_code string, frag_type string, cst_code string, cst_vagga string, cst_sutta string, cst_paranum string"
    row = lambda k, code, title: ("f", k, "Sutta", code, None, title, "1")
    old = spark.createDataFrame([row("1.0", "a", "A"), row("2.0", "a", "x"), row("3.0", "a", "A"), row("4.0", "a", "A"), row("5.0", "a", "A")], fields)
    new = spark.createDataFrame([row("1.0", "a", "B"), row("2.0", "a", "A"), row("3.0", "b", "B"), row("4.0", "zz", "q"), row("5.0", "a", None), row("9.0", "a", "A")], fields)
    refs = spark.createDataFrame([("a", "A"), ("b", "B")], "cst_code string, cst_sutta string")
    compared = diff.compare(old, new, refs)
    assert sorted(r["frag_idx_code"] for r in diff.regressions(compared).collect()) == ["1.0", "5.0"]
    assert tuple(diff.summary(new, compared).first()) == (6, 5, 2)


# -- files, store, runs

FILES = {"s0101m.mul.xml": DIGHA, "s0201m.mul.xml": MAJJHIMA, "s0301m.mul.xml": SAMYUTTA, "s0402m2.mul.xml": ANGUTTARA}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "xml").mkdir()
    for k, (name, text) in enumerate(FILES.items()):
        raw = text.replace('encoding="UTF-8"', 'encoding="UTF-16"').replace("\n", "\r\n")
        data = [b"\xff\xfe" + raw.encode("utf-16-le"), b"\xfe\xff" + raw.encode("utf-16-be"), b"\xef\xbb\xbf" + raw.encode(), raw.encode()][k % 4]
        (tmp_path / "xml" / name).write_bytes(data)
    return tmp_path


def test_read_xml_in_any_encoding(spark, folder):
    rows = fs.select_inputs(spark, folder=str(folder / "xml")).collect()
    assert {r["cst_file"]: r["content"] for r in rows} == FILES
    assert sorted((r["encoding"], r["marked"]) for r in rows) == [("UTF-16BE", True), ("UTF-16LE", True), ("UTF-8", False), ("UTF-8", True)]
    (folder / "bad.xml").write_bytes(b"\xff\xfea\x00\x00\xd8b")
    assert "�" in fs.read_xml(spark, str(folder / "bad.xml")).first()["content"]
    (folder / "list.txt").write_text('# names\n\n"s0101m.mul.xml",\n  s0201m.mul.xml \n')
    assert fs.select_inputs(spark, list_file=str(folder / "list.txt"), base=str(folder / "xml")).count() == 2
    with pytest.raises(ValueError):
        fs.select_inputs(spark, file="a", folder="b")
    assert fs.convert_to_utf8(spark, str(folder / "xml"), str(folder / "utf8")) == 4
    assert {p.name: p.read_bytes().decode() for p in (folder / "utf8").iterdir()} == FILES
    some = [str(folder / "xml" / "s0101m.mul.xml"), str(folder / "xml" / "none.xml"), str(folder / "xml" / "s0201m.mul.xml")]
    assert fs.convert_to_utf8(spark, some, str(folder / "some")) == 2
    assert fs.convert_to_utf8(spark, some[1], str(folder / "none")) == 0


def test_write_texts_on_the_executors(spark, tmp_path):
    texts = {f"{k}.xml": ("ṃ\r\n" * k + "end") if k % 3 else None for k in range(200)}
    rows = spark.createDataFrame([*texts.items(), (None, "x")], "cst_file string, text string").repartition(7)
    assert fs.write_texts(rows, str(tmp_path / "out")) == 200
    assert fs.write_texts(rows, f"file://{tmp_path}/out") == 200  # again, over what is there
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == {n: (t or "").encode() for n, t in texts.items()}
    assert fs.write_texts(rows.limit(0), str(tmp_path / "empty")) == 0


def test_store_runs_and_reparse(spark, folder):
    files = fs.read_xml(spark, str(folder / "xml"))
    store = FragmentStore(spark, str(folder / "store"))
    assert runs.import_files(store, files) == []
    first = store.read()
    assert first.count() == 14 and checks.differences(first, files).count() == 0 and checks.chain(first).count() == 0 and checks.content_integrity(first, files).count() == 0
    plain = lambda: sorted(str(r) for r in store.read().collect())
    before = plain()
    runs.reparse(store, files)
    assert plain() == before  # without edits nothing changes
    name = "s0301m.mul.xml"
    store.edit(name, lambda rows: edits.nudge(rows, "2.0", "prev", "line_up"))
    store.edit(name, lambda rows: edits.insert(rows, "2.0", "next"))
    edited = plain()
    assert edited != before and checks.differences(store.read(), files).count() == 0
    runs.reparse(store, files.where(F.col("cst_file") == name))
    again = store.read()
    assert checks.differences(again, files).count() == 0 and again.where("frag_idx_code = '2.1'").count() == 1
    assert again.count() == len(edited)
    runs.reset(store, files.where(F.col("cst_file") == name))
    assert plain() == before
    refs = spark.createDataFrame([("dn1.1", "1. Ekasuttaṃ")], "cst_code string, cst_sutta string")
    report = runs.regenerate(store, files, references=refs)
    assert (report.version, report.rows, report.differing_rows, report.regressed, report.regressions) == (7, 14, 0, 0, [])
    store.rollback(1)
    assert store.version() == 1 and sorted(r["nikaya"] for r in store.structures().collect()) == sorted(schema.LEVELS)
    assert store.subset(["s0101m.mul.xml"]).select("cst_file").distinct().count() == 1
    assert [r["nikaya"] for r in checks.files_by_collection(store.read()).collect()] == ["digha", "majjhima", "samyutta", "anguttara"]


def test_errors_of_files_and_of_runs(spark):
    files = spark.createDataFrame([("a.mul.xml", "<x>no name</x>"), ("b.mul.xml", DIGHA.replace("</text>", "</odd>")), ("c.mul.xml", DIGHA), ("d.mul.xml", None)], schema.SOURCE)
    rows, failures = runs.parse(files)
    assert {r["cst_file"] for r in failures.collect()} == {"a.mul.xml", "b.mul.xml", "d.mul.xml"} and rows.select("cst_file").distinct().count() == 1
    fixes = spark.createDataFrame([tuple({"cst_file": "c.mul.xml", "frag_idx_code": "1.0", "end_line": 1, "end_char": 0}.get(c) for c in schema.OVERRIDE.names)], schema.OVERRIDE)
    with pytest.raises(CriticalError):
        runs.guard(segment.failures(segment.segment(files, fixes)))


def test_tsv_round_trip(spark, folder):
    rows, _ = runs.parse(fs.read_xml(spark, str(folder / "xml")))
    fs.write_tsv(rows, str(folder / "tsv"))
    lines = [x for p in sorted((folder / "tsv").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines[0].split("\t") == schema.TSV_COLUMNS and len(lines) == 15
    back = fs.read_fragments_tsv(spark, str(folder / "tsv"))
    assert back.where("cst_code = 'dn1.1'").first()["cst_sutta"] == "1. Ekasuttaṃ" and back.where("cst_vagga is null").count() > 0
    assert diff.summary(back, diff.compare(back, back, spark.createDataFrame([], "cst_code string, cst_sutta string"))).first()["differing_rows"] == 0


def test_old_forms(spark):
    old = spark.createDataFrame([(3, "x")], "frag_idx int, y string")
    assert upgraded(old).first()["frag_idx_code"] == "3.0" and downgraded(upgraded(old)).first()["frag_idx"] == 3


def test_inbox(spark, folder):
    store = FragmentStore(spark, str(folder / "streamed"))
    watch(arrivals(spark, str(folder / "xml"), 2), store, str(folder / "checkpoint")).awaitTermination()
    assert store.read().select("cst_file").distinct().count() == 4
    watch(arrivals(spark, str(folder / "xml"), 2), store, str(folder / "checkpoint")).awaitTermination()
    assert store.read().count() == 14
    # a batch that is replayed after its commit is known, a new one is not
    version, (stream,) = store.version(), store.pointer()["applied"]
    files = fs.read_xml(spark, str(folder / "xml"))
    assert version == 2 and store.applied(stream) == 1 and store.applied("other") == -1
    assert not absorb(store, files, stream, 1) and not absorb(store, files, stream, 0) and store.version() == version
    assert absorb(store, files, stream, 2) and store.version() == version + 1 and store.read().count() == 14


def test_a_batch_reads_only_the_writes_that_hold_its_files(spark, folder):
    """What a batch of new files costs does not grow with the store; of known files the own corrections are kept."""
    kept, files = FragmentStore(spark, str(folder / "grown")), fs.read_xml(spark, str(folder / "xml"))
    old, new, known = "s0101m.mul.xml", "s0201m.mul.xml", "s0301m.mul.xml"
    only = lambda *names: files.where(F.col("cst_file").isin(*names))
    assert absorb(kept, only(old), "x", 0) and absorb(kept, only(known), "x", 1)
    kept.edit(known, lambda rows: edits.insert(rows, "2.0", "next"))
    (write,) = (r["w"] for r in kept._files(kept.pointer()).where(F.col("cst_file") == old).collect())
    data, aside = folder / "grown" / "data" / f"w={write}", folder / "aside"
    data.rename(aside)  # whoever reads it fails
    assert absorb(kept, only(new, known), "x", 2)
    aside.rename(data)
    rows = kept.read()
    assert checks.differences(rows, only(old, new, known)).count() == 0 and rows.select("cst_file").distinct().count() == 3
    assert rows.where("frag_idx_code = '2.1'").select("cst_file").collect() == [(known,)] and kept.applied("x") == 2
    assert kept.read_files(only(new), 1) is None and kept.read_files(only(old)).count() == rows.where(F.col("cst_file") == old).count() > 0


def test_the_inbox_is_delivered_by_all_tasks_in_two_batches(spark, tmp_path, monkeypatch):
    from fragloom.plans import store_queries

    monkeypatch.setattr(store_queries, "work_folder", lambda _, tag: str(tmp_path / tag))
    texts = spark.range(40).select(F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("some text").alias("text"))
    texts.write.parquet(str(tmp_path / "conversations.parquet"))
    rows = store_queries.inbox_batches(spark, str(tmp_path))
    assert rows.select("cst_file").distinct().count() == 40 and rows.count() == 120 and rows.where("again").count() == 0
    assert len(list((tmp_path / "inbox").glob("part-*.parquet"))) == 4  # local[4]: not three, however large the input
    assert list(FragmentStore(spark, str(tmp_path / "store")).pointer()["applied"].values()) == [1]


def test_command_line(spark, folder, capsys):
    from fragloom.cli import main

    store, out = str(folder / "cli"), str(folder / "out")
    assert main(["parse", "--folder", str(folder / "xml"), "--dry-run"], spark) == 0
    assert main(["parse", "--folder", str(folder / "xml"), "--store", store], spark) == 0
    assert main(["reconstruct", "--store", store, "--cst-file", "s0101m.mul.xml", "--out", out], spark) == 0
    assert spark.read.text(out, wholetext=True).first()["value"] == DIGHA
    assert main(["export-tsv", "--store", store, "--out", out + "-tsv"], spark) == 0
    (folder / "m.tsv").write_text("\t".join(c.split()[0] for c in schema.MAPPING.split(", ")) + "\nromn/s0101m.mul.xml\tdn1.1\t\t1. Ekasuttaṃ\t1\tdn1\tB\n")
    assert main(["check-regressions", "--old", out + "-tsv", "--new", out + "-tsv", "--mapping", str(folder / "m.tsv")], spark) == 0
    assert "14 rows, 0 differ, 0 regressed" in capsys.readouterr().out
    assert main(["validate", "--store", store], spark) == 0
    settings = config.Settings(xml_dir=str(folder / "xml"), store=store, mapping=str(folder / "m.tsv"), files=list(FILES))
    config.save(settings, folder / "s.toml")
    assert config.load(folder / "s.toml") == settings and config.load_or_default(folder / "none.toml") == config.Settings()
    assert main(["regenerate", "--config", str(folder / "s.toml")], spark) == 0
    assert FragmentStore(spark, store).read().where("sc_code = 'dn1'").count() == 1
    assert main(["convert-all", "--config", str(folder / "s.toml"), "--out", out + "-8"], spark) == 0


def test_durations():
    assert log.format_duration(1.234) == "1.23s" and log.format_duration(75) == "1m 15.0s"


def test_store_survives_writers_that_stop(spark, folder):
    """Whatever a writer leaves behind, the version that counts is the last one that was pointed to."""
    rows, _ = runs.parse(fs.read_xml(spark, str(folder / "xml")))
    path = str(folder / "pointed")
    kept = FragmentStore(spark, path)
    assert kept.publish(rows) == 1 and kept.version() == 1
    left = kept.prepare(rows.limit(1))
    (folder / "pointed" / "v=2.json").write_text("{")
    (folder / "pointed" / ".CURRENT-2.json").write_text("{")
    assert kept.version() == 1 and kept.read().count() == rows.count()
    assert kept.publish(rows.limit(3)) == 3 and kept.read().count() == 3
    kept.rollback(1)
    assert kept.version() == 1 and kept.read().count() == rows.count()
    assert kept.publish(rows.limit(2)) == 4
    for _ in range(6):
        kept.rollback(1)
    assert kept.version() == 1 and len(list((folder / "pointed").glob("CURRENT-*.json"))) <= 5
    (folder / "pointed" / "v=2.json").unlink()
    assert f"data/w={left.write}" in kept.vacuum() and kept.read().count() == rows.count() and kept.read(4).count() == 2


def test_versions_share_files_and_writers_conflict(spark, folder, monkeypatch):
    rows, _ = runs.parse(fs.read_xml(spark, str(folder / "xml")))
    kept = FragmentStore(spark, str(folder / "shared"))
    kept.publish(rows)
    name, before = "s0101m.mul.xml", kept.read()
    total, own = rows.count(), rows.where("cst_file = 's0101m.mul.xml'").count()
    mine, other = kept.prepare(rows.where(F.col("cst_file") == name).limit(1)), kept.prepare(rows.where(F.col("cst_file") == name).limit(2))
    assert kept.commit(mine) == 2
    with pytest.raises(Conflict):
        kept.commit(other)
    kept.discard(other)
    assert kept.read().count() == total - own + 1 and before.count() == total == kept.read(1).count()
    assert len(kept.pointer()["writes"]) == 2  # the other files are those of the first write
    kept.replace_files(rows.limit(0), gone=spark.createDataFrame([(name,)], "cst_file string"))
    assert kept.read().count() == total - own
    monkeypatch.setattr("fragloom.sources.store.COMPACT", 2)
    kept.replace_files(rows.where(F.col("cst_file") == name))
    kept.replace_files(rows.where(F.col("cst_file") == name))
    assert len(kept.pointer()["writes"]) == 1 and sorted(map(str, kept.read().collect())) == sorted(map(str, rows.select(*schema.COLUMNS).collect()))


def test_a_run_that_another_writer_overtakes_is_done_again(spark, folder, monkeypatch):
    files = fs.read_xml(spark, str(folder / "xml"))
    kept = FragmentStore(spark, str(folder / "raced"))
    runs.import_files(kept, files)
    prepare, raced = FragmentStore.prepare, []

    def late(self, rows, *args, **named):
        out = prepare(self, rows, *args, **named)
        if not raced:
            raced.append(True)
            FragmentStore(spark, kept.path).edit("s0301m.mul.xml", lambda r: edits.insert(r, "2.0", "next"))
        return out

    monkeypatch.setattr(FragmentStore, "prepare", late)
    runs.reparse(kept, files)
    assert kept.version() == 3 and kept.read().where("frag_idx_code = '2.1'").count() == 1  # the other writer's row is kept
    assert not list((folder / "raced").glob(".staged-*")) and kept.vacuum() == []


@pytest.mark.parametrize("run", [runs.reparse, runs.regenerate])
def test_lost_text_is_not_published(spark, folder, run):
    """An inserted row that ends behind where it began leaves a gap: the run raises and the version before stays."""
    files = fs.read_xml(spark, str(folder / "xml"))
    kept = FragmentStore(spark, str(folder / "gap"))
    runs.import_files(kept, files)
    name = "s0101m.mul.xml"
    row = kept.read().where((F.col("cst_file") == name) & (F.col("frag_idx_code") == "1.0")).first().asDict()
    hole = row | {"frag_idx_code": "1.1", "frag_review": "checked", "content_xml": "", "start_line": row["end_line"] - 1, "start_char": 0, "end_line": row["end_line"], "end_char": 0}
    kept.edit(name, lambda r: r.unionByName(spark.createDataFrame([tuple(hole[c] for c in schema.COLUMNS)], schema.FRAGMENT)))
    before = sorted(map(str, kept.read().collect()))
    with pytest.raises(CriticalError, match="text is not given back"):
        run(kept, files)
    assert kept.version() == 2 and sorted(map(str, kept.read().collect())) == before and kept.vacuum() == []
    runs.reset(kept, files)
    assert kept.version() == 3 and kept.read().count() == 14


def test_regeneration_keeps_numbers_of_rows(spark, folder):
    files = fs.read_xml(spark, str(folder / "xml"))
    kept = FragmentStore(spark, str(folder / "counted"))
    runs.import_files(kept, files.where("cst_file <> 's0201m.mul.xml'"))
    assert runs.regenerate(kept, files).files == 4  # a file that is new has no number to keep
    kept.edit("s0101m.mul.xml", lambda rows: rows.where("frag_idx_code <> '1.0'"))
    with pytest.raises(CriticalError, match="other number of rows: s0101m.mul.xml"):
        runs.regenerate(kept, files)
    assert kept.version() == 3 and runs.regenerate(kept, files, fresh=True).rows == 14


def test_a_store_of_the_first_form_opens(spark, folder):
    rows, _ = runs.parse(fs.read_xml(spark, str(folder / "xml")))
    path = folder / "old"
    downgraded(rows).write.partitionBy("cst_file").parquet(str(path / "v=1"))
    (path / "CURRENT-1.json").write_text('{"version": 1}')
    want = sorted(map(str, rows.select(*schema.COLUMNS).collect()))
    assert FragmentStore(spark, str(path)).schema_number() == 1 and sorted(map(str, FragmentStore(spark, str(path)).read().collect())) == want
    kept = FragmentStore.open(spark, str(path))
    assert (kept.version(), kept.schema_number(), kept.schema_number(1)) == (2, 2, 1) and sorted(map(str, kept.read().collect())) == want
    kept.edit("s0301m.mul.xml", lambda r: edits.insert(r, "2.0", "next"))
    assert kept.migrate(1) == 4 and kept.schema_number() == 1 and kept.read().count() == len(want)  # down loses the inserted row
    assert FragmentStore.open(spark, str(path)).schema_number() == 2
    odd = path / "odd"
    rows.withColumn("more", F.lit(1)).write.partitionBy("cst_file").parquet(str(odd / "v=1"))
    (odd / "CURRENT-1.json").write_text('{"version": 1}')
    with pytest.raises(ValueError, match="more"):
        FragmentStore(spark, str(odd)).read()


def test_what_does_not_verify_is_not_stored(spark, folder, monkeypatch):
    kept = FragmentStore(spark, str(folder / "verified"))
    files = fs.read_xml(spark, str(folder / "xml"))

    def refuse(*_):
        raise CriticalError("no")

    with monkeypatch.context() as m:
        m.setattr(runs, "verify", refuse)
        with pytest.raises(CriticalError):
            runs.import_files(kept, files)
    assert not kept.exists() and not list((folder / "verified").glob(".staged-*"))
    runs.import_files(kept, files)
    assert kept.exists() and not list((folder / "verified").glob(".staged-*"))


def test_dimensions_are_broadcast_by_rows_and_bytes(spark, monkeypatch):
    plan = lambda df: df._jdf.queryExecution().logical().toString()
    rows = spark.range(10).selectExpr("id", "repeat('x', 1000) AS t")
    assert "broadcast" in plan(lookups.small(rows)).lower()
    monkeypatch.setattr(lookups, "BROADCAST_BYTES", 5000)
    assert "broadcast" not in plan(lookups.small(rows)).lower()


def test_a_write_has_as_many_parquet_files_as_tasks(spark, tmp_path):
    """Not one for each file of the store; writes of before, with a folder for each file, are read beside those of now."""
    rows = spark.range(300).select(F.concat(F.lit("a b="), "id", F.lit(".xml")).alias("cst_file"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in schema.FRAGMENT if f.nullable), F.lit("0.0").alias("frag_idx_code"), F.lit("Header").alias("frag_type"), F.lit("digha").alias("nikaya"), F.lit("x").alias("content_xml"), *(F.lit(1).alias(c) for c in ("start_line", "start_char", "end_line", "end_char")))
    rows = rows.select(*schema.COLUMNS)
    kept = FragmentStore(spark, str(tmp_path / "store"))
    kept.publish(rows)
    (write,) = kept.pointer()["writes"]
    assert len(list((tmp_path / "store" / "data").rglob("*.parquet"))) <= 4 and kept.read().count() == 300
    rows.write.partitionBy("cst_file").parquet(str(tmp_path / "before"))
    (tmp_path / "store" / "data" / f"w={write}").rename(tmp_path / "aside")
    (tmp_path / "before").rename(tmp_path / "store" / "data" / f"w={write}")
    want = sorted(map(str, rows.collect()))
    assert sorted(map(str, kept.read().collect())) == want
    kept.edit("a b=7.xml", lambda r: r.withColumn("sc_code", F.lit("new")))
    assert len(kept.pointer()["writes"]) == 2 and kept.read().count() == 300
    assert [r["cst_file"] for r in kept.read().where("sc_code = 'new'").collect()] == ["a b=7.xml"] and sorted(map(str, kept.read(1).collect())) == want
    assert kept.migrate(1) == 3 and kept.schema_number() == 1 and kept.read().count() == 300


def test_insert_before_a_moved_row(spark):
    """A moved row that keeps its place: the row behind it starts where it did. One that has given it up is passed over."""
    rows = frame(spark, *(fragment(f"{k}.0", frag_review="moved" if k == 2 else None, start_line=k + 1, end_line=k + 2) for k in range(4)))
    kept, passed = ({r["frag_idx_code"]: (r["start_line"], r["frag_review"]) for r in edits.insert(rows, "1.0", "next", past_moved=p).collect()} for p in (False, True))
    assert kept == {"0.0": (1, None), "1.0": (2, None), "1.1": (3, "checked"), "2.0": (3, "moved"), "3.0": (4, None)}
    assert passed == kept | {"3.0": (3, "checked")}
    near = {r["frag_idx_code"]: (r["start_line"], r["frag_review"]) for r in edits.insert(rows, "0.0", "next", past_moved=False).collect()}
    assert near["1.0"] == (2, "checked") and near["0.1"] == (2, "checked")

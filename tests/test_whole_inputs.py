"""The queries take their whole tables, not a part of them."""

import random
import re
from xml.sax.saxutils import escape

from pyspark.sql import functions as F

from fragloom.operators import intervals, lookups, propagation, segment
from fragloom.plans import queries
from tests import plain_fold


def test_sections_hold_whole_texts(spark, tmp_path):
    texts = {1: "one\ntwo <b> & c\n\nfour  \n", 2: "", 3: None, 4: "long " * 3000 + "\nlast", 5: "\nāb\n"}
    rows = [(k, t, "web" if k < 4 else "book") for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    whole = {"web_0.mul.xml": [1, 2, 3], "book_0.mul.xml": [4, 5]}
    files = {r["cst_file"]: r["content"] for r in queries.section_files(spark, str(tmp_path)).collect()}
    assert files.keys() == whole.keys()
    for file, ids in whole.items():
        bodies = [f'<p rend="bodytext" n="{k + 1}">{escape(texts[i] or "")}</p>' for k, i in enumerate(ids)]
        assert [b in files[file] for b in bodies] == [True] * len(ids)
        rows = segment.fragments(segment.segment(queries.section_files(spark, str(tmp_path)).where(f"cst_file = '{file}'"))).collect()
        assert "".join(r["content_xml"] for r in sorted(rows, key=lambda r: int(r["frag_idx_code"].split(".")[0]))) == files[file]
        contents = [r["content_xml"] for r in rows if r["frag_type"] == "Sutta"]
        assert all(sum(b in c for c in contents) == 1 for b in bodies)
        tokens = {r["byte_start"]: (r["line"], r["col"]) for r in queries.segment_tokens(spark, str(tmp_path)).where(f"cst_file = '{file}'").collect()}
        raw = files[file].encode()
        assert all(at == (raw.count(b"\n", 0, p) + 1, p - (raw.rfind(b"\n", 0, p) + 1)) for p, at in tokens.items())


def test_dimensions_without_twin_are_whole(spark, tmp_path):
    rows = [(k, 1 + k * 7 % 50, f"name {k}") for k in range(1, 401)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    titles = {}
    for k, size, name in rows:
        uid = f"sn{k % 9 + 1}.{size % 12 + 1}" + (f"-{size % 12 + 4}" if k % 3 == 0 else "")
        titles[uid] = max(titles.get(uid, ""), name)
    assert {r["uid"]: r["name"] for r in queries.part_titles(spark, str(tmp_path)).collect()} == titles
    assert queries.part_mapping(spark, str(tmp_path)).count() == len(rows)


def test_codes_propagate_as_row_by_row(spark):
    """The fold in the JVM against plain Python, over random files."""
    draw = random.Random(4)
    uids = {f"{p}{g}.{n}" + (f"-{n + draw.randint(1, 3)}" if draw.random() < 0.3 else "") for p in ("sn", "an") for g in range(1, 9) for n in range(1, 9) if draw.random() < 0.8}
    uids |= {f"{p}{n}" + (f"-{n + 2}" if n % 4 == 0 else "") for p in ("dn", "mn") for n in range(1, 30)} | {"xx", "kp1.2", "sn1", "sn2", "sn3.1-2-3", "sn3.1"}
    names = {u: f"title {u}" for u in sorted(uids)}
    titles = spark.createDataFrame(list(names.items()), "uid string, name string")
    rows = []
    for f in range(300):
        prefix = draw.choice(("sn", "sn", "an", "dn", "mn", "xy"))
        group, n = draw.randint(1, 4), 1
        for i in range(14):
            group, n = (group + 1, 1) if draw.random() < 0.25 else (group, n + 1)
            own = f"{prefix}{group}.{n}" if prefix in ("sn", "an") else f"{prefix}{n}"
            sc = (own + draw.choice(("", "", "", f"-{n + 1}", "-x", ":1"))) if i == 0 or draw.random() < 0.15 else None
            cst = draw.choice((None, "dn1.2", "sn1.1.1.x", f"sn{group}.1.1.{n}.9")) if draw.random() < 0.08 else f"sn{group if draw.random() < 0.7 else 1}.{group}.1.{n}" + (f"-{n + draw.choice((0, 2, 5))}" if draw.random() < 0.15 else "")
            rows.append((f"{f}.xml", f"{i}.0", cst, sc, draw.choice((None, "old"))))
    found = propagation.propagate(spark.createDataFrame(rows, "cst_file string, frag_idx_code string, cst_code string, sc_code string, sc_sutta string"), titles)
    expected = []
    for f in range(300):
        own = [dict(zip(found.columns, r)) for r in rows if r[0] == f"{f}.xml"]
        expected += [(r["cst_file"], r["frag_idx_code"], r["cst_code"], *new) for r, new in zip(own, plain_fold.propagated(own, names))]
    assert sorted(map(str, expected)) == sorted(str(tuple(r)) for r in found.collect())
    filled = [(e[3][:2], e[3]) for e, r in zip(expected, rows) if e[3] != r[3]]
    assert all(sum(p == q for q, _ in filled) > 5 for p in ("sn", "an", "dn", "mn")) and sum("-" in c for _, c in filled) > 10
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_ranges_less_ranges(spark, monkeypatch):
    """Missing codes and interval joins against numbers one by one; one prefix has most of the rows."""
    draw = random.Random(5)
    monkeypatch.setattr(intervals, "BITS", 2)
    monkeypatch.setattr(intervals, "WIDTHS", 5)
    prefix = lambda: draw.choice(("sn1.", "sn1.", "sn1.", "an2.", "x-y."))
    uids = {prefix() + str(draw.randint(1, 400)) for _ in range(60)} | {f"{prefix()}{a}-{a + draw.choice((0, 1, 5, 60, -3))}" for a in draw.sample(range(1, 500), 40)} | {"dn1", "sn1.007", "mn2-3"}
    titles = spark.createDataFrame([(u, u) for u in sorted(uids)], "uid string, name string")
    codes = [prefix() + str(draw.randint(1, 420)) for _ in range(200)] + [f"{prefix()}{a}-{a + draw.choice((0, 2, 20, 90, -1))}" for a in draw.sample(range(1, 500), 200)] + ["dn1", "dn2", "mn2-3", "mn4-5", "sn1.7", "sn1.007", "sn1.5:2", "", "bad", "sn1.1-99999999999999999999"]
    known = set()
    for u in uids:
        m = re.fullmatch(r"(.*\.)(\d+)-(\d+)", u)
        known |= {(m[1], n) for n in range(int(m[2]), int(m[3]) + 1)} if m else set()
    number = lambda c: (m[1], int(m[2])) if (m := re.fullmatch(r"(.*\.)(\d+)", c)) else None
    is_in = lambda c: c in uids or number(c) in known
    rows = spark.createDataFrame(list(enumerate(codes)), "k int, code string")
    assert sorted(r["k"] for r in lookups.in_titles(rows, titles, "code").collect()) == [k for k, c in enumerate(codes) if is_in(c)]
    assert sorted(r["k"] for r in lookups.in_titles(rows, titles, "code", anti=True).collect()) == [k for k, c in enumerate(codes) if not is_in(c)]
    expected = {}
    for k, c in enumerate(codes):
        base = c.split(":")[0]
        if base and not is_in(base):
            m = re.fullmatch(r"([^-]*\.)(\d{1,18})-(\d{1,18})", base)
            gone = [x for x in (f"{m[1]}{n}" for n in range(int(m[2]), int(m[3]) + 1)) if not is_in(x)] if m else [base]
            if gone:
                expected[k] = (base, gone)
    assert {r["k"]: (r["base"], r["missing"]) for r in lookups.missing_codes(rows, titles, "code", ["k"]).collect()} == expected


def test_huge_ranges_stay_ranges(spark):
    titles = spark.createDataFrame([("sn1.5", "x"), ("sn1.1000-1999999999", "y"), ("sn1.3000000000", "z")], "uid string, name string")
    rows = spark.createDataFrame([(1, "sn1.1-2000000000"), (2, "sn1.1-3000000000"), (3, "sn1.3000000000-3000000005"), (4, "sn1.1500-1600"), (5, "sn9.1-900000000000000000")], "k int, code string")
    found = {r["k"]: r["missing"] for r in lookups.missing_codes(rows, titles, "code", ["k"]).collect()}
    few = [f"sn1.{n}" for n in range(1, 5)]
    assert found == {1: [*few, "sn1.6-999", "sn1.2000000000"], 2: [*few, "sn1.6-999", "sn1.2000000000-2999999999"], 3: [f"sn1.{3_000_000_000 + n}" for n in range(1, 6)], 5: ["sn9.1-900000000000000000"]}


def test_one_prefix_is_spread_over_cells(spark):
    """All rows and ranges have one prefix: no task of the join on cells gets more than a few of them."""
    ranges = spark.range(20_000).select(F.lit("sn1.").alias("prefix"), (F.col("id") * 50).alias("low"), (F.col("id") * 50 + 30).alias("high"))
    cells = intervals.in_cells(ranges)
    assert cells.groupBy("width", "cell").count().agg(F.max("count")).first()[0] <= 42 and cells.count() < 40_000
    numbers = intervals.looking(spark.range(1_000_000).select(F.lit("sn1.").alias("prefix"), F.col("id").alias("n")), "n", intervals.widths(cells))
    assert numbers.groupBy("width", "cell").count().agg(F.max("count")).first()[0] <= 1024


def test_the_scan_holds_one_file_and_what_it_hands_on(monkeypatch):
    """Files are taken out of their batch one by one; rows of several are handed on together, up to a bound."""
    import pyarrow as pa

    seen, made = [], []
    monkeypatch.setattr(segment, "HELD", 100)
    monkeypatch.setattr(segment, "HELD_ROWS", 7)

    def rows(file, content):
        seen.append(file)
        return ({"cst_file": file, "seq": k} for k in range(int(file)))

    batch = pa.RecordBatch.from_pydict({"cst_file": ["1", "2", "3", "20", "0", "1"], "content": ["x" * 60, "x" * 60, "x", None, "x", ""]})
    for out in segment._handed(iter([batch]), rows, segment._ARROW_TOKENS):
        made.append((len(seen), out.num_rows))
        assert out.schema == segment._ARROW_TOKENS
    assert made == [(2, 3), (4, 7), (4, 7), (4, 7), (6, 3)]

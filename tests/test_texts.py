"""Decoding against Python's decoders, first differences against characters one by one, free minors with a hot key."""

import random

from pyspark.sql import functions as F

from fragloom import schema
from fragloom.functions import text as tx
from fragloom.operators import checks, ordered
from tests.test_operators import fragment


def plain(raw):
    for mark, name in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"\xef\xbb\xbf", "utf-8")):
        if raw.startswith(mark):
            return raw[len(mark) :].decode(name, errors="replace")
    return raw.decode("utf-8", errors="replace")


def test_decoding_as_python_decodes(spark):
    draw = random.Random(31)
    raws = [b"", b"\xff\xfe", b"\xfe\xff", b"\xef\xbb\xbf", b"\xff\xfea", b"\xfe\xffa", b"\xff\xfe\x00\xd8", b"\xff\xfe\x00\xdc\x41\x00", b"\xfe\xff\xd8\x3d\xde\x00\xd8\x3d\x00a", b"\xff\xfe\xd8\x00\xdf\x00"]
    for _ in range(400):
        text = "".join(draw.choices("aā中😀Øß਍\n\r", k=draw.randrange(12)))
        name, mark = draw.choice((("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff"), ("utf-8", b"\xef\xbb\xbf"), ("utf-8", b"")))
        body = bytearray(text.encode(name))
        if name == "utf-16-le" and body and draw.random() < 0.5:
            at = draw.randrange(0, len(body), 2)
            body[at:at] = draw.choice((b"\x00\xdc", b"\x01\xd8a\x00"))
        if name == "utf-8" and body and draw.random() < 0.3:
            body[draw.randrange(len(body))] = draw.choice((0xFF, 0xC3, 0x80))
        raws.append(mark + bytes(body))
    rows = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(raws)] + [(-1, None)], "i int, raw binary")
    found = rows.select("i", tx.decoded(F.col("raw")).alias("t"))
    assert "Python" not in found._jdf.queryExecution().toString()
    got = {r["i"]: r["t"] for r in found.collect()}
    assert got.pop(-1) is None
    assert {i: t for i, t in got.items() if t != plain(raws[i]).replace("\r\n", "\n")} == {}


def test_long_files_decode_in_bounded_depth(spark):
    rows = spark.range(2).select("id", F.concat(F.unhex(F.lit("FFFE")), F.encode(F.repeat(F.lit("aṃ😀 "), 2_000_000), "UTF-16LE"), F.when(F.col("id") == 1, F.unhex(F.lit("00DC"))).otherwise(F.unhex(F.lit("")))).alias("raw"))
    assert [(r["n"], r["e"]) for r in rows.orderBy("id").select(F.char_length(tx.decoded(F.col("raw"))).alias("n"), F.right(tx.decoded(F.col("raw")), F.lit(1)).alias("e")).collect()] == [(8_000_000, " "), (8_000_001, "�")]


def test_first_differences(spark, monkeypatch):
    monkeypatch.setattr(checks, "CHUNK", 7)
    draw = random.Random(32)
    rows, files, expected = [], [], {}
    for i in range(300):
        text = "".join(draw.choices("abé中😀\n", k=draw.randrange(40)))
        other = text
        if draw.random() < 0.8:
            at = draw.randrange(len(text) + 1)
            other = text[:at] + "".join(draw.choices("aé中è😁", k=draw.randrange(3))) + text[at + draw.randrange(3) :]
        cut = draw.randrange(len(text) + 1)
        rows += [fragment("0.0", cst_file=f"{i}", content_xml=text[:cut], start_line=1), fragment("1.0", cst_file=f"{i}", content_xml=text[cut:], start_line=2)]
        files.append((f"{i}", other))
        if other != text:
            first = next((k for k, (x, y) in enumerate(zip(other, text)) if x != y), min(len(other), len(text)))
            expected[f"{i}"] = (len(other), len(text), first + 1)
    found = checks.differences(spark.createDataFrame(rows, schema.FRAGMENT), spark.createDataFrame(files, schema.SOURCE))
    assert {r["cst_file"]: tuple(r)[1:] for r in found.collect()} == expected


def test_a_file_of_50_mb(spark):
    lines = lambda end: F.concat(F.repeat(F.lit("a line of texṭ\n"), (F.length("cst_file") * 3_200_000).cast("int")), F.lit(end))
    files = spark.createDataFrame([("f",)], "cst_file string").withColumn("content", lines("END"))
    rows = spark.createDataFrame([fragment("0.0", cst_file="f")], schema.FRAGMENT).withColumn("content_xml", lines("EXD"))
    size = 15 * 3_200_000
    assert [tuple(r) for r in checks.differences(rows, files).collect()] == [("f", size + 3, size + 3, size + 2)]


def test_free_minors_of_a_hot_key(spark):
    rows = spark.range(300_000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE cast(id % 50 AS string) END AS k", "cast(id % 1000 AS int) AS n").where("not (k = 'hot' and n = 777) and not (k = '7' and n < 5)")
    rows = rows.unionByName(spark.createDataFrame([("zero", 0), ("gap", 0), ("gap", 2), (None, 1)], "k string, n int"))
    taken = {}
    for r in rows.distinct().collect():
        taken.setdefault(r["k"], set()).add(r["n"])
    expected = {k: next(n for n in range(1, 2000) if n not in v) for k, v in taken.items()}
    assert {r["k"]: r["free"] for r in ordered.free_minors(rows, ["k"], "n", "free").collect()} == expected and expected["hot"] == 777

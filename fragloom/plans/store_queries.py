"""Queries of whole runs on a store (import, edits, reparse, reset, regeneration, migration, the inbox), of decoding and of guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fragloom import schema
from fragloom.functions import codes as cd
from fragloom.functions import text as tx
from fragloom.operators import checks, diff, edit_log, ordered
from fragloom.plans import queries as q
from fragloom.plans import runs
from fragloom.plans.queries import query
from fragloom.sources.store import FragmentStore, downgraded, subset_counts
from fragloom.sources.work import work_folder, written
from fragloom.streaming import inbox

_SHOWN = ["cst_file", "frag_idx_code", "frag_review", "sc_code", "cst_code"]


def _conv() -> Column:
    return F.regexp_extract("cst_file", r"^f(\d+)", 1).cast("long")


def _edited_store(spark: SparkSession, sf: str) -> tuple[FragmentStore, DataFrame]:
    """A store of all collections with every third section checked and given a code of its own, in two files of three."""
    files, store = written(q.collection_files(spark, sf), "files"), FragmentStore(spark, work_folder(spark, "store"))
    runs.import_files(store, files)
    major = F.substring_index("frag_idx_code", ".", 1)
    fixed = (F.col("frag_type") == "Sutta") & (major.cast("int") % 3 == 1)
    rows = store.read().where(_conv() % 3 != 0)
    rows = rows.withColumns({"sc_code": F.when(fixed, F.concat(F.lit("fix-"), major)).otherwise(F.col("sc_code")), "frag_review": F.when(fixed, "checked").otherwise(F.col("frag_review"))})
    store.replace_files(rows)
    return store, files


def _expected(kept: str, extra: str = "") -> str:
    """Sections of all collections, those of kept files with what reviewers changed."""
    fixed = f"k % 3 = 1 AND conv_id % 3 <> 0 AND ({kept})"
    return (
        q._COLLECTED + f"SELECT cst_file, k || '.0' AS frag_idx_code, CASE WHEN {fixed} THEN 'checked' END AS frag_review, CASE WHEN {fixed} THEN 'fix-' || k END AS sc_code, {q._of_kind([q._said(x[7]) for x in q._KINDS])} AS cst_code{extra} FROM t "
        f"UNION ALL SELECT DISTINCT cst_file, '0.0', NULL, NULL, NULL{extra} FROM t UNION ALL SELECT DISTINCT cst_file, (n + 1) || '.0', NULL, NULL, NULL{extra} FROM t"
    )


@query(_expected("TRUE"))
def store_reparse(spark: SparkSession, sf: str) -> DataFrame:
    """[A9, H2, H14] all files parsed again with their own corrections, verified, as a new version"""
    store, files = _edited_store(spark, sf)
    runs.reparse(store, files)
    return store.read().select(*_SHOWN)


@query(_expected("conv_id % 2 = 1"))
def store_reset(spark: SparkSession, sf: str) -> DataFrame:
    """[A9, H13] half of the files parsed again without corrections, verified, as a new version that shares the other half"""
    store, files = _edited_store(spark, sf)
    runs.reset(store, files.where(_conv() % 2 == 0))
    return store.read().select(*_SHOWN)


@query(_expected("TRUE", ", 3 AS version, (SELECT count(DISTINCT conv_id) FROM conversations) AS files, (SELECT count(*) + 2 * count(DISTINCT conv_id) FROM conversations) AS rows"))
def store_regenerate(spark: SparkSession, sf: str) -> DataFrame:
    """[A10, A16, K2] a whole new version with the corrections of the one before, verified and counted against it"""
    store, files = _edited_store(spark, sf)
    report = runs.regenerate(store, files)
    return store.read(report.version).select(*_SHOWN, F.lit(report.version).alias("version"), F.lit(report.files).cast("long").alias("files"), F.lit(report.rows).cast("long").alias("rows"))


@query(_expected("TRUE") + " UNION ALL SELECT 'version 2 counts', NULL, NULL, NULL, NULL")
def store_refusal(spark: SparkSession, sf: str) -> DataFrame:
    """[J9, J11, K2] inserted rows that leave gaps in the files: the regeneration loses text, so it is refused and the version before still counts"""
    store, files = _edited_store(spark, sf)
    before = store.version()
    first = store.read().where((F.col("frag_idx_code") == "1.0") & (F.col("end_line") > F.col("start_line")))
    hole = first.withColumns({"frag_idx_code": F.lit("1.1"), "frag_review": F.lit("checked"), "content_xml": F.lit(""), "start_line": F.col("end_line") - 1, "start_char": F.lit(0)})
    store.publish(store.read().unionByName(hole.select(*schema.COLUMNS)))
    try:
        runs.regenerate(store, files)
    except runs.CriticalError:
        store.rollback(before)
    told = spark.createDataFrame([(f"version {store.version()} counts",)], "cst_file string")
    return store.read().select(*_SHOWN).unionByName(told, allowMissingColumns=True)


@query(f"WITH {q._F} SELECT cst_file, turn::INT AS frag_idx, frag_idx_code, sc_code, 2 AS version, 2 AS form FROM f")
def store_migration(spark: SparkSession, sf: str) -> DataFrame:
    """[A7, A17, A18] a store of the first form is opened, which brings it up to a new version, and taken down again"""
    path = work_folder(spark, "store")
    downgraded(q.turn_fragments(spark, sf)).write.parquet(f"{path}/v=1")
    FragmentStore(spark, path)._create("CURRENT-1.json", {"version": 1})
    store = FragmentStore.open(spark, path)
    up = store.read().select("cst_file", "frag_idx_code", "sc_code", F.lit(store.version()).alias("version"), F.lit(store.schema_number()).alias("form"))
    down = store._rows(store._record(store.migrate(1))).select("cst_file", "frag_idx")
    return up.join(down, (up["cst_file"] == down["cst_file"]) & (F.substring_index(up["frag_idx_code"], ".", 1).cast("int") == down["frag_idx"])).select(up["cst_file"], "frag_idx", "frag_idx_code", "sc_code", "version", "form")


@query(q._COLLECTED + f"SELECT cst_file, k || '.0' AS frag_idx_code, {q._of_kind([q._said(x[7]) for x in q._KINDS])} AS cst_code, FALSE AS again FROM t UNION ALL SELECT DISTINCT cst_file, '0.0', NULL, FALSE FROM t UNION ALL SELECT DISTINCT cst_file, (n + 1) || '.0', NULL, FALSE FROM t")
def inbox_batches(spark: SparkSession, sf: str) -> DataFrame:
    """[2.13] files that arrive as a stream, in batches committed with their numbers; the last batch, replayed, is not taken again"""
    folder, store = work_folder(spark, "inbox"), FragmentStore(spark, work_folder(spark, "store"))
    q.collection_files(spark, sf).repartition(max(3, spark.sparkContext.defaultParallelism), "cst_file").write.parquet(folder)
    parts = len(spark.read.schema(schema.SOURCE).parquet(folder).inputFiles())
    arrivals = spark.readStream.schema(schema.SOURCE).option("maxFilesPerTrigger", max(1, 2 * parts // 3)).parquet(folder)  # two batches, however many parts
    inbox.watch(arrivals, store, work_folder(spark, "checkpoint")).awaitTermination()
    (stream, last), = store.pointer()["applied"].items()
    again = inbox.absorb(store, spark.read.schema(schema.SOURCE).parquet(folder), stream, last)
    return store.read().select("cst_file", "frag_idx_code", "cst_code", F.lit(again).alias("again"))


@query(f"WITH {q._F}, k AS (SELECT cst_file, count(*) AS n, bool_or(coalesce(frag_review IN ('checked', 'moved'), FALSE) OR cst_file = '5.xml') AS kept FROM f GROUP BY 1) SELECT sum(n)::BIGINT AS rows_before, coalesce(sum(n) FILTER (WHERE kept), 0)::BIGINT AS rows_after, count(*) AS files_before, count(*) FILTER (WHERE kept) AS files_after FROM k")
def store_subset_counts(spark: SparkSession, sf: str) -> DataFrame:
    """[E13]"""
    return subset_counts(q.turn_fragments(spark, sf), ["5.xml"])


#: Edits of every file, in this order; the last is of a fragment that no file has.
_EDITS = (("nudge", "1.0", "prev", "char_right"), ("move", "2.0", "prev", None), ("insert", "0.0", "next", None), ("delete", "3.0", None, None), ("move", "99.0", "next", None))


@query(
    f"WITH {q._F}, c AS (SELECT cst_file, max(turn) AS last, {', '.join(f'max(CASE WHEN turn = {k} THEN content_xml END) AS c{k}' for k in range(4))} FROM f GROUP BY 1), "
    "e AS (SELECT f.*, c.* EXCLUDE (cst_file) FROM f JOIN c ON c.cst_file = f.cst_file) "
    "SELECT cst_file, frag_idx_code, CASE WHEN turn = 0 AND last > 0 THEN c0 || left(c1, 1) WHEN turn = 1 THEN substr(c1, 2) || coalesce(c2, '') || coalesce(c3, '') WHEN turn = 2 THEN '' ELSE content_xml END AS content_xml, "
    "CASE WHEN turn = 2 THEN 'moved' WHEN turn = 1 OR (turn = 0 AND last > 0) THEN 'checked' END AS frag_review, NULL AS reason FROM e WHERE turn <> 3 "
    "UNION ALL SELECT cst_file, '0.1', '', 'checked', NULL FROM c UNION ALL SELECT cst_file, '4', NULL, NULL, 'no fragment 99.0' FROM c "
    "UNION ALL SELECT cst_file, '0', NULL, NULL, 'no fragment 1.0' FROM c WHERE last < 1 UNION ALL SELECT cst_file, '1', NULL, NULL, 'no fragment 2.0' FROM c WHERE last < 2 UNION ALL SELECT cst_file, '3', NULL, NULL, 'no fragment 3.0' FROM c WHERE last < 3"
)
def edited_files(spark: SparkSession, sf: str) -> DataFrame:
    """[H6, H8, H9, H10, C4, F1] a log of edits of all files, folded per file; rejected edits by their number"""
    rows = q.turn_fragments(spark, sf).withColumn("frag_review", F.lit(None).cast("string"))
    edits = F.array(*(F.struct(F.lit(k).cast("long").alias("seq"), *(F.lit(v).cast("string").alias(c) for v, c in zip(e, ("action", "frag_idx_code", "direction", "nudge")))) for k, e in enumerate(_EDITS)))
    log = rows.select("cst_file").distinct().select("cst_file", F.inline(edits))
    done = written(edit_log.folded(rows, log), "edited")
    refused = edit_log.rejected(done).select("cst_file", F.col("seq").cast("string").alias("frag_idx_code"), "reason")
    return edit_log.fragments_of(rows, done).select("cst_file", "frag_idx_code", "content_xml", "frag_review").unionByName(refused, allowMissingColumns=True)


# -- decoding

_MARKED = "CASE doc_id % 6 WHEN 0 THEN 'UTF-16LE' WHEN 1 THEN 'UTF-16BE' WHEN 4 THEN 'UTF-16LE' ELSE 'UTF-8' END"


@query(
    f"SELECT doc_id, sha256(CASE WHEN doc_id % 6 >= 4 THEN chr(65533) ELSE '' END || '<?xml version=\"1.0\" encoding=\"UTF-8\"?>' || chr(10) || replace(coalesce(text, ''), chr(13) || chr(10), chr(10))) AS sha, {_MARKED} AS encoding, doc_id % 6 IN (0, 1, 2, 4) AS marked FROM documents"
)
def decoded_texts(spark: SparkSession, sf: str) -> DataFrame:
    """[A1, A2] all documents as files in three encodings, with and without marks, a third of them malformed, decoded"""
    text = F.concat(F.lit('<?xml version="1.0" encoding="UTF-16"?>\r\n'), F.coalesce("text", F.lit("")))
    k, mark = F.col("doc_id") % 6, lambda h: F.unhex(F.lit(h))
    raw = (
        F.when(k == 0, F.concat(mark("FFFE"), F.encode(text, "UTF-16LE"))).when(k == 1, F.concat(mark("FEFF"), F.encode(text, "UTF-16BE"))).when(k == 2, F.concat(mark("EFBBBF"), F.encode(text, "UTF-8")))
        .when(k == 3, F.encode(text, "UTF-8")).when(k == 4, F.concat(mark("FFFE00D8"), F.encode(text, "UTF-16LE"))).otherwise(F.concat(mark("FF"), F.encode(text, "UTF-8")))
    )
    rows = q.read(spark, sf, "documents").select("doc_id", raw.alias("raw"))
    return rows.select("doc_id", F.sha2(tx.decoded(F.col("raw")), 256).alias("sha"), tx.encoding(F.col("raw")).alias("encoding"), tx.has_mark(F.col("raw")).alias("marked"))


# -- guards of runs and small operators, each called as it is


@query(f"WITH {q._F} SELECT cst_file, arg_min(frag_type, turn) AS first, arg_max(frag_type, turn) AS last FROM f GROUP BY 1 HAVING arg_min(frag_type, turn) <> 'Header' OR arg_max(frag_type, turn) <> 'Header'")
def check_header_ends(spark: SparkSession, sf: str) -> DataFrame:
    """[J9, F6]"""
    return checks.header_ends(q.turn_fragments(spark, sf))


@query(
    f"WITH {q._F}, w AS (SELECT cst_file, sum(strlen(content_xml)) + CASE WHEN min(conv_id) % 4 = 0 THEN 3 ELSE 0 END AS whole_bytes, coalesce(sum(strlen(content_xml)) FILTER (WHERE {q._OK}), 0) AS part_bytes FROM f GROUP BY 1) "
    "SELECT cst_file, whole_bytes::BIGINT AS whole_bytes, part_bytes::BIGINT AS part_bytes, (part_bytes - whole_bytes)::BIGINT AS difference FROM w WHERE part_bytes <> whole_bytes"
)
def check_content_integrity(spark: SparkSession, sf: str) -> DataFrame:
    """[J12, E5] moved rows are lost, and every fourth file ends with three bytes more"""
    rows = q.turn_fragments(spark, sf)
    number = F.substring_index("cst_file", ".", 1).cast("long")
    files = ordered.joined_text(rows.withColumn("turn", F.substring_index("frag_idx_code", ".", 1).cast("int")), ["cst_file"], ["turn"], "content_xml", out="content")
    files = files.withColumn("content", F.concat("content", F.when(number % 4 == 0, "ā.").otherwise(F.lit(""))))
    return checks.content_integrity(rows, files).select("cst_file", "whole_bytes", F.coalesce("part_bytes", F.lit(0).cast("long")).alias("part_bytes"), "difference")


@query(
    f"WITH {q._F}, w AS (SELECT *, lag(end_line) OVER x AS expected_start_line, lag(end_char) OVER x AS expected_start_char FROM f WHERE {q._OK} WINDOW x AS (PARTITION BY cst_file ORDER BY turn)) "
    "SELECT cst_file, frag_idx_code, start_line, expected_start_line, expected_start_char FROM w WHERE start_line <> expected_start_line OR start_char <> expected_start_char"
)
def check_chain(spark: SparkSession, sf: str) -> DataFrame:
    """[J13, F2]"""
    return checks.chain(q.turn_fragments(spark, sf)).select("cst_file", "frag_idx_code", "start_line", "expected_start_line", "expected_start_char")


@query(f"SELECT (SELECT count(*) FROM ({q._NEW})) AS total_rows, count(*) FILTER (WHERE differs) AS differing_rows, count(*) FILTER (WHERE regressed) AS errors FROM ({q._sql['diff_versions']})")
def diff_summary(spark: SparkSession, sf: str) -> DataFrame:
    """[E12, K1]"""
    old, new, ref = (spark.sql(x.replace("FROM customer", "FROM {customer}"), customer=q.read(spark, sf, "customer")) for x in (q._OLD, q._NEW, q._REF))
    return diff.summary(new, diff.compare(old, new, ref))


@query(
    "SELECT p_partkey, regexp_extract(code, '^([a-z]{2})(\\d+)', 1) AS prefix, CASE WHEN code LIKE 'sn%' THEN p_size END AS samyutta, CASE WHEN code LIKE 'an%' THEN p_size END AS nipata, (p_partkey % 40 + 3)::INT AS sutta FROM "
    "(SELECT *, CASE p_partkey % 3 WHEN 0 THEN 'sn' WHEN 1 THEN 'an' ELSE 'x' END || p_size || '.' || (p_partkey % 40) || '-' || (p_partkey % 40 + 3) AS code FROM part) WHERE p_partkey % 3 < 2"
)
def sc_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """[C14] ranges; every third code is none"""
    sql = "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'sn' WHEN 1 THEN 'an' ELSE 'x' END || CAST(p_size AS STRING) || '.' || CAST(p_partkey % 40 AS STRING) || '-' || CAST(p_partkey % 40 + 3 AS STRING) AS code FROM part"
    p = cd.sc_range_parts(F.col("code"))
    return q.part_view(spark, sf, sql).where(p.isNotNull()).select("p_partkey", *(p[c].alias(c) for c in ("prefix", "samyutta", "nipata", "sutta")))


@query(
    f"WITH {q._F}, e AS (SELECT nikaya, cst_file, count(*) AS n FROM f GROUP BY ALL) SELECT nikaya, CASE nikaya WHEN 'digha' THEN 'Dīgha Nikāya' WHEN 'samyutta' THEN 'Saṃyutta Nikāya' ELSE 'Majjhima Nikāya' END AS display, "
    "string_agg(cst_file || ':' || n, ',' ORDER BY cst_file) AS items, sum(n)::BIGINT AS total FROM e GROUP BY nikaya"
)
def collections_shown(spark: SparkSession, sf: str) -> DataFrame:
    """[C31, E3, E6]"""
    rows = checks.files_by_collection(q.turn_fragments(spark, sf))
    return rows.select("nikaya", "display", F.array_join(F.transform("items", lambda x: F.concat(x["cst_file"], F.lit(":"), x["n"].cast("string"))), ",").alias("items"), "total")


@query(f"WITH {q._F} SELECT cst_file, frag_idx_code FROM f WHERE turn >= 2")
def later_rows(spark: SparkSession, sf: str) -> DataFrame:
    """[P9, C1] at or after an index"""
    return q.turn_fragments(spark, sf).where(checks.from_index(F.col("frag_idx_code"), "2.0")).select("cst_file", "frag_idx_code")

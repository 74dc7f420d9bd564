"""Runs: parse files, reparse one, regenerate a store, compare releases. [B6, H13, H14, K2, A20]"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragloom import log
from fragloom.operators import checks, diff, edits, lookups, propagation, segment
from fragloom.operators.scan import CriticalError
from fragloom.sources.files import tsv_rows
from fragloom.sources.store import Conflict, FragmentStore

#: Failures and regressions that a report names.
LISTED = 100
#: Runs until a conflict with other writers is an error.
ATTEMPTS = 5


@dataclass
class Corrections:
    """What reviewers changed in a store."""

    overrides: DataFrame
    inserted: DataFrame
    reviews: DataFrame

    @classmethod
    def of(cls, fragments: DataFrame) -> Corrections:
        return cls(*edits.corrections(fragments))


@dataclass
class Report:
    """Of a regeneration. failures and regressions: up to LISTED of them."""

    version: int
    files: int
    rows: int
    failures: list[tuple[str, str]] = field(default_factory=list)
    differing_rows: int | None = None
    regressed: int | None = None
    regressions: list[tuple[str, str]] = field(default_factory=list)


def enrich(rows: DataFrame, mapping: DataFrame | None, titles: DataFrame | None, corrections: Corrections | None) -> DataFrame:
    """[D2, D7, D6, H1] In this order: mapping, codes from the row above, corrections, inserted rows."""
    if mapping is not None:
        rows = propagation.propagate(lookups.fill_sc(rows, lookups.code_map(mapping)), titles, lookups.TitleIndex(titles).mark if titles is not None else None)
    if corrections is not None:
        rows = lookups.apply_overrides(rows, corrections.overrides, titles)
        rows = edits.inject(rows, corrections.inserted)
    return rows


def _scanned(files: DataFrame, corrections: Corrections | None) -> DataFrame:
    return segment.segment(files, corrections.overrides if corrections else None, corrections.inserted if corrections else None)


def parse(files: DataFrame, mapping: DataFrame | None = None, titles: DataFrame | None = None, corrections: Corrections | None = None) -> tuple[DataFrame, DataFrame]:
    """(fragments, failures) of (cst_file, content). Failures have a status: a critical one should stop the run."""
    scanned = _scanned(files, corrections)
    return enrich(segment.fragments(scanned), mapping, titles, corrections), segment.failures(scanned)


def guard(failures: DataFrame) -> list[tuple[str, str]]:
    """Failures of single files, up to LISTED of them; all are counted in the log. A critical one is raised."""
    if bad := failures.where("status = 'critical'").select("error").limit(1).collect():
        raise CriticalError(bad[0]["error"])
    rows = failures.select("cst_file", "error").orderBy("cst_file").limit(LISTED).collect()
    for r in rows:
        log.warn("%s: %s", r["cst_file"], r["error"])
    if len(rows) == LISTED:
        log.warn("%d files failed in all", failures.count())
    return [(r["cst_file"], r["error"]) for r in rows]


def verify(fragments: DataFrame, files: DataFrame, reference: DataFrame | None = None) -> None:
    """[J9-J11] Raises what must not be stored: ends that are no headers, lost or changed text, other numbers of rows than in the
    reference."""
    for what, found in (("first or last row is no Header", checks.header_ends(fragments)), ("text is not given back", checks.differences(fragments, files))):
        if bad := found.limit(5).collect():
            raise CriticalError(f"{what}: {', '.join(r['cst_file'] for r in bad)}")
    if reference is not None and (bad := checks.row_counts(fragments, reference).limit(5).collect()):
        raise CriticalError(f"other number of rows: {', '.join(r['cst_file'] for r in bad)}")


def _stored(store: FragmentStore, files: DataFrame, mapping: DataFrame | None, titles: DataFrame | None, corrected, whole: bool, reference=None, batch: tuple[str, int] | None = None) -> tuple[int, list[tuple[str, str]]]:
    """(version, failures). Scans once, writes beside the version that counts, verifies that, and only then commits: what verify() raises is
    never seen by a reader. corrected and reference are made from the version that the run began with, by its number, 0 for none; where
    another writer committed meanwhile, the run is done again from the new one."""
    for attempt in range(ATTEMPTS):
        base = store.pointer()
        began = base["version"] if base else 0
        work = []
        try:
            corrections = corrected(began, work)
            scanned = store.staged(_scanned(files, corrections))
            work.append(scanned)
            failed = guard(segment.failures(scanned))
            with log.timed("write"):
                pending = store.prepare(enrich(segment.fragments(scanned), mapping, titles, corrections), base=base)
            try:
                counted = reference(began, pending.rows) if reference is not None else None
                verify(pending.rows, files.join(pending.rows.select("cst_file").distinct(), "cst_file", "left_semi"), counted)
                return store.commit(pending, whole or base is None, batch=batch), failed
            except BaseException:
                store.discard(pending)
                raise
        except Conflict:
            log.warn("another writer committed; run %d of %d", attempt + 2, ATTEMPTS)
        finally:
            for rows in work:
                store.unstage(rows)
    raise Conflict(f"other writers committed during {ATTEMPTS} runs")


def import_files(store: FragmentStore, files: DataFrame, mapping: DataFrame | None = None, titles: DataFrame | None = None, corrections: Corrections | None = None, reference: DataFrame | None = None, dry_run: bool = False) -> list[tuple[str, str]]:
    """Files parsed into the store. A dry run names the files and does nothing."""
    if dry_run:
        for r in files.select("cst_file").orderBy("cst_file").toLocalIterator():
            log.info("would parse %s", r["cst_file"])
        return []
    return _stored(store, files, mapping, titles, lambda *_: corrections, False, (lambda *_: reference) if reference is not None else None)[1]


def reparse(store: FragmentStore, files: DataFrame, mapping: DataFrame | None = None, titles: DataFrame | None = None, batch: tuple[str, int] | None = None) -> list[tuple[str, str]]:
    """[H14] A new version with files parsed again, their own corrections kept; without edits nothing changes."""

    def own(version: int, work: list) -> Corrections | None:
        known = store.read_files(files, version) if version else None
        if known is None:  # new files have no corrections
            return None
        work.append(store.staged(known))
        return Corrections.of(work[-1])

    return _stored(store, files, mapping, titles, own, False, batch=batch)[1]


def reset(store: FragmentStore, files: DataFrame, mapping: DataFrame | None = None, batch: tuple[str, int] | None = None) -> list[tuple[str, str]]:
    """[H13] A new version with files parsed again, corrections dropped."""
    return _stored(store, files, mapping, None, lambda *_: None, False, batch=batch)[1]


def regenerate(store: FragmentStore, files: DataFrame, mapping: DataFrame | None = None, titles: DataFrame | None = None, references: DataFrame | None = None, fresh: bool = False) -> Report:
    """[K2] A new version from the sources and the corrections of the one before (fresh: from the sources alone), verified and compared with
    it. A file of the version before must keep its number of rows. That version stays; a comparison that fails is logged and does not
    undo the run."""
    old = store.read() if store.exists() and not fresh else None

    def counted(began: int, rows: DataFrame) -> DataFrame | None:
        """The version before, and of files that it does not have the rows as they are."""
        if fresh or not began:
            return None
        before = store.read(began)
        return before.select("cst_file").unionByName(rows.join(before.select("cst_file").distinct(), "cst_file", "left_anti").select("cst_file"))

    with log.timed("regenerate"):
        version, failed = _stored(store, files, mapping, titles, lambda version, _: Corrections.of(store.read(version)) if version and not fresh else None, True, counted)
    new = store.read(version)
    counts = new.agg(F.count_distinct("cst_file").alias("files"), F.count(F.lit(1)).alias("rows")).first()
    report = Report(version, counts["files"], counts["rows"], failed)
    if old is not None and references is not None:
        try:
            compared = diff.compare(old, new, references)
            report.differing_rows, report.regressed = diff.summary(new, compared).select("differing_rows", "errors").first()
            worst = diff.regressions(compared).orderBy("cst_file", "frag_idx_code").limit(LISTED)
            report.regressions = [(r["cst_file"], r["frag_idx_code"]) for r in worst.collect()]
        except Exception as e:  # noqa: BLE001
            log.warn("comparison failed: %s", e)
    return report


def export(store: FragmentStore) -> DataFrame:
    return tsv_rows(store.read())

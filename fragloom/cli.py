"""Command line: parse, reconstruct, to-utf8, export-tsv, check-regressions, validate, regenerate, convert-all. [2.15]"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from fragloom import config, log
from fragloom.operators import checks, diff, lookups
from fragloom.plans import runs
from fragloom.sources import files as fs
from fragloom.sources.store import FragmentStore


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="fragloom", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *options: str, **flags: str) -> None:
        p = sub.add_parser(name)
        for o in options:
            p.add_argument(f"--{o.rstrip('!')}", required=o.endswith("!"))
        for f, text in flags.items():
            p.add_argument(f"--{f.replace('_', '-')}", action="store_true", help=text)

    command("parse", "file", "folder", "list-file", "store", "mapping", "reference", dry_run="name the files only")
    command("reconstruct", "store!", "cst-file!", "out!")
    command("to-utf8", "file!", "out!")
    command("export-tsv", "store!", "out!")
    command("check-regressions", "old!", "new!", "mapping!")
    command("validate", "store!", "titles", include_checked="report checked rows too")
    command("regenerate", "config!", fresh="ignore corrections and the version before")
    command("convert-all", "config!", "out!")
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(args)
    log.configure()
    spark = spark or SparkSession.builder.appName("fragloom").getOrCreate()
    if a.command == "parse":
        inputs = fs.select_inputs(spark, a.file, a.folder, a.list_file)
        if a.store is None or a.dry_run:
            runs.import_files(None, inputs, dry_run=True)
            return 0
        store = FragmentStore.open(spark, a.store)
        reference = FragmentStore.open(spark, a.reference).read() if a.reference else None
        corrections = runs.Corrections.of(reference) if reference is not None else None
        failed = runs.import_files(store, inputs, fs.read_mapping(spark, a.mapping) if a.mapping else None, None, corrections, reference)
        return int(bool(failed))
    if a.command == "reconstruct":
        rows = checks.of_file(FragmentStore.open(spark, a.store).read(), a.cst_file)
        fs.write_texts(checks.reconstruct(rows), a.out)
        return 0
    if a.command == "to-utf8":
        return int(fs.convert_to_utf8(spark, a.file, a.out) == 0)
    if a.command == "export-tsv":
        fs.write_tsv(FragmentStore.open(spark, a.store).read(), a.out)
        return 0
    if a.command == "check-regressions":
        new = fs.read_fragments_tsv(spark, a.new)
        compared = diff.compare(fs.read_fragments_tsv(spark, a.old), new, lookups.title_map(fs.read_mapping(spark, a.mapping)))
        total = diff.summary(new, compared).first()
        print(f"{total['total_rows']} rows, {total['differing_rows']} differ, {total['errors']} regressed")
        return int(total["errors"] > 0)
    if a.command == "validate":
        titles = spark.read.csv(a.titles, sep="\t", header=True, quote="") if a.titles else None
        found = checks.run_all(FragmentStore.open(spark, a.store).read(), titles, a.include_checked)
        n = 0
        for row in checks.in_order(found).toLocalIterator():
            print("\t".join("" if v is None else str(v) for v in row))
            n += 1
        print(f"{n} findings")
        return 0
    settings = config.load(a.config).with_defaults()
    paths = [f"{settings.xml_dir.rstrip('/')}/{n}" for n in settings.files]
    if a.command == "convert-all":
        done = fs.convert_to_utf8(spark, paths, a.out)
        print(f"{done} of {len(paths)} files")
        return int(done < len(paths))
    mapping = fs.read_mapping(spark, settings.mapping) if settings.mapping else None
    titles = fs.root_titles(spark.read.json(settings.titles)) if settings.titles else None
    report = runs.regenerate(FragmentStore.open(spark, settings.store), fs.read_xml(spark, paths), mapping, titles, lookups.title_map(mapping) if mapping is not None else None, a.fresh)
    print(report)
    return int(bool(report.regressions))


if __name__ == "__main__":
    sys.exit(main())

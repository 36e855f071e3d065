"""Command line: prepared queries over structure files or a model store.

    python -m helixframe.cli <verb> (--directory D | --files F... | --file-list L | --database P) [options]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe import __version__
from helixframe.functions.interactions import TypeSet
from helixframe.operators import contacts, quality_metrics, shape
from helixframe.operators.dssp import dssp
from helixframe.operators.sasa import sasa
from helixframe.sources.model_atoms import model_atoms, model_bonds
from helixframe.sources import sinks
from helixframe.sources.models import ModelStore, extract, read_models
from helixframe.sources.structures import file_list, read_atoms

VERBS = ("createdb", "extract", "positions", "compaction-rg", "shape-metrics", "quality-metrics", "sasa-sr", "dssp", "contacts")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="helixframe")
    top.add_argument("--version", action="version", version=__version__)
    top.add_argument("-v", "--verbose", type=int, choices=(0, 1, 2), default=1)
    verbs = top.add_subparsers(dest="verb", required=True)
    for verb in VERBS:
        p = verbs.add_parser(verb)
        source = p.add_mutually_exclusive_group(required=True)
        source.add_argument("--directory")
        source.add_argument("--files", nargs="+")
        source.add_argument("--file-list")
        source.add_argument("--database")
        p.add_argument("--extension", default=".cif,.cif.gz,.pdb,.pdb.gz,.gro", help="comma-separated ends of names; an empty part matches all")
        p.add_argument("--recursive", action="store_true")
        p.add_argument("--output", required=True)
        p.add_argument("--max-records", type=int, default=0, help="rows per file; 0 for one file")
        if verb == "extract":
            p.add_argument("--field", choices=("sequence", "plddt", "dssp", "organism"), required=True)
        if verb == "positions":
            p.add_argument("--depth", type=int, choices=(0, 1, 2), default=1)
        if verb in ("compaction-rg", "shape-metrics"):
            p.add_argument("--min-high-fraction", type=float, default=0.80)
        if verb == "quality-metrics":
            p.add_argument("--plddt-group", action="append", default=[])
            p.add_argument("--dssp-group", action="append", default=[])
            p.add_argument("--segment-min", type=int, default=quality_metrics.SEGMENT_MIN)
        if verb == "sasa-sr":
            p.add_argument("--probe", type=float, default=1.4)
            p.add_argument("--points", type=int, default=128)
        if verb == "dssp":
            p.add_argument("--no-prefer-pi", action="store_true")
        if verb == "contacts":
            p.add_argument("--provider", choices=tuple(contacts.PROVIDERS), default="molstar")
            p.add_argument("--types", default="all")
    return top


def paths_of(spark: SparkSession, args) -> str | list[str]:
    return args.directory or args.files or file_list(spark, args.file_list)


def long_residues(models: DataFrame) -> DataFrame:
    return models.where(F.col("error").isNull() if "error" in models.columns else F.lit(True)).select("model_id", F.posexplode(F.arrays_zip("plddt", "dssp")).alias("position", "r")).select("model_id", F.col("position").cast("long"), "r.plddt", "r.dssp")


def build(spark: SparkSession, args) -> DataFrame:
    """The plan of a verb."""
    extensions = [e.strip() for e in args.extension.split(",")] if args.directory else None
    model_input = lambda *fields: ModelStore(spark, args.database).read(*fields) if args.database else read_models(spark, paths_of(spark, args), extensions, args.recursive)
    if args.verb == "createdb":
        return model_input()
    if args.verb == "extract":
        return extract(model_input(), args.field)
    if args.verb == "positions":
        return sinks.positions(model_input("coords"), args.depth)
    if args.verb == "compaction-rg":
        return shape.compaction_record(model_input(), args.min_high_fraction)
    if args.verb == "shape-metrics":
        m = model_input()
        kept = shape.compaction_record(m, args.min_high_fraction).where("status = 'ok'").select("model_id", "trim_start", "trim_end")
        counts = m.join(kept, "model_id").select("model_id", "coords", shape.atom_counts(F.col("sequence")).alias("c"), "trim_start", "trim_end")
        total = lambda n: F.aggregate(n, F.lit(0), lambda a, x: a + x)
        part = F.slice("coords", total(F.slice("c", 1, F.col("trim_start"))) + 1, total(F.slice("c", F.col("trim_start") + 1, F.col("trim_end") - F.col("trim_start"))))
        points = counts.select("model_id", F.explode(part).alias("p")).select("model_id", "p.x", "p.y", "p.z")
        return shape.shape_metrics(shape.principal_moments(shape.gyration_tensor(points, ["model_id"])))
    if args.verb == "quality-metrics":
        groups = lambda given, default, kind: quality_metrics.parse_groups(given or default, kind)
        plddt, states = groups(args.plddt_group, quality_metrics.DEFAULT_PLDDT, "plddt"), groups(args.dssp_group, quality_metrics.DEFAULT_DSSP, "dssp")
        return quality_metrics.quality_metrics(long_residues(model_input()), ["model_id"], plddt, states, segment_min=args.segment_min)
    models = model_input("sequence", "coords") if args.database else None
    atoms = model_atoms(models) if models is not None else read_atoms(spark, paths_of(spark, args), extensions, args.recursive).where(F.col("error").isNull())
    if args.verb == "sasa-sr":
        return sasa(atoms, probe=args.probe, points=args.points)
    if args.verb == "dssp":
        return dssp(atoms, prefer_pi=not args.no_prefer_pi)
    wanted = TypeSet.parse(args.types)
    if wanted is None:
        raise SystemExit(f"unknown interaction type in {args.types!r}")
    return contacts.contacts(atoms.withColumn("atom_id", F.col("atom_id").cast("long")), args.provider, wanted, bond=None if models is None else model_bonds(models))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"helixframe {args.verb}").getOrCreate()
    out = build(spark, args)
    if args.verb == "createdb":
        ModelStore(spark, args.output).write(out)
    elif args.verb == "positions":
        sinks.write_files(out, args.output)
    elif args.max_records:
        sinks.sharded_ndjson(out, args.output, args.max_records)
    else:
        sinks.ndjson(out, args.output)
    if args.verb == "compaction-rg":
        sinks.summary(shape.summary(out), f"{args.output.rstrip('/')}_summary.json")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

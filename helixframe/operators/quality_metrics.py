"""Fractions, segments and overlaps of named confidence and secondary-structure groups, per model."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.shape import DSSP_NAMES, PLDDT_NAMES

# The groups that stand if none are given.
DEFAULT_PLDDT = ("poor=verylow", "low_or_poor=low,verylow")
DEFAULT_DSSP = ("coil=coil,turn,bend", "helix=alphahelix,helix310,helixpi", "strand=strand")
SEGMENT_MIN, SEGMENT_GROUPS = 30, ("poor",)

_PLAIN = lambda s: re.sub(r"[^0-9A-Za-z]", "", s).upper()
_PLDDT = {_PLAIN(n): n for n in PLDDT_NAMES}
_DSSP = {_PLAIN(n): n for n in DSSP_NAMES if n != "BetaBridge"}


@dataclass(frozen=True)
class Group:
    name: str
    members: tuple[str, ...]


def parse_groups(specs: list[str] | tuple[str, ...], kind: str) -> list[Group]:
    """`name=value,value` definitions; kind is plddt or dssp. Raises ValueError with the reason."""
    known = _PLDDT if kind == "plddt" else _DSSP
    out: list[Group] = []
    for spec in specs:
        name, eq, values = spec.partition("=")
        name = name.strip().lower()
        if not eq or not re.fullmatch(r"[a-z0-9_-]+", name):
            raise ValueError(f"not a group definition: {spec!r}")
        if name in {g.name for g in out}:
            raise ValueError(f"group {name!r} is defined twice")
        members = []
        for value in values.split(","):
            if _PLAIN(value) not in known:
                raise ValueError(f"unknown {kind} value {value.strip()!r} in group {name!r}")
            members.append(known[_PLAIN(value)])
        out.append(Group(name, tuple(dict.fromkeys(members))))
    return out


def fractions(residues: DataFrame, model: list[str], plddt: list[Group], dssp: list[Group]) -> DataFrame:
    """Per model: n_residues, a fraction per group and per pair of a confidence and a structure group."""
    inside = {("plddt", g.name): F.col("plddt").isin(*g.members) for g in plddt} | {("dssp", g.name): F.col("dssp").isin(*g.members) for g in dssp}
    share = lambda test: F.avg(F.coalesce(test, F.lit(False)).cast("double"))
    singles = [share(test).alias(f"{kind}_{name}_fraction") for (kind, name), test in inside.items()]
    pairs = [share(inside["plddt", p.name] & inside["dssp", d.name]).alias(f"overlap_{p.name}__{d.name}_fraction") for p in plddt for d in dssp]
    return residues.groupBy(*model).agg(F.count(F.lit(1)).alias("n_residues"), *singles, *pairs)


def segments(residues: DataFrame, model: list[str], group: Group, segment_min: int = SEGMENT_MIN, position: str = "position") -> DataFrame:
    """Per model: maximal runs of the group: their number, the longest, and the share of residues in runs of at least segment_min.

    Runs are gaps and islands: position minus the rank among members is constant within a run.
    """
    order = Window.partitionBy(*model).orderBy(position)
    member = F.coalesce(F.col("plddt").isin(*group.members), F.lit(False))
    ranked = residues.withColumns({"__row": F.row_number().over(order), "__in": member})
    island = F.col("__row") - F.sum(F.col("__in").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = ranked.withColumn("__island", island).groupBy(*model, "__island").agg(F.count_if("__in").alias("run"), F.count(F.lit(1)).alias("rows"))
    name = f"plddt_{group.name}"
    return runs.groupBy(*model).agg(
        F.count_if(F.col("run") > 0).alias(f"{name}_segment_count"),
        F.max("run").alias(f"{name}_max_segment_len"),
        (F.sum(F.when(F.col("run") >= segment_min, F.col("run")).otherwise(0)) / F.sum("rows")).alias(f"{name}_long_segment_fraction"),
    )


def quality_metrics(residues: DataFrame, model: list[str], plddt: list[Group] | None = None, dssp: list[Group] | None = None, segment_groups: tuple[str, ...] = SEGMENT_GROUPS, segment_min: int = SEGMENT_MIN) -> DataFrame:
    """All fractions and the segment statistics of the named groups, one row per model."""
    plddt = parse_groups(DEFAULT_PLDDT, "plddt") if plddt is None else plddt
    dssp = parse_groups(DEFAULT_DSSP, "dssp") if dssp is None else dssp
    out = fractions(residues, model, plddt, dssp)
    for g in plddt:
        if g.name in segment_groups:
            out = out.join(segments(residues, model, g, segment_min), model)
    return out

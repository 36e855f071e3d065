"""Interaction types, their codes and sets of them, and entity ids."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories in the order of their numbers, flavours likewise.
CATEGORIES = (
    "None", "Generic", "Hydrophobic", "Halogen", "HydrogenBond", "WeakHydrogenBond", "PolarHydrogenBond",
    "WeakPolarHydrogenBond", "Aromatic", "Ionic", "MetalCoordination", "CationPi", "PiStacking", "Carbonyl",
    "VanDerWaals", "DonorPi", "SulphurPi", "CarbonPi",
)
FLAVORS = ("Default", "Parallel", "TShape")

# Short codes of the public types.
SHORT = {
    "HydrogenBond": "hb", "WeakHydrogenBond": "whb", "PolarHydrogenBond": "phb", "WeakPolarHydrogenBond": "wphb",
    "Hydrophobic": "hp", "Ionic": "io", "Halogen": "ha", "MetalCoordination": "mc", "PiStacking": "ps", "PiStackingP": "psp",
    "PiStackingT": "pst", "CationPi": "cp", "VanDerWaals": "vdw", "Aromatic": "ar", "Carbonyl": "co", "DonorPi": "dp",
    "SulphurPi": "sp", "CarbonPi": "cbp",
}

# Further names that are understood.
ALIASES = {"hbond": "HydrogenBond", "weakhbond": "WeakHydrogenBond", "polarhbond": "PolarHydrogenBond", "weakpolarhbond": "WeakPolarHydrogenBond", "metalic": "MetalCoordination", "vdw": "VanDerWaals"}

#: Name -> (category, flavour) for every type, the two markers All and None included.
TYPES: dict[str, tuple[int, int]] = {name: (i, 0) for i, name in enumerate(CATEGORIES)} | {"PiStackingP": (12, 1), "PiStackingT": (12, 2), "All": (0, 1)}
PUBLIC = tuple(n for n in TYPES if n not in ("None", "All"))


def code(name: str) -> int:
    """The packed number: category in the low half, flavour in the high half."""
    category, flavor = TYPES[name]
    return category | flavor << 16


def parse_type(token: str) -> str | None:
    """The type's name; case, underscores, hyphens and spaces don't matter. None if it is unknown."""
    plain = "".join(c for c in token.lower() if c not in "_- ")
    known = {n.lower(): n for n in TYPES} | ALIASES
    return known.get(plain)


def from_short(short: str) -> str | None:
    return next((n for n, s in SHORT.items() if s == short), None)


def code_column(name: Column) -> Column:
    """The packed number of a column of type names."""
    return F.try_element_at(F.create_map(*[F.lit(x) for n in TYPES for x in (n, code(n))]), name)


def short_column(name: Column) -> Column:
    """The short code of a column of type names; a type without one raises an error."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in SHORT.items() for x in kv]), name)
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no short code for "), F.coalesce(name, F.lit("null")))).cast("string"))


@dataclass(frozen=True)
class TypeSet:
    """A set of types; containment is exact (PiStacking doesn't contain PiStackingP)."""

    names: frozenset[str] = field(default_factory=frozenset)
    everything: bool = False

    @classmethod
    def of(cls, *names: str) -> TypeSet:
        return cls(frozenset(n for n in names if n not in ("All", "None")), "All" in names)

    @classmethod
    def parse(cls, text: str) -> TypeSet | None:
        """Names split at commas or bars; None if any of them is unknown."""
        found = [parse_type(t) for t in text.replace("|", ",").split(",") if t.strip()]
        return None if not found or None in found else cls.of(*found)

    def __or__(self, other: TypeSet) -> TypeSet:
        return TypeSet(self.names | other.names, self.everything or other.everything)

    def __contains__(self, name: str) -> bool:
        return self.everything or name in self.names

    def members(self) -> list[str]:
        return [n for n in PUBLIC if n in self]

    def column(self, name: Column) -> Column:
        return F.lit(True) if self.everything else name.isin(*sorted(self.names)) if self.names else F.lit(False)


# Kinds of entities in their order.
KINDS = ("atom", "ring", "group")
INDEX_MASK = (1 << 56) - 1


def entity_id(kind: str | Column, index: Column) -> Column:
    """A 64-bit id: the kind in the top byte, the index below, so ids sort by kind, then index."""
    number = F.lit(KINDS.index(kind)) if isinstance(kind, str) else F.array_position(F.array(*map(F.lit, KINDS)), kind) - 1
    return F.shiftleft(number.cast("long"), 56).bitwiseOR(index.cast("long").bitwiseAND(F.lit(INDEX_MASK)))


def entity_kind(eid: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), (F.shiftrightunsigned(eid, 56) + 1).cast("int"))


def entity_index(eid: Column) -> Column:
    return eid.bitwiseAND(F.lit(INDEX_MASK))


def contact_label(index: Column, name: Column, resid: Column, resname: Column, chain: Column) -> Column:
    """idx-name-resid-resname-chain."""
    return F.concat_ws("-", index.cast("string"), name, resid.cast("string"), resname, chain)


def ring_label(labels: Column, resid: Column, resname: Column, chain: Column) -> Column:
    """(i-n, ...)-resid-resname-chain; more than eight atoms print the first four."""
    shown = F.when(F.size(labels) > 8, F.concat(F.array_join(F.slice(labels, 1, 4), ", "), F.lit(", ..."))).otherwise(F.array_join(labels, ", "))
    return F.concat_ws("-", F.concat(F.lit("("), shown, F.lit(")")), resid.cast("string"), resname, chain)


def compact_number(value: Column, digits: int = 2) -> Column:
    """Fixed digits with trailing zeros and a trailing point removed."""
    return F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits}f", value), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")

"""Rules of non-covalent contacts as tests over arrays of pairs.

Rules are data: a name, what either side must be, a reach and tests over the two sides in the order in which they are
made; a later test sees only the pairs that passed the earlier ones. Cross rules are tried in both orientations; a pair
counts once. The arithmetic is that of `functions.geometry`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

from helixframe.operators import topology as topo
from helixframe.operators.near import Columns, Side, differ

POLYMER = (*topo.PROTEIN, *topo.PROTEIN_MORE, *topo.BASES)

# geometry: vectors are three arrays


def sub(a: tuple, b: tuple) -> tuple:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def dot(a: tuple, b: tuple) -> np.ndarray:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: tuple, b: tuple) -> tuple:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def wide(a: tuple) -> tuple:
    """Ready to meet an array of neighbours."""
    return tuple(x[:, None] for x in a)


def angle(a: tuple, b: tuple) -> np.ndarray:
    """Degrees between two vectors; NaN if one of them has no length."""
    size = np.sqrt(dot(a, a) * dot(b, b))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(size > 0, np.degrees(np.arccos(np.clip(dot(a, b) / size, -1.0, 1.0))), np.nan)


def acute(degrees: np.ndarray) -> np.ndarray:
    return np.fmin(degrees, 180.0 - degrees)


def plane_offset(point: tuple, center: tuple, normal: tuple) -> np.ndarray:
    """Distance of a point from a ring's axis, measured in the ring's plane."""
    d, n2 = sub(point, center), dot(normal, normal)
    along = dot(d, normal)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.sqrt(np.maximum(0.0, dot(d, d) - np.where(n2 > 0, along * along / n2, 0.0)))


def out_of_plane(origin: tuple, first: tuple, second: tuple, point: tuple) -> np.ndarray:
    n, t = cross(sub(first, origin), sub(second, origin)), sub(point, origin)
    c = cross(n, t)
    return np.degrees(np.abs(np.arctan2(dot(n, t), np.sqrt(dot(c, c)))))


# neighbours


class Bonded:
    """Bonded neighbours of the rows of a table, or of one side of pairs: arrays (row, place) of ids, coordinates and kinds; places beyond the last are not there."""

    def __init__(self, ids: np.ndarray, xyz: tuple, kinds: dict[str, np.ndarray]):
        self.ids, self.xyz, self.kinds = ids, xyz, kinds

    @staticmethod
    def of(side: Side) -> Bonded:
        whole = side.columns.held("bonded", lambda: Bonded._read(side.columns))
        return Bonded(whole.ids[side.rows], tuple(x[side.rows] for x in whole.xyz), {k: v[side.rows] for k, v in whole.kinds.items()})

    @staticmethod
    def _read(columns: Columns) -> Bonded:
        import pyarrow.compute as pc

        array = columns.array("nbrs")
        n = pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False)
        flat = dict(zip([f.name for f in array.type.value_type], array.flatten().flatten(), strict=True))
        row, place = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        shape = (len(n), max(1, int(n.max()) if len(n) else 1))

        def spread(values, empty) -> np.ndarray:
            out = np.full(shape, empty)
            out[row, place] = values
            return out

        element = flat["element"]
        kind = lambda *names: spread(np.array([e in names for e in element.to_pylist()], dtype=bool), False)
        there = spread(element.is_valid().to_numpy(zero_copy_only=False), False)
        hydrogen = kind("H", "D")
        return Bonded(
            spread(flat["atom_id"].to_numpy(zero_copy_only=False), -1), tuple(spread(flat[c].to_numpy(zero_copy_only=False), np.nan) for c in "xyz"),
            {"hydrogen": hydrogen, "heavy": there & ~hydrogen, "sulfur": kind("S"), "binder": kind("C", "N", "O", "S", "P"), "some": spread(True, False)},
        )

    def heavy(self, other: Side) -> np.ndarray:
        return self.kinds["heavy"] & (self.ids != other["atom_id"][:, None])

    def pick(self, mask: np.ndarray, number: int) -> tuple:
        """Coordinates of the number-th neighbour (from 0) in the mask; NaN where there are fewer."""
        hit = mask & (np.cumsum(mask, axis=1) == number + 1)
        place, rows = hit.argmax(axis=1), np.arange(len(mask))
        return tuple(np.where(hit.any(axis=1), x[rows, place], np.nan) for x in self.xyz)


def _second(side: Side) -> tuple:
    def read() -> tuple:
        array = side.columns.array("second")
        fields = dict(zip([f.name for f in array.type], array.flatten(), strict=True))
        return tuple(fields[c].to_numpy(zero_copy_only=False).astype(float) for c in "xyz")

    return tuple(x[side.rows] for x in side.columns.held("second place", read))



# tests


def apart(a: Side, b: Side, k: int) -> np.ndarray:
    """Other chains, or more than k residues apart."""
    with np.errstate(invalid="ignore"):
        return differ(a, b, "chain") | (np.abs(a["resid"] - b["resid"]) > k)


def other_residue(a: Side, b: Side) -> np.ndarray:
    return differ(a, b, "resid") | differ(a, b, "resname") | differ(a, b, "chain")


def not_own_residue(a: Side, b: Side) -> np.ndarray:
    """Not within one residue of a polymer; two residues at one number are two."""
    return differ(a, b, "chain") | a.outside("resname", *POLYMER) | b.outside("resname", *POLYMER) | differ(a, b, "resid") | differ(a, b, "resname")


def some_dry(a: Side, b: Side) -> np.ndarray:
    return a.outside("resname", *topo.WATER) | b.outside("resname", *topo.WATER)


def bonded(a: Side, b: Side) -> np.ndarray:
    n = Bonded.of(a)
    return (n.kinds["some"] & (n.ids == b["atom_id"][:, None])).any(axis=1)


def is_type(side: Side, *names: str) -> np.ndarray:
    return (side["atom_type"] & sum(topo.TYPES[n] for n in names)) != 0


def vdw(side: Side) -> np.ndarray:
    return side.columns.held("vdw", lambda: side.columns.mapped("el", lambda e: topo.VDW.get(e, 1.7), 1.7))[side.rows]


def vdw_sum(a: Side, b: Side) -> np.ndarray:
    return vdw(a) + vdw(b)


def no_hydrogen(a: Side, b: Side, _d2: np.ndarray) -> np.ndarray:
    return a.outside("el", "H", "D") & b.outside("el", "H", "D")


def disulfide(a: Side) -> np.ndarray:
    return a.within("resname", "CYS") & Bonded.of(a).kinds["sulfur"].any(axis=1)


def _ideal(side: Side) -> np.ndarray:
    hyb = side["hyb"]
    return np.where(hyb == 1, 180.0, np.where(hyb == 2, 120.0, 109.4721))


def _flat(side: Side, nbrs: Bonded, mask: np.ndarray, other: tuple, most: float) -> np.ndarray:
    """Whether `other` is near the plane of a planar side; the plane goes through two heavy neighbours, or one and the one beyond it."""
    n = mask.sum(axis=1)
    further = tuple(np.where(n >= 2, p, q) for p, q in zip(nbrs.pick(mask, 1), _second(side), strict=True))
    off = out_of_plane(side.place, nbrs.pick(mask, 0), further, other)
    return ~((side["hyb"] == 2) & (n >= 1)) | ~(off > most)  # a plane that isn't known forbids nothing


def _counted(d: Side, a: Side, at_d: Bonded) -> np.ndarray:
    """Heavy neighbours of the donor; of a sulfur outside polymers only those of usual elements."""
    cluster = d.within("el", "S") & d.outside("resname", *POLYMER)
    return at_d.heavy(a) & (~cluster[:, None] | at_d.kinds["binder"])


def hbond_donor(d: Side, a: Side, _d2: np.ndarray) -> np.ndarray:
    """Angles at the donor within 45 degrees of its ideal, and a hydrogen, if there are some, within 45 degrees of the way."""
    at_d = Bonded.of(d)
    turn, hs = angle(wide(sub(a.place, d.place)), sub(at_d.xyz, wide(d.place))), at_d.kinds["hydrogen"]
    off = (_counted(d, a, at_d) & (np.abs(turn - _ideal(d)[:, None]) > 45.0)).any(axis=1)
    return ~off & (~hs.any(axis=1) | (hs & (turn < 45.0)).any(axis=1))


def hbond_plane(d: Side, a: Side, _d2: np.ndarray) -> np.ndarray:
    """The acceptor within 45 degrees of the donor's plane."""
    at_d = Bonded.of(d)
    return _flat(d, at_d, _counted(d, a, at_d), a.place, 45.0)


def hbond_acceptor(d: Side, a: Side, _d2: np.ndarray) -> np.ndarray:
    """Angles at the acceptor at least its ideal less 45 degrees, as seen from the nearest hydrogen or else the donor, which is within 90 degrees of its plane."""
    at_d, at_a = Bonded.of(d), Bonded.of(a)
    hs, an = at_d.kinds["hydrogen"], at_a.heavy(d)
    has_h, away = hs.any(axis=1), sub(at_d.xyz, wide(a.place))
    key, nearest = hs, []
    for values in (dot(away, away), *at_d.xyz):  # of several hydrogens as near the one with the least coordinates
        least = np.where(key, values, np.inf).min(axis=1)
        key = key & (values == least[:, None])
        nearest.append(least)
    p = tuple(np.where(has_h, h, own) for h, own in zip(nearest[1:], d.place, strict=True))
    sharp = angle(wide(sub(p, a.place)), sub(at_a.xyz, wide(a.place))) < (_ideal(a) - 45.0)[:, None]
    return ~(an & sharp).any(axis=1) & _flat(a, at_a, an, p, 90.0)


def halogen_geometry(d: Side, a: Side, _d2: np.ndarray) -> np.ndarray:
    """One heavy neighbour at the donor, nearly opposite; acceptor neighbours at 90 degrees or more."""
    at_d, at_a, to = Bonded.of(d), Bonded.of(a), sub(a.place, d.place)
    dn, an = at_d.heavy(a), at_a.heavy(d)
    straight = (dn & (180.0 - angle(wide(to), sub(at_d.xyz, wide(d.place))) <= 30.0)).any(axis=1)
    narrow = (an & (angle(wide(sub(d.place, a.place)), sub(at_a.xyz, wide(a.place))) < 90.0)).any(axis=1)
    return (dn.sum(axis=1) == 1) & straight & an.any(axis=1) & ~narrow


def hydrogen_near(d: Side, a: Side, _d2: np.ndarray) -> np.ndarray:
    """A bonded hydrogen within the van der Waals radii of acceptor and hydrogen and 0.1."""
    n, reach = Bonded.of(d), vdw(a) + topo.VDW["H"] + 0.1
    v = sub(n.xyz, wide(a.place))
    return (n.kinds["hydrogen"] & (dot(v, v) <= (reach * reach)[:, None])).any(axis=1)


def hydrogen_angle(least: float) -> Callable:
    """A bonded hydrogen with donor-hydrogen-acceptor angle of at least `least` radians."""

    def test(d: Side, a: Side, _d2: np.ndarray) -> np.ndarray:
        n = Bonded.of(d)
        return (n.kinds["hydrogen"] & (angle(sub(wide(d.place), n.xyz), sub(wide(a.place), n.xyz)) >= math.degrees(least))).any(axis=1)

    return test


@dataclass(frozen=True)
class AtomRule:
    type: str
    left: tuple[str, ...]  # any of these bits; empty for any atom
    right: tuple[str, ...]
    reach: float
    tests: tuple[Callable[[Side, Side, np.ndarray], np.ndarray], ...]  # over left, right, squared distance
    symmetric: bool = False
    bonds: bool = False  # whether a test looks at bonded neighbours


def _within(least: float, most: float) -> Callable:
    return lambda a, b, d2: (d2 >= least) & (d2 <= most)


def _far(k: int) -> Callable:
    return lambda a, b, d2: apart(a, b, k)


def _metal(m: Side, p: Side, _d2: np.ndarray) -> np.ndarray:
    return np.where(is_type(m, "TransitionMetal"), is_type(p, "DativeBondPartner"), is_type(m, "IonicTypeMetal") & is_type(p, "IonicTypePartner"))


def _molstar_hbond(sulfur: float, least: float) -> tuple:
    def near(d: Side, a: Side, d2: np.ndarray) -> np.ndarray:
        reach = np.where(d.within("el", "S") | a.within("el", "S"), sulfur, 3.5)
        return (d2 >= least) & (d2 <= reach * reach)

    return near, lambda d, a, d2: not_own_residue(d, a) & some_dry(d, a), hbond_donor, hbond_plane, hbond_acceptor


MOLSTAR = (
    AtomRule("HydrogenBond", ("HbondDonor",), ("HbondAcceptor",), 4.1, _molstar_hbond(4.1, 2.0), bonds=True),
    AtomRule("WeakHydrogenBond", ("WeakHbondDonor",), ("HbondAcceptor",), 4.1, _molstar_hbond(3.5, 0.0), bonds=True),
    AtomRule("Hydrophobic", ("Hydrophobic",), ("Hydrophobic",), 4.0, (_within(0.0, 16.0), _far(0), lambda a, b, d2: a.outside("el", "F") | b.outside("el", "F")), True),
    AtomRule("Halogen", ("XbondDonor",), ("XBondAcceptor",), 4.0, (_within(0.0, 16.0), halogen_geometry), bonds=True),
    # a metal within its own residue is bonded, not in contact
    AtomRule("MetalCoordination", ("TransitionMetal", "IonicTypeMetal"), ("DativeBondPartner", "IonicTypePartner"), 3.0, (_within(0.0, 9.0), _metal, lambda m, p, d2: other_residue(m, p), lambda m, p, d2: ~bonded(m, p)), bonds=True),
)

ARPEGGIO = (
    AtomRule("HydrogenBond", ("HbondDonor",), ("HbondAcceptor",), 4.5, (_far(1), hydrogen_near, hydrogen_angle(1.57)), bonds=True),
    AtomRule("WeakHydrogenBond", ("WeakHbondDonor",), ("HbondAcceptor",), 4.5, (_far(1), hydrogen_near, hydrogen_angle(2.27)), bonds=True),
    AtomRule("PolarHydrogenBond", ("HbondDonor",), ("HbondAcceptor",), 3.5, (_within(0.0, 12.25), _far(1))),
    AtomRule("WeakPolarHydrogenBond", ("WeakHbondDonor",), ("HbondAcceptor",), 3.5, (_within(0.0, 12.25), _far(1))),
    AtomRule("Hydrophobic", ("Hydrophobic",), ("Hydrophobic",), 4.5, (_far(1),), True),
    AtomRule("VanDerWaals", (), (), 4.5, (lambda a, b, d2: (lambda d, s: (d >= s) & (d <= s + 0.1))(np.sqrt(d2), vdw_sum(a, b)), no_hydrogen, _far(1)), True),
    AtomRule("Ionic", ("PositiveCharge",), ("NegativeCharge",), 4.0, (_within(0.0, 16.0), _far(1))),
    AtomRule("Aromatic", ("Aromatic",), ("Aromatic",), 4.0, (_within(0.0, 16.0), _far(1)), True),
    AtomRule("Carbonyl", ("CarbonylCarbon",), ("CarbonylOxygen",), 3.6, (_within(0.0, 12.96), _far(1))),
)

GETCONTACTS = (
    AtomRule("Ionic", ("NegativeCharge",), ("PositiveCharge",), 5.0, (_within(0.0, 16.0),)),
    AtomRule("HydrogenBond", ("HbondDonor",), ("HbondAcceptor",), 4.5, (_within(0.0, 12.25), lambda d, a, d2: d.outside("el", "S") & a.outside("el", "S"), _far(0))),
    AtomRule("Hydrophobic", ("Hydrophobic",), ("Hydrophobic",), 3.9, (lambda a, b, d2: a.within("el", "C") & b.within("el", "C"), _far(1), lambda a, b, d2: (np.sqrt(d2) < vdw_sum(a, b) + 0.5) & (d2 <= 15.21)), True),
    AtomRule("VanDerWaals", (), (), 4.5, (lambda a, b, d2: np.sqrt(d2) <= vdw_sum(a, b) + 0.5, no_hydrogen, _far(1), lambda a, b, d2: ~(disulfide(a) & disulfide(b))), True, True),
)


def passed(tests: tuple, a: Side, b: Side, d2: np.ndarray) -> np.ndarray:
    """Places of the pairs that pass all tests, each of which sees what the ones before left."""
    left = np.arange(len(d2))
    for test in tests:
        if not len(left):
            break
        left = left[test(a.at(left), b.at(left), d2[left])]
    return left


def atom_tests(rules: tuple[AtomRule, ...]) -> Callable:
    """A classifier of pairs of atoms: every rule in both orientations, a pair once, alternates that can't meet never."""
    mask = lambda names: sum(topo.TYPES[n] for n in names)

    def classify(columns: Columns, i: np.ndarray, j: np.ndarray, d2: np.ndarray) -> Iterator:
        altloc = columns["altloc"]
        empty = columns.within("altloc", ("",), True)
        meet = np.flatnonzero(empty[i] | empty[j] | (altloc[i] == altloc[j]))
        if len(meet) < len(i):
            i, j, d2 = i[meet], j[meet], d2[meet]
        bits = columns["atom_type"]
        ti, tj = bits[i], bits[j]
        for number, r in enumerate(rules):
            fit = lambda t, names: (t & mask(names)) != 0 if names else np.ones(len(t), dtype=bool)
            near = d2 <= r.reach * r.reach
            found = np.zeros(len(i), dtype=bool)
            for a, b, ta, tb in ((i, j, ti, tj),) if r.symmetric else ((i, j, ti, tj), (j, i, tj, ti)):
                some = np.flatnonzero(near & ~found & fit(ta, r.left) & fit(tb, r.right))
                found[some[passed(r.tests, Side(columns, a[some]), Side(columns, b[some]), d2[some])]] = True
            yield number, meet[np.flatnonzero(found)]

    return classify


# rings: a side has the centre as its place and the normal as nx, ny, nz


def normal(side: Side) -> tuple:
    return tuple(side[f"n{c}"] for c in "xyz")


def of_kinds(classify: Callable) -> Callable:
    """A classifier from one that gives the number of each pair's kind, -1 for none."""

    def each(columns: Columns, i: np.ndarray, j: np.ndarray, d2: np.ndarray) -> Iterator:
        kind = classify(Side(columns, i), Side(columns, j), d2)
        for number in range(int(kind.max()) + 1 if len(kind) else 0):
            yield number, np.flatnonzero(kind == number)

    return each


def molstar_stack(a: Side, b: Side, d2: np.ndarray) -> np.ndarray:
    """0 for parallel, 1 for T-shaped."""
    out = np.full(len(d2), -1)
    some = passed((lambda a, b, d2: (d2 <= 30.25) & other_residue(a, b), lambda a, b, d2: np.fmin(plane_offset(b.place, a.place, normal(a)), plane_offset(a.place, b.place, normal(b))) <= 2.0), a, b, d2)
    degrees = acute(angle(normal(a.at(some)), normal(b.at(some))))
    out[some] = np.where(degrees <= 30.0, 0, np.where(np.abs(degrees - 90.0) <= 30.0, 1, -1))
    return out


def getcontacts_stack(a: Side, b: Side, d2: np.ndarray) -> np.ndarray:
    """0 for parallel, 1 for T-shaped."""

    def tilted(a: Side, b: Side, _d2: np.ndarray) -> np.ndarray:
        return np.fmin(acute(angle(normal(a), sub(b.place, a.place))), acute(angle(normal(b), sub(a.place, b.place)))) <= 45.0

    out = np.full(len(d2), -1)
    some = passed((lambda a, b, d2: d2 <= 49.0, lambda a, b, d2: other_residue(a, b), tilted), a, b, d2)
    degrees = angle(normal(a.at(some)), normal(b.at(some)))
    out[some] = np.where(acute(degrees) <= 30.0, 0, np.where((d2[some] <= 25.0) & (np.abs(degrees - 90.0) <= 30.0), 1, -1))
    return out


def over_ring(reach_sq: float, most: float | None = None, offset: float | None = None, apart: bool = False) -> Callable:
    """0 for points within reach of a ring, whose way to it is at most `most` degrees off the ring's axis or at most `offset` from it, if asked in another residue."""

    def classify(p: Side, r: Side, d2: np.ndarray) -> np.ndarray:
        tests = [lambda p, r, d2: d2 <= reach_sq]
        if apart:
            tests.append(lambda p, r, d2: other_residue(p, r))
        if most is not None:
            tests.append(lambda p, r, d2: acute(angle(normal(r), sub(p.place, r.place))) <= most)
        if offset is not None:
            tests.append(lambda p, r, d2: plane_offset(p.place, r.place, normal(r)) <= offset)
        out = np.full(len(d2), -1)
        out[passed(tuple(tests), p, r, d2)] = 0
        return out

    return classify

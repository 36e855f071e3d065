"""Solvent-accessible surface area (Shrake and Rupley 1973).

Atoms are dealt to blocks of space, each with the atoms around it that may shade its own, so a large assembly is many
tasks; the sphere around an atom is probed at `points` places, each place against all neighbours at once. A kernel takes
many blocks of the sorted stream together and works on numpy arrays over all their atoms.

Defined cases: models, frames and incompatible alternate locations don't shade each other; atoms with one id don't
either; an atom whose centre coincides with another's has no area and an error; a negative or non-finite radius has area 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.interactions import contact_label
from helixframe.operators.kernels import Grid, block_width, in_blocks, whole_groups

PROBE, POINTS = 1.4, 100
BLOCK, FULL, MEASURED = 48.0, 1 << 16, 2048  # width of a block, atoms of one, atoms whose points are tested together
MANY, SOME, TESTS = 1024, (16, 64, 256), 1 << 19  # atoms around one from which on some come first; how many; tests of a spot against an atom at a time

# Van der Waals radii by element (Bondi 1964 and later additions).
VDW = {"H": 1.2, "C": 1.7, "N": 1.55, "O": 1.52, "F": 1.47, "P": 1.8, "S": 1.8, "CL": 1.75, "BR": 1.85, "I": 1.98, "SE": 1.9, "ZN": 1.39, "MG": 1.73, "FE": 2.0, "CA": 2.31, "NA": 2.27, "K": 2.75}
# United-atom radii of protein atoms by chemistry (Tsai et al. 1999).
N_ANY, S_ANY, O_BARE, O_HYDROGEN, C_PLANAR, C_PLANAR_H, C_TETRAHEDRAL = 1.64, 1.77, 1.42, 1.46, 1.61, 1.76, 1.88
HYDROXYLS = ("OG", "OG1", "OH", "OD2", "OE2", "OXT")
PLANAR_BARE = {"PHE": ("CG",), "TYR": ("CG", "CZ"), "TRP": ("CG", "CD2", "CE2"), "HIS": ("CG",), "ASP": ("CG",), "ASN": ("CG",), "GLU": ("CD",), "GLN": ("CD",), "ARG": ("CZ",)}
PLANAR_H = {"PHE": ("CD1", "CD2", "CE1", "CE2", "CZ"), "TYR": ("CD1", "CD2", "CE1", "CE2"), "TRP": ("CD1", "CE3", "CZ2", "CZ3", "CH2"), "HIS": ("CD2", "CE1")}


def sphere(n: int) -> np.ndarray:
    """n nearly even points of the unit sphere on a golden spiral."""
    k = np.arange(n) + 0.5
    z = 1 - 2 * k / n
    r = np.sqrt(np.maximum(0, 1 - z * z))
    turn = np.pi * (3 - math.sqrt(5)) * np.arange(n)
    return np.stack([r * np.cos(turn), r * np.sin(turn), z], axis=1)


def check(probe: float, points: int) -> None:
    if not math.isfinite(probe) or probe < 0:
        raise ValueError("the probe must be finite and not negative")
    if points <= 0:
        raise ValueError("the number of points must be above zero")


def _in(table: dict[str, tuple]) -> Column:
    return F.concat_ws(":", F.upper("resname"), F.upper("name")).isin(*[f"{r}:{n}" for r, names in table.items() for n in names])


def element_radius(element: str = "element") -> Column:
    """Radius by element; 1.7 for others."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in VDW.items() for x in kv]), F.upper(F.trim(element))), F.lit(1.7))


def united_radius() -> Column:
    """United-atom radius of a protein atom from resname and name; null for atoms of other residues and hydrogens."""
    name, first = F.upper("name"), F.substring(F.upper("name"), 1, 1)
    standard = F.upper("resname").isin("ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL")
    carbon = F.when((name == "C") | _in(PLANAR_BARE), C_PLANAR).when(_in(PLANAR_H), C_PLANAR_H).otherwise(C_TETRAHEDRAL)
    return F.when(standard, F.when(first == "N", N_ANY).when(first == "S", S_ANY).when(first == "O", F.when(name.isin(*HYDROXYLS), O_HYDROGEN).otherwise(O_BARE)).when(first == "C", carbon))


def atom_label() -> Column:
    """idx-name-resid-resname-chain, the label of an atom in reports of areas."""
    return contact_label(F.col("atom_id"), F.col("name"), F.col("resid"), F.col("resname"), F.col("chain"))


def _coincident(xyz: np.ndarray, group: np.ndarray, ids: np.ndarray, altloc: np.ndarray) -> np.ndarray:
    """Whether another atom (of another id, at no other alternate location) has the very same centre; by counting, not by pairs."""
    number = lambda *columns: np.unique(np.stack(columns, axis=1), axis=0, return_inverse=True)[1].ravel()
    place = number(group.astype(float), *(xyz + 0.0).T)  # -0.0 is 0.0
    out = np.zeros(len(xyz), dtype=bool)
    shared = np.flatnonzero(np.bincount(place)[place] > 1)
    if not len(shared):
        return out
    place, ids, altloc = place[shared], ids[shared], altloc[shared]
    names, where = np.unique(altloc, return_inverse=True)
    count = lambda *columns: (lambda k: np.bincount(k)[k])(number(*columns))
    plain = where == np.searchsorted(names, "") if "" in names else np.zeros(len(shared), dtype=bool)
    held = lambda key: np.bincount(key, weights=plain)[key]
    one = number(place, ids)
    all_met = np.where(plain, np.bincount(place)[place], count(place, where) + held(place))
    own_met = np.where(plain, np.bincount(one)[one], count(place, ids, where) + held(one))
    out[shared] = all_met > own_met
    return out


def _limits(xyz, grown, ids, altloc, a: np.ndarray, b: np.ndarray, d2: np.ndarray) -> np.ndarray:
    """How far along a spot's direction from b to a it must lie for b not to shade it; minus infinity for atoms that don't shade each other."""
    limit = (grown[b] ** 2 - d2 - grown[a] ** 2) / (2 * grown[a])
    apart = (d2 == 0) | (ids[a] == ids[b]) | ((altloc[a] != "") & (altloc[b] != "") & (altloc[a] != altloc[b]))
    return np.where(apart, -np.inf, limit)


def _free_spots(xyz, grown, group, ids, altloc, kept, grid, spheres, who, dots) -> np.ndarray:
    """How many spots of each atom of `who` are free, where atoms are crowded: most spots are shaded by some of a few neighbours, spots that aren't meet all atoms around them."""
    low, high = grid.runs(grid._queries(xyz[who], group[who]))
    ends = np.vstack([np.zeros(len(who), dtype=np.int64), np.cumsum(high - low, axis=0)])
    atom, spot = (x.ravel() for x in np.meshgrid(np.arange(len(who)), np.arange(len(dots)), indexing="ij"))
    for some in SOME:
        if not len(atom):
            break
        asked = np.unique(atom)
        at = (np.arange(some)[None] * ends[-1][asked][:, None]) // some  # evenly over the cubes around
        run = sum((at >= ends[k][asked][:, None]).astype(np.int64) for k in range(1, len(ends) - 1))
        b = kept[grid.order[low[run, asked[:, None]] + at - ends[run, asked[:, None]]]]
        a = np.broadcast_to(who[asked][:, None], b.shape)
        v = xyz[a] - xyz[b]
        limit = _limits(xyz, grown, ids, altloc, a, b, v[..., 0] ** 2 + v[..., 1] ** 2 + v[..., 2] ** 2)
        of = np.searchsorted(asked, atom)
        free = np.ones(len(atom), dtype=bool)
        for start in range(0, len(atom), max(1, TESTS // some)):
            part = slice(start, start + max(1, TESTS // some))
            d = dots[spot[part]]
            along = v[of[part], :, 0] * d[:, :1] + v[of[part], :, 1] * d[:, 1:2] + v[of[part], :, 2] * d[:, 2:]
            free[part] = ~(along <= limit[of[part]]).any(axis=1)
        atom, spot = atom[free], spot[free]
    if len(atom):
        a = who[atom]
        free = np.ones(len(atom), dtype=bool)
        for i, j, _ in spheres.near(xyz[a] + grown[a][:, None] * dots[spot], group[a]):
            b = kept[j]
            v, d = xyz[a[i]] - xyz[b], dots[spot[i]]
            limit = _limits(xyz, grown, ids, altloc, a[i], b, (v * v).sum(axis=1))
            free[i[(v * d).sum(axis=1) <= limit]] = False
        atom = atom[free]
    return np.bincount(atom, minlength=len(who))


def measure(xyz: np.ndarray, radii: np.ndarray, group: np.ndarray, who: np.ndarray, probe: float = PROBE, points: int = POINTS, ids: np.ndarray | None = None, altloc: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Areas of the atoms `who`, and whether another centre coincides with theirs. Memory is bounded by the atoms, however crowded they are."""
    out, same = np.zeros(len(who)), np.zeros(len(who), dtype=bool)
    valid = np.isfinite(radii) & (radii >= 0) & np.isfinite(xyz).all(axis=1)
    grown = np.where(valid, radii + probe, 0.0)
    if not valid.any():
        return out, same
    ids = np.arange(len(xyz)) if ids is None else ids
    altloc = np.full(len(xyz), "") if altloc is None else altloc
    dots = sphere(points)
    kept = np.flatnonzero(valid)
    grid = Grid(xyz[kept], group[kept], max(2 * float(grown.max()), 1e-6))
    met = np.zeros(len(xyz), dtype=bool)
    met[kept] = _coincident(xyz[kept], group[kept], ids[kept], altloc[kept])
    same[:] = met[who]
    place = np.full(len(xyz), -1)
    place[kept] = np.arange(len(kept))
    asked = np.flatnonzero(valid[who])
    spheres = None
    around = np.concatenate([grid.counts(xyz[who[p]], group[who[p]]) for p in np.array_split(asked, len(asked) // MEASURED + 1)])
    for start in range(0, len(asked), MEASURED):
        part, n = asked[start : start + MEASURED], around[start : start + MEASURED]
        many = part[(n > MANY) & (grown[who[part]] > 0)]
        if len(many):
            spheres = spheres or Grid(xyz[kept], group[kept], max(float(grown.max()) * (1 + 1e-6), 1e-6))  # what shades a spot has it within its own sphere
            out[many] = 4 * math.pi * grown[who[many]] ** 2 * _free_spots(xyz, grown, group, ids, altloc, kept, grid, spheres, who[many], dots) / points
        part = part[~((n > MANY) & (grown[who[part]] > 0))]
        i, j, d2 = grid.pairs(place[who[part]])
        a, b = who[part][i], kept[j]
        near = (d2 <= (grown[a] + grown[b]) ** 2) & (d2 > 0) & (grown[a] > 0)
        i, a, b, d2 = i[near], a[near], b[near], d2[near]
        r = grown[who[part]]
        free = np.full(len(part), points)
        if len(i):
            shaded = (xyz[a] - xyz[b]) @ dots.T <= _limits(xyz, grown, ids, altloc, a, b, d2)[:, None]
            first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            free[i[first]] = points - np.logical_or.reduceat(shaded, first, axis=0).sum(axis=1)
        out[part] = 4 * math.pi * r**2 * free / points
    return out, same


def areas(xyz: np.ndarray, radii: np.ndarray, probe: float = PROBE, points: int = POINTS, ids: np.ndarray | None = None) -> np.ndarray:
    """Area per atom of one structure. A negative or non-finite radius gives 0; atoms with one id don't shade each other; other coincident centres raise."""
    check(probe, points)
    found, same = measure(xyz, radii, np.zeros(len(xyz), dtype=np.int64), np.arange(len(xyz)), probe, points, ids) if len(xyz) else (np.zeros(0), np.zeros(0, dtype=bool))
    if same.any():
        raise ValueError("two atoms have the same centre")
    return found


def _batches(batches: Iterator, keys: list[str], probe: float, points: int, decimals: int | None) -> Iterator:
    import pyarrow as pa

    for table, group in whole_groups(batches, [*keys, "block"]):
        column = lambda c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False)  # noqa: B023, E731
        xyz = np.stack([column(c).astype(float) for c in "xyz"], axis=1)
        own = np.flatnonzero(column("own"))
        if not len(own):
            continue
        codes = table.column("atom_id").combine_chunks().dictionary_encode().indices.to_numpy()
        found, same = measure(xyz, column("radius").astype(float), group, own, probe, points, codes, column("altloc").astype(str))
        found = np.round(found, decimals) if decimals is not None else found
        kept = table.select([*keys, "atom_id"]).take(pa.array(own)).combine_chunks()
        error = pa.array(["two atoms have the same centre" if x else None for x in same], pa.string())
        for part in kept.append_column("area", pa.array(found, mask=same)).append_column("error", error).to_batches():
            yield part


def sasa(atoms: DataFrame, model: list[str] | str | None = None, radius: str | Column | None = None, probe: float = PROBE, points: int = POINTS, decimals: int | None = 3) -> DataFrame:
    """(model_id, frame, atom_id, area, error) from atoms (model_id, atom_id, element, x, y, z, optionally frame and altloc).

    model names the columns that tell structures apart (by default model_id and, where there is one, frame); radius is a
    column to use instead of the element's radius.
    """
    check(probe, points)
    keys = [model] if isinstance(model, str) else model or [c for c in ("model_id", "frame") if c in atoms.columns]
    size = element_radius() if radius is None else F.col(radius) if isinstance(radius, str) else radius
    altloc = F.coalesce("altloc", F.lit("")) if "altloc" in atoms.columns else F.lit("")
    rows = atoms.select(*keys, "atom_id", *[F.col(c).cast("double").alias(c) for c in "xyz"], size.cast("double").alias("radius"), altloc.alias("altloc"))
    largest = max(VDW.values()) if radius is None else rows.agg(F.max(F.when((F.col("radius") >= 0) & (F.col("radius") < float("inf")), F.col("radius")))).first()[0] or 0.0
    halo = 2 * (largest + probe)
    ordered = in_blocks(rows, keys, halo, block_width(rows, keys, halo, BLOCK, FULL))
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, "atom_id"))
    return ordered.mapInArrow(lambda b: _batches(b, keys, probe, points, decimals), f"{schema}, area double, error string")


# Radii of the accessibility of secondary structure assignments (Kabsch and Sander 1983), for N, CA, C, O and side chains.
ACCESS = {"N": 1.65, "CA": 1.87, "C": 1.76, "O": 1.40}
ACCESS_SIDE, ACCESS_POINTS = 1.80, 401


def accessibility(atoms: DataFrame, points: int = ACCESS_POINTS) -> DataFrame:
    """(model_id, frame, chain, resid, resname, accessibility): the water-accessible area of each residue, by its heavy atoms."""
    keys = [c for c in ("model_id", "frame") if c in atoms.columns]
    heavy = atoms.where(~F.upper(F.trim("element")).isin("H", "D"))
    size = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ACCESS.items() for x in kv]), F.col("name")), F.lit(ACCESS_SIDE))
    found = sasa(heavy, radius=size, points=points, decimals=None)
    met = heavy.select(*keys, "atom_id", "chain", "resid", "resname").join(found, [*keys, "atom_id"])
    return met.groupBy(*keys, "chain", "resid", "resname").agg(F.sum("area").alias("accessibility"))

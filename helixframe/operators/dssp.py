"""Secondary structure from backbone hydrogen bonds (Kabsch and Sander 1983).

States: H alpha helix, G 3-10 helix, I pi helix, P polyproline helix, E strand, B bridge, T turn, S bend and
C for the rest. The backbone of a residue is one row, from one aggregation. Hydrogen bonds are found for many models of
the sorted stream together; the assignment itself is sequential within a model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators.kernels import Grid, whole_groups

TOGETHER = 4096  # donors whose bonds are sought together

# Fixed values of the method.
COUPLING, BOND, LOWEST, CLOSE = 27.888, -0.5, -9.9, 0.5
CA_REACH, PEPTIDE, BEND_DEGREES = 9.0, 2.5, 70.0
PPII_PHI, PPII_PSI, PPII_WIDTH, PPII_STRETCH = -75.0, 145.0, 29.0, 2


def torsion(a, b, c, d) -> np.ndarray:
    b1, b2, b3 = b - a, c - b, d - c
    n1, n2 = np.cross(b1, b2), np.cross(b2, b3)
    return np.degrees(np.arctan2(np.linalg.norm(b2, axis=-1) * (b1 * n2).sum(-1), (n1 * n2).sum(-1)))


def breaks(c: np.ndarray, n: np.ndarray, chain: np.ndarray, seq: np.ndarray) -> np.ndarray:
    """breaks[i]: no peptide bond between residue i - 1 and i (true for i = 0)."""
    out = np.ones(len(n), dtype=bool)
    if len(n) > 1:
        far = np.linalg.norm(c[:-1] - n[1:], axis=1) > PEPTIDE
        out[1:] = far | (chain[1:] != chain[:-1]) | (seq[1:] - seq[:-1] != 1)
    return out


def hydrogen_bonds(n, ca, c, o, cut: np.ndarray, proline: np.ndarray, model: np.ndarray | None = None) -> list[list[tuple[int, float]]]:
    """For each residue as donor, its two best acceptors (index, energy); residues of different models don't meet."""
    size = len(n)
    h = n.copy()
    linked = np.flatnonzero(~cut)
    away = c[linked - 1] - o[linked - 1]
    h[linked] = n[linked] + away / np.linalg.norm(away, axis=1, keepdims=True)
    best: list[list[tuple[int, float]]] = [[] for _ in range(size)]
    grid = Grid(ca, np.zeros(size, dtype=np.int64) if model is None else model, CA_REACH)
    donors = np.flatnonzero(~proline)
    for start in range(0, len(donors), TOGETHER):
        who = donors[start : start + TOGETHER]
        at, acceptor, _ = grid.pairs(who)
        donor = who[at]
        keep = (acceptor != donor - 1) | cut[donor]
        donor, acceptor = donor[keep], acceptor[keep]
        ho, hc, nc, no = (np.linalg.norm(x[acceptor] - y[donor], axis=1) for x, y in ((o, h), (c, h), (c, n), (o, n)))
        close = np.minimum.reduce([ho, hc, nc, no]) < CLOSE
        with np.errstate(divide="ignore", invalid="ignore"):
            e = COUPLING * (-1 / ho + 1 / hc - 1 / nc + 1 / no)
        e = np.where(close, LOWEST, np.maximum(np.round(e, 3), LOWEST))
        order = np.lexsort((acceptor, e, donor))
        donor, acceptor, e = donor[order], acceptor[order], e[order]
        first = np.searchsorted(donor, donor, side="left")
        two = np.flatnonzero(np.arange(len(donor)) - first < 2)
        for i, a, energy in zip(donor[two].tolist(), acceptor[two].tolist(), e[two].tolist(), strict=True):
            best[i].append((a, energy))
    return best


def assign(n, ca, c, o, chain, seq, proline, prefer_pi: bool = True, best: list | None = None) -> str:
    """The state letters of residues in order; all arrays are per complete residue. best are the hydrogen bonds, where they are known."""
    size = len(n)
    if not size:
        return ""
    cut = breaks(c, n, chain, seq)
    segment = np.cumsum(cut).tolist()
    best = hydrogen_bonds(n, ca, c, o, cut, proline) if best is None else best
    bonded = [{a for a, e in b if e < BOND} for b in best]  # N-H of i to C=O of a

    def bond(donor: int, acceptor: int) -> bool:
        return 0 <= donor < size and 0 <= acceptor < size and acceptor in bonded[donor]

    def joined(i: int, j: int) -> bool:
        return 0 <= i <= j < size and segment[i] == segment[j]

    # bridges
    pairs: list[tuple[int, int, bool]] = []
    partners: dict[int, set[int]] = {}
    for i, b in enumerate(bonded):
        for a in b:
            for x, y in ((i, a), (i - 1, a), (i + 1, a), (i, a - 1), (i, a + 1), (i - 1, a - 1), (i + 1, a + 1), (i - 1, a + 1), (i + 1, a - 1)):
                lo, hi = min(x, y), max(x, y)
                if lo >= 0 and hi < size and hi - lo >= 3:
                    partners.setdefault(lo, set()).add(hi)
    for i in sorted(partners):
        for j in sorted(partners[i]):
            if not (joined(i - 1, i + 1) and joined(j - 1, j + 1)):
                continue
            if (bond(i + 1, j) and bond(j, i - 1)) or (bond(j + 1, i) and bond(i, j - 1)):
                pairs.append((i, j, True))
            elif (bond(i + 1, j - 1) and bond(j + 1, i - 1)) or (bond(j, i) and bond(i, j)):
                pairs.append((i, j, False))

    # ladders, joined over bulges
    ladders: list[dict] = []
    ends: dict[tuple, dict] = {}  # a ladder by the bridge that would go on with it
    for i, j, parallel in pairs:
        ladder = ends.pop((i, j, parallel), None)
        if ladder is None:
            ladder = {"parallel": parallel, "i": [], "j": []}
            ladders.append(ladder)
        ladder["i"].append(i)
        ladder["j"].insert(len(ladder["j"]) if parallel else 0, j)
        ends.setdefault((i + 1, j + 1 if parallel else j - 1, parallel), ladder)
    ladders.sort(key=lambda x: (x["i"][0], x["j"][0]))
    k = 0
    while k < len(ladders):
        a, m = ladders[k], k + 1
        while m < len(ladders):
            b = ladders[m]
            gap_i = b["i"][0] - a["i"][-1]
            gap_j = (b["j"][0] - a["j"][-1]) if a["parallel"] else (a["j"][0] - b["j"][-1])
            whole = joined(a["i"][0], b["i"][-1]) and joined(min(a["j"][0], b["j"][0]), max(a["j"][-1], b["j"][-1]))
            if a["parallel"] == b["parallel"] and whole and gap_i > 0 and gap_j > 0 and ((gap_j < 6 and gap_i < 3) or (gap_i < 6 and gap_j < 3)):
                a["i"] += b["i"]
                a["j"] = a["j"] + b["j"] if a["parallel"] else b["j"] + a["j"]
                ladders.pop(m)
            else:
                m += 1
        k += 1
    state = ["C"] * size
    for ladder in ladders:
        mark = "E" if len(ladder["i"]) > 1 else "B"
        for side in ("i", "j"):
            for r in range(min(ladder[side]), max(ladder[side]) + 1):
                if state[r] != "E":
                    state[r] = mark

    # helices and turns
    starts = {k: [joined(i, i + k) and bond(i + k, i) for i in range(size)] for k in (3, 4, 5)}

    def helix(k: int, letter: str, over: str) -> None:
        for i in range(1, size - k):
            if starts[k][i] and starts[k][i - 1] and all(state[r] in over for r in range(i, i + k)):
                for r in range(i, i + k):
                    state[r] = letter

    for i in range(1, size - 4):
        if starts[4][i] and starts[4][i - 1]:
            for r in range(i, i + 4):
                state[r] = "H"
    helix(3, "G", "CG")
    helix(5, "I", "CIH" if prefer_pi else "CI")
    ca_ok = np.zeros(size, dtype=bool)
    if size > 4:
        u, v = ca[2:-2] - ca[:-4], ca[4:] - ca[2:-2]
        cos = (u * v).sum(1) / np.maximum(np.linalg.norm(u, axis=1) * np.linalg.norm(v, axis=1), 1e-12)
        ca_ok[2:-2] = (np.degrees(np.arccos(np.clip(cos, -1, 1))) > BEND_DEGREES) & (np.array(segment[:-4]) == np.array(segment[4:]))
    turn = [any(starts[k][i - s] for k in (3, 4, 5) for s in range(1, k) if i - s >= 0) for i in range(size)]
    for i in range(size):
        if state[i] == "C":
            state[i] = "T" if turn[i] else "S" if ca_ok[i] else "C"

    # polyproline
    phi, psi = np.full(size, 360.0), np.full(size, 360.0)
    inner = np.flatnonzero(~cut)
    if len(inner):
        phi[inner] = torsion(c[inner - 1], n[inner], ca[inner], c[inner])
        psi[inner - 1] = torsion(n[inner - 1], ca[inner - 1], c[inner - 1], n[inner])
    fits = (np.abs(phi - PPII_PHI) <= PPII_WIDTH) & (np.abs(psi - PPII_PSI) <= PPII_WIDTH)
    i = 0
    while i < size:
        j = i
        while j < size and fits[j] and segment[j] == segment[i]:
            j += 1
        if j - i >= PPII_STRETCH:
            for r in range(i, j):
                if state[r] == "C":
                    state[r] = "P"
        i = max(j, i + 1)
    return "".join(state)


def backbone(atoms: DataFrame, keys: list[str]) -> DataFrame:
    """One row per complete residue: keys, chain, resid, insertion, resname, place (of its first atom) and the positions of N, CA, C and O.

    Of several alternates of an atom the first stands for it.
    """
    insertion = F.coalesce("insertion", F.lit("")) if "insertion" in atoms.columns else F.lit("")
    order = F.col("atom_id") if "atom_id" in atoms.columns else F.lit(0)
    rows = atoms.where(F.col("name").isin("N", "CA", "C", "O")).select(*keys, "chain", "resid", insertion.alias("insertion"), "resname", "name", order.alias("place"), F.struct(*[F.col(c).cast("double").alias(c) for c in "xyz"]).alias("p"))
    pick = [F.min_by(F.when(F.col("name") == a, F.col("p")), F.when(F.col("name") == a, F.struct("place", "p"))).alias(a) for a in ("N", "CA", "C", "O")]
    found = rows.groupBy(*keys, "chain", "resid", "insertion", "resname").agg(F.min("place").alias("place"), *pick)
    whole = found.where(" AND ".join(f"{a} IS NOT NULL" for a in ("N", "CA", "C", "O")))
    return whole.select(*keys, "chain", "resid", "insertion", "resname", "place", *[F.col(f"{a}.{c}").alias(f"{a}_{c}") for a in ("N", "CA", "C", "O") for c in "xyz"])


def _batches(batches: Iterator, keys: list[str], prefer_pi: bool) -> Iterator:
    import pyarrow as pa

    for table, group in whole_groups(batches, keys):
        column = lambda c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False)  # noqa: B023, E731
        n, ca, c, o = (np.stack([column(f"{a}_{x}") for x in "xyz"], axis=1) for a in ("N", "CA", "C", "O"))
        chain, seq, proline = column("chain"), column("resid").astype(np.int64), column("resname") == "PRO"
        cut = breaks(c, n, chain, seq)
        cut[np.flatnonzero(np.r_[True, group[1:] != group[:-1]])] = True
        best = hydrogen_bonds(n, ca, c, o, cut, proline, group)
        starts = np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(group)].tolist()
        letters = []
        for a, b in zip(starts, starts[1:], strict=False):
            own = [[(j - a, e) for j, e in part] for part in best[a:b]]
            letters += assign(n[a:b], ca[a:b], c[a:b], o[a:b], chain[a:b], seq[a:b], proline[a:b], prefer_pi, own)
        yield from table.select([*keys, "chain", "resid", "insertion", "resname"]).append_column("state", pa.array(letters, pa.string())).to_batches()


def dssp(atoms: DataFrame, model: list[str] | str | None = None, prefer_pi: bool = True) -> DataFrame:
    """(model_id, frame, chain, resid, insertion, resname, state) of complete residues, in the order of the file.

    From atoms (model_id, chain, resid, resname, name, x, y, z, optionally frame, atom_id and insertion); model names the
    columns that tell structures apart (by default model_id and, where there is one, frame). Residues stand in the order of
    their first atoms, or by chain and number where there is no atom_id.
    """
    keys = [model] if isinstance(model, str) else model or [c for c in ("model_id", "frame") if c in atoms.columns]
    rows = backbone(atoms, keys)
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "place", "chain", "resid", "insertion")
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, "chain", "resid", "insertion", "resname"))
    return ordered.mapInArrow(lambda b: _batches(b, keys, prefer_pi), f"{schema}, state string")

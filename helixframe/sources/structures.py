"""Structure files as DataFrames: mmCIF, PDB and GRO text to atoms, multi-model files to frames.

Files are read by Spark's binaryFile source, so any path that Spark can open works, and parsed in Arrow
batches on the executors. A file that can't be parsed becomes one row with its error, never a failed job.
"""

from __future__ import annotations

import gzip
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATOMS = (
    "model_id string, frame int, atom_id int, element string, name string, resname string, resid int, chain string, altloc string, is_het boolean, "
    "formal_charge int, occupancy double, b_factor double, auth_resid int, label_chain string, label_resname string, x double, y double, z double, error string"
)
_NAMES = [p.split()[0] for p in ATOMS.split(", ")]

_CIF = re.compile(r"'((?:[^'\n]|'(?=\S))*)'(?=\s|$)|\"((?:[^\"\n]|\"(?=\S))*)\"(?=\s|$)|(#[^\n]*)|([^\s]+)")


def cif_tokens(text: str) -> Iterator[tuple[str, bool]]:
    """(token, quoted) of CIF text, with text blocks between lines that start with a semicolon."""
    parts = re.split(r"(?m)^;", text)
    for i, part in enumerate(parts):
        if i % 2:
            yield part.rstrip("\n"), True
            continue
        for m in _CIF.finditer(part):
            if m.group(3) is None:
                quoted = m.group(4) is None
                yield (m.group(1) if m.group(1) is not None else m.group(2) if m.group(2) is not None else m.group(4)), quoted


def cif_categories(text: str) -> dict[str, dict[str, list[str]]]:
    """Category -> item -> values, for loops and single items alike; values of '.' and '?' become ''."""
    out: dict[str, dict[str, list[str]]] = {}
    tokens = list(cif_tokens(text))
    at, n = 0, len(tokens)
    plain = lambda t: "" if not t[1] and t[0] in (".", "?") else t[0]
    while at < n:
        token, quoted = tokens[at]
        if not quoted and token.lower() == "loop_":
            at += 1
            names = []
            while at < n and not tokens[at][1] and tokens[at][0].startswith("_"):
                names.append(tokens[at][0])
                at += 1
            values = []
            while at < n and (tokens[at][1] or not re.match(r"_|loop_$|data_|save_", tokens[at][0], re.IGNORECASE)):
                values.append(plain(tokens[at]))
                at += 1
            if names and len(values) % len(names):
                raise ValueError(f"the loop of {names[0]} has an incomplete row")
            for i, name in enumerate(names):
                category, _, item = name.partition(".")
                out.setdefault(category.lower(), {})[item.lower()] = values[i :: len(names)]
        elif not quoted and token.startswith("_") and at + 1 < n:
            category, _, item = token.partition(".")
            out.setdefault(category.lower(), {})[item.lower()] = [plain(tokens[at + 1])]
            at += 2
        else:
            at += 1
    return out


def json_categories(text: str) -> dict[str, dict[str, list[str]]]:
    """The categories of an mmJSON text: one data block of columns; null and missing values are empty, as in mmCIF."""
    data = json.loads(text)
    block = next((v for k, v in data.items() if k.startswith("data_")), None)
    if block is None:
        raise ValueError("no data block")
    plain = lambda v: "" if v is None else str(v)
    return {f"_{c.lower().lstrip('_')}": {i.lower(): [plain(v) for v in values] for i, values in items.items()} for c, items in block.items()}


def parse_mmjson(text: str) -> list[dict]:
    return atom_rows(json_categories(text))


def parse_component(text: str) -> list[dict]:
    """Atom rows of a chemical component: its ideal coordinates, or the model's where they are missing; bonds come from `component_bonds`."""
    atoms = cif_categories(text).get("_chem_comp_atom")
    if not atoms:
        raise ValueError("no _chem_comp_atom category")
    number = lambda v: float(v) if v not in ("", "?", ".") else None
    rows = []
    for i, name in enumerate(atoms["atom_id"]):
        ideal, model = ([number(atoms[k % c][i]) if k % c in atoms else None for c in "xyz"] for k in ("pdbx_model_cartn_%s_ideal", "model_cartn_%s"))
        place = ideal if None not in ideal else model
        if None in place:
            raise ValueError(f"atom {name} has no coordinates")
        rows.append({
            "frame": 0, "atom_id": i, "element": atoms["type_symbol"][i].capitalize(), "name": name, "resname": atoms["comp_id"][i], "resid": 1, "chain": "A", "altloc": "", "is_het": True, "formal_charge": int(atoms.get("charge", [""] * (i + 1))[i] or 0),
            "occupancy": 1.0, "b_factor": 0.0, "auth_resid": 1, "label_chain": "A", "label_resname": atoms["comp_id"][i], "x": place[0], "y": place[1], "z": place[2],
        })
    return rows


# Bond orders of chemical components.
ORDERS = {"SING": 1, "DOUB": 2, "TRIP": 3, "AROM": 4}


def component_bonds(text: str) -> list[dict]:
    """Bonds of a chemical component: places of its atoms, order and whether it is aromatic."""
    cats = cif_categories(text)
    at = {name: i for i, name in enumerate(cats["_chem_comp_atom"]["atom_id"])}
    found = cats.get("_chem_comp_bond")
    if not found:
        return []
    flags = found.get("pdbx_aromatic_flag", ["N"] * len(found["atom_id_1"]))
    return [{"a": at[a], "b": at[b], "order": ORDERS.get(o.upper(), 1), "aromatic": f == "Y"} for a, b, o, f in zip(found["atom_id_1"], found["atom_id_2"], found["value_order"], flags, strict=True)]


def parse_mmcif(text: str) -> list[dict]:
    """Atom rows of coordinates, or of a chemical component where there are none."""
    cats = cif_categories(text)
    return atom_rows(cats) if "_atom_site" in cats or "_chem_comp_atom" not in cats else parse_component(text)


def atom_rows(categories: dict) -> list[dict]:
    """Atom rows. Author names are preferred for chain, residue and atom; residue numbers are label_seq_id where present."""
    site = categories.get("_atom_site")
    if not site:
        raise ValueError("no _atom_site category")
    n = len(site["cartn_x"])
    get = lambda *names: next((site[k] for k in names if k in site), [""] * n)
    best = lambda a, b: [x or y for x, y in zip(get(a), get(b), strict=True)]
    chain, comp, atom = best("auth_asym_id", "label_asym_id"), best("auth_comp_id", "label_comp_id"), best("auth_atom_id", "label_atom_id")
    seq = best("label_seq_id", "auth_seq_id")
    rows, model_of, sizes = [], {}, {}
    for i in range(n):
        model = get("pdbx_pdb_model_num")[i] or "1"
        frame = model_of.setdefault(model, len(model_of))
        sizes[frame] = sizes.get(frame, 0) + 1
        rows.append({
            "frame": frame, "atom_id": sizes[frame] - 1, "element": get("type_symbol")[i], "name": atom[i], "resname": comp[i], "resid": int(seq[i] or 0), "chain": chain[i],
            "altloc": get("label_alt_id")[i], "is_het": get("group_pdb")[i] == "HETATM", "formal_charge": int(get("pdbx_formal_charge")[i] or 0),
            "occupancy": float(get("occupancy")[i] or 1), "b_factor": float(get("b_iso_or_equiv")[i] or 0), "auth_resid": int(get("auth_seq_id")[i] or seq[i] or 0),
            "label_chain": get("label_asym_id")[i], "label_resname": get("label_comp_id")[i], "x": float(site["cartn_x"][i]), "y": float(site["cartn_y"][i]), "z": float(site["cartn_z"][i]),
        })
    return [r for r in rows if sizes[r["frame"]] == sizes[0]]  # models of another size than the first are dropped


def parse_pdb(text: str, all_models: bool = False) -> list[dict]:
    """Atom rows of ATOM and HETATM lines; the first model unless all_models."""
    rows, frame, count = [], 0, 0
    for line in text.splitlines():
        kind = line[:6]
        if kind in ("ATOM  ", "HETATM"):
            name = line[12:16].strip()
            element = line[76:78].strip() or (name[:1] if line[12:13] in " 0123456789" else re.sub(r"[^A-Za-z]", "", line[12:14]))
            charge = re.fullmatch(r"([0-9])([+-])", line[78:80].strip())
            rows.append({
                "frame": frame, "atom_id": count, "element": element.capitalize(), "name": name, "resname": line[17:20].strip(), "resid": int(line[22:26]), "chain": line[21:22].strip(),
                "altloc": line[16:17].strip(), "is_het": kind == "HETATM", "formal_charge": int(charge[2] + charge[1]) if charge else 0, "occupancy": float(line[54:60].strip() or 1),
                "b_factor": float(line[60:66].strip() or 0), "auth_resid": int(line[22:26]), "label_chain": None, "label_resname": None,
                "x": float(line[30:38]), "y": float(line[38:46]), "z": float(line[46:54]),
            })
            count += 1
        elif kind == "ENDMDL":
            if not all_models:
                break
            frame, count = frame + 1, 0
    if not rows:
        raise ValueError("no ATOM records")
    first = sum(r["frame"] == 0 for r in rows)
    sizes: dict[int, int] = {}
    for r in rows:
        sizes[r["frame"]] = sizes.get(r["frame"], 0) + 1
    return [r for r in rows if sizes[r["frame"]] == first]


# Residue names of amino acids in coordinate files of simulations.
PROTEIN = frozenset("ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL ASH GLH HID HIE HIP HSD HSE HSP CYX CYM LYN MSE".split())
# Atom names of ions and the element they stand for.
IONS = {"NA": "Na", "NA+": "Na", "CL": "Cl", "CL-": "Cl", "K": "K", "K+": "K", "MG": "Mg", "MG2+": "Mg", "CA2+": "Ca", "ZN": "Zn", "ZN2+": "Zn", "LI": "Li", "RB": "Rb", "CS": "Cs", "BR": "Br", "SOD": "Na", "CLA": "Cl", "POT": "K", "CAL": "Ca", "D": "H"}


def element_of(name: str, resname: str) -> str:
    """The element of an atom without an element column: ions by their residue, else the first letter of the name."""
    plain, res = name.strip().upper(), resname.strip().upper()
    if res not in PROTEIN and (plain in IONS or res in IONS):
        return IONS.get(plain) or IONS[res]
    letters = re.sub(r"[^A-Z]", "", plain)
    if not letters:
        return ""
    if res in PROTEIN:
        return "Se" if res == "MSE" and letters.startswith("SE") else letters[0]
    two = letters[:2].capitalize()
    return two if two in ("Cl", "Br", "Zn", "Mg", "Fe", "Se", "Si") else letters[0]


def parse_gro(text: str) -> list[dict]:
    """Atom rows of a GRO file; the distance of the decimal points gives the column width, nm become A."""
    lines = text.splitlines()
    if len(lines) < 3:
        raise ValueError("a GRO file has at least three lines")
    n = int(lines[1])
    if len(lines) < n + 2:
        raise ValueError(f"{n} atoms announced, {len(lines) - 2} lines found")
    rows = []
    width = None
    for i, line in enumerate(lines[2 : n + 2]):
        if width is None:
            dots = [m.start() for m in re.finditer(r"\.", line[20:])]
            width = dots[1] - dots[0]
        xyz = [float(line[20 + k * width : 20 + (k + 1) * width]) * 10 for k in range(3)]
        resname, name = line[5:10].strip(), line[10:15].strip()
        rows.append({
            "frame": 0, "atom_id": i, "element": element_of(name, resname), "name": name, "resname": resname, "resid": int(line[:5]), "chain": "", "altloc": "", "is_het": resname not in PROTEIN,
            "formal_charge": 0, "occupancy": 1.0, "b_factor": 0.0, "auth_resid": int(line[:5]), "label_chain": None, "label_resname": None, "x": xyz[0], "y": xyz[1], "z": xyz[2],
        })
    return rows


PARSERS = {".cif": parse_mmcif, ".mmcif": parse_mmcif, ".json": parse_mmjson, ".mmjson": parse_mmjson, ".pdb": parse_pdb, ".ent": parse_pdb, ".gro": parse_gro}


def parser_of(path: str, all_models: bool = False):
    plain = path.lower().removesuffix(".gz")
    for suffix, parser in PARSERS.items():
        if plain.endswith(suffix):
            return (lambda t: parse_pdb(t, all_models)) if parser is parse_pdb else parser
    raise ValueError(f"no parser for {path}")


def content_text(content: bytes) -> str:
    return (gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content).decode("utf-8", "replace")


def _atom_batches(batches: Iterator, all_models: bool) -> Iterator:
    import pyarrow as pa

    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    schema = pa.schema([(p.split()[0], kinds[p.split()[1]]) for p in ATOMS.split(", ")])
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                rows = [{"model_id": path, "error": None} | r for r in parser_of(path, all_models)(content_text(content))]
            except Exception as e:  # noqa: BLE001  a bad file is a row, not a failed job
                rows = [{"model_id": path, "error": f"{type(e).__name__}: {e}"}]
            yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in _NAMES} for r in rows], schema=schema)


def scan(spark: SparkSession, paths: str | list[str], extensions: list[str] | None = None, recursive: bool = False) -> DataFrame:
    """(path, content) of files; extensions filter by the end of the name, an empty one matches all. Files that vanish or can't be read are passed over."""
    reader = spark.read.format("binaryFile").options(recursiveFileLookup=str(recursive).lower(), ignoreMissingFiles="true", ignoreCorruptFiles="true")
    found = reader.load(paths)
    wanted = sorted(set(extensions or []))
    if wanted and "" not in wanted:
        test = F.lit(False)
        for e in wanted:
            test = test | F.col("path").endswith(e)
        found = found.where(test)
    return found.select("path", "content")


def file_list(spark: SparkSession, path: str) -> list[str]:
    """The paths in a text file, one a line; the list is as long as a command line user would write it."""
    return [r.value.strip() for r in spark.read.text(path).collect() if r.value.strip()]


def read_atoms(spark: SparkSession, paths: str | list[str], extensions: list[str] | None = None, recursive: bool = False, all_models: bool = False) -> DataFrame:
    """Atoms of structure files; model_id is the path; rows with an error have no atom."""
    return scan(spark, paths, extensions, recursive).mapInArrow(lambda b: _atom_batches(b, all_models), ATOMS)


def frames(atoms: DataFrame) -> DataFrame:
    """Models of multi-model files as frames: (model_id, frame, time_ps null, positions)."""
    p = F.struct("atom_id", F.struct("x", "y", "z").alias("p"))
    each = atoms.where(F.col("error").isNull()).groupBy("model_id", "frame").agg(F.transform(F.array_sort(F.collect_list(p)), lambda s: s["p"]).alias("positions"))
    return each.select("model_id", "frame", F.lit(None).cast("double").alias("time_ps"), "positions")

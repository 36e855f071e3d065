"""Compaction and shape of models: radius of gyration, gyration tensor, confidence, trimmed tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.geometry import let

# Heavy atoms of each residue without the terminal oxygen.
ATOMS = {"A": 5, "R": 11, "N": 8, "D": 8, "C": 6, "Q": 9, "E": 9, "G": 4, "H": 10, "I": 8, "L": 8, "K": 9, "M": 8, "F": 11, "P": 7, "S": 6, "T": 7, "W": 14, "Y": 12, "V": 7}
# Confidence thresholds that are reported.
THRESHOLDS = (0.80, 0.90, 0.95, 0.99)
# Secondary structure states by number, and their letters.
DSSP_NAMES = ("Coil", "AlphaHelix", "Helix3_10", "HelixPi", "PolyProlineHelix", "Strand", "Turn", "BetaBridge", "Bend")
PLDDT_NAMES = ("VeryHigh", "High", "Low", "VeryLow")
LOOSE = ("Coil", "Turn", "Bend")


def plddt_category(score: Column) -> Column:
    """VeryHigh above 90, High above 70, Low above 50, else VeryLow."""
    return F.when(score > 90, "VeryHigh").when(score > 70, "High").when(score > 50, "Low").otherwise("VeryLow")


def is_confident(category: Column) -> Column:
    return category.isin("High", "VeryHigh")


def confidence_fraction(category: Column) -> Column:
    """Share of confident residues; an aggregate, 0 for none."""
    return F.coalesce(F.avg(is_confident(category).cast("double")), F.lit(0.0))


def radius_of_gyration(points: DataFrame, by: list[str]) -> DataFrame:
    """One aggregation: the root of the summed population variances."""
    return points.groupBy(*by).agg(F.sqrt(F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("rg"), F.count(F.lit(1)).alias("n"))


def weighted_rg(points: DataFrame, by: list[str], weight: str = "weight") -> DataFrame:
    """Weighted radius of gyration about the weighted centroid; 0 where the weights don't exceed zero.

    The weighted covariance needs only sums, which combine before the shuffle.
    """
    return gyration_tensor(points, by, weight).select(*by, F.sqrt(F.greatest(F.lit(0.0), F.col("xx") + F.col("yy") + F.col("zz"))).alias("rg"), "w_sum")


def gyration_tensor(points: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """by, n, w_sum, center of mass (cx, cy, cz) and the six tensor elements."""
    pairs = (("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("x", "z"), ("y", "z"))
    if weight is None:
        found = points.groupBy(*by).agg(
            F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).cast("double").alias("w_sum"), *[F.avg(a).alias(f"c{a}") for a in "xyz"],
            *[(F.var_pop(a) if a == b else F.covar_pop(a, b)).alias(a + b) for a, b in pairs],
        )
        return found
    w = F.col(weight).cast("double")
    sums = points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("w_sum"), *[F.sum(w * F.col(a)).alias(f"s{a}") for a in "xyz"], *[F.sum(w * F.col(a) * F.col(b)).alias(f"q{a}{b}") for a, b in pairs])
    safe = F.when(F.col("w_sum") > 0, F.col("w_sum"))
    center = sums.withColumns({f"c{a}": F.coalesce(F.col(f"s{a}") / safe, F.lit(0.0)) for a in "xyz"})
    return center.select(*by, "n", "w_sum", "cx", "cy", "cz", *[F.coalesce(F.col(f"q{a}{b}") / safe - F.col(f"c{a}") * F.col(f"c{b}"), F.lit(0.0)).alias(a + b) for a, b in pairs])


def principal_moments(tensor: DataFrame) -> DataFrame:
    """Adds pm0 <= pm1 <= pm2, the eigenvalues of the symmetric tensor in closed form (trigonometric solution)."""
    q = (F.col("xx") + F.col("yy") + F.col("zz")) / 3
    off = F.col("xy") ** 2 + F.col("xz") ** 2 + F.col("yz") ** 2
    p = F.sqrt(((F.col("xx") - q) ** 2 + (F.col("yy") - q) ** 2 + (F.col("zz") - q) ** 2 + 2 * off) / 6)
    a, b, c = ((F.col(n) - F.col("__q")) / F.col("__p") for n in ("xx", "yy", "zz"))
    d, e, f = (F.col(n) / F.col("__p") for n in ("xy", "xz", "yz"))
    det = a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / 2))) / 3
    third = F.lit(2.0943951023931953)
    flat = F.col("__p") <= 1e-12
    based = tensor.withColumns({"__q": q, "__p": p}).withColumn("__phi", F.when(~flat, phi))
    pm = lambda shift: F.when(flat, F.col("__q")).otherwise(F.col("__q") + 2 * F.col("__p") * F.cos(F.col("__phi") + shift))
    top = based.withColumns({"pm2": pm(F.lit(0.0)), "pm0": pm(third)})
    return top.withColumn("pm1", 3 * F.col("__q") - F.col("pm0") - F.col("pm2")).drop("__q", "__p", "__phi")


def shape_metrics(moments: DataFrame) -> DataFrame:
    """Adds rg_sq, asphericity, acylindricity and kappa2 (relative shape anisotropy)."""
    total = F.col("pm0") + F.col("pm1") + F.col("pm2")
    squares = F.col("pm0") ** 2 + F.col("pm1") ** 2 + F.col("pm2") ** 2
    return moments.withColumns({
        "rg_sq": total,
        "asphericity": F.col("pm2") - 0.5 * (F.col("pm0") + F.col("pm1")),
        "acylindricity": F.col("pm1") - F.col("pm0"),
        "kappa2": F.when(total > 0, 1.5 * squares / (total * total) - 0.5).otherwise(0.0),
    })


def normalized_rg(rg: Column, n: Column) -> Column:
    return F.when(n > 0, rg / F.cbrt(n.cast("double"))).otherwise(0.0)


def passes(fraction: Column, threshold: float) -> Column:
    return fraction >= threshold


def highest_passed(fraction: Column) -> Column:
    """The largest threshold reached; 0 if none is."""
    out = F.lit(0.0)
    for t in THRESHOLDS:
        out = F.when(fraction >= t, F.lit(t)).otherwise(out)
    return out


def trim_tails(residues: DataFrame, model: list[str], position: str = "position") -> DataFrame:
    """residues without the loose and unsure tails of each model; needs columns plddt and dssp (names).

    A tail ends at the first residue that is neither both loose and unsure: the kept range is between the
    first and last such residue, found in one window over the model.
    """
    keeper = ~(F.col("dssp").isin(*LOOSE) & ~is_confident(F.col("plddt")))
    w = Window.partitionBy(*model)
    at = F.when(keeper, F.col(position))
    bounded = residues.withColumns({"__lo": F.min(at).over(w), "__hi": F.max(at).over(w)})
    return bounded.where(F.col(position).between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


def trim_report(residues: DataFrame, model: list[str], position: str = "position") -> DataFrame:
    """Per model: start and end (exclusive) of the kept range, residues trimmed at either end, confidence before and after."""
    keeper = ~(F.col("dssp").isin(*LOOSE) & ~is_confident(F.col("plddt")))
    at = F.when(keeper, F.col(position))
    w = Window.partitionBy(*model)
    marked = residues.withColumns({"__lo": F.min(at).over(w), "__hi": F.max(at).over(w)}).withColumn("__in", F.col(position).between(F.col("__lo"), F.col("__hi")))
    sure = is_confident(F.col("plddt")).cast("double")
    kept = F.sum(F.coalesce(F.col("__in"), F.lit(False)).cast("long"))
    return marked.groupBy(*model).agg(
        F.count(F.lit(1)).alias("n_residues"), kept.alias("n_kept"),
        F.coalesce(F.sum((F.col(position) < F.col("__lo")).cast("long")), F.count(F.lit(1))).alias("trimmed_start"),
        F.coalesce(F.sum((F.col(position) > F.col("__hi")).cast("long")), F.lit(0)).alias("trimmed_end"),
        F.avg(sure).alias("confidence"), F.coalesce(F.avg(F.when(F.col("__in"), sure)), F.lit(0.0)).alias("confidence_kept"),
    )


def atom_counts(sequence: Column) -> Column:
    """Array of atoms per residue of a one-letter sequence, the last with the terminal oxygen; null if a letter is unknown."""
    table = F.create_map(*[F.lit(x) for kv in ATOMS.items() for x in kv])
    letters = F.filter(F.split(sequence, ""), lambda c: c != "")
    counts = F.transform(letters, lambda c, i: F.try_element_at(table, c) + (i == F.size(letters) - 1).cast("int"))
    return F.when(F.exists(counts, lambda n: n.isNull()), F.lit(None)).otherwise(counts)


def prefix_sums(counts: Column) -> Column:
    """Running sums from 0; one entry more than counts."""
    zero = F.array(F.lit(0).cast("long"))
    return F.aggregate(counts, zero, lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n.cast("long"))))


def compaction_record(models: DataFrame, min_high_fraction: float = 0.80) -> DataFrame:
    """One row per model row (model_id, sequence, plddt, dssp arrays of names, coords array of points).

    status is ok, or why the model has no numbers: missing_sequence, missing_dssp, missing_positions,
    length_mismatch, prefix_errors, atom_mismatch, trimmed_empty, failed_confidence. All steps are expressions
    over the row's arrays, so there is no shuffle.
    """
    n = F.size("plddt")
    loose = lambda i: F.element_at("dssp", i).isin(*LOOSE) & ~is_confident(F.element_at("plddt", i))
    keepers = F.filter(F.sequence(F.lit(1), n), lambda i: ~loose(i))
    based = models.withColumn("__counts", F.when(F.length("sequence") > 0, atom_counts(F.col("sequence"))))
    early = (
        F.when(F.coalesce(F.length("sequence"), F.lit(0)) == 0, "missing_sequence")
        .when(F.coalesce(F.size("dssp"), F.lit(-1)) <= 0, "missing_dssp")
        .when(F.coalesce(F.size("coords"), F.lit(-1)) <= 0, "missing_positions")
        .when((F.coalesce(n, F.lit(-1)) != F.length("sequence")) | (F.size("dssp") != F.length("sequence")), "length_mismatch")
        .when(F.col("__counts").isNull(), "prefix_errors")
        .when(F.aggregate("__counts", F.lit(0), lambda a, c: a + c) != F.size("coords"), "atom_mismatch")
    )
    staged = based.withColumn("__early", early).withColumn("__keep", F.when(F.col("__early").isNull(), keepers))
    start, end = F.element_at("__keep", 1) - 1, F.element_at("__keep", -1)
    ranged = staged.withColumns({"trim_start": F.when(F.size("__keep") > 0, start), "trim_end": F.when(F.size("__keep") > 0, end)})
    size = F.col("trim_end") - F.col("trim_start")
    kept_plddt = F.slice("plddt", F.col("trim_start") + 1, size)
    high = F.size(F.filter(kept_plddt, is_confident)) / size
    first = F.aggregate(F.slice("__counts", 1, F.col("trim_start")), F.lit(0), lambda a, c: a + c)
    many = F.aggregate(F.slice("__counts", F.col("trim_start") + 1, size), F.lit(0), lambda a, c: a + c)
    scored = ranged.withColumn("high_fraction", high).withColumn("__xyz", F.when(F.col("trim_start").isNotNull(), F.slice("coords", first + 1, many)))
    weights = F.flatten(F.transform(F.slice("__counts", F.col("trim_start") + 1, size), lambda c: F.array_repeat(c.cast("double"), c)))
    total = lambda values, f: F.aggregate(values, F.lit(0.0), lambda acc, t: acc + f(t))

    def rg(xyz: Column, w: Column) -> Column:
        def about(e: Column) -> Column:
            mass = e["mass"]
            center = F.struct(*[(total(e["z"], lambda t, k=k: t["w"] * t["p"][k]) / mass).alias(k) for k in "xyz"])
            square = lambda t, c: sum(((t["p"][k] - c[k]) * (t["p"][k] - c[k]) for k in "xyz"), F.lit(0.0))
            return let(center, lambda c: F.sqrt(total(e["z"], lambda t: t["w"] * square(t, c)) / mass))

        pairs = F.arrays_zip(xyz.alias("p"), w.alias("w"))
        return let(pairs, lambda z: let(F.struct(z.alias("z"), total(z, lambda t: t["w"]).alias("mass")), about))

    ones = F.transform("__xyz", lambda _: F.lit(1.0))
    values = scored.withColumns({"rg": rg(F.col("__xyz"), ones), "rg_weighted": rg(F.col("__xyz"), weights), "n_residues": F.length("sequence"), "n_kept": size, "n_atoms_kept": F.size("__xyz")})
    status = F.coalesce(F.col("__early"), F.when(F.col("trim_start").isNull(), "trimmed_empty").when(F.col("high_fraction") < min_high_fraction, "failed_confidence").otherwise("ok"))
    out = values.withColumns({"status": status, "rg_normalized": normalized_rg(F.col("rg"), F.col("n_kept")), "highest_threshold": highest_passed(F.col("high_fraction"))})
    flags = F.struct(*[passes(F.col("high_fraction"), t).alias(f"{t:.2f}") for t in THRESHOLDS])
    names = ("trim_start", "trim_end", "high_fraction", "n_kept", "n_atoms_kept", "rg", "rg_weighted", "rg_normalized", "highest_threshold")
    return out.withColumn("passes", flags).select("model_id", "status", "n_residues", *[F.when(F.col("status") == "ok", F.col(c)).alias(c) for c in names], F.when(F.col("status") == "ok", F.col("passes")).alias("passes"))


#: Reasons that the summary counts.
REASONS = ("missing_sequence", "missing_dssp", "missing_positions", "length_mismatch", "atom_mismatch", "trimmed_empty", "failed_confidence", "prefix_errors")


def summary(records: DataFrame) -> DataFrame:
    """One row of counters over compaction records."""
    return records.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "ok").alias("written"), *[F.count_if(F.col("status") == r).alias(r) for r in REASONS],
        *[F.count_if((F.col("status") == "ok") & (F.col("highest_threshold") >= t)).alias(f"passed_{round(t * 100)}") for t in THRESHOLDS],
    )

"""Health score: penalties, total, grade. All are scalar columns, so they fold into whatever plan makes their inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.scalar import clamp, half_up, ratio


def linear(x: Column, lo: float, hi: float, most: float = 20.0) -> Column:
    """0 at lo, ``most`` at hi."""
    return clamp((x - lo) / (hi - lo)) * most


def complexity_penalty(mean: Column, cognitive: Column, nesting: Column) -> Column:
    return half_up(F.greatest(linear(mean, 2, 15), linear(cognitive, 15, 25), linear(nesting, 3, 7)))


def dead_code_penalty(critical: Column, warning: Column, info: Column, files: Column) -> Column:
    norm = F.when(files > 10, 1 + F.log10(files / 10)).otherwise(1.0)
    return F.floor(F.least(F.lit(20.0), (critical + 0.5 * warning + 0.2 * info) / norm)).cast("long")


def duplication_penalty(percent: Column) -> Column:
    return F.least(F.lit(20), half_up(percent / 30 * 20)).cast("long")


def share_penalty(high: Column, medium: Column, n: Column, medium_weight: float = 0.5, full: float = 0.40) -> Column:
    """Coupling (0.5) and cohesion (0.3): the weighted share of bad classes, 20 at ``full``."""
    return F.least(F.lit(20), half_up(ratio(high + medium_weight * medium, n) / full * 20)).cast("long")


def architecture_penalty(compliance: Column) -> Column:
    return half_up(12 * (1 - compliance))


def parse_penalty(skipped: Column, files: Column) -> Column:
    return F.when(skipped > 0, F.greatest(F.lit(11), half_up(ratio(skipped, files) * 56))).otherwise(0).cast("long")


def total(*penalties: Column) -> Column:
    out = F.lit(100)
    for p in penalties:
        out = out - p
    return F.greatest(F.lit(0), out).cast("long")


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 45, "D").otherwise("F")


def cohesion_penalty(high: Column, medium: Column, n: Column) -> Column:
    return share_penalty(high, medium, n, 0.3, 0.40)


def dependency_penalty(modules: Column, in_cycles: Column, depth: Column, deviation: Column) -> Column:
    """Cycles up to 10 (their share of modules, or log2 of one more than their number if that is more), depth beyond
    max(3, ceil(log2(modules + 1)) + 1) up to 3, deviation from the main sequence up to 3."""
    some = modules > 0
    cycles = F.least(F.lit(10), F.greatest(half_up(10 * clamp(ratio(in_cycles, modules))), F.floor(F.log2(in_cycles + 1)).cast("long")))
    expected = F.greatest(F.lit(3.0), F.ceil(F.log2(modules + 1)) + 1)
    return (F.when(some, cycles).otherwise(0) + F.when(some, half_up(clamp(depth - expected, 0.0, 3.0))).otherwise(0) + half_up(3 * clamp(deviation))).cast("long")


def community_risk(communities: Column, modularity: Column, bridges: Column, internal: Column, cross: Column, package_alignment: Column, layer_alignment: Column) -> Column:
    """0 to 1: low modularity .4, edges across .3, bridges .3, misaligned packages and layers .25 each, over what is known; null
    for fewer than two communities."""
    parts = [
        (0.40, clamp((0.30 - modularity) / 0.30)), (0.30, F.when(internal + cross > 0, clamp(ratio(cross, internal + cross) / 0.50))), (0.30, F.when(communities > 0, clamp(ratio(bridges, communities)))),
        (0.25, clamp(1 - package_alignment)), (0.25, clamp(1 - layer_alignment)),
    ]
    # clamp() passes over nulls, so each part is null where its input is
    known = [modularity, F.when(internal + cross > 0, cross), F.when(communities > 0, bridges), package_alignment, layer_alignment]
    top, weight = F.lit(0.0), F.lit(0.0)
    for (w, x), k in zip(parts, known):
        top, weight = top + F.when(k.isNotNull(), w * x).otherwise(0.0), weight + F.when(k.isNotNull(), w).otherwise(0.0)
    return F.when(communities >= 2, top / weight)


def community_penalty(risk: Column) -> Column:
    return F.coalesce(half_up(10 * risk), F.lit(0)).cast("long")


def category_score(penalty: Column, most: float = 20.0) -> Column:
    """100 without a penalty, 0 at ``most``."""
    return half_up(100 - clamp(penalty / most) * 100)


def is_healthy(score: Column) -> Column:
    return score >= 70


def fallback(mean_complexity: Column, dead: Column, high_complexity: Column, high_lcom: Column) -> Column:
    """A score without analyses' details: 10 less for a mean over 10, 5 less for each kind of finding."""
    five = lambda n: F.when(n > 0, 5).otherwise(0)
    return F.greatest(F.lit(0), 100 - F.when(mean_complexity > 10, 10).otherwise(0) - five(dead) - five(high_complexity) - five(high_lcom)).cast("long")


#: Ranges that a summary's numbers must lie in: name -> (least, most); a name as most is another column.
RANGES = {
    "skipped_files": (0, "total_files"), "mean_complexity": (0, None), "mean_cognitive": (0, None), "mean_nesting": (0, None), "duplication": (0, 100), "compliance": (0, 1), "deviation": (0, 1),
    "in_cycles": (0, "modules"), "modularity": (-1, 1), "package_alignment": (0, 1), "layer_alignment": (0, 1), "high_lcom": (0, "lcom_classes"), "medium_lcom": (0, "lcom_classes"),
    "high_cbo": (0, "cbo_classes"), "medium_cbo": (0, "cbo_classes"),
}


def invalid(df: DataFrame) -> DataFrame:
    """field, value of numbers out of range, of the columns that ``df`` has; null is not out of range."""
    rows = []
    for name, (least, most) in RANGES.items():
        if name in df.columns:
            x = F.col(name).cast("double")
            bad = x < least
            if isinstance(most, str):
                bad = bad | (x > F.col(most)) if most in df.columns else bad
            elif most is not None:
                bad = bad | (x > most)
            rows.append(F.when(bad, F.struct(F.lit(name).alias("field"), x.alias("value"))))
    return df.select(F.inline(F.filter(F.array(*rows), lambda r: r.isNotNull())))


def _rounded(x: Column) -> Column:
    return F.round(clamp(x, 0.0, 100.0), 2)


def maintainability(modules: Column, coupling: Column, high_risk: Column, in_cycles: Column, violations: Column) -> Column:
    lost = F.least(F.lit(30.0), coupling * 8) + F.least(F.lit(25.0), ratio(high_risk, modules) * 25) + F.least(F.lit(20.0), ratio(in_cycles, modules) * 20) + F.least(F.lit(25.0), ratio(violations, modules) * 10)
    return F.when(modules == 0, 0.0).otherwise(_rounded(100 - lost))


def modularity_score(index: Column, modules: Column, packages: Column, coupling: Column, in_cycles: Column) -> Column:
    """100 times the modularity index if it is above 0, else from coupling and cycles."""
    lost = F.least(F.lit(40.0), coupling * 10) + F.least(F.lit(40.0), ratio(in_cycles, modules) * 40) + F.when((packages <= 1) & (modules > 1), 10.0).otherwise(0.0)
    return F.when(index > 0, _rounded(index * 100)).when(modules == 0, 0.0).otherwise(_rounded(100 - lost))


def debt_hours(high_risk: Column, in_cycles: Column, violations: Column, candidates: Column, critical: Column) -> Column:
    return (high_risk * 4 + in_cycles * 2 + violations + candidates * 2 + critical * 4).cast("double")


def system_quality(maintainability_: Column, modularity_: Column, architecture: Column) -> Column:
    """Maintainability .4, modularity .3 and architecture .3 of those that are known (not null)."""
    parts = [(0.4, maintainability_), (0.3, modularity_), (0.3, architecture)]
    top = sum((F.coalesce(x * w, F.lit(0.0)) for w, x in parts), F.lit(0.0))
    weight = sum((F.when(x.isNotNull(), w).otherwise(0.0) for w, x in parts), F.lit(0.0))
    return F.when(weight == 0, 0.0).otherwise(_rounded(top / F.when(weight == 0, 1.0).otherwise(weight)))

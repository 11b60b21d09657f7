"""Clones: fragments to candidate pairs (exact or by MinHash bands), scores of four kinds, types, filters, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import scalar as S
from quarry.functions.lineage import cut

#: Thresholds and confidences of the types, 1 to 4 (fixed values); types that are on by default.
THRESHOLDS, CONFIDENCES = (0.85, 0.75, 0.70, 0.65), (1.0, 0.95, 0.9, 0.85)
ENABLED = (1, 2, 4)
HASHES, BANDS, ROWS = 128, 32, 4
AUTO_ROWS, AUTO_PAIRS = 500, 10_000
MOST_PAIRS = 10_000


# -- fragments ------------------------------------------------------------------------------------------------------


def large_enough(fragments: DataFrame, nodes: int = 20, lines: int = 10) -> DataFrame:
    return fragments.where((F.col("size") >= nodes) & (F.col("lines") >= lines))


def named(fragments: DataFrame) -> DataFrame:
    """Fragments with an id: path and number."""
    return fragments.withColumn("id", F.concat_ws("#", "path", F.col("fragment").cast("string")))


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once: a lambda's variable, which no plan rule puts back into the loop below it."""
    return F.transform(F.array(value), use)[0]


def grams(labels: Column, k: int = 4, plain: bool = True) -> Column:
    """Distinct runs of k labels in pre-order; plain ones are without names and values."""
    run = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.array_join(F.slice(w, i + 1, F.lit(k)), " ")))
    words = F.transform(labels, lambda x: F.regexp_extract(x, r"^[^(]+", 0)) if plain else labels
    return _once(words, lambda w: F.when(F.size(w) >= k, run(w)).otherwise(F.array().cast("array<string>")))


def word_grams(df: DataFrame, id_col: str, text: str, k: int = 4) -> DataFrame:
    """id, grams: distinct runs of k words of a text; texts of fewer words are left out."""
    w = F.filter(F.split(F.lower(F.col(text)), r"[^a-z0-9]+"), lambda x: x != "")
    return df.select(F.col(id_col).alias("id"), grams(w, k, False).alias("grams")).where(F.size("grams") > 0)


# -- candidates -----------------------------------------------------------------------------------------------------


def classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, grams) -> representatives (id, g: sorted gram hashes) of equal sets, and members (id, rep): copies never meet."""
    hashed = cut(sets.select("id", F.sort_array(F.transform("grams", lambda x: F.xxhash64(x))).alias("g")))
    reps = hashed.groupBy("g").agg(F.min("id").alias("id")).select("id", "g")
    return reps, hashed.join(reps.select(F.col("id").alias("rep"), "g"), "g").select("id", "rep")


def exact_pairs(reps: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity), a < b, of all pairs of sets (id, g) whose Jaccard similarity reaches the threshold, exactly.

    Prefix filtering: with grams in order of rarity a pair at the threshold shares one of its first size - ceil(t size) + 1,
    so only those are joined, and sizes that rule a pair out are part of the join."""
    flat = reps.select("id", F.size("g").alias("size"), F.explode("g").alias("gram"))
    freq = flat.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")  # a gram of one set makes no pair
    ranked = flat.join(freq, "gram", "left").withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy(F.col("df").asc_nulls_first(), "gram")))
    prefix = ranked.where(F.col("df").isNotNull() & (F.col("rn") <= F.col("size") - F.ceil(F.lit(threshold) * F.col("size")) + 1)).select("id", "gram", "size")
    a, b = prefix.toDF("a", "gram", "na"), prefix.toDF("b", "gram", "nb")
    maybe = a.join(b, "gram").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb"))).select("a", "b").distinct()
    return jaccards(maybe, reps).where(F.col("similarity") >= threshold)


def jaccards(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    x = pairs.select("a", "b").join(reps.select(F.col("id").alias("a"), F.col("g").alias("ga")), "a").join(reps.select(F.col("id").alias("b"), F.col("g").alias("gb")), "b")
    both = F.size(F.array_intersect("ga", "gb"))
    return x.select("a", "b", S.ratio(both, F.size("ga") + F.size("gb") - both).alias("similarity"))


def signatures(reps: DataFrame, hashes: int = HASHES) -> DataFrame:
    """id, sig: for each of ``hashes`` seeds the least hash of the set's grams."""
    sig = F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda s: F.aggregate("g", F.lit((1 << 63) - 1), lambda low, x: F.least(low, F.xxhash64(x, s))))
    return reps.where(F.size("g") > 0).select("id", sig.alias("sig"))


def estimated(a: Column, b: Column) -> Column:
    """Share of places at which two signatures agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


def banded_pairs(reps: DataFrame, least: float = 0.5, bands: int = BANDS, rows: int = ROWS, most: int | None = None) -> DataFrame:
    """(a, b, estimate) of sets that share a band of their signatures and whose estimate reaches ``least``. ``most`` keeps the best
    partners of each set, by estimate; by default all are kept."""
    s = signatures(reps, bands * rows)
    s = cut(s)
    band = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.struct(k.alias("band"), F.xxhash64(F.array_join(F.transform(F.slice("sig", k * rows + 1, F.lit(rows)), lambda x: x.cast("string")), ",")).alias("bucket")))
    flat = s.select("id", F.inline(band))
    a, b = flat.toDF("a", "band", "bucket"), flat.toDF("b", "band", "bucket")
    pairs = a.join(b, ["band", "bucket"]).where("a < b").select("a", "b").distinct()
    x = pairs.join(s.toDF("a", "sa"), "a").join(s.toDF("b", "sb"), "b").select("a", "b", estimated(F.col("sa"), F.col("sb")).alias("estimate")).where(F.col("estimate") >= least)
    if most:
        x = x.withColumn("_n", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("estimate"), "b"))).where(F.col("_n") <= most).drop("_n")
    return x


def use_bands(n: int, rows: int = AUTO_ROWS, pairs: int = AUTO_PAIRS) -> bool:
    """Whether so many fragments are compared by bands: their number or the number of their pairs is too high."""
    return n >= rows or n * (n - 1) // 2 > pairs


def candidates(reps: DataFrame, threshold: float = 0.65, bands: bool | None = None) -> DataFrame:
    """(a, b, similarity) at the threshold: exact or by bands with an exact check, as ``bands`` says or the count decides."""
    if use_bands(reps.count()) if bands is None else bands:
        return jaccards(banded_pairs(reps, min(0.5, threshold)), reps).where(F.col("similarity") >= threshold)
    return exact_pairs(reps, threshold)


# -- filters --------------------------------------------------------------------------------------------------------


def overlaps(a: str = "a", b: str = "b") -> Column:
    """Whether two fragments of one file share lines. Columns: {a}_path, {a}_start, {a}_end and so on."""
    return (F.col(f"{a}_path") == F.col(f"{b}_path")) & (F.col(f"{a}_start") <= F.col(f"{b}_end")) & (F.col(f"{b}_start") <= F.col(f"{a}_end"))


def similar_size(x: Column, y: Column, share: float = 0.5) -> Column:
    return F.least(x, y) >= F.lit(share) * F.greatest(x, y)


def located(pairs: DataFrame, fragments: DataFrame) -> DataFrame:
    """Pairs with the places and sizes of both ends, without those that overlap or differ too much in size or lines."""
    f = fragments.select("id", "path", F.col("start_line").alias("start"), F.col("end_line").alias("end"), "size", "lines")
    x = pairs
    for e in ("a", "b"):
        x = x.join(f.select(F.col("id").alias(e), *[F.col(c).alias(f"{e}_{c}") for c in f.columns if c != "id"]), e)
    return x.where(~overlaps() & similar_size(F.col("a_size"), F.col("b_size")) & similar_size(F.col("a_lines"), F.col("b_lines")))


def significant(pairs: DataFrame, threshold: float, distance: float = 50.0, size: int = 0) -> DataFrame:
    """Pairs at the threshold; of other types than 4 not beyond the distance; both ends of a size or more."""
    keep = (F.col("similarity") >= threshold) & ((F.col("type") == 4) | (F.col("distance") <= distance))
    return pairs.where(keep & (F.least("a_size", "b_size") >= size) if size else keep)


def selected(pairs: DataFrame, types: tuple[int, ...] = ENABLED, least: float = 0.0, most: float = 1.0) -> DataFrame:
    return pairs.where(F.col("type").isin(list(types)) & F.col("similarity").between(least, most))


def referenced(fragments: DataFrame, pairs: DataFrame) -> DataFrame:
    """Fragments that take part in a pair."""
    return fragments.join(pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct(), "id", "left_semi")


def best(pairs: DataFrame, n: int = MOST_PAIRS) -> DataFrame:
    """The n most similar pairs, ties by ids; 0 is no limit."""
    x = pairs.orderBy(F.desc("similarity"), "a", "b")
    return x.limit(n) if n else x


# -- scores ---------------------------------------------------------------------------------------------------------


def textual(a: Column, b: Column) -> Column:
    """1 for equal normal texts, else 1 - edit distance / the longer length."""
    return F.when(F.md5(a) == F.md5(b), 1.0).otherwise(S.levenshtein_similarity(a, b))


def map_cosine(a: Column, b: Column) -> Column:
    """Cosine of two maps of counts; 1 if both are empty, 0 if one is."""
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    get = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0)).cast("double")
    total = lambda f: F.aggregate(F.transform(keys, f), F.lit(0.0), lambda s, x: s + x)
    dot, na, nb = total(lambda k: get(a, k) * get(b, k)), total(lambda k: get(a, k) * get(a, k)), total(lambda k: get(b, k) * get(b, k))
    none = (F.size(a) == 0) & (F.size(b) == 0)
    return F.when(none, 1.0).when((na == 0) | (nb == 0), 0.0).otherwise(dot / (F.sqrt(F.when(na == 0, 1.0).otherwise(na)) * F.sqrt(F.when(nb == 0, 1.0).otherwise(nb))))


def flow_similarity(a: str = "a", b: str = "b") -> Column:
    """Of control flow: blocks .20, edges .15, edges - blocks + 2 .25, edge types .25, branching .10, loops and conditions .05.

    Columns {a}_blocks, {a}_edges, {a}_edge_types and so on."""
    c = lambda e, n: F.col(f"{e}_{n}")
    near = lambda f: S.closeness(f(a).cast("double"), f(b).cast("double"))
    of = lambda e, *kinds: reduce(lambda x, y: x + y, [F.coalesce(F.try_element_at(c(e, "edge_types"), F.lit(k)), F.lit(0)) for k in kinds])
    structure = (near(lambda e: of(e, "loop")) + near(lambda e: of(e, "cond_true", "cond_false"))) / 2
    score = (
        0.20 * near(lambda e: c(e, "blocks")) + 0.15 * near(lambda e: c(e, "edges")) + 0.25 * near(lambda e: c(e, "edges") - c(e, "blocks") + 2)
        + 0.25 * map_cosine(c(a, "edge_types"), c(b, "edge_types")) + 0.10 * near(lambda e: S.ratio(c(e, "edges"), c(e, "blocks"))) + 0.05 * structure
    )
    return S.clamp(score)


def dataflow_similarity(a: str = "a", b: str = "b") -> Column:
    """Of definitions and uses: pairs .25, pairs a definition .20, share across blocks .20, kinds of definitions .20, of uses .15;
    1 if neither defines anything, 0 if one does."""
    c = lambda e, n: F.col(f"{e}_{n}")
    near = lambda f: S.closeness(f(a).cast("double"), f(b).cast("double"))
    score = (
        0.25 * near(lambda e: c(e, "pairs")) + 0.20 * near(lambda e: S.ratio(c(e, "pairs"), c(e, "defs"))) + 0.20 * near(lambda e: S.ratio(c(e, "cross_pairs"), c(e, "pairs")))
        + 0.20 * map_cosine(c(a, "def_kinds"), c(b, "def_kinds")) + 0.15 * map_cosine(c(a, "use_kinds"), c(b, "use_kinds"))
    )
    none = (c(a, "defs") == 0) & (c(b, "defs") == 0)
    return F.when(none, 1.0).when((c(a, "defs") == 0) | (c(b, "defs") == 0), 0.0).otherwise(S.clamp(score))


def evidence(a: str = "a", b: str = "b") -> Column:
    """How far operators, calls, literals and returns bear out a likeness of flow: the mean Jaccard of the sets that are not empty
    on both sides, halved towards 1. (A definition of our own.)"""
    sets = [(F.col(f"{a}_{n}"), F.col(f"{b}_{n}")) for n in ("signals", "literals", "returns")]
    some = [(F.size(x) + F.size(y) > 0).cast("double") for x, y in sets]
    total = reduce(lambda p, q: p + q, [s * S.jaccard(x, y) for s, (x, y) in zip(some, sets)])
    n = reduce(lambda p, q: p + q, some)
    return F.when(n == 0, 1.0).otherwise(0.5 + 0.5 * total / F.when(n == 0, 1.0).otherwise(n))


def semantic(a: str = "a", b: str = "b", least_cyclomatic: int = 2) -> Column:
    """.6 flow + .4 data flow, times the evidence; 0 unless both have edges - blocks + 2 of ``least_cyclomatic``."""
    v = lambda e: F.col(f"{e}_edges") - F.col(f"{e}_blocks") + 2
    return F.when(F.least(v(a), v(b)) < least_cyclomatic, 0.0).otherwise((0.6 * flow_similarity(a, b) + 0.4 * dataflow_similarity(a, b)) * evidence(a, b))


def classified(textual_: Column, syntactic: Column, structural: Column, semantic_: Column, thresholds=THRESHOLDS) -> Column:
    """(type, similarity, confidence) of the first kind of score that reaches its threshold; null if none does. Scores that were not
    computed are null."""
    out = F.lit(None).cast("struct<type:int,similarity:double,confidence:double>")
    for k, (score, least, sure) in reversed(list(enumerate(zip((textual_, syntactic, structural, semantic_), thresholds, CONFIDENCES), 1))):
        row = F.struct(F.lit(k).alias("type"), score.cast("double").alias("similarity"), F.lit(sure).alias("confidence"))
        out = F.when(score >= least, row).otherwise(out)
    return out


def confidence(similarity: Column, size_a: Column, size_b: Column) -> Column:
    """The similarity, less for small fragments: from half of it at no nodes to all of it at 50. (A definition of our own.)"""
    return S.clamp(similarity * (0.5 + 0.5 * F.least(F.least(size_a, size_b) / 50.0, F.lit(1.0))))


def scored(pairs: DataFrame, fragments: DataFrame, structural: DataFrame | None = None) -> DataFrame:
    """Located pairs (a, b, similarity of grams) -> type, similarity and confidence, by the cascade. ``structural`` has (a, b,
    distance, similarity) of trees; pairs without a type go."""
    cols = ["text", "signals", "literals", "returns", "blocks", "edges", "edge_types", "defs", "pairs", "cross_pairs", "def_kinds", "use_kinds"]
    x = located(pairs.withColumnRenamed("similarity", "syntactic"), fragments)
    for e in ("a", "b"):
        x = x.join(fragments.select(F.col("id").alias(e), *[F.col(c).alias(f"{e}_{c}") for c in cols]), e)
    if structural is None:
        x = x.withColumn("structural", F.lit(None).cast("double")).withColumn("distance", F.lit(0.0))
    else:
        x = x.join(structural.select("a", "b", "distance", F.col("similarity").alias("structural")), ["a", "b"], "left").fillna({"distance": 0.0})
    found = classified(textual(F.col("a_text"), F.col("b_text")), F.col("syntactic"), F.col("structural"), semantic())
    keep = ["a", "b", "a_path", "a_start", "a_end", "a_size", "a_lines", "b_path", "b_start", "b_end", "b_size", "b_lines", "distance"]
    return x.select(*keep, found.alias("f")).where("f is not null").select(*keep, "f.type", "f.similarity", confidence(F.col("f.similarity"), F.col("a_size"), F.col("b_size")).alias("confidence"))


# -- statistics -----------------------------------------------------------------------------------------------------


def statistics(pairs: DataFrame) -> DataFrame:
    """type -> pairs, mean similarity, distinct fragments of either end."""
    ends = pairs.select("type", F.col("a").alias("id")).unionAll(pairs.select("type", "b")).groupBy("type").agg(F.count_distinct("id").alias("fragments"))
    return pairs.groupBy("type").agg(F.count("*").alias("pairs"), F.avg("similarity").alias("mean_similarity")).join(ends, "type")


def duplication(cloned: Column, fragments: Column) -> Column:
    """Percent of fragments that are clones, 30 at most."""
    return F.least(F.lit(30.0), 100.0 * S.ratio(cloned, fragments))


def of_two(spark, first: str, second: str) -> DataFrame:
    """One row: textual, syntactic, structural and semantic likeness of two pieces of Python code, and their type."""
    from quarry.operators import costs, trees
    from quarry.sources import python_files as P

    files = spark.createDataFrame([("a", "a", first.encode()), ("b", "b", second.encode())], "path string, module string, content binary")
    f = P.extract(files, "fragments").where("fragment = 0").withColumn("id", F.col("path"))
    pair = spark.createDataFrame([("a", "b")], "a string, b string")
    sets = f.select("id", F.sort_array(F.transform(grams(F.col("labels")), lambda x: F.xxhash64(x))).alias("g"))
    cols = ["text", "signals", "literals", "returns", "blocks", "edges", "edge_types", "defs", "pairs", "cross_pairs", "def_kinds", "use_kinds"]
    x = jaccards(pair, sets).withColumnRenamed("similarity", "syntactic").join(trees.structural_pairs(pair, f, 0.0, costs.Costs()).withColumnRenamed("similarity", "structural"), ["a", "b"])
    for e in ("a", "b"):
        x = x.join(f.select(F.col("id").alias(e), *[F.col(c).alias(f"{e}_{c}") for c in cols]), e)
    t, s = textual(F.col("a_text"), F.col("b_text")), semantic()
    found = classified(t, F.col("syntactic"), F.col("structural"), s)
    return x.select(t.alias("textual"), "syntactic", "structural", s.alias("semantic"), found["type"].alias("type"), found["similarity"].alias("similarity"))

"""Text queries: clones, placeholder data, similarity and scores over documents, pages, conversations and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import scalar as S
from quarry.functions.lineage import cut
from quarry.operators import clones as C
from quarry.operators import graph as G
from quarry.operators import grouping as N
from quarry.operators import placeholders as H
from quarry.operators import scoring as Q
from quarry.operators import summaries as A

THRESHOLD = 0.75


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def content_hash(spark, d):
    """Groups of texts that are equal but for comments and white space: the first id and the number."""
    x = _t(spark, d, "documents").select("doc_id", F.md5(S.strip_comments(F.col("text"))).alias("hash"))
    return x.groupBy("hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")


def _sets(spark, d):
    """Representatives of documents with equal sets of 4-grams, and which document has which."""
    return C.classes(C.word_grams(_t(spark, d, "documents"), "doc_id", "text"))


def _near(spark, d):
    reps, members = _sets(spark, d)
    return cut(C.exact_pairs(reps, THRESHOLD)), members


def clone_pairs(spark, d):
    """Pairs of different documents whose 4-gram sets are similar, exactly, by prefix filtering; copies are one."""
    return _near(spark, d)[0]


def clone_groups(spark, d):
    """Documents in connected groups of those pairs, their copies included."""
    p, members = _near(spark, d)
    nodes = p.select(F.col("a").alias("node")).union(p.select("b")).distinct()
    comp = G.components(nodes, p.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    x = members.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").groupBy(F.coalesce("component", "rep").alias("component"))
    return x.agg(F.count("*").alias("size")).where("size > 1")


def clone_stars(spark, d):
    """Members of each connected group that are similar to its medoid."""
    return N.star_groups(_near(spark, d)[0])


def clone_statistics(spark, d):
    """Pairs by type: 1 are copies with their representative, 2 are similar."""
    p, members = _near(spark, d)
    same = members.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"), F.lit(1).alias("type"))
    return C.statistics(same.unionByName(p.withColumn("type", F.lit(2))))


def clone_cliques(spark, d):
    """Each document with the least id of its 4-gram set and of its group by complete linkage of these sets, copies included, and
    with how many other sets are similar to its own, grouped with it or not. The groups depend on an order: tested by brute force."""
    from quarry.operators.cliques import complete_documents

    return complete_documents(_t(spark, d, "documents"), "doc_id", "text", THRESHOLD)


def clone_centroids(spark, d):
    return N.centroid_groups(_near(spark, d)[0], THRESHOLD)


def clone_bands(spark, d):
    """The same pairs by MinHash bands, which miss one in 200,000 at the threshold, and an exact check."""
    reps, _ = _sets(spark, d)
    return C.candidates(reps, THRESHOLD, True)


def clone_best(spark, d):
    return C.best(_near(spark, d)[0], 20)


def clone_covered(spark, d):
    """Neighbourhoods of documents that are part of no other's."""
    p, _ = _near(spark, d)
    both = p.select(F.col("a").alias("group"), F.col("b").alias("node")).unionAll(p.select("b", "a"))
    own = both.select("group", F.col("group").alias("node")).distinct()
    return N.uncovered(both.unionAll(own))


def clone_referenced(spark, d):
    """Documents that take part in a pair."""
    p, _ = _near(spark, d)
    return C.referenced(_t(spark, d, "documents").select(F.col("doc_id").alias("id"), "source"), p)


def text_similarity(spark, d):
    """Levenshtein similarity of each whole turn to the one before."""
    x = _t(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("s"))
    y = x.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("s").alias("before"))
    return x.join(y, ["conv_id", "turn"]).select("conv_id", "turn", C.textual(F.col("s"), F.col("before")).alias("similarity"))


def vector_similarity(spark, d):
    """Cosine similarity of each vector to the first vector of its label."""
    e = _t(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("medoid"))
    return e.join(first, "label").select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("medoid")), 6).alias("similarity"))


def mock_findings(spark, d):
    """One row for each heuristic that a document meets; the text is put in lower case once."""
    x = _t(spark, d, "documents").select("doc_id", "text", F.lower("text").alias("low"))
    tests = H.of_string(F.col("text"), F.col("low")) + [("placeholder", "info", S.mock_comment(F.col("text")))]
    return x.select("doc_id", F.inline(H.found(tests)))


def mock_words(spark, d):
    """Placeholder words, keys and repetitive strings among the words of turns."""
    w = _t(spark, d, "conversations").select(F.explode(F.split("text", r"[^A-Za-z0-9_@.:/-]+")).alias("word")).where("word <> ''")
    return w.select("word", H.worst(H.of_string(F.col("word"))).alias("f")).where("f is not null").groupBy("word", "f.kind", "f.severity").agg(F.count("*").alias("n"))


def mock_summary(spark, d):
    return mock_findings(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))


def mock_severity(spark, d):
    """The highest severity of each document that has a finding."""
    x = mock_findings(spark, d).withColumn("o", S.ordinal(F.col("severity"), S.SEVERITIES))
    return x.groupBy("doc_id").agg(F.max("o").cast("long").alias("worst"), F.count("*").alias("n"))


def repetitive_words(spark, d):
    w = _t(spark, d, "conversations").select(F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("word"))
    return w.where(S.repetitive(F.col("word"))).groupBy("word").agg(F.count("*").alias("n"))


def line_counts(spark, d):
    """The three line counts: newlines + 1, lines without a final empty one, non-blank lines."""
    ls = F.split(F.col("text"), "\n")
    return _t(spark, d, "documents").select("doc_id", F.size(ls).cast("long").alias("lines"), (F.size(ls) - F.col("text").endswith("\n").cast("int")).cast("long").alias("physical"), F.size(F.filter(ls, lambda x: F.trim(x) != "")).cast("long").alias("source"))


def grams_summary(spark, d):
    return C.word_grams(_t(spark, d, "benchmark"), "item_id", "text").select("id", F.size("grams").cast("long").alias("grams"))


def health_inputs(spark, d) -> DataFrame:
    lab, doc = _t(spark, d, "labels"), _t(spark, d, "documents")
    a = lab.agg(F.count_if(F.col("toxic") == 1).alias("critical"), F.count_if(F.col("quality") == 0).alias("warning"), F.count("*").alias("n"))
    b = doc.agg(F.count("*").alias("files"), F.count_if(F.col("n_chars") < 100).alias("skipped"), (F.avg("n_chars") / 400).alias("mean"))
    return a.crossJoin(b)  # one row each


def health_score(spark, d):
    c = F.col
    x = health_inputs(spark, d)
    x = x.select(
        Q.complexity_penalty(c("mean"), c("mean") * 2, c("mean") / 2).alias("complexity"), Q.dead_code_penalty(c("critical"), c("warning"), F.lit(0), c("files")).alias("dead_code"),
        Q.duplication_penalty(100 * S.ratio(c("warning"), c("n"))).alias("duplication"), Q.share_penalty(c("critical"), c("warning"), c("n")).alias("coupling"),
        Q.architecture_penalty(1 - S.ratio(c("critical"), c("n"))).alias("architecture"), Q.parse_penalty(c("skipped"), c("files")).alias("parse"),
    )
    score = Q.total(*[F.col(k) for k in ("complexity", "dead_code", "duplication", "coupling", "architecture", "parse")])
    return x.withColumn("score", score).withColumn("grade", Q.grade(F.col("score")))


def quality_gate(spark, d):
    """Violating rows by rule."""
    p, l = _t(spark, d, "part"), _t(spark, d, "lineitem")
    one = lambda name, df: df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")
    return one("complexity", l.where("l_quantity > 40")).unionByName(one("size", p.where("p_size > 45"))).unionByName(one("documents", _t(spark, d, "documents").where("n_chars > 5000")))


_DOC = '(?s)""".*?"""|' + "''" * 3 + ".*?" + "''" * 3
NORM = f"trim(regexp_replace(regexp_replace(regexp_replace(text, '{_DOC}', '', 'g'), '#[^" + r"\n]*', '', 'g'), '\s+', ' ', 'g'))"
GRAMS = "g AS (SELECT DISTINCT id, array_to_string(w[x : x + 3], ' ') AS gram FROM (SELECT id, w, unnest(range(1, len(w) - 2)) AS x FROM (SELECT id, [t for t in regexp_split_to_array(lower(text), '[^a-z0-9]+') if t <> ''] AS w FROM src) WHERE len(w) >= 4))"
SETS = "src AS (SELECT doc_id AS id, text FROM documents), " + GRAMS + ", ss AS (SELECT id, list_sort(list(gram)) AS gs FROM g GROUP BY 1), mm AS (SELECT id, min(id) OVER (PARTITION BY gs) AS rep FROM ss)"
PAIRS = SETS + f", r AS MATERIALIZED (SELECT g.id, hash(gram) AS gram FROM g JOIN mm ON g.id = mm.id WHERE mm.id = rep), s AS (SELECT id, count(*) AS n FROM r GROUP BY 1), i AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM r AS x JOIN r AS y ON x.gram = y.gram AND x.id < y.id GROUP BY 1, 2), p AS MATERIALIZED (SELECT a, b, k / (sa.n + sb.n - k) AS similarity FROM i JOIN s AS sa ON sa.id = a JOIN s AS sb ON sb.id = b WHERE k / (sa.n + sb.n - k) >= {THRESHOLD})"
COMP = ", u AS (SELECT a AS x, b AS y FROM p UNION SELECT b, a FROM p), c AS (SELECT x, y FROM u UNION SELECT x, x FROM u UNION SELECT c.x, u.y FROM c JOIN u ON c.y = u.x), k AS (SELECT x, min(y) AS component FROM c GROUP BY 1)"
#: The heuristics, written out.
WORD = "regexp_matches(lower({0}), '(^|[^a-z0-9])(mock|fake|dummy|test|sample|example|placeholder|stub|fixture|temp|tmp|foo|bar|baz|qux|lorem|ipsum)($|[^a-z0-9])')"
DOMAIN = "regexp_matches(lower({0}), 'example\\.com|example\\.org|example\\.net|test\\.com|test\\.org|test\\.net|localhost|invalid|foo\\.com|bar\\.com')"
EMAIL = "regexp_matches({0}, '(?i)[a-z0-9._%+-]+@(example\\.(com|org|net)|test\\.(com|org|net)|localhost|invalid|foo\\.com|bar\\.com)')"
PHONE = "regexp_matches({0}, '(^|[^0-9])(\\(?(000|111|123)\\)?[-.[:space:]]?(0{{3,4}}|1{{3,4}}|456)[-.[:space:]]?(0000|1111|7890))([^0-9]|$)')"
UUID = "(regexp_matches({0}, '(?i)[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}') AND (len(list_distinct(string_split(replace({0}, '-', ''), ''))) <= 2 OR lower(replace({0}, '-', '')) = '12345678123456781234567812345678'))"
AGAIN = "(length({0}) BETWEEN 4 AND 20 AND ({0} = repeat(substr({0}, 1, 1), length({0})) OR (length({0}) % 2 = 0 AND {0} = repeat(substr({0}, 1, 2), length({0}) // 2))))"
SECRET = "regexp_matches({0}, '(?i)^(password|secret|api[_-]?key|token|credential|auth)[0-9]*$|^(password|secret)123$|^test(password|secret|key)$')"
NOTE = "regexp_matches({0}, '(?i)\\b(TODO|FIXME|XXX|HACK|BUG|NOTE)[\\s:]+.*(replace|change|update|mock|fake|dummy|placeholder|temporary|temp)')"
RULES = [("keyword", "info", WORD), ("domain", "warning", DOMAIN), ("email", "warning", EMAIL), ("phone", "warning", PHONE), ("uuid", "warning", UUID), ("repetitive", "info", AGAIN), ("credential", "error", SECRET)]
MOCK = "m AS (SELECT doc_id, unnest([" + ", ".join(f"CASE WHEN {sql.format('text')} THEN {{'kind': '{k}', 'severity': '{v}'}} END" for k, v, sql in [*RULES, ("placeholder", "info", NOTE)]) + "]) AS f FROM documents), x AS (SELECT doc_id, f.kind AS kind, f.severity AS severity FROM m WHERE f IS NOT NULL)"
_BEST = "CASE " + " ".join(f"WHEN {sql.format('word')} THEN '{k}/{v}'" for level in ("error", "warning", "info") for k, v, sql in RULES if v == level) + " END"
_HALF = lambda e: f"(sign({e}) * floor(abs({e}) + 0.5))::BIGINT"
_LIN = lambda e, lo, hi: f"(greatest(0, least(1, ({e} - {lo}) / ({hi} - {lo}))) * 20)"

QUERIES = {
    "content_hash": (content_hash, f"SELECT md5({NORM}) AS hash, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1"),
    "clone_pairs": (clone_pairs, f"WITH {PAIRS} SELECT a, b, similarity FROM p"),
    "clone_groups": (clone_groups, f"WITH RECURSIVE {PAIRS}{COMP} SELECT coalesce(component, rep) AS component, count(*) AS size FROM mm LEFT JOIN k ON rep = x GROUP BY 1 HAVING count(*) > 1"),
    "clone_stars": (clone_stars, f"WITH RECURSIVE {PAIRS}{COMP}, v AS (SELECT a AS x, b AS y, similarity AS s FROM p UNION ALL SELECT b, a, similarity FROM p), t AS (SELECT x, round(sum(s), 9) AS total FROM v GROUP BY 1), m AS (SELECT component, x AS medoid FROM (SELECT component, x, row_number() OVER (PARTITION BY component ORDER BY total DESC, x) AS rn FROM k JOIN t USING (x)) WHERE rn = 1) SELECT component, medoid, y AS node, s AS similarity FROM m JOIN v ON medoid = x UNION ALL SELECT component, medoid, medoid, 1.0::DOUBLE FROM m"),
    "clone_statistics": (clone_statistics, f"WITH {PAIRS}, z AS (SELECT 1 AS type, rep AS a, id AS b, 1.0::DOUBLE AS similarity FROM mm WHERE id <> rep UNION ALL SELECT 2, a, b, similarity FROM p) SELECT type, count(*) AS pairs, avg(similarity) AS mean_similarity, fragments FROM z JOIN (SELECT type, count(DISTINCT e) AS fragments FROM (SELECT type, a AS e FROM z UNION ALL SELECT type, b FROM z) GROUP BY 1) USING (type) GROUP BY type, fragments"),
    "clone_cliques": (clone_cliques, None),
    "clone_centroids": (clone_centroids, None),
    "clone_bands": (clone_bands, f"WITH {PAIRS} SELECT a, b, similarity FROM p"),
    "clone_best": (clone_best, f"WITH {PAIRS} SELECT a, b, similarity FROM p ORDER BY similarity DESC, a, b LIMIT 20"),
    "clone_covered": (clone_covered, f"WITH {PAIRS}, n AS (SELECT DISTINCT * FROM (SELECT a AS gr, b AS node FROM p UNION ALL SELECT b, a FROM p UNION ALL SELECT a, a FROM p UNION ALL SELECT b, b FROM p)), l AS (SELECT gr, list_sort(list(node)) AS ns FROM n GROUP BY 1) SELECT gr AS \"group\", node FROM n WHERE gr NOT IN (SELECT x.gr FROM l AS x JOIN l AS y ON x.gr <> y.gr AND list_has_all(y.ns, x.ns) AND (len(x.ns) < len(y.ns) OR x.gr > y.gr))"),
    "clone_referenced": (clone_referenced, f"WITH {PAIRS} SELECT doc_id AS id, source FROM documents WHERE doc_id IN (SELECT a FROM p UNION SELECT b FROM p)"),
    "text_similarity": (text_similarity, None),
    "vector_similarity": (vector_similarity, "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], medoid::DOUBLE[]), 6) AS similarity FROM embeddings JOIN (SELECT label, arg_min(embedding, vec_id) AS medoid FROM embeddings GROUP BY 1) USING (label)"),
    "mock_findings": (mock_findings, f"WITH {MOCK} SELECT * FROM x"),
    "mock_summary": (mock_summary, f"WITH {MOCK} SELECT kind, count(*) AS n, count(DISTINCT doc_id) AS documents FROM x GROUP BY 1"),
    "mock_severity": (mock_severity, f"WITH {MOCK} SELECT doc_id, max(CASE severity WHEN 'error' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END)::BIGINT AS worst, count(*) AS n FROM x GROUP BY 1"),
    "mock_words": (mock_words, f"SELECT word, split_part(f, '/', 1) AS kind, split_part(f, '/', 2) AS severity, count(*) AS n FROM (SELECT word, {_BEST} AS f FROM (SELECT unnest(regexp_split_to_array(text, '[^A-Za-z0-9_@.:/-]+')) AS word FROM conversations) WHERE word <> '') WHERE f IS NOT NULL GROUP BY 1, 2, 3"),
    "repetitive_words": (repetitive_words, "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS word FROM conversations) WHERE length(word) BETWEEN 4 AND 20 AND (word = repeat(substr(word, 1, 1), length(word)) OR (length(word) % 2 = 0 AND word = repeat(substr(word, 1, 2), length(word) // 2))) GROUP BY 1"),
    "line_counts": (line_counts, "SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS lines, (len(string_split(text, chr(10))) - ends_with(text, chr(10))::INT)::BIGINT AS physical, len([x FOR x IN string_split(text, chr(10)) IF trim(x) <> ''])::BIGINT AS source FROM documents"),
    "grams_summary": (grams_summary, "WITH src AS (SELECT item_id AS id, text FROM benchmark), " + GRAMS + " SELECT id, count(*) AS grams FROM g GROUP BY 1"),
    "health_score": (
        health_score,
        "WITH i AS (SELECT * FROM (SELECT count(*) FILTER (WHERE toxic = 1) AS critical, count(*) FILTER (WHERE quality = 0) AS warning, count(*) AS n FROM labels), (SELECT count(*) AS files, count(*) FILTER (WHERE n_chars < 100) AS skipped, avg(n_chars) / 400 AS mean FROM documents)), "
        + f"p AS (SELECT {_HALF('greatest(' + _LIN('mean', 2, 15) + ', ' + _LIN('mean * 2', 15, 25) + ', ' + _LIN('mean / 2', 3, 7) + ')')} AS complexity, floor(least(20, (critical + 0.5 * warning) / CASE WHEN files > 10 THEN 1 + log10(files / 10) ELSE 1 END))::BIGINT AS dead_code, least(20, {_HALF('(100 * warning / n / 30 * 20)')})::BIGINT AS duplication, least(20, {_HALF('((critical + 0.5 * warning) / n / 0.4 * 20)')})::BIGINT AS coupling, {_HALF('(12 * (1 - (1 - critical / n)))')} AS architecture, CASE WHEN skipped > 0 THEN greatest(11, {_HALF('(skipped / files * 56)')}) ELSE 0 END::BIGINT AS parse FROM i), "
        "s AS (SELECT *, greatest(0, 100 - complexity - dead_code - duplication - coupling - architecture - parse)::BIGINT AS score FROM p) SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 45 THEN 'D' ELSE 'F' END AS grade FROM s",
    ),
    "quality_gate": (quality_gate, "SELECT 'complexity' AS rule, count(*) AS violations FROM lineitem WHERE l_quantity > 40 UNION ALL SELECT 'size', count(*) FROM part WHERE p_size > 45 UNION ALL SELECT 'documents', count(*) FROM documents WHERE n_chars > 5000"),
}

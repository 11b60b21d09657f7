"""Scalar functions of the metric model as Spark columns; thresholds are parameters with the usual defaults."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def risk(value: Column, low: float, medium: float) -> Column:
    """low up to ``low``, medium up to ``medium``, else high."""
    return F.when(value <= low, "low").when(value <= medium, "medium").otherwise("high")


def complexity_risk(complexity: Column, cognitive: Column | None = None, nesting: Column | None = None) -> Column:
    worst = F.lit(False)
    if cognitive is not None:
        worst = worst | (cognitive > 25)
    if nesting is not None:
        worst = worst | (nesting > 7)
    return F.when(worst, "high").otherwise(risk(complexity, 9, 19))


def bucket(value: Column, tops: list[int]) -> Column:
    """Histogram label: '0', '1-5', ..., 'n+' for rising inclusive tops."""
    out, low = None, None
    for top in tops:
        label = str(top) if low is None or low == top else f"{low}-{top}"
        out = F.when(value <= top, label) if out is None else out.when(value <= top, label)
        low = top + 1
    return out.otherwise(f"{low}+")


def ordinal(name: Column, names: list[str]) -> Column:
    """Place of a severity in ascending order, -1 if unknown."""
    return reduce(lambda acc, kv: F.when(name == kv[1], kv[0]).otherwise(acc), list(enumerate(names)), F.lit(-1))


SEVERITIES = ["info", "warning", "error", "critical"]


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b == 0, F.lit(empty)).otherwise(a / F.when(b == 0, F.lit(1)).otherwise(b))


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def half_up(x: Column) -> Column:
    """Round half away from zero, to a long."""
    return (F.signum(x) * F.floor(F.abs(x) + 0.5)).cast("long")


def closeness(a: Column, b: Column) -> Column:
    """1 - |a - b| / max(a, b); 1 if both are 0."""
    top = F.greatest(a, b)
    return F.when(top == 0, 1.0).otherwise(1.0 - F.abs(a - b) / F.when(top == 0, 1.0).otherwise(top))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def jaccard(a: Column, b: Column) -> Column:
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)), 0.0)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def leaf(dotted: Column) -> Column:
    return F.element_at(F.split(dotted, r"\."), -1)


def package(dotted: Column) -> Column:
    parts = F.split(dotted, r"\.")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), ".")


def common_prefix(a: Column, b: Column) -> Column:
    """Longest common dotted prefix."""
    x, y = F.split(a, r"\."), F.split(b, r"\.")
    n = F.aggregate(
        F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")),
        lambda s, same: F.struct((s["n"] + (s["go"] & same).cast("int")).alias("n"), (s["go"] & same).alias("go")),
    )["n"]
    return F.array_join(F.slice(x, F.lit(1), n), ".")


def glob_regex(pattern: str) -> str:
    """A path glob as an anchored Java regex: ** crosses folders, * and ? don't."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if not (c.isalnum() or c in "/_") else c), i + 1
    return f"^{out}$"


def module_matches(module: Column, pattern: str) -> Column:
    """A module pattern: with * any characters, whole or after a dot; without, one part or run of parts and what follows."""
    body = "".join(".*" if c == "*" else c if c.isalnum() or c == "_" else "\\" + c for c in pattern)
    tail = "" if "*" in pattern else r"(\..+)?"
    return module.rlike(f"(?i)^(.+\\.)?{body}{tail}$")


def common_directory(a: Column, b: Column) -> Column:
    """The deepest folder that holds both paths; '/' or '' where they share none."""
    x, y = F.split(a, "/"), F.split(b, "/")
    n = F.aggregate(
        F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")),
        lambda s, same: F.struct((s["n"] + (s["go"] & same).cast("int")).alias("n"), (s["go"] & same).alias("go")),
    )["n"]
    return F.array_join(F.slice(x, F.lit(1), n), "/")


def is_upper_constant(name: Column) -> Column:
    """Letters, none of them lower-case."""
    return name.rlike(r"[A-Za-z]") & (F.upper(name) == name)


def is_class_like(name: Column) -> Column:
    """The last dotted part, without leading underscores, doesn't begin with a lower-case letter."""
    return F.regexp_replace(leaf(name), "^_+", "").rlike(r"^[^\p{Ll}]")


def is_public(name: Column) -> Column:
    return (name != "") & ~name.startswith("_")


def thousands(x: Column) -> Column:
    return F.format_number(x.cast("long"), 0)


def percentage(x: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", (x * 100).cast("double"))


def duration(ms: Column) -> Column:
    """Milliseconds below a second, seconds with two digits from then on."""
    return F.when(ms < 1000, F.format_string("%dms", ms.cast("long"))).otherwise(F.format_string("%.2fs", (ms / 1000).cast("double")))


def plural(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def strip_comments(text: Column) -> Column:
    """Without triple-quoted strings and # comments, white space collapsed."""
    no_doc = F.regexp_replace(text, r'(?s)""".*?"""|' + r"'''.*?'''", "")
    return F.trim(F.regexp_replace(F.regexp_replace(no_doc, r"#[^\n]*", ""), r"\s+", " "))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    top = F.greatest(F.length(a), F.length(b))
    return F.when(top == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / F.when(top == 0, 1).otherwise(top))


# -- placeholder-data heuristics ----------------------------------------------------------------------------------

#: Placeholder words (fixed values).
MOCK_WORDS = ["mock", "fake", "dummy", "test", "sample", "example", "placeholder", "stub", "fixture", "temp", "tmp", "foo", "bar", "baz", "qux", "lorem", "ipsum"]
#: Reserved and placeholder domains (fixed values).
MOCK_DOMAINS = ["example.com", "example.org", "example.net", "test.com", "test.org", "test.net", "localhost", "invalid", "foo.com", "bar.com"]
#: Patterns (fixed values).
MOCK_EMAIL = r"(?i)[a-z0-9._%+-]+@(example\.(com|org|net)|test\.(com|org|net)|localhost|invalid|foo\.com|bar\.com)"
MOCK_PHONE = r"(?:^|[^0-9])(\(?(?:0{3}|1{3}|123)\)?[-.\s]?(?:0{3,4}|1{3,4}|456)[-.\s]?(?:0{4}|1{4}|7890))(?:[^0-9]|$)"
MOCK_UUID = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
MOCK_COMMENT = r"(?i)\b(TODO|FIXME|XXX|HACK|BUG|NOTE)[\s:]+.*(?:replace|change|update|mock|fake|dummy|placeholder|temporary|temp)"
MOCK_CREDENTIAL = r"(?i)^(password|secret|api[_-]?key|token|credential|auth)[0-9]*$|^(password|secret)123$|^test(password|secret|key)$"


def has_word(low: Column, words: list[str]) -> Column:
    """A whole word of the list in a text of lower case: one alternation, tried only where a word occurs at all."""
    return has_any(low, words) & low.rlike(r"(^|[^a-z0-9])(" + "|".join(words) + r")($|[^a-z0-9])")


def has_any(low: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in parts])


def mock_email(text: Column) -> Column:
    return F.contains(text, F.lit("@")) & text.rlike(MOCK_EMAIL)


def mock_phone(text: Column) -> Column:
    ends = F.contains(text, F.lit("0000")) | F.contains(text, F.lit("1111")) | F.contains(text, F.lit("7890"))
    return ends & text.rlike(MOCK_PHONE)


def mock_uuid(text: Column) -> Column:
    """An identifier with little variety: the text without hyphens has one or two different characters, or counts up."""
    bare = F.replace(text, F.lit("-"), F.lit(""))
    return F.contains(text, F.lit("-")) & text.rlike(MOCK_UUID) & (low_entropy(bare) | (F.lower(bare) == "12345678123456781234567812345678"))


def mock_comment(text: Column) -> Column:
    return text.rlike(MOCK_COMMENT)


def mock_credential(text: Column) -> Column:
    return (F.length(text) <= 64) & text.rlike(MOCK_CREDENTIAL)


def low_entropy(text: Column, most: int = 2) -> Column:
    """At most ``most`` different characters."""
    return F.size(F.array_distinct(F.split(text, ""))) <= most


def repetitive(text: Column, shortest: int = 4, longest: int = 20) -> Column:
    """One character, or one pair of characters, over and over."""
    return F.length(text).between(shortest, longest) & (text.rlike(r"(?s)^(.)\1+$") | text.rlike(r"(?s)^(..)\1+$"))

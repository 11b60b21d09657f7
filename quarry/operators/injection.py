"""Rules on injected dependencies: crowded constructors, hidden and concrete dependencies, service locators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import scalar as S

LEVELS = ["info", "warning", "error"]
MOST_PARAMETERS = 5
#: Names that mark an abstract type, builtin types, containers (fixed values).
ABSTRACT_PREFIXES, ABSTRACT_SUFFIXES = ["Abstract", "Base", "I"], ["Interface", "Protocol", "ABC", "Base", "Abstract"]
BUILTIN_TYPES = [
    "bool", "int", "float", "complex", "str", "bytes", "bytearray", "list", "tuple", "range", "dict", "set", "frozenset", "object", "type", "super", "Exception", "BaseException", "ValueError",
    "TypeError", "KeyError", "IndexError", "AttributeError", "RuntimeError",
]
GENERIC_TYPES = ["Optional", "List", "Dict", "Set", "Tuple", "Union", "Callable", "Type", "Any", "Sequence", "Mapping", "Iterable"]
#: Methods, whole calls, and container names of service locators (fixed values).
LOCATOR_METHODS = ["get_service", "resolve", "get_instance", "locate", "get_component", "get_dependency", "get_bean", "inject"]
LOCATOR_CALLS = [
    "container.resolve", "container.get_service", "container.get_instance", "container.locate", "locator.resolve", "locator.get_service", "locator.get_instance", "locator.locate", "ioc.resolve",
    "ioc.get_service", "ioc.get_instance", "ioc.locate", "resolver.resolve",
]
CONTAINERS = ["container", "locator", "ioc", "resolver", "registry", "provider", "services", "dependencies", "injector"]
CONTAINER_SUFFIXES = ["_container", "_locator", "_resolver", "_provider", "_registry", "_injector"]


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def is_concrete(name: Column) -> Column:
    """A type that is no builtin, container, or abstract by its name."""
    abstract = _any([name.startswith(p) for p in ABSTRACT_PREFIXES] + [name.endswith(s) for s in ABSTRACT_SUFFIXES])
    return (name != "") & ~name.isin(BUILTIN_TYPES) & ~name.isin(GENERIC_TYPES) & ~abstract


def is_container(name: Column) -> Column:
    """Whether a part of a dotted name, in any case, is one that holds services."""
    parts = F.split(F.lower(name), r"\.")
    return F.exists(parts, lambda p: p.isin(CONTAINERS) | _any([p.endswith(s) for s in CONTAINER_SUFFIXES]))


def is_locator(method: Column, container: Column) -> Column:
    """A locator's method, called by itself, as a known call, or on something that looks like a container."""
    known = F.lower(F.concat(container, F.lit("."), method)).isin(LOCATOR_CALLS)
    return F.lower(method).isin(LOCATOR_METHODS) & (F.coalesce(container, F.lit("")).isin("") | known | is_container(container))


_OUT = ["path", "class", "method", "line", "col", "type", "subtype", "severity", "subject", "description", "suggestion"]


def _finding(df: DataFrame, type_: str, subtype: str | None, severity: str, text: Column, advice: str) -> DataFrame:
    x = df.withColumn("type", F.lit(type_)).withColumn("subtype", F.lit(subtype).cast("string")).withColumn("severity", F.lit(severity))
    return x.withColumn("subject", F.col("name")).withColumn("description", text).withColumn("suggestion", F.lit(advice)).select(*_OUT)


def over_injection(facts: DataFrame, most: int = MOST_PARAMETERS) -> DataFrame:
    x = facts.where((F.col("kind") == "parameters") & (F.col("amount") > most))
    return _finding(x, "constructor_over_injection", None, "warning", F.format_string(f"Constructor has %d parameters (threshold: {most})", "amount"), "Group parameters in an object or split the class by responsibility")


def hidden_dependencies(facts: DataFrame) -> DataFrame:
    one = lambda kind, severity, text, advice: _finding(facts.where(F.col("kind") == kind), "hidden_dependency", kind, severity, text, advice)
    inject = "Pass the dependency to the constructor"
    return (
        one("global", "error", F.format_string("Uses global statement to access '%s'", "name"), inject)
        .unionByName(one("singleton", "warning", F.lit("Keeps its only instance in the class variable '_instance'"), "Let the caller provide the one instance"))
        .unionByName(one("module_variable", "warning", F.format_string("Directly accesses module-level variable '%s'", "name"), inject))
    )


def concrete_dependencies(facts: DataFrame) -> DataFrame:
    c = is_concrete(F.col("name"))
    hints = facts.where((F.col("kind") == "type_hint") & c)
    made = facts.where((F.col("kind") == "instantiation") & c & (F.col("name") != F.col("class")) & ~F.col("name").rlike("^[a-z]"))
    return _finding(hints, "concrete_dependency", "type_hint", "info", F.format_string("Parameter '%s' has concrete type hint '%s'", "detail", "name"), "Name an abstract type instead").unionByName(
        _finding(made, "concrete_dependency", "instantiation", "warning", F.format_string("Directly instantiates concrete class '%s' in constructor", "name"), "Take it as a parameter instead")
    )


def service_locators(facts: DataFrame) -> DataFrame:
    x = facts.where((F.col("kind") == "call") & is_locator(F.col("name"), F.col("detail")))
    return _finding(x, "service_locator", None, "warning", F.format_string("Uses service locator pattern via '%s'", "name"), "Pass the dependency to the constructor")


def antipatterns(facts: DataFrame, least: str = "warning", most_parameters: int = MOST_PARAMETERS) -> DataFrame:
    """Findings of all four rules, of severity ``least`` or more."""
    every = over_injection(facts, most_parameters).unionByName(hidden_dependencies(facts)).unionByName(concrete_dependencies(facts)).unionByName(service_locators(facts))
    return every.where(S.ordinal(F.col("severity"), LEVELS) >= LEVELS.index(least))


def sorted_antipatterns(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.desc(S.ordinal(F.col("severity"), LEVELS)), "path", "line", "col", "type", "subject")


def antipattern_summary(findings: DataFrame) -> DataFrame:
    """type -> errors, warnings, infos, classes."""
    return findings.groupBy("type").agg(*[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in reversed(LEVELS)], F.count_distinct("path", "class").alias("classes"))

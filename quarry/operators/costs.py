"""Costs of tree edits by the kind of node: what weighs more when inserted, deleted or renamed."""

from __future__ import annotations

from dataclasses import dataclass

#: Kinds of nodes by the prefix of their label (fixed values).
STRUCTURAL = ["FunctionDef", "AsyncFunctionDef", "ClassDef", "Module", "Arguments", "Arg", "Decorator"]
CONTROL = ["If", "For", "While", "Try", "With", "Match", "AsyncFor", "AsyncWith", "ExceptHandler", "Break", "Continue", "Return", "Raise"]
EXPRESSIONS = ["BinOp", "UnaryOp", "BoolOp", "Compare", "Call", "Attribute", "Subscript", "List", "Tuple", "Dict", "Set", "Lambda", "IfExp", "ListComp", "SetComp", "DictComp", "GeneratorExp"]
BOILERPLATE = ["Field(", "field(", "Factory(", "attrib(", "attr.ib("]
RELATED = [("FunctionDef", "AsyncFunctionDef"), ("For", "AsyncFor"), ("With", "AsyncWith")]
DEFINITIONS = ["ClassDef", "FunctionDef", "AsyncFunctionDef"]


def _starts(label: str, names: list[str]) -> bool:
    return label.startswith(tuple(names))


def is_boilerplate(label: str) -> bool:
    """Annotated assignments, decorators, type parameters and fields of data classes."""
    low = label.lower()
    return _starts(label, ["AnnAssign", "Decorator"]) or "generic_type" in low or "type_parameter" in low or any(p in label for p in BOILERPLATE)


@dataclass(frozen=True)
class Costs:
    ignore_literals: bool = False
    ignore_names: bool = False
    boilerplate: float | None = 0.1

    def edit(self, label: str) -> float:
        """Of an insertion or a deletion."""
        if self.boilerplate is not None and is_boilerplate(label):
            return self.boilerplate
        if _starts(label, STRUCTURAL):
            return 1.5
        if _starts(label, CONTROL):
            return 1.3
        if _starts(label, EXPRESSIONS):
            return 0.8
        if self.ignore_literals and label.startswith("Constant("):
            return 0.1
        return 0.2 if self.ignore_names and label.startswith("Name(") else 1.0

    def rename(self, a: str, b: str) -> float:
        if a == b:
            return 0.0
        for ignore, kind in ((self.ignore_literals, "Constant("), (self.ignore_names, "Name(")):
            if ignore and a.startswith(kind) and b.startswith(kind):
                return 0.0
        x, y = a.split("(", 1)[0], b.split("(", 1)[0]
        if x == y:
            return 1.0 if x in DEFINITIONS else 0.7
        if (x, y) in RELATED or (y, x) in RELATED:
            return 0.8
        return 0.9 if any(x in kinds and y in kinds for kinds in (STRUCTURAL, CONTROL, EXPRESSIONS)) else 1.0

"""What one parse of a Python file yields: rows of every relation, from the syntax tree, the tokens and the lines.

Each relation is a function of a ``Source``; RELATIONS names them with their Spark schemas. Trees are walked with a stack
where depth has no bound, so a file of deep expressions is analysed like any other.
"""

from __future__ import annotations

import ast
import builtins
import io
import keyword
import re
import tokenize
from functools import cached_property

from quarry.sources.control_flow import COMPREHENSIONS, SCOPES, Flow, blocks, def_use, references

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
MODULE = "<module>"
OPERATORS = {
    "Add": "+", "Sub": "-", "Mult": "*", "Div": "/", "FloorDiv": "//", "Mod": "%", "Pow": "**", "MatMult": "@", "LShift": "<<", "RShift": ">>", "BitOr": "|", "BitXor": "^", "BitAnd": "&",
    "And": "and", "Or": "or", "Not": "not", "Invert": "~", "UAdd": "+", "USub": "-", "Eq": "==", "NotEq": "!=", "Lt": "<", "LtE": "<=", "Gt": ">", "GtE": ">=", "Is": "is", "IsNot": "is not", "In": "in", "NotIn": "not in",
}
_MARKS = (ast.expr_context, ast.operator, ast.unaryop, ast.boolop, ast.cmpop)


def symbol(op: ast.AST) -> str:
    return OPERATORS[type(op).__name__]


def operator_of(n: ast.AST) -> str | None:
    if isinstance(n, ast.Compare):
        return " ".join(map(symbol, n.ops))
    return symbol(n.op) if isinstance(n, (ast.BinOp, ast.AugAssign, ast.UnaryOp, ast.BoolOp)) else None


def dotted(n: ast.AST | None) -> str:
    """a.b.c of names and attributes, else ''."""
    parts = []
    while isinstance(n, ast.Attribute):
        parts.append(n.attr)
        n = n.value
    return ".".join([n.id, *reversed(parts)]) if isinstance(n, ast.Name) else ""


def label(n: ast.AST) -> str:
    kind = type(n).__name__
    if isinstance(n, ast.Name):
        return f"Name({n.id})"
    if isinstance(n, ast.Constant):
        return f"Constant({n.value!r})"
    if isinstance(n, ast.Attribute):
        return f"Attribute({n.attr})"
    if isinstance(n, SCOPES):
        return f"{kind}({n.name})"
    if isinstance(n, ast.arg):
        return f"Arg({n.arg})"
    op = operator_of(n)
    return f"{kind}({op})" if op else kind[:1].upper() + kind[1:]


def is_docstring(n: ast.AST, parent: ast.AST | None, place: int) -> bool:
    return place == 0 and isinstance(parent, (ast.Module, *SCOPES)) and isinstance(n, ast.Expr) and isinstance(n.value, ast.Constant) and isinstance(n.value.value, str) and bool(parent.body) and parent.body[0] is n


def children(n: ast.AST):
    """(field, child) in source order of fields; decorators first, as nodes of their own."""
    fields = ["decorator_list", *(f for f in n._fields if f != "decorator_list")] if hasattr(n, "decorator_list") else n._fields
    for field in fields:
        value = getattr(n, field, None)
        for c in value if isinstance(value, list) else [value]:
            if isinstance(c, ast.AST) and not isinstance(c, _MARKS):
                yield field, c


def preorder(root: ast.AST, skip_docstrings: bool = False):
    """(id, parent id, place among its siblings, field, node, parent, depth) of each node."""
    out, stack = [], [(root, None, None, 0, None, 0)]
    while stack:
        n, up, parent, place, field, depth = stack.pop()
        me = len(out)
        out.append((me, up, place, field, n, parent, depth))
        kids = [(f, c) for f, c in children(n)]
        if skip_docstrings and isinstance(n, (ast.Module, *SCOPES)):
            kids = [(f, c) for f, c in kids if not (f == "body" and is_docstring(c, n, 0))]
        stack += [(c, me, n, k, f, depth + 1) for k, (f, c) in reversed(list(enumerate(kids)))]
    return out


def sizes(parents: list[int | None]) -> list[int]:
    out = [1] * len(parents)
    for i in range(len(parents) - 1, 0, -1):
        out[parents[i]] += out[i]
    return out


def inside(fn: ast.AST):
    """Nodes of a function or module without those of nested scopes; these themselves are included."""
    stack = list(reversed(getattr(fn, "body", [])))
    while stack:
        n = stack.pop()
        yield n
        if not isinstance(n, SCOPES):
            stack += reversed(list(ast.iter_child_nodes(n)))


# -- metrics of a function ------------------------------------------------------------------------------------------


def cognitive(fn: ast.AST) -> int:
    """Breaks in the flow, weighted by nesting; elif, else, break, continue and runs of one boolean operator add one."""
    total, stack = 0, [(s, 0, "") for s in reversed(fn.body)]

    def push(nodes, level, outer=""):
        stack.extend((n, level, outer) for n in reversed([n for n in nodes if n is not None]))

    while stack:
        n, level, outer = stack.pop()
        if isinstance(n, SCOPES):
            continue
        if isinstance(n, ast.If):
            total += 1 + (0 if outer == "elif" else level)
            if n.orelse and len(n.orelse) == 1 and isinstance(n.orelse[0], ast.If) and n.orelse[0].col_offset == n.col_offset:
                push(n.orelse, level, "elif")
            elif n.orelse:
                total += 1
                push(n.orelse, level + 1)
            push(n.body, level + 1)
            push([n.test], level)
        elif isinstance(n, (ast.For, ast.AsyncFor, ast.While)):
            total += 1 + level + bool(n.orelse)
            push(n.orelse, level + 1)
            push(n.body, level + 1)
            push([n.test if isinstance(n, ast.While) else n.iter], level)
        elif isinstance(n, (ast.Try, ast.TryStar)):
            total += bool(n.orelse)
            push(n.finalbody, level)
            push(n.orelse, level + 1)
            push(n.handlers, level)
            push(n.body, level)
        elif isinstance(n, ast.ExceptHandler):
            total += 1 + level
            push(n.body, level + 1)
        elif isinstance(n, (ast.With, ast.AsyncWith)):
            push(n.body, level + 1)
        elif isinstance(n, ast.Match):
            total += 1 + level
            push(n.cases, level + 1)
        elif isinstance(n, ast.match_case):
            push(n.body, level)
        elif isinstance(n, (ast.Break, ast.Continue)):
            total += 1
        elif isinstance(n, ast.BoolOp):
            op = symbol(n.op)
            total += op != outer
            for v in n.values:
                push([v], level, op if isinstance(v, ast.BoolOp) else "")
        elif isinstance(n, ast.IfExp):
            total += 1 + level
            push([n.test, n.body, n.orelse], level + 1)
        elif isinstance(n, ast.Lambda):
            push([n.body], level + 1)
        else:
            push(ast.iter_child_nodes(n), level)
    return total


NESTING = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith, ast.Try, ast.TryStar, ast.ExceptHandler, ast.Match, ast.match_case, ast.Lambda, *COMPREHENSIONS)


def nesting(fn: ast.AST) -> int:
    most, stack = 0, [(s, 0) for s in fn.body]
    while stack:
        n, depth = stack.pop()
        if isinstance(n, SCOPES):
            continue
        depth += isinstance(n, NESTING)
        most = max(most, depth)
        stack += [(c, depth) for c in ast.iter_child_nodes(n)]  # an elif stands inside the if whose branch it is
    return most


def statement_counts(fn: ast.AST) -> dict[str, int]:
    kinds = {"ifs": (ast.If,), "loops": (ast.For, ast.AsyncFor, ast.While), "handlers": (ast.ExceptHandler,), "matches": (ast.Match,), "cases": (ast.match_case,)}
    out = dict.fromkeys(kinds, 0)
    for n in inside(fn):
        for k, types in kinds.items():
            out[k] += isinstance(n, types)
    return out


def logical_lines(tree: ast.AST) -> int:
    """Statements, handlers and cases, without docstrings."""
    total, stack = 0, [tree]
    while stack:
        n = stack.pop()
        total += isinstance(n, (ast.stmt, ast.ExceptHandler, ast.match_case))
        total -= isinstance(n, (ast.Module, *SCOPES)) and bool(n.body) and is_docstring(n.body[0], n, 0)
        stack += [c for c in ast.iter_child_nodes(n) if isinstance(c, (ast.stmt, ast.ExceptHandler, ast.match_case))]
    return total


# -- lines ----------------------------------------------------------------------------------------------------------

_OPENS_BLOCK = re.compile(r"(?:async def |def |class ).*:$")
_OPENS_DOC = re.compile(r"""[rRuU]?(\"\"\"|''')""")


def _triple(line: str) -> str | None:
    """The first triple quote that stands outside strings and comments."""
    quote, i = None, 0
    while i < len(line):
        c = line[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = None
        elif line[i : i + 3] in ('"""', "'''"):
            return line[i : i + 3]
        elif c == "#":
            return None
        elif c in "\"'":
            quote = c
        i += 1
    return None


def line_kinds(text: str) -> list[str]:
    """blank, comment, docstring or code of each line; a final line feed opens no line."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    out: list[str] = []
    open_, mode = None, None  # the triple quote that goes on, and what its lines are
    fresh, indent = True, None  # whether a module's docstring may come, and the indent of a header just before
    for line in lines:
        if open_:
            out.append(mode)
            if line.count(open_) % 2:
                open_ = None
            continue
        bare = line.strip()
        if not bare:
            out.append("blank")
        elif bare.startswith("#"):
            out.append("comment")
        else:
            depth = len(line) - len(line.lstrip(" \t"))
            doc = _OPENS_DOC.match(bare)
            if doc and (fresh or indent is not None and depth > indent):
                out.append("docstring")
                mark, mode = doc.group(1), "docstring"
                indent = None
            else:
                out.append("code")
                mark, mode = _triple(line), "code"
                indent = depth if _OPENS_BLOCK.match(bare) else None
            fresh = False
            if mark and line.count(mark) % 2:
                open_ = mark
    return out


# -- tokens ---------------------------------------------------------------------------------------------------------


def bare_string(text: str) -> str:
    """A literal without quotes; an f before them goes too, other prefixes keep it whole."""
    if len(text) > 2 and text[0] in "fF":
        return bare_string(text[1:])
    if len(text) >= 6 and text[:3] in ('"""', "'''"):
        return text[3:-3]
    return text[1:-1] if len(text) >= 2 and text[0] in "\"'" else text


class Source:
    """A parsed file. What several relations need is made once."""

    def __init__(self, path: str, module: str, content: bytes):
        self.path, self.module, self.content = path, module, content
        self.tree = ast.parse(content)
        self.text = ast_text(content)

    @cached_property
    def lines(self) -> list[str]:
        return self.text.split("\n")

    @cached_property
    def kinds(self) -> list[str]:
        return line_kinds(self.text)

    @cached_property
    def functions(self) -> list[tuple[str, str | None, ast.AST, bool]]:
        """(qualified name, class, node, nested in a function) in source order; the module's own code is '<module>'."""
        out, stack = [(MODULE, None, self.tree, False)], [(self.tree, "", None, False)]
        while stack:
            n, scope, cls, nested = stack.pop()
            for c in ast.iter_child_nodes(n):
                if isinstance(c, FUNCTIONS):
                    name = f"{scope}{c.name}"
                    out.append((name, cls, c, nested))
                    stack.append((c, name + ".", cls, True))
                elif isinstance(c, ast.ClassDef):
                    stack.append((c, f"{scope}{c.name}.", f"{scope}{c.name}", nested))
                else:
                    stack.append((c, scope, cls, nested))
        return sorted(out, key=lambda f: (getattr(f[2], "lineno", 0), getattr(f[2], "col_offset", 0), f[0]))

    @cached_property
    def flows(self) -> list[Flow]:
        return [Flow(n) for _, _, n, _ in self.functions]

    @cached_property
    def refs(self) -> list[list]:
        return [references(n, f) for (_, _, n, _), f in zip(self.functions, self.flows)]

    @cached_property
    def classes(self) -> list[tuple[str, ast.ClassDef, bool]]:
        """(qualified name, node, whether at the top level) in source order."""
        out, stack = [], [(self.tree, "", True)]
        while stack:
            n, scope, top = stack.pop()
            for c in ast.iter_child_nodes(n):
                if isinstance(c, ast.ClassDef):
                    out.append((scope + c.name, c, top and isinstance(n, ast.Module)))
                own = isinstance(c, SCOPES)
                stack.append((c, f"{scope}{c.name}." if own else scope, top and not own))
        return sorted(out, key=lambda c: (c[1].lineno, c[1].col_offset))

    @cached_property
    def imported(self) -> dict[str, str]:
        """Names that imports bind -> what they stand for."""
        out = {}
        for n in ast.walk(self.tree):
            if isinstance(n, ast.Import):
                for a in n.names:
                    out[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
            elif isinstance(n, ast.ImportFrom):
                for a in n.names:
                    out[a.asname or a.name] = f"{n.module or ''}.{a.name}".strip(".")
        return out

    @cached_property
    def tokens(self) -> list[tuple]:
        """(kind, text, value, line, column, end line, end column) of strings, identifiers and comments."""
        out, starts = [], []
        for t in tokenize.tokenize(io.BytesIO(self.content).readline):
            if t.type == tokenize.FSTRING_START:
                starts.append(t)
            elif t.type == tokenize.FSTRING_END:
                first = starts.pop()
                text = self.between(first.start, t.end)
                out.append(("string", text, bare_string(text), *first.start, *t.end))
            elif t.type == tokenize.STRING:
                out.append(("string", t.string, bare_string(t.string), *t.start, *t.end))
            elif t.type == tokenize.COMMENT:
                out.append(("comment", t.string, t.string, *t.start, *t.end))
            elif t.type == tokenize.NAME and not keyword.iskeyword(t.string):
                out.append(("identifier", t.string, t.string, *t.start, *t.end))
        return out

    def between(self, start: tuple[int, int], end: tuple[int, int]) -> str:
        rows = self.lines[start[0] - 1 : end[0]]
        if not rows:
            return ""
        rows[-1] = rows[-1][: end[1]]
        rows[0] = rows[0][start[1] :]
        return "\n".join(rows)

    def column(self, line: int, byte: int) -> int:
        """The tree counts bytes, tokens characters."""
        return len(self.lines[line - 1].encode()[:byte].decode(errors="ignore"))


def ast_text(content: bytes) -> str:
    """The file as text, in the encoding that it declares."""
    encoding, _ = tokenize.detect_encoding(io.BytesIO(content).readline)
    return content.decode(encoding)


# -- relations ------------------------------------------------------------------------------------------------------


def nodes(s: Source):
    rows = preorder(s.tree)
    size = sizes([r[1] for r in rows])
    for (i, up, place, field, n, parent, depth), z in zip(rows, size):
        name = getattr(n, "name", None) or getattr(n, "id", None) or getattr(n, "attr", None) or getattr(n, "arg", None)
        value = repr(n.value) if isinstance(n, ast.Constant) else None
        doc = field == "body" and is_docstring(n, parent, 0)
        yield i, up, place, field, type(n).__name__, name, operator_of(n), value, label(n), depth, getattr(n, "lineno", None), getattr(n, "col_offset", None), getattr(n, "end_lineno", None), getattr(n, "end_col_offset", None), z, doc


def functions(s: Source):
    sloc = [0]
    for k in s.kinds:
        sloc.append(sloc[-1] + (k == "code"))
    for (name, cls, n, nested), flow in zip(s.functions, s.flows):
        first, last = (1, len(s.kinds)) if n is s.tree else (n.lineno, n.end_lineno)
        a = getattr(n, "args", None)
        params = [p.arg for p in [*a.posonlyargs, *a.args, *filter(None, [a.vararg]), *a.kwonlyargs, *filter(None, [a.kwarg])] if p.arg not in ("self", "cls")] if a else []
        seen, counts = flow.reachable(), statement_counts(n)
        decisions = len({x for x, _, kind in flow.edges if kind in ("cond_true", "cond_false") and x in seen})
        cyclomatic = max(1, max(0, decisions - counts["matches"]) + counts["handlers"] + counts["cases"] + 1)
        edges = sum(x in seen and y in seen for x, y, _ in flow.edges)
        yield (
            name, cls, first, last, params, isinstance(n, ast.AsyncFunctionDef), nested, cyclomatic, cognitive(n), nesting(n), counts["ifs"], counts["loops"], counts["handlers"], counts["matches"],
            counts["cases"], len(seen - {flow.entry, flow.exit}), edges, sloc[min(last, len(s.kinds))] - sloc[min(first, len(sloc)) - 1] if s.kinds else 0,
        )


def cfg_blocks(s: Source):
    for (name, _, n, _), flow in zip(s.functions, s.flows):
        for row in blocks(flow):
            yield name, getattr(n, "lineno", 0), *row


def cfg_edges(s: Source):
    for (name, _, n, _), flow in zip(s.functions, s.flows):
        for row in flow.edges:
            yield name, getattr(n, "lineno", 0), *row


def variables(s: Source):
    for (name, _, n, _), refs in zip(s.functions, s.refs):
        for row in refs:
            yield name, getattr(n, "lineno", 0), *row


def def_uses(s: Source):
    for (name, _, n, _), refs, flow in zip(s.functions, s.refs, s.flows):
        for row in def_use(refs, flow):
            yield name, getattr(n, "lineno", 0), *row


def _type_checking(test: ast.AST) -> bool:
    if isinstance(test, ast.BoolOp):
        return (any if isinstance(test.op, ast.And) else all)(map(_type_checking, test.values))
    return getattr(test, "id", getattr(test, "attr", None)) == "TYPE_CHECKING"


def imports(s: Source):
    """One row a name; ``import a`` has no name. A star is the name '*'."""
    stack = [(s.tree, False, False)]
    found = []
    while stack:
        n, lazy, typed = stack.pop()
        if isinstance(n, ast.Import):
            found += [(n.lineno, n.col_offset, a.name, None, a.asname, 0, lazy, typed) for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            found += [(n.lineno, n.col_offset, n.module or "", a.name, a.asname, n.level, lazy, typed) for a in n.names]
        else:
            guard = isinstance(n, ast.If) and _type_checking(n.test)
            for field, c in children(n):
                stack.append((c, lazy or isinstance(n, FUNCTIONS), typed or guard and field == "body"))
    for line, _, *row in sorted(found, key=lambda r: (r[0], r[1], r[2], str(r[3]), str(r[4]))):
        yield line, *row


def declared(s: Source):
    """Names of the first __all__ of the file."""
    for n in s.tree.body:
        if isinstance(n, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in n.targets):
            if isinstance(n.value, (ast.List, ast.Tuple)):
                yield from ((e.value,) for e in n.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str))
            return


ABSTRACT = ("ABC", "abc.ABC", "ABCMeta", "abc.ABCMeta")


def _decorators(n: ast.AST) -> list[str]:
    return [dotted(d.func if isinstance(d, ast.Call) else d) for d in getattr(n, "decorator_list", [])]


def _abstract_method(n: ast.AST) -> bool:
    return isinstance(n, FUNCTIONS) and any(d == "abstractmethod" or d.endswith(".abstractmethod") for d in _decorators(n))


def is_abstract(c: ast.ClassDef) -> bool:
    return any(dotted(b) in ABSTRACT for b in [*c.bases, *(k.value for k in c.keywords)]) or any(map(_abstract_method, c.body))


def module_facts(s: Source):
    defs = [n for n in ast.walk(s.tree) if isinstance(n, SCOPES)]
    classes = [n for n in defs if isinstance(n, ast.ClassDef)]
    count = s.kinds.count
    public = sorted(n.name for n in defs if not n.name.startswith("_"))
    yield len(defs) - len(classes), len(classes), sum(map(is_abstract, classes)), public, s.text.count("\n") + 1, len(s.kinds), count("code"), logical_lines(s.tree), count("comment"), count("docstring"), count("blank")


def lines(s: Source):
    yield from enumerate(s.kinds, 1)


# classes

CONSTRUCTORS = ("__init__", "__new__", "__post_init__")
PROPERTIES = ("property", "cached_property")
CTYPES = ("Structure", "Union", "BigEndianStructure", "LittleEndianStructure", "BigEndianUnion", "LittleEndianUnion")


def classes(s: Source):
    for name, c, top in s.classes:
        yield name, c.name, c.lineno, c.end_lineno, [b for b in map(_base, c.bases) if b], is_abstract(c), top


def _base(n: ast.AST) -> str:
    return dotted(n.value if isinstance(n, ast.Subscript) else n)


def _is_property(m: ast.AST) -> bool:
    return any(d.split(".")[-1] in PROPERTIES or d.endswith((".setter", ".getter", ".deleter")) for d in _decorators(m))


def class_methods(s: Source):
    """excluded: constructors, class, static and abstract methods."""
    for name, c, _ in s.classes:
        for m in c.body:
            if isinstance(m, FUNCTIONS):
                ds = _decorators(m)
                out = m.name in CONSTRUCTORS or _abstract_method(m) or any(d in ("classmethod", "staticmethod") for d in ds)
                yield name, c.lineno, m.name, m.lineno, out, m.name in CONSTRUCTORS, _is_property(m)


def _field_names(value: ast.AST) -> list[str]:
    return [t.elts[0].value for t in getattr(value, "elts", []) if isinstance(t, ast.Tuple) and t.elts and isinstance(t.elts[0], ast.Constant) and isinstance(t.elts[0].value, str) and t.elts[0].value]


def class_fields(s: Source):
    """Fields of foreign-function structures that _fields_ declares, in the class or for a class of one name."""
    known = [(q, c) for q, c, _ in s.classes if any(_base(b).split(".")[-1] in CTYPES for b in c.bases)]
    once = {c.name: (q, c) for q, c in known if sum(d.name == c.name for _, d in known) == 1}
    for n in ast.walk(s.tree):
        if isinstance(n, (ast.Assign, ast.AnnAssign)):
            for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                if isinstance(t, ast.Attribute) and t.attr == "_fields_" and isinstance(t.value, ast.Name) and t.value.id in once:
                    q, c = once[t.value.id]
                    yield from ((q, c.lineno, f) for f in _field_names(n.value))
                elif isinstance(t, ast.Name) and t.id == "_fields_":
                    yield from ((q, c.lineno, f) for q, c in known if n in c.body for f in _field_names(n.value))


def class_uses(s: Source):
    """(class, line, method, kind, name) of each self.x: 'variable' for all, 'call' where it is called, 'bare' for a lone self."""
    for name, c, _ in s.classes:
        for m in c.body:
            if not isinstance(m, FUNCTIONS):
                continue
            found, owned = set(), set()
            for n in ast.walk(m):
                if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id == "self":
                    found.add(("variable", n.attr))
                    owned.add(id(n.value))
                if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and isinstance(n.func.value, ast.Name) and n.func.value.id == "self":
                    found.add(("call", n.func.attr))
            if any(isinstance(n, ast.Name) and n.id == "self" and id(n) not in owned for n in ast.walk(m)):
                found.add(("bare", "self"))
            yield from ((name, c.lineno, m.name, *f) for f in sorted(found))


#: Classes of the standard library whose names are lower-case (fixed values).
LOWER_CLASSES = ("datetime.datetime", "datetime.date", "datetime.time", "datetime.timedelta", "datetime.timezone", "collections.defaultdict", "collections.deque", "array.array", "socket.socket", "threading.local")


def _annotation_names(n: ast.AST | None):
    if isinstance(n, (ast.Name, ast.Attribute)):
        yield dotted(n)
    elif isinstance(n, ast.Subscript):
        yield from _annotation_names(n.slice)
    elif isinstance(n, (ast.Tuple, ast.List)):
        for x in n.elts:
            yield from _annotation_names(x)
    elif isinstance(n, ast.BinOp) and isinstance(n.op, ast.BitOr):
        yield from _annotation_names(n.left)
        yield from _annotation_names(n.right)


def class_deps(s: Source):
    """(class, line, dependency, kind): inheritance, type_hint, instantiation, attribute; 'import' where an import binds it."""
    known = {c.name for _, c, _ in s.classes}
    postponed = any(isinstance(n, ast.ImportFrom) and n.module == "__future__" and any(a.name == "annotations" for a in n.names) for n in s.tree.body)

    def imported(name: str) -> bool:
        return name in s.imported or name.split(".")[0] in s.imported

    def class_like(name: str) -> bool:
        head, _, tail = name.partition(".")
        full = s.imported.get(name) or (f"{s.imported[head]}.{tail}" if head in s.imported and tail else name)
        leaf = full.split(".")[-1].lstrip("_")
        return full in LOWER_CLASSES or bool(leaf) and not leaf[0].islower()

    def owner(name: str) -> str:
        """The class that a called or read dotted name belongs to."""
        parts = name.split(".") if name else []
        if len(parts) > 1 and imported(name) and class_like(parts[0]):
            return parts[0]
        for end in range(len(parts), 0, -1):
            prefix = ".".join(parts[:end])
            if prefix in known or imported(prefix) and class_like(prefix) and not (end == len(parts) > 1 and parts[-1].isupper()):
                return prefix
        return ""

    for name, c, _ in s.classes:
        nested = {x.name for x in ast.walk(c) if isinstance(x, ast.ClassDef)} - {c.name}
        found = {(_base(b), "inheritance") for b in c.bases}
        skip = {id(x) for b in c.bases for x in ast.walk(b)}
        for n in ast.walk(c):
            hints = [n.annotation] if isinstance(n, (ast.AnnAssign, ast.arg)) else [n.returns] if isinstance(n, FUNCTIONS) else []
            for h in filter(None, hints):
                skip |= {id(x) for x in ast.walk(h)}
                if not postponed:
                    found |= {(x, "type_hint") for x in _annotation_names(h)}
        for n in ast.walk(c):
            if isinstance(n, ast.Call):
                found.add((owner(dotted(n.func)), "instantiation"))
                skip.add(id(n.func))
        for n in ast.walk(c):
            if isinstance(n, ast.Attribute) and id(n) not in skip and dotted(n):
                found.add((owner(dotted(n)), "attribute"))
        for dep, kind in sorted(found):
            if dep and dep != c.name and dep not in nested and s.imported.get(dep, "").split(".")[-1] != c.name and dep not in ("self", "cls"):
                yield name, c.lineno, dep, "import" if imported(dep) else kind


# injection

GENERIC = ("Optional", "List", "Dict", "Set", "Tuple", "Union", "Callable", "Type", "Any", "Sequence", "Mapping", "Iterable")


def _hint_type(n: ast.AST | None) -> str:
    """The first type that is no container in an annotation."""
    if isinstance(n, (ast.Name, ast.Attribute)):
        name = n.id if isinstance(n, ast.Name) else n.attr
        return "" if name in GENERIC or name == "None" else name
    if isinstance(n, ast.Subscript):
        inner = n.slice.elts if isinstance(n.slice, ast.Tuple) else [n.slice]
        return next(filter(None, map(_hint_type, inner)), "") or _hint_type(n.value)
    if isinstance(n, ast.BinOp) and isinstance(n.op, ast.BitOr):
        return _hint_type(n.left) or _hint_type(n.right)
    return ""


def injection(s: Source):
    """(class, method, kind, name, detail, amount, line, column): what the rules on injected dependencies look at."""
    variables_ = set()
    for n in s.tree.body:
        for t in n.targets if isinstance(n, ast.Assign) else [n.target] if isinstance(n, ast.AnnAssign) else []:
            if isinstance(t, ast.Name) and not t.id.startswith("__") and any("a" <= x <= "z" for x in t.id):
                variables_.add(t.id)
    for _, c, _ in s.classes:
        methods = [m for m in c.body if isinstance(m, FUNCTIONS)]
        for b in c.body:
            for t in b.targets if isinstance(b, ast.Assign) else [b.target] if isinstance(b, ast.AnnAssign) else []:
                if isinstance(t, ast.Name) and t.id == "_instance":
                    yield c.name, None, "singleton", "_instance", None, 0, c.lineno, c.col_offset
        for m in methods:
            own = [*m.args.posonlyargs, *m.args.args, *m.args.kwonlyargs]
            local = {p.arg for p in own} | {x for n in ast.walk(m) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store) for x in [n.id]}
            shared = {x for n in ast.walk(m) if isinstance(n, ast.Global) for x in n.names}
            seen = set()
            for n in sorted((x for x in ast.walk(m) if hasattr(x, "lineno")), key=lambda x: (x.lineno, x.col_offset)):
                if isinstance(n, ast.Global):
                    yield c.name, m.name, "global", ", ".join(n.names), None, len(n.names), n.lineno, n.col_offset
                elif isinstance(n, ast.Name) and n.id in variables_ and (n.id not in local or n.id in shared) and n.id not in seen:
                    seen.add(n.id)
                    yield c.name, m.name, "module_variable", n.id, None, 0, n.lineno, n.col_offset
                elif isinstance(n, ast.Call) and isinstance(n.func, (ast.Name, ast.Attribute)):
                    container = dotted(n.func.value) if isinstance(n.func, ast.Attribute) else ""
                    yield c.name, m.name, "call", n.func.id if isinstance(n.func, ast.Name) else n.func.attr, container, len(n.args) + len(n.keywords), n.lineno, n.col_offset
            if m.name == "__init__":
                params = [p for p in [*own, *filter(None, [m.args.vararg, m.args.kwarg])] if p.arg not in ("self", "cls")]
                yield c.name, m.name, "parameters", ", ".join(p.arg for p in params), None, len(params), m.lineno, m.col_offset
                for p in params:
                    if kind := _hint_type(p.annotation):
                        yield c.name, m.name, "type_hint", kind, p.arg, 0, p.lineno, p.col_offset
                for n in ast.walk(m):
                    if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and isinstance(n.value.func, (ast.Name, ast.Attribute)):
                        f = n.value.func
                        yield c.name, m.name, "instantiation", f.id if isinstance(f, ast.Name) else f.attr, None, 0, n.value.lineno, n.value.col_offset


def tokens(s: Source):
    """Strings, identifiers and comments, and assignments of a string to one target (text: the target, value: the string)."""
    rows = list(s.tokens)
    for n in ast.walk(s.tree):
        if isinstance(n, ast.Assign) and len(n.targets) == 1 and isinstance(n.value, ast.Constant) and isinstance(n.value.value, str):
            left = ast.get_source_segment(s.text, n.targets[0]) or ""
            right = ast.get_source_segment(s.text, n.value) or ""
            rows.append(("assignment", left, bare_string(right), n.lineno, s.column(n.lineno, n.col_offset), n.end_lineno, s.column(n.end_lineno, n.end_col_offset)))
    rows.sort(key=lambda r: (r[3], r[4], r[0] != "assignment"))
    for k, row in enumerate(rows):
        yield k, *row


# fragments

COMPOUND = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.For, ast.AsyncFor, ast.While, ast.If, ast.Try, ast.TryStar, ast.With, ast.AsyncWith)
WEAK_CALLS = ("len", "range", "enumerate", "list", "dict", "set", "tuple", "int", "str", "float", "bool")


def normal_text(s: Source, first: int, last: int) -> str:
    """Lines without comments and triple-quoted strings, white space collapsed."""
    cut = [(t[3:5], t[5:7]) for t in s.tokens if (t[0] == "comment" or t[0] == "string" and t[1].lstrip("rRbBuUfF")[:3] in ('"""', "'''")) and first <= t[3] and t[5] <= last]
    rows = [list(x) for x in s.lines[first - 1 : last]]
    for (a, x), (b, y) in cut:
        for k in range(a, b + 1):
            row = rows[k - first]
            for j in range(x if k == a else 0, min(y if k == b else len(row), len(row))):
                row[j] = " "
    return " ".join("\n".join("".join(r) for r in rows).split())


def signals(fn: ast.AST) -> tuple[list[str], list[str], list[str]]:
    """(operators and calls, string literals, categories of returned values)."""
    strong, literals, returns = set(), set(), set()
    inert = {id(x.value) for n in ast.walk(fn) for x in ast.iter_child_nodes(n) if isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant)}
    for n in ast.walk(fn):
        if isinstance(n, (ast.BinOp, ast.AugAssign)):
            strong.add(f"binop:{symbol(n.op)}")
        elif isinstance(n, ast.Compare):
            strong |= {f"compare:{symbol(o)}" for o in n.ops}
        elif isinstance(n, (ast.UnaryOp, ast.BoolOp)):
            strong.add(f"{'unary' if isinstance(n, ast.UnaryOp) else 'bool'}:{symbol(n.op)}")
        elif isinstance(n, ast.Call):
            if isinstance(n.func, ast.Attribute):
                strong.add(f"method:{n.func.attr}")
            elif isinstance(n.func, ast.Name) and n.func.id not in WEAK_CALLS:
                strong.add(f"call:{n.func.id}")
        elif isinstance(n, ast.Return):
            returns.add("none" if n.value is None else "tuple" if isinstance(n.value, ast.Tuple) else "scalar")
        elif isinstance(n, ast.Constant) and isinstance(n.value, str) and n.value and id(n) not in inert:
            literals.add(n.value)
    return sorted(strong), sorted(literals), sorted(returns)


class _Body:
    """A compound statement as the body of a function, for flow features."""

    def __init__(self, n: ast.AST):
        self.body = n.body if isinstance(n, SCOPES) else [n]


def fragments(s: Source):
    """Functions, classes and compound statements with their trees (pre-order labels and parents, no docstrings), text,
    signals, and features of their flow and of their definitions and uses."""
    every = [n for n in ast.walk(s.tree) if isinstance(n, COMPOUND)]
    every.sort(key=lambda n: (n.lineno, n.col_offset, -n.end_lineno))
    for k, n in enumerate(every):
        rows = preorder(n, True)
        parents = [r[1] for r in rows]
        shape = n if isinstance(n, FUNCTIONS) else _Body(n)
        flow = Flow(shape)
        refs = references(shape, flow)
        pairs = list(def_use(refs, flow))
        kinds, defs, uses = {}, {}, {}
        for _, _, kind in flow.edges:
            kinds[kind] = kinds.get(kind, 0) + 1
        for _, _, _, _, kind, is_def in refs:
            into = defs if is_def else uses
            into[kind] = into.get(kind, 0) + 1
        chain: dict[str, int] = {}
        for p in pairs:
            chain[p[0]] = chain.get(p[0], 0) + 1
        strong, literals, returns = signals(n)
        yield (
            k, type(n).__name__, getattr(n, "name", None), n.lineno, n.col_offset, n.end_lineno, n.end_lineno - n.lineno + 1, len(rows), [label(r[4]) for r in rows], parents, normal_text(s, n.lineno, n.end_lineno),
            strong, literals, returns, len(flow.labels), len(flow.edges), kinds, sum(defs.values()), sum(uses.values()), len(pairs), sum(p[-1] for p in pairs), max(chain.values(), default=0), defs, uses,
        )


BUILTINS = sorted(n for n in dir(builtins) if not n.startswith("_"))

_CLASS = "class string, class_line int"
_FN = "function string, function_line int"
RELATIONS = {
    "nodes": ("id int, parent int, ord int, field string, type string, name string, op string, value string, label string, depth int, start_line int, start_col int, end_line int, end_col int, size int, is_docstring boolean", nodes),
    "functions": ("function string, class string, start_line int, end_line int, parameters array<string>, is_async boolean, is_nested boolean, cyclomatic int, cognitive int, nesting int, ifs int, loops int, handlers int, matches int, cases int, blocks int, edges int, sloc int", functions),
    "cfg_blocks": (_FN + ", block int, label string, is_entry boolean, is_exit boolean, start_line int, end_line int, n_stmts int, is_noop boolean, ends_by string, reachable boolean", cfg_blocks),
    "cfg_edges": (_FN + ", src int, dst int, edge_type string", cfg_edges),
    "variables": (_FN + ", block int, position int, line int, name string, kind string, is_def boolean", variables),
    "def_use": (_FN + ", name string, def_block int, def_line int, def_kind string, use_block int, use_line int, use_kind string, cross_block boolean", def_uses),
    "imports": ("line int, target string, name string, alias string, level int, lazy boolean, type_checking boolean", imports),
    "declared": ("name string", declared),
    "module_facts": ("functions int, classes int, abstract_classes int, public_names array<string>, lines int, physical int, sloc int, lloc int, comment_lines int, docstring_lines int, blank_lines int", module_facts),
    "lines": ("line int, kind string", lines),
    "classes": ("class string, name string, start_line int, end_line int, bases array<string>, is_abstract boolean, is_top boolean", classes),
    "class_methods": (_CLASS + ", method string, line int, excluded boolean, is_constructor boolean, is_property boolean", class_methods),
    "class_fields": (_CLASS + ", name string", class_fields),
    "class_uses": (_CLASS + ", method string, kind string, name string", class_uses),
    "class_deps": (_CLASS + ", dependency string, kind string", class_deps),
    "injection": ("class string, method string, kind string, name string, detail string, amount int, line int, col int", injection),
    "tokens": ("seq int, kind string, text string, value string, line int, col int, end_line int, end_col int", tokens),
    "fragments": (
        "fragment int, kind string, name string, start_line int, start_col int, end_line int, lines int, size int, labels array<string>, parents array<int>, text string, signals array<string>, literals array<string>, returns array<string>, "
        "blocks int, edges int, edge_types map<string,int>, defs int, uses int, pairs int, cross_pairs int, longest_chain int, def_kinds map<string,int>, use_kinds map<string,int>",
        fragments,
    ),
}

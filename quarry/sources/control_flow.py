"""Control-flow blocks and edges of a function, and its definitions and uses, from its syntax tree.

A block is a run of statements with one way in and one way out. Edge types: normal, cond_true, cond_false, loop, break,
continue, return, exception. Statements that nothing leads to are blocks without an edge into them, so dead code is what
the entry doesn't reach. What leaves a try (return, break, continue, an exception) passes through its finally first.
"""

from __future__ import annotations

import ast

COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)
SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
LEAVES = {ast.Return: "return", ast.Raise: "raise", ast.Break: "break", ast.Continue: "continue"}


class Flow:
    """``frames`` holds what encloses the place that is built, outermost first: loops, handlers and finally blocks."""

    def __init__(self, fn: ast.AST):
        self.labels: list[str] = []
        self.held: list[list[ast.AST]] = []  # statements, handlers and cases of each block
        self.edges: list[tuple[int, int, str]] = []
        self._known: set[tuple[int, int, str]] = set()
        self.frames: list[tuple] = []
        self.entry, self.exit = self.block("entry"), self.block("exit")
        self.link(self.run(fn.body, self.follow(self.entry, "body")), self.exit, "normal")

    def block(self, label: str) -> int:
        self.labels.append(label)
        self.held.append([])
        return len(self.labels) - 1

    def link(self, a: int | None, b: int, kind: str):
        if a is not None and (a, b, kind) not in self._known:
            self._known.add((a, b, kind))
            self.edges.append((a, b, kind))

    def follow(self, a: int | None, label: str, kind: str = "normal") -> int:
        b = self.block(label)
        self.link(a, b, kind)
        return b

    def leave(self, kind: str, at: int | None, frames: list[tuple]):
        """Control leaves ``at`` for what return, break, continue or an exception leads to from within ``frames``."""
        for frame in reversed(frames):
            if frame[0] == "finally":
                self.link(at, frame[1], kind)
                frame[2].add(kind)
                return
            if frame[0] == "loop" and kind in ("break", "continue"):
                self.link(at, frame[2] if kind == "break" else frame[1], kind)
                return
            if frame[0] == "catch" and kind == "exception":
                for handler in frame[1]:
                    self.link(at, handler, kind)
                return
        self.link(at, self.exit, kind)

    def within(self, frame: tuple, stmts, at: int) -> int | None:
        self.frames.append(frame)
        out = self.run(stmts, at)
        self.frames.pop()
        return out

    def run(self, stmts, at: int | None) -> int | None:
        """The block that control leaves the statements from; None if it never does."""
        for s in stmts:
            at = self.one(s, self.block("unreachable") if at is None else at)
        return at

    def branch(self, stmts, at: int, kind: str, label: str) -> int | None:
        return self.run(stmts, self.follow(at, label, kind))

    def meet(self, label: str, *ends: int | None) -> int | None:
        if all(e is None for e in ends):
            return None
        b = self.block(label)
        for e in ends:
            self.link(e, b, "normal")
        return b

    def one(self, s: ast.stmt, at: int) -> int | None:
        if isinstance(s, (ast.Return, ast.Assign, ast.AnnAssign, ast.AugAssign, ast.Expr)) and isinstance(s.value, COMPREHENSIONS):
            at = self.comprehension(s.value, at)
        if isinstance(s, (ast.While, ast.For, ast.AsyncFor)):
            return self.loop(s, at)
        if isinstance(s, (ast.Try, ast.TryStar)):
            return self.attempt(s, at)
        if isinstance(s, (ast.With, ast.AsyncWith)):
            setup = self.follow(at, "with_setup")
            self.held[setup].append(s)
            done = self.follow(setup, "with_teardown", "exception")  # a manager may swallow an exception
            self.link(self.branch(s.body, setup, "normal", "with_body"), done, "normal")
            return self.follow(done, "with_exit")
        self.held[at].append(s)
        if isinstance(s, ast.If):
            yes = self.branch(s.body, at, "cond_true", "then")
            if s.orelse:
                return self.meet("merge", yes, self.branch(s.orelse, at, "cond_false", "else"))
            after = self.follow(at, "merge", "cond_false")
            self.link(yes, after, "normal")
            return after
        if isinstance(s, ast.Match):
            after = self.block("match_merge")
            for case in s.cases:
                b = self.follow(at, "case", "cond_true")
                self.held[b].append(case)
                self.link(self.run(case.body, b), after, "normal")
            self.link(at, after, "cond_false")
            return after
        if type(s) in LEAVES:
            kind = LEAVES[type(s)]
            self.leave("exception" if kind == "raise" else kind, at, self.frames)
            return None
        return at

    def loop(self, s, at: int) -> int:
        head, after = self.follow(at, "loop_header"), self.block("loop_exit")
        self.held[head].append(s)
        self.link(self.within(("loop", head, after), s.body, self.follow(head, "loop_body", "cond_true")), head, "loop")
        if s.orelse:
            self.link(self.branch(s.orelse, head, "cond_false", "loop_else"), after, "normal")
        else:
            self.link(head, after, "cond_false")
        return after

    def attempt(self, s, at: int) -> int | None:
        start = self.follow(at, "try")
        handlers = [self.block("except") for _ in s.handlers]
        final = ("finally", self.block("finally"), set()) if s.finalbody else None
        if final:
            self.frames.append(final)
        if handlers:
            for h in handlers:
                self.link(start, h, "exception")
            ends = [self.within(("catch", handlers), s.body, start)]
        else:
            self.leave("exception", start, self.frames)
            ends = [self.run(s.body, start)]
        if s.orelse and ends[0] is not None:
            ends = [self.branch(s.orelse, ends[0], "normal", "try_else")]
        for h, b in zip(s.handlers, handlers):
            self.held[b].append(h)
            ends.append(self.run(h.body, b))
        if not final:
            return self.meet("merge", *ends)
        self.frames.pop()
        for e in ends:
            self.link(e, final[1], "normal")
        done = self.run(s.finalbody, final[1])
        for kind in sorted(final[2]):
            self.leave(kind, done, self.frames)
        return self.follow(done, "merge") if done is not None and any(e is not None for e in ends) else None

    def comprehension(self, node, at: int) -> int:
        now = self.follow(at, "comp_init")
        for g in node.generators:
            head = self.follow(now, "comp_header")
            body = self.follow(head, "comp_body", "cond_true")
            for _ in g.ifs:
                test = self.follow(body, "comp_filter")
                self.link(test, head, "cond_false")
                body = self.follow(test, "comp_keep", "cond_true")
            self.link(self.follow(body, "comp_append"), head, "loop")
            now = head
        return self.follow(now, "comp_exit", "cond_false")

    def reachable(self) -> set[int]:
        out: dict[int, list[int]] = {}
        for a, b, _ in self.edges:
            out.setdefault(a, []).append(b)
        seen, todo = {self.entry}, [self.entry]
        while todo:
            for b in out.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen


def head_end(s: ast.AST) -> int:
    """The last line of what a statement evaluates itself: of compound ones the header."""
    if isinstance(s, (ast.If, ast.While)):
        return s.test.end_lineno
    if isinstance(s, (ast.For, ast.AsyncFor)):
        return s.iter.end_lineno
    if isinstance(s, (ast.With, ast.AsyncWith)):
        return s.items[-1].context_expr.end_lineno
    if isinstance(s, ast.Match):
        return s.subject.end_lineno
    if isinstance(s, ast.match_case):
        return (s.guard or s.pattern).end_lineno
    if isinstance(s, ast.ExceptHandler):
        return s.type.end_lineno if s.type else s.lineno
    return s.end_lineno


def head_start(s: ast.AST) -> int:
    return s.pattern.lineno if isinstance(s, ast.match_case) else s.lineno


def blocks(flow: Flow):
    """(block, label, is_entry, is_exit, start_line, end_line, n_stmts, is_noop, ends_by, reachable)."""
    seen = flow.reachable()
    for i, label in enumerate(flow.labels):
        held = flow.held[i]
        ends = next((LEAVES[type(s)] for s in reversed(held) if type(s) in LEAVES), None)
        yield (
            i, label, i == flow.entry, i == flow.exit, min(map(head_start, held), default=None), max(map(head_end, held), default=None), len(held),
            bool(held) and all(isinstance(s, ast.Pass) for s in held), ends, i in seen,
        )


# -- definitions and uses -----------------------------------------------------------------------------------------


def _targets(node: ast.AST):
    """Names that an assignment target binds."""
    if isinstance(node, ast.Name):
        yield node.id
    elif isinstance(node, (ast.Tuple, ast.List)):
        for x in node.elts:
            yield from _targets(x)
    elif isinstance(node, ast.Starred):
        yield from _targets(node.value)


def _patterns(node: ast.AST):
    for x in ast.walk(node):
        name = getattr(x, "name", None) if isinstance(x, (ast.MatchAs, ast.MatchStar)) else getattr(x, "rest", None) if isinstance(x, ast.MatchMapping) else None
        if name:
            yield name


def _loads(*parts: ast.AST | None):
    """(name, kind) of each name read, and (name, None) of each that := binds, without nested functions' bodies."""
    todo = [(p, "load") for p in reversed(parts) if p is not None]
    while todo:
        node, kind = todo.pop()
        if isinstance(node, ast.Name):
            if isinstance(node.ctx, ast.Load):
                yield node.id, kind
        elif isinstance(node, ast.NamedExpr):
            yield node.target.id, None
            todo.append((node.value, "load"))
        elif isinstance(node, ast.Call):
            todo += [(k.value, "load") for k in reversed(node.keywords)] + [(a, "load") for a in reversed(node.args)] + [(node.func, "call")]
        elif isinstance(node, ast.Attribute):
            todo.append((node.value, "attribute"))
        elif isinstance(node, ast.Subscript):
            todo += [(node.slice, "load"), (node.value, "subscript")]
        elif not isinstance(node, ast.Lambda):
            todo += [(c, "load") for c in reversed(list(ast.iter_child_nodes(node)))]


def _of(s: ast.AST):
    """(definitions with kinds, parts that are read) of a statement's own line."""
    if isinstance(s, ast.Assign):
        return [(n, "assign") for t in s.targets for n in _targets(t)], [s.value, *(t for t in s.targets if not isinstance(t, (ast.Name, ast.Tuple, ast.List)))]
    if isinstance(s, ast.AnnAssign):
        return [(n, "assign") for n in _targets(s.target) if s.value], [s.value]
    if isinstance(s, ast.AugAssign):
        return [(n, "augassign") for n in _targets(s.target)], [ast.Name(s.target.id, ast.Load()) if isinstance(s.target, ast.Name) else s.target, s.value]
    if isinstance(s, (ast.For, ast.AsyncFor)):
        return [(n, "for") for n in _targets(s.target)], [s.iter]
    if isinstance(s, (ast.If, ast.While)):
        return [], [s.test]
    if isinstance(s, (ast.With, ast.AsyncWith)):
        return [(n, "with") for i in s.items if i.optional_vars for n in _targets(i.optional_vars)], [i.context_expr for i in s.items]
    if isinstance(s, ast.ExceptHandler):
        return [(s.name, "except")] if s.name else [], [s.type]
    if isinstance(s, ast.Match):
        return [], [s.subject]
    if isinstance(s, ast.match_case):
        return [(n, "pattern") for n in _patterns(s.pattern)], [*(x.value if isinstance(x, ast.MatchValue) else x.cls for x in ast.walk(s.pattern) if isinstance(x, (ast.MatchValue, ast.MatchClass))), s.guard]
    if isinstance(s, (ast.Import, ast.ImportFrom)):
        return [((a.asname or a.name.split(".")[0]), "import") for a in s.names if a.name != "*"], []
    if isinstance(s, SCOPES):
        defaults = [] if isinstance(s, ast.ClassDef) else [*s.args.defaults, *(d for d in s.args.kw_defaults if d)]
        return [(s.name, "assign")], [*s.decorator_list, *defaults, *getattr(s, "bases", [])]
    if isinstance(s, (ast.Try, ast.TryStar)):
        return [], []
    return [], list(ast.iter_child_nodes(s))


def references(fn: ast.AST, flow: Flow):
    """(block, position, line, name, kind, is_def) of each definition and use, in order within its block."""
    out = []
    if isinstance(fn, (ast.FunctionDef, ast.AsyncFunctionDef)):
        a = fn.args
        for k, p in enumerate([*a.posonlyargs, *a.args, *filter(None, [a.vararg]), *a.kwonlyargs, *filter(None, [a.kwarg])]):
            out.append((flow.entry, k, p.lineno, p.arg, "param", True))
    for b, held in enumerate(flow.held):
        k = len(out)
        for s in held:
            defs, parts = _of(s)
            line = head_start(s)
            for name, kind in _loads(*parts):
                out.append((b, k, line, name, kind or "assign", kind is None))
                k += 1
            for name, kind in defs:
                out.append((b, k, line, name, kind, True))
                k += 1
    return out


def def_use(refs, flow: Flow):
    """(name, def_block, def_line, def_kind, use_block, use_line, use_kind, cross_block): definitions that reach uses."""
    by_block: dict[int, list] = {}
    for i, r in enumerate(refs):
        by_block.setdefault(r[0], []).append(i)
    ahead: dict[int, list[int]] = {}
    for a, b, _ in flow.edges:
        ahead.setdefault(a, []).append(b)
    into: list[dict[str, frozenset]] = [{} for _ in flow.labels]
    todo, found = sorted(set(range(len(flow.labels)))), set()
    while todo:
        b = todo.pop(0)
        now = dict(into[b])
        for i in by_block.get(b, ()):
            _, _, _, name, _, is_def = refs[i]
            if is_def:
                now[name] = frozenset([i])
            else:
                found |= {(d, i) for d in now.get(name, ())}
        for c in ahead.get(b, ()):
            merged = {n: into[c].get(n, frozenset()) | d for n, d in now.items()}
            if any(merged[n] != into[c].get(n) for n in merged):
                into[c] |= merged
                if c not in todo:
                    todo.append(c)
    for d, u in sorted(found):
        x, y = refs[d], refs[u]
        yield x[3], x[0], x[2], x[4], y[0], y[2], y[4], x[0] != y[0]

"""Early errors of ECMAScript: what a file of the right form must not do. They are judged on one derivation of the file,
taken from the recogniser's stack top down, so that what a word means can depend on the functions around it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from quarrymint.llm.grammar.gll import CALL, MATCH, RETURN, Grammar

_FUTURE = {"implements", "interface", "package", "private", "protected", "public", "let", "static", "yield"}
_OCTAL = re.compile(r"(?<!\\)(?:\\\\)*\\(?:[1-9]|0\d)")
_WORDLIKE = ("NAME", "as", "async", "await", "from", "get", "let", "of", "set", "static", "yield")


class EarlyError(Exception):
    pass


def demand(ok) -> None:
    if not ok:
        raise EarlyError


@dataclass
class Scope:
    parent: Scope | None
    function: bool
    lexical: set = field(default_factory=set)
    variables: set = field(default_factory=set)
    functions: set = field(default_factory=set)
    loose: set = field(default_factory=set)  # a plain catch parameter, which a variable may repeat

    def add_lexical(self, name: str) -> None:
        demand(name not in self.lexical and name not in self.variables)
        self.lexical.add(name)

    def add_function(self, name: str, strict: bool, plain: bool) -> None:
        """A function declared in a block; in sloppy code plain ones may be repeated."""
        if plain and not strict and name in self.functions:
            return
        self.add_lexical(name)
        if plain:
            self.functions.add(name)

    def add_variable(self, name: str) -> None:
        at: Scope | None = self
        while at is not None:
            demand(name not in at.lexical or name in at.loose)
            at.variables.add(name)
            at = None if at.function else at.parent


@dataclass(frozen=True)
class Context:
    scope: Scope
    module: bool = False
    strict: bool = False
    function: bool = False
    generator: bool = False
    awaits: bool = False  # await is an operator
    reserved: bool = False  # await is no name
    loop: bool = False
    switch: bool = False
    labels: frozenset = frozenset()
    loops: frozenset = frozenset()
    pending: frozenset = frozenset()  # labels that stand right before the statement
    member: bool = False  # super.x is allowed
    derived: bool = False  # super() is allowed
    target: bool = False  # new.target is allowed
    private: frozenset = frozenset()


class EarlyErrors:
    def __init__(self, grammar: Grammar, tokens: list[int], info, nodes: dict):
        self.g, self.toks, self.info, self.nodes = grammar, tokens, info, nodes
        self.text = info.texts
        self.kind = grammar.kind_names
        self.rule = {r: i for i, r in enumerate(grammar.rule_names)}
        k = grammar.kinds
        self.light = {self.rule[r] for r in ("expression", "assign", "conditional", "simple", "left")}
        self.assign, self.conditional = self.rule["assign"], self.rule["conditional"]
        self.words = {k[w] for w in _WORDLIKE}
        self.starts = self.words | {k[w] for w in ("this", "null", "LITERAL", "NUMBER", "STRING", "REGEX", "TEMPLATE", "THEAD", "(", "[", "{", "function", "class", "new", "super", "import", "+", "-", "!", "~", "delete", "void", "typeof", "++", "--")}
        self.either = {k[w] for w in ("(", "[", "+", "-", "++", "--", "TEMPLATE", "THEAD", "of")}

    def valid(self, start: str) -> bool:
        module = start == "module"
        ctx = Context(Scope(None, True), module=module, strict=module, awaits=module, reserved=module)
        try:
            demand(not (module and self.info.html))
            steps = self.steps(self.rule[start], 0, len(self.toks))
            if module:
                self.module(steps, ctx)
            else:
                self.calls(steps, replace(ctx, strict=self.directive(0)))
        except EarlyError:
            return False
        return True

    # --- one derivation

    def steps(self, rule: int, i: int, j: int) -> list[tuple]:
        """(None, place, place + 1) of the tokens and (rule, from, to) of the rules called."""
        g, toks = self.g, self.toks
        state, pos, path = g.start_of[rule], i, []
        while pos < j or not g.final[state]:  # as long as there is one way to go
            ways = g.table[state].get(toks[pos] if pos < len(toks) else -1, ())
            ways = [w for w in ways if w[0] != RETURN]
            if len(ways) != 1:
                break
            kind, then, x = ways[0][:3]
            if kind == MATCH:
                path.append((None, pos, pos + 1))
                pos += 1
            elif kind == CALL:
                node = self.nodes.get((x, pos))
                if node is None or len(node[1]) != 1 or node[1][0] > j:
                    break
                path.append((x, pos, node[1][0]))
                pos = node[1][0]
            elif not g.predicates[x][1](toks, pos, self.info):
                break
            state = then
            if pos > j:
                break
        if pos == j and g.final[state]:
            return path
        return self.search(rule, i, j)

    def search(self, rule: int, i: int, j: int) -> list[tuple]:
        g, toks = self.g, self.toks

        def options(state: int, pos: int):
            later = []
            for (kind, x), t in g.edges[state].items():
                if kind == MATCH:
                    if pos < j and toks[pos] == x:
                        yield (None, pos, pos + 1), (t, pos + 1)
                elif kind == CALL:
                    node = self.nodes.get((x, pos))
                    if node is not None:
                        later.extend(((x, pos, e), (t, e)) for e in sorted(node[1], reverse=True) if e <= j)
                elif g.predicates[x][1](toks, pos, self.info):
                    later.append((None, (t, pos)))
            yield from later

        start = (g.start_of[rule], i)
        if i == j and g.final[start[0]]:
            return []
        todo, path, seen = [options(*start)], [], {start}
        while todo:
            found = next(todo[-1], None)
            if found is None:
                todo.pop()
                if path:
                    path.pop()
                continue
            step, state = found
            if state in seen:
                continue
            seen.add(state)
            path.append(step)
            if state[1] == j and g.final[state[0]]:
                return [s for s in path if s]
            todo.append(options(*state))
        raise EarlyError

    def calls(self, steps: list[tuple], ctx: Context) -> None:
        for r, i, j in steps:
            if r is None:
                self.token(i, ctx)
            else:
                self.walk(r, i, j, ctx)

    def walk(self, r: int, i: int, j: int, ctx: Context) -> None:
        if j == i + 1 and r in self.light and self.k(i) != "yield":
            self.token(i, ctx)
            return
        if r == self.assign and self.k(i) != "yield":
            node = self.nodes.get((self.conditional, i))
            if node is not None and j in node[1]:  # what assigns nothing
                r = self.conditional
        steps = self.steps(r, i, j)
        name = self.g.rule_names[r]
        special = getattr(self, f"on_{name}", None)
        if special:
            special(steps, ctx)
        else:
            self.calls(steps, ctx)

    def k(self, pos: int) -> str:
        return self.kind[self.toks[pos]]

    def is_word(self, pos: int) -> bool:
        return self.toks[pos] in self.words

    def named(self, step: tuple) -> str | None:
        return None if step[0] is None else self.g.rule_names[step[0]]

    # --- words and literals

    def token(self, pos: int, ctx: Context) -> None:
        """A token of an expression."""
        kind, s = self.k(pos), self.text[pos]
        if pos and self.k(pos - 1) in (".", "OPTIONAL"):
            demand(kind != "PRIVATE" or s in ctx.private)
            return
        after = self.toks[pos + 1] if pos + 1 < len(self.toks) else 0
        if kind == "await":
            if ctx.awaits:
                demand(after in self.starts)
            else:
                demand(not ctx.reserved and (after not in self.starts or after in self.either or self.info.breaks[pos + 1]))
        elif kind == "yield":
            demand(not ctx.generator and not ctx.strict and (after not in self.starts or after in self.either or self.info.breaks[pos + 1]))
        elif kind == "NAME" or kind in ("let", "static"):
            demand(not (ctx.strict and s in _FUTURE))
            if ctx.strict and s in ("eval", "arguments"):
                demand(self.kind[after] not in ("=", "ASSIGN", "++", "--"))
        elif kind == "super":
            demand(ctx.derived if self.kind[after] == "(" else ctx.member)
        elif kind == "import" and self.kind[after] == ".":
            demand(ctx.module and self.text[pos + 2] == "meta")
        elif kind == "PRIVATE":
            demand(s in ctx.private)
        elif kind == "delete":
            after2 = self.k(pos + 2) if pos + 2 < len(self.toks) else "EOF"
            demand(not (ctx.strict and after in self.words and after2 not in (".", "[", "(", "OPTIONAL", "TEMPLATE", "THEAD", "=>")))
        elif ctx.strict and kind == "NUMBER":
            demand(not re.match(r"0\d", s))
        elif ctx.strict and kind == "STRING":
            demand(not _OCTAL.search(s))

    def bound(self, pos: int, ctx: Context) -> str:
        """A name that is declared."""
        s = self.text[pos]
        demand(not (s == "await" and ctx.reserved) and not (s == "yield" and (ctx.generator or ctx.strict)))
        demand(not (ctx.strict and (s in _FUTURE or s in ("eval", "arguments"))))
        return s

    def names(self, steps: list[tuple], ctx: Context) -> list[str]:
        """The names that a binding or pattern declares; what it computes is walked."""
        out = []
        for n, (r, i, j) in enumerate(steps):
            called = self.named((r, i, j))
            if called in ("bpattern", "belem", "bprop"):
                out += self.names(self.steps(r, i, j), ctx)
            elif r is not None:
                self.walk(r, i, j, ctx)
            elif self.is_word(i):
                after = steps[n + 1] if n + 1 < len(steps) else None
                if not (after and after[0] is None and self.k(after[1]) == ":"):
                    out.append(self.bound(i, ctx))
        return out

    def directive(self, at: int) -> bool:
        """Whether ``use strict`` stands among the strings that begin a body."""
        while self.k(at) == "STRING":
            ends = self.k(at + 1) in (";", "}", "EOF")
            if not ends and not (self.info.breaks[at + 1] and self.k(at + 1) in ("STRING", "NAME", "let", "const", "var", "function", "class", "if", "for", "return", "this", "new")):
                return False
            if self.text[at][1:-1] == "use strict":
                return True
            at += 2 if self.k(at + 1) == ";" else 1
        return False

    # --- functions

    def function(self, params: list[str] | None, simple: bool, body: tuple | None, at: int, ctx: Context, unique: bool, header: list[tuple] = ()) -> None:
        """Parameters (``header`` holds their steps) and body in a context of their own."""
        strict = ctx.strict
        if body is not None and self.directive(body[1]):
            demand(simple)
            strict = True
        scope = Scope(ctx.scope, True)
        inner = replace(ctx, scope=scope, strict=strict, function=True, loop=False, switch=False, labels=frozenset(), loops=frozenset(), pending=frozenset())
        names = params if params is not None else self.names(header, inner)
        demand(len(set(names)) == len(names) or not (unique or strict or not simple))
        scope.variables |= set(names)
        if body is not None:
            self.calls(self.steps(*body), inner)
            demand(not (scope.lexical & set(names)))

    def parameters(self, step: tuple) -> tuple[list[tuple], bool]:
        steps = self.steps(*step)
        simple = all((r is None and self.k(i) == ",") or (r is not None and j == i + 1) for r, i, j in steps)
        return steps, simple

    def on_function(self, steps: list[tuple], ctx: Context, declared: bool = False) -> None:
        is_async, star, name, header, body = self.k(steps[0][1]) == "async", False, None, None, None
        for s in steps:
            called = self.named(s)
            if called == "params":
                header = s
            elif called == "body":
                body = s
            elif header is None and self.k(s[1]) == "*":
                star = True
            elif header is None and self.is_word(s[1]) and not (is_async and s[1] == steps[0][1]):
                name = s[1]
        inner = replace(ctx, generator=star, awaits=is_async, reserved=is_async or ctx.module, member=False, derived=False, target=True)
        if name is not None and not declared:
            self.bound(name, inner)
        params, simple = self.parameters(header)
        self.function(None, simple, body, steps[-1][1], inner, False, params)

    def on_arrow(self, steps: list[tuple], ctx: Context) -> None:
        is_async = self.k(steps[0][1]) == "async" and self.named(steps[1]) is None and self.k(steps[1][1]) != "=>"
        inner = replace(ctx, generator=False, awaits=is_async, reserved=is_async or ctx.reserved)
        header = next((s for s in steps if self.named(s) == "params"), None)
        body = next((s for s in steps if self.named(s) == "body"), None)
        if header is not None:
            params, simple = self.parameters(header)
        else:
            params, simple = [next(s for s in reversed(steps) if s[0] is None and self.is_word(s[1]))], True
        self.function(None, simple, body, steps[-1][1], inner, True, params)
        if body is None:
            last = steps[-1]
            self.walk(*last, replace(inner, function=ctx.function, generator=False))

    def on_method(self, steps: list[tuple], ctx: Context, derived: bool = False) -> None:
        is_async = star = False
        header = body = None
        for n, s in enumerate(steps):
            called = self.named(s)
            if called in ("params", "belem"):
                header = s
            elif called == "body":
                body = s
            elif called is not None:
                self.walk(*s, ctx)
            elif header is None and n == 0 and self.k(s[1]) == "async" and (self.named(steps[1]) or self.k(steps[1][1]) != "("):
                is_async = True
            elif header is None and self.k(s[1]) == "*":
                star = True
        inner = replace(ctx, generator=star, awaits=is_async, reserved=is_async or ctx.module, member=True, derived=derived, target=True)
        if header is None:
            params, simple = [], True
        elif self.named(header) == "belem":
            params, simple = [header], header[2] == header[1] + 1
        else:
            params, simple = self.parameters(header)
        self.function(None, simple, body, steps[-1][1], inner, True, params)

    # --- classes and objects

    def on_class(self, steps: list[tuple], ctx: Context, declared: bool = False) -> None:
        inner = replace(ctx, strict=True)
        members = [self.steps(*s) for s in steps if self.named(s) == "member"]
        private: dict[str, set] = {}
        for m in members:
            flat = [s for x in m for s in (self.steps(*x) if self.named(x) == "method" else [x])]
            for s in flat:
                if s[0] is None and self.k(s[1]) == "PRIVATE":
                    what = self.k(flat[flat.index(s) - 1][1]) if flat.index(s) else ""
                    what = (what if what in ("get", "set") else "one") + ("s" if m[0][0] is None and self.k(m[0][1]) == "static" else "")
                    have = private.setdefault(self.text[s[1]], set())
                    demand(not have or (have | {what} in ({"get", "set"}, {"gets", "sets"}) and what not in have))
                    demand(self.text[s[1]] != "#constructor")
                    have.add(what)
                    break
        extends, constructors = False, 0
        body = replace(inner, private=ctx.private | frozenset(private), member=True, target=True)
        for s in steps:
            called = self.named(s)
            if called == "left":
                extends = True
                self.walk(*s, replace(inner, private=body.private))
            elif called is None and self.is_word(s[1]) and not declared:
                self.bound(s[1], inner)
        for m in members:
            static = len(m) > 1 and m[0][0] is None and self.k(m[0][1]) == "static"
            rest = m[1:] if static else m
            field = replace(body, scope=Scope(ctx.scope, True), function=False, generator=False, awaits=False, reserved=True, loop=False, switch=False, labels=frozenset(), derived=False)
            if self.named(rest[0]) == "method":
                part = self.steps(*rest[0])
                key = self.key_of(part)
                plain = part[0][0] is None and key == part[0][1]
                text = None if key is None else self.text[key].strip("'\"")
                if not static and text == "constructor":
                    demand(plain)
                    constructors += 1
                demand(not (static and text == "prototype"))
                self.on_method(part, body, derived=extends and not static and text == "constructor")
            elif rest[0][0] is None and self.k(rest[0][1]) == "{":
                self.calls(rest[1:-1], field)
            else:
                text = self.text[rest[0][1]].strip("'\"") if rest[0][0] is None else ""
                demand(text != "constructor" and not (static and text == "prototype"))
                for s in rest:
                    if s[0] is not None:
                        self.walk(*s, field)
        demand(constructors < 2)

    def key_of(self, steps: list[tuple]) -> int | None:
        """The token that names a method; None where the name is computed."""
        for n, s in enumerate(steps):
            if s[0] is None and self.k(s[1]) == "(":
                before = steps[n - 1]
                return before[1] if before[0] is None and self.k(before[1]) != "]" else None
        return None

    def on_object(self, steps: list[tuple], ctx: Context) -> None:
        protos = 0
        for s in steps:
            if self.named(s) == "entry":
                part = self.steps(*s)
                if part[0][0] is None and len(part) > 2 and part[1][0] is None and self.k(part[1][1]) == ":":
                    protos += self.text[part[0][1]].strip("'\"") == "__proto__"
                    self.calls(part[2:], ctx)
                else:
                    self.calls(part, ctx)
        demand(protos < 2)

    def on_aprop(self, steps: list[tuple], ctx: Context) -> None:
        keyed = len(steps) > 1 and steps[0][0] is None and steps[1][0] is None and self.k(steps[1][1]) == ":"
        self.calls(steps[2:] if keyed else steps, ctx)

    def on_new(self, steps: list[tuple], ctx: Context) -> None:
        if len(steps) == 3 and steps[1][0] is None and self.k(steps[1][1]) == ".":
            demand(ctx.target and self.text[steps[2][1]] == "target")
        else:
            self.calls(steps[1:], ctx)

    def on_assign(self, steps: list[tuple], ctx: Context) -> None:
        if steps[0][0] is None and self.k(steps[0][1]) == "yield" and ctx.generator:
            steps = steps[1:]
        self.calls(steps, ctx)

    # --- declarations

    def declare(self, kind: str, steps: list[tuple], ctx: Context, needs_value: bool = True) -> list[str]:
        """The bindings of a var, let or const list."""
        out = []
        for s in steps:
            if self.named(s) == "binding":
                part = self.steps(*s)
                demand(not (needs_value and kind == "const" and not any(x[0] is None and self.k(x[1]) == "=" for x in part)))
                out += self.names(part, ctx)
        self.enter(kind, out, ctx)
        return out

    def enter(self, kind: str, names: list[str], ctx: Context) -> None:
        for name in names:
            if kind == "var":
                ctx.scope.add_variable(name)
            else:
                demand(name != "let")
                ctx.scope.add_lexical(name)

    def on_lexical(self, steps: list[tuple], ctx: Context) -> None:
        self.declare(self.k(steps[0][1]), steps[1:], ctx)

    def on_variables(self, steps: list[tuple], ctx: Context) -> None:
        self.declare(self.k(steps[0][1]), steps[1:], ctx)

    def declared(self, step: tuple, ctx: Context, needs_name: bool = True) -> str | None:
        """A function or class that stands as a declaration."""
        steps = self.steps(*step)
        is_class = self.named(step) == "class"
        is_async = self.k(steps[0][1]) == "async"
        name = next((s[1] for s in steps[1:] if s[0] is None and self.is_word(s[1]) and not (is_async and s[1] == steps[0][1])), None)
        head = next((s[1] for s in steps if s[0] is None and self.k(s[1]) in ("(", "{") or self.named(s) == "left"), None)
        name = name if name is not None and (head is None or name < head) else None
        demand(name is not None or not needs_name)
        text = self.bound(name, replace(ctx, strict=True) if is_class else ctx) if name is not None else None
        if text is not None:
            plain = not is_class and not is_async and self.k(steps[1][1]) != "*"
            if is_class or (ctx.module and ctx.scope.parent is None):
                ctx.scope.add_lexical(text)
            elif ctx.scope.function:
                demand(text not in ctx.scope.lexical)
                ctx.scope.variables.add(text)
            else:
                ctx.scope.add_function(text, ctx.strict, plain)
        (self.on_class if is_class else self.on_function)(steps, ctx, declared=True)
        return text

    def on_item(self, steps: list[tuple], ctx: Context) -> None:
        for s in steps:
            if self.named(s) in ("function", "class"):
                self.declared(s, ctx)
            else:
                self.calls([s], ctx)

    def on_sub(self, steps: list[tuple], ctx: Context) -> None:
        if self.named(steps[0]) == "function":
            own = self.steps(*steps[0])
            demand(not ctx.strict and self.k(own[0][1]) == "function" and self.k(own[1][1]) != "*")
            self.declared(steps[0], replace(ctx, scope=Scope(ctx.scope, False)))
        else:
            self.calls(steps, ctx)

    # --- statements

    def on_block(self, steps: list[tuple], ctx: Context) -> None:
        self.calls(steps, replace(ctx, scope=Scope(ctx.scope, False), pending=frozenset()))

    def on_statement(self, steps: list[tuple], ctx: Context) -> None:
        first = steps[0]
        if first[0] is None and self.k(first[1]) == "var":
            self.declare("var", steps[1:], ctx)
            return
        demand(not (first[0] is None and self.k(first[1]) == "with" and ctx.strict))
        if self.named(first) not in ("labelled", "loop"):
            ctx = replace(ctx, pending=frozenset())
        for s in steps:
            if s[0] is not None:
                self.walk(*s, ctx)

    def on_if(self, steps: list[tuple], ctx: Context) -> None:
        self.calls([s for s in steps if s[0] is not None], replace(ctx, pending=frozenset()))

    def on_labelled(self, steps: list[tuple], ctx: Context) -> None:
        name = self.bound(steps[0][1], replace(ctx, strict=False)) if not ctx.strict else self.text[steps[0][1]]
        demand(name not in ctx.labels and not (ctx.strict and name in _FUTURE) and not (name == "await" and ctx.reserved))
        self.calls(steps[2:], replace(ctx, labels=ctx.labels | {name}, pending=ctx.pending | {name}))

    def on_jump(self, steps: list[tuple], ctx: Context) -> None:
        kind = self.k(steps[0][1])
        if kind == "return":
            demand(ctx.function)
            self.calls(steps[1:], ctx)
        elif len(steps) > 1:
            demand(self.text[steps[1][1]] in (ctx.labels if kind == "break" else ctx.loops))
        else:
            demand(ctx.loop or (kind == "break" and ctx.switch))

    def on_loop(self, steps: list[tuple], ctx: Context) -> None:
        inner = replace(ctx, loop=True, loops=ctx.loops | ctx.pending, pending=frozenset(), scope=Scope(ctx.scope, False))
        head = replace(inner, loop=ctx.loop)
        kinds = [self.k(s[1]) if s[0] is None else "" for s in steps]
        demand("await" not in kinds[:2] or ctx.awaits)
        declares = next((x for x in kinds if x in ("var", "let", "const")), None)
        for n, s in enumerate(steps):
            called = self.named(s)
            if called == "statement":
                self.walk(*s, inner)
            elif called == "bpattern":
                self.enter(declares, self.names(self.steps(*s), head), head)
            elif called is not None:
                self.walk(*s, head)
            elif declares and self.is_word(s[1]) and kinds[n - 1] == declares:
                self.enter(declares, [self.bound(s[1], head)], head)
            elif not declares and kinds[0] == "for" and kinds[n] not in ("await", "of"):
                self.token(s[1], head)
        if "var" in kinds and "=" in kinds:
            demand(not ctx.strict)

    def on_switch(self, steps: list[tuple], ctx: Context) -> None:
        inner = replace(ctx, switch=True, pending=frozenset(), scope=Scope(ctx.scope, False))
        for s in steps:
            if s[0] is not None:
                self.walk(*s, inner if self.named(s) == "cases" else ctx)

    def on_cases(self, steps: list[tuple], ctx: Context) -> None:
        self.calls([s for s in steps if s[0] is not None], ctx)

    def on_try(self, steps: list[tuple], ctx: Context) -> None:
        self.calls([s for s in steps if s[0] is not None], ctx)

    def on_catch(self, steps: list[tuple], ctx: Context) -> None:
        scope = Scope(ctx.scope, False)
        inner = replace(ctx, scope=scope)
        body = steps[-2]
        names = self.names([s for s in steps[1:-3] if s[0] is not None or self.is_word(s[1])], inner)
        demand(len(set(names)) == len(names))
        scope.lexical |= set(names)
        if len(steps) > 4 and steps[2][0] is None:
            scope.loose |= set(names)
        self.calls(self.steps(*body), inner)

    # --- modules

    def module(self, steps: list[tuple], ctx: Context) -> None:
        exported: list[str] = []
        used: list[str] = []
        for s in steps:
            called = self.named(s)
            if called == "importdecl":
                for name in self.imported(self.steps(*s), ctx):
                    demand(name not in ctx.scope.lexical)
                    ctx.scope.add_lexical(name)
            elif called == "exportdecl":
                self.exported(self.steps(*s), ctx, exported, used)
            elif called is not None:
                self.walk(*s, ctx)
        demand(len(set(exported)) == len(exported))
        demand(set(used) <= ctx.scope.lexical | ctx.scope.variables)

    def imported(self, steps: list[tuple], ctx: Context) -> list[str]:
        out = []
        for n, s in enumerate(steps[1:], 1):
            if s[0] is not None:
                continue
            kind, after = self.k(s[1]), self.k(s[1] + 1)
            if kind == "STRING" and after not in ("as",):
                break
            is_from = kind == "from" and after == "STRING" and self.k(s[1] - 1) in ("}", "NAME", *_WORDLIKE)
            if is_from:
                break
            if (self.is_word(s[1])) and after in (",", "}", "from") and not (kind == "as" and after in ("from",) and self.k(s[1] - 1) == "*"):
                out.append(self.bound(s[1], ctx))
        return out

    def exported(self, steps: list[tuple], ctx: Context, exported: list[str], used: list[str]) -> None:
        second = self.k(steps[1][1]) if steps[1][0] is None else ""
        if second == "*":
            if self.k(steps[2][1]) == "as":
                exported.append(self.text[steps[3][1]].strip("'\""))
        elif second == "{":
            elsewhere = any(s[0] is None and self.k(s[1]) == "from" for s in steps)
            for s in steps:
                if self.named(s) == "espec":
                    part = self.steps(*s)
                    exported.append(self.text[part[-1][1]].strip("'\""))
                    if not elsewhere:
                        demand(self.is_word(part[0][1]))
                        used.append(self.text[part[0][1]])
        elif second == "default":
            exported.append("default")
            inner = steps[2]
            if self.named(inner) in ("function", "class"):
                self.declared(inner, ctx, needs_name=False)
            else:
                self.calls(steps[2:], ctx)
        elif self.named(steps[1]) in ("function", "class"):
            exported.append(self.declared(steps[1], ctx))
        else:
            part = self.steps(*steps[1])
            exported.extend(self.declare(self.k(part[0][1]), part[1:], ctx))

"""Generalised LL recognition with a graph-structured stack.

A grammar is text: ``name = ... ;`` rules with 'literals', TOKENS, other rules, ``( ) | * + ?`` and ``@predicates``, which
consume nothing. Each rule becomes a deterministic automaton over grammar symbols; a state and the next token give the
viable actions (match, call, return, predicate). One viable action is taken at once. Several become descriptors, so that
all of them are followed. Calls of one rule at one place share a stack node, which keeps every caller and every place
where the rule ended; so ambiguity and left recursion cost polynomial time. Several start rules can run together.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Sequence

MATCH, CALL, RETURN, TEST, GO = range(5)
_DSL = re.compile(r"\s*(?:#[^\n]*|'((?:[^'])+)'|(@?[A-Za-z_]\w*)|([()|*+?=;]))")


def _merged(edges: list[dict], final: list[bool]) -> list[int]:
    """A class for each state, the same for states that no text tells apart."""
    part, n = [int(f) for f in final], 0
    while True:
        numbers: dict = {}
        part = [numbers.setdefault((part[i], frozenset((sym, part[t]) for sym, t in e.items())), len(numbers)) for i, e in enumerate(edges)]
        if len(numbers) == n:
            return part
        n = len(numbers)


class Grammar:
    def __init__(self, text: str, starts: Sequence[str], predicates: dict[str, Callable] | None = None):
        self.predicates = list((predicates or {}).items())
        self.kinds: dict[str, int] = {}
        rules = self._parse(text)
        self._number(rules)
        self._tables(starts)
        self.kind_names = {i: k for k, i in self.kinds.items()}

    # --- reading the rules

    def _parse(self, text: str) -> dict[str, tuple]:
        toks, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _DSL.match(text, at)
            if not m:
                raise ValueError(f"grammar text at {text[at : at + 30]!r}")
            at = m.end()
            if m.group(1):
                toks.append(("lit", m.group(1)))
            elif m.group(2):
                toks.append(("name", m.group(2)))
            elif m.group(3):
                toks.append((m.group(3), ""))
        rules: dict[str, tuple] = {}
        i = 0

        def alternatives(i: int) -> tuple[tuple, int]:
            options, i = [], i
            while True:
                seq = []
                while toks[i][0] not in ("|", ")", ";"):
                    kind, value = toks[i]
                    if kind == "(":
                        item, i = alternatives(i + 1)
                    elif kind in ("lit", "name"):
                        item = ("sym", value if kind == "name" else f"'{value}'")
                    i += 1
                    while toks[i][0] in ("*", "+", "?"):
                        item = (toks[i][0], item)
                        i += 1
                    seq.append(item)
                options.append(("seq", seq))
                if toks[i][0] != "|":
                    return ("alt", options), i
                i += 1

        while i < len(toks):
            name = toks[i][1]
            body, i = alternatives(i + 2)
            rules[name] = body
            i += 1
        return rules

    # --- automata

    def _number(self, rules: dict[str, tuple]) -> None:
        self.rule_names = list(rules)
        rule_id = {r: i for i, r in enumerate(self.rule_names)}
        pred_id = {f"@{p}": i for i, (p, _) in enumerate(self.predicates)}
        self.kinds["EOF"] = 0
        self.edges: list[dict] = []  # by state: symbol -> state
        self.final: list[bool] = []
        self.start_of: list[int] = []
        self.rule_of: list[int] = []

        def symbol(s: str):
            if s in rule_id:
                return (CALL, rule_id[s])
            if s in pred_id:
                return (TEST, pred_id[s])
            if s[0] == "@":
                raise ValueError(s)
            if s[0] != "'" and not s.isupper():
                raise ValueError(f"no rule {s}")
            return (MATCH, self.kinds.setdefault(s.strip("'") if s[0] == "'" else s, len(self.kinds)))

        for r, body in rules.items():
            eps: dict[int, set] = defaultdict(set)
            moves: dict[int, list] = defaultdict(list)
            count = [0]

            def new() -> int:
                count[0] += 1
                return count[0]

            def build(item: tuple, a: int) -> int:
                kind = item[0]
                if kind == "sym":
                    b = new()
                    moves[a].append((symbol(item[1]), b))
                    return b
                if kind == "seq":
                    for x in item[1]:
                        a = build(x, a)
                    return a
                end = new()
                if kind == "alt":
                    for x in item[1]:
                        eps[build(x, a)].add(end)
                    return end
                inner = new()
                eps[a].add(inner)
                b = build(item[1], inner)
                eps[b].add(end)
                if kind in "*+":
                    eps[b].add(inner)
                if kind in "*?":
                    eps[a].add(end)
                return end

            first = new()
            last = build(body, first)

            closures: dict[frozenset, frozenset] = {}

            def closure(states) -> frozenset:
                states = frozenset(states)
                if states not in closures:
                    closures[states] = reached(states)
                return closures[states]

            def reached(states) -> frozenset:
                todo, seen = list(states), set(states)
                while todo:
                    for t in eps[todo.pop()]:
                        if t not in seen:
                            seen.add(t)
                            todo.append(t)
                return frozenset(seen)

            ids: dict[frozenset, int] = {}
            todo = [closure([first])]
            ids[todo[0]] = 0
            edges: list[dict] = [{}]
            final = [last in todo[0]]
            while todo:
                cur = todo.pop()
                by: dict = defaultdict(set)
                for s in cur:
                    for sym, t in moves[s]:
                        by[sym].add(t)
                for sym, targets in by.items():
                    nxt = closure(targets)
                    if nxt not in ids:
                        ids[nxt] = len(edges)
                        edges.append({})
                        final.append(last in nxt)
                        todo.append(nxt)
                    edges[ids[cur]][sym] = ids[nxt]
            part = _merged(edges, final)
            base = len(self.edges)
            seen: dict[int, int] = {}
            for i, c in enumerate(part):  # the start is state 0, so its class comes first
                if c not in seen:
                    seen[c] = base + len(seen)
                    self.edges.append({})
                    self.final.append(final[i])
                    self.rule_of.append(rule_id[r])
            for i, c in enumerate(part):
                for sym, t in edges[i].items():
                    self.edges[seen[c]][sym] = seen[part[t]]
            self.start_of.append(base)

    # --- lookahead

    def _tables(self, starts: Sequence[str]) -> None:
        """For each state and next token the viable actions. Sets of token kinds are bits of a number; the bit after the last
        kind stands for the end of the text."""
        n, end = len(self.edges), 1 << len(self.kinds)
        can_end = list(self.final)
        first = [0] * n
        changed = True
        while changed:
            changed = False
            for s in reversed(range(n)):
                look, ends = first[s], can_end[s]
                for (kind, x), t in self.edges[s].items():
                    if kind == MATCH:
                        look |= 1 << x
                    elif kind == TEST:
                        look |= first[t]
                        ends = ends or can_end[t]
                    else:
                        b = self.start_of[x]
                        look |= first[b] | (first[t] if can_end[b] else 0)
                        ends = ends or (can_end[b] and can_end[t])
                if look != first[s] or ends != can_end[s]:
                    first[s], can_end[s], changed = look, ends, True
        follow = [0] * len(self.rule_names)
        for s in starts:
            follow[self.rule_names.index(s)] |= end
        calls = [(s, x, t) for s in range(n) for (kind, x), t in self.edges[s].items() if kind == CALL]
        changed = True
        while changed:
            changed = False
            for s, x, t in calls:
                look = follow[x] | first[t] | (follow[self.rule_of[s]] if can_end[t] else 0)
                if look != follow[x]:
                    follow[x], changed = look, True
        self.table: list[dict] = []
        serial = 0
        for s in range(n):
            row: dict = {}
            entries = []
            after = follow[self.rule_of[s]]
            for (kind, x), t in self.edges[s].items():
                serial += 1
                beyond = first[t] | (after if can_end[t] else 0)
                if kind == MATCH:
                    entries.append(((MATCH, t, 0, 0, serial), 1 << x))
                elif kind == TEST:
                    entries.append(((TEST, t, x, 0, serial), beyond))
                else:
                    b = self.start_of[x]
                    entries.append(((CALL, t, x, b, serial), first[b] | (beyond if can_end[b] else 0)))
            if self.final[s]:
                serial += 1
                entries.append(((RETURN, 0, 0, 0, serial), after))
            for act, look in entries:
                while look:
                    bit = look & -look
                    look ^= bit
                    k = -1 if bit == end else bit.bit_length() - 1
                    row[k] = (*row.get(k, ()), act)
            self.table.append(row)
        self.starts = {s: self.start_of[self.rule_names.index(s)] for s in starts}

    # --- recognition

    def recognise(self, tokens: list[int], starts: Sequence[str], info=None, forest: dict | None = None) -> bool:
        """Whether the tokens (ending in EOF) are a text of any of the ``starts``; ``info`` is passed to predicates. With
        ``forest`` all ways are followed to their end; it gets the stack nodes by (rule, place) and, under None, the starts
        that take the tokens."""
        toks = [*tokens, -1]
        n = len(tokens)
        table = self.table
        tests = [f for _, f in self.predicates]
        stack: dict = {} if forest is None else forest
        seen: set = set()
        work: list = []
        roots = {}
        for s in starts:
            node = [[(-1, None)], []]
            roots[s] = node
            work.append(((GO, self.starts[s], 0, 0, 0), node, 0))
        while work:
            act, node, pos = work.pop()
            while True:
                kind = act[0]
                if kind == MATCH:
                    pos += 1
                    state = act[1]
                elif kind == CALL:
                    key = (act[2], pos)
                    child = stack.get(key)
                    if child is None:
                        stack[key] = child = [[(act[1], node)], []]
                        node = child
                        state = act[3]
                    else:
                        for back, up in child[0]:
                            if back == act[1] and up is node:
                                break
                        else:
                            child[0].append((act[1], node))
                            for p in child[1]:
                                work.append(((GO, act[1], 0, 0, -act[1]), node, p))
                        break
                elif kind == RETURN:
                    ends = node[1]
                    if pos in ends:
                        break
                    ends.append(pos)
                    up = node[0]
                    if up[0][1] is None:
                        if pos == n and forest is None:
                            return True
                        break
                    for back, parent in up[1:]:
                        work.append(((GO, back, 0, 0, -back), parent, pos))
                    state, node = up[0]
                elif kind == TEST:
                    if not tests[act[2]](tokens, pos, info):
                        break
                    state = act[1]
                else:
                    state = act[1]
                acts = table[state].get(toks[pos])
                if acts is None:
                    break
                if len(acts) > 1:
                    for other in acts[1:]:
                        key = (other[4], id(node), pos)
                        if key not in seen:
                            seen.add(key)
                            work.append((other, node, pos))
                    key = (acts[0][4], id(node), pos)
                    if key in seen:
                        break
                    seen.add(key)
                act = acts[0]
        if forest is not None:
            forest[None] = [s for s, node in roots.items() if n in node[1]]
            return bool(forest[None])
        return False

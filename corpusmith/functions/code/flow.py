"""Syntax and data-flow features for comparing programs."""

from __future__ import annotations

from collections import Counter

import xxhash

from corpusmith.functions.code.parser import Node, Tree, deep
from corpusmith.functions.code.styles import BLOCKS, LOCALS, UPDATES


def subtrees(tree: Tree) -> list[str]:
    """Inner nodes as s-expressions of types, one for each node."""
    out: dict[int, str] = {}
    found = []
    order = list(tree.root.walk())
    for n in reversed(order):  # children come before their parents
        if n.children:
            out[id(n)] = f"({n.type} {' '.join(out[id(c)] for c in n.children)})"
            found.append(out[id(n)])
        else:
            out[id(n)] = f"({n.type})" if n.text is None or n.text[:1].isalnum() or n.text[:1] in "_\"'" else ""
    return found[::-1]


def subtree_digests(tree: Tree) -> list[str]:
    """For each inner node a 128-bit digest of its whole subtree of types, from the digests of its children: linear at any depth."""
    of: dict[int, str] = {}
    found = []
    for n in reversed(list(tree.root.walk())):  # children come before their parents
        of[id(n)] = xxhash.xxh3_128_hexdigest(f"({n.type} {' '.join(of[id(c)] for c in n.children)})") if n.children else n.type
        if n.children:
            found.append(of[id(n)])
    return found[::-1]


def _depth(tree: Tree) -> int:
    level, most = [tree.root], 0
    while level:
        level, most = [c for n in level for c in n.children], most + 1
    return most


Edge = tuple[str, int, str, tuple[str, ...], tuple[int, ...]]


def data_flow(tree: Tree) -> list[Edge]:
    """(variable, place, comesFrom or computedFrom, its sources, their places); places count the leaves. A declaration comes from its value,
    an assignment, an update and the variable of a loop over a collection are computed from theirs, and a use comes from where the
    variable was written. Loops are read twice, so that what their end writes reaches their beginning; branches unite
    what they write. Kept is one edge for each place that has sources or is one."""
    place = {}
    for i, n in enumerate(x for x in tree.root.walk() if x.text is not None):
        place[id(n)] = i
    edges: dict[tuple[int, str], tuple[str, set]] = {}

    def reads(n: Node) -> list[Node]:
        """Variables and literals."""
        return [x for x in n.walk() if x.text is not None and x.type != x.text]

    def edge(x: Node, kind: str, sources) -> None:
        edges.setdefault((place[id(x)], kind), (x.text, set()))[1].update(sources)

    def use(x: Node, state: dict[str, tuple[int, ...]]) -> None:
        came = state.get(x.text, ())
        edge(x, "comesFrom", [(p, x.text) for p in came])
        if not came and x.type == "identifier":
            state[x.text] = (place[id(x)],)

    def write(target: Node, kind: str, sources: list[Node], state: dict[str, tuple[int, ...]]) -> None:
        for x in reads(target):
            edge(x, kind, [(place[id(s)], s.text) for s in sources])
            state[x.text] = (place[id(x)],)

    def united(states: list[dict]) -> dict:
        keys = {k for s in states for k in s}
        return {k: tuple(sorted({p for s in states for p in s.get(k, ())})) for k in keys}

    def visit(n: Node | None, state: dict) -> dict:
        if n is None:
            return state
        t = n.type
        if t in LOCALS:
            for d in n["declarators"] or []:
                if d["value"] is not None:
                    state = visit(d["value"], state)
                write(d["name"] or d, "comesFrom", reads(d["value"]) if d["value"] is not None else [], state)
            return state
        if t == "assignment_expression":
            state = visit(n["right"], state)
            write(n["left"], "computedFrom", reads(n["right"]), state)
            return state
        if t in UPDATES:
            write(n["argument"], "computedFrom", reads(n["argument"]), state)
            return state
        if n.text is not None:
            if t != n.text:
                use(n, state)
            return state
        if t == "if_statement":
            state = visit(n["condition"], state)
            return united([visit(n["then"], dict(state)), visit(n["otherwise"], dict(state))])
        if t in ("switch_statement", "switch_expression"):
            state = visit(n["value"], state)
            ends = [dict(state)]
            for c in n["cases"] or []:
                inside = dict(state)
                for s in c["body"]:
                    inside = visit(s, inside)
                ends.append(inside)
            return united(ends)
        if t in ("while_statement", "do_statement", "for_statement"):
            state = visit(n["initializer"], state)
            before = dict(state)
            for _ in range(2):
                state = visit(n["condition"], united([before, state]))
                state = visit(n["body"], state)
                state = visit(n["update"], state)
            return united([before, state])
        if t in ("for_range_loop", "enhanced_for_statement", "for_each_statement"):
            before = dict(state)
            for _ in range(2):
                state = visit(n["value"], united([before, state]))
                write(n["name"], "computedFrom", reads(n["value"]), state)
                state = visit(n["body"], state)
            return united([before, state])
        if t == "parameter":
            if n["name"] is not None:
                state[n["name"].text] = (place[id(n["name"])],)
                edge(n["name"], "comesFrom", ())
            return state
        if t in ("function_definition", "method_declaration"):
            inside = visit(n["parameters"], dict(state))
            visit(n["body"], inside)
            return state
        for c in n.children:
            state = visit(c, state)
        return state

    with deep(8 * _depth(tree)):
        visit(tree.root, {})
    known = {p for (p, _), (_, sources) in edges.items() if sources}
    known |= {p for _, sources in edges.values() for p, _ in sources}
    one: dict[int, tuple[str, str, set]] = {}
    for (p, kind), (name, sources) in edges.items():
        if p in known:
            one.setdefault(p, (name, kind, set()))[2].update(sources)
    return [(name, p, kind, tuple(t for _, t in sorted(sources)), tuple(q for q, _ in sorted(sources))) for p, (name, kind, sources) in sorted(one.items())]


def normalized_flow(edges: list[Edge]) -> list[str]:
    """Edges as text, variables named by their first appearance."""
    names: dict[str, str] = {}
    out = []
    for var, _, kind, sources, _ in edges:
        for s in sources:
            names.setdefault(s, f"var_{len(names)}")
        names.setdefault(var, f"var_{len(names)}")
        out.append(f"{names[var]} {kind} {','.join(names[s] for s in sources)}")
    return out


def syntax_hits(candidate: list[str], reference: list[str]) -> tuple[int, int]:
    """Reference subtrees that the candidate has anywhere, and all."""
    have = set(candidate)
    return sum(s in have for s in reference), len(reference)


def flow_hits(candidate: list[str], reference: list[str]) -> tuple[int, int]:
    """Reference edges met by candidate edges, each used once, and all."""
    a, b = Counter(candidate), Counter(reference)
    return sum(min(n, a[e]) for e, n in b.items()), len(reference)


def blocks_of(tree: Tree) -> int:
    return sum(n.type in BLOCKS for n in tree.root.walk())

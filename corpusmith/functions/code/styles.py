"""Style counts of a program: one parse and one walk for all styles.

A style id is family.subtype. Counts are of places that have the style. Families 0 to 18; the audits of families below 0 are in
audits.py. A style that a language cannot have counts 0.
"""

from __future__ import annotations

import re
from collections import Counter

from corpusmith.functions.code.parser import Node, Tree, parse

# Style ids and what they say.
STYLES = {
    "0.1": "camelCase identifiers",
    "0.2": "PascalCase identifiers",
    "0.3": "snake_case identifiers",
    "0.4": "identifiers that begin with their type",
    "0.5": "identifiers that begin with _",
    "0.6": "identifiers that begin with $",
    "upper": "identifiers in upper case",
    "lower": "identifiers in lower case",
    "1.1": "single statements without braces",
    "1.2": "single statements in braces",
    "2.1": "a = a + b",
    "2.2": "a += b",
    "3.1": "comparisons by < and <=",
    "3.2": "comparisons by > and >=",
    "3.3": "comparisons by ==",
    "3.4": "comparisons by !=",
    "4.1": "++i",
    "4.2": "i++",
    "4.3": "i += 1",
    "4.4": "i = i + 1",
    "5.1": "arrays from the heap",
    "5.2": "arrays on the stack",
    "6.1": "*(a + i)",
    "6.2": "a[i]",
    "7.1": "declarations of one variable",
    "7.2": "declarations of several variables",
    "8.1": "blocks that begin with their declarations",
    "8.2": "blocks with later declarations",
    "9.1": "variables declared without a value",
    "9.2": "variables declared with a value",
    "10.0": "for (init; condition; update)",
    "10.1": "for (; condition; update)",
    "10.2": "for (init; ; update)",
    "10.3": "for (init; condition; )",
    "10.4": "for (init; ; )",
    "10.5": "for (; condition; )",
    "10.6": "for (; ; update)",
    "10.7": "for (; ; )",
    "11.1": "for loops",
    "11.2": "while loops",
    "11.3": "do-while loops",
    "11.4": "while (true)",
    "12.4": "while (true), as 11.4",
    "13.1": "goto",
    "13.2": "break in loops",
    "14.1": "conditions without a leading !",
    "14.2": "if (!(...))",
    "15.1": "if without a return",
    "15.2": "guards: if that ends in return, without else",
    "16.1": "switch",
    "16.2": "chains of if on one variable",
    "17.1": "if with &&",
    "17.2": "if directly in if",
    "18.1": "if without else",
    "18.2": "if with else",
}
FOR_SLOTS = {(1, 1, 1): "10.0", (0, 1, 1): "10.1", (1, 0, 1): "10.2", (1, 1, 0): "10.3", (1, 0, 0): "10.4", (0, 1, 0): "10.5", (0, 0, 1): "10.6", (0, 0, 0): "10.7"}
BLOCKS = ("compound_statement", "block")
LOCALS = ("declaration", "local_variable_declaration", "local_declaration_statement", "field_declaration")
UPDATES = ("update_expression", "prefix_unary_expression", "postfix_unary_expression")
BODIES = ("for_statement", "while_statement", "do_statement", "for_range_loop", "enhanced_for_statement", "for_each_statement")
CASES = [("0.1", re.compile(r"[a-z][a-z0-9]*(?:[A-Z][a-z0-9]*)+")), ("0.2", re.compile(r"(?:[A-Z][a-z0-9]+)+")), ("0.3", re.compile(r"[a-z][a-z0-9]*(?:_[a-z0-9]+)+")), ("0.5", re.compile(r"_\w*")), ("0.6", re.compile(r"\$[\w$]*"))]
_true = re.compile(r"\(\s*(?:1|true)\s*\)")


def is_step(tree: Tree, n: Node) -> bool:
    """n is an assignment a = a + 1 or a = a - 1."""
    r = n["right"]
    return n["op"].text == "=" and r.type == "binary_expression" and r["op"].text in "+-" and tree.source(r["left"]) == tree.source(n["left"]) and r["right"].text == "1"


def self_operation(tree: Tree, n: Node) -> bool:
    """n is an assignment a = a op b."""
    r = n["right"]
    return n["op"].text == "=" and r.type == "binary_expression" and f"{r['op'].text}=" in ("+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=") and tree.source(r["left"]) == tree.source(n["left"])


def branches(n: Node) -> list[Node]:
    """Statements that a control statement governs; an else-if is a statement of its own."""
    if n.type == "if_statement":
        other = n["otherwise"]
        return [n["then"]] + ([other] if other is not None and other.type != "if_statement" else [])
    return [n["body"]] if n.type in BODIES else []


def chain(tree: Tree, n: Node) -> tuple[str, list[tuple[Node, Node]], Node] | None:
    """variable, (value, branch)s and else of if (v == x) ... else if (v == y) ... else ..."""
    arms, name, at = [], None, n
    while at is not None and at.type == "if_statement":
        c = at["condition"]["inner"]
        if c.type != "binary_expression" or c["op"].text != "==" or c["left"].type != "identifier":
            return None
        if name not in (None, c["left"].text):
            return None
        name = c["left"].text
        arms.append((c["right"], at["then"]))
        at = at["otherwise"]
    return (name, arms, at) if len(arms) > 1 and at is not None else None


def of_tree(tree: Tree) -> dict[str, int]:
    c: Counter[str] = Counter()
    types: dict[str, str] = {}
    loops = []
    nested_else = set()
    for n in tree.root.walk():
        t = n.type
        if t == "identifier":
            for style, pattern in CASES:
                c[style] += pattern.fullmatch(n.text) is not None
            c["upper"] += n.text.isupper()
            c["lower"] += n.text.islower()
            if n.text in types and n.text.lower().startswith(types[n.text]) and len(n.text) > len(types[n.text]):
                c["0.4"] += 1
        for b in branches(n):
            if b.type in BLOCKS:
                c["1.2"] += len(b["body"]) <= 1
            elif b.type != "empty_statement":
                c["1.1"] += 1
        if t == "assignment_expression":
            c["2.1"] += self_operation(tree, n)
            c["2.2"] += n["op"].text not in ("=", "??=")
            c["4.3"] += n["op"].text in ("+=", "-=") and n["right"].text == "1"
            c["4.4"] += is_step(tree, n)
        elif t == "binary_expression":
            op = n["op"].text
            style = {"<": "3.1", "<=": "3.1", ">": "3.2", ">=": "3.2", "==": "3.3", "!=": "3.4"}.get(op)
            if style:
                c[style] += 1
        elif t in UPDATES:
            c["4.1" if n["prefix"] else "4.2"] += 1
        elif t == "pointer_expression" and n["op"].text == "*":
            a = n["argument"]
            c["6.1"] += a.type == "parenthesized_expression" and a["inner"].type == "binary_expression" and a["inner"]["op"].text == "+"
        elif t in ("subscript_expression", "array_access", "element_access_expression"):
            c["6.2"] += 1
        elif t in LOCALS:
            ds = n["declarators"] or []
            c["7.1" if len(ds) == 1 else "7.2"] += 1
            base = re.sub(r"\W.*", "", tree.source(n["type"]).split()[-1].lower()) if n["type"] else ""
            for d in ds:
                name = d["name"].text if d["name"] else d.text
                if name and base:
                    types[name] = base
                value = d["value"]
                c["9.2" if value is not None else "9.1"] += 1
                if d["dims"] and tree.lang == "c":
                    c["5.2"] += 1
                if value is not None and tree.lang == "c" and re.search(r"\b(?:malloc|calloc)\s*\(", tree.source(value)):
                    c["5.1"] += 1
        elif t in BLOCKS:
            kinds = [s.type in LOCALS for s in n["body"] or []]
            if any(kinds):
                late = any(k and not all(kinds[:i]) for i, k in enumerate(kinds))
                c["8.2" if late else "8.1"] += 1
        elif t == "for_statement":
            c[FOR_SLOTS[tuple(int(n[k] is not None) for k in ("initializer", "condition", "update"))]] += 1
            c["11.1"] += 1
            loops.append(n)
        elif t == "while_statement":
            c["11.2"] += 1
            c["11.4"] += _true.fullmatch(tree.source(n["condition"])) is not None
            loops.append(n)
        elif t == "do_statement":
            c["11.3"] += 1
            loops.append(n)
        elif t == "goto_statement":
            c["13.1"] += 1
        elif t in ("switch_statement", "switch_expression"):
            c["16.1"] += 1
        elif t == "if_statement":
            cond = n["condition"]["inner"]
            negated = cond.type == "unary_expression" and cond["op"].text == "!" and cond["argument"].type == "parenthesized_expression"
            c["14.2" if negated else "14.1"] += 1
            then = n["then"]
            last = (then["body"] or [None])[-1] if then.type in BLOCKS else then
            guard = n["otherwise"] is None and last is not None and last.type == "return_statement"
            c["15.2" if guard else "15.1"] += 1
            if id(n) not in nested_else and chain(tree, n):
                c["16.2"] += 1
            at = n["otherwise"]
            while at is not None and at.type == "if_statement":
                nested_else.add(id(at))
                at = at["otherwise"]
            only = then["body"][0] if then.type in BLOCKS and len(then["body"]) == 1 else then
            if n["otherwise"] is None and only.type == "if_statement" and only["otherwise"] is None:
                c["17.2"] += 1
            elif cond.type == "binary_expression" and cond["op"].text == "&&":
                c["17.1"] += 1
            c["18.2" if n["otherwise"] is not None else "18.1"] += 1
    c["12.4"] = c["11.4"]
    c["13.2"] = _breaks(loops)
    return {s: int(c[s]) for s in STYLES}


def _breaks(loops: list[Node]) -> int:
    """Breaks that leave a loop, not a switch."""
    found = set()
    for loop in loops:
        stack = [loop["body"]]
        while stack:
            n = stack.pop()
            if n.type == "break_statement":
                found.add(n.start)
            elif n.type not in ("switch_statement", "switch_expression", "for_statement", "while_statement", "do_statement"):
                stack.extend(n.children)
    return len(found)


def counts(code: str, lang: str) -> dict[str, int]:
    return of_tree(parse(code, lang))


def syntax_ok(code: str, lang: str) -> bool:
    return parse(code, lang).errors == 0


def leaf_tokens(tree: Tree) -> list[str]:
    """Texts of the leaves in order; joined they are the source without white space and comments."""
    return [n.text for n in tree.root.walk() if n.text is not None]

"""Detectors of tampering marks in programs: hidden characters, inert statements, suffixed identifiers. They find; they never insert."""

from __future__ import annotations

import re

from corpusmith.functions.code.parser import Node, Tree, parse
from corpusmith.functions.code.styles import BLOCKS

_false = re.compile(r"\(\s*(?:0|false|\d+\s*[<>]=?\s*\d+|\d+\s*==\s*\d+|[^()]*&&\s*(?:0|false))\s*\)", re.S)
_print = re.compile(r"(?:printf|puts|System\.out\.println?|Console\.Write(?:Line)?)\s*\(\s*\"(?:[^\"\\]|\\.)*\"\s*\)")


def constant_false(condition: str) -> bool:
    """The condition, as text in parentheses, can never hold by its literals alone."""
    m = re.fullmatch(r"\(\s*(\d+)\s*(<|>|<=|>=|==|!=)\s*(\d+)\s*\)", condition)
    if m:
        a, b = int(m[1]), int(m[3])
        return not {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b, "==": a == b, "!=": a != b}[m[2]]
    return re.fullmatch(r"\(\s*(?:0|false)\s*\)", condition) is not None or re.search(r"&&\s*(?:0|false)\s*\)$", condition) is not None


def inert(tree: Tree, s: Node) -> bool:
    """A statement that does nothing: guarded by a constant falsehood, or it only prints a literal."""
    if s.type in ("if_statement", "while_statement") and s["otherwise"] is None:
        return constant_false(tree.source(s["condition"]))
    return s.type == "expression_statement" and _print.fullmatch(tree.source(s["expression"])) is not None


def inert_first_statements(code: str, lang: str) -> int:
    """Functions whose body begins with an inert statement."""
    tree = parse(code, lang)
    found = 0
    for n in tree.root.walk():
        if n.type in ("function_definition", "method_declaration") and n["body"] is not None and n["body"].type in BLOCKS and n["body"]["body"]:
            found += inert(tree, n["body"]["body"][0])
    return found


def suffixed_identifiers(code: str, lang: str, suffixes: tuple[str, ...]) -> list[str]:
    return [n.text for n in parse(code, lang).root.walk() if n.type == "identifier" and n.text.endswith(suffixes)]

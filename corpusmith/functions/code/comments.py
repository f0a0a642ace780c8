"""Comments out of programs, by language family.

C family: a scanner that is in code, in a literal or in a comment, told apart by what begins there. Python: the places of comments come from
the tokenizer and those of docstrings (statements that are a string and nothing else) from the syntax tree; both are cut out by offset.
"""

from __future__ import annotations

import ast
import io
import itertools
import tokenize

Span = tuple[int, int]


def _literal_end(code: str, at: int) -> int:
    """Where the literal that begins at `at` ends; just behind its quote if it never closes."""
    end = at + 1
    while end < len(code) and code[end] != code[at]:
        end += 2 if code[end] == "\\" else 1
    return end + 1 if end < len(code) else at + 1


def c_comments(code: str) -> list[Span]:
    """Spans of the comments of a C-like program; a block comment that never closes is none."""
    found, at = [], 0
    while at < len(code):
        if code[at] in "\"'":
            at = _literal_end(code, at)
        elif code.startswith("//", at):
            end = code.find("\n", at)
            found.append((at, end if end >= 0 else len(code)))
            at = found[-1][1]
        elif code.startswith("/*", at) and (end := code.find("*/", at + 2)) >= 0:
            found.append((at, end + 2))
            at = end + 2
        else:
            at += 1
    return found


def python_comments(code: str) -> list[Span]:
    """Spans of comments and docstrings; none of a text that doesn't tokenize, no docstrings of one that doesn't parse."""
    begins = list(itertools.accumulate(map(len, code.splitlines(keepends=True)), initial=0))
    lines = code.splitlines(keepends=True)
    try:
        found = [(begins[t.start[0] - 1] + t.start[1], begins[t.end[0] - 1] + t.end[1]) for t in tokenize.generate_tokens(io.StringIO(code).readline) if t.type == tokenize.COMMENT]
    except (tokenize.TokenError, SyntaxError):
        return []
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError):
        return found

    def offset(row: int, byte: int) -> int:
        return begins[row - 1] + len(lines[row - 1].encode()[:byte].decode())

    docs = (n for n in ast.walk(tree) if isinstance(n, ast.Expr) and isinstance(n.value, ast.Constant) and isinstance(n.value.value, str))
    return sorted(found + [(offset(n.lineno, n.col_offset), offset(n.end_lineno, n.end_col_offset)) for n in docs])


def strip_comments(code: str, lang: str) -> str:
    """Comments become one space (in Python nothing), literals stay, blank lines go. Ruby stays as it is, and so does a Python text that doesn't tokenize."""
    if lang == "ruby":
        return code
    spans, put = (python_comments(code), "") if lang == "python" else (c_comments(code), " ")
    if lang == "python" and not spans:
        return code if not code.strip() or _broken(code) else _without_blank_lines(code)
    kept, at = [], 0
    for start, end in spans:
        kept += [code[at:start], put]
        at = end
    return _without_blank_lines("".join(kept) + code[at:])


def _broken(code: str) -> bool:
    try:
        return not all(True for _ in tokenize.generate_tokens(io.StringIO(code).readline))
    except (tokenize.TokenError, SyntaxError):
        return True


def _without_blank_lines(code: str) -> str:
    return "\n".join(line for line in code.split("\n") if line.strip())

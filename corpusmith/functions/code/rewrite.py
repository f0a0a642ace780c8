"""Equivalence-preserving rewrites of a program towards a style.

A rewrite matches nodes, makes non-overlapping edits (of nested matches the outermost goes first, then the text is parsed again until
nothing changes), and leaves a place alone where it cannot be sure that the meaning stays. Labels are never touched.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from corpusmith.functions.code.parser import PRIMITIVE, RESERVED, Node, Tree, parse
from corpusmith.functions.code.styles import BLOCKS, BODIES, LOCALS, UPDATES, branches, chain, is_step, self_operation

Edit = tuple[int, int, str]
NEGATED = {"<": ">=", ">": "<=", "<=": ">", ">=": "<", "==": "!=", "!=": "=="}
MIRRORED = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}
SIMPLE = ("identifier", "number_literal", "string_literal", "character_literal", "parenthesized_expression", "call_expression", "method_invocation", "invocation_expression", "subscript_expression", "array_access", "element_access_expression", "field_expression", "field_access", "member_access_expression", "true", "false", "null", "this")


def apply_edits(code: str, edits: list[Edit]) -> str:
    """code with [start, end) replaced by text; an edit that overlaps one further out or before is left out. Offsets are characters."""
    out, at = [], 0
    for start, end, text in sorted(edits, key=lambda e: (e[0], -e[1])):
        if start >= at:
            out += [code[at:start], text]
            at = end
    return "".join(out) + code[at:]


def indent_at(code: str, at: int) -> str:
    line = code.rfind("\n", 0, at) + 1
    return re.match(r"[ \t]*", code[line:])[0]


def pure(n: Node) -> bool:
    """Evaluating n twice, or in another order, changes nothing."""
    return not any(x.type in (*UPDATES, "assignment_expression", "call_expression", "method_invocation", "invocation_expression", "object_creation_expression", "await_expression", "lambda_expression", "ERROR") for x in n.walk())


def parens(t: Tree, n: Node) -> str:
    s = t.source(n)
    return s if n.type in SIMPLE else f"({s})"


def negation(t: Tree, n: Node) -> str:
    """!n, as plain as it gets."""
    if n.type == "parenthesized_expression":
        return negation(t, n["inner"])
    if n.type == "unary_expression" and n["op"].text == "!":
        return t.source(n["argument"])
    # NaN makes !(a < b) differ from a >= b; == and != are exact opposites
    if n.type == "binary_expression" and n["op"].text in ("==", "!="):
        return f"{t.source(n['left'])} {NEGATED[n['op'].text]} {t.source(n['right'])}"
    return f"!({t.source(n)})"


def has(n: Node, *types: str) -> bool:
    return any(x.type in types for x in n.walk())


def leaves_loop(body: Node, word: str) -> bool:
    """A break or continue in body that belongs to the loop around it."""
    stack = [body]
    while stack:
        n = stack.pop()
        if n.type == f"{word}_statement":
            return True
        if n.type not in BODIES and not (word == "break" and n.type in ("switch_statement", "switch_expression")):
            stack.extend(n.children)
    return False


def captured(body: Node, *moved: Node | None) -> bool:
    """What is moved into body would find names of body's own instead of those outside."""
    own = {name for s in (body["body"] or [] if body.type in BLOCKS else []) if s.type in LOCALS for name in names_of(s)}
    return any(x.text in own for m in moved if m is not None for x in m.walk())


def names_of(declaration: Node) -> list[str]:
    return [d["name"].text if d["name"] else d.text for d in declaration["declarators"] or []]


def inner_text(t: Tree, body: Node) -> str:
    """The statements of a body, without the braces around them; behind a // comment the line ends."""
    text = (t.code[body.start + 1 : body.end - 1] if body.type in BLOCKS else t.source(body)).strip()
    return text + "\n" if "//" in text else text


def parents(t: Tree) -> dict[int, Node]:
    return {id(c): n for n in t.root.walk() for c in n.children}


# One function a style: edits of a tree.


def _augmented(t: Tree, to: str) -> Iterator[Edit]:
    for n in t.root.walk():
        if n.type != "assignment_expression" or not pure(n["left"]):
            continue
        if to == "2.1" and n["op"].text not in ("=", "??=") and t.lang == "c":
            yield n.start, n.end, f"{t.source(n['left'])} = {t.source(n['left'])} {n['op'].text[:-1]} {parens(t, n['right'])}"
        elif to == "2.1" and n["op"].text not in ("=", "??=") and n["right"].type in ("number_literal", "identifier"):
            yield n.start, n.end, f"{t.source(n['left'])} = {t.source(n['left'])} {n['op'].text[:-1]} {t.source(n['right'])}"
        elif to == "2.2" and self_operation(t, n):
            yield n.start, n.end, f"{t.source(n['left'])} {n['right']['op'].text}= {t.source(n['right']['right'])}"


def _comparison(t: Tree, to: str) -> Iterator[Edit]:
    for n in t.root.walk():
        if n.type != "binary_expression" or n["op"].text not in NEGATED or not pure(n):
            continue
        op, a, b = n["op"].text, t.source(n["left"]), t.source(n["right"])
        if any(x.type == "binary_expression" and x["op"].text in NEGATED for x in [*n["left"].walk(), *n["right"].walk()]):
            a, b = f"({a})" if n["left"].type == "binary_expression" else a, f"({b})" if n["right"].type == "binary_expression" else b
        if to == "3.1" and op in (">", ">=") or to == "3.2" and op in ("<", "<="):
            yield n.start, n.end, f"{b} {MIRRORED[op]} {a}"
        elif to in ("3.1", "3.2") and op == "==" and _number(n["left"]) and _number(n["right"]):
            sign = "<=" if to == "3.1" else ">="
            yield n.start, n.end, f"({a} {sign} {b} && {b} {sign} {a})"
        elif to == "3.3" and op == "!=":
            yield n.start, n.end, f"!({a} == {b})"
        elif to == "3.4" and op == "==":
            yield n.start, n.end, f"!({a} != {b})"
        elif t.lang == "c" or _number(n["left"]) or _number(n["right"]):  # == of two objects would compare references
            # exact for NaN too, which is neither less nor equal
            if to == "3.3" and op in ("<=", ">="):
                yield n.start, n.end, f"({a} {op[0]} {b} || {a} == {b})"
            elif to == "3.4" and op in ("<", ">"):
                yield n.start, n.end, f"({a} {op}= {b} && {a} != {b})"


def _number(n: Node) -> bool:
    """n is surely a number: only arithmetic of number literals and at least one of them."""
    return n.type == "number_literal" or n.type == "binary_expression" and n["op"].text in "+-*/%" and (_number(n["left"]) or _number(n["right"]))


def _step(t: Tree, to: str) -> Iterator[Edit]:
    """Increments whose value nobody reads."""
    up = parents(t)
    for n in t.root.walk():
        if n.type in UPDATES:
            target, sign = n["argument"], n["op"].text[0]
        elif n.type == "assignment_expression" and n["op"].text in ("+=", "-=") and n["right"].text == "1":
            target, sign = n["left"], n["op"].text[0]
        elif n.type == "assignment_expression" and is_step(t, n):
            target, sign = n["left"], n["right"]["op"].text
        else:
            continue
        above = up.get(id(n))
        unread = above is not None and (above.type == "expression_statement" or above.type == "for_statement" and above["update"] is n or above.type == "comma_expression" and (up[id(above)].type == "expression_statement" or up[id(above)].type == "for_statement" and up[id(above)]["condition"] is not above))
        if not unread or not pure(target):
            continue
        a = t.source(target)
        new = {"4.1": f"{sign * 2}{a}", "4.2": f"{a}{sign * 2}", "4.3": f"{a} {sign}= 1", "4.4": f"{a} = {a} {sign} 1"}[to]
        if to == "4.4" and t.lang != "c" and not re.fullmatch(r"\w+", a):
            continue
        if new != t.source(n):
            yield n.start, n.end, new


def _braces(t: Tree, to: str) -> Iterator[Edit]:
    for n in t.root.walk():
        for b in branches(n):
            if to == "1.2" and b.type not in (*BLOCKS, "empty_statement", "ERROR"):
                yield b.start, b.end, f"{{ {t.source(b)} }}"
            elif to == "1.1" and b.type in BLOCKS and len(b["body"]) == 1 and b["body"][0].type not in (*LOCALS, "if_statement", "ERROR", "labeled_statement", "preproc_directive") and n.type != "do_statement" and not re.search(r"//|/\*", t.source(b)):
                only = b["body"][0]
                # a loop or an if at the end of it could catch a following else
                if not has(only, "if_statement"):
                    yield b.start, b.end, t.source(only)


def _array_access(t: Tree, to: str) -> Iterator[Edit]:
    if t.lang != "c":
        return
    for n in t.root.walk():
        if to == "6.1" and n.type == "subscript_expression" and n["index"] is not None and n["array"].type in SIMPLE:
            yield n.start, n.end, f"(*({t.source(n['array'])} + {parens(t, n['index'])}))"
        elif to == "6.2" and n.type == "pointer_expression" and n["op"].text == "*" and n["argument"].type == "parenthesized_expression":
            inner = n["argument"]["inner"]
            if inner.type == "binary_expression" and inner["op"].text == "+" and inner["left"].type in SIMPLE:
                yield n.start, n.end, f"{t.source(inner['left'])}[{t.source(inner['right'])}]"


def _declarator_text(t: Tree, d: Node) -> str:
    return t.source(d)


def _declare_lines(t: Tree, to: str) -> Iterator[Edit]:
    for block in t.root.walk():
        if block.type not in BLOCKS:
            continue
        body = block["body"] or []
        if to == "7.1":
            for s in body:
                if s.type in LOCALS and len(s["declarators"]) > 1:
                    pad = indent_at(t.code, s.start)
                    yield s.start, s.end, f"\n{pad}".join(f"{t.source(s['type'])} {_declarator_text(t, d)};" for d in s["declarators"])
        else:
            # neighbours of one type become one declaration; what lies between two others could use them
            i = 0
            while i < len(body):
                j = i + 1
                while body[i].type in LOCALS and j < len(body) and body[j].type in LOCALS and t.source(body[j]["type"]) == t.source(body[i]["type"]) and "*" not in t.source(body[i]["type"]) and not re.search(r"\S", re.sub(r"\s", "", t.code[body[j - 1].end : body[j].start])):
                    j += 1
                if j > i + 1:
                    names = [_declarator_text(t, d) for s in body[i:j] for d in s["declarators"]]
                    yield body[i].start, body[j - 1].end, f"{t.source(body[i]['type'])} {', '.join(names)};"
                i = j


def _declare_position(t: Tree, to: str) -> Iterator[Edit]:
    """8.1 moves declarations without a value to the head of their block, 8.2 to the statement that uses them first."""
    for block in t.root.walk():
        if block.type not in BLOCKS:
            continue
        body = block["body"] or []
        if to == "8.2":
            yield from _sunk(t, body)
            continue
        late = False
        for s in body:
            if s.type not in LOCALS:
                late = True
            elif late and all(d["value"] is None and not d["dims"] for d in s["declarators"]):
                # without a value a declaration can move up if its names aren't used before it
                names = {d["name"].text if d["name"] else d.text for d in s["declarators"]}
                before = {x.text for b in body if b.start < s.start for x in b.walk() if x.text}
                if not names & before and None not in names:
                    first = next(b for b in body if b.type not in LOCALS)
                    yield first.start, first.start, f"{t.source(s)} "
                    yield s.start, s.end, ""
                    break


def _sunk(t: Tree, body: list[Node]) -> Iterator[Edit]:
    if any(has(s, "labeled_statement", "goto_statement", "preproc_directive", "ERROR") for s in body):
        return
    for k, s in enumerate(body):
        names = set(names_of(s)) if s.type in LOCALS else set()
        if not names or None in names or any(d["value"] is not None or d["dims"] for d in s["declarators"]) or re.search(r"\b(?:static|const|final)\b", t.source(s["type"])):
            continue
        first = next((j for j in range(k + 1, len(body)) if any(x.text in names for x in body[j].walk())), None)
        if first is not None and body[first].type not in LOCALS and any(x.type not in LOCALS for x in body[k + 1 : first]):
            yield s.start, s.end, ""
            yield body[first].start, body[first].start, f"{t.source(s)} "


def _declare_assign(t: Tree, to: str) -> Iterator[Edit]:
    for block in t.root.walk():
        if block.type not in BLOCKS:
            continue
        body = block["body"] or []
        for k, s in enumerate(body):
            if s.type not in LOCALS or len(s["declarators"]) != 1:
                continue
            d = s["declarators"][0]
            type, name = t.source(s["type"]), d["name"].text if d["name"] else d.text
            if to == "9.1" and d["value"] is not None and not d["dims"] and not re.search(r"\b(?:const|final|var|auto|static)\b|\*|\[", type) and d["value"].type != "initializer_list" and d.children[0].text != "*":
                yield s.start, s.end, f"{type} {name};\n{indent_at(t.code, s.start)}{name} = {t.source(d['value'])};"
            elif to == "9.2" and d["value"] is None and not d["dims"] and name and k + 1 < len(body):
                a = body[k + 1]
                e = a["expression"] if a.type == "expression_statement" else None
                if e is not None and e.type == "assignment_expression" and e["op"].text == "=" and t.source(e["left"]) == name and not any(x.text == name for x in e["right"].walk()):
                    yield s.start, a.end, f"{type} {name} = {t.source(e['right'])};"


SLOTS = {"10.0": "abc", "10.1": "obc", "10.2": "aoc", "10.3": "abo", "10.4": "aoo", "10.5": "obo", "10.6": "ooc", "10.7": "ooo"}


def _for_slots(t: Tree, to: str) -> Iterator[Edit]:
    keep = SLOTS[to]
    up = parents(t)
    if to == "10.0":
        yield from _filled(t, up)
        return
    for n in t.root.walk():
        if n.type != "for_statement":
            continue
        init, cond, update, body = n["initializer"], n["condition"], n["update"], n["body"]
        move = [x is not None and k == "o" for x, k in zip((init, cond, update), keep, strict=True)]
        above = up.get(id(n))
        if not any(move) or above is None or above.type not in BLOCKS or move[2] and (leaves_loop(body, "continue") or captured(body, update)) or has(n, "ERROR", "preproc_directive"):
            continue
        text = lambda x: "" if x is None else t.source(x)
        inside = [f"if ({negation(t, cond)}) break;"] if move[1] else []
        inside += [inner_text(t, body)] if body.type != "empty_statement" else []
        inside += [f"{text(update)};"] if move[2] else []
        head = f"for ({'' if move[0] else text(init)};{'' if move[1] or cond is None else ' ' + text(cond)};{'' if move[2] or update is None else ' ' + text(update)})"
        loop = f"{head} {{ {' '.join(x for x in inside if x)} }}" if move[1] or move[2] else f"{head} {t.source(body)}"
        if move[0]:
            # in braces, so that a name declared there stays local
            loop = f"{{ {text(init)}; {loop} }}" if init.type in LOCALS else f"{text(init)};\n{indent_at(t.code, n.start)}{loop}"
        yield n.start, n.end, loop


def _filled(t: Tree, up: dict[int, Node]) -> Iterator[Edit]:
    """A part of a for that stands outside of its head, one a pass: an assignment right before it, a leading `if (...) break;`, a last step of what the condition reads."""
    for n in t.root.walk():
        above = up.get(id(n))
        if n.type != "for_statement" or above is None or above.type not in BLOCKS or has(n, "ERROR", "preproc_directive"):
            continue
        init, cond, update, body = n["initializer"], n["condition"], n["update"], n["body"]
        text = lambda x: "" if x is None else t.source(x)
        place = next(k for k, x in enumerate(above["body"]) if x is n)
        before = above["body"][place - 1] if place else None
        own = body["body"] or [] if body.type in BLOCKS else []
        first, last = (own[0], own[-1]) if own else (None, None)
        if init is None and before is not None and _step_of(before) and not t.code[before.end : n.start].strip():
            yield before.start, n.end, f"for ({text(before['expression'])}; {text(cond)}; {text(update)}) {t.source(body)}"
        elif cond is None and first is not None and _breaks_only(first):
            rest = t.code[body.start + 1 : first.start] + t.code[first.end : body.end]
            leave = first["condition"]["inner"]
            stay = leave["argument"] if leave.type == "unary_expression" and leave["op"].text == "!" else None
            test = t.source(stay["inner"]) if stay is not None and stay.type == "parenthesized_expression" else negation(t, leave)
            yield n.start, n.end, f"for ({text(init)}; {test}; {text(update)}) {{{rest}"
        elif update is None and cond is not None and last is not None and _step_of(last) and not leaves_loop(body, "continue") and not captured(body, last):
            target = last["expression"]["argument"] or last["expression"]["left"]
            if target.type == "identifier" and any(x.text == target.text for x in cond.walk()):
                yield n.start, n.end, f"for ({text(init)}; {text(cond)}; {text(last['expression'])}) {t.code[body.start : last.start]}{t.code[last.end : body.end]}"


def _step_of(s: Node) -> bool:
    """s assigns or counts, and does nothing else."""
    return s.type == "expression_statement" and s["expression"] is not None and s["expression"].type in ("assignment_expression", "update_expression", "prefix_unary_expression", "postfix_unary_expression")


def _breaks_only(s: Node) -> bool:
    if s.type != "if_statement" or s["otherwise"] is not None:
        return False
    then = s["then"]
    return then.type == "break_statement" or then.type in BLOCKS and len(then["body"]) == 1 and then["body"][0].type == "break_statement"


def _loop_kind(t: Tree, to: str) -> Iterator[Edit]:
    up = parents(t)
    always = "1" if t.lang == "c" else "true"
    for n in t.root.walk():
        if n.type not in ("for_statement", "while_statement", "do_statement") or has(n, "ERROR", "preproc_directive"):
            continue
        body, cond = n["body"], n["condition"]
        if to == "11.1" and n.type == "while_statement":
            yield n.start, n.end, f"for (; {t.source(cond['inner'])};) {t.source(body)}"
        elif to in ("11.1", "11.2") and n.type == "do_statement" and not leaves_loop(body, "continue") and not captured(body, cond) and (to == "11.1" or not leaves_loop(body, "break")):
            head = "for (;;)" if to == "11.1" else f"while ({always})"
            yield n.start, n.end, f"{head} {{ {inner_text(t, body)} if ({negation(t, cond['inner'])}) break; }}"
        elif n.type == "for_statement" and to != "11.1" and not _dangling(up, n) and not (n["update"] is not None and (leaves_loop(body, "continue") or captured(body, n["update"]))):
            parts = [inner_text(t, body) if body.type != "empty_statement" else "", f"{t.source(n['update'])};" if n["update"] is not None else ""]
            test = t.source(cond) if cond is not None else always
            if to == "11.3":
                loop = f"do {{ {' '.join(p for p in parts if p)} }} while ({test});"
                loop = loop if cond is None else f"if ({test}) {loop}"
            else:
                if to in ("11.4", "12.4") and cond is not None:
                    parts.insert(0, f"if ({negation(t, cond)}) break;")
                    test = always
                loop = f"while ({test}) {{ {' '.join(p for p in parts if p)} }}"
            init = n["initializer"]
            yield n.start, n.end, loop if init is None else f"{{ {t.source(init)}; {loop} }}" if init.type in LOCALS else f"{t.source(init)};\n{indent_at(t.code, n.start)}{loop}"
        elif to == "11.3" and n.type == "while_statement" and not _dangling(up, n):
            yield n.start, n.end, f"if ({t.source(cond['inner'])}) do {t.source(body) if body.type in BLOCKS else '{ ' + t.source(body) + ' }'} while ({t.source(cond['inner'])});"
        elif to in ("11.4", "12.4") and n.type == "while_statement" and not re.fullmatch(r"\(\s*(?:1|true)\s*\)", t.source(cond)):
            yield n.start, n.end, f"while ({always}) {{ if ({negation(t, cond['inner'])}) break; {inner_text(t, body) if body.type != 'empty_statement' else ''} }}"


def _dangling(up: dict[int, Node], n: Node) -> bool:
    """n isn't a statement of a block: an else behind it would be caught by an if that begins at n, and there is no room for a second statement."""
    above = up.get(id(n))
    return above is None or above.type not in BLOCKS


def _exclamation(t: Tree, to: str) -> Iterator[Edit]:
    for n in t.root.walk():
        if n.type != "if_statement":
            continue
        c = n["condition"]["inner"]
        negated = c.type == "unary_expression" and c["op"].text == "!" and c["argument"].type == "parenthesized_expression"
        if to == "14.2" and not negated and c.type == "binary_expression" and c["op"].text in ("==", "!="):
            yield c.start, c.end, f"!({t.source(c['left'])} {NEGATED[c['op'].text]} {t.source(c['right'])})"
        elif to == "14.1" and negated and c["argument"]["inner"].type == "binary_expression" and c["argument"]["inner"]["op"].text in ("==", "!="):
            yield c.start, c.end, negation(t, c["argument"]["inner"])


def _switch(t: Tree, to: str) -> Iterator[Edit]:
    if to == "16.1":
        seen = set()
        for n in t.root.walk():
            if n.type == "if_statement" and n.start not in seen:
                at = n["otherwise"]
                while at is not None and at.type == "if_statement":
                    seen.add(at.start)
                    at = at["otherwise"]
                found = chain(t, n)
                if found is None:
                    continue
                name, arms, other = found
                values = [t.source(v) for v, _ in arms]
                # cases must be distinct constants, and a break inside would end the switch instead of a loop
                if len(set(values)) < len(values) or any(v.type not in ("number_literal", "character_literal") for v, _ in arms) or any(leaves_loop(b, "break") or has(b, *LOCALS) for b in [*(b for _, b in arms), other]):
                    continue
                cases = [f"case {v}: {inner_text(t, b)}{_end(b)}" for v, (_, b) in zip(values, arms, strict=True)]
                yield n.start, n.end, f"switch ({name}) {{ {' '.join(cases)} default: {inner_text(t, other)}{_end(other)} }}"
    else:
        for n in t.root.walk():
            if n.type not in ("switch_statement", "switch_expression") or not n["cases"] or not pure(n["value"]["inner"]):
                continue
            arms, other, fine = [], None, True
            for k, case in enumerate(n["cases"]):
                body = case["body"]
                ends = body and body[-1].type in ("break_statement", "return_statement")
                fine &= bool(ends or k == len(n["cases"]) - 1) and not any(leaves_loop(s, "break") for s in body[:-1]) and case.children[-len(body) - 1].text == ":" if body else False
                if not fine:
                    break
                text = " ".join(t.source(s) for s in body if s.type != "break_statement" or s is not body[-1])
                if case["label"] is None:
                    other = text
                    fine &= k == len(n["cases"]) - 1
                else:
                    arms.append(f"if ({t.source(n['value']['inner'])} == {t.source(case['label'])}) {{ {text} }}")
            if fine and arms and not (t.lang != "c" and any(c["label"] is not None and c["label"].type == "string_literal" for c in n["cases"])):
                yield n.start, n.end, " else ".join(arms) + (f" else {{ {other} }}" if other is not None else "")


def _end(b: Node) -> str:
    last = (b["body"] or [None])[-1] if b.type in BLOCKS else b
    return "" if last is not None and last.type in ("return_statement", "continue_statement", "throw_statement", "goto_statement") else " break;"


def _nested(t: Tree, to: str) -> Iterator[Edit]:
    up = parents(t)
    for n in t.root.walk():
        if n.type != "if_statement" or n["otherwise"] is not None:
            continue
        above = up.get(id(n))
        if above is not None and above.type == "if_statement" and above["otherwise"] is not None:
            continue
        c = n["condition"]["inner"]
        if to == "17.2" and c.type == "binary_expression" and c["op"].text == "&&":
            yield n.start, n.end, f"if ({t.source(c['left'])}) {{ if ({t.source(c['right'])}) {t.source(n['then'])} }}"
        elif to == "17.1":
            then = n["then"]
            only = then["body"][0] if then.type in BLOCKS and len(then["body"]) == 1 else then
            if only.type == "if_statement" and only["otherwise"] is None:
                yield n.start, n.end, f"if ({_operand(t, c)} && {_operand(t, only['condition']['inner'])}) {t.source(only['then'])}"


def _operand(t: Tree, n: Node) -> str:
    low = n.type in ("assignment_expression", "ternary_expression", "conditional_expression", "comma_expression", "lambda_expression") or n.type == "binary_expression" and n["op"].text in ("||", "??")
    return f"({t.source(n)})" if low else t.source(n)


def _else(t: Tree, to: str) -> Iterator[Edit]:
    """18.1: an else behind a branch that always returns is not needed."""
    if to != "18.1":
        return
    up = parents(t)
    for n in t.root.walk():
        other, above = n["otherwise"] if n.type == "if_statement" else None, up.get(id(n))
        if other is not None and above is not None and above.type in BLOCKS and other.type in BLOCKS and not has(other, *LOCALS) and _end(n["then"]) == "":
            yield n.start, n.end, f"if {t.source(n['condition'])} {t.source(n['then'])}\n{indent_at(t.code, n.start)}{inner_text(t, other)}"


def _heap(t: Tree, to: str) -> Iterator[Edit]:
    if t.lang != "c":
        return
    for block in t.root.walk():
        for s in (block["body"] or []) if block.type in BLOCKS else []:
            if s.type in LOCALS and len(s["declarators"]) == 1:
                d = s["declarators"][0]
                type = t.source(s["type"])
                if to == "5.1" and d["dims"] and len(d["dims"]) == 1 and d["dims"][0] is not None and d["value"] is None and "static" not in type and not has(block, "sizeof_expression"):
                    yield s.start, s.end, f"{type} *{d['name'].text} = ({type} *)malloc({parens(t, d['dims'][0])} * sizeof({type}));"
                elif to == "5.2" and d["value"] is not None and (m := re.fullmatch(r"\(\s*(\w+)\s*\*\s*\)\s*malloc\s*\(\s*(\d+)\s*\*\s*sizeof\s*\(\s*\1\s*\)\s*\)", t.source(d["value"]))) and not re.search(rf"\b(?:free|realloc)\s*\(\s*{d['name'].text}\b|return\s+{d['name'].text}\b", t.source(block)):
                    yield s.start, s.end, f"{m[1]} {d['name'].text}[{m[2]}];"


def parts_of(name: str) -> list[str]:
    return re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", name)


RENAMES: dict[str, Callable[[str, str], str]] = {
    "0.1": lambda n, _: "".join(p.lower() if i == 0 else p.capitalize() for i, p in enumerate(parts_of(n))),
    "0.2": lambda n, _: "".join(p.capitalize() for p in parts_of(n)),
    "0.3": lambda n, _: "_".join(p.lower() for p in parts_of(n)),
    "0.4": lambda n, base: n if n.lower().startswith(base) and len(n) > len(base) else base + (n[:1].upper() + n[1:]),
    "0.5": lambda n, _: n if n.startswith("_") else f"_{n}",
    "0.6": lambda n, _: n if n.startswith("$") else f"${n}",
    "upper": lambda n, _: n.upper(),
    "lower": lambda n, _: n.lower(),
}


def _rename(t: Tree, to: str) -> Iterator[Edit]:
    """Local variables and parameters, each everywhere; names of the outside (functions, fields, types) stay."""
    local: dict[str, str] = {}
    fields = set()
    for n in t.root.walk():
        if n.type == "field_declaration":
            fields |= {d["name"].text if d["name"] else d.text for d in n["declarators"]}
        elif n.type in LOCALS or n.type == "parameter":
            base = re.sub(r"\W.*", "", t.source(n["type"]).split()[-1].lower()) if n["type"] is not None else ""
            for d in n["declarators"] or ([n] if n["name"] is not None else []):
                name = d["name"].text if d["name"] else d.text
                if name:
                    local.setdefault(name, base or "var")
    if t.lang == "c":  # a declaration outside of functions is visible elsewhere
        for n in t.root.children:
            if n.type in LOCALS:
                fields |= {d["name"].text if d["name"] else d.text for d in n["declarators"]}
    taken = {x.text for x in t.root.walk() if x.text}
    new: dict[str, str] = {}
    for name, base in local.items():
        to_name = RENAMES[to](name, base)
        if name in fields or to_name == name or not re.fullmatch(r"[A-Za-z_$][\w$]*", to_name) or to_name in taken or to_name in RESERVED | PRIMITIVE or to_name in new.values() or "$" in to_name and t.lang == "c_sharp":
            continue
        new[name] = to_name
    for n in t.root.walk():
        if n.type == "identifier" and n.text in new:
            yield n.start, n.end, new[n.text]


RULES: dict[str, Callable[[Tree, str], Iterator[Edit]]] = {
    **dict.fromkeys(RENAMES, _rename),
    **dict.fromkeys(("1.1", "1.2"), _braces),
    **dict.fromkeys(("2.1", "2.2"), _augmented),
    **dict.fromkeys(("3.1", "3.2", "3.3", "3.4"), _comparison),
    **dict.fromkeys(("4.1", "4.2", "4.3", "4.4"), _step),
    **dict.fromkeys(("5.1", "5.2"), _heap),
    **dict.fromkeys(("6.1", "6.2"), _array_access),
    **dict.fromkeys(("7.1", "7.2"), _declare_lines),
    **dict.fromkeys(("8.1", "8.2"), _declare_position),
    **dict.fromkeys(("9.1", "9.2"), _declare_assign),
    **dict.fromkeys(SLOTS, _for_slots),
    **dict.fromkeys(("11.1", "11.2", "11.3", "11.4", "12.4"), _loop_kind),
    **dict.fromkeys(("14.1", "14.2"), _exclamation),
    **dict.fromkeys(("16.1", "16.2"), _switch),
    **dict.fromkeys(("17.1", "17.2"), _nested),
    **dict.fromkeys(("18.1",), _else),
}
#: Styles that another pass would change again.
ONE_PASS = {"0.4", "0.5", "0.6", "8.1"}


def normalize(code: str, lang: str, styles: list[str]) -> tuple[str, list[bool]]:
    """code rewritten towards each style in turn, until nothing changes any more, and whether each changed more than white space. 0.0 changes nothing; programs
    that don't parse, and styles without a rewrite, stay as they are."""
    changed = []
    for style in styles:
        before = code
        seen = {code}
        while style in RULES:
            tree = parse(code, lang)
            if tree.errors:
                break
            edits = list(RULES[style](tree, style))
            new = apply_edits(code, edits)
            if new in seen or parse(new, lang).errors:
                break
            code = new
            if style in ONE_PASS:
                break
            seen.add(code)
            if len(seen) > len(before) + 2:  # each pass mends one level at least, and there are fewer levels than characters
                raise RuntimeError(f"style {style} never settles")
        changed.append(re.sub(r"\s", "", before) != re.sub(r"\s", "", code))
    return code, changed

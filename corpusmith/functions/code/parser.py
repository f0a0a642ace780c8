"""A small hand-written parser for a common subset of C, Java and C#.

It reads every program: what it doesn't understand becomes an ERROR node that reaches to the next ; or }, and the tree remembers
that it has one. Offsets are in characters. Node types bear the names of the public grammars of each language where they differ.
"""

from __future__ import annotations

import contextlib
import re
import sys
from collections.abc import Iterator

# Keywords that begin or modify types, per language family.
PRIMITIVE = set("void char short int long float double signed unsigned bool boolean byte sbyte uint ulong ushort string object decimal var auto size_t wchar_t".split())
MODIFIERS = set("public private protected internal static final const abstract sealed virtual override readonly volatile transient synchronized native strictfp extern inline register async partial unsafe default ref out in params typedef restrict".split())
RESERVED = set(
    "if else for while do switch case break continue return goto try catch finally throw throws new class struct enum interface union namespace package import using sizeof instanceof is as null true false this super base foreach lock yield await typeof default extends implements".split()
)
#: Words that name nothing.
WORDS = RESERVED | PRIMITIVE | MODIFIERS
BINARY = {"||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "instanceof": 7, "is": 7, "as": 7, "<<": 8, ">>": 8, ">>>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10, "??": 1}
ASSIGN = set("= += -= *= /= %= &= |= ^= <<= >>= >>>= ??=".split())

NAMES = {
    "c": {"root": "translation_unit", "block": "compound_statement", "local": "declaration", "declarator": "init_declarator", "function": "function_definition", "call": "call_expression", "index": "subscript_expression", "member": "field_expression", "foreach": "for_range_loop", "prefix": "update_expression", "postfix": "update_expression", "parameters": "parameter_list", "switch": "switch_statement", "ternary": "conditional_expression"},
    "java": {"root": "program", "block": "block", "local": "local_variable_declaration", "declarator": "variable_declarator", "function": "method_declaration", "call": "method_invocation", "index": "array_access", "member": "field_access", "foreach": "enhanced_for_statement", "prefix": "update_expression", "postfix": "update_expression", "parameters": "formal_parameters", "switch": "switch_expression", "ternary": "ternary_expression"},
    "c_sharp": {"root": "compilation_unit", "block": "block", "local": "local_declaration_statement", "declarator": "variable_declarator", "function": "method_declaration", "call": "invocation_expression", "index": "element_access_expression", "member": "member_access_expression", "foreach": "for_each_statement", "prefix": "prefix_unary_expression", "postfix": "postfix_unary_expression", "parameters": "parameter_list", "switch": "switch_statement", "ternary": "conditional_expression"},
}

_lex = re.compile(
    r"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<pre>(?m:^)[ \t]*\#(?:[^\n\\]|\\.|\\\n)*)"
    r"|(?P<string>@\"(?:[^\"]|\"\")*\"|\$?\"(?:[^\"\\\n]|\\.)*\"|\"\"\".*?\"\"\")|(?P<char>'(?:[^'\\\n]|\\.)+')"
    r"|(?P<number>0[xXbB][0-9a-fA-F_]+[uUlL]*|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[fFdDlLuUmM]*)|(?P<name>[^\W\d][\w$]*|[$@][\w$]+|\$)"
    r"|(?P<op>>>>=|<<=|>>=|>>>|\.\.\.|\?\?=|->|=>|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|::|\?\?|[-+*/%=<>!~?:;,.(){}\[\]&|^@\#\\`])|(?P<bad>.)",
    re.S,
)


class Node:
    __slots__ = ("type", "start", "end", "children", "fields", "text")

    def __init__(self, type: str, start: int, end: int, children: list[Node] | None = None, /, text: str | None = None, **fields):
        self.type, self.start, self.end, self.children, self.text = type, start, end, children or [], text
        self.fields = {k: v for k, v in fields.items() if v is not None}

    def __getitem__(self, name: str):
        return self.fields.get(name)

    def walk(self) -> Iterator[Node]:
        """Preorder, without recursion."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.children))


class Token:
    __slots__ = ("kind", "text", "start", "end")

    def __init__(self, kind: str, text: str, start: int, end: int):
        self.kind, self.text, self.start, self.end = kind, text, start, end


def lex(code: str) -> list[Token]:
    return [Token(m.lastgroup, m[0], *m.span()) for m in _lex.finditer(code) if m.lastgroup not in ("space", "comment")]


class Tree:
    def __init__(self, root: Node, code: str, lang: str, errors: int):
        self.root, self.code, self.lang, self.errors = root, code, lang, errors

    def source(self, n: Node) -> str:
        return self.code[n.start : n.end]


class _Stop(Exception):
    pass


class Parser:
    def __init__(self, code: str, lang: str):
        self.code, self.lang, self.n = code, lang, NAMES[lang]
        self.toks = lex(code)
        self.i = 0
        self.errors = sum(t.kind == "bad" for t in self.toks)
        self.match = {}
        stack = []
        for k, t in enumerate(self.toks):
            if t.kind == "op" and t.text in "([{":
                stack.append(k)
            elif t.kind == "op" and t.text in ")]}" and stack and self.toks[stack[-1]].text + t.text in ("()", "[]", "{}"):
                self.match[stack.pop()] = k

    # tokens

    def peek(self, k: int = 0) -> str:
        i = self.i + k
        return self.toks[i].text if i < len(self.toks) else ""

    def kind(self, i: int) -> str:
        return self.toks[i].kind if i < len(self.toks) else ""

    def text(self, i: int) -> str:
        return self.toks[i].text if i < len(self.toks) else ""

    def leaf(self, type: str | None = None) -> Node:
        if self.i >= len(self.toks):
            raise _Stop
        t = self.toks[self.i]
        self.i += 1
        if type is None:
            type = {"number": "number_literal", "string": "string_literal", "char": "character_literal"}.get(t.kind) or ("identifier" if t.kind == "name" and t.text not in WORDS else t.text)
        return Node(type, t.start, t.end, text=t.text)

    def expect(self, text: str) -> Node:
        if self.peek() != text:
            raise _Stop
        return self.leaf(text)

    def node(self, type: str, children: list[Node], /, **fields) -> Node:
        return Node(type, children[0].start, children[-1].end, children, **fields)

    # types and declarations

    def type_end(self, i: int) -> int | None:
        """Behind a type that begins at token i, modifiers included."""
        toks = self.toks
        while i < len(toks):
            if self.text(i) == "@" and self.kind(i + 1) == "name" or toks[i].text.startswith("@") and toks[i].kind == "name":
                i += 2 if toks[i].text == "@" else 1
                if self.text(i) == "(":
                    i = self.match.get(i, len(toks)) + 1
            elif self.text(i) == "[" and self.lang == "c_sharp" and i in self.match:
                i = self.match[i] + 1
            elif self.text(i) in MODIFIERS:
                i += 1
            else:
                break
        start = i
        if self.text(i) == "<" and self.lang == "java":
            i = self.generic_end(i) or i
        if self.text(i) in ("struct", "union", "enum") and self.kind(i + 1) == "name":
            i += 2
        elif self.text(i) in PRIMITIVE:
            while self.text(i) in PRIMITIVE or self.text(i) in ("const",):
                i += 1
        elif self.kind(i) == "name" and self.text(i) not in RESERVED:
            i += 1
            while self.text(i) in (".", "::") and self.kind(i + 1) == "name":
                i += 2
        else:
            return None
        if self.text(i) == "<":
            end = self.generic_end(i)
            if end is None:
                return None
            i = end
        while True:
            if self.text(i) in ("*", "const", "restrict") and self.lang != "java" or self.text(i) == "?" and self.lang == "c_sharp" or self.text(i) == "..." or self.text(i) == "&" and self.lang == "c":
                i += 1
            elif self.text(i) == "[" and self.text(i + 1) in ("]", ",") and i in self.match:
                i = self.match[i] + 1
            else:
                return i if i > start else None

    def generic_end(self, i: int) -> int | None:
        depth = 0
        while i < len(self.toks):
            t = self.toks[i]
            if t.text == "<":
                depth += 1
            elif t.text == ">":
                depth -= 1
                if depth == 0:
                    return i + 1
            elif t.text == ">>>":
                depth -= 3
                if depth == 0:
                    return i + 1
            elif t.kind != "name" and t.text not in (",", ".", "?", "[", "]", "&"):
                return None
            i += 1
        return None

    def type_node(self, end: int) -> Node:
        parts = []
        while self.i < end:
            parts.append(self.leaf("type_identifier" if self.kind(self.i) == "name" and self.peek() not in PRIMITIVE | MODIFIERS else None))
        return self.node("type", parts)

    def declaration_ahead(self) -> int | None:
        """Behind the type, if a declaration of variables begins here."""
        end = self.type_end(self.i)
        if end is None or self.kind(end) != "name" or self.text(end) in RESERVED:
            return None
        return end if self.text(end + 1) in ("=", ";", ",", "[", ":", "in") else None

    def declarators(self) -> list[Node]:
        out = []
        while True:
            stars = []
            while self.peek() == "*" and self.lang != "java":
                stars.append(self.leaf("*"))
            if self.kind(self.i) != "name":
                raise _Stop
            name = self.leaf("identifier")
            parts, dims, value = [*stars, name], [], None
            while self.peek() == "[":
                parts.append(self.leaf("["))
                if self.peek() != "]":
                    size = self.expression()
                    parts.append(size)
                    dims.append(size)
                else:
                    dims.append(None)
                parts.append(self.expect("]"))
            if self.peek() == "=":
                parts.append(self.leaf("="))
                value = self.initializer()
                parts.append(value)
            kind = self.n["declarator"] if value is not None or self.lang != "c" else "array_declarator" if dims else "pointer_declarator" if stars else "identifier"
            out.append(name if kind == "identifier" else self.node(kind, parts, name=name, value=value, dims=dims or None))
            if self.peek() != ",":
                return out
            out.append(self.leaf(","))

    def initializer(self) -> Node:
        if self.peek() != "{":
            return self.expression()
        parts = [self.leaf("{")]
        while self.peek() != "}":
            if self.peek() == "." and self.kind(self.i + 1) == "name":
                parts += [self.leaf("."), self.leaf("identifier"), self.expect("=")]
            parts.append(self.initializer())
            if self.peek() == ",":
                parts.append(self.leaf(","))
            elif self.peek() != "}":
                raise _Stop
        return self.node("initializer_list", [*parts, self.leaf("}")])

    def declaration(self, end: int, kind: str | None = None, closed: bool = True) -> Node:
        type = self.type_node(end)
        declared = self.declarators()
        parts = [type, *declared]
        if closed:
            parts.append(self.expect(";"))
        return self.node(kind or self.n["local"], parts, type=type, declarators=[d for d in declared if d.type != ","])

    def parameters(self) -> Node:
        parts = [self.expect("(")]
        while self.peek() != ")":
            if self.peek() == "...":
                parts.append(self.leaf("..."))
            else:
                end = self.type_end(self.i)
                if end is None:
                    raise _Stop
                type = self.type_node(end)
                one = [type]
                name = None
                if self.kind(self.i) == "name":
                    name = self.leaf("identifier")
                    one.append(name)
                    while self.peek() == "[":
                        one.append(self.leaf("["))
                        if self.peek() != "]":
                            one.append(self.expression())
                        one.append(self.expect("]"))
                    if self.peek() == "=":
                        one += [self.leaf("="), self.expression()]
                elif self.peek() == "(" and self.i in self.match:  # a pointer to a function
                    close = self.match[self.i]
                    while self.i <= close:
                        one.append(self.leaf())
                    if self.peek() == "(":
                        close = self.match.get(self.i, self.i)
                        while self.i <= close:
                            one.append(self.leaf())
                parts.append(self.node("parameter", one, type=type, name=name))
            if self.peek() == ",":
                parts.append(self.leaf(","))
            elif self.peek() != ")":
                raise _Stop
        return self.node(self.n["parameters"], [*parts, self.leaf(")")])

    # expressions

    def expression(self) -> Node:
        left = self.ternary()
        if self.peek() in ASSIGN:
            op = self.leaf()
            right = self.initializer() if self.peek() == "{" else self.expression()
            return self.node("assignment_expression", [left, op, right], left=left, op=op, right=right)
        # >> = of generics never gets here: the lexer leaves >> as two tokens
        return left

    def comma_expression(self) -> Node:
        parts = [self.expression()]
        while self.peek() == ",":
            parts += [self.leaf(","), self.expression()]
        return parts[0] if len(parts) == 1 else self.node("comma_expression", parts)

    def ternary(self) -> Node:
        cond = self.binary(0)
        if self.peek() != "?":
            return cond
        q = self.leaf("?")
        yes = self.expression()
        colon = self.expect(":")
        no = self.expression()
        return self.node(self.n["ternary"], [cond, q, yes, colon, no], condition=cond)

    def operator(self) -> str:
        t = self.peek()
        if t == ">" and self.peek(1) == ">" and self.toks[self.i].end == self.toks[self.i + 1].start:
            return ">>"
        return t

    def binary(self, least: int) -> Node:
        left = self.unary()
        while True:
            op = self.operator()
            rank = BINARY.get(op, 0)
            if rank <= least:
                return left
            sign = self.leaf(op if op != ">>" else ">>")
            if op == ">>":
                sign.end = self.leaf().end
                sign.text = ">>"
            if op in ("instanceof", "is", "as"):
                end = self.type_end(self.i)
                if end is None:
                    raise _Stop
                right = self.type_node(end)
                parts = [left, sign, right]
                if self.kind(self.i) == "name" and self.peek() not in RESERVED:
                    parts.append(self.leaf("identifier"))
                left = self.node("instanceof_expression", parts)
                continue
            right = self.binary(rank)
            left = self.node("binary_expression", [left, sign, right], left=left, op=sign, right=right)

    def cast_end(self) -> int | None:
        """Behind the type of a cast whose ( is here."""
        end = self.type_end(self.i + 1)
        if end is None or self.text(end) != ")":
            return None
        after, first = end + 1, self.text(self.i + 1)
        if first in PRIMITIVE or self.text(end - 1) in ("*", "]", ">") or first in ("struct", "const"):
            return end if self.kind(after) in ("name", "number", "string", "char") or self.text(after) in ("(", "-", "+", "!", "~", "&", "*", "{", "++", "--") else None
        return end if self.kind(after) in ("number", "string", "char") or self.kind(after) == "name" and self.text(after) not in ("instanceof", "is", "as") or self.text(after) in ("!", "~") else None

    def unary(self) -> Node:
        t = self.peek()
        if t in ("++", "--"):
            op = self.leaf()
            arg = self.unary()
            return self.node(self.n["prefix"], [op, arg], op=op, argument=arg, prefix=True)
        if t in ("+", "-", "!", "~"):
            op = self.leaf()
            arg = self.unary()
            return self.node("unary_expression", [op, arg], op=op, argument=arg)
        if t in ("*", "&") and self.lang != "java":
            op = self.leaf()
            arg = self.unary()
            return self.node("pointer_expression", [op, arg], op=op, argument=arg)
        if t in ("await", "throw") and self.lang == "c_sharp":
            op = self.leaf()
            return self.node("await_expression", [op, self.unary()])
        if t == "(":
            close = self.match.get(self.i)
            if close is not None and self.text(close + 1) in ("->", "=>") and self.lang != "c":
                params = self.node("lambda_parameters", [self.leaf() for _ in range(close + 1 - self.i)])
                return self.lambda_from(params)
            if (end := self.cast_end()) is not None:
                open_ = self.leaf("(")
                type = self.type_node(end)
                close_ = self.leaf(")")
                arg = self.initializer() if self.peek() == "{" else self.unary()
                return self.node("cast_expression", [open_, type, close_, arg], argument=arg)
        if t == "sizeof":
            op = self.leaf("sizeof")
            if self.peek() == "(" and (end := self.type_end(self.i + 1)) is not None and self.text(end) == ")":
                return self.node("sizeof_expression", [op, self.leaf("("), self.type_node(end), self.leaf(")")])
            return self.node("sizeof_expression", [op, self.unary()])
        return self.postfix(self.primary())

    def lambda_from(self, params: Node) -> Node:
        arrow = self.leaf()
        body = self.block() if self.peek() == "{" else self.expression()
        return self.node("lambda_expression", [params, arrow, body], body=body)

    def primary(self) -> Node:
        kind, t = self.kind(self.i), self.peek()
        if t == "(":
            open_ = self.leaf("(")
            inner = self.comma_expression()
            return self.node("parenthesized_expression", [open_, inner, self.expect(")")], inner=inner)
        if t == "new":
            new = self.leaf("new")
            parts = [new]
            if self.peek() not in ("(", "[", "{"):
                end = self.type_end(self.i)
                if end is None:
                    raise _Stop
                parts.append(self.type_node(end))
            while self.peek() == "[":
                parts.append(self.leaf("["))
                if self.peek() != "]":
                    parts.append(self.expression())
                parts.append(self.expect("]"))
            if self.peek() == "(":
                parts.append(self.arguments())
            if self.peek() == "{":
                parts.append(self.initializer() if self.text(self.i + 1) == "}" or not self.class_like() else self.class_body())
            return self.node("object_creation_expression", parts)
        if kind in ("number", "string", "char"):
            node = self.leaf()
            while node.type == "string_literal" and self.kind(self.i) == "string":
                more = self.leaf()
                node = Node("string_literal", node.start, more.end, text=self.code[node.start : more.end])
            return node
        if kind == "name" and (t not in RESERVED or t in ("this", "super", "base", "null", "true", "false", "typeof", "default")):
            if self.peek(1) in ("->", "=>") and self.lang != "c" and t not in RESERVED:
                return self.lambda_from(self.leaf("identifier"))
            if t in PRIMITIVE and self.peek(1) not in (".", "[", "::", ")"):
                raise _Stop
            return self.leaf()
        if t == "{":
            return self.initializer()
        raise _Stop

    def class_like(self) -> bool:
        """A { after new begins the body of an anonymous class, not a list of values."""
        end = self.type_end(self.i + 1)
        return end is not None and self.kind(end) == "name"

    def arguments(self) -> Node:
        parts = [self.expect("(")]
        while self.peek() != ")":
            if self.peek() in ("ref", "out", "in"):
                parts.append(self.leaf())
            end = self.type_end(self.i)
            if end is not None and self.text(end) in (")", ",") and (self.text(end - 1) == "*" or self.peek() in PRIMITIVE | {"struct"}):
                parts.append(self.type_node(end))
            else:
                parts.append(self.expression())
            if self.peek() == ",":
                parts.append(self.leaf(","))
            elif self.peek() != ")":
                raise _Stop
        return self.node("argument_list", [*parts, self.leaf(")")])

    def postfix(self, left: Node) -> Node:
        while True:
            t = self.peek()
            if t == "(":
                args = self.arguments()
                left = self.node(self.n["call"], [left, args], function=left, arguments=args)
            elif t == "[":
                open_ = self.leaf("[")
                index = self.comma_expression() if self.peek() != "]" else None
                close = self.expect("]")
                left = self.node(self.n["index"], [left, open_, *([index] if index else []), close], array=left, index=index)
            elif t in (".", "::") or t == "->" and self.lang == "c" or t == "?" and self.peek(1) == "." and self.lang == "c_sharp":
                ops = [self.leaf() for _ in range(1 + (t == "?"))]
                if self.peek() == "<" and (end := self.generic_end(self.i)):
                    ops += [self.leaf() for _ in range(end - self.i)]
                if self.kind(self.i) != "name":
                    raise _Stop
                name = self.leaf("new" if self.peek() == "new" else "field_identifier")
                left = self.node(self.n["member"], [left, *ops, name], object=left)
                if self.peek() == "<" and (end := self.generic_end(self.i)) and self.text(end) == "(":
                    left = self.node("generic_name", [left, *[self.leaf() for _ in range(end - self.i)]])
            elif t in ("++", "--"):
                op = self.leaf()
                left = self.node(self.n["postfix"], [left, op], op=op, argument=left, prefix=False)
            else:
                return left

    # statements

    def block(self) -> Node:
        parts = [self.expect("{")]
        body = []
        while self.peek() != "}":
            if self.i >= len(self.toks):
                self.errors += 1
                return self.node(self.n["block"], parts + body, body=body)
            body.append(self.safe(self.statement))
        return self.node(self.n["block"], [*parts, *body, self.leaf("}")], body=body)

    def safe(self, parse) -> Node:
        """What `parse` reads; where it fails an ERROR node up to the next ; or in front of the next }."""
        start, errors = self.i, self.errors
        try:
            return parse()
        except _Stop:
            self.i, self.errors = start, errors + 1
            parts = []
            while self.i < len(self.toks):
                t = self.peek()
                if t == "}" and parts:
                    break
                close = self.match.get(self.i)
                if t in "({[" and t and close is not None:
                    while self.i <= close:
                        parts.append(self.leaf())
                    if t == "{":
                        break
                    continue
                parts.append(self.leaf())
                if t in (";", "}"):
                    break
            return self.node("ERROR", parts)

    def condition(self) -> Node:
        open_ = self.expect("(")
        inner = self.comma_expression()
        return self.node("parenthesized_expression", [open_, inner, self.expect(")")], inner=inner)

    def statement(self) -> Node:
        t = self.peek()
        if self.kind(self.i) == "pre":
            return self.leaf("preproc_directive")
        if t == "{":
            return self.block()
        if t == ";":
            return self.leaf("empty_statement")
        if t == "if":
            return self.if_statement()
        if t == "for":
            return self.for_statement()
        if t == "foreach":
            head, open_ = self.leaf("foreach"), self.expect("(")
            return self.foreach([head, open_])
        if t == "while":
            head = self.leaf("while")
            cond = self.condition()
            body = self.statement()
            return self.node("while_statement", [head, cond, body], condition=cond, body=body)
        if t == "do":
            head = self.leaf("do")
            body = self.statement()
            parts = [head, body, self.expect("while"), cond := self.condition(), self.expect(";")]
            return self.node("do_statement", parts, body=body, condition=cond)
        if t == "switch":
            return self.switch_statement()
        if t in ("return", "throw", "yield"):
            head = self.leaf(t)
            parts = [head]
            if t == "yield" and self.peek() in ("return", "break"):
                parts.append(self.leaf())
            value = None
            if self.peek() != ";":
                value = self.comma_expression()
                parts.append(value)
            return self.node(f"{t}_statement", [*parts, self.expect(";")], value=value)
        if t in ("break", "continue", "goto"):
            parts = [self.leaf(t)]
            while self.peek() not in (";", "}") and self.i < len(self.toks):
                parts.append(self.leaf())
            return self.node(f"{t}_statement", [*parts, self.expect(";")])
        if t == "try":
            parts = [self.leaf("try")]
            if self.peek() == "(":
                close = self.match.get(self.i, self.i)
                parts.append(self.node("resource_specification", [self.leaf() for _ in range(close + 1 - self.i)]))
            parts.append(self.block())
            while self.peek() in ("catch", "finally"):
                parts.append(self.leaf())
                while self.peek() in ("(", "when") and self.i < len(self.toks):
                    if self.peek() == "when":
                        parts.append(self.leaf("when"))
                    close = self.match.get(self.i, self.i)
                    parts.append(self.node("catch_formal_parameter", [self.leaf() for _ in range(close + 1 - self.i)]))
                parts.append(self.block())
            return self.node("try_statement", parts)
        if t in ("synchronized", "lock", "using", "fixed", "checked", "unsafe") and self.peek(1) in ("(", "{"):
            parts = [self.leaf(t)]
            if self.peek() == "(":
                close = self.match.get(self.i, self.i)
                parts.append(self.node("header", [self.leaf() for _ in range(close + 1 - self.i)]))
            return self.node(f"{t}_statement", [*parts, self.statement()])
        if t in ("case", "default") and self.peek(1) != "(":
            raise _Stop
        if self.kind(self.i) == "name" and self.peek(1) == ":" and t not in RESERVED:
            return self.node("labeled_statement", [self.leaf("statement_identifier"), self.leaf(":"), self.statement() if self.peek() != "}" else Node("empty_statement", self.toks[self.i - 1].end, self.toks[self.i - 1].end)])
        if (item := self.definition()) is not None:
            return item
        if (end := self.declaration_ahead()) is not None:
            return self.declaration(end)
        e = self.comma_expression()
        return self.node("expression_statement", [e, self.expect(";")], expression=e)

    def if_statement(self) -> Node:
        # An else-if chain is read in a loop, so its length doesn't deepen the stack.
        heads = []
        while True:
            parts = [self.expect("if"), cond := self.condition(), then := self.statement()]
            heads.append((parts, cond, then))
            if self.peek() != "else":
                last = None
                break
            word = self.leaf("else")
            if self.peek() == "if":
                parts.append(word)
                continue
            parts.append(word)
            last = self.statement()
            break
        node = last
        for parts, cond, then in reversed(heads):
            if node is None:
                node = self.node("if_statement", parts, condition=cond, then=then)
            else:
                node = self.node("if_statement", [*parts, node], condition=cond, then=then, otherwise=node)
        return node

    def foreach(self, parts: list[Node]) -> Node:
        end = self.type_end(self.i)
        if end is None:
            raise _Stop
        parts += [self.type_node(end), name := self.leaf("identifier")]
        if self.peek() not in (":", "in"):
            raise _Stop
        parts += [self.leaf(), value := self.expression(), self.expect(")"), body := self.statement()]
        return self.node(self.n["foreach"], parts, name=name, value=value, body=body)

    def for_statement(self) -> Node:
        head, open_ = self.leaf("for"), self.expect("(")
        end = self.type_end(self.i)
        if end is not None and self.kind(end) == "name" and self.text(end + 1) == ":":
            return self.foreach([head, open_])
        parts, init, cond, update = [head, open_], None, None, None
        if self.peek() != ";":
            end = self.declaration_ahead()
            if end is not None:
                init = self.declaration(end, closed=False)
            else:
                init = self.comma_expression()
            parts.append(init)
        parts.append(self.expect(";"))
        if self.peek() != ";":
            cond = self.comma_expression()
            parts.append(cond)
        parts.append(self.expect(";"))
        if self.peek() != ")":
            update = self.comma_expression()
            parts.append(update)
        parts.append(self.expect(")"))
        body = self.statement()
        return self.node("for_statement", [*parts, body], initializer=init, condition=cond, update=update, body=body)

    def switch_statement(self) -> Node:
        parts = [self.leaf("switch"), value := self.condition(), self.expect("{")]
        cases = []
        while self.peek() != "}":
            if self.peek() not in ("case", "default"):
                raise _Stop
            one = [self.leaf()]
            label = None
            if one[0].type == "case":
                label = self.ternary_label()
                one.append(label)
                while self.peek() == ",":
                    one += [self.leaf(","), self.ternary_label()]
            if self.peek() not in (":", "->"):
                raise _Stop
            one.append(self.leaf())
            body = []
            while self.peek() not in ("case", "default", "}") and self.i < len(self.toks):
                body.append(self.safe(self.statement))
            cases.append(self.node("case_statement", one + body, label=label, body=body))
        parts += cases
        return self.node(self.n["switch"], [*parts, self.leaf("}")], value=value, cases=cases)

    def ternary_label(self) -> Node:
        return self.binary(0)

    # definitions

    def definition(self) -> Node | None:
        """A type, function, package or import at this place; None if something else begins."""
        t = self.peek()
        if t in ("package", "import") or t == "using" and self.peek(1) != "(":
            parts = [self.leaf()]
            while self.peek() != ";" and self.i < len(self.toks) and self.peek() not in "{}":
                parts.append(self.leaf())
            return self.node("import_declaration" if t != "package" else "package_declaration", [*parts, self.expect(";")])
        i = self.i
        while i < len(self.toks) and (self.text(i) in MODIFIERS or self.text(i).startswith("@") or self.text(i) == "[" and self.lang == "c_sharp" and i in self.match):
            if self.text(i) == "[":
                i = self.match[i] + 1
                continue
            i += 1 + (self.text(i) == "@")
            if self.text(i) == "(" and self.text(i - 1) not in MODIFIERS:
                i = self.match.get(i, i) + 1
        word = self.text(i)
        if word in ("class", "interface", "namespace", "struct", "union", "enum") and (self.kind(i + 1) == "name" or self.text(i + 1) == "{"):
            j = i + 1
            while j < len(self.toks) and self.text(j) not in ("{", ";", "=", "(", ")"):
                j += 1
            if self.text(j) == "{" and (word in ("class", "interface", "namespace") or j <= i + 2 or self.lang != "c"):
                parts = [self.leaf() for _ in range(j - self.i)]
                body = self.enum_body() if word == "enum" else self.class_body()
                parts.append(body)
                if self.lang == "c":
                    while self.peek() not in (";", "") and self.kind(self.i) in ("name", "op") and self.peek() not in "{}":
                        parts.append(self.leaf())
                    parts.append(self.expect(";"))
                elif self.peek() == ";":
                    parts.append(self.leaf(";"))
                return self.node(f"{word}_declaration", parts, body=body)
        if self.kind(i) == "name" and self.text(i + 1) == "(" and i > self.i and word not in RESERVED:  # a constructor with modifiers
            return self.function(i)
        end = self.type_end(self.i)
        if end is not None and self.kind(end) == "name" and self.text(end) not in RESERVED and self.text(end + 1) == "(" and (end + 1) in self.match:
            after = self.text(self.match[end + 1] + 1)
            if after in ("{", "throws") or after == "=>" and self.lang == "c_sharp" or after == ";" and (self.text(self.i) in MODIFIERS | PRIMITIVE or self.lang == "c"):
                return self.function(end)
        return None

    def function(self, name_at: int) -> Node:
        parts = []
        type = None
        if name_at > self.i:
            type = self.type_node(name_at)
            parts.append(type)
        name = self.leaf("identifier")
        params = self.parameters()
        parts += [name, params]
        if self.peek() == "throws" or self.peek() == ":" and self.lang == "c_sharp":
            while self.peek() not in ("{", ";") and self.i < len(self.toks):
                parts.append(self.leaf())
        body = None
        if self.peek() == "{":
            body = self.block()
            parts.append(body)
        elif self.peek() == "=>":
            parts += [self.leaf("=>"), self.expression(), self.expect(";")]
        else:
            parts.append(self.expect(";"))
        return self.node(self.n["function"], parts, type=type, name=name, parameters=params, body=body)

    def class_body(self) -> Node:
        parts = [self.expect("{")]
        while self.peek() != "}":
            if self.i >= len(self.toks):
                self.errors += 1
                return self.node("class_body", parts)
            parts.append(self.safe(self.member))
        return self.node("class_body", [*parts, self.leaf("}")])

    def enum_body(self) -> Node:
        close = self.match.get(self.i)
        if close is None:
            raise _Stop
        return self.node("enum_body", [self.leaf() for _ in range(close + 1 - self.i)])

    def member(self) -> Node:
        if self.kind(self.i) == "name" and self.peek(1) == "(" and self.peek() not in RESERVED | PRIMITIVE and self.text(self.match.get(self.i + 1, 0) + 1) in ("{", "throws", ":"):
            return self.function(self.i)
        if (item := self.definition()) is not None:
            return item
        end = self.declaration_ahead()
        if end is not None:
            return self.declaration(end, "field_declaration")
        end = self.type_end(self.i)
        if self.lang == "c_sharp" and end is not None and self.kind(end) == "name" and self.text(end + 1) in ("{", "=>"):  # a property
            parts = [self.type_node(end), self.leaf("identifier")]
            if self.peek() == "=>":
                return self.node("property_declaration", [*parts, self.leaf("=>"), self.expression(), self.expect(";")])
            close = self.match.get(self.i)
            if close is None:
                raise _Stop
            parts.append(self.node("accessor_list", [self.leaf() for _ in range(close + 1 - self.i)]))
            if self.peek() == "=":
                parts += [self.leaf("="), self.expression(), self.expect(";")]
            return self.node("property_declaration", parts)
        if self.peek() == "static" and self.peek(1) == "{":
            return self.node("static_initializer", [self.leaf("static"), self.block()])
        return self.statement()

    def parse(self) -> Node:
        items = []
        while self.i < len(self.toks):
            items.append(self.safe(self.member))
        return Node(self.n["root"], 0, len(self.code), items)


@contextlib.contextmanager
def deep(frames: int):
    """Room for so many more frames: walks over deep programs are recursive, and frames of Python lie on the heap."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, 2000 + frames))
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


def parse(code: str, lang: str) -> Tree:
    """The tree of a program, however deep; lang is c, java or c_sharp."""
    p = Parser(code, lang)
    with deep(40 * len(p.toks)):
        root = p.parse()
    return Tree(root, code, lang, p.errors)

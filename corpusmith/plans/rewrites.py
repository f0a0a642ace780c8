"""Queries that rewrite programs towards each style, family by family, in all three languages.

Each row of part is a program around one statement; which statement, and in which language, follows from p_partkey, and a number in it from p_size.
SQL says from the same cases what comes out, and how often the style is found before and after.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import functions as F

from corpusmith.functions.code import udfs
from corpusmith.operators import layout
from corpusmith.plans.programs import query
from corpusmith.plans.relational import QUERIES, table  # noqa: F401

ALL = ("c", "java", "c_sharp")
MANAGED = ("java", "c_sharp")

# Fixed values, by family: style, languages, a statement, what it becomes, and how often it has the style before and after. # is a number.
FAMILIES: dict[str, list[tuple[str, tuple[str, ...], str, str, int, int]]] = {
    "0": [
        ("0.1", ALL, "int my_var = #; s += my_var;", "int myVar = #; s += myVar;", 0, 2),
        ("0.2", ALL, "int my_var = #; s += my_var;", "int MyVar = #; S += MyVar;", 0, 2),
        ("0.3", ALL, "int myVar = #; s += myVar;", "int my_var = #; s += my_var;", 0, 2),
        ("0.5", ALL, "int k = #; g(k);", "int _k = #; g(_k);", 0, 4),
        ("0.6", MANAGED[:1], "int k = #; g(k);", "int $k = #; g($k);", 0, 4),
        ("0.6", MANAGED[1:], "int k = #; g(k);", "int k = #; g(k);", 0, 0),
    ],
    "1": [
        ("1.1", ALL, "if (s > #) { g(s); }", "if (s > #) g(s);", 0, 1),
        ("1.2", ALL, "while (s > #) s--;", "while (s > #) { s--; }", 0, 1),
    ],
    "2": [
        ("2.1", ALL, "s += #;", "s = s + #;", 0, 1),
        ("2.2", ALL, "s = s * #;", "s *= #;", 0, 1),
        ("2.2", ALL, "s = # - s;", "s = # - s;", 0, 0),
    ],
    "3": [
        ("3.1", ALL, "g(s > #);", "g(# < s);", 0, 1),
        ("3.2", ALL, "g(s <= #);", "g(# >= s);", 0, 1),
        ("3.3", ALL, "g(s != #);", "g(!(s == #));", 0, 1),
        ("3.3", ALL, "g(s <= #);", "g((s < # || s == #));", 0, 1),
        ("3.4", ALL, "g(s == #);", "g(!(s != #));", 0, 1),
        ("3.4", ALL, "g(s > #);", "g((s >= # && s != #));", 0, 1),
    ],
    "4": [
        ("4.1", ALL, "s++; g(#);", "++s; g(#);", 0, 1),
        ("4.2", ALL, "s -= 1; g(#);", "s--; g(#);", 0, 1),
        ("4.3", ALL, "s++; g(#);", "s += 1; g(#);", 0, 1),
        ("4.4", ALL, "++s; g(#);", "s = s + 1; g(#);", 0, 1),
    ],
    "5": [
        ("5.1", ALL[:1], "int a[#]; g(a);", "int *a = (int *)malloc(# * sizeof(int)); g(a);", 0, 1),
        ("5.2", ALL[:1], "int *a = (int *)malloc(# * sizeof(int)); g(a);", "int a[#]; g(a);", 0, 1),
    ],
    "6": [
        ("6.1", ALL[:1], "s = a[#];", "s = (*(a + #));", 0, 1),
        ("6.2", ALL[:1], "s = *(a + #);", "s = a[#];", 0, 1),
    ],
    "7": [
        ("7.1", ALL, "int a = #, b = 2;", "int a = #;\n    int b = 2;", 0, 2),
        ("7.2", ALL, "int a = #; int b = 2;", "int a = #, b = 2;", 0, 1),
    ],
    "8": [
        ("8.1", ALL, "g(#); int v; v = 4;", "int v; g(#);  v = 4;", 0, 1),
        ("8.2", ALL, "int v; g(#); v = 4;", " g(#); int v; v = 4;", 0, 1),
    ],
    "9": [
        ("9.1", ALL, "int i = #;", "int i;\n    i = #;", 0, 1),
        ("9.2", ALL, "int i; i = #;", "int i = #;", 0, 1),
    ],
    "10": [
        ("10.0", ALL, "i = 0; for (;;) { if (i == #) break; g(i); i++; }", "for (i = 0; i != #; i++) {  g(i);  }", 0, 1),
        ("10.1", ALL, "for (i = 0; i < #; i++) { g(i); }", "i = 0;\n    for (; i < #; i++) { g(i); }", 0, 1),
        ("10.2", ALL, "for (i = 0; i < #; i++) { g(i); }", "for (i = 0;; i++) { if (!(i < #)) break; g(i); }", 0, 1),
        ("10.3", ALL, "for (i = 0; i < #; i++) { g(i); }", "for (i = 0; i < #;) { g(i); i++; }", 0, 1),
        ("10.4", ALL, "for (i = 0; i < #; i++) { g(i); }", "for (i = 0;;) { if (!(i < #)) break; g(i); i++; }", 0, 1),
        ("10.5", ALL, "for (; i < #; i++) { g(i); }", "for (; i < #;) { g(i); i++; }", 0, 1),
        ("10.6", ALL, "for (; i < #; i++) { g(i); }", "for (;; i++) { if (!(i < #)) break; g(i); }", 0, 1),
        ("10.7", ALL, "for (; i < #; i++) { g(i); }", "for (;;) { if (!(i < #)) break; g(i); i++; }", 0, 1),
    ],
    "11": [
        ("11.1", ALL, "while (s > #) { s--; }", "for (; s > #;) { s--; }", 0, 1),
        ("11.1", ALL, "do { s--; } while (s > #);", "for (;;) { s--; if (!(s > #)) break; }", 0, 1),
        ("11.2", ALL, "for (i = 0; i < #; i++) { g(i); }", "i = 0;\n    while (i < #) { g(i); i++; }", 0, 1),
        ("11.3", ALL, "while (s > #) { s--; }", "if (s > #) do { s--; } while (s > #);", 0, 1),
        ("11.3", ALL, "for (; i < #; i++) { g(i); }", "if (i < #) do { g(i); i++; } while (i < #);", 0, 1),
        ("11.4", ALL[:1], "while (s > #) { s--; }", "while (1) { if (!(s > #)) break; s--; }", 0, 1),
        ("11.4", MANAGED, "while (s > #) { s--; }", "while (true) { if (!(s > #)) break; s--; }", 0, 1),
        ("12.4", ALL[:1], "for (; i < #; i++) { g(i); }", "while (1) { if (!(i < #)) break; g(i); i++; }", 0, 1),
        ("12.4", MANAGED, "for (; i < #; i++) { g(i); }", "while (true) { if (!(i < #)) break; g(i); i++; }", 0, 1),
    ],
    "14": [
        ("14.1", ALL, "if (!(s == #)) g(s);", "if (s != #) g(s);", 0, 1),
        ("14.2", ALL, "if (s == #) g(s);", "if (!(s != #)) g(s);", 0, 1),
    ],
    "16": [
        ("16.1", ALL, "if (s == #) g(1); else if (s == 99) { g(2); } else g(3);", "switch (s) { case #: g(1); break; case 99: g(2); break; default: g(3); break; }", 0, 1),
        ("16.2", ALL, "switch (s) { case #: g(1); break; case 99: g(2); break; default: g(3); }", "if (s == #) { g(1); } else if (s == 99) { g(2); } else { g(3); }", 0, 1),
    ],
    "17": [
        ("17.1", ALL, "if (s > #) { if (s < 99) g(s); }", "if (s > # && s < 99) g(s);", 0, 1),
        ("17.2", ALL, "if (s > # && s < 99) g(s);", "if (s > #) { if (s < 99) g(s); }", 0, 1),
    ],
    "18": [
        ("18.1", ALL, "if (s > #) { return 1; } else { g(s); }", "if (s > #) { return 1; }\n    g(s);", 0, 1),
    ],
}
HEAD, TAIL = "int f(int s) {\n    ", "\n    return s;\n}\n"


#: The parameter is renamed as well.
PARAMETERS = {"0.2": "S", "0.5": "_s", "0.6": "$s"}


def _framed(lang: str, body: str, parameter: str = "s") -> str:
    function = HEAD.replace("int s", f"int {parameter}") + body + TAIL.replace("return s", f"return {parameter}")
    return function if lang == "c" else f"class A {{\n{function}}}\n"


def _cases(family: str) -> list[tuple[str, str, str, str, int, int]]:
    return list(chain.from_iterable(((style, lang, _framed(lang, a), _framed(lang, b, "s" if a == b else PARAMETERS.get(style, "s")), n, m) for lang in langs) for style, langs, a, b, n, m in FAMILIES[family]))


def _sql(family: str) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, {quoted(style)}, {quoted(lang)}, {quoted(b)}, {n}, {m})" for k, (style, lang, _, b, n, m) in enumerate(_cases(family)))
    return f"""SELECT p_partkey, style, lang, md5(replace(wanted, '#', (2 + p_size)::VARCHAR)) AS code_md5, n_before::INT AS n_before, n_after::INT AS n_after
FROM part JOIN (VALUES {rows}) t(k, style, lang, wanted, n_before, n_after) ON k = p_partkey % {len(_cases(family))}"""


def _rewritten(family: str):
    def run(spark, d):
        cases = _cases(family)
        given = F.array(*[F.struct(F.lit(style).alias("style"), F.lit(lang).alias("lang"), F.lit(a).alias("code")) for style, lang, a, _, _, _ in cases])
        p = layout.spread(table(spark, d, "part").select("p_partkey", "p_size")).select("p_partkey", "p_size", F.get(given, (F.col("p_partkey") % len(cases)).cast("int")).alias("x"))
        p = p.select("p_partkey", "x.style", "x.lang", F.replace("x.code", F.lit("#"), (F.col("p_size") + 2).cast("string")).alias("code"))
        p = p.select("p_partkey", "style", "lang", udfs.restyled(F.col("code"), F.col("lang"), F.array("style")).alias("r"))
        return p.select("p_partkey", "style", "lang", F.md5("r.code").alias("code_md5"), F.col("r.before")[F.col("style")].alias("n_before"), F.col("r.after")[F.col("style")].alias("n_after"))

    run.__name__ = f"rewrite_family_{family}"
    return run


for _family in FAMILIES:
    query(_sql(_family))(_rewritten(_family))

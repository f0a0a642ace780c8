"""The parser as Spark functions: a program crosses to Python once for all that is asked of it, in Arrow batches.

Of equal programs in a batch one is parsed, and a worker remembers what programs met lately came to (up to REMEMBERED characters of them).
Spark is told that these functions may differ from call to call: filters on what they return then stay above them, where otherwise
it would work them out a second time below the exchange that spreads the rows, in as few tasks as the table has files.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from corpusmith.functions.code import audits, flow, rewrite, styles
from corpusmith.functions.code.comments import strip_comments as _strip
from corpusmith.functions.code.parser import NAMES, parse

#: Fixed value: characters of arguments whose results a worker keeps; a call with more than a 64th of it is not kept.
REMEMBERED = 1 << 19
_lately: dict[tuple, tuple[int, object]] = {}
_kept = 0


def once(f: Callable, *args):
    """f(*args), from memory if this worker met the same lately; the oldest go first. f is a function of a module, so that it is the same in every task."""
    global _kept
    key = (f, *args)
    if key in _lately:
        return _lately[key][1]
    found = f(*args)
    size = 16 + sum(len(a) for a in args if isinstance(a, str))
    if size <= REMEMBERED >> 6:
        while _kept + size > REMEMBERED:
            _kept -= _lately.pop(next(iter(_lately)))[0]
        _lately[key] = size, found
        _kept += size
    return found


def _numbered(column: pa.Array) -> tuple[np.ndarray, list]:
    """For each row the number of its value among the distinct ones, by first appearance, and these; lists are tuples."""
    if pa.types.is_nested(column.type):
        values: dict[tuple | None, int] = {}
        at = [values.setdefault(None if x is None else tuple(x), len(values)) for x in column.to_pylist()]
        return np.array(at, np.int64), list(values)
    found = column.dictionary_encode("encode")
    return found.indices.to_numpy().astype(np.int64), found.dictionary.to_pylist()


def _of_distinct(f: Callable, kind: pa.DataType, returns: str, *fixed):
    """A column function that calls f once for equal rows of a batch, which alone become Python objects. fixed: arguments behind the columns, the same for all rows."""

    def run(*columns: pa.Array) -> pa.Array:
        numbers, values = zip(*map(_numbered, columns), strict=True)
        row = numbers[0]
        for n, v in zip(numbers[1:], values[1:], strict=True):
            row = np.unique(row, return_inverse=True)[1] * len(v) + n
        _, first, at = np.unique(row, return_index=True, return_inverse=True)
        return pa.array([once(f, *(v[n[i]] for n, v in zip(numbers, values, strict=True)), *fixed) for i in first], kind).take(pa.array(at))

    return F.arrow_udf(run, returns).asNondeterministic()


def _known(code: str | None, lang: str | None) -> bool:
    """Null code, or a language without a parser, gives null."""
    return code is not None and lang in NAMES


def _style_counts(code, lang, wanted=None):
    return [(s, n) for s, n in styles.of_tree(parse(code, lang)).items() if wanted is None or s in wanted] if _known(code, lang) else None


def _syntax_ok(code, lang):
    return parse(code, lang).errors == 0 if _known(code, lang) else None


def _leaf_tokens(code, lang):
    return styles.leaf_tokens(parse(code, lang)) if _known(code, lang) else None


def _subtree_digests(code, lang):
    return flow.subtree_digests(parse(code, lang)) if _known(code, lang) else None


def _dataflow_edges(code, lang, fields):
    return [{k: x for k, x in zip(_EDGE, e, strict=True) if k in fields} for e in flow.data_flow(parse(code, lang))] if _known(code, lang) else None


def _inert_first_statements(code, lang):
    return audits.inert_first_statements(code, lang) if _known(code, lang) else None


def _suffixed_identifiers(code, lang, suffixes):
    return audits.suffixed_identifiers(code, lang, suffixes) if _known(code, lang) else None


def _stripped(code, lang):
    return None if code is None else _strip(code, lang)


def _normalized(code, lang, wanted):
    return dict(zip(("code", "changed"), rewrite.normalize(code, lang, list(wanted)) if _known(code, lang) else (None, None), strict=True))


def _changed(code, lang, wanted):
    return _normalized(code, lang, wanted)["changed"]


def _restyled(code, lang, wanted, counted=None):
    """The rewritten code, whether each style changed it, and counts of styles before and after; of the wanted styles, if no others are named."""
    (new, changed), of = _normalized(code, lang, wanted).values(), wanted if counted is None else counted
    return {"code": new, "changed": changed, "before": once(_style_counts, code, lang, of), "after": once(_style_counts, new, lang, of)}


def _features(code, lang):
    """Digests of syntax subtrees and normalized data-flow edges of a program, comments aside."""
    tree = parse(_strip(code or "", lang), lang)
    return flow.subtree_digests(tree), flow.normalized_flow(flow.data_flow(tree))


def _similarity(hyp, ref, lang):
    (ha, hf), (ra, rf) = once(_features, hyp, lang), once(_features, ref, lang)
    return dict(zip(("syntax_hit", "syntax_all", "flow_hit", "flow_all"), (*flow.syntax_hits(ha, ra), *flow.flow_hits(hf, rf)), strict=True))


def _restyled_similarity(code, lang, wanted):
    return _similarity(_normalized(code, lang, wanted)["code"], code, lang)


_STRINGS = pa.list_(pa.string())
#: Fields of a data-flow edge, in the order of flow.Edge.
_EDGE = {"var": (pa.string(), "string"), "idx": (pa.int32(), "int"), "rel": (pa.string(), "string"), "sources": (_STRINGS, "array<string>"), "source_idx": (pa.list_(pa.int32()), "array<int>")}


_COUNTS = pa.map_(pa.string(), pa.int32())


_SIMILARITY = pa.struct([(n, pa.int64()) for n in ("syntax_hit", "syntax_all", "flow_hit", "flow_all")]), "syntax_hit bigint, syntax_all bigint, flow_hit bigint, flow_all bigint"


def style_counts(code: Column, lang: Column, wanted: Sequence[str] | None = None) -> Column:
    """map of style id to count, all styles from one parse; of the wanted ones only, where these are given: Spark takes every entry over for every row."""
    return _of_distinct(_style_counts, _COUNTS, "map<string,int>", *[tuple(wanted)] if wanted is not None else [])(code, lang)


def syntax_ok(code: Column, lang: Column) -> Column:
    return _of_distinct(_syntax_ok, pa.bool_(), "boolean")(code, lang)


def leaf_tokens(code: Column, lang: Column) -> Column:
    return _of_distinct(_leaf_tokens, _STRINGS, "array<string>")(code, lang)


def subtree_digests(code: Column, lang: Column) -> Column:
    return _of_distinct(_subtree_digests, _STRINGS, "array<string>")(code, lang)


def dataflow_edges(code: Column, lang: Column, fields: Sequence[str] = tuple(_EDGE)) -> Column:
    """array of (var, idx, rel, sources, source_idx), or of those fields that are named: Spark takes every edge over for every row."""
    kept = tuple(k for k in _EDGE if k in fields)
    kind, returns = pa.list_(pa.struct([(k, _EDGE[k][0]) for k in kept])), ",".join(f"{k}:{_EDGE[k][1]}" for k in kept)
    return _of_distinct(_dataflow_edges, kind, f"array<struct<{returns}>>", kept)(code, lang)


def inert_first_statements(code: Column, lang: Column) -> Column:
    return _of_distinct(_inert_first_statements, pa.int32(), "int")(code, lang)


def suffixed_identifiers(code: Column, lang: Column, suffixes: tuple[str, ...]) -> Column:
    return _of_distinct(_suffixed_identifiers, _STRINGS, "array<string>")(code, lang, F.array(*[F.lit(s) for s in suffixes]))


def strip_comments(code: Column, lang: Column) -> Column:
    return _of_distinct(_stripped, pa.string(), "string")(code, lang)


def normalize_style(code: Column, lang: Column, wanted: list[str] | Column) -> Column:
    """struct of the rewritten code and, for each style, whether it changed something; styles may also come from an array column. Labels are not its business."""
    styles_of = wanted if isinstance(wanted, Column) else F.array(*[F.lit(w) for w in wanted])
    return _of_distinct(_normalized, pa.struct([("code", pa.string()), ("changed", pa.list_(pa.bool_()))]), "code string, changed array<boolean>")(code, lang, styles_of)


def style_changes(code: Column, lang: Column, wanted: Sequence[str]) -> Column:
    """Whether rewriting towards each style in turn changes something, as in normalize_style(), where the code itself is not asked for."""
    return _of_distinct(_changed, pa.list_(pa.bool_()), "array<boolean>", tuple(wanted))(code, lang)


def restyled(code: Column, lang: Column, wanted: Column, counted: Sequence[str] | None = None) -> Column:
    """struct of what normalize_style() returns for the wanted styles (an array column), and maps of counts of styles before and after, in one call: counting in the
    rewritten code would be a second pass through Python. Counted are the wanted styles, or those that are named."""
    kind = pa.struct([("code", pa.string()), ("changed", pa.list_(pa.bool_())), ("before", _COUNTS), ("after", _COUNTS)])
    return _of_distinct(_restyled, kind, "code string, changed array<boolean>, before map<string,int>, after map<string,int>", *[tuple(counted)] if counted is not None else [])(code, lang, wanted)


def similarity_stats(hyp: Column, ref: Column, lang: Column) -> Column:
    """Hits and totals of syntax subtrees and data-flow edges of a reference program, comments aside."""
    return _of_distinct(_similarity, *_SIMILARITY)(hyp, ref, lang)


def restyled_similarity(code: Column, lang: Column, wanted: Sequence[str]) -> Column:
    """similarity_stats() of programs rewritten towards the wanted styles, against the programs as they are; the rewritten code does not leave Python."""
    return _of_distinct(_restyled_similarity, *_SIMILARITY, tuple(wanted))(code, lang)


def _nodes(code, lang, kind):
    """(node, parent, depth, type, field, start, stop, text) of the nodes of a program's tree, or of those of one type."""
    out, stack, number = [], [(parse(code, lang).root, None, 0, None)] if _known(code, lang) else [], 0
    while stack:
        n, parent, depth, field = stack.pop()
        if kind is None or n.type == kind:
            out.append((number, parent, depth, n.type, field, n.start, n.end, n.text))
        names = {id(v): k for k, v in n.fields.items() if hasattr(v, "type")}
        stack.extend((c, number, depth + 1, names.get(id(c))) for c in reversed(n.children))
        number += 1
    return out


@udtf(returnType="node int, parent int, depth int, type string, field string, start int, stop int, text string")
class AstNodes:
    """One row for each node of a program's tree, so that SQL can ask about structure: SELECT ... FROM p, LATERAL ast_nodes(p.code, p.lang). With a type
    as third argument only nodes of it become rows; Spark does not push a filter on them into the function."""

    def eval(self, code: str, lang: str, kind: str = None):
        yield from once(_nodes, code, lang, kind)


def register(spark: SparkSession) -> None:
    """The functions under their names in SQL: ast_nodes, style_counts, syntax_ok, leaf_tokens, subtree_digests, of (code, lang)."""
    spark.udtf.register("ast_nodes", AstNodes)
    for name, f, kind, returns in (
        ("style_counts", _style_counts, _COUNTS, "map<string,int>"),
        ("syntax_ok", _syntax_ok, pa.bool_(), "boolean"),
        ("leaf_tokens", _leaf_tokens, _STRINGS, "array<string>"),
        ("subtree_digests", _subtree_digests, _STRINGS, "array<string>"),
    ):
        spark.udf.register(name, _of_distinct(f, kind, returns))

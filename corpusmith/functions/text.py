"""Text expressions: native functions alone, nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Code points that are invisible or turn the direction of text, with their names.
INVISIBLE = [
    (0x0008, "backspace"),
    (0x007F, "delete"),
    (0x200B, "zero width space"),
    (0x200C, "zero width non-joiner"),
    (0x200D, "zero width joiner"),
    (0x202A, "left-to-right embedding"),
    (0x202B, "right-to-left embedding"),
    (0x202C, "pop directional formatting"),
    (0x202D, "left-to-right override"),
    (0x202E, "right-to-left override"),
    (0x2066, "left-to-right isolate"),
    (0x2067, "right-to-left isolate"),
    (0x2068, "first strong isolate"),
    (0x2069, "pop directional isolate"),
]
INVISIBLE_CLASS = "[" + "".join(chr(c) for c, _ in INVISIBLE) + "]"
#: A carriage return counts only inside a word; at a line's end it is a plain line break.
HIDDEN_RETURN = "(?<=[A-Za-z0-9_])\r(?=[A-Za-z0-9_])"

# The rules of the public mteval-v11a tokenizer, in order.
MTEVAL_JOIN = [("<skipped>", ""), ("-\n", ""), ("\n", " ")]
MTEVAL_SPLIT = [
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def tokens(c: Column) -> Column:
    """What ASCII white space separates."""
    return F.filter(F.split(c, "[ \t\n\r\x0b\x0c]+"), lambda x: x != "")


def normalize_space(c: Column) -> Column:
    return F.array_join(tokens(c), " ")


def strip_breaks(c: Column) -> Column:
    return F.translate(c, "\n\t", "")


def split_punctuation(c: Column) -> Column:
    """Words and single other characters, joined by spaces."""
    return F.array_join(F.regexp_extract_all(c, F.lit(r"(?U)(\w+|[^\s\w])"), F.lit(1)), " ")


def unescape_xml(c: Column) -> Column:
    for name, char in (("&quot;", '"'), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def mteval_tokens(c: Column) -> Column:
    for pattern, to in MTEVAL_JOIN:
        c = F.regexp_replace(c, pattern, to)
    c = F.lower(F.concat(F.lit(" "), unescape_xml(c), F.lit(" ")))
    for pattern, to in MTEVAL_SPLIT:
        c = F.regexp_replace(c, pattern, to)
    return tokens(c)


def invisible_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(INVISIBLE_CLASS)) + F.regexp_count(c, F.lit(HIDDEN_RETURN))


def strip_invisible(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, INVISIBLE_CLASS, ""), HIDDEN_RETURN, "")


# What makes an identifier one of the naming styles.
CASES = {
    "upper": "^[A-Z][A-Z0-9]*$",
    "lower": "^[a-z][a-z0-9]*$",
    "camel": "^[a-z][a-z0-9]*([A-Z][a-z0-9]*)+$",
    "pascal": "^([A-Z][a-z0-9]+)+$",
    "snake": "^[a-z][a-z0-9]*(_[a-z0-9]+)+$",
    "underscore": "^_[A-Za-z0-9_]*$",
    "dollar": "^[$][A-Za-z0-9_$]*$",
}


def identifiers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("([A-Za-z_$][A-Za-z0-9_$]*)"), F.lit(1))


def case_of(c: Column) -> Column:
    """The first naming style that fits; other where none does."""
    out = F.lit("other")
    for name, pattern in reversed(CASES.items()):
        out = F.when(c.rlike(pattern), name).otherwise(out)
    return out


def subtokens(c: Column) -> Column:
    """An identifier's parts by case, _ and $."""
    return F.regexp_extract_all(c, F.lit("([A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+)"), F.lit(1))


def label_text(c: Column) -> Column:
    """0 and 1 as false and true; anything else is an error."""
    return F.when(c == 0, "false").when(c == 1, "true").otherwise(F.raise_error(F.concat(F.lit("not a label: "), F.coalesce(c.cast("string"), F.lit("null")))))


def normalized_label(c: Column) -> Column:
    """-1 counts as 0."""
    return F.when(c == -1, 0).otherwise(c)


def prefixed(task: str, sub_task: str, c: Column) -> Column:
    return F.concat(F.lit(f"{task} {sub_task}: " if sub_task != "none" else f"{task}: "), c)


def safe_eos(c: Column) -> Column:
    return F.replace(c, F.lit("</s>"), F.lit("<unk>"))


def line_breaks(c: Column, token: str = "NEW_LINE") -> Column:
    """Line breaks where a text has a token in their place."""
    return F.replace(c, F.lit(token), F.lit("\n"))

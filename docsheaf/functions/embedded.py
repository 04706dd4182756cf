"""JSON values written into texts, found and read by Spark's regular expressions and variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values nested deeper than this aren't read.
DEPTH = 48
#: A JSON string; possessive and unrolled, so that it takes no stack and one pass.
STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def balanced(opening: str, closing: str, depth: int = DEPTH) -> str:
    """Pattern of a run from an opening bracket to the one that closes it; brackets within strings don't count."""
    plain = f'[^"{opening}{closing}]*+'
    inner = STRING
    for _ in range(depth):
        value = rf"[{opening}]{plain}(?:(?:{inner}){plain})*+[{closing}]"
        inner = f"{STRING}|{value}"
    return value


OBJECT = balanced(r"\{", r"\}")
OBJECT_OR_LIST = balanced(r"\{\[", r"\}\]")


def fields(value: Column) -> Column:
    """The members of a variant that is an object, else null."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def items(value: Column) -> Column:
    """The elements of a variant that is a list, else null."""
    return F.try_variant_get(value, "$", "array<variant>")


def as_text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def first_embedded(text: Column, pattern: str) -> Column:
    """The first run of a balanced pattern that is JSON, wherever it begins; null if there is none."""
    runs = F.regexp_extract_all(text, F.lit(f"(?s)(?=({pattern}))"), F.lit(1))
    return F.get(F.filter(runs, lambda run: F.try_parse_json(run).isNotNull()), F.lit(0))

"""Column expressions on texts that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once however often use() names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: White space in the Unicode sense (the property White_Space) but the blank, in ranges as a pattern has them.
_OTHER_WHITE = "\\t-\\r\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_WHITE_CHARACTERS = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    """Without white space, in the Unicode sense, at both ends."""
    return F.btrim(text, F.lit(_WHITE_CHARACTERS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(_WHITE_CHARACTERS))


def strip_newlines(text: Column) -> Column:
    return F.btrim(text, F.lit("\n"))


def squeeze(text: Column) -> Column:
    """White space runs as one blank, none at the ends. Single blanks, by far the most of it, are passed over."""
    return F.btrim(F.regexp_replace(text, f"[ {_OTHER_WHITE}]{{2,}}|[{_OTHER_WHITE}]", " "))


def clip(text: Column, most: Column | int, margin: int = 80) -> Column:
    """Head and tail of a text longer than `most`, with a note of what is left out between them."""
    limit = F.lit(most) if isinstance(most, int) else most
    half = F.greatest(F.lit(1), F.floor((limit - margin) / 2)).cast("int")
    note = F.concat(F.lit("\n\n...[truncated "), (F.length(text) - half * 2).cast("string"), F.lit(" chars]...\n\n"))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, F.lit(1), half), note, F.right(text, half)))


def ordered_join(order: str, text: Column, separator: str) -> Column:
    """Aggregate: the texts of a group joined in order."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order), text.alias("t")))), lambda x: x["t"]), separator)


def root_name(name: Column) -> Column:
    """The upload that an attachment belongs to: the name before " · page N" or " · visual OCR"."""
    return F.split(name, r"(?i) · (?:page \d+|visual OCR)", 2)[0]


def is_visual_ocr(name: Column) -> Column:
    return F.lower(name).endswith("visual ocr")

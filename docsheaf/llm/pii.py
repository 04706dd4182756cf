"""Format-preserving pseudonyms for validated numbers and dates.

Card numbers, IBANs, telephone and social-security numbers, IPv4 addresses, e-mail names and calendar dates are found
by pattern and validated (Luhn, mod 97, ranges, calendar). A value is ranked within the set of values of its format,
the rank goes through a keyed Feistel permutation of that set, and the result is written in the original's format. The
same key sends equal values to equal pseudonyms in every document, whatever their separators, and different values to
different ones. Order and number of digits belong to the form of a date: a date is linked with others of its form, and with
those of forms that hold every day (two digits each for day and month, the order beyond doubt or month first).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsheaf.session import ship

ROUNDS = 8


def permute(x: int, size: int, key: bytes, kind: str) -> int:
    """A keyed permutation of range(size): a balanced Feistel network on the next even number of bits, walked until it
    falls into the range again."""
    if size < 2:
        return x
    half = ((size - 1).bit_length() + 1) // 2
    mask = (1 << half) - 1
    width = (half + 7) // 8
    tweak = f"{kind}:{size}".encode()
    while True:
        left, right = x >> half, x & mask
        for k in range(ROUNDS):
            said = hashlib.blake2b(bytes([k]) + right.to_bytes(width, "big") + tweak, key=key[:64], digest_size=width + 8).digest()
            left, right = right, left ^ (int.from_bytes(said, "big") & mask)
        x = left << half | right
        if x < size:
            return x


def luhn(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == digits[-1]


def luhn_digit(payload: str) -> str:
    total = sum(d if k % 2 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(payload))))
    return str(-total % 10)


def _refill(shape: str, digits: str) -> str:
    """shape with its letters and digits replaced, in order."""
    left = iter(digits)
    return re.sub(r"[A-Za-z0-9]", lambda _: next(left), shape)


def _mixed(value: str, key: bytes, kind: str) -> str:
    """Letters stay letters of their case and digits digits; one permutation over all of them."""
    radix = [26 if c.isalpha() else 10 for c in value]
    size, rank = 1, 0
    for c, r in zip(value, radix, strict=True):
        rank, size = rank * r + (ord(c.lower()) - 97 if r == 26 else int(c)), size * r
    rank, out = permute(rank, size, key, kind), []
    for c, r in zip(reversed(value), reversed(radix), strict=True):
        rank, d = divmod(rank, r)
        out.append(str(d) if r == 10 else chr((65 if c.isupper() else 97) + d))
    return "".join(reversed(out))


def _card(text: str, key: bytes) -> str | None:
    digits = re.sub(r"[^0-9]", "", text)
    if not luhn(digits) or digits[0] == "0":
        return None
    low, size = 10 ** (len(digits) - 2), 9 * 10 ** (len(digits) - 2)
    new = str(low + permute(int(digits[:-1]) - low, size, key, "card"))
    return _refill(text, new + luhn_digit(new))


def _phone(text: str, key: bytes) -> str | None:
    country = re.match(r"\+?([0-9]{1,3}(?=[ (-])|[0-9])?", text)[0] if text[0] == "+" else ""
    rest = text[len(country) :]
    digits = re.sub(r"[^0-9]", "", rest)
    if not 7 <= len(digits) <= 14:
        return None
    return country + _refill(rest, str(permute(int(digits), 10 ** len(digits), key, "phone")).zfill(len(digits)))


def _ssn(text: str, key: bytes) -> str | None:
    good = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    digits = text.replace("-", "")
    if not good(digits):
        return None
    while not good(digits := str(permute(int(digits), 10**9, key, "ssn")).zfill(9)):
        pass
    return _refill(text, digits)


def _ipv4(text: str, key: bytes) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
        return None
    new = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ipv4")
    return ".".join(map(str, new.to_bytes(4, "big")))


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _iban(text: str, key: bytes) -> str | None:
    """Of the longest valid start of text that ends with a group: a match with separators can run on into what follows.
    With separators or small letters at least half of the characters are digits, or words would pass by chance. Small
    and capital letters are the same value."""
    for end in [len(text), *reversed([m.start() for m in re.finditer(r"[ -]", text)])]:
        plain = re.sub(r"[ -]", "", text[:end])
        if len(plain) >= 15 and (len(plain) == end and plain == plain.upper() or 2 * sum(map(str.isdigit, plain)) >= len(plain)) and _iban_rest(plain) == 1:
            body = _mixed(plain[4:], key, "iban")
            return _refill(text[:end], f"{plain[:2]}{98 - _iban_rest(plain[:2] + '00' + body):02d}{body}")
    return None


def _email(text: str, key: bytes) -> str | None:
    name, domain = text.rsplit("@", 1)
    kept = re.sub(r"[^A-Za-z0-9]", "", name)
    if not kept:
        return None
    new = iter(_mixed(kept, key, "email"))
    return re.sub(r"[A-Za-z0-9]", lambda _: next(new), name) + "@" + domain


FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)


def _read_date(parts: list[str], marks: list[str]) -> tuple[str, date] | None:
    """(order, day) of a written date: the first order that gives a day; slashes may stand between month, day and year."""
    for order in ("ymd",) if len(parts[0]) == 4 else ("mdy", "dmy") if "/" in marks else ("dmy",):
        try:
            day = date(*(int(parts[order.index(k)]) for k in "ymd"))
        except ValueError:
            continue
        if FIRST_DAY <= day <= LAST_DAY:
            return order, day
    return None


def _date(text: str, key: bytes) -> str | None:
    """Days are permuted until the new one, written in the same order with as many digits, is read in that order: so a
    date stays within the texts of its form, and no two texts become the same."""
    parts, marks = re.split(r"[-/.]", text), re.findall(r"[-/.]", text)
    found = _read_date(parts, marks)
    if found is None:
        return None
    order, day = found
    while True:
        day = FIRST_DAY + timedelta(permute((day - FIRST_DAY).days, (LAST_DAY - FIRST_DAY).days + 1, key, "date"))
        value = {"y": day.year, "m": day.month, "d": day.day}
        filled = [str(value[k]).zfill(len(parts[i])) for i, k in enumerate(order)]
        if [*map(len, filled)] == [*map(len, parts)] and _read_date(filled, marks) == (order, day):
            return filled[0] + marks[0] + filled[1] + marks[1] + filled[2]


#: kind, pattern, pseudonym or None if the value isn't valid. The first pattern that matches at a place is tried.
KINDS: tuple[tuple[str, str, Callable[[str, bytes], str | None]], ...] = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", _email),
    ("iban", r"(?<!\w)[A-Za-z]{2}[0-9]{2}(?:[A-Za-z0-9]{11,30}|(?=[A-Za-z0-9]*(?P<gap0>[ -]))(?:(?P=gap0)?[A-Za-z0-9]){11,30})(?!\w)", _iban),
    ("date", r"(?<![\w/.-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![\w/-])", _date),
    ("ipv4", r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\w|\.[0-9])", _ipv4),
    ("ssn", r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", _ssn),
    ("card", r"(?<![\w])(?:[0-9]{13,19}|[0-9]{4}(?P<gap>[ -])[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{1,7}|[0-9]{4}(?P<gap2>[ -])[0-9]{6}(?P=gap2)[0-9]{5})(?!\w)", _card),
    ("phone", r"(?<![\w+])(?:\+[0-9]{1,3}[ -]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ -]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[ -][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?!\w)", _phone),
)
_ANY = re.compile("|".join(f"(?P<{k}>{p})" for k, p, _ in KINDS))
_MAKE = {k: f for k, _, f in KINDS}
#: No value of any kind has fewer than this in a row; texts without it and without "@" are passed on at once.
_HINT = re.compile(r"[0-9][0-9() ./-]{4,}[0-9]|[A-Za-z]{2}[0-9]{2}(?:[ -]?[A-Za-z0-9]){11}")


def pseudonymise(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """The new text and (kind, start, end) of what was replaced, in code points of the old text."""
    if "@" not in text and not _HINT.search(text):
        return text, []
    out, found, at, done = [], [], 0, 0
    while m := _ANY.search(text, at):
        kind = m.lastgroup if m.lastgroup in _MAKE else next(k for k in _MAKE if m[k] is not None)
        new = _MAKE[kind](m[0], key)
        if new is None:
            at = _after(text, m)
            continue
        end = m.start() + len(new) if kind == "iban" else m.end()  # an IBAN may be less than the match, see _iban()
        out += [text[done : m.start()], new]
        found.append((kind, m.start(), end))
        at = done = end
    return "".join([*out, text[done:]]), found


def _after(text: str, m: re.Match) -> int:
    """Where to go on after a match that isn't valid: past the run of word characters it starts with."""
    run = re.compile(r"[\w.+%-]+|.", re.S).match(text, m.start())
    return min(m.end(), run.end())


def pseudonyms(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, text with pseudonyms, n_replaced, spans ("kind:start:end" of the old text, by start).

    Whoever has the key can turn pseudonyms back, so there is no default: keep it secret, at least 16 bytes long, and
    the same for all documents that are to stay linked. Null texts stay null with n_replaced 0, texts without valid
    values stay as they are. Repeated rows give equal rows, rows without an id are rewritten like others, an empty table
    gives none; other columns are ignored, whatever their names.
    """
    if len(key) < 16:
        raise ValueError("the key must have at least 16 bytes")
    ids = docs.select(id_col).schema[0].dataType.simpleString()
    ship(docs.sparkSession)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(None, []) if t is None else pseudonymise(t, key) for t in batch.column("text").to_pylist()]
            spans = [",".join(f"{k}:{s}:{e}" for k, s, e in found) for _, found in made]
            columns = [pa.array([t for t, _ in made], pa.string()), pa.array([len(f) for _, f in made], pa.int64()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "text", "n_replaced", "spans"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(rewrite, f"doc_id {ids}, text string, n_replaced long, spans string")

"""Repair of texts whose UTF-8 bytes were read as Latin-1 or cp1252, and the cleaning of text values.

All of it but the compatibility forms of non-ASCII texts is built from Spark's own expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstone.functions.text import strip_ws, unicode_form

#: What tells a text that was read wrongly, for values and for terms.
VALUE_MARKS = ["Ã", "â€™", "â€œ", "â€\x9d", "â€˜", "â€“", "â€”", "â€¦", "â‚¬", "Â", "ï¬"]
TERM_MARKS = ["Ã", "â", "Â", "Ë", "È", "É", "�"]
#: The letters of cp1252 that Latin-1 doesn't have, and their bytes.
_CP1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
_BYTES = "".join(chr(c.encode("cp1252")[0]) for c in _CP1252)
#: Signs and what a cleaned value has for them.
PLAIN_SIGNS = {" ": " ", "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "ﬁ": "fi", "ﬂ": "fl"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _read_again(text: Column, page: str) -> Column:
    """The text's bytes in a code page read as UTF-8, or null if it has other letters or the bytes are no UTF-8."""
    if page == "cp1252":
        sound, latin = "^[\\x00-\\x7f\\xa0-\\xff" + _CP1252 + "]*$", F.translate(text, _CP1252, _BYTES)
    else:
        sound, latin = "^[\\x00-\\xff]*$", text
    raw = F.encode(F.regexp_replace(latin, "[^\\x00-\\xff]", "?"), "ISO-8859-1")
    return F.when(text.rlike(sound), F.try_validate_utf8(raw.cast("string")))


def mark_count(text: Column, marks: list[str] = VALUE_MARKS) -> Column:
    """How many signs of wrong reading a text holds; no sign is part of another one."""
    return F.regexp_count(text, F.lit("|".join(marks)))


def _any_mark(text: Column, marks: list[str]) -> Column:
    return text.rlike("|".join(marks))


def _best(text: Column, marks: list[str], first_only: bool) -> Column:
    """The reading with fewer marks: the first such page's, or the page's with the fewest."""

    def choose(state: Column) -> Column:
        own, latin, cp = state["own"], state["latin"], state["cp"]
        n = [F.coalesce(mark_count(c, marks), F.lit(1 << 30)) for c in (own, latin, cp)]
        if first_only:
            return F.when(n[1] < n[0], latin).when(n[2] < n[0], cp).otherwise(own)
        return F.when((n[1] < n[0]) & (n[1] <= n[2]), latin).when((n[2] < n[0]) & (n[2] < n[1]), cp).otherwise(own)

    return let(F.struct(text.alias("own"), _read_again(text, "latin-1").alias("latin"), _read_again(text, "cp1252").alias("cp")), choose)


def repaired(text: Column, passes: int = 2) -> Column:
    """A value read again as UTF-8 while that leaves fewer marks, at most `passes` times; ties go to Latin-1. Null stays null."""
    out = text
    for _ in range(passes):
        out = let(out, lambda t: _best(t, VALUE_MARKS, False))
    return F.when(_any_mark(text, VALUE_MARKS), out).otherwise(text)


def repaired_term(text: Column) -> Column:
    """A term with blanks for non-breaking ones, read again once by the first page that leaves fewer marks."""
    plain = F.replace(text, F.lit(" "), F.lit(" "))
    return F.when(_any_mark(plain, TERM_MARKS), let(plain, lambda t: _best(t, TERM_MARKS, True))).otherwise(plain)


def nfkc(text: Column) -> Column:
    """NFKC; ASCII texts, which are that already, stay in the JVM."""
    return F.when(text.rlike("^[\\x00-\\x7F]*$"), text).otherwise(unicode_form("NFKC")(text))


def clean_value(text: Column) -> Column:
    """A value repaired, in compatibility form, with ASCII quotation marks and dashes, single blanks and trimmed lines."""
    out = nfkc(repaired(text))
    for a, b in PLAIN_SIGNS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return strip_ws(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"(?U)\s*\n\s*", "\n"))


def clean_key(path: Column) -> Column:
    """A path as a comparison key: repaired, in compatibility form, one kind of separator, underscores for white space, lower case."""
    parts = F.split(strip_ws(F.replace(nfkc(repaired(path)), F.lit("\\"), F.lit("/"))), "/")
    return F.array_join(F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.lower(F.regexp_replace(strip_ws(p), r"(?U)\s+", "_"))), "/")


def known_repair(field: str, value: Column, repairs: dict[tuple[str, str], str]) -> Column:
    """The replacement of a field's known wrong values."""
    out = value
    for (name, wrong), right in repairs.items():
        if name == field:
            out = F.when(value == wrong, right).otherwise(out)
    return out

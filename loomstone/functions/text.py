"""Text functions: white space, shortening, unicode forms, parsing of model output and markers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Ligatures and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}


def strip_ws(c: Column) -> Column:
    """Without white space of any alphabet at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """White space runs become one blank; none at the ends; blank texts become null."""
    return F.nullif(F.regexp_replace(strip_ws(c), r"(?U)\s+", " "), F.lit(""))


def is_blank(c: Column) -> Column:
    return F.coalesce(strip_ws(c), F.lit("")) == ""


def parse_norm(c: Column) -> Column:
    """Non-breaking blanks and ligatures expanded, lower case, white space squeezed; null stays null."""
    out = F.replace(c, F.lit(" "), F.lit(" "))
    for a, b in LIGATURES.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(F.trim(F.lower(out)), r"(?U)\s+", " ")


def unicode_form(form: str, keep_marks: bool = True):
    """An Arrow function for a unicode normal form, optionally without combining marks."""

    @pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            if x is None:
                return None
            y = unicodedata.normalize(form, x)
            return y if keep_marks else "".join(ch for ch in y if not unicodedata.combining(ch))

        return s.map(one, na_action=None)

    return normal


def nfc(c: Column) -> Column:
    """NFC; pure ASCII text, which is NFC already, stays in the JVM."""
    return F.when(c.rlike("^[\\x00-\\x7F]*$"), c).otherwise(unicode_form("NFC")(c))


def simplify(c: Column) -> Column:
    """Lower case, underscores and dashes as blanks, accents dropped, other signs as blanks, squeezed; blank becomes null."""
    low = F.regexp_replace(F.lower(c), "[_-]", " ")
    plain = F.when(low.rlike("^[\\x00-\\x7F]*$"), low).otherwise(unicode_form("NFKD", keep_marks=False)(low))
    return squeeze(F.regexp_replace(plain, "[^a-z0-9 ]", " "))


def slugify(c: Column) -> Column:
    """`simplify` with underscores; nothing left gives `na`."""
    return F.coalesce(F.regexp_replace(simplify(c), " ", "_"), F.lit("na"))


def shorten(c: Column, most: int, mark: str = "…") -> Column:
    """At most `most` characters: cut one earlier, trailing blanks and ,;:- dropped, then the mark."""
    return F.when(F.length(c) > most, F.concat(F.regexp_replace(F.substring(c, 1, most - 1), "[ ,;:-]+$", ""), F.lit(mark))).otherwise(c)


def year_of(c: Column) -> Column:
    """The first four-digit number, or null."""
    return F.nullif(F.regexp_extract(c, r"(\d{4})", 1), F.lit(""))


def sentences(c: Column) -> Column:
    """Pieces that end with a stop, question or exclamation mark before white space."""
    return F.split(c, r"(?<=[.?!])\s+", -1)


def json_in(c: Column, schema: str) -> Column:
    """The JSON object a model's answer is, or the first one within it."""
    bare = F.regexp_replace(strip_ws(c), r"^```(?:json)?\s*|\s*```$", "")
    first = F.from_json(bare, schema)
    ok = bare.rlike(r"^\s*\{")
    return F.when(ok, first).otherwise(F.from_json(F.regexp_extract(bare, r"(\{[^{}]*\})", 1), schema))


def citations(c: Column) -> Column:
    """The numbers of markers such as [1] and [1, 2], in order."""
    marks = F.regexp_extract_all(c, F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), 1)
    return F.transform(F.flatten(F.transform(marks, lambda m: F.split(m, r"\s*,\s*"))), lambda x: x.cast("int"))


def occurrences(c: Column, marks: list[str]) -> Column:
    """How often any of the marks occurs."""
    total = F.lit(0)
    for m in marks:
        total = total + ((F.length(c) - F.length(F.replace(c, F.lit(m), F.lit("")))) / len(m)).cast("int")
    return total


def noise_line(c: Column) -> Column:
    """Lines that carry no text: page markers, bare numbers, rules."""
    return c.rlike(r"(?i)^\s*(?:page|pag\.?|p\.)?\s*\d+(?:\s*/\s*\d+)?\s*$|^\s*[-–—*_=·. ]*\s*$")


def data_uri(c: Column) -> tuple[Column, Column]:
    """Type and bytes of a base64 data URI; the type defaults to image/jpeg."""
    kind = F.regexp_extract(c, r"^data:([^;,]+)", 1)
    body = F.element_at(F.split(c, ",", 2), -1)
    return F.coalesce(F.nullif(kind, F.lit("")), F.lit("image/jpeg")), F.unbase64(body)

"""Several values packed in one field: one row per value, with its position.

Method: spans that protect their content (quotation marks, guillemets, parentheses, decimal
numbers) are replaced with indexed placeholders, the remaining delimiters split the field, the
spans are put back by array lookup, and the values are exploded with their positions. All of it
is built from Spark's own expressions, so it runs in the JVM without a shuffle.

The placeholder of span i is U+0001, a kind letter, i, U+0002. It cannot collide with text,
because U+0001 and U+0002 that stand in a field are spans themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_QUOTED = '"[^"]*+(?:""[^"]*+)*+"'
_SPAN = (
    _QUOTED
    + "|«[^»]*+»|“[^”]*+”"
    + r"|\((?!\d{1,2}\)\s)[^()]*+(?:\([^()]*+\)[^()]*+)*+\)"
    + r"|(?<!\d)\d{1,3},\d(?!\d)"
    + "|[\u0001\u0002]"
)
_MARK = r"(?:\(\d{1,2}\)|\[\d{1,2}\]|\d{1,2}\))"
_NUMBERED = rf"^\s*{_MARK}\s"
_INLINE_MARK = rf"(?:^|\s+){_MARK}(?=\s)"
_BULLET = rf"^(?:{_MARK}|\d{{1,2}}\.|[-–—•*·])\s+"
#: A value enclosed whole in straight quotation marks with a comma beside it: a comma-separated list.
_CSV = "(?:^|[;|,\\n•]\\s*)\u0001Q\\d+\u0002\\s*,|,\\s*\u0001Q\\d+\u0002\\s*(?:$|[;|,\\n])"


@dataclass(frozen=True)
class Packing:
    """How the values of a field are separated: `commas` tells whether a bare comma separates."""

    delimiters: str
    commas: bool

    def pattern(self, commas: bool, numbered: bool) -> str:
        return self.delimiters + ("|," if commas else "") + (f"|{_INLINE_MARK}" if numbered else "")


#: Lists of short names: a slash, a plus, a dash between blanks and the word "and" separate as well.
NAMES = Packing(r"[;|•/\r\n\t]|\s[+\-–—·&]\s|\s(?:and|e|et|und|y)\s", True)
#: Lists of titles, which hold commas, slashes, dashes and "and" themselves.
TITLES = Packing(r"[;|•\r\n\t]|//", False)

FIELDS = {"materials": NAMES, "exhibitions": TITLES, "bibliography": TITLES}


def _masked(text: Column, spans: Column) -> Column:
    """The text with span i replaced by its placeholder."""

    def held(piece: Column, i: Column) -> Column:
        kind = F.when(F.get(spans, i).startswith('"'), "Q").otherwise("S")
        return F.when(i < F.size(spans), F.concat(piece, F.lit("\u0001"), kind, i.cast("string"), F.lit("\u0002"))).otherwise(piece)

    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(F.transform(F.split(text, _SPAN, -1), held), ""))


def _restored(part: Column, spans: Column) -> Column:
    """A value with its spans put back, without list marker, outer blanks and enclosing quotation marks."""
    bare = F.regexp_replace(F.regexp_replace(part, r"^\s+|\s+$", ""), _BULLET, "")
    bits = F.split(bare, "[\u0001\u0002]", -1)
    back = F.array_join(F.transform(bits, lambda b, i: F.when(i % 2 == 1, F.get(spans, F.substring(b, 2, 10).cast("int"))).otherwise(b)), "")
    inner = F.replace(F.substring(back, F.lit(2), F.length(back) - 2), F.lit('""'), F.lit('"'))
    whole = F.when(bare.rlike("^\u0001Q\\d+\u0002$"), inner).when(F.contains(bare, F.lit("\u0001")), back).otherwise(bare)
    return F.regexp_replace(whole, "^ +| +$", "")


def unpack(df: DataFrame, key: str, fields: dict[str, Packing], *, least: int = 1) -> DataFrame:
    """One row `(key, field_name, pos, item_value)` per value of each of the `fields`.

    Rows that repeat a key and its fields count once; `least` is the number of values from which
    a field is listed. Null, empty and blank fields give no row; an empty table gives an empty
    result; other columns of `df` play no part, whatever their names. A null key is kept as a key.

    Each step is a projection of its own: what several expressions of the next step use is
    computed once.
    """
    kinds = list(dict.fromkeys(fields.values()))
    each = F.array(*[F.struct(F.lit(name).alias("field_name"), F.lit(kinds.index(p)).alias("kind"), F.col(name).alias("text")) for name, p in fields.items()])
    rows = df.select(F.col(key), F.explode(each).alias("f")).select(key, "f.field_name", "f.kind", "f.text").where("text <> ''")
    head = (key, "field_name")
    rows = rows.select(*head, "kind", "text", F.when(F.col("text").rlike('["«“(,\u0001\u0002]'), F.regexp_extract_all("text", F.lit(f"({_SPAN})"), 1)).otherwise(F.array().cast("array<string>")).alias("spans"))
    rows = rows.select(*head, "kind", "spans", _masked(F.col("text"), F.col("spans")).alias("masked"))
    masked = F.col("masked")
    commas = F.element_at(F.array(*[F.lit(p.commas) for p in kinds]), F.col("kind") + 1)
    rows = rows.select(*head, "spans", "masked", (F.col("kind") * 4 + F.when(masked.rlike(_NUMBERED), 2).otherwise(0) + F.when(commas | masked.rlike(_CSV), 1).otherwise(0)).alias("way"))
    parts = F.array().cast("array<string>")
    for k, p in enumerate(kinds):
        for numbered in (False, True):
            for c in (False, True):
                parts = F.when(F.col("way") == k * 4 + 2 * numbered + c, F.split(masked, p.pattern(c, numbered), -1)).otherwise(parts)
    rows = rows.select(*head, "spans", parts.alias("parts"))
    rows = rows.select(*head, F.filter(F.transform("parts", lambda v: _restored(v, F.col("spans"))), lambda v: v != "").alias("vals"))
    listed = F.when(F.size("vals") >= least, F.col("vals"))
    return rows.select(*head, F.posexplode(listed).alias("at", "item_value")).select(*head, (F.col("at") + 1).cast("int").alias("pos"), "item_value").distinct()

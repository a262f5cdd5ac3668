"""Predicates from filter specifications: `key=value` arguments and typed filters."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstone.functions.tags import any_of


def parse_filters(args: list[str] | None, coerce_digits: bool = True) -> dict[str, str | int]:
    """`key=value` arguments as a map: split at the first =, trimmed, unquoted; digits become integers; later keys win."""
    out: dict[str, str | int] = {}
    for a in args or []:
        key, sign, value = a.partition("=")
        if not sign:
            raise ValueError(f"a filter must be key=value: {a!r}")
        value = value.strip().strip('"').strip("'")
        out[key.strip()] = int(value) if coerce_digits and value.isdigit() else value
    return out


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def where_equal(filters: dict[str, str | int] | None) -> Column:
    """Conjunction of equalities; an integer equals only a column of a number, a text only one of text, as a typed store does."""
    return all_of([F.col(k) == F.lit(v) for k, v in (filters or {}).items()])


def contains_all(text: str, needles: list[str]) -> Column:
    """Case-sensitive substrings, all of them; none hold for every row."""
    return all_of([F.col(text).contains(n) for n in needles])


@dataclass(frozen=True)
class FilterSpec:
    """Equalities of scalar fields, tags by field (any within a field, all fields), and substrings of the text."""

    equal: dict[str, str] = field(default_factory=dict)
    tags: dict[str, list[str]] = field(default_factory=dict)
    contains: list[str] = field(default_factory=list)

    def is_empty(self) -> bool:
        return not (any(self.equal.values()) or any(self.tags.values()) or any(self.contains))

    def only(self, *names: str) -> bool:
        """Whether nothing but the named scalar fields is filtered."""
        return not any(self.tags.values()) and not any(self.contains) and {k for k, v in self.equal.items() if v} <= set(names)

    def condition(self, text: str | None = None) -> Column:
        """Empty values and lists are passed over."""
        conditions = [F.col(k) == v for k, v in self.equal.items() if v]
        conditions += [any_of(F.col(k), v) for k, v in self.tags.items() if v]
        if text:
            conditions += [F.col(text).contains(n) for n in self.contains if n]
        return all_of(conditions)

    def with_anchor(self, anchor: dict, attributes: list[str] | None = None) -> FilterSpec:
        """Filters taken from a reference item, before the own ones: its season and year, and its first colour, material and garment as substrings.

        `attributes` names which of season, year, color, material and garment count; none named
        are all. Values that the item lacks are passed over.
        """
        wanted = set(attributes or ("season", "year", "color", "material", "garment"))
        tags = [("color", "colors_tags"), ("material", "material_tags"), ("garment", "garments_tags")]
        first = [anchor[f][0] for a, f in tags if a in wanted and anchor.get(f)]
        scalars = [("season", "season_path"), ("year", "year_path")]
        return FilterSpec({k: anchor[k] for a, k in scalars if a in wanted and anchor.get(k)} | self.equal, self.tags, first + self.contains)

    @staticmethod
    def by_picture(attributes: list[str] | None) -> bool:
        """Whether a reference picture's own vector is searched with: not if only its season or year is asked for."""
        return not attributes or bool(set(attributes) - {"season", "year"})

    @classmethod
    def from_arguments(cls, arguments: dict) -> FilterSpec:
        """Filters out of a model's arguments: season and year as equalities, tag lists as substrings of the document; other arguments are passed over."""
        equal = {f"{k}_path": str(arguments[k]) for k in ("season", "year") if arguments.get(k)}
        contains = [t for k, v in arguments.items() if k.endswith("_tags") for t in (v if isinstance(v, list) else [v]) if t]
        return cls(equal=equal, contains=contains)

"""Text that was decoded with the wrong character encoding: find it and restore it.

Method: unknown code-page swaps are treated as substitution ciphers, one per source. The cipher's
units are the runs of non-ASCII characters. Expectation-maximisation learns for each source which
letter each unit stands for, and how often it stands for itself: the E-step shares every context
of a unit among its possible letters by a letter n-gram model of the collection's own text, the
M-step sums the shares up, and the letter model is counted anew from what is held to be sound.
Pairs of public code pages (which bytes were written, which letters they were read as) are the
prior of the mapping only: a letter that they suggest is dropped if sound text doesn't have it in
the unit's contexts, and a unit that they explain wrongly or not at all gets its letter from its
contexts alone. A unit is read as garbled where that is far more probable in its context.
Restoring marks these units by signs and applies the source's mapping of signs with translate().
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.plans.lineage import cut

#: The letters and signs that sound text in the five languages is made of.
PLAIN = "àáâäãèéêëìíîïòóôöùúûüçñßœæÀÁÂÄÈÉÊËÌÍÎÏÒÓÔÖÙÚÛÜÇÑŒÆ’‘“”«»–—…¿¡°€©®™½√ª º±№·•‰"
_PLAIN = frozenset(PLAIN + " ")
_LETTERS = frozenset(c for c in PLAIN if c.isalpha())
LOST = "�"
#: The name of the swap by which a unit's own letter was learnt.
LEARNT = "learnt"
#: The code pages that UTF-8 was read as, and pairs (written, read) of one-byte code pages.
READ_AS = ("cp1252", "cp1250", "cp437", "cp850", "mac_roman", "cp1251", "iso8859_2", "iso8859_15")
SWAPS = (
    *(("cp1252", r) for r in ("cp1251", "mac_roman", "cp437", "cp850", "cp1250")),
    *(("mac_roman", r) for r in ("cp1252", "cp850")),
    *((w, "cp1252") for w in ("cp850", "cp437")),
)
_RUN = re.compile(r"[^\x00-\x7f]+")
_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


@lru_cache(maxsize=None)
def _bytes_of(page: str) -> dict[str, int]:
    """The byte of each character of a code page; bytes without a character are the control of that number."""
    out = {}
    for b in range(0x80, 0x100):
        out.setdefault(chr(b), b)
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(page)] = b
        except UnicodeDecodeError:
            pass
    return out


@lru_cache(maxsize=None)
def _letters_of(swap: tuple[str, str]) -> dict[int, str]:
    """For translate(): what each letter that was read stands for in the code page that was written."""
    written, read = swap
    out = {}
    for b in range(0x80, 0x100):
        try:
            seen, meant = bytes([b]).decode(read), bytes([b]).decode(written)
        except UnicodeDecodeError:
            continue
        if seen != meant and ord(seen) > 0x7F and meant in _PLAIN:
            out[ord(seen)] = meant
    return out


def _utf8_once(run: str, page: str) -> str | None:
    """The run with its valid UTF-8 sequences read as UTF-8, or None if it has none."""
    table = _bytes_of(page)
    if not all(c in table for c in run):
        parts = [(_utf8_once(p, page) if all(c in table for c in p) else None) or p for p in re.split(f"([{re.escape(''.join(c for c in set(run) if c not in table))}]+)", run)]
        out = "".join(parts)
        return out if out != run else None
    raw = bytes(table[c] for c in run)
    out, at, hit = [], 0, False
    for m in _UTF8.finditer(raw):
        try:
            letter = m[0].decode("utf-8")
        except UnicodeDecodeError:
            continue
        out += [run[at : m.start()], letter]
        at, hit = m.end(), True
    return "".join([*out, run[at:]]) if hit else None


def _foreign(plain: str) -> bool:
    """Whether a run is of letters that other languages write: further Latin ones, or at least two Greek or Cyrillic ones."""
    other = [c for c in plain if c not in _PLAIN and ord(c) > 0x7F]
    script = [c for c in other if "Ͱ" <= c <= "ӿ"]
    return all(c.isalpha() and ("À" <= c <= "ſ" or c in script) for c in other) and len(script) != 1


@lru_cache(maxsize=200_000)
def readings(run: str) -> tuple[tuple[str, str], ...]:
    """`(swap, plain)` for every swap that could have made the run of sound letters."""
    found, foreign = {}, {}
    for page in READ_AS:
        plain = run
        for times in (1, 2, 3):
            before, plain = plain, _utf8_once(plain, page)
            if plain is None:
                if times > 1 and _foreign(before):
                    foreign.setdefault(before, f"utf-8>{page}x{times - 1}")
                break
            if all(c in _PLAIN or ord(c) < 0x80 for c in plain):
                found.setdefault(plain, f"utf-8>{page}x{times}")
                break
    found = found or foreign
    for swap in SWAPS:
        table = _letters_of(swap)
        if any(ord(c) in table for c in run):
            plain = run.translate(table)
            if all(c in _PLAIN for c in plain):
                found.setdefault(plain, f"{swap[0]}>{swap[1]}")
    return tuple((s, p) for p, s in found.items())


def _right(text: str, at: int) -> str:
    """The two characters from a place on, as far as they are ASCII; what is not may be garbled itself."""
    two = text[at : at + 2].ljust(2)
    return two if two.isascii() else two[:1]


@lru_cache(maxsize=None)
def _modelled() -> frozenset[str]:
    """The characters that readings and what they are read from are made of, lower case: the letter model's alphabet."""
    pages = {c for page in {*READ_AS, *(p for swap in SWAPS for p in swap)} for c in _bytes_of(page)}
    more = {chr(c) for a, b in ((0, 0x80), (0xC0, 0x180), (0x370, 0x500)) for c in range(a, b)}
    return frozenset("".join(pages | more | _PLAIN).lower())


#: What the letter model has for any other character.
_OTHER = "\uffff"


@lru_cache(maxsize=200_000)
def _folded(s: str) -> str:
    s = s.lower()
    return s if s.isascii() else "".join(c if c in _modelled() else _OTHER for c in s)


def contexts(text: str) -> list[tuple[int, str, str, str]]:
    """Of each non-ASCII run: where it begins, the two characters before it, itself, up to two after it."""
    return [(m.start(), text[max(0, m.start() - 2) : m.start()].rjust(2), m[0], _right(text, m.end())) for m in _RUN.finditer(text)]


@dataclass
class Letters:
    """Counts of one to three letters, lower case, of a fixed alphabet; unseen ones fall back to shorter ones."""

    counts: tuple[Counter, Counter, Counter] = field(default_factory=lambda: (Counter(), Counter(), Counter()))
    total: float = 0.0

    def add(self, left: str, run: str, right: str, n: float) -> None:
        s = _folded(left + run + right)
        for i in range(2, len(s)):
            self.counts[0][s[i]] += n
            self.counts[1][s[i - 1 : i + 1]] += n
            self.counts[2][s[i - 2 : i + 1]] += n
        self.total += n * max(0, len(s) - 2)

    def cost(self, left: str, run: str, right: str) -> float:
        """Minus the log-probability of the run and what follows it, given what precedes it."""
        s, out = _folded(left + run + right), 0.0
        c1, c2, c3 = self.counts
        for i in range(2, len(s)):
            p = (c1[s[i]] + 0.5) / (self.total + 100)
            p = (c2[s[i - 1 : i + 1]] + 2 * p) / (c1[s[i - 1]] + 2)
            p = (c3[s[i - 2 : i + 1]] + 1 * p) / (c2[s[i - 2 : i]] + 1)
            out -= math.log(max(p, 1e-12))
        return out


def _known(letters: Letters, left: str, plain: str, right: str) -> bool:
    """Whether sound text holds the letters at both ends of a reading beside these neighbours."""
    s = _folded(left[-1] + plain + (right[:1] or " "))
    return letters.counts[2][s] > 0 if len(s) == 3 else letters.counts[1][s[:2]] > 0 and letters.counts[1][s[-2:]] > 0


@dataclass
class Cipher:
    """What EM has learnt of each source: probabilities of swaps, and its mapping of units to letters."""

    swaps: dict[str, dict[str, float]]
    letters: Letters
    sound: float = 0.9
    #: A reading must be this probable.
    least: float = 0.5
    #: By source, the letter learnt for each unit that no listed swap explains in its contexts, and its probability.
    units: dict[str, dict[str, tuple[str, float]]] = field(default_factory=dict)
    #: By source and unit, what it stands for: `{letters: (share of its occurrences, share of these that sound text knows)}`.
    mapping: dict[str, dict[str, dict[str, tuple[float, float]]]] = field(default_factory=dict)
    #: `(source, unit, own)` of the units beyond those held here, if there are any; own is what lend() takes.
    rest: DataFrame | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rest": None}

    def lend(self, source: str, own: list[dict]) -> None:
        """Hold what is known of these units of the rest."""
        for x in own:
            self.mapping.setdefault(source, {})[x["unit"]] = {r["plain"]: (r["share"], r["known"]) for r in x.get("readings") or ()}
            if x.get("letter"):
                self.units.setdefault(source, {})[x["unit"]] = (x["letter"], x["p"])

    def take_back(self, source: str, own: list[dict]) -> None:
        """Forget lent units."""
        for x in own:
            self.mapping.get(source, {}).pop(x["unit"], None)
            self.units.get(source, {}).pop(x["unit"], None)

    def options(self, source: str, left: str, run: str, right: str) -> list[tuple[str, str]]:
        """`(swap, letters)` a run may stand for: what code pages suggest, unless the source's contexts speak against it."""
        own = self.mapping.get(source, {}).get(run, {})
        out = []
        for swap, plain in readings(run):
            if len(plain) == len(run):  # a letter for a letter: no structure of bytes speaks for it
                known = own[plain][1] if plain in own else float(_known(self.letters, left, plain, right))
                if known < 0.5:
                    continue
            out.append((swap, plain))
        return out

    def posterior(self, source: str, left: str, run: str, right: str, sound: float | None = None, only: frozenset[str] | None = None) -> tuple[str | None, float, str]:
        """The best reading of a run, or None, the probability that the run is garbled, and the swap.

        `sound` is the probability beforehand that it is not; `only` limits the swaps.
        """
        options = [o for o in self.options(source, left, run, right) if only is None or o[0] in only]
        if not options:
            letter, p = self.units.get(source, {}).get(run, (None, 0.0))
            if letter is None or only is not None and LEARNT not in only:
                return None, 0.0, ""
            return (letter.upper() if (left[-1] + right[:1]).strip().isupper() else letter), p, LEARNT
        own = self.mapping.get(source, {}).get(run, {})
        if sound is None:
            sound = min(0.95, max(0.5, 1 - sum(w for w, _ in own.values()))) if own else self.sound
        swaps = self.swaps.get(source, {})
        base = self.letters.cost(left, run, right)
        weights = []
        for swap, plain in options:
            prior = swaps.get(swap, 1e-3) if only is None else 1.0
            # signs foreign to sound text, and bytes that happen to make up a whole letter, speak for a swap
            odd = sum(c not in _PLAIN for c in run) + max(0, len(run) - len(plain))
            bonus = 2.0 * min(odd, 4)
            if len(plain) == len(run):  # accented letters don't come in rows: that is a word in another script
                bonus -= 6.0 * max(0, sum(c in _LETTERS for c in plain) - 2)
            weights.append(prior * math.exp(min(60.0, base - self.letters.cost(left, plain, right) + bonus)))
        whole = sum(weights)
        best = max(range(len(weights)), key=weights.__getitem__)
        garbled = (1 - sound) * whole / (sound + (1 - sound) * whole)
        return options[best][1], garbled, options[best][0]


def context_counts(texts: DataFrame) -> DataFrame:
    """`(source, lft, run, rgt, n)` of all non-ASCII runs of `(source, text)`, and of a sample-free letter count of plain words."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for b in batches:
            for source, text in zip(b["source"], b["text"]):
                for _, left, run, right in contexts(text):
                    seen[(source, left, run, right)] += 1
            if len(seen) > 100_000:
                yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["source", "lft", "run", "rgt", "n"])
                seen = Counter()
        if seen:
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["source", "lft", "run", "rgt", "n"])

    parts = texts.where(F.col("text").rlike("[^\\x00-\\x7F]")).select("source", "text").mapInPandas(count, "source string, lft string, run string, rgt string, n long")
    return parts.groupBy("source", "lft", "run", "rgt").agg(F.sum("n").alias("n"))


#: A task passes its sums on after so many contexts; all contexts of all sources are covered.
MODEL_CONTEXTS = 20_000


@dataclass(frozen=True)
class Bounds:
    """When a unit's own letter is believed: contexts it has, the letter's share, and its contexts that sound text has.

    Of the mapping, `units` units are held in memory; those of the rest are joined to where they occur.
    """

    contexts: int = 5
    share: float = 0.8
    known: float = 0.8
    longest: int = 3
    units: int = 20_000


def _model(grams: DataFrame) -> Letters:
    """The letter model of counts `(gram, n)`; the fixed alphabet bounds what reaches the driver."""
    letters = Letters()
    for gram, n in grams.groupBy("gram").agg(F.sum("n").alias("n")).collect():
        letters.counts[len(gram) - 1][gram] = n
    letters.total = sum(letters.counts[0].values())
    return letters


def _grams(letters: Letters) -> list[tuple[str, float]]:
    return [x for c in letters.counts for x in c.items()]


def sound_letters(counts: DataFrame) -> Letters:
    """The letter model of all contexts whose run is of sound letters."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), MODEL_CONTEXTS):
                own = Letters()
                for _, left, run, right, n in b[at : at + MODEL_CONTEXTS].itertuples(index=False):
                    if all(c in _PLAIN for c in run):
                        own.add(left, run, right, n)
                yield pd.DataFrame(_grams(own), columns=["gram", "n"])

    return _model(counts.mapInPandas(count, "gram string, n double"))


def learn_units(counts: DataFrame, letters: Letters, rounds: int = 3, bounds: Bounds = Bounds()) -> DataFrame | None:
    """`(source, unit, letter, p)` of units within words that no listed swap explains; None if there are none.

    E-step: each context of a unit is shared among the letters by the unit's letter probabilities
    and the letter model of sound text. M-step: the shares' sums are the new probabilities, which
    begin equal. Probabilities are a table that is joined to the contexts.
    """
    plain = sorted({c.lower() for c in _LETTERS})
    shared = counts.sparkSession.sparkContext.broadcast(letters)
    rows = counts.select("source", "lft", "run", "rgt", F.lit(None).cast("string").alias("own"))

    def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, sums = shared.value, {}
        for b in batches:
            for source, left, run, right, own in b.itertuples(index=False):
                if len(run) > bounds.longest or LOST in run or all(c in _PLAIN for c in run):
                    continue
                if any(len(p) < len(run) and all(c in _PLAIN for c in p) or _known(letters, left, p, right) for _, p in readings(run)):
                    continue  # a listed swap explains it here
                if not (left[-1].isalpha() or right[:1].isalpha()):
                    continue
                own = {x["letter"]: x["w"] for x in json.loads(own)} if own else None
                before = sum(own.values()) if own else 1.0
                weights = {c: (own.get(c, 1e-6 * before) / before if own else 1.0) * math.exp(-letters.cost(left, c, right)) for c in plain}
                whole = sum(weights.values())
                for c, w in weights.items():
                    if w > 1e-3 * whole:
                        at = sums.setdefault((source, run, c), [0.0, 0.0])
                        at[0] += w / whole
                        at[1] += w / whole * (letters.counts[2][_folded(left[-1] + c + right[:1])] > 0)
            if len(sums) > 100_000:
                yield pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=["source", "unit", "letter", "w", "known"])
                sums = {}
        yield pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=["source", "unit", "letter", "w", "known"])

    for _ in range(rounds):
        parts = rows.mapInPandas(expect, "source string, unit string, letter string, w double, known double")
        parts = parts.groupBy("source", "unit", "letter").agg(F.sum("w").alias("w"), F.sum("known").alias("known"))
        listed = parts.groupBy("source", "unit").agg(F.sum("w").alias("all"), F.collect_list(F.struct("letter", "w", "known")).alias("own"))
        found = cut(listed.where(F.col("all") >= bounds.contexts - 1e-6), "letters")
        if found.isEmpty():
            return None
        own = found.select("source", F.col("unit").alias("run"), F.to_json("own").alias("own"))
        rows = counts.join(own, ["source", "run"]).select("source", "lft", "run", "rgt", "own")
    best = F.array_min(F.transform("own", lambda x: F.struct((-x["w"]).alias("w"), x["letter"].alias("letter"), x["known"].alias("known"))))
    out = found.select("source", "unit", "all", best.alias("b")).select("source", "unit", F.col("b.letter").alias("letter"), (-F.col("b.w") / F.col("all")).alias("p"), (F.col("b.known") / -F.col("b.w")).alias("known"))
    return out.where((F.col("p") >= bounds.share) & (F.col("known") >= bounds.known)).drop("known")


_STATE = {"source": "string", "unit": "string", "all": "double", "readings": "array<struct<plain: string, share: double, known: double>>", "letter": "string", "p": "double"}


def _cipher(swaps: dict[str, dict[str, float]], letters: Letters, readings_: DataFrame | None, units: DataFrame | None, bounds: Bounds) -> Cipher:
    """The cipher with what is known of `bounds.units` units held, those that occur most; plain letters, which may come out of others, are held always."""
    cipher = Cipher(swaps, letters)
    known = [d for d in (readings_, units) if d is not None]
    if not known:
        return cipher
    state = known[0] if len(known) == 1 else known[0].join(known[1], ["source", "unit"], "full")
    state = cut(state.select(*[(F.col(c) if c in state.columns else F.lit(None)).cast(t).alias(c) for c, t in _STATE.items()]), "mapping")
    letter = F.col("unit").isin(sorted({x for c in _LETTERS for x in (c, c.upper(), c.lower()) if not x.isascii()}))
    often = state.where(~letter).orderBy(F.desc_nulls_last("all"), "source", "unit").limit(bounds.units)
    held = [*state.where(letter).collect(), *often.collect()]
    for r in held:
        cipher.lend(r["source"], [r.asDict(recursive=True)])
    if state.count() > len(held):
        keys = state.sparkSession.createDataFrame([(r["source"], r["unit"]) for r in held], "source string, unit string") if held else state.limit(0).select("source", "unit")
        rest = state.join(F.broadcast(keys), ["source", "unit"], "left_anti")
        cipher.rest = cut(rest.select("source", "unit", F.to_json(F.struct("unit", "readings", "letter", "p")).alias("own")), "rest")
    return cipher


#: Marks sums that are counts of letters.
_GRAM = "letters"


def learn(counts: DataFrame, rounds: int = 3, bounds: Bounds = Bounds()) -> Cipher:
    """Expectation-maximisation over context counts.

    All contexts count for the letter model and all readings for the mapping. What reaches the
    driver is bounded: counts of letters of a fixed alphabet, the sums of each source's swaps, and
    what is known of the `bounds.units` most frequent units; the other units' part of the mapping
    stays a table, `Cipher.rest`, and is joined to the contexts and texts that have them.
    """
    units = learn_units(counts, letters := sound_letters(counts), bounds=bounds)
    units = None if units is None else cut(units, "units")
    cipher = _cipher({}, letters, None, units, bounds)
    for _ in range(rounds):
        shared = counts.sparkSession.sparkContext.broadcast(cipher)
        rows = counts.select("source", "lft", "run", "rgt", "n")
        if cipher.rest is None:
            rows = rows.withColumn("own", F.lit(None).cast("string"))
        else:
            rows = rows.join(cipher.rest.withColumnRenamed("unit", "run"), ["source", "run"], "left").select("source", "lft", "run", "rgt", "n", "own")

        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cipher, sums, fresh, seen = shared.value, {}, Letters(), 0

            def all_sums() -> pd.DataFrame:
                lines = [(*k, *v) for k, v in sums.items()] + [("", gram, "", _GRAM, n, 0.0) for gram, n in _grams(fresh)]
                return pd.DataFrame(lines, columns=["source", "unit", "plain", "swap", "w", "known"])

            for b in batches:
                for source, left, run, right, n, own in b.itertuples(index=False):
                    if LOST in run:
                        continue
                    lent = [json.loads(own)] if own else []
                    cipher.lend(source, lent)
                    plain, p, swap = cipher.posterior(source, left, run, right)
                    cipher.take_back(source, lent)
                    fresh.add(left, plain if p > 0.5 else run, right, n)
                    seen += 1
                    if readings(run):
                        at = sums.setdefault((source, run, run, ""), [0.0, 0.0])
                        at[0] += n * (1 - p)
                        if plain is not None and swap != LEARNT:
                            at = sums.setdefault((source, run, plain, swap), [0.0, 0.0])
                            at[0] += n * p
                            at[1] += n * p * _known(cipher.letters, left, plain, right)
                    if seen % MODEL_CONTEXTS == 0:
                        yield all_sums()
                        sums, fresh = {}, Letters()
            yield all_sums()

        sums = rows.mapInPandas(expect, "source string, unit string, plain string, swap string, w double, known double")
        sums = cut(sums.groupBy("source", "unit", "plain", "swap").agg(F.sum("w").alias("w"), F.sum("known").alias("known")), "sums")
        swaps: dict[str, dict[str, float]] = {}
        for source, swap, w in sums.where(~F.col("swap").isin("", _GRAM)).groupBy("source", "swap").agg(F.sum("w").alias("w")).collect():
            swaps.setdefault(source, {})[swap] = w
        swaps = {s: {k: max(1e-3, v / max(1e-9, sum(own.values()))) for k, v in own.items()} for s, own in swaps.items()}
        each = sums.where(F.col("swap") != _GRAM).groupBy("source", "unit").agg(F.sum("w").alias("all"), F.collect_list(F.when(F.col("swap") != "", F.struct("plain", "w", "known"))).alias("r")).where(F.size("r") > 0)
        share = lambda x: F.struct(x["plain"].alias("plain"), (x["w"] / F.greatest("all", F.lit(1e-9))).alias("share"), (x["known"] / F.greatest(x["w"], F.lit(1e-9))).alias("known"))
        fresh = _model(sums.where(F.col("swap") == _GRAM).select(F.col("unit").alias("gram"), F.col("w").alias("n")))
        cipher = _cipher(swaps, fresh, each.select("source", "unit", "all", F.transform("r", share).alias("readings")), units, bounds)
    return cipher


class _Signs:
    """One sign, of the planes for private use, for each unit that stands for something: what translate() maps."""

    FIRST, LAST = 0xF0000, 0x10FFFD

    def __init__(self):
        self.of: dict[tuple[str, str], str] = {}
        self.table: dict[int, str] = {}

    def restart(self) -> None:
        """Forget all signs if few are left; to be called between texts."""
        if self.LAST - self.FIRST - len(self.of) < 40_000:
            self.of.clear()
            self.table.clear()

    def sign(self, unit: str, plain: str) -> str:
        got = self.of.get((unit, plain))
        if got is None:
            if self.FIRST + len(self.of) > self.LAST:
                return plain
            got = self.of[unit, plain] = chr(self.FIRST + len(self.of))
            self.table[ord(got)] = plain
        return got


def _needed(run: str) -> set[str]:
    """The units that restoring a run may ask for: itself, and those of what it may stand for."""
    return {run, *(r for _, p in readings(run) for r in _RUN.findall(p))}


def _with_rest(texts: DataFrame, rest: DataFrame) -> DataFrame:
    """`(source, text)` texts, with what the rest knows of the units that each may ask for as `_own`."""

    def needed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for source, digest, text in b.itertuples(index=False):
                units = sorted({u for run in set(_RUN.findall(text)) for u in _needed(run)})
                yield pd.DataFrame({"source": source, "_digest": digest, "unit": units})

    rows = texts.withColumn("_digest", F.sha2("text", 256))
    units = rows.select("source", "_digest", "text").mapInPandas(needed, "source string, _digest string, unit string").distinct()
    own = units.join(rest, ["source", "unit"]).groupBy("source", "_digest").agg(F.to_json(F.collect_list("own")).alias("_own"))
    return rows.join(own, ["source", "_digest"], "left").drop("_digest")


def restore(texts: DataFrame, cipher: Cipher, *carry: str) -> DataFrame:
    """`(*carry, text, restored, restorable)` of the texts with garbled characters.

    `restorable` is false where characters are lost for good (U+FFFD); the rest of such a text is
    restored. Null and plain ASCII texts are never garbled.
    """
    kinds = dict(texts.dtypes)
    shared = texts.sparkSession.sparkContext.broadcast(cipher)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in carry] + ["text string, restored string, restorable boolean"])

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cipher, known, signs = shared.value, {}, {}

        def decide(*key) -> tuple[str | None, str]:
            if key not in known:
                if len(known) > 200_000:
                    known.clear()
                plain, p, swap = cipher.posterior(*key)
                known[key] = (plain, swap) if p > cipher.least else (None, "")
            return known[key]

        def put(source: str, text: str, *more) -> tuple[str, frozenset[str]]:
            out, at, swaps, before = [], 0, set(), ""
            own = signs.setdefault(source, _Signs())
            own.restart()
            free = max(text) < chr(_Signs.FIRST)  # else the text holds such signs itself
            for start, left, run, right in contexts(text):
                if before and start - at < 2:  # what precedes was restored itself
                    left = (before + text[at:start])[-2:].rjust(2)
                plain, swap = decide(source, left, run, right, *more)
                if plain is not None:
                    out += [text[at:start], own.sign(run, plain) if free else plain]
                    at, before = start + len(run), plain
                    swaps.add(swap)
            if not swaps:
                return text, frozenset()
            marked = "".join([*out, text[at:]])
            return marked.translate(own.table) if free else marked, frozenset(swaps)

        for b in batches:
            keep, restored, whole = [], [], []
            for k, (source, text, own) in enumerate(zip(b["source"], b["text"], b["_own"])):
                lent = [json.loads(x) for x in json.loads(own)] if own else []
                cipher.lend(source, lent)
                fixed, swaps = put(source, text)
                if swaps:  # other runs of the value have likely gone the same way
                    fixed, _ = put(source, fixed, 0.5, swaps)
                cipher.take_back(source, lent)
                if swaps or LOST in text:
                    keep.append(k)
                    restored.append(fixed)
                    whole.append(LOST not in text)
            if keep:
                own = b.iloc[keep]
                yield own[[*carry, "text"]].assign(restored=restored, restorable=whole)

    rows = texts.where(F.col("text").rlike("[^\\x00-\\x7F]")).select(*carry, *([] if "source" in carry else ["source"]), "text")
    rows = rows.withColumn("_own", F.lit(None).cast("string")) if cipher.rest is None else _with_rest(rows, cipher.rest)
    return rows.mapInPandas(apply, schema)

"""Detectors of thirteen entity types, as Columns over a text, and their registry."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import ADDRESS_NAME, ADDRESS_WORDS, DETECTOR_ORDER, FULL_NAME, INITIALS, LETTERS, NAME_WINDOW, PATTERNS, PERSON_KEYS, POSTAL_INDEX
from ..functions.spans import NONE, find, from_each, no_spans, resolve, span
from ..functions.text import bound, canonical_product, clean, is_wide

Detector = Callable[[Column], Column]
Dictionary = dict[str, list[str]]

_ADDRESS_WORD = rf"(?:^|(?<=[^{LETTERS}]))(?=[ГДКЛМНОПРСУШгдклмнопрсуш\u1c80-\u1c88])(?:{'|'.join(ADDRESS_WORDS)})(?=[^{LETTERS}]|$)"
_ADDRESS_KEY = rf"(?=[\u0400-\u052f\u1c80-\u1c88])(?iU){_ADDRESS_WORD}"
_ADDRESS_PART = rf"(?iU:{_ADDRESS_WORD})(?:{ADDRESS_NAME})?"
#: From an address word on: further words, names and numbers, over blanks and single commas.
_ADDRESS_PHRASE = rf"(?U)^{_ADDRESS_PART}(?:[ \t]*(?:,[ \t]*)?(?:{_ADDRESS_PART}|\d+))*"


CYRILLIC = "[А-Яа-яЁё]"
#: Nine digits with nothing but blanks, hyphens and brackets between them: the fewest of a number without a key word.
DIGITS = r"(?U)\d(?:[\s\-()]*+\d){8}"
#: The letters that a Cyrillic one may match in any case.
ANY_CYRILLIC = r"[\u0400-\u052F\u1C80-\u1C8F\u2DE0-\u2DFF\uA640-\uA69F]"
#: The first letters of the keys of persons, of which most places of a text have none.
_PERSON_KEY = f"(?=[ВвГгЗзКкПпСсФф\u1c80\u1c83]){PERSON_KEYS}"


def needs(pattern: str) -> str:
    """What a match of one of the fixed patterns has to hold: a Cyrillic key word, an at sign, or digits."""
    return CYRILLIC if re.search(f"{CYRILLIC}{{2}}|р/с", pattern) else "@" if "@" in pattern else DIGITS


def entry_pattern(entry: str, plus: bool = False) -> str:
    """An entry as a pattern, in any case and not beside letters; a plus sign stands with any spacing if asked for."""
    quoted = lambda s: "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    body = r"\s*\+\s*".join(quoted(p.strip()) for p in entry.split("+")) if plus else quoted(entry)
    return f"(?iU)(?<![{LETTERS}]){body}(?![{LETTERS}])"


def longest_first(entries: Iterable[str]) -> list[str]:
    return sorted(entries, key=lambda e: -len(e))


def from_entries(kind: str, entries: list[str], order: int) -> Detector:
    """Every entry's matches, overlapping ones of different entries too. For dictionaries of up to some hundred entries; see dictionary_spans."""

    def detect(text: Column) -> Column:
        found = [find(text, entry_pattern(e, kind == "PRODUCT"), kind, order, needs=f"(?iU)\\Q{first_word(e)}\\E" if first_word(e) else None) for e in longest_first(entries)]
        spans = F.concat(*found) if found else no_spans()
        if kind == "PRODUCT":
            spans = F.transform(spans, lambda s: span(canonical_product(s["value"]), kind, s["start"], s["end"], order))
        return spans.cast(NONE)

    return detect


def persons(text: Column, order: int) -> Column:
    """After each key, the first full name and the first surname with initials within the window."""

    def named(key: Column, length: Column, pattern: str) -> Column:
        tail = F.substring(key["head"], length + 1, F.lit(NAME_WINDOW))
        value, at = F.regexp_extract(tail, pattern, 0), F.regexp_instr(tail, F.lit(pattern))
        start = key["start"] + length + at - 1
        return F.when(at > 0, span(value, "PERSON", start, start + F.length(value), order))

    def both(key: Column) -> Column:
        return bound(F.length(F.regexp_extract(key["head"], f"^{PERSON_KEYS}", 0)), lambda n: F.array(named(key, n, FULL_NAME), named(key, n, INITIALS)))

    found = F.transform(from_each(text, _PERSON_KEY, 2 * NAME_WINDOW), both)
    return F.when(text.rlike(_PERSON_KEY), F.array_compact(F.flatten(found))).otherwise(no_spans()).cast(NONE)


#: Characters that an address is looked for in, and how far from their end it has to stop; else all that follows is read.
ADDRESS_REACH, ADDRESS_REST = 400, 100


def addresses(text: Column, order: int) -> Column:
    """Postal indexes and, from each address word, the phrase that grows from it. The span keeps what is trimmed off the value."""

    def grown(key: Column) -> Column:
        near = F.regexp_extract(F.substring(key["head"], F.lit(1), F.lit(ADDRESS_REACH)), _ADDRESS_PHRASE, 0)
        # A phrase that goes on to near the end of what was read, or all but blanks to it, is read in the whole text.
        rest = F.substring(key["head"], F.length(near) + 1, F.lit(ADDRESS_REST))
        whole = F.regexp_extract(F.substring(text, key["start"] + 1, F.length(text)), _ADDRESS_PHRASE, 0)
        cut = (F.length(near) > ADDRESS_REACH - ADDRESS_REST) | (F.length(rest) == ADDRESS_REST) & rest.rlike(r"^[ \t]*(,[ \t]*)?$")
        phrase = F.when(cut, whole).otherwise(near)
        return bound(phrase, lambda p: span(F.btrim(p, F.lit(" ,.;")), "ADDR", key["start"], key["start"] + F.length(p), order))

    phrases = F.filter(F.transform(from_each(text, _ADDRESS_KEY, ADDRESS_REACH + ADDRESS_REST), grown), lambda s: F.length(s["value"]) >= 3)
    phrases = F.when(text.rlike(_ADDRESS_KEY), phrases).otherwise(no_spans())
    return F.concat(find(text, POSTAL_INDEX, "ADDR", order, 1), phrases).cast(NONE)


def detectors(dictionary: Dictionary | None = None) -> dict[str, Detector]:
    """By type, in the order of registration. Add to the result, or replace in it, to plug in a type of one's own."""
    own = {k: list(v) for k, v in (dictionary or {}).items()}

    def of(kind: str, order: int) -> list[tuple[str | None, Detector]]:
        """Parts of a detector, each with a pattern that stands in every text where it finds something."""
        parts = [(needs(p), lambda text, p=p, g=g: find(text, p, kind, order, g)) for t, p, g in PATTERNS if t == kind]
        for cyrillic in (True, False):
            entries = [e for e in own.get(kind, []) if bool(re.match(CYRILLIC, first_word(e))) == cyrillic]
            if entries:
                parts.append((ANY_CYRILLIC if cyrillic else None, from_entries(kind, entries, order)))
        if kind == "PERSON":
            parts.append((CYRILLIC, lambda text: persons(text, order)))
        if kind == "ADDR":
            parts.append((CYRILLIC, lambda text: addresses(text, order)))
        return parts

    return {kind: _of_parts(of(kind, i)) for i, kind in enumerate(DETECTOR_ORDER)}


def _holds(text: Column, need: str) -> Column:
    return F.contains(text, F.lit("@")) if need == "@" else text.rlike(need)


def _of_parts(parts: list[tuple[str | None, Detector]]) -> Detector:
    """A detector of parts: each pattern that texts need is looked for once, however many parts need it, and those of Cyrillic only in
    texts that have characters beyond Latin ones."""
    by_need: dict[str | None, list[Detector]] = {}
    for need, part in parts:
        by_need.setdefault(need, []).append(part)

    def detect(text: Column) -> Column:
        def joined(needed: Iterable[str | None]) -> Column:
            found = [(need, F.concat(*(p(text) for p in by_need[need])).cast(NONE)) for need in needed]
            spans = [F.when(_holds(text, need), x).otherwise(no_spans()) if need else x for need, x in found]
            return F.concat(*spans).cast(NONE) if spans else no_spans()

        wide = [need for need in by_need if need in (CYRILLIC, ANY_CYRILLIC)]
        others = joined(need for need in by_need if need not in wide)
        return F.concat(others, F.when(is_wide(text), joined(wide)).otherwise(no_spans())).cast(NONE) if wide else others

    detect.parts = parts
    return detect


def all_spans(text: Column, registry: dict[str, Detector]) -> Column:
    """What all detectors find, overlaps included. Parts of detectors that need the same are taken together."""
    return _of_parts([part for d in registry.values() for part in getattr(d, "parts", [(None, d)])])(text)


def with_spans(units: DataFrame, dictionary: Dictionary | None = None, text_col: str = "text", registry: dict[str, Detector] | None = None) -> DataFrame:
    """units with their text cleaned and a column spans, overlaps resolved. Null texts have no spans."""
    cleaned = units.withColumn(text_col, clean(F.col(text_col)))
    found = cleaned.withColumn("spans", F.coalesce(all_spans(F.col(text_col), registry or detectors(dictionary)), no_spans()))
    return found.withColumn("spans", resolve(F.col("spans")))


def each_span(found: DataFrame) -> DataFrame:
    """A row for each of spans, as s. The outer form keeps the optimizer from testing for emptiness first, which would find
    everything twice."""
    return found.withColumn("s", F.explode_outer("spans")).drop("spans").filter("s is not null")


def first_word(entry: str) -> str:
    m = re.search(r"\w+", entry.lower())
    return m[0] if m else ""

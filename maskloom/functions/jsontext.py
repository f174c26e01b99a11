"""JSON as text: cut into tokens, laid out with an indent of two, values told apart from keys; Column functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, running_long

_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
#: A key with its colon, an empty container, a string, a bracket, a comma, or a number or word.
_PART = rf'(?s){_STRING}(?:\s*+:)?|[\[{{]\s*+[\]}}]|[\[\]{{}},]|[^\s\[\]{{}},:"]++'
#: What is put between the characters of keys while values are looked through; no JSON holds it unescaped.
GUARD = "\u0001"
_SHORT = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def json_escaped(value: Column) -> Column:
    """A text as it stands within the quotes of a JSON string; other control characters in hexadecimal, in lower case."""
    for raw, to in _SHORT.items():
        value = F.replace(value, F.lit(raw), F.lit(to))
    rest = [chr(i) for i in range(32) if chr(i) not in _SHORT]
    hexed = value
    for c in rest:
        hexed = F.replace(hexed, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    return F.when(value.rlike("[\\x00-\\x1f]"), hexed).otherwise(value)


def _plain(string: Column) -> Column:
    """A JSON string with no escapes but those it needs."""
    read = F.from_json(F.concat(F.lit("["), string, F.lit("]")), "array<string>")[0]
    return F.when(F.contains(string, F.lit("\\")), F.concat(F.lit('"'), json_escaped(read), F.lit('"'))).otherwise(string)


def json_layout(text: Column, guard: str = "") -> Column:
    """A JSON text laid out anew, a line for each member, keys in their order and numbers as written; null for no JSON.

    guard: a character put between any two of each key's, so that a search of the result finds nothing in keys.
    """

    def key(part: Column) -> Column:
        name = _plain(F.regexp_replace(part, r"\s*+:\z", ""))
        return F.concat(F.regexp_replace(name, "(?s)(?<=.)(?=.)", guard) if guard else name, F.lit(": "))

    def laid(parts: Column) -> Column:
        steps = F.transform(parts, lambda p: F.when(p.isin("{", "["), 1).when(p.isin("}", "]"), -1).otherwise(0))
        line = lambda depth: F.concat(F.lit("\n"), F.repeat(F.lit("  "), depth))

        def one(part: Column, depth: Column) -> Column:
            return (
                F.when(part == ",", F.concat(part, line(depth)))
                .when(F.startswith(part, F.lit('"')), F.when(F.endswith(part, F.lit(":")), key(part)).otherwise(_plain(part)))
                .when(part.isin("{", "["), F.concat(part, line(depth + 1)))
                .when(part.isin("}", "]"), F.concat(line(depth - 1), part))
                .when(part.rlike(r"^[\[{]"), F.concat(F.substring(part, 1, 1), F.substring(part, -1, 1)))
                .otherwise(part)
            )

        return F.array_join(F.zip_with(parts, running_long(steps), one), "")

    return F.when(F.try_parse_json(text).isNotNull(), bound(F.regexp_extract_all(text, F.lit(_PART), F.lit(0)), laid))

"""Scalar functions on text, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import CYRILLIC, LATIN, NORMAL_FROM, NORMAL_TO, TABLE_SUFFIXES, TEXT_SUFFIXES

_BLANK = r"[\s\x1c-\x1f\x85]"


def bound(value: Column, use) -> Column:
    """use(value), with value computed once however often use refers to it."""
    return F.transform(F.array(value), use)[0]


def normalise(text: Column) -> Column:
    """Unusual spaces and hyphens become plain ones, zero-width characters go. Texts without any are only looked through."""
    return F.when(text.rlike(f"[{NORMAL_FROM}]"), F.translate(text, NORMAL_FROM, NORMAL_TO)).otherwise(text)


def strip(text: Column) -> Column:
    """Without blanks at both ends, by Unicode."""
    return F.regexp_replace(text, rf"(?U)^{_BLANK}+|{_BLANK}+\z", "")


def marker(text: Column) -> Column:
    """Text as markers are compared: normalised, ё as е, lower case, stripped; null as empty."""
    return strip(F.lower(F.translate(normalise(F.coalesce(text.cast("string"), F.lit(""))), "ёЁ", "еЕ")))


#: A run of letters and hyphens that holds a Cyrillic letter and a Latin look-alike, as every word of both does. Each run is looked at once.
_MIXED = rf"(?<![A-Za-zА-Яа-яЁё-])(?=[A-Za-zА-Яа-яЁё-]*[А-Яа-яЁё])[A-Za-zА-Яа-яЁё-]*[{LATIN}]"


#: What normalisation replaces and Cyrillic letters, with some more, as few ranges: a list of single characters takes five times as long.
_UNUSUAL = "[\u00a0\u00ad\u2007-\u2011\u202f\u0401-\u0451]"
#: One range that has all of these but the first two, and all that matches a Cyrillic letter in any case.
_WIDE = "[\u0400-\ua69f]"


def is_ascii(text: Column) -> Column:
    """Whether each character is one byte, which is told without decoding the text."""
    return F.octet_length(text) == F.length(text)


def is_wide(text: Column) -> Column:
    """Whether a text has any character from Cyrillic on; without one, no Cyrillic pattern matches. Most texts are told from one look at
    each character, those of plain letters from their sizes."""
    return ~is_ascii(text) & text.rlike(_WIDE)


def fix_homoglyphs(text: Column) -> Column:
    """In words with a Cyrillic letter, Latin look-alikes become Cyrillic. A word is letters with single hyphens inside."""
    word = "[A-Za-zА-Яа-яЁё]+(?:-[A-Za-zА-Яа-яЁё]+)*"
    fixed = F.transform(F.regexp_extract_all(text, F.lit(f"({word})")), lambda w: F.when(w.rlike("[А-Яа-яЁё]"), F.translate(w, LATIN, CYRILLIC)).otherwise(w))
    whole = F.array_join(F.flatten(F.zip_with(F.split(text, word, -1), fixed, lambda gap, w: F.array(gap, F.coalesce(w, F.lit(""))))), "")
    return F.when(text.rlike("[А-Яа-яЁё]") & text.rlike(_MIXED), whole).otherwise(text)


def clean(text: Column) -> Column:
    """What detectors read: normalised, look-alikes repaired. Texts with nothing to change are looked through, once if they hold no Cyrillic."""
    unusual = F.contains(text, F.lit("\u00a0")) | F.contains(text, F.lit("\u00ad")) | text.rlike(_WIDE)
    looked = ~is_ascii(text) & unusual & text.rlike(_UNUSUAL) & (text.rlike(f"[{NORMAL_FROM}]") | text.rlike(_MIXED))
    return F.when(looked, bound(normalise(text), fix_homoglyphs)).otherwise(text)


def pseudonym(kind: Column, n: Column) -> Column:
    """TYPE_0001; four digits at least."""
    return F.format_string("%s_%04d", kind, n)


def canonical_product(value: Column) -> Column:
    return strip(F.regexp_replace(value, r"(?U)\s*\+\s*", " + "))


def md_cell(value: Column) -> Column:
    return F.replace(F.replace(F.coalesce(value, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def md_row(cells: Column, width: Column | int | None = None) -> Column:
    """'| a | b |', padded with empty cells to the width."""
    shown = F.transform(cells, md_cell)
    if width is not None:
        width = width if isinstance(width, Column) else F.lit(width)
        shown = F.concat(shown, F.array_repeat(F.lit(""), F.greatest(width - F.size(cells), F.lit(0)).cast("int")))
    return F.concat(F.lit("| "), F.array_join(shown, " | "), F.lit(" |"))


def md_table(rows: Column) -> Column:
    """Lines of a table whose first row is its header: an array; none for no rows."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    lines = F.transform(rows, lambda r: md_row(r, width))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.when(F.size(rows) == 0, F.array().cast("array<string>")).otherwise(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, 1_000_000_000)))


def column_letter(n: Column) -> Column:
    """A for 1, Z for 26, AA for 27, to ZZZ."""
    digit = lambda x: F.char(65 + F.pmod(x, F.lit(26)))
    one, two, three = n - 1, n - 27, n - 703
    return (
        F.when(n <= 26, digit(one))
        .when(n <= 702, F.concat(digit(F.floor(two / 26)), digit(two)))
        .otherwise(F.concat(digit(F.floor(three / 676)), digit(F.floor(three / 26)), digit(three)))
    )


def _literal(value: Column) -> Column:
    """A value as a pattern for itself."""
    return F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


#: Sizes that are summed up without chunks.
FEW_SIZES = 100


def _running_few(sizes: Column) -> Column:
    """(total, the sums ahead of each) of a short array."""
    begun = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("ahead"))
    return F.aggregate(sizes, begun, lambda acc, x: F.struct((acc["total"] + x).alias("total"), F.concat(acc["ahead"], F.array(acc["total"])).alias("ahead")))


def in_chunks(values: Column, step: Column) -> Column:
    """An array cut into arrays of `step` elements."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / step) - 1, F.lit(0)).cast("int")), lambda k: F.slice(values, k * step + 1, step))


def root(n: Column) -> Column:
    """The root of a count, rounded up, 1 at least."""
    return F.greatest(F.ceil(F.sqrt(n.cast("double"))), F.lit(1)).cast("int")


def _shifted(chunks: Column, ahead: Column) -> Column:
    """The sums within each of the chunks, put behind what is ahead of the chunk."""
    return F.flatten(F.zip_with(chunks, ahead, lambda c, at: F.transform(c["ahead"], lambda x: x + at)))


def _totals(chunks: Column) -> Column:
    return F.transform(chunks, lambda c: c["total"])


def running(sizes: Column) -> Column:
    """For each of the sizes the sum of those ahead of it. In chunks of the root of their number, as arrays are copied when added to."""
    each = lambda own: F.transform(bound(root(F.size(own)), lambda step: in_chunks(own, step)), _running_few)
    whole = lambda chunks: _shifted(chunks, _running_few(_totals(chunks))["ahead"])
    few = lambda own: F.when(F.size(own) <= FEW_SIZES, _running_few(own)["ahead"]).otherwise(bound(each(own), whole))
    return bound(sizes, few)


def running_long(sizes: Column) -> Column:
    """As running(), for arrays of millions: chunks of FEW_SIZES, and chunks of these."""
    each = lambda own: F.transform(in_chunks(own, F.lit(FEW_SIZES)), _running_few)
    few = lambda own: F.when(F.size(own) <= FEW_SIZES, _running_few(own)["ahead"]).otherwise(bound(each(own), lambda chunks: _shifted(chunks, running(_totals(chunks)))))
    return bound(sizes, few)


def _starts(pieces: Column, first: Column, step: Column) -> Column:
    """Where each piece but the first begins, given where the second does and what stands between two of them."""
    return F.transform(running(F.transform(F.slice(pieces, 2, F.size(pieces)), lambda x: F.length(x) + step)), lambda at: at + first)


def occurrences(text: Column, value: Column, start: Column | int = 0) -> Column:
    """Starts of all occurrences of value from start on, overlapping ones too: an array of zero-based offsets. One pass over the text."""
    start = start if isinstance(start, Column) else F.lit(start)
    # Cut ahead of each place; a character is put in front so that a place at the very start is cut off as well.
    cut = F.split(F.concat(F.lit("\u0000"), text), F.concat(F.lit("(?="), _literal(value), F.lit(")")), -1)
    found = bound(cut, lambda c: _starts(c, F.length(c[0]) - 1, F.lit(0)))
    return F.when(F.contains(text, value) & (value != ""), F.filter(found, lambda i: i >= start)).otherwise(F.array().cast("array<int>"))


def places(text: Column, value: Column) -> Column:
    """Starts of the occurrences of value, each looked for behind the one before: an array of zero-based offsets."""
    cut = F.split(text, _literal(value), -1)
    found = bound(cut, lambda c: _starts(c, F.length(c[0]), F.length(value)))
    return F.when(F.contains(text, value) & (value != ""), found).otherwise(F.array().cast("array<int>"))


def line_and_column(text: Column, offset: Column) -> Column:
    """'line.column' of an offset: lines from 1, columns from 0."""
    head = F.substring(text, F.lit(1), offset)
    return F.concat_ws(".", F.size(F.split(head, "\n", -1)).cast("string"), F.length(F.substring_index(head, "\n", -1)).cast("string"))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    name = file_name(path)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_replace(name, r"\.[^.]+$", "")).otherwise(name)


def suffix(path: Column) -> Column:
    """With its dot, lower case; empty if none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def parent(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def is_supported(path: Column) -> Column:
    return suffix(path).isin(TEXT_SUFFIXES + TABLE_SUFFIXES)


def restored_name(path: Column) -> Column:
    """The file name of a restored artifact."""
    name = file_name(path)
    return (
        F.when(name == "index.json", "_deanon_index.json")
        .when(F.contains(name, F.lit("_anon")), F.regexp_replace(name, "^(.*?)_anon", "$1_deanon"))
        .otherwise(F.concat(stem(path), F.lit("_deanon"), F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)))
    )


def location(sheet: Column, row: Column, cell: Column, block: Column, col: Column) -> Column:
    """Where a candidate stands, in words."""
    in_sheet = F.concat_ws(" ", sheet, cell)
    in_table = F.format_string("block %d, row %d, column %d", block, row, col)
    return F.when(sheet.isNotNull(), in_sheet).when(col.isNotNull(), in_table).otherwise(F.format_string("block %d", block))

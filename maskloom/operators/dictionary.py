"""Dictionaries of any size, found in texts of any length.

Texts are cut into blocks that overlap by the longest entry. Every entry has an anchor, that of its words which comes least
often in the texts, and only where an entry's anchor stands is the entry looked for, at the one place that it can begin.
A word is a run of the letters that guard an entry, or a run of digits; an entry's runs of letters stand whole wherever
the entry does, and so do its runs of digits but for one at an end, which may go on in the text: at the right end, so many
digits of a run are looked for. Entries without any such word are anchored by their first characters.

Words and places are shuffled, not texts; each block is read once more with the candidates that begin in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import DETECTOR_ORDER, LETTERS
from ..functions.spans import NONE, find, no_spans, resolve
from ..functions.text import bound, canonical_product, clean
from ..plans.storage import stored
from .detect import all_spans, detectors

#: Characters of a block.
BLOCK = 1 << 15
WORD = f"[{LETTERS}]+|[0-9]+"
#: How many characters an entry without words is anchored by.
GRAM = 3
WHOLE, LEFT_PART, CHARACTERS = 0, 1, 2
#: So many different words of a dictionary (some 10 MB) are sent to all tasks; more are met by key.
SENT_WORDS = 100_000


def quoted(entry: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(entry, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def entry_regex(entry: Column, plus: Column) -> Column:
    """An entry as a pattern, in any case and not beside letters; a plus sign stands with any spacing where asked for."""
    spaced = F.array_join(F.transform(F.split(entry, r"\+", -1), lambda p: F.when(F.trim(p) == "", "").otherwise(quoted(F.trim(p)))), r"\s*\+\s*")
    return F.concat(F.lit(f"(?iU)(?<![{LETTERS}])"), F.when(plus, spaced).otherwise(quoted(entry)), F.lit(f"(?![{LETTERS}])"))


def _blocks(units: DataFrame, key: list[str], text_col: str, margin: int) -> DataFrame:
    """key, _block, _low (where its text begins), _part (its text, with a margin on either side)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = units.select(*key, text.alias("_text")).withColumn("_n", F.greatest(F.ceil(F.length("_text") / BLOCK), F.lit(1)).cast("int"))
    cut = cut.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    cut = cut.withColumn("_low", F.greatest(F.col("_block") * BLOCK - margin, F.lit(0)))
    part = F.when(F.col("_n") == 1, F.col("_text")).otherwise(F.substring("_text", F.col("_low") + 1, F.col("_block") * BLOCK - F.col("_low") + BLOCK + margin))
    return cut.select(*key, "_block", "_low", part.alias("_part"))


def _words(text: Column) -> Column:
    return find(text, WORD, "", 0)


def _anchors(entries: DataFrame) -> DataFrame:
    """type, entry, plus, word, kind, off: all words that an entry could be anchored by, off being where the word stands in it."""
    digits = lambda w: w["value"].rlike("^[0-9]")
    fits = F.filter(_words(F.col("entry")), lambda w: ~digits(w) | (w["start"] > 0))
    anchor = lambda word, kind, off: F.struct(F.lower(word).alias("word"), kind.alias("kind"), off.alias("off"))
    own = lambda w: anchor(w["value"], F.when(digits(w) & (w["end"] == F.length("entry")), LEFT_PART).otherwise(WHOLE), w["start"])
    # What stands around a plus sign is left open, so such an entry is anchored by what is ahead of the first, or by that sign.
    head = F.trim(F.substring_index("entry", "+", 1))
    begins = F.when(F.col("plus"), F.when(head == "", "+").otherwise(head)).otherwise(F.col("entry"))
    bare = F.array(anchor(F.substring(begins, 1, GRAM), F.lit(CHARACTERS), F.lit(0)))
    anchors = bound(fits, lambda words: F.when(F.size(words) > 0, F.transform(words, own)).otherwise(bare))
    return entries.select("type", "entry", "plus", F.explode(anchors).alias("w")).select("type", "entry", "plus", "w.*")


def _grams(part: Column, sizes: list[int]) -> Column:
    """Every run of so many characters that begins with neither a letter nor a blank, with its place."""

    def runs(chars: Column) -> Column:
        one = lambda c, i: F.when(~c.rlike(f"[{LETTERS}]"), F.transform(F.array(*map(F.lit, sizes)), lambda n: F.struct(F.lower(F.array_join(F.slice(chars, i + 1, n), "")).alias("word"), F.lit(CHARACTERS).alias("kind"), i.alias("pos"))))
        return F.flatten(F.filter(F.transform(chars, one), lambda x: x.isNotNull()))

    return bound(F.regexp_extract_all(part, F.lit("(?s)."), F.lit(0)), runs)


def _places(blocks: DataFrame, key: list[str], asked: DataFrame) -> DataFrame:
    """key, _block, _low, word, kind, pos: where the words asked for stand, written."""
    # A row for each kind and length of anchors; lengths are those of a dictionary's numbers.
    shapes = {(r["kind"], r["n"]) for r in asked.select("kind", F.when(F.col("kind") != WHOLE, F.length("word")).alias("n")).distinct().collect()}
    lengths = sorted(n for k, n in shapes if k == LEFT_PART)
    sizes = sorted(n for k, n in shapes if k == CHARACTERS)
    s = lambda w, kind, pos: F.struct(w.alias("word"), F.lit(kind).alias("kind"), pos.alias("pos"))
    whole = lambda words: F.transform(words, lambda w: s(F.lower(w["value"]), WHOLE, w["start"]))
    cut = lambda w: F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(w["value"])), lambda n: s(F.substring(w["value"], F.lit(1), n), LEFT_PART, w["start"]))
    numbers = lambda words: F.flatten(F.transform(F.filter(words, lambda w: (w["value"] >= "0") & (w["value"] < ":")), cut))
    found = [bound(_words(F.col("_part")), lambda words: F.concat(whole(words), numbers(words)) if lengths else whole(words))]
    if sizes:
        found.append(_grams(F.col("_part"), sizes))
    listed = blocks.select(*key, "_block", "_low", F.explode(F.concat(*found)).alias("x")).select(*key, "_block", "_low", "x.*")
    words = stored(asked.select("word", "kind").distinct(), "words")
    return stored(listed.join(F.broadcast(words) if words.count() <= SENT_WORDS else words, ["word", "kind"], "left_semi"), "places")


def _anchored(asked: DataFrame, places: DataFrame) -> DataFrame:
    """type, entry, plus, self, word, kind, off: each entry with the rarest of its words. One of whose words there is none is left out.
    self: whether its own matches can overlap each other."""
    often = places.groupBy("word", "kind").agg(F.count("*").alias("n"))
    met = asked.join(often, ["word", "kind"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = met.groupBy("type", "entry", "plus").agg(F.min(F.struct("n", "off", "word", "kind")).alias("b")).filter("b.n > 0")
    itself = F.exists(F.sequence(F.lit(1), F.greatest(F.length("entry") - 1, F.lit(1))), lambda k: (k < F.length("entry")) & (F.lower(F.right("entry", k)) == F.lower(F.left("entry", k))))
    return stored(best.select("type", "entry", "plus", (itself & ~F.col("plus")).alias("self"), "b.word", "b.kind", "b.off"), "anchors")


def _apart(found: DataFrame, key: list[str]) -> DataFrame:
    """Of an entry's places that overlap each other, from the left, those that begin where the one before has ended."""
    begun = F.struct(F.lit(-1).alias("end"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, s: F.when(s < acc["end"], acc).otherwise(F.struct((s + F.length("entry")).alias("end"), F.concat(acc["out"], F.array(s)).alias("out")))
    runs = found.filter("self").groupBy(*key, "type", "entry").agg(F.array_sort(F.collect_set("start")).alias("_all"))
    kept = runs.select(*key, "type", "entry", F.explode(F.aggregate("_all", begun, step)["out"]).alias("start"))
    return found.filter("not self").unionByName(found.filter("self").join(kept, [*key, "type", "entry", "start"], "left_semi"))


def candidates(units: DataFrame, entries: DataFrame, key: list[str], text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(blocks, places that entries may begin at: key, _block, type, entry, plus, self, start in the block's text)."""
    listed = entries.filter("entry is not null and entry <> ''").select("type", "entry", ((F.col("type") == "PRODUCT") & F.contains("entry", F.lit("+"))).alias("plus")).distinct()
    asked = stored(_anchors(listed), "asked")
    longest = asked.agg(F.max(F.length("entry"))).first()[0] or 0
    blocks = _blocks(units, key, text_col, longest + 1)
    places = _places(blocks, key, asked)
    met = places.join(_anchored(asked, places), ["word", "kind"]).withColumn("start", F.col("pos") - F.col("off"))
    own = (F.col("start") >= 0) & (F.col("start") + F.col("_low") >= F.col("_block") * BLOCK) & (F.col("start") + F.col("_low") < (F.col("_block") + 1) * BLOCK)
    return blocks, met.filter(own | F.col("plus")).select(*key, "_block", "type", "entry", "plus", "self", "start")


def dictionary_spans(units: DataFrame, entries: DataFrame, key: list[str], text_col: str = "text") -> DataFrame:
    """(key, value, type, start, end) for a dictionary (type, entry) of any size. key tells units apart.

    As the detectors search: in any case, not beside letters, an entry's own matches apart from each other, entries' matches
    over each other. A product with plus signs stands with any spacing around them. Letters are compared in lower case one by
    one, so characters whose lower case is that of another alphabet's letter (a Kelvin sign, a long s) don't match. Null and empty entries
    and null texts have no matches; entries that come twice are taken once.
    """
    blocks, met = candidates(units, entries, key, text_col)
    met = stored(met, "met")
    plain = met.filter("not plus").groupBy(*key, "_block").agg(F.collect_set(F.struct("start", "type", "entry", "self")).alias("_c"))
    part = F.col("_part")
    letter = lambda at: F.substring(part, at, F.lit(1)).rlike(f"[{LETTERS}]")
    stands = lambda c: (F.lower(F.substring(part, c["start"] + 1, F.length(c["entry"]))) == F.lower(c["entry"])) & ~((c["start"] > 0) & letter(c["start"])) & ~letter(c["start"] + F.length(c["entry"]) + 1)
    said = F.transform(F.filter("_c", stands), lambda c: F.struct(F.substring(part, c["start"] + 1, F.length(c["entry"])).alias("value"), c["type"].alias("type"), c["entry"].alias("entry"), c["self"].alias("self"), (c["start"] + F.col("_low")).alias("start")))
    found = blocks.join(plain, [*key, "_block"]).select(*key, F.explode(said).alias("x")).select(*key, "x.*")
    if not met.filter("self").isEmpty():
        found = _apart(stored(found, "found"), key)
    found = found.select(*key, "value", "type", "start", (F.col("start") + F.length("value")).alias("end"))
    wide = met.filter("plus").select(*key, "type", "entry", "plus").distinct()
    if wide.isEmpty():
        return found.distinct()
    texts = units.select(*key, F.col(text_col).alias("_text"))
    spaced = texts.join(wide, key).select(*key, "type", F.explode(find(F.col("_text"), entry_regex(F.col("entry"), F.col("plus")), F.col("type"), 0)).alias("s"))
    return found.unionByName(spaced.select(*key, canonical_product(F.col("s.value")).alias("value"), "type", "s.start", "s.end")).distinct()


def with_dictionary(units: DataFrame, entries: DataFrame, key: list[str], text_col: str = "text") -> DataFrame:
    """units with their text cleaned and a column spans, of all detectors and of a dictionary (type, entry) of any size, overlaps resolved."""
    cleaned = stored(units.withColumn(text_col, clean(F.col(text_col))), "cleaned")
    order = F.array_position(F.array(*map(F.lit, DETECTOR_ORDER)), F.col("type")).cast("int") - 1
    one = F.struct("value", "type", "start", "end", order.alias("ord"))
    listed = dictionary_spans(cleaned, entries, key, text_col).groupBy(*key).agg(F.collect_list(one).cast(NONE).alias("_listed"))
    both = F.concat(F.coalesce(all_spans(F.col(text_col), detectors()), no_spans()), F.coalesce("_listed", no_spans()))
    # As a column of its own: resolve() refers to its spans several times, and each time all detectors would run.
    found = cleaned.join(listed, key, "left").withColumn("spans", both).drop("_listed")
    return found.withColumn("spans", resolve(F.col("spans")))

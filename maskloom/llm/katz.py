"""Language-model scoring by Katz backoff.

Tokens are words and one end for each document, which also is the context of its first word. Bigram counts with
Good-Turing discounts back off to unigrams with weights that make each context's probabilities sum to one exactly.
Every word of the training rows has an id and is a context and part of bigrams of its own. The `common` most frequent
ones are sent to all tasks, with their counts and, as contexts, their weights; ids and counts of all others are joined
by word, and the sums that give their weights come with the counts of bigrams. Which words are common changes no score.

Documents are dealt to chunks. A chunk sums its bigrams first and asks the owner of each range of bigrams for the totals
of those it holds, as sorted and compressed arrays; the owner adds up all requests, keeps its part of the table and
answers each chunk. So a bigram that all documents share is one entry for each chunk.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, sliced, stored, text_of

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Ids of words that training rows lack (or of the class of further words) and of the end; the other words follow.
FURTHER, END = 0, 1
WIDTH = 31
#: Words that are sent to all tasks.
COMMON = (1 << 18) - 2
#: Counts up to K are discounted.
K = 5


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learnt from: crc32 of the id as text, mod 5, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_LOWER).split()


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n) over the training rows (_t, held_out); the end is the empty word. Tasks count before they send."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[bytes] = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["word", "n"])
            n.clear()
            return out

        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                n.update(_words(text))
                n[b""] += 1
                if len(n) > 400_000:
                    yield sent()
        yield sent()

    return rows.filter("not held_out").select("_t").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, vocabulary: int) -> tuple[list[bytes], np.ndarray]:
    """The most frequent words, `vocabulary` at most, most frequent first, with their counts: those above a bound of n that fits."""
    step = F.floor(F.log2("n") * 32)
    steps = {r["s"]: r["k"] for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("k")).collect()}  # 2,048 rows at most
    least, total = math.inf, 0
    for s in sorted(steps, reverse=True):
        total += steps[s]
        if total > vocabulary:
            break
        least = s
    if least == math.inf:
        return [], np.zeros(0, np.int64)
    top = counts.filter((step >= least) & (F.col("word") != F.lit(b""))).toArrow()
    words, n = top.column("word").to_pylist(), top.column("n").to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    return [words[i] for i in order], n[order]


def numbered(counts: DataFrame, words: list[bytes], n: np.ndarray) -> DataFrame:
    """(word, id, n) of the words that are not common, numbered on from those: by part, and by place within it."""
    rest = F.col("word") != F.lit(b"")
    if words:
        rest &= F.col("n") < int(n[-1])  # frequent() takes all words of a count or none
    told = stored(counts.filter(rest).withColumn("_at", F.monotonically_increasing_id()), "further")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = {r["p"]: r["k"] for r in told.groupBy(part.alias("p")).agg(F.count("*").alias("k")).collect()}  # a row for each part
    at, starts = END + 1 + len(words), []
    for k in sorted(sizes):
        starts.append((k, at))
        at += sizes[k]
    if at > 1 << WIDTH:
        raise ValueError(f"more than {1 << WIDTH} distinct words")
    before = told.sparkSession.createDataFrame(starts, "_p long, _before long")
    return told.withColumn("_p", part).join(F.broadcast(before), "_p").select("word", (F.col("_before") + place).alias("id"), "n")


def tokenised(rows: DataFrame, words: list[bytes]) -> DataFrame:
    """(row, _id, held_out, n_tokens, ids, n_places, places, further): ids, compressed, the end last; further: the distinct words
    without an id. Where one stands, ids has FURTHER, and the words' places among further are in places, in turn."""
    number = {w: i for i, w in enumerate(words, END + 1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = number.get
        for batch in sliced(batches):
            ids, n, further, places, n_places = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                own = _words(text)
                found = np.array([*map(get, own, [FURTHER] * len(own)), END], np.uint32)
                ids.append(_press(found))
                n.append(len(found))
                place: dict[bytes, int] = {}
                at = [place.setdefault(own[i], len(place)) for i in np.flatnonzero(found == FURTHER)]
                places.append(_press(np.array(at, np.uint32)))
                n_places.append(len(at))
                further.append(list(place))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(n_places, pa.int64()), pa.array(places, pa.binary()), pa.array(further, pa.list_(pa.binary()))], names)

    names = ["_id", "held_out", "n_tokens", "ids", "n_places", "places", "further"]
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.select("_id", "held_out", "_t").mapInArrow(run, f"_id {kind}, held_out boolean, n_tokens long, ids binary, n_places long, places binary, further array<binary>").withColumn("row", F.monotonically_increasing_id())


#: What a chunk needs of its documents' tokens.
PARTS = ["n_tokens", "ids", "n_places", "places"]


def looked_up(chunked: DataFrame, table: DataFrame) -> DataFrame:
    """(chunk, row, place, id, n): for each row's further words their ids and training counts; FURTHER and 0 where there are none."""
    asked = chunked.select("chunk", "row", F.posexplode("further").alias("place", "word"))
    return asked.join(table, "word", "left").select("chunk", "row", F.col("place").cast("long").alias("place"), F.coalesce("id", F.lit(FURTHER)).cast("long").alias("id"), F.coalesce("n", F.lit(0)).alias("n"))


def _press(x: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of bytes."""
    return pa.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def _unpress(blob: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(blob, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(n).astype(np.int64)


def _press_keys(keys: np.ndarray) -> bytes:
    return _press(np.diff(keys, prepend=0))


def _unpress_keys(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpress(blob, n))


def _owners(keys: np.ndarray, owners: int, spread: int) -> np.ndarray:
    """Each bigram's owner: its context's, but for contexts below `spread`, so frequent that their bigrams go to all owners."""
    context = keys >> WIDTH
    own = np.where(context < spread, keys, context).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((own >> np.uint64(33)) % np.uint64(owners)).astype(np.int64)


class _Chunk:
    """A chunk's documents: tokens, each one's training count where it isn't common, distinct bigrams by owner and key, and each token's place among them."""

    def __init__(self, docs: pa.Table, found: pa.Table, owners: int, spread: int):
        docs = docs.sort_by("row")
        found = found.sort_by([("row", "ascending"), ("place", "ascending")])
        self.docs, self.row = docs, docs.column("row")
        column = lambda x: docs.column(x).to_pylist()
        each = [*map(_unpress, column("ids"), column("n_tokens"))]
        self.tokens = np.concatenate(each)
        self.first = np.cumsum([0, *(len(x) for x in each[:-1])])
        self.further = np.flatnonzero(self.tokens == FURTHER)
        self.n = np.zeros(len(self.tokens), np.int64)
        places = [*map(_unpress, column("places"), column("n_places"))]
        start = np.searchsorted(found.column("row").to_numpy(), self.row.to_numpy())
        at = np.concatenate([p + a for p, a in zip(places, start, strict=True)]).astype(np.int64)
        self.tokens[self.further] = found.column("id").to_numpy()[at]
        self.n[self.further] = found.column("n").to_numpy()[at]
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.first] = END
        keys, one, at = np.unique(before << WIDTH | self.tokens, return_index=True, return_inverse=True)
        own = _owners(keys, owners, spread)
        order = np.lexsort((keys, own))
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.keys, self.own, self.at, self.word_n = keys[order], own[order], place[at], self.n[one][order]

    def cuts(self) -> list[tuple[int, int]]:
        """Each owner's stretch of keys."""
        cut = np.flatnonzero(np.diff(self.own, prepend=-1)).tolist()
        return list(zip(cut, [*cut[1:], len(self.own)], strict=True))


def _contexts(keys: np.ndarray, common: int) -> np.ndarray:
    """The contexts that are not common, sorted."""
    context = keys >> WIDTH
    return np.unique(context[context >= common])


def _sums(keys: np.ndarray, counts: np.ndarray, masses: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts, and for each how many bigrams were seen 1 to K + 1 times, the sum of counts over K, and the sum of its bigrams' words' masses."""
    context, at = np.unique(keys >> WIDTH, return_inverse=True)
    by = lambda w: np.bincount(at, w, len(context)).astype(np.int64)
    return context, np.array([*(by(counts == r) for r in range(1, K + 2)), by(counts * (counts > K)), by(masses)], np.int64).reshape(K + 3, len(context))


def requests(chunked: DataFrame, found: DataFrame, owners: int, spread: int) -> DataFrame:
    """(owner, chunk, n, keys, counts, masses): each chunk's distinct bigrams by owner, with their counts in training documents
    and the masses of their words where those aren't common, which are twice the counts and one."""

    def ask(key, docs, found):
        if not docs.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        c = _Chunk(docs, found, owners, spread)
        train = ~np.array(c.docs.column("held_out").to_pylist(), bool)
        weight = np.repeat(train, np.diff(np.append(c.first, len(c.tokens)))).astype(float)
        counts = np.bincount(c.at, weight, len(c.keys)).astype(np.int64)
        parts = [(int(c.own[a]), key[0].as_py(), b - a, _press_keys(c.keys[a:b]), _press(counts[a:b]), _press(2 * c.word_n[a:b] + 1)) for a, b in c.cuts()]
        return pa.table([pa.array(x, k) for x, k in zip(zip(*parts, strict=True), kinds, strict=True)], names)

    names, kinds = ["owner", "chunk", "n", "keys", "counts", "masses"], [pa.int64()] * 3 + [pa.binary()] * 3
    left = chunked.select("chunk", "row", "held_out", *PARTS).groupBy("chunk")
    return left.cogroup(found.groupBy("chunk")).applyInArrow(ask, "owner long, chunk long, n long, keys binary, counts binary, masses binary")


def answered(asked: DataFrame, mass: np.ndarray) -> DataFrame:
    """(owner, chunk, n, counts, m, sums): for each request the totals of its bigrams and the sums of its contexts that aren't
    common. With a null chunk: the sums of the common contexts, whose ids are counts; and with owner -1, of all others together.
    mass: those of the common words."""

    def answer(key, t):
        n = t.column("n").to_pylist()
        asked = [_unpress_keys(k, m) for k, m in zip(t.column("keys").to_pylist(), n, strict=True)]
        keys, one, at = np.unique(np.concatenate(asked), return_index=True, return_inverse=True)
        counts = np.concatenate([_unpress(c, m) for c, m in zip(t.column("counts").to_pylist(), n, strict=True)])
        totals = np.bincount(at, counts, len(keys)).astype(np.int64)
        word = keys & ((1 << WIDTH) - 1)
        masses = np.where(word < len(mass), mass[np.minimum(word, len(mass) - 1)], np.concatenate([_unpress(c, m) for c, m in zip(t.column("masses").to_pylist(), n, strict=True)])[one])
        seen = totals > 0
        context, sums = _sums(keys[seen], totals[seen], masses[seen])
        common = int(np.searchsorted(context, len(mass)))
        own, chunk = key[0].as_py(), [None, None, *t.column("chunk").to_pylist()]
        ends = np.cumsum([0, *n])
        far, far_sums = context[common:], np.append(sums[:, common:], np.zeros((K + 3, 1), np.int64), 1)
        replies = [(common, _press(context[:common]), common, _press(sums[:, :common].ravel())), (0, b"", 1, _press(sums[:, common:].sum(1)))]
        for a, b, k in zip(ends.tolist(), ends[1:].tolist(), asked, strict=False):
            wanted = _contexts(k, len(mass))
            place = np.searchsorted(far, wanted)
            there = (place < len(far)) & (np.append(far, -1)[place] == wanted)
            replies.append((b - a, _press(totals[at[a:b]]), len(wanted), _press(far_sums[:, np.where(there, place, len(far))].ravel())))
        size, blobs, m, sum_blobs = zip(*replies, strict=True)
        return pa.table([pa.array([own, -1, *[own] * len(n)], pa.int64()), pa.array(chunk, pa.int64()), pa.array(size, pa.int64()), pa.array(blobs, pa.binary()), pa.array(m, pa.int64()), pa.array(sum_blobs, pa.binary())], ["owner", "chunk", "n", "counts", "m", "sums"])

    return asked.groupBy("owner").applyInArrow(answer, "owner long, chunk long, n long, counts binary, m long, sums binary")


class Backoff:
    """Weights of contexts, from discounts and sums of their bigrams; arrays with a place for each context."""

    def __init__(self, discount: np.ndarray, n: np.ndarray, large: np.ndarray, seen: np.ndarray):
        """For each context: n[r - 1], how many bigrams were seen r times, up to K; the sum of counts over K; the sum of the
        unigram probabilities of what was seen after it."""
        self.discount = discount
        r = np.arange(1, K + 1)
        self.context = (r[:, None] * n[:K]).sum(0) + large
        kept = (discount[:, None] * r[:, None] * n[:K]).sum(0) + large
        # Where nothing of a context's counts is discounted, one more count is left over for what it hasn't seen.
        self.plain = (self.context > 0) & (self.context - kept <= 1e-9 * self.context)
        total = np.maximum(self.context, 1).astype(float)
        left = np.where(self.plain, 1 / (total + 1), (total - kept) / total)
        unseen = 1 - seen
        # What is left goes to unseen words in proportion; a context that has seen all words has none, and gives it to those.
        self.full = (self.context > 0) & (unseen <= 1e-12)
        self.weight = np.where(self.context > 0, np.where(self.full, 0.0, left / np.maximum(unseen, 1e-300)), 1.0)
        self.spread = np.where(self.full, 1 / np.maximum(1 - left, 1e-300), 1.0)

    def probability(self, context: np.ndarray, unigram: np.ndarray, count: np.ndarray) -> np.ndarray:
        """P(word | context) by the context's place, the word's unigram probability and the bigram's training count: discounted
        where it was seen, else by backing off to the unigram."""
        d = np.where((count <= K) & ~self.plain[context], self.discount[np.clip(count, 1, K) - 1], 1.0)
        seen = d * count / np.maximum(self.context[context] + self.plain[context], 1) * self.spread[context]
        return np.where(count > 0, seen, self.weight[context] * unigram)


def good_turing(n: np.ndarray) -> np.ndarray:
    """Discounts of counts 1 to K from how many bigrams were seen 1 to K + 1 times, after Katz. A count for which this gives
    none between 0 and 1, as happens where copies make some counts too frequent, loses a half."""
    r = np.arange(1, K + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        over = (K + 1) * n[K] / n[0]
        d = ((r + 1) * n[1 : K + 1] / n[:K] / r - over) / (1 - over)
    return np.where((d > 0) & (d < 1), d, (r - 0.5) / r)


def fit(table: DataFrame, size: int, whole: float) -> Backoff:
    """The common contexts' weights, and the discounts, from the owners' sums (the rows of answered() without a chunk)."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, n, c, m, x in zip(*(batch.column(x).to_pylist() for x in ("owner", "n", "counts", "m", "sums")), strict=True):
                context = _unpress(c, n) if own >= 0 else np.array([-1], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(context), *map(pa.array, _unpress(x, (K + 3) * m).reshape(K + 3, m))], names)

    names = ["context", *(f"n{r}" for r in range(1, K + 2)), "large", "masses"]
    sums = table.select("owner", "n", "counts", "m", "sums").mapInArrow(summed, ", ".join(f"{x} long" for x in names))
    found = sums.groupBy("context").agg(*(F.sum(x).alias(x) for x in names[1:])).toArrow()  # a row for each common word at most, and one
    at = found.column("context").to_numpy()
    x = np.zeros((K + 3, size + 1), np.int64)
    x[:, at] = np.array([found.column(c).to_numpy() for c in names[1:]])  # -1: all contexts that aren't common
    discount = good_turing(x[: K + 1].sum(1).astype(float))
    x = x[:, :size]
    return Backoff(discount, x[:K], x[K + 1], x[K + 2] / whole)


def katz_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: int | None = None, tokens_in_part: int = 1_000_000) -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability).

    base_score is that of unigrams with half a count added to each and to one unseen word. Null and empty texts are an
    end alone. A null id is not held out; repeated rows count as often as they come and get equal rows. With nothing to
    learn from, every token has probability 1 by either score. Columns other than the two named are not read.
    Where a vocabulary is asked for, words beyond that many share a class in contexts and bigrams, and go by their own
    counts within it; by default there is no such class.
    """
    if vocabulary is not None and vocabulary > COMMON:
        raise ValueError(f"a vocabulary has at most {COMMON} words")
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t"), held_out(id_col).alias("held_out"))
    counts = stored(word_counts(rows), "words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("word") == F.lit(b""), F.col("n"))), F.lit(0)).alias("ends")).first()
    words, n = frequent(counts, COMMON if vocabulary is None else vocabulary)
    n_all, v_all = total["n"], total["v"]
    known = np.concatenate([[0, total["ends"]], n]).astype(np.int64)
    whole = n_all + 0.5 * (v_all + 1)
    # One unseen word; with a vocabulary all further words and that one. Masses are doubled, so that they are whole.
    shared_n, shared_v = (0, 0) if vocabulary is None else (n_all - int(known.sum()), v_all - (total["ends"] > 0) - len(words))
    mass = 2 * known + 1
    mass[FURTHER] = 2 * shared_n + shared_v + 1
    unigram = mass / (2 * whole)
    if not total["ends"]:
        unigram[END] = 0.0 if len(words) else unigram[END]

    tokens = stored(tokenised(rows, words), "tokens")
    parts = 1 + (tokens.agg(F.sum("n_tokens")).first()[0] or 0) // tokens_in_part
    chunked = tokens.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(parts)))
    far = numbered(counts, words, n) if vocabulary is None else counts.select("word", F.lit(FURTHER).cast("long").alias("id"), "n")
    found = stored(looked_up(chunked, far), "found")
    common, any_known = len(mass), int(total["ends"] > 0)
    # Contexts that would be a fair part of an owner's work by themselves are spread; ids are by falling frequency.
    spread = min(common, END + 1 + int((n > tokens_in_part // 8).sum()))
    replies = stored(answered(requests(chunked, found, parts, spread), mass), "bigrams")
    model = fit(replies.filter("chunk is null"), common, 2 * whole)
    log_known = np.log10(known + 0.5)

    def scored(key, left, right):
        if not left.num_rows:
            return left.select([]).slice(0, 0)
        replied = pc.is_valid(right.column("owner"))
        c = _Chunk(left, right.filter(pc.invert(replied)), parts, spread)
        right = right.filter(replied).sort_by("owner")
        column = lambda x: right.column(x).to_pylist()
        count = np.concatenate([_unpress(x, m) for x, m in zip(column("counts"), column("n"), strict=True)])
        asked = np.concatenate([_contexts(c.keys[a:b], common) for a, b in c.cuts()])
        order = np.argsort(asked)
        sums = np.concatenate([_unpress(x, (K + 3) * m).reshape(K + 3, m) for x, m in zip(column("sums"), column("m"), strict=True)], 1)[:, order]
        own = Backoff(model.discount, sums[:K], sums[K + 1], sums[K + 2] / (2 * whole))
        context, word = c.keys >> WIDTH, c.keys & ((1 << WIDTH) - 1)
        p = np.where(word < common, unigram[np.minimum(word, common - 1)], (c.word_n + 0.5) / whole)
        near = context < common
        p[near] = model.probability(context[near], p[near], count[near])
        p[~near] = own.probability(np.searchsorted(asked[order], context[~near]), p[~near], count[~near])
        score = np.log10(np.maximum(p, 1e-300))[c.at]
        # Words of a class go by their own counts within it.
        score += np.where(c.tokens == FURTHER, np.log10(c.n + 0.5) - math.log10(mass[FURTHER] / 2), 0.0)
        is_known, base = np.full(len(c.tokens), any_known), log_known[np.minimum(c.tokens, common - 1)]
        is_known[c.further], base[c.further] = c.n[c.further] > 0, np.log10(c.n[c.further] + 0.5)
        return pa.table([c.row, *(pa.array(np.add.reduceat(x, c.first)) for x in (is_known, base, score))], ["row", "known", "base", "score"])

    told = replies.filter("chunk is not null").unionByName(found, allowMissingColumns=True)
    by_chunk = chunked.select("chunk", "row", *PARTS).groupBy("chunk").cogroup(told.groupBy("chunk"))
    sums = by_chunk.applyInArrow(scored, "row long, known long, base double, score double")
    return tokens.select("row", "_id", "held_out", "n_tokens").join(sums, "row").select(
        F.col("_id").alias(id_col), "held_out", "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * math.log10(whole)).alias("base_score"),
        "score",
    )

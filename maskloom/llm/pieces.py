"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reads the text once; at each position its output links name all pieces that end there, longest first, and
each relaxes the best score of that position. Pieces and scores come from a model file, which is read, never trained.
Where a model's pieces have the space mark in front only, no piece spans from a word to the next one's mark, so the best
segmentation of a text is that of its words, and words seen before are looked up. Characters that no piece holds fall
back to their bytes, or to the unknown piece where the model has no byte pieces. A model that maps characters first, such as
to their compatibility forms, has them mapped by the library's own normaliser; what is decoded is the mapped text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, text_of

MARK = "▁"
# The piece types of the model format, and how far below the lowest score an unknown character is.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
UNKNOWN_PENALTY = 10.0
#: Words up to so many characters are kept, so many of them for each Python worker.
WORD_CHARS, WORDS_KEPT = 48, 300_000


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceModel:
    """Encodes and decodes by the pieces of a model file, as (piece, score, type) in the order of their ids."""

    def __init__(self, pieces: list[tuple[str, float, int]], dummy_prefix: bool = True, trim: bool = False, mapped: Callable[[str], str] | None = None):
        self.dummy_prefix, self.trim, self.mapped, self.seen = dummy_prefix, trim, mapped, {}
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        usable = {p: (i, s) for i, (p, s, kind) in reversed(list(enumerate(pieces))) if kind in (NORMAL, USER_DEFINED) and p}
        self.automaton = ahocorasick.Automaton()
        for p, (i, s) in usable.items():
            self.automaton.add_word(p, (len(p), s, i))
        self.automaton.make_automaton()
        self.single = frozenset(p for p in usable if len(p) == 1)
        self.below = min((s for _, s in usable.values()), default=0.0) - UNKNOWN_PENALTY
        by_word = all(MARK not in p.lstrip(MARK) for p in usable)
        no_newline = not any("\n" in p for p in usable)
        self.words = re.compile(f"\n|{MARK}+(?=\n)|{MARK}*[^{MARK}\n]+|{MARK}+" if no_newline else f"{MARK}*[^{MARK}]+|{MARK}+") if by_word else None
        self.shown = [b"" if kind == CONTROL else bytes([int(p[3:5], 16)]) if kind == BYTE else " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARK, " ").encode() for p, _, kind in pieces]

    @classmethod
    def load(cls, path: str) -> PieceModel:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        return cls.of(model)

    @classmethod
    def of(cls, model) -> PieceModel:
        """From the parsed model file."""
        spec, mapped = model.normalizer_spec, None
        if spec.precompiled_charsmap:
            import sentencepiece

            mapped = sentencepiece.SentencePieceNormalizer(model_proto=model.SerializeToString(), add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False).normalize
        return cls([(p.piece, p.score, p.type) for p in model.pieces], spec.add_dummy_prefix, spec.remove_extra_whitespaces, mapped)

    def _best(self, s: str) -> list[int]:
        """The ids of the best segmentation; of equal ones, that with the longest last piece, and so on backwards."""
        n = len(s)
        score, start, piece = [float("-inf")] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        score[0] = 0.0
        unknown = [i for i, c in enumerate(s) if c not in self.single]
        # Matches come by the position where they end. An unknown character is relaxed before anything that ends later.
        waiting = iter(unknown)
        skip = next(waiting, n)
        for last, (length, own, i) in self.automaton.iter(s):
            while skip < last:
                self._relax(score, start, piece, skip)
                skip = next(waiting, n)
            end = last + 1
            reached = score[end - length] + own
            if reached > score[end] or (reached == score[end] and end - length < start[end]):
                score[end], start[end], piece[end] = reached, end - length, i
        while skip < n:
            self._relax(score, start, piece, skip)
            skip = next(waiting, n)
        ids: list[int] = []
        while n:
            if piece[n] >= 0:
                ids.append(piece[n])
            elif self.bytes:
                ids.extend(self.bytes[b] for b in reversed(s[start[n] : n].encode()))
            else:
                ids.append(self.unknown)
            n = start[n]
        ids.reverse()
        return ids

    def _relax(self, score: list[float], start: list[int], piece: list[int], at: int) -> None:
        """The character at `at`, which is no piece, may be taken as unknown."""
        if score[at] + self.below > score[at + 1]:
            score[at + 1], start[at + 1], piece[at + 1] = score[at] + self.below, at, -1

    def encode(self, text: str) -> list[int]:
        if self.mapped:
            text = self.mapped(text)
        if self.trim:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return []
        s = (MARK + text if self.dummy_prefix else text).replace(" ", MARK)
        if self.words is None:
            return self._best(s)
        ids: list[int] = []
        seen = self.seen
        for w in self.words.findall(s):
            got = seen.get(w)
            if got is None:
                got = self._best(w)
                if len(w) <= WORD_CHARS:
                    if len(seen) >= WORDS_KEPT:
                        seen.clear()
                    seen[w] = got
            ids += got
        return ids

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.shown.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def _model(path: str) -> PieceModel:
    return PieceModel.load(path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """One row per row of docs: id, n_chars, n_tokens, ids, decoded_sha256, round_trip.

    Null and empty texts have no tokens. decoded_sha256 is of the decoded ids; round_trip says whether they are the text
    again, as all are but those that hold the space mark itself, or characters that the model maps to others. Ids and repeated rows are passed on as they are. Columns
    other than the two named are not read.
    """
    path = model or model_path()
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(path)
        for batch in sliced(batches):
            texts = batch.column(1).to_pylist()
            ids = [m.encode(t) for t in texts]
            back = [m.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())),
                 pa.array([hashlib.sha256(b.encode()).hexdigest() for b in back], pa.string()), pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_())],
                ["_id", "n_chars", "n_tokens", "ids", "decoded_sha256", "round_trip"],
            )

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, n_chars long, n_tokens long, ids array<int>, decoded_sha256 string, round_trip boolean").withColumnRenamed("_id", id_col)


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """(id, text) of rows (id, ids); null ids give a null text."""
    path = model or model_path()
    rows = tokens.select(F.col(id_col).alias("_id"), F.col(ids_col).cast("array<int>").alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(path)
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else m.decode(x) for x in batch.column(1).to_pylist()], pa.string())], ["_id", "text"])

    return rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, text string").withColumnRenamed("_id", id_col)

"""SentencePiece encoding and decoding by an automaton over the pieces.

The text is read once through an Aho-Corasick automaton of all pieces.  At each
place the pieces that end there are found along the output links, longest first, and
each relaxes the best score of the place.  A character no piece covers costs
more than any piece and is written as its bytes.

Segmentation never crosses a word start (no piece holds the space mark after another
character), so words are segmented by themselves and remembered in a bounded cache.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed values of the format: the mark of a space and the penalty of an unknown character.
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHED_WORDS = 300_000
#: Rows converted at once.
SLICE = 256


class PieceModel:
    """Pieces and scores of a model file with byte fallback and no text normalisation."""

    def __init__(self, path: str, cached: int = CACHED_WORDS) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        bytes_of = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        if len(bytes_of) < 256:
            raise ValueError("the model has no byte fallback")
        self.byte_ids = [bytes_of[b] for b in range(256)]
        normal = [
            i for i in range(n)
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        ]
        self.automaton = ahocorasick.Automaton()
        for i in normal:
            self.automaton.add_word(self.pieces[i], (i, len(self.pieces[i]), model.get_score(i)))
        self.automaton.make_automaton()
        self.known = {self.pieces[i] for i in normal if len(self.pieces[i]) == 1}
        self.unknown = min(model.get_score(i) for i in normal) - UNKNOWN_PENALTY
        self.surface = [b""] * n
        for i in normal:
            self.surface[i] = self.pieces[i].replace(SPACE, " ").encode()
        for byte, i in bytes_of.items():
            self.surface[i] = bytes([byte])
        self.surface_of_unknown = " ⁇ ".encode()
        for i in range(n):
            if model.is_unknown(i):
                self.surface[i] = self.surface_of_unknown
        words_only = not any(re.search(f"[^{SPACE}]{SPACE}", self.pieces[i]) for i in normal)
        lines_apart = not any("\n" in self.pieces[i] for i in normal)
        word = f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if lines_apart else f"{SPACE}*[^{SPACE}]+|{SPACE}+"
        self.words = re.compile(word if words_only else r"(?s:.+)")
        self.cache = _Words(self, cached)

    def viterbi(self, text: str) -> list[int]:
        """Best segmentation of ``text``: one pass, ties to the longest last piece."""
        best = [0.0] + [-math.inf] * len(text)
        came: list = [None] * (len(text) + 1)
        if self.known.issuperset(text):
            # Every character is a piece, so every place is reached by pieces alone.
            for end, output in self.automaton.iter(text):
                score = best[end + 1 - output[1]] + output[2]
                if score > best[end + 1]:
                    best[end + 1], came[end + 1] = score, output
        else:
            self._relax_with_unknown(text, best, came)
        ids: list[int] = []
        at = len(text)
        while at:
            piece, length, _ = came[at]
            if piece >= 0:
                ids.append(piece)
            else:
                ids += [self.byte_ids[b] for b in reversed(text[at - 1].encode("utf-8", "surrogatepass"))]
            at -= length
        ids.reverse()
        return ids

    def _relax_with_unknown(self, text: str, best: list[float], came: list) -> None:
        for end, found in enumerate(self._outputs(text)):
            single = False
            for output in found:
                single |= output[1] == 1
                score = best[end + 1 - output[1]] + output[2]
                if score > best[end + 1]:
                    best[end + 1], came[end + 1] = score, output
            score = best[end] + self.unknown
            if not single and score > best[end + 1]:
                best[end + 1], came[end + 1] = score, (-1, 1, self.unknown)

    def _outputs(self, text: str) -> Iterator[list]:
        """The pieces that end at each place, without holding those of the whole text."""
        at, found = 0, []
        for end, piece in self.automaton.iter(text):
            while at < end:
                yield found
                at, found = at + 1, []
            found.append(piece)
        while at < len(text):
            yield found
            at, found = at + 1, []

    def encode(self, text: str | None) -> np.ndarray:
        """Identifiers of a text; none for a null or empty one."""
        if not text:
            return np.empty(0, dtype=np.int32)
        marked = SPACE + text.replace(" ", SPACE)
        found = b"".join(map(self.cache.__getitem__, self.words.findall(marked)))
        return np.frombuffer(found, dtype=np.int32)

    def decode(self, ids: list[int]) -> str:
        """The text of identifiers; bytes that are no UTF-8 become replacement characters."""
        data = b"".join(map(self.surface.__getitem__, ids))
        return data.removeprefix(b" ").decode("utf-8", "replace")


class _Words(dict):
    """Word to packed identifiers; at most twice ``limit`` words, the latest used."""

    def __init__(self, model: PieceModel, limit: int) -> None:
        super().__init__()
        self.model, self.limit, self.before = model, limit, {}

    def __missing__(self, word: str) -> bytes:
        packed = self.before.get(word)
        if packed is None:
            packed = array("i", self.model.viterbi(word)).tobytes()
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.before = dict(self)
                self.clear()
            self[word] = packed
        return packed


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def _others(df: DataFrame, *dropped: str) -> list[str]:
    lower = {d.lower() for d in dropped}
    return [c for c in df.columns if c.lower() not in lower]


def _mapped(
    df: DataFrame,
    source: str,
    target: str,
    kind: T.DataType,
    convert: Callable[[pa.Array], pa.Array],
) -> DataFrame:
    """``df`` with ``target`` made from ``source``, a few hundred rows at a time.

    Arrow hands over thousands of rows together; the larger column is made and given
    back in slices, so that a task never holds it for a whole batch.
    """
    kept = _others(df, source, target)
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.col(source).alias(target))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(target, kind)])
    names = [*kept, target]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                columns = [*part.columns[:-1], convert(part.columns[-1])]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, schema)


def encode_documents(
    docs: DataFrame, text_col: str = "text", ids_col: str = "pieces", model: str = MODEL
) -> DataFrame:
    """``docs`` with ``ids_col`` (array of identifiers) in place of the text.

    A null or empty text has no identifiers.  Other columns are kept; one named as
    ``ids_col`` is replaced.  ``model`` is a path every executor can read.
    """

    def convert(texts: pa.Array) -> pa.Array:
        encode = load(model).encode
        found = [encode(t.as_py()) for t in texts]
        offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
        ids = np.concatenate(found) if found else np.empty(0, dtype=np.int32)
        return pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))

    return _mapped(docs, text_col, ids_col, T.ArrayType(T.IntegerType()), convert)


def decode_documents(
    docs: DataFrame, ids_col: str = "pieces", text_col: str = "text", model: str = MODEL
) -> DataFrame:
    """``docs`` with ``text_col`` decoded from the identifiers; no identifiers are an empty text.

    Decoding gives back what was encoded, but for the space mark itself, which is
    read as a space.
    """

    def convert(lists: pa.Array) -> pa.Array:
        decode = load(model).decode
        texts = ("" if not ids.is_valid else decode(ids.values.to_pylist()) for ids in lists)
        return pa.array(texts, pa.string())

    return _mapped(docs, ids_col, text_col, T.StringType(), convert)

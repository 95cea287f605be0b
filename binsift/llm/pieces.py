"""SentencePiece encoding and decoding by one Viterbi pass over an Aho-Corasick automaton of the pieces.

The automaton reports, at each end position, every piece that ends there (its output links); each report relaxes the
best score of that position. The encoding of a text is the piece sequence of the highest summed score; of equal sums,
the one whose last piece is longest, position by position. Characters that no piece covers cost less than any piece and
become their UTF-8 bytes. A blank precedes the text, as the model's dummy prefix; decoding takes it away.

No piece of a vocabulary without inner blanks crosses from one blank-led word to the next, so each word is encoded by
itself and remembered; for other vocabularies the whole text is one word. Blanks are matched as blanks: a literal U+2581
of the text stays apart from them and survives the round trip.

Defined results: null and empty texts have no ids; ids of null decode to null, no ids to the empty text. Repeated rows
are encoded alike. Extra columns pass through untouched; the result columns replace columns of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import arrow_map
from ._text import Remembered

BLANK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass
class Vocabulary:
    """pieces: (text with plain blanks, id, score); bytes_: id of each byte; surface: UTF-8 bytes of each id."""

    pieces: list[tuple[str, int, float]]
    bytes_: list[int]
    surface: list[bytes]

    @classmethod
    def load(cls, path: str = DEFAULT_MODEL) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, bytes_, surface = [], [0] * 256, []
        for i in range(m.get_piece_size()):
            text = m.id_to_piece(i)
            if m.is_byte(i):
                bytes_[int(text[3:5], 16)] = i
                surface.append(bytes([int(text[3:5], 16)]))
            elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
                surface.append(b"")
            else:
                plain = text.replace(BLANK, " ")
                pieces.append((plain, i, m.get_score(i)))
                surface.append(plain.encode())
        return cls(pieces, bytes_, surface)


class Encoder(Remembered):
    """ids of each word met so far, as int32 bytes."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v = vocabulary
        self.automaton = ahocorasick.Automaton()
        for text, i, score in vocabulary.pieces:
            self.automaton.add_word(text, (len(text), i, score))
        self.automaton.make_automaton()
        self.covered = set("".join(t for t, _, _ in vocabulary.pieces))
        self.unknown = min(s for _, _, s in vocabulary.pieces) - 10
        self.single = {t for t, _, _ in vocabulary.pieces if len(t) == 1}
        if any(" " in t.lstrip(" ") for t, _, _ in vocabulary.pieces):
            self.words = re.compile(r"(?s).+")
        else:  # lines end words too where no piece holds a line end
            ends = "".join(c for c in "\n\r\t" if c not in self.covered)
            self.words = re.compile(rf" *[^ {re.escape(ends)}]+| +" + (rf"|[{re.escape(ends)}]" if ends else ""))

    def viterbi(self, word: str) -> list[int]:
        """Ids of the best segmentation of a text, in one pass over the automaton's reports."""
        n = len(word)
        best, last = [0.0] * (n + 1), [(0, -1)] * (n + 1)
        lowest = float("-inf")
        best[1:] = [lowest] * n
        done = 0
        gaps = not self.single.issuperset(word)
        for end, (size, i, score) in self.automaton.iter(word):
            if gaps and end > done:  # positions before this one are final: characters without a piece of their own
                self._fill(word, done, end, best, last)
                done = end
            if (s := best[end + 1 - size] + score) > best[end + 1]:
                best[end + 1], last[end + 1] = s, (size, i)
        if gaps:
            self._fill(word, done, n, best, last)
        out = []
        at = n
        while at:
            size, i = last[at]
            out += [i] if i >= 0 else [self.v.bytes_[b] for b in reversed(word[at - size : at].encode("utf-8", "surrogatepass"))]
            at -= size
        return out[::-1]

    def _fill(self, word: str, start: int, end: int, best: list[float], last: list[tuple[int, int]]) -> None:
        for k in range(start, end):
            if word[k] not in self.single and best[k] + self.unknown > best[k + 1]:
                best[k + 1], last[k + 1] = best[k] + self.unknown, (1, -1)

    def make(self, word: str) -> bytes:
        return np.array(self.viterbi(word), dtype=np.int32).tobytes()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, self.words.findall(" " + text))) if text else b"", dtype=np.int32)


def decode_ids(ids: list[int], surface: list[bytes]) -> str:
    """Text of ids; bytes that are no UTF-8 become U+FFFD, unknown ids nothing."""
    n = len(surface)
    text = b"".join([surface[i] for i in ids if 0 <= i < n]).decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with an array<int> column of ids."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rest = docs.drop(ids)
    schema = T.StructType([*rest.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(shared.value)
        for b in batches:
            found = [e.encode(t or "") for t in b.column(text).cast(pa.string()).to_pylist()]
            at = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            values = pa.array(np.concatenate(found) if found else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(at), values)], [*b.schema.names, ids])

    return arrow_map(rest, run, schema)


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """encoded with the text of its ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    rest = encoded.drop(text)
    schema = T.StructType([*rest.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surface = shared.value.surface
        for b in batches:
            col = b.column(ids)
            flat = col.flatten().to_numpy(zero_copy_only=False).tolist()
            at = np.concatenate(([0], np.cumsum([n or 0 for n in pc.list_value_length(col).to_pylist()]))).tolist()
            valid = col.is_valid().to_pylist()
            texts = [decode_ids(flat[lo:hi], surface) if ok else None for lo, hi, ok in zip(at, at[1:], valid)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, text])

    return arrow_map(rest, run, schema)


def round_trip(docs: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id, ids, n_ids and whether decoding gives the whole text back (null counts as empty), for every document.

    A text is encoded and its ids decoded in one pass, as encode and decode do it, so that neither crosses to Python twice.
    """
    v = Vocabulary.load(model_path)
    shared = docs.sparkSession.sparkContext.broadcast(v)
    own = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([own.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.IntegerType()), T.StructField("exact", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(shared.value)
        for b in batches:
            texts = b.column("text").to_pylist()
            found = [e.encode(t) for t in texts]
            exact = [decode_ids(ids.tolist(), e.v.surface) == t for ids, t in zip(found, texts)]
            n = np.array([len(x) for x in found], dtype=np.int32)
            at = pa.array(np.concatenate((np.zeros(1, np.int32), np.cumsum(n, dtype=np.int32))))
            ids = pa.ListArray.from_arrays(at, pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids, pa.array(n), pa.array(exact, pa.bool_())], ["doc_id", "ids", "n_ids", "exact"])

    return arrow_map(own, run, schema)

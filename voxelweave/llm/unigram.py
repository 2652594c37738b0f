"""Operator 6: unigram encoding and decoding over a double-array trie.

A text gets a whitespace marker (U+2581) in front and for each space. Of all ways to cut it into pieces, Viterbi
search finds the one with the highest sum of log scores; matches from a place are read off a double-array trie
over the pieces' UTF-8 bytes. A character that no piece covers costs `unknown` below the lowest score and is
written as its bytes' pieces; so is a marker that stands in the text itself, which makes decoding exact.
Pieces have no marker behind another character, so the search can't cross from a word to the marker after it: each
run of markers with what follows is searched once and kept in a bounded memo. (Vocabularies with such pieces are
searched whole.)

Vocabulary files are read with their own library and never copied; scores are taken from the file, or where the
file only ranks its pieces (byte-pair models) as those of a Zipf law over the ranks.

Defined results: null and empty texts have no pieces; any text decodes to itself, white space, control and
rare characters included; an empty table gives no rows; repeated rows are encoded alike; extra columns are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelweave.llm.common import batches, crc32_of, held, table, texts_of

MARK = "▁"
LITERAL = ""  # stands for a marker of the text itself while it is cut; a text that holds it is cut without stand-in


@dataclass(frozen=True)
class DoubleArray:
    """base[s] + byte is the next state if check there is s; value[s] is the id of the piece that ends in s, or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @staticmethod
    def build(pieces: list[tuple[bytes, int]]) -> DoubleArray:
        keys = sorted(dict(pieces).items())
        size = 1 << 16
        base, check, value = [0] * size, [-1] * size, [-1] * size
        used = bytearray(size)
        used[0] = 1
        free = mark = 256
        stack = [(0, 0, len(keys), 0)]  # state, range of keys, depth
        while stack:
            state, a, b, depth = stack.pop()
            if len(keys[a][0]) == depth if a < b else False:
                value[state] = keys[a][1]
                a += 1
            if a == b:
                continue
            groups, at = [], a
            while at < b:
                byte, end = keys[at][0][depth], at
                while end < b and keys[end][0][depth] == byte:
                    end += 1
                groups.append((byte, at, end))
                at = end
            free = used.find(0, free)
            free = size if free < 0 else free
            single = len(groups) == 1  # these fill the holes; others look from a mark that moves on where it is crowded
            begin, tried = (free if single else max(free, mark)) - groups[0][0], 0
            while True:
                if begin + 256 >= size:
                    grow = size
                    base += [0] * grow
                    check += [-1] * grow
                    value += [-1] * grow
                    used += bytearray(grow)
                    size += grow
                if not any(used[begin + byte] for byte, _, _ in groups):
                    break
                begin, tried = begin + 1, tried + 1
            if not single and tried > 32:
                mark = begin + groups[0][0]
            base[state] = begin
            for byte, x, y in groups:
                used[begin + byte] = 1
                check[begin + byte] = state
                stack.append((begin + byte, x, y, depth + 1))
        return DoubleArray(np.array(base, np.int32), np.array(check, np.int32), np.array(value, np.int32))


@dataclass(frozen=True)
class Vocabulary:
    """Text pieces with ids and log scores, ids of the 256 byte pieces, and the score of an unknown character."""

    pieces: dict[str, int]
    scores: dict[int, float]
    bytes_: list[int]
    unknown: float

    @staticmethod
    def of(pieces: list[tuple[str, int, float]], bytes_: list[int], below: float = 10.0) -> Vocabulary:
        scores = {i: s for _, i, s in pieces}
        return Vocabulary({p: i for p, i, _ in pieces}, scores, bytes_, min(scores.values(), default=0.0) - below)

    @staticmethod
    def read(path: str) -> Vocabulary:
        """From a SentencePiece file with byte pieces. Where scores are negated ranks, rank r gets -log(r + 2) - log(log(n))."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        bytes_, pieces = [-1] * 256, []
        for i in range(n):
            if model.is_byte(i):
                bytes_[int(model.id_to_piece(i)[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces.append((model.id_to_piece(i), i, model.get_score(i)))
        if min(bytes_) < 0:
            raise ValueError("the vocabulary has no byte pieces")
        if all(s <= 0 and s == int(s) for _, _, s in pieces):
            pieces = [(p, i, float(-np.log(k + 2) - np.log(np.log(n)))) for k, (p, i, _) in enumerate(pieces)]
        return Vocabulary.of(pieces, bytes_)


class _Memo(dict):
    def __init__(self, codec: Unigram, old: dict):
        super().__init__()
        self.codec, self.old = codec, old

    def __missing__(self, segment: str) -> bytes:
        ids = self.old.get(segment)
        if ids is None:
            ids = np.array(self.codec.search(segment), "<u4").tobytes()
        self[segment] = ids
        return ids


class Unigram:
    def __init__(self, vocabulary: Vocabulary, trie: DoubleArray, most: int = 250_000):
        self.vocabulary, self.most = vocabulary, most
        self.base, self.check, self.value = trie.base.tolist(), trie.check.tolist(), trie.value.tolist()
        self.score = vocabulary.scores
        self.crossing = any(MARK in p.lstrip(MARK) for p in vocabulary.pieces)
        top = max([*vocabulary.pieces.values(), *vocabulary.bytes_], default=0)
        self.spelled = [b""] * (top + 1)
        for p, i in vocabulary.pieces.items():
            self.spelled[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(vocabulary.bytes_):
            self.spelled[i] = bytes([b])
        self.memo = _Memo(self, {})

    def search(self, text: str) -> list[int]:
        """Ids of the best cut of a marked text; of equal ones that whose last piece begins first."""
        raw = text.encode("utf-8", "surrogatepass")
        n = len(raw)
        best, came, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        base, check, value, score, unknown = self.base, self.check, self.value, self.score, self.vocabulary.unknown
        size = len(base)
        at = 0
        while at < n:
            first = raw[at]
            width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            here = best[at]
            state, k, single = 0, at, False
            literal = width == 3 and raw[at : at + 3] == b"\xee\x80\x80"
            while k < n and not literal:
                go = base[state] + raw[k]
                if base[state] == 0 or go >= size or check[go] != state:
                    break
                state, k = go, k + 1
                if value[state] >= 0:
                    total = here + score[value[state]]
                    if total > best[k]:
                        best[k], came[k], piece[k] = total, at, value[state]
                    single |= k == at + width
            if not single:
                total = here + unknown
                if total > best[at + width]:
                    best[at + width], came[at + width], piece[at + width] = total, at, -1
            at += width
        out: list[int] = []
        at = n
        while at:
            if piece[at] >= 0:
                out.append(piece[at])
            else:
                part = raw[came[at] : at]
                part = MARK.encode() if part == b"\xee\x80\x80" and LITERAL in text else part
                out += [self.vocabulary.bytes_[b] for b in reversed(part)]
            at = came[at]
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes."""
        if not text:
            return b""
        if LITERAL in text:  # its stand-in can't be told from it: cut it out and give its bytes by hand
            parts = text.split(LITERAL)
            own = np.array([self.vocabulary.bytes_[b] for b in LITERAL.encode()], "<u4").tobytes()
            return own.join([self._marked((MARK if k == 0 else "") + p.replace(MARK, LITERAL).replace(" ", MARK)) for k, p in enumerate(parts)])
        return self._marked(MARK + (text.replace(MARK, LITERAL) if MARK in text else text).replace(" ", MARK))

    def _marked(self, marked: str) -> bytes:
        if not marked:
            return b""
        if len(self.memo) >= self.most:
            self.memo.old = {}
            self.memo = _Memo(self, self.memo)
        get = self.memo.__getitem__
        if self.crossing:
            return get(marked)
        if MARK + MARK in marked:
            return b"".join(map(get, re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", marked)))
        return b"".join(map(get, filter(None, marked.replace(MARK, f"\0{MARK}").split("\0")) if "\0" not in marked else re.findall(f"{MARK}[^{MARK}]*|[^{MARK}]+", marked)))

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.spelled.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw[1:].decode("utf-8", "surrogatepass") if raw else ""


def _codec(shared) -> Unigram:
    key, vocabulary, trie = shared.value
    return held(("unigram", key), lambda: Unigram(vocabulary, trie))


_RESULT = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n_pieces", T.LongType()), T.StructField("n_byte_pieces", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("decoded_crc32", T.LongType()), T.StructField("exact", T.BooleanType())]
)
_ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])


def _encode(source: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    codec = _codec(shared)
    for batch in batches(source):
        ids = [codec.encode(t) for t in texts_of(batch.column(1))]
        offsets = np.cumsum([0, *(len(b) // 4 for b in ids)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(ids), "<i4")))], names=_ENCODED.names)


def _digest(source: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    codec = _codec(shared)
    single = np.zeros(len(codec.spelled), bool)
    single[codec.vocabulary.bytes_] = True
    for batch in batches(source):
        rows = []
        for text in texts_of(batch.column(1)):
            ids = codec.encode(text)
            back = codec.decode(ids)
            rows.append((len(ids) // 4, int(single[np.frombuffer(ids, "<u4")].sum()), crc32_of(ids), crc32_of(back.encode("utf-8", "surrogatepass")), back == text))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.bool_())], names=_RESULT.names)


def _prepare(docs: DataFrame, vocabulary: Vocabulary, doc_id: str, text: str):
    trie = DoubleArray.build([(p.encode(), i) for p, i in vocabulary.pieces.items()])
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, vocabulary, trie))  # the vocabulary's size, whatever the corpus
    return shared, docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def encode(docs: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) of every whole text."""
    shared, rows = _prepare(docs, vocabulary, doc_id, text)
    return rows.mapInArrow(partial(_encode, shared=shared), _ENCODED)


def encode_digest(docs: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and checksums of every whole text's ids, and of what they decode to."""
    shared, rows = _prepare(docs, vocabulary, doc_id, text)
    return rows.mapInArrow(partial(_digest, shared=shared), _RESULT)


def op6_unigram(spark, sf_dir: str) -> DataFrame:
    """All documents, encoded with the pieces of piece_bpe_32k.model and decoded again.

    That file ranks its pieces without log scores; rank r counts as one of a Zipf law, -log(r + 2) - log(log(n)).
    """
    import public_tokenizers

    return encode_digest(table(spark, sf_dir, "documents"), Vocabulary.read(public_tokenizers.path("piece_bpe_32k.model")))

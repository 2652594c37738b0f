"""Token ids of whole texts by the tokenizers library, with a bounded memo of pieces.

Both tokenizers cut a text before they merge bytes, so the ids of a text are those of its pieces one after
another. Here a text of plain characters is cut where the tokenizer always cuts, and the library's model merges
each piece once, as long as the memo holds it. A text with any other character, with white space for which the
cuts are less simple, or with the string of one of the tokenizer's added tokens, goes to the library whole; the
tests hold both ways against a tokenizer read by the library alone.
"""

from __future__ import annotations

import re

import numpy as np
from tokenizers import Tokenizer

from voxelweave.llm.common import held

#: Characters for which cutting here and in the library agree: white space, printable ASCII, Latin letters, common punctuation.
_ODD = re.compile("[^\\t\\n\\r\\x20-\\x7e¡-©«-±´¶¸»¿-įı-ɏ‐-‧€]")
#: White space that the space-delimited cut of byte-level BPE can't handle: runs, ends, and other than space and newline.
_RUNS = ("  ", "\n ", " \n", "\n\n\n", "\t", "\r")
#: What the two tokenizers cut a text into, for plain characters.
_BYTE_LEVEL = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_WORD_LEVEL = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where it is printable, the others in order from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


_LETTERS = _byte_letters()
LONGEST = 48  # longer pieces are not kept, so a memo's entries bound its bytes


class _Memo(dict):
    """Piece -> ids. Pieces that the generation before knows are taken over from it."""

    def __init__(self, model, words: bool, old: dict[str, bytes]):
        super().__init__()
        self.merge, self.cut, self.words = model.tokenize, (_WORD_LEVEL if words else _BYTE_LEVEL).findall, words
        self.old = old
        self[""] = b""

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self._ids(piece)
        if len(piece) <= LONGEST:
            self[piece] = ids
        return ids

    def _ids(self, piece: str) -> bytes:
        bare = piece[1:] if piece[0] == " " else piece
        if not bare.isalpha():
            if piece[-1] in ".,":  # a word with a mark behind it, most often
                word = piece[:-1]
                if (word[1:] if word[:1] == " " else word).isalpha():
                    return self[word] + self[piece[-1]]
            parts = self.cut(piece.lower() if self.words else piece)
            if len(parts) != 1 or parts[0] != piece:
                return b"".join([self[p] if self.words or p != piece else self._merged(p) for p in parts])
        elif self.words:
            return self._merged(piece.lower())
        return self._merged(piece)

    def _merged(self, piece: str) -> bytes:
        return np.array([t.id for t in self.merge(piece.encode().decode("latin-1").translate(_LETTERS))], "<u4").tobytes()


class Encoder:
    """ids(texts) gives each text's ids as little-endian unsigned 32-bit bytes.

    Empty texts have no ids. `words` says that white space never enters a token (word-level BPE); otherwise a
    single space belongs to the word behind it (byte-level BPE). With `most` pieces the memo becomes the older
    generation, and the one before it is dropped.
    """

    def __init__(self, tokenizer_json: str, words: bool, most: int = 350_000):
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.added = tuple({t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()})  # a handful of strings
        self.words, self.most, self.memo = words, most, _Memo(self.tokenizer.model, words, {})

    def _cut(self, text: str) -> list[str] | None:
        """Pieces whose ids follow each other, or None where only the library may cut."""
        if not (text.replace("\n", " ").isprintable() if text.isascii() else not _ODD.search(text)):
            return None
        low = text.lower()
        if any(token in low for token in self.added):
            return None
        if self.words:
            return low.split()
        if any(run in text for run in _RUNS) or text[:1] == " " or text[-1:] == " " or text[-2:] == "\n\n":
            return None
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def ids(self, texts: list[str]) -> list[bytes]:
        get, out, whole = self.memo.__getitem__, [], []
        for k, text in enumerate(texts):
            if len(self.memo) >= self.most:
                self.memo.old = {}
                self.memo = _Memo(self.tokenizer.model, self.words, self.memo)
                get = self.memo.__getitem__
            pieces = self._cut(text)
            if pieces is None:
                whole.append(k)
                out.append(b"")
            else:
                out.append(b"".join(map(get, pieces)))
        for k in range(0, len(whole), 64):
            some = whole[k : k + 64]
            for at, e in zip(some, self.tokenizer.encode_batch([texts[i] for i in some], add_special_tokens=False), strict=True):
                out[at] = np.array(e.ids, "<u4").tobytes()
        return out


def read_tokenizer(path: str) -> str:
    """The tokenizer's file as text, read once on the driver; a few MB at most, so it may be broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encoder(tokenizer_json: str, words: bool) -> Encoder:
    """The encoder of this Python worker: its memo lasts from task to task."""
    return held(("encoder", hash(tokenizer_json), words), lambda: Encoder(tokenizer_json, words))

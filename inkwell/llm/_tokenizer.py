"""Byte-level BPE ids of whole texts, each distinct chunk of text encoded once per worker.

A text is cut before every single space and around every single line feed that stands
between two non-space characters, and between a letter and a sign. The tokenizer's own
pre-tokens never reach over such a cut, so the chunks tokenize independently and their ids laid end to end are the ids of the text.
"""

from __future__ import annotations

import numpy as np

from inkwell.llm._text import ChunkCodes, worker_store

# Leading bytes after which no Unicode space starts: ASCII signs, and the UTF-8 leads without a space character.
SAFE = np.zeros(256, bool)
SAFE[0x21:0x7F] = True
SAFE[0xC3:0xE1] = True
SAFE[0xE4:0xF5] = True

ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[65:91] = ASCII_LETTER[97:123] = True
# ASCII signs that never belong to a letter's pre-token; the apostrophe may.
MARK = np.zeros(256, bool)
MARK[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "'"]] = True


def chunk_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where chunks start: at every row's start and at every cut."""
    n = len(data)
    at = np.flatnonzero((data == 0x20) | (data == 0x0A))
    at = at[(at > 0) & (at < n - 1)]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    at = at[~edge[at] & ~edge[at + 1]]
    before = data[at - 1]
    for back in (2, 3, 4):
        inner = (before >= 0x80) & (before < 0xC0)
        before = np.where(inner, data[np.maximum(at - back, 0)], before)
    at = at[SAFE[before] & SAFE[data[at + 1]]]
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    cut[at] = True
    cut[at[data[at] == 0x0A] + 1] = True
    letter, mark = ASCII_LETTER[data], MARK[data]
    cut[1:n] |= letter[:-1] & mark[1:]
    return np.flatnonzero(cut[:n])


class ByteBpe:
    """``ids(data, bounds)``: every row's ids, exactly as the tokenizer gives them for the whole row."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.letters = _byte_letters()
        self.codes = ChunkCodes(self.encode)

    def encode(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk. A single run of Latin letters is one pre-token, which the model takes as it is."""
        out: list = [None] * len(chunks)
        other = []
        for i, chunk in enumerate(chunks):
            letters = chunk[1:] if chunk[:1] == " " else chunk
            if letters.isalpha() and (letters.isascii() or max(letters) < "\u0250"):
                out[i] = [t.id for t in self.tokenizer.model.tokenize(chunk.encode().decode("latin-1").translate(self.letters))]
            else:
                other.append(i)
        for i, e in zip(other, self.tokenizer.encode_batch([chunks[i] for i in other], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def ids(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids laid end to end, and each row's number of ids."""
        starts = chunk_starts(data, bounds)
        ends = np.append(starts[1:], len(data))
        ids, counts = self.codes.ids_of(data, starts, ends)
        before = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        at = before[np.searchsorted(starts, bounds)]
        return ids, np.diff(at)


def _byte_letters() -> dict[int, int]:
    """The printable characters that stand for the 256 bytes in a byte-level vocabulary, in the order of the bytes."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(other)}


def byte_bpe(path: str) -> ByteBpe:
    """The worker's encoder for this vocabulary file, with the chunks it has met so far."""
    store = worker_store()
    key = ("byte_bpe", path)
    if key not in store:
        store[key] = ByteBpe(path)
    return store[key]

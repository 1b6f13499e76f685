"""Token ids of whole batches with a public tokenizer.

Byte-level BPE never merges across the bounds of the tokenizer's first split, so a text's ids are those of its
pieces one after another, cut at such bounds. Pieces repeat: each distinct piece of a batch is encoded once by the
tokenizers library and all others are gathered by numpy. A cache of bounded size carries pieces across batches.
Texts that hold an added token such as ``<|endoftext|>`` are encoded whole: the tokenizer takes it out before it splits.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corpuslens.llm.common import utf8

#: Distinct pieces that a Python worker remembers; beyond it starts anew.
CACHE_PIECES = 800_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces start: at every text, at white space behind a character that surely is none, behind a single
    line feed, and where a letter meets an ASCII sign. All of these are bounds of the tokenizer's own first split.

    White space beyond ASCII ends in bytes after C2, E1, E2 or E3; behind such characters no cut is made, which is
    always right, as a longer piece is encoded like any other text. So is a cut before an apostrophe.
    """
    space = (data == 32) | ((data >= 9) & (data <= 13))
    cut = np.zeros(len(data), bool)
    cut[1:] = space[1:] & (data[:-1] > 32)
    cut[2:] &= data[:-2] != 0xC2
    cut[3:] &= (data[:-3] < 0xE1) | (data[:-3] > 0xE3)
    lower = data | 32
    ascii_letter = (lower >= 97) & (lower <= 122) & (data < 128)
    letter = ascii_letter.copy()
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)  # Latin-1 without the two signs
    sign = (data > 32) & (data < 127) & ~ascii_letter & ~((data >= 48) & (data <= 57))
    cut[2:] |= cut[1:-1] & (data[1:-1] == 10) & (data[2:] > 32) & (data[2:] < 127)
    cut[1:] |= letter[:-1] & sign[1:]
    cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(cut)


def _byte_letters() -> dict[int, int]:
    """The letters by which byte-level vocabularies spell bytes: printable ones themselves, the rest from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(rest)}


class Encoder:
    """``encode`` gives the ids of all texts in one array and the number of ids of each text."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}
        self.cache_pieces = cache_pieces
        self.letters = _byte_letters()

    def _learn(self, pieces: list[bytes]) -> None:
        merge, known, letters, other = self.tokenizer.model.tokenize, self.known, self.letters, []
        for piece in pieces:
            # One run of letters, with or without a space before it, is one unit of the first split.
            if piece.decode().removeprefix(" ").isalpha():
                ids = [t.id for t in merge(piece.decode("latin-1").translate(letters))]
                known[piece] = array("I", ids).tobytes()
            else:
                other.append(piece)
        for i in range(0, len(other), 20_000):
            part = other[i : i + 20_000]
            coded = self.tokenizer.encode_batch_fast([p.decode() for p in part], add_special_tokens=False)
            known.update((p, array("I", c.ids).tobytes()) for p, c in zip(part, coded))

    def _pieces(self, pieces: list[bytes]) -> list[bytes]:
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > self.cache_pieces:
            self.known, new = {}, pieces
        self._learn(new)
        return [self.known[p] for p in pieces]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        holds = np.zeros(len(texts), bool)
        for token in self.added:
            holds |= pc.match_substring(texts, token).fill_null(False).to_numpy(zero_copy_only=False)
        if not holds.any():
            return self._encode_pieces(texts)
        ids, counts = self._encode_pieces(pc.if_else(pa.array(holds), pa.scalar(None, texts.type), texts))
        whole = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in texts.filter(pa.array(holds)).to_pylist()]
        sizes = [len(w) for w in whole]
        at = (np.cumsum(counts) - counts)[holds]
        ids = np.insert(ids, np.repeat(at, sizes), np.concatenate([np.array(w, np.uint32) for w in whole]))
        counts[holds] = sizes
        return ids, counts

    def _encode_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = utf8(texts)
        starts = piece_starts(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        ends = np.append(starts[1:], len(data)).astype(np.int64)
        bounds = np.append(starts, ends[-1]).astype(np.int64)
        cells = pa.Array.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]
        ).dictionary_encode()
        coded = self._pieces(cells.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(coded), np.uint32)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        which = cells.indices.to_numpy()
        lengths = sizes[which]
        ahead = np.cumsum(lengths) - lengths
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[which] - ahead, lengths) + np.arange(lengths.sum())]
        # Ids before each text: those of the pieces that start before it.
        before = np.append(ahead, len(ids))[np.searchsorted(starts, offsets, "left")]
        return ids, np.diff(before)


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, cache_pieces: int = CACHE_PIECES) -> Encoder:
    """One encoder, with its cache of so many pieces, for each Python worker process."""
    if (path, cache_pieces) not in _ENCODERS:
        _ENCODERS[path, cache_pieces] = Encoder(path, cache_pieces)
    return _ENCODERS[path, cache_pieces]

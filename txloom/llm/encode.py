"""Whole texts to token ids with a public tokenizer file, by remembered words.

The tokenizer drops white space and never merges across it, so a text's ids are
the ids of its white-space-separated pieces in order. Pieces repeat a lot: each
worker keeps a bounded table from piece to id bytes. A new piece of Latin
letters goes straight to the tokenizer's BPE model, any other through the whole
tokenizer. Ids are little-endian unsigned 32-bit.
"""

from __future__ import annotations

import re
from array import array

import regex

from .words import kept

#: The tokenizer's own pre-tokenization pattern (a fixed value of the file).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Characters below U+0130 that are no white space: case and normal form are plain there.
LAST = "\u012f"
PLAIN = re.compile(f"[\x21-\x7e\xa1-{LAST}]+")

#: Marks that the pattern always parts from a word before them.
MARKS = b".,;:!?"


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest take letters from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _word_like(core: bytes) -> bool:
    """Whether the last character is a letter or digit, so that marks behind it are parted from it."""
    if core[-1:].isalnum():
        return True
    last = core[-2:].decode("utf-8", "ignore")[-1:]
    return "\x80" <= last <= LAST and last.isalpha()


class Encoder(dict):
    """piece -> id bytes, in two bounded tables: pieces of late and those from before."""

    LIMIT = 500_000

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.before: dict[bytes, bytes] = {}

    def __missing__(self, piece: bytes) -> bytes:
        out = self.before.get(piece)
        if out is None:
            core = piece.rstrip(MARKS)
            if len(core) < len(piece) and _word_like(core):  # a word and the marks behind it
                out = self[core] + self[piece[len(core) :]]
                if len(piece) > 8:
                    return out
            else:
                out = self._encode(piece)
        if len(piece) <= 64:
            if len(self) >= self.LIMIT:  # the older half of the table goes
                self.before = dict(self)
                self.clear()
            self[piece] = out
        return out

    def _encode(self, piece: bytes) -> bytes:
        if piece.isalpha():
            return self._merged(piece.lower().decode())
        text = piece.decode("utf-8", "replace")
        if text.isalpha() and max(text) <= LAST:  # one word
            return self._merged(self._spelt(text.lower()))
        if PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join([self._merged(p if p.isascii() else self._spelt(p)) for p in PIECES.findall(text.lower())])
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _spelt(self, part: str) -> str:
        return part.encode().decode("latin-1").translate(self.letters)

    def _merged(self, part: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(part)]).tobytes()

    def ids(self, text: bytes | None) -> bytes:
        """The ids of a text as bytes; null and empty texts have none."""
        if not text:
            return b""
        # special tokens are matched before letters are lowered
        pieces = text.split() if b"<|" in text else text.lower().split()
        return b"".join(map(self.__getitem__, pieces))


#: Bytes of text that are worked on at once; a longer text comes alone.
AT_ONCE = 4_000_000


def runs_of(column, at_once: int = AT_ONCE):
    """(from, to, texts as bytes) of an Arrow string column, in runs of about ``at_once`` bytes at most."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.cast(pa.large_binary())
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + at_once, side="right")))
        yield at, stop, column[at:stop].to_pylist()
        at = stop
    pa.default_memory_pool().release_unused()


def texts_of(batches, key: str, at_once: int = AT_ONCE):
    """From Arrow batches of a key and a text: (keys, texts as bytes) in runs of about ``at_once`` bytes at most."""
    for b in batches:
        keys = b.column(b.schema.get_field_index(key)).to_pylist()
        for at, stop, texts in runs_of(b.column(b.schema.get_field_index("text")), at_once):
            yield keys[at:stop], texts


def encoder(path: str) -> Encoder:
    """One encoder for each worker and file, while it encodes."""
    return kept(f"encoder {path}", lambda: Encoder(path))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")

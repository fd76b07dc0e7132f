"""Token ids of whole texts with the ``tokenizers`` library, by cached pieces.

A byte-pair tokenizer first splits a text into pre-tokens and merges within each
one. Between two characters that are not white space, a single space or line
feed always starts a new pre-token, whatever stands around it; so the ids of a
text are the ids of its pieces between such places, one after another. Pieces
recur, and the library encodes each of them once per worker. A text in which
some place is not of that kind (runs of white space, tabs, no-break spaces) is
encoded whole instead. Either way the ids equal those of
``Tokenizer.encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import ctypes
import os
import struct
import unicodedata
import weakref

import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: glibc's way to return freed memory to the system; other libraries return it by themselves.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: Pieces, and letter runs within them, kept per worker before a cache starts anew; bounds its memory.
MAX_PIECES = 300_000
MAX_CORES = 1_500_000
#: Longer pieces are encoded each time and never kept.
MAX_PIECE_CHARS = 48


def _byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


_ALPHABET = _byte_alphabet()
_SPACE = _ALPHABET[32]


class _Unsplittable(Exception):
    pass


class _Pieces(dict):
    """Ids of a piece with the space or line feed before it, as unsigned 32-bit little-endian."""

    def __init__(self, owner: PieceTokenizer):
        super().__init__()
        self.owner = weakref.proxy(owner)  # no cycle: a dropped tokenizer goes at once, with its caches

    def __missing__(self, piece: str) -> bytes:
        bare = piece[1:] if piece[:1] == "\n" else piece
        if not bare or bare[0].isspace() or bare[-1].isspace():
            raise _Unsplittable
        ids = self.owner._encode_piece(piece, bare)
        if len(piece) <= MAX_PIECE_CHARS:
            if len(self) >= MAX_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class PieceTokenizer:
    """``ids(text)`` gives the bytes of the token ids of a text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        if hasattr(self.model, "_resize_cache"):  # the pieces are cached here
            self.model._resize_cache(0)
        self.packed = [struct.pack("<I", i) for i in range(self.whole.get_vocab_size(with_added_tokens=True))]
        self.lowers = self.whole.normalizer is not None  # the word vocabulary: lower case, no white space
        self.pieces = _Pieces(self)
        self.marks: dict[str, bytes] = {m: self._pack(self.whole.encode(m, add_special_tokens=False).ids) for m in ".,;:!?"}
        self.cores: dict[str, bytes] = {}

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_whole(self, text: str) -> bytes:
        return self._pack(self.whole.encode(text, add_special_tokens=False).ids)

    def _encode_piece(self, piece: str, bare: str) -> bytes:
        mark = self.marks.get(bare[-1])
        core = bare if mark is None else bare[:-1]
        if core.isalpha() and piece is bare:  # letters after a space: one pre-token, then one mark at most
            ids = self.cores.get(core)
            if ids is None:
                ids = self._merge(core)
                if len(self.cores) >= MAX_CORES:
                    self.cores.clear()
                self.cores[core] = ids
            return ids if mark is None else ids + mark
        return self.encode_whole(piece if piece is not bare else " " + piece)

    def _merge(self, core: str) -> bytes:
        word = core
        if self.lowers:
            if not core.isascii():
                word = unicodedata.normalize("NFC", core)
                if "Σ" in word:  # its lower case depends on what follows in Python only
                    return self.encode_whole(" " + core)
            word = word.lower()
            if not word.isalpha():
                return self.encode_whole(" " + core)
        letters = word if word.isascii() else "".join(_ALPHABET[b] for b in word.encode())
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(letters if self.lowers else _SPACE + letters)])

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        head, *rest = text.replace("\n", " \n").split(" ")
        try:
            body = b"".join(map(self.pieces.__getitem__, rest))
        except _Unsplittable:
            return self.encode_whole(text)
        if head and (head[0].isspace() or head[-1].isspace()):
            return self.encode_whole(text)
        return (self.encode_whole(head) if head else b"") + body


_LOADED: dict[str, PieceTokenizer] = {}


def tokenizer(path: str) -> PieceTokenizer:
    """One per worker process and vocabulary file."""
    if path not in _LOADED:
        _LOADED.clear()  # a reused worker holds one vocabulary's cache at a time
        _LOADED[path] = PieceTokenizer(path)
    return _LOADED[path]


def release() -> None:
    """Drop a reused worker's tokenizer and its caches, and give back what it has freed.

    Workers live on beside the JVM between tasks, so tasks of operators that need no
    tokenizer begin with this, and those that held much end with it.
    """
    _LOADED.clear()
    trim()


def trim() -> None:
    """Give back what this process has freed; the tokenizer and its caches stay."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary file lies; pass another path to use your own."""
    import public_tokenizers

    return public_tokenizers.path(name)

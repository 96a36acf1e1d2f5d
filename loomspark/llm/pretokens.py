"""Encoding a batch of texts piece by piece, each distinct piece once.

A batch's UTF-8 bytes are cut, all at once, at places where the public byte-level patterns always cut, so
no pre-token crosses two pieces (a piece may hold several; the library splits it further). The pieces are
counted as one Arrow dictionary; only distinct ones are looked up in a worker's cache, only unknown ones
go to the library, and the ids are put together by array operations.

Whether there is a cut between two bytes is a table of their classes: letters (a-z, A-Z and the Latin-1
letters), digits, ASCII punctuation, apostrophe, space, other ASCII white space. Beside any other byte there
is none. Before a character that is no white space the last white space opens a piece (a space keeps the
character, anything else stands alone). A text that spells a special token is one piece.
"""

from __future__ import annotations

import sys
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from loomspark.llm.common import utf8

L, D, P, A, S, W, OTHER, NONE = range(8)
_KIND = np.full(256, OTHER, np.uint8)
_KIND[33:127] = P
for _from, _to, _kind in ((48, 58, D), (65, 91, L), (97, 123, L), (39, 40, A), (32, 33, S), (9, 14, W)):
    _KIND[_from:_to] = _kind


def _pairs(*kinds: tuple[str, str]) -> np.ndarray:
    """Table of class pairs: left class * 8 + right class."""
    names = dict(zip("LDPASW", range(6), strict=True))
    out = np.zeros(64, bool)
    for left, right in kinds:
        for a in left:
            for b in right:
                out[names[a] * 8 + names[b]] = True
    return out


#: A cut between the two; a cut before the first of the two.
BETWEEN = _pairs(("L", "DPASW"), ("D", "LPASW"), ("P", "LDSW"), ("A", "DSW"), ("W", "LDPA"))
BEFORE = _pairs(("SW", "LDPA"))
#: For vocabularies that drop white space and take digits one by one.
WORDS_BETWEEN = BETWEEN | _pairs(("D", "D"), ("S", "LDPA"))


def kinds_of(data: np.ndarray) -> np.ndarray:
    """The class of each byte; both bytes of a Latin-1 letter are letters."""
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = L
    return kind


def lowered(data: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Letters in lower case, but for those before a byte of their text that may be part of a combining mark."""
    small = np.arange(256, dtype=np.uint8)
    small[65:91] += 32
    out = small[data]
    follows = np.flatnonzero(data[:-1] == 0xC3) + 1
    capital = follows[(data[follows] < 0x9F) & (data[follows] != 0x97)]
    out[capital] += 32
    beside = (kind[:-1] == L) & (kind[1:] == OTHER)
    beside[offsets[(offsets > 0) & (offsets < len(data))] - 1] = False
    joined = np.flatnonzero(beside)
    out[joined] = data[joined]
    return out


def cut_pieces(data: np.ndarray, offsets: np.ndarray, whole: np.ndarray, between: np.ndarray, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """(pieces of all texts as a string array, index of each text's first piece and the end). whole: texts not to be cut."""
    n = len(data)
    kind = kinds_of(data)
    pair = kind[:-1] * np.uint8(8) + kind[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    pair[inner - 1] = NONE * 8 + NONE
    cut = np.zeros(n + 1, bool)
    if n:
        cut[1:n] = between[pair]
        cut[: n - 1] |= BEFORE[pair]
    for k in whole:
        cut[offsets[k] : offsets[k + 1]] = False
    cut[offsets] = True
    starts = np.flatnonzero(cut[:n])
    edges = np.append(starts, n).astype(np.int32)
    held = lowered(data, kind, offsets) if lower and n else np.ascontiguousarray(data)
    if lower:
        for k in whole:
            held[offsets[k] : offsets[k + 1]] = data[offsets[k] : offsets[k + 1]]
    pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(held))
    return pieces, np.searchsorted(starts, offsets)


def ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[starts[0]:starts[0]+sizes[0]], flat[starts[1]:...], ... one after the other."""
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])]


class PieceCache(dict):
    """piece -> encoded piece. Two generations bound the memory: a full one becomes the old one, whose
    entries move up when they are asked for again. ``encode`` takes a list of pieces."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], entries: int = 500_000):
        super().__init__()
        self.encode, self.entries, self.old = encode, entries, {}

    def many(self, pieces: list[str]) -> list[bytes]:
        """The encoded pieces; the given ones are distinct."""
        out = list(map(self.get, pieces))
        absent = [i for i, found in enumerate(out) if found is None]
        unknown = []
        for i in absent:
            found = out[i] = self.old.get(pieces[i])
            if found is None:
                unknown.append(i)
        for i, found in zip(unknown, self.encode([pieces[i] for i in unknown]) if unknown else (), strict=True):
            out[i] = found
        for i in absent:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            if len(pieces[i]) <= 64:
                self[pieces[i]] = out[i]
        return out


def encoded_batch(texts: pa.Array, known: PieceCache, marks: tuple[str, ...] = (), between: np.ndarray = BETWEEN, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, offsets of each text's ids and the end). texts: without nulls."""
    data, offsets = utf8(texts)
    whole = np.zeros(0, np.int64)
    for mark in marks:
        whole = np.union1d(whole, np.flatnonzero(pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)))
    pieces, first = cut_pieces(data, offsets, whole.astype(np.int64), between, lower)
    if not len(pieces):
        return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
    coded = pieces.dictionary_encode()
    found = known.many(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    starts = np.cumsum(sizes) - sizes
    which = coded.indices.to_numpy()
    lengths = sizes[which]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return ragged(np.frombuffer(b"".join(found), "<u4"), starts[which], lengths), ends[first]


def packed_ids(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: bytes that print
    as themselves in Latin-1 stay, the others take the characters from U+0100 on, in order."""
    spare = iter(range(256, 512))
    return [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 else chr(next(spare)) for b in range(256)]


ALPHABET = byte_alphabet()
TO_ALPHABET = dict(enumerate(ALPHABET))


def spelled(text: str) -> str:
    """A text's UTF-8 bytes in the printable alphabet."""
    return text.encode().decode("latin-1").translate(TO_ALPHABET)


#: Letters whose bytes are no class of their own; what stands before them is not in lower case yet.
_MARKED = frozenset("\u00aa\u00b5\u00ba")


def is_word(piece: str) -> bool:
    """ASCII letters and those from U+00C0 to U+00FF alone, with at most one space before them: one pre-token."""
    bare = piece[1:] if piece[:1] == " " else piece
    return bare.isalpha() and (bare.isascii() or (max(bare) < "\u0100" and not _MARKED.intersection(bare)))


def library_pieces(path: str) -> tuple[PieceCache, tuple[str, ...], int]:
    """(cache of pieces as the tokenizers library encodes them, strings of its special tokens, number of ids)."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    word = whole.model.tokenize

    def encode(pieces: list[str]) -> list[bytes]:
        spelt = spelled("\n".join(pieces)).split(ALPHABET[10]) if not any("\n" in p for p in pieces) else list(map(spelled, pieces))
        return [packed_ids([t.id for t in word(s)] if is_word(p) else whole.encode(p, add_special_tokens=False).ids) for p, s in zip(pieces, spelt, strict=True)]

    marks = tuple(t.content for t in whole.get_added_tokens_decoder().values())
    return PieceCache(encode), marks, whole.get_vocab_size()

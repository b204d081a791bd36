"""Token ids of texts by the tokenizers library, inside tasks.

A text is cut before each white space that follows another character.  Byte
level pre-tokens never cross such a cut, so the pieces' ids in turn are the
text's ids, and a piece that comes again is looked up, not encoded again.  The
table of known pieces is bounded; a task holds one Arrow batch beside it.
"""

from __future__ import annotations

import array
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The characters that the tokenizer's pattern takes as white space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_RARE = SPACES.replace(" ", "").replace("\n", "")
_PIECE = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
#: A line break, a word with the space before it, and marks behind it: these are pre-tokens each.
_SIMPLE = re.compile("(\n?)( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,;:!?|*#$%&]*)")
#: Pieces kept per Python worker (some 200 bytes each).
KNOWN_PIECES = 700_000
#: An encoder of lots keeps words from lot to lot until it has so many; the lot that passes this still adds its own.
KNOWN_WORDS = 200_000
#: Bytes of text that are cut into pieces at a time (or one longer text).
LOT_BYTES = 16 << 20


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer's file, the same on every machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts as arrays of unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}   # pieces as they stand
        self.spaced: dict[str, bytes] = {}  # words after one space, and line breaks with the word behind them
        self.marks: dict[str, bytes] = {}
        # the byte alphabet of byte-level BPE, as the tokenizer itself writes it
        self.letters = {}
        for c in range(0x100):
            raw = chr(c).encode()
            shown = "".join(p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(c)))
            if len(raw) == len(shown):
                self.letters.update(zip(raw, shown))

    def _piece(self, piece: str) -> bytes:
        m = _SIMPLE.fullmatch(piece)
        if not m:
            return self._encoded(piece)
        line, word, marks = m.groups()
        ids = self.known.get(word)
        if ids is None:
            shown = word.encode().decode("latin-1").translate(self.letters)
            ids = array.array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()
            if (line or marks) and len(self.known) < KNOWN_PIECES:
                self.known[word] = ids
        return (self._mark(line) if line else b"") + ids + (self._mark(marks) if marks else b"")

    def _mark(self, marks: str) -> bytes:
        ids = self.marks.get(marks)
        if ids is None:
            ids = self._encoded(marks)
            if len(self.marks) < 1000:
                self.marks[marks] = ids
        return ids

    def _encoded(self, piece: str) -> bytes:
        return array.array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def _look_up(self, keys: list[str], table: dict[str, bytes], whole) -> bytes:
        """Ids of all keys; what the table lacks is encoded as ``whole(key)``."""
        found = list(map(table.get, keys))
        if None in found:
            room = KNOWN_PIECES - len(table)
            for i, got in enumerate(found):
                if got is None:
                    key = keys[i]
                    found[i] = got = table.get(key) or self._piece(whole(key))
                    if room > 0:
                        table[key] = got
                        room -= 1
        return b"".join(found)

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of a text without special tokens; a null text has none."""
        if not text:
            return np.zeros(0, "<u4")
        if _plain(text):
            # single spaces and line breaks between words: cut by the string methods
            keys = text.replace("\n", " \n").split(" ")
            ids = self._look_up(keys[:1], self.known, str) + self._look_up(
                keys[1:], self.spaced, lambda key: key if key[0] == "\n" else " " + key)
        else:
            ids = self._look_up(_PIECE.findall(text), self.known, str)
        return np.frombuffer(ids, "<u4")


def _plain(text: str) -> bool:
    """Words stand between single spaces and single line breaks, with no other white space."""
    return not (text[0] in SPACES or text[-1] in SPACES or "  " in text or "\n\n" in text or " \n" in text or "\n " in text
                or any(c in text for c in _RARE))


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, kept while the Python worker lives."""
    return Encoder(path)


def lots(column: pa.Array, limit: int = LOT_BYTES):
    """Row ranges (start, end) of at most ``limit`` bytes of text, or one longer row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i, before = 0, 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(sizes, before + limit, "right")))
        yield i, j
        i, before = j, int(sizes[j - 1])


def pieces(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct pieces of texts, the pieces of all texts in turn as places
    among them, and the bounds of each text there.  Pieces joined are the text;
    an empty text has none."""
    mark = next(c for c in map(chr, [0, *range(0xE000, 0xF900)]) if not any(c in t for t in texts))
    odd = [i for i, t in enumerate(texts) if t and not _plain(t[1:] if len(t) > 1 and t[0] == " " else t)]
    marked = pc.replace_substring(pc.replace_substring(pa.array(texts, pa.large_string()), " ", mark + " "), "\n", mark + "\n")
    if odd:
        marked = marked.to_pylist()
        for i in odd:
            marked[i] = mark.join(_PIECE.findall(texts[i]))
        marked = pa.array(marked, pa.large_string())
    lists = pc.split_pattern(marked, mark)
    coded = lists.flatten().dictionary_encode()
    names, at = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    if "" in names:  # before a leading space, or an empty text
        full = at != names.index("")
        bounds = np.concatenate(([0], np.cumsum(full)))[bounds]
        at = at[full]
    return names, at, bounds


def spread(flat: np.ndarray, bounds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``at`` of a ragged table one after the other, and the bounds of each."""
    size = np.diff(bounds)[at]
    ends = np.concatenate(([0], np.cumsum(size)))
    return flat[np.repeat(bounds[at] - ends[:-1], size) + np.arange(ends[-1])], ends


class PieceEncoder:
    """Ids of many texts at a time: each distinct piece of a lot is encoded once
    and its ids are gathered; a bounded table keeps words from lot to lot.  With
    ``plain`` the strings of special tokens are ordinary text."""

    def __init__(self, path: str, plain: bool = False):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.bytes = byte_level_entries(self.tokenizer)
        self.size = np.array(list(map(len, self.bytes)), np.int64)
        self.letters = dict(enumerate(_byte_alphabet()))
        self.words: dict[str, list[int]] = {}
        self.marks: dict[str, list[int]] = {}

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in turn and the bounds of each text."""
        names, at, bounds = pieces(texts)
        ids, ends = spread(*self.piece_ids(names), at)
        return ids, ends[bounds]

    def piece_ids(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces in turn and the bounds of each."""
        words, marks, letters, tokenize = self.words, self.marks, self.letters, self.tokenizer.model.tokenize
        if len(words) > KNOWN_WORDS:
            words = dict(words)  # full: what this lot adds goes with it
        flat, sizes = array.array("i"), array.array("q", [0])
        for name in names:
            m = _SIMPLE.fullmatch(name)
            if m:
                line, word, tail = m.groups()
                ids = words.get(word)
                if ids is None:
                    shown = word.encode().decode("latin-1").translate(letters)
                    ids = words[word] = [t.id for t in tokenize(shown)]
                if line:
                    flat.extend(self._mark(line, marks))
                flat.extend(ids)
                if tail:
                    flat.extend(self._mark(tail, marks))
            else:
                flat.extend(self._whole(name))
            sizes.append(len(flat))
        return np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32), np.frombuffer(sizes, np.int64)

    def _mark(self, text: str, known: dict) -> list[int]:
        ids = known.get(text)
        if ids is None:
            ids = self._whole(text)
            if len(known) < 1000:
                known[text] = ids
        return ids

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


def _byte_alphabet() -> list[str]:
    """The characters of byte-level BPE: bytes that print stand for themselves,
    the others for the characters from U+0100 up, in order."""
    prints = {b for b in range(0x100) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b}
    more = iter(range(0x100, 0x200))
    return [chr(b if b in prints else next(more)) for b in range(0x100)]


def byte_level_entries(tokenizer) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary; added tokens stand as written."""
    shown = {c: b for b, c in enumerate(_byte_alphabet())}
    added = {i: t.content.encode() for i, t in tokenizer.get_added_tokens_decoder().items()}
    entries = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        entries[i] = added[i] if i in added else bytes(shown[c] for c in token)
    return entries


@lru_cache(2)
def piece_encoder(path: str, plain: bool = False) -> PieceEncoder:
    """The encoder of a vocabulary file, kept while the Python worker lives."""
    return PieceEncoder(path, plain)

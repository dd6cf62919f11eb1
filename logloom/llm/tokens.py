"""Token ids of whole texts for a byte-level BPE vocabulary.

A slice of texts is cut into the vocabulary's words (runs of letters, digits,
other signs or white space, each with one space before it, and English
contractions) with numpy on its code points; each different word is encoded
once by the tokenizer library and kept in a bounded cache; ids are then laid
out by number. Texts holding a special token's string go through the tokenizer
whole. The ids equal ``Tokenizer.encode(text, add_special_tokens=False).ids``.
"""

from __future__ import annotations

import base64
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from .text import mix, parts, powers

_U = np.uint64
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
#: Words kept between slices.
CACHE = 100_000
#: Bytes of text encoded at once; a dozen arrays of eight bytes a character go with it.
SLICE = 1 << 17


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point."""
    kind = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        major = unicodedata.category(chr(c))[0]
        if major == "L":
            kind[c] = _LETTER
        elif major == "N":
            kind[c] = _NUMBER
    white = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    kind[white] = _SPACE
    return kind


def word_starts(code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the words; ``first``: starts of the non-empty texts in ``code``."""
    kind = _classes()[code]
    n = len(code)
    head = np.zeros(n + 1, bool)
    head[first] = head[n] = True
    start = head[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # the last white space before another sign stands alone, or, if it is a space, begins the next word
    tail = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~head[1:-1]) if n > 1 else np.zeros(0, np.int64)
    start[tail] = True
    start[tail[code[tail] == 32] + 1] = False
    # contractions begin with a lone apostrophe that begins a word
    for i in np.flatnonzero((code[:-1] == 39) & start[:-1] & (kind[1:] == _LETTER) & ~head[1:-1]).tolist() if n > 1 else ():
        one = chr(code[i + 1])
        two = one + chr(code[i + 2]) if i + 2 < n and not head[i + 2] else one
        size = 1 if one in "stmd" else 2 if two in ("re", "ve", "ll") else 0
        if size:
            start[i + 1] = False
            if i + size + 1 < n:
                start[i + size + 1] = start[i + size + 1] or kind[i + size + 1] == _LETTER
    return np.flatnonzero(start)


class Encoder:
    """Ids of many texts at once; one per task."""

    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path or default_path())
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.word = self._fast(path) if path is None else self._plain
        self.clear()

    def _fast(self, path: str | None):
        """The same vocabulary as ranks: the same ids for a word, sooner."""
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        plain = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return plain.encode_single_piece if hasattr(plain, "encode_single_piece") else plain._encode_single_piece

    def _plain(self, word: str) -> list[int]:
        return self.whole.encode(word, add_special_tokens=False).ids

    def clear(self) -> None:
        self.slot: dict[int, int] = {}
        self.flat, self.at, self.size, self.used = array("i"), array("q"), array("i"), array("q")

    def _prune(self) -> None:
        """Keep the half of the words that came most often."""
        used, at, size = np.array(self.used), np.array(self.at), np.array(self.size, np.int64)
        hashes = np.fromiter(self.slot, _U, len(self.slot))  # in the order of the slots
        keep = np.sort(np.argsort(-used, kind="stable")[: CACHE // 2])
        flat = np.array(self.flat)
        size = size[keep]
        total = np.cumsum(size)
        spot = np.repeat(at[keep] - (total - size), size) + np.arange(total[-1])
        self.slot = dict(zip(hashes[keep].tolist(), range(len(keep))))
        self.flat, self.at = array("i", flat[spot].tobytes()), array("q", (total - size).tobytes())
        self.size, self.used = array("i", size.astype(np.int32).tobytes()), array("q", (used[keep] // 2).tobytes())

    def _slots(self, hashes: np.ndarray, counts: np.ndarray, where: np.ndarray, ends: np.ndarray, text: str) -> np.ndarray:
        if len(self.slot) > CACHE:
            self._prune()
        get = self.slot.get
        out = [get(h, -1) for h in hashes.tolist()]
        slots = np.array(out, np.int64)
        new = np.flatnonzero(slots < 0)
        if len(new):
            found = [self.word(text[a:b]) for a, b in zip(where[new].tolist(), ends[new].tolist())]
            size = np.array([len(f) for f in found], np.int64)
            base = len(self.at)
            slots[new] = base + np.arange(len(new))
            self.slot.update(zip(hashes[new].tolist(), range(base, base + len(new))))
            self.at.frombytes((len(self.flat) + np.cumsum(size) - size).tobytes())
            self.size.frombytes(size.astype(np.int32).tobytes())
            self.used.frombytes(np.zeros(len(new), np.int64).tobytes())
            self.flat.extend(chain.from_iterable(found))
        used = np.frombuffer(self.used, np.int64)
        used[slots] += counts
        return slots

    def slice(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids per text) of UTF-8 texts."""
        text = data.tobytes().decode()
        rows = len(off) - 1
        if not text:
            return np.zeros(0, np.int32), np.zeros(rows, np.int64)
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        chars = lead[off]  # of the texts' starts, in code points
        first = np.unique(chars[:-1][chars[1:] > chars[:-1]])
        starts = word_starts(code, first)
        ends = np.append(starts[1:], len(code))
        up, down = powers(len(code) + 1)
        sums = np.zeros(len(code) + 1, _U)
        np.cumsum(mix(code.astype(_U) + _U(1)) * up[:-1], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))
        uniq, where, inv, times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        slots = self._slots(uniq, times, starts[where], ends[where], text)[inv]
        size = np.frombuffer(self.size, np.int32)[slots].astype(np.int64)
        begin = np.frombuffer(self.at, np.int64)[slots]
        total = np.cumsum(size)
        spot = np.repeat(begin - (total - size), size) + np.arange(total[-1])
        ids = np.frombuffer(self.flat, np.int32)[spot]
        bounds = np.concatenate([[0], total])[np.searchsorted(starts, chars)]
        counts = np.diff(bounds)
        marked = [t for t in self.special if t in text]
        if marked:
            texts = [data[a:b].tobytes().decode() for a, b in zip(off[:-1], off[1:])]
            every = np.split(ids, bounds[1:-1])
            for i, t in enumerate(texts):
                if any(m in t for m in marked):
                    every[i] = np.array(self._plain(t), np.int32)
            ids, counts = np.concatenate(every), np.array([len(e) for e in every], np.int64)
        return ids, counts

    def texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a column; null is empty."""
        for _, data, off in parts(column, SLICE):
            ids, counts = self.slice(data, off)
            # views of the buffers must not outlive the slice
            yield from np.split(ids.copy(), np.cumsum(counts)[:-1])

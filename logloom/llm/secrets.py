"""Secret scans that unwrap nested encodings.

``scan`` finds three kinds of secrets in a text, then works through a list of
decoded layers: percent escapes, Unicode and character escapes, base64 runs (from any
character on, also joined over line breaks) and compressed payloads at any byte
of these, with all members. Every layer is scanned, printable or not, and may
hold more layers, until none is new. A layer is known by its content and its place, so a
payload that decodes to itself ends the walk. Every character of a layer
carries the range of the original text that it came from; a match in a layer is
reported as the range of the original that covers it.

Rows: null text is empty; an empty text has no spans. A layer that unpacks to
more than ``MAX_LAYER`` bytes is not opened (its base64 text is still scanned
as it stands) and counted in ``n_oversize``.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import html
import lzma
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import map_arrow

KINDS = ("assign", "access", "hex")
#: Unpacked bytes of one layer; guards tasks against decompression bombs.
MAX_LAYER = 64 << 20

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_CLUES = ("password", "passwd", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(
    r"((?:\\u[0-9A-Fa-f]{4})+)|\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})"
    r"|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});|(&[A-Za-z][A-Za-z0-9]{1,31};)"
)
#: The least characters of base64 and of a text with a secret or a further layer.
RUN = 12
_RUN = re.compile(rb"[\t\n\r -~]{%d}" % RUN)
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}={0,2}" % RUN)
_BREAK = re.compile(r"[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t]*")
_WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]+(?:{_BREAK.pattern}[A-Za-z0-9+/_-]+)+")
_URLSAFE = str.maketrans("-_", "+/")
#: How gzip and zlib, bz2, xz and zstd payloads begin.
_MAGIC = re.compile(
    rb"(?P<zlib>\x1f\x8b\x08|x[\x01\x5e\x9c\xda])|(?P<bz2>BZh[1-9](?:1AY&SY|\x17rE8P\x90))"
    rb"|(?P<xz>\xfd7zXZ\x00)|(?P<zstd>\(\xb5/\xfd)"
)
#: Packed bytes given to a decompressor, and unpacked bytes taken from one, at a time.
STEP = 1 << 16

Span = tuple[int, int, int]


class Layer(NamedTuple):
    """A text and, per character, where it starts and ends in the original (None: the original)."""

    text: str
    start: np.ndarray | None
    end: np.ndarray | None

    def origin(self, a: int, b: int) -> tuple[int, int]:
        if self.start is None:
            return a, b
        return int(self.start[a:b].min()), int(self.end[a:b].max())


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the plain matches, sorted."""
    found: list[Span] = []
    low = text.lower()
    if any(c in low for c in _CLUES):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _percent(m: re.Match) -> str | None:
    try:
        return bytes.fromhex(m[0].replace("%", "")).decode()
    except UnicodeDecodeError:
        return bytes.fromhex(m[0].replace("%", "")).decode("latin-1")


def _escape(m: re.Match) -> str | None:
    try:
        if m[1]:
            units = b"".join(int(u, 16).to_bytes(2, "big") for u in m[1].split("\\u")[1:])
            return units.decode("utf-16-be")
        for g, base in ((2, 16), (3, 16), (4, 16), (5, 16), (6, 10)):
            if m[g]:
                c = chr(int(m[g], base))
                return None if 0xD800 <= ord(c) < 0xE000 else c
        plain = html.unescape(m[7])
        return None if plain == m[7] else plain
    except (ValueError, OverflowError):
        return None


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every match decoded in place; None if nothing was."""
    text, out, starts, ends, at = layer.text, [], [], [], 0
    first = layer.start if layer.start is not None else None
    for m in pattern.finditer(text):
        plain = decode(m)
        if plain is None:
            continue
        out += [text[at : m.start()], plain]
        a, b = at, m.start()
        starts.append(np.arange(a, b) if first is None else first[a:b])
        ends.append(np.arange(a + 1, b + 1) if first is None else layer.end[a:b])
        lo, hi = layer.origin(m.start(), m.end())
        starts.append(np.full(len(plain), lo))
        ends.append(np.full(len(plain), hi))
        at = m.end()
    if not out:
        return None
    out.append(text[at:])
    n = len(text)
    starts.append(np.arange(at, n) if first is None else first[at:n])
    ends.append(np.arange(at + 1, n + 1) if first is None else layer.end[at:n])
    return Layer("".join(out), np.concatenate(starts), np.concatenate(ends))


def _unpack(raw: memoryview) -> tuple[bytes | None | bool, int]:
    """(unpacked content of all members, packed bytes read); content None if it is none, False if too large."""
    out, size, at = [], 0, 0
    while head := _MAGIC.match(raw[at : at + 16]):
        kind, begin = head.lastgroup, at
        try:
            if kind == "zstd":
                with zstandard.ZstdDecompressor().stream_reader(raw[at:], read_across_frames=True) as r:
                    at = len(raw)
                    while got := r.read(STEP):
                        out.append(got)
                        size += len(got)
                        if size > MAX_LAYER:
                            return False, at
                break
            d = zlib.decompressobj(47) if kind == "zlib" else bz2.BZ2Decompressor() if kind == "bz2" else lzma.LZMADecompressor()
            while at < len(raw) and not d.eof:
                piece = raw[at : at + STEP]
                got = d.decompress(piece, MAX_LAYER + 1 - size)
                out.append(got)
                size += len(got)
                if size > MAX_LAYER:
                    return False, at
                at += len(piece) - len(d.unused_data)
            while d.eof and raw[at : at + 1] == b"\0":  # padding between members
                at += 1
        except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError):
            at = max(at, begin + 1)
            break
    return (b"".join(out) if size else None), at


def _opened(raw: bytes) -> Iterator[tuple[int, int, bytes | bool]]:
    """(start, end, content) of the compressed payloads anywhere in ``raw`` and in
    one another, at the place of the outermost; False for one too large."""
    done = 0
    for hit in _MAGIC.finditer(raw):
        if hit.start() < done:
            continue
        got, used = _unpack(memoryview(raw)[hit.start() :])
        if got is None:
            continue
        end = hit.start() + used
        yield hit.start(), end, got
        if got is False:
            continue
        done = end if used < len(raw) - hit.start() else done
        seen, todo = {raw, got}, [got]
        while todo:
            for _, _, more in _once(todo.pop()):
                if more is False:
                    yield hit.start(), end, False
                elif more not in seen:
                    seen.add(more)
                    todo.append(more)
                    yield hit.start(), end, more


def _once(raw: bytes) -> Iterator[tuple[int, int, bytes | bool]]:
    done = 0
    for hit in _MAGIC.finditer(raw):
        if hit.start() >= done:
            got, used = _unpack(memoryview(raw)[hit.start() :])
            if got is not None:
                done = hit.start() + used if used < len(raw) - hit.start() else done
                yield hit.start(), hit.start() + used, got


def _text(raw: bytes, sure: bool) -> tuple[str | None, np.ndarray | None]:
    """Bytes as text, and the bytes of each character (None: one each). Bytes that
    are not UTF-8 stand for themselves. None if no secret or further layer fits in:
    both are ASCII of ``RUN`` characters, or, if ``sure``, a readable text."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return (raw.decode("latin-1"), None) if _RUN.search(raw) else (None, None)
    readable = sure and text and all(c.isprintable() or c in "\t\n\r" for c in text)
    if not readable and not _RUN.search(raw):
        return None, None
    return text, None if text.isascii() else np.array([len(c.encode()) for c in text])


def _bodies(text: str) -> Iterator[tuple[str, int, np.ndarray | None]]:
    """(characters, start, places) of what may be base64: runs of its alphabet, and
    the same joined over line breaks (places None: one after another)."""
    for m in _TOKEN.finditer(text):
        yield m[0].rstrip("="), m.start(), None
    if "\n" in text or "\\n" in text:
        for m in _WRAPPED.finditer(text):
            cuts = [m.start(), *(p for c in _BREAK.finditer(text, m.start(), m.end()) for p in c.span()), m.end()]
            body = "".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
            if len(body) >= RUN:
                yield body, m.start(), np.concatenate([np.arange(a, b) for a, b in zip(cuts[::2], cuts[1::2])])


def _inside(layer: Layer, body: str, start: int, places: np.ndarray | None) -> Iterator[Layer | int]:
    """The layers inside a run of base64 characters, and the places of those too large.

    A payload may begin anywhere in the run, after a path or a name: each of the
    four ways to group the characters is decoded, and compressed payloads are
    looked for at every byte."""
    code = body.translate(_URLSAFE)

    def spot(at: np.ndarray) -> np.ndarray:
        return start + at if places is None else places[at]

    for k in range(4):
        n = len(code) - k
        n -= n % 4 == 1
        if n < RUN:
            break
        raw = binascii.a2b_base64(code[k : k + n] + "=" * (-n % 4))
        for a, b, got in _opened(raw):
            lo, hi = spot(np.array([k + a * 4 // 3, k + (b * 8 - 1) // 6]))
            lo, hi = layer.origin(int(lo), int(hi) + 1)
            if got is False:
                yield lo
            elif (text := _text(got, True)[0]) is not None:
                yield Layer(text, np.full(len(text), lo), np.full(len(text), hi))
        text, size = _text(raw, k == 0)
        if text is None:
            continue
        size = np.ones(len(text), np.int64) if size is None else size
        stop = np.cumsum(size)
        first, last = spot(k + (stop - size) * 4 // 3), spot(k + (stop - 1) * 4 // 3 + 1)
        yield Layer(text, first, last + 1) if layer.start is None else Layer(text, layer.start[first], layer.end[last])


def _packed(layer: Layer) -> Iterator[Layer | int]:
    """The layers in compressed payloads whose bytes are characters of a layer, and the places of those too large."""
    for a, b, got in _opened(layer.text.encode("latin-1", "replace")):
        lo, hi = layer.origin(a, b)
        if got is False:
            yield lo
        elif (text := _text(got, True)[0]) is not None:
            yield Layer(text, np.full(len(text), lo), np.full(len(text), hi))


def _percent_packed(layer: Layer) -> Iterator[Layer | int]:
    """What is compressed in percent escapes, where a plus sign may be a space."""
    for text in dict.fromkeys((layer.text, layer.text.replace("+", " "))):
        raw = _replaced(layer._replace(text=text), _PERCENT, lambda m: bytes.fromhex(m[0].replace("%", "")).decode("latin-1"))
        if raw is not None:
            yield from _packed(raw)


def scan(text: str) -> tuple[list[Span], list[Span], int, int]:
    """(plain spans, all spans, number of decoded layers, layers too large to open)."""
    base = base_spans(text)
    found, seen, work, layers, over = set(base), set(), [Layer(text, None, None)], 0, set()
    while work:
        layer = work.pop()
        more: list[Layer | int | None] = []
        if "%" in layer.text:
            more.append(_replaced(layer, _PERCENT, _percent))
            more += _percent_packed(layer)
        if "\\" in layer.text or "&" in layer.text:
            more.append(_replaced(layer, _ESCAPE, _escape))
        if layer.start is not None:
            more += _packed(layer)
        for body, start, places in _bodies(layer.text):
            more += _inside(layer, body, start, places)
        for new in more:
            if isinstance(new, int):
                over.add(new)
                continue
            if new is None or not new.text:
                continue
            known = (hashlib.blake2b(new.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), int(new.start.min()), int(new.end.max()))
            if known in seen:
                continue
            seen.add(known)
            layers += 1
            for a, kind, b in base_spans(new.text):
                lo, hi = new.origin(a, b)
                found.add((lo, kind, hi))
            work.append(new)
    return base, sorted(found), layers, len(over)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secrets(docs: DataFrame) -> DataFrame:
    """Per row of (doc_id, text): counts, digests and spans of the secrets found."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for x in b.column("text"):
            base, all_, layers, over = scan(x.as_py() or "")
            kinds = [k for _, k, _ in base]
            rows.append(
                (
                    *(kinds.count(k) for k in range(3)),
                    hashlib.sha256(joined(base).encode()).hexdigest(),
                    joined(all_),
                    layers,
                    over,
                )
            )
        cols = list(zip(*rows))
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2
        names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers", "n_oversize"]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", *names]
        )

    return map_arrow(
        docs.select("doc_id", "text"),
        run,
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string,"
        " n_layers long, n_oversize long",
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` (all columns) with every found span of ``text`` replaced by ``mark``;
    ``n_chars``, if there, is the new length. Null texts stay null."""
    names = docs.columns

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = []
        for x in b.column("text"):
            text = x.as_py()
            if text:
                out, at = [], 0
                for a, _, z in scan(text)[1]:
                    if a >= at:
                        out += [text[at:a], mark]
                    at = max(at, z)
                text = "".join(out) + text[at:]
            texts.append(text)
        cols = [b.column(c) for c in names]
        cols[names.index("text")] = pa.array(texts, pa.string())
        if "n_chars" in names:
            i = names.index("n_chars")
            cols[i] = pa.array([None if t is None else len(t) for t in texts], b.column("n_chars").type)
        yield pa.RecordBatch.from_arrays(cols, names)

    return map_arrow(docs, run, docs.schema)

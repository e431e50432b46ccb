"""Secret scans with a recursive decoding worklist.

Each text is layer zero. A layer is scanned, then unwrapped: percent escapes (``%XX``, ``%uXXXX``, with ``+`` as a blank
too), Unicode and string escapes (``\\uXXXX``, ``\\u{…}``, ``\\UXXXXXXXX``, ``\\xXX``, ``&#…;``, ``\\n`` and its kin beside
them), base64 runs (standard and URL alphabets) and compressed payloads (zlib, gzip, bz2, xz, wherever their first bytes
stand in decoded bytes; deflate without a header at the start of a base64 piece of 16 characters or more) each give
further layers, scanned and unwrapped in turn until no new layer appears. A layer met before (equal text from an equal
place) is not visited again, so cycles end. A layer maps its characters to those of the layer it came from, by runs of
equal steps that are worked out only for findings, so a finding deep inside maps back to the characters that hide it.

Base64 may be wrapped at any width: its pieces are joined over blanks, line breaks (plain, escaped as in JSON, continued by
a backslash, quoted-printable), quotation marks and plus signs of adjacent literals, and the marks of quoted lines.
Joined runs are decoded at all four places of a group, so words glued to or standing before a payload do not hide it.
Readable stretches of the decoded bytes are the layers: findings and text wrappings are ASCII, whatever lies
between them and whether or not it is UTF-8. Where nothing but a blank parts an unpadded payload from the next word, a
finding at the payload's very end may take in some of that word's letters.
A compressed payload is inflated in blocks of ``max_layer`` / 8 bytes and scanned
whole, in pieces that end where nothing can go on. Only a stretch of more than
``max_layer`` characters without such an end (one huge run) is handed on in
overlapping pieces, all of them scanned, and counted in ``n_cut``: what is wrapped
across two such pieces may be missed.

Null and empty texts have no spans. Repeated rows are scanned alike. Spans are
code points, end exclusive; equal findings of several layers are one span.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LAYER = 32 << 20
OVERLAP = 64 << 10
FEED = 64 << 10
KINDS = ("assign", "access", "hex")

# The kinds' patterns and their least lengths.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_LEAST_VALUE, _LEAST_ACCESS = 6, 20
LEAST_RUN, LEAST_FINDING = 16, 12  # characters of base64 that hide the shortest finding, and its length

_MAY_HOLD = r"(?i:password|passwd|secret|token|api_?key)[\"']? *[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
_HOLDS = re.compile(_MAY_HOLD.replace("(?i:", "(?ai:"))

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+|%u[0-9A-Fa-f]{4}")
_FORM = re.compile(_PERCENT.pattern + r"|\+")
_NUMBERED = (r"\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})"
             r"|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
_UNICODE = re.compile(_NUMBERED)
_STRING = re.compile(_NUMBERED + r"""|\\([abtnvfr0\\'"/])""")
_NAMED = dict(zip("abtnvfr0", "\a\b\t\n\v\f\r\0"))
_ESCAPED = re.compile(r"%[0-9A-Fa-f]{2}|%u[0-9A-Fa-f]{4}|\\[uUx][0-9A-Fa-f{]|&#[0-9xX]")

# Base64 pieces and what may stand between two pieces of one run: blanks, line breaks (plain, escaped, quoted-printable
# or continued by a backslash), quotation marks, commas and plus signs of adjacent literals, marks of quoted lines.
_PIECE = rb"[A-Za-z0-9+/_-]++"
_BETWEEN = rb"""(?:\\[nrt]|=\r?\n|(?<=[\s"'])\+(?=[\s"'])|[\s"'`>|#*\\,])++"""
_JOINT = re.compile(_BETWEEN)
_RUN = re.compile(_PIECE + rb"(?:" + _BETWEEN + _PIECE + rb")*+")
_LONG = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16}")
_SOFT = re.compile(rb"""\\[nrt]|(?<=[\s"'])\+(?=[\s"'])""")
_STANDARD = bytes.maketrans(b"-_", b"+/")
_FOREIGN = bytes(c for c in range(256) if not (chr(c).isascii() and chr(c).isalnum()) and c not in b"+/-_")

# Decoded bytes that findings and further text wrappings consist of (NUL: UTF-16, UTF-32).
_READABLE = bytes([0, *range(9, 14), *range(32, 127)])
_CLASSES = bytes(1 if c in _READABLE else 0 for c in range(256))
_SHORTEST = b"\1" * LEAST_FINDING
_STRETCH = re.compile(rb"[\0\t-\r -~]{%d,}" % LEAST_FINDING)
_WRAPS = re.compile(_ESCAPED.pattern + r"""|(?:[A-Za-z0-9+/_-][\s"'`>|#*\\,=]*+){16}""", re.A)
_MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00")

# Ends that no finding, escape or base64 run goes over.
_SAFE = re.compile(r"""[^A-Za-z0-9+/_.=\-"'`:%\\&#;{}\s,>|*]|(?<=\.)\s""", re.A)

Span = Callable[[int, int], tuple[int, int]]  # the original characters of characters i to j-1 of a layer


class Layer(NamedTuple):
    text: str
    span: Span


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the plain findings."""
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= _LEAST_VALUE]
    out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= _LEAST_ACCESS]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def _percent(m: re.Match) -> str:
    if m[0] == "+":
        return " "
    return chr(int(m[0][2:], 16)) if m[0][1] in "uU" else bytes.fromhex(m[0].replace("%", "")).decode("latin-1")


def _escape(m: re.Match) -> str:
    if m.lastindex == 7:
        return _NAMED.get(m[7], m[7])
    code = int(m[5]) if m[5] else int(m[1] or m[2] or m[3] or m[4] or m[6], 16)
    return m[0] if code > 0x10FFFF or 0xD800 <= code < 0xE000 else chr(code)  # halves of a pair hide no ASCII


class _Runs:
    """Places of a rewritten text, as runs of characters that came from ``step`` characters each; others came from one."""

    def __init__(self, text: str, wanted: re.Pattern, decoded: Callable[[re.Match], str]):
        self.out, self.end, self.src, self.step = (array("q") for _ in range(4))
        ahead = 0
        for m in wanted.finditer(text):
            new, wide = decoded(m), m.end() - m.start()
            if new == m[0]:
                continue
            at, step = m.start() - ahead, wide // len(new)
            if self.out and self.end[-1] == at and self.step[-1] == step:
                self.end[-1] += len(new)
            else:
                for column, value in zip((self.out, self.end, self.src, self.step), (at, at + len(new), m.start(), step)):
                    column.append(value)
            ahead += wide - len(new)

    def place(self, i: int) -> tuple[int, int]:
        k = bisect_right(self.out, i) - 1
        if k < 0:
            return i, i + 1
        inside = min(i, self.end[k]) - self.out[k]
        at = self.src[k] + inside * self.step[k] + max(0, i - self.end[k])
        return at, at + (self.step[k] if i < self.end[k] else 1)


def _rewritten(layer: Layer, wanted: re.Pattern, decoded: Callable[[re.Match], str]) -> Layer:
    """The layer with each match replaced by ``decoded(match)``; the places are worked out when first asked for."""
    runs = cache(lambda: _Runs(layer.text, wanted, decoded))
    return Layer(wanted.sub(decoded, layer.text), lambda i, j: layer.span(runs().place(i)[0], runs().place(j - 1)[1]))


def _inflated(raw: bytes, at: int, size: int, bare: bool = False) -> Iterator[tuple[bytes, int]]:
    """What ``raw`` holds compressed from ``at`` on, in blocks of at most ``size``: (block, end of the bytes read). Members
    that follow each other are one payload; ``bare``: deflate without a header. What comes before an error is kept."""
    try:
        while bare or _MAGIC.match(raw, at):
            zipped = bare or raw[at] in b"\x1f\x78"
            d = (zlib.decompressobj(-15 if bare else 47) if zipped else
                 bz2.BZ2Decompressor() if raw[at] == ord("B") else lzma.LZMADecompressor())
            while not d.eof:
                tail = d.unconsumed_tail if zipped else b""
                if not tail and (zipped or d.needs_input):
                    tail = raw[at:at + FEED]
                    at += len(tail)
                    if not tail:
                        return
                if got := d.decompress(tail, size):
                    yield got, at - len(d.unused_data)
            at -= len(d.unused_data)
            if bare:
                return
    except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
        return


def _pieces(blocks: Iterator[bytes], size: int, most: int) -> Iterator[tuple[str, bool]]:
    """Pieces that end where no finding or wrapping goes on: what is unfinished is carried into the next. A carry of more
    than ``most`` characters is handed out as it is, its end once more with the next piece, and marked."""
    text = ""
    for block in blocks:
        text += block.decode("latin-1")  # all findings and wrappings are ASCII
        if len(text) < size:
            continue
        ends = [m.end() for m in _SAFE.finditer(text, max(0, len(text) - OVERLAP))]
        at = ends[-1] if ends else max((m.end() for m in _SAFE.finditer(text)), default=0)
        if at:
            yield text[:at], False
            text = text[at:]
        elif len(text) > most:
            yield text, True
            text = text[-min(OVERLAP, most // 2):]
    yield text, False


def _payload(raw: bytes, at: int, span: Span, most: int, bare: bool = False) -> Iterator[tuple[Layer, bool]]:
    """Layers of the payload compressed at ``raw[at:]``; all their characters come from all its bytes."""
    size, end, nul = max(most // 8, 1), at, False
    for block, end in _inflated(raw, at, size, bare):
        nul = nul or b"\0" in block
    if end == at:
        return
    whole = span(at, end)
    for drop in (b"", b"\0") if nul else (b"",):
        for piece, was_cut in _pieces((b.translate(None, drop) for b, _ in _inflated(raw, at, size, bare)), size, most):
            yield Layer(piece, lambda i, j: whole), was_cut


def _payloads(raw: bytes, span: Span, most: int) -> Iterator[tuple[Layer, bool]]:
    """Layers of every compressed payload that starts with its format's first bytes."""
    at = 0
    while m := _MAGIC.search(raw, at):
        at = m.end()
        for _, end in _inflated(raw, m.start(), max(most // 8, 1)):
            at = max(at, end)
        if at > m.end():
            yield from _payload(raw, m.start(), span, most)


def _stretches(raw: bytes, span: Span) -> Iterator[tuple[Layer, bool]]:
    """Readable stretches of decoded bytes that may hold a finding or a further wrapping; where there are NUL bytes (UTF-16,
    UTF-32), also without them."""
    for m in _STRETCH.finditer(raw):
        a, part = m.start(), m[0]
        text = part.decode("latin-1")
        if _HOLDS.search(text) or _WRAPS.search(text):
            yield Layer(text, lambda i, j, a=a: span(a + i, a + j)), False
        if b"\0" in part:
            kept = np.flatnonzero(np.frombuffer(part, np.uint8))
            yield (Layer(part.replace(b"\0", b"").decode("latin-1"),
                         lambda i, j, a=a, kept=kept: span(a + int(kept[i]), a + int(kept[j - 1]) + 1)), False)


def _decoded(stream: bytes, at: int, end: int | None = None) -> bytes:
    part = stream[at:end]
    part = part[:len(part) - (len(part) % 4 == 1)]
    return binascii.a2b_base64(part + b"=" * (-len(part) % 4))


def _may_hide(data: bytes) -> bool:
    """Whether any base64 run may hide something: the runs of the whole layer end to end, at all four places of a group,
    hold what each of them holds."""
    if _LONG.search(data):
        return True
    stream = (_SOFT.sub(b"", data) if b"\\" in data or b"+" in data else data).translate(_STANDARD, _FOREIGN)
    return any(_SHORTEST in raw.translate(_CLASSES) or _MAGIC.search(raw)
               for raw in (_decoded(stream, at) for at in range(4)))


def _base64_layers(data: bytes, span: Span, most: int) -> Iterator[tuple[Layer, bool]]:
    """Layers of all base64 runs, their pieces joined, at all four places of a group: what is glued to a run's beginning
    shifts it, and does not hide it."""
    if not _may_hide(data):
        return
    for run in _RUN.finditer(data):
        if run.end() - run.start() < LEAST_RUN:
            continue
        stream = _JOINT.sub(b"", run[0]).translate(_STANDARD)
        if len(stream) < LEAST_RUN:
            continue

        @cache
        def pieces(run=run) -> tuple[array, array]:
            """First characters of the run's pieces: in the stream and in the layer."""
            at, src = array("q", [0]), array("q", [run.start()])
            for gap in _JOINT.finditer(run[0]):
                at.append(at[-1] + run.start() + gap.start() - src[-1])
                src.append(run.start() + gap.end())
            return at, src

        def place(i: int, pieces=pieces) -> int:
            at, src = pieces()
            k = bisect_right(at, i) - 1
            return src[k] + i - at[k]

        def of(first: int, place=place, n=len(stream)) -> Span:
            """Original span of bytes i to j-1 decoded from the stream's character ``first`` on."""
            return lambda i, j: span(place(first + i * 4 // 3), place(min(n, first - (-j * 4 // 3)) - 1) + 1)

        for first in range(4):
            raw = _decoded(stream, first)
            if _SHORTEST in raw.translate(_CLASSES):
                yield from _stretches(raw, of(first))
            yield from _payloads(raw, of(first), most)
        if _LONG.search(run[0]):
            at, src = pieces()
            before = 0
            for k, first in enumerate(at):  # deflate without a header shows itself only by its start: that of a long piece
                wide = (at[k + 1] if k + 1 < len(at) else len(stream)) - first
                if wide >= LEAST_RUN and wide != before:
                    head = _decoded(stream, first, first + 4096)
                    try:
                        zlib.decompressobj(-15).decompress(head)
                    except zlib.error:
                        pass
                    else:
                        raw = head if first + 4096 >= len(stream) else _decoded(stream, first)
                        yield from _payload(raw, 0, of(first), most, bare=True)
                before = wide


def _unwrapped(layer: Layer, most: int) -> Iterator[tuple[Layer, bool]]:
    """Layers one step inside a layer."""
    text = layer.text
    if "%" in text and _PERCENT.search(text):
        yield _rewritten(layer, _PERCENT, _percent), False
        if "+" in text:
            yield _rewritten(layer, _FORM, _percent), False
    if ("\\" in text or "&#" in text) and _UNICODE.search(text):
        yield _rewritten(layer, _UNICODE, _escape), False
        if "\\" in text:
            yield _rewritten(layer, _STRING, _escape), False
    data = text.encode("latin-1", "replace")
    yield from _payloads(data, layer.span, most)
    yield from _base64_layers(data, layer.span, most)


def find(text: str | None, max_layer: int = MAX_LAYER,
         may_hold: bool = True) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], int]:
    """(plain findings, findings of all layers, pieces cut) of one text; the flag says what a filter has excluded."""
    base = base_spans(text) if text and may_hold else []
    found, seen, n_cut = set(base), set(), 0
    # lazily: a large payload's pieces come one by one
    work = [_unwrapped(Layer(text, lambda i, j: (i, j)), max_layer)] if text else []
    while work:
        if (got := next(work[-1], None)) is None:
            work.pop()
            continue
        layer, was_cut = got
        n_cut += was_cut
        if len(layer.text) < LEAST_FINDING:
            continue
        key = (hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(),
               layer.span(0, len(layer.text)))
        if key in seen:
            continue
        seen.add(key)
        if _HOLDS.search(layer.text):
            for kind, a, b in base_spans(layer.text):
                found.add((kind, *layer.span(a, b)))
        work.append(_unwrapped(layer, max_layer))
    return _sorted(base), _sorted(found), n_cut


def _sorted(spans) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _findings(column: pa.Array, max_layer: int) -> Iterator[tuple[str | None, tuple]]:
    """(text, ``find``'s result) of each row; whole batches are filtered for plain findings first."""
    for t, hold in zip(column, pc.fill_null(pc.match_substring_regex(column, _MAY_HOLD), False).to_pylist()):
        text = t.as_py()
        yield text, find(text, max_layer, hold)


SCHEMA = ("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_decoded long, n_cut long")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_layer: int = MAX_LAYER) -> DataFrame:
    """One row per document: counts and digest of the plain findings, and the spans of all layers. Map-only."""

    def run(batches):
        for batch in batches:
            rows = []
            for _, (base, every, n_cut) in _findings(batch.column(1), max_layer):
                kinds = [k for k, _, _ in base]
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(),
                             joined(every), len(every) - len(set(base)), n_cut))
            columns = list(zip(*rows)) if rows else [()] * 7
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_decoded", "n_cut"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
               .mapInArrow(run, SCHEMA)


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """``text`` with each run of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", length_col: str | None = "n_chars",
           max_layer: int = MAX_LAYER) -> DataFrame:
    """``docs`` with every finding of every layer replaced by ``mark``; ``length_col``, where there is one, is kept true
    for changed texts."""
    place = docs.columns.index(text_col)
    length = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches):
        for batch in batches:
            column = batch.column(place)
            new = {i: redacted(text, every, mark) for i, (text, (_, every, _)) in enumerate(_findings(column, max_layer))
                   if every}
            if new:
                arrays = batch.columns
                arrays[place] = pa.array([new[i] if i in new else t.as_py() for i, t in enumerate(column)], column.type)
                if length is not None:
                    old = arrays[length]
                    arrays[length] = pa.array([len(new[i]) if i in new else n for i, n in enumerate(old.to_pylist())], old.type)
                batch = pa.RecordBatch.from_arrays(arrays, schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, docs.schema)

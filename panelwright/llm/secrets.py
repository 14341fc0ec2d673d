"""Secret scanning through nested encodings.

A worklist holds layers of text. Each layer is scanned, then unwrapped: percent and backslash escapes
in place, base64 runs alone and joined over line breaks, gzip, zlib and raw deflate data and UTF-16 text inside those. What
comes out is a new layer unless the same text was seen at the same place before, so the list runs dry. Every character of a
layer knows its span in the document, and so do the secrets found in it. Bytes that hold nothing to find or to unwrap
make no layer, and a layer leaves memory once its last inner layer is out, so that time and memory follow the
size of what is unwrapped, however deep it lies.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator, Sequence
from itertools import chain
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import words as W

#: Fixed patterns, each with the least length of the group that counts.
KINDS = {
    "assign": (re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),
}
ORDER = list(KINDS)
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
#: Data written for a URL, with the characters that may stand as they are.
URL_DATA = re.compile(r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~*-])+")
ESCAPE = re.compile(r"\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: A run that goes on in whole lines, as MIME wraps it.
WRAPPED = re.compile(r"""[A-Za-z0-9+/_-]{16,}(?:\r?\n[ \t>]*[A-Za-z0-9+/_-]+(?=[ \t]*(?:[\r\n="'`<>(){}\[\],;.:|&\\]|\Z)))*(?:(?:\r?\n[ \t>]*)?=){0,2}""")
#: What compressed data begin with, as they are and written for a URL, and characters that are in no secret and no encoded run.
PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
PACKED_URL = re.compile(r"%1[Ff]%8[Bb]%08|(?:x|%78)%(?:01|5[Ee]|9[Cc]|[Dd][Aa])")
CUT = re.compile(r"""[^A-Za-z0-9+/_.=:"'%\\\s>-]""")
#: Bytes that are decompressed at once, and streams of compressed data that may lie in each other before they are read into memory.
PIECE, STREAMS = 1 << 16, 32
#: What a secret or an encoding in bytes has, as words in lower case and as patterns behind a byte that is quickly missed; control characters that no text has.
WORDS = ("pass", "secret", "token", "api")
LONG_RUN = re.compile(rb"[A-Za-z0-9+/_-]{16}")
MARKED = {b"%": re.compile(rb"%[0-9A-Fa-f]{2}"), b"\\": re.compile(rb"\\(?:u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2})")}
CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
#: Texts without any of these cannot hold a secret in any layer.
HINT = r"(?i)pass|secret|token|api|%[0-9a-f][0-9a-f]|\\[ux][0-9a-f]"
RUN = np.zeros(256, bool)
RUN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_-"]] = True

#: Text, start and end of each character's span in the document (one number where all share it), and the layers around it.
Layer = tuple[str, Sequence[int] | int, Sequence[int] | int, str]


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the secrets that stand in ``text`` as they are."""
    low = text.lower()
    there = {"assign": any(w in low for w in WORDS), "access": "AKIA" in text, "hex": True}
    return [
        (kind, m.start(), m.end())
        for kind, (pattern, group, least) in KINDS.items()
        if there[kind]
        for m in pattern.finditer(text)
        if m.end(group) - m.start(group) >= least
    ]


def _live(data: bytes) -> bool:
    """Whether bytes can hold a secret or an encoding."""
    low = data.lower()
    if any(w.encode() in low for w in WORDS) or LONG_RUN.search(data):
        return True
    return any(mark in data and pattern.search(data) for mark, pattern in MARKED.items())


def _place(starts: Sequence[int] | int, ends: Sequence[int] | int, a: int, b: int) -> tuple[int, int]:
    return (starts, ends) if isinstance(starts, int) else (starts[a], ends[b - 1])


def _in_place(layer: Layer, pattern: re.Pattern, name: str, decode) -> Layer | None:
    """The layer with each match of ``pattern`` decoded; None if there is none."""
    text, starts, ends, path = layer
    out, froms, tos, at = [], array("q"), array("q"), 0
    fixed = isinstance(starts, int)
    for m in pattern.finditer(text):
        piece = decode(m[0])
        step = (m.end() - m.start()) // max(1, len(piece))
        even = step * len(piece) == m.end() - m.start()
        out += [text[at : m.start()], piece]
        if not fixed:
            froms.extend(starts[at : m.start()])
            tos.extend(ends[at : m.start()])
            for k in range(len(piece)):
                a, b = (m.start() + k * step, m.start() + (k + 1) * step) if even else (m.start(), m.end())
                froms.append(starts[a])
                tos.append(ends[b - 1])
        at = m.end()
    if not out:
        return None
    if not fixed:
        froms.extend(starts[at:])
        tos.extend(ends[at:])
    return "".join([*out, text[at:]]), starts if fixed else froms, ends if fixed else tos, f"{path}{name}."


def _percent(run: str) -> str:
    return bytes.fromhex(run.replace("%", "")).decode("utf-8", "replace")


def _escape(run: str) -> str:
    return chr(int(run[2:], 16))


def _inflated(parts: Iterator[bytes], taken: set[int]) -> tuple[bool, Iterator[bytes]]:
    """(whether ``parts`` are gzip or zlib data, the data inside or the parts as they are); all members, in pieces.

    ``taken`` gets the places in ``parts`` where members end.
    """
    first = next(parts, b"")
    if not (first[:3] == b"\x1f\x8b\x08" or (first[:1] == b"\x78" and len(first) > 2 and int.from_bytes(first[:2], "big") % 31 == 0)):
        return False, chain([first], parts)
    try:
        if not zlib.decompressobj(47).decompress(first, PIECE):
            return False, chain([first], parts)
    except zlib.error:
        return False, chain([first], parts)

    def members() -> Iterator[bytes]:
        inside, todo, read = zlib.decompressobj(47), chain([first], parts), 0
        for data in todo:
            read += len(data)
            while data:
                try:
                    yield inside.decompress(data, PIECE)
                except zlib.error:
                    yield data
                    yield from todo
                    return
                data = inside.unconsumed_tail
                if inside.eof:
                    data, inside = inside.unused_data.lstrip(b"\0"), zlib.decompressobj(47)
                    taken.add(read - len(data))
        while more := inside.decompress(b"", PIECE):
            yield more

    return True, (piece for piece in members() if piece)


def _texts(parts: Iterator[bytes], limit: int) -> Iterator[str]:
    """``parts`` as texts of about ``limit`` characters, cut only where no secret and no encoded run can go on."""
    decoder, held = codecs.getincrementaldecoder("utf-8")("replace"), []
    size = 0
    for part in parts:
        text = decoder.decode(part)
        size += len(text)
        held.append(text)
        if size >= limit and (cuts := [m.end() for m in CUT.finditer(text)]):
            yield "".join([*held[:-1], text[: cuts[-1]]])
            held = [text[cuts[-1] :]]
            size = len(held[0])
    yield "".join([*held, decoder.decode(b"", True)])


def _pieces(data: bytes, start: int) -> Iterator[bytes]:
    return (data[k : k + PIECE] for k in range(start, len(data), PIECE))


def _opens(data: bytes, at: int) -> bool:
    """Whether compressed data may begin at ``at``: their first bytes are sound."""
    try:
        zlib.decompressobj(47).decompress(data[at : at + 64], 64)
    except zlib.error:
        return False
    return True


def _held(parts: Iterator[bytes], limit: int) -> Iterator[bytes]:
    """``parts``, read into memory where they are no more than ``limit`` bytes."""
    taken, size = [], 0
    for part in parts:
        taken.append(part)
        size += len(part)
        if size > limit:
            return chain(taken, parts)
    return _pieces(b"".join(taken), 0)


def _packed(data: bytes, limit: int) -> Iterator[tuple[str, str]]:
    """(names of the layers, text) of the compressed data at any place of ``data``."""
    reached = 0
    for m in PACKED.finditer(data):
        if m.start() < reached or not _opens(data, m.start()):  # what lies in whole streams is read when these are unpacked
            continue
        taken: set[int] = set()
        heads, name = {data[m.start() : m.start() + PIECE]}, ""
        is_packed, parts = _inflated(_pieces(data, m.start()), taken)
        while is_packed:
            name += "zip."
            head = next(parts, b"")
            while len(head) < PIECE and (more := next(parts, b"")):
                head += more
            parts = chain([head], parts)
            if head[:PIECE] in heads:
                break
            heads.add(head[:PIECE])
            if name.count(".") % STREAMS == 0:  # streams inside streams are calls inside calls
                parts = _held(parts, limit)
            is_packed, parts = _inflated(parts, set())
        if name:
            yield from ((name, text) for text in _texts(parts, limit))
        reached = m.start() + max(taken, default=0)


def _deflated(data: bytes, limit: int) -> Iterator[str]:
    """The text of ``data`` if all of it is one raw deflate stream."""
    def inflated() -> Iterator[bytes]:
        inside, todo = zlib.decompressobj(-15), data
        while not inside.eof and (piece := inside.decompress(todo, PIECE)):
            todo = inside.unconsumed_tail
            yield piece
        if not inside.eof or inside.unused_data:
            raise zlib.error

    try:
        for _ in inflated():
            pass
    except zlib.error:
        return
    yield from _texts(inflated(), limit)


def _utf16(data: bytes) -> str | None:
    """``data`` read as UTF-16, if every other of most of its bytes is NUL or it begins with the mark of the byte order."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    for at, kind in ((1, "utf-16-le"), (0, "utf-16-be")):
        if 4 * data[at::2].count(0) > len(data) > 1:
            return data.decode(kind, "replace")
    return None


def _base64(text: str) -> Iterator[tuple[str, int, int]]:
    """(characters of base64, start, end) of the runs, alone and joined over line breaks."""
    joined = (m for m in WRAPPED.finditer(text) if "\n" in m[0]) if "\n" in text else ()
    for m in chain(BASE64.finditer(text), joined):
        yield re.sub(r"[\s>=]", "", m[0]).replace("-", "+").replace("_", "/"), m.start(), m.end()


def _decoded(data: bytes, limit: int) -> Iterator[tuple[str, str]]:
    """(names of the layers, text) of what decoded bytes may be; nothing where they can hold neither secret nor encoding."""
    if wide := _utf16(data):
        yield "utf16.", wide
    yield from (("deflate.", part) for part in _deflated(data, limit))
    yield from _packed(data, limit)
    if _live(data):
        yield "", data.decode("utf-8", "replace")


def _is_text(data: bytes) -> bool:
    try:
        return not CONTROL.search(data.decode())
    except UnicodeDecodeError:
        return False


def _inner(layer: Layer, limit: int) -> Iterator[Layer]:
    """The layers right inside a layer."""
    text, starts, ends, path = layer
    reached = 0
    for m in PACKED_URL.finditer(text) if "%" in text else ():
        if m.start() >= reached and (run := URL_DATA.match(text, m.start())):
            reached = run.end()
            for name, part in _packed(unquote_to_bytes(run[0]), limit):
                yield part, *_place(starts, ends, m.start(), reached), f"{path}url.{name}"
    for run, a, b in _base64(text):
        for k in range(4):  # other characters may stand before the first one; once the bytes make sense they do not
            piece = run[k : len(run) - ((len(run) - k) % 4 == 1)]
            data = base64.b64decode(piece + "=" * (-len(piece) % 4))
            sound = False
            for name, part in _decoded(data, limit):
                sound |= name != "" and "\ufffd" not in part and not CONTROL.search(part)
                yield part, *_place(starts, ends, a + k, b), f"{path}base64.{name}"
            if sound or _is_text(data):
                break
    for mark, pattern, name, decode in (("%", PERCENT, "url", _percent), ("\\", ESCAPE, "unicode", _escape)):  # last, as what else is in the layer is in these too
        if mark in text and (inner := _in_place(layer, pattern, name, decode)):
            yield inner


def unwrap(text: str, limit: int = 1 << 24) -> list[tuple[str, int, int, str, str]]:
    """(kind, start, end, layers, secret) in ``text`` and all layers inside it; spans are those in ``text``.

    A compressed layer is read whole, in parts of about ``limit`` characters, so that a small document
    does not fill memory, unless it holds no character to cut at.
    """
    seen: set[tuple] = set()
    found: dict[tuple, tuple] = {}
    work: list[tuple[Layer, Iterator[Layer]]] = [((text, range(len(text)), range(1, len(text) + 1), ""), iter(()))]
    while work:
        layer, others = work.pop()
        if (other := next(others, None)) is not None:
            work.append((other, others))
        inner, starts, ends, path = layer
        if not inner:
            continue
        mark = (hashlib.blake2b(inner.encode("utf-8", "surrogatepass"), digest_size=16).digest(), *_place(starts, ends, 0, len(inner)))
        if mark in seen:
            continue
        seen.add(mark)
        for kind, a, b in scan(inner):
            key = (kind, *_place(starts, ends, a, b), inner[a:b])
            if key not in found or path.count(".") < found[key][3].count("."):
                found[key] = (*key[:3], path, inner[a:b])
        inside = _inner(layer, limit)
        if (first := next(inside, None)) is not None:
            work.append((first, inside))
    return sorted(found.values(), key=lambda s: (s[1], s[3] != "", ORDER.index(s[0]), s[2], s[3], s[4]))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("layers", pa.string()), ("secret", pa.string())]))
SPANS_DDL = "array<struct<kind: string, start: int, end: int, layers: string, secret: string>>"


def _find(limit: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            told = pc.fill_null(pc.match_substring_regex(texts, HINT), False).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in W.slices(texts):
                start, end, first = W.find_words(data, offsets, RUN)
                long_run = W.per_row(end - start >= 16, first) > 0
                spans: list[list] = [[] for _ in range(hi - lo)]
                for r in np.flatnonzero(long_run | told[lo:hi]).tolist():
                    text = data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace")
                    spans[r] = [dict(zip(("kind", "start", "end", "layers", "secret"), s, strict=True)) for s in unwrap(text, limit)]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(spans, SPANS)], ["doc_id", "spans"])

    return find


def scan_secrets(docs: DataFrame, inflate_limit: int = 1 << 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): secrets of each document and of the layers encoded in it, by start.

    A span has kind (assign, access or hex), start and end in code points of the document, the layers
    it was under ('' for none, else for example ``url.base64.zip.``) and the secret itself. One row
    for each row of ``docs``; null and empty texts have no spans; ids may be null or repeat; further
    columns are ignored.
    """
    keys = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = keys.schema["doc_id"].dataType.simpleString()
    return keys.mapInArrow(_find(inflate_limit), f"doc_id {kind}, spans {SPANS_DDL}")

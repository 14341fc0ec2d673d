"""SentencePiece encoding and decoding of BPE models, by a table of the prefixes of a text.

Merging leaves one sequence of pieces for each text, and in each prefix of the text one last piece. An
automaton lists the pieces that end at a place; the last piece of the prefix is the one that stays apart
from the last piece of what is before it, that is, merging the two alone would give these two again. So the
table fills from left to right, one entry a character, and the ids are read backwards from its end.

No piece goes beyond a place whose two characters stand beside each other in no piece. So texts are
cut before blanks, around digits and between letters and other characters, as far as the pieces of the model allow it, and the
ids of a cut are kept for when it comes again.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

BLANK = "▁"
#: Cuts whose ids are kept in a task, the longest of them, and pairs of pieces that are kept.
KEPT, KEPT_CHARS, KEPT_PAIRS = 1 << 18, 64, 1 << 18
#: Characters of a text that are looked at together.
PART = 1 << 20


class Apart(dict):
    """Whether two pieces, one after the other, are not merged across the border between them."""

    def __init__(self, rank: dict[str, int], halves: dict[str, tuple[str, str]]):
        super().__init__()
        self.rank, self.halves = rank, halves

    def __missing__(self, pair: tuple[str, str]) -> bool:
        if len(self) >= KEPT_PAIRS:
            self.clear()
        self[pair] = found = self.test(*pair)
        return found

    def test(self, a: str, b: str) -> bool:
        """The merges that made the two are taken back from the last on; none of the symbols that then meet
        at the border may merge earlier than what was taken back. Of equal merges the left one comes first.
        """
        rank, halves = self.rank, self.halves
        before = len(rank)
        while True:
            meet = rank.get(a + b)
            if meet is not None and meet < before:
                return False
            left, right = (rank[a] if len(a) > 1 else -1), (rank[b] if len(b) > 1 else -1)
            if left < 0 and right < 0:
                return True
            if left > right:
                a, before = halves[a][1], left
            else:
                b, before = halves[b][0], right + 1


def cuts(pieces: Iterable[str]) -> re.Pattern:
    """Finds the parts of a text that no piece goes beyond."""
    met = {(a, b) for p in pieces for a, b in zip(p, p[1:])}
    if any(b == BLANK != a for a, b in met):
        return re.compile(r"(?s).+")
    letter, digit = re.compile(r"[^\W\d_]").match, re.compile(r"\d").match
    odd = "".join(sorted({a for a, b in met if letter(a) and not letter(b)}))  # such as a high figure before a stop

    def kind(c: str) -> str:
        return "blank" if c == BLANK else "digit" if digit(c) else "letter" if letter(c) and c not in odd else "other"

    kinds = {(kind(a), kind(b)) for a, b in met}
    if any("digit" in pair for pair in kinds) or kinds & {("letter", "other"), ("other", "letter")}:
        return re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
    return re.compile(rf"{BLANK}*[^\W\d_{odd}]+|{BLANK}*(?:[^\w{BLANK}]|[_{odd}])+|{BLANK}+|\d")


class Pieces(dict):
    """A BPE model; as a dict it holds the ids of cuts of texts, blanks written as U+2581."""

    def __init__(self, model: bytes):
        super().__init__()
        self.old: dict[str, tuple[int, ...]] = {}
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {names[i]: i for i in plain}
        self.byte_ids = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte pieces to fall back on")
        #: Place in the order of merges: equal scores are equal.
        place = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        self.rank = {names[i]: place[sp.get_score(i)] for i in plain}
        self.cuts = cuts(self.ids)
        self.halves: dict[str, tuple[str, str]] = {}
        self.apart = Apart(self.rank, self.halves)
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if len(piece) > 1 and self.merged(piece) == [piece]:
                self.automaton.add_word(piece, (piece, len(piece)))
        self.automaton.make_automaton()
        surface = [b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else bytes([int(names[i][3:5], 16)]) if sp.is_byte(i) else names[i].replace(BLANK, " ").encode() for i in range(n)]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(s) for s in surface])])
        self.is_byte = np.array([sp.is_byte(i) for i in range(n)])
        self.leads = np.zeros(n, bool)
        self.leads[[i for p, i in self.ids.items() if p.startswith(BLANK)]] = True

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging itself; notes the two halves of each piece it makes."""
        parts = list(text)
        while True:
            best = min(((self.rank[p], k) for k in range(len(parts) - 1) if (p := parts[k] + parts[k + 1]) in self.rank), default=None)
            if best is None:
                return parts
            k = best[1]
            if len(parts) == 2:
                self.halves[text] = (parts[0], parts[1])
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def encode_cut(self, text: str) -> tuple[int, ...]:
        """Ids of a cut of any length, by the table of its prefixes."""
        last, apart, done = list(text), self.apart, -1
        for end, (piece, n) in self.automaton.iter(text):  # by end, the longest first
            if end != done and (end < n or apart[last[end - n], piece]):
                last[end] = piece
                done = end
        out, end, ids = [], len(last) - 1, self.ids
        while end >= 0:
            piece = last[end]
            end -= len(piece)
            if piece in ids:
                out.append(ids[piece])
            else:
                out.extend(self.byte_ids[b] for b in reversed(piece.encode("utf-8", "replace")))
        out.reverse()
        return tuple(out)

    def __missing__(self, cut: str) -> tuple[int, ...]:
        found = self.old.pop(cut, None) or self.encode_cut(cut)
        if len(cut) <= KEPT_CHARS:
            if len(self) >= KEPT // 2:  # what does not come again before the half fills up is forgotten
                self.old = dict(self)
                self.clear()
            self[cut] = found
        return found

    def encode(self, text: str) -> array:
        """Ids of a whole text, without begin and end."""
        out = array("i")
        if not text:
            return out
        text, at = BLANK + text.replace(" ", BLANK), 0
        while at < len(text):
            end = len(text)
            if end - at > 2 * PART:  # a part ends where a cut ends
                end = next((m.end() for m in self.cuts.finditer(text, at) if m.end() - at >= PART), end)
            out.extend(chain.from_iterable(map(self.__getitem__, self.cuts.findall(text, at, end))))
            at = end
        return out

    def bytes_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids, end of each id's bytes)."""
        size = self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.offsets[ids] - (ends - size), size)
        return self.surface[at], ends

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``; a byte that is in no whole character becomes U+FFFD."""
        data, ends = self.bytes_of(ids)
        first = int(np.argmax(ends > 0)) if len(ends) and ends[-1] else None
        if first is not None and self.leads[ids[first]]:
            data, ends = data[1:], np.maximum(ends - 1, 0)
        data = data.tobytes()
        try:
            return data.decode()
        except UnicodeDecodeError:
            single = np.flatnonzero(np.diff(self.is_byte[ids], prepend=False, append=False))
            out, at = [], 0
            for lo, hi in zip(single[::2], single[1::2], strict=True):
                start = int(ends[lo - 1]) if lo else 0
                out += [data[at:start].decode(), _single_bytes(data[start : int(ends[hi - 1])])]
                at = int(ends[hi - 1])
            return "".join([*out, data[at:].decode()])


def _single_bytes(data: bytes) -> str:
    """UTF-8 with U+FFFD for each byte that is in no whole character."""
    out, at = [], 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[at : at + n].decode())
                break
            except UnicodeDecodeError:
                n = 1 if n == 4 else n
        else:
            out.append("�")
        at += n
    return "".join(out)


@lru_cache(maxsize=2)
def pieces(model: bytes) -> Pieces:
    """The model of a task, read once."""
    return Pieces(model)


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _encode(model: bytes):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pieces(model)
        for batch in batches:
            for lo, n in runs(batch.column(1)):
                part = batch.slice(lo, n)
                ids = [held.encode(t or "") for t in part.column(1).to_pylist()]
                at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate([np.frombuffer(x, np.int32) for x in ids]) if at[-1] else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(at, pa.array(flat))], ["doc_id", "ids"])

    return encode


def runs(texts: pa.Array, limit: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """(first, number) of runs of rows with about ``limit`` bytes."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + limit, "right")))
        yield at, end - at
        at = end


def _decode(model: bytes):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pieces(model)
        for batch in batches:
            names = batch.schema.names
            ids = batch.column("ids")
            texts = [None if x is None else held.decode(np.asarray(x.values, np.int64)) for x in (s if s.is_valid else None for s in ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    return decode


def encode(docs: DataFrame, model_path: str, decoded: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of each whole text as a list of int, as the model's own library gives them.

    ``model_path`` is a SentencePiece model of type BPE with byte pieces and no normalisation; the driver reads it, its bytes go
    to the tasks. With ``decoded`` the ids are decoded too, in the same pass (a further column, as by ``decode``). One row for each row of
    ``docs``: null and empty texts have no ids; ids of documents may be null or repeat; further columns are ignored. A text takes time in
    proportion to its length, also one without blanks.
    """
    keys = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ddl = f"doc_id {keys.schema['doc_id'].dataType.simpleString()}, ids array<int>"
    there, back = _encode(model := read_model(model_path)), _decode(model)
    if not decoded:
        return keys.mapInArrow(there, ddl)
    return keys.mapInArrow(lambda batches: back(there(batches)), f"{ddl}, decoded string")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``encoded`` (with a column ``ids``) and the text ``decoded``; null ids give null, no ids the empty text."""
    schema = StructType([*encoded.schema.fields, StructField("decoded", StringType())])
    return encoded.mapInArrow(_decode(read_model(model_path)), schema)

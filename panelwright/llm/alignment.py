"""Links between the tokens that two tokenizers make of the same texts.

Incidence matrices in compressed sparse rows say which bytes a token holds. Gustavson's row products A·Bᵀ of
the two give the overlap links: tokens that share bytes. Where no overlap reaches across, both tokenizers end a token,
and a group of tokens ends. The incidence of token ids and groups, multiplied in the same way, gives
the shared-group links as ids with their numbers of occurrences, without a pair of tokens becoming a row.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import words as W
from panelwright.llm.common import grouped, materialise
from panelwright.llm.pieces import Pieces, pieces, read_model, runs

#: How texts are cut before pairs of bytes are merged: a fixed value of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Products made at once, id pairs in a row of the table of links, and pairs that are sent to all tasks.
PRODUCTS, CHUNK, SENT = 1 << 20, 1 << 18, 1 << 20


@dataclass
class Rows:
    """A sparse matrix by rows: row i has ``values`` in the columns ``cols``, from ``at[i]`` to ``at[i + 1]``."""

    at: np.ndarray
    cols: np.ndarray
    values: np.ndarray
    n_cols: int

    @classmethod
    def of(cls, row: np.ndarray, col: np.ndarray, n_rows: int, n_cols: int) -> Rows:
        """From entries in any order; equal ones are added up."""
        key = np.sort(row.astype(np.int64) * n_cols + col, kind="stable")
        lead = np.flatnonzero(np.diff(key, prepend=-1))
        key, values = key[lead], np.diff(lead, append=len(key))
        at = np.searchsorted(key, np.arange(n_rows + 1) * n_cols)
        return cls(at, key % max(n_cols, 1), values, n_cols)

    def transposed(self) -> Rows:
        order = np.argsort(self.cols, kind="stable")
        at = np.concatenate([[0], np.cumsum(np.bincount(self.cols, minlength=self.n_cols))])
        rows = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))
        return Rows(at, rows[order], self.values[order], len(self.at) - 1)

    def times(self, other: Rows, limit: int = PRODUCTS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, column, value) of the product, whole rows at a time, by row and column.

        Row i is the sum of the rows of ``other`` that the entries of row i point at. A part has about ``limit`` products; one row is never cut.
        """
        size = np.diff(other.at)[self.cols]
        total = np.concatenate([[0], np.cumsum(size)])[self.at]
        first, n_rows = 0, len(self.at) - 1
        while first < n_rows:
            last = max(first + 1, int(np.searchsorted(total, total[first] + limit, "right")) - 1)
            entries = slice(self.at[first], self.at[last])
            n = size[entries]
            begin = np.cumsum(n) - n
            at = np.arange(n.sum()) + np.repeat(other.at[self.cols[entries]] - begin, n)
            row = np.repeat(np.repeat(np.arange(first, last), np.diff(self.at[first : last + 1])), n)
            key = row * other.n_cols + other.cols[at]
            value = np.repeat(self.values[entries], n) * other.values[at]
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
            lead = np.flatnonzero(np.diff(key, prepend=-1))
            if len(lead):
                yield key[lead] // other.n_cols, key[lead] % other.n_cols, np.add.reduceat(value, lead)
            first = last


class ByteTokens:
    """A byte-level BPE, from the JSON of its vocabulary and merges."""

    def __init__(self, model: bytes):
        told = json.loads(model)["model"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        by_id = {i: bytes(byte[c] for c in w) for w, i in told["vocab"].items() if all(c in byte for c in w)}
        made = [told["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in told["merges"]]
        if made != sorted(made):
            raise ValueError("the ids do not follow the order of the merges")
        single = [i for i, w in by_id.items() if len(w) == 1]
        ranks = {by_id[i]: i for i in (*single, *made)}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(by_id) + 1, np.int64)
        self.sizes[list(by_id)] = [len(w) for w in by_id.values()]

    def encode(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype(np.int64)


@lru_cache(maxsize=2)
def byte_tokens(model: bytes) -> ByteTokens:
    """The model of a task, read once."""
    return ByteTokens(model)


@dataclass
class Tokens:
    """The tokens of one tokenizer in a run of texts: ids, sizes in bytes, and the text of each."""

    ids: np.ndarray
    sizes: np.ndarray
    text: np.ndarray

    def incidence(self) -> Rows:
        """Tokens by bytes."""
        ends = np.cumsum(self.sizes)
        n = int(ends[-1]) if len(ends) else 0
        return Rows(np.concatenate([[0], ends]), np.arange(n), np.ones(n, np.int64), n)


def tokens(texts: list[str | None], a: ByteTokens, b: Pieces) -> tuple[Tokens, Tokens]:
    """The tokens of each text behind a blank; none where they do not stand for its very bytes."""
    found: tuple[list, list] = ([], [])
    for text in texts:
        ids_a, ids_b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if text:
            ids_b = np.frombuffer(b.encode(text), np.int32).astype(np.int64)
            if b.bytes_of(ids_b)[0].tobytes() == f" {text}".encode():
                ids_a = a.encode(f" {text}")
            else:
                ids_b = ids_b[:0]
        found[0].append(ids_a)
        found[1].append(ids_b)
    sizes = (a.sizes, np.diff(b.offsets))
    out = []
    for ids, size in zip(found, sizes, strict=True):
        flat = np.concatenate(ids)
        out.append(Tokens(flat, size[flat], np.repeat(np.arange(len(ids)), [len(i) for i in ids])))
    return out[0], out[1]


def overlaps(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token of a, token of b, bytes they share): all overlap links, by both."""
    parts = list(a.incidence().times(b.incidence().transposed()))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3


def groups(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token, counted on over all texts: tokens that overlaps join, directly or not."""
    left, right, _ = overlaps(a, b)
    first, last = np.searchsorted(left, np.arange(len(a.ids))), np.searchsorted(left, np.arange(len(a.ids)), "right") - 1
    low, high = right[first], right[last]
    new = np.ones(len(a.ids), bool)
    new[1:] = low[1:] != high[:-1]
    of_a = np.cumsum(new) - 1
    of_b = np.zeros(len(b.ids), np.int64)
    of_b[right] = of_a[left]
    return of_a, of_b


def written(a: Tokens, b: Tokens, of_a: np.ndarray, of_b: np.ndarray, n: int) -> list[bytes]:
    """`a1,a2|b1;a3|b2,b3` of each text: the ids in the groups."""
    ids, text = np.concatenate([a.ids, b.ids]), np.concatenate([a.text, b.text])
    part = np.concatenate([2 * of_a, 2 * of_b + 1])
    order = np.argsort(part, kind="stable")
    ids, text, part = ids[order], text[order], part[order]
    width = len(str(ids.max(initial=0)))
    digits = ids[:, None] // 10 ** np.arange(width - 1, -1, -1)
    shown = (digits > 0) | (np.arange(width) == width - 1)
    out = np.zeros((len(ids), width + 1), np.uint8)
    out[:, :-1] = np.where(shown, digits % 10 + 48, 0)
    ends = np.diff(part, append=-1) != 0
    out[:, -1] = np.where(ends, np.where(part % 2 == 0, ord("|"), ord(";")), ord(","))
    out[np.diff(text, append=-1) != 0, -1] = 0
    there = out != 0
    sizes = np.bincount(text, there.sum(axis=1), n).astype(np.int64)
    flat, at = out[there], np.concatenate([[0], np.cumsum(sizes)])
    return [flat[at[k] : at[k + 1]].tobytes() for k in range(n)]


def id_links(a: Tokens, b: Tokens, of_a: np.ndarray, of_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, id pair, occurrences) of the shared-group links, by text; a pair is id_a * 2 ** 32 + id_b."""
    if not len(a.ids):
        return
    row, at = np.unique(a.text << 32 | a.ids, return_inverse=True)
    n_groups, n_ids = int(of_a[-1]) + 1, int(b.ids.max()) + 1
    by_id = Rows.of(at, of_a, len(row), n_groups)
    by_group = Rows.of(of_b, b.ids, n_groups, n_ids)
    for r, c, value in by_id.times(by_group):
        yield row[r] >> 32, (row[r] & 0xFFFFFFFF) << 32 | c, value


LINKS = pa.schema(
    [(n, pa.int64()) for n in ("row", "n_a", "n_b", "n_groups", "n_links")]
    + [("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))]
)
LINKS_DDL = "row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def _align(model_a: bytes, model_b: bytes, chunk: int):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, n in runs(batch.column(1), 1 << 20):
                rows, texts = (c.slice(lo, n) for c in batch.columns)
                a, b = tokens(texts.to_pylist(), byte_tokens(model_a), pieces(model_b))
                of_a, of_b = groups(a, b)
                in_a, in_b = np.bincount(of_a), np.bincount(of_b)
                text_of = np.zeros(len(in_a), np.int64)
                text_of[of_a] = a.text
                count = lambda x, w=None: np.bincount(x, w, n).astype(np.int64)
                n_a, n_b = count(a.text), count(b.text)
                links = np.zeros(n, np.int64)
                np.add.at(links, text_of, in_a * in_b)
                shas = [hashlib.sha256(s).hexdigest() if s else "" for s in written(a, b, of_a, of_b, n)]
                none = pa.nulls(n, LINKS.field("pairs").type)
                yield pa.RecordBatch.from_arrays([rows, *map(pa.array, (n_a, n_b, count(text_of), links, shas)), none, none], schema=LINKS)
                yield from _chunks(rows.to_numpy(), id_links(a, b, of_a, of_b), chunk)

    return align


def _chunks(rows: np.ndarray, found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], chunk: int) -> Iterator[pa.RecordBatch]:
    """Rows of up to ``chunk`` pairs of one text."""
    for text, pair, times in found:
        starts = np.flatnonzero(np.diff(text, prepend=-1))
        ends = np.append(starts[1:], len(text))
        cut = np.concatenate([np.arange(s, e, chunk) for s, e in zip(starts, ends, strict=True)])
        at = np.append(cut, len(text)).astype(np.int32)
        lists = (pa.ListArray.from_arrays(at, pa.array(x)) for x in (pair, times))
        empty = [pa.nulls(len(cut), LINKS.field(k).type) for k in range(1, 6)]
        yield pa.RecordBatch.from_arrays([pa.array(rows[text[cut]]), *empty, *lists], schema=LINKS)


def link_table(docs: DataFrame, model_a: str, model_b: str, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(row, doc_id) of all documents, and a table of their links, written once: a row of figures for each document (``pairs`` is null), and rows of its id pairs (the other columns are null), written once.

    ``row`` tells the rows of ``docs`` apart.
    """
    keys = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keys = materialise(keys.withColumn("row", F.monotonically_increasing_id()))
    table = materialise(keys.select("row", "text").mapInArrow(_align(read_model(model_a), read_model(model_b), chunk), LINKS_DDL))
    return keys.select("row", "doc_id"), table


def pair_counts(table: DataFrame) -> DataFrame:
    """(a, b, pair, n, best): how many documents hold the ids a and b linked, and whether it is the most of any pair with a."""
    counts = grouped(table.where(F.col("pairs").isNotNull()).select(F.explode("pairs").alias("pair")), ["pair"], n=F.count("*"))
    a = F.shiftright("pair", 32).cast("int")
    counts = materialise(counts.select(a.alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), "pair", "n"))
    most = grouped(counts, ["a"], most=F.max("n"))
    return materialise(counts.join(most, "a").select("a", "b", "pair", "n", (F.col("n") == F.col("most")).alias("best")))


def _cutoff(counts: DataFrame, limit: int) -> int:
    """The least power of two that at most ``limit`` pairs reach; 1 if all do."""
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count("*").alias("pairs")).collect()
    held, least = 0, 62
    for k, n in sorted(((r.k, r.pairs) for r in sizes), reverse=True):
        held += n
        if held > limit:
            return 1 << least
        least = k
    return 1


def _looked_up(pair: np.ndarray, n: np.ndarray, best: np.ndarray, rest: bool):
    """Sums over the pairs of a row that are in the table, or the pairs that are not."""

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, pairs, times = batch.columns
            size = np.diff(pairs.offsets.to_numpy())
            pairs, times = pairs.flatten().to_numpy(), times.flatten().to_numpy()
            at = np.minimum(np.searchsorted(pair, pairs), len(pair) - 1)
            there = pair[at] == pairs
            if rest:
                rows = np.repeat(row.to_numpy(), size)
                yield pa.RecordBatch.from_arrays([pa.array(x[~there]) for x in (rows, pairs, times)], ["row", "pair", "times"])
            else:
                first = np.concatenate([[0], np.cumsum(size)])
                sums = (pa.array(W.per_row(np.where(there, times * x[at], 0), first)) for x in (best.astype(np.int64), n))
                yield pa.RecordBatch.from_arrays([row, *sums], ["row", "n_best", "count_sum"])

    return look_up


def scores(table: DataFrame, counts: DataFrame, limit: int = SENT) -> DataFrame:
    """(row, n_best, count_sum) of the rows with links.

    The most frequent pairs, ``limit`` at most, are sent to all tasks; only rarer ones are joined.
    """
    cut = _cutoff(counts, limit)
    often = counts.where(F.col("n") >= cut).select("pair", "n", "best").orderBy("pair").toArrow()
    sent = tuple(often[c].to_numpy() for c in ("pair", "n", "best"))
    held = table.where(F.col("pairs").isNotNull()).select("row", "pairs", "times")
    sums = []
    if len(often):
        sums.append(held.mapInArrow(_looked_up(*sent, False), "row long, n_best long, count_sum long"))
    if cut > 1:
        rare = counts.where(F.col("n") < cut).select("pair", "n", "best")
        if len(often):
            left = held.mapInArrow(_looked_up(*sent, True), "row long, pair long, times long")
        else:
            left = held.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
        best = F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best")
        sums.append(left.join(rare, "pair").select("row", best, (F.col("times") * F.col("n")).alias("count_sum")))
    both = sums[0] if len(sums) == 1 else sums[0].unionByName(sums[1]) if sums else None
    if both is None:
        return table.sparkSession.createDataFrame([], "row long, n_best long, count_sum long")
    return both.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(docs: DataFrame, model_a: str, model_b: str, sent: int = SENT, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document.

    ``model_a`` is the JSON of a byte-level BPE, ``model_b`` a SentencePiece BPE model; a gets a blank before
    the text, as b adds one itself; special tokens are plain text. Byte offsets where tokens of both end cut
    them into groups, and tokens in one group are linked. ``n_best`` counts the links whose id pair is linked
    in more documents than any other pair with the same id of a (ties count), ``count_sum`` adds up these
    numbers of documents over the links. ``groups_sha256`` is that of `a1,a2|b1;a3|b2,b3`.

    One row for each row of ``docs``, and each counts as a document, also repeated ones. Texts that are null or
    empty, or whose tokens do not give the text's bytes back, have zeros and an empty string. Ids may be null;
    further columns are ignored.
    """
    keys, table = link_table(docs, model_a, model_b, chunk, id_col, text_col)
    figures = table.where(F.col("n_a").isNotNull()).drop("pairs", "times")
    found = keys.join(figures, "row").join(scores(table, pair_counts(table), sent), "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def token_overlaps(docs: DataFrame, model_a: str, model_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, links): the overlap links of each document as structs of a and b (places of the tokens) and the bytes they share."""
    one, two = read_model(model_a), read_model(model_b)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, n in runs(batch.column(1), 1 << 20):
                ids, texts = (c.slice(lo, n) for c in batch.columns)
                a, b = tokens(texts.to_pylist(), byte_tokens(one), pieces(two))
                left, right, size = overlaps(a, b)
                text = a.text[left]
                at = np.searchsorted(text, np.arange(n + 1)).astype(np.int32)
                first = (np.searchsorted(t.text, np.arange(n)) for t in (a, b))
                places = [pa.array((x - f[text]).astype(np.int32)) for x, f in zip((left, right), first, strict=True)]
                links = pa.StructArray.from_arrays([*places, pa.array(size.astype(np.int32))], ["a", "b", "bytes"])
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(at, links)], ["doc_id", "links"])

    keys = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = keys.schema["doc_id"].dataType.simpleString()
    return keys.mapInArrow(find, f"doc_id {kind}, links array<struct<a: int, b: int, bytes: int>>")

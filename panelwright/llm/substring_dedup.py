"""Removal of repeated byte strings by difference-cover suffix sorting.

Only strings that start alike can be equal, so Spark deals the suffixes to tasks by what they start
with. Every string of ``length`` bytes points at its anchor, the gram in it with the lowest hash (the
rightmost, if tied): equal strings have equal anchors at equal places. Neighbouring starts with one
anchor are a run, and what a run's strings cover is its context. An anchor found once has no repeats;
equal contexts are a class, of which two copies stand for all. Spark gathers the contexts by anchor,
and each task sorts their suffixes: triples at the sampled places, names and triples of names, a merge
with the other suffixes, then a comparison of neighbours over ``length`` bytes. Where an anchor has too
many contexts for one task, they are sorted in parts, and the strings that a part holds once meet those
of the other parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm import words as W
from panelwright.llm.common import grouped, held_by, materialise
from panelwright.llm.suffix_sort import equal_neighbours, suffix_order

LENGTH, GRAM = 200, 50
#: Bits of the filters before joins on anchors (8 MB) and on texts (2 MB).
ANCHOR_BITS, TEXT_BITS = 26, 24
#: Contexts of one anchor that a task sorts together, and bytes in one sort.
PART, BATCH_BYTES = 512, 1_000_000
_PLACE = np.uint64((1 << 24) - 1)
RUNS = pa.list_(pa.struct([("anchor", pa.int64()), ("context", pa.int64()), ("place", pa.int64())]))
RUNS_DDL = "array<struct<anchor: long, context: long, place: long>>"


def _runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, anchor hash, context hash, start in the row, number of starts) of the runs of all rows; under 2 ** 24 bytes."""
    counts = np.maximum(np.diff(offsets) - length + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    starts = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + offsets[:-1][rows]
    if not len(starts):
        return rows, *(np.zeros(0, np.int64),) * 4
    hashes = W.gram_hash(data, gram)
    low = (hashes & ~_PLACE) | (_PLACE - np.arange(len(hashes), dtype=np.uint64))
    size, width = 1, length - gram + 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    place = (_PLACE - (low[starts] & _PLACE)).astype(np.int64)
    lead = np.ones(len(starts), bool)
    lead[1:] = (place[1:] != place[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(lead)
    n = np.diff(np.append(first, len(starts)))
    begin = starts[first]
    context = W.range_hash(data, begin, begin + n - 1 + length)
    return rows[first], hashes[place[first]].view(np.int64), context.view(np.int64), begin - offsets[:-1][rows[first]], n


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int, limit: int = 1 << 23) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shift, bytes, offsets): the slice as it is, or a single long row in pieces that overlap so that each start is in one."""
    if len(data) <= limit:
        yield 0, data, offsets
        return
    for a in range(0, len(data), limit):
        part = data[a : a + limit + length - 1]
        yield a, part, np.array([0, len(part)])


def _scan(length: int, gram: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *keys, texts = batch.columns
            for lo, hi, data, offsets in W.slices(texts):
                parts = [(shift, _runs(d, o, length, gram)) for shift, d, o in _pieces(data, offsets, length)]
                row = np.concatenate([r[0] for _, r in parts])
                place = np.concatenate([((r[3] + shift) << 32) | r[4] for shift, r in parts])
                columns = [*(np.concatenate([r[k] for _, r in parts]) for k in (1, 2)), place]
                at = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                values = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], [f.name for f in RUNS.value_type])
                lists = pa.ListArray.from_arrays(at, values)
                yield pa.RecordBatch.from_arrays([*(k.slice(lo, hi - lo) for k in keys), lists], [*batch.schema.names[:-1], "runs"])

    return scan


def _binary(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """``data[start:start + size]`` for each start."""
    at = np.concatenate([[0], np.cumsum(size)])
    places = np.arange(at[-1]) + np.repeat(start - at[:-1], size)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(data[places])]).cast(pa.binary())


def _bytes(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of binary values."""
    _, offsets, data = blobs.buffers()
    offsets = np.frombuffer(offsets, np.int32)[blobs.offset : blobs.offset + len(blobs) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8), offsets - offsets[0]


CONTEXTS = ("anchor", "context", "part", "start", "bytes")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contexts of a text, from (mark, text, runs); repeated rows of a document come once."""
    seen: set[int] = set()
    for batch in batches:
        marks = batch.column(0).to_pylist()
        new = [m not in seen and not seen.add(m) for m in marks]
        _, texts, wanted = batch.filter(pa.array(new, pa.bool_())).columns
        for lo, hi, data, offsets in W.slices(texts):
            lists = wanted.slice(lo, hi - lo)
            runs = lists.flatten()
            base = np.repeat(offsets[:-1], lists.value_lengths().to_numpy(zero_copy_only=False))
            start, size = (runs.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("start", "bytes"))
            yield pa.RecordBatch.from_arrays([*(runs.field(f) for f in CONTEXTS[:-1]), _binary(data, base + start, size)], list(CONTEXTS))


SETTLED = pa.schema(
    [("anchor", pa.int64()), ("context", pa.int64()), ("spans", pa.list_(pa.struct([("at", pa.int32()), ("upto", pa.int32())]))),
     ("at", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())]
)
SETTLED_DDL = "anchor long, context long, spans array<struct<at: int, upto: int>>, at int, h1 long, h2 long"


def _settled(**columns: pa.Array) -> pa.RecordBatch:
    """The columns, and nulls for the others."""
    n = len(columns["anchor"])
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in SETTLED], schema=SETTLED)


def _settle(table: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    """The repeated starts of each context among the contexts of whole groups, as spans of starts.

    Then the strings of parts of large anchors, each once; with its context if the part holds it once.
    """
    table = table.combine_chunks()
    data, offsets = _bytes(table["bytes"].chunk(0))
    n = np.diff(offsets) - length + 1
    owner = np.repeat(np.arange(len(n)), n)
    starts = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + offsets[:-1][owner]
    order = suffix_order(data, starts, length)
    same = equal_neighbours(data, order, length)
    twice = np.zeros(len(data), bool)
    twice[order[:-1][same]] = twice[order[1:][same]] = True

    keep = np.zeros(len(data) + 1, np.int8)
    keep[1:] = twice
    edge = np.diff(keep, append=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # a context ends in bytes that are no starts
    k = np.searchsorted(offsets, first, "right") - 1
    has, at = np.unique(k, return_index=True)
    spans = pa.StructArray.from_arrays([pa.array((x - offsets[k]).astype(np.int32)) for x in (first, last)], ["at", "upto"])
    lists = pa.ListArray.from_arrays(np.append(at, len(k)).astype(np.int32), spans)
    pairs = np.stack([table[c].chunk(0).to_numpy()[has] for c in ("anchor", "context")], 1)
    _, once = np.unique(pairs, axis=0, return_index=True)  # both copies of a class have the same spans
    yield _settled(anchor=pa.array(pairs[once, 0]), context=pa.array(pairs[once, 1]), spans=lists.take(pa.array(once)))

    part = table["part"].chunk(0)
    if part.null_count < len(part):
        k = np.searchsorted(offsets, order, "right") - 1
        lead = np.concatenate([[True], ~same]) & part.is_valid().to_numpy(zero_copy_only=False)[k]
        begin, k = order[lead], k[lead]
        keys = {c: table[c].chunk(0).take(pa.array(k)) for c in ("anchor", "context")}
        keys["context"] = pc.if_else(pa.array(twice[begin]), None, keys["context"])
        hashes = {f"h{i + 1}": pa.array(W.range_hash(data, begin, begin + length, i).view(np.int64)) for i in (0, 1)}
        yield _settled(**keys, at=pa.array((begin - offsets[k]).astype(np.int32)), **hashes)


def _sorted_groups(length: int, batch_bytes: int):
    """Settle the contexts of a partition sorted by (anchor, part), some whole groups at a time."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            if not len(batch):
                continue
            anchor, part = batch.column("anchor").to_numpy(), pc.fill_null(batch.column("part"), -1).to_numpy()
            edges = np.flatnonzero((anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])) + 1
            if held and last != (anchor[0], part[0]):
                edges = np.concatenate([[0], edges])
            last = (anchor[-1], part[-1])
            offsets = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column("bytes")).to_numpy(zero_copy_only=False))])
            at = 0
            for e in edges.tolist():
                if size + offsets[e] - offsets[at] > batch_bytes:
                    yield from _settle(pa.Table.from_batches([*held, batch.slice(at, e - at)]), length)
                    held, size, at = [], 0, e
            held.append(batch.slice(at))
            size += int(offsets[-1] - offsets[at])
        if held:
            yield from _settle(pa.Table.from_batches(held), length)

    return settle


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text without its spans."""
    for batch in batches:
        *keys, texts, spans = batch.columns
        for lo, hi, data, offsets in W.slices(texts):
            lists = spans.slice(lo, hi - lo)
            found = lists.flatten()
            base = np.repeat(offsets[:-1], lists.value_lengths().to_numpy(zero_copy_only=False))
            cover = np.zeros(len(data) + 1, np.int32)
            for field, by in (("start", 1), ("end", -1)):
                np.add.at(cover, base + found.field(field).to_numpy(zero_copy_only=False), by)
            gone = np.cumsum(cover[:-1]) > 0
            rising = gone.copy()
            rising[1:] &= ~gone[:-1]
            edges = offsets[:-1][offsets[:-1] < len(data)]
            rising[edges] = gone[edges]
            removed = W.per_row(gone, offsets)
            at = offsets - np.concatenate([[0], np.cumsum(removed)])
            kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(at), pa.py_buffer(data[~gone])]).cast(pa.binary())
            columns = [*(k.slice(lo, hi - lo) for k in keys), kept, pa.array(removed), pa.array(W.per_row(rising, offsets))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-2], "kept", "n_removed", "n_spans"])


def _runs_of(places: str) -> Column:
    """Spans of neighbouring numbers in a sorted array."""
    first = F.filter(places, lambda x: ~F.array_contains(places, x - 1))
    last = F.filter(places, lambda x: ~F.array_contains(places, x + 1))
    return F.arrays_zip(first.alias("at"), F.transform(last, lambda x: x + 1).alias("upto"))


def dedup_substrings(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, part: int = PART, batch_bytes: int = BATCH_BYTES,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Remove every byte covered by a string of ``length`` bytes that also starts anywhere else.

    Texts are UTF-8 bytes; strings lie within one document and are judged on the input; overlapping
    ones count, in the same document too. Returns doc_id, text_hash, n_bytes, n_removed, n_spans
    (maximal removed runs), kept (the remaining bytes; null where nothing was removed) and
    kept_sha256: one row for each row of ``docs``. Null text is empty. Rows are documents, so repeated
    rows are copies of each other. Ids may be null. Further columns are ignored.

    Contexts are a class if the hashes of anchor and context are equal; two of a class are then compared
    byte by byte in the sort. The classes of an anchor are sorted in parts of about ``part``; strings that
    a part holds once then meet those of the other parts by a 128-bit hash.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.octet_length(text).cast("long").alias("n_bytes"),
        F.sha2(text.cast("binary"), 256).alias("sha256"), text.alias("text"),
    )
    kind = keys.schema["doc_id"].dataType.simpleString()
    scanned = keys.mapInArrow(_scan(length, gram), f"doc_id {kind}, text_hash long, n_bytes long, sha256 string, runs {RUNS_DDL}")
    table = materialise(scanned.withColumn("row", F.monotonically_increasing_id()))

    runs = table.select("row", F.explode("runs").alias("r")).select("row", "r.*")
    seen = materialise(runs.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("anchor"))
    again = held_by(runs, seen, "anchor", ANCHOR_BITS)
    start, n = F.shiftright("place", 32).cast("int"), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    copy = F.struct("row", "place")
    classes = materialise(again.groupBy("anchor", "context").agg(F.count("*").alias("copies"), F.min(copy).alias("first"), F.max(copy).alias("last")))
    sizes = grouped(classes, ["anchor"], contexts=F.count("*"), found=F.sum("copies")).where(F.col("found") > 1)
    pair = F.when(F.col("copies") > 1, F.array("first", "last")).otherwise(F.array("first"))
    dealt = F.when(F.col("contexts") > part, F.pmod("context", F.ceil(F.col("contexts") / part)).cast("int"))
    wanted = classes.join(sizes, "anchor").select("anchor", "context", dealt.alias("part"), F.explode(pair).alias("c"))
    wanted = wanted.select("anchor", "context", "part", "c.*").select(
        "row", F.struct("anchor", "context", "part", start.alias("start"), (n - 1 + length).alias("bytes")).alias("run")
    )
    wanted = wanted.join(table.select("row", "doc_id", "text_hash"), "row").groupBy("doc_id", "text_hash").agg(F.min("row").alias("mark"), F.collect_list("run").alias("runs"))
    cut = _with_text(keys, materialise(wanted), ["mark", "runs"]).select("mark", "text", "runs")
    cut = cut.mapInArrow(_cut, "anchor long, context long, part int, start int, bytes binary").drop("start")
    groups = cut.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    settled = materialise(groups.mapInArrow(_sorted_groups(length, batch_bytes), SETTLED_DDL))
    strings = settled.where(F.col("spans").isNull())
    met = grouped(strings, ["h1", "h2"], n=F.count("*")).where(F.col("n") > 1)
    across = strings.where(F.col("context").isNotNull()).join(met, ["h1", "h2"])
    across = across.groupBy("anchor", "context").agg(F.array_sort(F.collect_set("at")).alias("places")).select("anchor", "context", _runs_of("places").alias("spans"))
    settled = settled.where(F.col("spans").isNotNull()).select("anchor", "context", "spans").unionByName(across)

    spans = again.join(settled, ["anchor", "context"]).select("row", F.explode("spans").alias("s"), start.alias("start"))
    spans = spans.select("row", F.struct((F.col("start") + F.col("s.at")).alias("start"), (F.col("start") + F.col("s.upto") - 1 + length).alias("end")).alias("s"))
    marked = spans.groupBy("row").agg(F.collect_set("s").alias("spans")).join(table.select("row", "doc_id", "text_hash"), "row")
    marked = materialise(marked.drop("row").dropDuplicates(["doc_id", "text_hash"]))
    stripped = _with_text(keys, marked, ["spans"]).select("doc_id", "text_hash", "text", "spans").mapInArrow(
        _strip, f"doc_id {kind}, text_hash long, kept binary, n_removed long, n_spans long"
    )
    stripped = stripped.withColumn("kept_sha256", F.sha2("kept", 256)).withColumnsRenamed({"doc_id": "id", "text_hash": "hash"}).dropDuplicates(["id", "hash"])
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
    none = F.lit(0).cast("long")
    return table.join(stripped, same, "left").select(
        "doc_id", "text_hash", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"),
        "kept", F.coalesce("kept_sha256", "sha256").alias("kept_sha256"),
    )


def _with_text(keys: DataFrame, listed: DataFrame, columns: list[str]) -> DataFrame:
    """``listed`` (doc_id, text_hash and ``columns``) with the texts; a filter spares most other texts the exchange."""
    texts = held_by(keys.select("doc_id", "text_hash", "text"), listed, "text_hash", TEXT_BITS)
    listed = listed.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), *columns)
    return texts.join(listed, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")))

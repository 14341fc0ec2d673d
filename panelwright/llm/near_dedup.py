"""Near-duplicate classes by DartMinHash.

A document is a weighted set: its shingles of five words, each as heavy as it is frequent. The axis of
an element's weight is cut into unit cells and the axis of ranks into intervals; the hash of a cell and
an interval throws a Poisson number of darts there, the same in every document that reaches the cell.
A dart falls on one of the signature's coordinates, and each coordinate keeps the dart of lowest rank.
Two documents agree on a coordinate with their weighted Jaccard similarity. Only as many ranks are
looked at as fill the coordinates, so a signature costs little more than reading the shingles once.

Bands of coordinates make buckets, buckets propose pairs, and pairs are checked on the shingles
themselves. Linked documents form a class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import words as W
from panelwright.llm.common import boxed, grouped, materialise
from panelwright.llm.graph import components

SHINGLE, BANDS, ROWS = 5, 24, 6
#: Lengths of the first rank intervals; all further ones have length 1.
INTERVALS = (0.125, 0.25, 0.5)
_U = np.uint64


def _number(h: np.ndarray) -> np.ndarray:
    """A hash as a number in [0, 1)."""
    return (h >> _U(11)).astype(np.float64) * 2.0**-53


def _step(k: int, by: int) -> np.uint64:
    return _U((k + 1) * by & 0xFFFFFFFFFFFFFFFF)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all shingles by row and hash; a row of fewer words, but not none, has one of all its words."""
    data = W.LOWER[data]
    start, end, first = W.find_words(data, offsets, W.ALNUM)
    hashes = W.range_hash(data, start, end)
    begin, row = W.windows(first, size, len(start))
    n = np.diff(first)
    few = np.flatnonzero((n > 0) & (n < size))
    row = np.concatenate([row, few])
    value = np.concatenate([W.range_hash(hashes, begin, begin + size), W.range_hash(hashes, first[few], first[few + 1])])
    order = np.lexsort((value, row))
    return row[order], value[order]


def _repeats(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """0, 1, ... within equal neighbours."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    at = np.arange(len(row))
    return at - np.maximum.accumulate(np.where(new, at, 0))


def _darts(row: np.ndarray, cell: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, rank, dart) of all darts in the cells with a rank below the limit of their row."""
    found, low, k = [], 0.0, 0
    while len(row):
        length = INTERVALS[k] if k < len(INTERVALS) else 1.0
        h = W.mix(cell + _step(k, 0xA0761D6478BD642F))
        u, below, p = _number(h), 0.0, math.exp(-length)
        for i in range(40):
            below += p
            more = u >= below
            if not more.any():
                break
            row_, h_ = row[more], h[more]
            dart = W.mix(h_ + _step(i, 0xE7037ED1A0B428DB))
            rank = low + length * _number(dart)
            inside = rank < limit[row_]
            found.append((row_[inside], rank[inside], W.mix(dart[inside] + _U(0x8EBC6AF09C88C6E3))))
            p *= length / (i + 1)
        low += length
        k += 1
        still = limit[row] > low
        row, cell = row[still], cell[still]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def signatures(row: np.ndarray, value: np.ndarray, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, has shingles) of each row, for shingles as from ``shingles``."""
    cell = W.mix(value + _repeats(row, value).astype(np.uint64) * _U(0x589965CC75374CC3))
    weight = np.bincount(row, minlength=n_rows).astype(np.float64)
    limit = np.where(weight > 0, (size * math.log(size) + 2 * size) / np.maximum(weight, 1), 0)
    out, open_ = np.zeros((n_rows, size), np.uint64), weight > 0
    while open_.any():
        mine = open_[row]
        r, rank, dart = _darts(row[mine], cell[mine], limit)
        slot = r * size + (dart % _U(size)).astype(np.int64)
        order = np.lexsort((rank, slot))
        slot, dart = slot[order], dart[order]
        lead = np.ones(len(slot), bool)
        lead[1:] = slot[1:] != slot[:-1]
        full = np.zeros(n_rows * size, bool)
        full[slot[lead]] = True
        out.reshape(-1)[slot[lead]] = dart[lead]
        open_ &= ~full.reshape(n_rows, size).all(axis=1)
        limit = limit * 2
    return out, weight > 0


def _sketch(shingle: int, bands: int, rows: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *keys, texts = batch.columns
            for lo, hi, data, offsets in W.slices(texts):
                sig, has = signatures(*shingles(data, offsets, shingle), hi - lo, bands * rows)
                key = np.repeat(np.arange(bands, dtype=np.uint64)[None], hi - lo, axis=0)
                for k in range(rows):
                    key = W.mix(key * _U(0x9E3779B97F4A7C15) + sig[:, k::rows])
                at = np.concatenate([[0], np.cumsum(np.where(has, bands, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(at, pa.array(key[has].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(k.slice(lo, hi - lo) for k in keys), lists], [*batch.schema.names[:-1], "buckets"])

    return sketch


def similarity(left: pa.Array, right: pa.Array, shingle: int) -> np.ndarray:
    """Weighted Jaccard similarity of the shingles of each pair; 0 if neither has any."""
    out = []
    for lo, hi, data, offsets in W.slices(left):
        sides = [shingles(data, offsets, shingle)]
        for _, _, data, offsets in W.slices(right.slice(lo, hi - lo), 1 << 62):
            sides.append(shingles(data, offsets, shingle))
        (ra, va), (rb, vb) = sides
        a, b = (W.mix(v + _repeats(r, v).astype(np.uint64) * _U(0x589965CC75374CC3) + r.astype(np.uint64) * _U(0x632BE59BD9B4E019)) for r, v in sides)
        both = np.bincount(ra[np.isin(a, b)], minlength=hi - lo)
        either = np.bincount(ra, minlength=hi - lo) + np.bincount(rb, minlength=hi - lo) - both
        out.append(both / np.maximum(either, 1))
    return np.concatenate(out) if out else np.zeros(0)


def _verify(shingle: int, least: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, right = batch.columns
            for lo in range(0, len(a), 256):
                part = slice(lo, min(lo + 256, len(a)))
                n = part.stop - part.start
                keep = pa.array(similarity(left.slice(lo, n), right.slice(lo, n), shingle) >= least)
                yield pa.RecordBatch.from_arrays([a.slice(lo, n).filter(keep), b.slice(lo, n).filter(keep)], ["a", "b"])

    return verify


def _checked(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are alike."""
    left, right = (texts.select(F.col("node").alias(c), F.col("text").alias(t)) for c, t in (("a", "left"), ("b", "right")))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return materialise(both.mapInArrow(_verify(shingle, least), "a long, b long"))


#: Least and most texts in a block of a crowded bucket, and its most characters.
BLOCK, BLOCK_CHARS = (128, 1024), 1 << 21
#: Up to so many texts, those that share a shingle are listed pair by pair.
FEW = 16
#: Each class of lengths is so many times as long as the one before.
LENGTHS = 1.05


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` after further links; only the classes that they touch are looked at."""
    for side in ("a", "b"):
        at = roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
        links = links.join(at, side, "left").withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
    moved = components(links.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    kept = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left")
    return materialise(kept.select("node", F.coalesce("new", "root").alias("root")).unionByName(moved))


def _tokens(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Shingles told apart from their repeats within a row, so that a row is a set."""
    return W.mix(value + _repeats(row, value).astype(np.uint64) * _U(0x589965CC75374CC3))


def _common(row: np.ndarray, value: np.ndarray, n_rows: int) -> np.ndarray:
    """Common shingles of all pairs of rows (lower row first), for shingles as from ``shingles``."""
    token = _tokens(row, value)
    order = np.lexsort((row, token))
    token, row = token[order], row[order]
    lead = np.ones(len(token), bool)
    lead[1:] = token[1:] != token[:-1]
    name = np.cumsum(lead) - 1
    count = np.bincount(name)[name] if len(name) else name
    out = np.zeros((n_rows, n_rows), np.float32 if len(row) < 1 << 24 else np.float64)
    few = (count > 1) & (count <= FEW)
    rare, at = row[few], name[few]
    for d in range(1, FEW):
        same = at[d:] == at[:-d]
        cell, times = np.unique(rare[:-d][same] * n_rows + rare[d:][same], return_counts=True)
        out.reshape(-1)[cell] += times
    often, at = row[count > FEW], np.cumsum(lead[count > FEW]) - 1
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, 2048):
        part = slice(*np.searchsorted(at, [lo, lo + 2048]))
        has = np.zeros((n_rows, 2048), np.float32)
        has[often[part], at[part] - lo] = 1
        out += has @ has.T
    return np.triu(out, 1)


def _links(shingle: int, least: float):
    def links(table: pa.Table) -> pa.Table:
        """Links between the classes of one or two blocks of a bucket, as many as join what is alike."""
        table = table.combine_chunks()
        root, block = (table[c].to_numpy() for c in ("root", "block"))
        found = []
        for lo, _, data, offsets in W.slices(table["text"].chunk(0)):
            row, value = shingles(data, offsets, shingle)
            found.append((row + lo, value))
        row, value = (np.concatenate(x) for x in zip(*found, strict=True))
        weight = np.bincount(row, minlength=len(root))
        both = _common(row, value, len(root))
        a, b = np.nonzero(both)
        apart = (root[a] != root[b]) & ((block[a] != block[b]) | (block[0] == block).all())
        a, b = a[apart], b[apart]
        common = both[a, b].astype(np.int64)
        alike = common / np.maximum(weight[a] + weight[b] - common, 1) >= least
        pairs = np.unique(np.sort(np.stack([root[a[alike]], root[b[alike]]], 1), axis=1), axis=0)
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        kept = []
        for x, y in pairs.tolist():
            u, v = top(x), top(y)
            if u != v:
                up[max(u, v)] = min(u, v)
                kept.append((y, x))
        return pa.table({c: pa.array([k[i] for k in kept], pa.int64()) for i, c in enumerate(("a", "b"))})

    return links


def _sets(shingle: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, texts = batch.columns
            for lo, hi, data, offsets in W.slices(texts):
                row, value = shingles(data, offsets, shingle)
                at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=hi - lo))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(at, pa.array(_tokens(row, value).view(np.int64)))
                yield pa.RecordBatch.from_arrays([node.slice(lo, hi - lo), lists], ["node", "tokens"])

    return sets


def _rare_groups(texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """(token, length, node, root, chars, short): groups in which every two alike texts meet, one of them ``short``.

    The tokens of a text stand in one order of all tokens, rare ones first. Two texts of a <= b tokens are alike if they share
    ``need`` = least / (1 + least) * (a + b) of them, so the first one that they share has at most a - need tokens before it in the one
    and b - need in the other. Tokens that only one text has come first and are never sent anywhere. A text
    takes the role of the shorter one in the group of its own class of lengths, that of the longer one in all classes from ``least`` of its length up.
    """
    sets = materialise(texts.select("node", "text").mapInArrow(_sets(shingle), "node long, tokens array<long>"))
    each = sets.select("node", F.explode("tokens").alias("token"))
    shared = materialise(grouped(each, ["token"], held=F.count("*")).where("held > 1"))
    ranked = each.join(shared, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("held", "token"))).alias("found"))
    ranked = ranked.join(sets.select("node", F.size("tokens").alias("n")), "node").join(texts.select("node", "root", "chars"), "node")
    own = ["node", "root", "chars", "n"]
    ranked = ranked.select(*own, (F.col("n") - F.size("found")).alias("alone"), F.posexplode("found").alias("at", "found"))
    ranked = ranked.select(*own, (F.col("alone") + F.col("at")).alias("at"), "found.token")

    def need(a, b):
        return F.ceil(least / (1 + least) * (a + b) - 1e-6)

    def length(n):
        return F.floor(F.log(n.cast("double")) / float(np.log(LENGTHS))).cast("int")

    n, at = F.col("n"), F.col("at")
    low = F.greatest(F.lit(1), F.floor(n * least - 1e-6))
    reach = ranked.where(at <= n - need(low, n)).withColumn("length", F.explode(F.sequence(length(low), length(n))))
    shortest = F.greatest(low, F.floor(F.pow(F.lit(LENGTHS), F.col("length"))))
    short = (F.col("length") == length(n)) & (at <= n - need(n, n))
    return reach.where(at <= n - need(shortest, n)).select("token", "length", "node", "root", "chars", short.alias("short"))


def _side(n, chars):
    """Blocks that ``n`` texts of so many characters make."""
    block = F.least(F.lit(BLOCK[1]), F.greatest(F.lit(BLOCK[0]), 5 * F.sqrt(n)))
    return F.greatest(F.ceil(F.greatest(n / block, chars / BLOCK_CHARS)).cast("int"), F.lit(1))


def _mark():
    """A fingerprint of the members of a group."""
    return F.bit_xor(F.xxhash64("node", "short"))


def _compared(met: DataFrame, keys: list[str], roots: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """``roots`` after the texts of each group of ``met`` (node, block and keys) are compared across its blocks, or within its only one."""
    met = met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(texts.select("node", "text"), "node")
    links = met.select(*keys, "root", "block", "text").groupBy(*keys).applyInArrow(_links(shingle, least), "a long, b long")
    return _joined(roots, materialise(links))


def _join_rare(groups: DataFrame, roots: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """``roots`` after the short texts of each of the ``groups`` are compared with its others.

    Small groups are listed by pairs, each pair once; larger ones where several classes are left are compared by blocks.
    """
    key = ["token", "length"]

    def several(placed: DataFrame, wanted) -> DataFrame:
        chars, shorts = F.sum("chars"), F.sum(F.col("short").cast("long"))
        found = grouped(placed, key, n=F.count("*"), shorts=shorts, chars=chars, low=F.min("root"), high=F.max("root"), mark=_mark())
        found = found.where((F.col("low") < F.col("high")) & (F.col("shorts") > 0) & wanted)
        first = F.min(F.struct(*key, "chars"))
        return materialise(grouped(found, ["mark", "n", "shorts"], first=first).select("first.*", "n", "shorts"))

    small = groups.join(several(groups, F.col("n") <= FEW).select(*key), key)
    left, right = small.where("short").select(*key, F.col("node").alias("x")), small.select(*key, F.col("node").alias("y"))
    pairs = left.join(right, key).where("x != y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    for side in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left")
    apart = F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
    roots = _joined(roots, _checked(materialise(pairs.where(apart).select("a", "b")), texts, shingle, least))

    large = several(groups, F.col("n") > FEW)
    if large.isEmpty():
        return roots
    groups = groups.join(large.select(*key), key).drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = materialise(groups)
    large = several(groups, F.lit(True))
    mean = F.col("chars") / F.col("n")
    large = large.select(*key, _side(F.col("shorts"), F.col("shorts") * mean).alias("lefts"), _side(F.col("n"), F.col("chars")).alias("rights"))
    member = groups.drop("root", "chars").join(large, key)
    part = F.xxhash64("node")
    left = member.where("short").withColumn("u", F.pmod(part, "lefts").cast("int")).withColumn("v", F.explode(F.sequence(F.lit(0), F.col("rights") - 1)))
    right = member.withColumn("v", F.pmod(part, "rights").cast("int")).withColumn("u", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)))
    both = left.withColumn("block", F.lit(0)).unionByName(right.withColumn("block", F.lit(1)))
    return _compared(both.select(*key, "u", "v", "node", "block"), [*key, "u", "v"], roots, texts, shingle, least)


def _join_classes(members: DataFrame, roots: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """``roots`` after all texts of different classes that share a bucket of ``members`` (node, bucket) are compared.

    Buckets with equal members count once. What fits one block is compared in one group, whose pairs do not become rows. The texts of
    larger buckets meet by rare tokens (``_rare_groups``); only where that leaves more pairs than the buckets have, in every two
    blocks of a bucket. All ways find the same links.
    """
    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(texts.select("node", "chars"), "node")
    placed = materialise(placed.withColumn("short", F.lit(True)))
    several = grouped(placed, ["bucket"], n=F.count("*"), chars=F.sum("chars"), low=F.min("root"), high=F.max("root"), mark=_mark())
    several = several.where(F.col("low") < F.col("high"))
    several = grouped(several, ["mark", "n"], first=F.min(F.struct("bucket", "chars"))).select("first.*", "n")
    several = several.select("bucket", "n", _side(F.col("n"), F.col("chars")).alias("blocks"))
    crowd = placed.join(several, "bucket").select("bucket", "n", "node", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), "blocks")
    crowd = materialise(crowd)
    roots = _compared(crowd.where("blocks = 1"), ["bucket"], roots, texts, shingle, least)
    crowd = crowd.where("blocks > 1")
    if crowd.isEmpty():
        return roots
    crowded = texts.join(crowd.select("node").distinct(), "node", "left_semi").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = materialise(_rare_groups(crowded, shingle, least))
    by_group = groups.groupBy("token", "length").agg((F.count("*") * F.sum(F.col("short").cast("double"))).alias("pairs")).agg(F.sum("pairs")).first()[0]
    by_bucket = crowd.agg(F.sum(F.col("n").cast("double"))).first()[0]
    if (by_group or 0) <= by_bucket:
        return _join_rare(groups, roots, texts, shingle, least)
    met = crowd.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("bucket", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("last"), "node", "block")
    return _compared(met, ["bucket", "first", "last"], roots, texts, shingle, least)


def near_duplicates(
    docs: DataFrame, least: float = 0.8, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, text_hash, class_id, class_size, leader) of each document.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z is lower-cased. Documents are linked if
    the weighted Jaccard similarity of their shingles is ``least`` or more; a class is what links join,
    and its id the smallest document id in it. A pair of similarity s meets in a bucket with
    probability 1 - (1 - s ** rows) ** bands, at 0.8 over 0.999.

    Equal texts are linked without comparison and only one of them goes on. In a bucket every text is
    compared with the first one, then with the two that a fixed order of all texts puts lowest and
    highest, unless a class joins them already. Where several classes are left beside these three, all
    pairs of different classes are compared, so no pair that shares a bucket is passed over: in one
    group where a bucket is small, by rare shingles where it is large.
    ``leader`` marks one row of each class, one with the class's id.

    One row for each row of ``docs``. Null texts are classes of their own, empty texts are equal to
    each other. Null ids sort last; a class without ids has a null id. Further columns are ignored.
    """
    keys = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.xxhash64(F.lit("text"), text_col).alias("h2"),
        F.col(text_col).isNull().alias("blank"), F.col(text_col).alias("text"),
    )
    kind = keys.schema["doc_id"].dataType.simpleString()
    sketched = keys.mapInArrow(_sketch(shingle, bands, rows), f"doc_id {kind}, text_hash long, h2 long, blank boolean, buckets array<long>")
    table = materialise(sketched.withColumn("row", F.monotonically_increasing_id()))
    table = table.withColumn("h2", F.when(F.col("blank"), F.col("row")).otherwise(F.col("h2")))
    first = materialise(grouped(table, ["text_hash", "h2"], node=F.min("row")))
    nodes = table.join(first.select(F.col("node").alias("row")), "row", "left_semi")
    members = materialise(nodes.select(F.col("row").alias("node"), F.explode("buckets").alias("bucket")))

    order = F.xxhash64("node")
    shared = materialise(
        grouped(
            members, ["bucket"], n=F.count("*"), low=F.min("node"), second=F.min_by("node", order), third=F.max_by("node", order)
        ).where(F.col("n") > 1).drop("n")
    )
    proposed = materialise(members.join(shared, "bucket").select("node", "bucket", "low", "second", "third"))
    involved = proposed.select("node").distinct()
    named = involved.join(table.select(F.col("row").alias("node"), "doc_id", "text_hash"), "node")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("hash", F.xxhash64("text"))
    same = texts["doc_id"].eqNullSafe(named["doc_id"]) & (texts["hash"] == named["text_hash"])
    texts = materialise(texts.join(named, same).select("node", "text", F.length("text").alias("chars")).dropDuplicates(["node"]))

    tried = proposed.where(F.col("node") != F.col("low")).select(F.col("node").alias("a"), F.col("low").alias("b"))
    tried = materialise(tried.distinct())
    roots = components(_checked(tried, texts, shingle, least))
    other = proposed.select(F.col("node").alias("a"), F.explode(F.array("second", "third")).alias("b")).where(F.col("a") != F.col("b"))
    other = other.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct()
    for side in ("a", "b"):
        other = other.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left")
    apart = F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
    other = materialise(other.where(apart).select("a", "b").join(tried, ["a", "b"], "left_anti"))
    roots = _joined(roots, _checked(other, texts, shingle, least))
    rest = ~F.col("node").isin(F.col("low"), F.col("second"), F.col("third"))
    roots = _join_classes(proposed.where(rest).select("node", "bucket"), roots, texts, shingle, least)

    placed = (
        table.select("row", "doc_id", "text_hash", "h2")
        .join(first, ["text_hash", "h2"])
        .join(roots, "node", "left")
        .select("row", "doc_id", "text_hash", F.coalesce("root", "node").alias("root"))
    )
    placed = materialise(placed)
    best = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))
    classes = grouped(placed, ["root"], best=F.min(best), class_size=F.count("*"))
    return placed.join(classes, "root").select(
        "doc_id", "text_hash", F.col("best.doc_id").alias("class_id"), "class_size", (F.col("best.row") == F.col("row")).alias("leader")
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each class, all columns: the one with the smallest id. Equal rows count once."""
    leaders = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).where("leader")
    leaders = leaders.select(F.col("doc_id").alias("_id"), F.coalesce("text_hash", F.lit(0)).alias("_hash"))
    keys = boxed(docs, id=F.col(id_col), hash=F.coalesce(F.xxhash64(text_col), F.lit(0)))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))
    return keys.join(leaders, same, "left_semi").dropDuplicates(["id", "hash"]).select("doc.*")

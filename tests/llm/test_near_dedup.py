import random
from collections import Counter

import pyarrow as pa
from helpers import alnum_words, frame, thue_morse
from pyspark.sql import functions as F

from panelwright.llm import near_dedup
from panelwright.llm.graph import components
from panelwright.llm.near_dedup import _sketch, drop_near_duplicates, near_duplicates


def shingles(text):
    w = alnum_words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def classes(rows):
    """Class ids by comparing all pairs."""
    parent = {k: k for k in range(len(rows))}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    sets = [shingles(r[1]) for r in rows]
    for a in range(len(rows)):
        for b in range(a):
            inter, size = sum((sets[a] & sets[b]).values()), sum((sets[a] | sets[b]).values())
            if (size and inter / size >= 0.8) or (rows[a][1] is not None and rows[a][1] == rows[b][1]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[root(k)] = min(r[0], least.get(root(k), r[0]))
    return [(r[0], least.get(root(k))) for k, r in enumerate(rows)]


def groups(links):
    out = []
    for a, b in links:
        mine = {a, b}.union(*(g for g in out if a in g or b in g))
        out = [g for g in out if not g & mine] + [mine]
    return out


def sample():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 300))]
        for _ in range(rng.randrange(1, 8)):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 5, 9])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy).title() if rng.random() < 0.3 else " ".join(copy), "s", "en"))
    rng.shuffle(rows)
    long = " ".join(f"v{i % 997}x{i % 13}" for i in range(60_000))
    return rows + [(900, None, "s", "en"), (901, None, "s", "en"), (902, "", "s", "en"), (903, "", "s", "en"), (904, "one two", None, None), (905, "One, two!", "s", "en"), (5, rows[5][1], "s", "en"), (None, rows[7][1], "s", "en"), (906, long, "s", "en"), (907, long + " end", "s", "en"), (908, "... !!!", "s", "en")]


def test_against_all_pairs(spark):
    rows = sample()
    got = near_duplicates(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == sorted(classes(rows), key=str)
    sizes = Counter(r.class_id for r in got)
    assert all(r.class_size == sizes[r.class_id] for r in got if r.class_id is not None)
    assert sum(r.leader for r in got) == len({r.class_id for r in got})


def test_one_of_each_class_stays(spark):
    rows = sample()
    kept = [r.doc_id for r in drop_near_duplicates(frame(spark, rows)).collect()]
    assert sorted(kept) == sorted({c for _, c in classes(rows)})


def test_large_group_of_near_copies(spark):
    rng = random.Random(11)
    base = [f"u{rng.randrange(5000)}" for _ in range(300)]
    rows = []
    for k in range(400):
        copy = list(base)
        copy[rng.randrange(300)] = f"edit{k}"
        rows.append((k, " ".join(copy), "s", "en"))
    got = near_duplicates(frame(spark, rows)).collect()
    assert {r.class_id for r in got} == {0}


def test_loosely_alike_group_and_repeated_rows(spark):
    """Of a large group whose pairs lie around 0.8, all but a few linked pairs come out in one class; rows that repeat cost no squares."""
    rng = random.Random(12)
    base = [f"u{rng.randrange(5000)}" for _ in range(200)]
    rows = []
    for k in range(250):
        copy = list(base)
        for at in rng.sample(range(200), rng.randrange(1, 7)):
            copy[at] = f"edit{k}x{at}"
        rows.append((k, " ".join(copy), "s", "en"))
    sets = [shingles(r[1]) for r in rows]
    alike = [(a, b) for a in range(250) for b in range(a) if sum((sets[a] & sets[b]).values()) >= 0.8 * sum((sets[a] | sets[b]).values())]
    rows += [rows[3]] * 3000 + [rows[4]] * 3000
    got = {r.doc_id: r.class_id for r in near_duplicates(frame(spark, rows)).collect()}
    together = sum(got[a] == got[b] for a, b in alike)
    assert len(alike) > 3000 and together >= 0.999 * len(alike)
    expected = [(r[0], min(g)) for g in groups(alike) for r in rows[:250] if r[0] in g]
    assert sum(got[d] == c for d, c in expected) >= 0.99 * len(expected)


def test_recall_at_the_threshold(spark):
    """Pairs just above 0.8, each by itself: at least 99 of 100 are found."""
    rows = []
    for k in range(300):
        words = [f"p{k}x{i}" for i in range(104)]
        other = words[:46] + [f"q{k}"] + words[47:98] + [f"r{k}"] + words[99:]
        rows += [(2 * k, " ".join(words), "s", "en"), (2 * k + 1, " ".join(other), "s", "en")]
    a, b = shingles(rows[0][1]), shingles(rows[1][1])
    assert 0.8 <= sum((a & b).values()) / sum((a | b).values()) < 0.83
    got = {r.doc_id: r.class_id for r in near_duplicates(frame(spark, rows)).collect()}
    assert sum(got[2 * k] == got[2 * k + 1] for k in range(300)) >= 297


def test_all_pairs_of_crowded_buckets(spark):
    """Pairs of alike texts among many that are loosely alike: all that share the one bucket are found."""
    core, rows = [f"c{i}" for i in range(100)], []
    for k in range(60):
        own = [f"p{k}x{i}" for i in range(40)]
        rows += [(2 * k, " ".join(core + own), "s", "en"), (2 * k + 1, " ".join(core + own[:20] + ["other"] + own[21:]), "s", "en")]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["doc_id", "text"])
    bucket = {i: b[0] for part in _sketch(5, 1, 1)([batch]) for i, b in zip(*(c.to_pylist() for c in part.columns), strict=True)}
    met = [k for k in range(60) if bucket[2 * k] == bucket[2 * k + 1]]
    assert len(met) > 40 and max(Counter(bucket.values()).values()) > 40
    got = {r.doc_id: r.class_id for r in near_duplicates(frame(spark, rows), bands=1, rows=1).collect()}
    assert [k for k in range(60) if got[2 * k] == got[2 * k + 1]] == met and set(got.values()) >= {2 * k for k in range(60)}


def test_blocks_of_a_bucket_link_what_is_alike(monkeypatch):
    monkeypatch.setattr(near_dedup, "FEW", 2)
    texts = sample()[:60]
    table = pa.table({"root": pa.array(range(60)), "block": pa.array([0] * 60), "text": [r[1] for r in texts]})
    found = near_dedup._links(5, 0.8)(table)
    sets = [shingles(r[1]) for r in texts]
    alike = [(a, b) for a in range(60) for b in range(a) if sum((sets[a] & sets[b]).values()) >= 0.8 * sum((sets[a] | sets[b]).values())]
    top = lambda links: {n: min(g) for g in groups(links) for n in g}
    assert top(list(zip(*(c.to_pylist() for c in found.columns), strict=True))) == top(alike) and len(alike) > found.num_rows > 0


def loose(n, edits, seed=12, size=200):
    """Texts made of one by up to so many edits of their own."""
    rng = random.Random(seed)
    base = [f"u{rng.randrange(5000)}" for _ in range(size)]
    rows = []
    for k in range(n):
        copy = list(base)
        for at in rng.sample(range(size), rng.randrange(1, edits)):
            copy[at] = f"edit{k}x{at}"
        rows.append((k, " ".join(copy[: rng.randrange(size * 9 // 10, size + 1)]), "s", "en"))
    return rows


def alike_pairs(rows):
    sets = [shingles(r[1]) for r in rows]
    return [(a, b) for a in range(len(rows)) for b in range(a) if sum((sets[a] & sets[b]).values()) >= 0.8 * sum((sets[a] | sets[b]).values())]


def test_every_alike_pair_meets_by_a_rare_token(spark):
    rows = [(k, *r[1:]) for k, r in enumerate([r for r in sample()[:60] if r[1]] + loose(120, 7) + [(0, "a b a b " * 60, "s", "en"), (0, "a b a b " * 66, "s", "en")])]
    texts = spark.createDataFrame([(r[0], r[1], r[0], len(r[1])) for r in rows], "node long, text string, root long, chars int")
    met = {}
    for r in near_dedup._rare_groups(texts, 5, 0.8).collect():
        met.setdefault((r.token, r.length), []).append((r.node, r.short))
    pairs = {(max(x, y), min(x, y)) for g in met.values() for x, s in g if s for y, _ in g}
    alike = [p for p in alike_pairs(rows) if rows[p[0]][1] != rows[p[1]][1]]
    assert len(alike) > 300 and set(alike) <= pairs
    assert len(pairs) < len(rows) * (len(rows) - 1) / 2


def families(n):
    """Families of one to six near copies; any two families share more than half of their words."""
    rng, rows = random.Random(21), []
    base = [f"u{rng.randrange(5000)}" for _ in range(200)]
    for k in range(n):
        mine = list(base)
        for at in range(k % 13, 200, 13):
            mine[at] = f"own{k}x{at}"
        for i in range(rng.randrange(1, 7)):
            copy = list(mine)
            copy[rng.randrange(200)] = f"edit{k}x{i}"
            rows.append((len(rows), " ".join(copy), "s", "en"))
    return rows


def test_large_buckets_link_what_is_alike(spark, monkeypatch):
    """Buckets of many blocks: by rare tokens, in pairs or in blocks, and by blocks of the bucket, the classes are those of all pairs."""
    monkeypatch.setattr(near_dedup, "BLOCK", (4, 8))
    ways, real = [], near_dedup._join_rare
    monkeypatch.setattr(near_dedup, "_join_rare", lambda *a: ways.append("rare") or real(*a))
    for rows, few, expected in ((families(40), 16, ["rare"]), (families(40), 3, ["rare"]), (loose(160, 8), 16, [])):
        top = {n: min(g) for g in groups(alike_pairs(rows)) for n in g}
        monkeypatch.setattr(near_dedup, "FEW", few)
        texts = spark.createDataFrame([(r[0], r[1], len(r[1])) for r in rows], "node long, text string, chars int")
        members = texts.select("node", F.lit(1).cast("long").alias("bucket"))
        none = spark.createDataFrame([], "node long, root long")
        ways.clear()
        got = {r.node: r.root for r in near_dedup._join_classes(members, none, texts, 5, 0.8).collect()}
        assert {k: got.get(k, k) for k in range(len(rows))} == {k: top.get(k, k) for k in range(len(rows))}
        assert ways == expected and len(top) > 50


def test_words_of_one_form_are_told_apart():
    texts = [" ".join([word] * 5) for word in thue_morse(11)]
    assert near_dedup.similarity(pa.array(texts), pa.array(texts[::-1]), 5).tolist() == [0.0, 0.0]
    assert near_dedup.similarity(pa.array(texts), pa.array(texts), 5).tolist() == [1.0, 1.0]


def test_empty(spark):
    assert near_duplicates(frame(spark, [])).collect() == [] and drop_near_duplicates(frame(spark, [])).collect() == []


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (1, 0), (500, 499)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, **{k: 100 for k in range(101, 140)}, 500: 499}

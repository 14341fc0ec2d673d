import random

import pytest
from helpers import alnum_words, frame

from panelwright.llm.decontamination import decontaminate, drop_contaminated


def plain(docs, items):
    wins = {}
    for item, text in items:
        w = alnum_words(text)
        n = min(13, len(w))
        for i in range(max(0, len(w) - 12) if len(w) >= 13 else bool(w)):
            wins.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for r in docs:
        w, hit, names = alnum_words(r[1]), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in wins:
                    hit |= set(range(i, i + n))
                    names |= {str(k) for k in wins[x] if k is not None}
        out.append((r[0], len(w), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["a", "b", "Cé", "d"]
    items = [(k, " ".join(rng.choice(words) + ("x" * (k % 3)) for _ in range(rng.choice([1, 2, 5, 12, 13, 14, 30, 60])))) for k in range(40)]
    items += [(40, None), (41, ""), (42, "..."), (None, "zed " * 20), (3, "another three " * 8)]
    docs = []
    for k in range(120):
        text = " ".join(rng.choice([*words, "noise", "other"]) for _ in range(rng.randrange(0, 60)))
        for _ in range(rng.randrange(0, 3)):
            source = alnum_words(rng.choice(items)[1])
            a, b = sorted((rng.randrange(len(source) + 1), rng.randrange(len(source) + 1)))
            text += f"! {rng.choice(['', 'pad '])}" + ", ".join(source[a:b]).upper() + "."
        docs.append((k, text, "s", "en"))
    docs += [(200, None, "s", "en"), (None, "zed " * 300, None, None), (5, docs[5][1], "s", "en"), (201, ("w " * 50_000) + items[20][1], "s", "en")]
    benchmark = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, window string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in decontaminate(frame(spark, docs), benchmark).collect()), key=str)
    assert got == plain(docs, items)


def test_drop_and_empty_tables(spark):
    passage = " ".join(f"t{i}" for i in range(15))
    docs = frame(spark, [(1, f"intro {passage} end", "s", "en"), (2, "clean words only", "s", "en"), (3, None, "s", "en"), (4, passage + " pad" * 400, "s", "en")])
    items = spark.createDataFrame([(7, passage)], "item_id long, text string")
    assert sorted(r.doc_id for r in drop_contaminated(docs, items).collect()) == [2, 3, 4]
    assert drop_contaminated(docs, items.limit(0)).count() == 4
    assert decontaminate(docs.limit(0), items).collect() == []

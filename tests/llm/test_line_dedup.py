import random
from collections import defaultdict

from helpers import TO_LOWER, frame

from panelwright.llm.line_dedup import dedup_lines


def plain(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(TO_LOWER)
    holders = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            holders[key(line)].add(r[0])
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        first = lambda k: min((i for i in holders[k] if i is not None), default=None)
        kept = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < 2 or r[0] == first(key(x))]
        out.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(2)
    lines = ["a line of some length", "\tA LINE of some length ", "short", "", "ÀÉ line with accents", "àé line with accents", "\x0bodd blanks here\x0c", " wide blank line "]
    rows = [(k, "\n".join(rng.choice([*lines, f"only in {k} here"]) for _ in range(rng.randrange(0, 9))), "s", "en") for k in range(60)]
    rows += [(70, None, None, None), (71, "", "s", "en"), (3, rows[3][1], "s", "en"), (3, "a line of some length", "s", "en"), (None, "a line of some length\nnull only line", "s", "en"), (None, "null only line", "s", "en")]
    rows += [(72, "\n".join(f"line number {i}" for i in range(20_000)), "s", "en"), (73, "line number 7\nx", "s", "en")]
    docs = frame(spark, rows, "first long, pos int, key string, drops string")
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in dedup_lines(docs).collect()), key=str)
    assert got == plain(rows)
    assert dedup_lines(docs.limit(0)).collect() == []

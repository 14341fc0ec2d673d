"""Links between two tokenizers against the libraries and plain loops."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelwright.llm import alignment, pieces
from panelwright.llm.queries import op11_token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
ONE, TWO = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
ONE.encode_special_tokens = True
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE = {chr(b): b for b in SHOWN} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in SHOWN)}
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def ends(sizes):
    return np.cumsum(sizes).tolist()


def plain_tokens(text):
    """(ids, ends in bytes) of both tokenizers; nothing where the bytes differ."""
    if not text:
        return ([], []), ([], [])
    e = ONE.encode(" " + text, add_special_tokens=False)
    one = [bytes(BYTE[c] for c in t) for t in e.tokens]
    ids = TWO.encode(text)
    names = [TWO.id_to_piece(i) for i in ids]
    two = [bytes([int(p[3:5], 16)]) if TWO.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, names, strict=True)]
    if b"".join(one) != (" " + text).encode() or b"".join(two) != (" " + text).encode():
        return ([], []), ([], [])
    return (e.ids, ends([len(t) for t in one])), (ids, ends([len(t) for t in two]))


def plain_groups(text):
    (ia, ea), (ib, eb) = plain_tokens(text)
    out, x, y = [], 0, 0
    for cut in sorted(set(ea) & set(eb)):
        na, nb = ea.index(cut, x) + 1, eb.index(cut, y) + 1
        out.append((ia[x:na], ib[y:nb]))
        x, y = na, nb
    return out


def plain(rows):
    """The contract's columns by loops over all links."""
    held, links = defaultdict(int), []
    for _, text in rows:
        found = Counter((a, b) for g in plain_groups(text) for a in g[0] for b in g[1])
        links.append(found)
        for pair in found:
            held[pair] += 1
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    out = []
    for (doc, text), found in zip(rows, links, strict=True):
        groups = plain_groups(text)
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        sha = hashlib.sha256(shown.encode()).hexdigest() if groups else ""
        best = sum(n for p, n in found.items() if held[p] == most[p[0]])
        counts = sum(n * held[p] for p, n in found.items())
        out.append((doc, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(found.values()), best, counts, sha))
    return out


def key(row):
    return tuple((v is None, v) for v in row)


ROWS = [
    (1, "A plain text, and a 2nd one."), (2, None), (3, ""), (None, "null id"), (5, "a▁b"), (6, "<|endoftext|> <s> 中文 😀 naïve\r\n\tx   y"),
    (7, "aa bb aa bb"), (7, "aa bb aa bb"), (8, "x" * 900 + " 0000000 " + "=" * 300), (9, " "), (10, "\0\x7f ²½"), (11, "aa bb"),
]


@pytest.mark.parametrize(("sent", "chunk"), [(1 << 20, 1 << 18), (7, 3), (0, 2)])
def test_whole_operator(spark, sent, chunk):
    docs = spark.createDataFrame([(*r, "x", 0) for r in ROWS], "doc_id long, text string, row string, n_a int")
    found = alignment.align(docs, A, B, sent=sent, chunk=chunk)
    assert found.columns[:7] == COLUMNS[:7]
    assert sorted((tuple(r) for r in found.select(*COLUMNS).collect()), key=key) == sorted(plain(ROWS), key=key)


def test_no_documents(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r) for r in alignment.align(docs, A, B).select(*COLUMNS).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]
    assert alignment.align(docs.where(F.lit(False)), A, B).count() == 0


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    assert sorted(tuple(r) for r in op11_token_alignment(spark, SF).select(*COLUMNS).collect()) == sorted(plain(rows))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40) | st.text("aeinrsthl AB01./\n_='t", max_size=60))
def test_tokens_are_the_librarys(text):
    one, two = alignment.byte_tokens(pieces.read_model(A)), pieces.pieces(pieces.read_model(B))
    a, b = alignment.tokens([text], one, two)
    (ia, ea), (ib, eb) = plain_tokens(text)
    assert (a.ids.tolist(), np.cumsum(a.sizes).tolist(), b.ids.tolist(), np.cumsum(b.sizes).tolist()) == (ia, ea, ib, eb)


@settings(max_examples=100, deadline=None)
@given(st.data())
def test_row_products(data):
    n, k, m = (data.draw(st.integers(1, 6)) for _ in range(3))
    entries = lambda r, c: data.draw(st.lists(st.tuples(st.integers(0, r - 1), st.integers(0, c - 1)), max_size=20))
    x, y = entries(n, k), entries(k, m)
    full = [np.zeros(s, np.int64) for s in ((n, k), (k, m))]
    rows = []
    for pairs, (r, c), dense in ((x, (n, k), full[0]), (y, (k, m), full[1])):
        for p in pairs:
            dense[p] += 1
        at = np.array(pairs, np.int64).reshape(-1, 2)
        rows.append(alignment.Rows.of(at[:, 0], at[:, 1], r, c))
    out = np.zeros((n, m), np.int64)
    for r, c, v in rows[0].times(rows[1], limit=data.draw(st.integers(1, 30))):
        assert (out[r, c] == 0).all()
        out[r, c] = v
    assert (out == full[0] @ full[1]).all()
    twice = rows[0].transposed().transposed()
    assert twice.at.tolist() == rows[0].at.tolist() and twice.cols.tolist() == rows[0].cols.tolist()


def test_overlaps(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    for (_, text), row in zip(ROWS, alignment.token_overlaps(docs, A, B).collect(), strict=True):
        (_, ea), (_, eb) = plain_tokens(text)
        want = [
            (i, j, min(x, y) - max(ea[i - 1] if i else 0, eb[j - 1] if j else 0))
            for i, x in enumerate(ea) for j, y in enumerate(eb) if min(x, y) > max(ea[i - 1] if i else 0, eb[j - 1] if j else 0)
        ]
        assert [tuple(x) for x in row.links] == want


def test_a_group_of_a_long_text_is_no_square():
    """One group of 40,000 tokens on both sides: its ids are multiplied, not its tokens."""
    n = 40_000
    ids = np.arange(n) % 50
    a = alignment.Tokens(ids, np.full(n, 2), np.zeros(n, np.int64))
    sizes = np.full(n + 1, 2)
    sizes[[0, -1]] = 1
    b = alignment.Tokens(np.arange(n + 1) % 70, sizes, np.zeros(n + 1, np.int64))
    of_a, of_b = alignment.groups(a, b)
    assert of_a.max() == of_b.max() == 0
    found = [x for part in alignment.id_links(a, b, of_a, of_b) for x in part[2].tolist()]
    assert len(found) == 50 * 70 and sum(found) == n * (n + 1)

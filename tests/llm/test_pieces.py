"""SentencePiece encoding and decoding against the library itself."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelwright.llm import pieces
from panelwright.llm.queries import op13_sentencepiece

PATH = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)
MODEL = pieces.Pieces(pieces.read_model(PATH))
PARTS = [" ", "  ", "\t", "\n", "\r\n", "a", "the", "ing", "I", "1", "23", "é", "ß", "²", "².", "中", "文", "😀", "▁", "\0", "<s>", "<0x41>", "//", "==", "　", "é"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=30).map("".join) | st.text(max_size=40) | st.text("aeinrsthl AB01./\n_=", max_size=60))
def test_encode_and_decode_are_the_librarys(text):
    ids = SP.encode(text)
    assert list(MODEL.encode(text)) == ids
    assert MODEL.decode(np.array(ids, np.int64)) == SP.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(sorted(MODEL.byte_ids.values())) | st.integers(0, 31999) | st.just(259), max_size=12))
def test_any_ids_decode_as_in_the_library(ids):
    assert MODEL.decode(np.array(ids, np.int64)) == SP.decode(ids)


def test_pairs_stay_apart_as_in_merging():
    rnd, names = random.Random(3), list(MODEL.ids)
    for _ in range(3000):
        a, b = rnd.choice(names), rnd.choice(names)
        assert MODEL.apart.test(a, b) == (MODEL.merged(a + b) == [a, b]), (a, b)


def test_no_piece_goes_beyond_a_cut():
    assert all(MODEL.cuts.findall(p) == [p] for p in MODEL.ids)
    assert all("".join(MODEL.cuts.findall(t)) == t for t in ("▁a1b_c²d▁▁2\n", "\0▁", "▁ \t.x"))


@pytest.mark.parametrize("mixed", [["a▁b", "▁a"], ["a1", "▁a"], ["ab", "1", "▁."]])
def test_cuts_follow_the_pieces(mixed):
    found = pieces.cuts(mixed)
    assert all(found.findall(p) == [p] for p in mixed)
    assert "".join(found.findall("▁a▁b1.a1")) == "▁a▁b1.a1"


@pytest.mark.parametrize("text", ["a" * 200_000, " " * 100_000, "ab1" * 70_000, "word and " * 300_000, "\n" * 50_000])
def test_long_texts(text):
    assert list(MODEL.encode(text)) == SP.encode(text)


def test_parts_of_a_long_text(monkeypatch):
    text = " ".join(f"wort {k} 中文, and" for k in range(500))
    monkeypatch.setattr(pieces, "PART", 50)
    assert list(MODEL.encode(text)) == SP.encode(text)


def test_full_tables_of_kept_cuts_start_anew(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT", 5)
    monkeypatch.setattr(pieces, "KEPT_PAIRS", 5)
    text = "several words that are more than five, and several words again"
    assert list(pieces.Pieces(pieces.read_model(PATH)).encode(text)) == SP.encode(text)


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (2, "a b", "x"), (2, "a b", "x"), (3, "<s>▁ end", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = pieces.decode(pieces.encode(docs, PATH), PATH)
    assert found.columns == ["doc_id", "ids", "decoded"]
    want = sorted((d or 0, SP.encode(t or ""), SP.decode(SP.encode(t or ""))) for d, t, _ in rows)
    assert sorted((r.doc_id or 0, r.ids, r.decoded) for r in found.collect()) == want
    assert pieces.encode(docs.where(F.lit(False)), PATH).count() == 0
    nulls = pieces.decode(spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>"), PATH).collect()
    assert [(r.k, r.decoded) for r in sorted(nulls)] == [(1, None), (2, "")]


def test_a_model_without_byte_pieces_is_refused():
    with pytest.raises(Exception):
        pieces.Pieces(b"")


def test_query(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for r in pq.read_table(f"{SF}/documents.parquet").to_pylist():
        ids = SP.encode(r["text"] or "")
        want.add((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(SP.decode(ids))))
    assert {tuple(r) for r in op13_sentencepiece(spark, SF).collect()} == want

import hashlib
import random
from collections import Counter

import pytest
from helpers import thue_morse

from panelwright.llm.queries import op9_substring_dedup
from panelwright.llm.substring_dedup import dedup_substrings


def plain(texts, length):
    """The contract, written out, for (key, text) pairs."""
    data = [(t or "").encode() for _, t in texts]
    counts = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (key, _), d in zip(texts, data, strict=True):
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        spans = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((key, len(d), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize(("part", "bits"), [(8192, 24), (3, 7)])
def test_small_strings_against_brute_force(spark, part, bits, monkeypatch):
    """Groups sorted whole with filters, and in parts with semi-joins."""
    monkeypatch.setattr("panelwright.llm.substring_dedup.ANCHOR_BITS", bits)
    monkeypatch.setattr("panelwright.llm.substring_dedup.TEXT_BITS", bits)
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdé") for _ in range(60))
    texts = []
    for k in range(150):
        noise = ["".join(rng.choice("abé") for _ in range(rng.randrange(0, 40))) for _ in range(3)]
        a, b = sorted(rng.sample(range(61), 2))
        texts.append((k, rng.choice([noise[0] + passage[a:b] + noise[1], noise[0], passage + noise[2] + passage, "ab" * rng.randrange(0, 30), texts[-1][1] if texts else ""])))
    texts += [(150, None), (150, ""), (None, passage), (3, texts[3][1])]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, row string, spans int")
    assert got(dedup_substrings(docs, length=20, gram=6, part=part, batch_bytes=500)) == plain(texts, 20)
    assert got(dedup_substrings(docs.limit(0), length=20, gram=6)) == []


def test_repeated_rows_and_thue_morse_texts(spark):
    texts = [*((7, "one document, many rows. " * 20) for _ in range(3000)), *zip((8, 9), thue_morse(11), strict=True)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert got(dedup_substrings(docs, part=2)) == plain(texts, 200)
    assert got(dedup_substrings(docs)) == plain(texts, 200)


def test_query_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(op9_substring_dedup(spark, sf)) == plain(rows, 200)

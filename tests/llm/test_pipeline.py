import corpus_pipeline
import pytest
from test_decontamination import plain as contaminated
from test_near_dedup import classes

from test_quality import plain as rules

from panelwright.llm.mixing import mix


@pytest.fixture(scope="module")
def steps(spark, sf):
    """(documents before, rows after) of each stage, each run on the rows of the one before."""
    docs, found = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        rows = out.collect()
        assert name == "sharding" or out.columns == docs.columns
        found[name] = (docs, rows)
        docs = spark.createDataFrame(rows, out.schema)
    return found


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_quality_rules(steps):
    before, rows = steps["quality_rules"]
    judged = rules([(r.doc_id, r.text, r.source) for r in before.collect()], 0.02, 10, 1 / 3)
    assert ids(rows) == sorted(j[0] for j in judged if j[-1])


def test_near_dedup(steps):
    before, rows = steps["near_dedup"]
    assert ids(rows) == sorted({c for _, c in classes([(r.doc_id, r.text) for r in before.collect()])})


def test_decontamination(spark, sf, steps):
    before, rows = steps["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    judged = contaminated([(r.doc_id, r.text) for r in before.collect()], items)
    assert ids(rows) == sorted(j[0] for j in judged if not j[-1])


def test_mixing_and_sharding(steps):
    before, rows = steps["mixing"]
    assert ids(rows) == ids(r for r in mix(before).collect() if r.kept)
    assert ids(steps["sharding"][1]) == ids(rows)


def test_run_is_the_chain_of_the_stages(spark, sf, steps):
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, steps["sharding"][1]), key=str)


def test_empty_and_odd_documents(spark, tmp_path):
    """No rows give no rows; null ids, null texts, repeated rows, a very long text and further columns pass through."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, shard string, root long, _id int"
    words = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(k, words(k, 40 + k), "en", "a") for k in range(20)] + [(None, words(50, 60), None, None), (None, None, "en", "a"), (3, words(3, 43), "en", "a"), (3, words(3, 43), "en", "a"), (60, "", "de", "b"), (61, words(61, 60_000), "de", "b")]
    rows = [(*r, len(r[1] or ""), "s", 1, 2) for r in rows]
    for name, part in (("none", []), ("odd", rows)):
        folder = tmp_path / name
        spark.createDataFrame(part, kind).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([] if name == "none" else [("i1", words(5, 45)), (None, None)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, str(folder)).collect()
        found = [r.doc_id for r in got]
        assert len(found) == len(set(found)) and set(found) <= {r[0] for r in part} - {5, 60}
        assert bool(found) == bool(part)

"""The pipeline's stages against plain computations, each on its own input."""

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from loomgraph.llm import pieces, queries, secrets

from . import cases
from .test_operators import MODEL, plain_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """A folder of tables: good and bad documents, copies, a benchmark passage and a secret."""
    path = tmp_path_factory.mktemp("tables")
    item = cases.prose(7700, 30)
    good = {k: cases.prose(k, 60) for k in range(200)}
    bad = {k: " ".join(w.upper() + "!!" for w in cases.prose(k, 60).split()) for k in range(200, 280)}
    odd = {300: good[3] + " end", 301: good[4], 302: cases.prose(900, 30) + " " + item + " " + cases.prose(901, 30), 303: cases.prose(902, 50) + ' token = "24be64439e3e49cf46b2d7c90f3602a3"', 304: None, 305: ""}
    rows = [(i, t, "en", "s", None if t is None else len(t), "mine") for i, t in {**good, **bad, **odd}.items()] + [(None, cases.prose(950, 60), None, None, None, None), (5, good[5], "en", "s", 1, "mine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, matches string")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i in range(280)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs, str(path)


def ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=lambda k: (k is None, k or 0))


def test_quality_stage(spark, made):
    docs, path = made
    out = corpus_pipeline.by_quality(spark, docs, path)
    assert out.columns == docs.columns
    kept = set(ids(out))
    assert set(range(200)) <= kept and not kept & set(range(200, 280))


def test_near_copies_stage(spark, made):
    docs, path = made
    out = corpus_pipeline.one_of_each(spark, docs, path)
    groups = plain_components({r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None})
    assert out.columns == docs.columns
    assert ids(out) == [i for i, (_, root) in sorted(groups.items()) if i == root] + [None]


def test_decontamination_stage(spark, made):
    docs, path = made
    out = corpus_pipeline.decontaminated(spark, docs, path)
    assert out.columns == docs.columns and out.count() == docs.count() - 1 and 302 not in ids(out)
    assert {r["matches"] for r in out.collect()} == {"mine", None}


def test_secrets_stage(spark, made):
    docs, path = made
    out = {r["doc_id"]: r for r in corpus_pipeline.without_secrets(spark, docs, path).collect()}
    assert "[secret]" in out[303]["text"] and "24be64439e3e" not in out[303]["text"] and out[303]["n_chars"] == len(out[303]["text"])
    assert all(out[r["doc_id"]]["text"] == (r["text"] or "") for r in docs.collect() if not secrets.base_spans(r["text"] or ""))


def test_pieces_stage(spark, made):
    docs, path = made
    v = pieces.Vocabulary(MODEL)
    out = corpus_pipeline.coded(spark, docs, path).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(v.decode(np.frombuffer(r["ids"], "<i4").tolist()) == (texts[r["doc_id"]] or "") for r in out)


def test_run(spark, made):
    _, path = made
    out = corpus_pipeline.run(spark, path)
    kept = set(ids(out))
    assert 302 not in kept and 301 not in kept and not kept & set(range(200, 280)) and 303 in kept


def test_empty_tables(spark, made, tmp_path):
    docs, path = made
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_cover_whole_tables(spark):
    n, pages = pq.read_metadata(f"{SF}/documents.parquet").num_rows, pq.read_metadata(f"{SF}/pages.parquet").num_rows
    for name, f in queries.QUERIES.items():
        count = f(spark, SF).count()
        assert count == (pages if name.startswith("op1_") else n) or name.startswith(("op5_", "op11_", "op13_"))  # these give rows of matches, negatives and phrases

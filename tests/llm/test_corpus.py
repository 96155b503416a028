"""The pipeline against brute force, and the registered corpus queries against their SQL."""
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from insolvia.llm import bpe
from insolvia.llm.queries import ORACLES, QUERIES
from tools.compare import TABLES, rows_of

from test_dedup import components_by_brute_force
from test_texts import contamination_by_brute_force

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    cur = db.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cur.fetchall())


def test_every_query_is_registered():
    found = entry.queries()
    assert set(QUERIES) | {"pipeline"} <= set(found) and {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in QUERIES}
    assert set(ORACLES) <= set(entry.oracle_sql())


def test_language_query_never_shows_held_out_labels(spark, db):
    rows = QUERIES["op1_language_id"](spark, FOLDER).collect()
    truth = dict(db.execute("select doc_id, lang from documents").fetchall())
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and held and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.9 * len(held)


def test_pipeline_equals_brute_force(spark, tmp_path, db):
    """Exact copies, near copies and benchmark passages are taken out one after the other; the rest is encoded."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = [(10_000 + k, t, None, "src0", 0) for k, t in enumerate([None, "", " 12 34 ", "?!"])]  # no language
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = sorted((r.doc_id, r.text) for r in docs.collect())

    judged = corpus_pipeline.language_stage(spark, docs, str(tmp_path))
    assert judged.columns == docs.columns
    spoken = {r.doc_id for r in judged.collect()}
    assert not spoken & {r[0] for r in extra} and len(spoken) >= 0.95 * (len(rows) - len(extra))

    white = str.maketrans("", "", " \t\n\x0b\x0c\r")
    best = {}
    for i, t in rows:
        if i in spoken:
            key = t.translate(white)
            if key not in best or (-len(t), i) < (-len(best[key][1]), best[key][0]):
                best[key] = (i, t)
    rows = sorted(best.values())
    _, part = components_by_brute_force([t for _, t in rows], 5, 80)
    rows = [r for k, r in enumerate(rows) if part[k] == k]
    items = db.execute("select item_id, text from benchmark").fetchall()
    hits = contamination_by_brute_force([t for _, t in rows], items, 10)
    rows = [r for r, h in zip(rows, hits) if not h[1]]

    library = Tokenizer.from_file(bpe.default_vocabulary())
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(got) == [i for i, _ in rows]
    for i, t in rows:
        assert np.frombuffer(got[i].ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_stages_keep_the_columns_of_documents_and_take_empty_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == 0


def test_stages_take_awkward_rows(spark, awkward):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, awkward, FOLDER)
        assert out.count() <= awkward.count(), name

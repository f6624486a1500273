import os

import brute
import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from tastegrid.llm import queries

SMALL = os.environ.get("TASTEGRID_TESTDATA", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the small test tables")


def test_stages_against_brute_force(spark, make, corpus, tmp_path):
    rows = [(d, t) for d, t in corpus] + [(900 + d, t) for d, t in corpus[:20]]
    docs = make(rows)
    names, stages = zip(*corpus_pipeline.STAGES)
    assert len(names) == 5
    left = []
    for stage in stages[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        path = str(tmp_path / f"s{len(left)}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        left.append([(r.doc_id, r.text) for r in docs.collect()])
    good, exact, near, mixed = left
    assert {d for d, t in rows if brute.counts(t)[5]}.isdisjoint(d for d, _ in good)
    assert sorted(exact) == sorted((d, t) for d, t in good if brute.exact(good)[d][2])
    found = brute.near(exact)
    assert sorted(near) == sorted((d, t) for d, t in exact if found[d][1] == d)
    assert set(mixed) <= set(near)
    last = stages[4](spark, docs, str(tmp_path)).collect()
    assert len(last) == len(mixed)
    assert all(brute.sha(bytes(r.ids)) == r.ids_sha256 and len(r.ids) == 4 * r.n_tokens for r in last)


def test_pipeline_of_odd_and_no_rows(spark, make, odd, tmp_path):
    for rows in (odd, []):
        docs = make(rows)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        docs.collect()


def test_all_queries_are_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in names if x in queries.QUERIES}
    assert names["pipeline"] is corpus_pipeline.run
    assert set(queries.ORACLES) <= set(queries.QUERIES)


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name]).fetchdf()
    got = queries.QUERIES[name](spark, SMALL).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    key = [c for c in ("doc_id", "page_id", "copy") if c in columns]
    want, got = (x[columns].sort_values(key).reset_index(drop=True) for x in (want, got))
    assert len(want) == len(got)
    for c in columns:
        a, b = want[c], got[c]
        same = np.isclose(a, b) if a.dtype.kind == "f" else (a == b) | (a.isna() & b.isna())
        assert same.all(), c


@needs_data
def test_queries_without_sql(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]

    def rows(name, *columns):
        return {r.doc_id: tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, SMALL).collect()}

    assert rows("op5_simhash", "fingerprint", "component_id") == brute.near(docs)
    assert rows("op7_suffix_dedup", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.repeats(docs)
    counts = rows("op6_quality_rules", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert counts == {d: brute.counts(t) for d, t in docs}
    found = rows("op10_license_scan", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert found == {d: brute.licenses(t) for d, t in docs}
    assert len(rows("op3_quality_classifier", "score")) == len(docs)
    assert corpus_pipeline.run(spark, SMALL).count() > 0

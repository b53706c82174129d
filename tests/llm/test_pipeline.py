from __future__ import annotations

import os

import public_tokenizers
import pytest
from conftest import prose
from test_dedup import LOWER, near_brute

import corpus_pipeline
from rollbook.llm.quality import quality_stage
from rollbook.llm.registry import ORACLES, QUERIES
from rollbook.llm.sp_sampling import decode_ids

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages_against_brute_force(spark, frame, tmp_path):
    item = prose(777, 40)
    rows = [(i, prose(i, 150) if i % 5 else "!!! ".join(w.upper() + "###" for w in prose(i, 60).split()), "en", f"src{i % 3}") for i in range(120)]
    rows += [(500 + i, prose(i + 1, 150).upper(), "en", "src1") for i in range(0, 8, 5)] + [(600 + i, prose(i + 2, 150) + " more", "en", "src2") for i in range(0, 8, 5)]
    rows += [(700, prose(300, 80) + " " + item + " " + prose(301, 80), "en", "src0"), (701, prose(1, 150), "en", "src0")]
    docs = frame(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(100)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    good = {r.doc_id for r in quality_stage(spark, docs, str(tmp_path)).collect()}
    assert all(i % 5 for i in good if i < 120)
    kept = [(i, t) for i, t, *_ in rows if i in good]
    last: dict[str, int] = {}
    for i, t in kept:
        last[t.translate(LOWER)] = max(i, last.get(t.translate(LOWER), -1))
    kept = [(i, t) for i, t in kept if last[t.translate(LOWER)] == i]
    roots = {min(kept[i][0] for i in g) for g in near_brute(kept)}
    assert len(roots) < len(kept)
    kept = [(i, t) for i, t in kept if i in roots and item not in t]
    assert sorted({r.doc_id for r in out}) == sorted(i for i, _ in kept) and len(out) == 2 * len(kept)
    assert all(len(r.ids) == r.n_pieces > 0 and r.round_trip and 0 < r.inclusion <= 1 for r in out)
    text = dict(kept)
    ids = spark.createDataFrame([(r.doc_id, r.ids) for r in out if r["sample"] == 1], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in decode_ids(ids, public_tokenizers.path("piece_bpe_32k.model")).collect()} == text


def test_stages_of_empty_tables(spark, frame, tmp_path):
    frame([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = frame([(1, prose(1, 40), "en", "s"), (2, None, None, None), (None, "", None, "s")])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, rel = QUERIES[name](spark, SF), c.sql(ORACLES[name])
    at = [rel.columns.index(x) for x in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in rel.fetchall())

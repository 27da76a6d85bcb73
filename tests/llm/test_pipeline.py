"""The stages of the pipeline on nulls, repeated ids, clashing columns and empty tables."""

import corpus_pipeline


def test_stages_on_nasty_and_empty_tables(spark, sf, nasty, no_rows):
    for docs in (nasty, no_rows):
        columns, n = docs.columns, docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            rows = out.collect()
            assert len(rows) <= n
            if name == "byte_bpe":
                assert len(rows) == n and all(r["same"] for r in rows)
                continue
            assert out.columns == columns
            texts = [r["text"] for r in rows]
            if name == "language":
                assert all(t and any(c.isalpha() for c in t) for t in texts)
            if name == "near_dedup":  # rows without an id, and of one id, are left to each other
                ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
                assert len({t for t, r in zip(texts, rows) if r["doc_id"] is not None}) >= len(set(ids)) - 1
            docs, n = spark.createDataFrame(rows, docs.schema), len(rows)

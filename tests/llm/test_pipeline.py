"""The pipeline on a small table: what must go goes, what is clean stays."""

from __future__ import annotations

import corpus_pipeline


def test_pipeline(spark, tmp_path):
    clean = [f"clean {' '.join(f'p{i}q{k}' for k in range(30))}" for i in range(12)]
    passage = " ".join(f"bench{k}" for k in range(14))
    texts = [*clean, clean[0] + " more", "what an idiot you stupid loser are", f"here it is {passage} so it is", "mail me@example.com now", None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        seen.append({r.doc_id: r.text for r in kept.collect()})
    toxic, near, clean_of, masked = seen
    assert set(toxic) == set(range(18)) - {13}
    assert set(near) == set(toxic) - {12}
    assert set(clean_of) == set(near) - {14}
    assert masked[15] == "mail <EMAIL> now" and {k: v for k, v in masked.items() if k != 15} == {k: v for k, v in clean_of.items() if k != 15}
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in pieces.collect()} == set(masked)

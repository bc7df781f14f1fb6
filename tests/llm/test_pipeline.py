import shutil

import corpus_pipeline as C
from custlens.llm.anchor_pii import find_spans, redact

from .test_hilbert_pack import check
from .test_lsh_forest import brute


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in C.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = C.materialise_table(stage(spark, docs, sf), name)
        after = {r["doc_id"]: r for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        if name == "near_dedup":
            groups = brute([(d, r["text"]) for d, r in before.items()])
            assert set(after) == {d for d, (_, c) in groups.items() if c == d}
        if name == "personal_data":
            assert set(after) == set(before)
            assert all(after[d]["text"] == redact(r["text"], find_spans(r["text"])) and after[d]["n_chars"] == len(after[d]["text"]) for d, r in before.items())
        else:
            assert all(after[d] == before[d] for d in after)
        seen.append(len(after))
    assert seen[0] < 1000 and sorted(seen, reverse=True) == seen and seen[-1] > 500
    check([(r["doc_id"], r["text"]) for r in docs.collect()], C.STAGES[-1][1](spark, docs, sf).collect(), 4096)
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    clean = [d for d, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0]
    first = {r["doc_id"] for r in C.toxicity(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()}
    assert sum(d in first for d in clean) >= 0.99 * len(clean)


def test_odd_table(spark, tmp_path):
    """Nulls, copies, a long text, clashing and extra columns; then no row at all."""
    good = " ".join(f"w{k}" for k in range(50))
    rows = [(1, None, "a", 1, "r"), (2, good, "a", 2, "r"), (3, good, None, 2, "r"), (None, good + " more", "a", None, "r"), (4, " ".join(f"q{k}" for k in range(80_000)), "a", 3, None),
            (5, "x@y.example words of a mail text that goes on for a while here " + " ".join(f"z{k}" for k in range(40)), "a", 4, "r")]
    schema = "doc_id long, text string, score string, n_chars long, kept string"
    shutil.copy("/root/testdata/sf0.001/labels.parquet", tmp_path / "labels.parquet")
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    got = C.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == {2, None, 4, 5}
    empty = tmp_path / "none"
    empty.mkdir()
    shutil.copy("/root/testdata/sf0.001/labels.parquet", empty / "labels.parquet")
    spark.createDataFrame([], schema).write.parquet(str(empty / "documents.parquet"))
    assert C.run(spark, str(empty)).collect() == []

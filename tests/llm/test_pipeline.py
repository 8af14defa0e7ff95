import corpus_pipeline
import pytest
from conftest_rows import rows
from test_lines import brute_force as dropped_lines
from test_mixing import check as check_mix
from test_near import brute_force as near_classes
from test_packing import brute_pieces, check_places

from tidemark.llm import mixing, quality

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def test_order_of_stages():
    assert list(STAGES) == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]


def test_each_stage_on_all_that_the_one_before_kept(spark, tmp_path):
    """Each stage is held against a brute-force version of its own on the same input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        before, after = [r.asDict() for r in docs.collect()], [r.asDict() for r in out.collect()]
        if name != "packing":
            assert out.columns == columns
            assert len(after)
        if name == "quality":
            judged = quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            assert sorted(r["doc_id"] for r in after) == sorted(r.doc_id for r in judged.where("predicted = 1").collect())
            truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            kept = {r["doc_id"] for r in after}
            clean = [r["doc_id"] for r in before if truth.get(r["doc_id"]) == 1]
            assert sum(d in kept for d in clean) >= 0.9 * len(clean)
        elif name == "line_dedup":
            want = dropped_lines([(r["doc_id"], r["text"]) for r in before])
            assert dropped_lines_of(after) == sorted((d, h) for d, _, _, h in want)
        elif name == "near_dedup":
            classes, _ = near_classes([(r["doc_id"], r["text"]) for r in before])
            assert sorted(r["doc_id"] for r in after) == sorted(set(classes.values()))
        elif name == "mixing":
            mixed = mixing.mix(docs).collect()
            check_mix(mixed, [(r["doc_id"], r["text"], r["source"]) for r in before])
            taken, got = {r.doc_id: r.taken for r in mixed if r.taken}, {}
            for r in after:
                got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(r["text"].encode().split())
            assert got == taken
        else:
            assert sorted((tuple(r[k] for k in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in after), key=repr) == brute_pieces([(r["doc_id"], r["text"]) for r in before], 2048)
            check_places(out.collect(), 2048)
        docs = out


def dropped_lines_of(after):
    import hashlib

    return sorted((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in after)


@pytest.mark.parametrize("name", list(STAGES))
def test_awkward_rows(spark, awkward, clashing, none, name):
    for df in (awkward, clashing):
        out = STAGES[name](spark, df, SF)
        n = out.count()
        if name != "packing":
            assert out.columns == df.columns
        if name == "line_dedup":
            assert n == len(rows())
    assert STAGES[name](spark, none, SF).count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert check_places(out.collect(), 2048)

"""The model queries over all of their input."""

from pyspark.sql import functions as F

from flowmill.operators import training as tr
from flowmill.plans import experiments as ex

DATA = "/root/testdata/sf0.001"


def test_all_components_are_features(spark):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = ex._rows(spark, DATA).select("vec_id", F.array(*ex._F).alias("all")).collect()
    assert {r.vec_id: r["all"] for r in rows} == {r.vec_id: r.e for r in e.select("vec_id", F.col("embedding").cast("array<double>").alias("e")).collect()}
    assert sum(r.features for r in ex.importance_groups(spark, DATA).collect()) == len(rows[0]["all"])


def test_all_candidates_in_full_size_are_compared(spark):
    models = ex._models()
    assert list(models) == ["logistic", "tree", "forest", "boosted"]
    assert models["logistic"][1].getMaxIter() == 2000 and models["tree"][1].getMaxDepth() == 30
    assert models["forest"][1].getNumTrees() == 300 and models["boosted"][1].rounds == 200
    rows = ex._rows(spark, DATA).withColumn("label", F.col("label") % 2).persist()
    got = tr.compare(rows, ex._F[:4], "vec_id", tr.candidates(2, 3, 4)).collect()
    assert [(r.name, r.error) for r in got] == [(m, None) for m in models] and all(r.score is not None for r in got)


def test_a_candidate_that_fails_says_why_and_keeps_its_name(spark):
    rows = ex._rows(spark, DATA).where("split <> 'train'").persist()
    got = {r.name: r for r in tr.compare(rows, ex._F[:2], "vec_id", {k: v for k, v in tr.candidates(2, 1, 2).items() if k != "forest"}).collect()}
    assert set(got) == {"logistic", "tree", "boosted"}
    assert all(r.score is None and r.error for r in got.values())


def test_a_capture_is_read_from_several_files(spark, monkeypatch):
    whole = sorted(map(tuple, ex.src_capture_frames(spark, DATA).collect()))
    seen, frames = [], ex.src.frames
    monkeypatch.setattr(ex.src, "frames", lambda files: seen.append(files.count()) or frames(files))
    monkeypatch.setattr(ex, "FILE_FRAMES", 7)
    assert sorted(map(tuple, ex.src_capture_frames(spark, DATA).collect())) == whole
    assert seen[0] > len({r[0] for r in whole})

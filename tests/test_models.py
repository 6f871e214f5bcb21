"""Stored models: cards, refusals, choice, and that what is loaded scores as what was saved."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from flowmill.operators import training as tr
from flowmill.operators.models import ModelStore, new_store
from flowmill.plans import experiments as ex

DATA = "/root/testdata/sf0.001"
CARD = {"model_id": "m", "feature_schema": "s", "classes": ["0", "1"], "trained_at": "2024-01-01"}


@pytest.fixture(scope="module")
def rows(spark):
    return ex._rows(spark, DATA).withColumn("label", F.col("label") % 2).persist()


def test_every_candidate_scores_alike_after_it_is_loaded(spark, rows):
    store = new_store(spark)
    for name, (_, estimator) in tr.candidates(2, 3, 3).items():
        model = tr.fit(rows, ex._F[:4], estimator)
        store.save(name, model, {**CARD, "algorithm": name}, ex._F)
        again = tr.score(store.load(name), rows, "vec_id").orderBy("vec_id").collect()
        assert again == tr.score(model, rows, "vec_id").orderBy("vec_id").collect()
    assert store.status("s").first().asDict() == {"available": True, "selected": "tree", "cards": 4, "incompatible": 0, "broken": 0, "reason": None}
    lost = rows.drop("f2")
    with pytest.raises(ValueError, match="f2"):
        store.score_latest(lost, "vec_id", "s")
    with pytest.raises(Exception, match="exist"):
        store.save("tree", model, CARD, ex._F)


def test_what_may_not_be_saved_leaves_nothing(spark, tmp_path):
    store, model = ModelStore(spark, f"file://{tmp_path}"), ex._stumps()
    short = {k: v for k, v in CARD.items() if k != "trained_at"}
    for name, card, allowed in (
        ("a", short, ex._F), ("a", {**CARD, "classes": []}, ex._F), ("a", {**CARD, "else": 1}, ex._F), ("a", CARD, ex._F[1:]), ("a", CARD, ex._F[::-1]), ("a", {**CARD, "feature_names": ["f1"]}, ex._F), ("a/b", CARD, ex._F), ("_a", CARD, ex._F),
    ):
        with pytest.raises(ValueError):
            store.save(name, model, card, allowed)
    assert list(tmp_path.iterdir()) == []


def test_why_no_model_can_be_used(spark, tmp_path):
    store = ModelStore(spark, f"file://{tmp_path}")
    reason = lambda: store.status("s").first().reason
    assert reason() == "no model" and store.cards("s").count() == 0
    ex._stumps().save(f"file://{tmp_path}/uncarded/pipeline")
    assert reason() == "no model"
    store.save("other", ex._stumps(), {**CARD, "feature_schema": "t"}, ex._F)
    assert reason() == "no model of this feature schema"
    store.card("gone", CARD)
    (tmp_path / "torn" / "card").mkdir(parents=True)
    (tmp_path / "torn" / "card" / "part-0").write_text('{"model_id": "x", "clas')
    assert reason() == "no model can be loaded"
    assert {r.directory: r.problem for r in store.cards("s").collect()} == {"other": "other feature schema", "gone": "no pipeline", "torn": "broken card"}
    with pytest.raises(LookupError, match="no model can be loaded"):
        store.latest("s")
    for name, at in (("p", "2024-02-01"), ("q", "2024-02-01"), ("r", "2024-01-31")):
        store.save(name, ex._stumps(), {**CARD, "trained_at": at}, ex._F)
    s = store.status("s").first()
    assert (s.selected, s.cards, s.incompatible, s.broken) == ("q", 6, 1, 2) and isinstance(store.latest("s"), PipelineModel)

"""Training queries fit the study's models, none with less rounds, trees or steps."""

import pytest
from conftest import SF_DIR

from cuespark.operators import models
from cuespark.operators.network import MiniBatchNetwork
from cuespark.plans import queries


class Seen(BaseException):
    """Ends a query where it begins to train."""


@pytest.mark.parametrize("name", [
    "train_boosted", "train_boosted_slow", "train_boosted_three", "train_all", "train_cross_validated",
    "compare_embeddings",
])
def test_models_are_the_study_s(spark, monkeypatch, name):
    asked = {}

    def look(data, estimators, *_, **__):
        asked.update(estimators)
        raise Seen

    monkeypatch.setattr(models, "train_models", look)
    with pytest.raises(Seen):
        queries.QUERIES[name](spark, SF_DIR)
    for booster in {models.BOOSTED_SLOW, models.BOOSTED_DEEP} & set(asked):
        assert asked[booster].getMaxIter() == 300
    if len(asked) == 1:
        return
    assert list(asked) == [models.LASSO, models.FOREST, models.MLP, models.BOOSTED_SLOW, models.BOOSTED_DEEP]
    assert asked[models.LASSO].getMaxIter() == 2000
    forest = asked[models.FOREST]
    assert (forest.getOrDefault("numTrees"), forest.getOrDefault("maxDepth")) == (300, models.MAX_DEPTH)
    network = asked[models.MLP]
    assert isinstance(network, MiniBatchNetwork)
    assert network.getOrDefault("layers")[1:] == [512, 256, 128, 2]
    assert (network.getOrDefault("batch"), network.getOrDefault("epochs")) == (32, 20)

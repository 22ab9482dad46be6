"""Work on rows of small tables is dealt over all cores before it is done."""

from __future__ import annotations

import numpy as np

from catalith.operators import search_index
from catalith.plans import entity_queries

SF = "/root/testdata/sf0.001"


def test_entities_are_computed_on_all_cores(spark):
    """The table is a small file of one partition; what is made of its rows was computed there."""
    cores = spark.sparkContext.defaultParallelism
    assert entity_queries.catalog(spark, SF, spread=True).entities.rdd.getNumPartitions() >= cores


def test_states_are_read_on_all_cores(spark):
    read = entity_queries._url_states(spark, SF).select("q")
    assert read.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("try_url_decode" if "try_url_decode" in plan else "https") < plan.index("Repartition")  # the plan's lower lines are done first


def test_values_without_repeats():
    assert search_index._distinct(np.array([5, 1, 5, 3, 1])).tolist() == [1, 3, 5]

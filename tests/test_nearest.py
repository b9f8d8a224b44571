"""Pruned exact search gives what the full search gives, and prunes where vectors are in clusters."""

import numpy as np
import pytest

from corpusmill.operators import nearest, retrieval


def table(spark, m, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id bigint, embedding array<double>")


def told(df):
    return sorted((r["query_id"], r["rank"], r["slot_id"], round(r["score"], 6)) for r in df.collect())


@pytest.mark.parametrize("pivots", [1, 7])
def test_same_rows_whatever_the_pivots(spark, pivots):
    rng = np.random.default_rng(pivots)
    m = rng.normal(size=(400, 6))
    m[50:60] = m[:10]  # ties
    m[60:63] = 0  # no direction
    q = np.vstack([rng.normal(size=(8, 6)), m[:3], np.zeros((1, 6))])
    slots, queries = table(spark, m), table(spark, q, 1000)
    found = nearest.search(queries, slots, 5, pivots=pivots, first=1, rings_each=3)
    assert told(found.rows) == told(retrieval.top_k(queries, slots, 5)) and found.met <= found.pairs


def test_clusters_are_left_out(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16)) * 10
    m = np.repeat(centres, 100, axis=0) + rng.normal(size=(2000, 16)) * 0.3
    slots, queries = table(spark, m), table(spark, m[::100], 5000)
    found = nearest.search(queries, slots, 10, pivots=32)
    assert told(found.rows) == told(retrieval.top_k(queries, slots, 10))
    assert found.met < found.pairs / 4  # pairs of queries and rings


def test_odd_tables(spark):
    few = table(spark, np.eye(3))
    assert told(nearest.search(few, few, 10).rows) == told(retrieval.top_k(few, few, 10))
    none = few.where("false")
    assert nearest.search(none, few, 2).rows.count() == 0 and nearest.search(few, none, 2).rows.count() == 0
    mixed = few.unionByName(spark.createDataFrame([(9, [1.0]), (None, [1.0, 0.0, 0.0]), (10, None)], "vec_id bigint, embedding array<double>"))
    assert nearest.search(mixed.where("vec_id < 3 or vec_id is null or vec_id = 10"), few, 2).rows.count() == 6

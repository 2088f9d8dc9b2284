"""Lines that meet at a key without being of near length leave before they are rows."""

import numpy as np

from pooltide.llm import line_dedup as L


def test_near_lengths_are_near_classes():
    chars = np.arange(1, 60_000)
    shortest = np.ceil(chars * L.SIMILARITY - 1e-9).astype(int)
    assert np.abs(L.length_classes(chars).astype(int) - L.length_classes(shortest).astype(int)).max() <= L.NEAR_CLASSES
    group = np.array([1, 1, 1, 2, 2, 3])
    assert L.with_near_length(group, L.length_classes(np.array([100, 10, 85, 40, 90, 7]))).tolist() == [True, False, True, False, False, False]
    assert L.with_near_length(group[:0], group[:0]).tolist() == []


def test_lines_of_other_lengths_do_not_meet(spark):
    short, long = ("abcdefgh " * n for n in (6, 20))
    near = "abcdefgh " * 19
    docs = spark.createDataFrame([(1, short), (2, long)], "doc_id long, text string")
    assert L.shared_keys(docs, True, 2)[0].isEmpty()
    rows = L.shared_keys(docs.unionByName(spark.createDataFrame([(3, near)], docs.schema)), True, 3)[0].select("num").distinct().count()
    assert rows == 2
    gone = {r.doc_id: r.dropped for r in L.dedup_lines(docs.unionByName(spark.createDataFrame([(3, "abcdefgh " * 19 + "abcdefgh")], docs.schema))).collect()}
    assert gone == {1: 0, 2: 0, 3: 1}

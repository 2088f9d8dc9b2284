"""What a stored table leaves behind."""

from pooltide.operators import staging as S


def test_shuffle_files_go_with_the_job_that_stores_a_table(spark):
    known = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    before, mode = known(), spark.conf.get(S._CLEANUP, None)
    table = S.staged(spark.range(1000).repartition(3, "id").groupBy("id").count(), "counts")
    assert known() <= before and spark.conf.get(S._CLEANUP, None) == mode
    assert table.count() == 1000

from pyspark.sql import functions as F

from inkwell.session import SHUFFLE_CLEANUP, materialize, working_tables


def test_what_was_shuffled_for_a_table_goes_when_it_is_written(spark):
    def shuffled():
        manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return manager.getAllFiles().mkString("\n").count("shuffle_")

    with working_tables(spark):
        before, setting = shuffled(), spark.conf.get(SHUFFLE_CLEANUP)
        table = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
        assert shuffled() <= before and spark.conf.get(SHUFFLE_CLEANUP) == setting
        assert table.where("count > 100").count() == 7

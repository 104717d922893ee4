"""The Spark session of the tests and of the check."""

import tempfile

from pyspark.sql import SparkSession


def make_session(cores: str = "8"):
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("spanworks-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spanworks-tests-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark

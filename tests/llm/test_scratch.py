import importlib
import time

import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize("module", ["amendry.llm.scratch", "amendry.plans.scratch"])
def test_shuffle_files_go_when_a_table_is_written(spark, module):
    """They would stay until the driver collects garbage; the session's setting is left as it was."""
    written, key = importlib.import_module(module).written, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before, setting = disk.getAllFiles().size(), spark.conf.get(key)
    made = written(spark.range(20_000).groupBy(F.xxhash64("id").alias("k")).count(), "made")
    assert spark.conf.get(key) == setting
    for _ in range(40):
        if disk.getAllFiles().size() <= before:
            break
        time.sleep(0.25)
    assert disk.getAllFiles().size() <= before
    assert made.count() == 20_000

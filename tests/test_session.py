from types import SimpleNamespace

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from civitext import session


def fake(master, configured=None):
    context = SimpleNamespace(master=master, folder=None, applicationId="app-1")
    context.getCheckpointDir = lambda: context.folder
    context.setCheckpointDir = lambda folder: setattr(context, "folder", folder)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default: configured))


def test_the_clusters_folder_is_used():
    assert session.scratch_root(fake("spark://host", "s3://shared/tmp")) == "s3://shared/tmp"
    assert session.scratch_path(fake("yarn", "hdfs:///a/"), "x").startswith("hdfs:///a/civitext/app-1/x-")


def test_only_a_local_session_gets_its_own_folder():
    local = fake("local[2]")
    assert session.scratch_root(local) == session.scratch_root(local) == local.sparkContext.folder
    with pytest.raises(RuntimeError):
        session.scratch_root(fake("yarn"))


def test_materialised_rows_are_read_back(spark):
    df = spark.range(10).selectExpr("id", "id % 3 AS k")
    back = session.materialise(df, "rows")
    assert back.dtypes == df.dtypes and sorted(back.collect()) == sorted(df.collect())


def test_small_tables_are_cut_only_where_the_session_says_so(spark):
    df = spark.range(100).coalesce(1)
    assert session.cut(df, "id", None) is df
    assert session.cut(df, "id", 3).select(F.spark_partition_id().alias("p")).distinct().count() <= 3
    assert session.scan_parts(spark) == 8
    assert session.scan_parts(SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default))) is None


def test_scratch_of_another_application_stays(spark):
    kept = f"{session.scratch_root(spark)}/civitext/other/rows"
    spark.range(3).write.parquet(kept)
    path = session.scratch_path(spark, "rows")
    assert spark.sparkContext.applicationId in path
    spark.range(3).write.parquet(path)
    folder = session._scratch_folder
    session._scratch_folder = lambda spark: path  # only this path, other tests have theirs
    try:
        session.drop_scratch(spark)
    finally:
        session._scratch_folder = folder
    assert spark.read.parquet(kept).count() == 3
    with pytest.raises(AnalysisException):
        spark.read.parquet(path)

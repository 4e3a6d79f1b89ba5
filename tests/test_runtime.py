import warnings

from gridspark import runtime
from gridspark.operators import ranking


def folders(spark):
    fs, where = runtime.hadoop_path(spark, runtime.shared_dir(spark))
    return {s.getPath().getName() for s in fs.listStatus(where)} if fs.exists(where) else set()


def test_clean_leaves_nothing_behind(spark):
    runtime.clean(spark)
    before = folders(spark)
    ranked = ranking.global_row_number(spark.range(100), ["id"])
    assert ranked.count() == 100 and len(folders(spark) - before) == 1
    runtime.clean(spark)
    assert folders(spark) == before


def test_staging_removes_its_folder(spark):
    runtime.new_dir(spark, "first")
    with runtime.staging(spark, "job") as folder:
        runtime.materialise(spark.range(3), "rows", folder)
        fs, where = runtime.hadoop_path(spark, folder)
        assert fs.exists(where)
    assert not fs.exists(where)


def test_local_folder_is_accepted_by_a_local_master(spark):
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        runtime.shared_dir(spark)


def test_package_is_sent_once(spark, monkeypatch):
    sent = []
    monkeypatch.setenv("PYTHONPATH", "")
    monkeypatch.setattr(type(spark.sparkContext), "addPyFile", lambda self, path: sent.append(path))
    was = spark.conf.get(runtime.SHIPPED_CONF, None)
    spark.conf.unset(runtime.SHIPPED_CONF)
    runtime.prepare(spark)
    runtime.prepare(spark)
    assert len(sent) == 1 and sent[0].endswith("gridspark.zip")
    if was is None:
        spark.conf.unset(runtime.SHIPPED_CONF)

import os
from types import SimpleNamespace

import pytest
from pyspark.errors import AnalysisException

from spanworks.plans import chain
from spanworks.sinks.snapshot import (
    SnapshotConfig,
    SnapshotSaver,
    read_snapshot,
    save_dataframe,
    summarize_log,
)
from spanworks.workdir import materialize, work_dir


@pytest.fixture()
def df(spark):
    return spark.createDataFrame([(1, "a"), (2, ""), (3, None), (4, 'x"y\\')], "id int, s string")


def keep_large(df):
    return df.filter("id > 1")


def larger_than(n):
    return lambda df: df.filter(df.id > n)


def test_transform_and_factory(df, tmp_path):
    saver = SnapshotSaver(SnapshotConfig(str(tmp_path), when="both"))
    step, made = saver.save_transform()(keep_large), saver.save_transform()(larger_than)
    assert df.transform(step).count() == 3 and df.transform(made(2)).count() == 2
    assert step.__name__ == "keep_large"
    assert [(f, p, n) for f, p, _, _, n in saver.saves_log] == [
        ("keep_large", "before", 4), ("keep_large", "after", 3),
        ("larger_than", "before", 4), ("larger_than", "after", 2)]
    assert all(os.path.isdir(path) for *_, path, _ in saver.saves_log)
    paths = [path for *_, path, _ in saver.saves_log]
    assert paths[0].endswith("_before") and paths[1].endswith("_after") and len(set(paths)) == 4


def test_after_has_no_suffix(df, tmp_path):
    saver = SnapshotSaver(SnapshotConfig(str(tmp_path), include_timestamp=False))
    df.transform(saver.save_transform()(keep_large))
    assert saver.saves_log[0][3] == f"{tmp_path}/keep_large/keep_large"


def test_counts_run_no_second_job(spark, df, tmp_path):
    saver = SnapshotSaver(str(tmp_path))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("one-save", "")
    df.transform(saver.save_transform()(keep_large))
    spark.sparkContext.setJobGroup("other", "")
    assert len(tracker.getJobIdsForGroup("one-save")) == 1


@pytest.mark.parametrize("kind", ["csv", "json", "parquet", "orc"])
def test_round_trip(spark, tmp_path, kind):
    df = spark.sql(
        "SELECT 1 AS i, CAST(NULL AS STRING) AS s, '' AS e, date'2020-02-29' AS d, array(1, 2) AS a, "
        "timestamp_ntz'2020-01-01 00:00:00.123456' AS t, 1.5D AS x, true AS b"
    )
    saver = SnapshotSaver(SnapshotConfig(str(tmp_path), save_format=kind))
    df.transform(saver.save_transform()(lambda x: x))
    back = read_snapshot(spark, saver.saves_log[0][3], kind, df.schema)
    assert back.collect() == df.collect()


def test_decorator_defaults_and_options(df, spark, tmp_path):
    save_dataframe(str(tmp_path), sep=";")(keep_large)(df)
    folder = tmp_path / "keep_large"
    assert spark.read.text(str(folder / os.listdir(folder)[0])).filter("value = 'id;s'").count() >= 1


def test_modes(df, tmp_path):
    def saver(mode):
        return SnapshotSaver(SnapshotConfig(str(tmp_path), save_mode=mode, include_timestamp=False))

    first, again = saver("error"), saver("error")
    df.transform(first.save_transform()(keep_large))
    with pytest.raises(AnalysisException):
        df.transform(again.save_transform()(keep_large))
    ignoring = saver("ignore")
    df.transform(ignoring.save_transform()(keep_large))
    assert ignoring.saves_log[0][4] is None


@pytest.mark.parametrize(
    "bad", [{"when": "never"}, {"save_mode": "x"}, {"reuse": "x"}, {"reuse": "reread", "save_format": "csv"}]
)
def test_settings_are_checked(tmp_path, bad):
    with pytest.raises(ValueError):
        SnapshotConfig(str(tmp_path), **bad)


def test_reread_cuts_the_lineage(df, tmp_path):
    saver = SnapshotSaver(SnapshotConfig(str(tmp_path), reuse="reread"))
    out = df.transform(saver.save_transform()(keep_large))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "Filter (" not in plan
    assert sorted(out.collect(), key=str) == sorted(keep_large(df).collect(), key=str)


def test_chain_with_snapshots_and_summary(spark, df, tmp_path):
    saver = SnapshotSaver(str(tmp_path / "snap"))
    out = chain.run_chain(
        df, [("lower", chain.lower_case_names()), ("large", keep_large)], saver, ["large"]
    )
    assert out.count() == 3
    saver.append_log(spark, str(tmp_path / "log"))
    saver.append_log(spark, str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    row = summarize_log(log).first()
    assert (row.function, row.saves, row.last_row_count) == ("large", 2, 3)


def test_empty_result_is_logged(df, tmp_path):
    saver = SnapshotSaver(str(tmp_path))
    df.transform(saver.save_transform()(larger_than)(99))
    assert saver.saves_log[0][4] == 0


def test_work_dir_follows_the_session(spark, df):
    base = spark.conf.get("spark.checkpoint.dir", None)
    path = work_dir(spark, "x")
    assert path.startswith(base) if base else "spanworks-" in path
    assert sorted(materialize(df, "t").collect(), key=str) == sorted(df.collect(), key=str)


def test_work_dir_without_the_setting():
    def session(master):
        context = SimpleNamespace(master=master, applicationId=f"app-{master}")
        return SimpleNamespace(conf={}, sparkContext=context)

    first, second = (work_dir(session("local[2]"), "x") for _ in range(2))
    assert first != second and os.path.dirname(first) == os.path.dirname(second)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        work_dir(session("yarn"), "x")


def test_config_decorator(df, tmp_path):
    config = SnapshotConfig(str(tmp_path))
    assert df.transform(config.get_decorator("both")(keep_large)).count() == 3
    assert len(os.listdir(tmp_path / "keep_large")) == 2

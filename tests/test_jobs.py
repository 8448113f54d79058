import pytest
from pyspark.sql import functions as F

from fernweave import cli, jobs
from fernweave.sources.tables import Table
from fernweave.storage import new_dir


def test_lock(spark):
    path = new_dir(spark, "lock")
    with jobs.Lock(spark, path, "a"):
        with pytest.raises(BlockingIOError), jobs.Lock(spark, path, "b"):
            pass
    with jobs.Lock(spark, path, "b"):
        pass


def test_a_dead_drivers_lock_is_taken_over(spark):
    import time

    path = new_dir(spark, "lock")
    dead = jobs.Lock(spark, path, "dead", 0.6)
    dead._keep = lambda: None
    dead.__enter__()
    with pytest.raises(BlockingIOError), jobs.Lock(spark, path, "b", 0.6):
        pass
    time.sleep(1.2)
    with jobs.Lock(spark, path, "b", 0.6) as own:
        assert own.held() and not dead.held()
        time.sleep(1.2)  # the holder keeps its lease
        with pytest.raises(BlockingIOError), jobs.Lock(spark, path, "c", 0.6):
            pass
        dead.__exit__()
        assert own.held()


def test_retries():
    waits, calls = [], []

    def work():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return 7

    assert jobs.retried(work, sleep=waits.append) == 7 and waits == [2.0, 4.0]
    with pytest.raises(ZeroDivisionError):
        jobs.retried(lambda: 1 / 0, retries=1, sleep=waits.append)
    with pytest.raises(TimeoutError):
        jobs.retried(lambda: 1, limit=-1)


def test_checkpoints_and_runs(spark):
    table, asked = Table(spark, new_dir(spark, "points"), ["key"]), []

    def answer(rows):
        asked.append(rows.count())
        return rows.withColumn("payload", F.upper("key"))

    first, second = (spark.createDataFrame([(k,) for k in x], "key string") for x in ("ab", "bc"))
    assert jobs.with_checkpoints(first, table, "key", answer).count() == 2
    assert {r.payload for r in jobs.with_checkpoints(second, table, "key", answer).collect()} == {"B", "C"} and asked == [2, 1]
    assert jobs.checkpoint_key({"b": 1, "a": 2}) == jobs.checkpoint_key({"a": 2, "b": 1})
    run = jobs.Run(spark, Table(spark, new_dir(spark, "runs"), ["run_id"]), "r")
    assert run.status() is None
    run.set("running")
    run.check()
    run.set("cancel_requested")
    with pytest.raises(jobs.Cancelled):
        run.check()
    assert run.status() == "cancelled"


def test_cli(spark, tmp_path):
    docs, index = str(tmp_path / "docs"), new_dir(spark, "index")
    spark.createDataFrame([(1, "患者失眠，辨为心脾两虚，方用归脾汤。")], "doc_id long, text string").write.parquet(docs)
    assert cli.main([index, "rebuild", docs], spark) == {"chunks": 1}
    assert cli.main([index, "query", "失眠"], spark)["hits"]
    assert cli.main([index, "vectors", "5"], spark) == {"chunks": 1}
    assert cli.main([index, "answer", "失眠"], spark)["trace"]["graph"]["entities"] == []
    assert cli.main([index, "cancel", "no-such-run"], spark) == {"cancelled": False}
    assert cli.main([index, "status"], spark)["total"] == 1

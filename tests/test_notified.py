"""Who is told of which episode, and that the rows of the result are not shuffled."""

from __future__ import annotations

from loregrain.operators import feeds


def test_notified(spark):
    episodes = [(1, 10, 5), (1, 10, 9), (1, 11, 3), (2, 20, 9), (2, None, 9), (1, 12, None)]
    subscriptions = [(100, 1, 4), (100, 1, 8), (101, 1, 9), (100, 2, 1), (None, 1, 1)]
    frame = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names.split()))
    followed, sent = frame(subscriptions, "user_id feed_id created_at"), frame([(100, 20), (101, 11), (None, 10)], "user_id episode_id")

    def told(rows):
        got = feeds.notified(frame(rows, "feed_id episode_id ready_at"), followed, sent)
        return got, sorted(tuple(r) for r in got.na.fill(0).collect())

    got, rows = told(episodes)
    assert rows == [(0, 10), (0, 11), (100, 0), (100, 10), (101, 10)]
    plan = got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")
    assert "Exchange" not in plan[: plan.index("Join")]
    # an episode of two feeds is told once
    assert told([*episodes, (2, 10, 9)])[1] == rows


def test_the_result_is_small_where_it_is_written(spark, tmp_path):
    episodes = spark.range(2000).selectExpr("id % 2 feed_id", "id * 7919 % 2000 episode_id", "id * 7919 % 2000 ready_at")
    followed = spark.range(1000).selectExpr("100000 + id user_id", "id % 2 feed_id", "id * 31 % 300 created_at")
    sent = spark.range(500).selectExpr("100000 + id user_id", "id * 3 episode_id")
    feeds.notified(episodes, followed, sent).write.parquet(f"{tmp_path}/told")
    got = spark.read.parquet(f"{tmp_path}/told")
    plain = episodes.join(followed, "feed_id").where("created_at <= ready_at").select("user_id", "episode_id").exceptAll(sent)
    assert got.count() == plain.count() and got.exceptAll(plain).isEmpty()
    files = list((tmp_path / "told").glob("*.parquet"))
    assert sum(f.stat().st_size for f in files) < 0.6 * got.count()
    # several tasks write it, however little is shuffled
    assert len(files) > 2

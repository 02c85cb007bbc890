from pyspark.sql import functions as F

from claimstone import session
from claimstone.session import stored


def _broadcasts(spark, since: int) -> list[str]:
    """Names of the broadcasts in the executions after the first ``since``."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark._jsparkSession.sharedState().statusStore()
    runs, found = store.executionsList(), []
    for i in range(since, runs.size()):
        nodes = store.planGraph(runs.apply(i).executionId()).allNodes()
        found += [n for k in range(nodes.size()) if (n := nodes.apply(k).name()).startswith("BroadcastExchange")]
    return found


def test_tables_that_compress_well_are_not_broadcast(spark):
    rows = stored(spark.range(200_000).select(F.xxhash64("id").alias("id"), F.lit("as good as nothing in a file " * 5).alias("text")), "rows")
    other = stored(spark.range(200_000).select(F.xxhash64("id").alias("id"), F.lit("nor is this, which is in every row " * 5).alias("more")), "other")
    before = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    joined = stored(rows.join(other, "id"), "joined")
    assert _broadcasts(spark, before) == []
    assert joined.count() == 200_000


def test_small_tables_still_are(spark):
    rows, few = stored(spark.range(200_000).toDF("id"), "rows"), stored(spark.range(10).toDF("id"), "few")
    before = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    assert stored(rows.join(few, "id"), "joined").count() == 10
    assert _broadcasts(spark, before)


def test_rows_of_groups_and_batches_are_bounded(spark):
    import pyarrow as pa
    import pyarrow.parquet as pq

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows])], names=["n"])

    rows = stored(spark.range(0, 50, 1, 1), "rows", group=8)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in rows.inputFiles()]
    assert max(f.row_group(i).num_rows for f in files for i in range(f.num_row_groups)) == 8
    before = spark.conf.get(session.BATCH, None)
    n = [r.n for r in stored(rows.mapInArrow(sizes, "n long"), "sizes", batch=3).collect()]
    assert max(n) == 3 and sum(n) == 50 and spark.conf.get(session.BATCH, None) == before


def test_a_write_leaves_the_settings_as_they_were(spark):
    names = (session.CLEANUP, session.BROADCAST, session.ADAPTIVE)
    kept = {k: spark.conf.get(k, None) for k in names}
    try:
        spark.conf.unset(session.ADAPTIVE)
        for own in ("-1", "100k", "20MB"):
            spark.conf.set(session.BROADCAST, own)
            with session._writing(spark), session._writing(spark):
                assert int(spark.conf.get(session.BROADCAST)) == {"-1": -1, "100k": 102_400, "20MB": session.SURE}[own]
                assert spark.conf.get(session.ADAPTIVE) == own
            assert [spark.conf.get(k, None) for k in names] == [kept[session.CLEANUP], own, None]
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)

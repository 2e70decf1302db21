"""Tables written to cut lineage."""

import time

from moneytrail.plans import session


def test_saving_frees_the_shuffles_of_finished_queries(spark, monkeypatch):
    monkeypatch.setattr(session, "FREE_EVERY", 0, raising=False)
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    for _ in range(6):
        session.save(spark.range(0, 1000, 1, 4).repartition(7))
    until = time.time() + 15
    while files() > 12 and time.time() < until:
        time.sleep(0.5)
    assert files() <= 12  # six shuffles leave 48

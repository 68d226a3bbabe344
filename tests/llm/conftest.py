import time

import pytest


@pytest.fixture
def shuffled_bytes(spark):
    """A function that gives the bytes that all tasks so far have written to shuffles."""

    def read():
        time.sleep(0.3)  # the store takes a value at most every 0.1 s
        spark.range(1).count()
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()

    return read

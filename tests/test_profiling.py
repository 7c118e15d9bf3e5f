from pyspark.sql import functions as F

from denspark.profiling import Profile, timed


def test_peak_memory_and_time():
    with Profile(interval=0.01) as profile:
        held = bytearray(b"x") * 60_000_000
        sum(held[::4096])
    assert profile.peak_bytes > 60_000_000
    assert profile.samples >= 2
    assert profile.seconds > 0


def test_a_run_is_observed(spark):
    seen, profile = timed(spark.range(1000), F.max("id").alias("most"))
    assert seen == {"rows": 1000, "most": 999}
    assert profile.seconds > 0

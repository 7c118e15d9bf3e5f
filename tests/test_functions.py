import math

import pytest
from pyspark.sql import functions as F

from denspark import errors
from denspark.config import ClusterConfig, KnnParams
from denspark.functions import distance, scalar


def one(spark, column, **values):
    kinds = {list: "array<float>", str: "string", int: "long", float: "double"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("a", "b", "want"), [([0.0, 0.0], [0.0, 0.0], 0), ([1.0, 2.0], [4.0, 6.0], 5), ([1.0, 2.0, 3.0], [4.0, 6.0, 8.0], math.sqrt(50))])
def test_euclidean(spark, a, b, want):
    assert one(spark, distance.euclidean(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize(("a", "b", "want"), [([1.0, 0.0], [2.0, 0.0], 0), ([1.0, 0.0], [-1.0, 0.0], 2), ([1.0, 0.0], [0.0, 3.0], 1)])
def test_cosine(spark, a, b, want):
    assert one(spark, distance.cosine(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want, abs=1e-6)


def test_cosine_of_a_zero_vector_is_an_error(spark):
    with pytest.raises(Exception, match="ZERO_MAGNITUDE"):
        one(spark, distance.cosine(F.col("a"), F.col("b")), a=[0.0], b=[1.0])


@pytest.mark.parametrize(("a", "b", "want"), [("kitten", "sitting", 3), ("gumbo", "gambol", 2), ("", "", 0), ("naïve", "naive", 1)])
def test_levenshtein_counts_characters(spark, a, b, want):
    assert one(spark, distance.levenshtein(F.col("a"), F.col("b")), a=a, b=b) == want


def test_infinite_distances_are_found(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, float("nan"))], "source long, target long, distance float")
    with pytest.raises(errors.INDEX["NON_FINITE_DISTANCE"]):
        distance.check_finite(edges)


def test_bytes():
    assert scalar.format_bytes(1536) == "1.5 KiB"
    assert scalar.format_bytes(1023) == "1023 B"
    assert scalar.parse_byte_size("512M") == 512 << 20
    assert scalar.parse_byte_size("2 GiB") == 2 << 30
    assert scalar.parse_byte_size("10kb") == 10240
    with pytest.raises(ValueError):
        scalar.parse_byte_size("ten")
    with pytest.raises(OverflowError):
        scalar.parse_byte_size("99999999999G")
    assert scalar.estimate_peak_bytes(0) == 0
    assert scalar.format_bytes(scalar.estimate_peak_bytes(10_000, 16)) == "140.0 MiB"


def test_small_arithmetic(spark):
    assert scalar.source_name("/a/b.parquet") == "b"
    assert scalar.source_name("/a/b.parquet", "c") == "c"
    assert scalar.query_index(0, 51) == 1
    assert scalar.resolve_ef(8, 0) == 16
    assert scalar.effective_ef(10, 5, 64) == 10
    assert scalar.effective_ef(1000, 99, 64) == 100
    assert [one(spark, scalar.lane_basis_points(F.col("a")), a=c) for c in (0, 8, 16, 24)] == [0, 5000, 10000, 7500]
    assert one(spark, scalar.duration_basis_points(F.col("a"), F.col("b")), a=5, b=0) == 0
    assert one(spark, scalar.duration_basis_points(F.col("a"), F.col("b")), a=9, b=3) == 10000
    assert one(spark, scalar.weight_to_lambda(F.col("a")), a=0.0) == math.inf
    assert one(spark, scalar.weight_to_lambda(F.col("a")), a=4.0) == 0.25


def test_settings_are_checked():
    with pytest.raises(errors.ENGINE["INVALID_MIN_CLUSTER_SIZE"]) as e:
        ClusterConfig(0)
    assert e.value.code == "INVALID_MIN_CLUSTER_SIZE"
    with pytest.raises(errors.INDEX["INVALID_PARAMETERS"]):
        KnnParams(16, 8)
    with pytest.raises(errors.ENGINE["BACKEND_UNAVAILABLE"]):
        ClusterConfig(strategy="gpu").check_backend()
    assert KnnParams().degree_limit(0) == 32

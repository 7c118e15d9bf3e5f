import gzip
import io
import struct

import pyarrow as pa
import pytest

from denspark import cli, errors
from denspark.errors import INGEST
from denspark.sources import readers, recipes, sinks, synthetic


def test_parquet_vectors(spark, tmp_path):
    path = str(tmp_path / "v.parquet")
    spark.createDataFrame([([1.0, 2.0], "x"), ([3.0, 4.0], "y")], "features array<float>, other string").coalesce(1).write.parquet(path)
    points = readers.vectors_from_parquet(spark, path)
    assert [(r["id"], r["item"]) for r in points.orderBy("id").collect()] == [(0, [1.0, 2.0]), (1, [3.0, 4.0])]
    with pytest.raises(INGEST["COLUMN_NOT_FOUND"]):
        readers.vectors_from_parquet(spark, path, "nothing")
    with pytest.raises(INGEST["INVALID_COLUMN_TYPE"]):
        readers.vectors_from_parquet(spark, path, "other")


def test_arrow_vectors(spark):
    table = pa.table({"v": pa.array([[1.0], [2.0]], pa.list_(pa.float32()))})
    assert readers.vectors_from_arrow(spark, table, "v").count() == 2
    with pytest.raises(INGEST["INVALID_LIST_VALUE_TYPE"]):
        readers.vectors_from_arrow(spark, pa.table({"v": pa.array([[1.0]], pa.list_(pa.float64()))}), "v")


@pytest.mark.parametrize(("rows", "code"), [([], "EMPTY_INPUT"), ([[1.0], None], "NULL_ROW"), ([[1.0, None]], "NULL_VALUE"), ([[1.0], [1.0, 2.0]], "INVALID_ROW_LENGTH"), ([[]], "INVALID_DIMENSION")])
def test_bad_rows(spark, rows, code):
    with pytest.raises(INGEST[code]):
        readers.vectors_from_rows(spark, rows)


@pytest.mark.parametrize(("content", "want"), [("alpha\nbeta\n", ["alpha", "beta"]), ("alpha\r\nbeta\r\n", ["alpha", "beta"]), ("alpha", ["alpha"]), ("a\n\nb\n", ["a", "", "b"])])
def test_text_lines(spark, tmp_path, content, want):
    path = tmp_path / "t.txt"
    path.write_bytes(content.encode())
    assert [r["item"] for r in readers.text_lines(spark, str(path)).orderBy("id").collect()] == want


def test_empty_text(spark, tmp_path):
    path = tmp_path / "t.txt"
    path.write_text("")
    with pytest.raises(INGEST["EMPTY_INPUT"]):
        readers.text_lines(spark, str(path))


def test_csv_and_images(spark, tmp_path):
    (tmp_path / "p.csv").write_text("1,2\n3,4\n")
    assert readers.vectors_from_csv(spark, str(tmp_path / "p.csv"), 2).count() == 2
    data = struct.pack(">iiii", 2051, 2, 1, 3) + bytes([1, 2, 3, 4, 5, 6])
    (tmp_path / "i.gz").write_bytes(gzip.compress(data))
    assert [r["item"] for r in readers.idx_images(spark, str(tmp_path / "i.gz")).orderBy("id").collect()] == [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]]


def test_generators_depend_on_seed_and_id_only(spark):
    for make in (lambda s: synthetic.uniform(spark, 20, 3, s), lambda s: synthetic.blobs(spark, 20, 3, 4, seed=s), lambda s: synthetic.ring(spark, 20, 3, seed=s), lambda s: synthetic.swiss_roll(spark, 20, 3, seed=s), lambda s: synthetic.mutated_text(spark, 20, seed=s)):
        rows = sorted(map(str, make(1).collect()))
        assert rows == sorted(map(str, make(1).repartition(3).collect()))
        assert rows != sorted(map(str, make(2).collect()))
    assert all(6 <= len(r["item"]) <= 14 for r in synthetic.mutated_text(spark, 50).collect())
    with pytest.raises(ValueError):
        synthetic.swiss_roll(spark, 5, 2)


def test_reports(spark, tmp_path):
    out = io.StringIO()
    sinks.write_summary("x", spark.createDataFrame([(1, 0), (0, 1)], "id long, label long"), 2, out)
    assert out.getvalue() == "data source: x\nclusters: 2\n0\t1\n1\t0\n"
    sinks.write_report("recall", [{"source": "a,b", "n": 1, "m": 2, "ef_construction": 3, "k": 4, "hits": 1, "total": 2, "recall": 0.5}], tmp_path / "r.csv")
    assert (tmp_path / "r.csv").read_text().splitlines()[1] == '"a,b",1,2,3,4,1,2,0.500000'


def test_command_line(spark, tmp_path):
    path = tmp_path / "words.txt"
    path.write_text("alpha\nbeta\ngamma\n")
    out = io.StringIO()
    assert cli.main(["run", "--min-cluster-size", "2", "text", str(path), "--metric", "levenshtein"], out, spark) == 0
    lines = out.getvalue().splitlines()
    assert lines[0] == "data source: words"
    assert len(lines) == 5
    assert cli.main(["run", "--min-cluster-size", "9", "text", str(path), "--metric", "levenshtein"], out, spark) == 1
    assert cli.main(["run", "--max-bytes", "1k", "--min-cluster-size", "2", "text", str(path), "--metric", "levenshtein"], out, spark) == 1


class Lines(recipes.Recipe):
    def __init__(self, fail=None, bad_cleanup=False):
        self.fail, self.bad_cleanup, self.completed = fail, bad_cleanup, "unset"

    def _step(self, phase, value):
        if phase == self.fail:
            raise ValueError(phase)
        return value

    def info(self):
        return recipes.DatasetInfo("lines", recipes.RecipeVersion.parse("1.2.3"))

    def fetch(self, fetcher):
        return self._step("fetch", fetcher)

    def validate(self, x):
        return self._step("validate", x)

    def prepare(self, x):
        return self._step("prepare", {"rows": x})

    def cleanup(self, completed):
        self.completed = completed
        if self.bad_cleanup:
            raise ValueError("cleanup")


def test_recipes(spark, tmp_path):
    manifest = recipes.run_recipe(Lines(), spark.range(3), recipes.ParquetPublisher(str(tmp_path)))
    assert manifest.roles["rows"][1] == 3
    recipe = Lines("prepare")
    with pytest.raises(errors.RECIPE["PREPARE"]):
        recipes.run_recipe(recipe, spark.range(3), None)
    assert recipe.completed == "validate"
    with pytest.raises(errors.RECIPE["CLEANUP"]):
        recipes.run_recipe(Lines("fetch", True), None, None)
    with pytest.raises(errors.RECIPE["INVALID_NAME"]):
        recipes.SourceUrl("http://x")
    with pytest.raises(errors.RECIPE["CHECKSUM_UNSUPPORTED"]):
        recipes.SourceUrl("https://x", "abc")


def idx_file(n, h, w, packed=False):
    import gzip
    import struct

    import numpy as np

    data = struct.pack(">iiii", 2051, n, h, w) + np.random.default_rng(n).integers(0, 256, n * h * w).astype("uint8").tobytes()
    return gzip.compress(data) if packed else data


@pytest.mark.parametrize("packed", [False, True])
def test_idx_by_ranges_of_images(spark, tmp_path, monkeypatch, packed):
    from denspark.sources import datasource

    monkeypatch.setattr(datasource, "BATCH", 7)
    datasource.register(spark)
    folder = tmp_path / "idx"
    folder.mkdir()
    for name, n in (("a", 50), ("b", 3), ("c", 0)):
        (folder / name).write_bytes(idx_file(n, 4, 3, packed))
    want = [tuple(r) for r in readers.idx_images(spark, str(folder)).orderBy("id").collect()]
    assert len(want) == 53
    for parts in (1, 8):
        found = spark.read.format("idx").option("partitions", parts).load(str(folder))
        assert found.rdd.getNumPartitions() == (2 if parts == 1 else 11)
        assert sorted(tuple(r) for r in found.collect()) == want
    assert [tuple(r) for r in spark.read.format("idx").load(f"file://{folder}/b").collect()] == [(i, x) for (_, x), i in zip(want[50:], range(3), strict=True)]


def test_broken_idx_files(spark, tmp_path):
    from denspark.sources import datasource

    datasource.register(spark)
    whole = idx_file(5, 2, 2)
    for content, message in ((whole[:-1], "ends before"), (b"\0" * 16, "magic"), (b"", "header")):
        (tmp_path / "x").write_bytes(content)
        with pytest.raises(Exception, match=message):
            spark.read.format("idx").load(str(tmp_path / "x")).collect()


def test_generated_points_by_ranges(spark):
    from denspark.sources import datasource

    datasource.register(spark)
    make = lambda parts, **more: sorted(tuple(r) for r in spark.read.format("points").options(n=500, dimension=3, partitions=parts, **more).load().collect())
    assert make(1) == make(8) != make(8, seed=1)
    assert all(0 <= v <= 1 for _, item, _ in make(3) for v in item)
    blobs = make(4, clusters=5)
    assert blobs == make(1, clusters=5) and {x[2] for x in blobs} == set(range(5))
    with pytest.raises(Exception, match="positive"):
        make(1, clusters=-1)


def stored(width=3, child=True, field=True, kind="float", rows=5, name="features", groups=2):
    """Bytes of a Parquet file; ``child`` and ``field``: whether elements and rows must not be null."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    value = pa.field("item", pa.float32() if kind == "float" else pa.float64(), nullable=not child)
    list_type = pa.list_(value, width) if width is not None else pa.list_(value)
    data = pa.array([[float(i * 10 + j) for j in range(width or 2)] for i in range(rows)], list_type)
    sink = pa.BufferOutputStream()
    pq.write_table(pa.Table.from_arrays([data], schema=pa.schema([pa.field(name, list_type, nullable=not field)])), sink, row_group_size=groups)
    return sink.getvalue().to_pybytes()


def test_parquet_from_bytes(spark, tmp_path):
    from denspark.sources import contract

    files = spark.createDataFrame([("b", stored(rows=2)), ("a", stored(rows=5))], "name string, content binary").repartition(2)
    got = contract.vectors_from_bytes(files).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(7))
    assert [r["item"][0] for r in got] == [0.0, 10.0, 20.0, 30.0, 40.0, 0.0, 10.0]
    (tmp_path / "x.parquet").write_bytes(stored())
    assert contract.check_parquet(spark, str(tmp_path)) == 3
    assert readers.vectors_from_parquet(spark, str(tmp_path / "x.parquet"), strict=True).count() == 5


@pytest.mark.parametrize(("more", "code"), [({"field": False}, "NULL_ROW"), ({"child": False}, "NULL_VALUE"), ({"kind": "double"}, "INVALID_LIST_VALUE_TYPE"), ({"width": None}, "INVALID_COLUMN_TYPE"), ({"name": "other"}, "COLUMN_NOT_FOUND"), ({"rows": 0}, "EMPTY_INPUT")])
def test_field_contract(spark, tmp_path, more, code):
    from denspark import errors
    from denspark.sources import contract

    content = stored(**more)
    with pytest.raises(errors.INGEST[code]):
        contract.vectors_from_bytes(spark.createDataFrame([("a", content)], "name string, content binary"))
    (tmp_path / "x.parquet").write_bytes(content)
    with pytest.raises(errors.INGEST[code]):
        readers.vectors_from_parquet(spark, str(tmp_path / "x.parquet"), strict=True)


def test_files_of_different_width(spark):
    from denspark import errors
    from denspark.sources import contract

    files = spark.createDataFrame([("a", stored(3)), ("b", stored(4))], "name string, content binary")
    with pytest.raises(errors.INGEST["INVALID_ROW_LENGTH"]):
        contract.vectors_from_bytes(files)

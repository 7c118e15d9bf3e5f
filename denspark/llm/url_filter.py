r"""URL filters: a sort-merge range join of addresses with host and path rules.

A canonical key is the host with its labels reversed, a zero byte, and the path, so a rule is
the interval of keys that begin with its own. Each address gives one key for every ending of
its host that has as many labels as some rule's host. Rules and keys are range-partitioned and
sorted together (with a hash of the row, so a popular address is spread over tasks); each task
sweeps its keys once with a stack of the rules that are still active, innermost on top. Rules
that began in an earlier partition are exactly those that the partition's first key begins
with; it is looked up at the lengths that rules have, and one short list per partition is handed
to the sweep. Keys are cut at the longest rule's length, so a very long address costs no more.

Defined cases: a null address or one without ``://`` has an empty host and path and no rule;
repeated rows each get their result; the longest fitting rule wins (then the longer host, then
the smaller); without a rule the verdict is ``default``; an empty table gives an empty result;
further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from denspark.lineage import cut

#: Fixed values: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SCHEMA = "row long, size int, host_size int, rule string, verdict string"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of an address."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(1 << 30))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.reverse(labels), "."), F.lit("\0"), path)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """(key, rule, verdict, size, host_size, labels) of literal rules; of equal ones the first counts."""
    rows = {(host, path): verdict for verdict, host, path in reversed(rules)}
    out = spark.createDataFrame([(h, p, v) for (h, p), v in rows.items()], "host string, path string, verdict string")
    labels = F.split("host", "[.]")
    return out.select(_key(labels, F.col("path")).alias("key"), F.concat("host", "path").alias("rule"), "verdict", F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"), F.size(labels).alias("labels"))


def _sweep(active: dict[int, list[tuple]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stack = None, []
        for batch in batches:
            out = []
            for pid, key, row, rule in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if pid != part:
                    part, stack = pid, list(active.get(pid, []))
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if row is None:
                    stack.append((key, rule["size"], rule["host_size"], rule["rule"], rule["verdict"]))
                elif stack:
                    out.append((row, *stack[-1][1:]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["row", "size", "host_size", "rule", "verdict"])

    return run


def url_filter(pages: DataFrame, rules: DataFrame | None = None, default: str = "allow", url: str = "url") -> DataFrame:
    """page_id, host, path, rule (or null) and verdict of every address. ``rules``: as :func:`rule_table` gives."""
    spark = pages.sparkSession
    rules = rule_table(spark) if rules is None else rules
    host, path = split_url(F.col(url))
    rows = cut(pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id()))
    # Different numbers of labels in the rules' hosts, and lengths of their keys: small numbers, never the rules themselves.
    depths = [x["labels"] for x in rules.select("labels").distinct().orderBy("labels").collect()]
    sizes = [x["n"] for x in rules.select(F.length("key").alias("n")).distinct().orderBy("n").collect()]
    labels = F.split("host", "[.]")
    ends = F.filter(F.lit(depths).cast("array<int>"), lambda n: n <= F.size(labels)) if depths else F.lit([]).cast("array<int>")
    keys = rows.select("row", "path", labels.alias("labels"), F.explode(ends).alias("n"))
    # What follows the longest rule's length decides nothing, so keys end there, however long an address is.
    key = F.left(_key(F.slice("labels", F.size("labels") - F.col("n") + 1, F.col("n")), F.col("path")), F.lit(sizes[-1] if sizes else 0))
    keys = keys.select(key.alias("key"), "row", F.lit(None).cast("struct<size:int,host_size:int,rule:string,verdict:string>").alias("rule"))
    starts = rules.select("key", F.lit(None).cast("long").alias("row"), F.struct("size", "host_size", "rule", "verdict").alias("rule"))
    # A rule stands before the addresses of its key: nulls come first.
    events = keys.unionByName(starts).withColumn("salt", F.when(F.col("row").isNotNull(), F.xxhash64("row")))
    events = events.repartitionByRange("key", "salt").sortWithinPartitions("key", "salt")
    events = cut(events.select(F.spark_partition_id().alias("pid"), "key", "row", "rule"))
    # One row per partition, then its active rules: as many as rules nest.
    first = events.groupBy("pid").agg(F.min("key").alias("first"))
    fitting = F.filter(F.lit(sizes).cast("array<int>"), lambda n: n <= F.length("first")) if sizes else F.lit([]).cast("array<int>")
    begins = first.select("pid", F.explode(F.transform(fitting, lambda n: F.left(F.col("first"), n))).alias("key"))
    carried = begins.join(starts.select("key", "rule"), "key").join(first, "pid").where("key <= first").orderBy("pid", "key").collect()
    active: dict[int, list[tuple]] = {}
    for x in carried:
        active.setdefault(x["pid"], []).append((x["key"], x["rule"]["size"], x["rule"]["host_size"], x["rule"]["rule"], x["rule"]["verdict"]))
    hits = events.mapInArrow(_sweep(active), _SCHEMA)
    best = hits.groupBy("row").agg(F.max_by(F.struct("rule", "verdict"), F.struct("size", "host_size", "rule")).alias("best"))
    return rows.join(best, "row", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (
  SELECT *, CASE WHEN '.' || host LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN '.' || host LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN '.' || host LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN '.' || host LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

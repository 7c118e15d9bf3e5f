r"""Filter interaction audit: what five filters remove in each of their 120 orders, alone, first and in vain.

1. One Arrow pass over the texts' buffers: byte classes and prefix sums give words, capitals, symbols and
   code points of all texts of a slice at once. Word hashes are sorted within each text; neighbours of
   equal hash are held against each other byte by byte, so distinct words are exact. A text becomes
   a mask of the filters it fails and its sha256.
2. A text fails the last filter if a smaller doc_id has the same text: rows are combined by (digest,
   doc_id, part, mask), and the least id of each digest is joined back by digest and id, so that
   a group of copies is dealt over tasks however large it is.
3. Rows are added up by part and mask (combined before the shuffle). What a part loses in any order
   follows from its 32 masks: a product with fixed tables of ones, one column for each order and step.

Shapley values need no orders: of the k filters that a text fails each comes first in 120 / k orders.

Defined cases: null text is empty; a null source is the part ``''``; a null doc_id neither has an
earlier copy nor is one, and has no labels; rows equal in id and text count each, none of them as a copy of
another; of several labels of an id any that is 1 counts; empty documents give an empty result; further columns
play no part; long texts are judged whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from denspark.lineage import table
from denspark.llm import textops

FILTERS = "ABCDE"
#: Least words, least percent of distinct words, most percent of capitals.
WORDS, DISTINCT, CAPITALS = 50, 65, 5
#: Bytes that no text may hold.
SYMBOLS = b"#$%&*|"
#: Bytes of words that are compared at once, and lots over which rows without an id are dealt.
COMPARED, LOTS = 1 << 20, 1 << 10
_CAPITAL, _SYMBOL = np.zeros(256, bool), np.zeros(256, bool)
_CAPITAL[65:91] = True
_SYMBOL[list(SYMBOLS)] = True
_SCANNED = "doc_id long, part string, n_words long, n_distinct long, n_capitals long, n_chars long, n_symbols long, failed int, digest binary"


def same_words(raw: np.ndarray, words: textops.Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the words numbered ``a`` and ``b`` are equal byte by byte."""
    size = words.ends[a] - words.starts[a]
    equal = size == words.ends[b] - words.starts[b]
    at = np.flatnonzero(equal)
    ends = np.cumsum(size[at])
    while len(at):
        n = max(1, int(np.searchsorted(ends - ends[0] + size[at[0]], COMPARED, "right")))
        now, length = at[:n], size[at[:n]]
        start = np.cumsum(length) - length
        place = np.arange(int(length.sum())) - np.repeat(start, length)
        differs = raw[np.repeat(words.starts[a[now]], length) + place] != raw[np.repeat(words.starts[b[now]], length) + place]
        equal[now] = ~np.logical_or.reduceat(differs, start)
        at, ends = at[n:], ends[n:]
    return equal


def distinct_words(raw: np.ndarray, words: textops.Words) -> np.ndarray:
    """Number of different words of each text, from sorted hashes that the words themselves confirm."""
    n = np.diff(words.bounds)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((words.hashes, doc))
    alike = np.flatnonzero((words.hashes[order[1:]] == words.hashes[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])) + 1
    a, b = order[alike - 1], order[alike]
    out = n - np.bincount(doc[b], minlength=len(n))
    for d in np.unique(doc[b][~same_words(raw, words, a, b)]).tolist():
        # Different words of one hash: these texts are counted by their words.
        whole = raw.tobytes()
        own = range(words.bounds[d], words.bounds[d + 1])
        out[d] = len({whole[words.starts[i] : words.ends[i]] for i in own})
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _SCANNED.split(", ")]
    for batch in batches:
        ids, part = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "part"))
        for row, raw, offs in textops.slices(textops.text_column(batch)):
            words = textops.Words(raw, offs, lower=False)
            n = np.diff(words.bounds)
            distinct = distinct_words(raw, words)
            capitals, symbols, chars = (textops.sums_by(x, offs) for x in (_CAPITAL[raw], _SYMBOL[raw], textops.code_points(raw)))
            fails = (n < WORDS, 100 * distinct < DISTINCT * n, 100 * capitals > CAPITALS * chars, symbols > 0)
            failed = sum(x.astype(np.int32) << i for i, x in enumerate(fails))
            whole = raw.tobytes()
            digest = [hashlib.sha256(whole[a:b]).digest() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            counts = [pa.array(x, pa.int64()) for x in (n, distinct, capitals, chars, symbols)]
            yield pa.RecordBatch.from_arrays([ids.slice(row, len(n)).cast(pa.int64()), part.slice(row, len(n)).cast(pa.string()), *counts, pa.array(failed, pa.int32()), pa.array(digest, pa.binary())], names=names)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: its part, counts, the mask ``failed`` of the filters A to D (bit 0 is A) and its text's sha256."""
    return docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), "text").mapInArrow(_scan, _SCANNED)


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, n, good, toxic): documents of each part by the mask of all five filters, and those labelled so."""
    rows = table(scan(docs).groupBy("digest", "doc_id", "part", "failed").agg(F.count("*").alias("n")))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    judged = rows.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", (F.col("failed") + F.when(copy, 1 << 4).otherwise(0)).alias("failed"), "n", F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.xxhash64("digest"), F.lit(LOTS))).otherwise(0).alias("lot"))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("is_good"), F.max((F.col("toxic") == 1).cast("int")).alias("is_toxic"))
    known = known.select(F.col("doc_id").alias("of"), F.lit(0).cast("long").alias("lot"), "is_good", "is_toxic")
    both = judged.withColumn("of", F.coalesce("doc_id", F.lit(0))).join(known, ["of", "lot"], "left")
    labelled = [F.sum(F.when(F.col(f"is_{c}") == 1, F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")]
    return both.groupBy("part", "failed").agg(F.sum("n").alias("n"), *labelled)


ORDERS = ["".join(x) for x in permutations(FILTERS)]


def effects() -> dict[str, np.ndarray]:
    """What a document of each mask (32 rows) counts as in each order and step (600 columns)."""
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    own = np.array([bit[f] for order in ORDERS for f in order])
    before = np.array([sum(bit[f] for f in order[:s]) for order in ORDERS for s in range(len(FILTERS))])
    mask = np.arange(1 << len(FILTERS))[:, None]
    fails, gone = (mask & own) > 0, (mask & before) > 0
    share = len(ORDERS) // np.maximum(np.bitwise_count(mask), 1)
    return {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": mask == own, "shapley": fails * share}


_AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = {k: x.astype(np.int64) for k, x in effects().items()}
    names = [x.split()[0] for x in _AUDIT.split(", ")]
    steps = len(FILTERS)
    order = pa.array([o for o in ORDERS for _ in range(steps)])
    step = pa.array(np.tile(np.arange(1, steps + 1), len(ORDERS)), pa.int32())
    for batch in batches:
        for part, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts = np.zeros((3, 1 << steps), np.int64)
            for x in own:
                counts[:, x["failed"]] = x["n"], x["good"], x["toxic"]
            n, good, toxic = counts
            sums = [n @ tables["kept"], n @ tables["removed"], n @ tables["redundant"], n @ tables["unique_fails"], good @ tables["removed"], toxic @ tables["removed"], n @ tables["shapley"]]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(order)), order, step, *(pa.array(x) for x in sums)], names=names)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, zeros included."""
    # At most 32 masks of a part meet in one row.
    parts = masks(docs, labels).groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("masks"))
    return parts.mapInArrow(_reduce, _AUDIT)


ORACLE_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
least_id AS (SELECT text, min(doc_id) AS first_id FROM d GROUP BY text),
known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
j AS MATERIALIZED (
  SELECT d.part, coalesce(known.good, 0) AS good, coalesce(known.toxic, 0) AS toxic,
         {'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w), 'C': 100 * length(regexp_replace(d.text, '[^A-Z]+', '', 'g')) > 5 * length(d.text),
          'D': regexp_matches(d.text, '[#$%&*|]'), 'E': coalesce(d.doc_id > first_id, FALSE)} AS f
  FROM d JOIN least_id USING (text) LEFT JOIN known ON known.doc_id = d.doc_id),
g AS MATERIALIZED (
  SELECT part, (CASE WHEN f.A THEN 'A' ELSE '' END) || (CASE WHEN f.B THEN 'B' ELSE '' END) || (CASE WHEN f.C THEN 'C' ELSE '' END) || (CASE WHEN f.D THEN 'D' ELSE '' END) || (CASE WHEN f.E THEN 'E' ELSE '' END) AS fails,
         count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM j GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS own, filter_order[1:step - 1] AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (
  SELECT part, filter_order, step, own,
         sum(CASE WHEN translate(fails, earlier || own, '') = fails THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN contains(fails, own) AND translate(fails, earlier, '') = fails THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN contains(fails, own) AND translate(fails, earlier, '') <> fails THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN fails = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN contains(fails, own) AND translate(fails, earlier, '') = fails THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN contains(fails, own) AND translate(fails, earlier, '') = fails THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM g, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""

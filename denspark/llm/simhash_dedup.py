r"""SimHash near-dedup by a Gray-order hierarchical index.

1. One Arrow pass turns each text into a 64-bit fingerprint: the majority of the bits of the XXH64 hashes of
   its word shingles. Only (doc_id, fingerprint) is kept, and equal fingerprints become one.
2. Different fingerprints are sorted by Gray rank, in which neighbours differ in few bits, range by range.
   ``BLOCK`` consecutive ones are a block: a node that keeps the bits that all of them share, as a mask and
   a pattern. ``FAN`` consecutive nodes have a node above them that takes over what these share in turn.
3. The index meets itself from the top down: two nodes are at least as far apart as the bits in which
   their shared patterns differ. Differences are accumulated on the way: a level adds only those among
   bits that the levels above didn't share yet. Whole groups drop out as soon as there are over ``REACH``.
   Above the blocks a level is a table, and a step two joins on the parents' numbers; two blocks that
   are left are one row and one task's work, which goes on in the same way down to single fingerprints.
4. A pair of blocks gives the edges of a forest of its links, so pairs inside a group of near copies are never
   rows: at most one edge leaves it for each fingerprint. Classes follow by contraction, and documents take
   their class over from their fingerprint.

No link is missed and none is a guess: the index only leaves out what the bits that a group shares rule out.

The time of step 3 grows faster than the number of different fingerprints, but less than its square: twice as many
share one bit more in each node, and 64 pairs of children are looked at where their parents come near.

Defined cases: null and empty texts and texts of white space have fingerprint zero and link like any other;
with fewer than ``SIZE`` words all of them are one shingle; repeated rows and equal texts share a
fingerprint; a null doc_id takes part in links and gets the smallest doc_id of its class, null if there
is none; an empty table gives an empty result; further columns play no part; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from denspark.lineage import cut, table
from denspark.llm import textops
from denspark.operators.components import connected_components
from denspark.sources.readers import number_rows

#: Words of a shingle, seed of its hash, most bits in which linked fingerprints differ.
SIZE, SEED, REACH = 4, 42, 4
#: Children of a node, and levels and fingerprints of a block.
FAN, HEIGHT = 8, 5
BLOCK = FAN**HEIGHT
#: Shingles that are hashed at once, and pairs of nodes that a task opens at once.
HASHED, OPENED = 1 << 16, 1 << 12
_U = np.uint64
_ALL = ~_U(0)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[list(textops.SPACES)] = 32
_WORD = np.ones(256, bool)
_WORD[list(textops.SPACES)] = False


def shingle_hashes(raw: np.ndarray, offs: np.ndarray, size: int = SIZE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, hash) of the word shingles of a slice, HASHED at a time, in order."""
    words = textops.Words(raw, offs)
    if not len(words.starts):
        return
    word = _WORD[raw]
    # Words with one space behind each: what follows a word's last byte stays.
    keep = word.copy()
    keep[1:] |= word[:-1]
    data = _LOWER[raw[keep]].tobytes()
    place = np.cumsum(keep) - 1
    starts, ends = place[words.starts], place[words.ends - 1] + 1
    n = np.diff(words.bounds)
    many = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), many)
    first = np.arange(len(doc)) + np.repeat(words.bounds[:-1] - (np.cumsum(many) - many), many)
    last = np.minimum(first + size, words.bounds[1:][doc]) - 1
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(doc), HASHED):
        own = slice(at, at + HASHED)
        yield doc[own], np.array([digest(data[a:b], SEED) for a, b in zip(starts[first[own]].tolist(), ends[last[own]].tolist(), strict=True)], _U)


def fingerprints(raw: np.ndarray, offs: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The fingerprint of each text of a slice: bits that are set in over half of its hashes."""
    ones, total = np.zeros((len(offs) - 1, 64), np.int64), np.zeros(len(offs) - 1, np.int64)
    for doc, hashes in shingle_hashes(raw, offs, size):
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        ones[doc[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
        total += np.bincount(doc, minlength=len(total))
    return np.packbits(2 * ones > total[:, None], axis=1).view(">u8").ravel().astype(_U)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(_U).view(np.int64))


def _fingerprinted(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for row, raw, offs in textops.slices(textops.text_column(batch)):
                yield pa.RecordBatch.from_arrays([ids.slice(row, len(offs) - 1).cast(pa.int64()), _signed(fingerprints(raw, offs, size))], names=["doc_id", "print"])

    return run


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code in Gray order."""
    rank = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> _U(shift)
    return rank


def gray_code(rank: np.ndarray) -> np.ndarray:
    """The code at each place."""
    return rank ^ (rank >> _U(1))


def shared(mask: np.ndarray, pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mask and pattern of what all nodes of each row share."""
    every, some = np.bitwise_and.reduce(pattern, 1), np.bitwise_or.reduce(pattern, 1)
    mask = np.bitwise_and.reduce(mask, 1) & ~(every ^ some)
    return mask, every & mask


class Tree:
    """The levels of a block, single fingerprints first: masks and patterns of its nodes, and how many there are."""

    def __init__(self, prints: np.ndarray):
        self.levels = [(np.full(len(prints), _ALL), prints, len(prints))]
        for _ in range(HEIGHT):
            mask, pattern, n = self.levels[-1]
            above = -(-n // FAN)
            # The last node stands for those that its parent lacks.
            own = np.minimum(np.arange(above * FAN), n - 1)
            mask, pattern, self.levels[-1] = mask[own], pattern[own], (mask[own].reshape(-1, FAN), pattern[own].reshape(-1, FAN), n)
            self.levels.append((*shared(mask.reshape(-1, FAN), pattern.reshape(-1, FAN)), above))


def links(a: Tree, b: Tree, same: bool, reach: int = REACH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j): places of the linked fingerprints of two blocks (i < j if they are the same one)."""
    top = a.levels[HEIGHT][0][:1] & b.levels[HEIGHT][0][:1]
    apart = np.bitwise_count((a.levels[HEIGHT][1][:1] ^ b.levels[HEIGHT][1][:1]) & top).astype(np.int64)
    stack = [(HEIGHT, np.zeros(1, np.int64), np.zeros(1, np.int64), apart, top)] if apart[0] <= reach else []
    child = np.arange(FAN)
    while stack:
        level, i, j, apart, known = stack.pop()
        (mask_a, own_a, n_a), (mask_b, own_b, n_b) = a.levels[level - 1], b.levels[level - 1]
        both = mask_a[i][:, :, None] & mask_b[j][:, None, :]
        fresh = (own_a[i][:, :, None] ^ own_b[j][:, None, :]) & both & ~known[:, None, None]
        total = apart[:, None, None] + np.bitwise_count(fresh)
        p, x, y = np.nonzero(total <= reach)
        total, both = total[p, x, y], both[p, x, y]
        i, j = i[p] * FAN + child[x], j[p] * FAN + child[y]
        keep = (i < n_a) & (j < n_b)
        if same:
            keep &= i < j if level == 1 else i <= j
        i, j, total, both = i[keep], j[keep], total[keep], both[keep]
        if level == 1:
            if len(i):
                yield i, j
            continue
        stack += [(level - 1, i[at : at + OPENED], j[at : at + OPENED], total[at : at + OPENED], both[at : at + OPENED]) for at in range(0, len(i), OPENED)]


def join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each the least place of its class) after the classes of ``i`` and ``j`` are joined."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of fingerprints from sorted Gray ranks (with the sign bit turned)."""

    def block(rank: np.ndarray) -> pa.RecordBatch:
        own = gray_code(rank.view(_U) ^ _U(1 << 63))
        mask, pattern = shared(np.full((1, len(own)), _ALL), own[None])
        return pa.RecordBatch.from_arrays([pa.array(rank[:1]), _signed(mask), _signed(pattern), pa.array([own.tobytes()], pa.binary())], names=["first", "mask", "pattern", "prints"])

    held, n = [], 0
    for batch in batches:
        rank = batch.column(0).to_numpy()
        while n + len(rank) >= BLOCK:
            yield block(np.concatenate([*held, rank[: BLOCK - n]]))
            held, n, rank = [], 0, rank[BLOCK - n :]
        if len(rank):
            held.append(rank)
            n += len(rank)
    if n:
        yield block(np.concatenate(held))


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([_signed(gray_rank(batch.column(0).to_numpy().view(_U)) ^ _U(1 << 63))], names=["rank"])


def _forest(reach: int):
    """(source, target): edges of a forest of the links of each pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, left, right in zip(*(batch.column(k) for k in range(3)), strict=True):
                same = same.as_py()
                a = np.frombuffer(left.as_py(), _U)
                b = a if same else np.frombuffer(right.as_py(), _U)
                tree = Tree(a)
                both = a if same else np.concatenate([a, b])
                label = np.arange(len(both))
                for i, j in links(tree, tree if same else Tree(b), same, reach):
                    label = join_labels(label, i, j if same else j + len(a))
                at = np.flatnonzero(label != np.arange(len(both)))
                if len(at):
                    yield pa.RecordBatch.from_arrays([_signed(both[at]), _signed(both[label[at]])], names=["source", "target"])

    return run


def near_blocks(nodes: DataFrame, n: int, reach: int = REACH) -> DataFrame:
    """(a, b), a <= b: numbers of the blocks that can hold a link, from the top of the index down.

    ``nodes``: id (0 to n - 1 in Gray order), mask, pattern.
    """
    levels = [nodes.select("id", "mask", "pattern")]
    while n > 1:
        n = -(-n // FAN)
        every, some = F.bit_and("pattern"), F.bit_or("pattern")
        above = levels[-1].groupBy(F.floor(F.col("id") / FAN).alias("id")).agg(F.bit_and("mask").alias("mask"), every.alias("pattern"), every.bitwiseXOR(some).alias("differ"))
        mask = F.col("mask").bitwiseAND(F.bitwise_not("differ"))
        levels.append(cut(above.select("id", mask.alias("mask"), F.col("pattern").bitwiseAND(mask).alias("pattern"))))
    root = levels.pop()
    pairs = root.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0).alias("apart"), F.col("mask").alias("known"))
    for level in reversed(levels):
        x, y = (level.select(F.floor(F.col("id") / FAN).alias(up), F.col("id").alias(f"{up}2"), F.col("mask").alias(f"m{up}"), F.col("pattern").alias(f"p{up}")) for up in "ab")
        both = F.col("ma").bitwiseAND(F.col("mb"))
        fresh = F.bit_count(F.col("pa").bitwiseXOR(F.col("pb")).bitwiseAND(both).bitwiseAND(F.bitwise_not("known")))
        pairs = pairs.join(x, "a").join(y, "b").where("a2 <= b2")
        pairs = pairs.select(F.col("a2").alias("a"), F.col("b2").alias("b"), (F.col("apart") + fresh).alias("apart"), both.alias("known")).where(F.col("apart") <= reach)
    return pairs.select("a", "b")


def classes(prints: DataFrame, reach: int = REACH) -> DataFrame:
    """(node, component) of the fingerprints (print) that link with another; rows may repeat."""
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranks = prints.select("print").distinct().mapInArrow(_ranked, "rank long")
    blocks = table(ranks.repartitionByRange(parts, "rank").sortWithinPartitions("rank").mapInArrow(_blocks, "first long, mask long, pattern long, prints binary"))
    nodes = cut(number_rows(blocks.select("first", "mask", "pattern"), ["first"]))
    pairs = cut(near_blocks(nodes, nodes.count(), reach))
    held = blocks.select("first", "prints").join(nodes.select("first", "id"), "first")
    left, right = (held.select(F.col("id").alias(x), F.col("prints").alias(f"of_{x}")) for x in "ab")
    same = F.col("a") == F.col("b")
    rows = pairs.join(left, "a").join(right, "b").repartition(parts, "a", "b")
    rows = rows.select(same.alias("same"), "of_a", F.when(~same, F.col("of_b")).alias("of_b"))
    return connected_components(cut(rows.mapInArrow(_forest(reach), "source long, target long")))


def simhash_dedup(docs: DataFrame, size: int = SIZE, reach: int = REACH) -> DataFrame:
    """One row per document: doc_id, its fingerprint in hex, and the smallest doc_id of its class."""
    own = table(docs.select("doc_id", "text").mapInArrow(_fingerprinted(size), "doc_id long, print long"))
    least = own.groupBy("print").agg(F.min("doc_id").alias("least"))
    found = least.join(classes(own, reach), F.col("print") == F.col("node"), "left").select("print", "least", F.coalesce("component", "print").alias("class"))
    found = cut(found)
    smallest = found.groupBy("class").agg(F.min("least").alias("component_id"))
    of_print = found.join(smallest, "class").select(F.col("print").alias("of"), "component_id")
    rows = own.join(of_print, F.col("print") == F.col("of"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, size: int = SIZE, reach: int = REACH) -> DataFrame:
    """``docs`` without near copies: of each class the row with the smallest doc_id stays (nulls last; one of rows that tie
    in id and fingerprint). Columns of any name stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                text = batch.column(0).field("text").fill_null("")
                for row, raw, offs in textops.slices(text):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(offs) - 1), _signed(fingerprints(raw, offs, size))], names=["row", "print"])

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    kind = T.StructType([T.StructField("row", docs.select(row).schema["row"].dataType), T.StructField("print", T.LongType())])
    rows = table(docs.select(row).mapInArrow(run, kind))
    least = rows.groupBy("print").agg(F.min("row.doc_id").alias("id"))
    found = least.join(classes(rows, reach), F.col("print") == F.col("node"), "left")
    best = F.min_by(F.struct("print", "id"), F.struct(F.col("id").isNull(), "id", "print")).alias("best")
    chosen = found.groupBy(F.coalesce("component", "print")).agg(best).select(F.col("best.print").alias("of"), F.col("best.id").alias("id"))
    kept = rows.join(chosen, (F.col("print") == F.col("of")) & F.col("row")["doc_id"].eqNullSafe(F.col("id"))).dropDuplicates(["print"])
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])

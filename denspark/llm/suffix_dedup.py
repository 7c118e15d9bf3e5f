r"""Suffix-array dedup: bytes inside a ``SIZE``-byte string that also starts elsewhere are removed.

The transforms of shards are merged by interleave refinement:

1. Every ``SIZE``-byte window picks an anchor, the ``GRAM``-byte string with the least hash in it;
   equal windows pick equal anchors at equal distances. Anchors (about one in 70 bytes) are counted;
   where one occurs once, no window around it has an equal. That is all that hashes decide.
2. The stretches that the windows of the other anchors cover are the strings of the collection, and
   those with one anchor a block: equal windows lie in one block, at equal columns if stretches are
   aligned at the anchor. Each shard, a few MB of stretches, makes the Burrows-Wheeler transform of
   each of its blocks: for each column the symbols that stand before the sorted suffixes of the next
   one. Stretches that a shard holds twice, byte for byte, enter it once.
3. The transforms of all shards of a block are merged, without the stretches themselves and without
   sorting suffixes again: the interleaving of the shards' suffixes in one column follows from that of
   the next one by a stable sort on one symbol each, read from the transforms in turn. The longest
   common prefix of neighbours is one more than the least one between their places before, or 0.
   Suffixes whose common prefix with a neighbour reaches SIZE begin a repeated interval.

One shuffle counts anchors (8 bytes each, combined before it), one carries the transforms. A task
holds at most ``ROWS`` and one block's stretches at a time. A block whose anchor occurs over ``HOT``
times is split first: a shared window has half of what it holds beyond the block's common bytes on
one side of them at least, so the block's stretches are dealt once by that many more bytes on the left
and once on the right. What is still too large is split again, until the common bytes are a window
themselves; then every row of the block repeats that window, and no row has to be held against another.

Defined cases: null text is empty; texts shorter than SIZE keep everything; equal rows are
repeats of each other, so nothing of at least SIZE bytes is left of them; repeated or null ids do no
harm; an empty table gives an empty result; further columns play no part. Repeats are found by
comparing bytes; a stretch goes back to its texts by their 64-bit hash and length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from denspark.lineage import bounded_batches, cut, table
from denspark.llm import textops
from denspark.llm.bits import bit_table, held, table_size

SIZE, GRAM = 200, 64
#: Columns of an aligned stretch: places of a window before its anchor, and the window.
BEFORE = SIZE - GRAM
WIDTH = BEFORE + SIZE
#: Bytes of stretches in a shard, stretches merged at once, and stretches that a block may have before it is split.
SHARD, ROWS, HOT = 4_000_000, 1 << 15, 1 << 15
_U = np.uint64
_PLACE = 22
_BYTES = textops.mix(np.arange(1, 257, dtype=_U) * _U(0x2545F4914F6CDD1D))


def anchors(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(gram, document, anchor, first, last) of each anchor in a slice; the last three count bytes in the document."""
    n = len(raw)
    none = (np.zeros(0, _U),) + (np.zeros(0, np.int64),) * 4
    if n < SIZE:
        return none
    up, down = textops.powers(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum(_BYTES[raw] * up[:n], out=sums[1:])
    gram = textops.mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    width = BEFORE + 1
    best = np.empty(n - SIZE + 1, np.int64)
    step = (1 << _PLACE) - width
    for at in range(0, len(best), step):
        # Hash above, place below: the least is the leftmost of the least hashes. Running minima of
        # blocks of ``width`` from both sides give those of every window.
        part = gram[at : at + step + width - 1]
        part = (part & ~_U((1 << _PLACE) - 1)) | np.arange(len(part), dtype=_U)
        blocks = np.concatenate([part, np.full(-len(part) % width, ~_U(0))]).reshape(-1, width)
        left = np.minimum.accumulate(blocks, axis=1).ravel()
        right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        m = len(part) - width + 1
        least = np.minimum(right[:m], left[width - 1 : width - 1 + m])
        best[at : at + m] = (least & _U((1 << _PLACE) - 1)).astype(np.int64) + at
    ends = np.repeat(offs[1:], np.diff(offs))
    start = np.flatnonzero(np.arange(len(best)) + SIZE <= ends[: len(best)])
    if not len(start):
        return none
    best = best[start]
    new = np.ones(len(start), bool)
    new[1:] = (best[1:] != best[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    first, last, anchor = start[at], start[np.append(at[1:], len(start)) - 1], best[at]
    doc = np.searchsorted(offs, first, "right") - 1
    # Least hashes are alike in their high bits; spread them again.
    return textops.mix(gram[anchor]), doc, anchor - offs[doc], first - offs[doc], last - offs[doc]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == _U else x, pa.int64())


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors; those that a slice holds twice stand in it twice."""
    for batch in batches:
        for _, raw, offs in textops.slices(textops.text_column(batch)):
            yield pa.RecordBatch.from_arrays([_signed(anchors(raw, offs)[0])], names=["gram"])


class Stretches:
    """Different stretches of a shard with their owners: (text's hash, its length, place of the anchor and of its windows)."""

    def __init__(self):
        self.number: dict[tuple[bytes, int], int] = {}
        self.grams: list[int] = []
        self.owners: list[np.ndarray] = []
        self.bytes = 0

    def add(self, whole: bytes, key: np.ndarray, size: np.ndarray, gram: np.ndarray, begin: np.ndarray, anchor: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        """Stretches of a slice ``whole``, where they begin at ``begin``."""
        number, grams = self.number, self.grams
        rows = []
        for g, a, b, back in zip(gram.view(np.int64).tolist(), begin.tolist(), (begin + last - first + SIZE).tolist(), (anchor - first).tolist(), strict=True):
            known = (whole[a:b], back)
            i = number.get(known)
            if i is None:
                i = number[known] = len(grams)
                grams.append(g)
                self.bytes += b - a
            rows.append(i)
        place = anchor << 16 | (anchor - first) << 8 | (anchor - last)
        self.owners.append(np.stack([np.array(rows, np.int64), key, size, place]))

    def rows(self) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """gram, bytes and back of each stretch, whether it occurs again, and owners (row, hash, length, place), all by gram."""
        gram = np.array(self.grams, np.int64)
        order = np.argsort(gram, kind="stable")
        known = list(self.number)
        owners = np.concatenate(self.owners, axis=1)
        again = np.bincount(owners[0], minlength=len(gram)) > 1
        place = np.empty(len(gram), np.int64)
        place[order] = np.arange(len(gram))
        owners[0] = place[owners[0]]
        owners = owners[:, np.lexsort(owners[::-1])]
        owners = owners[:, np.concatenate([[True], (owners[:, 1:] != owners[:, :-1]).any(0)])]
        return gram[order], [known[i][0] for i in order.tolist()], np.array([known[i][1] for i in order.tolist()], np.int64), again[order], owners


def _open(bits: np.ndarray, hot_bits: np.ndarray, hot: bool):
    """Shards of the stretches whose anchors occur again: the hot ones as rows, the others as transforms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Stretches()
        for batch in batches:
            key = batch.column(batch.schema.get_field_index("key")).to_numpy()
            for row, raw, offs in textops.slices(textops.text_column(batch)):
                gram, doc, anchor, first, last = anchors(raw, offs)
                # A full table lets more stretches into the merge, never fewer.
                at = np.flatnonzero(held(bits, gram) & (held(hot_bits, gram) == hot))
                if len(at):
                    doc = doc[at]
                    own.add(raw.tobytes(), key[row + doc], np.diff(offs)[doc], gram[at], first[at] + offs[doc], anchor[at], first[at], last[at])
                if own.bytes >= SHARD:
                    yield (_hot_rows if hot else _transforms)(*own.rows())
                    own = Stretches()
        if own.grams:
            yield (_hot_rows if hot else _transforms)(*own.rows())

    return run


_OWNERS = "keys array<long>, sizes array<long>, places array<long>"
_HOT = f"gram long, back int, body binary, again boolean, {_OWNERS}"
_SHARDS = f"gram long, n int, symbols binary, rows array<int>, {_OWNERS}"


def _hot_rows(gram: np.ndarray, bodies: list[bytes], back: np.ndarray, again: np.ndarray, owners: np.ndarray) -> pa.RecordBatch:
    counts = np.bincount(owners[0], minlength=len(gram))
    return pa.RecordBatch.from_arrays([pa.array(gram), pa.array(back, pa.int32()), pa.array(bodies, pa.binary()), pa.array(again), *(_lists(x, counts, pa.int64()) for x in owners[1:])], names=["gram", "back", "body", "again", "keys", "sizes", "places"])


def aligned(bodies: list[bytes], back: np.ndarray) -> np.ndarray:
    """Stretches as rows, aligned at their anchors; bytes plus 1, 0 where a stretch has none (UTF-8 has no byte 255)."""
    out = np.zeros((len(bodies), WIDTH), np.uint8)
    sizes = np.array([len(x) for x in bodies], np.int64)
    ends = np.cumsum(sizes)
    column = np.arange(ends[-1] if len(ends) else 0) + np.repeat(BEFORE - back - (ends - sizes), sizes)
    out[np.repeat(np.arange(len(bodies)), sizes), column] = np.frombuffer(b"".join(bodies), np.uint8) + np.uint8(1)
    return out


def transform(symbols: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The transform of each block of rows: in column c of row k the symbol before the block's k-th suffix of column c + 1.

    ``block``: sorted block number of each row.
    """
    columns = np.ascontiguousarray(symbols.T)
    out = np.empty_like(columns)
    order, base = np.arange(len(symbols)), block.astype(np.int64) << 8
    for c in range(WIDTH - 1, -1, -1):
        out[c] = columns[c][order]
        order = order[np.argsort(base + out[c], kind="stable")]
    return np.ascontiguousarray(out.T)


def _transforms(gram: np.ndarray, bodies: list[bytes], back: np.ndarray, again: np.ndarray, owners: np.ndarray) -> pa.RecordBatch:
    """One row for each block of a shard: its transform, and the owners of its stretches (row number doubled, plus 1 if it occurs again)."""
    symbols = aligned(bodies, back)
    starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    sizes = np.diff(np.append(starts, len(gram)))
    block = np.repeat(np.arange(len(starts)), sizes)
    several = np.flatnonzero(np.repeat(sizes > 1, sizes))
    if len(several):
        symbols[several] = transform(symbols[several], block[several])
    counts = np.bincount(block[owners[0]], minlength=len(starts))
    rows = (owners[0] - starts[block[owners[0]]]) * 2 + again[owners[0]]
    ends = np.concatenate([[0], np.cumsum(sizes * WIDTH)]).astype(np.int32)
    data = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(symbols)])
    return pa.RecordBatch.from_arrays([pa.array(gram[starts]), pa.array(sizes, pa.int32()), data, _lists(rows, counts, pa.int32()), *(_lists(x, counts, pa.int64()) for x in owners[1:])], names=["gram", "n", "symbols", "rows", "keys", "sizes", "places"])


def _hot_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Transforms of the rows of each batch."""
    for batch in batches:
        if batch.num_rows:
            gram, back, again = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("gram", "back", "again"))
            bodies = batch.column(batch.schema.get_field_index("body")).to_pylist()
            lists = [batch.column(batch.schema.get_field_index(c)) for c in ("keys", "sizes", "places")]
            counts = np.diff(lists[0].offsets.to_numpy())
            order = np.argsort(gram, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            owners = np.stack([np.repeat(place, counts), *(x.flatten().to_numpy() for x in lists)])
            yield _transforms(gram[order], [bodies[i] for i in order.tolist()], back[order], again[order], owners[:, np.argsort(owners[0], kind="stable")])


def _between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of values[low+1 .. high], with minima over stretches of doubled length."""
    gap = high - low
    level = np.frexp(gap.astype(np.float64))[1] - 1
    out = np.empty(len(low), values.dtype)
    table_, k = values, 0
    while True:
        own = level == k
        if own.any():
            a, b = low[own] + 1, high[own] - (1 << k) + 1
            out[own] = np.minimum(table_[a], table_[b])
        if k >= int(level.max(initial=0)):
            return out
        table_ = np.minimum(table_[: -(1 << k)], table_[1 << k :])
        k += 1


def interleave(symbols: np.ndarray, block: np.ndarray, run: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First and last column (-1: none) at which each row's suffix shares SIZE symbols with another of its block.

    ``symbols``: transforms of runs of rows, as :func:`transform` gives them (a run of one row is that
    row); ``run`` and ``block``: sorted run and block number of each row, every row a run if ``run`` is
    left out. What is refined is the interleaving of the runs: which run each suffix of a block belongs
    to, in their common order. A run's suffixes keep their own order in it, so the next symbol of a run
    is the next one of its transform.
    """
    n = len(symbols)
    columns = np.ascontiguousarray(symbols.T)
    run = np.arange(n) if run is None else run
    start = np.searchsorted(run, run)
    several = np.zeros(n, bool)
    several[1:] = run[1:] == run[:-1]
    several[:-1] |= several[1:]
    mixed = bool(several.any())
    # By place in the common order: the row, the first row of its run, and whether its run has others.
    row, common = np.arange(n), np.zeros(n, np.int16)
    first, last = np.full(n, -1), np.full(n, -1)
    base = block.astype(np.int64) << 8
    for c in range(WIDTH - 1, -1, -1):
        slot = start
        if mixed:
            at = np.flatnonzero(several)
            of = start[at]
            by = np.argsort(of, kind="stable")
            ranked = of[by]
            nth = np.arange(len(at)) - np.searchsorted(ranked, ranked)
            slot = start.copy()
            slot[at[by]] += nth
        key = base + columns[c][slot]
        new = np.argsort(key, kind="stable")
        ranked = key[new]
        alike = np.flatnonzero((ranked[1:] == ranked[:-1]) & (ranked[1:] & 255 > 0)) + 1
        fresh = np.zeros(n, np.int16)
        if len(alike):
            fresh[alike] = np.minimum(_between(common, new[alike - 1], new[alike]) + 1, SIZE)
        row, start, common = row[new], start[new], fresh
        if mixed:
            several = several[new]
        if c <= BEFORE:
            at = np.flatnonzero(common >= SIZE)
            rows = np.unique(np.concatenate([row[at], row[at - 1]]))
            first[rows] = c
            last[rows] = np.where(last[rows] < 0, c, last[rows])
    return first, last


_SPANS = "key long, size long, start long, end long"


def _merge(most: int):
    """Spans of repeated intervals from transforms sorted by gram; blocks are merged ``most`` rows at a time, or one if it is larger."""

    def solve(parts: list) -> pa.RecordBatch:
        gram, n, symbols, counts, rows, keys, sizes, places = (np.concatenate([p[k] for p in parts]) for k in range(8))
        starts = np.cumsum(n) - n
        run = np.repeat(np.arange(len(n)), n)
        block = np.concatenate([[0], np.cumsum(gram[1:] != gram[:-1])])[run]
        others = np.flatnonzero(np.bincount(block)[block] > 1)
        first, last = np.full(len(run), -1), np.full(len(run), -1)
        if len(others):
            first[others], last[others] = interleave(symbols.reshape(-1, WIDTH)[others], block[others], run[others])
        own = np.repeat(starts, counts) + (rows >> 1)
        again, hit = (rows & 1).astype(bool), first[own] >= 0
        anchor = places >> 16
        start = np.where(again, anchor - (places >> 8 & 255), anchor + first[own] - BEFORE)
        end = np.where(again, anchor - (places & 255) + SIZE, anchor + last[own] - BEFORE + SIZE)
        at = np.flatnonzero(again | hit)
        return pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (keys, sizes, start, end)], names=["key", "size", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, count = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            gram = batch.column(0).to_numpy()
            change = np.flatnonzero(gram[1:] != gram[:-1]) + 1
            bounds = [0, *change.tolist(), len(gram)]
            n = batch.column(1).to_numpy()
            ends = np.concatenate([[0], np.cumsum(n)])
            at = 0
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                # Before a new block begins, what is held can be merged.
                if count + ends[a] - ends[at] >= most and (a > 0 or kept and kept[-1][0][-1] != gram[0]):
                    if a > at:
                        kept.append(_unpacked(batch.slice(at, a - at)))
                    yield solve(kept)
                    kept, count, at = [], 0, a
            kept.append(_unpacked(batch.slice(at)))
            count += int(ends[-1] - ends[at])
        if kept:
            yield solve(kept)

    return run


def _unpacked(part: pa.RecordBatch) -> tuple:
    """gram, n, symbols, owners of each block, and the owners: row, hash, length, place."""
    lists = [part.column(i) for i in range(3, 7)]
    symbols = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8)
    return part.column(0).to_numpy(), part.column(1).to_numpy().astype(np.int64), symbols, np.diff(lists[0].offsets.to_numpy()), *(x.flatten().to_numpy().astype(np.int64) for x in lists)


def split_hot(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Blocks of at most HOT rows, and (or None) the spans, as _SPANS, of rows in blocks that all share a window.

    ``rows``: as _HOT. A block of the result shares ``left`` bytes before and ``right`` bytes after its
    anchor; ``gram`` becomes the hash of all that it shares.
    """
    names = rows.columns
    rows = table(rows.select(*names, F.lit(0).alias("left"), F.lit(0).alias("right")))
    cold, known, lefts = [], 0, {0}
    while True:
        sizes = cut(rows.groupBy("gram", "left", "right").agg(F.count("*").alias("n")).where(F.col("n") > HOT))
        if sizes.isEmpty():
            return reduce(DataFrame.unionByName, [*cold, rows.select(*names)]), None
        cold.append(rows.join(sizes, ["gram", "left", "right"], "left_anti").select(*names))
        hot = rows.join(sizes, ["gram", "left", "right"])
        if known == BEFORE:
            # Over HOT rows share one window: each of them has it a second time, whatever else it holds.
            owner = hot.select("left", "right", F.explode(F.arrays_zip("keys", "sizes", "places")).alias("o"))
            anchor = F.shiftright("o.places", 16)
            same = owner.select(F.col("o.keys").alias("key"), F.col("o.sizes").alias("size"), (anchor - F.col("left")).alias("start"), (anchor + GRAM + F.col("right")).alias("end"))
            return reduce(DataFrame.unionByName, cold), same
        more = (BEFORE - known + 1) // 2
        known += more
        # What is reached from two sides comes from the right one only, so that no stretch meets itself.
        once = ~F.col("left").isin([x for x in lefts if x + more in lefts] or [-1])
        lefts |= {x + more for x in lefts}
        sides = F.explode(F.array(*[F.struct((F.col("left") + a).alias("left"), (F.col("right") + b).alias("right"), fits.alias("fits")) for a, b, fits in ((more, 0, once), (0, more, F.lit(True)))]))
        dealt = hot.select(*names, sides.alias("side")).select(*names, "side.*")
        dealt = dealt.where(F.col("fits") & (F.col("left") <= F.col("back")) & (F.col("back") + GRAM + F.col("right") <= F.length("body")))
        shared = F.substring("body", F.col("back") - F.col("left") + 1, F.col("left") + GRAM + F.col("right"))
        rows = table(dealt.withColumn("gram", F.xxhash64(shared, "left", "right")).drop("fits"))


def _bits(grams: DataFrame, n: int) -> np.ndarray:
    """A table of bits for n anchors."""
    size = table_size(n)
    return bit_table(grams.select(F.col("gram").bitwiseAND(size - 1).alias("cell")), size)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(key, size, start, end): the stretches of bytes to remove in texts of that xxhash64 and length, possibly overlapping."""
    bounded_batches(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    again = cut(docs.select("text").mapInArrow(_grams, "gram long").groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"))
    hot = again.where(F.col("n") > HOT)
    n_hot = hot.count()
    bits, hot_bits = _bits(again, again.count()), _bits(hot, n_hot)
    shards, same = texts.mapInArrow(_open(bits, hot_bits, False), _SHARDS), None
    if n_hot:
        cold, same = split_hot(texts.mapInArrow(_open(bits, hot_bits, True), _HOT))
        shards = shards.unionByName(cold.mapInArrow(_hot_shards, _SHARDS))
    spans = shards.repartition(parts, "gram").sortWithinPartitions("gram").mapInArrow(_merge(ROWS), _SPANS)
    return cut(spans if same is None else spans.unionByName(same))


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The union of stretches as maximal runs."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]]))
    return list(zip(starts[new].tolist(), ends[np.append(new[1:], len(starts)) - 1].tolist(), strict=True))


def _kept(text: bytes, spans: list) -> tuple[bytes, list[tuple[int, int]]]:
    runs = merged(np.array([x["start"] for x in spans], np.int64), np.array([x["end"] for x in spans], np.int64)) if spans else []
    out, at = [], 0
    for a, b in runs:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]]), runs


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            ids, texts, spans = (part.column(i) for i in range(3))
            rows = []
            for text, own in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
                raw = (text or "").encode()
                left, runs = _kept(raw, own)
                rows.append((len(raw), len(raw) - len(left), len(runs), hashlib.sha256(left).hexdigest()))
            n, removed, runs, digest = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` as struct ``row`` with its ``spans``; the text is shuffled once, by its hash."""
    # Sets: the tasks combine what copies of a text say of it.
    spans = repeated_spans(docs).groupBy("key", "size").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(text).alias("of"), F.octet_length(text).cast("long").alias("n"))
    return rows.join(spans, (F.col("of") == F.col("key")) & (F.col("n") == F.col("size")), "left").select("row", "spans")


def dedup_report(docs: DataFrame) -> DataFrame:
    """One row per document: bytes, bytes and runs removed, and the digest of what is left."""
    return _with_spans(docs.select("doc_id", "text")).select("row.doc_id", "row.text", "spans").mapInArrow(_digest, _RESULT)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text``; bytes that are no longer UTF-8 become U+FFFD."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else _kept(t.encode(), s)[0].decode("utf-8", "replace") for t, s in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            columns = [pa.array(texts, batch.schema.field(at).type) if i == at else c for i, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    at, name = docs.columns.index("text"), "spans"
    while name in docs.columns:
        name += "_"
    return _with_spans(docs).select("row.*", F.col("spans").alias(name)).mapInArrow(clean, docs.schema)

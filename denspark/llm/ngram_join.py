r"""N-gram Jaccard join with adaptive multi-match prefixes, and its classes of linked documents.

Documents are sets of 5-word shingles; two link when their Jaccard similarity is at least
``SHARE`` percent. The join works on distinct sets (documents with equal sets are one node):

1. Tokens get a global order, rarest first, from counts over all documents in a table of fixed
   size (an estimate only orders tokens; any order is right).
2. A set of n tokens that must share o = ceil(n * SHARE / 100) of them with a partner keeps its
   first n - o + m tokens. Partners then share at least min(m, m') prefix tokens. Each set
   lengthens its prefix (m from 1 to ``MOST_MATCHES``) to where the estimated cost of
   scanning its lists and verifying the candidates left is least: sets made of common tokens
   ask for more matches before a candidate counts.
3. Lists of one set are dropped as they stream out of the shuffle. Every list first pairs its
   sets with ``CENTRES`` centres only, and every set tries the ``CENTRES`` it meets most often, if
   often enough, so a large group of near copies costs its size and not its square; verified pairs
   are contracted to classes.
4. Lists that still hold several classes are compared across classes (long ones block
   against block, dealt over tasks by pairs of groups of ``TOGETHER`` blocks); pairs with enough matches
   are verified. No link between different classes can be missed, so the classes are exact.

5. Links are counted inside the classes: a class travels in blocks of ``ROWS`` sets, a task holds one block, in
   parts of ``PART``, and counts the tokens that its sets share with those of another as they stream past; what
   leaves it is one number a set. A set travels once for each block of its class, once if there is only one.
   So every link between different texts is verified and counted, and no pair is ever a row.

Verification looks at sizes, then at parity bitmaps of ``BITMAP`` bits (sets that differ in d
tokens differ in at most d bits, so the test loses nothing; sets of over ``LONG`` tokens have a
larger one besides), and at last intersects the sets
themselves, which are made and shuffled only for pairs that got that far.

Words, sets and prefixes come from one Arrow pass each.

Defined cases: null or empty text, or text without words, has an empty set, links with nothing
and keeps its own doc_id as component; fewer than five words make one token of the whole
sequence; repeated rows and equal texts share a node and are linked with each other; a null doc_id takes part in links and
gets the smallest doc_id of its class, null if there is none; an empty table gives an empty
result; further columns play no part. Nodes and tokens are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from denspark.lineage import bounded_batches, cut, table
from denspark.llm import textops
from denspark.llm.bits import added_up, bit_table, held, table_size
from denspark.operators.components import connected_components

SIZE, SHARE = 5, 80
#: Cells of the table of counts and of one of its blocks, most matches a prefix may ask for, centres of a list.
CELLS, BLOCK, MOST_MATCHES, CENTRES = 1 << 20, 1 << 16, 4, 3
#: Cost of verifying one candidate, per token of the set, in scanned list entries.
VERIFY = 0.05
#: Bits of a set's parity bitmap, and tokens of a set that has a larger one.
BITMAP, LONG = 1024, 1500
#: Members of a list that travel in one block, blocks that a task compares with as many, and members of a list that gives its pairs at once.
MEMBERS, TOGETHER, SHORT = 2048, 8, 16
#: Sets and tokens of a block whose links are counted, sets of its parts, sets that are held against a part at once, and columns of a table of both.
ROWS, TOKENS, PART, CHUNK, WIDTH = 8192, 1 << 22, 1024, 256, 4096
_U = np.uint64

#: The same rows without prefixes: every pair that shares a shingle. For small tables.
ORACLE_SQL = r"""
WITH RECURSIVE texts AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM texts WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT r, count(*) AS n FROM shingles GROUP BY r),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.r <> b.r GROUP BY a.r, b.r),
links AS MATERIALIZED (
  SELECT a, b FROM common JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT r AS a, r AS b FROM texts UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
classes AS (SELECT a, min(doc_id) AS component_id FROM reach JOIN texts ON b = r GROUP BY a),
degrees AS (SELECT a, count(*) AS k FROM links GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(k, 0) AS n_links
FROM texts JOIN classes ON classes.a = texts.r LEFT JOIN sizes ON sizes.r = texts.r LEFT JOIN degrees ON degrees.a = texts.r
"""


def node_of(tokens: np.ndarray) -> np.uint64:
    """Hash of a set of tokens."""
    return textops.mix(np.array([textops.mix(tokens ^ _U(0xA5A5A5A5)).sum() + _U(len(tokens))], _U))[0]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        for row, raw, offs in textops.slices(textops.text_column(batch)):
            found = textops.shingle_sets(raw, offs, SIZE)
            yield ids.slice(row, len(found)), found


def _signed(values) -> pa.Array:
    return pa.array(np.asarray(values, _U).view(np.int64))


def bitmap(tokens: np.ndarray, bits: int = BITMAP) -> np.ndarray:
    """Parity of the tokens that fall on each of ``bits`` bits."""
    odd = np.bincount((tokens >> _U(40)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def long_bitmap(tokens: np.ndarray) -> np.ndarray | None:
    """A bitmap for sets of over LONG tokens, where BITMAP bits are too few: 8 times the bits for 8 times the tokens."""
    if len(tokens) <= LONG:
        return None
    bits = 8 * BITMAP
    while len(tokens) > 8 * LONG * bits // (8 * BITMAP):
        bits *= 8
    return bitmap(tokens, min(bits, 1 << 24))


_SIGNED = "block int, doc_id long, n long, node long, bits array<long>, more array<long>, counts binary"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block null) of documents, and blocks of the table of token counts."""
    total = np.zeros(CELLS, np.int32)
    names = [x.split()[0] for x in _SIGNED.split(", ")]
    words = BITMAP // 64
    for ids, sets in _sets(batches):
        n = len(sets)
        tokens = np.concatenate(sets) if sets else np.zeros(0, _U)
        np.add.at(total, (tokens & _U(CELLS - 1)).astype(np.int64), 1)
        bits = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * words, pa.int32()), pa.array(np.concatenate([bitmap(s) for s in sets])))
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), ids.cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), _signed([node_of(s) for s in sets]), bits, pa.array([long_bitmap(s) for s in sets], pa.list_(pa.int64())), pa.nulls(n, pa.binary())], names=names)
    if total.any():
        n = CELLS // BLOCK
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n), pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), *[pa.nulls(n, pa.list_(pa.int64()))] * 2, pa.array([x.astype(np.int64).tobytes() for x in total.reshape(n, BLOCK)], pa.binary())], names=names)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums blocks of counts as they stream past; holds one sum per block number."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(data, np.int64)
            sums[block] = sums[block] + own if block in sums else own
    for block, own in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["block", "counts"])


def needed(n, share: int = SHARE):
    """Tokens that a set of n must share with any partner."""
    return -(-n * share // 100)


def prefix(tokens: np.ndarray, counts: np.ndarray, usual: float, share: int = SHARE) -> tuple[np.ndarray, int]:
    """The adaptive prefix of a set and the matches it asks for."""
    n = len(tokens)
    estimate = counts[(tokens & _U(CELLS - 1)).astype(np.int64)]
    order = np.lexsort((tokens, estimate))
    first = n - needed(n, share) + 1
    matches = np.arange(1, min(MOST_MATCHES, n - first + 1) + 1)
    # List entries that a token brings beyond what its cell usually holds, then summed over the prefix.
    entries = np.cumsum(np.maximum(estimate[order] - usual, 0))[first - 1 + matches - 1]
    best = int(np.argmin(entries + VERIFY * n * entries / matches))
    return tokens[order[: first + best]], best + 1


def _prefixes(counts: np.ndarray, usual: float, share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches):
            tokens, nodes, sizes = [], [], []
            for s in sets:
                if len(s):
                    own, m = prefix(s, counts, usual, share)
                    tokens.append(own)
                    nodes.append(np.full(len(own), node_of(s), _U))
                    sizes.append(np.full(len(own), len(s) * 8 + m, np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(tokens)), _signed(np.concatenate(nodes)), pa.array(np.concatenate(sizes))], names=["token", "node", "size"])

    return run


def _shared_only(share: int):
    """Keeps rows with a partner: another node in the list whose size leaves a chance of a link.

    Rows are sorted by (token, size, node), so the nearest sizes stand next to each other and a copy
    of a row follows it. One row is held between batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, is_out = None, False  # the last row so far, and whether it has been passed on
        for batch in batches:
            rows = [batch.column(i).to_numpy() for i in range(3)]
            if held is not None:
                rows = [np.concatenate([h, x]) for h, x in zip(held, rows, strict=True)]
            token, size, node = rows
            if not len(token):
                continue
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
            token, size, node = (x[new] for x in rows)
            n = size >> 3
            pair = np.zeros(len(token) + 1, bool)
            pair[1:-1] = (token[1:] == token[:-1]) & (100 * n[:-1] >= share * n[1:])
            out = pair[:-1] | pair[1:]
            last_is_out = bool(out[-1])
            if held is not None and is_out:
                last_is_out |= len(out) == 1
                out[0] = False
            held, is_out = (token[-1:], size[-1:], node[-1:]), last_is_out
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (token, size, node)], names=["token", "size", "node"])

    return run


def _asked_sets(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _sets(batches):
            nodes = np.array([node_of(s) for s in sets], _U)
            own = pc.fill_null(ids.cast(pa.int64()), 0).to_numpy()
            at = np.flatnonzero(held(bits, _asked_cell(nodes.view(np.int64), own)))
            if len(at):
                offsets = np.concatenate([[0], np.cumsum([len(sets[i]) for i in at])])
                tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _signed(np.concatenate([sets[i] for i in at])))
                yield pa.RecordBatch.from_arrays([_signed(nodes[at]), tokens], names=["node", "tokens"])

    return run


def _asked_cell(node: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    """A number for a set's first document, whose low bits are its place in the table of sets that are asked for."""
    return textops.mix(node.astype(np.int64).view(_U) ^ textops.mix(doc_id.astype(np.int64).view(_U)))


def _cells(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, doc_id = batch.column(0).to_numpy(), pc.fill_null(batch.column(1), 0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_asked_cell(node, doc_id) & _U(size - 1)), pa.int64())], names=["cell"])

    return run


def _across(share: int):
    """(a, b, need): pairs of members of different classes, of two blocks, near by size and bitmap."""

    def unpack(rows: pa.ListScalar):
        x = rows.values
        node, group, n, need = (x.field(k).to_numpy(zero_copy_only=False) for k in range(4))
        return node, group, n.astype(np.int64), need, x.field(4).flatten().to_numpy().view(_U).reshape(len(node), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (a, ga, na, ma, xa), (b, gb, nb, mb, xb) = (unpack(batch.column(k)[i]) for k in range(2))
                same = batch.column(2)[i].as_py()
                by = np.argsort(nb, kind="stable")
                b, gb, nb, mb, xb = b[by], gb[by], nb[by], mb[by], xb[by]
                low = np.searchsorted(nb, -(-share * na // 100))
                high = np.searchsorted(nb, 100 * na // share, "right")
                for r in range(len(a)):
                    at = np.arange(low[r], high[r])
                    at = at[(gb[at] != ga[r]) & ((a[r] < b[at]) if same else True)]
                    apart = np.bitwise_count(xb[at] ^ xa[r]).sum(1, dtype=np.int64)
                    at = at[(100 + share) * apart <= (100 - share) * (nb[at] + na[r])]
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a[r], b[at])), pa.array(np.maximum(a[r], b[at])), pa.array(np.minimum(mb[at], ma[r]), pa.int32())], names=["a", "b", "need"])

    return run


def _node_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, tokens) of the nodes in ``wanted`` (node, rep), and a few more; one shuffle drops repeated rows."""
    bits = bit_table(wanted.mapInArrow(_cells(size := table_size(wanted.count())), "cell long"), size)
    return docs.select("doc_id", "text").mapInArrow(_asked_sets(bits), "node long, tokens array<long>").dropDuplicates(["node"])


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, share: int) -> DataFrame:
    """(source, target) of the pairs (a, b) that link: bitmaps first, then the sets themselves."""
    # common >= share / (100 + share) of the sizes' sum, so at most the rest of it differs.
    most = F.lit(100 - share) * (F.col("na") + F.col("nb"))

    def alike(pairs: DataFrame, bits: str, rows: DataFrame) -> DataFrame:
        left = rows.select(F.col("node").alias("a"), F.col(bits).alias("xa"), F.col("n").alias("na"))
        right = rows.select(F.col("node").alias("b"), F.col(bits).alias("xb"), F.col("n").alias("nb"))
        apart = F.aggregate(F.zip_with("xa", "xb", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda t, x: t + x)
        found = pairs.join(left, "a").join(right, "b").where(F.coalesce(F.size("xa") != F.size("xb"), F.lit(True)) | ((100 + share) * apart <= most))
        return found.select("a", "b", "na", "nb")

    near_pairs = cut(alike(pairs, "bits", nodes))
    big = (F.col("na") > LONG) & (F.col("nb") > LONG)
    big_pairs = alike(near_pairs.where(big).select("a", "b"), "more", nodes.where(F.col("n") > LONG))
    near = cut(near_pairs.where(~big).unionByName(big_pairs))
    sets = _node_sets(docs, cut(near.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "rep"), "node")))
    near = near.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b")
    near = near.withColumn("common", F.size(F.array_intersect("ta", "tb")))
    return cut(near.where(100 * F.col("common") >= share * (F.col("na") + F.col("nb") - F.col("common"))).select(F.col("a").alias("source"), F.col("b").alias("target")))


def _fits(share: int):
    """Sizes that leave a chance of a link."""
    return 100 * F.least("na", "nb") >= share * F.greatest("na", "nb")


def signatures(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, node, bits, more) of every row, and the table of token counts (CELLS numbers)."""
    bounded_batches(docs.sparkSession)
    both = table(docs.select("doc_id", "text").mapInArrow(_signatures, _SIGNED))
    blocks = added_up(both.where("block is not null").select("block", "counts"), _add_up, "block int, counts binary", CELLS // BLOCK).toArrow().to_pylist()
    counts = np.zeros(CELLS, np.int64)
    for x in blocks:
        counts[x["block"] * BLOCK : (x["block"] + 1) * BLOCK] = np.frombuffer(x["counts"], np.int64)
    return both.where("block is null").select("doc_id", "n", "node", "bits", "more"), np.minimum(counts, (1 << 31) - 1).astype(np.int32)


def node_classes(docs: DataFrame, own: DataFrame, counts: np.ndarray, share: int = SHARE) -> DataFrame:
    """(node, component) for the sets that link with another; component is the smallest node of the class.

    ``own`` and ``counts`` are what :func:`signatures` gives for ``docs``.
    """
    parts = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    tokens = docs.select("doc_id", "text").mapInArrow(_prefixes(counts, float(np.median(counts)), share), "token long, node long, size long")
    lists = tokens.select("token", "size", "node").repartition(int(parts), "token").sortWithinPartitions("token", "size", "node").mapInArrow(_shared_only(share), "token long, size long, node long")
    lists = table(lists.select("token", "node", F.shiftright("size", 3).alias("n"), F.col("size").bitwiseAND(7).cast("int").alias("matches")))
    nodes = own.where("n > 0").join(lists.select("node").distinct(), "node", "left_semi")
    nodes = cut(nodes.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("more").alias("more")))
    # Base texts of copies have all of their prefix in shared lists: they make the best centres.
    often = lists.groupBy("node").agg(F.count("*").alias("lists"), F.first("n").alias("n"), F.first("matches").alias("matches"))
    often = often.select("node", (F.col("lists") / (F.col("n") - F.ceil(F.col("n") * share / 100) + F.col("matches"))).alias("shared"))
    ranks = [F.struct((-F.col("shared") if k == 0 else F.lit(0.0)).alias("r"), F.xxhash64("node", F.lit(k)).alias("h"), "node", "n", "matches") for k in range(CENTRES)]
    centre = lists.join(often, "node").groupBy("token").agg(*[F.min(r).alias(f"c{k}") for k, r in enumerate(ranks)])
    centre = centre.select("token", F.array_distinct(F.array(*[F.struct(F.col(f"c{k}.node"), F.col(f"c{k}.n"), F.col(f"c{k}.matches")) for k in range(CENTRES)])).alias("centres"))
    pairs = lists.join(centre, "token").select("node", F.col("n").alias("na"), "matches", F.explode("centres").alias("c"))
    pairs = pairs.select("node", "na", F.col("c.node").alias("b"), F.col("c.n").alias("nb"), F.least("matches", "c.matches").alias("need")).where((F.col("node") != F.col("b")) & _fits(share))
    # The centres that a set meets most often are its likeliest partners; step 4 finds what others would have added.
    met = Window.partitionBy("node").orderBy(F.desc("met"), "b")
    pairs = pairs.groupBy("node", "b").agg(F.count("*").alias("met"), F.first("need").alias("need")).where("met >= need")
    pairs = pairs.withColumn("place", F.row_number().over(met)).where(F.col("place") <= CENTRES)
    pairs = pairs.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
    edges = _verified(pairs, docs, nodes, share)
    classes = connected_components(edges)
    # Lists that still hold several classes: all pairs across classes with enough matches.
    seen = lists.join(classes, "node", "left").select("token", "node", "n", "matches", F.coalesce("component", "node").alias("class"))
    seen = cut(seen)
    mixed = seen.groupBy("token").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("token")
    seen = cut(seen.join(mixed, "token"))
    held = seen.groupBy("token").agg(F.count("*").alias("members"))
    seen = cut(seen.join(held, "token"))
    # Short lists give their pairs at once, less than SHORT for each member. In others members travel in
    # blocks with their bitmaps, and a task compares block with block: what leaves it are the pairs near
    # enough, not all pairs of a list.
    short = seen.where(F.col("members") <= SHORT)
    other = short.select("token", F.col("node").alias("b"), F.col("class").alias("class2"), F.col("n").alias("nb"), F.col("matches").alias("matches2"))
    pairs = short.select("token", F.col("node").alias("a"), "class", F.col("n").alias("na"), "matches").join(other, "token").where((F.col("a") < F.col("b")) & (F.col("class") != F.col("class2")) & _fits(share))
    pairs = pairs.select("a", "b", F.least("matches", "matches2").alias("need"))
    long = seen.where(F.col("members") > SHORT).join(nodes.select("node", "bits"), "node")
    member = F.struct("node", "class", "n", "matches", "bits")
    n_blocks = F.ceil(F.col("members") / MEMBERS)
    blocks = table(long.groupBy("token", F.pmod(F.xxhash64("node", F.lit(9)), n_blocks).alias("block"), n_blocks.alias("blocks")).agg(F.collect_list(member).alias("members")))
    # Groups of blocks meet group by group, so one token's pairs of blocks are dealt over many tasks.
    group, groups = F.floor(F.col("block") / TOGETHER), F.ceil(F.col("blocks") / TOGETHER)
    left = blocks.select("token", "block", "members", group.alias("low"), F.explode(F.sequence(group, groups - 1)).alias("high"))
    right = blocks.select("token", F.col("block").alias("block2"), F.col("members").alias("members2"), F.explode(F.sequence(F.lit(0).cast("long"), group)).alias("low"), group.alias("high"))
    across = left.join(right, ["token", "low", "high"]).where("block <= block2").select("members", "members2", (F.col("block") == F.col("block2")).alias("same")).mapInArrow(_across(share), "a long, b long, need int")
    pairs = pairs.unionByName(across).groupBy("a", "b").agg(F.count("*").alias("met"), F.first("need").alias("need")).where("met >= need").select("a", "b")
    found = _verified(pairs, docs, nodes, share)
    return classes if found.isEmpty() else connected_components(edges.unionByName(found))


class Sets:
    """Sets of one block: nodes, how many documents have each, sizes, and all tokens one after the other."""

    def __init__(self, parts: list[tuple[np.ndarray, ...]]):
        self.node, self.copies, self.n, tokens = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.row = np.repeat(np.arange(len(self.n)), self.n)
        self.vocabulary, self.column = np.unique(tokens, return_inverse=True)
        by = np.argsort(self.column, kind="stable")
        self.row, self.column, self.tokens = self.row[by], self.column[by], tokens[by]


def _part(x: np.ndarray, start: int, stop: int) -> slice:
    return slice(*np.searchsorted(x, [start, stop]))


def linked(a: Sets, b: Sets, share: int) -> np.ndarray:
    """Which sets of ``a`` link with which of ``b``: tokens in common from products of tables of WIDTH columns."""
    common = np.zeros((len(a.n), len(b.n)), np.int64)
    at = np.minimum(np.searchsorted(a.vocabulary, b.tokens), len(a.vocabulary) - 1)
    hit = a.vocabulary[at] == b.tokens
    column, row = at[hit], b.row[hit]
    for start in range(0, len(a.vocabulary), WIDTH):
        theirs = _part(column, start, start + WIDTH)
        if theirs.start == theirs.stop:
            continue
        own = _part(a.column, start, start + WIDTH)
        width = min(WIDTH, len(a.vocabulary) - start)
        left, right = np.zeros((len(a.n), width), np.float32), np.zeros((len(b.n), width), np.float32)
        left[a.row[own], a.column[own] - start] = 1
        right[row[theirs], column[theirs] - start] = 1
        common += (left @ right.T).astype(np.int64)
    return 100 * common >= share * (a.n[:, None] + b.n - common)


def _count_links(share: int):
    """(node, links) from rows (component, low, high, side, node, copies, tokens) sorted by the first four.

    Holds the sets of side 0 of one pair of blocks in parts; those of side 1 are counted as they stream past.
    """

    def counts(node: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(links.astype(np.int64))], names=["node", "links"])

    def packed(rows: list) -> list[Sets]:
        out, own, n = [], [], 0
        for part in rows:
            own.append(part)
            n += len(part[0])
            if n >= PART:
                out.append(Sets(own))
                own, n = [], 0
        return [*out, Sets(own)] if own else out

    def alone(block: list[Sets]) -> Iterator[pa.RecordBatch]:
        for i, part in enumerate(block):
            both = linked(part, part, share)
            np.fill_diagonal(both, False)
            yield counts(part.node, both @ part.copies)
            for other in block[:i]:
                both = linked(part, other, share)
                yield counts(part.node, both @ other.copies)
                yield counts(other.node, part.copies @ both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, block = None, [], None
        for batch in batches:
            component, low, high, side, node, copies = (batch.column(k).to_numpy() for k in range(6))
            tokens = batch.column(6)
            new = np.ones(len(node), bool)
            new[1:] = (component[1:] != component[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (side[1:] != side[:-1])
            starts = np.flatnonzero(new)
            for start, stop in zip(starts, np.append(starts[1:], len(node)), strict=True):
                here = (component[start], low[start], high[start])
                if here != key:
                    if parts and key[1] == key[2]:
                        yield from alone(packed(parts))
                    key, parts, block = here, [], None
                for at in range(start, stop, CHUNK):
                    own = slice(at, min(at + CHUNK, stop))
                    lists = tokens.slice(at, own.stop - at)
                    part = (node[own], copies[own], pc.list_value_length(lists).to_numpy().astype(np.int64), lists.flatten().to_numpy())
                    if side[start] == 0:
                        parts.append(part)
                        continue
                    if not parts:
                        continue
                    block = block or packed(parts)
                    chunk = Sets([part])
                    for held_part in block:
                        both = linked(held_part, chunk, share)
                        yield counts(held_part.node, both @ chunk.copies)
                        yield counts(chunk.node, held_part.copies @ both)
        if parts and key[1] == key[2]:
            yield from alone(packed(parts))

    return run


def node_links(docs: DataFrame, own: DataFrame, classes: DataFrame, share: int = SHARE) -> DataFrame:
    """(node, links): how many documents with another set each set of ``classes`` links with."""
    parts = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    nodes = own.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.count("*").alias("copies"))
    members = cut(classes.join(nodes, "node"))
    sizes = members.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / ROWS, F.sum("n") / TOKENS)).alias("blocks"))
    members = members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node", F.lit(11)), "blocks"))
    sets = _node_sets(docs, members.select("node", "rep")).join(members, "node")
    sets = sets.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    key = ["component", "low", "high"]
    sets = sets.select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") > F.col("other")).cast("int").alias("side"), "node", "copies", "tokens")
    counted = sets.repartition(int(parts), *key).sortWithinPartitions(*key, "side").mapInArrow(_count_links(share), "node long, links long")
    return counted.groupBy("node").agg(F.sum("links").alias("links"))


def ngram_join(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id of its class), n_links (other documents
    that it links with, copies included) and its node."""
    own, counts = signatures(docs)
    classes = cut(node_classes(docs, own, counts, share))
    heads = own.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    heads = heads.join(classes, "node", "left").select("node", F.coalesce("component", "node").alias("class"), "doc_id", "copies")
    heads = heads.join(node_links(docs, own, classes, share), "node", "left")
    smallest = heads.groupBy("class").agg(F.min("doc_id").alias("least_id"))
    links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    of_node = heads.join(smallest, "class").select(F.col("node").alias("of"), "least_id", links.alias("n_links"))
    rows = own.join(of_node, (F.col("node") == F.col("of")) & (F.col("n") > 0), "left")
    component = F.coalesce(F.when(F.col("n") > 0, F.col("least_id")), "doc_id")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "node")


def _with_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, node) from (row), whose field ``text`` is the text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(0).field("text")
        for row, raw, offs in textops.slices(pc.fill_null(text, "") if text.null_count else text):
            found = textops.shingle_sets(raw, offs, SIZE)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(found)), _signed([node_of(s) for s in found])], names=["row", "node"])


def keep_one(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """The documents without near copies: of each class the row with the smallest doc_id stays (nulls last).

    Of rows equal in doc_id and set one stays; documents without words (null and empty texts too) link
    with nothing and all stay; an empty table stays empty; columns of any name stay as they are.
    """
    word = r"[^\x20\x09-\x0D]"
    worded = F.coalesce(F.col("text").rlike(word), F.lit(False))
    own, counts = signatures(docs.where(worded))
    classes = node_classes(docs.where(worded), own, counts, share)
    heads = own.groupBy("node").agg(F.min("doc_id").alias("id")).join(classes, "node", "left")
    best = F.min_by(F.struct("node", "id"), F.struct(F.col("id").isNull(), "id", "node")).alias("best")
    chosen = heads.groupBy(F.coalesce("component", "node")).agg(best).select(F.col("best.node").alias("of"), F.col("best.id").alias("id"))
    # The caller's columns stay inside one struct, so that helper names can't clash.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    kind = T.StructType([T.StructField("row", docs.select(row).schema["row"].dataType), T.StructField("node", T.LongType())])
    rows = docs.where(worded).select(row).mapInArrow(_with_node, kind)
    rows = rows.join(chosen, (F.col("node") == F.col("of")) & F.col("row")["doc_id"].eqNullSafe(F.col("id"))).dropDuplicates(["node"])
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns]).unionByName(docs.where(~worded))

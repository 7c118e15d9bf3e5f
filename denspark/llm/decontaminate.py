r"""Benchmark decontamination: latent semantic retrieval, then subsequence and answer checks.

Passages (blocks of ``PASSAGE`` words) of all documents and of the benchmark form a TF-IDF
matrix A over ``TERMS`` hashed words. One distributed pass adds up A'A times a random matrix
and the document frequencies, in blocks of fixed size that are summed as they stream past; the
driver gets TERMS x RANK numbers whatever the corpus, orthonormalises them and rotates them to
singular directions (randomised SVD in one pass). A second pass projects overlapping passages,
looks for benchmark items with a high cosine, and confirms each candidate on the words
themselves: the longest common subsequence with the item, and with its answer (its last
sentence or last quarter). A paraphrase that keeps most of the words in order is found; shared
common words alone are not enough.

A short item fills too little of a passage for the cosine to show it, so items are also looked up
by their words. A stretch that holds o of an item's n words in order holds at least ``MET`` of the
item's n - o + ``MET`` rarest words, whichever they are: places where that many lie within
``STRETCH`` times the item's length are the only ones where such a stretch can be, and each is
compared in full. No stretch of that length with the shares below is missed, whatever its cosine.
Items of over ``PASSAGE`` words are looked up by their passages too: one that is there nearly
whole (``SURE``) is a leak, however long the item.

Items of under ``LEAST`` words are looked up as they are: a text that holds all their words in a row
holds them, however common the words and whatever the size of the corpus.

The benchmark is handled in blocks of at most ``ITEMS`` rows and ``ITEM_WORDS`` words (or one longer
item), so what tasks receive is bounded.

Defined cases: null or empty text is never contaminated, null or empty items match nothing; repeated rows
are judged one by one; an empty table or benchmark gives an empty result; other columns play
no part; long texts are searched whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from denspark.lineage import bounded_batches
from denspark.llm import textops
from denspark.llm.bits import added_up

PASSAGE, TERMS, RANK, EXTRA = 32, 8192, 48, 8
#: Items of the benchmark and their words in one pass; words from which paraphrases of an item are looked for.
ITEMS, ITEM_WORDS, LEAST = 2000, 400_000, 8
#: Least cosine of a candidate, least share of its distinct terms in the passage (by bitmaps of BITS), and least shares of the item's and the answer's words in common order.
COSINE, TERMS_SHARED, BITS, SHARED, ANSWER, SURE = 0.5, 0.5, 1024, 0.6, 0.5, 0.8
#: Rarest words of an item that a place must hold, and the length of a stretch in item lengths.
MET, STRETCH = 3, 1.5
_BLOCK = 512
_WIDTH = RANK + EXTRA
_MATCH = "doc_id long, item_id long, cosine double, lcs double, answer double"


def _start() -> np.ndarray:
    return np.random.default_rng(5).standard_normal((TERMS, _WIDTH)).astype(np.float32)


def _terms(words: textops.Words) -> np.ndarray:
    return (words.hashes >> np.uint64(51)).astype(np.int64)


def _passages(bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the blocks of ``size`` words of each document, and their bounds by document."""
    counts = -(-np.diff(bounds) // size)
    ends = np.concatenate([[0], np.cumsum(counts)])
    starts = (np.arange(ends[-1]) - np.repeat(ends[:-1], counts)) * size + np.repeat(bounds[:-1], counts)
    return starts, ends


def _fit(start: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((TERMS, _WIDTH + 1), np.float64)
        passages = 0.0
        for batch in batches:
            weights = batch.column(batch.schema.get_field_index("weight")).to_numpy()
            for row, raw, offs in textops.slices(textops.text_column(batch), 400_000):
                words = textops.Words(raw, offs)
                if not len(words.hashes):
                    continue
                terms = _terms(words)
                starts, ends = _passages(words.bounds, PASSAGE)
                z = np.add.reduceat(start[terms], starts)
                weight = np.repeat(weights[row : row + len(offs) - 1], np.diff(ends)).astype(np.float32)
                passage = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(terms))))
                order = np.argsort(terms, kind="stable")
                sorted_terms, sorted_passages = terms[order], passage[order]
                first = np.flatnonzero(np.concatenate([[True], sorted_terms[1:] != sorted_terms[:-1]]))
                total[sorted_terms[first], :_WIDTH] += np.add.reduceat((z * weight[:, None])[sorted_passages], first)
                once = np.concatenate([[True], (sorted_terms[1:] != sorted_terms[:-1]) | (sorted_passages[1:] != sorted_passages[:-1])])
                total[:, _WIDTH] += np.bincount(sorted_terms[once], minlength=TERMS)
                passages += len(starts)
        for k in range(0, TERMS, _BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array([k // _BLOCK], pa.int32()), pa.array([passages]), pa.array([total[k : k + _BLOCK].astype(np.float32).tobytes()], pa.binary())], names=["block", "passages", "sums"])

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the blocks as they stream past; holds one sum per block number."""
    sums: dict[int, np.ndarray] = {}
    passages: dict[int, float] = {}
    for batch in batches:
        for block, n, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            own = np.frombuffer(data, np.float32).astype(np.float64)
            sums[block] = sums[block] + own if block in sums else own
            passages[block] = passages.get(block, 0.0) + n
    for block, own in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([passages[block]]), pa.array([own.astype(np.float32).tobytes()], pa.binary())], names=["block", "passages", "sums"])


def latent_space(docs: DataFrame, benchmark: DataFrame) -> np.ndarray:
    """TERMS x RANK: idf times the leading right singular directions of the TF-IDF passages.

    Benchmark passages weigh as much as the documents' in all, so that the space tells items apart.
    """
    bounded_batches(docs.sparkSession)
    start = _start()
    weight = max(1.0, docs.count() / max(1, benchmark.count()))
    texts = docs.select("text", F.lit(1.0).alias("weight")).unionByName(benchmark.select("text", F.lit(float(weight)).alias("weight")))
    schema = "block int, passages double, sums binary"
    blocks = added_up(texts.mapInArrow(_fit(start), schema), _add_up, schema, TERMS // _BLOCK).toArrow().to_pylist()
    if not blocks:
        return np.zeros((TERMS, RANK), np.float32)
    total = np.zeros((TERMS, _WIDTH + 1))
    for x in blocks:
        total[x["block"] * _BLOCK : (x["block"] + 1) * _BLOCK] = np.frombuffer(x["sums"], np.float32).reshape(_BLOCK, _WIDTH + 1)
    idf = np.log((blocks[0]["passages"] + 1) / (total[:, _WIDTH] + 1))
    idf[total[:, _WIDTH] == 0] = 0
    # With A = T diag(idf): A'A omega for omega = start / idf; Nystroem's core gives the rotation.
    sketch = idf[:, None] * total[:, :_WIDTH]
    omega = start / np.maximum(idf, 1e-3)[:, None]
    q, _ = np.linalg.qr(sketch)
    core = (q.T @ sketch) @ np.linalg.pinv(q.T @ omega)
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    # Directions weigh alike: otherwise the first, what all prose has in common, hides the rest.
    scale = 1 / np.sqrt(np.maximum(values[::-1][:RANK], 1e-9 * max(1e-9, values[-1])))
    return (idf[:, None] * (q @ vectors[:, ::-1][:, :RANK]) * scale).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, with one bit for each element of ``a``."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & at.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def answer_of(text: str) -> int:
    """Number of words of an item's answer: its last sentence, or its last quarter if that is all there is."""
    words = text.split()
    inner = [i for i, w in enumerate(words[:-1]) if w[-1] in ".?!:"]
    return len(words) - inner[-1] - 1 if inner else -(-len(words) // 4)


def least(share: float, n: int) -> int:
    """Least whole number of n words that is at least ``share`` of them."""
    return -int(-(share * n - 1e-9) // 1)


class Items:
    """Benchmark items of one block: their word hashes, answers, latent pieces and index of rarest words."""

    def __init__(self, rows: list, space: np.ndarray):
        self.ids, self.words, self.answers, vectors, self.owner, terms = [], [], [], [], [], []
        self.pieces, self.whole = [], []
        short: dict[int, list] = {}
        for item_id, text in rows:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            words = textops.Words(raw, np.array([0, len(raw)]))
            own_terms = _terms(words)
            if len(words.hashes) < LEAST:
                if len(words.hashes):
                    short.setdefault(len(words.hashes), []).append((item_id, words))
                continue
            own = space[own_terms]
            cuts = [(0, len(own))]
            if len(own) > PASSAGE:
                cuts += [(i, min(i + PASSAGE, len(own))) for i in range(0, len(own) - PASSAGE // 2, PASSAGE // 2)]
            for a, b in cuts:
                vectors.append(own[a:b].sum(0))
                held = np.zeros(BITS, bool)
                held[own_terms[a:b] % BITS] = True
                terms.append(np.packbits(held))
                self.owner.append(len(self.ids))
                self.pieces.append(words.hashes[a:b].tolist())
                self.whole.append(b - a == len(own))
            self.ids.append(item_id)
            self.words.append(words.hashes.tolist())
            self.answers.append(min(len(own), answer_of(text)))
        self.owner = np.array(self.owner, np.int64)
        self.terms = np.array(terms, np.uint8).reshape(len(terms), BITS // 8).view(np.uint64)
        self.distinct = np.bitwise_count(self.terms).sum(1)
        self.latent = _unit(np.array(vectors, np.float32).reshape(len(vectors), RANK)).T.copy()
        # By their number of words: a hash of the words in a row, sorted, and the items.
        self.short = {}
        for n, known in short.items():
            hashes = np.array([textops.windows(w.hashes, w.bounds, n)[0][0] for _, w in known], np.uint64)
            order = np.argsort(hashes, kind="stable")
            self.short[n] = hashes[order], [known[i][0] for i in order.tolist()], [known[i][1].hashes for i in order.tolist()]
        self._index()

    def in_a_row(self, words: textops.Words) -> Iterator[tuple[int, int, int]]:
        """(document, item id, first word) where all words of a short item stand in a row."""
        for n, (hashes, ids, own) in self.short.items():
            found, bounds = textops.windows(words.hashes, words.bounds, n)
            low, high = np.searchsorted(hashes, found), np.searchsorted(hashes, found, "right")
            for at in np.flatnonzero(high > low).tolist():
                d = int(np.searchsorted(bounds, at, "right")) - 1
                first = int(words.bounds[d] + at - bounds[d])
                for k in range(low[at], high[at]):
                    if (words.hashes[first : first + n] == own[k]).all():
                        yield d, ids[k], first

    def _index(self) -> None:
        """Postings (word, piece) of the rarest words of each piece; the order of words only decides the cost."""
        counts = Counter(x for words in self.words for x in set(words))
        rows = set()
        for p, piece in enumerate(self.pieces):
            o = least(SHARED if self.whole[p] else SURE, len(piece))
            rows.update((x, p) for x in sorted(piece, key=lambda x: (counts[x], x))[: len(piece) - o + min(MET, o)])
        rows = sorted(rows)
        self.spans = np.array([least(STRETCH, len(piece)) for piece in self.pieces], np.int64)
        self.posted = np.array([p for _, p in rows], np.int64)
        self.keys, first = np.unique(np.array([x for x, _ in rows], np.uint64), return_index=True)
        self.posts = np.append(first, len(rows)).astype(np.int64)
        self.cells = np.zeros(1 << 16, bool)
        self.cells[(self.keys >> np.uint64(48)).astype(np.int64)] = True

    def places(self, words: textops.Words, doc: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(piece, low, high): the parts of a document where a piece's stretch can be; ``doc``: document of each word."""
        at = np.flatnonzero(self.cells[(words.hashes >> np.uint64(48)).astype(np.int64)])
        key = np.minimum(np.searchsorted(self.keys, words.hashes[at]), len(self.keys) - 1)
        known = self.keys[key] == words.hashes[at]
        at, key = at[known], key[known]
        many = self.posts[key + 1] - self.posts[key]
        ends = np.cumsum(many)
        piece = self.posted[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.posts[key] - (ends - many), many)]
        hit = np.sort(piece << 40 | np.repeat(at, many))
        a, b = hit[: 1 - MET], hit[MET - 1 :]
        near = a >> 40 == b >> 40
        a, b = a[near], b[near]
        piece, a, b = a >> 40, a & ((1 << 40) - 1), b & ((1 << 40) - 1)
        near = (b - a < self.spans[piece]) & (doc[a] == doc[b])
        piece, a, b = piece[near], a[near], b[near]
        low = np.maximum(words.bounds[doc[a]], b - self.spans[piece] + 1)
        high = np.minimum(words.bounds[doc[a] + 1], a + self.spans[piece])
        return zip(piece.tolist(), low.tolist(), high.tolist(), strict=True)


def stretch(piece: list, answer: int, near: list, span: int) -> tuple[int, float, float] | None:
    """(begin, share, answer share) of a stretch of ``span`` words in ``near`` that confirms a piece.

    ``answer``: words of the item's answer at the piece's end, 0 for a part of an item. Stretches that
    begin as the piece does are tried before others; the first that confirms is given.
    """
    n, own, held = len(piece), set(piece), set(near)
    tail = piece[n - answer :] if answer else []

    def shares(part: list) -> tuple[float, float] | None:
        share = lcs(piece, part) / n
        if share < (SHARED if answer else SURE):
            return None
        told = lcs(tail, part) / answer if answer else 0.0
        return (share, told) if share >= SURE or told >= ANSWER else None

    # No stretch can have more than all of them together.
    if sum(x in held for x in piece) < least(SHARED if answer else SURE, n) or not shares(near):
        return None
    for begin in sorted((k for k, x in enumerate(near) if x in own), key=lambda k: near[k] != piece[0]):
        found = shares(near[begin : begin + span])
        if found:
            return begin, *found
    return None


def matches(raw: np.ndarray, offs: np.ndarray, items: Items, space: np.ndarray) -> list[tuple]:
    """(document, item, cosine, lcs share, answer share) of the confirmed leaks in a slice."""
    words = textops.Words(raw, offs)
    half = PASSAGE // 2
    starts, ends = _passages(words.bounds, half)
    if not len(starts):
        return []
    found = {}
    for d, item, _ in items.in_a_row(words):
        found[d, ("short", item)] = (d, item, 1.0, 1.0, 1.0)
    if not len(items.ids):
        return list(found.values())
    terms = _terms(words)
    sums = np.add.reduceat(space[terms], starts)
    held = np.zeros((len(starts), BITS), bool)
    held[np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(terms)))), terms % BITS] = True
    held = np.packbits(held, axis=1).view(np.uint64)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(ends))
    pair = sums.copy()
    follows = doc[1:] == doc[:-1]
    pair[:-1][follows] += sums[1:][follows]
    held[:-1][follows] |= held[1:][follows].copy()
    cosine = _unit(pair) @ items.latent
    at, piece = np.nonzero(cosine >= COSINE)
    common = np.bitwise_count(held[at] & items.terms[piece]).sum(1)
    likely = common >= TERMS_SHARED * items.distinct[piece]
    at, piece = at[likely], piece[likely]
    tried = set()
    for w, p in sorted(zip(at.tolist(), piece.tolist(), strict=True), key=lambda x: -cosine[x]):
        d, i = int(doc[w]), int(items.owner[p])
        if (d, i) in found or (w, i) in tried:
            continue
        tried.add((w, i))
        item = items.words[i]
        reach = len(item)
        low, high = max(words.bounds[d], starts[w] - reach), min(words.bounds[d + 1], starts[w] + PASSAGE + reach)
        near = words.hashes[low:high].tolist()
        have = set(near)
        if sum(x in have for x in item) < SHARED * len(item):
            continue
        share = lcs(item, near) / len(item)
        answer = item[len(item) - items.answers[i] :]
        told = lcs(answer, near) / len(answer)
        if share >= SURE or share >= SHARED and told >= ANSWER:
            found[d, i] = (d, items.ids[i], round(float(cosine[w, p]), 3), share, told)
    word_doc = np.repeat(np.arange(len(offs) - 1), np.diff(words.bounds))
    for p, low, high in items.places(words, word_doc):
        d, i = int(word_doc[low]), int(items.owner[p])
        if (d, i) in found:
            continue
        hit = stretch(items.pieces[p], items.answers[i] if items.whole[p] else 0, words.hashes[low:high].tolist(), int(items.spans[p]))
        if hit:
            begin, share, told = hit
            own = space[terms[low + begin : min(high, low + begin + int(items.spans[p]))]].sum(0, keepdims=True)
            found[d, i] = (d, items.ids[i], round(float((_unit(own) @ items.latent[:, p])[0]), 3), share, told)
    return [found[k] for k in sorted(found, key=str)]


def _searcher(items: Items, space: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for row, raw, offs in textops.slices(textops.text_column(batch), 400_000):
                hits = matches(raw, offs, items, space)
                if hits:
                    d, item, *rest = zip(*hits, strict=True)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.array(d) + row)).cast(pa.int64()), pa.array(item, pa.int64()), *(pa.array(x, pa.float64()) for x in rest)], names=["doc_id", "item_id", "cosine", "lcs", "answer"])

    return run


def _cleaner(items: Items, space: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for row, raw, offs in textops.slices(textops.text_column(batch), 400_000):
                clean[[row + x[0] for x in matches(raw, offs, items, space)]] = False
            yield batch.filter(pa.array(clean))

    return run


def item_blocks(benchmark: DataFrame, space: np.ndarray) -> Iterator[Items]:
    """The benchmark in blocks of at most ITEMS rows and about ITEM_WORDS words, ordered by item_id and text."""
    rows = benchmark.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator()
    block: list = []
    size = 0
    for x in rows:
        n = len(x["text"].split())
        if block and (len(block) == ITEMS or size + n > ITEM_WORDS):
            yield Items(block, space)
            block, size = [], 0
        block.append((x["item_id"], x["text"]))
        size += n
    if block:
        yield Items(block, space)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer): the benchmark items that documents hold."""
    space = latent_space(docs, benchmark)
    found = [docs.select("doc_id", "text").mapInArrow(_searcher(items, space), _MATCH) for items in item_blocks(benchmark, space)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], _MATCH)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with their columns as they were; no shuffle.

    Null and empty texts stay, repeated rows are judged one by one, an empty benchmark drops nothing, an
    empty table stays empty, and columns of any name are no special case.
    """
    space = latent_space(docs, benchmark)
    for items in item_blocks(benchmark, space):
        docs = docs.mapInArrow(_cleaner(items, space), docs.schema)
    return docs

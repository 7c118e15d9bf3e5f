"""Quality rules: zstandard compression bands over whole documents and fixed chunks.

Prose compresses within a band that depends on its length. Text above the band repeats
itself, text below it is close to random (encoded blobs, keys, noise). One Arrow pass over
the documents, no shuffle: it scales with the number of input splits.

Defined cases: null or empty text has no words, so ``base_failed`` is true and ``kept``
false; other nulls (and any further columns, whatever their names) play no part; repeated
rows are judged one by one and stay; an empty table gives an empty result; a long text is
compressed in whole and, above one chunk, in chunks up to its last byte: what is left over is a
chunk too, judged by the limits of its own length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from denspark.lineage import bounded_batches
from denspark.llm import textops

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

#: (smallest number of bytes, lowest ratio, highest ratio) for whole documents.
BANDS = ((0, 0.0, 100.0), (64, 0.7, 3.0), (256, 1.15, 3.5), (1024, 1.4, 4.0), (4096, 1.5, 5.0), (16384, 1.6, 6.0))
#: Bytes of a chunk, the same limits for chunks by their length, and the share of chunks that may lie outside.
CHUNK, CHUNK_SHARE = 4096, 0.2
CHUNK_BANDS = ((0, 0.0, 100.0), (64, 0.7, 3.5), (256, 1.1, 4.0), (1024, 1.25, 5.0), (4096, 1.4, 6.0))
LEVEL = 3

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, zstd_ratio double, chunks long, chunks_outside long"
_ARROW = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("zstd_ratio", pa.float64()), ("chunks", pa.int64()), ("chunks_outside", pa.int64())])

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_SPACE = np.zeros(256, bool)
_SPACE[list(textops.SPACES)] = True


def repeated_words(words: textops.Words, size: int = 8) -> np.ndarray:
    """For each document, the words that lie in a ``size``-word window which its text holds twice or more."""
    hashes, bounds = textops.windows(words.hashes, words.bounds, size)
    docs = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))
    first = np.arange(len(hashes)) + np.repeat(words.bounds[:-1] - bounds[:-1], np.diff(bounds))
    key = hashes ^ textops.mix(docs + np.uint64(0x51ED27))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(change, first[twice], 1)
    np.add.at(change, first[twice] + size, -1)
    return textops.sums_by(np.cumsum(change[:-1]) > 0, words.bounds)


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line of the same text."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def band(n_bytes: int, bands=BANDS) -> tuple[float, float]:
    """The lowest and highest ratio for a document (or chunk) of that many bytes."""
    return next((low, high) for least, low, high in reversed(bands) if n_bytes >= least)


def compression(text: bytes, packer: zstandard.ZstdCompressor, bands=BANDS, chunk: int = CHUNK) -> tuple[float, int, int, bool]:
    """Ratio of the whole text, its chunks, those outside the limits of their length, and the verdict."""
    if not text:
        return 0.0, 0, 0, False
    ratio = len(text) / len(packer.compress(text))
    low, high = band(len(text), bands)
    chunks = outside = 0
    if len(text) > chunk:
        for i in range(0, len(text), chunk):
            chunks += 1
            part = text[i : i + chunk]
            least, most = band(len(part), CHUNK_BANDS)
            outside += not least <= len(part) / len(packer.compress(part)) <= most
    return ratio, chunks, outside, low <= ratio <= high and outside <= CHUNK_SHARE * chunks


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=LEVEL)
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        for row, raw, offs in textops.slices(textops.text_column(batch)):
            words = textops.Words(raw, offs, lower=False)
            n_words = np.diff(words.bounds)
            word_chars = textops.sums_by(textops.code_points(raw) & ~_SPACE[raw], offs)
            symbols = textops.sums_by(_SYMBOL[raw], offs)
            repeats = repeated_words(words)
            failed = (n_words < 20) | (100 * repeats > 30 * n_words)
            whole, texts = raw.tobytes(), []
            for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                texts.append(whole[a:b])
            lines = [duplicate_lines(t) for t in texts]
            ratio, chunks, outside, fits = zip(*(compression(t, packer) for t in texts), strict=True)
            yield textops.record_batch(_ARROW, ids.slice(row, len(texts)), n_words, word_chars, symbols, lines, repeats, failed, np.array(fits) & ~failed, ratio, chunks, outside)


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document with its counts, compression figures and whether it is ``kept``."""
    return docs.select("doc_id", "text").mapInArrow(_judge, SCHEMA)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that :func:`quality_rules` keeps, with their columns as they were.

    Rows are judged and dropped in one pass, so the text is never shuffled or joined: rows that share a
    ``doc_id`` (or have none), repeated rows and columns of any name are no special case, a null or
    empty text goes, and an empty table stays empty.
    """
    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(_keeper, docs.schema)


def _keeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = pa.array(np.arange(batch.num_rows), pa.int64())
        text = batch.column(batch.schema.get_field_index("text"))
        judged = [x.column(x.schema.get_field_index("kept")) for x in _judge([pa.RecordBatch.from_arrays([ids, text], names=["doc_id", "text"])])]
        if judged:
            yield batch.filter(pa.concat_arrays(judged))

r"""Fill-in-middle transformation by overlapping-chunk decomposition.

A text is ``n`` tokens ``[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+``: a word with the white space before
it, and white space at the end. So a token ends where a word ends, and two adjacent characters tell:
the first is of a word, the second is not (or the text ends). Texts are cut into chunks of ``CHUNK``
bytes that overlap by the one character that the last one of a chunk has to be held against:

1. boundaries are counted chunk by chunk, ``RUN`` bytes of chunks at once, whatever texts they are of;
2. prefix sums over the counts give each text's number of tokens, and name the chunk that owns the
   rank of each of the two cuts;
3. only these chunks are scanned again, for the place of the cut. Texts that stay plain have no cuts.

Spark deals the texts over tasks; nothing is shuffled. A task holds one Arrow batch and the masks of RUN bytes.

Which texts are transformed, how, and where they are cut follows from the sha256 of ``seed:doc_id``,
so reruns agree and rows that share an id share their ranks.

Defined cases: null text is empty and stays plain (null again in :func:`transform_texts`); a text that
holds a sentinel stays plain, so the output can always be read back; a text of white space is one token;
repeated rows give repeated results; a null doc_id hashes as the seed and the colon alone; an empty
table gives an empty result; further columns play no part; long texts are one row and never cut short.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from denspark.llm import textops

#: Bytes of a chunk, and of chunks whose boundaries are counted at once.
CHUNK, RUN = 4096, 1 << 20
#: What stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_SENTINELS = [x.encode() for x in (PREFIX, SUFFIX, MIDDLE)]
_WORD = np.ones(256, bool)
_WORD[list(textops.SPACES)] = False
_RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def word_ends(part: np.ndarray, last: np.ndarray) -> np.ndarray:
    """True where a word ends; ``part`` is one byte longer than what is asked for, unless the text ends there.

    ``last``: places of the last byte of each text in it.
    """
    word = _WORD[part]
    after = np.zeros(len(part), bool)
    after[:-1] = word[1:]
    after[last] = False
    return word & ~after


class Chunks:
    """The overlapping chunks of the texts of a slice, and the boundaries that each of them holds."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, chunk: int | None = None, run: int | None = None):
        self.raw, self.offs = raw, offs
        chunk, run = chunk or CHUNK, run or RUN
        many = -(-np.diff(offs) // chunk)
        self.bounds = np.concatenate([[0], np.cumsum(many)])
        text = np.repeat(np.arange(len(many)), many)
        self.starts = offs[text] + (np.arange(len(text)) - self.bounds[text]) * chunk
        self.stops = np.minimum(self.starts + chunk, offs[text + 1])
        self.closes = self.stops == offs[text + 1]
        counts = np.zeros(len(text), np.int64)
        at = 0
        while at < len(text):
            end = max(at + 1, int(np.searchsorted(self.stops, self.starts[at] + run, "right")))
            counts[at:end] = np.add.reduceat(self._ends(at, end), self.starts[at:end] - self.starts[at], dtype=np.int64)
            at = end
        self.total = np.concatenate([[0], np.cumsum(counts)])
        #: Words of each text, and tokens: white space at the end is one more.
        self.words = np.diff(self.total[self.bounds])
        full = np.diff(offs) > 0
        tail = np.zeros(len(many), bool)
        tail[full] = ~_WORD[raw[offs[1:][full] - 1]]
        self.tokens = self.words + tail

    def _ends(self, at: int, end: int) -> np.ndarray:
        """Boundaries of the chunks ``at`` to ``end`` (exclusive), which lie side by side."""
        low, high = self.starts[at], self.stops[end - 1]
        last = self.stops[at:end][self.closes[at:end]] - 1 - low
        return word_ends(self.raw[low : high + 1], last)[: high - low]

    def place(self, text: int, rank: int) -> int:
        """Byte of a text's slice where its token number ``rank`` ends (0: where it begins); scans one chunk."""
        if rank == 0:
            return int(self.offs[text])
        if rank > self.words[text]:
            return int(self.offs[text + 1])
        wanted = self.total[self.bounds[text]] + rank
        owner = int(np.searchsorted(self.total, wanted, "left")) - 1
        return int(self.starts[owner] + np.flatnonzero(self._ends(owner, owner + 1))[wanted - self.total[owner] - 1]) + 1


def draws(seed: int, doc_id: int | None) -> list[int]:
    """The first four 32-bit numbers of the sha256 of ``seed:doc_id``."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def _cut(rate: int, spm: int, seed: int):
    """(n, form, prefix, middle, output) of each text of a slice: code points of both (None if plain), and bytes."""

    def run(ids: list, raw: np.ndarray, offs: np.ndarray) -> Iterator[tuple]:
        chunks, whole = Chunks(raw, offs), raw.tobytes()
        for k, (doc_id, n) in enumerate(zip(ids, chunks.tokens.tolist(), strict=True)):
            text = whole[offs[k] : offs[k + 1]]
            h1, h2, h3, h4 = draws(seed, doc_id)
            if h3 % 100 >= rate or not text or any(x in text for x in _SENTINELS):
                yield n, "plain", None, None, text
                continue
            a, b = (chunks.place(k, r) - int(offs[k]) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
            prefix, middle, suffix = text[:a], text[a:b], text[b:]
            p, s, m = _SENTINELS
            form = "spm" if h4 % 100 < spm else "psm"
            output = s + suffix + p + prefix + m + middle if form == "spm" else p + prefix + s + suffix + m + middle
            yield n, form, len(prefix.decode()), len(middle.decode()), output

    return run


def fill_in_middle(docs: DataFrame, rate: int = 50, spm: int = 80, seed: int = 42) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): ``rate`` percent of the texts cut into prefix, middle and
    suffix and written with the middle last; ``spm`` percent of these with the suffix first. Others are ``plain``."""
    cut = _cut(rate, spm, seed)
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in _RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            for row, raw, offs in textops.slices(textops.text_column(batch)):
                own = ids[row : row + len(offs) - 1]
                columns = [own, *zip(*cut(own, raw, offs), strict=True)]
                columns[-1] = pa.array(columns[-1], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, _RESULT)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    prefix, suffix = (F.when(form == "spm", F.get(part, F.lit(i))).otherwise(F.get(part, F.lit(3 - i))) for i in (2, 1))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, F.get(part, F.lit(3)), suffix))


def transform_texts(docs: DataFrame, rate: int = 50, spm: int = 80, seed: int = 42) -> DataFrame:
    """``docs`` with the transformed ``text`` (null stays null) and all other columns as they were."""
    cut = _cut(rate, spm, seed)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            null = batch.column(at).is_null().to_pylist()
            made = []
            for row, raw, offs in textops.slices(textops.text_column(batch)):
                made += [x[-1] for x in cut(ids[row : row + len(offs) - 1], raw, offs)]
            texts = pa.array([None if gone else x for x, gone in zip(made, null, strict=True)], pa.binary()).cast(batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([texts if i == at else x for i, x in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def fim_report(docs: DataFrame) -> DataFrame:
    """Digests of the outputs and of the texts read back from them."""
    made = fill_in_middle(docs)
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w FROM documents),
r AS (
  SELECT *, len(w) AS n, ('0x' || substr(h, 1, 8))::UBIGINT::BIGINT % (len(w) + 1) AS r1, ('0x' || substr(h, 9, 8))::UBIGINT::BIGINT % (len(w) + 1) AS r2,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(h, 17, 8))::UBIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::UBIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (
  SELECT *, array_to_string(list_slice(w, 1, least(r1, r2)), '') AS pre, array_to_string(list_slice(w, least(r1, r2) + 1, greatest(r1, r2)), '') AS mid,
         array_to_string(list_slice(w, greatest(r1, r2) + 1, n), '') AS suf FROM r)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE pre || mid || suf END) AS restored_sha256
FROM p
"""

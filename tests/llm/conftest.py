import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, node long, body string, spans string, `key` long, copies long"


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def make_rows():
    """Null and empty texts, copies, near copies, shared passages, repeated rows, null ids, a long text, odd characters."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(900)] + ["Élan", "straße", "日本"]
    texts = [None, "", "   \n\t ", "one", "two words", "a b c d", "A b C d", "x" * 30_000, "word " * 400]
    base = prose(rng, 220, words).split()
    texts.append(" ".join(base))
    for k in range(8):
        copy = list(base)
        for _ in range(1 + k // 2):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(copy))
    texts += [" ".join(base).upper(), " ".join(base)]
    shared = prose(rng, 60, words)
    for k in range(6):
        texts.append(prose(rng, 30 + 20 * k, words) + "\n" + shared + "\n" + prose(rng, 40, words))
    texts += [prose(rng, 120, words) for _ in range(6)]
    texts.append("Mail a@b.com_x@c.de, a.b@c..d me@x-y.org. Call +1 (555) 123-4567 or +12, host 10.0.0.255 1.2.3.256 1.2.3.4.5 card 4111 1111 1111 1111 and 4111-1111-1111-1112, IBAN DE89 3704 0044 0532 0130 00. é😀 q@r.st")
    texts.append("Under the Apache License; MIT license. CC BY\nSPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0\nGNU  General-Public license")
    texts.append(("same line here with words\n" * 30) + "#*$%&|<>")
    texts.append(prose(rng, 6000, words))
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(3, "one"), (None, prose(rng, 50, words)), (None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows as documents with columns whose names clash with helpers."""
    full = [(d, t, None, None if k % 7 == 0 else f"s{k % 3}", None if t is None else len(t), "r", 1, "b", "s", 2, 9) for k, (d, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

"""License scans: Aho-Corasick phrases and tags, then a shunting-yard parser for licence expressions.

One automaton finds every notice phrase and identifier tag in one walk over the normalised
words of a text. Where a tag ends, a shunting-yard parser reads the licence expression behind it,
token by token, as far as it is one: identifiers (by family, version and suffix), ``and``,
``or`` (also written as a slash), ``with`` and parentheses. An operand that looks like an identifier but isn't
known has no label and leaves no open choice; brackets that are still open at the end are closed. What it has read is
evaluated to labels and to whether it leaves an open choice. One Arrow pass, no shuffle, linear in a
text's length. Both tables, of notices and of identifiers, are arguments.

The score is 1 with an expression behind a tag; otherwise it grows with the weights of the different
phrases found, up to ``MOST``, and is 0 without any.

Defined cases: null or empty text has no words, empty labels and score 0; other nulls and
further columns play no part; repeated rows are scanned one by one; overlapping places all
count; of an expression that breaks off, the part that is one counts ("MIT or contact us" and "(MIT" are
MIT, "Foo-1.0 OR MIT" names MIT), and a tag before anything else, or before unknown names alone, has no expression; an empty table gives an empty result;
long texts are scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from denspark.llm import textops

#: Notice phrases of the base and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notice phrases and their labels: names of licences, and sentences that only stand in their texts.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "gnu gpl": "gpl",
    "gnu lgpl": "lgpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "common development and distribution license": "cddl",
    "common public license": "cpl",
    "european union public licence": "eupl",
    "academic free license": "afl",
    "open software license": "osl",
    "artistic license": "artistic",
    "boost software license": "bsl",
    "business source license": "busl",
    "server side public license": "sspl",
    "elastic license": "elastic",
    "microsoft public license": "ms-pl",
    "microsoft reciprocal license": "ms-rl",
    "python software foundation license": "psf",
    "php license": "php",
    "postgresql license": "postgresql",
    "sil open font license": "ofl",
    "open database license": "odbl",
    "open data commons attribution license": "odc-by",
    "universal permissive license": "upl",
    "zlib license": "zlib",
    "isc license": "isc",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "bsd zero clause": "0bsd",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0 1 0": "cc0",
    "creative commons zero": "cc0",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
    "licensed under the apache license version 2 0": "apache",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "do what the fuck you want to public license": "wtfpl",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "dedicated to the public domain": "public-domain",
    "released into the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
#: Phrases after which a licence expression stands.
TAGS = ("spdx license identifier", "spdx license expression", "license expression")
#: Families of identifiers (lower case): label and known versions; an identifier is a family, a version or none, and a suffix or none.
FAMILIES = {
    "agpl": ("agpl", "1.0 3.0"), "gpl": ("gpl", "1.0 2.0 3.0"), "lgpl": ("lgpl", "2.0 2.1 3.0"), "gfdl": ("gfdl", "1.1 1.2 1.3"),
    "apache": ("apache", "1.0 1.1 2.0"), "mit": ("mit", ""), "mit-0": ("mit", ""), "x11": ("mit", ""), "isc": ("isc", ""), "0bsd": ("0bsd", ""),
    "bsd": ("bsd", ""), "bsd-1-clause": ("bsd", ""), "bsd-2-clause": ("bsd", ""), "bsd-3-clause": ("bsd", ""), "bsd-4-clause": ("bsd", ""), "bsd-2-clause-patent": ("bsd", ""), "bsd-3-clause-clear": ("bsd", ""),
    "mpl": ("mpl", "1.0 1.1 2.0"), "epl": ("epl", "1.0 2.0"), "cddl": ("cddl", "1.0 1.1"), "cpl": ("cpl", "1.0"), "eupl": ("eupl", "1.0 1.1 1.2"), "afl": ("afl", "1.1 1.2 2.0 2.1 3.0"), "osl": ("osl", "1.0 1.1 2.0 2.1 3.0"), "ecl": ("ecl", "1.0 2.0"),
    "artistic": ("artistic", "1.0 2.0"), "bsl": ("bsl", "1.0"), "busl": ("busl", "1.1"), "sspl": ("sspl", "1.0"), "elastic": ("elastic", "2.0"), "ms-pl": ("ms-pl", ""), "ms-rl": ("ms-rl", ""), "psf": ("psf", "2.0"), "python": ("psf", "2.0"),
    "php": ("php", "3.0 3.01"), "ruby": ("ruby", ""), "openssl": ("openssl", ""), "postgresql": ("postgresql", ""), "ncsa": ("ncsa", ""), "upl": ("upl", "1.0"), "vim": ("vim", ""), "w3c": ("w3c", ""), "ofl": ("ofl", "1.0 1.1"), "zlib": ("zlib", ""), "libpng": ("libpng", "2.0"),
    "unlicense": ("unlicense", ""), "wtfpl": ("wtfpl", ""), "curl": ("curl", ""), "icu": ("icu", ""), "json": ("json", ""), "hpnd": ("hpnd", ""), "unicode-dfs": ("unicode", "2015 2016"), "blueoak": ("blueoak", "1.0.0"), "mulanpsl": ("mulanpsl", "1.0 2.0"),
    "cc0": ("cc0", "1.0"), "cc-by": ("cc-by", "1.0 2.0 2.5 3.0 4.0"), "cc-by-sa": ("cc-by-sa", "1.0 2.0 2.5 3.0 4.0"), "cc-by-nc": ("cc-by-nc", "1.0 2.0 2.5 3.0 4.0"), "cc-by-nd": ("cc-by-nd", "1.0 2.0 2.5 3.0 4.0"), "cc-by-nc-sa": ("cc-by-nc-sa", "1.0 2.0 2.5 3.0 4.0"), "cc-by-nc-nd": ("cc-by-nc-nd", "1.0 2.0 2.5 3.0 4.0"),
    "odbl": ("odbl", "1.0"), "odc-by": ("odc-by", "1.0"), "pddl": ("pddl", "1.0"),
}
#: Further families, each its own label, with their versions.
_MORE = """aal; aladdin; apsl 1.0 1.1 1.2 2.0; bittorrent 1.0 1.1; borceux; bzip2 1.0.5 1.0.6; caldera; catosl 1.1; cecill 1.0 1.1 2.0 2.1; cecill-b; cecill-c;
clartistic; cnri-python; cpal 1.0; cpol 1.02; crossword; cua-opl 1.0; d-fsl 1.0; diffmark; dsdp; efl 1.0 2.0; entessa; erlpl 1.1; etalab 2.0; eudatagrid; fair; frameworx 1.0;
freeimage; fsfap; fsful; fsfullr; ftl; gl2ps; gnuplot; ijg; imagemagick; imatix; intel; ipa; ipl 1.0; jasper 2.0; lal 1.2 1.3; latex2e; leptonica; liliq-p 1.1; liliq-r 1.1;
linux-openib; lpl 1.0 1.02; lppl 1.0 1.1 1.2 1.3a 1.3c; makeindex; miros; motosoto; mpich2; mtll; multics; mup; nasa 1.3; naumen; nbpl 1.0; netcdf; newsletr; ngpl; nist-pd; nlod 1.0 2.0;
nokia; nosl; noweb; npl 1.0 1.1; nposl 3.0; nrl; ntp; oclc 2.0; ogl-uk 1.0 2.0 3.0; ogtsl; oldap 1.1 1.2 1.3 1.4 2.0 2.1 2.2 2.3 2.4 2.5 2.6 2.7 2.8; o-uda 1.0; oset-pl 2.1;
parity 6.0.0 7.0.0; plexus; polyform-noncommercial 1.0.0; polyform-small-business 1.0.0; psutils; qhull; qpl 1.0; rhecos 1.1; rpl 1.1 1.5; rpsl 1.0; rsa-md; rscpl; saxpath; sendmail;
sgi-b 1.0 1.1 2.0; shl 0.5 0.51; simpl 2.0; sissl 1.2; sleepycat; smlnj; snia; spencer-86; spencer-94; spl 1.0; sugarcrm 1.1.3; swl; tapr-ohl 1.0; tcl; tcp-wrappers; tmate; torque 1.1; tosl;
ucl 1.0; unicode 3.0; vostrom; vsl 1.0; watcom 1.0; wsuipa; x11-distribute-modifications-variant; xerox; xfree86 1.1; xinetd; xnet; xpp; xskat; ypl 1.0 1.1; zed; zend 2.0; zimbra 1.3 1.4; zpl 1.1 2.0 2.1"""
FAMILIES |= {name: (name, " ".join(versions)) for name, *versions in (x.split() for x in _MORE.split(";"))}
SUFFIXES = ("-only", "-or-later", "-no-copyleft-exception", "+")
#: Labels whose terms let a text be reused freely; ``or`` needs one side, ``and`` both.
OPEN = frozenset("apache mit bsd 0bsd isc zlib libpng bsl psf php postgresql ncsa upl unlicense wtfpl curl icu hpnd unicode blueoak mulanpsl ecl afl artistic ofl mpl epl cddl cpl cc0 cc-by odc-by pddl public-domain".split())
#: Weight of a phrase by its number of words (names of two words are often mere mentions), and most that phrases alone score.
WEIGHTS, LONG, MOST = {2: 0.5, 3: 0.6, 4: 0.7}, 0.85, 0.95

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string, is_open boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")], ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.string()), ("is_open", pa.bool_())])

_FOLD = bytearray(range(256))
for _b in range(128):
    _c = chr(_b)
    _FOLD[_b] = ord(_c.lower()) if _c.isalnum() else 32
_FOLD = bytes(_FOLD)
_WORD = re.compile(rb"[^ ]+")
_LEAD = re.compile(rb"[\"']?[ \t]*[:=]?[ \t]*[\"']?")
_TOKEN = re.compile(rb"[ \t]*([()/]|[A-Za-z0-9][A-Za-z0-9.+:_-]*)")
#: What an identifier that no table has looks like: words of letters and digits, joined by hyphens.
_LIKELY = re.compile(r"[a-z0-9][a-z0-9.+]*(-[a-z0-9.+]+)+")
_EXCEPTION = re.compile(r"[a-z0-9.-]+-exception(?:-[0-9.]+)?|linux-syscall-note")
_RANK = {"or": 1, "and": 2, "with": 3}


def weight(phrase: str) -> float:
    return WEIGHTS.get(len(phrase.split()), LONG)


def automaton(notices: dict[str, str] = NOTICES) -> ahocorasick.Automaton:
    """All phrases and tags, each with a space on both sides so that only whole words match."""
    found = ahocorasick.Automaton()
    for phrase, label in (notices | BASE).items():
        found.add_word(f" {phrase} ", (phrase, label, phrase in BASE))
    for tag in TAGS:
        found.add_word(f" {tag} ", (tag, None, False))
    found.make_automaton()
    return found


def label_of(identifier: str, families: dict[str, tuple[str, str]] = FAMILIES) -> str | None:
    """The label of a licence identifier (lower case), None for what isn't one; LicenseRef- names are their own labels."""
    if identifier.startswith("licenseref-") and len(identifier) > len("licenseref-"):
        return identifier
    for suffix in SUFFIXES:
        if identifier.endswith(suffix):
            identifier = identifier[: -len(suffix)]
            break
    if identifier in families:
        return families[identifier][0]
    family, _, version = identifier.rpartition("-")
    label, versions = families.get(family, (None, ""))
    return label if version in versions.split() else None


def is_operand(token: str, after: str | None, families: dict[str, tuple[str, str]] = FAMILIES) -> bool:
    """Whether a token may stand where an operand is wanted: what looks like an identifier, an exception after ``with``, or a licence."""
    if _LIKELY.fullmatch(token):
        return True
    return bool(_EXCEPTION.fullmatch(token)) if after == "with" else label_of(token, families) is not None


def tokens(text: bytes, at: int = 0) -> Iterator[str]:
    """Tokens of an expression from there on, in lower case, up to the first byte that belongs to none."""
    while m := _TOKEN.match(text, at):
        token = "or" if m[1] == b"/" else m[1].decode().lower()
        yield token.rstrip(".:-_") if len(token) > 1 else token
        at = m.end()


def to_postfix(expression: str | Iterable[str], operand: Callable[[str, str | None], bool] = lambda token, after: True) -> list[str] | None:
    """Shunting-yard: the postfix form of the longest beginning that is a licence expression, its open brackets closed; None if there is none."""
    out: list[str] = []
    ops: list[str] = []
    whole = None  # the length of the output and the operators left when the expression was last complete
    want = True  # an operand or "(" comes next
    for token in tokens(expression.encode()) if isinstance(expression, str) else expression:
        if token in _RANK:
            if want or token == "with" and ops and ops[-1] == "with":
                break
            while ops and ops[-1] != "(" and _RANK[ops[-1]] >= _RANK[token]:
                out.append(ops.pop())
            ops.append(token)
            want = True
        elif token == "(":
            if not want or ops and ops[-1] == "with":
                break
            ops.append(token)
        elif token == ")":
            if want or "(" not in ops:
                break
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
        elif want and operand(token, ops[-1] if ops else None):
            out.append(token)
            want = False
        else:
            break
        if not want:
            whole = len(out), [x for x in ops[::-1] if x != "("]
    return None if whole is None else out[: whole[0]] + whole[1]


def evaluate(postfix: list[str], families: dict[str, tuple[str, str]] = FAMILIES) -> tuple[set[str], bool]:
    """The labels an expression names and whether it leaves an open choice; ``with`` keeps its left side's terms."""
    stack: list[tuple[set[str], bool]] = []
    for token in postfix:
        if token in _RANK:
            right, left = stack.pop(), stack.pop()
            if token == "with":
                stack.append(left)
            else:
                stack.append((left[0] | right[0], (left[1] or right[1]) if token == "or" else left[1] and right[1]))
        else:
            label = label_of(token, families)
            stack.append(({label} - {None}, label in OPEN))
    return stack[0]


def scan(text: bytes, phrases: ahocorasick.Automaton, families: dict[str, tuple[str, str]] = FAMILIES) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, is_open) of one text."""
    folded = text.translate(_FOLD)
    words = folded.split()
    line = " " + b" ".join(words).decode("latin-1") + " "
    base, labels, found, starts, tags = set(), set(), set(), [], []
    for end, (phrase, label, is_base) in phrases.iter(line):
        if label is None:
            tags.append(end)
            continue
        found.add(phrase)
        labels.add(label)
        if is_base:
            base.add(label)
            starts.append(end - len(phrase) - 1)
    # Position of a phrase in words: the spaces before it, counted once along the sorted places.
    starts.sort()
    first = last = None
    if starts:
        first = line.count(" ", 0, starts[0] + 1) - 1
        last = first + line.count(" ", starts[0] + 1, starts[-1] + 1)
    expressions, choices = [], []
    if tags:
        # Where each word ends in the text; folding keeps places.
        ends = [m.end() for m in _WORD.finditer(folded)]
        n, before = 0, 0
        for end in sorted(set(tags)):
            n, before = n + line.count(" ", before, end), end
            postfix = to_postfix(tokens(text, _LEAD.match(text, ends[n - 1]).end()), lambda token, after: is_operand(token, after, families))
            named, free = evaluate(postfix, families) if postfix else (set(), False)
            if named:
                labels |= named
                choices.append(free)
                expressions.append(" ".join(postfix))
    doubt = 1.0
    for phrase in sorted(found):
        doubt *= 1 - weight(phrase)
    score = 1.0 if expressions else min(MOST, round(1 - doubt, 6))
    is_open = (all(choices) if choices else bool(labels)) and all(x in OPEN for x in (labels if not choices else base))
    return len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, "; ".join(expressions), is_open


def license_scan(docs: DataFrame, notices: dict[str, str] = NOTICES, families: dict[str, tuple[str, str]] = FAMILIES) -> DataFrame:
    """One row per document with its counts, places, labels, score and expressions.

    ``notices``: phrases (words in lower case, one space between) and their labels, besides the base; ``families``:
    identifiers in lower case, each with its label and known versions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = automaton(notices)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for row, raw, offs in textops.slices(textops.text_column(batch)):
                whole = np.ascontiguousarray(raw).tobytes()
                found = [scan(whole[a:b], phrases, families) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                yield textops.record_batch(_ARROW, ids.slice(row, len(found)), *map(list, zip(*found, strict=True)))

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)

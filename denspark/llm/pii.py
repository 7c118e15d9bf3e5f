r"""PII: patterns propose spans, checksums and ranges confirm them, nearby words adjust the score.

Native DataFrame functions only. A pattern cuts a text into gaps (``split``) and matches
(``regexp_extract_all``); running totals of their lengths give positions in code points.
Quantifiers are possessive and start at the edge of a run, which finds the same matches in linear
time without deep recursion. No shuffle: one pass over the documents, linear in a text's length
and in its number of matches.

Words near a span (``CONTEXT`` characters on either side) that name its kind raise its score,
words that tell of something else (a version, an order number, a sample) lower it.

Defined cases: null text is empty and has no span; other nulls and further columns, whatever
their names, play no part; repeated rows are scanned one by one; spans of different kinds may
overlap (masking merges them, and the one that begins first, or else the longest, gives the
name); an empty table gives an empty result; long texts are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from denspark.llm.scans import blocks, let, part, running, sums_before

# The number of characters of an account number (IBAN) by country, check digits included.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def _iban() -> str:
    """Country, check digits and exactly as many characters as the country has, with single spaces between any of them."""
    lengths = sorted(set(IBAN_LENGTHS.values()))
    kinds = [f"(?:{'|'.join(c for c, n in IBAN_LENGTHS.items() if n == size)})[0-9] ?[0-9](?: ?[A-Z0-9]){{{size - 4}}}" for size in lengths]
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9])(?:{'|'.join(kinds)})(?![A-Za-z0-9])"


#: Kinds of the base, then those added, in the order of the result; Java patterns.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": _iban(),
}
BASE = ("email", "ip", "card", "phone")
#: A byte string that every match of the kind holds, to skip other texts.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: Score of a confirmed span, words that raise it, and words that lower it, when they stand within CONTEXT characters.
SCORES = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.8}
NEAR_WORDS = {
    "email": "mail|contact|write|address",
    "ip": "ip|host|server|address|login",
    "card": "card|credit|visa|mastercard|payment|account",
    "phone": "phone|tel|call|mobile|fax|contact",
    "iban": "iban|bank|account|transfer|konto",
}
OTHER_WORDS = {
    "email": "sample|dummy|placeholder|fictitious",
    "ip": "version|release|firmware|section|chapter|netmask",
    "card": "order|invoice|tracking|serial|isbn|sample|dummy",
    "phone": "order|invoice|serial|isbn|sample|dummy",
    "iban": "sample|dummy|placeholder|fictitious",
}
RAISE, LOWER, CONTEXT = 0.2, 0.2, 40
_SPAN = "struct<kind:string,start:bigint,end:bigint,score:double>"


def _confirmed(kind: str) -> str:
    """SQL condition on the match ``x.hit``."""
    digits = "regexp_replace(x.hit, '[^0-9]', '')"
    if kind == "ip":
        part = "ltrim('0', p)"
        return f"forall(split(x.hit, '[.]'), p -> length({part}) <= 3 and coalesce(try_cast({part} as int), 0) <= 255)"
    if kind == "card":
        return f"length({digits}) between 16 and 19 and luhn_check({digits})"
    if kind == "phone":
        return f"length({digits}) between 8 and 15"
    if kind == "iban":
        packed = "replace(x.hit, ' ', '')"
        turned = f"concat(substring({packed}, 5), left({packed}, 4))"
        value = "case when c between '0' and '9' then int(c) else ascii(c) - 55 end"
        return f"length({packed}) between 15 and 34 and aggregate(split({turned}, ''), 0, (r, c) -> case when c = '' then r when {value} < 10 then (r * 10 + {value}) % 97 else (r * 100 + {value}) % 97 end) = 1"
    return "true"


def _placed(kind: str) -> Column:
    """All matches of a kind as array<struct<start,end,hit,near>>, from g_<kind> and m_<kind>; null without one."""
    g, m = f"g_{kind}", f"m_{kind}"
    steps = f"sequence(0, size({m}) - 1)"
    widths = f"transform({steps}, i -> cast(length(get({g}, i)) + length(get({m}, i)) as bigint))"
    start = f"get(b, i) + length(get({g}, i))"
    near = f"lower(concat(right(get({g}, i), {CONTEXT}), ' ', left(get({g}, i + 1), {CONTEXT})))"
    one = f"named_struct('start', {start}, 'end', {start} + length(get({m}, i)), 'hit', get({m}, i), 'near', {near})"
    return F.expr(f"case when size({m}) > 0 then get(transform(array({widths}), w -> get(transform(array({sums_before('w')}), b -> transform({steps}, i -> {one})), 0)), 0) end")


def _spans(kind: str) -> Column:
    """Confirmed spans of a kind as array<struct<kind,start,end,score>>, from p_<kind>."""
    near = f"case when regexp_like(x.near, '\\\\b(?:{NEAR_WORDS[kind]})') then {RAISE} else 0 end - case when regexp_like(x.near, '\\\\b(?:{OTHER_WORDS[kind]})') then {LOWER} else 0 end"
    item = f"named_struct('kind', '{kind}', 'start', x.start, 'end', x.end, 'score', cast({SCORES[kind]} + {near} as double))"
    return F.expr(f"coalesce(transform(filter(p_{kind}, x -> {_confirmed(kind)}), x -> {item}), cast(array() as array<{_SPAN}>))")


def _scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, body, spans): the caller's columns in one struct, so that helper names can't clash, the text, and its spans."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    out = docs.select(own, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))
    matches = {}
    for kind, pattern in PATTERNS.items():
        found = F.regexp_extract_all("body", F.lit(pattern), F.lit(0))
        matches[f"m_{kind}"] = F.when(F.col("body").contains(NEEDS[kind]), found).otherwise(F.lit([]).cast("array<string>")) if kind in NEEDS else found
    out = out.withColumns(matches)
    out = out.withColumns({f"g_{k}": F.when(F.size(f"m_{k}") > 0, F.split("body", p, -1)) for k, p in PATTERNS.items()})
    out = out.withColumns({f"p_{k}": _placed(k) for k in PATTERNS})
    return out.select("row", "body", F.concat(*[_spans(k) for k in PATTERNS]).alias("spans"))


def find_spans(docs: DataFrame, text: str = "text", into: str = "pii_spans") -> DataFrame:
    """``docs`` with a column ``into``: array of (kind, start, end, score), by kind and then start.

    A column of that name in ``docs`` is replaced.
    """
    row = F.col("row")
    return _scanned(docs, text).select(*[row[c].alias(c) for c in docs.columns if c != into], F.col("spans").alias(into))


def _joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def pii_report(docs: DataFrame) -> DataFrame:
    """One row per document: counts by kind, digest of the base spans, all spans and their scores."""
    base = "filter(spans, x -> x.kind in (" + ", ".join(f"'{k}'" for k in BASE) + "))"
    return _scanned(docs.select("doc_id", "text")).select(
        F.col("row")["doc_id"].alias("doc_id"),
        *[F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined("spans").alias("spans"),
        F.expr("cast(size(filter(spans, x -> x.kind = 'iban')) as bigint)").alias("n_iban"),
        F.expr("array_join(transform(spans, x -> format_string('%.1f', x.score)), ',')").alias("scores"),
    )


def _masked(body: Column, spans: Column) -> Column:
    """The text with the union of a non-empty array of spans, in order of their starts, replaced."""

    def write(pieces: Column, covered: Column) -> Column:
        steps = F.sequence(F.lit(0), F.size(spans) - 1)
        fresh = F.filter(steps, lambda i: F.get(spans, i)["start"] >= F.get(covered, i))
        out = F.transform(fresh, lambda i: F.concat(part(pieces, F.get(covered, i), F.get(spans, i)["start"]), F.lit("<"), F.upper(F.get(spans, i)["kind"]), F.lit(">")))
        last = F.greatest(F.get(covered, F.size(spans) - 1), F.get(spans, F.size(spans) - 1)["end"])
        return F.concat(F.array_join(out, ""), part(pieces, last, F.length(body).cast("long")))

    ends = F.transform(spans, lambda x: x["end"])
    # Where the spans before each one end: those that begin before that belong to their union.
    reach = let(ends, lambda e: running(e, F.lit(0).cast("long"), lambda a, x: F.greatest(a, x)))
    return let(blocks(body), lambda pieces: let(reach, lambda covered: write(pieces, covered)))


def mask_pii(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """``docs`` with spans of at least that score replaced by ``<KIND>`` in ``text``; overlapping spans become one.

    A column ``n_chars`` gets the new length of the texts that change; all others, of any name, stay as
    they are. Null texts stay null, repeated rows are masked one by one, an empty table stays empty.
    """
    order = "(l, r) -> case when l.start != r.start then int(sign(l.start - r.start)) else int(sign(r.end - l.end)) end"
    found = _scanned(docs).withColumn("spans", F.expr(f"array_sort(filter(spans, x -> x.score >= {least!r}), {order})"))
    some = F.size("spans") > 0
    row, text = F.col("row"), F.when(some, _masked(F.col("body"), F.col("spans"))).otherwise(F.col("row")["text"])
    found = found.select("row", some.alias("changed"), text.alias("masked"))
    columns = {c: row[c] for c in docs.columns} | {"text": F.col("masked")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("changed"), F.length("masked").cast(docs.schema["n_chars"].dataType)).otherwise(row["n_chars"])
    return found.select(*[v.alias(k) for k, v in columns.items()])

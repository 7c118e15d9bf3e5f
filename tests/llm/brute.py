"""Plain Python versions of the operators' contracts, for small fixtures."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    n, rep = len(words), len(covered)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), rep, n < 20 or 100 * rep > 30 * n


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def pii(text):
    text = text or ""
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]
    spans, counts = [], []
    for kind, pattern, good in rules:
        own = [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text) if good(m[0])]
        counts.append(len(own))
        spans += own
    return (*counts, hashlib.sha256(",".join(spans).encode()).hexdigest())


def shingles(text, size=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def components(docs, share=80):
    """doc_id -> (n_shingles, smallest doc_id reachable by links, number of links)."""
    sets = {d: shingles(t) for d, t in docs}
    ids = sorted(sets)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for d in ids:
        for s in sets[d]:
            holders.setdefault(s, []).append(d)
    pairs, links = Counter(), Counter()
    for own in holders.values():
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                pairs[a, b] += 1
    for (a, b), n in pairs.items():
        if 100 * n >= share * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
            links[a] += 1
            links[b] += 1
    return {d: (len(sets[d]), find(d), links[d]) for d in ids}


def repeats(docs, size=200):
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256)."""
    raws = {d: (t or "").encode() for d, t in docs}
    seen = Counter(r[i : i + size] for r in raws.values() for i in range(len(r) - size + 1))
    out = {}
    for d, r in raws.items():
        gone = bytearray(len(r))
        end = 0
        for i in range(len(r) - size + 1):
            if seen[r[i : i + size]] > 1:
                for j in range(max(i, end), i + size):
                    gone[j] = 1
                end = i + size
        runs = sum(1 for i in range(len(r)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(r), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=True) if not g)).hexdigest())
    return out


def licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    places = [(i, v) for k, v in phrases.items() for i in range(len(words)) if words[i : i + len(k.split())] == k.split()]
    at = sorted(i for i, _ in places)
    return len(words), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted({v for _, v in places}))


def license_verdict(text, phrases, tags, weight, label_of, is_exception, is_open):
    """(labels, score, is_open) by plain searches and a recursive parser over the same tables."""
    text = text or ""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    there = lambda phrase: any(words[i : i + len(phrase.split())] == phrase.split() for i in range(len(words)))
    found = [p for p in phrases if there(p)]
    labels = {phrases[p] for p in found}
    low, gap, word = re.sub("[A-Z]", lambda m: m[0].lower(), text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
    ends = {m.end(1) for tag in tags for m in re.finditer(rf"(?<!{word})(?=({gap.join(tag.split())})(?!{word}))", low)}
    choices = []
    for end in sorted(ends):
        rest = re.match(r"[\"']?[ \t]*[:=]?[ \t]*[\"']?(.*)", text[end:])[1]
        parts = []
        while m := re.match(r"[ \t]*([()/]|[A-Za-z0-9][A-Za-z0-9.+:_-]*)", rest):
            parts.append("or" if m[1] == "/" else m[1].lower().rstrip(".:-_") if len(m[1]) > 1 else m[1].lower())
            rest = rest[m.end() :]
        for n in range(len(parts), 0, -1):
            got = whole_expression(parts[:n], label_of, is_exception, is_open)
            if got:
                if got[0]:
                    labels |= got[0]
                    choices.append(got[1])
                break
    score = 1.0 if choices else min(0.95, round(1 - math.prod(1 - weight(p) for p in sorted(found)), 6))
    return ",".join(sorted(labels)), score, choices


def whole_expression(parts, label_of, is_exception, is_open):
    """Recursive descent: or, and, with; None unless all parts are one expression, brackets may stay open at the end."""
    at = 0
    likely = lambda x: bool(re.fullmatch(r"[a-z0-9][a-z0-9.+]*(-[a-z0-9.+]+)+", x))

    def peek():
        return parts[at] if at < len(parts) else None

    def atom():
        nonlocal at
        x = peek()
        at += 1
        if x == "(":
            inner = either()
            if inner is None or peek() not in (")", None):
                return None
            at += 1
        elif x is None or x in ("and", "or", "with", ")") or label_of(x) is None and not likely(x):
            return None
        else:
            inner = {label_of(x)} - {None}, is_open(label_of(x))
        if peek() == "with":
            at += 1
            if peek() is None or not (is_exception(peek()) or likely(peek())):
                return None
            at += 1
        return inner

    def series(word, item, join):
        nonlocal at
        left = item()
        while left is not None and peek() == word:
            at += 1
            right = item()
            left = None if right is None else (left[0] | right[0], join((left[1], right[1])))
        return left

    def both():
        return series("and", atom, all)

    def either():
        return series("or", both, any)

    got = either()
    return got if got is not None and at >= len(parts) else None


def low_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def fingerprint(text, size=4):
    """Majority of the bits of the shingles' hashes."""
    import xxhash

    words = low_words(text)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42) for i in range(max(1, len(words) - size + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_classes(prints, reach=4):
    """Place -> class of places whose numbers differ in at most ``reach`` bits, by all pairs."""
    label = list(range(len(prints)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= reach:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def fill_in_middle(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    form = "plain" if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50 else "spm" if h4 % 100 < 80 else "psm"
    out = {"plain": text, "psm": f"<P>{pre}<S>{suf}<M>{mid}", "spm": f"<S>{suf}<P>{pre}<M>{mid}"}[form]
    return doc_id, n, form, *((None, None) if form == "plain" else (len(pre), len(mid))), hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def audit(docs, labels):
    """(part, order, step) -> the seven counts, document by document in each order. ``docs``: (doc_id, text, source)."""
    from itertools import permutations

    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    out = Counter()
    for d, t, s in docs:
        text, part = t or "", s or ""
        words = WORD.findall(text)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), "D": any(c in "#$%&*|" for c in text), "E": d is not None and least[text] < d}
        good, toxic = (any(x[k] == 1 for x in labels if x[0] == d and d is not None) for k in (1, 2))
        for order in permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                key = (part, "".join(order), step)
                removed = fails[f] and not gone
                values = (not gone and not fails[f], removed, fails[f] and gone, fails[f] and sum(fails.values()) == 1, removed and good, removed and toxic)
                for k, v in enumerate(values):
                    out[key, k] += v
                out[part, f] += removed
                gone |= fails[f]
    keys = {k[0] for k in out if isinstance(k[0], tuple)}
    return {(*k, *(out[k, i] for i in range(6)), out[k[0], k[1][k[2] - 1]]) for k in keys}

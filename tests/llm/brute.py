"""Plain versions of the corpus queries, for small tables: rows are (doc_id, text)."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def substring(rows, width=50):
    seen, out = {}, {}
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in split:
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            seen[key] = min(seen.get(key, d), d)
    for d, w in split:
        gone = set()
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] < d:
                gone |= set(range(k, k + width))
        out[d] = len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def lines(rows, least=2):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    first, docs = {}, {}
    for d, t in rows:
        for s in (t or "").split("\n"):
            k = key(s)
            first[k] = min(first.get(k, d), d)
            docs.setdefault(k, set()).add(d)
    out = {}
    for d, t in rows:
        own = (t or "").split("\n")
        kept = [s for s in own if not (len(key(s)) >= 10 and len(docs[key(s)]) >= least and first[key(s)] < d)]
        out[d] = len(own), len(own) - len(kept), sha("\n".join(kept))
    return out


def simhash(rows, words=3, within=2):
    import xxhash

    prints = {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        shingles = [" ".join(w[k : k + words]) for k in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= within and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (f"{prints[d]:016x}", find(d)) for d in prints}


def jaccard(rows, words=5, similarity=0.8):
    """Components of rows whose sets of shingles are equal or have the similarity; every pair is compared."""
    sets = {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[d] = frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset({tuple(w)} - {()})
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both and both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in sets}


def sharding(rows, shards, slots=4096, overhead=8):
    """(doc_id, text, size, shard, place) of every row, row by row in one list."""
    import hashlib

    import xxhash

    placed, loads = [], Counter()
    for d, t in rows:
        h = xxhash.xxh64_intdigest((t or "").encode(), 42)
        digest = hashlib.md5(f"{'' if d is None else d}:{h - (h >> 63 << 64)}".encode()).hexdigest()
        slot, part = int(digest[:8], 16) % slots, int(digest[8:16], 16) % 16
        size = len((t or "").encode()) + overhead
        loads[slot] += size
        placed.append((slot, part, (d is not None, d or 0), zlib.crc32((t or "").encode()), size, d, t))
    weight, of = [0] * shards, {}
    for slot in sorted(range(slots), key=lambda s: (-loads[s], s)):
        of[slot] = weight.index(min(weight))
        weight[of[slot]] += loads[slot]
    out, next_ = [], Counter()
    for slot, _, _, _, size, d, t in sorted(placed, key=lambda r: r[:5]):
        out.append((d, t, size, of[slot], next_[of[slot]]))
        next_[of[slot]] += 1
    return out


def leaks(rows, items, units, numbers, width=13, least=4, shortest=6):
    """(doc_id, item, first word, end word, slots, changed slots, literal) by comparing every window with every window."""

    def forms(word):
        bare = word.strip(".,;:!?\"'()[]{}<>«»„“”‘’…-–—*_`|/\\") or word
        low = bare.lower()
        if re.fullmatch(r"[+\-$€£]*\d[\d.,:/]*(st|nd|rd|th)?[%$€£]?", bare) or low in numbers:
            return low, "<num>"
        if low in units:
            return low, "<unit>"
        m = re.fullmatch(r"[+\-$€£]*\d[\d.,]*([^\W\d_]+)", low)
        if m and m[1] in units:
            return low, "<num><unit>"
        return low, "<name>" if bare[:1].isupper() else low

    out = []
    for d, text in rows:
        own = [forms(w) for w in (text or "").split()]
        for item, question in items:
            asked = [forms(w) for w in (question or "").split()]
            n = min(width, len(asked))
            if n < shortest:
                continue
            met = {}
            for j in range(len(asked) - n + 1):
                b = asked[j : j + n]
                slots = sum(x != y for x, y in b)
                for i in range(len(own) - n + 1):
                    a = own[i : i + n]
                    literal = all(x[0] == y[0] for x, y in zip(a, b))
                    typed = slots and width * (n - slots) >= least * n and all(x[1] == y[1] for x, y in zip(a, b))
                    if literal or typed:
                        met.setdefault(i - j, []).append(j)
            for shift, starts in met.items():
                runs = []
                for j in sorted(starts):
                    if runs and j <= runs[-1][1]:
                        runs[-1][1] = j + n
                    else:
                        runs.append([j, j + n])
                for low, high in runs:
                    pairs = [(asked[j], own[j + shift]) for j in range(low, high)]
                    slots = [(b, a) for b, a in pairs if a[1] == b[1] != b[0]]
                    alike = all((b[0] != y[0] or a[0] == x[0]) and (b[1] != "<name>" or a[0] != x[0] or b[0] == y[0]) for b, a in slots for y, x in slots if b[1] == y[1])
                    same = "".join("1" if a[0] == b[0] else "0" for b, a in pairs)
                    literal = "1" * n in same
                    if literal or alike:
                        out.append((d, item, low + shift, high + shift, len(slots), sum(b[0] != a[0] for b, a in slots), literal))
    return sorted(out)


def quality_base(text):
    text = text or ""
    w = WORD.findall(text)
    own = [s for s in text.split("\n")]
    again = sum(1 for i, s in enumerate(own) if WORD.search(s) and s in own[:i])
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def katz(rows):
    tokens = {d: [*WORD.findall((t or "").translate(LOWER)), None] for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    one, two, docs = Counter(), Counter(), 0
    for d, t in tokens.items():
        if not held[d]:
            one.update(t)
            two.update(zip(["\n", *t], t))
            docs += 1
    n, v = sum(one.values()), len(one)

    def discounts(of):
        out = {0: 0.0}
        fixed, top = (of[1] / (of[1] + 2 * of[2]), 6 * of[6] / of[1]) if of[1] else (0.5, 1.0)
        for r in range(1, 6):
            x = (r + 1) * of[r + 1] / (r * of[r]) if of[r] else 0.0
            x = (x - top) / (1 - top) if top < 1 else 0.0
            out[r] = x if 0 < x < 1 else (r - fixed) / r
        return out

    d1, d2 = discounts(Counter(one.values())), discounts(Counter(two.values()))
    mass = sum(d1.get(c, 1.0) * c for c in one.values())
    scale = n if mass < n else n + 1
    p1 = {w: d1.get(c, 1.0) * c / scale for w, c in one.items()}
    unknown = 1 - mass / scale
    kept = {k: d2.get(c, 1.0) * c for k, c in two.items()}
    total, lower = Counter(), Counter()
    for (h, w), x in kept.items():
        total[h] += x
        lower[h] += p1[w]
    count = one | {"\n": docs}

    def p(h, w):
        c = count.get(h, 0)
        den = c + 1 if total[h] >= c * (1 - 1e-12) else c
        if (h, w) in kept:
            return kept[h, w] / den
        return ((1 - total[h] / den) / (1 - lower[h]) if c else 1.0) * p1.get(w, unknown)

    out = {}
    for d, t in tokens.items():
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t)
        out[d] = held[d], len(t), sum(w in one for w in t), n, base, sum(math.log10(p(h, w)) for h, w in zip(["\n", *t], t))
    sums = {h: sum(p(h, w) for w in one) + p(h, object()) for h in [*list(one)[:5], "\n"]}
    return out, sums

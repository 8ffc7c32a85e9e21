"""Fuzzy matching of a text with the templates.

The similarity of two strings is 200 * LCS / (sum of lengths). The shorter string slides over the longer one: full
windows, and the shorter ones at both ends. The best window counts; among equal templates the first.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.rules import TEMPLATES
from palimpsest.functions.text import normalized_value

FOUND = T.StructType([T.StructField("best", T.DoubleType()), T.StructField("template", T.StringType())])


def _char_masks(needle: str, text: np.ndarray) -> np.ndarray:
    """For each character of the text, the places that it has in the needle (at most 63 characters), as bits."""
    masks: dict[int, int] = {}
    for i, ch in enumerate(needle):
        masks[ord(ch)] = masks.get(ord(ch), 0) | 1 << i
    known = np.array(sorted(masks), np.uint32)
    bits = np.array([masks[int(k)] for k in known], np.uint64)
    place = np.minimum(np.searchsorted(known, text), len(known) - 1)
    return np.where(known[place] == text, bits[place], np.uint64(0))


def _step(state: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """One character more, bit-parallel: zeros of the state count the longest common subsequence."""
    u = state & mask
    return (state + u) | (state - u)


def _lcs_of_windows(needle: str, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Longest common subsequence of the needle with each window of the text."""
    of_char = _char_masks(needle, text)
    state = np.full(len(starts), (1 << 64) - 1, np.uint64)
    for j in range(int(lengths.max(initial=0))):
        state = _step(state, np.where(j < lengths, of_char[np.minimum(starts + j, len(text) - 1)], np.uint64(0)))
    return np.bitwise_count(~state & np.uint64((1 << len(needle)) - 1)).astype(np.int64)


def partial_ratio(a: str, b: str) -> float:
    """0 to 100; both orders are tried for equal lengths. The shorter string has at most 63 characters, or is compared as it is."""
    if not a or not b:
        return 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    best = _slide(short, long)
    return max(best, _slide(long, short)) if len(a) == len(b) else best


def _slide(short: str, long: str) -> float:
    m, n = len(short), len(long)
    text = np.frombuffer(long.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.arange(1, m)
    starts = np.concatenate([np.arange(n - m + 1), np.zeros(len(ends), np.int64), n - ends])
    lengths = np.concatenate([np.full(n - m + 1, m), ends, ends])
    return float((200.0 * _lcs_of_windows(short, text, starts, lengths) / (m + lengths)).max())


def difflib_ratio(text: str, template: str) -> float:
    """The alternative without a fuzzy library: sequence matching on overlapping windows of at least 80 characters."""
    if not text or not template:
        return 0.0
    text, template = text[:20_000], template[:500]
    width = max(len(template), 80)
    starts = range(0, max(1, len(text) - width + 1), max(1, width // 4))
    return 100.0 * max(difflib.SequenceMatcher(None, text[i : i + width], template).ratio() for i in starts)


def best_template(text: str | None, ratio=partial_ratio) -> tuple[float, str]:
    best, found = 0.0, ""
    for template in TEMPLATES if text else ():
        score = ratio(text, template)
        if score > best:
            best, found = score, template
    return best, found


#: Characters of texts that are taken at once, and of them those whose windows are: few, so that their states stay in the processor's cache.
SLICE, BLOCK = 200_000, 16_000
LONGEST = max(map(len, TEMPLATES))


def _alphabet(text: np.ndarray) -> np.ndarray:
    """Each character's place among those that templates have, from 1; 0 for others."""
    return _PLACES[np.minimum(text, len(_PLACES) - 1)]


def _tables() -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    known = sorted({ord(c) for t in TEMPLATES for c in t})
    places = np.zeros(known[-1] + 2, np.intp)
    places[known] = np.arange(1, len(known) + 1)
    both = []
    for t in TEMPLATES:
        # Half the width where it is enough: half the bytes to move.
        kind = np.uint32 if len(t) <= 32 else np.uint64
        both.append(tuple(np.array([0, *(sum(1 << i for i, c in enumerate(order) if ord(c) == k) for k in known)], kind) for order in (t, t[::-1])))
    return places, both


_PLACES, _MASKS = _tables()


def _long_texts(texts: list[str]) -> np.ndarray:
    """partial_ratio of each template, a row, with each text, all longer than any template.

    Full windows of all texts advance together over one array. The shorter windows at the ends need no windows of their
    own: the state after k characters, from the front or from the back, is that of the window of k characters.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(lengths) - lengths
    chars = _alphabet(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32))
    k = np.arange(LONGEST - 1)
    edges = chars[first + k[:, None]], chars[first + lengths - 1 - k[:, None]]
    out = np.empty((len(TEMPLATES), len(texts)))
    for row, (template, masks) in enumerate(zip(TEMPLATES, _MASKS)):
        m, kind = len(template), masks[0].dtype.type
        full = kind((1 << m) - 1)
        of_char = masks[0][chars]
        counts = np.zeros(len(chars) - m + 2, np.uint8)
        for start in range(0, len(chars) - m + 1, BLOCK):
            size = min(BLOCK, len(chars) - m + 1 - start)
            state, u, v = np.full(size, ~kind(0), kind), np.empty(size, kind), np.empty(size, kind)
            for j in range(start, start + m):
                np.bitwise_and(state, of_char[j : j + size], out=u)
                np.add(state, u, out=v)
                np.subtract(state, u, out=state)
                np.bitwise_or(v, state, out=state)
            counts[start : start + size] = np.bitwise_count(~state & full)
        ends = np.stack([first, first + lengths - m + 1], 1).ravel()
        best = 100.0 * np.maximum.reduceat(counts, ends)[::2].astype(np.int64) / m
        for of_edge, table in zip(edges, masks):
            state = np.full(len(texts), ~kind(0), kind)
            for k in range(m - 1):
                state = _step(state, table[of_edge[k]])
                best = np.maximum(best, 200.0 * np.bitwise_count(~state & full) / (m + k + 1))
        out[row] = best
    return out


def best_templates(texts: list[str | None]) -> list[tuple[float, str]]:
    """best_template of every text; repeated texts are matched once."""
    found: dict[str | None, tuple[float, str]] = {}
    held: list[str] = []
    size = 0
    for t in [*dict.fromkeys(texts), None]:
        if t and len(t) > LONGEST:
            held.append(t)
            size += len(t)
        elif t is not None:
            found[t] = best_template(t)
        if held and (t is None or size >= SLICE):
            scores = _long_texts(held)
            first = scores.argmax(0)
            for i, text in enumerate(held):
                best = float(scores[first[i], i])
                found[text] = (best, TEMPLATES[first[i]]) if best > 0 else (0.0, "")
            held, size = [], 0
    found[None] = (0.0, "")
    return [found[t] for t in texts]


def in_pieces(texts: pa.Array, of: Callable[[list[str | None]], list[tuple[float, str]]]) -> pa.Array:
    """What `of` finds for the texts of a batch, of which only a piece is held as Python strings at a time."""
    best, template = [], []
    rows = max(1, SLICE * 4 * len(texts) // max(1, texts.nbytes))
    for start in range(0, len(texts), rows):
        for score, found in of(texts.slice(start, rows).to_pylist()):
            best.append(score)
            template.append(found)
    return pa.StructArray.from_arrays([pa.array(best, pa.float64()), pa.array(template, pa.string())], ["best", "template"])


@F.arrow_udf(FOUND)
def _indel(texts: pa.Array) -> pa.Array:
    return in_pieces(texts, best_templates)


@F.arrow_udf(FOUND)
def _difflib(texts: pa.Array) -> pa.Array:
    return in_pieces(texts, lambda part: [best_template(t, difflib_ratio) for t in part])


@F.arrow_udf(FOUND)
def _normalized_indel(texts: pa.Array) -> pa.Array:
    return in_pieces(texts, lambda part: best_templates([normalized_value(t) for t in part]))


# Catalyst would otherwise plan them once for a filter and once for the projection.
_BACKENDS = {"indel": _indel.asNondeterministic(), "difflib": _difflib.asNondeterministic()}
_OF_TEXTS = _normalized_indel.asNondeterministic()


def fuzzy_of_text(text: Column) -> Column:
    """fuzzy_best of the normalized text, with both steps in one worker."""
    return _OF_TEXTS(text)


def fuzzy_best(norm: Column, backend: str) -> Column:
    """STRUCT<best DOUBLE, template STRING>."""
    if backend == "off":
        return F.struct(F.lit(0.0).alias("best"), F.lit("").alias("template"))
    return _BACKENDS[backend](norm)

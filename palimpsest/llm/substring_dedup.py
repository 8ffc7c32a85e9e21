"""Operator 6: substring deduplication by recompression.

A window is `width` consecutive words of one document. Every word is removed that a window covers whose word sequence
also starts in a document with a smaller doc_id.

Recompression: in rounds, runs of one symbol and then pairs of symbols get names. A name is a 64-bit hash of what it
stands for, so every task gives the same run or pair the same name with nothing exchanged; which pairs are joined
depends on the two names alone. With each symbol goes the stretch of words that decides how it came about. If that
stretch lies inside a window, the same symbol stands at the same place in every equal window.

1. For every window, of the symbols of the highest level that its words alone decide, the one with the least hash is
   its anchor. Consecutive windows mostly share one: about one anchor for 15 words. An anchor is filed under the hash
   of its deciding stretch, with a hash of all the words its windows cover.
2. Anchors whose stretch occurs in one document only are done: their windows have no equal elsewhere. That is most.
3. Anchors equal in all covered words have equal windows: all but the smallest document's lose theirs. Groups of
   copies, however large, end here with one aggregation.
4. Smallest documents whose stretch is shared but whose covered words differ (borders of passages, edited copies) have
   their windows compared one by one, by 128-bit hashes.

No pairs are ever formed; all steps are aggregations and joins on hashes and on doc_id.

Defined cases: a null or empty text has no words and stays as it is; rows with no doc_id stay whole and take nothing
from others; rows of equal doc_id count as one document for comparison, and each loses only what is in its own text; a very
long text is worked on alone; an empty table gives an empty result; extra columns stay, those named like a result column are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import settled
from palimpsest.llm.hashing import Words, mix, prefixes, span_hash

WIDTH = 50
LEVELS = 4
#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK = 1 << 20


def recompress(names: np.ndarray, fixed: np.ndarray, levels: int) -> list[dict[str, np.ndarray]]:
    """Levels 0 to `levels`: of each symbol its name, and first and last+1 word of the stretch that decides it.

    fixed: places that are joined with nothing, the borders between documents.
    """
    n = len(names)
    level = {"name": names, "low": np.arange(n), "high": np.arange(1, n + 1), "fixed": fixed}
    out = [level]
    for k in range(1, levels + 1):
        level = _pairs(_runs(level, k), k)
        out.append(level)
    return out


def _take(level: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[at] for k, v in level.items()}


def _runs(level: dict[str, np.ndarray], k: int) -> dict[str, np.ndarray]:
    """Each longest run of one symbol becomes one symbol. That a run ends is decided by its neighbours."""
    name = level["name"]
    starts = np.concatenate([[True], (name[1:] != name[:-1]) | level["fixed"][1:] | level["fixed"][:-1]])
    first = np.flatnonzero(starts)
    last = np.concatenate([first[1:], [len(name)]]) - 1
    out = _take(level, first)
    length = last - first + 1
    out["name"] = np.where(length > 1, mix(out["name"] + mix(length.astype(np.uint64) + np.uint64(k << 32))), out["name"])
    out["low"] = level["low"][np.maximum(first - 1, 0)]
    out["high"] = level["high"][np.minimum(last + 1, len(name) - 1)]
    return out


def _pairs(level: dict[str, np.ndarray], k: int) -> dict[str, np.ndarray]:
    """Symbols are left or right by a bit of their name; each left one followed by a right one joins it."""
    name, low, high, fixed = level["name"], level["low"], level["high"], level["fixed"]
    right = (mix(name ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(63)).astype(bool)
    joins = np.zeros(len(name), bool)
    joins[:-1] = ~right[:-1] & right[1:] & ~fixed[:-1] & ~fixed[1:]
    joined = np.zeros(len(name), bool)
    joined[1:] = joins[:-1]
    alone = ~joins & ~joined & ~fixed
    following, preceding = np.append(high[1:], high[-1:]), np.insert(low[:-1], 0, low[:1])
    new_low = np.where(alone & right, preceding, low)
    new_high = np.where(joins, following, np.where(alone & ~right, following, high))
    both = mix(name * np.uint64(0xD6E8FEB86659FD93) + mix(np.append(name[1:], name[-1:]) + np.uint64(k)))
    new_name = np.where(joins, both, name)
    keep = ~joined
    return {"name": new_name[keep], "low": new_low[keep], "high": new_high[keep], "fixed": fixed[keep]}


def anchors(levels: list[dict[str, np.ndarray]], starts: np.ndarray, size: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window start: level and stretch (low, high) of its anchor."""
    level_of = np.full(len(starts), -1)
    low_of, high_of = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    open_ = np.arange(len(starts))
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        below = np.concatenate([[0], np.cumsum(np.bincount(level["low"], minlength=size + 1))])
        upto = np.concatenate([[0], np.cumsum(np.bincount(level["high"], minlength=size + 2))])
        p = starts[open_]
        first, end = below[p], upto[p + width + 1]
        has = end > first
        rows, first, end = open_[has], first[has], end[has]
        if len(rows):
            order = mix(level["name"])
            best = [np.arange(len(order))]
            for step in range(int(np.max(end - first)).bit_length() - 1):
                left, far = best[-1], 1 << step
                right = left[far:]
                left = left[: len(right)]
                best.append(np.where(order[left] <= order[right], left, right))
            span = np.frexp((end - first).astype(np.float64))[1] - 1
            chosen = np.empty(len(rows), np.int64)
            for step in np.unique(span):
                own = span == step
                a, b = best[step][first[own]], best[step][end[own] - (1 << int(step))]
                chosen[own] = np.where(order[a] <= order[b], a, b)
            level_of[rows], low_of[rows], high_of[rows] = k, level["low"][chosen], level["high"][chosen]
        open_ = open_[~has]
        if not len(open_):
            break
    return level_of, low_of, high_of


def _chunks(batches: Iterator[pa.RecordBatch], text_at: int, size: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of record batches with the bytes of their texts, about `size` bytes each."""
    for b in batches:
        at, weight, held = 0, 0, []
        for i, t in enumerate(b.column(text_at)):
            held.append((t.as_py() or "").encode("utf-8", "surrogatepass"))
            weight += len(held[-1])
            if weight >= size:
                yield b.slice(at, i + 1 - at), held
                at, weight, held = i + 1, 0, []
        if held:
            yield b.slice(at), held


def _anchor_rows(width: int, n_levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in _chunks(batches, 1):
            words = Words(texts)
            n, docs = len(words.hash), len(texts)
            # Each document's words are preceded by a place of its own, a border.
            size = n + docs + 1
            place = np.arange(n) + words.doc + 1
            name, fixed = np.zeros(size, np.uint64), np.ones(size, bool)
            name[place], fixed[place] = words.hash, False
            starts_word = np.flatnonzero(np.arange(n) + width <= words.first[words.doc] + words.count[words.doc]) if n else np.empty(0, np.int64)
            if not len(starts_word):
                continue
            starts = place[starts_word]
            level, low, high = anchors(recompress(name, fixed, n_levels), starts, size, width)
            new = np.concatenate([[True], (np.diff(starts) != 1) | (np.diff(level) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)])
            head = np.flatnonzero(new)
            count = np.diff(np.append(head, len(starts)))
            sums = prefixes(name)
            key = mix(span_hash(sums, low[head], high[head]) + level[head].astype(np.uint64))
            # The anchor's place among the windows is part of what must be equal.
            shape = mix((low[head] - starts[head]).astype(np.uint64) + (count.astype(np.uint64) << np.uint64(32)))
            covered = mix(span_hash(sums, starts[head], starts[head] + count - 1 + width) ^ shape)
            own = words.doc[starts_word[head]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(covered.view(np.int64)), b.column(0).take(pa.array(own)), b.column(2).take(pa.array(own)), pa.array((starts_word[head] - words.first[own]).astype(np.int32)), pa.array(count.astype(np.int32))],
                names=["k", "h", "d", "x", "at", "n"],
            )

    return run


def _window_rows(width: int):
    """d, x, text, list of (at, n) -> both hashes of every window that starts there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in _chunks(batches, 2):
            words, other = Words(texts), Words(texts, other=True)
            one, two = prefixes(words.hash), prefixes(other.hash, other=True)
            lists = b.column(3)
            rows = lists.flatten()
            if not len(rows):
                continue
            doc = np.repeat(np.arange(len(texts)), np.diff(np.asarray(lists.offsets)))
            first, count = np.asarray(rows.field("at")).astype(np.int64), np.asarray(rows.field("n")).astype(np.int64)
            at = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            doc = np.repeat(doc, count)
            start = words.first[doc] + at
            h, g = mix(span_hash(one, start, start + width)), mix(span_hash(two, start, start + width, other=True))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), b.column(0).take(pa.array(doc)), b.column(1).take(pa.array(doc)), pa.array(at.astype(np.int32))], names=["h", "g", "d", "x", "at"])

    return run


def text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def repeats(df: DataFrame, key: str = "doc_id", text: str = "text", *, width: int = WIDTH, levels: int = LEVELS) -> DataFrame:
    """(key, x, starts): for each document that has any, the runs (at, n) of window starts to be removed; x is the XXH64 of its text."""
    docs = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("d"), F.col(text).alias("t"), text_hash(text).alias("x"))
    found = settled(docs.mapInArrow(_anchor_rows(width, levels), "k long, h long, d long, x long, at int, n int"), "anchors")
    # Each side of a join is a table, so a stretch that very many documents share is split over tasks when joined.
    shared = settled(found.groupBy("k").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo < hi").select("k"), "keys")
    met = settled(found.join(shared, "k"), "shared")
    same = settled(met.groupBy("k", "h").agg(F.min("d").alias("rep")), "same")
    several = settled(same.groupBy("k").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("k"), "several")
    marked = met.join(same, ["k", "h"])
    copies = marked.where("d > rep").select("d", "x", "at", "n")
    first = marked.where("d = rep").join(several, "k").select("d", "x", F.struct("at", "n").alias("run"))
    asked = first.groupBy("d", "x").agg(F.collect_set("run").alias("runs"))
    windows = docs.join(asked.hint("shuffle_hash"), ["d", "x"]).select("d", "x", "t", "runs").mapInArrow(_window_rows(width), "h long, g long, d long, x long, at int")
    windows = settled(windows, "windows")
    lowest = settled(windows.groupBy("h", "g").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo < hi"), "lowest")
    later = windows.join(lowest, ["h", "g"]).where("d > lo").select("d", "x", "at", F.lit(1).alias("n"))
    return copies.union(later).groupBy("d", "x").agg(F.collect_set(F.struct("at", "n")).alias("starts")).withColumnRenamed("d", key)


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", *, width: int = WIDTH, levels: int = LEVELS) -> DataFrame:
    """df with the kept words, joined by one space, in its text column (unchanged where nothing goes), n_words and n_removed."""
    base = df.drop("n_words", "n_removed", "kept_sha256", "__starts", "__x")
    starts = repeats(base, key, text, width=width, levels=levels).withColumnsRenamed({"starts": "__starts", "x": "__x"})
    joined = base.withColumn("__x", text_hash(text)).join(starts.hint("shuffle_hash"), [key, "__x"], "left").select(*base.columns, "__starts")
    at, name = joined.columns.index(text), text
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.drop("__starts").schema) + ", n_words long, n_removed long, kept_sha256 string"

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, words_, removed, digests = [], [], [], []
            for t, runs in zip(b.column(at), b.column(b.schema.get_field_index("__starts"))):
                t = t.as_py()
                words = (t or "").encode("utf-8", "surrogatepass").split()
                gone, runs = 0, runs.as_py()
                kept = words
                if runs:
                    drop = np.zeros(len(words) + 1, np.int64)
                    for r in runs:
                        drop[min(r["at"], len(words))] += 1
                        drop[min(r["at"] + r["n"] - 1 + width, len(words))] -= 1
                    out = np.cumsum(drop[:-1]) > 0
                    gone = int(out.sum())
                    kept = [w for w, x in zip(words, out.tolist()) if not x]
                line = b" ".join(kept)
                texts.append(line.decode("utf-8", "surrogatepass") if gone else t)
                words_.append(len(words))
                removed.append(gone)
                digests.append(hashlib.sha256(line).hexdigest())
            columns = {n: b.column(i) for i, n in enumerate(b.schema.names) if n != "__starts"}
            columns |= {name: pa.array(texts, pa.string()), "n_words": pa.array(words_, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return joined.mapInArrow(keep, schema)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")

"""Near-duplicates of operator 10 by the similarity of their texts: Jaccard similarity of sets of word shingles.

A node is a distinct set of shingles, `fp` its hash. Fingerprints alone can't keep this law: copies that lack or add a
block differ in too many bits. So they give candidates, a search without loss gives the others, and every candidate is
held shingle by shingle.

1. Shingles are counted over all sets. They travel as packed arrays, from chunks of the table to buckets of shingles
   (as many as the number of shingles asks for) and back, those found in one set only left out.
2. A set of n shingles, u of them in no other set, is similar to another only if u <= n - ceil(similarity * n).
   The others end here, which is most of a corpus. Of those left, the shingles that are in other sets stay.
3. Fingerprints over these link sets by the generalised pigeonhole (simhash.links).
4. Each set left files the first of its n - ceil(similarity * n) + 1 shingles, rarest first; those in no other set need no
   row. Two similar sets share one of these, and its places bound how many more they share. Under each shingle
   everyone is held against one, the set with the fewest rarer shingles, so no pairs of a group are made.
5. Sets that are still apart although they meet under a shingle are held against each other: those outside the
   largest component under it against all members of other components. What is in one component needs no comparison.

No link is lost but by collisions of 64-bit hashes; nothing is capped.

Defined cases: null and empty texts have no shingles and are one node; a text of fewer words than a shingle is one
shingle; very long texts are worked on alone, by parts of their set; rows of equal key are each in the component of their own text,
and a null key gives its component no name; an empty table gives an empty result; extra columns are ignored here and
stay in drop_near_duplicates().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import pack, settled, shuffle_width, unpack
from palimpsest.llm.components import components
from palimpsest.llm.hashing import Words, mix
from palimpsest.llm.simhash import SEED, fingerprint, links, named, signed

#: Bytes of text that are worked on at once.
SLICE = 1 << 20
#: Shingles of a chunk of the table, and of a bucket of shingles.
CHUNK = BUCKET = 1 << 20
#: Rows of one to three longs that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 19
MESSAGE = {"bucket": pa.int64(), "chunk": pa.int64(), "payload": pa.binary()}
MESSAGE_SQL = "bucket long, chunk long, payload binary"
LISTED = -1


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Of each text the hashes of its distinct shingles, in order."""
    words_of = Words([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts])
    flat = words_of.hash
    n = max(0, len(flat) - words + 1)
    rolled = np.full(n, words, np.uint64)
    for k in range(words):
        rolled = mix(rolled * np.uint64(0xD6E8FEB86659FD93) + flat[k : n + k])
    out, at = [], 0
    for count in words_of.count.tolist():
        if count >= words:
            out.append(np.unique(rolled[at : at + count - words + 1]))
        else:
            value = np.full(min(1, count), count, np.uint64)
            for k in range(count):
                value = mix(value * np.uint64(0xD6E8FEB86659FD93) + flat[at + k])
            out.append(value)
        at += count
    return out


def set_print(shingles: np.ndarray) -> int:
    """A signed 64-bit hash of a set of shingles, given in order; 0 for none."""
    import xxhash

    return signed(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)) if len(shingles) else 0


def _slices(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for b in batches:
        low, weight, held = 0, 0, []
        for i, t in enumerate(b.column(at)):
            held.append(t.as_py())
            weight += len(held[-1] or "")
            if weight >= SLICE:
                yield b.slice(low, i + 1 - low), held
                low, weight, held = i + 1, 0, []
        if held:
            yield b.slice(low), held


def _lacks(n, similarity: float):
    """How many of its n shingles a set may lack in a similar one."""
    return n - math.ceil(similarity * n - 1e-9)


def _sets(df: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """The key, fp and n (how many shingles) of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in _slices(batches, 1):
            sets = shingle_sets(texts, words)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(set_print, sets)), pa.int64()), pa.array(list(map(len, sets)), pa.int64())], names=[key, "fp", "n"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, fp long, n long")


def _sent(words: int, buckets: int):
    """Text -> for each chunk a message to every bucket, (shingles, places of their sets), and a list of its sets (fp, n)."""
    edges = np.array([(i << 64) // buckets for i in range(buckets)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, {}, 0

        def out() -> pa.RecordBatch:
            sizes = np.array(list(map(len, held.values())), np.int64)
            values = np.concatenate(list(held.values()))
            order = np.argsort(values, kind="stable")
            values, places = values[order], np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)[order]
            ends = np.append(np.searchsorted(values, edges), len(values))
            rows = [(b, number, pack(values[ends[b] : ends[b + 1]], places[ends[b] : ends[b + 1]])) for b in range(buckets) if ends[b + 1] > ends[b]]
            # Lists are to pass the buckets by, each as a group of its own.
            rows.append((LISTED - number, number, pack(np.array(list(held), np.int64), sizes)))
            return _rows(rows, MESSAGE)

        for _, texts in _slices(batches, 0):
            for own in shingle_sets(texts, words):
                if len(own) and (fp := set_print(own)) not in held:
                    held[fp] = own
                    size += len(own)
                if size >= CHUNK:
                    yield out()
                    number, held, size = number + 1, {}, 0
        if held:
            yield out()

    return run


def _rows(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values())], names=list(types))


def _tallied(table: pa.Table) -> pa.Table:
    """Messages of one bucket -> for each chunk the shingles of several sets, the places of their sets, and how many sets; lists as they are."""
    if table.column("bucket")[0].as_py() < 0:
        return table
    parts = [unpack(p.as_py()) for p in table.column("payload")]
    values = np.concatenate([p[0] for p in parts])
    _, place, count = np.unique(values, return_inverse=True, return_counts=True)
    often = count[place]
    out, at = [], 0
    for chunk, (own, places) in zip(table.column("chunk").to_pylist(), parts):
        n = often[at : at + len(own)]
        at += len(own)
        if (n > 1).any():
            out.append((0, chunk, pack(own[n > 1], places[n > 1], n[n > 1].astype(np.uint32))))
    return pa.Table.from_batches([_rows(out, MESSAGE)])


LEFT = {"fp": pa.int64(), "n": pa.int32(), "u": pa.int32(), "grams": pa.list_(pa.int64())}


def _left(similarity: float):
    """What came back to one chunk -> its sets that may be similar to another: fp, n, u, and the shingles in other sets, rarest first."""

    def run(table: pa.Table) -> pa.Table:
        kinds, payloads = table.column("bucket").to_pylist(), table.column("payload")
        fps, sizes = unpack(payloads[next(i for i, k in enumerate(kinds) if k < 0)].as_py())
        parts = [unpack(p.as_py()) for k, p in zip(kinds, payloads) if k >= 0]
        if not parts:
            return pa.Table.from_batches([_rows([], LEFT)])
        values, places, often = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.lexsort((values, often, places))
        values = values[order].view(np.int64)
        shared = np.bincount(places, minlength=len(fps))
        first = np.cumsum(shared) - shared
        own = sizes - shared
        keep = [i for i in np.flatnonzero(shared).tolist() if own[i] <= _lacks(int(sizes[i]), similarity)]
        rows = [(int(fps[i]), int(sizes[i]), int(own[i]), values[first[i] : first[i] + shared[i]]) for i in keep]
        return pa.Table.from_batches([_rows(rows, LEFT)])

    return run


def candidates(firsts: DataFrame, total: int, words: int, similarity: float) -> DataFrame:
    """(fp, n, u, grams): the sets that may be similar to another; firsts has one column of texts, of `total` shingles."""
    buckets = max(shuffle_width(firsts.sparkSession), -(-total // BUCKET))
    # As many partitions as buckets, so what a task reads doesn't grow with the table.
    sent = firsts.mapInArrow(_sent(words, buckets), MESSAGE_SQL).repartition(buckets, "bucket")
    back = sent.groupBy("bucket").applyInArrow(_tallied, MESSAGE_SQL).repartition(buckets, "chunk")
    left = back.groupBy("chunk").applyInArrow(_left(similarity), "fp long, n int, u int, grams array<long>")
    return left.dropDuplicates(["fp"])


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _by_fingerprint(sets: DataFrame, within: int, dense: int) -> DataFrame:
    """Candidate pairs (a, b): each set with the first of its fingerprint, and the firsts of fingerprints that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [signed(fingerprint(g.values.to_numpy().view(np.uint64))) for g in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.int64())], names=["id", "alone", "fp"])

    prints = settled(sets.select("fp", F.col("u") / F.col("n"), "grams").mapInArrow(run, "id long, alone double, fp long"), "prints")
    firsts = settled(prints.groupBy("fp").agg(F.min_by("id", F.struct("alone", "id")).alias("first")), "firsts")
    near = links(firsts.select("fp"), within, dense)
    a, b = (firsts.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}")) for c in "ab")
    return prints.join(firsts, "fp").select(F.col("id").alias("a"), F.col("first").alias("b")).union(near.join(a, "a").join(b, "b").select("first_a", "first_b"))


def _possible(n: Column, at: Column, m: Column, to: Column, similarity: float) -> Column:
    """Can sets of n and m shingles that share their first at places `at` and `to` have the similarity?"""
    return F.least(n - at, m - to) >= similarity / (1 + similarity) * (n + m) - 1e-6


def _verified(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs of sets that have the similarity, once each."""
    pairs = settled(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    a, b = (sets.select(F.col("fp").alias(c), F.col("n").alias(f"n{c}"), F.col("grams").alias(f"g{c}")) for c in "ab")
    shared = F.size(F.array_intersect("ga", "gb"))
    return settled(pairs.join(a, "a").join(b, "b").where(shared >= similarity * (F.col("na") + F.col("nb") - shared)).select("a", "b"), "similar")


def similar(df: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, within: int = 2, dense: int = 64) -> DataFrame:
    """(key, fp, component_id), linked where the sets of shingles of `words` words have the Jaccard similarity or more."""
    docs = settled(_sets(df, key, text, words), "sets")
    nodes = settled(docs.groupBy("fp").agg(F.min(key).alias("low"), F.max("n").alias("n")), "nodes")
    total = nodes.agg(F.sum("n")).first()[0] or 0
    # Rows that are the first of no set go; those of a null key stay, as nothing else names them.
    lows = nodes.select("low").where("low is not null").distinct()
    gone = settled(docs.select(key).join(lows, F.col(key) == F.col("low"), "left_anti").where(F.col(key).isNotNull()).distinct(), "copies")
    few = gone.count() <= BROADCAST_ROWS
    firsts = df.join(F.broadcast(gone) if few else gone, key, "left_anti").select(text)
    # Chunks are named by their place in the table, so it must be the same table whenever a task is run again.
    sets = settled(candidates(firsts if few else settled(firsts, "firsts"), total, words, similarity), "candidates")

    at = F.col("u") + F.col("pos")
    filed = sets.select("fp", "n", "u", F.posexplode(F.slice("grams", F.lit(1), F.col("n") - F.ceil(similarity * F.col("n") - 1e-9).cast("int") + 1 - F.col("u"))).alias("pos", "value")).select("value", "fp", "n", at.alias("at"))
    first = F.min_by(F.struct("fp", "n", "at"), F.struct(F.col("at") / F.col("n"), "fp")).alias("first")
    pivots = settled(filed.groupBy("value").agg(first, F.count(F.lit(1)).alias("met")).where("met > 1").select("value", F.col("first.fp").alias("b"), F.col("first.n").alias("nb"), F.col("first.at").alias("j")), "pivots")
    tried = filed.join(pivots, "value").where("fp <> b").where(_possible(F.col("n"), F.col("at"), F.col("nb"), F.col("j"), similarity))
    edges = _verified(sets, tried.select(F.col("fp").alias("a"), "b").union(_by_fingerprint(sets, within, dense)), similarity)

    roots = settled(components(edges), "roots").withColumnRenamed("node", "fp")
    rooted = settled(filed.join(pivots.select("value"), "value").join(_small(roots), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    held = rooted.groupBy("value", "root").agg(F.count(F.lit(1)).alias("members"))
    mixed = settled(held.groupBy("value").agg(F.max_by("root", F.struct("members", "root")).alias("major"), F.count(F.lit(1)).alias("roots")).where("roots > 1").drop("roots"), "mixed")
    rest = settled(rooted.join(_small(mixed), "value"), "apart")
    left = rest.where("root <> major").select("value", F.col("fp").alias("a"), F.col("n").alias("na"), F.col("at").alias("i"), F.col("root").alias("ra"), "major")
    right = rest.select(F.col("value").alias("here"), F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("at").alias("j"), F.col("root").alias("rb"))
    once = (F.col("a") < F.col("b")) | (F.col("rb") == F.col("major"))
    fits = _possible(F.col("na"), F.col("i"), F.col("nb"), F.col("j"), similarity)
    more = left.join(right.hint("merge"), (F.col("value") == F.col("here")) & (F.col("ra") != F.col("rb")) & once & fits)
    more = _verified(sets, more.select("a", "b"), similarity)
    return named(docs.select(key, "fp"), nodes, edges.union(more), key)


def drop_near_duplicates(df: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    """One document of each group of similar() stays, that of the smallest key; rows with no key, and of equal key, stay together."""
    groups = similar(df, key=key, **options)
    gone = groups.where(F.col(key) > F.col("component_id")).select(key).distinct()
    return df.join(gone, key, "left_anti")

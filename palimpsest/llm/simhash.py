"""Operator 10: SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: 64 bits, bit k set if more than half of the XXH64 values of the text's word shingles have it. Two texts
link if their fingerprints differ in `within` bits or fewer.

Search: equal fingerprints are one node. Bits that are set together are put into one part each of m parts, by their
correlation over all fingerprints. Part i gets its own threshold t_i >= -1 with sum(t_i) = within - m + 1: of two
fingerprints within the distance, at least one part must then differ in t_i bits or fewer (-1: the part is not
probed). A dynamic programme allots thresholds, and the cheapest m is taken, on the candidate counts expected from how
often each bit is set over all fingerprints. Every fingerprint files its part's value and, for t_i > 0, the
values within t_i flips; those that meet under a value are verified on all bits.

Values under which more than `dense` fingerprints meet, as in a large group of near copies, are not compared pair by pair.
Their members are filed under every fingerprint within within/2 flips of their own: two of them meet there exactly if
they link, and a meeting place has at most as many members as it has neighbours, so the work is in proportion to the
members.

Defined cases: a null or empty text has no shingles and fingerprint 0, which links like any other; rows of equal doc_id
keep their own fingerprints; a null doc_id is in a component but gives it no name; bits of very long texts are counted in parts; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import settled
from palimpsest.llm.components import components

BITS = 64
SEED = 42
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15


def hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included."""
    import xxhash

    own = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not own:
        return np.empty(0, np.uint64)
    line, digest = b" ".join(own), xxhash.xxh64_intdigest
    if len(own) < words:
        return np.array([digest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(own) - words + 1
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist())), np.uint64, n)


def fingerprint(values: np.ndarray) -> int:
    """The bits set in over half the values; 0 for none."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(values), CHUNK):
        part = values[at : at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(values)).tobytes(), "big")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(df: DataFrame, *, text: str = "text", words: int = 3, carry: list[str] = ("doc_id",)) -> DataFrame:
    """The carried columns and `fp`, the fingerprint as a signed long."""
    names = list(carry)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [signed(fingerprint(hashes(t.as_py(), words))) for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(own, pa.int64())], names=[*names, "fp"])

    return df.select(*names, text).mapInArrow(prints, f"{types}, fp long")


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how many of them have bits j and k set (64 x 64), over all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros((BITS, BITS))
        for b in batches:
            raw = np.ascontiguousarray(b.column(0).to_numpy().astype(">i8")).view(np.uint8).reshape(-1, 8)
            for at in range(0, len(raw), CHUNK):
                bits = np.unpackbits(raw[at : at + CHUNK], axis=1).astype(np.float32)
                sums += bits.T @ bits
            n += len(raw)
        yield pa.RecordBatch.from_pydict({"place": pa.array(range(BITS * BITS), pa.int64()), "n": pa.array([n] * BITS**2, pa.int64()), "both": pa.array(sums.astype(np.int64).ravel(), pa.int64())})

    rows = nodes.select("fp").mapInArrow(count, "place long, n long, both long").groupBy("place").agg(F.sum("n").alias("n"), F.sum("both").alias("both")).collect()
    both = np.zeros(BITS * BITS)
    for r in rows:
        both[r["place"]] = r["both"]
    return (rows[0]["n"] if rows else 0), both.reshape(BITS, BITS)


def grouped(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m parts of nearly equal size; each takes, one by one, the bit most correlated with those it has. Bit 0 is the highest."""
    p = np.diag(both) / max(n, 1)
    cov = np.abs(both / max(n, 1) - np.outer(p, p))
    scale = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    strength = np.divide(cov, scale, out=np.zeros_like(cov), where=scale > 0)
    free, parts = list(range(BITS)), []
    for i in range(m):
        size = (BITS - sum(map(len, parts))) // (m - i)
        part = [free.pop(0)]
        while len(part) < size:
            best = max(free, key=lambda b: (strength[b, part].sum(), -b))
            free.remove(best)
            part.append(best)
        parts.append(sorted(part))
    return parts


def expected_cost(n: int, p: np.ndarray, part: list[int], t: int) -> float:
    """Rows filed (within t flips) and candidate pairs expected of a part with threshold t, with bits taken as independent."""
    if t < 0:
        return 0.0
    differ = 2 * p[part] * (1 - p[part])
    chances = np.array([1.0])
    for d in differ:
        chances = np.convolve(chances, [1 - d, d])
    filed = sum(math.comb(len(part), k) for k in range(min(t, len(part)) + 1))
    return max(n, 1) * filed + n * (n - 1) / 2 * float(chances[: t + 1].sum())


def allotted(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of least cost with the given sum, by dynamic programming over the parts; costs[i][t + 1] for t from -1."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for k, c in enumerate(row):
                if used + k - 1 not in after or cost + c < after[used + k - 1][0]:
                    after[used + k - 1] = cost + c, [*chosen, k - 1]
        best = after
    return best[total]


def plan(n: int, both: np.ndarray, within: int) -> list[tuple[list[int], int]]:
    """Parts and thresholds of the cheapest number of parts."""
    p = np.diag(both) / max(n, 1)
    tried = []
    for m in range(1, within + 3):
        parts = grouped(n, both, m)
        cost, thresholds = allotted([[expected_cost(n, p, part, t) for t in range(-1, within + 1)] for part in parts], within - m + 1)
        tried.append((cost, m, parts, thresholds))
    _, _, parts, thresholds = min(tried)
    return [(part, t) for part, t in zip(parts, thresholds) if t >= 0]


def mask_of(bits) -> int:
    return signed(sum(1 << (BITS - 1 - b) for b in bits))


def flips(bits: list[int], radius: int) -> list[int]:
    return [mask_of(c) for k in range(radius + 1) for c in combinations(bits, k)]


def links(nodes: DataFrame, within: int = 2, dense: int = 64) -> DataFrame:
    """Edges (a, b) that connect whatever fingerprints within the distance connect; each edge is itself within it."""
    n, both = bit_statistics(nodes)
    filed = None
    for i, (part, t) in enumerate(plan(n, both, within)):
        value = F.col("fp").bitwiseAND(F.lit(mask_of(part)))
        at = F.explode(F.transform(F.array(*map(F.lit, flips(part, t))), lambda f: value.bitwiseXOR(f))) if t else value
        own = nodes.select(F.lit(i).alias("part"), at.alias("value"), "fp")
        filed = own if filed is None else filed.union(own)
    sizes = filed.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = settled(filed.join(sizes, ["part", "value"]), "met")
    small = met.where(F.col("n") <= dense).groupBy("part", "value").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(_verify(within), "a long, b long")
    # Radius r on both sides meets at distance 2r; for an odd distance one side would go a step further.
    radius = -(-within // 2)
    crowd = met.where(F.col("n") > dense).select("fp").distinct()
    places = crowd.select("fp", F.explode(F.transform(F.array(*map(F.lit, flips(list(range(BITS)), radius))), lambda f: F.col("fp").bitwiseXOR(f))).alias("place"))
    around = places.groupBy("place").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps").mapInArrow(_verify(within), "a long, b long")
    return small.union(around).distinct()


def _verify(within: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each list, edges within the distance that leave out those already connected through the list."""
        for b in batches:
            out: list[tuple[int, int]] = []
            for fps in b.column(0).to_pylist():
                own = np.unique(np.array(fps, np.int64))
                far = np.bitwise_count(own[:, None] ^ own[None, :]) if len(own) > 1 else np.zeros((1, 1), np.int64)
                near = far <= within
                left = np.ones(len(own), bool)
                while left.any():
                    first = int(np.argmax(left))
                    left[first] = False
                    frontier = [first]
                    while frontier:
                        u = frontier.pop()
                        for v in np.flatnonzero(near[u] & left).tolist():
                            left[v] = False
                            out.append((int(own[u]), int(own[v])))
                            frontier.append(v)
            a, z = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], names=["a", "b"])

    return run


def near_duplicates(df: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 3, within: int = 2, dense: int = 64) -> DataFrame:
    """(key, fp, component_id): the smallest key reachable over links, a row for each row of df."""
    docs = settled(fingerprints(df, text=text, words=words, carry=[key]), "fingerprints")
    nodes = settled(docs.groupBy("fp").agg(F.min(key).alias("low")), "nodes")
    return named(docs, nodes, links(nodes, within, dense), key)


def named(docs: DataFrame, nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    named = nodes.join(components(edges).withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("low").alias("component_id"))
    of = settled(named.join(names, "root").select("fp", "component_id"), "components")
    return docs.join(of, "fp").select(key, "fp", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

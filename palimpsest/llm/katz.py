"""Operator 7: scores of a Katz back-off model, trained on the corpus.

Counts are Good-Turing discounted; what discounting leaves in a context goes to the words not kept there, in proportion
to their lower-order probability, with a weight that makes each context sum to exactly 1. A token's probability is
looked up recursively: bigram, else weight times unigram, else the unigram mass of unknown words. All counts are kept,
those of one included.

Tables are partitioned by hash and everything moves as packed arrays. The corpus is first coded into chunks of about
`CHUNK` tokens (a sorted word list, and each token's place in it), a settled table. Then, by groups and cogroups:
  words     chunk -> word bucket:    its words and their training counts;  back: counts over the corpus
  bigrams   chunk -> bigram bucket:  its bigrams and their training counts;  back: counts of those kept, and for each
            kept bigram one of its chunks as the owner
  sums      chunk -> word bucket:    for each context, how many of the bigrams it owns, and of their words, have each count;
                                     back: the context's weight
and each chunk scores its documents. Sums are of whole numbers, so weights don't depend on the order of the messages. A frequent word or bigram is one entry of a chunk at most, so none makes a group
large; no task holds more than a chunk or a bucket, and works on `PIECE` tokens or entries of it at a time. There are as many buckets and partitions as the number of chunks asks
for, and a bucket is a partition, as hashes of bucket numbers would put several into one and none into others; a message holds one entry at least, so however many chunks and buckets there are, messages never outnumber entries.

Words stand as 64-bit hashes. Defined cases: a null or empty text has only its end token; a very long text is a chunk of its
own; a null doc_id counts as training; rows of equal doc_id are scored each; with no training text all mass is on
unknown words; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import bucketed, pack, settled, shuffle_width, unpack
from palimpsest.llm.hashing import Words, mix

CHUNK = 1_000_000
#: Chunks whose words or bigrams fill a bucket at most.
CHUNKS = 4
SLICE = 1 << 20
#: Entries of a bucket that are merged at a time, and tokens of a chunk that are scored at a time, whole documents of them.
PIECE = 1 << 17
END, BEGIN = np.uint64(0x656E64), np.uint64(0x626567696E)
#: Counts above this are not discounted.
DISCOUNTED = 5
#: Rows with this chunk number hold figures of the whole corpus.
WHOLE = -1
#: Rows with this bucket number hold the sums of the context that begins a document.
BEGINS = -1


@dataclass(frozen=True)
class Model:
    """What scoring needs besides the tables: training tokens and kinds, discounts by count (0 to DISCOUNTED)."""

    tokens: int
    kinds: int
    unigram: np.ndarray
    bigram: np.ndarray
    unknown: float
    scale: float

    def p1(self, counts: np.ndarray) -> np.ndarray:
        """Unigram probabilities by training count."""
        kept = self.unigram[np.minimum(counts, DISCOUNTED + 1)] * counts
        return np.where(counts > 0, kept / max(self.scale, 1.0), self.unknown)

    def weights(self, sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Back-off weights of contexts, and what their count is raised by, from their counts and spread() sums.

        A context with nothing left by discounting gives unseen words the share of one more occurrence.
        """
        r = np.arange(1, DISCOUNTED + 1)
        mass = (self.bigram[1:-1] * r) @ sums[:DISCOUNTED] + sums[DISCOUNTED]
        lower = ((self.unigram[1:-1] * r) @ sums[DISCOUNTED + 1 : -1] + sums[-1]) / max(self.scale, 1.0)
        more = (counts > 0) & (mass >= counts * (1 - 1e-12))
        return np.where(counts > 0, (1 - mass / np.maximum(counts + more, 1)) / (1 - lower), 1.0), more


def spread(place: np.ndarray, counts: np.ndarray, out: np.ndarray) -> None:
    """By place: how many counts there are of 1, 2, ... DISCOUNTED, and the sum of those above, each into a row of out."""
    size = out.shape[1]
    for r in range(1, DISCOUNTED + 1):
        out[r - 1] = np.bincount(place[counts == r], minlength=size)
    over = counts > DISCOUNTED
    out[DISCOUNTED] = np.bincount(place[over], counts[over], size)


def discounts(of: np.ndarray) -> np.ndarray:
    """Good-Turing discount for counts 0 to DISCOUNTED, and 1 beyond; of[r]: how many kinds have count r.

    Where the estimate isn't between 0 and 1 (few data), an absolute discount takes its place.
    """
    out = np.ones(DISCOUNTED + 2)
    out[0] = 0.0
    fixed = of[1] / (of[1] + 2 * of[2]) if of[1] else 0.5
    top = (DISCOUNTED + 1) * of[DISCOUNTED + 1] / of[1] if of[1] else 1.0
    for r in range(1, DISCOUNTED + 1):
        ratio = (r + 1) * of[r + 1] / (r * of[r]) if of[r] else 0.0
        ratio = (ratio - top) / (1 - top) if top < 1 else 0.0
        out[r] = ratio if 0 < ratio < 1 else (r - fixed) / r
    return out


def _rows(columns: dict[str, list], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in types.items()], names=list(types))


MESSAGE = {"bucket": pa.int32(), "chunk": pa.int64(), "payload": pa.binary()}
MESSAGE_SQL = "bucket int, chunk long, payload binary"


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, each value's place among them, and where each comes first: np.unique, with half as much held."""
    order = np.argsort(values, kind="stable")
    values = values[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    values, first = values[new], order[new].astype(np.int32)
    inverse = np.empty(len(order), np.int32)
    inverse[order] = np.cumsum(new, dtype=np.int32) - 1
    return values, inverse, first


def _buckets(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of n equal ranges of 64-bit keys begins in sorted keys, and the end."""
    edges = [np.uint64((i << 64) // n) for i in range(n)]
    return np.append(np.searchsorted(keys, np.array(edges, np.uint64)), len(keys))


def held_out(doc_id: int | None, folds: int, fold: int) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds == fold


def coded(df: DataFrame, key: str, text: str, folds: int, fold: int) -> tuple[DataFrame, int]:
    """A table dealt out by chunk, and in how many parts: (chunk, payload): word list, places of all tokens, tokens of each document, its id, and flags (1: held out, 2: no id)."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def out() -> pa.RecordBatch:
            lengths, ids, flags = (np.concatenate([h[i] for h in held]) for i in range(1, 4))
            words, places, _ = _distinct(np.concatenate([h[0] for h in held]))
            return _rows({"chunk": [number], "payload": [pack(words, places.astype(np.uint32), lengths.astype(np.uint32), ids, flags)]}, {"chunk": pa.int64(), "payload": pa.binary()})

        for ids, texts in _slices(batches):
            words = Words(texts)
            lengths = words.count + 1
            ends = np.cumsum(lengths) - 1
            tokens = np.empty(int(lengths.sum()), np.uint64)
            is_end = np.zeros(len(tokens), bool)
            is_end[ends] = True
            tokens[is_end], tokens[~is_end] = END, words.hash
            flags = np.array([held_out(i, folds, fold) + 2 * (i is None) for i in ids], np.uint8)
            held.append((tokens, lengths, np.array([i or 0 for i in ids], np.int64), flags))
            size += len(tokens)
            if size >= CHUNK:
                yield out()
                number, held, size = number + 1, [], 0
        if held:
            yield out()

    return bucketed(df.select(F.col(key).cast("long"), text).mapInArrow(code, "chunk long, payload binary"), "chunk", "chunks")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[bytes]]]:
    for b in batches:
        ids, texts, weight = [], [], 0
        for i, t in zip(b.column(0).to_pylist(), b.column(1)):
            ids.append(i)
            texts.append((t.as_py() or "").encode("utf-8", "surrogatepass").lower())
            weight += len(texts[-1]) + 1
            if weight >= SLICE:
                yield ids, texts
                ids, texts, weight = [], [], 0
        if ids:
            yield ids, texts


class Chunk:
    """A chunk's arrays, with the beginning of each document as a context in the word list's last place."""

    def __init__(self, payload: bytes):
        self.words, places, lengths, self.ids, self.flags = unpack(payload)
        self.places, self.lengths = places.astype(np.int32), lengths.astype(np.int64)
        self.train = np.repeat(~(self.flags & 1).astype(bool), self.lengths)
        starts = np.cumsum(self.lengths) - self.lengths
        self.starts = starts
        self.before = np.append(np.int32(len(self.words)), self.places[:-1])
        self.before[starts] = len(self.words)

    def counts(self) -> np.ndarray:
        """Training count of each word; last: training documents."""
        own = np.bincount(self.places[self.train], minlength=len(self.words))
        return np.append(own, int((~(self.flags & 1).astype(bool)).sum()))

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted bigram keys, each token's place among them, and for each key one token that has it."""
        names = mix(np.append(self.words, BEGIN))
        return _distinct(mix(names[self.before] * np.uint64(0xD6E8FEB86659FD93) + names[self.places]))


def _each(make: Callable[[int, Chunk], Iterator[tuple[int, bytes]]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, payload in zip(b.column(0).to_pylist(), b.column(1)):
                found = list(make(number, Chunk(payload.as_py())))
                yield _rows({"bucket": [x[0] for x in found], "chunk": [number] * len(found), "payload": [x[1] for x in found]}, MESSAGE)

    return run


def _words_out(n: int) -> Callable:
    def make(number: int, c: Chunk) -> Iterator[tuple[int, bytes]]:
        edges, counts = _buckets(c.words, n), c.counts()
        for b in range(n):
            own = slice(edges[b], edges[b + 1])
            if edges[b + 1] > edges[b]:
                yield b, pack(c.words[own], _small(counts[:-1][own]))

    return _each(make)


def _bigrams_out(n: int) -> Callable:
    def make(number: int, c: Chunk) -> Iterator[tuple[int, bytes]]:
        keys, inverse, _ = c.bigrams()
        counts = np.bincount(inverse[c.train], minlength=len(keys))
        edges = _buckets(keys, n)
        for b in range(n):
            own = slice(edges[b], edges[b + 1])
            if edges[b + 1] > edges[b]:
                yield b, pack(keys[own], _small(counts[own]))

    return _each(make)


def _small(a: np.ndarray) -> np.ndarray:
    top = int(a.max(initial=0))
    return a.astype(np.uint8 if top < 1 << 8 else np.uint32 if top < 1 << 32 else np.uint64)


def _messages(table: pa.Table) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
    """Messages of one bucket: chunks, and the keys and counts each has."""
    parts = [unpack(p.as_py()) for p in table.column("payload")]
    return table.column("chunk").to_pylist(), [p[0] for p in parts], [p[1] for p in parts]


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[tuple[list[slice], list[slice], np.ndarray, np.ndarray, np.ndarray]]:
    """By ranges of keys, which are hashes, about PIECE entries each: every message's entries in the range, where they are among
    all entries of the range, the sums of the range's distinct keys, each entry's place among these and which entries come first."""
    pieces = -(-sum(map(len, keys)) // PIECE)
    low, high = min(int(k[0]) for k in keys), max(int(k[-1]) for k in keys)
    edges = np.array([low + (high - low + 1) * i // pieces for i in range(1, pieces)], np.uint64)
    cuts = [[0, *np.searchsorted(k, edges).tolist(), len(k)] for k in keys]
    for i in range(pieces):
        own = [slice(c[i], c[i + 1]) for c in cuts]
        ends = np.cumsum([x.stop - x.start for x in own]).tolist()
        unique, inverse, first = _distinct(np.concatenate([k[x] for k, x in zip(keys, own)]))
        total = np.bincount(inverse, weights=np.concatenate([c[x] for c, x in zip(counts, own)]), minlength=len(unique)).astype(np.int64)
        yield own, [slice(e - (x.stop - x.start), e) for x, e in zip(own, ends)], total, inverse, first


def _figures(total: np.ndarray) -> np.ndarray:
    """Counts of counts up to DISCOUNTED + 1, and sum and number of the counts above 0."""
    of = np.bincount(np.minimum(total, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[: DISCOUNTED + 2]
    return np.concatenate([of, [total.sum(), (total > 0).sum()]]).astype(np.int64)


def _counted(table: pa.Table, owners: bool) -> pa.Table:
    """Back to each chunk: counts of its entries over the corpus and, if asked for, which of those above 0 it owns. And the bucket's figures."""
    chunks, keys, counts = _messages(table)
    sums, owned = ([np.zeros(len(k), kind) for k in keys] for kind in (np.int64, np.uint8))
    figures = np.zeros(DISCOUNTED + 4, np.int64)
    for own, at, total, inverse, first in _merged(keys, counts):
        figures += _figures(total)
        owner = np.zeros(len(inverse), np.uint8)
        owner[first] = total > 0
        total = total[inverse]
        for s, o, x, y in zip(sums, owned, own, at):
            s[x], o[x] = total[y], owner[y]
    payloads = [pack(_small(s), *[o] * owners) for s, o in zip(sums, owned)]
    bucket = table.column("bucket")[0].as_py()
    return pa.Table.from_batches([_rows({"bucket": [bucket] * (len(chunks) + 1), "chunk": [*chunks, WHOLE], "payload": [*payloads, figures.astype("<i8").tobytes()]}, MESSAGE)])


def _count_words(table: pa.Table) -> pa.Table:
    return _counted(table, owners=False)


def _count_bigrams(table: pa.Table) -> pa.Table:
    return _counted(table, owners=True)


def _whole(answers: DataFrame) -> np.ndarray:
    rows = answers.where(F.col("chunk") == WHOLE).select("payload").collect()  # one small row for each bucket
    return sum((np.frombuffer(r["payload"], "<i8") for r in rows), np.zeros(DISCOUNTED + 4, np.int64))


def fitted(words: DataFrame, bigrams: DataFrame) -> Model:
    one, two = _whole(words), _whole(bigrams)
    tokens, kinds = int(one[-2]), int(one[-1])
    unigram, bigram = discounts(one), discounts(two)
    r = np.arange(DISCOUNTED + 1)
    low = one[: DISCOUNTED + 1] * r
    kept = float((low * unigram[:-1]).sum() + (tokens - low.sum()))
    # All counts above the discounted ones: one more token stands for the unknown words.
    scale = float(tokens) if kept < tokens else tokens + 1.0
    return Model(tokens, kinds, unigram, bigram, 1 - kept / scale, scale)


def _assembled(table: pa.Table, kind: int) -> list[list[np.ndarray]]:
    rows = sorted((b, p) for k, b, p in zip(table.column("kind").to_pylist(), table.column("bucket").to_pylist(), table.column("payload").to_pylist()) if k == kind)
    return [[b, *unpack(p)] for b, p in rows]


class Known:
    """A chunk with the answers it got."""

    def __init__(self, left: pa.Table, right: pa.Table, model: Model):
        self.chunk = c = Chunk(left.column("payload")[0].as_py())
        words = _assembled(right, 0)
        counts = np.concatenate([w[1].astype(np.int64) for w in words])
        self.counts = counts
        self.p1 = model.p1(counts)
        _, self.inverse, self.first = c.bigrams()
        grams = _assembled(right, 1)
        self.kept = np.concatenate([g[1].astype(np.int64) for g in grams])
        self.owned = np.concatenate([g[2].astype(bool) for g in grams])
        self.discounted = model.bigram[np.minimum(self.kept, DISCOUNTED + 1)] * self.kept


def _sums_out(n: int, model: Model) -> Callable:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([_rows({"bucket": [], "chunk": [], "payload": []}, MESSAGE)])
        k = Known(left, right, model)
        c, own = k.chunk, np.flatnonzero(k.owned)
        context, word = c.before[k.first[own]], c.places[k.first[own]]
        sums = np.empty((2 * DISCOUNTED + 2, len(c.words) + 1), np.int64)
        spread(context, k.kept[own], sums[: DISCOUNTED + 1])
        spread(context, k.counts[word], sums[DISCOUNTED + 1 :])
        has = sums.any(axis=0)
        edges, rows, number = _buckets(c.words, n), [], left.column("chunk")[0].as_py()
        for b in range(n):
            at = np.flatnonzero(has[edges[b] : edges[b + 1]])
            if len(at):
                rows.append((b, number, pack(at.astype(np.uint64), *map(_small, sums[:, edges[b] + at]))))
        if has[-1]:
            rows.append((BEGINS, number, pack(*sums[:, -1:])))
        columns = dict(zip(MESSAGE, zip(*rows))) if rows else {k: [] for k in MESSAGE}
        return pa.Table.from_batches([_rows(columns, MESSAGE)])

    return run


def _weights_back(model: Model) -> Callable:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """left: sums of contexts; right: the words that chunks have in this bucket. Back: for each chunk its words' weights."""
        rows: dict[str, list] = {"bucket": [], "chunk": [], "payload": []}
        if right.num_rows:
            chunks, keys, counts = _messages(right)
            place = {number: i for i, number in enumerate(chunks)}
            sent = [(place[number], unpack(payload.as_py())) for number, payload in zip(left.column("chunk").to_pylist(), left.column("payload"))]
            weights, raised = ([np.empty(len(k), kind) for k in keys] for kind in (np.float64, np.uint8))
            for own, at, total, inverse, _ in _merged(keys, counts):
                sums = np.zeros((2 * DISCOUNTED + 2, len(total)), np.int64)
                for i, (has, *parts) in sent:
                    of = slice(*np.searchsorted(has, np.array([own[i].start, own[i].stop], np.uint64)))
                    sums[:, inverse[at[i]][has[of].astype(np.int64) - own[i].start]] += np.stack([x[of].astype(np.int64) for x in parts])
                weight, more = model.weights(sums, total)
                weight, more = weight[inverse], more[inverse]
                for w, m, x, y in zip(weights, raised, own, at):
                    w[x], m[x] = weight[y], more[y]
            rows["bucket"] = [right.column("bucket")[0].as_py()] * len(chunks)
            rows["chunk"], rows["payload"] = chunks, [pack(w, m) for w, m in zip(weights, raised)]
        return pa.Table.from_batches([_rows(rows, MESSAGE)])

    return run


SCORES = {"key": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}


def _pieces(ends: np.ndarray) -> Iterator[slice]:
    """Documents by their last tokens' ends, in stretches of PIECE tokens or one document."""
    at = 0
    while at < len(ends):
        begin = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, begin + PIECE, side="right")))
        yield slice(at, to)
        at = to


def _scores(model: Model, begin: tuple[float, bool, int]) -> Callable:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([_rows({k: [] for k in SCORES}, SCORES)])
        k = Known(left, right, model)
        c = k.chunk
        answers = _assembled(right, 2)
        weight = np.concatenate([*(a[1] for a in answers), [begin[0]]])
        total = np.append(k.counts, begin[2]) + np.concatenate([*(a[2] for a in answers), [begin[1]]])
        known, base, score = (np.empty(len(c.starts), kind) for kind in (np.int64, np.float64, np.float64))
        ends = np.append(c.starts[1:], len(c.places))
        for docs in _pieces(ends):
            own = slice(c.starts[docs.start], ends[docs.stop - 1])
            places, before, gram = c.places[own], c.before[own], k.inverse[own]
            p = np.where(k.kept[gram] > 0, k.discounted[gram] / np.maximum(total[before], 1), weight[before] * k.p1[places])
            counts = k.counts[places]
            starts = c.starts[docs] - own.start
            known[docs] = np.add.reduceat((counts > 0).astype(np.int64), starts)
            base[docs] = np.add.reduceat(np.log10((counts + 1) / (model.tokens + 1.0 * (model.kinds + 1))), starts)
            score[docs] = np.add.reduceat(np.log10(p), starts)
        ids = [None if f & 2 else i for i, f in zip(c.ids.tolist(), c.flags.tolist())]
        return pa.Table.from_batches([_rows({"key": ids, "held_out": (c.flags & 1).astype(bool), "n_tokens": c.lengths, "n_known": known, "train_tokens": [model.tokens] * len(ids), "base_score": base, "score": score}, SCORES)])

    return run


def dealt(messages: DataFrame, n: int) -> DataFrame:
    """Messages in n partitions, one for each bucket; grouping them by bucket moves no row."""
    return messages.repartitionById(n, "bucket")


def score(df: DataFrame, *, key: str = "doc_id", text: str = "text", folds: int = 7, fold: int = 2) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of df; trained on the other folds."""
    chunks, m = coded(df, key, text, folds, fold)
    n = max(shuffle_width(df.sparkSession), -(-chunks.count() // CHUNKS))
    words_sent = dealt(chunks.mapInArrow(_words_out(n), MESSAGE_SQL), n)
    words = settled(words_sent.groupBy("bucket").applyInArrow(_count_words, MESSAGE_SQL), "words")
    bigrams = settled(dealt(chunks.mapInArrow(_bigrams_out(n), MESSAGE_SQL), n).groupBy("bucket").applyInArrow(_count_bigrams, MESSAGE_SQL), "bigrams")
    model = fitted(words, bigrams)
    answers = words.select(F.lit(0).alias("kind"), "*").union(bigrams.select(F.lit(1).alias("kind"), "*")).where(F.col("chunk") != WHOLE)
    by_chunk = chunks.groupBy("chunk")
    sums = settled(by_chunk.cogroup(answers.repartition(m, "chunk").groupBy("chunk")).applyInArrow(_sums_out(n, model), MESSAGE_SQL), "sums")
    back = dealt(sums.where(F.col("bucket") != BEGINS), n).groupBy("bucket").cogroup(words_sent.groupBy("bucket")).applyInArrow(_weights_back(model), MESSAGE_SQL)
    begin = _begin(sums, model, df, key, folds, fold)
    both = answers.union(back.select(F.lit(2).alias("kind"), "*"))
    types = "key long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return by_chunk.cogroup(both.repartition(m, "chunk").groupBy("chunk")).applyInArrow(_scores(model, begin), types).withColumnRenamed("key", key)


def _begin(sums: DataFrame, model: Model, df: DataFrame, key: str, folds: int, fold: int) -> tuple[float, bool, int]:
    """The context that begins a document: its weight, whether its count is raised, and its count, the training documents."""
    names = [f"s{i}" for i in range(2 * DISCOUNTED + 2)]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.array([np.concatenate(unpack(p.as_py())) for p in b.column(0)], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in own.T], names=names)

    found = sums.where(F.col("bucket") == BEGINS).select("payload").mapInArrow(take, ", ".join(f"{x} long" for x in names))
    own = np.array([x or 0 for x in found.agg(*(F.sum(x) for x in names)).first()], np.int64)
    fold_of = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds
    documents = df.where(fold_of != fold).count()
    weight, more = model.weights(own[:, None], np.array([documents]))
    return float(weight[0]), bool(more[0]), documents


def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs)

"""Operator 5: edit-aware token counts.

A document's pre-tokens are grouped into leaves; each leaf keeps its characters and tokens, and a segment tree over the
leaves keeps sums, the count of the whole document at the root. An edit re-encodes the leaves it touches and a little
before them, then goes on until a pre-token begins where an old leaf did: the pre-token pattern only looks ahead, so
from there on all is as it was. The leaves in between get the new pre-tokens, and their sums are renewed up to the root.
Leaves that would hold over twice `LEAF` pre-tokens are split, so an edit stays local however a text has grown.

Token counts are those of byte-level BPE with special tokens' strings as ordinary text.

Defined cases: a null text counts as empty, with one empty leaf; a very long text has more leaves, nothing else; edits are (start, end, replacement) in characters of the
old text, in any order; one that overlaps an earlier one is refused; empty or null lists of edits change nothing;
repeated rows are counted each; an empty table gives an empty result; extra columns stay.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.encoding import PATTERN, Encoder, encoder

LEAF = 64
#: A pre-token is decided by at most this many characters after it.
AHEAD = 4
#: What the query masks: a string that a match must hold, the pattern, the replacement.
MASKS = (
    ("@", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<EMAIL>"),
    ("://", r"https?://[^\s]+", "<URL>"),
    ("", r"[0-9a-fA-F]{32,}", "<SECRET>"),
    ("", r"\d{7,}", "<NUMBER>"),
)


@dataclass
class Tree:
    """Sums over leaves: rows are characters and tokens; node i has children 2i and 2i+1, leaves start at `size`."""

    sums: np.ndarray
    leaves: int

    @staticmethod
    def of(leaves: np.ndarray) -> Tree:
        n = leaves.shape[1]
        size = 1 << max(0, n - 1).bit_length()
        sums = np.zeros((2, 2 * size), np.int64)
        sums[:, size : size + n] = leaves
        level = size
        while level > 1:
            sums[:, level // 2 : level] = sums[:, level : 2 * level : 2] + sums[:, level + 1 : 2 * level : 2]
            level //= 2
        return Tree(sums, n)

    @property
    def size(self) -> int:
        return self.sums.shape[1] // 2

    @property
    def chars(self) -> int:
        return int(self.sums[0, 1])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def bounds(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.sums[0, self.size : self.size + self.leaves])])

    def put(self, first: int, values: np.ndarray) -> None:
        """Replaces some leaves and renews the sums above them."""
        low, high = self.size + first, self.size + first + values.shape[1] - 1
        self.sums[:, low : high + 1] = values
        while low > 1:
            low, high = low // 2, high // 2
            nodes = np.arange(low, high + 1)
            self.sums[:, nodes] = self.sums[:, 2 * nodes] + self.sums[:, 2 * nodes + 1]

    def renew(self, changes: list[tuple[int, int, np.ndarray]]) -> None:
        """Replaces leaves low to high by others, in ascending order; where their number changes, the tree is built anew."""
        if all(values.shape[1] == high - low for low, high, values in changes):
            for low, _, values in changes:
                self.put(low, values)
            return
        old, parts, at = self.sums[:, self.size : self.size + self.leaves], [], 0
        for low, high, values in changes:
            parts += [old[:, at:low], values]
            at = high
        new = Tree.of(np.concatenate([*parts, old[:, at:]], axis=1))
        self.sums, self.leaves = new.sums, new.leaves

    def dump(self) -> bytes:
        return self.sums[:, self.size : self.size + self.leaves].astype("<u4").tobytes()

    @staticmethod
    def load(value: bytes) -> Tree:
        return Tree.of(np.frombuffer(value, "<u4").reshape(2, -1).astype(np.int64))


class Counter:
    """Builds and edits trees with one vocabulary."""

    def __init__(self, path: str):
        import regex

        self.encoder: Encoder = encoder(path, True)
        self.pieces = self.encoder.pieces
        self.match = regex.compile(PATTERN).finditer
        self.library = self.encoder.library.pre_tokenizer.pre_tokenize_str

    def pieces_from(self, text: str, begin: int = 0) -> Iterator[tuple[str, int]]:
        """Pre-tokens from a place where one begins, and where each ends. Characters on which Unicode versions differ are left to the library."""
        if self.encoder.settled(text):
            return ((m[0], m.end()) for m in self.match(text, begin))
        return ((text[begin + a : begin + b], begin + b) for _, (a, b) in self.library(text[begin:]))

    def measured(self, pieces: list[str]) -> np.ndarray:
        get = self.pieces.__getitem__
        return np.array([list(map(len, pieces)), [len(get(p)) >> 2 for p in pieces]], np.int64).reshape(2, -1)

    def build(self, text: str) -> Tree:
        values = self.measured(self.encoder.split(text) if self.encoder.settled(text) else [p for p, _ in self.pieces_from(text)])
        if not values.shape[1]:
            return Tree.of(np.zeros((2, 1), np.int64))
        return Tree.of(np.add.reduceat(values, np.arange(0, values.shape[1], LEAF), axis=1))

    def edit(self, text: str, tree: Tree, edits: list[tuple[int, int, str]]) -> tuple[str, int]:
        """Changes the tree to that of the edited text; the new text, and how many characters were encoded anew."""
        edits = sorted(e for e in edits if e[0] != e[1] or e[2])
        if any(a[1] > b[0] for a, b in itertools.pairwise(edits)) or any(not 0 <= s <= e <= len(text) for s, e, _ in edits):
            raise ValueError("edits overlap or are outside the text")
        parts, at = [], 0
        for s, e, new in edits:
            parts += [text[at:s], new]
            at = e
        changed = "".join([*parts, text[at:]])
        bounds, encoded, shift, i, last, renewed = tree.bounds(), 0, 0, 0, 0, []
        while i < len(edits):
            low = max(last, int(np.searchsorted(bounds, max(0, edits[i][0] - AHEAD), "right")) - 1)
            low = min(low, tree.leaves - 1)
            begin = int(bounds[low]) + shift
            high, pieces, end = low + 1, [], begin
            found = self.pieces_from(changed, begin)
            while True:
                # Edits up to the end of the stretch are part of it.
                while i < len(edits) and edits[i][0] - AHEAD <= bounds[high]:
                    shift += len(edits[i][2]) - (edits[i][1] - edits[i][0])
                    high = max(high, int(np.searchsorted(bounds, edits[i][1], "left")))
                    i += 1
                goal = int(bounds[high]) + shift
                while end < goal:
                    piece, end = next(found)
                    pieces.append(piece)
                if end == goal:
                    break
                high += 1
            encoded += end - begin
            values = self.measured(pieces) if pieces else np.zeros((2, 0), np.int64)
            # As many leaves as before; where these would be over twice full, as many as there is need for.
            leaves = high - low if values.shape[1] <= 2 * LEAF * (high - low) else -(-values.shape[1] // LEAF)
            places = np.linspace(0, values.shape[1], leaves + 1).astype(int)
            sums = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(values, axis=1)], axis=1)
            renewed.append((low, high, np.diff(sums[:, places], axis=1)))
            last = high
        tree.renew(renewed)
        return changed, encoded


def build(df: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """df with `tree` (the leaves; sums follow from them) and `n_tokens`."""
    names = [c for c in df.columns if c not in ("tree", "n_tokens")]
    base = df.select(*names)
    at = names.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + ", tree binary, n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for b in batches:
            trees = [counter.build(t.as_py() or "") for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([t.dump() for t in trees], pa.binary()), pa.array([t.tokens for t in trees], pa.int64())], names=[*names, "tree", "n_tokens"])

    return base.mapInArrow(run, schema)


def apply_edits(df: DataFrame, vocabulary: str, *, text: str = "text", edits: str | Callable[[str], list[tuple[int, int, str]]] = "edits") -> DataFrame:
    """df (with tree and n_tokens of build()) after the edits: new text, tree and n_tokens, `n_edits` and `chars_encoded`.

    edits: the column that holds them (array<struct<start,end,replacement>>), or a function that finds them in a text.
    """
    names = [c for c in df.columns if c not in ("n_edits", "chars_encoded")]
    base = df.select(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + ", n_edits long, chars_encoded long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for b in batches:
            columns = {n: b.column(i) for i, n in enumerate(names)}
            given = columns[edits] if isinstance(edits, str) else None
            texts, trees, tokens, number, encoded = [], [], [], [], []
            for i, (t, tree) in enumerate(zip(columns[text], columns["tree"])):
                tree, n, t = Tree.load(tree.as_py()), 0, t.as_py()
                own = edits(t or "") if given is None else [(e["start"], e["end"], e["replacement"] or "") for e in given[i].as_py() or []]
                if own:
                    t, n = counter.edit(t or "", tree, own)
                texts.append(t)
                trees.append(tree.dump())
                tokens.append(tree.tokens)
                number.append(len(own))
                encoded.append(n)
            columns |= {text: pa.array(texts, pa.string()), "tree": pa.array(trees, pa.binary()), "n_tokens": pa.array(tokens, pa.int64()), "n_edits": pa.array(number, pa.int64()), "chars_encoded": pa.array(encoded, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return base.mapInArrow(run, schema)


def masks(text: str) -> list[tuple[int, int, str]]:
    """Edits that mask addresses, links, keys and long numbers; of those that overlap, the first to begin, in the order of MASKS."""
    found = []
    for order, (needed, pattern, new) in enumerate(_masks()):
        if needed in text:
            found += [(m.start(), order, m.end(), new) for m in pattern.finditer(text)]
    out, at = [], 0
    for start, _, end, new in sorted(found):
        if start >= at:
            out.append((start, end, new))
            at = end
    return out


@functools.cache
def _masks():
    import re

    return [(needed, re.compile(pattern), new) for needed, pattern, new in MASKS]


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every whole document before and after its personal data and secrets are masked."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = build(docs, path).withColumn("n_tokens_before", F.col("n_tokens"))
    edited = apply_edits(counted, path, edits=masks)
    return edited.select("doc_id", "n_tokens_before", "n_edits", F.col("n_tokens").alias("n_tokens_after"), F.length("text").cast("long").alias("n_chars_after"), "chars_encoded")

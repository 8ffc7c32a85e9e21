"""Operator 9: benchmark decontamination by template canonicalisation.

Words are canonical in two ways. Literal: lower case, outer punctuation off. Typed: numbers, units and capitalised words
(names, and words that begin a sentence) become the placeholders <num>, <unit> and <name>. Windows of `width`
canonical words of the benchmark are hashed, and every window of every whole document is looked up among them.

A literal window that matches is a leak. A typed one is only if its slots are consistent over the whole matched
stretch: wherever the benchmark item has the same value in two slots, the document has too, and different names stay
different. So a question with other numbers and names is caught, and chance meetings of placeholders are not. Windows
with fewer than `min_literal` words that aren't placeholders are not looked up. Items shorter than a window, of at least
`min_words` words, are one window as a whole, which needs such words in proportion to its length.

The benchmark is a stated set of queries. It is taken in blocks of at most `block` windows, so what every task gets is
bounded, and each block passes over the documents once.

Defined cases: null or empty texts and items match nothing; rows of equal or no doc_id are judged row by row; repeated items
are reported each; very long texts are worked on alone; an empty table gives an empty result; extra columns stay.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import settled
from palimpsest.llm.hashing import mix, prefixes, span_hash

#: Words that stand for numbers, and units of measure.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half twice".split()
UNITS = "mm cm m km inch inches ft foot feet yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs oz ounce ounces pound pounds ton tons ml l liter liters litre litres gallon gallons second seconds sec minute minutes min hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents usd eur kmh mph hz khz mhz ghz kb mb gb tb degree degrees celsius fahrenheit watt watts volt volts meter meters metre metres kilometer kilometers kilometre kilometres".split()
PUNCTUATION = ".,;:!?\"'()[]{}<>«»„“”‘’…-–—*_`|/\\"
TABLE = 100_000
CHUNK = 1 << 20


@dataclass(frozen=True)
class Rules:
    width: int = 13
    min_literal: int = 4
    min_words: int = 6
    block: int = 1_000_000

    def literal_words(self, n: int) -> int:
        """How many words of a typed window of n words must not be placeholders."""
        return -(-self.min_literal * n // self.width)


class Canon(dict):
    """A word as it stands to its row in `literal`, `typed` (64-bit hashes) and `slot` (is it a placeholder)."""

    def __init__(self):
        import regex
        import xxhash

        self.number = regex.compile(r"[+\-$€£]*\d[\d.,:/]*(?:st|nd|rd|th)?[%$€£]?").fullmatch
        self.glued = regex.compile(r"[+\-$€£]*\d[\d.,]*(\p{L}+)").fullmatch
        self.digest = xxhash.xxh64_intdigest
        self.units, self.numbers = set(UNITS), set(NUMBER_WORDS)
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.literal, self.typed, self.slot = [], [], []

    def __missing__(self, word: str) -> int:
        literal, typed = self.forms(word)
        self.literal.append(self.digest(literal))
        self.typed.append(self.literal[-1] if typed == literal else self.digest(typed))
        self.slot.append(typed != literal)
        self[word] = len(self.literal) - 1
        return self[word]

    def forms(self, word: str) -> tuple[str, str]:
        bare = word.strip(PUNCTUATION) or word
        low = bare.lower()
        letters = bare.isalpha()  # then it has no digit, which both patterns ask for
        if low in self.numbers or not letters and self.number(bare):
            return low, "<num>"
        if low in self.units:
            return low, "<unit>"
        if not letters and (m := self.glued(low)) and m[1] in self.units:
            return low, "<num><unit>"
        if bare[:1].isupper():
            return low, "<name>"
        return low, low


def consistent(pairs: list[tuple[str, str, str]]) -> bool:
    """(kind, item's value, document's value) of slots: one value for one value, and for names different for different."""
    there: dict[tuple[str, str], str] = {}
    back: dict[tuple[str, str], str] = {}
    for kind, item, doc in pairs:
        if there.setdefault((kind, item), doc) != doc:
            return False
        if kind == "<name>" and back.setdefault((kind, doc), item) != item:
            return False
    return True


class Index:
    """The windows of some benchmark items, by length and hash."""

    def __init__(self, items: list[tuple[int, str]], rules: Rules):
        self.rules, self.items = rules, {}
        canon = Canon()
        found: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for place, (item, text) in enumerate(items):
            words = text.split()
            forms = [canon.forms(w) for w in words]
            self.items[place] = item, forms
            n = min(rules.width, len(words))
            if n < rules.min_words:
                continue
            rows = np.array([canon[w] for w in words])
            for hashes, enough in Windows(canon, rows, rules).of(n):
                for at in np.flatnonzero(enough):
                    found[n][int(hashes[at])].append((place, int(at)))
        self.lengths = sorted(found)
        self.places = {n: dict(found[n]) for n in self.lengths}
        self.known = {n: np.sort(np.array(list(found[n]), np.uint64)) for n in self.lengths}
        self.bits = {n: _bitmap(v) for n, v in self.known.items()}

    def hits(self, n: int, hashes: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.bits[n][(hashes >> np.uint64(42)).astype(np.int64)])
        at = np.searchsorted(self.known[n], hashes[maybe])
        at[at == len(self.known[n])] = 0
        return maybe[self.known[n][at] == hashes[maybe]]


def _bitmap(values: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << 22, bool)
    bits[(values >> np.uint64(42)).astype(np.int64)] = True
    return bits


class Windows:
    """The literal and the typed windows of some words, of any length."""

    def __init__(self, canon: Canon, rows: np.ndarray, rules: Rules):
        self.rules, self.size = rules, len(rows)
        self.slots = np.concatenate([[0], np.cumsum(np.array(canon.slot, bool)[rows])])
        self.sums = [prefixes(np.array(kind, np.uint64)[rows]) for kind in (canon.literal, canon.typed)]

    def of(self, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Literal, then typed windows of n words: their hashes, and which are looked up."""
        if self.size < n:
            return
        at = np.arange(self.size - n + 1)
        filled = self.slots[n:] - self.slots[: len(at)]
        for sums, enough in zip(self.sums, (np.ones(len(at), bool), (filled > 0) & (n - filled >= self.rules.literal_words(n)))):
            yield mix(span_hash(sums, at, at + n) + np.uint64(n)), enough


def leaks(texts: list[str], index: Index, canon: Canon) -> Iterator[tuple[int, int, int, int, int, int, bool]]:
    """(text's number, item, first word, end word, slots, slots changed, literal?) of every matched stretch."""
    split = [t.split() for t in texts]
    if len(canon) > TABLE:
        canon.empty()
    rows = np.fromiter((canon[w] for words in split for w in words), np.int64)
    counts = np.array([len(w) for w in split], np.int64)
    first = np.cumsum(counts) - counts
    doc = np.repeat(np.arange(len(split)), counts)
    stretches: dict[tuple[int, int, int], list[tuple[int, int]]] = defaultdict(list)
    windows = Windows(canon, rows, index.rules)
    for n in index.lengths:
        for hashes, enough in windows.of(n):
            for p in index.hits(n, hashes).tolist():
                d = int(doc[p])
                if enough[p] and p + n <= first[d] + counts[d]:
                    for place, at in index.places[n][int(hashes[p])]:
                        stretches[d, place, int(p - first[d]) - at].append((at, at + n))
    for (d, place, shift), own in sorted(stretches.items()):
        item, forms = index.items[place]
        start = None
        for a, b in [*sorted(set(own)), (1 << 60, 0)]:
            if start is not None and a > end:
                yield from _judged(d, item, forms, split[d], shift, start, end, index.rules, canon)
                start = None
            if start is None:
                start, end = a, b
            end = max(end, b)


def _judged(d: int, item: int, forms: list, words: list[str], shift: int, start: int, end: int, rules: Rules, canon: Canon) -> Iterator[tuple]:
    own = [canon.forms(w) for w in words[start + shift : end + shift]]
    pairs = [(a[1], a[0], b[0]) for a, b in zip(forms[start:end], own) if a[1] == b[1] and a[1] != a[0]]
    equal = [a[0] == b[0] for a, b in zip(forms[start:end], own)]
    n = min(rules.width, len(forms))
    run = longest = 0
    for x in equal:
        run = run + 1 if x else 0
        longest = max(longest, run)
    literal = longest >= n
    if literal or consistent(pairs):
        yield d, item, start + shift, end + shift, len(pairs), sum(a != b for _, a, b in pairs), literal


def _blocks(benchmark: DataFrame, key: str, text: str, rules: Rules) -> Iterator[list[tuple[int, str]]]:
    held, size = [], 0
    for r in benchmark.where(F.col(text).isNotNull()).select(key, text).orderBy(key, text).toLocalIterator():
        n = 2 * len(r[1].split())
        if held and size + n > rules.block:
            yield held
            held, size = [], 0
        held.append((r[0], r[1]))
        size += n
    if held:
        yield held


def _slices(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for b in batches:
        low, weight, held = 0, 0, []
        for i, t in enumerate(b.column(at)):
            held.append(t.as_py() or "")
            weight += len(held[-1])
            if weight >= CHUNK:
                yield b.slice(low, i + 1 - low), held
                low, weight, held = i + 1, 0, []
        if held:
            yield b.slice(low), held


def find_leaks(df: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """(key, item, first_word, end_word, n_slots, n_changed, literal): every stretch of a document that leaks an item."""
    schema = f"`{key}` long, item_id long, first_word long, end_word long, n_slots long, n_changed long, literal boolean"
    find = lambda items: df.select(F.col(key).cast("long"), text).mapInArrow(_finder(items, rules, key), schema)
    blocks = _blocks(benchmark, item_key, item_text, rules)
    out = find(next(blocks, []))
    for items in blocks:  # each is done before the next is fetched
        out = settled(out.union(find(items)), "leaks")
    return out


def _finder(items: list[tuple[int, str]], rules: Rules, key: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, canon = Index(items, rules), Canon()
        names = [key, "item_id", "first_word", "end_word", "n_slots", "n_changed", "literal"]
        for b, texts in _slices(batches, 1):
            rows = list(leaks(texts, index, canon))
            if rows:
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(c, pa.int64()) for c in columns[1:-1]), pa.array(columns[-1], pa.bool_())], names=names)

    return run


def decontaminate(df: DataFrame, benchmark: DataFrame, *, text: str = "text", item_key: str = "item_id", item_text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """df without the rows that leak an item. Nothing is shuffled."""
    at = df.columns.index(text)
    blocks = _blocks(benchmark, item_key, item_text, rules)
    df = df.mapInArrow(_clean(next(blocks, []), rules, at), df.schema)
    for items in blocks:
        df = settled(df, "clean").mapInArrow(_clean(items, rules, at), df.schema)
    return df


def _clean(items: list[tuple[int, str]], rules: Rules, at: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, canon = Index(items, rules), Canon()
        for b, texts in _slices(batches, at):
            bad = {r[0] for r in leaks(texts, index, canon)}
            yield b.filter(pa.array([i not in bad for i in range(b.num_rows)], pa.bool_()))

    return run


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return find_leaks(docs, benchmark)

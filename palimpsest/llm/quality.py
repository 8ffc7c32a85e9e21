"""Operator 4: quality rules by distribution divergence.

Two histograms of a document are held against its language's: classes of characters, and common words. Each language's
references are summed over all its documents of at least `min_words` words and few symbols. The measure is the Jensen-Shannon distance
(square root of the divergence in bits, 0 to 1). Short texts scatter, so there are minimum-length guards: no comparison
of words below `min_words_compared`, and what sampling alone adds to the divergence of a text of n words is taken off.

The language is the primary subtag of the `lang` column in lower case ('de' of 'de-DE', 'DE' and 'de_at') where that is two or
three letters, which bounds the references, which every task gets, at 26**2 + 26**3 languages. A text with no such code is
held against the language nearest to it. A language of fewer than `min_reference_words` words has no reference: its
texts, and those with no code where no language has one, are judged by the base rules only, with a distance of 0.

Defined cases: a null or empty text has no words and fails the base rules; a null lang counts as none; repeated rows are
judged alike; a very long text is judged whole; an empty table gives an empty result; extra columns stay, those named like a result column are replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import settled

SYMBOLS = "#*$%&|<>"
SYMBOL_BYTES = [s.encode() for s in SYMBOLS]
RESULT = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "char_distance": "double", "word_distance": "double", "kept": "boolean"}
#: Words met by a task before it hands on its counts.
HELD = 150_000
BLANK = b" \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    common_words: int = 100
    min_words_compared: int = 100
    min_reference_words: int = 1000
    max_reference_symbol_percent: int = 1
    max_char_distance: float = 0.185
    max_word_distance: float = 0.30


def _classes() -> np.ndarray:
    """The class of each byte of UTF-8: what ASCII is, or of which block its first byte is. 0: bytes that go on."""
    of = np.zeros(256, np.uint8)
    groups = [
        range(97, 123), range(65, 91), range(48, 58), b" ", b"\n", b"\t\x0b\x0c\r", b".", b",", b";:!?", b"'\"-()", b"#*$%&|<>", b"/\\@_^~`=+[]{}",
        [*range(0, 9), *range(14, 32), 127], [0xC2], [0xC3], range(0xC4, 0xCA), range(0xCA, 0xD0), range(0xD0, 0xD4), range(0xD4, 0xE0), range(0xE0, 0xE3), range(0xE3, 0xF0), range(0xF0, 0xF5),
    ]
    for k, group in enumerate(groups, 1):
        of[list(group)] = k
    return of


CLASSES = _classes()
N_CLASSES = int(CLASSES.max()) + 1
#: ASCII letters in lower case, bytes above ASCII as they are, all else to spaces.
LETTERS = bytes(b + 32 if 65 <= b < 91 else b if 97 <= b < 123 or b >= 128 else 32 for b in range(256))


def base(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = text.split("\n")
    seen: set[str] = set()
    again = 0
    for line in lines:
        if line in seen:
            again += bool(line.strip(" \t\n\x0b\x0c\r"))
        else:
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    covered = 0
    if len(set(windows)) < len(windows):
        times, end = Counter(windows), 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                covered += i + 3 - max(i, end)
                end = i + 3
    return len(words), chars, symbols, again, covered


def char_histogram(raw: bytes) -> np.ndarray:
    counts = np.bincount(CLASSES[np.frombuffer(raw, np.uint8)], minlength=N_CLASSES).astype(np.float64)
    counts[0] = 0
    return counts


def divergence(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon divergence in bits of two histograms of counts."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    part = lambda a: float((a[a > 0] * np.log2(a[a > 0] / m[a > 0])).sum())
    return max(0.0, (part(p) + part(q)) / 2)


def language(lang: Column) -> Column:
    """The primary subtag of a code, in lower case; '' where it isn't two or three letters."""
    return F.coalesce(F.regexp_extract(F.lower(F.trim(lang)), r"^([a-z]{2,3})(?:[-_.@].*)?$", 1), F.lit(""))


def reference_counts(df: DataFrame, lang: str, text: str, rules: Rules) -> DataFrame:
    """(lang, kind, item, n) over all documents: kind 0 are character classes, kind 1 words. Texts with no language are in none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        chars: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            rows = [(k, 1, w.decode("utf-8", "replace"), n) for k, c in words.items() for w, n in c.items()]
            rows += [(k, 0, str(i), int(n)) for k, h in chars.items() for i, n in enumerate(h) if n]
            words.clear()
            chars.clear()
            columns = list(zip(*rows)) or [[], [], [], []]
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "kind", "item", "n"])

        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1)):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                if len(raw.split()) < rules.min_words or 100 * sum(map(raw.count, SYMBOL_BYTES)) > rules.max_reference_symbol_percent * len(raw):
                    continue
                words.setdefault(k, Counter()).update(raw.translate(LETTERS).split())
                chars[k] = chars.get(k, 0) + char_histogram(raw)
                if sum(map(len, words.values())) > HELD:
                    yield out()
        yield out()

    found = df.select(language(F.col(lang)).alias("__lang"), text).where("__lang <> ''").mapInArrow(count, "lang string, kind long, item string, n long")
    return found.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))


def references(df: DataFrame, lang: str = "lang", text: str = "text", rules: Rules = Rules()) -> dict[str, tuple[np.ndarray, dict[bytes, int], np.ndarray]]:
    """For each language: the character histogram, each common word's place, and the histogram of these with all other words last."""
    both = settled(reference_counts(df, lang, text, rules), "reference")
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "item"))
    top = both.where("kind = 1").withColumn("place", order).where(F.col("place") <= rules.common_words).drop("place")
    totals = both.where("kind = 1").groupBy("lang").agg(F.sum("n").alias("n")).select("lang", F.lit(2).cast("long").alias("kind"), F.lit("").alias("item"), "n")
    rows = top.unionByName(both.where("kind = 0")).unionByName(totals).collect()
    out = {}
    for k in sorted({r["lang"] for r in rows}):
        own = [r for r in rows if r["lang"] == k]
        total = sum(r["n"] for r in own if r["kind"] == 2)
        if total < rules.min_reference_words:
            continue
        chars = np.zeros(N_CLASSES)
        for r in own:
            if r["kind"] == 0:
                chars[int(r["item"])] = r["n"]
        words = sorted((r for r in own if r["kind"] == 1), key=lambda r: (-r["n"], r["item"]))
        held = np.array([r["n"] for r in words], np.float64)
        out[k] = chars, {r["item"].encode(): i for i, r in enumerate(words)}, np.append(held, total - held.sum())
    return out


def distances(text: str | None, known: tuple[np.ndarray, dict[bytes, int], np.ndarray], rules: Rules) -> tuple[float, float | None]:
    """The text's Jensen-Shannon distances from its language: characters, and words unless there are too few."""
    chars, places, words = known
    raw = (text or "").encode("utf-8", "surrogatepass")
    by_char = math.sqrt(divergence(char_histogram(raw), chars))
    own = raw.translate(LETTERS).split()
    if len(own) < rules.min_words_compared:
        return by_char, None
    found = Counter([places[w] for w in own if w in places])
    counts = np.zeros(len(words))
    counts[list(found)] = list(found.values())
    counts[-1] = len(own) - counts.sum()
    chance = (len(words) - 1) / (8 * math.log(2) * len(own))
    return by_char, math.sqrt(max(0.0, divergence(counts, words) - chance))


def nearest(text: str | None, known: dict[str, tuple], rules: Rules) -> tuple[float, float | None]:
    """The distances from the language that is nearest in words, or in characters where words are too few; 0 where there is none."""
    found = [distances(text, k, rules) for k in known.values()]
    return min(found, key=lambda d: (d[0] if d[1] is None else d[1], d[0]), default=(0.0, None))


def judge(df: DataFrame, *, lang: str = "lang", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """df with the base figures, the two distances and the verdict `kept`."""
    rows = df.drop(*RESULT)
    known = references(rows, lang, text, rules)
    names, at = [*rows.columns, *RESULT], rows.columns.index(text)
    keyed = rows.withColumn("__lang", language(F.col(lang)))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), *(f"{k} {v}" for k, v in RESULT.items())])

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for k, t in zip(b.column(b.num_columns - 1).to_pylist(), b.column(at)):
                t = t.as_py()
                figures = base(t)
                failed = figures[0] < rules.min_words or 100 * figures[4] > rules.max_repeat_percent * figures[0]
                by_char, by_word = nearest(t, {k: known[k]} if k in known else {} if k else known, rules)
                kept = not failed and by_char <= rules.max_char_distance and (by_word is None or by_word <= rules.max_word_distance)
                out.append((*figures, failed, by_char, by_word, kept))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
            columns = list(zip(*out)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, kind) for c, kind in zip(columns, kinds))], names=names)

    return keyed.mapInArrow(verdicts, schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    return judge(docs).drop("lang", "text")

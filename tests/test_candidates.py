"""What workers know of a candidate text, and which texts they leave out."""

import random
import re

import numpy as np
import pytest

from palimpsest.functions import fuzzy
from palimpsest.functions import rules as R
from palimpsest.functions.text import normalized_value
from palimpsest.operators import scan
from palimpsest.operators.candidates import PATTERNS, SIGNALS, judged
from palimpsest.plans import seeded

WORDS = ["system", "user", "refuser", "Système", "ſystem prompt", "ignore", "score 9", "don't", "é", "​", "‮", "ｉｇｎｏｒｅ", "a\x1cb", "recommend accept", "日本"]


def test_judged_misses_nothing():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(WORDS) + rnd.choice(["", " "]) for _ in range(rnd.randint(0, 6))) for _ in range(400)]
    norms = [normalized_value(t) for t in texts]
    may, sure = judged(texts, norms)
    for k, pattern in PATTERNS.items():
        holds = np.array([bool(re.search(pattern, n)) or k == "direct_phrase" and bool(re.search(pattern, t, re.I | re.S)) for t, n in zip(texts, norms)])
        found = may[:, SIGNALS.index(k)]
        assert not (holds & ~found).any() and (holds == found)[sure].all()
    assert [bool(x) for x in may[:, 4]] == ["​" in t for t in texts] and [bool(x) for x in may[:, 5]] == ["‮" in t for t in texts]


def test_texts_that_cannot_become_findings_stay_in_workers(spark, tmp_path):
    """all of them went through every rule, page texts three times."""
    spark.createDataFrame([(11, "plants and roots"), (16, "plants")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    docs = seeded.extracted(spark, str(tmp_path))
    rows = scan.candidates(docs, R.Rules(fuzzy="off"), R.FLAGGED_SCORE).collect()
    assert sorted(r.source for r in rows if r.doc_key == "doc/11") == ["embedded_file", "span"]
    assert {r.source for r in rows if r.doc_key == "doc/16"} == {"embedded_file", "span", "page_text", "annotation", "widget", "metadata"}
    assert scan.candidates(docs, R.Rules(fuzzy="off")).where("doc_key = 'doc/11'").count() == 8


def test_rows_of_one_doc_id_make_one_document(spark, tmp_path):
    spark.createDataFrame([(11, "b\n\nc"), (11, "a"), (12, None), (None, "d")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    docs = {r.doc_key: [s.text for s in r.pages[0].spans] for r in seeded.extracted(spark, str(tmp_path)).collect()}
    assert docs == {"doc/11": ["a", "b", "c"], None: ["d"]}


def test_long_texts_in_blocks(monkeypatch):
    """windows are compared in blocks that stay in the cache, and edges with the whole."""
    monkeypatch.setattr(fuzzy, "BLOCK", 50)
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("ignoreal pvusé日") for _ in range(rnd.randint(40, 300))) for _ in range(20)]
    for t, (best, template) in zip(texts, fuzzy.best_templates(texts)):
        want = [fuzzy.partial_ratio(t, u) for u in R.TEMPLATES]
        assert best == pytest.approx(max(want)) and template == R.TEMPLATES[want.index(max(want))]


def test_a_batch_is_matched_in_pieces():
    """a worker holds a piece of its batch as Python strings, however large the batch."""
    import pyarrow as pa

    sizes = []

    def of(part):
        sizes.append(sum(map(len, part)))
        return [(1.0, "x")] * len(part)

    found = fuzzy.in_pieces(pa.array(["a" * 10_000] * 1000), of)
    assert len(found) == 1000 and sum(sizes) == 10_000_000 and max(sizes) <= 4 * fuzzy.SLICE
    assert len(fuzzy.in_pieces(pa.array([], pa.string()), of)) == 0

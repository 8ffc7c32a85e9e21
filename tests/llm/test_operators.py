"""The corpus operators against plain versions, and on the defined odd cases."""

import random
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import decontamination, katz, line_dedup, mixing, quality, sharding, simhash, similarity, substring_dedup, token_counts, token_files

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


# 1: token files


def test_token_files(spark, docs, rows):
    from tokenizers import Tokenizer

    plain, start, want = Tokenizer.from_file(BPE), 0, {}
    for d, t in sorted(pairs(rows)):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        want[d] = start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    files = token_files.write(docs, BPE, parts=4)
    assert by_id(token_files.digests(files), "start", "n_tokens", "ids_crc32") == want
    plainly, shuffled = (token_files.read(files, shuffle_seed=s).collect() for s in (None, 3))
    assert sorted((r.doc_id, bytes(r.ids)) for r in plainly) == sorted((r.doc_id, bytes(r.ids)) for r in shuffled)
    assert [r.place for r in shuffled] != [r.place for r in plainly]


def test_a_hot_id_is_spread_over_files(spark):
    rows = [(7, f"text {i}") for i in range(1000)] + [(7, "the same")] * 1000 + [(i, f"one {i}") for i in range(1000)]
    files = token_files.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), BPE, parts=8)
    sizes = [r["records"] for r in files.files.collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 2 * len(rows) / 8
    read = [(r["doc_id"], r["start"], r["n_tokens"]) for r in token_files.digests(files).orderBy("start").collect()]
    assert [d for d, _, _ in read] == sorted(d for d, _ in rows)
    assert all(b[1] == a[1] + a[2] for a, b in zip(read, read[1:]))


def test_token_file_damage_is_found(spark, docs):
    files = token_files.write(docs.limit(20), BPE, parts=1)
    path = files.files.first()["path"].removeprefix("file:")
    with open(path, "r+b") as f:
        f.seek(40)
        byte = f.read(1)
        f.seek(40)
        f.write(bytes([byte[0] ^ 1]))
    with pytest.raises(Exception, match="checksum"):
        token_files.read(files).collect()


def test_crc32c_known_value():
    assert int(token_files.crc32c([b"123456789"])[0]) == 0xE3069283
    assert int(token_files.crc32c([b""])[0]) == 0


def test_encoder_is_the_library():
    from palimpsest.llm.encoding import encoder

    e = encoder(BPE)
    for t in ["", "  a", " a ", "a\n b", "a  b", "l'été 12's", "\n", "<|endoftext|>x y", "日本 go", "a\x1cb c", "it's,ok.", "".join(map(chr, range(32, 0x250)))]:
        assert e.ids(t) == e.whole(t), t


def test_encoder_on_any_white_space():
    from palimpsest.llm.encoding import Encoder

    e, pick = Encoder(BPE), random.Random(5)
    for _ in range(3000):
        t = "".join(pick.choices("ab'1.é–  \n\t\r\x0b\xa0", k=pick.randrange(9)))
        assert e.ids(t) == e.whole(t), repr(t)


# 2: mixing


def test_mixing(docs, rows):
    got = by_id(mixing.mix(docs, ranges=16), "source", "size", "source_size", "target", "taken", "partial")
    sizes = Counter()
    for d, t, _, s, _ in rows:
        assert got[d][1] == len(brute.WORD.findall(t or ""))
        sizes[s] += got[d][1]
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, capped, left = {}, set(), sum(sizes.values())
    while True:
        rest = [s for s in names if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        target |= share
        if not over:
            break
        for s in over:
            target[s], left = 3 * sizes[s], left - 3 * sizes[s]
            capped.add(s)
    taken = Counter()
    for d, (s, size, source, goal, t, _) in got.items():
        assert source == sizes[s] and goal == pytest.approx(target[s]) and 0 <= t <= 3 * size
        taken[s] += t
    assert all(abs(taken[s] - target[s]) < 2 for s in names)
    again = by_id(mixing.mix(docs.repartition(3), ranges=16), "source", "size", "source_size", "target", "taken", "partial")
    assert again == got
    words = mixing.materialise(mixing.mix(docs, ranges=16)).groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n"))
    assert {r["doc_id"]: r["n"] for r in words.collect() if r["n"]} == {d: v[4] for d, v in got.items() if v[4]}


# 3: sharding


def test_sharding(spark, docs, rows, tmp_path):
    root = str(tmp_path / "map")
    out = sharding.shard(docs, "doc_id", "text", shards=4, slots=64, root=root).collect()
    places = {}
    for r in out:
        places.setdefault(r["shard"], []).append(r["slot"])
        assert r["size"] == len((r["text"] or "").encode()) + 8
    assert len(out) == len(rows) and all(sorted(p) == list(range(len(p))) for p in places.values())
    first = sharding.load_map(spark, root, 1)
    sharding.save_map(sharding.grown_map(first, 4), root)
    old, new = ({r["vslot"]: r["shard"] for r in sharding.load_map(spark, root, v).collect()} for v in (1, 2))
    assert all(new[s] in (old[s], 4) for s in old) and 4 in new.values()


def none_last(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("slots", [8, 4096])
def test_sharding_by_plain_rules(docs, odd, rows, slots):
    for table, own in ((docs, pairs(rows)), (odd, [(r["doc_id"], r["text"]) for r in odd.collect()])):
        got = [(r["doc_id"], r["text"], r["size"], r["shard"], r["slot"]) for r in sharding.shard(table.drop("size"), "doc_id", "text", shards=5, slots=slots).collect()]
        assert none_last(got) == none_last(brute.sharding(own, 5, slots))


def test_one_key_of_a_third_of_all_rows_is_spread(spark):
    hot = [(1 if i % 3 == 0 else i, f"text {i} " + "x" * (i % 50)) for i in range(3000)]
    loads = Counter()
    for r in sharding.shard(spark.createDataFrame(hot, "doc_id long, text string"), "doc_id", "text", shards=8).collect():
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) < 1.02 * min(loads.values())


def test_balanced_map_is_greedy(spark):
    sizes = spark.createDataFrame([(i, b, 1) for i, b in enumerate([9, 7, 6, 5, 4, 3, 2, 0])], "vslot int, bytes long, rows long")
    loads = Counter()
    for r in sharding.balanced_map(sizes, 3).collect():
        loads[r["shard"]] += r["bytes"]
    assert [loads[s] for s in range(3)] == [12, 13, 11]


# 4: quality


def test_quality_base(docs, rows):
    got = by_id(quality.judge(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == {d: brute.quality_base(t) for d, t in pairs(rows)}


def test_quality_verdict(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    judged = quality.judge(docs).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("not base_failed")
    good, bad = (judged.where(f"quality = {q}").agg(F.avg(F.col("kept").cast("double"))).first()[0] for q in (1, 0))
    assert good > 0.98 and bad < 0.05


def test_quality_of_a_minor_language(spark):
    import random

    rnd = random.Random(3)
    common = {"en": "the of and to in is that for it as was with be by on not he his but at".split(), "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch".split()}
    make = lambda k, n: " ".join(rnd.choice(common[k]) if rnd.random() < 0.6 else f"{rnd.choice('abdegklmnoprst')}{rnd.choice('aeiou')}{rnd.choice('lmnrst')}{rnd.choice('aeiou')}" for _ in range(n)) + "."
    rows = [(i, make("en", 200), "en") for i in range(90)] + [(100 + i, make("de", 200), ("de-DE", "DE", "de_at", "de")[i % 4]) for i in range(8)]
    rows += [(200, make("de", 200), None), (201, make("en", 200), "unknown"), (202, make("de", 200), "nds"), (203, "%9 #8 &7 " * 100 + make("en", 90), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = by_id(quality.judge(docs), "kept", "base_failed")
    assert [d for d, (k, _) in kept.items() if not k] == [203]


def test_distances_by_plain_rules(docs, rows):
    """References and distances against a plain count of the same corpus, at several limits of length."""
    import math
    import re

    for limits in (quality.Rules(), quality.Rules(min_words=20, common_words=7, min_words_compared=30, min_reference_words=200, max_char_distance=0.3, max_word_distance=0.5)):
        known = {}
        for k in ("en", "fr"):
            texts = [t.encode() for _, t, lang, *_ in rows if lang == k and len((t or "").split()) >= limits.min_words]
            texts = [t for t in texts if 100 * len(re.findall(rb"[#*$%&|<>]", t)) <= len(t)]
            words = Counter(w for t in texts for w in re.findall(rb"[a-z\x80-\xff]+", t.lower()))
            chars = Counter(int(quality.CLASSES[b]) for t in texts for b in t)
            top = [w for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0]))[: limits.common_words]]
            if sum(words.values()) >= limits.min_reference_words:
                known[k] = top, words, chars
        assert known

        def apart(p, q):
            js = 0.0
            for x in set(p) | set(q):
                a, b = p.get(x, 0) / sum(p.values()), q.get(x, 0) / sum(q.values())
                js += sum(y / 2 * math.log2(2 * y / (a + b)) for y in (a, b) if y)
            return js

        def distances(t, top, words, chars):
            own = Counter(int(quality.CLASSES[b]) for b in t)
            own.pop(0, None)
            by_char = math.sqrt(max(0.0, apart(own, {k: n for k, n in chars.items() if k}))) if own else 0.0
            found = re.findall(rb"[a-z\x80-\xff]+", t.lower())
            if len(found) < limits.min_words_compared:
                return by_char, None
            fold = lambda c: Counter({w: n for w, n in c.items() if w in top}) + Counter({None: sum(n for w, n in c.items() if w not in top)})
            return by_char, math.sqrt(max(0.0, apart(fold(Counter(found)), fold(words)) - len(top) / (8 * math.log(2) * len(found))))

        got = by_id(quality.judge(docs, rules=limits), "char_distance", "word_distance", "base_failed", "kept")
        for d, t, lang, *_ in rows:
            raw = (t or "").encode()
            ways = [distances(raw, *known[k]) for k in ([lang] if lang in known else [] if lang else known)]
            by_char, by_word = min(ways, key=lambda x: (x[0] if x[1] is None else x[1], x[0]), default=(0.0, None))
            assert got[d][0] == pytest.approx(by_char, abs=1e-6) and got[d][1] == (None if by_word is None else pytest.approx(by_word, abs=1e-6)), d
            assert got[d][3] == (not got[d][2] and by_char <= limits.max_char_distance and (by_word is None or by_word <= limits.max_word_distance))


def test_divergence():
    a, b = np.array([1.0, 0.0]), np.array([0.0, 3.0])
    assert quality.divergence(a, a) == 0 and quality.divergence(a, b) == pytest.approx(1) and quality.divergence(a, np.zeros(2)) == 0


# 5: token counts


def test_token_counts_after_edits(docs, rows):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(BPE)
    plain.encode_special_tokens = True
    count = lambda t: len(plain.encode(t, add_special_tokens=False).ids)
    edit = F.array(F.struct(F.lit(0).alias("start"), F.least(F.length(F.coalesce("text", F.lit(""))), F.lit(9)).alias("end"), F.lit("It's 12 ").alias("replacement")))
    built = token_counts.build(docs, BPE)
    out = token_counts.apply_edits(built.withColumn("edits", edit), BPE)
    before, after = by_id(built, "n_tokens"), by_id(out, "text", "n_tokens", "chars_encoded")
    for d, t in pairs(rows):
        new = "It's 12 " + (t or "")[9:]
        assert before[d] == (count(t or ""),) and after[d][:2] == (new, count(new)) and after[d][2] <= len(new)
    rebuilt = by_id(token_counts.build(out.select("doc_id", "text"), BPE), "n_tokens")
    assert all(rebuilt[d][0] == after[d][1] for d in rebuilt)


def test_leaves_split_so_that_edits_stay_local():
    counter = token_counts.Counter(BPE)
    tree = counter.build("")
    text, _ = counter.edit("", tree, [(0, 0, "some words and 12 more, " * 4000)])
    assert tree.leaves > 100 and (tree.tokens, tree.chars) == (counter.build(text).tokens, len(text))
    new, encoded = counter.edit(text, tree, [(50_000, 50_001, "X")])
    assert encoded < 2000 and tree.tokens == counter.build(new).tokens


def test_counts_of_characters_that_versions_differ_on():
    from tokenizers import Tokenizer

    counter, plain = token_counts.Counter(BPE), Tokenizer.from_file(BPE)
    for low in range(0x0250, 0x20000, 97):
        text = f"a {chr(low) if not 0xD800 <= low < 0xE000 else 'x'}b1{chr(low ^ 1) if not 0xD800 <= low ^ 1 < 0xE000 else 'y'} c's \u30a0 \u200b d"
        tree = counter.build(text)
        assert tree.tokens == len(plain.encode(text, add_special_tokens=False).ids)
        new, _ = counter.edit(text, tree, [(3, 5, "zz 9")])
        assert tree.tokens == len(plain.encode(new, add_special_tokens=False).ids)


def test_masks():
    import random

    rnd = random.Random(6)
    parts = {"jo.ann@mail.example.org": "<EMAIL>", "https://a.b/c?d=e@f": "<URL>", "0123456789abcdefABCDEF0123456789": "<SECRET>", "1234567": "<NUMBER>", "123456": "123456", "word": "word", "@": "@", "x@y": "x@y", "http:/": "http:/", "deadbeef": "deadbeef"}
    for _ in range(200):
        own = [rnd.choice(list(parts)) for _ in range(rnd.randint(0, 12))]
        text, want = " ".join(own), " ".join(parts[p] for p in own)
        for start, end, new in reversed(token_counts.masks(text)):
            text = text[:start] + new + text[end:]
        assert text == want


def test_overlapping_edits_are_refused():
    counter = token_counts.Counter(BPE)
    with pytest.raises(ValueError):
        counter.edit("abc def", counter.build("abc def"), [(0, 3, "x"), (2, 4, "y")])


def test_random_edits():
    import random

    rnd, counter = random.Random(2), token_counts.Counter(BPE)
    parts = ["a", "b ", "  ", "\n", "'s", "12", " x", ".", "é", "Hello", "\t ", "'", "re"]
    for _ in range(300):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 900)))
        cuts = sorted(rnd.sample(range(len(text) + 1), min(len(text) + 1, 2 * rnd.randint(0, 4))))
        edits = [(a, b, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 5)))) for a, b in zip(cuts[::2], cuts[1::2])]
        tree = counter.build(text)
        new, _ = counter.edit(text, tree, edits)
        assert (tree.tokens, tree.chars) == (counter.build(new).tokens, len(new))


# 6: substring dedup


@pytest.mark.parametrize("width", [50, 8])
def test_substring_dedup(docs, rows, width):
    got = by_id(substring_dedup.remove_repeats(docs, width=width), "n_words", "n_removed", "kept_sha256")
    assert got == brute.substring(pairs(rows), width)


def thue_morse(n, swap=False):
    return "".join("ba" if bin(i).count("1") % 2 ^ swap else "ab" for i in range(n // 2))


def test_words_that_collide_in_polynomials_differ(spark):
    """Thue-Morse words have equal polynomials in every odd base modulo a power of two."""
    one, two = thue_morse(4096), thue_morse(4096, True)
    around = [f"w{i}" for i in range(80)]
    texts = [" ".join([*around[:40], x, *around[40:]]) for x in (one, two)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert by_id(substring_dedup.remove_repeats(docs), "n_words", "n_removed", "kept_sha256") == brute.substring(list(enumerate(texts)), 50)
    scored = spark.createDataFrame([(i, x) for i, x in enumerate([one] * 9 + [two] * 3)], "doc_id long, text string")
    want, _ = brute.katz([(i, x) for i, x in enumerate([one] * 9 + [two] * 3)])
    assert {d: v[:4] for d, v in by_id(katz.score(scored), "held_out", "n_tokens", "n_known", "train_tokens").items()} == {d: w[:4] for d, w in want.items()}


def test_rows_of_one_id_lose_only_what_is_in_their_own_text(spark):
    passage, other = " ".join(f"p{i}" for i in range(60)), " ".join(f"o{i}" for i in range(100))
    docs = spark.createDataFrame([(1, passage), (5, passage + " and more"), (5, other), (5, None)], "doc_id long, text string")
    out = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(docs).collect())
    assert out == [(1, 60, 0), (5, 0, 0), (5, 62, 60), (5, 100, 0)]


# 7: Katz


def test_katz(docs, rows):
    want, sums = brute.katz(pairs(rows))
    got = by_id(katz.score(docs), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    assert got.keys() == want.keys() and all(s == pytest.approx(1) for s in sums.values())
    for d, w in want.items():
        assert got[d][:4] == w[:4] and got[d][4:] == pytest.approx(w[4:]), d


def test_katz_in_small_chunks(docs, rows, monkeypatch):
    monkeypatch.setattr(katz, "CHUNK", 500)
    want, _ = brute.katz(pairs(rows))
    got = by_id(katz.score(docs), "score")
    assert all(got[d][0] == pytest.approx(w[5]) for d, w in want.items())


def test_katz_holds_little_of_a_bucket():
    import tracemalloc

    rnd = np.random.default_rng(3)
    kinds = np.unique(rnd.integers(0, (1 << 64) - 1, 200_000, dtype=np.uint64, endpoint=True))
    sent = [(np.sort(rnd.choice(kinds, 30_000, replace=False)), rnd.integers(0, 9, 30_000).astype(np.uint8)) for _ in range(30)]
    table = pa.table({"bucket": pa.array([3] * 30, pa.int64()), "chunk": pa.array(range(30), pa.int64()), "payload": pa.array([katz.pack(*x) for x in sent], pa.binary())})
    tracemalloc.start()
    back = katz._count_bigrams(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 35 * 30 * 30_000, "bytes an entry"
    got = {c: katz.unpack(p) for c, p in zip(back.column("chunk").to_pylist(), back.column("payload").to_pylist()) if c != katz.WHOLE}
    total, first = Counter(), {}
    for i, (keys, counts) in enumerate(sent):
        for k, c in zip(keys.tolist(), counts.tolist()):
            total[k] += c
            first.setdefault(k, i)
    for i, (keys, _) in enumerate(sent):
        assert got[i][0].tolist() == [total[k] for k in keys.tolist()]
        assert got[i][1].tolist() == [total[k] > 0 and first[k] == i for k in keys.tolist()]


def test_katz_in_pieces(spark):
    """One bucket of words and one of bigrams, and chunks, of several pieces each."""
    rnd = random.Random(5)
    word = lambda: f"w{min(rnd.randrange(600_000), rnd.randrange(1, 600_000) if rnd.random() < 0.5 else 50):x}"
    rows = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([700] * 400 + [200_000] + [1] * 50)]
    width = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        got = by_id(katz.score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    want, _ = brute.katz(rows)
    assert len({w for _, t in rows for w in t.split()}) > katz.PIECE
    for d, w in want.items():
        assert got[d][:4] == w[:4] and got[d][4:] == pytest.approx(w[4:]), d


def test_katz_deals_buckets_evenly(spark):
    messages = spark.createDataFrame([(b, c, b"x") for b in range(51) for c in range(3)], katz.MESSAGE_SQL)
    dealt = katz.dealt(messages.repartition(7), 51)
    places = dealt.groupBy(F.spark_partition_id()).agg(F.count_distinct("bucket"), F.count("*")).collect()
    assert len(places) == 51 and all(p[1:] == (1, 3) for p in places)


# 8: line dedup


@pytest.mark.parametrize("least", [2, 6, 30])
def test_line_dedup(docs, rows, least):
    out = line_dedup.dedup_lines(docs, min_docs=least).withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    assert by_id(out, "n_lines", "n_dropped", "sha") == brute.lines(pairs(rows), least)


# 9: decontamination


ITEM = "A farmer named Tom sells 12 apples and 30 pears to Anna for 5 dollars each week of the long dry summer"


def test_decontamination(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, "What is the capital of France today"), (4, "few words")], "item_id long, text string")
    other = ITEM.replace("Tom", "Ivan").replace("12", "7").replace("30", "44").replace("Anna", "Mary").replace("5", "9")
    mixed = "Then a farmer named Tom sells 5 apples. " * 3
    twice = "Lena gave 3 coins to Lena while Omar watched the three of them count every last coin slowly"
    rows = [(1, f"x y {ITEM} z"), (2, f"q {other}."), (3, mixed), (4, None), (5, ""), (6, "so WHAT is the Capital of france today ok"), (7, "few words"), (8, ITEM.upper() + " " + "w " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.literal) for r in decontamination.find_leaks(docs, bench).collect()}
    assert got == {(1, 1, True), (2, 1, False), (6, 3, True), (8, 1, True)}
    assert sorted(r.doc_id for r in decontamination.decontaminate(docs, bench).collect()) == [3, 4, 5, 7]
    assert decontamination.find_leaks(docs, bench, rules=decontamination.Rules(block=30)).count() == 4
    item = spark.createDataFrame([(9, twice)], "item_id long, text string")
    swapped = twice.replace("Lena gave", "Rosa gave")
    assert decontamination.find_leaks(spark.createDataFrame([(1, swapped)], "doc_id long, text string"), item, rules=decontamination.Rules(width=19)).count() == 0


DENSE = {
    1: ("Anna walks 3 km in 2 hours and Ben walks 5 km in 4 hours", "Mia walks 7 km in 6 hours and Leo walks 9 km in 8 hours"),
    2: ("Tom has 5 apples and buys 3 more", "Eva has 8 apples and buys 2 more"),
    3: ("Tom buys 3 and sells 4", "Eva buys 6 and sells 9"),
}


def test_items_dense_in_placeholders_leak(spark):
    bench = spark.createDataFrame([(k, item) for k, (item, _) in DENSE.items()], "item_id long, text string")
    rows = [(k, f"so it was that {leak} as they say") for k, (_, leak) in DENSE.items()]
    rows.append((4, "so Mia walks 7 km in 6 hours and Mia walks 9 km in 8 hours"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.literal) for r in decontamination.find_leaks(docs, bench).collect()}
    assert got == {(1, 1, False), (2, 2, False), (3, 3, False)}
    assert [r.doc_id for r in decontamination.decontaminate(docs, bench).collect()] == [4]


def questions():
    """Items, and documents that hold them whole, in part, with other names and numbers, inconsistently, or not."""
    import random

    rnd = random.Random(8)
    names, verbs = "Anna Ben Carla Dora Emil Fritz".split(), "pays gives sells lends".split()
    ask = lambda: "If {0} {5} {1} {2} dollars and {3} cents while {4} {5} {0} 3 euros then who has more at noon".format(*rnd.sample(names, 2), rnd.randint(2, 99), rnd.randint(2, 99), rnd.choice(names), rnd.choice(verbs))
    items = [(i, ask()) for i in range(12)] + [(20, "Tom has 5 apples and buys 3 more"), (21, "What is the capital of France"), (22, "too short an item"), (23, None), (24, "")]
    filler = lambda: " ".join(rnd.choice("so it was that some went on by a road with 7 or Max km".split()) for _ in range(rnd.randint(0, 25)))
    texts = [f"{filler()} {ask()}, {filler()} {rnd.choice(items[:14])[1]} {filler()}" for _ in range(60)]
    texts += [" ".join(t.split()[: rnd.randint(1, 40)]) for t in texts] + ["Ann has 9 apples and buys 2 more", "what is the capital of Spain", "What is the capital of Spain", "too short an item", None, "", "4 km " * 40]
    return list(enumerate(texts)), items


def test_leaks_by_comparing_all_windows(spark):
    rows, items = questions()
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute.leaks(rows, items, set(decontamination.UNITS), set(decontamination.NUMBER_WORDS))
    got = sorted(tuple(r) for r in decontamination.find_leaks(docs, bench).collect())
    assert got == want and sum(not x[-1] for x in want) > 50 and sum(x[-1] for x in want) > 50
    blocks = decontamination.find_leaks(docs, bench, rules=decontamination.Rules(block=60))
    assert sorted(tuple(r) for r in blocks.collect()) == want
    kept = decontamination.decontaminate(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({d for d, _ in rows} - {x[0] for x in want})


def test_leaks_of_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "one two three four five six"), (1, "one two three four five six"), (None, "same words here")], "item_id long, text string")
    leak = odd.withColumn("text", F.when(F.col("doc_id") == 5, F.concat("text", F.lit(" four five six"))).otherwise(F.col("text")))
    assert Counter(r["doc_id"] for r in decontamination.find_leaks(leak, bench).collect()) == Counter({5: 4})
    kept = decontamination.decontaminate(leak, bench)
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({None: 2, 5: 1, 7: 1}) and kept.columns == odd.columns


# 10: SimHash


@pytest.mark.parametrize("dense", [64, 2])
def test_simhash(docs, rows, dense):
    found = simhash.near_duplicates(docs, dense=dense)
    got = {r["doc_id"]: (f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in found.collect()}
    assert got == brute.simhash(pairs(rows))


def copies():
    """A chain of near copies, each a few words from the one before, a crowd around one text, and unlike texts."""
    import random

    rnd = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    new = lambda n: [rnd.choice(words) for _ in range(n)]
    rows, chain, centre = [], new(150), new(200)
    for _ in range(12):
        chain[rnd.randrange(150)] = rnd.choice(words)
        rows.append(" ".join(chain))
    for k in range(150):
        own = list(centre)
        for _ in range(k % 7):
            own[rnd.randrange(200)] = rnd.choice(words)
        rows.append(" ".join(own))
    rows += [" ".join(new(rnd.randint(1, 90))) for _ in range(60)] + ["", "A b", "a B", "a b c"]
    rnd.shuffle(rows)
    return list(enumerate(rows, 3))


@pytest.mark.parametrize("dense", [64, 2])
def test_similar(spark, dense):
    rows = copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.jaccard(rows)
    assert {r["doc_id"]: r["component_id"] for r in similarity.similar(docs, dense=dense).collect()} == want
    kept = similarity.drop_near_duplicates(docs, dense=dense)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values())) and kept.columns == ["doc_id", "text"]


def test_similar_on_documents(docs, rows):
    assert {r["doc_id"]: r["component_id"] for r in similarity.similar(docs).collect()} == brute.jaccard(pairs(rows))


def block_edits():
    """Copies that lack or add one block, at similarities of 0.8 to 0.95."""
    import random

    rnd = random.Random(9)
    new = lambda n: [f"v{rnd.randrange(5000)}" for _ in range(n)]
    rows = []
    for n in (30, 60, 200):
        for share in (0.05, 0.1, 0.15, 0.19):
            for _ in range(12):
                own, cut = new(n), int(n * share)
                rows += [own, rnd.choice((own[cut:], own[: n - cut], own + new(cut), new(cut) + own))]
    rows = [" ".join(r) for r in rows]
    rnd.shuffle(rows)
    return list(enumerate(rows, 1))


@pytest.mark.parametrize("dense", [64, 2])
def test_similar_by_plain_jaccard(spark, dense):
    rows = block_edits()
    want = brute.jaccard(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in similarity.similar(docs, dense=dense).collect()} == want


def leaders():
    """Different texts in which one pair of words outweighs all others, so their fingerprints are equal; and a near copy of one."""
    rows = [" ".join([*(f"t{k}x{i}" for i in range(150)), *[". . . . . ."] * 12]) for k in range(8)]
    return list(enumerate([*rows, rows[5] + " end"], 1))


def test_equal_fingerprints_are_held_shingle_by_shingle(spark):
    rows = leaders()
    prints = brute.simhash(rows, 2, -1)
    assert len({f for f, _ in prints.values()}) < 8
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in similarity.similar(docs).collect()} == brute.jaccard(rows) == {**{k: k for k in range(1, 9)}, 9: 6}
    assert similarity.drop_near_duplicates(docs).count() == 8


def test_similar_rows_without_key(spark):
    base = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(None, base), (4, base + " end"), (None, "other words here")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in similarity.similar(docs).collect())
    assert got == [(0, 0), (0, 4), (4, 4)]


def test_thresholds_cover_the_distance():
    rnd = np.random.default_rng(5)
    both = np.full((64, 64), 250.0)
    both[np.diag_indices(64)] = rnd.integers(100, 900, 64)
    for n in (10, 1000, 10**9):
        parts = simhash.plan(n, both * n / 1000, 2)
        assert sum(t + 1 for _, t in parts) == 3 and sum(len(p) for p, _ in parts) <= 64


# odd cases


RUNS = {
    "1": lambda d: token_files.digests(token_files.write(d, BPE, parts=2)),
    "2": mixing.mix,
    "2m": lambda d: mixing.materialise(mixing.mix(d)),
    "3": lambda d: sharding.shard(d, "doc_id", "text", shards=3, slots=16),
    "4": quality.judge,
    "5": lambda d: token_counts.apply_edits(token_counts.build(d, BPE), BPE, edits=token_counts.masks),
    "6": substring_dedup.remove_repeats,
    "7": katz.score,
    "8": line_dedup.dedup_lines,
    "10": simhash.near_duplicates,
    "10s": similarity.similar,
}


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(nothing, name):
    assert RUNS[name](nothing).collect() == []


@pytest.mark.parametrize("name", [n for n in RUNS if n != "2m"])
def test_null_and_repeated_rows(odd, name):
    out = RUNS[name](odd).collect()
    assert Counter(r["doc_id"] for r in out) == Counter({None: 2, 5: 3, 7: 1})
    assert len(out[0]) == len(set(out[0].asDict()))


def test_nothing_leaks_from_nothing(spark, nothing, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_leaks(nothing, bench).collect() == [] and decontamination.find_leaks(docs, bench).collect() == []
    assert decontamination.decontaminate(docs, bench).count() == docs.count()

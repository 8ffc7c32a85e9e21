"""Operator 1: token ids as length-delimited binary records.

Each partition of documents, ranged by doc_id, becomes one data file and one index file.

Data file: records one after the other, each framed as
  length (unsigned 64-bit) | masked CRC-32C of the length's bytes | payload | masked CRC-32C of the payload,
all little-endian. A checksum is masked as ((c >> 15) | (c << 17)) + 0xA282EAD8 modulo 2**32. The payload is
  flags (1 byte; bit 0: there is a doc_id) | doc_id (signed 64-bit) | ids (unsigned 16-bit if the vocabulary allows, else 32-bit).
Index file: for each record its doc_id, its offset in the data file and its number of ids, three little-endian signed
64-bit integers, so a reader can take records in any shuffled order by seeking.

Files appear under their names only when complete; a task that runs again writes the same bytes again.

Rows of one doc_id are ranged on by a hash of their texts and, equal in both, by their places in the table, so an id that
holds a third of all rows is spread over as many files as its share asks for.

Defined cases: a null or empty text has only the end id; rows with no doc_id come first; rows of equal doc_id are ordered
by the XXH64 of their texts; very long texts are encoded whole; an empty table gives no files and an empty result; extra
columns, of whatever names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import atomic_output, filesystem, scratch, shuffle_width
from palimpsest.llm.encoding import encoder

HEAD = 9
MASK = 0xA282EAD8
#: Records are encoded and checked in groups of about so many bytes.
GROUP = 4 << 20


def _table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0x82F63B78), c >> 1)
    return c


_BYTE = _table()
_ROW = 64


def _ahead(crc: np.ndarray, n: int) -> np.ndarray:
    """The raw CRC state after n more zero bytes."""
    for _ in range(n):
        crc = _BYTE[crc & 0xFF] ^ (crc >> 8)
    return crc


def _shift_tables(n: int) -> np.ndarray:
    """Four tables of 256 entries that move a state over n zero bytes at once."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    if n <= _ROW:
        moved = _ahead(bits, n)
    else:
        half = _shift_tables(n // 2)
        moved = _shift(_shift(bits, half), half)
    values = np.arange(256)
    tables = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for b in range(8):
            tables[k] ^= np.where(values >> b & 1, moved[8 * k + b], 0).astype(np.uint32)
    return tables


def _shift(crc: np.ndarray, tables: np.ndarray) -> np.ndarray:
    return tables[0][crc & 0xFF] ^ tables[1][crc >> 8 & 0xFF] ^ tables[2][crc >> 16 & 0xFF] ^ tables[3][crc >> 24]


_POSITION = np.stack([_ahead(_BYTE, _ROW - 1 - j) for j in range(_ROW)])
_SHIFTS: dict[int, np.ndarray] = {}


def crc32c(records: list[bytes]) -> np.ndarray:
    """CRC-32C of each record, for many records at once.

    The CRC is linear: rows of 64 bytes are looked up by position and combined in pairs, doubling the distance at each
    level. Records are padded in front, which changes nothing; the initial all-ones state is moved over each length.
    """
    lengths = np.array([len(r) for r in records], np.int64)
    out = np.zeros(len(records), np.uint32)
    rows = np.maximum(1, -(-lengths // _ROW))
    levels = np.ceil(np.log2(rows)).astype(int)
    for level in np.unique(levels):
        own = np.flatnonzero(levels == level)
        width = _ROW << int(level)
        for part in np.array_split(own, max(1, len(own) * width // GROUP)):
            block = np.frombuffer(b"".join(records[i].rjust(width, b"\0") for i in part), np.uint8).reshape(-1, _ROW)
            crc = np.zeros(len(block), np.uint32)
            for j in range(_ROW):
                crc ^= _POSITION[j][block[:, j]]
            span = _ROW
            while span < width:
                if span not in _SHIFTS:
                    _SHIFTS[span] = _shift_tables(span)
                crc = _shift(crc[0::2], _SHIFTS[span]) ^ crc[1::2]
                span *= 2
            out[part] = crc
    state = np.full(len(records), 0xFFFFFFFF, np.uint32)
    rest = lengths.copy()
    for bit in range(int(rest.max(initial=0)).bit_length()):
        n = 1 << bit
        if n not in _SHIFTS:
            _SHIFTS[n] = _shift_tables(n)
        state = np.where(rest >> bit & 1, _shift(state, _SHIFTS[n]), state)
    return out ^ state ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK)


@dataclass(frozen=True)
class TokenFiles:
    """What was written: the folder, bytes of an id, and a row (part, path, records, ids, bytes) for each file."""

    root: str
    width: int
    files: DataFrame


def _ranged(df: DataFrame, parts: int) -> DataFrame:
    """Rows (key, text) in ascending order of key, hash of text and place, as ranges of about equal numbers of rows."""
    order = [F.col("__key").asc_nulls_first(), F.col("__hash"), F.col("__row")]
    placed = df.withColumns({"__hash": F.xxhash64("__text"), "__row": F.monotonically_increasing_id()})
    return placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("__key", "__text")


def write(df: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text", end_id: int | None = 0, root: str | None = None, parts: int | None = None) -> TokenFiles:
    """Encodes every text whole and writes the ids in ascending key order. Returns once the files are there."""
    from pyspark import TaskContext

    spark = df.sparkSession
    root = root or scratch(spark, "tokens")
    from tokenizers import Tokenizer

    width = 2 if Tokenizer.from_file(vocabulary).get_vocab_size() <= 1 << 16 else 4
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(vocabulary).ids, TaskContext.get().partitionId()
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        name, at, records, ids = f"{root}/part-{part:06d}.rec", 0, 0, 0
        with atomic_output(name) as data, atomic_output(f"{name}.idx") as index:

            def flush(keys: list, payloads: list[bytes]) -> None:
                nonlocal at, records, ids
                heads = [len(p).to_bytes(8, "little") for p in payloads]
                marks = masked(crc32c(heads)).astype("<u4"), masked(crc32c(payloads)).astype("<u4")
                sizes = np.array([len(p) for p in payloads], np.int64)
                offsets = at + np.concatenate([[0], np.cumsum(sizes + 16)])
                counts = (sizes - HEAD) // width
                entries = np.stack([np.array([k or 0 for k in keys], np.int64), offsets[:-1], counts], 1)
                data.write(b"".join(x for h, p, a, b in zip(heads, payloads, marks[0], marks[1]) for x in (h, a.tobytes(), p, b.tobytes())))
                index.write(entries.astype("<i8").tobytes())
                at, records, ids = int(offsets[-1]), records + len(keys), ids + int(counts.sum())

            keys, payloads, held = [], [], 0
            for batch in (b for source in ([first], batches) for b in source):
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                    value = np.frombuffer(encode(t.as_py() or "") + end, "<u4")
                    body = bytes([k is not None]) + (k or 0).to_bytes(8, "little", signed=True) + value.astype(f"<u{width}").tobytes()
                    keys.append(k)
                    payloads.append(body)
                    held += len(body)
                    if held >= GROUP:
                        flush(keys, payloads)
                        keys, payloads, held = [], [], 0
            if keys:
                flush(keys, payloads)
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [name], "records": [records], "ids": [ids], "bytes": [at]})

    rows = df.select(F.col(key).cast("long").alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = "part long, path string, records long, ids long, bytes long"
    written = _ranged(rows, parts or shuffle_width(spark)).mapInArrow(put, schema)
    # One small row for each file, a manifest.
    manifest = spark.createDataFrame(written.collect(), schema).coalesce(1)
    return TokenFiles(root, width, manifest)


def _records(files: TokenFiles, shuffle_seed: int | None, group: int, row: Callable[[list[bytes]], list[pa.Array]], columns: str, key: str) -> DataFrame:
    """A row for each record: part, place, key and what row() makes of the ids (little-endian unsigned 32-bit)."""
    width = files.width
    names = ["part", "place", key, *(c.split()[0] for c in columns.split(", "))]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, name in zip(batch.column("part").to_pylist(), batch.column("path").to_pylist()):
                system, path = filesystem(name)
                with system.open_input_stream(f"{path}.idx") as f:
                    index = np.frombuffer(f.read(), "<i8").reshape(-1, 3)
                order = np.arange(len(index)) if shuffle_seed is None else np.random.default_rng([shuffle_seed, part]).permutation(len(index))
                sizes = 16 + HEAD + index[:, 2] * width
                steps = np.cumsum(sizes[order]) // group
                with system.open_input_file(path) as f:
                    for own in np.split(order, np.flatnonzero(np.diff(steps)) + 1):
                        if shuffle_seed is None:
                            low = int(index[own[0], 1])
                            block = f.read_at(int(index[own[-1], 1] + sizes[own[-1]]) - low, low)
                            frames = [block[at : at + n] for at, n in zip((index[own, 1] - low).tolist(), sizes[own].tolist())]
                        else:
                            frames = [f.read_at(int(sizes[i]), int(index[i, 1])) for i in own]
                        keys, ids = _checked(part, frames, width)
                        yield pa.RecordBatch.from_arrays([pa.array([part] * len(keys), pa.int64()), pa.array(own, pa.int64()), pa.array(keys, pa.int64()), *row(ids)], names=names)

    one_each = files.files.repartition(max(1, min(shuffle_width(files.files.sparkSession), 10_000)), "part")
    return one_each.select("part", "path").mapInArrow(take, f"part long, place long, `{key}` long, {columns}")


def read(files: TokenFiles, *, key: str = "doc_id", shuffle_seed: int | None = None, group: int = GROUP) -> DataFrame:
    """(part, place, key, ids as little-endian unsigned 32-bit bytes) of every record, checksums verified.

    With a seed, each file's records come in a random order by seeking through its index.
    """
    return _records(files, shuffle_seed, group, lambda ids: [pa.array(ids, pa.binary())], "ids binary", key)


def _checked(part: int, frames: list[bytes], width: int) -> tuple[list[int | None], list[bytes]]:
    heads, bodies = [x[:8] for x in frames], [x[12:-4] for x in frames]
    for what, told in ((heads, [x[8:12] for x in frames]), (bodies, [x[-4:] for x in frames])):
        if not np.array_equal(masked(crc32c(what)), np.frombuffer(b"".join(told), "<u4")):
            raise ValueError(f"part {part}: a record's checksum does not match")
    if any(int.from_bytes(h, "little") != len(b) for h, b in zip(heads, bodies)):
        raise ValueError(f"part {part}: a record's length does not match")
    keys = [int.from_bytes(b[1:HEAD], "little", signed=True) if b[0] & 1 else None for b in bodies]
    return keys, [np.frombuffer(b, f"<u{width}", offset=HEAD).astype("<u4").tobytes() for b in bodies]


def digests(files: TokenFiles, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens, ids_crc32 of every record, as read back."""
    sums = lambda ids: [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
    rows = _records(files, None, GROUP, sums, "n_tokens long, ids_crc32 long", key)
    # A file's tokens are known from the manifest; within a file, one file's records are one task's work already.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.files.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("__first"))
    within = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__before", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return rows.join(starts, "part").select(key, (F.col("__first") + F.col("__before")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(write(docs, public_tokenizers.path("byte_bpe_50k.json")))

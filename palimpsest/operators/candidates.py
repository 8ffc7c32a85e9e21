"""The candidate texts of extracted documents, built by Python workers from Arrow columns.

A candidate comes with its normalized text and with what one pass of RE2 says of each rule. On ASCII texts RE2 decides as the rules
do; on others it finds all that they find and more (its word boundaries are ASCII, and each pattern starts and ends in ASCII word
characters), so the rules are tried there only where it found something.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from palimpsest.functions import rules as R
from palimpsest.functions.text import is_plain_value, normalized_value

#: The rules in the order of their bits.
SIGNALS = list(R.WEIGHTS)[:-1]
WEIGHTS = np.array([R.WEIGHTS[k] for k in SIGNALS])
PATTERNS = {"direct_phrase": R.DIRECT, "control_bucket": R.CONTROL, "role_bucket": R.ROLE, "review_bucket": R.REVIEW}
#: Documents and characters that are worked on at once.
DOCUMENTS, CHARS = 256, 1_000_000

_HIDDEN, _TURNED = re.compile(f"[{R.ZERO_WIDTH}]"), re.compile(f"[{R.BIDI}]")
_LOW, _HIGH = string.ascii_lowercase, string.ascii_uppercase
_ROT13 = bytes.maketrans((_HIGH + _LOW).encode(), (_HIGH[13:] + _HIGH[:13] + _LOW[13:] + _LOW[:13]).encode())


def loose(pattern: str) -> str:
    """What finds a pattern in any case, between any characters and over any white space."""
    return "(?is)" + pattern.replace(r"\b", "").replace(r"\s", r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]")


def collapsed(text: str | None) -> str:
    return " ".join(text.split()) if text else ""


def rot13(text: str) -> str:
    return text.encode().translate(_ROT13).decode()


def _found(texts: list[str], pattern: str) -> np.ndarray:
    return pc.match_substring_regex(pa.array(texts, pa.large_string()), pattern).to_numpy(zero_copy_only=False).astype(bool)


def judged(texts: list[str], norms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: which rules may hold, a column for each; and whether these do hold."""
    may = np.zeros((len(texts), len(SIGNALS)), bool)
    sure = np.array([t.isascii() for t in texts], bool)
    for k, pattern in PATTERNS.items():
        may[:, SIGNALS.index(k)] = _found(norms, pattern)
    others = [i for i in np.flatnonzero(~sure) if not is_plain_value(texts[i])]
    if others:
        may[others, 0] |= _found([texts[i] for i in others], loose(R.DIRECT))
        may[others, SIGNALS.index("zero_width_present")] = [bool(_HIDDEN.search(texts[i])) for i in others]
        may[others, SIGNALS.index("bidi_controls_present")] = [bool(_TURNED.search(texts[i])) for i in others]
    return may, sure


def _entries(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """For each entry of a column of lists its row, and the entries."""
    return pc.list_parent_indices(column).to_numpy(zero_copy_only=False), pc.list_flatten(column)


def _lists(values: pa.Array, *names: str) -> list[list]:
    return [pc.struct_field(values, [n]).to_pylist() for n in names]


def _either(*values: str | None) -> str:
    return next((v for v in values if v), "")


def _blob(*parts: str) -> str:
    return " | ".join(parts).strip(" |")


def _number(v: float | None) -> tuple[int, float]:
    """Null first, NaN last, as Spark orders them."""
    return (0, 0.0) if v is None else (2, 0.0) if v != v else (1, v)


class Rows:
    """Candidates as they are found."""

    def __init__(self) -> None:
        self.rows: list[dict] = []

    def add(self, **values) -> None:
        self.rows.append(values)

    def columns(self) -> dict[str, list]:
        return {k: [r.get(k) for r in self.rows] for k in dict.fromkeys(k for r in self.rows for k in r)}


def _pages(rows: Rows, page_of: list, docs: list, number: list, spans: list[list[tuple]]) -> None:
    for p, own in enumerate(spans):
        text = " ".join(s[-1] for s in sorted(own))[: R.PAGE_CHARS]
        if not text:
            continue
        plain, n = is_plain_value(text), normalized_value(text)
        turned, back = rot13(text), text[::-1]
        kinds = [("page_text", "page_concatenation", text, n), ("page_text_reversed", "reversed_text", back, n[::-1] if plain else normalized_value(back)), ("page_text_rot13", "rot13_text", turned, rot13(n) if plain else normalized_value(turned))]
        for i, (source, reason, value, low) in enumerate(kinds):
            rows.add(doc=docs[p], emit=[3, number[p], 2, i, 0], origin="page", source=source, page=number[p], text=value, t_norm=low, base_reason=reason, decode_text=text if i == 0 else None, decode_tag=source if i == 0 else None)


def _small(rows: Rows, batch: pa.RecordBatch, rules: R.Rules, on: set[str], decode: bool, docs: list, number: list, pages: pa.Array) -> None:
    """Metadata, embedded files, annotations and form fields."""
    if "metadata" in on:
        xmp = batch["xmp"].to_pylist()
        for d, (entries, packet) in enumerate(zip(batch["metadata"].to_pylist(), xmp)):
            for i, (key, value) in enumerate(entries or ()):
                if value := collapsed(value):
                    rows.add(doc=d, emit=[0, 0, 0, i, 0], origin="metadata", source="metadata", page=0, text=f"{key}: {value}", base_reason="metadata_field", decode_text=value, decode_tag="metadata", meta_field=key)
            if packet := collapsed(packet):
                rows.add(doc=d, emit=[0, 0, 1, 0, 0], origin="metadata", source="xmp", page=0, text=packet, base_reason="xmp_metadata", decode_text=packet if decode else None, decode_tag="xmp", meta_field="xmp")
    if "embedded" in on:
        for d, files in enumerate(batch["embedded"].to_pylist()):
            for i, e in enumerate(files or ()):
                e = e or {}
                name = collapsed(_either(e.get("filename"), e.get("name"), f"index_{i}"))
                desc = collapsed(_either(e.get("desc"), e.get("description")))
                rows.add(doc=d, emit=[1, 0, 0, i, 0], origin="embedded", source="embedded_file", page=0, text=_blob(name, desc) or name, base_reason="embedded_file_present", decode_text=desc, decode_tag="embedded_file_desc", embedded_filename=name)
    if "annotations" in on:
        of, notes = _entries(pc.struct_field(pages, ["annots"]))
        for p, seq, subtype, title, subject, content, contents in zip(of, *_lists(notes, "seq", "subtype", "title", "subject", "content", "contents")):
            subtype, title, subject = map(collapsed, (subtype, title, subject))
            if text := _blob(subtype, title, subject, collapsed(_either(content, contents))):
                rows.add(doc=docs[p], emit=[3, number[p], 0, seq, 0], origin="page", source="annotation", page=number[p], text=text, base_reason="annotation_text", decode_text=text if decode else None, decode_tag="annotation", annot_subtype=subtype, annot_title=title, annot_subject=subject)
    if "widgets" in on:
        of, fields = _entries(pc.struct_field(pages, ["widgets"]))
        for p, seq, name, kind, value in zip(of, *_lists(fields, "seq", "field_name", "field_type", "field_value")):
            name, kind, value = map(collapsed, (name, kind, value))
            if text := _blob(name, kind, value):
                rows.add(doc=docs[p], emit=[3, number[p], 1, seq, 0], origin="page", source="widget", page=number[p], text=text, base_reason="widget_text", decode_text=text if decode else None, decode_tag="widget", widget_name=name, widget_type=kind)


def builder(rules: R.Rules, own: list[str], schema: pa.Schema, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function for mapInArrow. Spans and embedded files always come; others only where they may score `least`, match the
    single pattern, or hold what may be a token to decode. least 0: all come."""
    on, phrases = set(rules.channels), rules.scoring == "phrases"
    decode = "decode" in on

    def judge(columns: dict, n: int) -> dict:
        texts = columns["text"]
        if phrases:
            read = [d if s == "metadata" else t for t, s, d in zip(texts, columns["source"], columns.get("decode_text") or [None] * n)]
            may = _found(read, loose(R.PHRASES))
            out = {"hints": may.astype(np.int32), "sure": np.zeros(n, bool), "t_norm": [None] * n}
        else:
            # Page texts have made theirs on their way.
            norms = columns["t_norm"] if "t_norm" in columns else [normalized_value(t) for t in texts]
            bits, sure = judged(texts, norms)
            may = bits @ WEIGHTS >= least
            out = {"hints": (bits @ (1 << np.arange(len(SIGNALS)))).astype(np.int32), "sure": sure, "t_norm": norms}
        if decode and "decode_text" in columns:
            out["tokens"] = _found([t or "" for t in columns["decode_text"]], "[A-Za-z0-9+/]{80}")
        else:
            out["tokens"] = np.zeros(n, bool)
        source = columns["source"]
        out["come"] = may | out["tokens"] | np.array([least == 0 or s in ("span", "embedded_file") for s in source], bool)
        return out

    def filled(batch: pa.RecordBatch, columns: dict) -> pa.RecordBatch | None:
        n = len(columns.get("doc", ()))
        if not n:
            return None
        found = judge(columns, n)
        keep = np.flatnonzero(found.pop("come"))
        columns = columns | found
        if "decode_text" in columns:
            # The others' payloads are looked for no more; metadata are measured by theirs.
            columns["decode_text"] = [t if k or s == "metadata" else None for t, k, s in zip(columns["decode_text"], columns["tokens"], columns["source"])]
        arrays = []
        for field in schema:
            if field.name in own:
                a = batch[field.name].take(pa.array(np.asarray(columns["doc"], np.int64)))
            elif field.name in columns:
                a = columns[field.name]
                a = a if isinstance(a, pa.Array) else pa.array(a, field.type)
            else:
                a = pa.nulls(n, field.type)
            a = a.take(pa.array(keep)) if len(keep) < n else a
            arrays.append(a if a.type == field.type else a.cast(field.type))
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def of_documents(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        of, pages = _entries(batch["pages"])
        docs, number = of.tolist(), pc.struct_field(pages, ["page"]).to_pylist()
        small = Rows()
        _small(small, batch, rules, on, decode, docs, number, pages)
        yield filled(batch, small.columns())
        if not on & {"spans", "page_text"}:
            return
        span_page, spans = _entries(pc.struct_field(pages, ["spans"]))
        texts = [collapsed(t) for t in pc.struct_field(spans, ["text"]).to_pylist()]
        held = np.flatnonzero(np.array([bool(t) for t in texts], bool))
        spans, span_page, texts = spans.take(pa.array(held)), span_page[held].tolist(), [texts[i] for i in held]
        seqs = pc.struct_field(spans, ["seq"]).to_pylist()
        if "spans" in on:
            columns = {"doc": [docs[p] for p in span_page], "emit": [[2, number[p], 0, s, 0] for p, s in zip(span_page, seqs)], "origin": ["span"] * len(texts), "source": ["span"] * len(texts), "page": [number[p] for p in span_page], "text": texts}
            columns |= {k: pc.struct_field(spans, [name]) for k, name in (("size_pt", "size"), ("opacity", "opacity"), ("type", "type"), ("layer", "layer"), ("color", "color"), ("bbox", "bbox"))}
            yield filled(batch, columns)
        if "page_text" in on:
            keyed: list[list[tuple]] = [[] for _ in number]
            boxes, y_keys = _lists(spans, "bbox", "y_key")
            for p, box, y, s, t in zip(span_page, boxes, y_keys, seqs, texts):
                left, top = (box[0], box[1]) if box is not None and len(box) == 4 else (None, None)
                y = top if y is None else y
                y = number[p] if y is None else y
                keyed[p].append((_number(y), _number(0.0 if left is None else left), _number(s), t))
            rows = Rows()
            _pages(rows, number, docs, number, keyed)
            yield filled(batch, rows.columns())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = max(1, min(DOCUMENTS, CHARS * batch.num_rows // max(1, batch.nbytes)))
            for start in range(0, batch.num_rows, each):
                # A copy, as functions over lists look at all that stands behind a slice.
                part = batch.take(pa.array(range(start, min(start + each, batch.num_rows))))
                yield from (b for b in of_documents(part) if b is not None and b.num_rows)

    return build

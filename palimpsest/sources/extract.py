"""Extraction: PDF bytes to the nested table that the scan takes, or such a table from JSON or Parquet.

The PDF library is optional. Failures are rows with status `error`, never exceptions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from palimpsest.operators.scan import EXTRACTED


#: Fixed value: the status of a document that could not be had.
MISSING = "pdf_missing_or_download_failed"


def sidecar(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Documents that were extracted elsewhere, in the extracted schema."""
    return spark.read.schema(EXTRACTED).format(fmt).load(path)


def extract(files: DataFrame, extractor: Callable[[bytes], dict] | None = None) -> DataFrame:
    """(doc_key, file_size_bytes, mtime, content) to extracted documents; `extractor` gives the nested fields of one file.

    Other columns stay. A document without content has the status of a failed download.
    """
    own, needed = extractor or pdf_fields, ["doc_key", "file_size_bytes", "mtime", "content"]
    more = [f for f in files.schema if f.name not in needed]
    carried = [f.name for f in more]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                row = {"doc_key": r.doc_key, "file_size_bytes": r.file_size_bytes, "mtime": r.mtime, "status": "ok", "error": "", "n_pages": 0, "ocg_count": 0, "metadata": {}, "xmp": "", "embedded": [], "pages": []}
                row |= {k: getattr(r, k) for k in carried}
                try:
                    row |= {"status": MISSING} if r.content is None else own(r.content)
                except Exception as e:  # one bad document is a row, not a failed job
                    row |= {"status": "error", "error": f"{type(e).__name__}: {e}"}
                rows.append(row)
            yield pd.DataFrame(rows)

    return files.select(*needed, *carried).mapInPandas(run, EXTRACTED + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in more))


def span_text(chars: list) -> str:
    """A span's text from its characters; the first item of each is a code point."""
    return " ".join("".join(chr(c[0]) for c in chars if c and isinstance(c[0], int)).split())


def pdf_fields(content: bytes) -> dict:
    """The nested fields of one PDF, by the optional PDF library."""
    import pymupdf

    with pymupdf.open(stream=content, filetype="pdf") as doc:
        groups = _quiet(doc.get_ocgs, {})
        return {
            "n_pages": int(doc.page_count),
            "ocg_count": len(groups) if isinstance(groups, dict) else 0,
            "metadata": {str(k): None if v is None else str(v) for k, v in (doc.metadata or {}).items()},
            "xmp": _quiet(doc.get_xml_metadata, "") or "",
            "embedded": [_embedded(doc, i) for i in range(_quiet(doc.embfile_count, 0))],
            "pages": [_page(doc.load_page(i), i + 1) for i in range(doc.page_count)],
        }


def _quiet(read: Callable, instead):
    try:
        return read()
    except Exception:
        return instead


def _embedded(doc, i: int) -> dict:
    info = _quiet(lambda: doc.embfile_info(i), {}) or {}
    return {"seq": i} | {k: info.get(k) for k in ("filename", "name", "desc", "description")}


def _page(page, number: int) -> dict:
    spans = []
    for i, s in enumerate(_quiet(page.get_texttrace, []) or []):
        box = s.get("bbox")
        color = s.get("color")
        spans.append({
            "seq": i, "text": span_text(s.get("chars") or []), "size": float(s.get("size") or 0), "opacity": None if s.get("opacity") is None else float(s["opacity"]), "type": s.get("type"), "layer": s.get("layer") or None,
            "color": [float(c) for c in color] if isinstance(color, list | tuple) else None, "bbox": [float(v) for v in box] if box else None, "y_key": round(box[1], 1) if box else float(number),
        })
    notes = [{"seq": i, **{k: (a.info or {}).get(k) for k in ("subtype", "title", "subject", "content", "contents")}} for i, a in enumerate(_quiet(lambda: list(page.annots() or []), []))]
    fields = [{"seq": i, "field_name": w.field_name, "field_type": str(w.field_type), "field_value": None if w.field_value is None else str(w.field_value)} for i, w in enumerate(_quiet(lambda: list(page.widgets() or []), []))]
    return {"page": number, "spans": spans, "annots": notes, "widgets": fields}

"""The document scan: extracted documents to findings, and to one summary row for each document.

Workers turn each document into candidate texts, one for each channel entry, and leave out those that can't become findings
(`operators.candidates`); nothing is shuffled up to the findings. Decoded payloads join their parent's candidates before anything else is filtered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from palimpsest.functions import rules as R
from palimpsest.functions.scoring import hinted_at, is_phrase, scored
from palimpsest.functions.text import base64_text, collapse, has_bidi, has_zero_width, hex_text, mostly_printable, token_candidates
from palimpsest.operators import visibility
from palimpsest.operators.candidates import SIGNALS, builder

SPAN = "struct<seq:int,text:string,size:double,opacity:double,type:int,layer:string,color:array<double>,bbox:array<double>,y_key:double>"
ANNOTATION = "struct<seq:int,subtype:string,title:string,subject:string,content:string,contents:string>"
WIDGET = "struct<seq:int,field_name:string,field_type:string,field_value:string>"
EMBEDDED = "struct<seq:int,filename:string,name:string,desc:string,description:string>"
EXTRACTED = (
    "doc_key string, file_size_bytes bigint, mtime timestamp, status string, error string, n_pages int, ocg_count int, "
    f"metadata map<string,string>, xmp string, embedded array<{EMBEDDED}>, "
    f"pages array<struct<page:int,spans:array<{SPAN}>,annots:array<{ANNOTATION}>,widgets:array<{WIDGET}>>>"
)

# The output columns of each generation, in order.
FINDINGS = {
    "v3": ("pdf_path", "source", "page", "text", "text_norm_snip", "text_len", "prompty", "prompty_score", "fuzzy_best", "fuzzy_template", "reasons", "size_pt", "opacity", "type", "layer", "color", "bbox", "annot_subtype", "annot_title", "annot_subject", "widget_name", "widget_type", "meta_field", "embedded_filename", "decode_method", "bidi_present", "zero_width_present"),
    "v2": ("pdf_path", "source", "page", "text", "text_len", "size_pt", "opacity", "type", "layer", "color", "bbox", "prompty", "reasons", "annot_subtype", "annot_title", "annot_subject", "widget_name", "widget_type", "meta_field", "embedded_filename"),
    "v1": ("doi", "version", "date", "pdf_path", "page", "text", "text_len", "size_pt", "opacity", "type", "layer", "color", "bbox", "prompty", "reasons"),
}
SUMMARY = {
    "v3": ("pdf_path", "file_size_bytes", "mtime_iso", "status", "error", "n_pages", "n_findings_total", "n_span_findings", "n_page_text_findings", "n_annotation_findings", "n_widget_findings", "n_metadata_findings", "n_embedded_findings", "any_prompty", "any_hidden_or_transparent", "any_layer_text", "bidi_present", "zero_width_present", "annotation_count", "widget_count", "embedded_file_count", "ocg_count"),
    "v2": ("pdf_path", "file_size_bytes", "mtime_iso", "status", "error", "n_pages", "n_findings_total", "n_span_findings", "n_annotation_findings", "n_widget_findings", "n_metadata_findings", "n_embedded_findings", "any_prompty", "any_hidden_or_transparent", "any_layer_text", "has_annotations", "has_widgets", "embedded_file_count", "ocg_count"),
    "v1": ("doi", "version", "date", "pdf_downloaded", "pdf_path", "n_findings", "any_prompty", "any_hidden_or_transparent", "status", "error"),
}

#: Columns of a document that its findings carry where it has them.
KEYS = ("doi", "version", "date")

#: A candidate: where it comes from (emit: channel group, page, pass within the page, entry, part of the entry), its text, what is decoded
#: and under which tag, context, and what workers know of it: its normalized text, the rules that may hold as bits, whether these do hold, and whether a token may be there.
FIELDS = {
    "emit": "array<int>", "origin": "string", "source": "string", "page": "int", "text": "string", "base_reason": "string", "visible_reasons": "array<string>", "decode_text": "string", "decode_tag": "string",
    "size_pt": "double", "opacity": "double", "type": "int", "layer": "string", "color": "array<double>", "bbox": "array<double>", "annot_subtype": "string", "annot_title": "string", "annot_subject": "string",
    "widget_name": "string", "widget_type": "string", "meta_field": "string", "embedded_filename": "string", "decode_method": "string",
    "t_norm": "string", "hints": "int", "sure": "boolean", "tokens": "boolean",
}


#: Every rule may hold.
ALL_HINTS = (1 << len(SIGNALS)) - 1


def _candidate(**values: Column) -> Column:
    return F.struct(*(values.get(k, F.lit(None)).cast(t).alias(k) for k, t in FIELDS.items()))


def page_text(page: Column) -> Column:
    """The page's span texts in reading order, joined and cut to the page limit."""
    def key(s: Column) -> Column:
        placed = F.size(s["bbox"]) == 4
        y = F.coalesce(s["y_key"], F.when(placed, F.get(s["bbox"], F.lit(1))), page["page"].cast("double"))
        x = F.coalesce(F.when(placed, F.get(s["bbox"], F.lit(0))), F.lit(0.0))
        return F.struct(y.alias("y"), x.alias("x"), s["seq"].alias("seq"), collapse(s["text"]).alias("text"))

    ordered = F.array_sort(F.transform(F.filter(page["spans"], lambda s: collapse(s["text"]) != ""), key))
    return F.substring(F.array_join(F.transform(ordered, lambda s: s["text"]), " "), 1, R.PAGE_CHARS)


def _array() -> str:
    return "array<struct<" + ",".join(f"{k}:{t}" for k, t in FIELDS.items()) + ">>"


def _decoded(c: Column) -> Column:
    """The printable payloads of a candidate's base64 and hex tokens, as candidates."""
    def of(method: str, pattern: str, text_of) -> Column:
        def one(token: Column, i: Column) -> Column:
            place = F.concat(F.slice(c["emit"], 1, 4), F.array(i + (1 if method == "base64" else 1_000_000)))
            return _candidate(emit=place, origin=c["origin"], source=F.lit("decoded"), page=c["page"], text=text_of(token), base_reason=F.concat(F.lit(f"decoded_{method}_from_"), c["decode_tag"]), decode_method=F.lit(method), hints=F.lit(ALL_HINTS), sure=F.lit(False), tokens=F.lit(False))

        return F.filter(F.transform(token_candidates(c["decode_text"], pattern), one), lambda d: mostly_printable(d["text"]))

    return F.when(c["decode_text"].isNotNull(), F.concat(of("base64", R.BASE64_TOKEN, base64_text), of("hex", R.HEX_TOKEN, hex_text))).otherwise(F.array().cast(_array()))


def candidates(extracted: DataFrame, rules: R.Rules, least: int = 0) -> DataFrame:
    """doc_key, the document's KEYS, and one row for each candidate text, decoded payloads included.

    With `least`, texts that can't score as much are left out, or that don't match the single pattern, where the text alone decides.
    """
    own = ["doc_key", *(k for k in KEYS if k in extracted.columns)]
    kinds = T.StructType([extracted.schema[k] for k in own] + [T.StructField(k, T._parse_datatype_string(t)) for k, t in FIELDS.items()])
    rows = extracted.select(*own, "metadata", "xmp", "embedded", "pages").mapInArrow(builder(rules, own, to_arrow_schema(kinds), least), kinds)
    if "decode" in rules.channels:
        one = F.struct(*FIELDS)
        rows = rows.select(*own, one.alias("c"))
        with_decoded = F.when(F.col("c.tokens"), F.concat(F.array("c"), _decoded(F.col("c")))).otherwise(F.array("c"))
        rows = rows.select(*own, F.explode(with_decoded).alias("c")).select(*own, "c.*")
    is_span = F.col("source") == "span"
    why = visibility.reasons(*(F.col(c) for c in ("text", "size_pt", "opacity", "type", "layer", "color", "bbox")), rules)
    rows = rows.withColumn("visible_reasons", F.when(is_span, why))
    return rows.withColumns({
        "base_reason": F.coalesce("base_reason", F.array_join("visible_reasons", ";")), "size_pt": F.when(is_span, F.coalesce("size_pt", F.lit(0.0))),
        "opacity": F.when(is_span, visibility.shown_opacity(F.col("opacity"), rules)), "type": F.when(is_span, F.coalesce("type", F.lit(-1))),
    })


def findings(extracted: DataFrame, preset: str = "v3", rules: R.Rules | None = None) -> DataFrame:
    """Kept findings in the columns of the preset, and `origin` and `emit` (the order of findings in a document)."""
    rules = rules or R.PRESETS[preset]
    least = 1 if rules.scoring == "phrases" else R.FLAGGED_SCORE - (R.WEIGHTS["fuzzy_match"] if rules.fuzzy != "off" else 0)
    rows = candidates(extracted, rules, least)
    suspect = F.coalesce(visibility.suspicious(F.col("visible_reasons"), F.col("text"), rules), F.lit(False))
    if rules.scoring == "phrases":
        rows = rows.withColumn("prompty", (F.col("hints") > 0) & is_phrase(F.when(F.col("source") == "metadata", F.col("decode_text")).otherwise(F.col("text"))))
        keep = F.col("prompty") | suspect | (F.col("source") == "embedded_file")
        suffix = F.when(F.col("source") == "embedded_file", F.when(F.col("prompty"), F.lit("embedded_file_text_prompty")))
        named = F.when(F.col("source").isin("annotation", "widget"), F.concat(F.col("base_reason"), F.lit("_prompty"))).when(F.col("source") == "metadata", F.lit("metadata_prompty")).when(F.col("source") == "xmp", F.lit("xmp_prompty")).otherwise(F.col("base_reason"))
        rows = rows.where(keep).withColumn("reasons", F.concat_ws(";", F.nullif(named, F.lit("")), suffix))
        measured = F.when(F.col("source") == "metadata", F.col("decode_text")).otherwise(F.col("text"))
        rows = rows.withColumn("text_len", F.length(measured))
    else:
        always = suspect | (F.col("source") == "embedded_file")
        rows = scored(rows, "text", fuzzy=rules.fuzzy, always=always, hinted=True).where(F.col("prompty") | always)
        rows = rows.withColumns({
            "reasons": F.concat_ws(";", F.nullif(F.col("base_reason"), F.lit("")), F.nullif(F.col("prompty_reasons"), F.lit(""))),
            "text_len": F.length("text"), "text_norm_snip": F.substring("t_norm", 1, R.NORM_SNIPPET_CHARS),
            "bidi_present": hinted_at("bidi_controls_present") & has_bidi(F.col("text")), "zero_width_present": hinted_at("zero_width_present") & has_zero_width(F.col("text")),
        })
    rows = rows.withColumns({"text": F.substring("text", 1, R.SNIPPET_CHARS), "pdf_path": F.col("doc_key")})
    columns = [c for c in FINDINGS[preset] if c in rows.columns]
    return rows.select("doc_key", "origin", "emit", *columns)


def summary(extracted: DataFrame, found: DataFrame, preset: str = "v3") -> DataFrame:
    """One row for every document, with or without findings, failed ones included."""
    of = lambda source: F.count_if(F.col("source") == source)
    says = lambda what: F.coalesce(F.bool_or(F.col("reasons").contains(what)), F.lit(False))
    counts = {
        "n_findings_total": F.count(F.lit(1)),
        "any_prompty": F.bool_or("prompty"),
        "any_hidden_or_transparent": says("hidden_render_mode") | says("opacity"),
    }
    if preset != "v1":
        counts |= {
            "any_layer_text": says("optional_content_layer"), "n_span_findings": of("span"), "n_annotation_findings": of("annotation"), "n_widget_findings": of("widget"),
            "n_metadata_findings": F.count_if(F.col("origin") == "metadata"), "n_embedded_findings": F.count_if(F.col("origin") == "embedded"),
        }
    if preset == "v3":
        counts |= {"n_page_text_findings": F.count_if(F.col("origin") == "page"), "bidi_present": F.bool_or("bidi_present"), "zero_width_present": F.bool_or("zero_width_present")}
    grouped = found.groupBy("doc_key").agg(*(c.alias(k) for k, c in counts.items()))
    over_pages = lambda field: F.coalesce(F.aggregate("pages", F.lit(0), lambda n, p: n + F.greatest(F.size(p[field]), F.lit(0))), F.lit(0))
    facts = extracted.select(
        "doc_key", (F.when(F.col("pdf_downloaded"), F.col("doc_key")) if "pdf_downloaded" in extracted.columns else F.col("doc_key")).alias("pdf_path"), F.coalesce("file_size_bytes", F.lit(0)).alias("file_size_bytes"),
        F.coalesce(F.regexp_replace(F.date_format("mtime", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", ""), F.lit("")).alias("mtime_iso"), "status", F.coalesce("error", F.lit("")).alias("error"),
        F.coalesce("n_pages", F.lit(0)).alias("n_pages"), F.coalesce("ocg_count", F.lit(0)).alias("ocg_count"),
        over_pages("annots").alias("annotation_count"), over_pages("widgets").alias("widget_count"), F.greatest(F.size("embedded"), F.lit(0)).alias("embedded_file_count"),
        *(c for c in ("doi", "version", "date", "pdf_downloaded") if c in extracted.columns),
    )
    joined = facts.join(grouped, "doc_key", "left")
    zeros = {k: F.coalesce(F.col(k), F.lit(False) if k.startswith("any_") or k.endswith("_present") else F.lit(0)) for k in counts}
    joined = joined.withColumns(zeros)
    if preset == "v2":
        joined = joined.withColumns({"has_annotations": F.col("n_annotation_findings") > 0, "has_widgets": F.col("n_widget_findings") > 0})
    if preset == "v1":
        joined = joined.withColumnRenamed("n_findings_total", "n_findings")
    return joined.select(*[c for c in SUMMARY[preset] if c in joined.columns])


def prevalence(papers: DataFrame) -> DataFrame:
    """Papers, downloaded ones, and of these the shares with findings and with instructions."""
    got = F.col("pdf_downloaded")
    share = lambda c: F.avg(F.when(got, c.cast("double")))
    return papers.agg(F.count(F.lit(1)).alias("n_papers"), F.count_if(got).alias("n_downloaded"), share(F.col("n_findings") > 0).alias("share_with_findings"), share(F.coalesce(F.col("any_prompty"), F.lit(False))).alias("share_prompty"))

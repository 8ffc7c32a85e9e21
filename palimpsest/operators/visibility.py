"""Rules by which a text span is hard to see for a reader."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.rules import V3, Rules


def fixed(value: Column, digits: int) -> Column:
    """A number with fixed digits, ties to even on the binary value, and no grouping."""
    return F.call_function("format_number", value, F.lit("0." + "0" * digits))


def shown_opacity(opacity: Column, rules: Rules = V3) -> Column:
    given = F.coalesce(opacity, F.lit(1.0))
    return F.when(given == 0, 1.0).otherwise(given) if rules.zero_opacity == "coerce" else given


def near_white(color: Column, rules: Rules = V3) -> Column:
    high = lambda i: F.get(color, F.lit(i)) >= rules.near_white
    return F.coalesce(F.when(F.size(color) == 1, high(0)).when(F.size(color) >= 3, high(0) & high(1) & high(2)), F.lit(False))


def area(bbox: Column) -> Column:
    side = lambda a, b: F.greatest(F.lit(0.0), F.get(bbox, F.lit(b)) - F.get(bbox, F.lit(a)))
    return F.when(F.size(bbox) == 4, side(0, 2) * side(1, 3)).otherwise(0.0)


def reasons(text: Column, size: Column, opacity: Column, kind: Column, layer: Column, color: Column, bbox: Column, rules: Rules = V3) -> Column:
    """Array of the reasons that hold, in fixed order."""
    size, opacity = F.coalesce(size, F.lit(0.0)), shown_opacity(opacity, rules)
    length, space = F.length(text), F.coalesce(area(bbox), F.lit(0.0))
    found = [
        F.when(kind == 3, F.lit("hidden_render_mode(type=3)")),
        F.when(opacity <= rules.near_zero_opacity, F.concat(F.lit("near_zero_opacity("), fixed(opacity, 3), F.lit(")")))
        .when(opacity <= rules.low_opacity, F.concat(F.lit("low_opacity("), fixed(opacity, 3), F.lit(")"))),
        F.when((size > 0) & (size <= rules.micro_font), F.concat(F.lit("micro_font("), fixed(size, 2), F.lit("pt)")))
        .when((size > 0) & (size <= rules.tiny_font), F.concat(F.lit("tiny_font("), fixed(size, 2), F.lit("pt)"))),
        F.when(near_white(color, rules), F.lit("near_white_color")),
        F.when(F.coalesce(layer, F.lit("")) != "", F.concat(F.lit("optional_content_layer("), layer, F.lit(")"))),
        F.when((space > 0) & (size <= rules.micro_font) & (length >= rules.least_chars), F.concat(F.lit("microtext_density("), fixed(length / space, 2), F.lit("/pt^2)"))),
    ]
    return F.array_compact(F.array(*found))


def suspicious(found: Column, text: Column, rules: Rules = V3) -> Column:
    micro = F.exists(found, lambda r: r.contains("micro_font"))
    return (F.size(found) > 0) & ((F.length(text) >= rules.least_chars) | micro)

"""Highlighted text: XML, terminal and HTML forms, built from phrase spans.

Spans come per text as array<struct<start, end, phrase[, attributes]>> in order;
attributes is a map of further attributes (null: none).
"""

from __future__ import annotations

import re
from xml.sax.saxutils import escape, unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLUE, GREEN, END = "\033[94m", "\033[92m", "\033[0m"
HTML_SPAN = ('<span style="background-color: LightBlue;">', "</span>")
HTML_HEAD = '<html>\n<head>\n<meta http-equiv="Content-Type" content="text/html; charset=UTF-8">\n<meta charset="UTF-8">\n<title>highlighted text</title>\n</head>\n<body>'


def _weaver(inside, outside):
    """(text, spans) -> string: outside(text between spans) and inside(span, its text) in order; one pass over text and spans.

    A null text is an empty one.
    """

    @F.arrow_udf("string")
    def weave(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, own in zip(texts.to_pylist(), spans.to_pylist()):
            text, parts, at = text or "", [], 0
            for s in own or ():
                parts += [outside(text[at : s["start"]]), inside(s, text[s["start"] : s["end"]])]
                at = s["end"]
            parts.append(outside(text[at:]))
            out.append("".join(parts))
        return pa.array(out, pa.string())

    return weave


def _attributes(s: dict) -> str:
    return "".join(f' {k}="{v}"' for k, v in s.get("attributes") or ())


def highlight_xml(text: Column, spans: Column) -> Column:
    """<highlighted_text> with <extracted_phrase standardized_form="..."> around each span. Attributes aren't escaped."""

    def inside(s, own):
        return f'<extracted_phrase standardized_form="{s["phrase"]}"{_attributes(s)}>{escape(own)}</extracted_phrase>'

    return F.concat(F.lit("<highlighted_text>"), _weaver(inside, escape)(text, spans), F.lit("</highlighted_text>"))


def highlight_terminal(text: Column, spans: Column, replace: bool = False) -> Column:
    """[phrases] in blue; with replace their standard forms, in green."""
    if replace:
        return _weaver(lambda s, own: f"{GREEN}[{s['phrase']}]{END}", lambda t: t)(text, spans)
    return _weaver(lambda s, own: f"{BLUE}[{own}]{END}", lambda t: t)(text, spans)


def highlight_html(text: Column, spans: Column, standalone: bool = False) -> Column:
    """A span element with phrases on light blue, or a page of it."""
    woven = _weaver(lambda s, own: HTML_SPAN[0] + escape(own) + HTML_SPAN[1], escape)(text, spans)
    body = F.concat(F.lit("<span>"), woven, F.lit("</span>"))
    return F.concat(F.lit(HTML_HEAD), body, F.lit("</body>\n</html>\n")) if standalone else body


def with_spans(docs: DataFrame, phrases: DataFrame, id_col: str = "doc_id", attributes: Column | None = None) -> DataFrame:
    """docs with `spans`: the phrases of extract_spans, in order; an empty array for texts without any.

    For phrases that a join has given more columns to; without one, Pipeline.spans_in has the spans in the row.
    attributes: a map of further attributes per phrase.
    """
    kind = "array<struct<pos:int,start:int,end:int,phrase:string,attributes:map<string,string>>>"
    more = F.lit(None).cast("map<string,string>") if attributes is None else attributes
    own = F.collect_list(F.struct("pos", "start", "end", "phrase", more.alias("attributes")))
    lists = phrases.groupBy(F.col("doc_id").alias("span_id")).agg(F.array_sort(own, lambda a, b: a["pos"] - b["pos"]).alias("spans"))
    out = docs.join(lists, F.col(id_col) == F.col("span_id"), "left").drop("span_id")
    return out.withColumn("spans", F.coalesce("spans", F.array().cast(kind)))


_PHRASE = re.compile(r'<extracted_phrase standardized_form="(.*?)"[^>]*>(.*?)</extracted_phrase>', re.S)


def printable(xml: str, replace: bool = False) -> str:
    """The terminal form of one XML string, on the driver."""
    text = re.sub(r"^\s*<highlighted_text>|</highlighted_text>\s*$", "", xml)
    shown = _PHRASE.sub(lambda m: f"{GREEN}[{m[1]}]{END}" if replace else f"{BLUE}[{m[2]}]{END}", text)
    return unescape(shown)


def html_of(xml: str, standalone: bool = False) -> str:
    """The HTML form of one XML string, on the driver; broken markup is taken as text."""
    text = re.sub(r"^\s*<highlighted_text>|</highlighted_text>\s*$", "", xml)
    out, at = [], 0
    for m in _PHRASE.finditer(text):
        out += [escape(unescape(re.sub(r"<[^>]*>", "", text[at : m.start()]))), HTML_SPAN[0], escape(unescape(m[2])), HTML_SPAN[1]]
        at = m.end()
    out.append(escape(unescape(re.sub(r"<[^>]*>", "", text[at:]))))
    body = f"<span>{''.join(out)}</span>"
    return f"{HTML_HEAD}{body}</body>\n</html>\n" if standalone else body

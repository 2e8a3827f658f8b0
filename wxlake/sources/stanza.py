"""XML stanzas that wrap a bulletin, both ways.

XML readers turn CR LF into LF, and a bulletin's CR CR LF would become two line ends, one of them a blank line with
a meaning. So CRs inside the root element are written as references, which readers keep, before the standard parser sees them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC, datetime
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "nwws-oi"
_NAMES = ("type", "sender", "recipient", "summary", "xhtml_summary", "payload", "error")
PAYLOAD = T.StructType([T.StructField(n, T.TimestampType() if n == "issue" else T.StringType()) for n in ("cccc", "ttaaii", "awips", "issue", "id", "process_id", "sequence", "raw")])
STANZA = T.StructType([T.StructField(n, PAYLOAD if n == "payload" else T.StringType()) for n in _NAMES])
_ROOT = re.compile(r"<[^?!]")
_TEXT = re.compile(r"(<!\[CDATA\[.*?\]\]>|>[^<]*)", re.DOTALL)
_TIME = re.compile(r"\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:\d{2})\Z")
_FIELDS = ("cccc", "ttaaii", "issue", "awipsid", "id")


def _payload(attributes: dict[str, str]) -> dict | None:
    """The wrapper's fields; None if one is missing or malformed, which skips the payload but not the message."""
    if any(f not in attributes for f in _FIELDS) or not _TIME.match(attributes["issue"]):
        return None
    process, dot, number = attributes["id"].partition(".")
    if not dot:
        process, number = "", process
    try:
        issue = datetime.fromisoformat(attributes["issue"].upper()).astimezone(UTC)
    except ValueError:
        return None
    if not re.fullmatch(r"\+?[0-9]+", number) or int(number) >= 1 << 64:
        return None
    return {"cccc": attributes["cccc"], "ttaaii": attributes["ttaaii"], "awips": attributes["awipsid"], "issue": issue, "id": attributes["id"], "process_id": process, "sequence": str(int(number)), "raw": ""}


def _kept(text: str) -> str:
    """The text with each CR in its root element as a reference; a CDATA section is left and entered again for it."""
    root = _ROOT.search(text)
    if "\r" not in text or root is None:
        return text
    written = lambda m: m[0].replace("\r", "]]>&#13;<![CDATA[" if m[0].startswith("<") else "&#13;")
    return text[: root.start()] + _TEXT.sub(written, text[root.start() :])


def read(text: str | None) -> dict:
    """A stanza's fields; error is set if the text is no well-formed XML."""
    out: dict = dict.fromkeys(_NAMES)
    if text is None:
        return out | {"error": "InvalidUtf8"}
    state: dict = {"html": False, "target": None, "open": None}

    def start(name: str, attributes: dict[str, str]) -> None:
        if name == "message":
            out.update(type=attributes.get("type"), sender=attributes.get("from"), recipient=attributes.get("to"))
        elif name == "html":
            state["html"] = True
        elif name == "body":
            state["target"] = "xhtml_summary" if state["html"] else "summary"
        elif name == "x" and attributes.get("xmlns") == SPACE:
            state["open"] = _payload(attributes) or state["open"]

    def end(name: str) -> None:
        if name == "body":
            state["target"] = None
        elif name == "html":
            state["html"] = False
        elif name == "x" and state["open"] is not None:
            state["open"]["raw"] = state["open"]["raw"].strip("\r\n")
            out["payload"], state["open"] = state["open"], None

    def data(chunk: str) -> None:
        if state["open"] is not None:
            state["open"]["raw"] += chunk
        elif state["target"] and chunk:
            out[state["target"]] = (out[state["target"]] or "") + chunk

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    try:
        parser.Parse(_kept(text.strip(" \t\r\n\f")), True)
    except expat.ExpatError:
        return dict.fromkeys(out) | {"error": "InvalidXml"}
    return out


@F.pandas_udf(STANZA)
def stanza(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The fields of stanzas; a null text is an error."""
    for texts in batches:
        yield pd.DataFrame([read(t) for t in texts], columns=list(_NAMES))


def escaped(text: Column) -> Column:
    for plain, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&apos;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(name))
    return text


def written(wrapper: Column, wrapper_id: Column, issue: Column, raw: Column) -> Column:
    """The canonical stanza of a wrapper and its bulletin, null without a payload."""
    attribute = lambda name, value: F.coalesce(F.concat(F.lit(f" {name}='"), escaped(value), F.lit("'")), F.lit(""))
    body = F.coalesce(F.concat(F.lit("<body>"), escaped(wrapper["summary"]), F.lit("</body>")), F.lit(""))
    html = F.coalesce(F.concat(F.lit("<html xmlns='http://jabber.org/protocol/xhtml-im'><body xmlns='http://www.w3.org/1999/xhtml'>"), escaped(wrapper["xhtml_summary"]), F.lit("</body></html>")), F.lit(""))
    fields = F.concat(attribute("cccc", wrapper["cccc"]), attribute("ttaaii", wrapper["ttaaii"]), attribute("issue", F.date_format(issue, "yyyy-MM-dd'T'HH:mm:ss'Z'")), attribute("awipsid", wrapper["awips"]), attribute("id", wrapper_id))
    head = F.concat(F.lit("<message"), attribute("type", wrapper["type"]), attribute("from", wrapper["sender"]), attribute("to", wrapper["recipient"]), F.lit(">"))
    return F.when(wrapper_id.isNotNull() & raw.isNotNull(), F.concat(head, body, html, F.lit(f"<x xmlns='{SPACE}'"), fields, F.lit(">"), escaped(raw), F.lit("</x></message>")))

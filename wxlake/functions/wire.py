"""Texts to bulletins: frame, sequence number, heading, identifier and body, in plain Python for the segmenter."""

from __future__ import annotations

import re

SOH, ETX, SEPARATOR = "\x01", "\x03", "\r\r\n"
_SPACE = " \t\n\r\f"
#: The shapes of a heading's tokens; the fourth may be missing.
_TOKENS = (("ttaaii", re.compile(r"[A-Z]{4}[0-9]{2}\Z")), ("cccc", re.compile(r"[A-Z]{4}\Z")), ("yygggg", re.compile(r"[0-9]{6}\Z")), ("bbb", re.compile(r"[A-Z0-9]{3}\Z")))
#: A heading as most texts have it: tokens with single spaces between. Other lines are judged token by token.
_HEADING = re.compile(r"([A-Z]{4}[0-9]{2}) ([A-Z]{4}) ([0-9]{6})(?: ([A-Z0-9]{3}))?\Z")
_AWIPS, _SEQUENCE = re.compile(r"[A-Z0-9]{5,6}\Z"), re.compile(r"[0-9]{3}\Z")
NAMES = ("frame_kind", "bulletin", "sequence_number", "heading", "ttaaii", "cccc", "yygggg", "bbb", "awips_id", "nnn", "xxx", "body", "error_kind", "error_field", "error_offset")


class Rejected(ValueError):
    """kind, field and offset of what rejects a text."""


def _unbroken(text: str) -> str:
    """The text without the line end that it may end on."""
    return next((text[: -len(end)] for end in (SEPARATOR, "\r\n", "\n") if text.endswith(end)), text) if text.endswith("\n") else text


def _unframed(raw: str) -> str:
    size = len(raw.encode())
    if size < 5:
        raise Rejected("UnexpectedEof", "framed message", None)
    if raw[1:4] != SEPARATOR:
        raise Rejected("InvalidControl", "leading SOH separator", 1)
    if not raw.endswith(ETX):
        raise Rejected("InvalidControl", "missing trailing ETX", size - 1)
    return raw[4:-1]


def _line(text: str, name: str) -> tuple[str, str]:
    """The first line, trimmed, and what follows it; a line needs its end."""
    line, end, rest = text.partition("\n")
    if not end:
        raise Rejected("UnexpectedEof", name, None)
    return line.strip(_SPACE), rest


def _heading(line: str, out: dict) -> str:
    """A heading's tokens, which go to their fields, with single spaces between."""
    token = line.split()
    for i, (name, _) in enumerate(_TOKENS[:3]):
        if len(token) <= i:
            raise Rejected("MissingField", name, None)
    if len(token) > 4:
        raise Rejected("InvalidField", "wmo heading token count", None)
    for t, (name, shape) in zip(token, _TOKENS, strict=False):
        if not shape.match(t):
            raise Rejected("InvalidField", name, None)
        out[name] = t
    return " ".join(token)


def read(raw: str | None) -> dict:
    """The bulletin's fields. A null text counts as bytes that are not UTF-8; a rejected text keeps what names the error."""
    out: dict = dict.fromkeys(NAMES)
    framed = raw is not None and raw.startswith(SOH)
    out["frame_kind"] = "framed" if framed else "bare"
    try:
        if raw is None:
            raise Rejected("InvalidUtf8", "utf-8", None)
        text = out["bulletin"] = _unbroken(_unframed(raw) if framed else raw)
        first, end, rest = text.partition("\n")
        number = None
        if end and _SEQUENCE.match(first := first.strip(_SPACE)):
            number, text = int(first), rest
        line, rest = _line(text.lstrip("\r\n"), "wmo heading line")
        if usual := _HEADING.match(line):
            out["heading"] = line
            out["ttaaii"], out["cccc"], out["yygggg"], out["bbb"] = usual.groups()
        else:
            out["heading"] = _heading(line, out)
        out["sequence_number"] = number
        rest = rest.lstrip("\r\n")
        named, end, after = rest.partition("\n")
        named = named.strip(_SPACE)
        if end and _AWIPS.match(named):
            out["awips_id"], out["nnn"], out["xxx"], rest = named, named[:3], named[3:], after
        out["body"] = _unbroken(rest)
    except Rejected as e:
        out.update(dict.fromkeys(NAMES[2:12]), error_kind=e.args[0], error_field=e.args[1], error_offset=e.args[2])
    return out

"""Hazard tags of a segment's lines, for the segmenter."""

from __future__ import annotations

import math
import re
import struct

from .codes import ACTIONS, TEXT_TAGS

_SPACE = " \t\n\r\f"
_FLOAT = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\Z")
_INT = re.compile(r"\+?[0-9]+\Z")
#: Values of a tornado tag that every report knows.
TORNADO = ("OBSERVED", "RADAR INDICATED", "POSSIBLE")
_THREATS = ("tstm_damage_threat", "tornado_damage_threat", "flash_flood_damage_threat")


_CAPITALS = {c: c - 32 for c in range(ord("a"), ord("z") + 1)}


def upper(text: str) -> str:
    """ASCII upper case."""
    return text.upper() if text.isascii() else text.translate(_CAPITALS)


def _single(x: float) -> float:
    return struct.unpack("f", struct.pack("f", x))[0]


def hundredths(text: str) -> float | None:
    """A number in single precision, rounded there to two places, halves away from zero; null if it is too large."""
    try:
        scaled = _single(_single(float(text)) * 100)
    except OverflowError:
        return None
    return _single(math.copysign(math.floor(abs(scaled) + 0.5), scaled) / 100) if math.isfinite(scaled) else None


def _number(line: str, prefix: str, unit: str, shape: re.Pattern) -> str | None:
    """The number between the first `prefix` and the next `unit`."""
    _, found, rest = line.partition(prefix)
    inner, ended, _ = rest.partition(unit)
    plain = inner.strip().lstrip("<>")
    return plain if found and ended and shape.match(plain) else None


def of_line(line: str) -> list[tuple[str, float | None, str | None]]:
    """Segment tags (kind, number, text) of one line."""
    u = upper(line.strip(_SPACE))
    if "..." not in u and "DAMAGE THREAT" not in u and not u.startswith("FLASH FLOOD EMERGENCY"):
        return []
    out: list = [("tornado", None, w) for w in TORNADO if f"TORNADO...{w}" in u]
    out += [("flash_flood_observed", None, None)] if "FLASH FLOOD...OBSERVED" in u else []
    out += [("flash_flood_emergency", None, None)] if u.startswith("FLASH FLOOD EMERGENCY") else []
    hail = _number(u, "HAIL...", "IN", _FLOAT) or _number(u, "MAX HAIL SIZE...", "IN", _FLOAT)
    winds = [n for prefix in ("WIND...", "MAX WIND GUST...") if (n := _number(u, prefix, "MPH", _INT)) and int(n) < 1 << 16]
    out += [("hail_inches", hundredths(hail), None)] if hail else []
    out += [("wind_mph", float(winds[0]), None)] if winds else []
    if "DAMAGE THREAT" in u:
        out += [("damage_threat", None, w) for w in ("CONSIDERABLE", "SIGNIFICANT", "DESTRUCTIVE", "CATASTROPHIC") if w in u]
    return out + [("damage_threat", None, w) for w in ("SIGNIFICANT", "GENERAL") if f"SNOW SQUALL IMPACT...{w}" in u]


def text_tag(line: str, number: int) -> dict | None:
    """A tag NAME...VALUE with raw and normalised parts and its measurement."""
    raw = line.strip()
    name, dots, value = raw.partition("...")
    name, value = name.strip().lstrip("*").strip(), value.strip()
    known = upper(" ".join(name.split()))
    if not dots or known not in TEXT_TAGS:
        return None
    unit = {"MAX HAIL SIZE": ("IN", "in"), "MAX WIND GUST": ("MPH", "mph")}.get(known)
    size = None
    if unit:
        text, ended, _ = upper("".join(value.split())).partition(unit[0])
        text = text.lstrip("<>")
        size = hundredths(text) if ended and _FLOAT.match(text) else None
    return {"kind": known.lower().replace(" ", "_"), "raw_line": raw, "raw_name": name, "raw_value": value, "normalized_value": upper(" ".join(value.split())), "numeric_value": size, "unit": unit[1] if size is not None else None, "line_number": number}


def rolled_up(lines: list[str], phenomena: list[str]) -> tuple[dict, list[dict]]:
    """Tags as columns, and the text tags. Of each kind the last counts, and segment tags override text tags.

    tornado_any keeps any value of a text tag, tornado_tag only the known ones. Segments with a flash-flood code have
    no damage threat; a catastrophic one is an emergency.
    """
    texts = [t for i, x in enumerate(lines) if "..." in x and (t := text_tag(x, i + 1))]
    out = dict.fromkeys(("tornado_tag", "tornado_any", "hail_inches", "wind_mph", "damage_threat")) | {"flash_flood_observed": False, "flash_flood_emergency": False}
    for t in texts:
        if t["kind"] == "tornado":
            out["tornado_any"] = t["normalized_value"]
            if t["normalized_value"] in TORNADO:
                out["tornado_tag"] = t["normalized_value"]
        elif t["kind"] == "max_hail_size" and t["numeric_value"] is not None:
            out["hail_inches"] = t["numeric_value"]
        elif t["kind"] == "max_wind_gust" and t["numeric_value"] is not None:
            out["wind_mph"] = int(t["numeric_value"] + 0.5)
        elif t["kind"] in _THREATS:
            out["damage_threat"] = t["normalized_value"]
    for kind, number, text in [t for x in lines for t in of_line(x)]:
        if kind == "tornado":
            out["tornado_tag"] = out["tornado_any"] = text
        elif kind == "hail_inches":
            out["hail_inches"] = number
        elif kind == "wind_mph":
            out["wind_mph"] = int(number)
        elif kind == "damage_threat":
            out["damage_threat"] = text
        else:
            out[kind] = True
    if "FF" in phenomena:
        out["flash_flood_emergency"] |= out["damage_threat"] == "CATASTROPHIC"
        out["damage_threat"] = None
    return out, texts


def actions(codes: list[dict]) -> list[dict]:
    return [{"action": c["action"], "normalized_action": ACTIONS[c["action"]], "raw": c["raw"], "vtec_index": i + 1} for i, c in enumerate(codes)]

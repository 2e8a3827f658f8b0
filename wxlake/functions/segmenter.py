"""Texts to bulletins and segments: the sequential part of parsing, as one Arrow function called once a text.

Native columns were tried first: their nested expressions grew so large that the optimizer did not finish.

A geography block opens a segment, which lasts to a `$$` line or the next block. What stands outside segments is
preamble. Families, times, coordinates, keys and everything across rows are native columns afterwards.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import datetime
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import hashing, tags, wire
from .vtec import H_VTEC, P_VTEC

_P, _H = re.compile(P_VTEC), re.compile(H_VTEC)


def _struct(fields: str) -> T.StructType:
    kinds = {"i": T.IntegerType(), "f": T.FloatType(), "b": T.BooleanType()}
    pairs = [f.partition(":") for f in fields.split()]
    return T.StructType([T.StructField(n, kinds.get(k, T.StringType())) for n, _, k in pairs])


P_CODE = _struct("raw event_class action office phenomenon significance etn:i start end")
H_CODE = _struct("raw nwsli severity cause begin crest end record")
_POINTS = T.ArrayType(_struct("lat:i lon:i"))
POLYGON = T.StructType([T.StructField("raw", T.StringType()), T.StructField("points", _POINTS)])
MOTION = T.StructType([*_struct("raw time direction_degrees:i speed_knots:i"), T.StructField("locations", _POINTS)])
TAGS = _struct("tornado_tag tornado_any flash_flood_observed:b flash_flood_emergency:b hail_inches:f wind_mph:i damage_threat")
TEXT_TAGS = T.ArrayType(_struct("kind raw_line raw_name raw_value normalized_value numeric_value:f unit line_number:i"))
_SEGMENT = T.StructType(
    [
        *_struct("ugc headline dollars:b ampersands:b"),
        T.StructField("ugcs", T.ArrayType(T.StringType())),
        T.StructField("lines", T.ArrayType(T.StringType())),
        T.StructField("pvtec", T.ArrayType(P_CODE)),
        T.StructField("hvtec", T.ArrayType(H_CODE)),
        T.StructField("lat_lon", POLYGON),
        T.StructField("motion", MOTION),
        T.StructField("tags", TAGS),
        T.StructField("text_tags", TEXT_TAGS),
        T.StructField("actions", T.ArrayType(_struct("action normalized_action raw vtec_index:i"))),
    ]
)
_INTS = {"sequence_number", "error_offset"}
BULLETIN = T.StructType([*(T.StructField(n, T.IntegerType() if n in _INTS else T.StringType()) for n in wire.NAMES), T.StructField("mnd_header", T.StringType()), T.StructField("first_code", _struct("phenomenon significance")), T.StructField("parts", T.ArrayType(_SEGMENT))])

#: Digests that the parser gives where they are named: FNV-1a and SHA-256 of the bulletin, FNV-1a of the text; they need no second
#: call, and the text need not come back.
DIGESTS = ("digest", "text_digest", "raw_digest")

#: Texts that are held parsed at once.
TEXTS = 200
_SPACE = " \t\n\r\f"
_BLOCK = re.compile(r"[A-Z]{2}[CZ](?:[0-9]{3}|ALL)[->0-9]")
_GROUP = re.compile(r"(?:([A-Z]{2})([CZ]))?(?:(ALL|000)|([0-9]{3})(?:>([0-9]{3}))?)\Z")
_PURGE = re.compile(r"(?:0[1-9]|[12][0-9]|3[01])(?:[01][0-9]|2[0-3])[0-5][0-9]\Z")
_LAT_LON = re.compile(r"LAT\.\.\.LON((?:[ \t\n\r\f]+[0-9]{4}[ \t\n\r\f]+[0-9]{4,5}){1,20})\Z")
_DIGITS = re.compile(r"[0-9][0-9 \t\f]*\Z")
_MOTION = re.compile(r"TIME\.\.\.MOT\.\.\.LOC\s+((?:[01][0-9]|2[0-3])[0-5][0-9])Z\s+([0-2][0-9]{2}|3[0-5][0-9]|360)DEG\s+([0-9]|[1-9][0-9])KT((?:\s+[0-9]{4}\s+[0-9]{4,5}){1,255})\Z")


def areas(compact: str) -> list[str] | None:
    """Codes of a geography string, ranges written out; None unless it keeps all rules: one kind throughout, a state
    named once, numbers ascending within it, ranges of zones only, and ALL or 000 alone in their state."""
    head, _, purge = compact.removesuffix("-").rpartition("-")
    found = _named(head) if head and compact.endswith("-") and _PURGE.match(purge) else None
    return None if found is None else list(found)


@lru_cache(1 << 14)
def _named(head: str) -> tuple[str, ...] | None:
    """areas() without the time at its end; the same ones come again and again."""
    out, state, kind, last, alone, seen = [], None, None, 0, False, set()
    for i, group in enumerate(head.split("-")):
        m = _GROUP.match(group)
        if not m or (i == 0 and not m[1]):
            return None
        if m[1]:
            if m[1] in seen or (kind and m[2] != kind):
                return None
            state, kind, last, alone = m[1], m[2], 0, False
            seen.add(state)
        if alone or (m[3] and last):
            return None
        if m[3]:
            out.append(f"{state}{kind}{m[3]}")
            alone = True
            continue
        low, high = int(m[4]), int(m[5] or m[4])
        if low <= last or (m[5] and (kind == "C" or high <= low)):
            return None
        out += [f"{state}{kind}{n:03}" for n in range(low, high + 1)]
        last = high
    return tuple(out)


def block(lines: list[str], at: int) -> tuple[int, str, list[str]] | None:
    """The geography block that begins at a line: the line after it, its text and its codes."""
    if not _BLOCK.match(lines[at].strip(_SPACE)):
        return None
    grown: list[str] = []
    for i in range(at, len(lines)):
        line = lines[i].strip(_SPACE)
        if not line or line in ("$$", "&&") or line.startswith("/") or line.split() != [line]:
            return None
        grown.append(line)
        codes = areas("".join(grown))
        if codes is not None:
            return i + 1, "\n".join(grown), codes
        if not line.endswith("-"):
            return None
    return None


class Malformed(ValueError):
    """A polygon or motion line that rejects its product."""


def _points(pairs: str) -> list[dict]:
    numbers = list(map(int, pairs.split()))
    return [{"lat": a, "lon": b} for a, b in zip(numbers[::2], numbers[1::2], strict=True)]


def _in_range(points: list[dict]) -> bool:
    return all(p["lat"] <= 9000 and p["lon"] <= 18100 for p in points)


def polygon(lines: list[str]) -> dict | None:
    """The first LAT...LON line with the lines of digits that follow it, in hundredths of a degree."""
    for i, line in enumerate(lines):
        if line.startswith("LAT...LON"):
            text = line
            for more in lines[i + 1 :]:
                if not _DIGITS.match(more):
                    break
                text += "\n" + more
            m = _LAT_LON.match(text)
            points = _points(m[1]) if m else []
            if not m or not _in_range(points):
                raise Malformed("LAT...LON")
            return {"raw": text, "points": points}
    return None


def motion(lines: list[str]) -> dict | None:
    for line in lines:
        if line.startswith("TIME...MOT...LOC"):
            m = _MOTION.match(line)
            points = _points(m[4]) if m else []
            if not m or not _in_range(points):
                raise Malformed("TIME...MOT...LOC")
            return {"raw": line, "time": m[1] + "Z", "direction_degrees": int(m[2]), "speed_knots": int(m[3]), "locations": points}
    return None


@lru_cache(1 << 16)
def _in_calendar(time: str) -> bool:
    """Whether YYMMDDThhmmZ is unspecified or a time."""
    if time == "000000T0000Z":
        return True
    try:
        datetime(2000 + int(time[:2]), int(time[2:4]), int(time[4:6]), int(time[7:9]), int(time[9:11]))
    except ValueError:
        return False
    return True


def coded(lines: list[str]) -> tuple[list[dict], list[dict], list[str]]:
    """P-VTEC codes at the head of a segment, the H-VTEC codes after them, and the rest. Blank lines between are skipped."""
    found: tuple[list[dict], list[dict]] = ([], [])
    at = 0
    for pattern, names, first, out in ((_P, P_CODE.names, 6, found[0]), (_H, H_CODE.names, 3, found[1])):
        while at < len(lines):
            line = lines[at].strip(_SPACE)
            m = pattern.match(line)
            if m and all(map(_in_calendar, m.groups()[first : first + (3 if pattern is _H else 2)])):
                out.append(dict(zip(names, (line, *m.groups()), strict=True)))
            elif line:
                break
            at += 1
    for code in found[0]:
        code["etn"] = int(code["etn"])
    return *found, lines[at:]


#: Fields of segments that need no codes.
_CODELESS = frozenset(("ugc", "ugcs", "dollars", "ampersands", "lat_lon", "motion"))


def completed(segment: dict, wanted: frozenset[str] | None, coded_too: bool = True) -> dict:
    """A segment with its codes, geometry and tags. Polygon and motion are read whatever is wanted, as a bad one rejects the product;
    codes stand before both, so they are read where a wanted field, or the caller, needs them."""
    lines = segment["lines"]
    if wanted is None or "ampersands" in wanted:
        segment["ampersands"] = any(x.strip(_SPACE) == "&&" for x in lines)
    if not coded_too and wanted is not None and wanted <= _CODELESS:
        plain = [x.strip(_SPACE) for x in lines]
        segment["lat_lon"], segment["motion"] = polygon(plain), motion(plain)
        return segment
    segment["pvtec"], segment["hvtec"], segment["lines"] = coded(lines)
    plain = [x.strip(_SPACE) for x in segment["lines"]]
    segment["headline"] = next(filter(None, plain), None)
    segment["lat_lon"], segment["motion"] = polygon(plain), motion(plain)
    if wanted is None or wanted & {"tags", "text_tags"}:
        segment["tags"], segment["text_tags"] = tags.rolled_up(segment["lines"], [c["phenomenon"] for c in segment["pvtec"]])
    segment["actions"] = tags.actions(segment["pvtec"]) if wanted is None or "actions" in wanted else None
    return segment


def segments(body: str, wanted: frozenset[str] | None = None, coded_too: bool = True) -> tuple[str | None, list[dict]]:
    """The first preamble line, and the segments."""
    lines = [x.rstrip("\r") for x in body.split("\n")]
    header, found, own, at = None, [], None, 0
    while at < len(lines):
        line = lines[at].strip(_SPACE)
        if line and _BLOCK.match(line) and (hit := block(lines, at)):
            at, text, codes = hit
            own = {"ugc": text, "ugcs": codes, "lines": [], "dollars": False}
            found.append(own)
            continue
        if own is not None:
            if line == "$$":
                own["dollars"], own = True, None
            else:
                own["lines"].append(lines[at])
        elif line and header is None:
            header = line
        at += 1
    return header, [completed(x, wanted, coded_too) for x in found]


#: Beginnings of lines that tell how many segments a body has and whether they are sound: geography, `$$`, polygon and motion.
_MARK = re.compile(r"\n[ \t\r\f]*(?:([A-Z]{2}[CZ](?:[0-9]{3}|ALL)[->0-9])|(\$\$)[ \t\r\f]*(?![^\n])|(LAT\.\.\.LON)|TIME\.\.\.MOT\.\.\.LOC)")
#: Polygons and motions as most texts have them, in range and not followed by more digits. Others are judged by polygon() and motion().
_LAT, _LON = "(?:[0-8][0-9]{3}|9000)", "(?:0?[0-9]{4}|1[0-7][0-9]{3}|180[0-9]{2}|18100)"
_GAP, _END = r"(?:[ \t\f]+|[ \t\r\f]*\n[ \t\r\f]*)", r"[ \t\r\f]*(?![^\n])"
_SOUND_POLYGON = re.compile(rf"LAT\.\.\.LON(?:{_GAP}{_LAT}{_GAP}{_LON}){{1,20}}{_END}(?!\n[ \t\r\f]*[0-9])")
_SOUND_MOTION = re.compile(rf"TIME\.\.\.MOT\.\.\.LOC[ ]+(?:[01][0-9]|2[0-3])[0-5][0-9]Z[ ]+(?:[0-2][0-9]{{2}}|3[0-5][0-9]|360)DEG[ ]+[0-9]{{1,2}}KT(?:[ ]+{_LAT}[ ]+{_LON}){{1,255}}{_END}")
#: A line, with the lines of digits that follow it.
_AND_DIGITS = re.compile(r"[^\n]*(?:\n[ \t\r\f]*[0-9][0-9 \t\r\f]*(?![^\n]))*")
#: Fields of segments that outlined() gives.
_OUTLINE = frozenset(("dollars",))


def outlined(body: str) -> tuple[str | None, list[dict]]:
    """What segments() says of the first preamble line, of the number of segments, of whether `$$` ends them, and of malformed polygons and
    motions. The body is searched for the lines that decide it; the others are not looked at."""
    text = "\n" + body
    found: list[dict] = []
    shapes: list[list[int | None]] = []  # where a segment's polygon and motion begin
    gaps, gap, own, ahead = [], 0, None, 0
    for m in _MARK.finditer(text):
        at = m.start()
        if at < ahead:
            continue  # within a geography block
        kind = m.lastindex
        if kind == 1:
            lines = [text[at + 1 :].partition("\n")[0]]
            if not (hit := block(lines, 0)) and lines[0].rstrip(_SPACE).endswith("-"):
                lines = text[at + 1 :].split("\n")
                hit = block(lines, 0)
            if hit:
                if own is None:
                    gaps.append((gap, at))
                own = {"dollars": False}
                found.append(own)
                shapes.append([None, None])
                ahead = at + hit[0] + sum(map(len, lines[: hit[0]]))
        elif own is None:
            continue
        elif kind == 2:
            own["dollars"], own, gap = True, None, m.end()
        elif shapes[-1][kind is None] is None:
            shapes[-1][kind is None] = m.end() - (9 if kind else 16)
    if own is None:
        gaps.append((gap, len(text)))
    for area, move in shapes:
        if area is not None and not _SOUND_POLYGON.match(text, area):
            polygon([x.strip(_SPACE) for x in _AND_DIGITS.match(text, area)[0].split("\n")])
        if move is not None and not _SOUND_MOTION.match(text, move):
            motion([text[move:].partition("\n")[0].strip(_SPACE)])
    plain = next(filter(None, (text[a:b].strip(_SPACE) for a, b in gaps)), None)
    return plain and plain.partition("\n")[0].strip(_SPACE), found


def parse(raw: str | None, wanted: frozenset[str] | None = None) -> dict:
    """A text's bulletin and segments; one malformed polygon or motion line rejects all of it. wanted: fields of segments (all)."""
    out = wire.read(raw) | {"mnd_header": None, "first_code": None, "parts": None}
    if out["error_kind"] is None:
        try:
            # The first code tells the family of a product without identifier.
            coded_too = wanted is None or out["nnn"] is None
            if wanted is not None and wanted <= _OUTLINE and not coded_too:
                out["mnd_header"], out["parts"] = outlined(out["body"])
                return out
            out["mnd_header"], out["parts"] = segments(out["body"], wanted, coded_too)
            out["first_code"] = next((c for s in out["parts"] for c in s.get("pvtec", ())), None)
        except Malformed as e:
            out.update(error_kind="InvalidField", error_field=str(e))
    return out


def _each(digest: Callable[[list[bytes]], list[str]], texts: list[bytes | None]) -> list[str | None]:
    """Digests of many texts; null stays null."""
    found = iter(digest([t for t in texts if t is not None]))
    return [t if t is None else next(found) for t in texts]


@cache
def parser(columns: tuple[str, ...] | None = None, parts: tuple[str, ...] | None = None):
    """parse() of a text column that returns the named fields of bulletins and of their segments, or all of them, and DIGESTS that are named.
    Texts are long beside what most reports read of them, so what is not named is neither made nor sent."""
    fields = [f for f in BULLETIN if f.name != "parts" and (columns is None or f.name in columns)]
    if parts != ():
        fields.append(T.StructField("parts", T.ArrayType(T.StructType([f for f in _SEGMENT if parts is None or f.name in parts]))))
    digests = [d for d in DIGESTS if columns is not None and d in columns]
    plain, shape = T.StructType(fields), T.StructType(fields + [T.StructField(d, T.StringType()) for d in digests])
    wanted = None if parts is None else frozenset(parts)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = to_arrow_type(plain)
        for texts in batches:
            # What is parsed weighs many times what it is as a column, so only some texts are held so.
            made, own = [], []
            for at in range(0, max(1, len(texts)), TEXTS):
                rows = [parse(t, wanted) for t in texts.slice(at, TEXTS).to_pylist()]
                made.append(pa.array(rows, kind))
                if digests:
                    own += [b if b is None else b.encode() for b in (r["bulletin"] for r in rows)]
            out = pa.concat_arrays(made)
            if digests:
                said = {"digest": lambda: _each(hashing.fnv1a_hex, own), "text_digest": lambda: [b if b is None else hashlib.sha256(b).hexdigest() for b in own], "raw_digest": lambda: _each(hashing.fnv1a_hex, [t if t is None else t.encode() for t in texts.to_pylist()])}
                out = pa.StructArray.from_arrays([*out.flatten(), *(pa.array(said[d](), pa.string()) for d in digests)], names=shape.names)
            yield out

    # Filters on parsed columns would otherwise be pushed below the call and make it run again for each of them.
    return F.arrow_udf(run, shape).asNondeterministic()


parsed = parser()

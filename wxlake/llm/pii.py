"""Personal data by weak supervision: emails, IP addresses, payment cards and phone numbers.

One pass over the whole texts finds base spans (strict patterns and checks, always kept) and wider
candidates (also inside runs of digits that fail as a whole), and lets four labelers vote on each: the
strict pattern, a value check (ranges, check digit, digit count), a gazetteer (top-level domains, issuer and area prefixes) and the context (cue words before
the span, boundaries). A labeler votes yes (1), no (0) or abstains (-). Spark counts the vote patterns;
expectation-maximisation estimates each labeler's reliability for both classes from the counts, and its
posteriors train a logistic span classifier over votes and shape. Wider candidates that the classifier
accepts become spans too. Patterns and shapes are categories of a closed set, so the counts that reach
the driver do not grow with the corpus.

Base spans are leftmost, non-overlapping per kind; offsets are code points, the end is exclusive.
Defined cases: a null text is empty and has no spans; repeated rows and null ids yield a row each; extra
columns are ignored. Matching is linear in the text's length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "value", "gazetteer", "context")
SPANS = "array<struct<kind:string,start:long,end:long,base:boolean,votes:string,shape:string>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.string()), ("shape", pa.string())]))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits fails or matches as a whole, so only its first digit is tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SOME = re.compile(r"[0-9@]|[\[(]at[\])]", re.IGNORECASE)
_AT = re.compile(r"[\[(]at[\])]", re.IGNORECASE)
_SPELLED = re.compile(r"(?<![\w.])[A-Za-z0-9._-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]{1,63}){1,4}", re.IGNORECASE)
_INTERNATIONAL = re.compile(r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[\x20.-][0-9]{2,4}){2,3}(?![0-9])")
_NATIONAL = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_DIGIT = re.compile(r"[0-9]")
_GROUP = re.compile(r"[0-9]+")
# The usual groups of a card number: none, fours, or 4-6-4 and 4-6-5.
_PRINTED = re.compile(r"[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){2,3}(?:[\x20-][0-9]{1,3})?|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{4,5}")

# Fixed values of the gazetteers.
TOP_LEVEL = frozenset("com net org edu gov mil int info biz io co uk de fr es it nl eu ch at be pl ru cn jp kr in br au ca us me dev app example test".split())
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65", "22", "35", "30", "36", "38")
CUES = {
    "email": re.compile(r"(?:e-?mail|mail|contact|write|address|courriel|correo)\W*\Z", re.IGNORECASE),
    "ip": re.compile(r"(?:\bip|server|host|address|addr|login|from)\W*\Z", re.IGNORECASE),
    "card": re.compile(r"(?:card|visa|master|credit|payment|karte|carte|tarjeta)\W*\Z", re.IGNORECASE),
    "phone": re.compile(r"(?:phone|tel|call|fax|mobile|telefon|téléphone|teléfono)\W*\Z", re.IGNORECASE),
}
AGAINST = re.compile(r"(?:\b(?:version|release|order|invoice|isbn|issn|section|no|nr)|§)\W*\Z", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at)
        at = text.find("@", max(at + 1, done))


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def _good_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def _good_card(s: str) -> bool:
    d = _digits(s)
    return 13 <= len(d) <= 19 and luhn(d)


def _series(at: int, run: str) -> Iterator[tuple[int, int]]:
    """Series of whole digit groups of 13 to 19 digits, at most seven from each group."""
    groups = [m.span() for m in _GROUP.finditer(run)]
    for i, (start, _) in enumerate(groups):
        n = 0
        for a, end in groups[i : i + 19]:
            n += end - a
            if n > 19:
                break
            if n >= 13:
                yield at + start, at + end


def _good_phone(s: str) -> bool:
    return 9 <= len(_digits(s)) <= 15


def find(text: str) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    """Base spans by kind, and the wider candidates."""
    base: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    wide: list[tuple[str, int, int]] = []
    if not _SOME.search(text):
        return base, wide
    if "@" in text:
        base["email"] = list(_emails(text))
    if _DIGIT.search(text):
        for kind, pattern, good in (("ip", _IP, _good_ip), ("card", _CARD, _good_card), ("phone", _PHONE, _good_phone)):
            for m in pattern.finditer(text):
                if good(m[0]):
                    base[kind].append(m.span())
                elif kind == "phone":  # it may have run into other numbers
                    wide += [("phone", m.start() + a.start(), m.start() + a.end()) for a in _INTERNATIONAL.finditer(m[0])]
                elif kind == "card":  # so may a card
                    whole = [m.span()] if len(_digits(m[0])) == 12 else []
                    wide += [("card", *s) for s in (*whole, *_series(m.start(), m[0]))]
                else:
                    wide.append((kind, *m.span()))
        wide += [("phone", *m.span()) for m in _NATIONAL.finditer(text)]
    if _AT.search(text):
        wide += [("email", *m.span()) for m in _SPELLED.finditer(text)]
    out, held = [], {k: iter(v) for k, v in base.items()}
    ahead = {k: next(v, None) for k, v in held.items()}
    for kind, start, end in sorted(wide, key=lambda s: s[1]):
        while ahead[kind] and ahead[kind][1] <= start:
            ahead[kind] = next(held[kind], None)
        if not ahead[kind] or ahead[kind][0] >= end:
            out.append((kind, start, end))
    return base, out


def _gazetteer(kind: str, s: str) -> str:
    if kind == "email":
        return "1" if re.split(r"\W+", s.lower().rstrip(")] "))[-1] in TOP_LEVEL else "0"
    if kind == "card":
        return "1" if _digits(s).startswith(ISSUERS) else "0"
    if kind == "phone":
        return "1" if "555" in s or s.startswith("+") else "-"
    return "0" if s.startswith(("0.", "127.", "255.")) else "-"


def votes(text: str, kind: str, start: int, end: int, base: bool) -> tuple[str, str]:
    """The labelers' votes, and the span's shape."""
    s = text[start:end]
    value = {"email": lambda: "1" if len(s) <= 254 else "0", "ip": lambda: "1" if _good_ip(s) else "0", "card": lambda: "1" if _good_card(s) else "0", "phone": lambda: "1" if 7 <= len(_digits(s)) <= 15 else "0"}[kind]()
    before = text[max(0, start - 24) : start]
    context = "0" if AGAINST.search(before) else "1" if CUES[kind].search(before) else "-"
    left, right = text[start - 1 : start], text[end : end + 1]
    edge = "".join("e" if not c else "s" if c.isspace() else "w" if c.isalnum() else "p" for c in (left, right))
    if context == "-" and "w" in edge:
        context = "0"
    n = len(_digits(s))
    shape = f"{edge}{'0' if not n else 's' if n < 7 else 'm' if n < 13 else 'l'}{'x' if ' ' in s else '-' if '-' in s else '.'}"
    strict = base or kind == "card" and bool(_PRINTED.fullmatch(s)) and _good_card(s)  # inside a longer run
    return ("1" if strict else "0") + value + _gazetteer(kind, s) + context, shape


def spans_of(text: str | None) -> list[tuple[str, int, int, bool, str, str]]:
    """All candidates by kind, then start."""
    if not text:
        return []
    base, wide = find(text)
    every = [(k, a, b, True) for k in KINDS for a, b in base[k]] + [(*w, False) for w in wide]
    every.sort(key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
    return [(*x, *votes(text, *x)) for x in every]


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and the candidate spans of every document."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in _SPANS.value_type]
        for batch in batches:
            found = [[dict(zip(names, s, strict=True)) for s in spans_of(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPANS)], names=["doc_id", "found"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).transform(common.mapped, run, f"doc_id {kind}, found {SPANS}")


@dataclass
class Model:
    """reliability: kind -> (share of true spans, yes-or-no tables per labeler); accepts: probability by
    kind, votes and shape."""

    reliability: dict[str, tuple[float, np.ndarray]] = field(default_factory=dict)
    accepts: dict[tuple[str, str, str], float] = field(default_factory=dict)

    def keep(self, span: tuple) -> bool:
        return span[3] or self.accepts.get((span[0], span[4], span[5]), 0.0) >= 0.5


def em(patterns: list[str], counts: np.ndarray, rounds: int = 100) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of true spans, table[class, labeler, vote] of vote probabilities (votes 0, 1, -), and each
    pattern's posterior of being true; starts from the majority of the votes."""
    vote = np.array([["01-".index(v) for v in p] for p in patterns])
    post = np.clip(((vote == 1).sum(1) + 0.5) / ((vote < 2).sum(1) + 1), 0.05, 0.95)
    one_hot = np.eye(3)[vote]  # pattern, labeler, vote
    for _ in range(rounds):
        weight = np.stack([counts * (1 - post), counts * post])
        table = np.einsum("cp,plv->clv", weight, one_hot) + 0.5
        table /= table.sum(2, keepdims=True)
        prior = (weight[1].sum() + 1) / (weight.sum() + 2)
        logs = np.einsum("clv,plv->cp", np.log(table), one_hot) + np.log([[1 - prior], [prior]])
        post = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
    return float(prior), table, post


def _design(keys: list[tuple[str, str, str]]) -> np.ndarray:
    names = sorted({f"{i}{v}" for _, p, _ in keys for i, v in enumerate(p)} | {f"s{i}{c}" for _, _, s in keys for i, c in enumerate(s)})
    at = {n: i for i, n in enumerate(names)}
    x = np.zeros((len(keys), len(names) + 1))
    x[:, -1] = 1
    for r, (_, p, s) in enumerate(keys):
        for n in [f"{i}{v}" for i, v in enumerate(p)] + [f"s{i}{c}" for i, c in enumerate(s)]:
            x[r, at[n]] = 1
    return x


def _logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 0.5, rounds: int = 25) -> np.ndarray:
    """Weights that fit soft targets, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (p - target)) + ridge * w)
        w -= np.clip(step, -5, 5)
    return w


def fit(found: DataFrame) -> Model:
    """Reliabilities and the span classifier, from the counts of votes and shapes in candidates()."""
    rows = found.select(F.explode("found").alias("s")).groupBy("s.kind", "s.votes", "s.shape").count().collect()  # a closed set of categories
    model = Model()
    for kind in KINDS:
        own = sorted((r["votes"], r["shape"], r["count"]) for r in rows if r["kind"] == kind)
        if not own:
            continue
        patterns = sorted({v for v, _, _ in own})
        counts = np.array([sum(n for v, _, n in own if v == p) for p in patterns], float)
        prior, table, post = em(patterns, counts)
        model.reliability[kind] = (prior, table)
        keys = [(kind, v, s) for v, s, _ in own]
        x, n = _design(keys), np.array([c for _, _, c in own], float)
        w = _logistic(x, np.array([post[patterns.index(v)] for v, _, _ in own]), n / n.mean())
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        model.accepts |= dict(zip(keys, map(float, p), strict=True))
    return model


def personal_data(docs: DataFrame) -> tuple[DataFrame, Model]:
    """doc_id, base and spans (arrays of kind, start, end as structs) of every document, and the model."""
    found = common.written(candidates(docs), "spans")
    model = fit(found)
    kind = dict(docs.dtypes)["doc_id"]
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"doc_id": batch.column(0).to_pylist(), **{f"n_{k}": [] for k in KINDS}, "base": [], "spans": []}
            for doc in batch.column(1).to_pylist():
                spans = [tuple(s.values()) for s in doc]
                base = [s for s in spans if s[3]]
                for k in KINDS:
                    out[f"n_{k}"].append(sum(s[0] == k for s in base))
                out["base"].append(joined(base))
                out["spans"].append(joined([s for s in spans if held.value.keep(s)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[f"n_{k}"], pa.int64()) for k in KINDS), pa.array(out["base"], pa.string()), pa.array(out["spans"], pa.string())], names=list(out))

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return found.transform(common.mapped, run, f"doc_id {kind}, {counts}, base string, spans string"), model


def masked(text: str | None, model: Model) -> str | None:
    """The text with every span replaced by its kind; overlapping spans become one, named by the first."""
    if not text:
        return text
    spans = sorted((s for s in spans_of(text) if model.keep(s)), key=lambda s: (s[1], -s[2]))
    if not spans:
        return text
    out, at = [], 0
    for kind, start, end, *_ in spans:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with personal data masked and n_chars, where there is one, brought up to date."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([masked(t, held.value) for t in batch.column(place).to_pylist()], batch.schema.field(place).type)
            yield batch.set_column(place, batch.schema.field(place), text)

    out = docs.transform(common.mapped, run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out



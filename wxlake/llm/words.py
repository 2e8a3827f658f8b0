"""Token ids of words and other pieces of text, kept by each Python worker.

The tokenizer drops white space and never merges across it, so a text's ids are those of its words one
after the other. Texts with white space beyond blanks, tabs and line ends are encoded whole.

Defined cases: a null or empty text has no ids; repeated texts have equal ids; a word of any length is one entry.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable

import numpy as np

RARE_SPACE = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Words of a generation: the two last generations are kept, and a word that is met again stays.
GENERATION = 200_000


#: Letters of lower-cased Latin text; a run of them is one piece to the tokenizer, and so is what lies between.
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u024f"
_LETTERS = re.compile(rf"[{_LETTERS}]+"), re.compile(rf"[{_LETTERS}]+|[^{_LETTERS}\s]+")
#: Apostrophes begin pieces of their own, and beyond Latin other rules hold.
_ODD = re.compile(r"['\u0250-\U0010ffff]")


def pieces(text: str) -> list[str]:
    """Strings that the tokenizer encodes one after the other: runs of letters, what lies between, and whole words
    with signs for which that does not hold."""
    low = text.lower()
    if not _ODD.search(low):
        return _LETTERS[1].findall(low)
    out: list[str] = []
    for w in text.split():
        low = w.lower()
        out += [w] if _ODD.search(low) else _LETTERS[1].findall(low)
    return out


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Words:
    """What `make` gives for the ids of pieces.

    A run of Latin letters is one piece to the tokenizer, so it goes straight to the same merges without the
    tokenizer's patterns. All other pieces take the tokenizer itself.
    """

    def __init__(self, path: str, make: Callable) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.make = make
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}
        self.letters = _byte_letters()
        self.merges = Tokenizer.from_file(path)
        self.merges.no_truncation()
        self.merges.no_padding()
        self.merges.normalizer = normalizers.Sequence([])
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        probe = ["storm", "straße", "éclair", "mañana", "x", "zzzzqqq"]
        self.direct = self._merged([p.lower() for p in probe]) == self.ids(probe)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, words: list[str]) -> list[list[int]] | None:
        """Ids of lower-case words of letters; None if their ends cannot be told apart."""
        lines = []
        for i in range(0, len(words), 500):
            line = " ".join(words[i : i + 500])
            lines.append(line if line.isascii() else line.encode().decode("latin-1").translate({b: c for b, c in self.letters.items() if b != 32}))
        out = []
        for e in self.merges.encode_batch_fast(lines, add_special_tokens=False):
            ids, start = e.ids, 0
            for end in (np.flatnonzero(self.ends[ids]) + 1).tolist():
                out.append(ids[start:end])
                start = end
        return out if len(out) == len(words) else None

    def _fresh(self, new: list[str]) -> dict[str, object]:
        runs = [w for w in new if _LETTERS[0].fullmatch(w) and w == w.lower()] if self.direct else []
        merged = self._merged(runs) if runs else []
        if merged is None:
            runs, merged = [], []
        out = dict(zip(runs, map(self.make, merged), strict=True))
        rest = [w for w in new if w not in out]
        out.update(zip(rest, map(self.make, self.ids(rest)), strict=True))
        return out

    def look_up(self, words: list[str]) -> list:
        """The made values of pieces, in order."""
        missing = [w for w in dict.fromkeys(words) if w not in self.young]
        if missing:
            known = {w: v for w in missing if (v := self.old.get(w)) is not None}
            known.update(self._fresh([w for w in missing if w not in known]))
            self.young.update(known)
        found = list(map(self.young.__getitem__, words))
        if len(self.young) > GENERATION:
            self.old, self.young = self.young, {}
        return found


def whole(text: str) -> bool:
    """Whether a text must be encoded in one go: unusual white space, or what may be a special token."""
    return "<|" in text or RARE_SPACE.search(text) is not None


_bytes: dict[str, Words] = {}


def _little(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def bytes_of(path: str, texts: list[str | None]) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit bytes."""
    if path not in _bytes:
        _bytes[path] = Words(path, _little)
    words = _bytes[path]
    plain = [[] if not t or whole(t) else pieces(t) for t in texts]
    made = words.look_up([w for own in plain for w in own])
    out, at = [], 0
    for text, own in zip(texts, plain, strict=True):
        out.append(b"".join(made[at : at + len(own)]) if own or not text else _little(words.ids([text])[0]))
        at += len(own)
    return out

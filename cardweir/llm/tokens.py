"""Token ids of whole texts by a tokenizer file, as little-endian unsigned 32-bit bytes."""

from __future__ import annotations

import gc
import os
import re

import numpy as np
import pyarrow as pa

TOKENIZER = "byte_bpe_50k.json"
#: Pieces of text whose ids a worker remembers, and the longest such piece. More memory saves time; ``MANY``
#: is for jobs that do little besides.
REMEMBERED, MANY, REMEMBERED_CHARS = 150_000, 600_000, 60
#: Marks that end words, which the vocabulary's pattern never joins to letters.
_MARKS = ".,;:!?#$%&*|"
_TOGETHER = 1000

_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes by the pieces between single spaces.

    The vocabulary's pattern never joins what stands before a space between two visible characters
    with what comes after, so the ids of a text are those of its pieces, each with the space before
    it. For the same reason letters and the marks after them, and what a single line feed parts, are pieces of
    their own. Words recur, so most pieces are looked up. Texts with other spacing are cut at such spaces only.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        self.remembered = remembered
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # such strings in a text are ordinary text
        self.line = self._ids(["\n"])[0]
        self.known: dict[str, bytes] = {}  # ids of pieces after a space
        self.bare: dict[str, bytes] = {"": b""}  # and of pieces without one
        self.composed: list[str] = []  # known pieces that others make up: the first to be forgotten

    def _ids(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]

    def _words(self, words: list[str], space: str) -> list[bytes]:
        """Ids of pieces without white space: many at a time, parted by line feeds, which keep their own id."""
        out = []
        for at in range(0, len(words), _TOGETHER):
            part = words[at : at + _TOGETHER]
            raw = self._ids(["\n".join([space + w for w in part])])[0]
            cuts = (np.flatnonzero(np.frombuffer(raw, "<u4") == int.from_bytes(self.line, "little")) * 4).tolist()
            out += [raw[x:y] for x, y in zip([0, *[c + 4 for c in cuts]], [*cuts, len(raw)], strict=True)]
        return out

    def _learn(self, pieces: list[str]) -> None:
        """Put the ids of new pieces into ``known``."""
        words: set[str] = set()
        bare: set[str] = set()
        plans: list[tuple[str, list[tuple[str, str]]]] = []
        whole = []
        for p in pieces:
            if p.isalpha():
                words.add(p)
                continue
            stem = p.rstrip(_MARKS)
            if stem.isalpha():
                parts = [(stem, p[len(stem) :])]
            else:
                lines = p.split("\n")
                if any(not x or x.split() != [x] for x in lines):
                    whole.append(p)  # other white space in it
                    continue
                parts = []
                for x in lines:
                    stem = x.rstrip(_MARKS)
                    parts.append((stem, x[len(stem) :]) if stem.isalpha() else (x, ""))
                bare.update([stem for stem, _ in parts[1:]])
                bare.update([marks for _, marks in parts[1:]])
            plans.append((p, parts))
            words.add(parts[0][0])
            bare.add(parts[0][1])
        for table, new, space in ((self.known, words, " "), (self.bare, bare, "")):
            missing = [w for w in new if w not in table]
            table.update(zip(missing, self._words(missing, space), strict=True))
        for p, parts in plans:
            ids = self.known[parts[0][0]] + self.bare[parts[0][1]]
            for stem, marks in parts[1:]:
                ids += self.line + self.bare[stem] + self.bare[marks]
            self.known[p] = ids
        self.composed += [p for p, parts in plans if parts[0][0] != p]
        self.known.update(zip(whole, self._ids([" " + p for p in whole]), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; none for null and empty ones."""
        was_on = gc.isenabled()
        gc.disable()  # millions of short-lived strings and no cycles
        try:
            return self._encode(texts)
        finally:
            if was_on:
                gc.enable()

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        known = self.known
        if len(known) > self.remembered:
            for p in self.composed:
                del known[p]
            self.composed = []
            if len(known) > 0.9 * self.remembered:
                known.clear()
        if len(self.bare) > self.remembered:
            self.bare = {"": b""}
        split = [(t or "").split(" ") for t in texts]
        new: set[str] = set()
        for parts in split:
            new.update(parts)
        new = {p for p in new if p not in known}
        odd = {p for p in new if not p or p[0].isspace() or p[-1].isspace()}
        if odd:
            new = set()
            for i, parts in enumerate(split):
                if not odd.isdisjoint(parts):
                    split[i] = _SAFE_SPACE.split(texts[i] or "")
                new.update(split[i][1:])
            new = {p for p in new if p not in known}
        once = [p for p in new if len(p) > REMEMBERED_CHARS]
        self._learn([p for p in new if len(p) <= REMEMBERED_CHARS])
        known.update(zip(once, self._ids([" " + p for p in once]), strict=True))
        heads = self._ids([parts[0] for parts in split])
        out = [h + b"".join(map(known.__getitem__, parts[1:])) for h, parts in zip(heads, split, strict=True)]
        for p in once:
            del known[p]
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder; tasks of one worker share it."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget(remembered: int) -> None:
    """At the end of a task: drop this worker's encoders, unless it is to remember much for a job of its own."""
    if remembered <= REMEMBERED:
        _ENCODERS.clear()


def encode_column(texts: pa.Array, path: str, remembered: int = REMEMBERED) -> list[bytes]:
    own = encoder(path)
    own.remembered = remembered
    return own.encode(texts.to_pylist())

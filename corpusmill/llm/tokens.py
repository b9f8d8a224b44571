"""Token ids of a public byte-level vocabulary, by tokenizers.

A byte-level vocabulary splits a text before it merges, and always where white space follows something else. So the ids of a
text are those of its pieces, each white space with what stands after it, one after another. tokenizers encodes each
different piece once for a worker; what it gave is kept while there is room. A piece of any length is one call, so texts
without white space, or of white space alone, take tokenizers' own time.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from struct import pack

import numpy as np

#: Pieces that a worker remembers, and the longest of them in characters.
KEPT, SHORT = 1_000_000, 24
#: Characters of text that are encoded together.
TOGETHER = 1 << 19

# U+180E was white space in old Unicode tables. All that any table takes for white space is here, so a boundary is sure.
_PIECE = re.compile(r"[\s᠎]*[^\s᠎]+|[\s᠎]+")


def public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _head(piece: str) -> str | None:
    """What stands before the full stops and commas that end a piece, where it ends in a letter of a table's first pages: a sure boundary too."""
    if piece[-1] in ".,":
        head = piece.rstrip(".,")
        if head and head[-1] < "\u0250" and head[-1].isalpha():
            return head
    return None


class Encoder:
    def __init__(self, vocabulary: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary or public("byte_bpe_50k.json"))
        self.known: dict[str, bytes] = {}

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [pack(f"<{len(ids)}I", *ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) for ids in (e.ids,)]

    def batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        group: list[str] = []
        size = 0
        for t in texts:
            group.append(t)
            size += len(t)
            if size > TOGETHER:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]) -> list[np.ndarray]:
        """Without the collector of cycles, which would look at every list of pieces and find none."""
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._encoded(texts)
        finally:
            if collecting:
                gc.enable()

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        known = self.known
        cut, holes_in, n = [], set(), 0
        for t in texts:
            pieces = _PIECE.findall(t)
            ids = list(map(known.get, pieces))
            holes = [i for i, x in enumerate(ids) if x is None] if None in ids else ()
            own = [pieces[i] for i in holes]
            holes_in.update(own)
            n += len(pieces)
            cut.append((ids, holes, own))
        if len(known) > KEPT and 3 * sum(len(holes) for _, holes, _ in cut) > n:  # another language
            known.clear()
        parted = {p: h for p in holes_in if (h := _head(p))}
        order = list({x for p in holes_in for x in ((parted[p], p[len(parted[p]) :]) if p in parted else (p,)) if x not in known})
        found = dict(zip(order, self._raw(order), strict=True)) if order else {}
        part = lambda x: known[x] if x in known else found[x]
        whole = {p: part(h) + part(p[len(h) :]) for p, h in parted.items()}
        again = [p for p, h in parted.items() if h in known]
        out = []
        for ids, holes, own in cut:
            for i, p in zip(holes, own, strict=True):
                ids[i] = whole[p] if p in whole else found[p]
            out.append(np.frombuffer(b"".join(ids), "<u4"))
        if len(known) <= KEPT:
            known.update((p, whole[p]) for p in again if len(p) <= SHORT)
            known.update((p, ids) for p, ids in found.items() if len(p) <= SHORT)
        return out

    def ids(self, text: str) -> np.ndarray:
        return next(self.batch([text]))


_made: dict[str | None, Encoder] = {}


def encoder(vocabulary: str | None = None) -> Encoder:
    """One for each Python worker; it runs in the worker's own thread."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if vocabulary not in _made:
        _made[vocabulary] = Encoder(vocabulary)
    return _made[vocabulary]

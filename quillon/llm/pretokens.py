"""Cutting a text where byte-level BPE can never join: before each run of plain white space.

The pre-token pattern takes white space only at the start of a match, so a cut between a
character that isn't white space and one that is never falls inside a match, and what
follows doesn't depend on what came before.  Chunks repeat far more often than texts, so
what is known of a chunk is kept in a table of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from typing import Any

import numpy as np

PLAIN = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
#: Other white space, before which a cut isn't safe: such a text is handled whole.
OTHER = re.compile("[\x0b\x0c\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
MAX_ENTRIES, MAX_LENGTH = 300_000, 64
#: Bits that say which chunks were met before; only what is met again enters the table.
MET_BITS = 1 << 23


class Table:
    """What `work` gives for each chunk, kept for short ones until the table is full.  cut: the chunks of a text."""

    def __init__(self, work: Callable[[list[str]], list[Any]], cut: Callable[[str], list[str]] = PLAIN.findall):
        self.work, self.cut, self.held = work, cut, {}
        self.met, self.n_met = np.zeros(MET_BITS, bool), 0

    def of(self, texts: Iterable[str]) -> list[list[Any]]:
        """For each text, what its chunks give, in order."""
        cut = [self.cut(t) for t in texts]
        seen = set().union(*cut)
        new = seen.difference(self.held)
        if len(self.held) + len(new) > MAX_ENTRIES:  # what this call uses again stays
            self.held = {x: self.held[x] for x in seen.difference(new)}
        odd = {x for x in new if OTHER.search(x)}
        if fresh := list(new.difference(odd) if odd else new):
            self.held.update(zip(fresh, self.work(fresh), strict=True))
        get = self.held.__getitem__
        out = [self.work(["".join(c)]) if odd and not odd.isdisjoint(c) else list(map(get, c)) for c in cut]
        if fresh:
            at = np.fromiter(map(hash, fresh), np.int64, len(fresh)) & (MET_BITS - 1)
            for k in np.flatnonzero(~self.met[at] | (np.fromiter(map(len, fresh), np.int64, len(fresh)) > MAX_LENGTH)).tolist():
                del self.held[fresh[k]]
            self.met[at] = True
            self.n_met += len(fresh)
            if self.n_met > MET_BITS // 2:
                self.met[:], self.n_met = False, 0
        return out

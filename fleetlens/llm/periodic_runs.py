"""Periodic runs of words: a suffix automaton whose links carry a link-cut tree.

Words are appended one by one to a suffix automaton.  The suffix links form a
tree in which every state remembers where its strings last ended; states with
one and the same last end form a path, kept as one splay tree (a preferred
path).  Appending word i is an access of the new state: it recolours the path
from the root with i, segment by segment.  A segment that held end e and whose
longest string has L words says: the L words that end at e end at i again, and
no longer suffix did.  If i - e <= L they overlap or touch, so the last
L + (i - e) words have the period i - e and hold a square.  That period is the
smallest one (a smaller one would have put the last end later), no word before
them keeps it (else L were larger), and the run shows up at every word from its
first square to its end.  So a run is a (start, period) with the last i that
reported it.

Only words that can lie in a run enter the automaton: a run of at least
``least`` words and two periods is covered by sequences of ``least // 2`` words
that stand twice in it.  Stretches of words so covered are found by sorting
hashes, and again inside the stretches until nothing more falls away; a
collision only lets more words in.  No run is lost and none is cut, since every
word of a run is covered.

Words are ``[^\\x20\\x09-\\x0D]+``.  A text is read by one task; memory is some
hundred bytes per word of its longest stretch.

Defined results: a null or empty text has no words, no runs and the empty kept
text.  Repeated rows and repeated ids give a row each; other columns do not
matter.  Texts whose words are all equal are one run of period 1.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import slices

Run = tuple[int, int, int]  #: start, length, period


class RunFinder:
    """The automaton, its link tree as splay trees, and the runs seen so far."""

    def __init__(self) -> None:
        # state: longest string, suffix link, first transition (further ones in ``more``)
        self.length, self.link = array("i", [0]), array("i", [-1])
        self.word, self.target = array("i", [-1]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        # splay trees by depth; the up-link of a tree's root leads to the path above it
        self.left, self.right, self.up = array("i", [-1]), array("i", [-1]), array("i", [-1])
        self.ended = array("i", [-1])  # last end, valid at the root of a splay tree
        self.last, self.n = 0, 0
        self.seen: dict[tuple[int, int], int] = {}  # (start, period): last word

    def _state(self, length: int, link: int) -> int:
        for a, x in ((self.length, length), (self.link, link), (self.word, -1), (self.target, -1), (self.left, -1), (self.right, -1), (self.up, -1), (self.ended, -1)):
            a.append(x)
        return len(self.length) - 1

    def _go(self, state: int, word: int) -> int:
        if self.word[state] == word:
            return self.target[state]
        further = self.more.get(state)
        return -1 if further is None else further.get(word, -1)

    def _lead(self, state: int, word: int, target: int) -> None:
        if self.word[state] in (word, -1):
            self.word[state], self.target[state] = word, target
        else:
            self.more.setdefault(state, {})[word] = target

    def _splay(self, x: int) -> None:
        """Make ``x`` the root of its splay tree; the last end moves with it."""
        left, right, up = self.left, self.right, self.up
        p = up[x]
        if p < 0 or (left[p] != x and right[p] != x):
            return
        while True:
            g = up[p]
            inner = g >= 0 and (left[g] == p or right[g] == p)
            if inner and (left[g] == p) == (left[p] == x):
                turns = (p, x)  # same side twice: the parent first
            else:
                turns = (x, x) if inner else (x,)
            for t in turns:
                a = up[t]
                b = up[a]
                if left[a] == t:
                    c = right[t]
                    left[a], right[t] = c, a
                else:
                    c = left[t]
                    right[a], left[t] = c, a
                if c >= 0:
                    up[c] = a
                up[a], up[t] = t, b
                if b >= 0 and left[b] == a:
                    left[b] = t
                elif b >= 0 and right[b] == a:
                    right[b] = t
                else:
                    self.ended[t] = self.ended[a]  # ``a`` was the root
            p = up[x]
            if p < 0 or (left[p] != x and right[p] != x):
                return

    def _extend(self, word: int) -> int:
        """The state of the whole prefix with ``word`` appended."""
        length, link = self.length, self.link
        new = self._state(self.n + 1, 0)
        p = self.last
        while p >= 0 and self._go(p, word) < 0:
            self._lead(p, word, new)
            p = link[p]
        if p >= 0:
            q = self._go(p, word)
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = self._state(length[p] + 1, link[q])
                self.word[twin], self.target[twin] = self.word[q], self.target[q]
                if q in self.more:
                    self.more[twin] = dict(self.more[q])
                while p >= 0 and self._go(p, word) == q:
                    self._lead(p, word, twin)
                    p = link[p]
                link[q] = link[new] = twin
                # the twin's strings ended where q's did: it joins q's path just above q
                self._splay(q)
                above = self.left[q]
                self.left[q], self.up[twin], self.left[twin] = twin, q, above
                if above >= 0:
                    self.up[above] = twin
        self.up[new] = link[new]
        self.last = new
        return new

    def append(self, word: int) -> None:
        """Append a word (a number from 0) and note the squares that end there."""
        i = self.n
        x, below = self._extend(word), -1
        left, right, up, ended, length, seen = self.left, self.right, self.up, self.ended, self.length, self.seen
        while x >= 0:
            self._splay(x)
            e = ended[x]
            cut = right[x]
            if cut >= 0:
                ended[cut] = e  # the deeper part stays a path of its own
            if e >= 0 and i - e <= length[x]:
                seen[i - length[x] - (i - e) + 1, i - e] = i
            right[x] = below
            below, x = x, up[x]
        ended[below] = i
        self.n += 1

    def runs(self, least: int) -> list[Run]:
        found = ((start, end - start + 1, period) for (start, period), end in self.seen.items())
        return sorted(((s, n, p) for s, n, p in found if n >= least), key=lambda r: (r[0], r[2]))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def stretches(words: np.ndarray, group: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches [a, b) of positions that may hold a run.

    ``words`` are numbers of words, ``group`` the text of each (ascending).
    A run's words are covered by sequences of ``least // 2`` words that occur
    twice in its stretch, so the others go, until all that stay are covered.
    """
    size = max(1, least // 2)
    kept = np.arange(len(words))
    hashed = _mix(words.astype(np.uint64) + np.uint64(1))
    while len(kept) >= size:
        # pieces: neighbours in the text that are still there
        piece = np.cumsum(np.concatenate([[0], (np.diff(kept) != 1) | (np.diff(group[kept]) != 0)]))
        sums = hashed[kept[: len(kept) - size + 1]].copy()
        for i in range(1, size):
            sums = _mix(sums) + hashed[kept[i : len(kept) - size + 1 + i]]
        whole = piece[: len(kept) - size + 1] == piece[size - 1 :]
        at = np.flatnonzero(whole)
        key = _mix(sums[at] ^ _mix(piece[at].astype(np.uint64)))
        order = np.argsort(key)
        same = np.zeros(len(at) + 1, bool)
        same[1:-1] = key[order][1:] == key[order][:-1]
        twice = at[order[same[1:] | same[:-1]]]
        cover = np.zeros(len(kept) + 1, np.int64)
        np.add.at(cover, twice, 1)
        np.add.at(cover, np.minimum(twice + size, len(kept)), -1)
        stay = np.cumsum(cover[:-1]) > 0
        length = np.diff(np.concatenate([np.flatnonzero(np.diff(piece, prepend=-1)), [len(kept)]]))
        if stay.all() and (length >= least).all():
            return [(int(kept[a]), int(kept[a]) + int(n)) for a, n in zip(np.cumsum(length) - length, length, strict=True)]
        kept = kept[stay]
        if len(kept):  # too short for a run
            piece = np.cumsum(np.concatenate([[0], (np.diff(kept) != 1) | (np.diff(group[kept]) != 0)]))
            kept = kept[np.bincount(piece)[piece] >= least]
    return []


def runs_of(texts: list[list[bytes]], least: int = 12) -> list[list[Run]]:
    """The runs of every text, by start, then period: stretches of at least
    ``least`` words and two smallest periods that no neighbour extends."""
    out: list[list[Run]] = [[] for _ in texts]
    if not texts:
        return out
    sizes = [len(t) for t in texts]
    first = np.cumsum([0, *sizes])
    number = np.fromiter((hash(w) for t in texts for w in t), np.int64, first[-1])
    group = np.repeat(np.arange(len(texts)), sizes)
    for a, b in stretches(number, group, least):
        text = int(group[a])
        shift = a - int(first[text])
        known: dict[bytes, int] = {}
        finder = RunFinder()
        for w in texts[text][shift : shift + b - a]:
            finder.append(known.setdefault(w, len(known)))
        out[text] += [(s + shift, n, p) for s, n, p in finder.runs(least)]
    return out


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words joined by one space, without those that a run holds after its
    first period."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)])


RUNS = "array<struct<start:long,length:long,period:long>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12) -> DataFrame:
    """Per row: id, n_words, ``runs`` (start, length, period; by start, then
    period) and ``kept``, the text without repeated periods."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, 1):
            texts = [(t or "").encode("utf-8", "surrogatepass").split() for t in piece.column(1).to_pylist()]
            found = runs_of(texts, least)
            kept = [collapsed(w, r).decode("utf-8", "surrogatepass") for w, r in zip(texts, found, strict=True)]
            runs = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in found]
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array([len(w) for w in texts], pa.int64()), pa.array(runs, _RUNS), pa.array(kept, pa.string())], ["id", "n_words", "runs", "kept"]
            )

    return rows.mapInArrow(work, f"id {kind}, n_words long, runs {RUNS}, kept string")


def refolded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every tenth text (by the crc32 h of its id) made periodic:
    from word a = g % n on, words repeat with period 1 + (n - a) // (3 + g % 8),
    where g = h // 10.  A null id leaves the text alone."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))

    def again(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n)
        p = F.floor((n - a) / (g % 8 + 3)) + 1
        at = F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)
        place = F.transform(at, lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
        return F.when(n > 0, F.array_join(F.transform(place, lambda i: F.get(w, i.cast("int"))), " ")).otherwise("")

    once = F.element_at(F.transform(F.array(words), again), 1)  # the words are split once
    return docs.withColumn(text_col, F.when(h % 10 == 0, once).otherwise(F.col(text_col)))

"""License scans: MinHash bands over overlapping windows, then exact shingle containment.

A template of t words is looked for in windows of W words, W the smallest power of two not
under 2 (t - 1), that start every W / 2 words: some window holds every place the template
can stand at whole. Such a window has W - 4 shingles of five words, and the template's
t - 4 are among them: a Jaccard similarity J of at least (t - 4) / (W - 4), a quarter or
more. With bands of one row, ``bands`` of them miss with chance (1 - J) ** bands, below
1e-4 for 32; for a template found to ``contain`` = 0.8 below 0.2%. A window that shares a
band with a template is compared word by word, widened by half a window on both sides, so
what is reported is exact.

Templates are few and go to all workers; texts are read once, nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame

from .common import ship, whole_ids

SHINGLE = 5
#: Lower-case letters for A-Z; what is no letter, digit or byte of a longer character parts words.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(PLAIN).split()


class Hashes(dict):
    """32-bit hashes of words, kept up to ``entries`` words."""

    entries = 500_000

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh32_intdigest(word, 0)
        return h


HASHES = Hashes()


def shingles(own: list[bytes]) -> np.ndarray:
    """A 32-bit hash of each run of five words."""
    if len(HASHES) > HASHES.entries:
        HASHES.clear()
    h = np.array(list(map(HASHES.__getitem__, own)), np.uint32)
    n = len(h) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    out = np.zeros(n, np.uint32)
    for k in range(SHINGLE):
        out = (out ^ h[k : k + n]) * np.uint32(0x9E3779B1)
        out ^= out >> np.uint32(15)
    return out


@dataclass(frozen=True)
class Template:
    name: str
    words: tuple[bytes, ...]
    shingles: frozenset[tuple[bytes, ...]]


def template(name: str, text: str) -> Template:
    own = words(text)
    if len(own) < SHINGLE:
        raise ValueError(f"template {name} has under {SHINGLE} words")
    return Template(name, tuple(own), frozenset(tuple(own[i : i + SHINGLE]) for i in range(len(own) - SHINGLE + 1)))


class Index:
    """The templates' bands by window width."""

    def __init__(self, texts: dict[str, str], bands: int, contain: float):
        rng = np.random.default_rng(17)
        self.odd = rng.integers(0, 1 << 31, bands).astype(np.uint32) * np.uint32(2) + np.uint32(1)
        self.add = rng.integers(0, 1 << 32, bands).astype(np.uint32)
        self.contain, self.by_width = contain, {}
        for name, text in sorted(texts.items()):
            t = template(name, text)
            width = 8
            while width < 2 * (len(t.words) - 1):
                width *= 2
            self.by_width.setdefault(width, []).append(t)
        self.lowest = {w: np.stack([self.mixed(shingles(list(t.words))).min(1) for t in ts], 1) for w, ts in self.by_width.items()}
        # by width and band, which low 16 bits any template has: most windows end here
        self.near = {w: np.zeros((bands, 1 << 16), bool) for w in self.by_width}
        for w, low in self.lowest.items():
            self.near[w][np.arange(bands)[:, None], low & 0xFFFF] = True

    def mixed(self, h: np.ndarray) -> np.ndarray:
        """bands x shingles: the hashes under each band's permutation."""
        x = h[None, :] * self.odd[:, None] + self.add[:, None]
        x ^= x >> np.uint32(13)
        return x

    def retrieved(self, h: np.ndarray, step: int = 1 << 16) -> set[tuple[int, int, int]]:
        """(width, template, window) that share a band, from the shingle hashes of a text.

        A window is the block of W / 2 shingles at its start and the first W / 2 - 4 of the
        next. A long text goes in steps, each with the next block of the widest window.
        """
        found, widest = set(), max(self.by_width, default=0)
        for at in range(0, len(h), step):
            part = self.mixed(h[at : at + step + widest // 2])
            for width in self.by_width:
                half = width // 2
                n = -(-part.shape[1] // half)
                x = np.full((len(part), n * half), 0xFFFFFFFF, np.uint32)
                x[:, : part.shape[1]] = part
                x = x.reshape(len(part), n, half)
                low = x.min(2)
                if half >= SHINGLE:
                    low[:, :-1] = np.minimum(low[:, :-1], x[:, 1:, : half - SHINGLE + 1].min(2))
                low = low[:, : step // half]
                band, window = np.nonzero(self.near[width][np.arange(len(low))[:, None], low & np.uint32(0xFFFF)])
                if len(band):
                    which, t = np.nonzero(low[band, window][:, None] == self.lowest[width][band])
                    found.update((width, int(j), int(w) + at // half) for j, w in zip(t, window[which]))
        return found

    def verified(self, own: list[bytes], width: int, t: int, window: int) -> list[tuple[float, int, int]]:
        """(containment, first word, end) of places of any length that hold enough of the template, within the window and half of one on both sides."""
        half, made = width // 2, self.by_width[width][t]
        a, b = max(0, (window - 1) * half), min(len(own), (window + 3) * half)
        at = [(i, s) for i in range(a, b - SHINGLE + 1) if (s := tuple(own[i : i + SHINGLE])) in made.shingles]
        out, least = [], self.contain * len(made.shingles)
        for k, (i, _) in enumerate(at):
            held = set()
            for j, s in at[k:]:
                if s not in held:
                    held.add(s)
                    if len(held) >= least:
                        out.append((len(held) / len(made.shingles), i, j + SHINGLE))
            if len(held) < least:  # nor does a later start hold enough
                break
        return out

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, containment, first word, end) of matches; places no longer than the template go first, then the best, shortest, first; each then widens to what holds more, short of the others."""
        own = words(text)
        best: dict[str, list[tuple[float, int, int]]] = {}
        for width, t, window in self.retrieved(shingles(own)):
            for share, a, b in self.verified(own, width, t, window):
                best.setdefault(self.by_width[width][t].name, []).append((-share, a, b))
        out, sizes = [], {t.name: len(t.words) for ts in self.by_width.values() for t in ts}
        for name, found in best.items():
            spans = sorted(set(found), key=lambda x: (x[2] - x[1] > sizes[name], x[0], x[2] - x[1], x[1]))
            taken: list[tuple[float, int, int]] = []
            apart = lambda x, others: all(x[2] <= y[1] or x[1] >= y[2] for y in others)
            for x in spans:
                if apart(x, taken):
                    taken.append(x)
            for k, y in enumerate(taken):
                others = taken[:k] + taken[k + 1 :]
                wider = [x for x in spans if x[1] <= y[1] and y[2] <= x[2] and apart(x, others)]
                taken[k] = min(wider, key=lambda x: (x[0], x[2] - x[1], x[1]))
            out += [(name, -share, a, b) for share, a, b in taken]
        return sorted(out, key=lambda x: (x[2], x[0]))


def scan(docs: DataFrame, templates: dict[str, str], bands: int = 32, contain: float = 0.8) -> DataFrame:
    """doc_id, license, containment, first_word, end_word of every match in every document.

    Matches hold at least ``contain`` of the template's five-word shingles. Words are runs of
    letters and digits, A-Z as lower case. Texts that are null, empty or under five words
    match nothing; whole texts are scanned, however long. Null and repeated doc_ids are rows
    like others; an empty table gives no rows; other columns are ignored.
    """
    ship(docs.sparkSession)
    index = docs.sparkSession.sparkContext.broadcast(Index(templates, bands, contain))  # as large as the templates

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(None if none else int(d), *m) for d, none, t in zip(frame["doc_id"], frame["none"], frame["text"]) if isinstance(t, str) for m in index.value.scan(t)]
            out = pd.DataFrame(rows, columns=["doc_id", "license", "containment", "first_word", "end_word"])
            out["doc_id"] = pd.array([r[0] for r in rows], "Int64")
            yield out.astype({"containment": float, "first_word": "int64", "end_word": "int64"})

    return whole_ids(docs).mapInPandas(run, "doc_id long, license string, containment double, first_word long, end_word long")

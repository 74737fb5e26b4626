"""Words of a text by a frequency dictionary: the likeliest path through the lattice of its words.

The dictionary is a trie. From each place of a run of CJK characters start all of its words, and
the character alone; of all ways through the run the one with the greatest product of
frequencies wins, found from the run's end by dynamic programming. Of equals the longer word
goes first. Other scripts' words stay whole, but dictionary words with blanks or marks in them
("power bi", "c++") are found first.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .text import normalized

#: Words that a dictionary may have, and characters of a word: what goes to the workers is bounded by these.
WORDS, LONGEST = 2_000_000, 64
#: Characters that are cut into words at a time.
CHARACTERS = 1_000_000
CJK = re.compile(r"[㐀-鿿豈-﫿]+")
OTHER = re.compile(r"[^\W_]+(?:[+#.&'\-][^\W_]+|[+#]+)*")


def load_user_words(path: str) -> dict[str, int | None]:
    """Lines of ``word``, ``word weight`` or ``word weight kind``; words may hold blanks. None if the file lacks; a word without a weight has None."""
    file, out = Path(path), {}
    for line in file.read_text(encoding="utf-8").splitlines() if file.exists() else []:
        m = re.fullmatch(r"\s*(.+?)(?:\s+(\d+))?(?:\s+[a-z]{1,3})?\s*", line)
        if m:
            out[m[1].lower()] = int(m[2]) if m[2] else None
    return out


class Dictionary:
    """A trie of words; each node maps characters to nodes, and "" to the log-frequency of the word that ends there."""

    def __init__(self, words: dict[str, int | None]):
        words = {w.strip().lower(): n for w, n in words.items() if w and w.strip() and len(w.strip()) <= LONGEST}
        if len(words) > WORDS:
            raise ValueError(f"more than {WORDS} words")
        self.root: dict = {}
        self.total = math.log(sum(n or 1 for n in words.values()) or 1)
        self.unknown = -self.total
        self.blanks = sorted((w for w in words if not CJK.fullmatch(w) and not OTHER.fullmatch(w)), key=lambda w: (-len(w), w))
        self.pattern = re.compile("|".join(rf"(?<![^\W_]){re.escape(w)}(?![^\W_])" for w in self.blanks)) if self.blanks else None
        for w, n in sorted(words.items(), key=lambda x: (x[1] is None, len(x[0]), x[0])):
            if CJK.fullmatch(w):
                score = math.log(max(n, 1)) - self.total if n is not None else self.whole(w)
                node = self.root
                for ch in w:
                    node = node.setdefault(ch, {})
                node[""] = score

    def whole(self, word: str) -> float:
        """A score by which the word comes out whole: just above its best cut."""
        return self.best(word)[0][0] + 1e-6

    def best(self, run: str) -> list[tuple[float, int]]:
        """For each place the score of the best way to the end and the end of its first word."""
        out: list[tuple[float, int]] = [(0.0, 0)] * (len(run) + 1)
        for i in range(len(run) - 1, -1, -1):
            found = (self.unknown + out[i + 1][0], i + 1)
            node, j = self.root, i
            while j < len(run) and run[j] in node:
                node = node[run[j]]
                j += 1
                if "" in node:
                    found = max(found, (node[""] + out[j][0], j))
            out[i] = found
        return out

    def cut_run(self, run: str) -> Iterator[str]:
        step, i = self.best(run), 0
        while i < len(run):
            yield run[i : step[i][1]]
            i = step[i][1]

    def cut(self, text: str) -> list[str]:
        """All words of a text in lower case, in order."""
        text, out, at = text.lower(), [], 0
        for m in self.pattern.finditer(text) if self.pattern else ():
            out += [*self.plain(text[at : m.start()]), m[0]]
            at = m.end()
        return [*out, *self.plain(text[at:])]

    def plain(self, text: str) -> Iterator[str]:
        for m in re.finditer(f"({CJK.pattern})|{OTHER.pattern}", CJK.sub(lambda m: f" {m[0]} ", text)):
            if m[1]:
                yield from self.cut_run(m[1])
            else:
                yield m[0]


def pieces(texts: pd.Series, most: int = CHARACTERS) -> Iterator[pd.Series]:
    """A batch of texts in pieces of ``most`` characters, or one text: words take many times a text's room, so they go on a piece at a time."""
    at, held = 0, 0
    for i, n in enumerate(texts.str.len()):
        if i > at and held + n > most:
            yield texts.iloc[at:i]
            at, held = i, 0
        held += n
    yield texts.iloc[at:]


def segmented(spark: SparkSession, c: Column | str, words: dict[str, int | None], stopwords: set[str] = frozenset(), low_value: set[str] = frozenset(), min_len: int = 2) -> Column:
    """The words of the normalised text by a dictionary (word: frequency), without short, stop and low-value ones; null and blank texts have none."""
    given, drop = spark.sparkContext.broadcast(Dictionary(words)), set(stopwords) | set(low_value)  # bounded by WORDS

    @F.pandas_udf("array<string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield from (pd.Series([[w for w in given.value.cut(t) if len(w) >= min_len and w not in drop] for t in some], dtype=object) for some in pieces(part))

    return run(normalized(c))

"""Language identification: known words by their frequency in each language, others by shorter and shorter character n-grams.

A text's words are its runs of letters in lower case. A word that the model knows scores the
logarithm of its relative frequency in each language. An unseen word, between blanks, is cut
into n-grams of ``longest`` characters; if the model knows any of them, the word scores their mean,
else one character less is tried, down to single characters; if none is known the word tells
nothing. Scores of a text's words are added to the logarithm of each language's share of
training words; the greatest sum wins, and its chance among the languages is the score.

The model is fitted on labelled documents: some ``sample_rows`` a language (those whose ids
have the smallest hashes, whole texts), words and n-grams counted and summed up in the
cluster. It keeps the most frequent entries, as many as ``entries`` allows, so what goes to
the workers is bounded whatever the sample holds.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship, whole_ids

#: Letters, and digits that are not decimal; words without a letter are told apart when first met.
WORD, GAP = re.compile(r"[^\W\d_]+"), re.compile(r"[\W\d_]")
#: The longest n-grams that are tried.
LONGEST = 5
#: Languages that are told apart at most, those with most labelled documents.
LANGUAGES = 256
#: Distinct words, and characters, that a task counts before it sends them on; longer words are counted in parts.
HELD, HELD_CHARS, PART = 50_000, 40_000_000, 1024
#: Characters of a text that are cut into words at a time.
SLICE = 1 << 22
#: Words looked up at a time, numbers kept of unseen words for later batches, and the longest such word.
AT_ONCE, CACHED, LONG = 200_000, 1_000_000, 64
UND = "und"


def slices(text: str) -> Iterator[str]:
    """A text in parts of a few megabytes, cut between words."""
    at = 0
    while at < len(text):
        end = at + SLICE
        gap = GAP.search(text, end) if end < len(text) else None
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Rows(dict):
    """Words to the numbers of their rows; an unseen word gets the next number when it is first looked up."""

    def __init__(self, words: dict[str, int], unseen: Callable[[str], int]):
        super().__init__(words)
        self.unseen = unseen

    def __missing__(self, word: str) -> int:
        return self.unseen(word)


class Model:
    """Log-frequencies of known words and n-grams, a row an entry and a column a language."""

    def __init__(self, languages: list[str], prior: np.ndarray, words: dict[str, int], parts: dict[str, int], table: np.ndarray):
        self.languages, self.prior, self.words, self.parts, self.table = languages, prior, words, parts, table
        self.rows = Rows(words, self.unseen)
        self.kept: list[str] = []
        self.fresh, self.pending = np.zeros((0, len(languages))), []

    def __getstate__(self):
        return self.languages, self.prior, self.words, self.parts, self.table

    def __setstate__(self, state):
        self.__init__(*state)

    def backed_off(self, word: str) -> list[int]:
        """The rows of the word's longest known n-grams; none if it has none or no letter."""
        parts, padded = self.parts, f" {word} "
        if word.isalpha() or has_letter(word):
            for n in range(min(LONGEST, len(padded)), 0, -1):
                known = [parts[g] for g in [padded[i : i + n] for i in range(len(padded) - n + 1)] if g in parts]
                if known:
                    return known
        return []

    def unseen(self, word: str) -> int:
        """The number of an unseen word's row, after those of the table."""
        at = len(self.table) + len(self.fresh) + len(self.pending)
        self.pending.append(self.backed_off(word))
        if len(word) <= LONG:
            self.rows[word] = at
            self.kept.append(word)
        return at

    def settle(self) -> None:
        """Give the words that are pending their rows: the means of their n-grams' rows."""
        if self.pending:
            size = np.array([len(p) for p in self.pending])
            of = np.repeat(np.arange(len(size)), size)
            at = np.fromiter((i for p in self.pending for i in p), np.int64, size.sum())
            mean = [np.bincount(of, self.table[at, k], len(size)) / np.maximum(size, 1) for k in range(len(self.languages))]
            self.fresh, self.pending = np.concatenate([self.fresh, np.stack(mean, axis=1)]), []

    def forget(self) -> None:
        """Let go of unseen words."""
        for word in self.kept:
            del self.rows[word]
        self.kept, self.fresh = [], self.fresh[:0]

    def sums(self, texts: list[str]) -> np.ndarray:
        """For each text and language the sum over all words."""
        out = np.zeros((len(texts), len(self.languages)))
        held, size = [], 0
        for i, text in enumerate(texts):
            for part in slices(text):
                held.append((i, WORD.findall(part.lower())))
                size += len(held[-1][1])
                if size > AT_ONCE:
                    self.add(out, held)
                    held, size = [], 0
        self.add(out, held)
        return out

    def add(self, out: np.ndarray, held: list[tuple[int, list[str]]]) -> None:
        """Add the scores of words to the rows of their texts."""
        found = [w for _, ws in held for w in ws]
        if not found:
            return
        of = np.repeat([i for i, _ in held], [len(ws) for _, ws in held])
        at = np.fromiter(map(self.rows.__getitem__, found), np.int64, len(found))
        self.settle()
        new = at >= len(self.table)
        old, late = ~new, at[new] - len(self.table)
        for k in range(len(self.languages)):
            value = np.empty(len(at))
            value[old], value[new] = self.table[at[old], k], self.fresh[late, k]
            out[:, k] += np.bincount(of, value, len(out))
        if self.fresh.size > CACHED:
            self.forget()

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """A language, or und for no letter, and its chance among the languages."""
        some = [isinstance(t, str) and has_letter(t) for t in texts]
        if not self.languages:
            return [UND] * len(texts), [0.0] * len(texts)
        total = self.sums([t if ok else "" for t, ok in zip(texts, some)]) + self.prior
        best = total.argmax(axis=1)
        chance = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.languages[b] if ok else UND for b, ok in zip(best, some)], [round(float(c), 6) if ok else 0.0 for c, ok in zip(chance, some)]


def counted(words: Counter) -> tuple[Counter, Counter]:
    """The words with a letter, and their n-grams, with their counts."""
    own, parts = Counter(), Counter()
    for word, k in words.items():
        if word.isalpha() or has_letter(word):
            if len(word) <= LONG:
                own[word] = k
            padded = f" {word} "
            for n in range(1, LONGEST + 1):
                for i in range(len(padded) - n + 1):
                    parts[padded[i : i + n]] += k
    return own, parts


def tallied(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """lang, size, entry, n of a task's texts: words (size 0), and n-grams."""
    n: dict[str, Counter] = defaultdict(Counter)
    chars = 0

    def flushed() -> Iterator[pd.DataFrame]:
        for lang, words in n.items():
            own, parts = counted(words)
            yield pd.DataFrame({"lang": lang, "size": [0] * len(own) + [len(g) for g in parts], "entry": [*own, *parts], "n": [*own.values(), *parts.values()]}).astype({"size": np.int32, "entry": object, "n": np.int64})
        n.clear()

    for frame in frames:
        for lang, text in zip(frame["lang"], frame["text"]):
            for part in slices(text):
                found = WORD.findall(part.lower())
                if max(map(len, found), default=0) > PART:
                    found = [w[at : at + PART] for w in found for at in range(0, len(w), PART)]
                n[lang].update(found)
                chars += len(part)
                if sum(map(len, n.values())) > HELD or chars > HELD_CHARS:
                    yield from flushed()
                    chars = 0
    yield from flushed()


def sampled(labelled: DataFrame, sample_rows: int) -> DataFrame:
    """lang and text of some ``sample_rows`` documents a language, of the languages with most of them."""
    spread = 1 << 20
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    limits = [(r["lang"], min(spread, -(-spread * sample_rows // r["n"]))) for r in sizes]
    if not limits:
        return labelled.filter("false").select("lang", "text")
    most = F.create_map(*[F.lit(x) for pair in limits for x in pair])
    return labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(spread)) < F.element_at(most, F.col("lang"))).filter("text is not null").select("lang", "text")


def fitted(labelled: DataFrame, sample_rows: int = 3_000, entries: int = 6_400_000) -> Model:
    """The model of documents with doc_id, text and a language.

    It has at most ``entries`` numbers: a row for each of the most frequent words and, as many
    again, n-grams, all that occur as often kept or left out together; words met once are left out.
    """
    ship(labelled.sparkSession)
    own = sampled(labelled, sample_rows)
    counted = cut(own.mapInPandas(tallied, "lang string, size int, entry string, n long").groupBy("lang", "size", "entry").agg(F.sum("n").alias("n")))
    word = F.col("size") == 0
    totals = {r["lang"]: (r["words"], r["grams"]) for r in counted.groupBy("lang").agg(F.sum(F.when(word, F.col("n")).otherwise(0)).alias("words"), F.sum(F.when(F.col("size") == 1, F.col("n")).otherwise(0)).alias("grams")).collect()}  # LANGUAGES rows
    languages = sorted(totals)
    if not languages:
        return Model([], np.zeros(0), {}, {}, np.zeros((0, 0)))
    wide = cut(counted.groupBy("size", "entry").agg(F.sum("n").alias("total"), *[F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(languages)]))
    room = max(1, entries // 2 // len(languages))
    rows = []
    for kind in (word, ~word):
        least, seen = None, 0
        how_often = wide.filter(kind & (F.col("total") > 1)).groupBy("total").agg(F.count("*").alias("n"))
        for r in sorted(how_often.collect(), key=lambda r: -r["total"]):  # a row a frequency: at most the root of twice the sample's words
            seen += r["n"]
            if seen > room:
                break
            least = r["total"]
        rows.append(wide.filter(kind & (F.col("total") >= least)) if least else wide.filter("false"))
    found = rows[0].union(rows[1]).toPandas()
    is_word = found["size"].eq(0).to_numpy(bool)
    counts = found[[f"n{i}" for i in range(len(languages))]].to_numpy(np.float64)
    sizes = np.array([totals[x] for x in languages], np.float64)
    size = np.where(is_word[:, None], sizes[:, 0], sizes[:, 1])
    missing = np.log(0.1 / np.maximum(sizes.max(axis=0), 1))
    with np.errstate(divide="ignore"):
        table = np.where(counts > 0, np.log(counts) - np.log(size), np.where(is_word, missing[0], missing[1])[:, None]).astype(np.float32)
    words = {e: i for i, (e, w) in enumerate(zip(found["entry"], is_word)) if w}
    parts = {e: i for i, (e, w) in enumerate(zip(found["entry"], is_word)) if not w}
    return Model(languages, np.log((sizes[:, 1] + 1) / (sizes[:, 1] + 1).sum()), words, parts, table)


def identify(docs: DataFrame, learn: str = "true", sample_rows: int = 3_000) -> DataFrame:
    """doc_id, lang_pred, score of every document; learns from documents with text, lang and a true ``learn``, an SQL expression.

    A null text, and one without a letter, is ``und`` with score 0; so is all without a labelled
    document. Sums that tie go to the smaller name. Documents without doc_id are predicted and
    not learned from. Repeated rows are rows like others. Whole texts count, however long. An
    empty table gives no rows; other columns are ignored.
    """
    labelled = docs.filter(F.expr(learn) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "lang", F.col("text").cast("string").alias("text"))
    given = docs.sparkSession.sparkContext.broadcast(fitted(labelled, sample_rows))  # bounded by its entries

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = given.value
        for frame in frames:
            for at in range(0, len(frame), 256):
                part = frame.iloc[at : at + 256]
                lang, score = model.predict(part["text"].tolist())
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").mask(part["none"]).array, "lang_pred": lang, "score": score})

    return whole_ids(docs).mapInPandas(run, "doc_id long, lang_pred string, score double")

"""Mixing sources to target weights by soft membership, in DataFrame functions alone.

A table of labelled documents names their domains; a labelled document has its own domain as
its chance. Naive Bayes over distinct words and a few surface features gives every other
document its chance of each domain: features are counted on at most ``sample_rows`` labelled
documents, and the ``features`` that tell domains apart best are kept, so the model has a
fixed size. A feature that a document has speaks for or against a domain; that it lacks
one does so too if the feature is the mark of one domain, as other words are lacking in any
short text. Kept features lie in a table of slots by their 64-bit hashes, a literal array, so a
word costs one hash and one look-up.

Rates r >= 0, how often each document goes into the mixture, minimise the squared gap between
expected domain tokens, the sum of r * tokens * chance, and their targets, by projected
gradient: each round sums over all documents (one row a round reaches the driver) and moves
the point 1 - l . p against the gradient; rates are its projection on what is allowed. The
gradient is a weight a domain, so the whole state is the vector l, and no round stores rates.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A feature that one domain has so many times as often as any other is its mark, and speaks by absence too.
MARKS = 5.0
#: Marks come together, so the lack of all of a domain's makes it at most this much less likely (in logarithm).
LACK = 3.0
#: What a feature must tell of the domains at least, in nats over the whole sample: less is chance among many words.
TOLD = 8.0


def words(text: Column) -> Column:
    """Words in lower case, parted by blanks, line ends and marks of the sentence."""
    return F.array_remove(F.split(F.lower(text), r"[\s.,;:()\"]+"), "")


#: Characters that the surface features count, each kind by one sign.
KINDS = {"!": "!#$%&*|<>{}=@~^\\/_", "0": "0123456789", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def signs(text: Column) -> Column:
    """The text with one sign for all characters of a kind: one pass, after which counting is cheap."""
    return F.translate(text, "".join(KINDS.values()), "".join(k * len(v) for k, v in KINDS.items()))


def with_features(docs: DataFrame) -> DataFrame:
    """docs (with text, not null) and tokens, the number of words, and _f, hashes of distinct words and of surface features: shares of marks, digits, capitals and distinct words, in steps."""
    told = docs.withColumns({"_words": words(F.col("text")), "_signs": signs(F.col("text"))}).withColumn("_set", F.array_distinct("_words"))
    size = F.length("_signs") + 1
    share = lambda sign: (F.length("_signs") - F.length(F.replace(F.col("_signs"), F.lit(sign), F.lit("")))) / size
    kinds = {"#marks": share("!"), "#digits": share("0"), "#capitals": share("A"), "#distinct": F.size("_set") / F.greatest(F.size("_words"), F.lit(1))}
    surface = F.array(*[F.concat(F.lit(name), F.least(F.floor(c * 20), F.lit(20)).cast("string")) for name, c in kinds.items()])
    hashes = F.transform(F.concat("_set", surface), lambda x: F.xxhash64(x))
    return told.select(*docs.columns, F.size("_words").cast("long").alias("tokens"), hashes.alias("_f"))


def numbers(values: list, kind: str) -> Column:
    """A literal array, folded from one text."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def only_domain(labelled: DataFrame) -> DataFrame:
    """doc_id, domain of ids with one domain; those with several, and nulls, are left out."""
    labelled = labelled.filter("doc_id is not null and domain is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("domain").alias("domain"), F.max("domain").alias("_other"))
    return labelled.filter("domain = _other").select("doc_id", "domain")


def membership(docs: DataFrame, labelled: DataFrame, sample_rows: int, features: int) -> tuple[DataFrame, list[str]]:
    """doc_id, tokens and a double column _p0, _p1, ... for each domain of every document; the domains' names.

    docs: doc_id, text and columns that stay; labelled: doc_id and domain, an id once.
    """
    others = [c for c in docs.columns if c != "text"]
    chosen = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = docs.join(F.broadcast(chosen.withColumnRenamed("domain", "_domain")), "doc_id")  # at most sample_rows ids
    seen = cut(with_features(sample).select("_domain", "_f"))
    total = {r["_domain"]: r["count"] for r in seen.groupBy("_domain").count().collect()}
    domains = sorted(total)
    if not domains:
        return docs.select(*others, F.size(words(F.col("text"))).cast("long").alias("tokens"), F.lit(1.0).alias("_p0")), ["unlabelled"]
    by = seen.select("_domain", F.explode("_f").alias("f")).groupBy("f").agg(*[F.sum((F.col("_domain") == d).cast("long")).alias(f"n{k}") for k, d in enumerate(domains)])
    rate = [(F.col(f"n{k}") + 0.5) / (total[d] + 1.0) for k, d in enumerate(domains)]
    mean = sum(F.col(f"n{k}") + 0.5 for k in range(len(domains))) / (sum(total.values()) + 1.0 * len(domains))
    apart = sum(total[d] * (r * F.ln(r / mean) + (1 - r) * F.ln((1 - r) / (1 - mean))) for d, r in zip(domains, rate))
    kept = by.withColumn("_apart", apart).filter(F.col("_apart") >= TOLD).orderBy(F.desc("_apart"), "f").limit(features).collect()
    table = {}
    slots = 16 * features
    for r in kept:  # the better of two features that share a slot stays
        table.setdefault(r["f"] % slots, (r["f"], [(r[f"n{k}"] + 0.5) / (total[d] + 1) for k, d in enumerate(domains)]))
    is_mark = lambda p: len(p) > 1 and sorted(p)[-1] >= MARKS * sorted(p)[-2]
    marks = [p for _, p in table.values() if is_mark(p)]
    base = [math.log(total[d] / sum(total.values())) + max(-LACK, sum(math.log(1 - p[k]) for p in marks)) for k, d in enumerate(domains)]
    gains = [[0] * slots for _ in domains]
    for slot, (_, p) in table.items():
        for k, x in enumerate(p):
            gains[k][slot] = round(math.log(x / (1 - x) if is_mark(p) else x), 4)
    at = lambda h: F.pmod(h, F.lit(slots)).cast("int")
    owner = numbers([table[s][0] if s in table else 0 for s in range(slots)], "bigint")
    told = with_features(docs).withColumn("_hits", F.filter("_f", lambda h: owner[at(h)] == h))
    score = lambda b, g: F.aggregate("_hits", F.lit(b), lambda a, h: a + g[at(h)])
    scores = [score(b, numbers(g, "double")) for b, g in zip(base, gains)]
    told = told.select(*others, "tokens", *[s.alias(f"_s{k}") for k, s in enumerate(scores)])
    top = F.greatest(*[F.col(f"_s{k}") for k in range(len(domains))]) if len(domains) > 1 else F.col("_s0")
    told = told.withColumns({f"_e{k}": F.exp(F.col(f"_s{k}") - top) for k in range(len(domains))})
    whole = sum(F.col(f"_e{k}") for k in range(len(domains)))
    return told.select(*others, "tokens", *[(F.col(f"_e{k}") / whole).alias(f"_p{k}") for k in range(len(domains))]), domains


def prepared(docs: DataFrame, labelled: DataFrame, sample_rows: int = 20_000, features: int = 1024, also: Column | None = None) -> tuple[DataFrame | None, list[str]]:
    """doc_id, tokens and chances of all rows, and ``also`` as _also, checkpointed; None if there are no rows."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *([] if also is None else [also.alias("_also")]), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if docs.isEmpty():
        return None, []
    labelled = only_domain(labelled)
    told, domains = membership(docs, labelled, sample_rows, features)
    told = cut(told)
    if domains == ["unlabelled"]:
        return told, domains
    # rows without an id meet nothing, so they stay out of the join, where they would be one key
    own = told.filter("doc_id is not null").join(labelled.withColumnRenamed("domain", "_domain"), "doc_id", "left")
    own = own.select(*[c for c in told.columns if not c.startswith("_p")], *[F.when(F.col("_domain").isin(domains), (F.col("_domain") == d).cast("double")).otherwise(F.col(f"_p{k}")).alias(f"_p{k}") for k, d in enumerate(domains)])
    return cut(own.union(told.filter("doc_id is null"))), domains


def rates(light: DataFrame, domains: int, targets: list[float], rounds: int = 40, tolerance: float = 1e-6, least: Column | None = None) -> DataFrame:
    """light (tokens, _p0, _p1, ...) with rate; targets: tokens wanted of each domain.

    ``least`` is a row's lowest rate, from 0 to 1; 0 if None. A round looks at several steps
    in one pass over the rows, in the metric of the domain totals of rates that may move, of
    that and all rows', and the plain gradient's, and takes the one that gets lowest in the
    convex function whose gradient the gap is; so it descends wherever it begins. Ends when
    the targets are met, or when five rounds do not bring the least gap down by a thousandth,
    as of targets that no rates can reach; the rates of the least gap are returned.
    """
    p, n = [F.col(f"_p{k}") for k in range(domains)], F.col("tokens").cast("double")
    low, wanted = F.lit(0.0) if least is None else least, np.array(targets, float)
    above = np.triu_indices(domains)

    def point(state: np.ndarray) -> Column:
        return F.lit(1.0) - sum(F.lit(float(s)) * x for s, x in zip(state, p))

    def square(row: np.ndarray) -> np.ndarray:
        out = np.zeros((domains, domains))
        out[above] = row
        return out + np.triu(out, 1).T

    def seen(states: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """For each state the height, the gap to the targets, and the metric: expected tokens of two domains at once, over rates that may move."""
        sums = []
        for c in range(len(states)):
            y = F.col(f"_y{c}")
            rate, free = F.greatest(low, y), n * (y > low).cast("double")
            sums += [F.sum(n * F.when(y > low, y * y / 2).otherwise(low * y - low * low / 2))] + [F.sum(rate * n * x) for x in p] + [F.sum(free * p[i] * p[j]) for i, j in zip(*above)]
        got = light.withColumns({f"_y{c}": point(s) for c, s in enumerate(states)}).agg(*[x.alias(f"s{i}") for i, x in enumerate(sums)]).first()
        rows = np.array([float(x or 0) for x in got]).reshape(len(states), -1)
        return [(r[0] + s @ wanted, r[1 : domains + 1] - wanted, square(r[domains + 1 :])) for s, r in zip(states, rows)]

    state, slow = np.zeros(domains), 0
    whole = square(np.array([float(x or 0) for x in light.agg(*[F.sum(n * p[i] * p[j]).alias(f"m{i}_{j}") for i, j in zip(*above)]).first()]))
    whole += np.eye(domains) * max(1e-9 * np.trace(whole), 1e-9)
    height, gap, metric = seen([state])[0]
    best = (np.linalg.norm(gap), state)
    for _ in range(rounds):
        if np.abs(gap).max() <= tolerance * max(wanted.sum(), 1.0) or slow >= 5:
            break
        steps = [np.linalg.lstsq(metric + a * whole, gap, rcond=None)[0] for a in (1e-9, 1e-3, 0.03, 0.3, 3.0)]
        there = [state + s for s in (*steps, gap / np.linalg.eigvalsh(whole)[-1])]
        found = min(zip(seen(there), there), key=lambda x: x[0][0])
        if found[0][0] >= height:
            break
        (height, gap, metric), state = found
        slow = slow + 1 if np.linalg.norm(gap) > 0.999 * best[0] else 0
        best = min(best, (np.linalg.norm(gap), state), key=lambda x: x[0])
    return light.withColumn("rate", F.greatest(low, point(best[1])))


def finished(rated: DataFrame, domains: list[str], seed: int = 11) -> DataFrame:
    chances = F.array(*[F.struct(F.lit(d).alias("domain"), F.col(f"_p{k}").alias("chance")) for k, d in enumerate(domains)])
    part = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    return rated.select("doc_id", *[c for c in rated.columns if c == "_also"], "tokens", chances.alias("domains"), "rate").withColumn("copies", F.floor(F.col("rate") + part).cast("long"))


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], budget: float | None = None, sample_rows: int = 20_000, features: int = 1024, seed: int = 11) -> DataFrame:
    """doc_id, tokens, domains (array<struct<domain, chance>>), rate, copies of every document.

    ``weights`` gives each domain's share of the mixture (domains not named: none), ``budget``
    its tokens, all tokens of docs if None. tokens counts words. copies is the rate rounded up
    or down by a hash of doc_id and ``seed``, in proportion, so totals hold on average. A
    target that no rates can reach, as of a domain without documents, is met as nearly as
    least squares allow. A null text has no tokens and its rate no effect. Null and repeated
    doc_ids are rows like others; an id with several domains counts as not labelled; an empty
    table gives no rows; other columns are ignored. If no document is labelled there is one
    domain, "unlabelled", and all rates are 1.
    """
    light, domains = prepared(docs, labelled, sample_rows, features)
    if light is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, tokens long, domains array<struct<domain:string,chance:double>>, rate double, copies long")
    if domains == ["unlabelled"]:
        return finished(light.withColumn("rate", F.lit(1.0)), domains, seed)
    total = light.agg(F.sum("tokens")).first()[0] or 0
    share = sum(weights.get(d, 0.0) for d in domains) or 1.0
    return finished(rates(light, len(domains), [(budget if budget is not None else total) * weights.get(d, 0.0) / share for d in domains]), domains, seed)

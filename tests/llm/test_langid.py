"""Language identification: the model against a plain one, held-out accuracy, edges."""

import math
import random
from collections import Counter

from tagloom.llm import langid

PARTS = {"aa": ["ka", "to", "mi", "ne"], "bb": ["schl", "ung", "ver", "ich"], "cc": ["ção", "nh", "ões", "lho"]}


def texts(lang, n, rng):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def docs(spark, rng, n=240):
    rows = [(i, texts(lang, rng.randint(1, 60), rng), lang, 1, 2) for i in range(n) for lang in [rng.choice(sorted(PARTS))]]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, entry int, size int")


def plain(rows, texts_):
    """Scores by the documented rule, word by word."""
    langs = sorted({r[2] for r in rows})
    words, grams = {x: Counter() for x in langs}, {x: Counter() for x in langs}
    for _, t, lang, *_ in rows:
        for w in langid.WORD.findall(t.lower()):
            words[lang][w] += 1
            for n in range(1, 6):
                grams[lang].update(f" {w} "[i : i + n] for i in range(len(w) + 3 - n))
    size = {x: (sum(words[x].values()), sum(k for g, k in grams[x].items() if len(g) == 1)) for x in langs}
    total_w, total_g = sum(words.values(), Counter()), sum(grams.values(), Counter())
    out = []
    for t in texts_:
        s = {x: math.log((size[x][1] + 1) / sum(size[y][1] + 1 for y in langs)) for x in langs}
        for w in langid.WORD.findall(t.lower()):
            own = [w] if total_w[w] > 1 else next((g for n in range(5, 0, -1) if (g := [y for i in range(len(w) + 3 - n) for y in [f" {w} "[i : i + n]] if total_g[y] > 1])), [])
            known, which = (words, 0) if total_w[w] > 1 else (grams, 1)
            for x in langs:
                if own:
                    s[x] += sum(math.log(known[x][g] / size[x][which]) if known[x][g] else math.log(0.1 / max(size[y][which] for y in langs)) for g in own) / len(own)
        best = max(langs, key=lambda x: s[x])
        out.append((best, round(1 / sum(math.exp(v - s[best]) for v in s.values()), 6)))
    return out


def test_scores_are_those_of_the_rule(spark):
    rng = random.Random(5)
    rows, df = docs(spark, rng)
    model = langid.fitted(df)
    asked = [texts(x, n, rng) for x in PARTS for n in (1, 2, 7, 30)] + ["kato zzz qqq", "Schlung, verich!", "x", "tox schl", "kakakakakakakakakakakakaka"]
    lang, score = model.predict(asked)
    for got, want in zip(zip(lang, score), plain(rows, asked)):
        assert got[0] == want[0] and abs(got[1] - want[1]) < 2e-5
    again = model.predict(asked * 3)
    assert again == (lang * 3, score * 3)
    model.forget()
    assert model.predict(asked) == (lang, score)


def test_held_out_accuracy_and_edges(spark, monkeypatch):
    rng = random.Random(6)
    rows, df = docs(spark, rng, 600)
    long = texts("bb", 60_000, rng)
    monkeypatch.setattr(langid, "SLICE", 10_000)
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 ²! 3", "bb"), (1003, long, None), (None, texts("cc", 20, rng), "aa"), (None, None, None), (1004, "x" * 50_000, None), (3, "ka to mi", None), (3, "ka to mi", None)]
    more = spark.createDataFrame([(*r, 1, 2) for r in odd], df.schema)
    got = langid.identify(df.union(more), "doc_id % 3 <> 1").collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in got)
    of = {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] is not None}
    held = [r for r in rows if r[0] % 3 == 1]
    assert sum(of[i] == lang for i, _, lang, *_ in held) >= 0.97 * len(held)
    assert [of[i] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "bb"] and of[1004] in PARTS
    assert sorted(r["lang_pred"] for r in got if r["doc_id"] is None) == ["cc", "und"]
    assert langid.identify(df.limit(0)).count() == 0
    none = langid.identify(df, "false").collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)} and len(none) == len(rows)


def test_the_model_is_bounded(spark):
    _, df = docs(spark, random.Random(7))
    model = langid.fitted(df, entries=120)
    assert len(model.words) <= 20 and len(model.parts) <= 20 and model.table.shape == (len(model.words) + len(model.parts), 3)
    few = langid.sampled(df, 5).groupBy("lang").count().collect()
    assert all(r["count"] < 40 for r in few)

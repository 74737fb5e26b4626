"""License matches against exact containment of every place."""

import numpy as np

from tagloom.llm import licenses
from tagloom.llm.license_texts import TEMPLATES


def plain(text, t):
    """Whether any run of words about as long as the template holds 0.8 of its shingles."""
    own = licenses.words(text)
    where = [i for i in range(len(own) - 4) if tuple(own[i : i + 5]) in t.shingles]
    for i in where:
        span = {tuple(own[j : j + 5]) for j in where if i <= j < i + len(t.words)}
        if len(span) >= 0.8 * len(t.shingles):
            return True
    return False


def test_matches_equal_exact_containment(spark):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(500)]
    noise = lambda n: " ".join(rng.choice(words, n))
    rows = []
    for name, text in TEMPLATES.items():
        for _ in range(25):
            rows.append((len(rows), f"{noise(int(rng.integers(0, 300)))}\n{text.upper()}\n{noise(int(rng.integers(0, 300)))}", name))
        w = text.split()
        for _ in range(5):  # a word changed: found only where enough is left
            v = list(w)
            v[rng.integers(len(v))] = "other"
            rows.append((len(rows), noise(70) + " " + " ".join(v) + " " + noise(33), ""))
        rows.append((len(rows), " ".join(w[: len(w) // 2]), ""))
    rows += [(len(rows) + i, t, "") for i, t in enumerate([None, "", "the", noise(70_000) + " " + TEMPLATES["mit"] + " " + noise(70_000) + TEMPLATES["isc"]])] + [(None, TEMPLATES["mit-line"], "")]
    rows.append(rows[0])
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(docs, TEMPLATES).collect()}
    made = [licenses.template(n, t) for n, t in TEMPLATES.items()]
    want = {(d, t.name) for d, text, _ in rows for t in made if text and plain(text, t)}
    assert got == want and licenses.scan(docs.limit(0), TEMPLATES).count() == 0


def test_places(spark):
    docs = spark.createDataFrame([(1, "one two " + TEMPLATES["isc"] + " three " + TEMPLATES["isc"])], "doc_id long, text string")
    n = len(licenses.words(TEMPLATES["isc"]))
    got = [(r["first_word"], r["end_word"], r["containment"]) for r in licenses.scan(docs, TEMPLATES).collect() if r["license"] == "isc"]
    assert len(got) == 2 and got[0][2] == 1.0 and got[0][0] == 2 and got[1][1] == 2 * n + 3


def test_words_put_in(spark):
    """Seven words in the middle leave 0.87 of isc's shingles; the rest of it lies beyond the template's length."""
    w = TEMPLATES["isc"].split()
    text = " ".join(["before"] * 9 + w[: len(w) // 2] + [f"in{i}" for i in range(7)] + w[len(w) // 2 :] + ["after"] * 9)
    found = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), TEMPLATES).collect()
    made = licenses.template("isc", TEMPLATES["isc"])
    got = [(r["containment"], r["first_word"], r["end_word"]) for r in found if r["license"] == "isc"]
    assert got == [((len(made.shingles) - 4) / len(made.shingles), 9, 9 + len(made.words) + 7)]


def test_damaged_neighbours_stay_two(spark):
    """Two copies that lack different words are two matches, not one that holds all."""
    w = TEMPLATES["isc"].split()
    text = " ".join([*w[3:], "between", *w[:-3]])
    found = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), TEMPLATES).collect()
    assert len([r for r in found if r["license"] == "isc"]) == 2

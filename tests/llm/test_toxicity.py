"""Toxicity: the automaton against edit distances, windows, held-out accuracy."""

import math
import random
import zlib

import numpy as np
import pytest

from flagtide.llm import toxicity as T

SF = "/root/testdata/sf0.01"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(word, terms, stems, weights):
    hits = [(0, -len(s), s) for s in stems if word.startswith(s)]
    for t in terms:
        d = distance(word, t)
        if d <= (T.edits_allowed(t) if weights[t] >= math.log(T.FUZZY_RATIO) else 0):
            hits.append((d, -len(t), t))
    if not hits:
        return None
    d, _, t = min(hits)
    return t, d


@pytest.mark.parametrize("seed", range(6))
def test_automaton_equals_edit_distance(seed):
    rng = random.Random(seed)
    word = lambda a, b: "".join(rng.choice("abcd") for _ in range(rng.randrange(a, b)))
    terms = {word(3, 11): rng.choice([2.5, 5.0]) for _ in range(12)}
    stems = {word(3, 6): 4.0 for _ in range(3)}
    terms = {t: w for t, w in terms.items() if t not in stems}
    auto = T.TermAutomaton(terms, stems)
    for _ in range(1500):
        w = word(1, 12) if rng.random() < 0.5 else rng.choice(list(terms))
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(w) + 1)
            w = rng.choice([w[:at] + rng.choice("abcd") + w[at:], w[:at] + w[at + 1:], w[:at] + "d" + w[at + 1:]])
        if w:
            assert auto.nearest(w) == plain(w, terms, stems, auto.weights), w


def test_automaton_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(T, "MOST_KNOWN", 10)
    auto = T.TermAutomaton({"worthless": 5.0}, {"lowei": 5.0})
    for i in range(100):
        assert auto.nearest(f"w{i}") is None
        assert auto.nearest("worthles") == ("worthless", 1) and auto.nearest("loweichen") == ("lowei", 0)


MODEL = T.Model({"idiot": 7.0, "pathetic": 7.0}, {"vequ": 4.0})


def score(text, model=MODEL):
    return T.score_text(text, model, T.automaton(model))


def test_windows_and_misspellings():
    filler = "the quiet river runs past the old mill and on to the sea " * 3
    abuse = score(filler + "you idiot " + filler)
    assert abuse > 0.9
    assert score(filler + 'he wrote "idiot" on it ' + filler) < abuse - 0.1
    assert score(filler + "the word idiot is old " + filler) < abuse - 0.1
    for spelled in ("idi0t", "1diot", "IDIOT", "pathetc", "p@thetic", "vequlant"):
        assert score(filler + f"you {spelled} " + filler) > score(filler), spelled
    assert score(None) == score("") == score(filler) < 0.3
    harmless = T.Model(MODEL.terms, MODEL.stems, frozenset({"idiom"}))
    assert score("an idiom", harmless) == score("", harmless) and score("an idiom") > score("")


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = T.fit(docs, labels)
    rows = T.score(docs, model).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows) and len(rows) > 500
    good = [r.score for r in rows if r.toxic]
    bad = [r.score for r in rows if not r.toxic]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.97


def test_query_covers_every_document(spark):
    from flagtide.llm import queries  # noqa: F401
    from flagtide.llm.registry import QUERIES

    rows = QUERIES["op3_toxicity"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_held_out_labels_are_not_used(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("toxic", T.F.when(T.held_out(T.F.col("doc_id")), 1 - T.F.col("toxic")).otherwise(T.F.col("toxic")))
    a, b = T.fit(docs, labels), T.fit(docs, flipped)
    assert (a.terms, a.stems, a.harmless) == (b.terms, b.stems, b.harmless) and np.allclose(a.weights, b.weights)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "idiot " * 90_000, 1), (3, "x", 1), (None, "you idiot", 1)],
                                 "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 0, 1), (2, 0, None), (None, 0, 1), (3, 0, 7), (3, 0, 1), (3, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    model = T.fit(docs, labels)
    assert T.score(docs, model).count() == 5 and T.score(docs.limit(0), model).count() == 0
    assert T.drop_toxic(docs, labels).columns == docs.columns
    nothing = T.fit(docs, labels.limit(0))
    assert not nothing.terms and T.score(docs, nothing).where("predicted = 0").count() == 5


@pytest.mark.parametrize("seed", range(3))
def test_edits_at_any_place(seed):
    """Plain edit distance, without a rule on the first letters."""
    rng = random.Random(seed)
    word = lambda a, b: "".join(rng.choice("abcd") for _ in range(rng.randrange(a, b)))
    terms = {word(3, 11): rng.choice([2.5, 5.0]) for _ in range(12)}
    auto = T.TermAutomaton(terms, {})
    for _ in range(1500):
        w = word(1, 12) if rng.random() < 0.5 else rng.choice(list(terms))
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(w) + 1)
            w = rng.choice([rng.choice("abcd") + w, w[1:], w[:at] + w[at + 1:]])
        hits = [(d, -len(t), t) for t in terms
                if (d := distance(w, t)) <= (T.edits_allowed(t) if terms[t] >= math.log(T.FUZZY_RATIO) else 0)]
        assert auto.nearest(w) == ((min(hits)[2], min(hits)[0]) if hits else None), w


def test_front_edits_and_long_words_score():
    model = T.Model({"stupid": 7.0, "ab" * 40: 7.0}, {})
    for spelled in ("tupid", "xstupid", "ab" * 40, "ab" * 39 + "ac"):
        assert score(f"you {spelled} there", model) > score("you there", model), spelled
    assert T.automaton(model).nearest("ab" * 32) is None


def test_all_terms_with_support_are_learned(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(letters[i % 26] + letters[i // 26 % 26] + letters[i // 676] + "words", 100, 0) for i in range(2100)]
    terms, _ = T.learn_terms(spark.createDataFrame(rows, "word string, toxic long, clean long"), 1000, 1000)
    assert len(terms) == 2100


def test_misspelled_forms_of_a_stem(spark):
    """None of the forms has half of the stem's documents, some have very few."""
    rows = [("vequorab" + end, n, 0) for end, n in (("an", 30), ("lich", 30), ("es", 25), ("ion", 25), ("ung", 2))]
    counts = spark.createDataFrame(rows + [("quiet", 10, 400)], "word string, toxic long, clean long")
    terms, stems = T.learn_terms(counts, 500, 500)
    assert any("vequorab".startswith(s[:3]) for s in stems)
    auto = T.TermAutomaton(terms, stems)
    for word, _, _ in rows:
        assert auto.nearest(word)[1] == 0
        assert auto.nearest(word[:4] + "z" + word[5:]) == (word, 1), word
        assert auto.nearest(word[1:]) == (word, 1), word
    assert auto.nearest("quiet") is None
    both = T.TermAutomaton({"loser": 5.0}, {"loser": 5.0})  # a stem that is a word too
    assert both.nearest("looser") == ("loser", 1) and both.nearest("loserish") == ("loser", 0)


def test_misspelled_forms_are_found_after_training(spark):
    rng = random.Random(4)
    noise = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(3000)]
    forms = ["vequoraban", "vequorablich", "vequorabes", "vequorabion"]
    rows = [(i, " ".join([*rng.sample(noise, 30), *([rng.choice(forms)] if i % 4 == 0 else [])]), int(i % 4 == 0)) for i in range(800)]
    data = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = T.fit(data.select("doc_id", "text"), data.select("doc_id", "toxic"))
    assert model.stems and set(forms) <= set(model.terms)
    for spelled in ("vequzraban", "equorabion", "vequorrablich"):
        assert score(f"you {spelled} there", model) > score("you there", model), spelled


def test_forms_among_harmless_words_stay_exact():
    terms, stems = {"achlichung": 4.0, "achlichein": 4.0, "other": 5.0}, {"achlich": 4.0}
    known = T.Counter({("achlichung", True): 5, ("achlichein", False): 2, ("other", True): 9})
    assert T.with_telling_forms(terms, stems, known) == {"other": 5.0}
    assert T.with_telling_forms(terms, stems, T.Counter()) == terms

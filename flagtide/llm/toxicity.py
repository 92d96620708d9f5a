"""Toxicity: a learned lexicon matched through Levenshtein automata, with
context windows that tell quotation from abuse.

A lexicon of terms (whole words, and stems that open many words) is learned
from labelled documents. A stem runs on exactly; misspellings are looked for
around the forms of it that toxic documents use. The terms form a trie; the automaton that accepts a
word within so many edits of any term is the product of that trie with the
Levenshtein edit counter, made deterministic as words need it, so a word costs
one table step per character and most die after two or three. Every match is
looked at in a window of its text: inside quotation marks or next to a verb
of reporting it counts as quoted. A small logistic model over the sums of
matches (exact or misspelled, abusive or quoted) and their rate per word gives
the score, so a chance match in a very long text weighs little.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from flagtide.llm.common import slices, written

#: Most labelled rows the classifier is fitted on (those with the smallest
#: hash of their id); everything else covers all rows.
MAX_LABELLED = 200_000
#: A term must occur in so many toxic documents.
MIN_SUPPORT = 8
#: Least ratio of a term's (smoothed) frequency in toxic to that in clean
#: documents, least log-likelihood ratio of the two, and the ratio from which
#: misspellings of a term are looked for.
MIN_RATIO, MIN_SIGNIFICANCE, FUZZY_RATIO = 8.0, 40.0, 25.0
STEM_LENGTHS = range(3, 11)
THRESHOLD = 0.3
#: Words and automaton states that a worker remembers.
MOST_KNOWN, MOST_STATES = 50_000, 4_000

WORD = re.compile(r"[^\W_]+(?:[@$*'’!0-9_]+[^\W_]+)*|[^\W_]*[@$*][\w@$*]*")
# Characters written in place of a letter.
LOOKALIKES = str.maketrans("013457@$!", "oieastasi")
# Quotation marks, and words that announce someone else's words.
QUOTES = re.compile("[\"“”„«»‹›‘]")
REPORTING = frozenset(
    "said says saying called calling quoted quote quotes wrote writes word words term slur claims "
    "sagte sagt nannte schrieb zitat wort dit disait écrit appelé mot dijo dice llamó escribió palabra".split())
WINDOW = 6


def normal_word(word: str) -> str:
    w = word.lower().replace("'", "").replace("’", "").replace("_", "")
    return w.translate(LOOKALIKES) if not w.isalpha() and not w.isdigit() else w


def words(text: str) -> list[str]:
    return WORD.findall(text)


def edits_allowed(term: str) -> int:
    """Short terms have too many harmless neighbours."""
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


class TermAutomaton:
    """Words within the allowed edits of a term, as a lazily determinised DFA.

    A state is a set of (trie node, edits, edits its first letter allows);
    ``step`` follows equal letters, insertions, deletions, substitutions and
    lets stems run on. An edit may stand anywhere, at the front too."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float]):
        self.weights = {**stems, **terms}
        self.whole = frozenset(terms)
        self.children: list[dict[str, int]] = [{}]
        self.final: list[str | None] = [None]
        self.runs_on: list[bool] = [False]
        self.budget: list[int] = [0]
        for term in sorted(self.weights):
            node, k = 0, self.allowed(term) if term in terms else 0
            self.budget[0] = max(self.budget[0], k)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.final.append(None)
                    self.runs_on.append(False)
                    self.budget.append(0)
                node = self.children[node][c]
                self.budget[node] = max(self.budget[node], k)
            self.final[node] = term
            self.runs_on[node] = term in stems
        self._forget()

    def _forget(self) -> None:
        """Only the start state: states and verdicts are made again as needed."""
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[str, int] | None] = []
        self.known: dict[str, tuple[str, int] | None] = {}
        self.start = self._state(self._closed({(0, 0)}))

    def _closed(self, states: set) -> frozenset:
        """With letters of the term left out, each at one edit."""
        todo = list(states)
        while todo:
            node, e = todo.pop()
            for child in self.children[node].values():
                if e < self.budget[child] and (child, e + 1) not in states:
                    states.add((child, e + 1))
                    todo.append((child, e + 1))
        best: dict[int, int] = {}
        for node, e in states:
            best[node] = min(e, best.get(node, 99))
        return frozenset(best.items())

    def _state(self, states: frozenset) -> int:
        if states not in self.ids:
            self.ids[states] = len(self.sets)
            self.sets.append(states)
            self.moves.append({})
            ends = [(e, -len(self.final[n]), self.final[n]) for n, e in states
                    if n >= 0 and self.final[n] is not None and e <= self._limit(self.final[n])]
            ends += [(0, -len(self.final[-n]), self.final[-n]) for n, _ in states if n < 0]
            self.accepts.append((min(ends)[2], min(ends)[0]) if ends else None)
        return self.ids[states]

    def allowed(self, term: str) -> int:
        return edits_allowed(term) if self.weights[term] >= math.log(FUZZY_RATIO) else 0

    def _limit(self, term: str) -> int:
        return self.allowed(term) if term in self.whole else 0

    def _step(self, state: int, c: str) -> int:
        out: set = set()
        for node, e in self.sets[state]:
            if node < 0:  # past the end of a stem
                out.add((node, e))
                continue
            if self.runs_on[node] and e == 0:
                out.add((-node, 0))
            if e < self.budget[node]:
                out.add((node, e + 1))
            for letter, child in self.children[node].items():
                if letter == c:
                    out.add((child, e))
                elif e < self.budget[child]:
                    out.add((child, e + 1))
        past = frozenset(s for s in out if s[0] < 0)
        target = self._state(self._closed({s for s in out if s[0] >= 0}) | past)
        self.moves[state][c] = target
        return target

    def nearest(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the nearest term, or None."""
        if word in self.known:
            return self.known[word]
        if len(self.known) >= MOST_KNOWN or len(self.sets) >= MOST_STATES:
            self._forget()
        state = self.start
        for c in word:
            state = self.moves[state].get(c) or self._step(state, c)
            if not self.sets[state]:
                break
        found = self.accepts[state]
        self.known[word] = found
        return found


@dataclass
class Model:
    """All that scoring needs; its size is bounded by MAX_LABELLED."""

    terms: dict[str, float]
    stems: dict[str, float]
    harmless: frozenset = frozenset()  # misspelled forms that clean documents use
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())


# where the logistic weights start, and what they stay near without evidence:
# bias, exact abuse, misspelled abuse, exact quoted, misspelled quoted, abuse per 100 words
PRIOR = np.array([-4.0, 2.0, 1.5, 0.5, 0.25, 1.0])

RATE_SHARES = np.array([1.0, 0.5, 0.1, 0.05])

def automaton(model: Model) -> TermAutomaton:
    return TermAutomaton(model.terms, model.stems)


def quoted(text: str, start: int, end: int, before: list[str], after: list[str]) -> bool:
    """Whether the match lies inside quotation marks or beside reported speech."""
    left = QUOTES.findall(text, max(0, start - 80), start)
    right = QUOTES.findall(text, end, end + 80)
    if len(left) % 2 == 1 and right:
        return True
    return any(w.lower() in REPORTING for w in before[-WINDOW:] + after[:2])


def features(text: str, model: Model, auto: TermAutomaton) -> np.ndarray:
    """1, the logarithms of the four weighted sums of matches, and that of
    the abuse per 100 words (misspelled counts half, quoted a tenth)."""
    sums, rate = np.zeros(4), 0.0
    if text:
        match = auto.nearest
        hits = {}
        found_words = words(text)
        for w in set(found_words):
            n = normal_word(w)
            found = match(n)
            if found and not (found[1] and n in model.harmless):
                hits[w] = found
        if hits:
            tokens = list(WORD.finditer(text))
            for i, m in enumerate(tokens):
                found = hits.get(m.group())
                if found:
                    near = quoted(text, m.start(), m.end(), [t.group() for t in tokens[max(0, i - WINDOW):i]],
                                  [t.group() for t in tokens[i + 1:i + 3]])
                    sums[2 * near + (found[1] > 0)] += auto.weights[found[0]]
            rate = float(sums @ RATE_SHARES) * 100 / len(found_words)
    return np.concatenate([[1.0], np.log1p(sums), [math.log1p(rate)]])


def score_text(text: str | None, model: Model, auto: TermAutomaton) -> float:
    z = float(features(text or "", model, auto) @ model.weights)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


# -------------------------------------------------------------------- training

def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, toxic) of the labelled rows used for fitting: never a held-out
    row, one row per id, at most ``most`` of them, chosen by the hash of the id."""
    chosen = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")


def sketches(text: str, n: int = 3) -> list[int]:
    """Smallest hashes of the word triples: near copies mostly share them."""
    w = text.split()
    grams = {" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))}
    return [min(xxhash.xxh64_intdigest(g, seed) for g in grams) - (1 << 63) for seed in range(n)]


def without_copies(train: DataFrame) -> DataFrame:
    """One row per group of (near) copies, or a passage copied a hundred times
    would make terms of all its words. Copies of either label are looked for
    within that label."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            marks = [sketches(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), *(pa.array([m[i] for m in marks], pa.int64()) for i in range(3))],
                ["doc_id", "toxic", "s0", "s1", "s2"])

    rows = written(train.mapInArrow(run, "doc_id bigint, toxic int, s0 bigint, s1 bigint, s2 bigint"))
    kept = rows
    for s in ("s0", "s1", "s2"):
        firsts = rows.groupBy("toxic", s).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
        kept = kept.join(firsts, "doc_id", "left_semi")
    return written(kept.select("doc_id", "toxic").distinct())


def word_counts(train: DataFrame) -> DataFrame:
    """word, toxic, clean: documents of either kind that use the word, counted
    per batch before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            counts = (Counter(), Counter())
            for text, toxic in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                counts[toxic].update({normal_word(w) for w in words(text or "")})
            keys = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()),
                 pa.array([counts[0][k] for k in keys], pa.int64())], ["word", "toxic", "clean"])

    return train.mapInArrow(run, "word string, toxic bigint, clean bigint").groupBy("word").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_terms(counts: DataFrame, n_toxic: int, n_clean: int) -> tuple[dict[str, float], dict[str, float]]:
    """Whole words and stems (prefixes that open several words) far more
    frequent in toxic documents. Of nested stems the most telling is taken; the
    forms it opens in toxic documents are whole words too."""
    ratio = ((F.col("toxic") + 0.5) / (n_toxic + 1)) / ((F.col("clean") + 0.5) / (n_clean + 1))
    # against one rate for both kinds of documents
    both = (F.col("toxic") + F.col("clean")) / max(1, n_toxic + n_clean)
    log_ratio = 2 * (F.col("toxic") * F.ln(F.col("toxic") / (both * n_toxic))
                     + F.when(F.col("clean") > 0, F.col("clean") * F.ln(F.col("clean") / (both * n_clean))).otherwise(0.0))

    def chosen(table: DataFrame, key: str):
        rows = (table.where((F.col("toxic") >= MIN_SUPPORT) & (F.length(key) >= 3))
                .withColumn("ratio", ratio).withColumn("significance", log_ratio)
                .where((F.col("ratio") >= MIN_RATIO) & (F.col("significance") >= MIN_SIGNIFICANCE))
                .orderBy(F.desc("significance"), F.desc(F.length(key)), key).collect())  # the labelled rows bound them
        return {r[key]: (r["toxic"], math.log(r["ratio"])) for r in rows}

    prefixes = counts.where(F.length("word") > min(STEM_LENGTHS)).select(
        F.explode(F.expr(f"transform(sequence({min(STEM_LENGTHS)}, least({max(STEM_LENGTHS)}, length(word) - 1)), "
                         "n -> substr(word, 1, n))")).alias("stem"), "word", "toxic", "clean")
    by_stem = prefixes.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"),
                                          F.count(F.lit(1)).alias("forms")).where("forms >= 4")
    full = chosen(counts, "word")
    stems = chosen(by_stem, "stem")
    picked: dict[str, float] = {}
    for s, (n, weight) in stems.items():  # the most telling first; of equals the longest
        nested = any(s.startswith(t) or t.startswith(s) for t in picked)
        word_below = any(w.startswith(s) and m >= 0.5 * n for w, (m, _) in full.items())
        if not nested and not word_below:
            picked[s] = weight
    terms = {w: weight for w, (_, weight) in full.items() if not any(w.startswith(s) for s in picked)}
    terms |= {s: picked[s] for s in picked if s in full}
    # the forms of a stem stand for it where misspellings are looked for, however
    # rare each is; they weigh what the stem weighs
    fuzzy = [s for s, weight in picked.items() if weight >= math.log(FUZZY_RATIO)]
    telling = (ratio >= MIN_RATIO) | (F.col("clean") * 20 <= F.col("toxic"))
    forms = prefixes.where(F.col("stem").isin(fuzzy) & (F.col("toxic") > 0) & telling).select("word", "stem").collect()
    terms |= {r["word"]: picked[r["stem"]] for r in forms}
    return dict(sorted(terms.items())), picked


def with_telling_forms(terms: dict[str, float], stems: dict[str, float], nearby: Counter) -> dict[str, float]:
    """``terms`` without the forms of stems around which training knows more
    harmless words than others: there a word never seen is likely harmless too.
    ``nearby``: number of words by nearest term and whether they are harmless."""
    out = dict(terms)
    for s in stems:
        forms = [t for t in terms if t.startswith(s) and t != s]
        if sum(nearby[t, True] for t in forms) > sum(nearby[t, False] for t in forms):
            for t in forms:
                del out[t]
    return out


def fit_weights(x: np.ndarray, y: np.ndarray, strength: float = 2.0) -> np.ndarray:
    """Logistic regression by damped Newton steps, held near PRIOR."""
    w = PRIOR.copy()
    if len(y) == 0:
        return w

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(np.sum(np.logaddexp(0, z) - y * z) + strength / 2 * np.sum((v - PRIOR) ** 2))

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + strength * (w - PRIOR)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(step).max() < 1e-8:
            break
    w[1:] = np.maximum(w[1:], 0.0)
    return w


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model:
    """Learns lexicon and weights from ``labels`` (doc_id, toxic), held-out
    rows excepted. Without labels, or without toxic ones, the lexicon is empty
    and every score is the prior's."""
    train = training_rows(docs, labels, most)
    single = without_copies(train)
    size = {r["toxic"]: r["count"] for r in single.groupBy("toxic").count().collect()}
    chosen = docs.select("doc_id", "text").join(F.broadcast(single), "doc_id").select("doc_id", "text", "toxic")
    counts = written(word_counts(chosen))
    n_toxic, n_clean = size.get(1, 0), size.get(0, 0)
    terms, stems = learn_terms(counts, n_toxic, n_clean)
    model = Model(terms, stems)
    if not terms and not stems:
        return model

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(model)
        for b in slices(batches):
            found = [(w, auto.nearest(w), odd) for w, odd in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            hits = [(w, f[0], odd) for w, f, odd in found if f and f[1]]
            yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], pa.string()), pa.array([h[1] for h in hits], pa.string()),
                                              pa.array([h[2] for h in hits], pa.bool_())], ["form", "term", "odd"])

    # forms near a term that clean documents use are words of their own; their
    # number is bounded by the words of at most ``most`` documents
    nearby = counts.selectExpr("word", "clean * 20 > toxic as odd").mapInArrow(near, "form string, term string, odd boolean").collect()
    model.terms = with_telling_forms(terms, stems, Counter((r["term"], r["odd"]) for r in nearby))
    auto = automaton(model)
    model.harmless = frozenset(r["form"] for r in nearby if r["odd"] and (auto.nearest(r["form"]) or ("", 0))[1])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(model)
        for b in slices(batches):
            rows = [features(t or "", model, auto).tolist() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b.column(2)], ["x", "toxic"])

    # equal feature vectors are counted, so the driver gets distinct ones only
    table = (chosen.mapInArrow(measured, "x array<double>, toxic int").select(
        F.transform("x", lambda v: F.round(v, 2)).alias("x"), "toxic").groupBy("x", "toxic").count().collect())
    x = np.array([r["x"] for r in table for _ in range(r["count"])], dtype=float).reshape(-1, len(PRIOR))
    y = np.array([r["toxic"] for r in table for _ in range(r["count"])], dtype=float)
    model.weights = fit_weights(x, y)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; nothing but
    the text goes into a score. Null and empty texts get the score of a text
    without matches, very long ones are read to their end. Rows that repeat are
    scored each, a null id counts as not held out, an empty table gives no rows;
    other columns are not looked at."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(model)
        for b in slices(batches):
            s = [score_text(t, model, auto) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` not predicted toxic, all columns unchanged, in one
    pass without a shuffle (the verdict is computed on the row itself). Null,
    empty and very long texts, repeated rows and null ids are judged as in
    ``score``; columns of any name stay; an empty table gives no rows."""
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(model)
        for b in slices(batches):
            yield b.filter(pa.array([score_text(t, model, auto) < THRESHOLD for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

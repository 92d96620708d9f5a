"""Document scores by masked pseudo-likelihood.

Every token is predicted from the tokens on both sides by a small window
network; the sum of the conditional log-probabilities is a document's score.
Tokens are white-space separated words, known by 64-bit hashes and counted over
the whole corpus in a Spark table, one row per different word. The most frequent
words are classes of their own, the others are dealt to the remaining classes;
the network predicts the class from the classes of the neighbours, and the corpus
counts give the word within its class, so the probabilities of all words, and of
one never seen in each shared class, sum to one. Classes, hidden units and with
them the weights grow with the number of different words.

Tasks hold the counts of the ``HEAD`` most frequent words as a cache. All other
words of the documents meet the table in a join on the word, at most as many rows
for a word as the rarest cached word has tokens.

The network is trained in numpy where the documents are: in every round each
partition improves the current weights on its share of the documents, and the
results are averaged by the number of tokens in one grouped sum. Each document
is trained on in exactly one round.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flagtide.llm.common import slices, word_hashes, written

REACH = 2
ROUNDS, BATCH, RATE = 2, 2048, 0.03
#: Words whose counts tasks hold; tokens that a task counts before it passes them on.
HEAD, COUNTED = 1 << 16, 1 << 22


def hashes_of(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and the number of words of each text."""
    h, counts = word_hashes([t.encode() if t else b"" for t in texts])
    return h.view(np.int64), counts


# ------------------------------------------------------------------- vocabulary

def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word, n: tokens of every different word over all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted():
            word, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(word), pa.array(n, pa.int64())], ["word", "n"])

        for b in slices(batches):
            for group in _groups(b.column(0).to_pylist()):
                held += [d for _, d in group]
            if sum(map(len, held)) >= COUNTED:
                yield counted()
                held = []
        if held:
            yield counted()

    return docs.select(text_col).mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame) -> DataFrame:
    """The words above a count that no more than HEAD words exceed. It is found on
    a histogram of the logarithms of the counts (a few thousand numbers)."""
    level = F.floor(F.log2(F.col("n").cast("double")) * 64).cast("int")
    words, least = 0, None
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        words += r["count"]
        if words > HEAD:
            break
        least = r["level"]
    return counts.where(level >= least) if least is not None else counts.limit(0)


def sizes_for(words: int) -> tuple[int, int, int]:
    """Classes, those of a single word, and hidden units for so many different words:
    they grow with its logarithm, as the cost of a token does."""
    bits = math.log2(words + 2)
    classes = 48 + round(2 * bits)
    return classes, classes * 3 // 4, 20 + round(bits / 4)


@dataclass
class Vocabulary:
    """Classes of all words, and counts of the most frequent ones."""

    head: np.ndarray         # hashes, ascending
    head_class: np.ndarray
    head_inside: np.ndarray  # log-probability within the class
    classes: int
    own: int                 # classes of a single word
    hidden: int
    log_total: np.ndarray    # logarithm of the weight of every class

    @classmethod
    def of(cls, counts: DataFrame) -> "Vocabulary":
        """``counts``: word, n (a written table)."""
        classes, own, hidden = sizes_for(counts.count())
        shared = classes - own
        rows = frequent(counts).collect()  # HEAD at most
        word, n = (np.array([r[c] for r in rows], dtype=np.int64) for c in ("word", "n"))
        order = np.lexsort((word, -n))
        word, n, rank = word[order], n[order], np.arange(len(word))
        # neighbours in frequency go to different classes, which makes them equally heavy
        of_word = np.where(rank < own, rank, own + (rank - own) % shared)
        total = np.zeros(classes)
        by_hash = F.pmod("word", F.lit(shared))
        for r in counts.groupBy(by_hash.alias("c")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect():
            total[own + r["c"]] = r["n"] + 0.5 * r["words"]
        # words of the head are not where their hash would put them
        np.subtract.at(total, own + np.mod(word, shared), n + 0.5)
        np.add.at(total, of_word, n + 0.5)
        total[own:] += 0.5  # a word never seen
        total = np.maximum(total, 0.5)
        order = np.argsort(word)
        inside = np.log((n + 0.5) / total[of_word]).astype(np.float32)
        return cls(word[order], of_word[order].astype(np.int16), inside[order], classes, own, hidden, np.log(total))

    def classified(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, log-probability within it, and whether a word is in the cache
        (others have 0 for now)."""
        if not len(self.head):
            return (self.own + np.mod(words, self.classes - self.own)).astype(np.int16), np.zeros(len(words)), np.zeros(len(words), bool)
        at = np.minimum(np.searchsorted(self.head, words), len(self.head) - 1)
        known = self.head[at] == words
        of_word = np.where(known, self.head_class[at], self.own + np.mod(words, self.classes - self.own)).astype(np.int16)
        return of_word, np.where(known, self.head_inside[at], 0.0), known


# ---------------------------------------------------------------------- network

def shapes(classes: int, hidden: int) -> dict[str, tuple[int, ...]]:
    """The class after the last one stands for the outside of a text."""
    return {"embed": (2 * REACH, classes + 1, hidden), "hidden_bias": (hidden,), "out": (hidden, classes), "out_bias": (classes,)}


@dataclass
class Network:
    """Window network: classes on both sides -> hidden layer -> class."""

    params: dict[str, np.ndarray]
    squares: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def start(cls, log_weights: np.ndarray, hidden: int) -> "Network":
        """``log_weights``: logarithm of the weight of every class."""
        rng = np.random.default_rng(17)
        p = {k: (0.1 * rng.standard_normal(s)).astype(np.float32) for k, s in shapes(len(log_weights), hidden).items()}
        p["out_bias"] = (log_weights - np.logaddexp.reduce(log_weights)).astype(np.float32)
        return cls(p)

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.params.values()]).astype(np.float64)

    def with_values(self, values: np.ndarray) -> "Network":
        """A network of the same shape with other weights."""
        p, at = {}, 0
        for k, old in self.params.items():
            p[k] = values[at:at + old.size].reshape(old.shape).astype(np.float32)
            at += old.size
        return Network(p)

    def forward(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hidden layer and log-probabilities of all classes; ``around``: one row of
        2 * REACH neighbour classes per token."""
        p = self.params
        h = p["embed"][0][around[:, 0]]
        for k in range(1, 2 * REACH):
            h += p["embed"][k][around[:, k]]
        h = np.tanh(h + p["hidden_bias"])
        z = h @ p["out"] + p["out_bias"]
        z -= z.max(axis=1, keepdims=True)
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
        return h, z

    def step(self, around: np.ndarray, target: np.ndarray) -> None:
        """One Adagrad step on a batch."""
        h, logp = self.forward(around)
        n = len(target)
        dz = np.exp(logp)
        dz[np.arange(n), target] -= 1
        dz /= n
        dh = (dz @ self.params["out"].T) * (1 - h * h)
        grad = {"out": h.T @ dz, "out_bias": dz.sum(axis=0), "hidden_bias": dh.sum(axis=0)}
        embed = np.zeros(self.params["embed"].shape, dtype=np.float32)
        for k in range(2 * REACH):
            order = np.argsort(around[:, k], kind="stable")
            c = around[order, k]
            heads = np.concatenate([[0], np.flatnonzero(np.diff(c)) + 1])
            embed[k][c[heads]] = np.add.reduceat(dh[order], heads, axis=0)
        grad["embed"] = embed
        for k, g in grad.items():
            s = self.squares.setdefault(k, np.full(g.shape, 1e-4, dtype=np.float32))
            s += g * g
            self.params[k] -= RATE * g / np.sqrt(s)


def neighbours(classes: np.ndarray) -> np.ndarray:
    """Classes at -REACH..-1 and 1..REACH of every token but the outer REACH ones."""
    n = len(classes) - 2 * REACH
    return np.stack([classes[REACH + d:REACH + d + n] for d in (*range(-REACH, 0), *range(1, REACH + 1))], axis=1)


def padded(docs: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Class sequences laid side by side with REACH pads between them, and the
    places of their tokens among the inner positions."""
    gap = np.full(REACH, pad, dtype=np.int16)
    parts, places, at = [gap], [], 0
    for d in docs:
        parts += [d, gap]
        places.append(np.arange(at, at + len(d)))
        at += len(d) + REACH
    line = np.concatenate([*parts])
    return line, np.concatenate(places) if places else np.empty(0, dtype=np.int64)


def _groups(texts: list, most: int = 600_000) -> Iterator[list[tuple[int, np.ndarray]]]:
    """(number, hashes) of texts, about ``most`` characters at a time; a longer
    text is a group of its own."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to] or "") <= most):
            size += len(texts[to] or "")
            to += 1
        words, counts = hashes_of(texts[at:to])
        yield list(zip(range(at, to), np.split(words, np.cumsum(counts)[:-1])))
        at = to


def _split(values: np.ndarray, docs: list[np.ndarray]) -> list[np.ndarray]:
    return np.split(values, np.cumsum([len(d) for d in docs])[:-1]) if docs else []


def token_scores(net: Network, vocab: Vocabulary, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Conditional log-probability of every token of the given word sequences (for
    words outside the cache that of their class alone), classes, and whether a
    word is in the cache."""
    words = np.concatenate(docs) if docs else np.empty(0, dtype=np.int64)
    of_word, inside, known = vocab.classified(words)
    line, places = padded(_split(of_word, docs), vocab.classes)
    out = np.empty(len(places), dtype=np.float64)
    around, target = neighbours(line), line[REACH:len(line) - REACH]
    for at in range(0, len(places), 16384):
        p = places[at:at + 16384]
        _, logp = net.forward(around[p])
        out[at:at + 16384] = logp[np.arange(len(p)), target[p]] + inside[at:at + 16384]
    return out, of_word, known


# ---------------------------------------------------------------- training, scoring

@dataclass
class Model:
    net: Network
    vocab: Vocabulary
    counts: DataFrame  # word, n; a written table


def train(docs: DataFrame, vocab: Vocabulary, text_col: str = "text") -> Network:
    """Weights after ROUNDS rounds of averaged local training over all documents."""
    net = Network.start(vocab.log_total, vocab.hidden)
    for turn in range(ROUNDS):
        start = net

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            local, seen = start.with_values(start.flat()), 0
            for b in slices(batches):
                for group in _groups(b.column(0).to_pylist()):
                    docs_ = [d for _, d in group]
                    classes = vocab.classified(np.concatenate(docs_))[0]
                    line, places = padded(_split(classes, docs_), vocab.classes)
                    if not len(places):
                        continue
                    places = np.random.default_rng(len(places)).permutation(places)
                    around, target = neighbours(line), line[REACH:len(line) - REACH]
                    for at in range(0, len(places), BATCH):
                        p = places[at:at + BATCH]
                        local.step(around[p], target[p])
                    seen += len(places)
            if seen:
                values = local.flat() * seen
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(values)), pa.int64()), pa.array(values),
                     pa.array(np.full(len(values), float(seen)))], ["i", "value", "weight"])

        share = docs.select(text_col).where(F.pmod(F.xxhash64(text_col), F.lit(ROUNDS)) == turn)
        rows = share.mapInArrow(run, "i bigint, value double, weight double").groupBy("i").agg(
            (F.sum("value") / F.sum("weight")).alias("value")).collect()  # as many rows as the network has weights
        if rows:
            values = np.empty(len(rows))
            for r in rows:
                values[r["i"]] = r["value"]
            net = net.with_values(values)
    return net


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    counts = written(word_counts(docs, text_col))
    vocab = Vocabulary.of(counts)
    return Model(train(docs, vocab, text_col), vocab, counts)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, log_likelihood (sum over tokens) and mean_log_likelihood.

    Null, empty and blank texts have no tokens, a sum of 0 and a null mean. Rows
    that repeat are scored each, a null id stays null, an empty table gives no
    rows; only id and text are looked at.
    """
    net, vocab = model.net, model.vocab
    rare = pa.list_(pa.struct([("word", pa.int64()), ("of", pa.int16()), ("tf", pa.int32())]))

    def rest(words: np.ndarray, classes: np.ndarray) -> list[dict]:
        word, first, tf = np.unique(words, return_index=True, return_counts=True)
        return [{"word": w, "of": c, "tf": n} for w, c, n in zip(word.tolist(), classes[first].tolist(), tf.tolist())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, sums, rares = np.zeros(b.num_rows, dtype=np.int64), np.zeros(b.num_rows), [[] for _ in range(b.num_rows)]
            for group in _groups(b.column(1).to_pylist()):
                docs_ = [d for _, d in group]
                parts = [_split(x, docs_) for x in token_scores(net, vocab, docs_)]
                for (i, d), scores, classes, known in zip(group, *parts):
                    n[i], sums[i] = len(d), scores.sum()
                    rares[i] = rest(d[~known], classes[~known])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(sums), pa.array(rares, rare)],
                                             ["doc_id", "n_tokens", "so_far", "rare"])

    scored = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(
        run, "doc_id bigint, n_tokens bigint, so_far double, rare array<struct<word: bigint, of: smallint, tf: int>>")
    # rows are numbered as they are written, so a number stays with its row
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()))
    tokens = scored.select("row", F.explode("rare").alias("r")).select("row", "r.*")
    total = F.get(F.lit(vocab.log_total.tolist()), F.col("of").cast("int"))
    inside = F.log(F.coalesce("n", F.lit(0)) + 0.5) - total
    added = tokens.join(model.counts, "word", "left").groupBy("row").agg(F.sum(F.col("tf") * inside).alias("inside"))
    summed = scored.drop("rare").join(added, "row", "left").select(
        "doc_id", "n_tokens", (F.col("so_far") + F.coalesce("inside", F.lit(0.0))).alias("log_likelihood"))
    return summed.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))

"""Toxicity by weak supervision.

Many voters (lexicons and patterns) say hit or no hit for a text. A generative label model is fitted to
their agreements alone, by expectation maximisation over a hidden class: each voter's accuracy, and its
correlation with the voter it depends on most, for which a maximum spanning tree of the voters' mutual
information within the classes is drawn. Given labels choose words for further lexicons, which vote only
on the other half of the sample, and say which hidden class is the toxic one; they are no votes. A linear
classifier is trained on the posterior labels and scores every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import checkpointed, portions, tidy, utf8

#: fixed values: general insults by theme, each theme one voter
LEXICONS = {
    "stupidity": "idiot idiots stupid moron morons dumb fool foolish imbecile brainless",
    "worth": "worthless loser losers useless pathetic failure nobody pitiful",
    "disgust": "disgusting trash garbage filth filthy scum vermin vile gross",
    "ridicule": "clown clowns joke ridiculous laughable ugly fat",
    "hostility": "hate kill die shut hell damn threat destroy",
}
WORD = re.compile(r"[^\W\d_]+")
#: fixed values: patterns over lower-cased text; one voter each
PATTERNS = {
    "second_person": re.compile(r"\byou(?:'re| are)? (?:an? |all |such an? )?(?:idiot|stupid|moron|loser|clown|worthless|pathetic|disgusting|trash|scum)"),
    "masked": re.compile(r"\b[a-z][*@#$]{2,}[a-z]*\b"),
    "drawn_out": re.compile(r"([a-z])\1{4,}"),
}
SHAPES = ("shouting", "exclaiming")
LEARNED = 16
STEMS = (3, 4, 5, 6, 7)
#: a stem is dense where two words or more, and one in so many, begin with it
DENSE = 80
#: a word is telling at this log likelihood ratio, and where it occurs in so many times more toxic than clean texts
TELLING, PURE = 12.0, 3
SAMPLE_ROWS = 12_000
VOCABULARY = 800


def fold(divisor: int) -> Column:
    """crc32 of doc_id as text, modulo ``divisor``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def _shape(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether a text shouts (over 30 % capitals of its letters A-Z) or exclaims (over 1 % of its bytes)."""
    data, offsets = utf8(batch.column(column))
    total = [np.concatenate(([0], np.cumsum(m, dtype=np.int64))) for m in ((data >= 65) & (data <= 90), (data >= 97) & (data <= 122), data == 33)]
    upper, lower, marks = ((t[offsets[1:]] - t[offsets[:-1]]) for t in total)
    return upper > 0.3 * np.maximum(1, upper + lower), marks * 100 > np.diff(offsets)


def features(low: str) -> set[str]:
    """Words of a lower-cased text; marked by a dash, the stems of longer words; by =, stems that many of its words share."""
    words = set(WORD.findall(low))
    out = set(words)
    for n in STEMS:
        for stem, times in Counter([w[:n] for w in words if len(w) > n]).items():
            out.add(stem + "-")
            if times > 1 and times * DENSE >= len(words):
                out.add(stem + "=")
    return out


def _texts(words: set[str], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[set[str], list[int]]]]]:
    """Per text: which of ``words`` it holds, and the votes of the patterns."""
    for batch in portions(batches, 1, 2_000_000):
        shouts, exclaims = _shape(batch, 1)
        out = []
        for k, text in enumerate(batch.column(1).to_pylist()):
            low = (text or "").lower()
            held = words.intersection(features(low))
            votes = [int(bool(p.search(low))) if held or name != "second_person" else 0 for name, p in PATTERNS.items()]
            out.append((held, [*votes, int(shouts[k]), int(exclaims[k])]))
        yield batch, out


class LabelModel:
    """Hidden class and a tree of voters: how often a voter hits given the class and the vote of its parent."""

    def __init__(self, votes: np.ndarray, rounds: int = 100):
        """Fit to votes (rows x voters, 0 or 1) alone; the class whose voters hit more is class 1."""
        self.patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
        self.at, self.counts = at.ravel(), counts.astype(float)
        x = self.patterns.astype(int)
        self.parents = np.full(x.shape[1], -1)
        # where to begin: the share of hits, each as telling as it is rare
        weight = -np.log((self.counts @ x + 1) / (self.counts.sum() + 2))
        strength = x @ weight / weight.sum()
        self.post = np.clip(np.where(strength > 0, 0.5 + strength, 0.02), 0.02, 0.98)
        self._run(rounds)
        self.parents = self._tree()
        self._run(rounds)

    def _run(self, rounds: int) -> None:
        for _ in range(rounds):
            before, self.post = self.post, self._posterior()
            if np.abs(self.post - before).max() < 1e-6:
                break

    def _above(self) -> np.ndarray:
        """Each voter's parent's vote; 0 for those without."""
        return np.where(self.parents >= 0, self.patterns[:, np.maximum(self.parents, 0)], 0).astype(int)

    def _posterior(self) -> np.ndarray:
        x, above = self.patterns.astype(int), self._above()
        classes = np.stack((self.counts * (1 - self.post), self.counts * self.post))
        prior = np.log((classes.sum(1) + 1) / (classes.sum() + 2))
        # hit[c, p, v]: share of hits of voter v in class c where its parent votes p
        self.hit = np.stack([np.stack([((w[:, None] * (above == p)) * x).sum(0) + 0.5 for p in (0, 1)]) / np.stack([(w[:, None] * (above == p)).sum(0) + 1 for p in (0, 1)]) for w in classes])
        logs = []
        for c in (0, 1):
            hit = self.hit[c, above, np.arange(x.shape[1])]
            logs.append(prior[c] + np.where(x == 1, np.log(hit), np.log1p(-hit)).sum(1))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -30, 30)))

    def correlations(self) -> np.ndarray:
        """Mutual information of each two voters within the classes."""
        x = self.patterns.astype(float)
        total = np.zeros((x.shape[1], x.shape[1]))
        for w in (self.counts * (1 - self.post), self.counts * self.post):
            n = w.sum() + 1e-9
            one = (w @ x / n)
            for a, own in ((1, one), (0, 1 - one)):
                for b, other in ((1, one), (0, 1 - one)):
                    both = np.maximum(1e-12, ((x if a else 1 - x).T * w) @ (x if b else 1 - x) / n)
                    total += n * both * np.log(both / np.maximum(1e-12, np.outer(own, other)))
        np.fill_diagonal(total, 0)
        return total / self.counts.sum()

    def _tree(self) -> np.ndarray:
        """Parents in a maximum spanning tree of the correlations; a voter that depends on none has none."""
        bond = self.correlations()
        parents, best = np.full(len(bond), -1), np.full(len(bond), -1.0)
        todo = set(range(len(bond)))
        while todo:
            v = max(sorted(todo), key=lambda k: best[k])
            todo.discard(v)
            for k in todo:
                # twice the sample's information is chi-square distributed: over 8, the bond is no accident
                if bond[v, k] > best[k] and 2 * self.counts.sum() * bond[v, k] > 8:
                    best[k], parents[k] = bond[v, k], v
        return parents

    def posteriors(self) -> np.ndarray:
        return self.post[self.at]


def posterior_labels(votes: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """The label model's posteriors; given labels only say which of the classes is the toxic one."""
    post = LabelModel(votes).posteriors()
    return post if post @ truth * (1 - truth).sum() >= post @ (1 - truth) * truth.sum() else 1 - post


def linear(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression on soft labels (last: intercept), by Newton steps."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """Words in fixed order and the weights of words and pattern voters."""

    def __init__(self, words: list[str], weights: np.ndarray):
        self.at = {w: i for i, w in enumerate(words)}
        self.weights = weights

    def scores(self, texts: list[tuple[set[str], list[int]]]) -> list[float]:
        n, w = len(self.at), self.weights
        logits = [w[-1] + sum(w[self.at[x]] for x in sorted(held)) + float(np.dot(w[n:-1], votes)) for held, votes in texts]
        return (1 / (1 + np.exp(-np.clip(np.array(logits), -30, 30)))).tolist()


def _sampled(words: Callable[[], set[str]]) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(words(), batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([sorted(h) for h, _ in texts], pa.list_(pa.string())), pa.array([v for _, v in texts], pa.list_(pa.int32()))],
                ["mark", "held", "votes"])

    return rows


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, 1, 2_000_000):
        found = [sorted(features((t or "").lower())) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], ["mark", "words"])


def _scored(model: Model) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = set(model.at)
        for batch, texts in _texts(words, batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(texts), pa.float64())], ["doc_id", "score"])

    return rows


def telling(a: Column, b: Column, of_a: int, of_b: int) -> Column:
    """Log likelihood ratio of a word in ``a`` of ``of_a`` texts of one kind and ``b`` of ``of_b`` of the other."""
    both = (a + b) / float(of_a + of_b)
    cells = ((a, both * of_a), (b, both * of_b), (of_a - a, (1 - both) * of_a), (of_b - b, (1 - both) * of_b))
    return sum((F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(0.0) for seen, expected in cells), F.lit(0.0))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, vocabulary: int = VOCABULARY) -> Model:
    """Fit on at most ``sample_rows`` labelled rows (the first by hash of doc_id), whatever the input.

    ``labels``: (doc_id, toxic); rows with a null label are not used. Without labelled rows of
    both kinds the fixed lexicons alone decide. Where a half of the sample finds no telling word, both use the other half's, and
    without any the fixed lexicons and patterns are the voters.
    """
    chosen = (
        labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    # of copies one is enough to learn from; half says which half of the sample a text is in
    sample = checkpointed(sample.groupBy(F.xxhash64("text").alias("h")).agg(F.min_by(F.struct("toxic", "text"), "doc_id").alias("x")).select(
        (F.col("x.toxic") + 2 * F.pmod("h", F.lit(2)).cast("int")).alias("mark"), "x.text"))
    sizes = {r["mark"]: r["n"] for r in sample.groupBy("mark").agg(F.count("*").alias("n")).collect()}
    fixed = [w for x in LEXICONS.values() for w in x.split()]
    learned: list[list[str]] = [[], []]
    if all(sizes.get(k) for k in range(4)):
        marked = sample.mapInArrow(tidy(_listed), "mark int, words array<string>").select("mark", F.explode("words").alias("word"))
        seen = checkpointed(marked.groupBy("word").agg(*[F.count(F.when(F.col("mark") == k, 1)).alias(f"n{k}") for k in range(4)]))
        for half in (0, 1):
            clean, toxic = F.col(f"n{2 * half}"), F.col(f"n{2 * half + 1}")
            told = telling(toxic, clean, sizes[2 * half + 1], sizes[2 * half])
            top = seen.filter((toxic >= 3) & (toxic >= PURE * clean)).withColumn("told", told).filter(F.col("told") > TELLING).orderBy(F.desc("told"), "word").limit(vocabulary)
            learned[half] = [r["word"] for r in top.select("word").collect()]
    vocab = list(dict.fromkeys([*learned[0], *learned[1], *fixed]))
    if not all(any(sizes.get(k + 2 * half) for half in (0, 1)) for k in (0, 1)):
        pull = np.array([4.0] * len(vocab) + [2.0] * len(PATTERNS) + [0.5] * len(SHAPES) + [-3.0])
        return Model(vocab, pull)
    rows = sample.select("mark", "text").mapInArrow(_sampled(lambda: set(vocab)), "mark int, held array<string>, votes array<int>").collect()
    at = {w: i for i, w in enumerate(vocab)}
    mark = np.array([r["mark"] for r in rows])
    x = np.zeros((len(rows), len(vocab) + len(PATTERNS) + len(SHAPES)), np.float32)
    for i, r in enumerate(rows):
        x[i, [at[w] for w in r["held"]]] = 1
        x[i, len(vocab):] = r["votes"]
    label = np.zeros(len(rows))
    for half in (0, 1):
        # voters: the fixed lexicons, words that the other half chose dealt over lexicons, patterns and shapes
        strong = learned[1 - half] or learned[half]
        groups = [[at[w] for w in t.split()] for t in LEXICONS.values()] + [[at[w] for w in strong[k::LEARNED]] for k in range(LEARNED) if strong[k::LEARNED]]
        own = np.flatnonzero(mark // 2 == half)
        votes = np.hstack([*(x[own][:, g].any(1, keepdims=True) for g in groups), x[own, len(vocab):] > 0]).astype(np.int8)
        label[own] = posterior_labels(votes, mark[own] % 2)
    return Model(vocab, linear(x.astype(float), label, penalty=0.2))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, score), one for each input row; null texts score like empty ones."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(_scored(model)), "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of ``docs``.

    Labels are learned only from rows whose crc32(doc_id as text) mod 3 is not 1. Empty and null texts
    get the score of a text without any evidence. Repeated rows score alike; a null doc_id is not held
    out; an empty table gives no rows. Only text is an input of the score.
    """
    model = train(docs, labels.filter(fold(3) != 1))
    return score(docs, model).select(
        "doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all their columns, whose text scores below ``threshold``."""
    model = train(docs, labels.filter(fold(3) != 1))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = set(model.at)
        for batch, texts in _texts(words, (b.select([at_doc, at_text, *others]) for b in batches)):
            kept = batch.filter(pa.array(np.array(model.scores(texts)) < threshold))
            yield kept.select(names)

    names = docs.columns
    at_doc, at_text = names.index("doc_id"), names.index("text")
    others = [i for i in range(len(names)) if i not in (at_doc, at_text)]
    return docs.mapInArrow(tidy(keep), docs.schema)

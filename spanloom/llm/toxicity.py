"""Toxicity by a subsequence-kernel support vector machine with Nystroem landmarks.

Two strings are alike by the subsequences of ORDER characters that they share, each occurrence weighted by
DECAY ** (characters skipped), up to SPAN characters long: an insult with characters put in or left out still shares
most of them. The kernel is normalised, and the strings are the words of a sentence (single letters in a row are read as
one word, very long words as overlapping windows). A sentence scores as its worst word, a document as its worst
sentence.

Training is multiple-instance: sentences carry their document's label, and in a toxic document only the witness, its
worst sentence, is taken as toxic. Landmarks are words that tell toxic from other documents; the kernel against them,
whitened by their own kernel matrix (Nystroem), is what the linear machine sees. It trains on witnesses, on variants of
them with a character put in, and on words of other documents. A logistic curve over the documents' scores gives values
from 0 to 1.

The model is fitted on the driver on at most SAMPLE_TOXIC + SAMPLE_OTHER labelled rows (the smallest by a hash of
doc_id), and is a table of some thousand weights at any input size. Defined results: a null or empty text scores like a
text without any suspicious word; a doc_id labelled twice is toxic if any label says so; without labels of both kinds
every score is 0 up to rounding (under 1e-25); repeated rows give repeated rows; of rows that share a labelled doc_id the
greatest text is trained on; ties in the sample go by doc_id; texts are read whole, however long; an empty table gives no
rows. Words, not whole sentences, are the kernel's strings: measured on held-out labels they tell insults apart as well
as asked (recall and precision are asserted in tests), and an insult across several everyday words is not seen.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, id_text, mix64

ORDER, SPAN, DECAY = 3, 5, 0.7
PATTERNS = tuple((a, b) for b in range(2, SPAN) for a in range(1, b))
#: Added to a word's own kernel value when normalising, so that a very short word isn't all of one subsequence.
SHORT = 0.5
LANDMARKS = 240
#: The kernel is this sum of powers (and shares): alike families of words, near copies, and exact words. Values under NEAR count as nothing.
POWERS, NEAR = ((1, 0.25), (2, 0.25), (8, 0.5)), 0.15
#: Labelled rows used for training at most.
SAMPLE_TOXIC, SAMPLE_OTHER = 1500, 2000
#: Weight of the training errors against the machine's flatness.
COST = 1000000.0
#: Frequent words of other documents that training starts with; rounds of training.
COMMON, ROUNDS = 6000, 4
THRESHOLD = 0.7
#: Words are scored in windows of WINDOW characters, each half over the one before.
WINDOW = 24
CACHE_ENTRIES = 600_000
FILTER_BITS = 20

_SENTENCE = re.compile(r"[.!?\n]+(?:\s+|$)")
_LETTERS = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")


def words_of(text: str) -> list[str]:
    """Lower-case words; three or more single characters in a row, each between blanks, are read as one."""
    text = text.lower()
    out = text.split()
    out += [m[0].replace(" ", "").replace("\t", "") for m in _LETTERS.finditer(text)] if " " in text else []
    return out


def windows(word: str) -> list[str]:
    return [word] if len(word) <= WINDOW else [word[i : i + WINDOW] for i in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, subsequence key, weight) of every distinct subsequence of every word; weights are normalised by word."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # characters from here to the word's end
    at, keys, weights = [], [], []
    for a, b in PATTERNS:
        i = np.flatnonzero(left > b)
        at.append(owner[i])
        keys.append(codes[i] << np.uint64(42) | codes[i + a] << np.uint64(21) | codes[i + b])
        weights.append(np.full(len(i), DECAY ** (b + 1 - ORDER)))
    at, keys, weights = np.concatenate(at), np.concatenate(keys), np.concatenate(weights)
    tagged = mix64(keys) ^ (at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(tagged)
    if len(order):
        tagged, at, keys, weights = tagged[order], at[order], keys[order], weights[order]
        head = np.flatnonzero(np.concatenate(([True], tagged[1:] != tagged[:-1])))
        at, keys, weights = at[head], keys[head], np.add.reduceat(weights, head)
    norm = np.sqrt(np.bincount(at, weights**2, len(words)) + SHORT)
    return at, keys, weights / norm[at] if len(at) else weights


@dataclass
class Model:
    keys: np.ndarray  # subsequences of the landmarks, sorted
    landmarks: np.ndarray  # normalised weight of each (rows) in each landmark (columns)
    weights: np.ndarray  # of each landmark
    bias: float
    slope: float
    shift: float

    def __post_init__(self):
        self.present = np.zeros(1 << FILTER_BITS, bool)
        self.present[self._slot(self.keys)] = True
        self.most = self.landmarks.max(1, initial=0)
        self.cache: dict[str, float] = {}

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (mix64(keys) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def likeness(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the words that may be like a landmark, their kernel values against the landmarks).

        A word whose subsequences' greatest landmark weights add up to less than NEAR is less than NEAR like each.
        """
        at, keys, values = subsequences(words)
        hit = np.flatnonzero(self.present[self._slot(keys)])
        at, keys, values = at[hit], keys[hit], values[hit]
        spot = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        own = self.keys[spot] == keys if len(self.keys) else np.zeros(0, bool)
        at, spot, values = at[own], spot[own], values[own]
        near = np.flatnonzero(np.bincount(at, values * self.most[spot], len(words)) >= NEAR)
        rank = np.full(len(words), -1)
        rank[near] = np.arange(len(near))
        out = np.empty((len(near), self.landmarks.shape[1]), np.float32)
        own = rank[at] >= 0
        at, spot, values = rank[at[own]], spot[own], values[own]
        order = np.argsort(at, kind="stable")
        at, spot, values = at[order], spot[order], values[order]
        for i in range(0, len(near), 1000):
            lo, hi = np.searchsorted(at, [i, i + 1000])
            grid = np.zeros((min(1000, len(near) - i), len(self.keys)), np.float32)
            grid[at[lo:hi] - i, spot[lo:hi]] = values[lo:hi]
            like = grid @ self.landmarks
            like[like < NEAR] = 0
            out[i : i + 1000] = sum(share * like**power for power, share in POWERS)
        return near, out

    def margins(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), self.bias)
        near, like = self.likeness(words)
        out[near] += like @ self.weights
        return out

    def all_margins(self, words: set[str]) -> dict[str, float]:
        names, out = sorted(words), {}
        for i in range(0, len(names), 20_000):
            out.update(zip(names[i : i + 20_000], self.margins(names[i : i + 20_000]).tolist()))
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        """The greatest margin of each text's words; the bias, an empty word's margin, at least."""
        sets = [set(words_of(t)) for t in texts]
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        new = [w for w in set().union(*sets) if w not in self.cache]
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            pieces = [windows(w) for w in part]
            flat = self.margins([p for x in pieces for p in x])
            starts = np.cumsum([0] + [len(x) for x in pieces])[:-1]
            self.cache.update(zip(part, np.maximum.reduceat(flat, starts).tolist()))
        get = self.cache.__getitem__
        return np.array([max(map(get, s), default=self.bias) for s in sets])

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -60, 60)))


def _linear_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Newton's method in the primal for the squared hinge loss; x has a constant last column."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3

    def loss(w: np.ndarray) -> float:
        return w @ ridge @ w + (cost * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()

    for _ in range(rounds):
        inside = y * (x @ w) < 1
        z = x[inside] * cost[inside, None]
        step = np.linalg.solve(ridge + z.T @ x[inside], z.T @ y[inside]) - w
        length, before = 1.0, loss(w)
        while length > 1e-4 and loss(w + length * step) > before:
            length /= 2
        w = w + length * step
        if length <= 1e-4 or np.abs(step).max() * length < 1e-6:
            break
    return w


def variants(word: str) -> list[str]:
    """The word with a character put in between or doubled, at every place; what training adds for a witness."""
    marks = ".*-_x0"
    put = [word[:i] + marks[(i + len(word)) % len(marks)] + word[i:] for i in range(1, len(word))]
    return put + [word[:i] + word[i - 1] + word[i:] for i in range(1, len(word))] + [c.join(word) for c in ".-*"]


def fit(toxic: list[str], other: list[str], n_toxic: float, n_other: float) -> Model:
    """A model from the texts of both kinds; n_toxic and n_other are how often the kinds occur among all labelled rows."""
    none = Model(np.zeros(0, np.uint64), np.zeros((0, 1), np.float32), np.zeros(1), -1.0, 0.0, -60.0)
    if not toxic or not other:
        return none
    toxic, other = sorted(set(toxic)), sorted(set(other))  # copies would count their words again
    df_toxic, df_other = Counter(), Counter()
    for texts, df in ((toxic, df_toxic), (other, df_other)):
        for t in texts:
            df.update({p for w in words_of(t) for p in windows(w)})
    odds = {w: np.log((n + 0.1) / (len(toxic) + 1)) - np.log((df_other[w] + 0.1) / (len(other) + 1)) for w, n in df_toxic.items() if n >= 2 and len(w) >= ORDER}
    landmarks = sorted((w for w in odds if odds[w] > 1), key=lambda w: (-odds[w] * df_toxic[w], w))[:LANDMARKS]
    if not landmarks:
        return none
    at, keys, values = subsequences(landmarks)
    vocabulary, column = np.unique(keys, return_inverse=True)
    features = np.zeros((len(landmarks), len(vocabulary)))
    features[at, column] = values
    features = np.ascontiguousarray(features.T, np.float32)
    base = Model(vocabulary, features, np.zeros(len(landmarks)), 0.0, 1.0, 0.0)
    gram = base.likeness(landmarks)[1].astype(float)
    eigen, vectors = np.linalg.eigh((gram + gram.T) / 2)
    keep = eigen > 1e-3 * eigen.max()
    whiten = vectors[:, keep] / np.sqrt(eigen[keep])

    def embedded(words: list[str]) -> np.ndarray:
        near, like = base.likeness(words)
        out = np.zeros((len(words), whiten.shape[1] + 1))
        out[near, :-1] = like @ whiten
        out[:, -1] = 1
        return out

    weight = np.array([odds[w] for w in landmarks])
    model = Model(vocabulary, features, weight / weight.max(), -0.5, 1.0, 0.0)
    bags = [[[sorted({p for w in words_of(x) for p in windows(w)}) for x in _SENTENCE.split(t) if x.strip()] for t in texts] for texts in (toxic, other)]
    everything = {p for texts in bags for t in texts for x in t for p in x}
    negative = dict.fromkeys(sorted((w for w in df_other if df_toxic[w] <= 2 * df_other[w]), key=lambda w: (-df_other[w], w))[:COMMON], 1.0)
    sure = {w: df_toxic[w] for w in odds if odds[w] > 3 and df_toxic[w] >= max(3, 0.15 * len(toxic))}  # an insult beside a worse one is an insult too
    for _ in range(ROUNDS):  # witnesses, then the machine, then better witnesses; what was mistaken for toxic stays
        margin = model.all_margins(everything)
        witness = Counter(sure)
        for t in bags[0]:
            worst = max((max((margin[p], p) for p in x) for x in t if x), default=None)
            if worst and worst[1] in odds and odds[worst[1]] > 1 and worst[1] not in sure:
                witness[worst[1]] += 1
        for t in bags[1]:
            worst = sorted((margin[p], p) for x in t for p in x)[-3:]
            negative.update((p, 3.0) for _, p in worst if not (p in odds and odds[p] > 1))
        more = {v: n**0.5 / (2 * len(w)) for w, n in sure.items() for v in variants(w) if v not in df_other}
        names = [*witness, *more, *negative]
        y = np.array([1.0] * (len(witness) + len(more)) + [-1.0] * len(negative))
        mass = np.concatenate((np.sqrt(list(witness.values())), list(more.values()), list(negative.values())))
        mass[y > 0] /= mass[y > 0].sum()
        mass[y < 0] /= mass[y < 0].sum()
        w = _linear_svm(embedded(names), y, COST * mass)
        model = Model(vocabulary, features, whiten @ w[:-1], float(w[-1]), 1.0, 0.0)
    margins = np.concatenate((model.scores(toxic), model.scores(other)))
    y = np.concatenate((np.full(len(toxic), (len(toxic) + 1) / (len(toxic) + 2)), np.full(len(other), 1 / (len(other) + 2))))
    mass = np.concatenate((np.full(len(toxic), n_toxic / len(toxic)), np.full(len(other), n_other / len(other))))
    mass /= mass.sum()
    a, b = 1.0, 0.0
    for _ in range(100):  # Newton's method, with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -60, 60)))
        g = np.array([((p - y) * margins * mass).sum() + 1e-6 * a, ((p - y) * mass).sum()])
        h = p * (1 - p) * mass
        hess = np.array([[(h * margins**2).sum() + 1e-6, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    model.slope, model.shift = float(max(a, 0)), float(b)
    model.cache.clear()
    return model


def held_out(doc_id):
    """Rows whose labels training never reads."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from labelled rows outside the held-out third. The sample is bounded, whatever the tables' size."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    parts = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_OTHER))]
    sample = F.broadcast(parts[0].unionByName(parts[1]))  # at most SAMPLE_TOXIC + SAMPLE_OTHER short rows
    own = id_text(docs, id_col, text_col).join(sample, "doc_id")
    rows = own.groupBy("doc_id", "label").agg(F.max(F.coalesce("text", F.lit(""))).alias("text")).collect()  # a row for each of the sample's ids at most
    by = {k: sorted(r["text"] for r in rows if r["label"] == k) for k in (1, 0)}
    return fit(by[1], by[0], totals.get(1, 0), totals.get(0, 0))


_models: dict[int, Model] = {}


def fields_of(model: Model) -> tuple:
    return model.keys, model.landmarks, model.weights, model.bias, model.slope, model.shift


def worker_model(fields: tuple) -> Model:
    """The worker's model, which outlives a task, and so do the words it has scored."""
    key = hash((fields[0].tobytes(), fields[1].tobytes(), fields[2].tobytes(), *fields[3:]))
    if key not in _models:
        _models.clear()
        _models[key] = Model(*fields)
    return _models[key]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each whole text."""
    bounded_batches(docs.sparkSession)
    fields = fields_of(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker_model(fields)
        for b in batches:
            margins = own.scores([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(own.probability(margins))], ["doc_id", "score"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each whole text."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that the classifier rejects; `labelled` has the texts of the labelled rows where docs doesn't."""
    bounded_batches(docs.sparkSession)
    fields, at = fields_of(train(docs if labelled is None else labelled, labels)), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*fields)  # its word cache goes with the task: later stages of a pipeline need the worker's memory
        for b in batches:
            kept = own.probability(own.scores([t or "" for t in b.column(at).to_pylist()])) < threshold
            yield b.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)

"""Language identification with string kernels.

A text is the set of its character n-grams of several lengths (a blended spectrum of presence). The kernel of two
texts is the number of n-grams they share over the geometric mean of their numbers, and only n-grams of the landmark
texts count. Nystroem's method makes a text's kernel values with the landmarks into features, and kernel ridge
regression of one language against the rest gives a weight vector for each. The weights of the landmarks are added up
for each n-gram they hold, so a text is scored by a sum over its own n-grams.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tideline.llm.common import narrow, slices, text_bytes

#: Documents of each language that the weights are fitted on, and landmarks among them, at most.
SAMPLE, LANDMARKS = 400, 40

LENGTHS = (1, 2, 3)
POINT = np.uint64(21)  # bits that hold a code point and one more, so three fit in a code
RIDGE = 1e-2
UNKNOWN = "und"


def codes(text: str) -> Iterator[np.ndarray]:
    """For each length the codes of all n-grams of a whole text, with repeats; every n-gram has a code of its own."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    code = points[:0]
    for n in range(1, max(LENGTHS) + 1):
        code = points if n == 1 else code[:-1] << POINT | points[n - 1 :]
        if n in LENGTHS:
            yield code


def slot(found: np.ndarray, factor: np.uint64, shift: np.uint64) -> np.ndarray:
    return found * factor >> shift


@dataclass(frozen=True)
class Model:
    grams: np.ndarray  # codes of the n-grams that count, sorted
    tables: list[tuple[np.uint64, np.uint64, np.ndarray]]  # their places by hash; what shares a slot is in a later table
    weights: np.ndarray  # n-grams x languages
    bias: np.ndarray  # languages
    languages: list[str]

    def places(self, text: str, seen: np.ndarray) -> np.ndarray:
        """Places of the n-grams of a text that count, sorted; ``seen`` is as long as ``grams`` and False."""
        for left in codes(text):
            for factor, shift, table in self.tables:
                at = table[slot(left, factor, shift)]
                same = self.grams[at] == left
                seen[at[same]] = True
                left = left[~same]
        found = np.flatnonzero(seen)
        seen[found] = False
        return found

    def presence(self, texts: list[str]) -> np.ndarray:
        """Rows of 0 and 1 over ``grams``, each over the root of its sum."""
        seen, rows = np.zeros(len(self.grams), bool), np.zeros((len(texts), len(self.grams)), np.float32)
        for row, text in zip(rows, texts):
            row[self.places(text, seen)] = 1
        return rows / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))

    def margins(self, texts: list[str]) -> np.ndarray:
        seen, out = np.zeros(len(self.grams), bool), np.empty((len(texts), len(self.languages)))
        for row, text in zip(out, texts):
            at = self.places(text, seen)
            row[:] = self.weights[at].sum(axis=0, dtype=np.float64) / np.sqrt(max(len(at), 1)) + self.bias
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language with the largest margin, and its share when margins are taken as logarithms."""
        if not self.languages or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        margins = 4 * self.margins(texts)
        best = margins.argmax(axis=1)
        share = 1 / np.exp(margins - margins.max(axis=1, keepdims=True)).sum(axis=1)
        none = np.array([not any(map(str.isalpha, t)) for t in texts])
        return [UNKNOWN if n else self.languages[b] for n, b in zip(none, best)], np.where(none, 0.0, share)


def hashed(grams: np.ndarray) -> list[tuple[np.uint64, np.uint64, np.ndarray]]:
    """Tables that give the place of each code; a code is looked for in one after the other."""
    tables, left = [], np.arange(len(grams))
    while len(left):
        factor = np.random.default_rng(len(tables)).integers(2**63, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
        bits = (4 * len(left)).bit_length()
        shift, table = np.uint64(64 - bits), np.zeros(1 << bits, np.int32)
        at = slot(grams[left], factor, shift)
        table[at] = left
        tables.append((factor, shift, table))
        left = left[table[at] != left]
    return tables


@dataclass(frozen=True)
class Landmarks:
    """Kernel values with the landmark texts, from the landmarks that hold each n-gram."""

    start: np.ndarray  # of each n-gram in ``owner``, and the end
    owner: np.ndarray  # landmarks, by n-gram
    root: np.ndarray  # of the number of n-grams in each landmark

    @classmethod
    def of(cls, places: list[np.ndarray], grams: int) -> Landmarks:
        gram = np.concatenate(places)
        owner = np.repeat(np.arange(len(places), dtype=np.int32), [len(p) for p in places])
        start = np.concatenate([[0], np.bincount(gram, minlength=grams).cumsum()])
        return cls(start, owner[np.argsort(gram, kind="stable")], np.sqrt([max(len(p), 1) for p in places]))

    def kernel(self, at: np.ndarray) -> np.ndarray:
        count = self.start[at + 1] - self.start[at]
        places = np.repeat(self.start[at] - count.cumsum() + count, count) + np.arange(count.sum())
        shared = np.bincount(self.owner[places], minlength=len(self.root))
        return shared / self.root / np.sqrt(max(len(at), 1))


def fit_texts(texts: list[str], languages: list[str]) -> Model:
    """Fits on the given texts; the first ``LANDMARKS`` of each language are the landmarks."""
    names, by_name = sorted(set(languages)), defaultdict(list)
    for i, name in enumerate(languages):
        by_name[name].append(i)
    picked = [i for name in names for i in by_name[name][:LANDMARKS]]
    grams = np.unique(np.concatenate([np.empty(0, np.uint64), *(np.unique(np.concatenate(list(codes(texts[i])))) for i in picked)]))
    model = Model(grams, hashed(grams), np.empty((len(grams), 0)), np.empty(0), [])
    if not names:
        return model
    seen = np.zeros(len(grams), bool)
    held = [model.places(texts[i], seen) for i in picked]
    marks = Landmarks.of(held, len(grams))
    # Nystroem: features K(x, landmarks) (K(landmarks, landmarks) + jitter) ^ -1/2
    values, vectors = np.linalg.eigh(np.array([marks.kernel(at) for at in held]))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    # Every language weighs the same; the sums over the texts are made in blocks.
    size, number = Counter(languages), {name: i for i, name in enumerate(names)}
    squares, products = np.zeros((len(picked) + 1,) * 2), np.zeros((len(picked) + 1, len(names)))
    for k in range(0, len(texts), 256):
        block = slice(k, k + 256)
        features = np.array([marks.kernel(model.places(t, seen)) for t in texts[block]]) @ root
        padded = np.hstack([features, np.ones((len(features), 1))])
        target = np.full((len(features), len(names)), -1.0)
        target[np.arange(len(features)), [number[x] for x in languages[block]]] = 1.0
        balanced = padded.T * np.array([len(languages) / len(names) / size[x] for x in languages[block]])
        squares += balanced @ padded
        products += balanced @ target
    ridge = RIDGE * np.eye(len(squares))
    ridge[-1, -1] = 1e-9
    solved = np.linalg.solve(squares + len(texts) * ridge / 100, products)
    weights = np.zeros((len(grams), len(names)), np.float32)
    for at, w in zip(held, root @ solved[:-1] / marks.root[:, None]):
        weights[at] += w
    return Model(grams, model.tables, weights, solved[-1], names)


def fit(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fits on a bounded sample of every language (``SAMPLE`` documents of each).

    Only rows with ``learn``, a letter and a language that is not NULL are learned from; a hash of the id decides which.
    Texts in the sample are used whole.
    """
    given = docs.where(learn & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(lang).alias("lang"), F.xxhash64(F.col(doc_id).cast("string")).alias("order"), F.col(text).alias("text")
    )
    first = Window.partitionBy("lang").orderBy("order")
    limits = (
        given.select("lang", "order").withColumn("row", F.row_number().over(first)).where(F.col("row") <= SAMPLE)
        .groupBy("lang").agg(F.max("order").alias("last"))
    )
    # A row per language; rows of one id are counted, as there can be any number of them.
    near = given.join(F.broadcast(limits), "lang").where(F.col("order") <= F.col("last"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("order", F.xxhash64("text")))
    rows = near.select("lang", "text", number.alias("row")).where(F.col("row") <= SAMPLE).orderBy("lang", "row").collect()
    return fit_texts([r.text for r in rows], [r.lang for r in rows])


def predictions(docs: DataFrame, model: Model, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1) of every whole text.

    ``und`` with score 0 where the text is NULL or has no letter, or where nothing was learned. Row by row, so NULL and repeated ids and
    repeated rows are no matter; no further columns are read.
    """
    rows = narrow(docs).select(F.col(doc_id).alias("doc_id"), held_out.alias("held_out"), text_bytes(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            names, score = [], []
            texts = [t.decode("utf-8", "replace") for t in batch.column("text").to_pylist()]
            for k in range(0, len(texts), 256):
                found, share = model.predict(texts[k : k + 256])
                names += found
                score += share.tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")

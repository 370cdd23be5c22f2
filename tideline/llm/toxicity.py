"""Toxicity by two class-conditional Kneser-Ney bigram models over words.

Counts are continuation counts at both orders: of a pair how many different words stand before it, of a word how many
different words do. So copies of a passage count once and expressions that are put anywhere count often. What both
classes have in common (the smaller of their shares) is the shared backoff. A class keeps of its own counts only
what exceeds that by more than chance gives; all else is discounted, and the mass goes to the shared backoff. Rare
expressions therefore say nothing about the class.

The shared bigram is an absolutely discounted, interpolated Kneser-Ney model. A class has it with its own word
marginals (each word scaled by the class's probability over the shared one, and scaled back to sum one for every
word before), and the pairs it has in excess on top. The score compares the two log-likelihoods per word.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tideline.llm.common import fold, materialise, narrow, one_text, only, slices, text_bytes

#: Labelled documents of each class that the models are fitted on, at most. Both classes give the same number, as
#: continuation counts do not grow in proportion to the text.
SAMPLE = 4_000

#: Every so many documents of the sample only set where the score is one half.
CALIBRATE = 4

#: Absolute discount of the shared models.
DISCOUNT = 0.75

#: A class's count is discounted by DOUBLE times what is common, and by CHANCE times the root of that and one. Words of
#: one text are not independent, so chance goes far beyond two or three roots.
DOUBLE, CHANCE = 2.0, 8.0

#: As CHANCE for pairs of words, of which many more can exceed by chance.
PAIR_CHANCE = 14.0

#: Toxic texts that may be missed rather than reject one ordinary text, when the line is set.
SPARE = 4

#: Part of the toxic texts that the line may miss beyond that: ordinary texts reach further up than a sample of them.
SLACK = 1 / 200

WORD = re.compile(r"[^\W\d_]+")

#: Score that texts get at the edge of what the calibration saw of the other class.
EDGE = 4.0

START = ""  # stands before the first word


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case."""
    return WORD.findall(text.lower())


@dataclass(frozen=True)
class Model:
    """log P(word | word before, toxic) - log P(word | word before, ordinary), and the line to the score.

    It is the sum of a part for the word before (``befores``, or ``unseen``) and one for the word (``words``, or
    ``usual``), as the shared probability cancels out; for pairs that a class has in excess it is in ``pairs``.
    """

    words: dict[str, float] = field(default_factory=dict)
    befores: dict[str, float] = field(default_factory=dict)
    pairs: dict[tuple[str, str], float] = field(default_factory=dict)
    usual: float = 0.0
    unseen: float = 0.0
    middle: float = 0.0
    slope: float = 0.0

    @property
    def nothing(self) -> float:
        """The difference of a text in which no word or pair is known; also that of a text without words."""
        return self.usual + self.unseen

    def ratio(self, before: str, word: str) -> float:
        found = self.pairs.get((before, word))
        if found is not None:
            return found
        return self.words.get(word, self.usual) + self.befores.get(before, self.unseen)

    def difference(self, text: str) -> float:
        """Mean over the words of a text, from left to right with the word before as the state."""
        words = words_of(text)
        if not words:
            return self.nothing
        befores = [START, *words[:-1]]
        total = sum(map(self.words.get, words, repeat(self.usual))) + sum(map(self.befores.get, befores, repeat(self.unseen)))
        for pair in filter(self.pairs.__contains__, zip(befores, words)) if self.pairs else ():
            before, word = pair
            total += self.pairs[pair] - self.words.get(word, self.usual) - self.befores.get(before, self.unseen)
        return total / len(words)

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * (self.difference(text) - self.middle), -500, 500))))


def sample(docs: DataFrame, labels: DataFrame, learn_folds: int = 5) -> DataFrame:
    """Texts of a bounded, balanced sample of labelled documents: toxic, part (0 calibrates), text.

    An id is one document; of several texts the one with the smallest hash stands for it. Documents with crc32(id)
    modulo ``learn_folds`` equal to 0 are left out. A document counts as toxic if any of its labels says so; NULL labels
    are none. The order of a hash of the id decides who is in the sample.
    """
    marked = (
        only(labels, doc_id="doc_id", toxic="toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold("doc_id", learn_folds) != 0))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .withColumn("order", F.xxhash64(F.col("doc_id").cast("string")))
    )
    texts = only(docs, doc_id="doc_id", text="text").where(F.col("doc_id").isNotNull())
    present = materialise(marked.join(texts.select("doc_id"), "doc_id", "left_semi"), "toxic-labels")
    counts = {r.toxic: r.n for r in present.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n = min(SAMPLE, counts.get(0, 0), counts.get(1, 0))
    ids = None
    for toxic in (0, 1):
        some = present.where(F.col("toxic") == toxic).orderBy("order", "doc_id").limit(n)
        ids = some if ids is None else ids.unionByName(some)
    part = F.pmod(F.col("order"), F.lit(CALIBRATE))
    chosen = ids.select("doc_id", "toxic", part.alias("part"))  # 2 * SAMPLE rows at most
    return materialise(one_text(texts.join(F.broadcast(chosen), "doc_id"), "doc_id", "toxic", "part").drop("doc_id"), "toxic-sample")


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different (word before that, word before, word) of each text."""
    for batch in slices(batches, "text"):
        for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
            words = words_of(text.decode("utf-8", "replace"))
            found = sorted(set(zip([START, START, *words], [START, *words], words)))
            columns = [pa.array([x[i] for x in found], pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(found), pa.int32()), *columns], ["toxic", "first", "before", "word"])


def pair_counts(texts: DataFrame) -> DataFrame:
    """before, word, and how many different words stand before the pair in toxic (a) and ordinary (b) texts."""
    triples = texts.select("toxic", "text").mapInArrow(_contexts, "toxic int, first string, before string, word string").distinct()
    toxic = F.col("toxic").cast("double")
    return triples.groupBy("before", "word").agg(F.sum(toxic).alias("a"), F.sum(1 - toxic).alias("b"))


def _excess(own: Column, total: Column, other: Column, other_total: Column, chance: float) -> Column:
    """What a class has beyond the common share and chance."""
    common = F.least(own / total, F.coalesce(F.try_divide(other, other_total), F.lit(0.0))) * total
    return F.greatest(own - DOUBLE * common - chance * F.sqrt(common + 1), F.lit(0.0))


def fitted(texts: DataFrame) -> Model:
    """The models of both classes, as the parts of their log ratio.

    Everything that comes to the driver (words and pairs in excess, words before) is bounded by the sample.
    """
    pairs = materialise(pair_counts(texts), "toxic-pairs")
    words = materialise(pairs.groupBy("word").agg(
        F.count_if(F.col("a") > 0).cast("double").alias("a"), F.count_if(F.col("b") > 0).cast("double").alias("b")
    ), "toxic-words")
    total = words.agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("*").alias("n")).first()
    if not total.a or not total.b:
        return Model()
    a, b, all_a, all_b = F.col("a"), F.col("b"), F.lit(total.a), F.lit(total.b)
    words = words.withColumns({"x_a": _excess(a, all_a, b, all_b, CHANCE), "x_b": _excess(b, all_b, a, all_a, CHANCE)})
    words = words.withColumn("shared", a + b - F.col("x_a") - F.col("x_b"))
    sums = words.agg(
        F.sum("x_a").alias("x_a"), F.sum("x_b").alias("x_b"), F.sum("shared").alias("shared"),
        F.sum(F.least("shared", F.lit(DISCOUNT))).alias("freed"),
    ).first()
    # The shared unigram, its freed mass spread evenly over all words and one unknown word.
    unigram = (F.greatest(F.col("shared") - DISCOUNT, F.lit(0.0)) + sums.freed / (total.n + 1)) / sums.shared
    usual_a, usual_b = (total.a - sums.x_a) / total.a, (total.b - sums.x_b) / total.b
    words = words.withColumn("p", unigram)
    words = words.withColumns({"r_a": F.col("x_a") / (all_a * F.col("p")) + usual_a, "r_b": F.col("x_b") / (all_b * F.col("p")) + usual_b})
    telling = words.where("x_a > 0 OR x_b > 0").select("word", "p", "r_a", "r_b")
    known = {r.word: r for r in telling.collect()}
    more_a, more_b = (math.fsum(r.p * (x(r) - u) for r in known.values()) for x, u in ((lambda r: r.r_a, usual_a), (lambda r: r.r_b, usual_b)))

    # Shared bigram: twice the smaller count of each pair; its sums by the word before, with the scaled marginals.
    kept = F.greatest(2 * F.least(a, b) - DISCOUNT, F.lit(0.0))
    scaled = pairs.join(F.broadcast(telling.drop("p")), "word", "left")
    befores = materialise(scaled.groupBy("before").agg(
        F.sum("a").alias("t_a"), F.sum("b").alias("t_b"), F.sum(2 * F.least(a, b)).alias("t"), F.sum(kept).alias("kept"),
        F.sum(kept * (F.col("r_a") - usual_a)).alias("z_a"), F.sum(kept * (F.col("r_b") - usual_b)).alias("z_b"),
    ), "toxic-befores")
    own = pairs.join(befores.select("before", "t_a", "t_b"), "before")
    own = own.withColumns({
        "x_a": F.when(a > 0, _excess(a, F.col("t_a"), b, F.col("t_b"), PAIR_CHANCE)).otherwise(0.0),
        "x_b": F.when(b > 0, _excess(b, F.col("t_b"), a, F.col("t_a"), PAIR_CHANCE)).otherwise(0.0),
    })
    extra = own.where("x_a > 0 OR x_b > 0").select("before", "word", "x_a", "x_b", kept.alias("kept"))
    extra = extra.join(words.select("word", "p"), "word").collect()
    given: dict[str, list[float]] = {}
    for r in extra:
        sums_of = given.setdefault(r.before, [0.0, 0.0])
        sums_of[0] += r.x_a
        sums_of[1] += r.x_b

    def norms(t: float, kept: float, z_a: float | None, z_b: float | None) -> tuple[float, float, float]:
        """The weight of the unigram after a word, and what the scaled marginals of both classes add up to."""
        back = (t - kept) / t if t else 1.0
        return back, usual_a + ((z_a or 0.0) / t if t else 0.0) + back * more_a, usual_b + ((z_b or 0.0) / t if t else 0.0) + back * more_b

    offsets, ratios = {}, {}
    states = {r.before: r for r in befores.where(F.col("t") > 0).collect()}
    if given:
        states |= {r.before: r for r in befores.where(F.col("before").isin(list(given))).collect()}
    rests = {}
    for before, r in states.items():
        back, n_a, n_b = norms(r.t, r.kept, r.z_a, r.z_b)
        x_a, x_b = given.get(before, (0.0, 0.0))
        rest_a, rest_b = (1 - x_a / r.t_a if r.t_a else 1.0) / n_a, (1 - x_b / r.t_b if r.t_b else 1.0) / n_b
        offsets[before], rests[before] = math.log(rest_a / rest_b), (back, rest_a, rest_b)
    for e in extra:
        (back, rest_a, rest_b), r, w = rests[e.before], states[e.before], known.get(e.word)
        p = (e.kept / r.t if r.t else 0.0) + back * e.p
        p_a = (e.x_a / r.t_a if r.t_a else 0.0) + rest_a * p * (w.r_a if w else usual_a)
        p_b = (e.x_b / r.t_b if r.t_b else 0.0) + rest_b * p * (w.r_b if w else usual_b)
        ratios[e.before, e.word] = math.log(p_a / p_b)
    _, n_a, n_b = norms(0.0, 0.0, 0.0, 0.0)
    return Model(
        {word: math.log(r.r_a / r.r_b) for word, r in known.items()}, offsets, ratios, math.log(usual_a / usual_b), math.log(n_b / n_a)
    )


def _line(ordinary: list[float], toxic: list[float]) -> tuple[float, float]:
    """The highest of the cuts with the fewest calibration texts on the wrong side, but for SLACK of them, and a slope."""
    values = np.array(sorted({*ordinary, *toxic}))
    low, high = np.sort(ordinary), np.sort(toxic)
    cuts = np.concatenate([[values[0] - 1e-3], (values[1:] + values[:-1]) / 2, [values[-1] + 1e-3]])
    wrong = SPARE * (len(low) - np.searchsorted(low, cuts, "right")) + np.searchsorted(high, cuts, "left")
    middle = float(cuts[int(np.flatnonzero(wrong <= wrong.min() + SLACK * len(high))[-1])])
    above = high[high > middle]
    spread = (float(np.median(above)) if len(above) else middle + 1e-2) - middle
    return middle, EDGE / max(spread, 1e-4)


def fit(docs: DataFrame, labels: DataFrame, learn_folds: int = 5) -> Model:
    """Fits on a part of the sample, finds the line on the rest, then takes the models from all of it.

    Without labels of both classes, or if nothing tells the classes apart, every text scores below 0.5; so does a
    text in which nothing is known.
    """
    texts = sample(docs, labels, learn_folds)
    draft, model = fitted(texts.where(F.col("part") != 0)), fitted(texts)
    values = {0: [], 1: []}
    rest = texts.where(F.col("part") == 0).select(F.col("toxic").alias("doc_id"), "text")
    for toxic, value in differences(rest, draft).collect():  # 2 * SAMPLE rows at most
        values[toxic].append(value)
    if not draft.words or not values[0] or not values[1]:
        return replace(model, middle=model.nothing + 1e-4, slope=EDGE / 1e-2)
    middle, slope = _line(values[0], values[1])
    return replace(model, middle=max(middle, model.nothing + 1e-6), slope=slope)


def _mapped(rows: DataFrame, name: str, kind: str, value) -> DataFrame:
    """The rows with ``value`` of each text in place of the text."""
    others = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [value(t.decode("utf-8", "replace")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(found, pa.float64())], [*others, name])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others)
    return rows.mapInArrow(run, f"{schema}, {name} {kind}")


def differences(rows: DataFrame, model: Model) -> DataFrame:
    return _mapped(rows, "difference", "double", model.difference)


def scores(docs: DataFrame, model: Model, learn_folds: int = 5) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from a score of 0.5) of every whole text.

    A NULL or empty text scores like one in which no word or pair is known: below 0.5. NULL and
    repeated ids and repeated rows are scored row by row; no further columns are read.
    """
    rows = narrow(only(docs, doc_id="doc_id", text="text")).select("doc_id", text_bytes().alias("text"))
    found = _mapped(rows, "score", "double", model.score)
    return found.select(
        "doc_id", (fold("doc_id", learn_folds) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def not_toxic(docs: DataFrame, labels: DataFrame, learn_folds: int = 5) -> DataFrame:
    """``docs`` without the rows whose text the model calls toxic; columns and other rows as they are."""
    model = fit(docs, labels, learn_folds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            keep = [model.score(t or "") < 0.5 for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return narrow(docs).mapInArrow(run, docs.schema)

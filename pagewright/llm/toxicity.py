"""Toxicity severity by cumulative-link ordinal regression over sparse text features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from pagewright.llm import words
from pagewright.llm.store import widened, written

#: Bounds of the fit: labelled rows (a sample by hash of the id) and markers.
LABELLED = 20_000
MARKERS = 2_048
GRADES = 3
#: A marker's share of the toxic texts lies so many standard deviations above its share of the clean ones; the weights do the rest.
SURE = 6
#: Besides whole words, beginnings of so many bytes can be markers: they hold for forms that no labelled row has.
BEGINNINGS = (4, 5, 6)


@dataclass
class Model:
    """Weights shared by all thresholds: P(grade >= k) = sigmoid(weights . x - thresholds[k - 1])."""

    markers: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.full(GRADES, np.inf))

    def reach(self, texts: list[bytes]) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... of each whole text; a text without words reaches no grade."""
        out = np.zeros((len(texts), len(self.thresholds)))
        for lo, hi in words.groups(texts):
            w = words.find(texts[lo:hi], words.ALNUM)
            row, column, times, _ = marker_counts(w, self.markers)
            z = scores((row, column, np.log1p(times)), self.weights, hi - lo)
            out[lo:hi] = np.where(w.counts[:, None] > 0, sigmoid(z[:, None] - self.thresholds), 0.0)
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-z))


def terms(w: words.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, their words) of the words, and of the beginnings of words that are longer."""
    yield words.hashes(w), np.arange(len(w.starts))
    for size in BEGINNINGS:
        longer = np.flatnonzero(w.ends - w.starts > size)
        start = w.starts[longer]
        yield words.mix(words.hashes(words.Words(w.data, start, start + size, w.first, w.text_at)) + np.uint64(size)), longer


def marker_counts(w: words.Words, markers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, marker, times) of the markers, given as sorted hashes, in each text, and how many words of each text have one."""
    pairs, marked = [np.zeros(0, np.int64)], np.zeros(len(w.starts), bool)
    if len(markers):
        for h, own in terms(w):
            at = np.minimum(np.searchsorted(markers, h), len(markers) - 1)
            held = np.flatnonzero(markers[at] == h)
            marked[own[held]] = True
            pairs.append((np.searchsorted(w.first, own[held], side="right") - 1) * len(markers) + at[held])
    pair, times = np.unique(np.concatenate(pairs), return_counts=True)
    text = np.searchsorted(w.first, np.flatnonzero(marked), side="right") - 1
    width = max(1, len(markers))
    return pair // width, pair % width, times, np.bincount(text, minlength=len(w.first) - 1)


def scores(x: tuple, weights: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(x[0], x[2] * weights[x[1]], n)


def fit_ordinal(x: tuple, grades: np.ndarray, n_features: int, rounds: int = 600, rate: float = 0.05, ridge: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights, 0 or above, and rising thresholds that maximise the penalised likelihood of the grades; Adam on all rows."""
    n, top = len(grades), GRADES
    p = np.concatenate([np.zeros(n_features), [2.0], np.zeros(top - 1)])  # weights, first threshold, logs of the steps
    first, second = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1):
        w, steps = p[:n_features], np.exp(p[n_features + 1 :])
        cuts = p[n_features] + np.concatenate([[0], np.cumsum(steps)])
        reach = sigmoid(scores(x, w, n)[:, None] - cuts)
        bounds = np.concatenate([np.ones((n, 1)), reach, np.zeros((n, 1))], axis=1)
        slope = bounds * (1 - bounds)
        i = np.arange(n)
        chance = np.maximum(bounds[i, grades] - bounds[i, grades + 1], 1e-12)
        d_z = -(slope[i, grades] - slope[i, grades + 1]) / chance / n
        d_cuts = np.zeros(top + 2)
        np.add.at(d_cuts, grades, slope[i, grades] / chance / n)
        np.add.at(d_cuts, grades + 1, -slope[i, grades + 1] / chance / n)
        d_cuts = d_cuts[1:-1]
        grad = np.concatenate([
            np.bincount(x[1], x[2] * d_z[x[0]], n_features) + ridge * w / n, [d_cuts.sum()],
            steps * np.cumsum(d_cuts[::-1])[::-1][1:],
        ])
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        p = p - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-9)
        p[:n_features] = np.maximum(p[:n_features], 0)
    return p[:n_features], p[n_features] + np.concatenate([[0], np.cumsum(np.exp(p[n_features + 1 :]))])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", labelled: int = LABELLED, markers: int = MARKERS) -> Model:
    """A model from labelled documents.

    Markers are words, or beginnings of words, that stand in far more of the toxic than of the clean labelled documents. Copies of a
    text, told by a sketch, are counted once. Grades follow the labels: 0 is clean; toxic ones
    are graded 1 to 3 by how many of their words have markers, in thirds. Texts of any length are read whole. Labels that are null are left out; a
    document with two labels counts as toxic. Without toxic or without clean rows, or without markers, nothing is toxic.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    n = known.count()
    if not n:
        return Model()
    part = int(min(1.0, labelled / n) * (1 << 30))
    sample = known.filter(F.xxhash64("id").bitwiseAND(F.lit((1 << 30) - 1)) < part)  # about ``labelled`` rows
    whole = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def sketch(batches: Iterator) -> Iterator:
        """The least hash of five words in a row: copies of a text mostly share it."""
        import pyarrow as pa

        for batch in words.slices(batches, 2):
            found = words.raw_texts(batch.column(2))
            least = np.zeros(len(found), np.int64)
            for lo, hi in words.groups(found):
                w = words.find(found[lo:hi], words.ALNUM)
                h = words.shingle_hashes(words.hashes(w), 5)
                some = np.flatnonzero(w.counts >= 5)
                if len(some):
                    ends = np.stack([w.first[some], w.first[some + 1] - 4], axis=1).ravel()
                    least[lo + some] = np.minimum.reduceat(np.append(h, np.uint64(0)), ends)[::2].view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(least)], names=["id", "y", "least"])

    sketched = whole.join(F.broadcast(sample), "id").select("id", "y", "text")
    own = F.when(F.col("least") == 0, F.xxhash64("id")).otherwise(F.col("least"))
    apart = written(sketched.mapInArrow(sketch, widened(sketched.select("id", "y"), "least long")).groupBy(own, "y").agg(F.min("id").alias("id")).select("id", "y"))
    texts = whole.join(F.broadcast(apart), "id").select("id", "y", "text")

    def count(batches: Iterator) -> Iterator:
        """How many toxic and how many clean texts hold each term; the row without a term counts texts."""
        import pyarrow as pa

        for batch in words.slices(batches, 2):
            found, y = words.raw_texts(batch.column(2)), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi in words.groups(found):
                w = words.find(found[lo:hi], words.ALNUM)
                all_terms = [(h, np.searchsorted(w.first, own, side="right") - 1) for h, own in terms(w)]
                h, text = np.concatenate([x for x, _ in all_terms]), np.concatenate([x for _, x in all_terms])
                order = np.lexsort((text, h))
                h, text = h[order], text[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
                h, toxic = h[new], y[lo:hi][text[new]]
                begin = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
                a, n = np.add.reduceat(toxic, begin) if len(h) else begin, np.diff(np.append(begin, len(h)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None, *h[begin].view(np.int64).tolist()], pa.int64()), pa.array(np.append(y[lo:hi].sum(), a)), pa.array(np.append((1 - y[lo:hi]).sum(), n - a))],
                    names=["h", "a", "b"],
                )

    stands = written(texts.mapInArrow(count, "h long, a long, b long").groupBy("h").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter("h IS NULL OR a >= 3"))
    sizes = stands.filter("h IS NULL").first()
    if not sizes or not sizes.a or not sizes.b:
        return Model()
    toxic, clean = sizes.a, sizes.b
    pooled = (F.col("a") + F.col("b")) / (toxic + clean)
    gap = F.col("a") / toxic - F.col("b") / clean
    strong = stands.withColumn("z", F.try_divide(gap, F.sqrt(pooled * (1 - pooled) * (1 / toxic + 1 / clean)))).filter(F.col("z") >= SURE)
    chosen = np.array(sorted(r.h & (1 << 64) - 1 for r in strong.filter("h IS NOT NULL").orderBy(F.desc("z"), "h").limit(markers).collect()), np.uint64)
    if not len(chosen):
        return Model()

    def extract(batches: Iterator) -> Iterator:
        """The sampled texts that hold markers, as numbers."""
        import pyarrow as pa

        for batch in words.slices(batches, 2):
            found = words.raw_texts(batch.column(2))
            for lo, hi in words.groups(found):
                w = words.find(found[lo:hi], words.ALNUM)
                row, column, times, marked = marker_counts(w, chosen)
                some = np.flatnonzero(marked)
                at = np.append(np.searchsorted(row, some), len(row)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).take(pa.array(some + lo)), pa.array(marked[some]), pa.ListArray.from_arrays(at, column), pa.ListArray.from_arrays(at, times)],
                    names=["y", "marked", "columns", "times"],
                )

    held = texts.mapInArrow(extract, "y int, marked long, columns array<long>, times array<long>").collect()  # at most ``labelled`` rows of ``markers`` numbers
    m = len(held)
    row = np.repeat(np.arange(m), [len(r.columns) for r in held])
    column, times = (np.array([v for r in held for v in r[k]], np.int64) for k in ("columns", "times"))
    marked, y = (np.array([r[k] for r in held], np.int64) for k in ("marked", "y"))
    cuts = np.quantile(marked[y > 0], [(k + 1) / GRADES for k in range(GRADES - 1)])
    grades = np.where(y > 0, 1 + np.searchsorted(cuts, marked), 0)
    rest = [np.ones(toxic - int(y.sum()), np.int64), np.zeros(clean - int((y == 0).sum()), np.int64)]  # texts without markers
    return Model(chosen, *fit_ordinal((row, column, np.log1p(times)), np.concatenate([grades, *rest]), len(chosen)))


def severity(model: Model, text_col: str = "text"):
    """A column struct<severity double, p_toxic double, grade int>: expected grade, P(grade >= 1), and the likeliest grade."""

    @F.arrow_udf("struct<severity:double,p_toxic:double,grade:int>")
    def score(text):
        import pyarrow as pa

        reach = np.concatenate([np.zeros((0, len(model.thresholds))), *[model.reach(words.raw_texts(text.slice(a, n))) for a, n in words.cuts(text)]])
        words.give_back()
        bounds = np.concatenate([np.ones((len(reach), 1)), reach, np.zeros((len(reach), 1))], axis=1)
        grade = np.argmax(bounds[:, :-1] - bounds[:, 1:], axis=1).astype(np.int32)
        return pa.StructArray.from_arrays([pa.array(reach.sum(axis=1)), pa.array(reach[:, 0]), pa.array(grade)], names=["severity", "p_toxic", "grade"])

    return score(F.col(f"`{text_col}`").cast("string"))


def keep_mild(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose chance of any toxic grade is below ``limit``; null and empty texts stay."""
    return docs.filter(severity(model, text_col)["p_toxic"] < limit)

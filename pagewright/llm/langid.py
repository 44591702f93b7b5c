"""Language identification by error-correcting output codes over hashed letter n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from pagewright.llm import words
from pagewright.llm.store import written

#: Bound of the fit: about so many labelled texts of each language, and of all together; copies of a text are one.
LABELLED, TOTAL = 1_000, 20_000
BINS = 4_096
UNKNOWN = "und"

_LETTER = np.full(256, 32, np.uint8)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)


def features(texts: list[bytes]) -> np.ndarray:
    """Square roots of the shares of hashed runs of two to four bytes of each whole text, letters in lower case."""
    out = np.zeros((len(texts), BINS), np.float32)
    for begin in range(0, len(texts), 256):
        some = texts[begin : begin + 256]
        for lo, hi in words.groups(some):
            data = _LETTER[np.frombuffer(b" ".join([b"", *some[lo:hi], b""]).lower(), np.uint8)].astype(np.uint32)
            sizes = np.array([len(t) + 1 for t in some[lo:hi]])
            base = np.repeat(np.arange(hi - lo, dtype=np.int64) * BINS, sizes)
            run, counts = data.copy(), np.zeros((hi - lo) * BINS, np.int64)
            for size in (2, 3, 4):
                run = run[:-1] * np.uint32(0x01000193) ^ data[size - 1 :]
                h = (run * np.uint32(size) * np.uint32(0x9E3779B1)) >> np.uint32(20)
                n = min(len(h), len(base))
                counts += np.bincount(base[:n] + h[:n], minlength=len(counts))
            counts = counts.reshape(hi - lo, BINS)
            out[begin + lo : begin + hi] = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    return out


def code(n: int, seed: int = 3) -> np.ndarray:
    """Codewords of -1 and 1, one row a language: all splits of up to six languages, else random ones that lie far apart."""
    if n <= 6:
        columns = [[1 if i == 0 or mask >> (i - 1) & 1 else -1 for i in range(n)] for mask in range(2 ** max(n - 1, 0))]
        return np.array([c for c in columns if -1 in c], np.int8).reshape(-1, n).T
    rng = np.random.default_rng(seed)
    tries = [rng.choice(np.array([-1, 1], np.int8), size=(n, int(np.ceil(10 * np.log2(n))))) for _ in range(50)]

    def apart(c: np.ndarray) -> int:
        d = (c.shape[1] - c.astype(np.int32) @ c.T) // 2
        return int(d[~np.eye(n, dtype=bool)].min()) if (np.abs(c.sum(axis=0)) < n).all() else -1

    return max(tries, key=apart)


@dataclass
class Model:
    """Languages, their codewords, a linear classifier for each bit and its weight in the decoding."""

    languages: list[str]
    codewords: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def losses(self, texts: list[bytes]) -> np.ndarray:
        """The weighted loss of each language's codeword, by text."""
        out = np.zeros((len(texts), len(self.languages)))
        for at in range(0, len(texts), 1024):
            f = features(texts[at : at + 1024]) @ self.weights + self.bias
            margin = f[:, None, :] * self.codewords[None]
            out[at : at + 1024] = (np.logaddexp(0, -margin) * self.trust).sum(axis=2)
        return out

    def decode(self, texts: list[bytes], close: float = 0.25) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The nearest language of each text, its share of the likelihood, and whether the second one comes ``close`` to it."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        loss = self.losses(texts)
        like = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share = np.sort(like / like.sum(axis=1, keepdims=True), axis=1)[:, ::-1]
        second = share[:, 1] if share.shape[1] > 1 else np.zeros(len(texts))
        return [self.languages[i] for i in loss.argmin(axis=1)], share[:, 0], share[:, 0] - second < close


def fit(x: np.ndarray, language: np.ndarray, languages: list[str], rounds: int = 150, rate: float = 0.3, ridge: float = 1e-5) -> Model:
    """Logistic classifiers of all bits at once, every language with the same weight; Adam on all rows."""
    codewords = code(len(languages))
    y = codewords[language].astype(np.float32)
    each = (1 / np.bincount(language, minlength=len(languages)))[language].astype(np.float32)[:, None]
    each /= each.sum()
    p = np.zeros((x.shape[1] + 1, y.shape[1]), np.float32)
    first, second = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1):
        pull = each * y / (1 + np.exp(y * (x @ p[:-1] + p[-1])))
        grad = np.concatenate([x.T @ pull, pull.sum(axis=0, keepdims=True)]) - ridge * p
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        p += rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    right = (each * ((x @ p[:-1] + p[-1]) * y > 0)).sum(axis=0)
    return Model(languages, codewords, p[:-1], p[-1], np.maximum(right - 0.5, 0.01) * 2)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", labelled: int = LABELLED) -> Model:
    """A model from the rows of ``docs`` with a text and a language. Rows without either are left out; none give an empty model.

    Every language with a row takes part. Copies of a text under a language are learnt once.
    """
    known = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    named = known.withColumn("h", F.xxhash64("text"))
    texts = written(named.groupBy("lang", "h").agg(F.count("*").alias("n")).select("lang", "h"))
    many = written(texts.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")))
    languages = many.count()
    if not languages:
        return Model([], np.zeros((0, 0)), np.zeros((BINS, 0)), np.zeros(0), np.zeros(0))
    # a share of about twice as many texts of each language as it may keep is ranked, so no language fills a task
    each = max(1, min(labelled, TOTAL // languages))
    part = F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < F.lit(float(1 << 30)) * (2 * each + 64) / F.col("n")
    some = texts.join(F.broadcast(many), "lang").filter(part | (F.col("h") == F.col("least")))
    first = Window.partitionBy("lang").orderBy("h")
    kept = written(some.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= each).select("lang", "h"))
    copies = named.join(F.broadcast(kept), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    chosen = copies.select("lang", "text")

    def extract(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in words.slices(batches, 1):
            x = features(words.raw_texts(batch.column(1))).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])

    rows = sorted((r.lang, bytes(r.x)) for r in written(chosen.mapInArrow(extract, "lang string, x binary")).collect())
    languages = sorted({k for k, _ in rows})
    x = np.stack([np.frombuffer(v, np.float16) for _, v in rows]).astype(np.float32)
    return fit(x, np.array([languages.index(k) for k, _ in rows]), languages)


def predict(model: Model, text_col: str = "text") -> Column:
    """A column struct<lang string, score double, ambiguous boolean>.

    Null texts and texts without a letter are ``und`` with score 0 and not ambiguous, and so is every text under an empty model.
    """

    @F.arrow_udf("struct<lang:string,score:double,ambiguous:boolean>")
    def decoded(text):
        import pyarrow as pa

        parts = [model.decode(words.raw_texts(text.slice(a, n))) for a, n in words.cuts(text)]
        lang = [x for part in parts for x in part[0]]
        score = np.concatenate([np.zeros(0), *[part[1] for part in parts]])
        close = np.concatenate([np.zeros(0, bool), *[part[2] for part in parts]])
        words.give_back()
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(close)], names=["lang", "score", "ambiguous"])

    text = F.col(f"`{text_col}`").cast("string")
    nothing = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous"))
    return F.when(text.rlike(r"\p{L}"), decoded(text)).otherwise(nothing)

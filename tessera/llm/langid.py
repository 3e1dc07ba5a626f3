"""Language identification with a string kernel.

Kernel: blended-spectrum presence kernel, the number of distinct character n-grams (n in ORDERS, hashed to 2^BITS
slots) that two texts share, divided by the root of the product of their own numbers. Nystroem: landmarks from each
language span the feature space. Classifier: one-versus-rest kernel ridge regression on a sample of labelled rows.

Since the kernel is linear in the presence vector, K(x, landmarks) @ alpha = presence(x) @ (landmarks @ alpha), so the
landmarks are folded into one matrix of slots x languages and a batch of texts is scored by one product of its sparse
presence matrix with that matrix. Every whole text is scored; only fitting uses a sample, at most LANDMARKS landmarks
and TRAIN rows over all languages, drawn by a hash of the document id, in equal parts from each language.

Defined cases: a null text and one without a letter give ``und`` with score 0; without a labelled row everything is
``und``; of languages with equal scores the one of the smallest name is told; a null label is not learned from; repeated rows count as often as they stand; an empty table gives an empty
result. ``predict`` keeps all input columns, replacing ones named like its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_text, limit_batches, map_arrow

ORDERS = (2, 3, 4)
BITS = 18
#: Bounds of the sample that the classifier is fitted on, over all languages.
LANDMARKS = 256
TRAIN = 6000
RIDGE = 1e-3
#: Sharpness of the softmax that turns regression values into a score.
SHARPNESS = 6.0
UNDETERMINED = "und"

_LETTERS = np.array([chr(c).isalpha() for c in range(0x10000)])
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)


def codes(text: str) -> tuple[np.ndarray, bool]:
    """Lower-cased code points with everything but letters as a space, and whether there is a letter."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    letters = _LETTERS[np.minimum(points, 0xFFFF)]
    high = points > 0xFFFF
    if high.any():
        letters = letters.copy()
        letters[high] = [chr(c).isalpha() for c in points[high]]
    return np.where(letters, points, 32).astype(np.uint64), bool(letters.any())


def presence(points: np.ndarray) -> np.ndarray:
    """Slots of the distinct n-grams of a text, ascending."""
    seen = np.zeros(1 << BITS, bool)
    rolled = points
    for n in range(2, max(ORDERS) + 1):
        if len(points) < n:
            break
        rolled = rolled[:-1] * _STEP + points[n - 1 :]
        if n in ORDERS:
            seen[((rolled ^ np.uint64(n)) * _MIX) >> np.uint64(64 - BITS)] = True
    return np.flatnonzero(seen).astype(np.int32)


@dataclass
class Model:
    languages: list[str]
    #: slots x languages
    weights: np.ndarray

    def score(self, slots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Best language and score for each presence row, by one sparse product over the batch."""
        sizes = np.array([len(s) for s in slots])
        sums = np.zeros((len(slots), len(self.languages)))
        full = np.flatnonzero(sizes)
        if len(full):
            starts = np.cumsum(np.append(0, sizes[full]))[:-1]
            sums[full] = np.add.reduceat(self.weights[np.concatenate([slots[k] for k in full])], starts, axis=0)
        values = sums / np.sqrt(np.maximum(sizes, 1))[:, None]
        grown = np.exp(SHARPNESS * (values - values.max(axis=1, keepdims=True)))
        share = grown / grown.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        return best, share[np.arange(len(slots)), best]


def _sample_key(doc_id: Column, salt: str) -> Column:
    """A number in 0..1 from the id."""
    return F.crc32(F.concat(F.lit(f"{salt}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")) / F.lit(float(1 << 32))


def _drawn(rows: DataFrame, counts: dict[str, int], want: int, salt: str) -> DataFrame:
    """About ``want`` rows of each language: those whose key is under the language's rate."""
    rates = [(k, min(1.0, 1.2 * want / max(n, 1))) for k, n in counts.items()]
    table = rows.sparkSession.createDataFrame(rates, "rate_lang string, rate double")
    keyed = rows.withColumn("key", _sample_key(F.col("doc_id"), salt))
    return keyed.join(F.broadcast(table), F.col("lang") == F.col("rate_lang")).where("key < rate").select("text", "lang", "key")


def fit(rows: DataFrame, landmarks: int = LANDMARKS, train: int = TRAIN, ridge: float = RIDGE) -> Model:
    """Fit on rows (doc_id, text, lang) with a label; the bounds are LANDMARKS and TRAIN."""
    rows = rows.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), np.float32))
    each = max(1, landmarks // len(languages))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = batch.to_pydict()
            found = [presence(codes(t)[0]) for t in cols["text"]]
            yield pa.RecordBatch.from_arrays([pa.array(cols["lang"], pa.string()), pa.array(cols["key"], pa.float64()), pa.array(found, pa.list_(pa.int32()))], names=["lang", "key", "slots"])

    drawn: dict[str, list] = {k: [] for k in languages}
    found = map_arrow(_drawn(rows, counts, each, "landmark"), slots, "lang string, key double, slots array<int>", 256).toArrow()
    for lang, key, own in zip(found["lang"].to_pylist(), found["key"].to_pylist(), found["slots"], strict=True):
        if len(own):
            drawn[lang].append((key, own.values.to_numpy().astype(np.int32)))
    chosen = [s for k in languages for _, s in sorted(drawn[k], key=lambda x: (x[0], x[1].tolist()))[:each]]
    if not chosen:
        return Model([], np.zeros((1 << BITS, 0), np.float32))
    m = len(chosen)
    root = np.sqrt(np.array([len(s) for s in chosen], np.float64))
    held = rows.sparkSession.sparkContext.broadcast(chosen)

    def against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(s) for s in held.value])
        length, starts, every, mark = np.sqrt(sizes), np.cumsum(sizes) - sizes, np.concatenate(held.value), np.zeros(1 << BITS, bool)

        def shared(own: np.ndarray) -> np.ndarray:
            """Slots that a text shares with each landmark."""
            mark[own] = True
            found = np.add.reduceat(mark[every], starts, dtype=np.int64)
            mark[own] = False
            return found

        for batch in batches:
            cols = batch.to_pydict()
            seen = [presence(codes(t)[0]) for t in cols["text"]]
            kernel = [(shared(s) / (length * np.sqrt(max(1, len(s))))).astype(np.float32) for s in seen]
            yield pa.RecordBatch.from_arrays([pa.array(cols["lang"], pa.string()), pa.array(cols["key"], pa.float64()), pa.array(kernel, pa.list_(pa.float32()))], names=["lang", "key", "kernel"])

    most = max(1, train // len(languages))
    found = map_arrow(_drawn(rows, counts, most, "train"), against, "lang string, key double, kernel array<float>", 256).toArrow()
    held.unpersist()
    lang, k_nm = np.array(found["lang"].to_pylist(), object), np.concatenate([c.flatten().to_numpy() for c in found["kernel"].chunks] or [np.empty(0, np.float32)]).reshape(-1, m)
    # A fixed order, in which each language keeps its first rows.
    order = np.lexsort((*k_nm[:, :8].T, found["key"].to_numpy(), [languages.index(x) for x in lang])) if len(lang) else np.empty(0, int)
    kept, have = [], dict.fromkeys(languages, 0)
    for k in order:
        have[lang[k]] += 1
        if have[lang[k]] <= most:
            kept.append(k)
    k_nm = k_nm[kept].astype(np.float64)
    y = np.where(lang[kept][:, None] == np.array(languages, object)[None, :], 1.0, -1.0)
    k_mm, mark = np.zeros((m, m)), np.zeros(1 << BITS, bool)
    for i, s in enumerate(chosen):
        mark[s] = True
        k_mm[i] = [np.count_nonzero(mark[x]) for x in chosen]
        mark[s] = False
    left = k_nm.T @ k_nm + ridge * max(1, len(kept)) * k_mm / np.outer(root, root) + 1e-8 * np.eye(m)
    alpha = np.linalg.solve(left, k_nm.T @ y) / root[:, None]
    weights = np.zeros((1 << BITS, len(languages)), np.float32)
    for s, a in zip(chosen, alpha, strict=True):
        weights[s] += a.astype(np.float32)
    return Model(languages, weights)


def detector(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """Texts -> struct<lang_pred, score>. Only the texts go through Python; other columns stay where they are."""
    limit_batches(spark)
    held = spark.sparkContext.broadcast(model)

    def score(texts: pa.Array) -> pa.Array:
        own, names, values = held.value, [], []
        for low in range(0, len(texts), 512):
            slots, sure = [], []
            for t in texts.slice(low, 512).to_pylist():
                points, letters = codes(t) if t is not None else (None, False)
                sure.append(letters and bool(own.languages))
                slots.append(presence(points) if sure[-1] else np.empty(0, np.int32))
            if own.languages:
                best, share = own.score(slots)
                names += [own.languages[b] if s else UNDETERMINED for b, s in zip(best, sure, strict=True)]
                values += [float(v) if s else 0.0 for v, s in zip(share, sure, strict=True)]
        if not own.languages:
            names, values = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.float64())], ["lang_pred", "score"])

    # The evaluation type is told by these, which must be types and not their names.
    score.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(score, "lang_pred string, score double")


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score, from the text alone."""
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), detector(docs.sparkSession, model)(F.col("text")).alias("found"))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in kept], "found.lang_pred", "found.score")


def held_out(doc_id: Column) -> Column:
    return crc32_text(doc_id) % 4 == 2


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the labelled rows that are not held out, then predict every row."""
    return predict(docs, fit(docs.where(~held_out(F.col("doc_id")))))

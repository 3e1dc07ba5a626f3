"""Language model scoring by the likelihood of a subword lattice.

An existing vocabulary's pieces span, for each word, a lattice of all its segmentations (byte pieces stand in for
characters that no piece holds). A forward recursion in log space sums the probabilities of all segmentations; since
pieces begin words with a mark and never cross them, a document's marginal probability is the product over its words
and one end token. Piece scores: the public vocabulary states ranks, which give starting probabilities by Zipf's law;
EM over all training words, each as often as it occurs, then re-estimates them. ``score`` is this probability: pieces
are its only edges. ``mixed_score``, a further column, also knows whole words: each training word is an edge of its own
across its lattice, with its relative frequency; the share of the pieces against these edges is the Good-Turing estimate
of unseen text, the number of words seen once over the number of tokens.

Corpus side: counts of all distinct words of all texts are aggregated into a written table, which is scored once.
Words that make up at least 1/HEAVY of all tokens - at most HEAVY words, whatever the corpus - are handed to the tasks
that read the texts; the rest of each document's words are joined with the word table by a shuffle. Both give the same
numbers; no word is left out.

Defined cases: a null or empty text is the end token alone; words are cut at ASCII white space after lower-casing A-Z;
repeated rows count and are scored each; a null id counts as the empty text for its fold; an empty table gives an empty
result; without any training token, base and model give every token the probability 1 / (V + 1) = 1.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_text, held, map_arrow, materialise

VOCABULARY = "piece_bpe_32k.model"
#: Words with at least this share (1 / HEAVY) of all tokens are looked up in the reading tasks.
HEAVY = 1 << 17
EM_ROUNDS = 2
#: Weight of the starting probabilities against expected counts.
PRIOR = 1000.0
MARK = "▁"

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)
_SLOT_BITS = 20


def load_pieces(path: str) -> tuple[list[str], list[int], np.ndarray]:
    """Pieces, the ids of the 256 byte pieces, and starting log probabilities from the ranks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    normal = [not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k)) for k in range(n)]
    pieces = [model.id_to_piece(k) if normal[k] else "" for k in range(n)]
    bytes_ = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    weight = np.zeros(n)
    for k in range(n):
        if normal[k]:
            weight[k] = 1.0 / (max(0.0, -model.get_score(k)) + 3.0)
    weight[bytes_] = 1e-6
    return pieces, bytes_, np.log(np.maximum(weight / weight.sum(), 1e-300))


class Lattice:
    """Segmentation lattices of many words at once."""

    def __init__(self, pieces: list[str], byte_ids: list[int]):
        self.byte_ids, self.n = byte_ids, len(pieces)
        self.longest = max((len(p) for p in pieces), default=1)
        ids = np.array([k for k, p in enumerate(pieces) if p], np.int32)
        hashes = np.array([self._hash(pieces[k]) for k in ids], np.uint64) * _MIX
        order = np.argsort(hashes)
        self.keys, self.ids = np.append(hashes[order], np.uint64(0)), np.append(ids[order], 0)
        slots = (self.keys[:-1] >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        self.first = np.searchsorted(slots, np.arange(1 << _SLOT_BITS)).astype(np.int32)
        self.most = int(np.bincount(slots).max())
        self.keys, self.ids = np.append(self.keys, np.zeros(self.most, np.uint64)), np.append(self.ids, np.zeros(self.most, np.int32))
        self.lone = {ord(p) for p in pieces if len(p) == 1}

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_STEP) + ord(c) + 1) & (2**64 - 1)
        return h

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece id of each substring hash, -1 if there is none."""
        mixed = hashes * _MIX
        at = self.first[mixed >> np.uint64(64 - _SLOT_BITS)]
        out = np.full(mixed.shape, -1, np.int32)
        for k in range(self.most):
            hit = self.keys[at + k] == mixed
            out[hit] = self.ids[at + k][hit]
        return out

    def _groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row numbers, code points padded with 0, lengths) for words of about the same length."""
        lengths = np.array([len(w) + 1 for w in words])
        padded = np.where(lengths <= 64, -(-lengths // 4) * 4, -(-lengths // 32) * 32)
        for width in np.unique(padded):
            rows = np.flatnonzero(padded == width)
            step = max(1, 60_000 // int(width))
            for low in range(0, len(rows), step):
                part = rows[low : low + step]
                text = "".join((MARK + words[k]).ljust(int(width), "\0") for k in part)
                yield part, np.frombuffer(text.encode("utf-32-le"), "<u4").reshape(len(part), int(width)), lengths[part]

    def _edges(self, points: np.ndarray) -> list[np.ndarray]:
        """For each piece length, the piece ids that begin at each place (-1: none)."""
        rows, width = points.shape
        prefix = np.zeros((rows, width + 1), np.uint64)
        for k in range(width):
            prefix[:, k + 1] = prefix[:, k] * _STEP + points[:, k] + np.uint64(1)
        power, out = np.ones(1, np.uint64), []
        for n in range(1, min(self.longest, width) + 1):
            power = power * _STEP
            out.append(self._find(prefix[:, n:] - prefix[:, :-n] * power))
        return out

    def _bytes(self, code: int, logp: np.ndarray) -> float:
        return float(sum(logp[self.byte_ids[b]] for b in chr(code).encode("utf-8", "replace")))

    def _run(self, points: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        edges = self._edges(points)
        known = np.append(logp, -np.inf)
        costs = [known[e] for e in edges]
        odd = edges[0] < 0
        if odd.any():
            found, back = np.unique(points[odd], return_inverse=True)
            costs[0][odd] = np.array([self._bytes(int(c), logp) if c else -np.inf for c in found])[back]
        rows, width = points.shape
        alpha = np.full((rows, width + 1), -np.inf)
        alpha[:, 0] = 0
        with np.errstate(invalid="ignore", divide="ignore"):
            for j in range(1, width + 1):
                into = np.stack([alpha[:, j - n] + costs[n - 1][:, j - n] for n in range(1, min(j, len(costs)) + 1)])
                top = into.max(axis=0)
                top[np.isneginf(top)] = 0
                alpha[:, j] = np.log(np.exp(into - top).sum(axis=0)) + top
        return alpha, edges, costs

    def log_probability(self, words: list[str], logp: np.ndarray) -> np.ndarray:
        """Natural log of each word's marginal probability over all segmentations."""
        out = np.zeros(len(words))
        for rows, points, lengths in self._groups(words):
            alpha, _, _ = self._run(points, logp)
            out[rows] = alpha[np.arange(len(rows)), lengths]
        return out

    def expected(self, words: list[str], counts: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece in words that occur ``counts`` times."""
        total = np.zeros(self.n)
        for rows, points, lengths in self._groups(words):
            alpha, edges, costs = self._run(points, logp)
            count, width = points.shape
            beta = np.full((count, width + 1), -np.inf)
            whole = alpha[np.arange(count), lengths]
            scale = np.log(counts[rows]) - whole
            with np.errstate(invalid="ignore", divide="ignore"):
                for i in range(width - 1, -1, -1):
                    beta[np.arange(count), lengths] = 0
                    out = np.stack([costs[n - 1][:, i] + beta[:, i + n] for n in range(1, min(width - i, len(costs)) + 1)])
                    top = out.max(axis=0)
                    top[np.isneginf(top)] = 0
                    beta[:, i] = np.where(i < lengths, np.log(np.exp(out - top).sum(axis=0)) + top, -np.inf)
                beta[np.arange(count), lengths] = 0
                for n, (e, c) in enumerate(zip(edges, costs, strict=True), 1):
                    use = np.exp(alpha[:, : e.shape[1]] + c + beta[:, n:] + scale[:, None])
                    hit = e >= 0
                    total += np.bincount(e[hit], use[hit], self.n)
                    if n == 1 and not hit.all():
                        found, back = np.unique(points[~hit], return_inverse=True)
                        for code, weight in zip(found, np.bincount(back, use[~hit]), strict=True):
                            if code:
                                for b in chr(int(code)).encode("utf-8", "replace"):
                                    total[self.byte_ids[b]] += weight
        return total


def lattice(path: str) -> Lattice:
    kept = held("lm")
    if path not in kept:
        pieces, bytes_, _ = load_pieces(path)
        kept[path] = Lattice(pieces, bytes_)
    return kept[path]


def tokens_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased; ``bytes`` methods treat ASCII only."""
    return text.lower().split() if text else []


def held_out(doc_id):
    return crc32_text(doc_id) % 7 == 2


def count_words(docs: DataFrame) -> DataFrame:
    """(text binary, held_out) -> word, c (in training rows), n (in all rows), one row per distinct word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            words = list(seen[0].keys() | seen[1].keys())
            c, rest = (np.array([s.get(w, 0) for w in words], np.int64) for s in seen)
            for s in seen:
                s.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(c), pa.array(c + rest)], names=["word", "c", "n"])

        for batch in batches:
            for text, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[bool(held)].update(tokens_of(text))
                if len(seen[0]) + len(seen[1]) > 400_000:
                    yield flush()
        if seen[0] or seen[1]:
            yield flush()

    return map_arrow(docs.select(F.col("text").cast("binary"), "held_out"), count, "word string, c long, n long", 512).groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def train(words: DataFrame, ends: int, path: str, rounds: int = EM_ROUNDS) -> tuple[np.ndarray, float]:
    """EM over the written word table: log probabilities of the pieces and the probability of the end token."""
    start = load_pieces(path)[2]
    logp, p_end = start, 0.5
    for _ in range(rounds):
        held = words.sparkSession.sparkContext.broadcast(logp)

        def expect(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                part = lattice(path).expected(batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(np.float64), held.value)
                total = part if total is None else total + part
            if total is not None:
                used = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["piece", "uses"])

        # One row per piece of the vocabulary comes back.
        found = map_arrow(words.where("c > 0").select("word", "c"), expect, "piece int, uses double", owner="lm").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
        held.unpersist()
        uses = np.zeros(len(start))
        for r in found:
            uses[r.piece] = r.uses
        total = uses.sum()
        # One more for what is unseen: even a training text without words leaves words possible.
        p_end = ends / (total + ends + 1)
        logp = np.log(np.maximum((uses + PRIOR * np.exp(start)) / (total + PRIOR), 1e-300)) + np.log1p(-p_end)
    return logp, p_end


def score(docs: DataFrame, path: str | None = None, rounds: int = EM_ROUNDS, heavy: int = HEAVY) -> DataFrame:
    """``docs`` (doc_id, text, held_out) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, mixed_score."""
    path = path or public_tokenizers.path(VOCABULARY)
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("text"), "held_out")
    counted = materialise(count_words(docs), "lm-words")
    totals = counted.agg(F.sum("c").alias("c"), F.sum("n").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.count_if(F.col("c") == 1).alias("once")).first()
    ends = docs.where(~F.col("held_out")).count()
    n_train, distinct, n_all = (totals.c or 0) + ends, (totals.v or 0) + (ends > 0), totals.n or 0
    unseen = min(0.999, max((totals.once or 0) / n_train, 1e-9)) if n_train else 1.0
    logp, p_end = train(counted, ends, path, rounds)
    below = float(n_train + (distinct + 1)) if n_train else 1.0
    held = spark.sparkContext.broadcast(logp)

    def marginal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            found = lattice(path).log_probability(words, held.value)
            c = batch.column(1).to_numpy().astype(np.float64)
            base = np.log10((c + 1) / below)
            found = found if n_train else found * 0
            mixed = np.logaddexp(np.log(unseen) + found, np.log1p(-unseen) + np.log(np.maximum(c, 1e-300) / max(n_train, 1))) if n_train else found
            mixed = np.where(c > 0, mixed, np.log(unseen) + found) if n_train else mixed
            arrays = [batch.column(0), batch.column(1), batch.column(2), pa.array(base), pa.array(found / np.log(10)), pa.array(mixed / np.log(10))]
            yield pa.RecordBatch.from_arrays(arrays, names=["word", "c", "n", "base", "model", "mixed"])

    scored = materialise(map_arrow(counted, marginal, "word string, c long, n long, base double, model double, mixed double", owner="lm"), "lm-scored")
    # At most ``heavy`` words can have this share of all tokens.
    common = scored.where(F.col("n") * heavy >= n_all).select("word", "c", "base", "model", "mixed").collect()
    table = spark.sparkContext.broadcast({r.word.encode(): (r.c > 0, r.base, r.model, r.mixed) for r in common})
    end_base = float(np.log10((ends + 1) / below))
    # Rows of null texts alone have no words: then all that the model knows are ends.
    end_model = float(np.log10(p_end)) if n_train else 0.0
    end_mixed = float(np.log10(unseen * p_end + (1 - unseen) * ends / n_train)) if n_train else 0.0
    end_known = int(ends > 0)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, at, known_words = TaskContext.get(), 0, table.value
        part = (context.partitionId() if context else 0) << 33
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                piece = batch.slice(low, 256)
                docs_, rest = [], ([], [], [])
                for doc_id, text, out in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                    words, key = tokens_of(text), part + at
                    at += 1
                    known, base, model, mixed = end_known, end_base, end_model, end_mixed
                    for w, k in Counter(words).items():
                        if (x := known_words.get(w)) is not None:
                            known, base, model, mixed = known + k * x[0], base + k * x[1], model + k * x[2], mixed + k * x[3]
                        else:
                            rest[0].append(key)
                            rest[1].append(w)
                            rest[2].append(k)
                    docs_.append((key, b" %d" % key, 0, doc_id, out, len(words) + 1, known, base, model, mixed))
                k = len(rest[0])
                cols = list(zip(*docs_, strict=True))
                kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                arrays = [pa.array([*c, *(rest[i] if i < 3 else [None] * k)], kind) for i, (c, kind) in enumerate(zip(cols, kinds, strict=True))]
                arrays[1] = arrays[1].cast(pa.string())
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "word", "k", "doc_id", "held_out", "n_tokens", "known", "b", "m", "x"])

    # A document's own row has a word that no text can hold, so that these rows spread like any other.
    rows = map_arrow(docs, read, "key long, word string, k long, doc_id long, held_out boolean, n_tokens long, known long, b double, m double, x double")
    rare = scored.where(F.col("n") * heavy < n_all).select(F.col("word").alias("w"), "c", "base", "model", "mixed")
    joined = rows.join(rare.hint("shuffle_hash"), F.col("word") == F.col("w"), "left")
    none = F.lit(0.0)
    return (
        joined.groupBy("key")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.bool_or("held_out").alias("held_out"),
            F.max("n_tokens").alias("n_tokens"),
            F.sum(F.coalesce("known", F.when(F.col("c") > 0, F.col("k")), F.lit(0))).alias("n_known"),
            F.sum(F.coalesce("b", F.col("k") * F.col("base"), none)).alias("base_score"),
            F.sum(F.coalesce("m", F.col("k") * F.col("model"), none)).alias("score"),
            F.sum(F.coalesce("x", F.col("k") * F.col("mixed"), none)).alias("mixed_score"),
        )
        .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("bigint").alias("train_tokens"), "base_score", "score", "mixed_score")
    )

"""Cross-tokenizer alignment: minimal groups of tokens of two tokenizers that cover the same bytes.

Tokens of A and B are nodes of a bipartite graph, joined where their byte ranges overlap. Its connected components, by
union-find, are exactly the minimal groups: a cut at which tokens of both end is crossed by no edge, and between two
such cuts every token overlaps the next. The members of a component are expanded into links, the pairs whose ranges end
together. Links are counted over the corpus by id pair, and documents are told how their links fare.

Both tokenizers work on pieces of a text that begin at a single space or newline between other characters: neither
joins symbols across such a place, so a piece's tokens do not depend on its neighbours, and what is known of a piece is
kept. White space of any other form stays inside a piece. ASCII signs that end a word of letters are a piece of their own,
if no piece of B's vocabulary holds a letter and a sign after it.

Defined cases: a null or empty text, and one whose bytes A's or B's tokens do not give back, has no tokens: zeros and an
empty digest; null and repeated ids are rows of their own; strings of special tokens inside a text are plain text; an
empty table gives an empty result; other columns are ignored. A text of any length is encoded whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, join_sized, map_arrow, materialise
from .tokens import Encoder

VOCABULARY_A = "byte_bpe_50k.json"
VOCABULARY_B = "piece_bpe_32k.model"
#: Pieces that a worker keeps, in two generations (an estimated 350 bytes each), and the longest that it keeps.
MEMO = 800_000
MEMO_CHARS = 64
#: Texts that are aligned together.
BATCH_TEXTS = 256
#: Links of one Arrow batch of results, and documents.
BATCH_LINKS = 1 << 19
BATCH_DOCS = 2000

DOCS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
LINKS = "links array<struct<pair:long,times:int>>"
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_SPACE = "▁"
#: A word of letters and signs after them, and where they meet.
_FORM = Encoder._FORM
_SIGN = re.compile("[A-Za-zªµºÀ-ÖØ-öø-ÿ][!-/:-@[-`{-~]")


def components(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """The component of each token, those of A and then those of B: the smallest of its members' numbers.

    ``a_ends`` and ``b_ends`` are the ends of the tokens' byte ranges, strictly ascending, with one last end. Every byte
    range between neighbouring ends lies in one token of each side: these pairs are the edges. Union-find over all of
    them at once: roots hook onto smaller roots that an edge reaches, then all paths are halved until they are flat.
    """
    ends = np.union1d(a_ends, b_ends)
    u, v = np.searchsorted(a_ends, ends), len(a_ends) + np.searchsorted(b_ends, ends)
    parent = np.arange(len(a_ends) + len(b_ends))
    while True:
        x, y = parent[u], parent[v]
        apart = x != y
        if not apart.any():
            return parent
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def expand(own: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links, as places in A and in B: pairs of members of one component whose ranges end together."""
    both = np.intersect1d(a_ends, b_ends, assume_unique=True)
    i, j = np.searchsorted(a_ends, both), np.searchsorted(b_ends, both)
    linked = own[i] == own[len(a_ends) + j]
    return i[linked], j[linked]


#: What is kept of a piece: its numbers of A's and B's tokens and of groups, its groups as text, its links as i64 pairs.
Piece = tuple[int, int, int, str, bytes]


class Aligner:
    """Aligns the tokens of two tokenizers over texts."""

    def __init__(self, path_a: str, path_b: str, memo: int = MEMO):
        import sentencepiece

        self.a = Encoder(path_a, MEMO // 8)
        self.a.tokenizer.encode_special_tokens, self.a.special = True, []
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        # Byte-level BPE writes bytes that are not printable Latin-1 as characters from U+0100 on.
        printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in printed} | {chr(0x100 + k): b for k, b in enumerate(sorted(set(range(256)) - set(printed)))}
        names = self.a.tokenizer.get_vocab()
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for t, k in names.items():
            self.a_bytes[k] = bytes(byte[c] for c in t) if all(c in byte for c in t) else b""
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(t[3:5], 16)]) if self.b.is_byte(k) else t.replace(_SPACE, " ").encode() for k, t in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.shown = [str(k) for k in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.lead = self.b.piece_to_id(_SPACE)
        # Cuts are safe only if no piece of B goes on over a space, or holds a newline.
        self.cuts = not any(re.search(f"[^{_SPACE}]{_SPACE}|\n", t) for t in pieces)
        # Signs after letters are pieces of their own if no piece of B holds a letter and a sign after it; A always cuts there.
        plain = [t for k, t in enumerate(pieces) if not (self.b.is_byte(k) or self.b.is_control(k) or self.b.is_unknown(k))]
        self.after = self.b.encode("\n")
        self.signs = self.cuts and self.after[:1] == [self.lead] and not any(_SIGN.search(t) for t in plain)
        self.limit, self.known, self.older = memo, {}, {}

    def _a_ids(self, piece: str) -> bytes:
        body = piece[1:]
        if piece[0] not in " \n":
            return self.a.inner[piece]
        if body.split() == [body]:
            return self.a._piece(body if piece[0] == " " else piece)
        return self.a._whole(piece)

    def _tokens(self, pieces: list[str]) -> tuple[list[bytes], list[list[int]], list[bool]]:
        """A's ids (as u32 bytes) and B's of each piece, and whether both keep its bytes.

        A piece has the space before it, begins with a newline, or is made of signs after letters.
        """
        self.a.renew()
        a = [self._a_ids(p) for p in pieces]
        # B puts a space before what it is given; a newline does not join it, nor what follows a newline.
        b = self.b.encode([p[1:] if p[0] == " " else p if p[0] == "\n" else "\n" + p for p in pieces], num_threads=1)
        good = [True] * len(pieces)
        for k, p in enumerate(pieces):
            if p[0] != " ":
                lead = [self.lead] if p[0] == "\n" else self.after
                good[k], b[k] = b[k][: len(lead)] == lead, b[k][len(lead) :]
        of_a, of_b = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        raw = [p.encode() for p in pieces]
        all_a, all_b = np.frombuffer(b"".join(a), "<u4").tolist(), list(chain.from_iterable(b))
        same_a = self._same(raw, [len(x) // 4 for x in a], all_a, self.a_bytes, self.a_size)
        if not (all(good) and same_a and self._same(raw, list(map(len, b)), all_b, self.b_bytes, self.b_size)):
            for k, r in enumerate(raw):
                good[k] = good[k] and b"".join(map(of_b, b[k])) == r and b"".join(map(of_a, np.frombuffer(a[k], "<u4").tolist())) == r
        return a, b, good

    @staticmethod
    def _same(raw: list[bytes], n: list[int], ids: list[int], told: list[bytes], width: np.ndarray) -> bool:
        """Whether the tokens of every piece give back its bytes: they do all together, and each has its piece's size."""
        ends = np.concatenate([[0], np.cumsum(width[ids])])[np.concatenate([[0], np.cumsum(n)])] if ids else np.zeros(len(n) + 1, np.int64)
        return np.array_equal(np.diff(ends), list(map(len, raw))) and b"".join(map(told.__getitem__, ids)) == b"".join(raw)

    def learn(self, pieces: list[str]) -> list[Piece | None]:
        """What is kept of each piece, None where either tokenizer loses bytes.

        The pieces are aligned as one sequence of tokens: both sides end where a piece ends, so no component leaves it.
        """
        a, b, good = self._tokens(pieces)
        out: list[Piece | None] = [None] * len(pieces)
        whole = [k for k, g in enumerate(good) if g]
        if not whole:
            return out
        a_n, b_n = np.array([len(a[k]) // 4 for k in whole]), np.array([len(b[k]) for k in whole])
        a_ids = np.frombuffer(b"".join([a[k] for k in whole]), "<u4").astype(np.int64)
        b_ids = np.array(list(chain.from_iterable([b[k] for k in whole])), np.int64)
        a_ends, b_ends = np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids])
        own = components(a_ends, b_ends)
        # Members of a component stand side by side, in the same order of components on both sides.
        n = len(a_ids)
        a_first, b_first = (np.flatnonzero(np.diff(side, prepend=-1)) for side in (own[:n], own[n:]))
        last_a, last_b = np.cumsum(a_n), np.cumsum(b_n)
        group_end = np.searchsorted(a_first, last_a).tolist()
        i, j = expand(own, a_ends, b_ends)
        pairs = ((a_ids[i] << 32) | b_ids[j]).tobytes()
        link_end = np.searchsorted(i, last_a).tolist()
        shown = self.shown.__getitem__
        a_text, b_text = list(map(shown, a_ids.tolist())), list(map(shown, b_ids.tolist()))
        a_cut, b_cut = [*a_first.tolist(), n], [*b_first.tolist(), len(b_ids)]
        told = [
            f"{a_text[p]}|{b_text[r]}" if q - p == 1 == s - r else f"{','.join(a_text[p:q])}|{','.join(b_text[r:s])}"
            for p, q, r, s in zip(a_cut[:-1], a_cut[1:], b_cut[:-1], b_cut[1:], strict=True)
        ]
        group, link = 0, 0
        for k, n_a, n_b, group_to, link_to in zip(whole, a_n.tolist(), b_n.tolist(), group_end, link_end, strict=True):
            out[k] = (n_a, n_b, group_to - group, ";".join(told[group:group_to]), pairs[8 * link : 8 * link_to])
            group, link = group_to, link_to
        return out

    def align(self, texts: list[str | None]) -> list[list[Piece]]:
        """The pieces of each text in order; none if the text has no tokens."""
        if len(self.known) > self.limit // 2:
            # A new generation; pieces of the one before stay known as long as they are used.
            self.known, self.older = {}, self.known
        parts = [self.pieces(" " + t) if t else [] for t in texts]
        # Asked piece by piece, as the difference from a view of what is known would walk all of it.
        known, older = self.known, self.older
        missing = {p for p in set().union(*parts) if p not in known}
        # Words with signs after them are put together from their parts, and not kept.
        made = {p: (p[0] + form[1], form[2]) for p in missing if (form := _FORM.fullmatch(p, 1)) and form[2]} if self.signs else {}
        missing = {p for p in chain(missing, *made.values()) if p not in made and p not in known}
        known.update({p: older[p] for p in missing if p in older})
        fresh = [p for p in missing if p not in older]
        self.known.update(zip(fresh, self.learn(fresh), strict=True))
        for p, (letters, signs) in made.items():
            x, y = self.known[letters], self.known[signs]
            self.known[p] = (x[0] + y[0], x[1] + y[1], x[2] + y[2], f"{x[3]};{y[3]}", x[4] + y[4]) if x and y else None
        out = []
        for text, own in zip(texts, parts, strict=True):
            found = list(map(self.known.__getitem__, own))
            if None in found:
                # Bytes are lost in some piece: the whole text decides.
                (last,) = self.learn([" " + text])
                found = [] if last is None else [last]
            out.append(found)
        for p in chain(made, [p for p in fresh if len(p) > MEMO_CHARS]):
            del self.known[p]
        return out

    def pieces(self, whole: str) -> list[str]:
        if not self.cuts:
            return [whole]
        body = whole[1:]
        words, cuts = body.split(), body.count(" ") + body.count("\n")
        if len(words) != cuts + 1 or sum(map(len, words)) + cuts != len(body):
            # Other white space, or runs of it.
            return _CUT.split(whole)
        return [p if p[0] == "\n" else " " + p for p in (body.replace("\n", " \n").split(" ") if "\n" in body else words)]


def aligner(path_a: str, path_b: str) -> Aligner:
    kept = held("alignment")
    if (path_a, path_b) not in kept:
        kept[path_a, path_b] = Aligner(path_a, path_b)
    return kept[path_a, path_b]


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, with_groups: bool = False) -> DataFrame:
    """DOCS and LINKS of every document (doc_id, text), as a written table; ``row`` numbers its rows.

    A document's links are its distinct id pairs, A's id in the upper 32 bits, with how often each stands in it.
    ``with_groups`` adds the groups as text.
    """
    path_a = path_a or public_tokenizers.path(VOCABULARY_A)
    path_b = path_b or public_tokenizers.path(VOCABULARY_B)
    schema = DOCS.removeprefix("row long, ") + f", {LINKS}" + ", groups string" * with_groups
    link = pa.struct([("pair", pa.int64()), ("times", pa.int32())])

    def batch(rows: list, pairs: list[np.ndarray], times: list[np.ndarray]) -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in pairs])]).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array(np.concatenate(pairs), pa.int64()), pa.array(np.concatenate(times), pa.int32())], fields=list(link))
        cols = list(zip(*rows, strict=True))
        arrays = [pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array(cols[5], pa.string()), pa.ListArray.from_arrays(pa.array(offsets), values)]
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"]
        if with_groups:
            arrays, names = [*arrays, pa.array(cols[6], pa.string())], [*names, "groups"]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        rows, pairs, times, n = [], [], [], 0
        for part in batches:
            ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            for doc_id, found in zip(ids, own.align(texts), strict=True):
                n_a, n_b, n_groups, groups, links = zip(*found, strict=True) if found else ((),) * 5
                told, flat = ";".join(groups), np.frombuffer(b"".join(links), np.int64)
                each, count = np.unique(flat, return_counts=True)
                row = (doc_id, sum(n_a), sum(n_b), sum(n_groups), len(flat), hashlib.sha256(told.encode()).hexdigest() if found else "")
                rows.append((*row, told) if with_groups else row)
                pairs.append(each)
                times.append(count.astype(np.int32))
                n += len(each) + (len(told) // 8 if with_groups else 0)
                if n > BATCH_LINKS or len(rows) >= BATCH_DOCS:
                    yield batch(rows, pairs, times)
                    rows, pairs, times, n = [], [], [], 0
        if rows:
            yield batch(rows, pairs, times)

    found = map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), work, schema, BATCH_TEXTS, owner="alignment")
    # The numbers are fixed by writing them.
    return materialise(found.withColumn("row", F.monotonically_increasing_id()), "alignment")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, a, b, count, docs, best) of the corpus, a written table: how many links and documents hold the pair, and
    whether no pair of its B id has more. There are at most as many pairs as A has ids for each of B's."""
    each = aligned.select(F.inline("links"))
    counts = materialise(each.groupBy("pair").agg(F.sum("times").cast("long").alias("count"), F.count(F.lit(1)).alias("docs")), "alignment-pairs")
    named = counts.withColumn("a", F.shiftright("pair", 32)).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    # A row per id of B's vocabulary.
    most = named.groupBy("b").agg(F.max("count").alias("most"))
    return materialise(named.join(F.broadcast(most), "b").select("pair", "a", "b", "count", "docs", (F.col("count") == F.col("most")).alias("best")), "alignment-counts")


def judge(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """Documents with n_best, their links whose count is their B id's highest, and count_sum over their links.

    A pair that stands in very many documents is a hot key; ``join_sized`` keeps it from meeting in one task.
    """
    each = aligned.select("row", F.inline("links"))
    known = join_sized(each, counts.select("pair", "count", "docs", "best"), "pair", "docs", 32)
    sums = known.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("times") * F.col("count")).cast("long").alias("count_sum"))
    zero = F.lit(0).cast("long")
    return aligned.drop("links").join(sums, "row", "left").withColumns({"n_best": F.coalesce("n_best", zero), "count_sum": F.coalesce("count_sum", zero)})

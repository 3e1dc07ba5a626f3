"""Benchmark decontamination by template canonicalisation.

Words lose punctuation at their ends and become template tokens: words with a digit are <num>, units after one <unit>,
capitalised words inside a sentence are <name>, all others stand for themselves in lower case. A second stream keeps
names as lower-case words, so that a copy in another case is found as well. Windows of WINDOW tokens of either stream,
at least half of them literal, are hashed, and the windows of all whole texts are joined with the benchmark's by hash.
Windows with fewer literals, and whole items of fewer than SHORTEST tokens, are looked up by the words themselves, in
lower case and without punctuation at their ends, so that verbatim copies are always found.

Hits of a text with an item are grouped by their offset (place in the text minus place in the item). Within an offset
the slots must be consistent: one value of the item's slots always stands for the same value in the text; hits with a
slot against the majority are dropped; hits by the words themselves stay. An item is leaked into a text if the remaining hits cover at least COVERAGE of
its tokens, or a run of RUN tokens. Where slot values differ it is a re-parameterised copy, else a verbatim one.

Texts are read once, whatever the size of the benchmark: tasks drop windows that a bit filter of fixed size rules out,
the rest are joined with the benchmark's windows (a broadcast up to a counted size, beyond it a shuffle that splits hot
hashes), and hits are grouped by text and item.

Defined cases: null and empty texts and items have no windows; an item of fewer than WINDOW tokens
is one window of its length, so an item of one word is in every text with that word; repeated rows are reported each;
a null doc_id or item_id stays null, so items without an id cannot be told apart; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_sized, map_arrow, materialise

WINDOW = 8
SHORTEST = 5
COVERAGE = 0.5
RUN = 13
#: Bits of the filter, as a power of two.
FILTER_BITS = 27
#: Words whose canonical form a task keeps.
MEMO = 500_000
UNITS = frozenset(
    "km m cm mm mi mile miles ft feet foot inch inches yd yard yards kg g mg lb lbs oz pound pounds ton tons "
    "l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "hz khz mhz ghz w kw mw v kv a ma pa kpa bar j kj cal kcal k °c °f c f % percent dollar dollars euro euros cent cents usd eur gbp mph kmh km/h m/s".split()
)
#: Kinds of token.
LITERAL, NUMBER, UNIT, NAME = 0, 1, 2, 3

_EDGES = "\"'()[]{}<>,.;:!?*#|&$%…«»„“”‘’-–—_"
_CLOSING, _STOPS, _INNER = "\"')]}»“”’", (".", "!", "?"), frozenset("abcdefghijklmnopqrstuvwxyz,;")
_DIGIT = re.compile(r"\d")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SLOT = {NUMBER: 0x1111, UNIT: 0x2222, NAME: 0x3333}
_SCHEMA = "doc_id long, item_id long, coverage double, windows long, slots long, changed_slots long, kind string"


class Words(dict):
    """Word -> number of its canonical form; the forms' arrays are filled up from lists when they are asked for."""

    def __init__(self):
        super().__init__()
        self.fresh: tuple[list, list, list, list, list] = ([], [], [], [], [])
        self.filled, self.names = 0, []
        self.arrays = (np.empty(1024, np.uint64), np.empty(1024, np.uint64), np.empty(1024, np.int8), np.empty(1024, bool), np.empty(1024, np.uint64))

    def __missing__(self, word: str) -> int:
        core = word.strip(_EDGES) or word
        low = core.lower()
        own = xxhash.xxh64_intdigest(low)
        if not low.isalpha() and _DIGIT.search(low):
            kind, typed, plain = NUMBER, _SLOT[NUMBER], _SLOT[NUMBER]
        elif low in UNITS:
            kind, typed, plain = UNIT, _SLOT[UNIT], _SLOT[UNIT]
        elif core[0].isupper():
            kind, typed, plain = NAME, _SLOT[NAME], own
        else:
            kind, typed, plain = LITERAL, own, own
        a, b, c, d, e = self.fresh
        a.append(typed)
        b.append(plain)
        c.append(kind)
        d.append(word[-1] not in _INNER and word.rstrip(_CLOSING)[-1:] in _STOPS)
        e.append(own)
        self.names.append(low)
        self[word] = k = len(self.names) - 1
        return k

    def value(self, k: int) -> str:
        return self.names[k]

    def forms(self) -> tuple[np.ndarray, ...]:
        """Both hashes, kind, end-of-sentence mark and the hash of the word itself of every form."""
        n = len(self.names)
        if self.filled < n:
            if n > len(self.arrays[0]):
                self.arrays = tuple(np.concatenate([x[: self.filled], np.empty(2 * n - self.filled, x.dtype)]) for x in self.arrays)
            for x, new in zip(self.arrays, self.fresh, strict=True):
                x[self.filled : n] = new
                new.clear()
            self.filled = n
        return self.arrays

    def tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Form numbers, both hash streams, and kinds as the first stream has them."""
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        typed, plain, kind, ends, own = (x[at] for x in self.forms())
        # A capital at the start of a sentence makes no name; a unit's word without a number before it ("a", "second") is a word.
        start = np.append(True, ends[:-1]) & (kind == NAME)
        loose = (kind == UNIT) & ~np.append(False, kind[:-1] == NUMBER)
        return at, np.where(start | loose, own, typed), np.where(loose, own, plain), np.where(start | loose, LITERAL, kind)


def window_hashes(stream: np.ndarray, size: int) -> np.ndarray:
    out = np.full(len(stream) - size + 1, size, np.uint64)
    for k in range(size):
        out = (out ^ stream[k : len(stream) - size + 1 + k]) * _STEP
        out ^= out >> np.uint64(29)
    return out


def _long(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


#: A window of an item: its place, its hash, whether it is looked up by the words themselves, its words and their kinds.
WINDOWS = "item long, item_id long, length int, place int, hash long, exact boolean, words array<string>, kinds array<tinyint>"


def own_windows(words: Words, text: str) -> tuple[int, list[tuple]]:
    """Number of tokens of an item, and (place, hash, exact, words, kinds) of its windows."""
    own = text.split()
    if not own:
        return 0, []
    at, typed, plain, kind = words.tokens(own)
    size, names, out = min(WINDOW, len(own)), [words.value(k) for k in at], {}
    left = np.ones(len(own) - size + 1, bool)
    for stream, kinds in ((typed, kind), (plain, np.where(kind == NAME, LITERAL, kind))) if len(own) >= SHORTEST else ():
        held = 2 * np.convolve(kinds == LITERAL, np.ones(size), "valid") >= size
        found = _long(window_hashes(stream, size))
        out |= {(int(p), int(found[p]), False): None for p in np.flatnonzero(held)}
        # What the second stream holds is found there in a verbatim copy.
        left = ~held
    # A unit's word in front is literal here, but a text may have a number before it.
    left[0] |= words.forms()[2][at[0]] == UNIT
    found = _long(~window_hashes(words.forms()[4][at], size))
    out |= {(int(p), int(found[p]), True): None for p in np.flatnonzero(left)}
    return len(own), [(p, h, exact, names[p : p + size], kind[p : p + size].tolist()) for p, h, exact in out]


def item_windows(benchmark: DataFrame) -> DataFrame:
    """The windows of all items (item_id, text), a written table; ``item`` numbers the items."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, number = Words(), TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = []
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(words) > MEMO:
                    words = Words()
                length, found = own_windows(words, text)
                rows += [(number, item_id, length, *x) for x in found]
                number += 1
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.int8())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in WINDOWS.split(", ")])

    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where(F.length(F.trim("text")) > 0)
    return materialise(map_arrow(items, cut, WINDOWS, 256), "decontaminate-windows")


def window_filter(windows: DataFrame) -> np.ndarray:
    """2^FILTER_BITS bits, set at the first bits of the windows' hashes; 16 MB whatever the size of the benchmark."""
    slot = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    each = windows.select(F.shiftright(slot, 15).cast("int").alias("part"), slot.bitwiseAND(F.lit((1 << 15) - 1)).cast("int").alias("bit")).distinct()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            part, bit = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k in np.unique(part).tolist():
                held.setdefault(k, np.zeros(1 << 15, bool))[bit[part == k]] = True
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in held.values()], pa.binary())], names=["part", "bits"])

    # A part is 4 KB, and a task holds those that it is dealt.
    packed = map_arrow(each.repartition(max(8, 1 << (FILTER_BITS - 23)), "part"), pack, "part int, bits binary").toArrow()
    out = np.zeros((1 << FILTER_BITS - 15, 1 << 12), np.uint8)
    for k, raw in zip(packed.column(0).to_pylist(), packed.column(1).to_pylist(), strict=True):
        out[k] = np.frombuffer(raw, np.uint8)
    return out.reshape(-1)


def candidates(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(key, doc_id, copy, hash, at, said) of the windows of all texts that pass the filter, a written table.

    ``docs``: doc_id, text, copy; ``key`` numbers the rows, ``said`` are the window's words. All windows of all texts are
    looked at; the filter spares those the shuffle that no item can have.
    """
    sizes = windows.select("exact", F.size("words").alias("size")).distinct().collect()
    held = docs.sparkSession.sparkContext.broadcast((window_filter(windows), sorted(r.size for r in sizes if not r.exact), sorted(r.size for r in sizes if r.exact)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, typical, exact = held.value
        words, key = Words(), TaskContext.get().partitionId() << 33
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text, copy in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key += 1
                own = text.split()
                if not own:
                    continue
                if len(words) > MEMO:
                    words = Words()
                at, typed, plain, _ = words.tokens(own)
                found: dict[tuple[int, int], int] = {}
                for stream, lengths, turned in ((typed, typical, False), (plain, typical, False), (words.forms()[4][at], exact, True)):
                    for size in lengths:
                        if len(stream) < size:
                            continue
                        hashes = window_hashes(stream, size)
                        hashes = ~hashes if turned else hashes
                        slot = hashes >> np.uint64(64 - FILTER_BITS)
                        for p in np.flatnonzero(bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).tolist():
                            found[p, int(_long(hashes[p : p + 1])[0])] = size
                rows += [(key, doc_id, copy, h, p, [words.value(k) for k in at[p : p + size]]) for (p, h), size in found.items()]
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "doc_id", "copy", "hash", "at", "said"])

    return materialise(map_arrow(docs, search, "key long, doc_id long, copy long, hash long, at int, said array<string>", 256), "decontaminate-hits")


#: A hit: exact, place in the text, its words, place in the item, its words and their kinds.
Hit = tuple[bool, int, list[str], int, list[str], list[int]]


def judge(length: int, hits: list[Hit]) -> tuple | None:
    """(coverage, windows, slots, changed slots, kind) if an item of ``length`` tokens is leaked into a text by its hits."""
    offsets: dict[int, tuple[set[int], set[int]]] = defaultdict(lambda: (set(), set()))
    said: dict[int, str] = {}
    value: dict[int, str] = {}
    kind: dict[int, int] = {}
    size = len(hits[0][4])
    for exact, p, theirs, q, own, kinds in hits:
        offsets[p - q][exact].add(q)
        said.update(enumerate(theirs, p))
        value.update(enumerate(own, q))
        kind.update(enumerate(kinds, q))
    covered, windows, slots, changed = set(), 0, 0, 0
    for offset, (places, exact) in offsets.items():
        stands: dict[tuple[int, str], Counter] = defaultdict(Counter)
        found = sorted({q + k for q in places for k in range(size) if kind[q + k] != LITERAL})
        for s in found:
            stands[kind[s], value[s]][said[offset + s]] += 1
        agreed = {k: c.most_common(1)[0][0] for k, c in stands.items()}
        odd = {s for s in found if agreed[kind[s], value[s]] != said[offset + s]}
        kept = exact | {q for q in places if not any(q + k in odd for k in range(size))}
        own = {q + k for q in kept for k in range(size)}
        held = [s for s in own if kind[s] != LITERAL]
        covered |= own
        windows, slots, changed = windows + len(kept), slots + len(held), changed + sum(said[offset + s] != value[s] for s in held)
    run = longest = 0
    for s in range(length):
        run = run + 1 if s in covered else 0
        longest = max(longest, run)
    if covered and (len(covered) >= COVERAGE * length or longest >= RUN):
        return len(covered) / length, windows, slots, changed, "reparameterised" if changed else "verbatim"
    return None


def find_leaks(docs: DataFrame, benchmark: DataFrame, with_copy: bool = False) -> DataFrame:
    """One row per document and benchmark item (item_id, text) leaked into it; ``with_copy`` adds the hash of its text."""
    windows = item_windows(benchmark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("copy")).where(F.col("text").isNotNull())
    hits = candidates(rows, windows)
    # How many windows of texts each hash has: a passage that very many texts hold is a hot key of the join.
    seen = hits.groupBy("hash").agg(F.count(F.lit(1)).alias("seen"))
    known = materialise(windows.join(seen, "hash").select("hash", "seen", "item", "item_id", "length", "place", "exact", "words", "kinds"), "decontaminate-known")
    joined = join_sized(hits, known, "hash", "seen", 250).where(F.col("item").isNotNull())
    schema = _SCHEMA + ", copy long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, fixed, found = None, (), []
        for batch in batches:
            out = []
            for key, item, doc_id, copy, item_id, length, *hit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, item) != at:
                    if found and (told := judge(fixed[3], found)):
                        out.append((fixed[0], fixed[2], *told, fixed[1]))
                    at, fixed, found = (key, item), (doc_id, copy, item_id, length), []
                found.append(hit)
            yield _told(out)
        if found and (told := judge(fixed[3], found)):
            yield _told([(fixed[0], fixed[2], *told, fixed[1])])

    # A group is what one text shares with one item.
    pairs = joined.select("key", "item", "doc_id", "copy", "item_id", "length", "exact", "at", "said", "place", "words", "kinds")
    leaked = map_arrow(pairs.repartition("key", "item").sortWithinPartitions("key", "item"), work, schema)
    return leaked if with_copy else leaked.drop("copy")


def _told(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
    names = [f.split()[0] for f in (_SCHEMA + ", copy long").split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

"""Token ids in patched frame-of-reference files.

Texts are encoded with a public tokenizer, an end id is appended to each document, and ids are written in ascending
document order. Each task writes shard files of this layout (all numbers little-endian):

    magic "TPF1"
    blocks of BLOCK ids: u32 minimum, u8 width, u16 number of ids, u16 number of exceptions, the offsets from the
        minimum packed at ``width`` bits, exception positions (u16 each), exception offsets (u32 each)
    u64 start of each block, u64 number of ids before each shard document's end, i64 document ids, u8 null marks
    footer: u64 number of blocks, u64 number of documents, u64 place of the index, magic "TPF1"

A block's width is the PERCENTILE-th of its offsets' bit lengths; offsets that need more are exceptions, packed as 0
and patched on reading. The block index gives any document's ids without reading what lies before.

Defined cases: a null text is empty and has the end id alone; null document ids come first; rows with equal ids are
ordered by text and each keeps its own ids; an empty table gives an empty manifest and result; other columns are
ignored. Special token strings in texts are treated as the tokenizer file's default says.
"""

from __future__ import annotations

import codecs
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held, map_arrow, materialise, shared_dir
from .files import RollingFile, resolve

MAGIC = b"TPF1"
BLOCK = 512
PERCENTILE = 0.9
#: A new shard file is begun beyond this many ids.
SHARD_IDS = 32 << 20
END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
#: Blocks that are packed or unpacked together.
BATCH_BLOCKS = 512
#: Word encodings that a worker keeps, in two generations (an estimated 200 bytes each), and the longest word that it keeps.
MEMO = 800_000
MEMO_CHARS = 64

MANIFEST = "part long, shard long, path string, documents long, ids long"
_HEAD = struct.Struct("<IBHH")
_FOOT = struct.Struct("<QQQ4s")


def _bits(values: np.ndarray) -> np.ndarray:
    """Bit length of each value."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def pack(ids: np.ndarray) -> list[bytes]:
    """Blocks of a run of ids; all but the last have BLOCK ids."""
    full = len(ids) // BLOCK * BLOCK
    out = []
    for at in range(0, full, BATCH_BLOCKS * BLOCK):
        out += _pack(ids[at : min(at + BATCH_BLOCKS * BLOCK, full)].reshape(-1, BLOCK))
    return out + (_pack(ids[full:].reshape(1, -1)) if full < len(ids) else [])


def _pack(rows: np.ndarray) -> list[bytes]:
    least = rows.min(axis=1)
    offsets = (rows - least[:, None]).astype("<u4")
    need = _bits(offsets)
    place = max(0, int(np.ceil(PERCENTILE * rows.shape[1])) - 1)
    width = np.partition(need, place, axis=1)[:, place]
    odd = need > width[:, None]
    low = np.where(odd, 0, offsets).astype("<u4")
    out: list[bytes] = [b""] * len(rows)
    for w in np.unique(width):
        which = np.flatnonzero(width == w)
        if w == 16:
            packed = low[which].astype("<u2").view(np.uint8)
        else:
            bits = np.unpackbits(low[which].view(np.uint8).reshape(len(which), rows.shape[1], 4), axis=2, bitorder="little", count=int(w)) if w else np.zeros((len(which), 0, 0), np.uint8)
            packed = np.packbits(bits.reshape(len(which), -1), axis=1, bitorder="little")
        for k, i in enumerate(which):
            at = np.flatnonzero(odd[i])
            out[i] = _HEAD.pack(least[i], w, rows.shape[1], len(at)) + packed[k].tobytes() + at.astype("<u2").tobytes() + offsets[i, at].tobytes()
    return out


def unpack(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks at ``starts`` in ``data``, in that order."""
    heads = [_HEAD.unpack_from(data, int(s)) for s in starts]
    out = [np.empty(0, "<u4")] * len(heads)
    raw = np.frombuffer(data, np.uint8)
    groups: dict[tuple[int, int], list[int]] = {}
    for k, (_, w, n, _x) in enumerate(heads):
        groups.setdefault((w, n), []).append(k)
    for (w, n), which in groups.items():
        size = (w * n + 7) // 8
        body = np.stack([raw[int(starts[k]) + _HEAD.size : int(starts[k]) + _HEAD.size + size] for k in which])
        values = np.zeros((len(which), n), "<u4")
        if w == 16:
            values[:] = body.view("<u2")
        elif 0 < w <= 24:
            # Each value lies within the four bytes from the byte that holds its first bit.
            bit = np.arange(n) * w
            padded = np.pad(body, ((0, 0), (0, 4)))
            wide = sum(padded[:, (bit >> 3) + k].astype("<u4") << np.uint32(8 * k) for k in range(3 if w <= 17 else 4))
            values[:] = (wide >> (bit & 7).astype("<u4")) & np.uint32((1 << w) - 1)
        elif w:
            bits = np.unpackbits(body, axis=1, bitorder="little", count=w * n).reshape(len(which), n, w)
            part = np.packbits(bits, axis=2, bitorder="little")
            values.view(np.uint8).reshape(len(which), n, 4)[:, :, : part.shape[2]] = part
        for row, k in zip(values, which, strict=True):
            least, _, _, odd = heads[k]
            if odd:
                at = int(starts[k]) + _HEAD.size + size
                row[np.frombuffer(data, "<u2", odd, at)] = np.frombuffer(data, "<u4", odd, at + 2 * odd)
            out[k] = row + np.uint32(least)
    return np.concatenate(out) if out else np.empty(0, "<u4")


#: Byte-level BPE writes the bytes up to 0x20, 0x7F-0xA0 and 0xAD as further characters, all others as themselves.
_FURTHER = {b: 0x100 + k for k, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}
_BYTES = "".join(chr(_FURTHER.get(b, b)) for b in range(256))


class _Kept(dict):
    """Encodings by piece; an unknown piece is encoded when it is asked for. What the last generation knew moves here when
    it is used, so each piece is kept once."""

    def __init__(self, encode, parts: bool, older: dict):
        super().__init__()
        self.encode, self.parts, self.older, self.seen = encode, parts, older, bytearray(1 << 21)

    def __missing__(self, piece: str) -> bytes:
        known = self.older.pop(piece, None)
        if known is None:
            known = self.encode(piece)
            if len(piece) > MEMO_CHARS:
                return known
            if not self.parts and not piece.isalpha():
                # Words with signs are put together from kept parts, and most of them occur once; only those that come
                # again are kept. A false hit keeps one more.
                at = hash(piece) & 0xFFFFFF
                if not self.seen[at >> 3] & 1 << (at & 7):
                    self.seen[at >> 3] |= 1 << (at & 7)
                    return known
        self[piece] = known
        return known


class Encoder:
    """A tokenizer that remembers the encodings of words.

    Byte-level BPE cuts a text before each space or newline that follows another character, and what it makes of a
    piece does not depend on its neighbours, so pieces are looked up. Pieces of Latin-1 characters without white space are
    cut here into what the library would hand to its model (contractions, letters, numbers, other signs) and go straight
    there, each part once. Other pieces, and texts in which a cut would fall inside a run of white space or a special
    token, are encoded whole by the library.
    """

    _RUN = re.compile(r"\s[ \n]")
    _LATIN = re.compile("[!-~\xa1-\xff]+")
    #: Most words: letters, and other signs after them.
    _FORM = re.compile("([A-Za-zªµºÀ-ÖØ-öø-ÿ]+)([!-/:-@[-`{-~]*)")
    #: The cuts of byte-level BPE, for Latin-1.
    _CUTS = re.compile("'(?:[stmd]|re|ve|ll)| ?[A-Za-zªµºÀ-ÖØ-öø-ÿ]+| ?[0-9²³¹¼½¾]+| ?[^ A-Za-zªµºÀ-ÖØ-öø-ÿ0-9²³¹¼½¾]+")
    #: White space besides space and newline.
    _ODD = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f", "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

    def __init__(self, path: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit, self.line = memo, self._whole("\n")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenizer.model._resize_cache(0)
        self.model = self.tokenizer.model.tokenize
        self.single = [struct.pack("<I", k) for k in range(self.tokenizer.get_vocab_size())]
        #: What follows a space or begins with a newline; and what stands inside a word or begins a text.
        self.memo, self.inner = _Kept(self._piece, False, {}), _Kept(self._ids, True, {})

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ids(self, cut: str) -> bytes:
        """The ids of one cut, with the space before it if there is one."""
        found = self.model(codecs.charmap_decode(cut.encode(), "strict", _BYTES)[0])
        return self.single[found[0].id] if len(found) == 1 else b"".join([self.single[t.id] for t in found])

    def _piece(self, piece: str) -> bytes:
        """The ids of a piece that follows a space, or that begins with a newline."""
        if form := self._FORM.fullmatch(piece):
            letters, signs = form.groups()
            return self.memo[letters] + self.inner[signs] if signs else self._ids(" " + piece)
        if piece[:1] == "\n":
            return self.line + self._start(piece[1:]) if self._LATIN.fullmatch(piece, 1) else self._whole(piece)
        if not self._LATIN.fullmatch(piece):
            return self._whole(" " + piece)
        first, *rest = self._CUTS.findall(" " + piece)
        # A word that begins with letters is known by them.
        start = self.memo[first[1:]] if rest and first[1:].isalpha() else self._ids(first)
        return start + b"".join(map(self.inner.__getitem__, rest))

    def _start(self, piece: str) -> bytes:
        """The ids of a piece that nothing stands before."""
        if not self._LATIN.fullmatch(piece):
            return self._whole(piece)
        return b"".join(map(self.inner.__getitem__, self._CUTS.findall(piece)))

    def _joined(self, text: str) -> bool:
        """Whether a cut could fall inside white space or a special token."""
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or any(t in text for t in self.special):
            return True
        odd = any(c in text for c in self._ODD[0]) or (not text.isascii() and any(c in text for c in self._ODD[1]))
        return odd and self._RUN.search(text) is not None

    def renew(self) -> None:
        """Begin a new generation of what is kept, if this one is full."""
        for name, most in (("memo", self.limit // 2), ("inner", self.limit // 8)):
            kept = getattr(self, name)
            if len(kept) > most:
                kept.older = {}
                setattr(self, name, _Kept(kept.encode, kept.parts, kept))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian u32 bytes."""
        out = []
        for text in texts:
            # Before each text, so that what is kept beyond the limit is at most the words of one.
            self.renew()
            if self._joined(text):
                out.append(self._whole(text))
                continue
            parts = text.replace("\n", " \n").split(" ")
            first = self._start(parts.pop(0))
            out.append(first + b"".join(map(self.memo.__getitem__, parts)))
        return out


def encoder(path: str) -> Encoder:
    kept = held("tokens")
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


class ShardWriter:
    """Writes documents' ids into rolling shard files."""

    def __init__(self, folder: str, shard_ids: int = SHARD_IDS):
        self.out, self.shard_ids, self.done = RollingFile(folder, ".tpf"), shard_ids, []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.out.sink is None:
            self.out.open().write(MAGIC)
            self.at, self.starts, self.ends, self.docs, self.pending, self.held = 4, [], [], [], [], 0
        self.pending.append(ids)
        self.held += len(ids) // 4
        self.ends.append((self.ends[-1] if self.ends else 0) + len(ids) // 4)
        self.docs.append(doc_id)
        if self.held >= BATCH_BLOCKS * BLOCK:
            self._flush(False)
        if self.ends[-1] >= self.shard_ids:
            self.finish()

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.pending), "<u4")
        keep = 0 if last else len(ids) % BLOCK
        for block in pack(ids[: len(ids) - keep]):
            self.starts.append(self.at)
            self.out.sink.write(block)
            self.at += len(block)
        self.pending, self.held = ([ids[len(ids) - keep :].tobytes()] if keep else []), keep

    def finish(self) -> None:
        if self.out.sink is None:
            return
        self._flush(True)
        nulls = np.array([d is None for d in self.docs], np.uint8)
        for part in (np.array(self.starts, "<u8"), np.array(self.ends, "<u8"), np.array([d or 0 for d in self.docs], "<i8"), nulls):
            self.out.sink.write(part.tobytes())
        self.out.sink.write(_FOOT.pack(len(self.starts), len(self.docs), self.at, MAGIC))
        shard = self.out.count - 1
        self.done.append((self.out.part, shard, self.out.close(), len(self.docs), self.ends[-1]))


class ShardReader:
    """Random access to a shard through its block index."""

    def __init__(self, path: str):
        fs, at = resolve(path)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        self.file.seek(size - _FOOT.size)
        blocks, docs, self.index, magic = _FOOT.unpack(self.file.read(_FOOT.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a token shard")
        self.file.seek(self.index)
        tail = self.file.read(size - self.index - _FOOT.size)
        self.starts = np.append(np.frombuffer(tail, "<u8", blocks), np.uint64(self.index)).astype(np.int64)
        self.ends = np.frombuffer(tail, "<u8", docs, 8 * blocks).astype(np.int64)
        self.docs = np.frombuffer(tail, "<i8", docs, 8 * (blocks + docs))
        self.nulls = np.frombuffer(tail, np.uint8, docs, 8 * (blocks + 2 * docs))

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Ids at places begin..end of the shard."""
        if begin >= end:
            return np.empty(0, "<u4")
        first, last = begin // BLOCK, (end - 1) // BLOCK + 1
        base = int(self.starts[first])
        self.file.seek(base)
        data = self.file.read(int(self.starts[last]) - base)
        return unpack(data, self.starts[first:last] - base)[begin - first * BLOCK : end - first * BLOCK]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, place, ids) of every document, in runs of about BATCH_BLOCKS blocks."""
        at, n = 0, len(self.docs)
        while at < n:
            begin = int(self.ends[at - 1]) if at else 0
            to = min(n, max(at + 1, int(np.searchsorted(self.ends, begin + BATCH_BLOCKS * BLOCK))))
            run = self.ids(begin, int(self.ends[to - 1]))
            for k in range(at, to):
                low = int(self.ends[k - 1]) if k else 0
                yield (None if self.nulls[k] else int(self.docs[k])), low, run[low - begin : int(self.ends[k]) - begin]
            at = to


def write_tokens(docs: DataFrame, path: str | None = None, folder: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode and write ``docs`` (doc_id, text) in ascending order; the manifest, a written table, lists the shards."""
    path = path or public_tokenizers.path(VOCABULARY)
    folder = folder or shared_dir(docs.sparkSession, "tokens")
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, writer = encoder(path), ShardWriter(folder, shard_ids)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode(texts), strict=True):
                    writer.add(doc_id, ids + end)
        writer.finish()
        if writer.done:
            names = [f.split()[0] for f in MANIFEST.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*writer.done, strict=True)], names=names)

    # Ranges are of ids alone, so the sample that cuts them, which goes to the driver, holds no text.
    by_id = F.col("doc_id").asc_nulls_first()
    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange(by_id).sortWithinPartitions(by_id, "text")
    return materialise(map_arrow(ordered, write, MANIFEST, owner="tokens"), "token-manifest")


def read_tokens(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Documents of the listed shards: doc_id, start (ids of all documents before it), n_tokens, crc32 and the ids."""
    # One row per shard file, so the running sum over all of them is small.
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]

        def packed(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 4 else pa.list_(pa.int64())) for k, c in enumerate(zip(*rows, strict=True))], names=names)

        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held = [], 0
                for doc_id, at, ids in ShardReader(path).documents():
                    rows.append((doc_id, base + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) + ((ids,) if with_ids else ()))
                    held += len(ids) if with_ids else 1
                    if held > 1 << 20 or len(rows) >= 10_000:
                        yield packed(rows)
                        rows, held = [], 0
                if rows:
                    yield packed(rows)

    # A stated number, so that the few small manifest rows are not put into one task.
    return map_arrow(based.repartition(max(1, min(manifest.count(), 10_000)), "path"), read, schema)

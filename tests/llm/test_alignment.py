import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import alignment, common, queries

PATHS = public_tokenizers.path(alignment.VOCABULARY_A), public_tokenizers.path(alignment.VOCABULARY_B)
DOC = "doc_id long, text string, row string, links string, pair string, times string, groups string"


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    signs = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    chars, n = {}, 0
    for x in range(256):
        if x in signs:
            chars[chr(x)] = x
        else:
            chars[chr(256 + n)] = x
            n += 1
    return a, b, chars


def brute_tokens(libraries, text):
    """(id, begin, end) of A's and B's tokens by the libraries alone, on the whole text; empty if bytes are lost."""
    a, b, chars = libraries
    if not text:
        return [], []
    raw = (" " + text).encode()
    out = []
    for ids, of in ((a.encode(" " + text, add_special_tokens=False).ids, lambda k: bytes(chars[c] for c in a.id_to_token(k))), (b.encode(text), lambda k: bytes.fromhex(b.id_to_piece(k)[3:5]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode())):
        spans, at, joined = [], 0, b""
        for k in ids:
            piece = of(k)
            spans.append((k, at, at + len(piece)))
            at += len(piece)
            joined += piece
        if joined != raw:
            return [], []
        out.append(spans)
    return out


def brute_groups(a, b):
    cuts = sorted({x[2] for x in a} & {x[2] for x in b})
    out, low = [], 0
    for cut in cuts:
        out.append(([x[0] for x in a if low < x[2] <= cut], [x[0] for x in b if low < x[2] <= cut]))
        low = cut
    return out


def brute(libraries, rows):
    docs, counts = [], Counter()
    for doc_id, text in rows:
        a, b = brute_tokens(libraries, text)
        ends = {x[2]: x[0] for x in b}
        links = [(x[0], ends[x[2]]) for x in a if x[2] in ends]
        counts.update(links)
        docs.append((doc_id, a, b, links))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for doc_id, a, b, links in docs:
        groups = brute_groups(a, b)
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(told.encode()).hexdigest() if a else ""))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def told(frame):
    return sorted(map(tuple, frame.select(COLUMNS).collect()), key=str)


SAID = st.lists(st.sampled_from(["don't", "IT'S", "x'", "l'été", "3rd", "1,000.5", "½", "\xa0", "\n", "\n\n", " ", "  ", "\t", "\r\n", "<|endoftext|>", "</s>", "<s>", "<unk>", "<0x41>", "Ünï", "é", "漢字", "😀", "▁", "a\xadb", "　", " ", "\x1c", "\x00", "\x85", "﻿", "internationalization", "antidisestablishmentarianism"]), max_size=10)


@given(st.lists(st.one_of(SAID.map(" ".join), SAID.map("".join), st.text(max_size=40), st.text(alphabet="ab \n\t.'é", max_size=40)), max_size=6))
@settings(max_examples=400, deadline=None)
def test_pieces_equal_whole_texts(libraries, texts):
    own = alignment.aligner(*PATHS)
    for text, found in zip(texts, own.align(texts), strict=True):
        want = brute_groups(*brute_tokens(libraries, text))
        assert [p for p in ";".join(f[3] for f in found).split(";") if p] == [",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in want], text
        assert "".join(own.pieces(" " + text)) == " " + text


def test_words_with_signs_are_learned_by_parts(libraries):
    own, learned = alignment.Aligner(*PATHS), []
    learn = own.learn
    own.learn = lambda pieces: learned.extend(pieces) or learn(pieces)
    text = "thonér thonér, thonér.%%%\nthonér! thonér's C++ thonér,"
    for _ in range(2):
        (found,) = own.align([text])
        assert ";".join(f[3] for f in found) == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in brute_groups(*brute_tokens(libraries, text)))
    assert sorted(learned) == sorted([" thonér", "\nthonér", " thonér's", " C", ",", ".%%%", "!", "++"])


ENDS = st.lists(st.integers(1, 40), unique=True, min_size=1).map(sorted)


@given(ENDS, ENDS)
@settings(max_examples=300, deadline=None)
def test_components_are_reachable_sets(a, b):
    last = max(a[-1], b[-1])
    a, b = [x for x in a if x < last] + [last], [x for x in b if x < last] + [last]
    spans = [("a", k, lo, hi) for k, (lo, hi) in enumerate(zip([0, *a], a, strict=False))] + [("b", k, lo, hi) for k, (lo, hi) in enumerate(zip([0, *b], b, strict=False))]
    left, want = set(range(len(spans))), []
    while left:
        reached, new = set(), {min(left)}
        while new:
            reached |= new
            new = {k for k in left - reached if any(spans[k][0] != spans[m][0] and spans[k][2] < spans[m][3] and spans[m][2] < spans[k][3] for m in reached)}
        left -= reached
        want.append(([spans[k][1] for k in sorted(reached) if spans[k][0] == "a"], [spans[k][1] for k in sorted(reached) if spans[k][0] == "b"]))
    own = alignment.components(np.array(a), np.array(b))
    got = [([k for k in range(len(a)) if own[k] == g], [k for k in range(len(b)) if own[len(a) + k] == g]) for g in np.unique(own)]
    assert got == want
    i, j = alignment.expand(own, np.array(a), np.array(b))
    assert list(zip(i, j, strict=True)) == [(p, q) for x, y in got for p in x for q in y if a[p] == b[q]]


ROWS = [(1, "Hello world, hello tokens"), (2, None), (3, ""), (None, "Hello world"), (None, "Hello world"), (4, "x ▁ y"), (5, "  two  spaces\n\nand\tlines \n end "), (6, "<|endoftext|> </s> <s>"), (7, "é漢字😀 é​﻿"), (8, " "), (9, "\n"), (1, "Hello world, hello tokens"), (10, "word " * 20_000), (11, "x" * 5_000), (12, "\x00\x85 \x1c a\r\nb"), (13, "same same same same")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "r", "l", "p", "t", "g") for r in rows], DOC)


def judged(spark, rows):
    aligned = alignment.align(frame(spark, rows))
    return alignment.judge(aligned, alignment.pair_counts(aligned))


def test_edge_cases(spark, libraries):
    assert told(judged(spark, ROWS)) == brute(libraries, ROWS)


def test_beyond_broadcasts(spark, libraries, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "HOT", 3)
    rows = ROWS + [(100 + k, f"the number {k} of the words {k * 7}") for k in range(200)]
    assert told(judged(spark, rows)) == brute(libraries, rows)


def test_empty_table(spark):
    assert judged(spark, []).count() == 0


def test_groups_as_text(spark):
    for r in alignment.align(frame(spark, ROWS), with_groups=True).collect():
        assert r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "")
        assert sum(x.times for x in r.links) == r.n_links == r.n_groups
        assert len(np.unique([x.pair for x in r.links])) == len(r.links)


def test_query_against_brute_force(spark, sf_dir, libraries):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert told(queries.op11_token_alignment(spark, sf_dir)) == brute(libraries, docs)

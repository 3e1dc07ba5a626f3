import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import common, decontaminate, jaccard, queries, sql
from tessera.llm.components import connected_components

DOC = "doc_id long, text string, source string, n string, bits string"


def components(ids, links):
    up = {i: i for i in ids}

    def find(a):
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_jaccard(rows, n, percent):
    sets = defaultdict(list)
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i].append(frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset())
    flat = [(i, s) for i, own in sets.items() for s in own if s]
    links = [(i, j) for k, (i, a) in enumerate(flat) for j, b in flat[:k] if 100 * len(a & b) >= percent * len(a | b)]
    return components(list(sets), links)


def near_copies(seed, groups=12, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, key = [], 0
    common = rng.choices(vocabulary, k=20)
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.randint(1, words)) + (common if rng.random() < 0.5 else [])
        for _ in range(rng.randint(1, 9)):
            text = [w if rng.random() > 0.015 else rng.choice(vocabulary) for w in base] if rng.random() < 0.8 else base
            rows.append((key, " ".join(text)))
            key += rng.randint(1, 3)
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "n", "percent"), [(1, 3, 90), (2, 5, 80), (3, 1, 60)])
def test_components_equal_brute_force(spark, seed, n, percent):
    rows = near_copies(seed)
    got = jaccard.jaccard_components(spark.createDataFrame([(*r, "s", "n", "b") for r in rows], DOC), n, percent).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_jaccard(rows, n, percent)


def test_links_inside_components_equal_brute_force(spark):
    rows = near_copies(2)
    first = {}
    for i, text in sorted(rows):
        w = text.split()
        first.setdefault(frozenset(tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))), i)
    flat = [(i, s) for s, i in first.items()]
    want = {(min(i, j), max(i, j)) for k, (i, a) in enumerate(flat) for j, b in flat[:k] if 100 * len(a & b) >= 60 * len(a | b)}
    got = [tuple(r) for r in jaccard.jaccard_links(spark.createDataFrame([(*r, "s", "n", "b") for r in rows], DOC), 3, 60).select("a", "b").collect()]
    ids = components(list(first.values()), want)
    assert len(want) > len(ids) - len(set(ids.values())), "some links are not needed for the components"
    assert len(got) == len(want) and set(got) == want


def test_jaccard_edge_cases(spark):
    long = "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3
    rows = [(5, "one"), (3, "ONE"), (9, None), (8, ""), (7, " \n"), (2, long), (1, long + "end"), (1, long + "end"), (None, "one"), (None, None), (6, "É"), (4, "é"), (20, "x " * 50_000), (21, "x x"), (22, "x x x")]
    got = jaccard.jaccard_components(spark.createDataFrame([(*r, "s", "n", "b") for r in rows], DOC), 3, 90).collect()
    found = sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None)
    n = len({tuple(long.split()[k : k + 3]) for k in range(76)})
    assert found == [(1, n + 1, 1), (1, n + 1, 1), (2, n, 1), (3, 1, 3), (4, 1, 4), (5, 1, 3), (6, 1, 6), (7, 0, 7), (8, 0, 8), (9, 0, 9), (20, 1, 20), (21, 1, 21), (22, 1, 20)]
    assert [(r.n_shingles, r.component_id) for r in got if r.doc_id is None and r.n_shingles == 0] == [(0, None)]
    assert jaccard.jaccard_components(spark.createDataFrame([], DOC)).count() == 0


@given(st.integers(0, 10**6), st.integers(2, 120), st.sampled_from([60, 80, 90]))
@settings(max_examples=40, deadline=None)
def test_trees_lose_no_pair(seed, n, percent):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 150).astype(np.uint64)
    sets = []
    for _ in range(n):
        own = base[rng.random(150) < rng.choice([0.3, 0.95, 0.99])]
        own = np.concatenate([own, rng.integers(0, 2**63, rng.integers(0, 9)).astype(np.uint64)])
        sets.append(np.unique(own) if len(own) else base[:1])
    groups = rng.integers(0, 4, n)
    sizes = np.array([len(s) for s in sets])
    left = {(max(i, j), min(i, j)) for i, j, _ in jaccard.bucket_pairs(sizes, groups, [jaccard.bitmap(s) for s in sets], percent)}
    for i in range(n):
        for j in range(i):
            shared = len(np.intersect1d(sets[i], sets[j]))
            if groups[i] != groups[j] and 100 * shared >= percent * (sizes[i] + sizes[j] - shared):
                assert (i, j) in left


def draw_sets(rng, n):
    base = rng.integers(0, 2**63, 150).astype(np.uint64)
    sets = []
    for _ in range(n):
        own = np.concatenate([base[rng.random(150) < rng.choice([0.3, 0.95, 0.99])], rng.integers(0, 2**63, rng.integers(0, 9)).astype(np.uint64)])
        sets.append(np.unique(own) if len(own) else base[:1])
    return sets


@given(st.integers(0, 10**6), st.integers(2, 150), st.sampled_from([60, 80, 90]))
@settings(max_examples=40, deadline=None)
def test_partners_and_nearest_of_a_bucket(seed, n, percent):
    """Partners are pairs that the trees leave, and no node that has one goes without; nearest is the best of them."""
    rng = np.random.default_rng(seed)
    sets = draw_sets(rng, n)
    sizes, groups, bits = np.array([len(s) for s in sets]), rng.integers(0, n, n), [jaccard.bitmap(s) for s in sets]
    left = {(min(i, j), max(i, j)): most for i, j, most in jaccard.bucket_pairs(sizes, groups, bits, percent)}
    bucket = jaccard.Bucket(sizes, groups, bits)
    i, j = bucket.partners(percent)
    got = {(min(p), max(p)) for p in zip(i.tolist(), j.tolist(), strict=True)}
    assert got <= left.keys() and {x for p in got for x in p} == {x for p in left for x in p}
    best = {}
    for (a, b), most in left.items():
        like = most / (sizes[a] + sizes[b] - most)
        for x, y in ((a, b), (b, a)):
            best[x] = max(best.get(x, (-1, 0)), (like, -y))
    i, j = bucket.nearest(percent)
    assert dict(zip(i.tolist(), j.tolist(), strict=True)) == {x: -y for x, (_, y) in best.items()}


def test_a_bucket_of_near_copies_costs_its_size():
    """Pairs of a pass grow with the nodes, not with their square, and join all of them."""
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 200).astype(np.uint64)
    for n in (1000, 16_000):
        sets = []
        for _ in range(n):
            own = base.copy()
            own[(at := rng.integers(0, 198)) : at + 3] = rng.integers(0, 2**63, 3).astype(np.uint64)
            sets.append(np.unique(own))
        i, j = jaccard.Bucket(np.array([len(s) for s in sets]), np.arange(n), [jaccard.bitmap(s) for s in sets]).partners(90)
        assert len(i) <= 2 * n
        assert len(set(components(range(n), zip(i.tolist(), j.tolist(), strict=True)).values())) == 1


def test_thousands_of_near_copies(spark):
    """Texts of 200 words that differ in one of them: every two link."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(5000):
        own = list(base)
        own[rng.randrange(200)] = f"x{k}"
        rows.append((k + 7, " ".join(own)))
    rows += [(k, f"another text of its own number {k} and its square {k * k}") for k in range(7)]
    got = jaccard.jaccard_components(spark.createDataFrame([(*r, "s", "n", "b") for r in rows], DOC), 3, 90).collect()
    assert {r.component_id for r in got if r.doc_id >= 7} == {7}
    assert sorted(r.component_id for r in got if r.doc_id < 7) == list(range(7))


def test_connected_components(spark):
    links = [(k, k + 1) for k in range(10, 40)] + [(3, 40), (100, 101), (101, 102), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 3 for k in [3, *range(10, 41)]} | {k: 100 for k in (100, 101, 102)}


def test_jaccard_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    frame = queries.op4_ngram_jaccard(spark, sf_dir)
    want = con.execute(f"SELECT {', '.join(frame.columns)} FROM ({sql.ORACLES['op4_ngram_jaccard']})").fetchall()
    assert sorted(map(tuple, frame.collect())) == sorted(want)


ITEM = "item_id long, text string"
QUESTION = "A train leaves Lisbon at 9 and travels 120 km to Porto at 60 km per hour with 3 stops. How long does the trip to Porto take for Maria, who gets on in Lisbon?"
PAD = "plain words that have nothing to do with any question stand around here and there for a while "


def leaks(spark, texts, items):
    docs = spark.createDataFrame([(k, t, "s", "n", "b") for k, t in enumerate(texts)], DOC)
    got = decontaminate.find_leaks(docs, spark.createDataFrame(items, ITEM)).collect()
    return {(r.doc_id, r.item_id): r for r in got}


def brute_tokens(text):
    """(word, token with names typed, token with names as words, whether a slot), a word at a time."""
    out, before_number, sentence = [], False, True
    for word in (text or "").split():
        core = word.strip(decontaminate._EDGES) or word
        low = core.lower()
        if any(c.isdigit() for c in low) and re.search(r"\d", low):
            kind = "<num>"
        elif low in decontaminate.UNITS:
            kind = "<unit>" if before_number else low
        elif core[0].isupper() and not sentence:
            kind = "<name>"
        else:
            kind = low
        slot = kind in ("<num>", "<unit>", "<name>") and kind != low
        out.append((low, ("slot", kind) if slot else ("word", low), ("slot", kind) if slot and kind != "<name>" else ("word", low), slot, low in decontaminate.UNITS))
        before_number = slot and kind == "<num>"
        sentence = word[-1] not in "abcdefghijklmnopqrstuvwxyz,;" and word.rstrip("\"')]}»“”’")[-1:] in (".", "!", "?")
    return out


def brute_leaks(texts, items):
    """The template matcher without hashes: windows are compared token by token."""
    found = {}
    for d, text in enumerate(texts):
        theirs = brute_tokens(text)
        for item_id, question in items:
            own = brute_tokens(question)
            size = min(8, len(own))
            if not own or len(theirs) < size:
                continue
            hits = {}
            for q in range(len(own) - size + 1):
                part = own[q : q + size]
                literal = [2 * sum(t[c][0] == "word" for t in part) >= size and len(own) >= 5 for c in (1, 2)]
                exact = not literal[1] or (q == 0 and part[0][4])
                for p in range(len(theirs) - size + 1):
                    there = theirs[p : p + size]
                    for c in (1, 2):
                        if literal[c - 1] and any([t[s] for t in there] == [t[c] for t in part] for s in (1, 2)):
                            hits.setdefault(p - q, (set(), set()))[0].add(q)
                    if exact and [t[0] for t in there] == [t[0] for t in part]:
                        hits.setdefault(p - q, (set(), set()))[1].add(q)
            covered, windows, slots, changed = set(), 0, 0, 0
            for offset, (places, exact) in hits.items():
                stands = {}
                at = sorted({q + k for q in places for k in range(size) if own[q + k][3]})
                for s in at:
                    stands.setdefault((own[s][1], own[s][0]), []).append(theirs[offset + s][0])
                agreed = {k: max(v, key=lambda x, v=v: (v.count(x), -v.index(x))) for k, v in stands.items()}
                odd = {s for s in at if agreed[own[s][1], own[s][0]] != theirs[offset + s][0]}
                kept = exact | {q for q in places if not odd & set(range(q, q + size))}
                held = {q + k for q in kept for k in range(size)}
                covered |= held
                windows += len(kept)
                slots += sum(own[s][3] for s in held)
                changed += sum(own[s][3] and own[s][0] != theirs[offset + s][0] for s in held)
            run = longest = 0
            for s in range(len(own)):
                run = run + 1 if s in covered else 0
                longest = max(longest, run)
            if covered and (2 * len(covered) >= len(own) or longest >= 13):
                found[d, item_id] = (round(len(covered) / len(own), 9), windows, slots, changed, "reparameterised" if changed else "verbatim")
    return found


def questions(seed, n):
    """Items with names, numbers and units, and texts that hold them whole, in part, with other values, or with values mixed up."""
    rng = random.Random(seed)
    plain = "the a of train leaves at and travels to from how many stops does it make on its way there second after each".split()
    names, units = ["Lisbon", "Porto", "Maria", "Rome", "Ines"], ["km", "kg", "hours", "m", "second"]

    def words(k):
        out = []
        for _ in range(k):
            x = rng.random()
            out += [rng.choice(names)] if x < 0.12 else [str(rng.randrange(9))] + ([rng.choice(units)] if rng.random() < 0.5 else []) if x < 0.3 else [rng.choice(plain) + (rng.choice([".", ",", "?"]) if rng.random() < 0.1 else "")]
        return out

    items = [(k, " ".join(words(rng.choice([1, 2, 4, 6, 9, 15, 30])))) for k in range(n)]
    texts = []
    for _ in range(3 * n):
        out = words(rng.randrange(20))
        for _ in range(rng.randrange(3)):
            own = rng.choice(items)[1].split()
            low = rng.randrange(len(own))
            own = own[low : low + rng.choice([len(own), 10, 16])] if rng.random() < 0.4 else own
            change = {v: rng.choice([names, "123456789", units][j]) for j, group in enumerate((names, "012345678", units)) for v in group}
            how = rng.random()
            own = own if how < 0.3 else [change.get(w, w) for w in own] if how < 0.6 else [rng.choice([change.get(w, w), w]) for w in own] if how < 0.8 else [w.lower() for w in own]
            out += own + words(rng.randrange(6))
        texts.append(" ".join(out))
    return items, [*texts, None, ""]


@pytest.mark.parametrize("seed", [1, 2])
def test_decontamination_against_a_matcher_without_hashes(spark, seed):
    items, texts = questions(seed, 25)
    got = {k: (round(r.coverage, 9), r.windows, r.slots, r.changed_slots, r.kind) for k, r in leaks(spark, texts, items).items()}
    want = brute_leaks(texts, items)
    assert {r[4] for r in want.values()} == {"verbatim", "reparameterised"} and len(want) > 40
    assert got == want


@pytest.mark.parametrize("broadcast", [common.BROADCAST_BYTES, 0])
def test_decontamination(spark, monkeypatch, broadcast):
    monkeypatch.setattr(common, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(common, "HOT", 10)
    other = QUESTION.replace("120", "350").replace("60 km", "70 km").replace("Lisbon", "Madrid").replace("Maria", "Ines")
    mixed = QUESTION.replace("in Lisbon", "in Rome").replace("from Porto", "x")
    texts = [PAD + QUESTION + " " + PAD, PAD + other, QUESTION.lower(), PAD * 40, None, "", QUESTION.replace(" ", "\n"), mixed, "word " * 30_000 + QUESTION, "short text here it is", PAD + " ".join(QUESTION.split()[:9])]
    items = [(1, QUESTION), (2, "Short one here now ok."), (3, None), (4, ""), (5, "two words"), (6, "Entirely unrelated benchmark text about clouds drifting over quiet harbours at dawn today.")]
    got = leaks(spark, texts, items)
    assert {k for k in got if k[1] == 1} == {(k, 1) for k in (0, 1, 2, 6, 7, 8)}
    assert set(got) - {(k, 1) for k in range(11)} == set()
    assert got[0, 1].kind == "verbatim" and got[0, 1].coverage == 1.0
    assert got[1, 1].kind == "reparameterised" and got[1, 1].changed_slots > 0


def test_inconsistent_slots_are_no_copy(spark):
    item = "If 7 is a prime then the sum of 7 and the square of 7 divided by 7 is what whole number near 7 exactly"
    same, odd = item.replace("7", "11"), item
    for value in ("1", "2", "3", "4", "5", "6"):
        odd = odd.replace("7", value, 1)
    got = leaks(spark, [same, odd], [(1, item)])
    assert got[0, 1].kind == "reparameterised"
    assert (1, 1) not in got or got[1, 1].coverage < got[0, 1].coverage


def test_verbatim_items_of_numbers_and_short_items(spark):
    sums, row, short = "12 + 30 = 42 ; 7 x 6 = 42 m 9 s", "3.5 kg 12 m 40 s 18 c 77 f 5 a 6 h", "Capital of Peru?"
    items = [(1, sums), (2, row), (3, short), (4, "42 km"), (5, f"{row} is what the table of {short} says")]
    texts = [PAD + sums + " " + PAD, row, f"{PAD}capital of peru? {PAD}", "42 km", row.replace("1", "2"), PAD, f"{PAD} {row} is what the table of {short} says"]
    got = leaks(spark, texts, items)
    assert {k for k, r in got.items() if r.coverage == 1.0} == {(0, 1), (1, 2), (2, 3), (3, 4), (6, 2), (6, 3), (6, 5)}
    assert {r.kind for r in got.values()} == {"verbatim"} and not {d for d, _ in got} & {4, 5}


def test_words_of_units_are_units_after_numbers_only():
    words = decontaminate.Words()
    kind = [int(k) for k in words.tokens("a second 5 a second 60 km km Second 7 s".split())[3]]
    assert kind == [0, 0, 1, 2, 0, 1, 2, 0, 0, 1, 2]


def test_unit_word_in_front_of_an_item_after_a_number(spark):
    item = "second law of motion here"
    assert set(leaks(spark, [f"the 2 {item} and", f"{PAD}{item}"], [(1, item)])) == {(0, 1), (1, 1)}


def test_null_item_ids_stay_null(spark):
    got = leaks(spark, [PAD + QUESTION], [(None, QUESTION), (-1, QUESTION)])
    assert set(got) == {(0, None), (0, -1)}


def test_decontamination_empty(spark):
    assert leaks(spark, [], [(1, QUESTION)]) == {}
    assert leaks(spark, [QUESTION], []) == {}


def test_decontamination_query_finds_contained_items(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    held = {(d.doc_id, i.item_id) for d in docs for i in items if i.text in (d.text or "")}
    got = {(r.doc_id, r.item_id): r.coverage for r in queries.op2_decontaminate(spark, sf_dir).collect()}
    assert held <= set(got)
    assert {k for k, c in got.items() if c == 1.0} == held

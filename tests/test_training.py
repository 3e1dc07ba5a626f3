import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.operators import training
from tessera.plans import registry, trace_queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def brute(library, messages, mode, most, side, answer, search):
    """Every prefix encoded whole."""
    text = lambda said: "".join(f"<|im_start|>{r or ''}\n{c or ''}<|im_end|>\n" for r, c in said)
    turns = [k for k, (r, _) in enumerate(messages) if r == "assistant"]
    ids, labels, weights, seen = [], [], [], 0
    for k, (role, content) in enumerate(messages):
        whole = library.encode(text(messages[: k + 1]), add_special_tokens=False).ids
        delta, seen = whole[seen:], len(whole)
        low = (content or "").lower()
        on = role == "assistant" and (mode != "final_only" or k == turns[-1])
        weight = (answer if "<answer>" in low else search if "<search>" in low else 1.0) if on else 0.0
        ids += delta
        labels += delta if on else [-100] * len(delta)
        weights += [weight] * len(delta)
    if len(ids) <= most:
        return ids, labels, weights
    cut = slice(-most, None) if side == "left" else slice(0, most)
    return ids[cut], labels[cut], weights[cut]


PARTS = st.lists(st.sampled_from(["hello", " ", "  ", "\n", "\n\n", "é漢", "<answer>", "a-b", "\t", "<|endoftext|>", "'s", "12", "!?", " x", "\xa0"]), max_size=8).map("".join)


@given(st.lists(PARTS, max_size=6))
@settings(max_examples=300, deadline=None)
def test_deltas_are_those_of_whole_prefixes(library, texts):
    seen, want = 0, []
    for k in range(len(texts)):
        ids = library.encode("".join(texts[: k + 1]), add_special_tokens=False).ids
        want.append(ids[seen:])
        seen = len(ids)
    assert list(training.PrefixEncoder(PATH).deltas(texts)) == want


ROWS = [
    (1, "all_assistant", [("system", "be brief"), ("user", "who?"), ("assistant", "<Search>x</search>"), ("user", "y"), ("assistant", "<answer>z</answer> <search>")]),
    (2, " Final_Only ", [("user", "who?"), ("assistant", "one"), ("user", None), ("assistant", "two  \n"), ("user", "three")]),
    (3, None, []),
    (4, None, None),
    (5, "x", [(None, "no role"), ("assistant", None)]),
    (6, "x", [("assistant", "long word " * 3000), ("user", "a"), ("assistant", "b")]),
    (6, "x", [("user", "  leading"), ("assistant", "\n")]),
]


@pytest.mark.parametrize(("most", "side"), [(8192, "right"), (20, "left"), (20, "right")])
def test_arrays_against_whole_prefixes(spark, library, most, side):
    frame = spark.createDataFrame([(*r, "i", "l") for r in ROWS], "id long, mode string, messages array<struct<role:string,content:string>>, input_ids_ string, said string")
    from pyspark.sql import functions as F

    got = training.supervised_tokens(frame, PATH, most, side, 3.0, 0.25, F.col("mode")).collect()
    want = [(i, *map(tuple, brute(library, m or [], (mode or "").strip().lower(), most, side, 3.0, 0.25))) for i, mode, m in ROWS]
    key = lambda x: (x[0], len(x[1]))
    assert sorted(((r.id, tuple(r.input_ids), tuple(r.labels), tuple(r.loss_weights)) for r in got), key=key) == sorted(want, key=key)
    assert {r.said for r in got} == {"l"}


def test_wrong_side_is_refused(spark):
    with pytest.raises(ValueError, match="left or right"):
        training.supervised_tokens(spark.createDataFrame([], "messages array<struct<role:string,content:string>>"), PATH, truncate_side="middle")


def test_query_against_whole_prefixes(spark, sf_dir, library):
    import hashlib

    told = lambda x: hashlib.md5(",".join(map(str, x)).encode()).hexdigest()
    want = []
    for r in trace_queries._tagged_messages(spark, sf_dir).collect():
        ids, labels, weights = brute(library, [tuple(m) for m in r.messages], r.supervision_mode, 4096, "left", 2.5, 0.5)
        want.append((r.conv_id, len(ids), sum(x != -100 for x in labels), round(sum(weights), 6), told(ids), told(labels)))
    got = registry.QUERIES["delta_tokens"](spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(want)

"""Token ids, labels and loss weights of conversations for supervised training (survey S22, P33).

A message's ids are what it adds to the ids of the templated conversation so far: with the ids of messages 0..i and of
messages 0..i-1, those from the latter's length on. Supervised turns are labelled with their own ids, all others with
IGNORED and weight 0. Conversations that are too long lose ids at the chosen side.

Encoding every prefix anew would cost the square of a conversation's length. Byte-level BPE does not join what stands
before a single space or newline between other characters with what follows, so only the text after the last such
place is encoded again when a message is added; the ids are those of whole prefixes, which the tests compare.

Null messages are none, null roles and contents empty; a conversation without messages has empty arrays.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Label of ids that carry no loss.
IGNORED = -100
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_NONE = "array<struct<role:string,content:string>>"


def turn_losses(messages: Column, final_only: Column | bool = False, answer_weight: float = 1.0, search_weight: float = 1.0) -> Column:
    """array<struct<supervised, weight>>: assistant turns, or the last one only, weighted by what they hold.

    A turn with an answer tag, in any case, weighs ``answer_weight``, else one with a search tag ``search_weight``, else 1.
    """
    only = F.lit(final_only) if isinstance(final_only, bool) else F.coalesce(final_only, F.lit(False))
    last = F.array_max(F.transform(messages, lambda m, i: F.when(m["role"] == "assistant", i).otherwise(-1)))

    def one(m: Column, i: Column) -> Column:
        low = F.lower(F.coalesce(m["content"], F.lit("")))
        weight = F.when(F.contains(low, F.lit("<answer>")), float(answer_weight)).when(F.contains(low, F.lit("<search>")), float(search_weight)).otherwise(1.0)
        supervised = F.coalesce(m["role"] == "assistant", F.lit(False)) & (~only | (i == last))
        return F.struct(supervised.alias("supervised"), F.when(supervised, weight).otherwise(0.0).alias("weight"))

    return F.transform(messages, one)


def chat_template(role: Column, content: Column) -> Column:
    """One message between marks, the default template; what follows a message does not change it."""
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), content, F.lit("<|im_end|>\n"))


class PrefixEncoder:
    """The ids that each message adds to the ids of the texts before it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        kind = type(self.tokenizer.pre_tokenizer).__name__
        # Other kinds, and added tokens with white space, may join what stands around a cut.
        self.cuts = kind == "ByteLevel" and self.tokenizer.normalizer is None and not any(re.search(r"\s", t) for t in added)

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids if text else []

    def deltas(self, texts: list[str]) -> Iterator[list[int]]:
        # Ids of the text before the last cut, and of what follows it; both end where the conversation so far does.
        settled, open_, open_ids = 0, "", []
        for text in texts:
            before = settled + len(open_ids)
            pieces = _CUT.split(open_ + text) if self.cuts else [open_ + text]
            fresh = self.ids("".join(pieces[:-1]))
            open_, open_ids = pieces[-1], self.ids(pieces[-1])
            whole = fresh + open_ids
            yield whole[before - settled :]
            settled += len(fresh)


_ENCODERS: dict[str, PrefixEncoder] = {}


def _encoder(path: str) -> PrefixEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PrefixEncoder(path)
    return _ENCODERS[path]


def supervised_tokens(
    rows: DataFrame, path: str, max_length: int = 8192, truncate_side: str = "right", answer_weight: float = 1.0, search_weight: float = 1.0,
    mode: Column | None = None, template: Callable[[Column, Column], Column] = chat_template,
) -> DataFrame:
    """``rows`` (messages array<struct<role, content>>) with input_ids, labels and loss_weights.

    ``path``: a tokenizer file that executors can open; ``mode``: ``final_only`` supervises the last assistant turn
    alone, anything else all of them.
    """
    if truncate_side not in ("left", "right"):
        raise ValueError(f"truncate_side is left or right, not {truncate_side!r}")
    only = F.lower(F.trim(F.coalesce(mode, F.lit("")))) == "final_only" if mode is not None else F.lit(False)
    said = F.transform(F.coalesce(F.col("messages"), F.array().cast(_NONE)), lambda m: F.struct(F.coalesce(m["role"], F.lit("")).alias("role"), F.coalesce(m["content"], F.lit("")).alias("content")))
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), said.alias("said"), only.alias("only"))
    packed = packed.select("row", F.transform("said", lambda m: template(m["role"], m["content"])).alias("texts"), turn_losses(F.col("said"), F.col("only"), answer_weight, search_weight).alias("losses"))
    kind = packed.schema["row"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(path)
        cut = slice(-max_length, None) if truncate_side == "left" else slice(0, max_length)
        for batch in batches:
            made = []
            for texts, losses in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids, labels, weights = [], [], []
                for delta, loss in zip(own.deltas(texts), losses, strict=True):
                    ids += delta
                    labels += delta if loss["supervised"] else [IGNORED] * len(delta)
                    weights += [loss["weight"]] * len(delta)
                made.append((ids[cut], labels[cut], weights[cut]) if len(ids) > max_length else (ids, labels, weights))
            arrays = [pa.array([m[k] for m in made], pa.list_(t)) for k, t in enumerate((pa.int32(), pa.int32(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["row", "input_ids", "labels", "loss_weights"])

    found = packed.mapInArrow(work, f"row {kind}, input_ids array<int>, labels array<int>, loss_weights array<double>")
    return found.select(*[F.col("row")[c].alias(c) for c in rows.columns], "input_ids", "labels", "loss_weights")

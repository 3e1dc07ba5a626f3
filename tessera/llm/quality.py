r"""Quality rules with DataFrame expressions only: rules on each text and cross-document line frequency.

Rules on a text (see ``base_features``) fail short and repetitive documents. Across documents, lines are normalised
(lower case, digits as 0, punctuation and white space as single spaces), hashed, and the distinct documents that hold
each line are counted per host; here a document's host is its source. A line of at least MIN_LINE_WORDS words that more
distinct documents of a host hold than ``limit`` allows is removed from all of them: more than SHARE of the host's
distinct documents, but always more than FEW, and never more than MANY. So a small host needs a handful of documents, and
in a large one, however large, a line that MANY different documents hold is common. A document is rejected as depleted
when less than KEEP of its words is left. Exact copies of a text count as one document on both sides, so that a text is
not taken for boilerplate because it was copied.

Lines are cut once, to a written table of hashes; it is counted with partial aggregation before each shuffle, and joined
with the common lines. Texts are not shuffled, unless the documents with removed words are too many to be broadcast.

Defined cases: a null text has no words and fails the rules, and counts as an empty document; a null source is a host of
its own; empty lines count for nothing; repeated rows get the same verdict; an empty table gives an empty result; input
columns with names of the results are replaced, others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, beside, let, materialise, n_words, words

SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line is common in more documents of a host than this share of them ...
SHARE = 0.02
#: ... if they are more than FEW, and in more than MANY documents in any case.
FEW = 5
MANY = 100
MIN_LINE_WORDS = 3
#: Share of its words that a document keeps at least.
KEEP = 0.3
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(own: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more.

    Window hashes are sorted with their places; equal neighbours are the repeated ones, and each of their places, in
    order, adds the words up to the next one, three at most.
    """
    hashes = F.transform(F.sequence(F.lit(0), F.size(own) - 3), lambda i: F.xxhash64(F.get(own, i), F.get(own, i + 1), F.get(own, i + 2)))

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def places(ordered: Column) -> Column:
        repeated = F.filter(ordered, lambda x, k: (x["h"] == F.get(ordered, k + 1)["h"]) | ((k > 0) & (x["h"] == F.get(ordered, F.greatest(k - 1, F.lit(0)))["h"])))
        return F.sort_array(F.transform(repeated, lambda x: x["at"]))

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, k: F.struct(x.alias("h"), k.alias("at"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(ordered, places), covered))

    return F.when(F.size(own) < 3, F.lit(0)).otherwise(let(hashes, count)).cast("bigint")


def _lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORD)))


def base_features(text: Column) -> dict[str, Column]:
    """The rules' figures for a text; all 0 for null."""
    whole = F.coalesce(text, F.lit(""))
    # Words are cut once for three figures.
    of_words = let(
        words(whole),
        lambda own: F.struct(F.size(own).alias("n"), F.length(F.array_join(own, "")).alias("chars"), _repeat_words(own).alias("again")),
    )
    return {
        "of_words": of_words,
        "n_symbols": F.regexp_count(whole, F.lit(SYMBOLS)).cast("bigint"),
        "n_dup_lines": let(_lines(whole), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
    }


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"\p{N}", "0"), r"[^\p{L}\p{N}]+", " "))


def _copy(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_table(docs: DataFrame) -> DataFrame:
    """One row per line with a word: key, hash of the text, host, its place, hash of the normalised line, number of words."""
    cut = _lines(F.coalesce("text", F.lit("")))
    exploded = docs.select(F.col("doc_id").alias("key"), _copy(F.col("text")).alias("copy"), F.col("source").alias("host"), F.posexplode(cut).alias("at", "line"))
    return exploded.select("key", "copy", "host", "at", F.xxhash64(normalised(F.col("line"))).alias("hash"), n_words(F.col("line")).cast("int").alias("words"))


def limit(docs: Column, share: float = SHARE, few: int = FEW, many: int = MANY) -> Column:
    """Distinct documents of a host that may hold a line, of ``docs`` there are."""
    return F.greatest(F.lit(few), F.least(docs * share, F.lit(many)))


def frequent_lines(docs: DataFrame, lines: DataFrame, share: float = SHARE, few: int = FEW, many: int = MANY) -> DataFrame:
    """(host, hash) of the lines that too many distinct documents of a host hold."""
    # Two aggregations instead of a distinct count: the first combines copies and repetitions before the shuffle.
    held = lines.where(F.col("words") >= MIN_LINE_WORDS).select("host", "hash", "copy").distinct().groupBy("host", "hash").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > few)
    hosts = docs.select(F.col("source").alias("host_name"), _copy(F.col("text")).alias("copy")).distinct().groupBy("host_name").agg(F.count(F.lit(1)).alias("all_docs"))
    kept = held.join(hosts, F.col("host").eqNullSafe(F.col("host_name"))).where(F.col("docs") > limit(F.col("all_docs"), share, few, many))
    return kept.select(F.col("host").alias("bad_host"), F.col("hash").alias("bad_hash"))


def judge(docs: DataFrame, share: float = SHARE, few: int = FEW, many: int = MANY, keep: float = KEEP) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with the base figures, base_failed, removed_words and kept."""
    lines = materialise(line_table(docs), "quality-lines")
    bad = materialise(frequent_lines(docs, lines, share, few, many), "quality-common")
    hit = lines.join(beside(bad, 64), F.col("host").eqNullSafe(F.col("bad_host")) & (F.col("hash") == F.col("bad_hash"))).drop("bad_host", "bad_hash")
    # Repeated rows of an id, a text and a source bring their lines once.
    lost = hit.dropDuplicates(["key", "copy", "host", "at"]).groupBy("key", "copy", "host").agg(F.sum("words").alias("lost_words"))
    lost = materialise(lost.withColumnsRenamed({"copy": "lost_copy", "host": "lost_host"}), "quality-lost")
    made = {*FEATURES, "base_failed", "removed_words", "kept"}
    held = [c for c in docs.columns if c.lower() not in made]
    figured = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in held]).alias("row"), F.col("doc_id").alias("id"), _copy(F.col("text")).alias("copy"), F.col("source").alias("host"),
        *[c.alias(n) for n, c in base_features(F.col("text")).items()],
    )
    same = F.col("id").eqNullSafe(F.col("key")) & (F.col("copy") == F.col("lost_copy")) & F.col("host").eqNullSafe(F.col("lost_host"))
    joined = figured.join(beside(lost, 64), same, "left").select(
        "row", F.col("of_words.n").cast("bigint").alias("n_words"), F.col("of_words.chars").cast("bigint").alias("word_chars"), "n_symbols", "n_dup_lines",
        F.col("of_words.again").alias("n_repeat_words"), F.coalesce("lost_words", F.lit(0)).cast("bigint").alias("removed_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    kept = ~failed & (F.col("n_words") - F.col("removed_words") >= keep * F.col("n_words"))
    return joined.select(*[F.col("row").getField(c).alias(c) for c in held], *FEATURES, failed.alias("base_failed"), "removed_words", kept.alias("kept"))

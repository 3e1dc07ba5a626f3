"""Packets and skill banks (survey S10, S11, J3, J9, J13, A13, W16-W18, R12, R15)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx

from .sampling import best, first_distinct

HEADER = r"^`([a-z0-9][a-z0-9-]*)`\s*$"


def parse_bank(lines: DataFrame, keep_empty: bool = False, joiner: str = "\n") -> DataFrame:
    """Numbered lines (doc, line_no, value) of skill-bank markdown -> doc, ord, skill_id, text; last header wins."""
    head = F.regexp_extract("value", HEADER, 1)
    along = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("head_line", F.when(F.length(head) > 0, F.col("line_no"))).withColumn("at", F.last("head_line", ignorenulls=True).over(along))
    named = marked.where(F.col("at").isNotNull()).groupBy("doc", "at").agg(
        F.max(F.when(F.col("line_no") == F.col("at"), head)).alias("skill_id"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("line_no") > F.col("at"), F.struct("line_no", "value")))), lambda x: x["value"]), joiner).alias("text"),
    )
    out = named.groupBy("doc", "skill_id").agg(F.min("at").alias("ord"), F.max_by("text", "at").alias("text")).withColumn("text", tx.strip(F.col("text")))
    return out if keep_empty else out.where("text != ''")


def bank_ids(text: Column, in_order: bool = False) -> Column:
    """Ids in backticks, sorted and distinct or in order of first occurrence."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(tx.BACKTICK_ID), 1))
    return found if in_order else F.array_sort(found)


#: Headings of the index and of cards, in our words.
INDEX_HEAD, CARDS_HEAD = "Skills of the bank:", "Cards of the chosen skills:"


def skill_index(bank: DataFrame, limit: int = 180, heading: str = INDEX_HEAD) -> DataFrame:
    """A heading and one line per skill; a bank has tens of skills, collected in their order."""
    line = F.concat(F.lit("- "), F.col("skill_id"), F.lit(": "), tx.compact_text(F.col("text"), limit))
    return bank.groupBy("doc").agg(F.concat_ws("\n", F.lit(heading), F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"])).alias("index_text"))


def skill_cards(ids: Column, bank: Column, limit: int = 900, heading: str = CARDS_HEAD) -> Column:
    """A heading and the cards of skill ids, from a map of id to text; unknown ids give empty text."""
    cards = F.transform(ids, lambda s: F.concat(F.lit('<skill_card id="'), s, F.lit('">\n'), tx.compact_text(F.coalesce(F.try_element_at(bank, s), F.lit("")), limit), F.lit("\n</skill_card>")))
    return F.concat_ws("\n", F.lit(heading), cards)


def build_packets(rows: DataFrame, order: Sequence[Column], examples: int = 3) -> DataFrame:
    """Packets of a signature with up to ``examples`` distinct questions."""
    chosen = first_distinct(rows, ["dataset", "signature"], tx.collapse("question"), order, examples)
    shown = chosen.groupBy("dataset", "signature").agg(F.array_sort(F.collect_list(F.struct("id", "question", "primary_answer"))).alias("representative_examples"))
    sizes = rows.groupBy("dataset", "signature").agg(F.count(F.lit(1)).alias("group_size"))
    return sizes.join(shown, ["dataset", "signature"], "left").withColumn("group_id", tx.packet_id(F.col("dataset"), F.col("signature")))


def _in(column: str, *values: str) -> Column:
    return F.arrays_overlap(F.coalesce(column, F.array().cast("array<string>")), F.array(*[F.lit(v) for v in values]))


def bucket_rules(round_no: int) -> list[tuple[Column, str]]:
    """The bucket predicates of a round, fixed values of that round, over native_type, flags, entity_bin, token_bin, hop_count, wh_word, form.

    Round 1's long bucket means ``long`` only, and its yes/no bucket names question words that profiles never have.
    """
    n, e, t, h = F.col("native_type"), F.col("entity_bin"), F.col("token_bin"), F.col("hop_count")
    many, dated = e.isin("multi_entity", "dense_entity"), _in("flags", "temporal", "numeric", "time_anchor")
    compare, long = (n == "comparison") | _in("flags", "comparison"), t.isin("long", "very_long")
    check, same, chain = _in("flags", "yes_no", "verification"), _in("flags", "same_attribute"), _in("flags", "relation_chain")
    checked = _in("flags", "verification", "dense_entities") & many
    if round_no == 1:
        w, form = F.col("wh_word"), F.col("form")
        return [
            (_in("flags", "direct_lookup"), "direct"), (_in("flags", "alias"), "alias"), (_in("flags", "temporal") | (w == "when"), "temporal"),
            (_in("flags", "numeric") | (form == "number") | (w == "how"), "numeric"), (_in("flags", "location") | (w == "where"), "location"),
            (_in("flags", "person") | w.isin("who", "whose"), "person"), (_in("flags", "organization"), "organization"),
            (_in("flags", "yes_no") | w.isin("is", "are", "was", "were", "do", "does", "did", "can", "could", "has", "have", "had"), "yes_no"),
            ((e != "single_entity") | (t == "long"), "long_wording"), (_in("flags", "quoted_span") | form.isin("long_span", "list_like"), "quoted_or_list"),
        ]
    if round_no == 2:
        return [
            (n == "bridge", "bridge"), (compare, "comparison"), ((n == "bridge") & dated, "bridge_dated"), (compare & dated, "comparison_dated"),
            ((n == "bridge") & (many | _in("flags", "dense_entities", "multi_entity")), "bridge_entities"), ((n == "bridge") & long, "bridge_long"),
            (compare & same, "comparison_attribute"), (check, "verification"), ((n == "bridge") & chain, "bridge_chain"), (checked, "dense_verification"),
        ]
    if round_no == 3:
        return [
            (n == "compositional", "compositional"), (compare, "comparison"), (n == "bridge_comparison", "bridge_comparison"), (n == "inference", "inference"),
            (chain, "chain"), (h >= 4, "four_hops"), (compare & same, "comparison_attribute"), (check, "verification"), (dated, "dated"), (checked, "dense_verification"),
        ]
    if round_no == 4:
        return [
            (n == "decomp_2", "decomp_2"), (n == "decomp_3", "decomp_3"), (n == "decomp_4", "decomp_4"), (_in("flags", "longer_hop") | (h >= 3), "longer_hop"),
            (_in("flags", "temporal", "numeric"), "dated"), (_in("flags", "dense_entities", "multi_entity") & many, "entities"), (_in("flags", "comparison", "same_attribute"), "comparison"),
            (_in("flags", "time_anchor"), "time_anchor"), (chain, "chain"), (long & _in("flags", "dense_entities", "longer_hop"), "long_dense"),
        ]
    raise ValueError(f"no round {round_no}")


def bucket_rollup(packets: DataFrame, rules: list[tuple[Column, str]], example: Column, size: Column, order: Sequence[Column], limit: int) -> DataFrame:
    """Per bucket matched packets, their sizes and the first distinct examples.

    Packets are exploded by the buckets they match, so there is no join over predicates.
    """
    tagged = packets.withColumn("__size", size).withColumn("bucket", F.explode(tx.choices(*rules)))
    totals = tagged.groupBy("bucket").agg(F.count(F.lit(1)).alias("matched_packet_count"), F.sum("__size").cast("bigint").alias("total_group_size"))
    shown = first_distinct(tagged.withColumn("__example", example), ["bucket"], F.col("__example"), order, limit)
    texts = shown.groupBy("bucket").agg(F.array_join(F.array_sort(F.collect_set("__example")), "|").alias("examples"))
    return totals.join(texts, "bucket", "left")


def top_profiles(packets: DataFrame, order: Sequence[Column], n: int = 18) -> DataFrame:
    """W18."""
    return best(packets, n, order)


def render_summary(rollup: list[dict]) -> str:
    """Markdown of the buckets, on the driver: there are ten at most."""
    lines = ["# Packet summary", ""]
    for r in sorted(rollup, key=lambda x: (-x["matched_packet_count"], x["bucket"])):
        lines += [f"## {r['bucket']}", f"- packets: {r['matched_packet_count']}", f"- rows: {r['total_group_size']}"]
        lines += [f"- {e}" for e in (r.get("examples") or "").split("|") if e] + [""]
    return "\n".join(lines)

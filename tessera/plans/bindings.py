"""The driver's tables in the roles of question rows, traces and trajectories, for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import profile, text as tx
from tessera.operators import coverage
from tessera.session import table, written


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as question rows: text is the question, its first word the answer, lang the native type."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("dataset"), text.alias("question"), F.array(F.split(text, " ")[0]).alias("golden_answers"),
        F.col("lang").alias("native_type"), (F.length(text) % 4 + 1).alias("hop_count"),
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile columns of every question row; ASCII word characters, as in the SQL."""
    rows = questions(spark, sf_dir)
    q, a = F.col("question"), F.col("golden_answers")[0]
    count = profile.entity_count(q, unicode=False)
    made = rows.select(
        "id", "dataset", "question", a.alias("answer"), "native_type", "hop_count", tx.word_count(q).alias("words"), profile.wh_word(q).alias("wh_word"), count.alias("entity_count"),
        profile.answer_form(a).alias("form"), profile.single_flags(q, a).alias("flags"),
    )
    made = made.withColumn("entity_bin", profile.entity_bin(F.col("entity_count"))).withColumn("token_bin", profile.token_bin(F.col("words")))
    fields = {"wh_word": ("text", F.col("wh_word")), "entity_bin": ("text", F.col("entity_bin")), "token_bin": ("text", F.col("token_bin")), "answer_form_hint": ("text", F.col("form")), "dataset": ("text", F.col("dataset"))}
    parts = {"wh": F.col("wh_word"), "answer": F.col("form"), "entity": F.col("entity_bin"), "token": F.col("token_bin")}
    return made.withColumn("signature", profile.signature(fields, F.col("flags"))).withColumn("labels", profile.labels(parts, F.col("flags")))


def _cue(column: str, cues: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{c}')" for c in cues) + ")"


def _starts(column: str, cues: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"starts_with({column}, '{c}')" for c in cues) + ")"


def _flag(condition: str, name: str) -> str:
    return f"CASE WHEN {condition} THEN '{name}' END"


def sql_form(answer: str, words: int) -> str:
    low = rf"lower(regexp_replace({answer}, '^\s+|\s+$', '', 'g'))"
    return rf"""CASE WHEN {low} IN ('yes', 'no') THEN 'boolean' WHEN regexp_matches({low}, '\b(1[5-9]\d{{2}}|20\d{{2}}|2100)\b') THEN 'year_or_date'
      WHEN regexp_matches({low}, '\d') THEN 'number' WHEN contains({low}, ',') THEN 'list_like'
      WHEN {sql_words(low)} >= {words} THEN 'long_span' ELSE 'entity_or_short_span' END"""


def sql_words(value: str) -> str:
    return rf"len(list_filter(regexp_split_to_array({value}, '\s+'), lambda x: x <> ''))"


def _sql_flags(single: bool) -> str:
    starts = _flag(_starts("low", profile.YES_NO_STARTS), "yes_no")
    if single:
        c = profile.SINGLE_CUES
        own = [_flag("true", "direct_lookup"), _flag(rf"({_cue('low', c['numeric'])} OR regexp_matches(answer, '\d'))", "numeric"), *[_flag(_cue("low", c[k]), k) for k in c if k != "numeric"], starts]
        own += [_flag("(contains(question, '\"') OR contains(question, ''''))", "quoted_span"), _flag("words >= 14", "long_question")]
    else:
        c = profile.MULTI_CUES
        extra = {"comparison": " OR contains(lower(coalesce(native_type, '')), 'comparison')", "numeric": r" OR regexp_matches(answer, '\d')"}
        own = [*[_flag(f"({_cue('low', c[k])}{extra.get(k, '')})", k) for k in c], starts, _flag("hop_count >= 3", "longer_hop"), _flag("entity_count >= 3", "dense_entities")]
    return f"list_sort(list_distinct(list_filter([{', '.join(own)}], lambda x: x IS NOT NULL)))"


_WH = " ".join(f"WHEN starts_with(ltrim(low), '{w} ') THEN '{w}'" for w in profile.WH_WORDS)
_SPAN = profile.SPAN.replace("'", "''")

#: Common table expressions q (rows), e (counts), p (profiles with flags) and s (signature and labels).
SQL_PROFILES = rf"""
q AS (
  SELECT doc_id AS id, source AS dataset, coalesce(text, '') AS question, lower(coalesce(text, '')) AS low, string_split(coalesce(text, ''), ' ')[1] AS answer,
    lang AS native_type, length(coalesce(text, '')) % 4 + 1 AS hop_count
  FROM documents),
e AS (
  SELECT *, CAST({sql_words("question")} AS BIGINT) AS words,
    CAST(len(list_distinct(list_filter(regexp_extract_all(question, '{_SPAN}'), lambda x: length(x) > 1))) AS BIGINT) AS entity_count
  FROM q),
p AS (
  SELECT *, CASE {_WH} ELSE 'other' END AS wh_word, {sql_form("answer", 4)} AS form,
    CASE WHEN entity_count <= 1 THEN 'single_entity' WHEN entity_count = 2 THEN 'two_entities' WHEN entity_count <= 4 THEN 'multi_entity' ELSE 'dense_entity' END AS entity_bin,
    CASE WHEN words <= 6 THEN 'short' WHEN words <= 10 THEN 'medium' WHEN words <= 16 THEN 'long' ELSE 'very_long' END AS token_bin,
    CASE WHEN words <= 8 THEN 'short' WHEN words <= 14 THEN 'medium' WHEN words <= 22 THEN 'long' ELSE 'very_long' END AS token_bin_multi,
    {_sql_flags(True)} AS flags, {_sql_flags(False)} AS multi_flags
  FROM e),
s AS (
  SELECT *, '{{"answer_form_hint": "' || form || '", "dataset": "' || dataset || '", "entity_bin": "' || entity_bin || '", "flags": ['
      || array_to_string(list_transform(flags[1:6], lambda f: '"' || f || '"'), ', ') || '], "token_bin": "' || token_bin || '", "wh_word": "' || wh_word || '"}}' AS signature,
    list_sort(list_distinct(list_concat(['wh:' || wh_word, 'answer:' || form, 'entity:' || entity_bin, 'token:' || token_bin], list_transform(flags, lambda f: 'flag:' || f)))) AS labels
  FROM p),
n AS (SELECT label, count(*) AS freq FROM (SELECT unnest(labels) AS label FROM s) GROUP BY label),
r AS (
  SELECT id, round(sum(1.0 / freq), 9) AS rarity, min(freq) AS rarest FROM (SELECT id, unnest(labels) AS label FROM s) JOIN n USING (label) GROUP BY id),
t AS (
  SELECT s.*, rarity, rarest, count(*) OVER (PARTITION BY signature) AS group_size, greatest(12, CAST(ceil(0.002 * count(*) OVER ()) AS BIGINT)) AS threshold FROM s JOIN r USING (id)),
k AS (SELECT *, group_size <= 3 AS small, rarest <= threshold AS rare, (group_size <= 3 OR rarest <= threshold) AS protected FROM t)
"""


#: As SQL_PROFILES, then y: annotated groups with labels and priority, ranked by ``place``.
SQL_GROUPS = f"""{SQL_PROFILES}, g AS (
  SELECT signature, dataset, substr(md5(signature), 1, 16) AS group_id, count(*) AS size, coalesce(arg_min(native_type, id), 'unknown') AS native_type, arg_min(hop_count, id) AS hop_count, arg_min(flags, id) AS f,
    arg_min(entity_bin, id) AS entity_bin, arg_min(form, id) AS answer_form FROM s GROUP BY signature, dataset),
b AS (SELECT *, list_has_any(f, ['comparison']) OR contains(native_type, 'comparison') AS compare, list_has_any(f, ['relation_chain']) OR contains(native_type, 'bridge') OR contains(native_type, 'inference') OR hop_count >= 3 AS chain,
  list_has_any(f, ['temporal', 'time_anchor']) AS time_, list_has_any(f, ['numeric']) AS count_, list_has_any(f, ['yes_no', 'verification']) AS check_,
  list_has_any(f, ['multi_entity']) OR entity_bin IN ('multi_entity', 'dense_entity') AS many, list_has_any(f, ['same_attribute']) AS same FROM g),
ta AS (SELECT *, CASE WHEN same THEN 'set_constraint' WHEN many THEN 'multi_entity' WHEN chain THEN 'relation_chain' WHEN compare THEN 'pairwise_entities' ELSE 'single_entity' END AS entity_pattern,
  list_sort(list_filter(['compositional_lookup', CASE WHEN compare THEN 'comparison_reasoning' END, CASE WHEN chain THEN 'relation_chain' END, CASE WHEN chain THEN 'bridge_reasoning' END, CASE WHEN time_ THEN 'temporal_reasoning' END,
    CASE WHEN count_ THEN 'numerical_reasoning' END, CASE WHEN check_ THEN 'verification_or_yes_no' END, CASE WHEN many THEN 'multi_entity_grounding' END, CASE WHEN same THEN 'set_constraint' END], lambda x: x IS NOT NULL)) AS reasoning,
  list_filter(['answer_composition', CASE WHEN compare THEN 'comparison' END, CASE WHEN chain THEN 'relation_following' END, CASE WHEN chain THEN 'bridge_search' END, CASE WHEN time_ THEN 'temporal_filtering' END,
    CASE WHEN count_ THEN 'aggregation_or_counting' END, CASE WHEN check_ THEN 'evidence_verification' END, CASE WHEN many THEN 'entity_grounding' END, CASE WHEN same THEN 'constraint_filtering' END], lambda x: x IS NOT NULL) AS demands FROM b),
o AS (SELECT *, CASE WHEN hop_count >= 4 THEN 5 WHEN size < 32 OR entity_pattern IN ('multi_entity', 'relation_chain', 'set_constraint') THEN 4 ELSE 3 END AS coverage_priority,
  list_sort(list_distinct(list_concat(['native:' || native_type, 'hop:' || hop_count, 'entity:' || entity_pattern, 'answer:' || answer_form], list_transform(reasoning, lambda x: 'reasoning:' || x), list_transform(demands, lambda x: 'skill:' || x)))) AS labels FROM ta),
el AS (SELECT group_id, size, unnest(labels) AS label FROM o),
fq AS (SELECT label, sum(size) AS freq, row_number() OVER (ORDER BY sum(size), label) AS step FROM el GROUP BY label),
ra AS (SELECT group_id, sum(1.0 / sqrt(freq)) AS rarity FROM el JOIN fq USING (label) GROUP BY group_id),
yr AS (SELECT o.*, round(2.5 * coverage_priority + rarity + 0.15 * log2(size + 1), 9) AS priority FROM o JOIN ra USING (group_id)),
y AS (SELECT *, row_number() OVER (ORDER BY priority DESC, group_id) AS place FROM yr)"""


def annotated_groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Profile rows with their group_id, narrow and written once, and the annotated groups with their labels."""
    rows = profiles(spark, sf_dir).withColumn("answer_form_hint", F.col("form")).withColumn("group_id", tx.short_md5(F.col("signature")))
    rows = written(rows.select("id", "dataset", "group_id", "signature", "native_type", "hop_count", "flags", "entity_bin", "answer_form_hint"), "profiles")
    groups = coverage.annotate(coverage.groups(rows))
    return rows, written(groups.withColumn("labels", profile.coverage_labels()), "groups")


def unicode_low(column: str) -> str:
    """SQL: lower-cased text with accented letters as x, so that RE2's ASCII word boundaries fall where Unicode's do."""
    return rf"regexp_replace(lower(coalesce({column}, '')), '[\x{{C0}}-\x{{24F}}]', 'x', 'g')"

"""Queries of annotation, banks, rendering and rewards, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import profile, text as tx
from tessera.operators import coverage, merge, messages, packets, reports, sampling
from tessera.session import table

from .bindings import SQL_GROUPS, SQL_PROFILES, annotated_groups, questions, sql_words

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(f"""WITH {SQL_PROFILES}, z AS (SELECT id, {_STRIP.format("question")} AS plain, {_STRIP.format("answer")} AS a, wh_word FROM p)
SELECT id, array_to_string(list_sort(list_filter([CASE WHEN a = '' THEN 'empty_answer' END, CASE WHEN length(plain) < 20 THEN 'very_short_text' END, CASE WHEN {sql_words('plain')} < 4 THEN 'too_few_tokens' END,
  CASE WHEN {' OR '.join(f"starts_with(lower(plain), '{s}')" for s in profile.FRAGMENT_STARTS)} THEN 'fragment_after_aux' END,
  CASE WHEN wh_word = 'other' AND NOT ends_with(plain, '?') AND (plain = '' OR regexp_matches(plain, '^\\p{{Ll}}')) THEN 'non_interrogative_fragment' END], lambda x: x IS NOT NULL)), '|') AS reasons FROM z""")
def suspicious_rows(spark, sf_dir):
    """P15."""
    rows = questions(spark, sf_dir)
    return rows.select("id", F.array_join(profile.suspicious(F.col("question"), F.col("golden_answers")[0]), "|").alias("reasons"))


@query(f"WITH {SQL_GROUPS} SELECT group_id, dataset, size, array_to_string(reasoning, '|') AS reasoning_types, entity_pattern, coverage_priority, CASE WHEN hop_count >= 4 THEN 'hard' ELSE 'medium' END AS difficulty FROM o")
def group_annotations(spark, sf_dir):
    """P13, W7."""
    return annotated_groups(spark, sf_dir)[1].select("group_id", "dataset", "size", F.array_join("reasoning_types", "|").alias("reasoning_types"), "entity_pattern", "coverage_priority", "difficulty")


@query(f"WITH {SQL_GROUPS} SELECT group_id, round(priority, 6) AS priority, array_to_string(labels, '|') AS labels FROM y")
def group_priorities(spark, sf_dir):
    """Priorities of groups over all their labels."""
    groups = coverage.group_priority(annotated_groups(spark, sf_dir)[1])
    return groups.select("group_id", F.round("priority", 6).alias("priority"), F.array_join("labels", "|").alias("labels"))


@query("""SELECT 'bank-' || (p_partkey % 5) AS doc, 'skill-' || p_size AS skill_id, arg_max(p_name || ' ' || p_type, p_partkey) AS text, count(*) AS headers FROM part GROUP BY ALL""")
def skill_bank(spark, sf_dir):
    """Parts as markdown banks: a header line and a body line each, the last header of a skill wins."""
    part = table(spark, sf_dir, "part").withColumn("doc", F.concat(F.lit("bank-"), (F.col("p_partkey") % 5).cast("string")))
    name = F.concat(F.lit("skill-"), F.col("p_size").cast("string"))
    lines = part.select("doc", F.explode(F.array(F.struct((F.col("p_partkey") * 2).alias("line_no"), F.concat(F.lit("`"), name, F.lit("`")).alias("value")), F.struct((F.col("p_partkey") * 2 + 1).alias("line_no"), F.concat("p_name", F.lit(" "), "p_type").alias("value")))).alias("l")).select("doc", "l.*")
    counts = part.groupBy("doc", name.alias("skill_id")).agg(F.count(F.lit(1)).alias("headers"))
    return packets.parse_bank(lines).select("doc", "skill_id", "text").join(counts, ["doc", "skill_id"])


@query("""WITH s AS (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY first) AS k FROM (
    SELECT source, lang, min(doc_id) AS doc_id, min(doc_id) AS first FROM documents WHERE trim(coalesce(text, '')) <> '' GROUP BY source, lang, md5(trim(regexp_replace(text, '\\s+', ' ', 'g')))))
SELECT source, lang, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS examples FROM s WHERE k <= 3 GROUP BY ALL""".replace("\\\\s", "\\s"))
def packet_examples(spark, sf_dir):
    """Up to three distinct texts of each source and language."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    plain = tx.collapse("text")
    chosen = sampling.first_distinct(rows, ["source", "lang"], F.when(plain != "", F.md5(plain.cast("binary"))), [F.col("doc_id")], 3)
    return chosen.groupBy("source", "lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("examples"))


@query("""WITH c AS (SELECT conv_id, turn, role, trim(coalesce(text, ''), ' ' || chr(10) || chr(9)) AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)
SELECT conv_id, md5(string_agg('Doc ' || k || '(Title: ' || role || ') ' || text, chr(10) ORDER BY k)) AS plain, md5(string_agg('Doc ' || k || '(Title: "' || role || '") ' || text, chr(10) ORDER BY k)) AS quoted FROM c GROUP BY conv_id""")
def passages(spark, sf_dir):
    """Turns as retrieved passages."""
    docs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("title"), F.col("text").alias("text")))).alias("docs"))
    return docs.select("conv_id", F.md5(messages.passages(F.col("docs")).cast("binary")).alias("plain"), F.md5(messages.passages(F.col("docs"), quoted=True).cast("binary")).alias("quoted"))


@query("""WITH c AS (SELECT conv_id, role, turn, max(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS last FROM conversations)
SELECT conv_id, CAST(count(*) FILTER (role = 'assistant') AS DOUBLE) AS all_weight, CAST(count(*) FILTER (role = 'assistant' AND turn = last) AS DOUBLE) AS final_weight FROM c GROUP BY conv_id""")
def turn_weights(spark, sf_dir):
    """P33, W25."""
    rows = messages.ordered_messages(table(spark, sf_dir, "conversations"))
    total = lambda w: F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    return rows.select("conv_id", total(messages.turn_weights(F.col("messages"))).alias("all_weight"), total(messages.turn_weights(F.col("messages"), final_only=True)).alias("final_weight"))


@query("""WITH q AS (SELECT conv_id, list(string_split(coalesce(text, ''), ' ')[1] ORDER BY turn) AS words, string_agg(lower(coalesce(text, '')), ' ' ORDER BY turn) AS seen FROM conversations GROUP BY conv_id)
SELECT conv_id, round(CAST(1 AS DOUBLE) + 0.2::DOUBLE * CAST(contains(seen, lower(words[1])) AS INTEGER) - 0.1::DOUBLE * (len(words) - len(list_distinct(words))), 9) AS reward FROM q""")
def rewards(spark, sf_dir):
    """A22."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.split(F.coalesce("text", F.lit("")), " ")[0].alias("word"), F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    words, texts = F.transform("t", lambda x: x["word"]), F.transform("t", lambda x: x["text"])
    return rows.select("conv_id", F.round(reports.reward(F.lit(1), F.slice(words, 1, 1), texts, words, 0.2, 0.1), 9).alias("reward"))


@query("SELECT status, count(*) AS count FROM (SELECT CASE WHEN e.value > 50 THEN 'kept' WHEN e.value > 20 THEN 'quality' ELSE 'duplicate' END AS status FROM events e) GROUP BY status")
def drop_reasons(spark, sf_dir):
    """A12, A16."""
    v = F.col("value")
    return reports.histogram(table(spark, sf_dir, "events"), F.when(v > 50, "kept").when(v > 20, "quality").otherwise("duplicate"), "status")


@query("""SELECT e.user_id AS id, string_agg(DISTINCT e.event_type, '|' ORDER BY e.event_type) AS wrong_skills FROM events e WHERE NOT e.value > 50 GROUP BY e.user_id""")
def failure_skills(spark, sf_dir):
    """M4: skills used by failed traces; users are traces, event types skills."""
    rows = table(spark, sf_dir, "events").where(~(F.col("value") > 50)).groupBy(F.col("user_id").alias("id")).agg(F.collect_list(F.struct("event_id", F.array("event_type").alias("selected_skills"))).alias("steps"))
    full = rows.withColumn("question", F.lit("q")).withColumn("prediction", F.lit("p")).withColumn("em", F.lit(0))
    found = merge.failure_replays(full, "ev")
    return found.select(F.regexp_extract("id", r"(\d+)$", 1).cast("bigint").alias("id"), F.array_join(F.array_sort("wrong_skills"), "|").alias("wrong_skills"))


@query(r"SELECT event_id AS id, CASE WHEN length(trim(props)) > 7 THEN rtrim(substr(trim(props), 1, 4)) || '...' ELSE trim(props) END AS clipped, substr(props, 1, 5) AS cut, least(5, greatest(1, CAST(value AS INTEGER))) AS clamped FROM events")
def text_cuts(spark, sf_dir):
    """F7, F8, F20."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), tx.clip_text("props", 7).alias("clipped"), tx.prefix("props", 5).alias("cut"), tx.clamp(F.bround("value").cast("int"), 1, 5).alias("clamped"))

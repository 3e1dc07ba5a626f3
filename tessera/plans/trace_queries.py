"""Queries of traces, messages, merging and evaluation, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import routing, text as tx
from tessera.operators import merge, messages, reports, retrieve, sampling, training, vector_index
from tessera.sources import external
from tessera.session import table

from .bindings import questions, sql_words, unicode_low

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _ascii(pattern: str) -> str:
    return pattern.replace("'", "''")


def _starts(column: str, values) -> str:
    return "(" + " OR ".join(f"starts_with({column}, '{v}')" for v in values) + ")"


def _m(pattern: str, low: str = "low") -> str:
    return f"regexp_matches({low}, '{_ascii(pattern)}')"


def _n(pattern: str) -> str:
    return f"len(regexp_extract_all(low, '{_ascii(pattern)}'))"


_LOW = f"q AS (SELECT doc_id AS id, source AS dataset, coalesce(text, '') AS question, {unicode_low('text')} AS low, lang FROM documents), c AS (SELECT *, {sql_words('question')} AS words FROM q)"
_TYPE = f"""CASE WHEN {_starts('low', routing.EVAL_YES_NO_STARTS)} THEN 'yesno' WHEN {_m(routing.EVAL_COMPARISON)} THEN 'compare' WHEN contains(low, ' or ') THEN 'forced_choice'
  WHEN {_m(routing.SUPERLATIVE)} THEN 'ranking' WHEN {_m(routing.ALIAS)} THEN 'alias' WHEN {_m(routing.EVAL_TIME_OR_NUMBER)} THEN 'time_num'
  WHEN words >= 12 OR {_m(routing.CONSTRAINED)} THEN 'constraint_heavy' ELSE 'fact' END"""


@query(f"WITH {_LOW}, x AS (SELECT id, words, {_TYPE} AS question_type, CAST({_n(routing.CONNECTOR)} AS BIGINT) AS connectors, {_m(routing.RELATION_OF)} AS explicit_relation, {_n(routing.RELATION_MENTION)} AS mentions FROM c) SELECT id, question_type, connectors, explicit_relation, connectors >= 4 OR mentions >= 3 OR (words >= 18 AND connectors >= 3) AS long_hop FROM x")
def question_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("question")
    return questions(spark, sf_dir).select("id", routing.question_type(q).alias("question_type"), routing.connector_count(q).cast("bigint").alias("connectors"), routing.explicit_relation(q).alias("explicit_relation"), routing.long_hop(q).alias("long_hop"))


def _chosen(rules: list[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {when} THEN '{skill}' END" for when, skill in rules) + "], lambda x: x IS NOT NULL)"


def _ordered(values: str) -> str:
    """SQL: the first occurrences of a list's values, in order."""
    return f"list_filter({values}, lambda x, place: list_position({values}, x) = place)"


_HOPS = f"CASE WHEN {_n(routing.HOP_CONNECTOR)} >= 3 THEN 4 WHEN {_n(routing.HOP_CONNECTOR)} = 2 THEN 3 WHEN {_n(routing.HOP_CONNECTOR)} = 1 THEN 2 ELSE 1 END"
# The rules as they are stated, over facts of the question; two rules of one skill are one place each.
_PRIMARY = _chosen([
    ("is_alias", "surface-name-resolution"), ("is_super", "superlative-ranking-match"), ("is_choice AND single", "forced-choice-option-resolution"), ("is_kin", "derived-kinship-inference-join"),
    ("kind = 'comparison' AND (hops >= 3 OR is_anchor)", "bridge-comparison-planning"), ("kind = 'comparison' AND NOT (hops >= 3 OR is_anchor)", "parallel-attribute-compare"), ("kind = 'comparison' AND is_yes_no", "multihop-yes-no-verification"),
    ("kind = 'bridge'", "bridge-entity-search"), ("kind IN ('bridge', 'compositional')", "relation-chain-decomposition"), ("kind = 'compositional'", "sequential-hop-checkpointing"), ("hops >= 4", "re-anchored-long-hop-decomposition"),
    ("hops >= 3", "sequential-hop-checkpointing"), ("hops = 2", "bridge-entity-search"), ("hops IN (2, 3)", "relation-chain-decomposition"), ("is_anchor AND hops >= 2", "temporal-anchor-carry-forward"), ("is_time", "temporal-range-extract"),
    ("words >= 12", "multi-constraint-query-anchoring"), ("single", "single-entity-relation-lookup"), ("NOT single", "bridge-entity-search"), ("NOT single", "relation-chain-decomposition"),
])
_INITIAL = _chosen([
    ("qt = 'yesno'", "multihop-yes-no-verification"), ("compare AND (relation OR bridge)", "bridge-comparison-planning"), ("compare", "parallel-attribute-compare"), ("derived OR (is_kin AND relation AND far)", "derived-kinship-inference-join"),
    ("relation OR bridge", "bridge-entity-search"), ("relation", "relation-chain-decomposition"), ("far", "sequential-hop-checkpointing"), ("far AND is_anchor", "temporal-anchor-carry-forward"), ("far", "re-anchored-long-hop-decomposition"),
    ("far", "reconstructed-chain-verification"), ("qt = 'alias'", "surface-name-resolution"), ("qt = 'ranking'", "superlative-ranking-match"), ("qt IN ('time_num', 'ranking') OR is_anchor", "temporal-range-extract"),
    ("qt = 'forced_choice' AND NOT compare", "forced-choice-option-resolution"), ("qt = 'constraint_heavy'", "multi-constraint-query-anchoring"),
])


@query(f"""WITH {_LOW}, m AS (SELECT id, words, dataset IN ('nq', 'triviaqa') AS single, CASE lang WHEN 'de' THEN 'comparison' WHEN 'fr' THEN 'bridge' WHEN 'es' THEN 'compositional' ELSE 'unknown' END AS kind, {_HOPS} AS hops, {_TYPE} AS qt,
  {_m(routing.YES_NO)} AS is_yes_no, {_m(routing.ALIAS)} AS is_alias, {_m(routing.SUPERLATIVE)} AS is_super, {_m(routing.KINSHIP)} AS is_kin, {_m(routing.FORCED_CHOICE)} AS is_choice, {_m(routing.TEMPORAL_ANCHOR)} AS is_anchor, {_m(routing.TIME_OR_NUMBER)} AS is_time,
  {_m(routing.EVAL_COMPARISON)} AS compare, {_m(routing.DERIVED_KINSHIP)} AS derived, {_m(routing.BRIDGE_LIKE)} AS bridge, {_m(routing.ORGANISATION)} AS company, {_m(routing.RELATION_OF)} AS relation,
  {_n(routing.CONNECTOR)} >= 4 OR {_n(routing.RELATION_MENTION)} >= 3 OR (words >= 18 AND {_n(routing.CONNECTOR)} >= 3) AS far FROM c),
r AS (SELECT *, {_PRIMARY} AS p, {_INITIAL} AS main FROM m),
t AS (SELECT *, list_concat(CASE WHEN len(main) = 0 THEN ['single-entity-relation-lookup'] ELSE main END, CASE WHEN company THEN ['conflict-check', 'answer-grounding-check'] ELSE ['answer-grounding-check'] END) AS i FROM r)
SELECT id, array_to_string({_ordered('p')}[1:5], '|') AS "primary", array_to_string({_ordered('i')}[1:5], '|') AS initial, '{"|".join(routing.SUPPORT_ONLY)}' AS support FROM t""")
def skill_routes(spark, sf_dir):
    """Both routers over every row, skills joined by bars."""
    legal = F.array(*[F.lit(s) for s in (*messages.MULTI_CORE, *messages.SINGLE_CORE, "multi-constraint-query-anchoring", "superlative-ranking-match", *routing.SUPPORT_ONLY)])
    q = F.col("question")
    hops = routing.estimated_hops(q, F.lit(0), F.lit(0))
    kind = F.when(F.col("native_type") == "de", "comparison").when(F.col("native_type") == "fr", "bridge").when(F.col("native_type") == "es", "compositional").otherwise("unknown")
    return questions(spark, sf_dir).select("id", F.array_join(routing.primary_skills(q, kind, F.col("dataset"), hops, legal), "|").alias("primary"), F.array_join(routing.initial_skills(q, legal), "|").alias("initial"), F.array_join(routing.support_skills(legal), "|").alias("support"))


_FLAG = {"is_yes_no": routing.YES_NO, "has_alias_cue": routing.ALIAS, "has_superlative": routing.SUPERLATIVE, "has_kinship": routing.KINSHIP, "has_forced_choice": routing.FORCED_CHOICE, "has_comparison": routing.COMPARISON, "has_temporal_anchor": routing.TEMPORAL_ANCHOR}


@query(f"""WITH {_LOW}, u AS (SELECT 'documents' AS origin, id, dataset, low FROM q UNION ALL SELECT 'conversations', conv_id * 1000 + turn, 'nq', {unicode_low('text')} FROM conversations)
SELECT origin, id, CASE WHEN dataset IN ('nq', 'triviaqa') THEN 'singlehop' ELSE 'multihop' END AS task_family,
  CAST(CASE WHEN {_n(routing.HOP_CONNECTOR)} >= 3 THEN 4 WHEN {_n(routing.HOP_CONNECTOR)} = 2 THEN 3 WHEN {_n(routing.HOP_CONNECTOR)} = 1 THEN 2 ELSE 1 END AS INTEGER) AS estimated_hops,
  {', '.join(f'{_m(p)} AS {n}' for n, p in _FLAG.items())} FROM u""")
def manifest_union(spark, sf_dir):
    rows = questions(spark, sf_dir).select(F.lit("documents").alias("origin"), "id", "dataset", "question")
    more = table(spark, sf_dir, "conversations").select(F.lit("conversations").alias("origin"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit("nq").alias("dataset"), F.coalesce("text", F.lit("")).alias("question"))
    marks = routing.question_marks(F.col("question"))
    both = rows.unionByName(more, allowMissingColumns=True)
    return both.select("origin", "id", routing.task_family(F.col("dataset")).alias("task_family"), routing.estimated_hops(F.col("question"), F.lit(0), F.lit(0)).alias("estimated_hops"), *[marks[n].alias(n) for n in _FLAG])


@query(f"""WITH c AS (SELECT conv_id, turn, role, text, {unicode_low('text')} AS low, ['bridge-entity-search', 'verbatim-evidence-span', 'conflict-check'][turn % 3 + 1] AS joined FROM conversations)
SELECT conv_id, turn, CASE WHEN joined = 'verbatim-evidence-span' THEN 'verifier_as_planner' WHEN {_m(routing.ALIAS)} THEN 'alias_route_error' WHEN {_m(routing.KINSHIP)} THEN 'kinship_route_error'
  WHEN {_m(routing.YES_NO)} THEN 'yesno_aggregation_error' WHEN role = 'yes' THEN 'stopped_on_wrong_answer_type' WHEN {_m(routing.SUPERLATIVE)} THEN 'comparison_or_ranking_route_error'
  WHEN {sql_words("coalesce(text, '')")} >= 14 THEN 'long_question_route_error' ELSE 'generic_route_error' END AS error_tag FROM c""")
def failure_tag_case(spark, sf_dir):
    skill = F.element_at(F.array(F.lit("bridge-entity-search"), F.lit("verbatim-evidence-span"), F.lit("conflict-check")), (F.col("turn") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", routing.failure_tag(F.col("text"), F.col("role"), F.array(skill)).alias("error_tag"))


def _steps(spark, sf_dir):
    """Conversations as trajectories: a user's turn searches for its first word, an assistant's turn answers."""
    said, word = F.coalesce("text", F.lit("")), F.split(F.coalesce("text", F.lit("")), " ")[0]
    user = F.col("role") == "user"
    step = F.struct(
        "turn", F.when(user, "search").otherwise("answer").alias("action"), F.when(user, "bridge-entity-search").when(F.col("turn") % 4 == 1, "conflict-check").otherwise("single-entity-relation-lookup").alias("primary_skill"),
        F.array(F.when(F.length(said) % 7 == 0, "made-up-skill").otherwise("conflict-check")).alias("support_skills"), F.when(user, word).otherwise("").alias("query"), F.when(user, "").otherwise(word).alias("draft_answer"), F.when(user, said).otherwise("").alias("retrieved"),
    )
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    return rows.withColumn("final_answer", F.coalesce(merge.last_step(F.col("steps"))["draft_answer"], F.lit("")))


_STEPS = "s AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, string_split(coalesce(text, ''), ' ')[1] AS word, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)"


@query(f"""WITH {_STEPS} SELECT conv_id, CAST(count(*) AS BIGINT) AS n_steps, CAST(count(*) FILTER (role = 'user' AND trim(text) <> '') AS BIGINT) AS retrieved_steps, bool_or(role = 'user') AS has_search,
  CAST(count(DISTINCT CASE WHEN length(text) % 7 = 0 THEN 1 END) AS BIGINT) AS n_unknown, max(CASE WHEN turn = last THEN CASE WHEN role = 'user' THEN 'bridge-entity-search' WHEN turn % 4 = 1 THEN 'conflict-check' ELSE 'single-entity-relation-lookup' END END) AS last_skill FROM s GROUP BY conv_id""")
def validate_steps(spark, sf_dir):
    rows = _steps(spark, sf_dir)
    legal = F.array(*[F.lit(s) for s in ("bridge-entity-search", "single-entity-relation-lookup", *routing.SUPPORT_ONLY)])
    v = merge.validation(F.col("steps"), F.col("final_answer"), F.array("final_answer"), legal, legal)
    return rows.withColumn("v", v).select("conv_id", F.size("steps").cast("bigint").alias("n_steps"), merge.retrieved_steps(F.col("steps")).cast("bigint").alias("retrieved_steps"), F.col("v.has_search").alias("has_search"), F.size("v.unknown_skills").cast("bigint").alias("n_unknown"), merge.last_step(F.col("steps"))["primary_skill"].alias("last_skill"))


_PRIORITY = "CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 4 END"


def _source():
    e = F.col("event_type")
    return F.when(e == "purchase", 0).when(e == "signup", 1).when(e == "click", 2).when(e == "view", 3).otherwise(4)


@query(f"""WITH r AS (SELECT user_id, event_id, value, value > 20 AS passed, event_type = 'error' AS failed, {_PRIORITY} AS source, CAST(event_id % 5 AS INTEGER) AS n_steps, length(props) AS n_outputs FROM events)
SELECT user_id, event_id, first_arrival FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY passed DESC, failed, source, n_steps, n_outputs DESC, event_id) AS k, min(event_id) OVER (PARTITION BY user_id) AS first_arrival FROM r) WHERE k = 1""")
def merge_priority(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") > 20).alias("passed"), (F.col("event_type") == "error").alias("runtime_error"), _source().alias("source"), (F.col("event_id") % 5).alias("n_steps"), F.length("props").alias("n_outputs"), F.col("event_id").alias("arrival"))
    return merge.merge_runs(runs, "user_id").select("user_id", "event_id", "first_arrival")


@query(f"""WITH l AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, {_PRIORITY} AS p FROM events GROUP BY user_id, event_type),
o AS (SELECT *, value > 20 AS a, CAST(floor(value / 10) AS BIGINT) AS b FROM l),
j AS (SELECT x.user_id, x.event_type, x.p, x.a, x.b, (SELECT struct_pack(a := y.a, b := y.b, p := -y.p, t := y.event_type) FROM o y WHERE y.user_id = x.user_id AND y.p < x.p ORDER BY y.a DESC, y.b DESC, y.p LIMIT 1) AS h FROM o x)
SELECT CASE WHEN (a, b) > (h.a, h.b) THEN event_type ELSE h.t END AS kept, CASE WHEN (a, b) > (h.a, h.b) THEN h.t ELSE event_type END AS replaced, count(*) AS count FROM j WHERE h IS NOT NULL GROUP BY ALL""")
def canonical_overlap_log(spark, sf_dir):
    latest = sampling.last_wins(table(spark, sf_dir, "events").select("user_id", "event_type", "value", "ts", "event_id"), ["user_id", "event_type"], F.struct("ts", "event_id"))
    rows = latest.select("user_id", F.col("event_type").alias("source"), _source().alias("source_priority"), "value")
    _, log = merge.merge_canonical(rows, [F.col("value") > 20, F.floor(F.col("value") / 10)], ("user_id",))
    return log.groupBy("kept", "replaced").agg(F.count(F.lit(1)).alias("count"))


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def last_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return sampling.last_wins(rows, ["user_id", "event_type"], F.struct("ts", "event_id")).select("user_id", "event_type", "event_id", "value")


@query(f"""WITH {_STEPS}, p AS (SELECT *, CASE WHEN role = 'user' THEN '<skill>bridge-entity-search' || CASE WHEN length(text) % 7 = 0 THEN '|made-up-skill' ELSE '|conflict-check' END || '</skill>' || chr(10) || '<search>' || CASE WHEN trim(word) = '' THEN 'q' ELSE trim(word, ' ' || chr(10) || chr(9)) END || '</search>'
    ELSE '<skill>' || CASE WHEN turn % 4 = 1 THEN CASE WHEN length(text) % 7 = 0 THEN 'conflict-check|made-up-skill' ELSE 'conflict-check' END ELSE 'single-entity-relation-lookup' || CASE WHEN length(text) % 7 = 0 THEN '|made-up-skill' ELSE '|conflict-check' END END || '</skill>' || chr(10) || '<answer>' || trim(word, ' ' || chr(10) || chr(9)) || '</answer>' END AS said,
    CASE WHEN role = 'user' AND trim(text) <> '' THEN '<information>' || chr(10) || substr(trim(text, ' ' || chr(10) || chr(9)), 1, 4000) || chr(10) || '</information>' END AS back FROM s)
SELECT conv_id, CAST(2 + count(*) + count(back) AS BIGINT) AS n_messages, md5(string_agg(said || coalesce(back, ''), '' ORDER BY turn)) AS packed FROM p GROUP BY conv_id""")
def stage1_messages(spark, sf_dir):
    rows = _steps(spark, sf_dir)
    packed = messages.pack_retrieval("s", F.lit("u"), F.col("steps"), F.lit("q"), F.lit(""))
    joined = F.array_join(F.transform(F.slice("m", F.lit(3), F.greatest(F.size("m") - 2, F.lit(0))), lambda m: m["content"]), "")
    return rows.withColumn("m", packed).select("conv_id", F.size("m").cast("bigint").alias("n_messages"), F.md5(joined.cast("binary")).alias("packed"))


@query("""WITH m AS (SELECT conv_id, role, length(coalesce(text, '')) AS n, row_number() OVER w AS k, lag(role) OVER w AS before FROM conversations WHERE role IS DISTINCT FROM 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
f AS (SELECT *, CASE WHEN role = 'assistant' THEN CASE WHEN n % 11 = 0 THEN 'missing_skill_tag' WHEN n % 7 = 0 THEN 'unknown_skill' WHEN before IS DISTINCT FROM 'user' THEN 'assistant_without_user' END
  WHEN role IS DISTINCT FROM 'user' THEN 'unsupported_role_' || coalesce(role, 'None') END AS fault FROM m),
g AS (SELECT conv_id, arg_min(fault, k) FILTER (fault IS NOT NULL) AS fault, count(*) FILTER (role = 'assistant') AS a, count(*) FILTER (role = 'user') AS u FROM f GROUP BY conv_id),
c AS (SELECT conv_id, CASE WHEN fault IS NOT NULL THEN fault WHEN coalesce(a, 0) = 0 THEN 'no_assistant_turns' ELSE '' END AS reason, u, a FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN g USING (conv_id))
SELECT reason, CAST(CASE WHEN reason = '' THEN 1 + u + 3 * a ELSE 0 END AS BIGINT) AS n_messages, count(*) AS count FROM c GROUP BY ALL""")
def stage2_message_hist(spark, sf_dir):
    """Message counts and drop reasons after the two-phase repacking; by length some turns have no tag or
    a skill beside a known one that the bank lacks."""
    said = F.coalesce("text", F.lit(""))
    tag = F.when(F.length(said) % 11 == 0, "").when(F.length(said) % 7 == 0, "<skill>conflict-check|made-up-skill</skill>\n").otherwise("<skill>conflict-check</skill>\n")
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("role") == "assistant", F.concat(tag, said)).otherwise(F.col("text")))
    rows = messages.ordered_messages(turns).withColumnRenamed("conv_id", "id")
    packed = messages.repack_two_phase(rows, F.create_map(F.lit("conflict-check"), F.lit("card")), F.lit("index"))
    packed = packed.withColumn("packed", F.coalesce("packed", F.array().cast(packed.schema["packed"].dataType)))
    return packed.groupBy(F.coalesce("drop_reason", F.lit("")).alias("reason"), F.size("packed").cast("bigint").alias("n_messages")).agg(F.count(F.lit(1)).alias("count"))


@query(f"""WITH q AS (SELECT doc_id AS id, source, trim(coalesce(text, ''), ' ' || chr(10) || chr(9)) AS question, lower(coalesce(text, '')) AS low, {sql_words("coalesce(text, '')")} AS words FROM documents)
SELECT id, source AS data_source, md5(CASE WHEN question <> '' AND NOT ends_with(question, '?') THEN question || '?' ELSE question END) AS question_md5,
  CAST(least(3 + CASE WHEN {' OR '.join(f"contains(low, '{c}')" for c in ('same', 'both', 'older', 'younger', 'earlier', 'later', ' or '))} THEN 1 ELSE 0 END + CASE WHEN words >= 18 THEN 1 ELSE 0 END, 5) AS INTEGER) AS search_budget FROM q""")
def search_budget(spark, sf_dir):
    rows = messages.prompt_rows(questions(spark, sf_dir), "train", "Answer the question.")
    return rows.select(F.col("id").cast("bigint").alias("id"), "data_source", F.md5(F.col("question").cast("binary")).alias("question_md5"), F.col("extra_info.search_budget").alias("search_budget"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 100 = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_dot_product(q.v, e.v) AS score FROM q, e WHERE q.vec_id <> e.vec_id)
SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 3""")
def knn_top3(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    found = retrieve.top_k(rows.where("vec_id % 100 = 0"), rows, 3)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query()
def knn_index_top3(spark, sf_dir):
    """R1 with an index: probes are calibrated to hold 95 % of the neighbours; its recall is tested against ``knn_top3``."""
    rows = table(spark, sf_dir, "embeddings")
    found = vector_index.build_index(rows).search(rows.where("vec_id % 100 = 0"))
    return found.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(ORACLES["knn_top3"])
def knn_index_exact(spark, sf_dir):
    """R1 with an index, certified: cells that a better neighbour could be in are probed too."""
    rows = table(spark, sf_dir, "embeddings")
    found = vector_index.build_index(rows).search(rows.where("vec_id % 100 = 0"), certified=True)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(r"SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '(?is)<a (.*?)>', 1)) AS BIGINT) AS links, regexp_extract(html, '(?is)<p>(.*?)</p>', 1) AS first_paragraph FROM pages")
def parse_markup(spark, sf_dir):
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", messages.markup_title(html).alias("title"), F.size(F.regexp_extract_all(html, F.lit(r"(?is)<a (.*?)>"), 1)).cast("bigint").alias("links"), F.regexp_extract(html, r"(?is)<p>(.*?)</p>", 1).alias("first_paragraph"))


@query("""SELECT user_id || '-' || hour(ts) AS id, count(*) FILTER (event_type IS DISTINCT FROM 'error') > 0 AS done,
  arg_min(event_id, (ts, event_id)) FILTER (event_type IS DISTINCT FROM 'error') AS event_id, arg_min(event_type, (ts, event_id)) FILTER (event_type IS DISTINCT FROM 'error') AS event_type, arg_min(value, (ts, event_id)) FILTER (event_type IS DISTINCT FROM 'error') AS value,
  CASE WHEN count(*) FILTER (event_type IS DISTINCT FROM 'error') = 0 THEN arg_max(coalesce(props, 'error'), (ts, event_id)) END AS last_error, count(*) FILTER (event_type = 'error') AS failures
FROM events WHERE user_id IS NOT NULL GROUP BY user_id, hour(ts)""")
def resume_attempts(spark, sf_dir):
    """The state of a run that was resumed several times."""
    from tessera.streaming.queries import resume_attempts as run

    return run(spark, sf_dir)


def _tagged_messages(spark, sf_dir):
    """Conversations whose texts are searches, answers (the tag in mixed case) or plain, by their length; every other one supervises its last turn alone."""
    text = F.coalesce("text", F.lit(""))
    kind = F.length(text) % 3
    said = F.when(kind == 0, F.concat(F.lit("<search>"), text, F.lit("</search>"))).when(kind == 1, F.concat(F.lit("<Answer>"), text, F.lit("</Answer>"))).otherwise(text)
    rows = messages.ordered_messages(table(spark, sf_dir, "conversations").withColumn("text", said))
    return rows.withColumn("supervision_mode", F.when(F.col("conv_id") % 2 == 0, "final_only").otherwise("all_assistant"))


@query("""WITH c AS (SELECT conv_id, turn, role, length(coalesce(text, '')) % 3 AS kind, max(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS last FROM conversations),
w AS (SELECT *, role = 'assistant' AND (conv_id % 2 <> 0 OR turn = last) AS supervised, CASE kind WHEN 1 THEN 2.5::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1::DOUBLE END AS weight FROM c)
SELECT conv_id, count(*) FILTER (supervised) AS supervised_turns, round(coalesce(sum(weight) FILTER (supervised), 0), 9) AS total_weight, string_agg(CASE WHEN supervised THEN CAST(weight AS VARCHAR) ELSE '0.0' END, '|' ORDER BY turn) AS weights FROM w GROUP BY conv_id""")
def turn_losses(spark, sf_dir):
    """Which turns are supervised, and the weights of answer, search and other turns."""
    rows = _tagged_messages(spark, sf_dir).withColumn("l", training.turn_losses(F.col("messages"), F.col("supervision_mode") == "final_only", 2.5, 0.5))
    total = F.aggregate("l", F.lit(0.0), lambda a, x: a + x["weight"])
    return rows.select("conv_id", F.size(F.filter("l", lambda x: x["supervised"])).cast("bigint").alias("supervised_turns"), F.round(total, 9).alias("total_weight"), F.array_join(F.transform("l", lambda x: x["weight"].cast("string")), "|").alias("weights"))


@query()
def delta_tokens(spark, sf_dir):
    """Ids, labels and weights of conversations by a public tokenizer; digests of them, and their counts."""
    import public_tokenizers

    made = training.supervised_tokens(_tagged_messages(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 4096, "left", 2.5, 0.5, F.col("supervision_mode"))
    told = lambda c: F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), ",").cast("binary"))
    supervised = F.size(F.filter("labels", lambda x: x != training.IGNORED)).cast("bigint")
    total = F.aggregate("loss_weights", F.lit(0.0), lambda a, x: a + x)
    return made.select("conv_id", F.size("input_ids").cast("bigint").alias("n_ids"), supervised.alias("n_supervised"), F.round(total, 6).alias("total_weight"), told("input_ids").alias("ids_md5"), told("labels").alias("labels_md5"))


_HEAD = "'<skill>a | b</skill> '"


@query(rf"""WITH c AS (SELECT conv_id, turn, role = 'user' AS usr, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS plain FROM conversations)
SELECT conv_id, turn, CASE WHEN usr THEN 'search' ELSE 'final' END AS action, CASE WHEN usr THEN length(plain) END AS query_chars,
  length({_HEAD} || CASE WHEN usr THEN '<search> ' || t || ' </search>' ELSE '<ANSWER>' || t || '</ANSWER>' END) AS kept_chars, 'a|b' AS skills, md5(CASE WHEN usr THEN '' ELSE plain END) AS prediction FROM c""")
def parse_turns(spark, sf_dir):
    """Turns with tags set around conversation texts, which have none of their own."""
    user = F.col("role") == "user"
    said = F.concat(F.lit("<skill>a | b</skill> "), F.when(user, F.concat(F.lit("<search> "), F.coalesce("text", F.lit("")), F.lit(" </search> tail"))).otherwise(F.concat(F.lit("<ANSWER>"), F.coalesce("text", F.lit("")), F.lit("</ANSWER>"))))
    rows = table(spark, sf_dir, "conversations").withColumn("said", said)
    turn = messages.parse_turn(F.col("said"))
    return rows.withColumn("t", turn).select("conv_id", "turn", "t.action", F.length("t.query").cast("bigint").alias("query_chars"), F.length("t.kept").cast("bigint").alias("kept_chars"), F.array_join(messages.skills(F.col("said")), "|").alias("skills"), F.md5(messages.prediction(F.col("said"), F.col("said")).cast("binary")).alias("prediction"))


_PUNCT = tx.PUNCTUATION.replace("'", "''")
_COLLAPSE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_PACK = f"translate(lower(t), '{tx.PACK_PUNCTUATION.replace(chr(39), chr(39) * 2)}', '{' ' * len(tx.PACK_PUNCTUATION)}')"
# Article removal by tokens: an article stands between non-word characters, with accented letters as word characters.
_ART = r"regexp_replace(regexp_replace({}, '(^|[^\p{{L}}\p{{N}}_])(a|an|the)(?:$|([^\p{{L}}\p{{N}}_]))', '\1 \3', 'g'), '(^|[^\p{{L}}\p{{N}}_])(a|an|the)(?:$|([^\p{{L}}\p{{N}}_]))', '\1 \3', 'g')"


@query(rf"""WITH q AS (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents)
SELECT id, md5({_COLLAPSE.format(_ART.format(f"translate(replace(lower(t), '’', ''''), '{_PUNCT}', '')"))}) AS teacher, md5({_COLLAPSE.format(f"translate({_ART.format('lower(t)')}, '{_PUNCT}', '')")}) AS eval,
  md5({_COLLAPSE.format(_PACK)}) AS pack, CASE WHEN length({_COLLAPSE.format('t')}) > 40 THEN rtrim(substr({_COLLAPSE.format('t')}, 1, 40)) || '...' ELSE {_COLLAPSE.format('t')} END AS compact FROM q""")
def exact_match(spark, sf_dir):
    q = questions(spark, sf_dir)
    h = lambda c: F.md5(c.cast("binary"))
    return q.select("id", h(tx.normalize_answer_teacher("question")).alias("teacher"), h(tx.normalize_answer_eval("question")).alias("eval"), h(tx.normalize_answer_pack("question")).alias("pack"), tx.compact_text("question", 40).alias("compact"))


def _traces(spark, sf_dir):
    def said(s):
        """Most searches are tagged, some in capitals; most answers too, others are plain words."""
        n = F.length(s["retrieved"])
        search = F.when(n % 5 == 0, s["query"]).when(n % 5 == 1, F.concat(F.lit("<SEARCH>"), s["query"], F.lit("</SEARCH>"))).otherwise(F.concat(F.lit("<search>"), s["query"], F.lit("</search>")))
        answer = F.when(F.length(s["draft_answer"]) % 3 == 0, s["draft_answer"]).otherwise(F.concat(F.lit("<answer>"), s["draft_answer"], F.lit("</answer>")))
        return F.when(s["action"] == "search", search).otherwise(answer)

    steps = F.transform("steps", lambda s: F.struct(s["action"].alias("action"), s["support_skills"].alias("selected_skills"), said(s).alias("generated")))
    rows = _steps(spark, sf_dir)
    return rows.select(F.col("conv_id").alias("id"), (F.col("conv_id") % 4).alias("dataset"), (F.length("final_answer") % 2).cast("int").alias("em"), steps.alias("steps"))


_TRACES = f"""{_STEPS}, x AS (SELECT conv_id AS id, conv_id % 4 AS dataset, max(CASE WHEN turn = last AND role <> 'user' THEN length(word) ELSE 0 END) % 2 AS em, count(*) FILTER (role = 'user') AS searches, count(*) AS steps,
  count(DISTINCT length(text) % 7 = 0) AS skills, count(*) FILTER (role = 'user' AND length(text) % 5 <> 0) AS tagged_search, max(CASE WHEN turn = last AND role <> 'user' AND length(word) % 3 <> 0 THEN 1 ELSE 0 END) AS tagged_final FROM s GROUP BY conv_id)"""


@query(f"""WITH {_TRACES} SELECT dataset, count(*) AS n_examples, CAST(sum(em) AS BIGINT) AS n_correct, sum(em) / count(*) AS em, avg(searches) AS avg_search_steps, avg(steps) AS avg_total_steps, avg(skills) AS avg_skills,
  avg(tagged_final) AS tagged_final_turn_rate, CAST(sum(tagged_search) AS DOUBLE) / greatest(sum(searches), 1) AS tagged_search_turn_rate, CAST(count(*) FILTER (em = 1 AND searches <= 3) AS DOUBLE) / count(*) AS correct_within_3 FROM x GROUP BY dataset""")
def eval_metrics(spark, sf_dir):
    return reports.eval_metrics(_traces(spark, sf_dir), "dataset")


@query(f"""WITH {_TRACES}, m AS (SELECT dataset, sum(em) AS c, count(*) AS n FROM x GROUP BY dataset) SELECT avg(c / n) AS macro_em, CAST(sum(c) AS BIGINT) AS n_correct, CAST(sum(n) AS BIGINT) AS n_examples, sum(c) / sum(n) AS pooled_em FROM m""")
def pooled_metrics(spark, sf_dir):
    """Macro and pooled exact match over shards."""
    return reports.macro_and_pooled(reports.eval_metrics(_traces(spark, sf_dir), "dataset"))


@query(f"WITH {_TRACES} SELECT id, dataset, CAST(sum(em) OVER w AS DOUBLE) / count(*) OVER w AS running_em FROM x WINDOW w AS (PARTITION BY dataset ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def running_em(spark, sf_dir):
    return reports.running_em(_traces(spark, sf_dir), "dataset", "id").select("id", "dataset", "running_em")


@query("SELECT count(*) AS n, count(*) FILTER (quality = 0 AND toxic = 1) AS newly_correct, count(*) FILTER (quality = 1 AND toxic = 0) AS newly_wrong FROM labels")
def run_flips(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    return reports.flips(rows.select("doc_id", F.col("quality").alias("em")), rows.select("doc_id", F.col("toxic").alias("em")), "doc_id")


@query("SELECT event_type, count(*) AS processed, count(*) FILTER (value > 20) AS passed, count(*) FILTER (NOT value > 20) AS failed, count(*) FILTER (props IS NULL) AS runtime_errors FROM events GROUP BY event_type")
def outcome_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("value") > 20).alias("passed"), F.col("props").isNull().alias("runtime_error"))
    return reports.outcome_counts(rows, "event_type")


_MARKS = {"comparison": (routing.COMPARISON, 5), "yes_no": (routing.YES_NO, 4), "anchor": (routing.TEMPORAL_ANCHOR, 4), "super": (routing.SUPERLATIVE, 3), "kin": (routing.KINSHIP, 3), "choice": (routing.FORCED_CHOICE, 2), "chain": (routing.RELATION_CHAIN, 2)}


@query(f"""WITH {_STEPS}, k AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, {_COLLAPSE.format(_PACK.replace('lower(t)', 'lower(word)'))} AS norm,
  CASE WHEN role = 'user' THEN 'bridge-entity-search' WHEN turn % 4 = 1 THEN 'conflict-check' ELSE 'single-entity-relation-lookup' END AS skill FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
l AS (SELECT *, coalesce(role <> 'user' AND lag(role) OVER w <> 'user' AND norm <> '' AND norm = lag(norm) OVER w AND skill = 'conflict-check', false) AS repeats FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
g AS (SELECT conv_id, max(n) AS n, max(CASE WHEN i = n THEN skill END) AS last_skill, max(CASE WHEN i = 1 THEN skill END) AS first_skill, max(CASE WHEN i = 1 AND role = 'user' THEN text ELSE '' END) AS said, max(i) FILTER (NOT repeats) AS kept FROM l GROUP BY conv_id),
h AS (SELECT *, {unicode_low('said')} AS low FROM g),
m AS (SELECT *, {_HOPS} AS hops, {', '.join(f'{_m(p)} AS is_{x}' for x, (p, _) in _MARKS.items())} FROM h)
SELECT conv_id, CAST(100 + CASE WHEN n IN (4, 5) THEN 18 WHEN n IN (3, 6) THEN 12 WHEN n = 7 THEN 4 ELSE -4 END + CASE WHEN last_skill <> 'conflict-check' THEN 8 ELSE 0 END + CASE WHEN hops >= 3 THEN 6 ELSE 0 END
    + {' + '.join(f'{points} * CAST(is_{x} AS INTEGER)' for x, (_, points) in _MARKS.items())} AS INTEGER) AS score,
  CAST(1 + CAST(is_comparison OR is_yes_no OR is_anchor OR is_choice OR is_chain OR hops >= 3 AS INTEGER) + CAST(first_skill = 'bridge-entity-search' AS INTEGER) AS INTEGER) AS copies, CAST(kept AS INTEGER) AS kept_steps FROM m""")
def quality_scores(spark, sf_dir):
    """Scores, copies and tags of trajectories."""
    rows = _steps(spark, sf_dir)
    first = F.coalesce(F.try_element_at("steps", F.lit(1))["primary_skill"], F.lit(""))
    q = F.coalesce(F.try_element_at("steps", F.lit(1))["retrieved"], F.lit(""))
    meta = routing.metadata_summary(q, F.lit("hotpotqa"), F.lit("bridge"), routing.estimated_hops(q, F.lit(0), F.lit(0)))
    full = rows.withColumn("meta", meta)
    return full.select("conv_id", messages.quality_score(F.col("steps"), F.col("meta"), F.lit("train"), F.lit(False)).alias("score"), messages.repeat_factor(F.lit("hotpotqa"), first, F.col("meta"), F.lit("train")).alias("copies"), F.size(merge.cleaned_steps(F.col("steps"))).alias("kept_steps"))


@query()
def rollout(spark, sf_dir):
    """The offline policy over every benchmark item."""
    return external.rollout(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question")))


_NESTED = """{"a": ' || props || ', "s": "a } and { or \\" here"}"""


@query(f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '{_NESTED}' WHEN 3 THEN props END AS object FROM events")
def json_recovery(spark, sf_dir):
    """Objects between words, in fences and with braces inside strings; none where the first brace stays open."""
    props, kind = F.col("props"), F.col("event_id") % 4
    nested = F.concat(F.lit('{"a": '), props, F.lit(', "s": "a } and { or \\" here"}'))
    said = F.when(kind == 0, F.concat(F.lit("Here: "), props, F.lit(" and a tail }"))).when(kind == 1, F.concat(F.lit("```json\n"), nested, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("noise { "), props, F.lit(" tail"))).otherwise(props)
    return table(spark, sf_dir, "events").select("event_id", external.first_object(said).alias("object"))


@query("SELECT doc_id AS id, source, n_chars, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def strict_join(spark, sf_dir):
    """Light profiles with their full rows, each checked; the full side holds the labels."""
    docs = table(spark, sf_dir, "documents")
    light = docs.select(F.col("doc_id").alias("id"), "source", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("question"))
    full = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").select(F.col("doc_id").alias("id"), "n_chars", "quality", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("question"))
    joined = merge.join_strictly(light, full)
    return joined.select("light.id", "light.source", "full.n_chars", F.coalesce("full.quality", F.lit(-1)).alias("quality"))


@query("SELECT event_type, count(*) AS processed, count(*) FILTER (value > 20) AS passed, count(*) FILTER (NOT value > 20) AS failed FROM events GROUP BY event_type")
def stream_summary(spark, sf_dir):
    """The events folder read as a stream, one row per id within the watermark, summed up."""
    from tessera.streaming.queries import summarise_events

    return summarise_events(spark, sf_dir)

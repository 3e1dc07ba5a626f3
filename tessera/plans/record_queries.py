"""Queries of profiles as whole records, trajectories' quality, packed texts and joins of records, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import profile, routing, text as tx
from tessera.operators import coverage, merge, messages, packets, sampling
from tessera.session import table

from .bindings import SQL_GROUPS, SQL_PROFILES, _sql_flags, annotated_groups, profiles, sql_form, sql_words, unicode_low
from .trace_queries import _ART, _COLLAPSE, _PUNCT

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _strip(value: str) -> str:
    return rf"regexp_replace({value}, '^\s+|\s+$', '', 'g')"


# Profiles: a capitalised span begins with A-Z and goes on with letters and digits of any script.
_SPAN = profile.SPAN.replace(r"\w", r"\p{L}\p{M}\p{N}_").replace("'", "''")
_WH = " ".join(f"WHEN starts_with(low, '{w} ') THEN '{w}'" for w in profile.WH_WORDS)
_SUPPORTED = "list_distinct(string_split(t, ' ')[1:length(t) % 4])"


def _profile_sql(single: bool, dataset: str, more: str = "") -> str:
    """Common table expressions up to s: the profile of every document, with signature."""
    a, b, c = (6, 10, 16) if single else (8, 14, 22)
    keys = {"dataset": "dataset", "entity_bin": "entity_bin", "token_bin": "token_bin", "wh_word": "wh_word"} | ({"answer_form_hint": "form"} if single else {"native_type": "native_type"})
    shown = {k: f"'\"' || {v} || '\"'" for k, v in keys.items()} | {"flags": "'[' || array_to_string(list_transform(flags[1:6], lambda f: '\"' || f || '\"'), ', ') || ']'"} | ({} if single else {"hop_count": "hop_count"})
    signature = " || ', ' || ".join(f"'\"{k}\": ' || {shown[k]}" for k in sorted(shown))
    return f"""d AS (SELECT doc_id, lang, source, n_chars, coalesce(text, '') AS t FROM documents),
q AS (SELECT CAST(doc_id AS VARCHAR) AS id, {dataset} AS dataset, {_strip('t')} AS question, lower({_strip('t')}) AS low, {_strip("string_split(t, ' ')[1]")} AS answer{more} FROM d),
e AS (SELECT *, CAST({sql_words('question')} AS BIGINT) AS words, CAST(len(list_distinct(list_filter(regexp_extract_all(question, '{_SPAN}'), lambda x: length(x) > 1))) AS BIGINT) AS entity_count FROM q),
f AS (SELECT *, CASE {_WH} ELSE 'other' END AS wh_word, {sql_form('answer', 4 if single else 3)} AS form, {_sql_flags(single)} AS flags,
  CASE WHEN entity_count <= 1 THEN 'single_entity' WHEN entity_count = 2 THEN 'two_entities' WHEN entity_count <= 4 THEN 'multi_entity' ELSE 'dense_entity' END AS entity_bin,
  CASE WHEN words <= {a} THEN 'short' WHEN words <= {b} THEN 'medium' WHEN words <= {c} THEN 'long' ELSE 'very_long' END AS token_bin FROM e),
s AS (SELECT *, '{{' || {signature} || '}}' AS signature FROM f)"""


def _labels_sql(parts: dict[str, str]) -> str:
    own = ", ".join(f"'{n}:' || {c}" for n, c in parts.items())
    return f"array_to_string(list_sort(list_distinct(list_concat([{own}], list_transform(flags, lambda x: 'flag:' || x)))), '|')"


_SHOWN = ["id", "dataset", "wh_word", "answer_form_hint", "entity_count", "entity_bin", "token_bin"]


@query(f"""WITH {_profile_sql(True, "CASE WHEN doc_id % 3 = 0 THEN 'nq' ELSE 'triviaqa' END")}
SELECT id, dataset, wh_word, form AS answer_form_hint, entity_count, entity_bin, token_bin, array_to_string(flags, '|') AS flags, md5(signature) AS signature, {_labels_sql({'wh': 'wh_word', 'answer': 'form', 'entity': 'entity_bin', 'token': 'token_bin'})} AS labels,
  id IN (SELECT CAST(item_id AS VARCHAR) FROM benchmark) AS is_eval_overlap FROM s""")
def singlehop_profiles(spark, sf_dir):
    """The flat profile, letters of any script in entity spans."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, "nq").otherwise("triviaqa").alias("dataset"), F.col("text").alias("question"), F.array(F.split("text", " ")[0]).alias("golden_answers"))
    made = profile.light_single(rows, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id")))
    return made.select(*_SHOWN, F.array_join("flags", "|").alias("flags"), F.md5(F.col("signature").cast("binary")).alias("signature"), F.array_join(profile.single_labels(), "|").alias("labels"), "is_eval_overlap")


_TITLED = "dataset <> 'musique'"


@query(f"""WITH {_profile_sql(False, "['hotpotqa', '2wiki', 'musique'][doc_id % 3 + 1]", f''',
  CASE WHEN doc_id % 3 < 2 THEN CASE lang WHEN 'de' THEN 'comparison' WHEN 'fr' THEN 'unknown' ELSE 'bridge' END ELSE 'decomp_' || len(string_split(t, ' ')[1:length(t) % 5]) END AS native_type,
  CASE WHEN doc_id % 3 < 2 THEN CASE WHEN len({_SUPPORTED}) > 0 THEN len({_SUPPORTED}) ELSE 2 END ELSE greatest(len(string_split(t, ' ')[1:length(t) % 5]), 1) END AS hop_count,
  CASE WHEN doc_id % 3 < 2 THEN len({_SUPPORTED}) END AS supporting_title_count, CASE WHEN doc_id % 3 < 2 THEN len(string_split(t, ' ')[1:length(t) % 7]) END AS context_title_count,
  CASE WHEN doc_id % 3 = 0 THEN CASE WHEN lang = 'en' THEN 'hard' ELSE 'unknown' END END AS level, CASE WHEN doc_id % 3 = 2 THEN coalesce(CASE WHEN lang = 'en' THEN false WHEN lang = 'de' THEN true END, true) END AS answerable''')}
SELECT id, dataset, wh_word, form AS answer_form_hint, entity_count, entity_bin, token_bin, array_to_string(flags, '|') AS flags, md5(signature) AS signature,
  {_labels_sql({'native': 'native_type', 'hop': 'hop_count', 'entity': 'entity_bin', 'wh': 'wh_word'})} AS labels, native_type, CAST(hop_count AS BIGINT) AS hop_count, level,
  CAST(supporting_title_count AS BIGINT) AS supporting_title_count, CAST(context_title_count AS BIGINT) AS context_title_count, answerable FROM s""")
def multihop_profiles(spark, sf_dir):
    """Documents as questions of the three multi-hop data sets in turn, metadata taken from their words."""
    docs = table(spark, sf_dir, "documents").withColumn("t", F.coalesce("text", F.lit("")))
    words, n, lang = F.split("t", " "), F.length("t"), F.col("lang")
    part = lambda k: F.slice(words, F.lit(1), (n % k).cast("int"))
    metadata = F.struct(
        F.when(lang == "de", "comparison").when(lang != "fr", "bridge").alias("type"), F.when(lang == "en", "hard").alias("level"), F.struct(part(4).alias("title")).alias("supporting_facts"),
        F.struct(part(7).alias("title")).alias("context"), part(5).alias("question_decomposition"), F.when(lang == "en", False).when(lang == "de", True).alias("answerable"),
    )
    name = F.element_at(F.array(*[F.lit(x) for x in messages.MULTI_SETS]), (F.col("doc_id") % 3 + 1).cast("int"))
    made = profile.light_multi(docs.select(F.col("doc_id").alias("id"), name.alias("dataset"), F.col("text").alias("question"), F.array(words[0]).alias("golden_answers"), metadata.alias("metadata")))
    own = F.col("native_summary")
    return made.select(
        *_SHOWN, F.array_join("flags", "|").alias("flags"), F.md5(F.col("signature").cast("binary")).alias("signature"), F.array_join(profile.prune_labels(), "|").alias("labels"), "native_type", F.col("hop_count").cast("bigint").alias("hop_count"),
        own["level"].alias("level"), own["supporting_title_count"].cast("bigint").alias("supporting_title_count"), own["context_title_count"].cast("bigint").alias("context_title_count"), own["answerable"].alias("answerable"),
    )


def trajectories(spark, sf_dir):
    """Conversations as trajectories with faults of every kind, by the lengths of their texts."""
    said = F.coalesce("text", F.lit(""))
    n, word, user = F.length(said), F.split(said, " ")[0], F.col("role") == "user"
    step = F.struct(
        "turn", F.when(user, F.when(n % 5 == 0, "verify").otherwise("search")).otherwise("answer").alias("action"),
        F.when(user, F.when(n % 3 == 0, "conflict-check").otherwise("bridge-entity-search")).otherwise("single-entity-relation-lookup").alias("primary_skill"),
        F.array(F.when(n % 7 == 0, "made-up-skill").otherwise("conflict-check")).alias("support_skills"), F.when(user, word).otherwise("").alias("query"), F.when(user, "").otherwise(word).alias("draft_answer"), F.when(user, said).otherwise("").alias("retrieved"),
    )
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    return rows.withColumn("final_answer", F.coalesce(merge.last_step(F.col("steps"))["draft_answer"], F.lit(""))).withColumn("gold", F.when(F.col("conv_id") % 2 == 0, F.array("final_answer")).otherwise(F.array(F.lit("zzz"))))


CANDIDATES = ("bridge-entity-search", "single-entity-relation-lookup")
_TEACHER = _COLLAPSE.format(_ART.format(f"translate(replace(lower(final_answer), '’', ''''), '{_PUNCT}', '')"))

#: v: a row per conversation with the terms of its validation.
_VALID = f"""s AS (SELECT conv_id, turn, role = 'user' AS usr, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, string_split(coalesce(text, ''), ' ')[1] AS word, row_number() OVER w - 1 AS i FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT conv_id, arg_max(CASE WHEN usr THEN '' ELSE word END, i) AS final_answer, bool_or(usr) AS has_search, CASE WHEN bool_or(n % 7 = 0) THEN 'made-up-skill' ELSE '' END AS unknown_skills,
  coalesce(string_agg(CASE WHEN usr AND n % 3 = 0 THEN CAST(i AS VARCHAR) END, '|' ORDER BY i), '') AS wrong_steps, bool_or(i = 0 AND NOT (usr AND n % 3 = 0)) AS route, count(*) AS n_steps,
  count(*) FILTER (usr AND trim(t) <> '') AS retrieved FROM s GROUP BY conv_id),
h AS (SELECT *, {_TEACHER} AS norm FROM g),
v AS (SELECT *, norm <> '' AND (conv_id % 2 = 0 OR norm = 'zzz') AS em FROM h)"""


def _validation(rows):
    legal = F.array(*[F.lit(s) for s in (*CANDIDATES, *routing.SUPPORT_ONLY)])
    return merge.validation(F.col("steps"), F.col("final_answer"), F.col("gold"), F.array(*[F.lit(c) for c in CANDIDATES]), legal)


@query(f"WITH {_VALID} SELECT conv_id, em, has_search, unknown_skills, wrong_steps, route, em AND has_search AND unknown_skills = '' AND wrong_steps = '' AS passed FROM v")
def validation_terms(spark, sf_dir):
    """Every term of a trajectory's validation."""
    rows = trajectories(spark, sf_dir)
    v = rows.withColumn("v", _validation(rows))
    return v.select("conv_id", F.col("v.em").alias("em"), F.col("v.has_search").alias("has_search"), F.array_join("v.unknown_skills", "|").alias("unknown_skills"), F.array_join(F.transform("v.support_only_primary_steps", lambda x: x.cast("string")), "|").alias("wrong_steps"), F.col("v.route_matches_candidates").alias("route"), F.col("v.passed").alias("passed"))


#: o: conversations as runs of three sources, with the tuple that ranks them.
_RANKED = f"""{_VALID}, o AS (SELECT conv_id // 3 AS id, conv_id % 3 AS p, 's' || conv_id % 3 AS source,
  [CAST(em AND has_search AND unknown_skills = '' AND wrong_steps = '' AS BIGINT), 1 - CAST(n_steps % 4 = 0 AS BIGINT), CAST({_strip('final_answer')} <> '' AS BIGINT), CAST(n_steps > 0 AS BIGINT), CAST(unknown_skills = '' AS BIGINT), CAST(wrong_steps = '' AS BIGINT),
   CAST(route AS BIGINT), -(conv_id % 3), retrieved, n_steps, n_steps - n_steps % 2] AS q FROM v)"""


def _runs(spark, sf_dir):
    rows = trajectories(spark, sf_dir)
    v = rows.withColumn("v", _validation(rows).withField("runtime_error", F.size("steps") % 4 == 0))
    runs = v.withColumn("id", F.floor(F.col("conv_id") / 3)).withColumn("source_priority", F.col("conv_id") % 3).withColumn("source", F.concat(F.lit("s"), (F.col("conv_id") % 3).cast("string")))
    outputs = F.slice("steps", F.lit(1), F.size("steps") - F.size("steps") % 2)
    return merge.merge_canonical(runs, merge.quality_terms(F.col("v"), F.col("steps"), F.col("final_answer"), outputs, F.col("source_priority")), ("id",))


@query(f"WITH {_RANKED} SELECT id, source, q[1] = 1 AS passed FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY q DESC) AS k FROM o) WHERE k = 1")
def canonical_best(spark, sf_dir):
    """M3: of several sources' trajectories the best, by all terms of their quality."""
    return _runs(spark, sf_dir)[0].select("id", "source", F.col("v.passed").alias("passed"))


@query(f"""WITH {_RANKED}, j AS (SELECT x.*, (SELECT struct_pack(q := y.q, s := y.source) FROM o y WHERE y.id = x.id AND y.p < x.p ORDER BY y.q DESC LIMIT 1) AS h FROM o x)
SELECT id, CASE WHEN q > h.q THEN source ELSE h.s END AS kept, CASE WHEN q > h.q THEN h.s ELSE source END AS replaced FROM j WHERE h IS NOT NULL""")
def canonical_log(spark, sf_dir):
    """Each decision between a trajectory and the best of the sources before."""
    return _runs(spark, sf_dir)[1].select("id", "kept", "replaced")


def _told(said):
    """One digest of messages, their roles and whole contents."""
    return F.md5(F.array_join(F.transform(said, lambda m: F.concat(m["role"], F.lit("|"), m["content"])), "\n").cast("binary"))


def _json(value: str) -> str:
    for plain, shown in (("'\\'", "'\\\\'"), ("'\"'", "'\\\"'"), ("chr(10)", "'\\n'"), ("chr(9)", "'\\t'"), ("chr(13)", "'\\r'")):
        value = f"replace({value}, {plain}, {shown})"
    return f"'\"' || {value} || '\"'"


_PRIMARY = "CASE WHEN usr THEN CASE WHEN n % 3 = 0 THEN 'conflict-check' ELSE 'bridge-entity-search' END ELSE 'single-entity-relation-lookup' END"
_ACTION = "CASE WHEN usr THEN CASE WHEN n % 5 = 0 THEN 'verify' ELSE 'search' END ELSE 'answer' END"
_SUPPORT = "CASE WHEN n % 7 = 0 THEN 'made-up-skill' ELSE 'conflict-check' END"
_BACK = f"CASE WHEN usr AND {_strip('t')} <> '' THEN chr(10) || 'user|Retriever results:' || chr(10) || substr({_strip('t')}, 1, {{}}) || chr(10) || '{messages.NEXT_ACTION}' ELSE '' END"


@query(f"""WITH {_VALID} SELECT conv_id, count(*) + count(*) FILTER (usr AND {_strip('t')} <> '') + 1 AS n_messages,
  md5('user|Question: who?' || chr(10) || 'Dataset: set' || conv_id % 4 || chr(10) || 'Estimated hops: ' || CASE WHEN conv_id % 3 = 0 THEN 'unknown' ELSE CAST(conv_id % 3 AS VARCHAR) END || chr(10) || 'Candidate primary skills: {", ".join(CANDIDATES)}' || chr(10) || '{messages.NEXT_ACTION}' || chr(10)
  || string_agg('assistant|{{"primary_skill": "' || {_PRIMARY} || '", "support_skills": ["' || {_SUPPORT} || '"], "action": "' || {_ACTION} || '", "query": ' || {_json("CASE WHEN usr THEN word ELSE '' END")} || ', "checkpoint": {{}}, "draft_answer": ' || {_json("CASE WHEN usr THEN '' ELSE word END")} || '}}' || {_BACK.format(4000)}, chr(10) ORDER BY i)) AS packed FROM s GROUP BY conv_id""")
def json_messages(spark, sf_dir):
    """Trajectories as JSON actions, whole texts."""
    hops = F.when(F.col("conv_id") % 3 != 0, F.col("conv_id") % 3)
    candidates = F.array(*[F.lit(c) for c in (*CANDIDATES, " ", CANDIDATES[0])])
    packed = messages.pack_json(F.lit(" who? "), F.concat(F.lit("set"), (F.col("conv_id") % 4).cast("string")), hops, candidates, F.col("steps"))
    return trajectories(spark, sf_dir).withColumn("m", packed).select("conv_id", F.size("m").cast("bigint").alias("n_messages"), _told(F.col("m")).alias("packed"))


@query(f"""WITH {_VALID} SELECT conv_id, md5('user|Question: who?' || chr(10) || 'Dataset: ' || chr(10) || 'Candidate primary skills: {", ".join(CANDIDATES)}' || chr(10) || '{messages.NEXT_ACTION}' || chr(10)
  || string_agg('assistant|{{' || chr(10) || '  "primary_skill": "' || {_PRIMARY} || '",' || chr(10) || '  "support_skills": [''' || {_SUPPORT} || '''],' || chr(10) || '  "action": "' || {_ACTION} || '",' || chr(10)
    || '  "query": "' || CASE WHEN usr THEN word ELSE '' END || '",' || chr(10) || '  "draft_answer": "' || CASE WHEN usr THEN '' ELSE word END || '"' || chr(10) || '}}' || {_BACK.format(50)}, chr(10) ORDER BY i)) AS packed FROM s GROUP BY conv_id""")
def simple_messages(spark, sf_dir):
    """Trajectories in the loose notation, whole texts."""
    packed = messages.pack_simple(F.lit("who?\n"), F.lit(None).cast("string"), F.array(*[F.lit(c) for c in CANDIDATES]), F.col("steps"), 50)
    return trajectories(spark, sf_dir).withColumn("m", packed).select("conv_id", _told(F.col("m")).alias("packed"))


_CARDS = f"{packets.CARDS_HEAD}\n<skill_card id=\"conflict-check\">\na card of ten...\n</skill_card>\n\n{messages.ACT.format('conflict-check')}".replace("\n", "' || chr(10) || '")


@query(f"""WITH c AS (SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN '<skill>conflict-check</skill>' || chr(10) || coalesce(text, '') ELSE 'Recommended skills: x' || chr(10) || coalesce(text, '') END AS said, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE role IS DISTINCT FROM 'system'),
p AS (SELECT conv_id, bool_and(CASE WHEN role = 'assistant' THEN before IS NOT DISTINCT FROM 'user' ELSE role IS NOT DISTINCT FROM 'user' END) AND bool_or(role IS NOT DISTINCT FROM 'assistant') AS good,
  md5('system|be brief' || chr(10) || string_agg(CASE WHEN role = 'assistant' THEN 'assistant|<select_skill>conflict-check</select_skill>' || chr(10) || 'user|{_CARDS}' || chr(10) || 'assistant|' || {_strip('said')}
    ELSE 'user|' || {_strip(f"{_strip(chr(34) + 'rest' + chr(34))} || chr(10) || chr(10) || 'the index' || chr(10) || chr(10) || '{messages.CHOOSE}'")} END, chr(10) ORDER BY turn)) AS packed
  FROM (SELECT *, regexp_replace(substr(said, 23), '\\r\\n|\\r', chr(10), 'g') AS rest FROM c) GROUP BY conv_id)
SELECT conv_id, CASE WHEN good THEN packed END AS packed FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN p USING (conv_id)""")
def two_phase_text(spark, sf_dir):
    """The two-phase form, whole texts; a line that it replaces stands before each user's text."""
    said = F.coalesce("text", F.lit(""))
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("role") == "assistant", F.concat(F.lit("<skill>conflict-check</skill>\n"), said)).otherwise(F.concat(F.lit("Recommended skills: x\n"), said)))
    rows = messages.ordered_messages(turns).withColumnRenamed("conv_id", "id")
    packed = messages.repack_two_phase(rows, F.create_map(F.lit("conflict-check"), F.lit("a card  of\nten words")), F.lit("the index"), "be brief", 13)
    return packed.select(F.col("id").alias("conv_id"), _told(F.col("packed")).alias("packed"))


@query(f"""WITH p AS (SELECT 'bank-' || (p_partkey % 5) AS doc, 'skill-' || p_size AS skill_id, arg_max(p_name || ' ' || p_type, p_partkey) AS text, min(p_partkey) AS ord FROM part GROUP BY ALL),
c AS (SELECT *, {_COLLAPSE.format('text')} AS whole FROM p)
SELECT doc, md5('{packets.INDEX_HEAD}' || chr(10) || string_agg('- ' || skill_id || ': ' || CASE WHEN length(whole) > 12 THEN rtrim(substr(whole, 1, 12)) || '...' ELSE whole END, chr(10) ORDER BY ord)) AS index_md5 FROM c GROUP BY doc""")
def bank_index(spark, sf_dir):
    """The index of each bank, whole texts."""
    part = table(spark, sf_dir, "part").withColumn("doc", F.concat(F.lit("bank-"), (F.col("p_partkey") % 5).cast("string")))
    head = F.struct((F.col("p_partkey") * 2).alias("line_no"), F.concat(F.lit("`skill-"), F.col("p_size").cast("string"), F.lit("`")).alias("value"))
    body = F.struct((F.col("p_partkey") * 2 + 1).alias("line_no"), F.concat("p_name", F.lit(" "), "p_type").alias("value"))
    bank = packets.parse_bank(part.select("doc", F.explode(F.array(head, body)).alias("l")).select("doc", "l.*"))
    return packets.skill_index(bank, 12).select("doc", F.md5(F.col("index_text").cast("binary")).alias("index_md5"))


@query("""SELECT d.doc_id AS id, d.source, d.lang AS role, l.turn, l.chars FROM documents d
LEFT JOIN (SELECT conv_id, max(turn) AS turn, arg_max(length(coalesce(text, '')), turn) AS chars FROM conversations GROUP BY conv_id) l ON l.conv_id = d.doc_id""")
def joined_profiles(spark, sf_dir):
    """Full rows with what the last light row of their key adds; both have ``role``, the full row's counts."""
    full = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.col("lang").alias("role"))
    light = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "role", "turn", F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("chars"))
    return merge.join_profiles(full, light, "id", F.col("turn"))


@query("SELECT doc_id AS id, source FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(quality = 1 AND toxic = 0, true)")
def reviewed_rows(spark, sf_dir):
    """Rows without a review pass."""
    reviews = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("keep"))
    return coverage.reviewed(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source"), reviews, "id")


@query(f"WITH {SQL_GROUPS} SELECT group_id, CASE WHEN size % 2 = 0 THEN 'reviewed' ELSE entity_pattern END AS entity_pattern, CASE WHEN size % 4 = 0 THEN 'hard' WHEN hop_count >= 4 THEN 'hard' ELSE 'medium' END AS difficulty FROM y")
def answered_groups(spark, sf_dir):
    """A model's answers override what the rules say of a group, where they say something."""
    groups = annotated_groups(spark, sf_dir)[1]
    answers = groups.where("size % 2 = 0").select("group_id", F.lit("reviewed").alias("entity_pattern"), F.when(F.col("size") % 4 == 0, "hard").alias("difficulty"))
    return coverage.with_answers(groups.select("group_id", "entity_pattern", "difficulty"), answers, "group_id", ["entity_pattern", "difficulty"])


_REVIEW_FLAGS = ("multi_entity", "relation_chain", "same_attribute", "yes_no", "temporal", "numeric", "dense_entities", "comparison")
_STAGES = [f"CASE WHEN row_number() OVER (PARTITION BY {c} ORDER BY size DESC, group_id) <= 8 THEN {k} END" for k, c in enumerate(("native_type", "hop_count", "entity_bin"))]
_STAGES += [f"CASE WHEN list_contains(f, '{x}') AND row_number() OVER (PARTITION BY list_contains(f, '{x}') ORDER BY size DESC, group_id) <= 10 THEN {k} END" for k, x in enumerate(_REVIEW_FLAGS, 3)]


@query(f"""WITH {SQL_GROUPS}, st AS (SELECT *, least({', '.join(_STAGES)}, 11) AS stage FROM y),
ld AS (SELECT *, CASE stage WHEN 0 THEN min([-size, place_]) OVER (PARTITION BY native_type) WHEN 1 THEN min([-size, place_]) OVER (PARTITION BY hop_count) WHEN 2 THEN min([-size, place_]) OVER (PARTITION BY entity_bin) END AS bucket
  FROM (SELECT *, row_number() OVER (ORDER BY group_id) AS place_ FROM st)),
rk AS (SELECT *, row_number() OVER (ORDER BY stage, bucket NULLS FIRST, CASE WHEN stage = 11 THEN coverage_priority * 10 + log2(size + 1) ELSE size END DESC, group_id) AS pick FROM ld)
SELECT group_id, stage FROM rk WHERE pick <= 60""")
def review_budget(spark, sf_dir):
    """The groups that a costly review of 60 looks at, in stages."""
    return coverage.budget_pick(annotated_groups(spark, sf_dir)[1], 60).select("group_id", F.col("stage").cast("int").alias("stage"))


_AGAIN = rf"""r AS (SELECT doc_id AS id, c AS copy, lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS q, CAST(l.quality AS VARCHAR) AS a FROM documents d JOIN labels l USING (doc_id) JOIN (SELECT unnest([0, 1]) AS c) ON c = 0 OR doc_id % 5 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY id, copy) > 1 AS again FROM r),
o AS (SELECT *, min(a) OVER (PARTITION BY q, again) <> max(a) OVER (PARTITION BY q, again) AS differ, row_number() OVER (PARTITION BY q, again ORDER BY id, copy) AS k FROM n),
t AS (SELECT id, copy, CASE WHEN again THEN 'duplicate_id' WHEN differ THEN 'conflicting' WHEN k > 1 THEN 'duplicate' ELSE 'kept' END AS status FROM o)"""


def _repeated(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    twice = docs.withColumn("copy", F.explode(F.when(F.col("doc_id") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    rows = twice.select(F.col("doc_id").alias("id"), "copy", F.md5(tx.normalize_question("text").cast("binary")).alias("q"), F.col("quality").cast("string").alias("a"))
    return sampling.dedup_conflicts(rows, F.col("q"), F.col("a"), [F.col("id"), F.col("copy")], "id")


@query(f"WITH {_AGAIN} SELECT * FROM t")
def conflict_status(spark, sf_dir):
    """W13 with the step on ids: what becomes of each row."""
    return _repeated(spark, sf_dir).select("id", "copy", "status")


@query(f"""WITH {_AGAIN} SELECT count(*) FILTER (status = 'duplicate_id') AS dropped_duplicate_id, count(*) FILTER (status = 'duplicate') AS dropped_duplicate_question,
  count(*) FILTER (status = 'conflicting') AS dropped_conflicting_question, count(*) FILTER (status = 'quality') AS dropped_quality FROM t""")
def conflict_drops(spark, sf_dir):
    """A12 from the statuses of W13."""
    return sampling.drop_counts(_repeated(spark, sf_dir))


def _re(pattern: str) -> str:
    return f"regexp_matches(low, '{pattern.replace(chr(39), chr(39) * 2)}')"


_MARKS = {
    "is_yes_no": routing.YES_NO, "has_alias_cue": routing.ALIAS, "has_superlative": routing.SUPERLATIVE, "has_kinship": routing.KINSHIP,
    "has_forced_choice": routing.FORCED_CHOICE, "has_comparison": routing.COMPARISON, "has_temporal_anchor": routing.TEMPORAL_ANCHOR, "looks_relation_chain": routing.RELATION_CHAIN,
}
_OWN_BUDGET = "CASE WHEN doc_id % 4 = 0 THEN doc_id % 9 END"


@query(f"""WITH q AS (SELECT *, ['nq', 'popqa', 'hotpotqa', ''][doc_id % 4 + 1] AS dataset, {unicode_low('text')} AS low, lower(coalesce(text, '')) AS plain, {sql_words("coalesce(text, '')")} AS words, len(regexp_extract_all({unicode_low('text')}, '{routing.HOP_CONNECTOR}')) AS links FROM documents)
SELECT doc_id AS id, CASE WHEN dataset IN ('nq', 'triviaqa') THEN 'singlehop' ELSE 'multihop' END AS task_family,
  CAST(CASE WHEN doc_id % 5 > 2 THEN doc_id % 5 WHEN doc_id % 7 > 3 THEN doc_id % 7 WHEN links >= 3 THEN 4 WHEN links = 2 THEN 3 WHEN links = 1 THEN 2 ELSE 1 END AS INTEGER) AS estimated_hops,
  coalesce(CASE WHEN lang <> 'de' THEN lang END, 'unknown') AS question_type, CASE WHEN doc_id % 2 = 0 THEN 'hard' END AS level, CASE WHEN doc_id % 3 = 0 THEN 'numeric|temporal' ELSE '' END AS flags, source AS wh_word, NULL::VARCHAR AS entity_bin, 'long' AS token_bin,
  {", ".join(f"{_re(p)} AS {n}" for n, p in _MARKS.items())}, 'generic_route_error' AS failure_error_tag,
  CAST(CASE WHEN coalesce({_OWN_BUDGET}, 0) <> 0 THEN least(5, greatest(1, {_OWN_BUDGET})) WHEN dataset IN ('nq', 'popqa') THEN CASE WHEN words <= 12 THEN 2 ELSE 3 END
    ELSE least(5, 3 + CAST({" OR ".join(f"contains(plain, '{c}')" for c in ('same', 'both', 'older', 'younger', 'earlier', 'later', ' or '))} AS INTEGER) + CAST(words >= 18 AS INTEGER)) END AS INTEGER) AS search_budget,
  CASE WHEN dataset = '' THEN 'unknown' ELSE dataset END AS data_source FROM q""")
def metadata_rows(spark, sf_dir):
    """All keys of the metadata summary, hops from each of their sources, budgets by all rules."""
    docs = table(spark, sf_dir, "documents")
    key, text = F.col("doc_id"), F.col("text")
    name = F.element_at(F.array(*[F.lit(x) for x in ("nq", "popqa", "hotpotqa", "")]), (key % 4 + 1).cast("int"))
    hops = routing.estimated_hops(text, F.when(key % 5 > 2, key % 5), F.when(key % 7 > 3, key % 7))
    flags = F.when(key % 3 == 0, F.array(F.lit("numeric"), F.lit("temporal")))
    meta = routing.metadata_summary(text, name, F.when(F.col("lang") != "de", F.col("lang")), hops, F.when(key % 2 == 0, "hard"), flags, F.col("source"), None, F.lit("long"), F.lit("generic_route_error"))
    budget = routing.search_budget(text, name, F.when(key % 4 == 0, (key % 9).cast("int")))
    return docs.select(key.alias("id"), meta.alias("m"), budget.alias("search_budget"), routing.dataset_name(name).alias("data_source")).select("id", "m.*", "search_budget", "data_source").withColumn("flags", F.array_join("flags", "|"))


# The predicates as each round states them, over a group's type, flags, entities, length, hops, question word and form.
_MANY, _LONG, _DATED = "e IN ('multi_entity', 'dense_entity')", "t IN ('long', 'very_long')", "has(f, ['temporal', 'numeric', 'time_anchor'])"
_COMPARE, _CHECK, _CHECKED = "(n = 'comparison' OR has(f, ['comparison']))", "has(f, ['yes_no', 'verification'])", f"has(f, ['verification', 'dense_entities']) AND e IN ('multi_entity', 'dense_entity')"
_ROUNDS = {
    1: {
        "direct": "has(f, ['direct_lookup'])", "alias": "has(f, ['alias'])", "temporal": "has(f, ['temporal']) OR w = 'when'", "numeric": "has(f, ['numeric']) OR form = 'number' OR w = 'how'", "location": "has(f, ['location']) OR w = 'where'",
        "person": "has(f, ['person']) OR w IN ('who', 'whose')", "organization": "has(f, ['organization'])", "yes_no": "has(f, ['yes_no']) OR w IN ('is', 'are', 'was', 'were', 'do', 'does', 'did', 'can', 'could', 'has', 'have', 'had')",
        "long_wording": "e <> 'single_entity' OR t = 'long'", "quoted_or_list": "has(f, ['quoted_span']) OR form IN ('long_span', 'list_like')",
    },
    2: {
        "bridge": "n = 'bridge'", "comparison": _COMPARE, "bridge_dated": f"n = 'bridge' AND {_DATED}", "comparison_dated": f"{_COMPARE} AND {_DATED}", "bridge_entities": f"n = 'bridge' AND ({_MANY} OR has(f, ['dense_entities', 'multi_entity']))",
        "bridge_long": f"n = 'bridge' AND {_LONG}", "comparison_attribute": f"{_COMPARE} AND has(f, ['same_attribute'])", "verification": _CHECK, "bridge_chain": "n = 'bridge' AND has(f, ['relation_chain'])", "dense_verification": _CHECKED,
    },
    3: {
        "compositional": "n = 'compositional'", "comparison": _COMPARE, "bridge_comparison": "n = 'bridge_comparison'", "inference": "n = 'inference'", "chain": "has(f, ['relation_chain'])", "four_hops": "h >= 4",
        "comparison_attribute": f"{_COMPARE} AND has(f, ['same_attribute'])", "verification": _CHECK, "dated": _DATED, "dense_verification": _CHECKED,
    },
    4: {
        "decomp_2": "n = 'decomp_2'", "decomp_3": "n = 'decomp_3'", "decomp_4": "n = 'decomp_4'", "longer_hop": "has(f, ['longer_hop']) OR h >= 3", "dated": "has(f, ['temporal', 'numeric'])", "entities": f"has(f, ['dense_entities', 'multi_entity']) AND {_MANY}",
        "comparison": "has(f, ['comparison', 'same_attribute'])", "time_anchor": "has(f, ['time_anchor'])", "chain": "has(f, ['relation_chain'])", "long_dense": f"{_LONG} AND has(f, ['dense_entities', 'longer_hop'])",
    },
}
_KINDS = "['comparison', 'bridge', 'compositional', 'inference', 'bridge_comparison', 'decomp_2', 'decomp_3', 'decomp_4']"
_MATCHES = " UNION ALL ".join(
    f"SELECT {r} AS round, '{b}' AS bucket, count(*) AS matched_packet_count, CAST(sum(size) AS BIGINT) AS total_group_size FROM gs WHERE {when.replace('has(', 'list_has_any(')} HAVING count(*) > 0" for r, rules in _ROUNDS.items() for b, when in rules.items()
)


@query(f"""WITH {SQL_PROFILES}, gs AS (SELECT {_KINDS}[id % 8 + 1] AS n, flags AS f, entity_bin AS e, token_bin AS t, hop_count AS h, wh_word AS w, form, words AS size FROM s) {_MATCHES}""")
def bucket_matches(spark, sf_dir):
    """The bucket predicates of all four rounds over profiles of every native type."""
    kinds = F.array(*[F.lit(x) for x in ("comparison", "bridge", "compositional", "inference", "bridge_comparison", "decomp_2", "decomp_3", "decomp_4")])
    rows = profiles(spark, sf_dir).select("id", "flags", "entity_bin", "token_bin", "hop_count", "wh_word", "form", "words").withColumn("native_type", F.element_at(kinds, (F.col("id") % 8 + 1).cast("int")))
    named = [F.struct(F.lit(r).alias("round"), F.lit(b).alias("bucket")) for r in _ROUNDS for _, b in packets.bucket_rules(r)]
    held = [F.when(when, name) for (when, _), name in zip([x for r in _ROUNDS for x in packets.bucket_rules(r)], named, strict=True)]
    tagged = rows.select("words", F.explode(F.array_compact(F.array(*held))).alias("b"))
    return tagged.groupBy("b.round", "b.bucket").agg(F.count(F.lit(1)).alias("matched_packet_count"), F.sum("words").cast("bigint").alias("total_group_size"))

"""Queries of profiles and sampling, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import profile, text as tx
from tessera.operators import coverage, packets, reports, sampling
from tessera.session import table, written

from .bindings import SQL_GROUPS, SQL_PROFILES, annotated_groups, profiles, questions, sql_form

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _with(select: str) -> str:
    return f"WITH {SQL_PROFILES} {select}"


def _rank():
    return [F.col("rarity").desc(), F.col("words").desc(), F.col("id").asc()]

SQL_RANK = "rarity DESC, words DESC, id"


@query(_with("SELECT id, wh_word FROM p"))
def wh_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(spark, sf_dir).select("id", "wh_word")


@query(_with("SELECT id, entity_count, entity_bin FROM p"))
def entity_bucket(spark, sf_dir):
    return profiles(spark, sf_dir).select("id", "entity_count", "entity_bin")


@query(_with("SELECT id, words, token_bin, token_bin_multi FROM p"))
def token_bucket(spark, sf_dir):
    return profiles(spark, sf_dir).select("id", "words", "token_bin", profile.token_bin(F.col("words"), True).alias("token_bin_multi"))


_FORMS = f"SELECT kind, id, {sql_form('answer', 4)} AS form_single, {sql_form('answer', 3)} AS form_multi FROM (SELECT 'part' AS kind, p_partkey AS id, p_name AS answer FROM part UNION ALL SELECT 'event', event_id, props FROM events UNION ALL SELECT 'order', o_orderkey, CAST(year(o_orderdate) AS VARCHAR) FROM orders)"


@query(_FORMS)
def answer_form(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("answer"))
    rows = rows.unionByName(table(spark, sf_dir, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("props").alias("answer")))
    rows = rows.unionByName(table(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.year("o_orderdate").cast("string").alias("answer")))
    return rows.select("kind", "id", profile.answer_form(F.col("answer")).alias("form_single"), profile.answer_form(F.col("answer"), True).alias("form_multi"))


@query(_with("SELECT kind, value, count(*) AS count FROM (SELECT 'single' AS kind, unnest(flags) AS value FROM p UNION ALL SELECT 'multi', unnest(multi_flags) FROM p) GROUP BY ALL"))
def flags_exploded(spark, sf_dir):
    rows = profiles(spark, sf_dir).withColumn("multi", _multi())
    single = reports.exploded_counts(rows, "flags").select(F.lit("single").alias("kind"), "value", "count")
    return single.unionByName(reports.exploded_counts(rows, "multi").select(F.lit("multi").alias("kind"), "value", "count"))


def _multi():
    """Multi-hop flags with the ASCII entity count, as in the SQL."""
    return profile.multi_flags(F.col("question"), F.col("answer"), F.col("native_type"), F.col("hop_count"), F.col("entity_count"))


@query(_with("SELECT substr(md5(signature), 1, 16) AS group_id, dataset, dataset || '_sig_' || substr(sha1(dataset || '::' || signature), 1, 12) AS packet_id, count(*) AS size FROM s GROUP BY signature, dataset"))
def signature_groups(spark, sf_dir):
    sizes = profiles(spark, sf_dir).groupBy("signature", "dataset").agg(F.count(F.lit(1)).alias("size"))
    return sizes.select(tx.short_md5(F.col("signature")).alias("group_id"), "dataset", tx.packet_id(F.col("dataset"), F.col("signature")).alias("packet_id"), "size")


@query(_with("SELECT id, rarity, rarest FROM r"))
def label_rarity(spark, sf_dir):
    return sampling.label_rarity(written(profiles(spark, sf_dir).select("id", "labels"), "labels"), "id").select("id", "rarity", "rarest")


def _protected(spark, sf_dir):
    # Narrow profile columns, written once and read several times.
    narrow = written(profiles(spark, sf_dir).drop("question", "answer"), "profiles")
    rows, n = sampling.label_rarity(narrow, "id"), narrow.count()
    return sampling.protect_rare(rows, "signature", tx.rare_threshold(F.lit(n), 12, 0.002))


@query(_with("SELECT id, group_size, protected, CASE WHEN small AND rare THEN 'both' WHEN small THEN 'rare_signature' WHEN rare THEN 'rare_label' END AS protect_reason FROM k"))
def protected_rows(spark, sf_dir):
    return _protected(spark, sf_dir).select("id", "group_size", "protected", "protect_reason")


_CAP = f"c AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY protected DESC, {SQL_RANK}) AS rank FROM k), d AS (SELECT * FROM c WHERE protected OR rank <= 4)"


@query(_with(f", {_CAP} SELECT id, dataset, wh_word, form AS answer_form_hint, entity_bin, token_bin, substr(md5(signature), 1, 16) AS group_id, group_size, rarity, protected FROM d"))
def cap_sample(spark, sf_dir):
    """The flagship: profile, rarity, protection and cap per signature over all documents."""
    kept = sampling.cap_per_group(_protected(spark, sf_dir), "signature", 4, _rank())
    return kept.select("id", "dataset", "wh_word", F.col("form").alias("answer_form_hint"), "entity_bin", "token_bin", tx.short_md5(F.col("signature")).alias("group_id"), "group_size", "rarity", "protected")


@query(_with(f""", c AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY protected DESC, {SQL_RANK}) AS rank FROM k),
  d AS (SELECT *, protected OR rank <= 2 AS chosen FROM c), f AS (SELECT *, row_number() OVER (ORDER BY chosen DESC, {SQL_RANK}) AS place FROM d),
  m AS (SELECT (SELECT count(*) FROM d) * 3 // 4 AS target), g AS (SELECT * FROM f, m WHERE place <= greatest(target, (SELECT count(*) FROM d WHERE chosen)))
  SELECT id, rarity, chosen FROM (SELECT *, row_number() OVER (ORDER BY {SQL_RANK}) AS final FROM g) WHERE final <= target"""))
def global_fill(spark, sf_dir):
    """Fill up to three quarters of the rows, then the best of what was selected."""
    from tessera.operators.sampling import best, cap_per_group, fill_to

    rows = _protected(spark, sf_dir)
    target = table(spark, sf_dir, "documents").count() * 3 // 4
    chosen = cap_per_group(rows, "signature", 2, _rank()).select("id", "words", "rarity", F.lit(True).alias("chosen"))
    pool = rows.select("id", "words", "rarity", F.lit(False).alias("chosen"))
    return best(fill_to(chosen, pool, "id", target, _rank()), target, _rank()).select("id", "rarity", "chosen")


@query(r"SELECT id, dataset FROM (SELECT doc_id AS id, source AS dataset, row_number() OVER (PARTITION BY lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def first_dedup(spark, sf_dir):
    rows = questions(spark, sf_dir)
    return sampling.dedup_first(rows, F.md5(tx.normalize_question("question").cast("binary")), [F.col("id")]).select("id", "dataset")


_CONFLICT = r"""WITH j AS (
  SELECT d.doc_id AS id, lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS q, CAST(l.quality AS VARCHAR) AS a FROM documents d JOIN labels l USING (doc_id)),
f AS (SELECT q, count(DISTINCT a) AS answers FROM j GROUP BY q)
SELECT id, CASE WHEN answers > 1 THEN 'conflicting' WHEN row_number() OVER (PARTITION BY q ORDER BY id) > 1 THEN 'duplicate' ELSE 'kept' END AS status FROM j JOIN f USING (q)"""


@query(_CONFLICT)
def conflict_dedup(spark, sf_dir):
    rows = questions(spark, sf_dir).join(table(spark, sf_dir, "labels"), F.col("id") == F.col("doc_id"))
    return sampling.dedup_conflicts(rows, F.md5(tx.normalize_question("question").cast("binary")), F.col("quality").cast("string"), [F.col("id")]).select("id", "status")


@query("""SELECT o_orderstatus, o_orderpriority, o_orderkey FROM (
  SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY o_orderstatus, o_orderpriority) AS n FROM orders WINDOW w AS (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_totalprice, o_orderkey))
WHERE n <= 5 OR pos IN (round_even(0 * (n - 1) / 4.0, 0), round_even(1 * (n - 1) / 4.0, 0), round_even(2 * (n - 1) / 4.0, 0), round_even(3 * (n - 1) / 4.0, 0), round_even(4 * (n - 1) / 4.0, 0))""")
def representatives(spark, sf_dir):
    return sampling.representatives(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], [F.col("o_totalprice"), F.col("o_orderkey")], 5).select("o_orderstatus", "o_orderpriority", "o_orderkey")


@query("""WITH u AS (
  SELECT p_partkey, 0 AS stage FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) WHERE k <= 8
  UNION ALL SELECT p_partkey, 1 FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) WHERE k <= 10)
SELECT p_partkey, min(stage) AS stage FROM u GROUP BY p_partkey""")
def stratified_topk(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    order = [F.col("p_retailprice").desc(), F.col("p_partkey")]
    return sampling.stratified_top([(part, ["p_brand"], 8), (part, ["p_type"], 10)], "p_partkey", order).select("p_partkey", "stage")


@query("""SELECT doc_id, source, turn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS turn FROM documents)
ORDER BY turn, md5('42:' || source), source, doc_id LIMIT 150""")
def round_robin_take(spark, sf_dir):
    return sampling.round_robin(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 150).select("doc_id", "source", F.col("turn").cast("bigint").alias("turn"))


@query(f"""WITH RECURSIVE {SQL_GROUPS}, c AS (SELECT greatest(1, count(*) // 5) AS target, greatest(24, least(80, greatest(1, count(*) // 5) // 100)) AS quota FROM documents),
w(step, group_id, taken) AS (
  SELECT 0::BIGINT, group_id, 0::BIGINT FROM y
  UNION ALL SELECT step, group_id, CAST(taken + CASE WHEN has THEN greatest(0, least(size - taken, need - before)) ELSE 0 END AS BIGINT) FROM (
    SELECT *, least(quota - coalesce(sum(taken) FILTER (has) OVER (), 0), target - sum(taken) OVER ()) AS need,
      coalesce(sum(size - taken) FILTER (has) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM (SELECT fq.step, y.group_id, w.taken, y.size, y.place, list_contains(y.labels, fq.label) AS has, quota, target FROM w JOIN y USING (group_id) JOIN fq ON fq.step = w.step + 1, c))),
qq AS (SELECT y.*, w.taken FROM w JOIN y USING (group_id) WHERE w.step = (SELECT max(step) FROM fq)),
rr AS (SELECT group_id, row_number() OVER (ORDER BY turn, place) AS k FROM (SELECT group_id, place, unnest(range(size - taken)) AS turn FROM qq)),
x AS (SELECT group_id, taken + coalesce(more, 0) AS take FROM qq LEFT JOIN (SELECT group_id, count(*) AS more FROM rr WHERE k <= (SELECT target FROM c) - (SELECT sum(taken) FROM qq) GROUP BY group_id) m USING (group_id)),
z AS (SELECT id, dataset, substr(md5(signature), 1, 16) AS group_id, row_number() OVER (PARTITION BY signature ORDER BY md5('20260327:' || id), id) AS k FROM s)
SELECT id, dataset, group_id FROM z JOIN x USING (group_id) WHERE k <= take""")
def coverage_sample(spark, sf_dir):
    """W9-W11 over signature groups: a fifth of the documents."""
    rows, groups = annotated_groups(spark, sf_dir)
    return coverage.coverage_sample(rows.select("id", "dataset", "group_id"), coverage.group_priority(groups), max(1, rows.count() // 5))


@query(r"""WITH g AS (SELECT l_returnflag || l_linestatus || CAST(l_linenumber AS VARCHAR) AS group_id, count(*) AS size FROM lineitem GROUP BY ALL),
b AS (SELECT *, coalesce(sum(size) OVER (ORDER BY size DESC, group_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, (SELECT count(*) // 3 FROM lineitem) AS quota FROM g)
SELECT group_id, size, CAST(greatest(0, least(size, quota - before)) AS BIGINT) AS take FROM b""")
def quota_fill(spark, sf_dir):
    """One label takes its quota from groups in order of priority, by prefix sums over the group table."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "lineitem")
    groups = rows.groupBy(F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("group_id")).agg(F.count(F.lit(1)).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy(F.col("size").desc(), "group_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = F.expr("sum(size) OVER () div 3")
    return groups.select("group_id", "size", F.greatest(F.lit(0), F.least(F.col("size"), quota - before)).cast("bigint").alias("take"))


_NORM = r"md5(lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))))"


@query(f"""WITH d AS (SELECT doc_id AS id, source AS group_id, {_NORM} AS q FROM documents),
sel AS (SELECT d.* FROM d JOIN labels l ON l.doc_id = d.id WHERE quality = 1), rej AS (SELECT d.* FROM d JOIN labels l ON l.doc_id = d.id WHERE quality = 0),
f AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY id) AS turn FROM d WHERE id NOT IN (SELECT id FROM sel) AND q NOT IN (SELECT q FROM sel UNION SELECT q FROM rej)),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY turn, group_id, id) AS k FROM f) WHERE k = 1)
SELECT id, group_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY turn, id) AS again FROM o) ORDER BY again, group_id, id LIMIT 100""")
def refill_candidates(spark, sf_dir):
    rows = questions(spark, sf_dir).withColumn("group_id", F.col("dataset"))
    norm = F.md5(tx.normalize_question("question").cast("binary"))
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id")
    told = rows.join(labels, "id").withColumn("question_key", norm)
    return coverage.refill(rows, told.where("quality = 1"), told.where("quality = 0"), norm, 100, F.col("id"), F.col("group_id")).select("id", "group_id")


@query(_with(", x AS (SELECT unnest([{'dimension': 'wh_word', 'value': wh_word}, {'dimension': 'form', 'value': form}, {'dimension': 'entity_bin', 'value': entity_bin}, {'dimension': 'token_bin', 'value': token_bin}, {'dimension': 'native_type', 'value': native_type}]) AS d FROM p), c AS (SELECT d.dimension AS dimension, d.value AS value, count(*) AS count FROM x GROUP BY ALL) SELECT *, round(count / sum(count) OVER (PARTITION BY dimension), 9) AS share FROM c"))
def distributions(spark, sf_dir):
    return reports.distributions(profiles(spark, sf_dir), ["wh_word", "form", "entity_bin", "token_bin", "native_type"])


@query(_with(", c AS (SELECT signature, count(*) AS group_size, count(DISTINCT dataset) AS n_datasets, min(id) AS first_id FROM s GROUP BY signature) SELECT substr(md5(signature), 1, 16) AS group_id, group_size, n_datasets, first_id FROM c ORDER BY group_size DESC, signature LIMIT 24"))
def top_profiles(spark, sf_dir):
    sizes = profiles(spark, sf_dir).groupBy("signature").agg(F.count(F.lit(1)).alias("group_size"), F.countDistinct("dataset").alias("n_datasets"), F.min("id").alias("first_id"))
    return packets.top_profiles(sizes, [F.col("group_size").desc(), F.col("signature")], 24).select(tx.short_md5(F.col("signature")).alias("group_id"), "group_size", "n_datasets", "first_id")


@query("SELECT d.doc_id AS id, b.item_id IS NOT NULL AS is_eval_overlap FROM documents d LEFT JOIN (SELECT DISTINCT item_id FROM benchmark) b ON b.item_id = d.doc_id")
def eval_overlap_flag(spark, sf_dir):
    ids = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))
    return profile.with_overlap(questions(spark, sf_dir).select("id"), ids)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def eval_anti(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return profile.without_overlap(table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 200000)")
def materialize_semi(spark, sf_dir):
    chosen = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' AND o_totalprice > 200000").select(F.col("o_orderkey").alias("l_orderkey"))
    return coverage.materialise_selected(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), chosen, "l_orderkey")


@query("SELECT d.doc_id AS id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, 0) AS toxic, l.doc_id IS NOT NULL AS reviewed FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def light_full_left(spark, sf_dir):
    """Full rows drive, missing reviews get defaults."""
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "__id")
    joined = questions(spark, sf_dir).select("id").join(labels, F.col("id") == F.col("__id"), "left")
    return joined.select("id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"), F.col("__id").isNotNull().alias("reviewed"))


_BUCKETS = "list_filter([CASE WHEN event_type = 'click' THEN 'click' END, CASE WHEN value > 50 THEN 'high' END, CASE WHEN event_type IN ('error', 'signup') AND value <= 10 THEN 'low_odd' END, CASE WHEN user_id % 2 = 0 THEN 'even' END], lambda x: x IS NOT NULL)"


@query(f"""WITH t AS (SELECT event_id, props, CAST(user_id AS BIGINT) AS size, unnest({_BUCKETS}) AS bucket FROM events),
c AS (SELECT bucket, count(*) AS matched_packet_count, CAST(sum(size) AS BIGINT) AS total_group_size FROM t GROUP BY bucket),
d AS (SELECT bucket, props, min(event_id) AS first FROM t WHERE trim(props) <> '' GROUP BY ALL),
e AS (SELECT bucket, string_agg(props, '|' ORDER BY props) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY first) AS k FROM d) WHERE k <= 10 GROUP BY bucket)
SELECT * FROM c JOIN e USING (bucket)""")
def bucket_rollup(spark, sf_dir):
    e, v = F.col("event_type"), F.col("value")
    rules = [(e == "click", "click"), (v > 50, "high"), (e.isin("error", "signup") & (v <= 10), "low_odd"), (F.col("user_id") % 2 == 0, "even")]
    return packets.bucket_rollup(table(spark, sf_dir, "events"), rules, F.col("props"), F.col("user_id"), [F.col("event_id")], 10)


@query("SELECT doc_id, quality, CASE WHEN rep = 1 THEN CAST(doc_id AS VARCHAR) ELSE doc_id || '__rep' || rep END AS copy_id FROM (SELECT *, unnest(range(1, 2 + quality + 2 * toxic)) AS rep FROM labels)")
def oversample(spark, sf_dir):
    return sampling.oversample(table(spark, sf_dir, "labels"), 1 + F.col("quality") + 2 * F.col("toxic"), "doc_id").select("doc_id", "quality", "copy_id")


@query("""WITH RECURSIVE s AS (SELECT lang, count(*) AS n, row_number() OVER (ORDER BY lang) AS k FROM documents GROUP BY lang), t AS (SELECT count(*) AS total FROM documents),
q AS (SELECT 0 AS k, 100::BIGINT AS rest, (SELECT total FROM t) AS pool, NULL::VARCHAR AS lang, 0::BIGINT AS take
  UNION ALL SELECT s.k, rest - x, pool - s.n, s.lang, x FROM (SELECT q.rest, q.pool, s.*, CASE WHEN q.rest > 0 THEN least(greatest(1, CAST(round_even(s.n * q.rest / q.pool, 0) AS BIGINT)), s.n, q.rest) ELSE 0 END AS x FROM q JOIN s ON s.k = q.k + 1) s)
SELECT doc_id AS id, CASE WHEN row_number() OVER (PARTITION BY d.lang ORDER BY md5('42:' || doc_id), doc_id) <= q.take THEN 'eval' ELSE 'train' END AS part FROM documents d JOIN q ON q.lang = d.lang""")
def train_eval_split(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    return sampling.train_eval_split(rows, "lang", "id", 100).select("id", "part")


@query("SELECT o_orderkey, CAST(ntile(7) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS shard FROM orders")
def contiguous_shards(spark, sf_dir):
    return sampling.contiguous_shards(table(spark, sf_dir, "orders").select("o_orderkey"), [F.col("o_orderkey")], 7)

"""Queries whose rows go out to files or logs and come back through the sources, and small text rules, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import merge, messages, packets, reports
from tessera.session import shared_folder, table
from tessera.sources import arrow_ipc, external, files
from tessera.streaming import logs

from .trace_queries import _ART, _COLLAPSE, _PUNCT

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority, row_number() OVER (ORDER BY o_orderkey) - 1 AS line_no FROM orders")
def jsonl_scan(spark, sf_dir):
    """Orders as JSON lines in two appended parts, read with the order of their lines."""
    folder = shared_folder(spark, "jsonl")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    middle = orders.agg(F.avg("o_orderkey")).first()[0] or 0
    files.write_jsonl(orders.where(F.col("o_orderkey") < middle).orderBy("o_orderkey"), f"{folder}/1")
    files.write_jsonl(orders.where(F.col("o_orderkey") >= middle).orderBy("o_orderkey"), f"{folder}/2")
    files.write_jsonl(orders.limit(0), f"{folder}/2", append=True)
    return files.read_jsonl(spark, [f"{folder}/1", f"{folder}/2"], "o_orderkey long, o_orderstatus string, o_orderpriority string")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS line_no FROM orders ORDER BY o_orderkey LIMIT 100")
def jsonl_head(spark, sf_dir):
    """The first hundred lines of a file."""
    folder = shared_folder(spark, "jsonl")
    files.write_jsonl(table(spark, sf_dir, "orders").select("o_orderkey").orderBy("o_orderkey"), folder)
    return files.read_jsonl(spark, folder, "o_orderkey long", limit=100)


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem")
def arrow_scan(spark, sf_dir):
    """Order lines as Arrow streams, one from each task, read again by record batches."""
    folder = shared_folder(spark, "arrow")
    arrow_ipc.write_arrow(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag").repartition(3, "l_orderkey"), folder)
    return files.read_arrow(spark, folder, split_bytes=1 << 20)


@query("SELECT 0 AS src_priority, c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT 1, s_suppkey, s_name FROM supplier")
def table_union(spark, sf_dir):
    """Parquet and JSON lines by their suffix, in the order listed."""
    folder = shared_folder(spark, "tables")
    table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")).write.parquet(f"{folder}/a.parquet")
    files.write_jsonl(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")), f"{folder}/b.jsonl")
    return files.read_tables(spark, [f"{folder}/a.parquet", f"{folder}/b.jsonl"]).select("src_priority", "key", "name")


@query("SELECT DISTINCT CAST(item_id AS VARCHAR) AS id FROM benchmark WHERE item_id IS NOT NULL")
def eval_id_scan(spark, sf_dir):
    """Ids of evaluation files; one that is missing gives none."""
    folder = shared_folder(spark, "eval")
    ids = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))
    files.write_jsonl(ids.unionByName(ids), f"{folder}/dev")
    return files.eval_ids(spark, f"{folder}/dev").unionByName(files.eval_ids(spark, f"{folder}/none", tolerant=True))


@query("""SELECT part, event_type, count(*) AS n FROM (SELECT 'raw' AS part, event_type FROM events UNION ALL SELECT CASE WHEN value > 20 THEN 'filtered' ELSE 'failed' END, event_type FROM events) GROUP BY ALL""")
def partitioned_outcomes(spark, sf_dir):
    """Raw, filtered and failed tables, partitioned by type, read back."""
    folder = shared_folder(spark, "outcomes")
    files.write_partitioned(table(spark, sf_dir, "events"), folder, "event_type", F.col("value") > 20)
    parts = [spark.read.parquet(f"{folder}/{p}").select(F.lit(p).alias("part"), F.col("event_type").cast("string").alias("event_type")) for p in ("raw", "filtered", "failed")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("part", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def cached_counts(spark, sf_dir):
    """A table that is made once, and made anew when its size is not the expected one."""
    folder = shared_folder(spark, "cached")
    counts = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    files.cached_table(spark, folder, lambda: counts.limit(1))
    expected = counts.count()
    files.cached_table(spark, folder, lambda: counts, expected)
    return files.cached_table(spark, folder, lambda: counts.limit(0), expected)


@query("SELECT event_id, event_type, value > 20 AS passed FROM events")
def log_replay(spark, sf_dir):
    """A log of JSON lines is followed at a pace and appended to another, once each."""
    folder = shared_folder(spark, "replay")
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("value") > 20).alias("passed"))
    rows.repartition(6, "event_id").write.json(f"{folder}/in")
    stream = logs.read_log(spark, f"{folder}/in", rows.schema, 2)
    for _ in range(2):
        # The second run finds nothing new.
        logs.append_log(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(rows.schema).json(f"{folder}/out")


@query("SELECT part, count(*) AS n FROM (SELECT 'raw' AS part FROM events UNION ALL SELECT CASE WHEN value > 20 THEN 'filtered' ELSE 'failed' END FROM events) GROUP BY part")
def log_split(spark, sf_dir):
    """S18 on a stream: batches of a log into raw, filtered and failed."""
    folder = shared_folder(spark, "split")
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("value") > 20).alias("passed"))
    rows.repartition(6, "event_id").write.json(f"{folder}/in")
    logs.split_sink(logs.read_log(spark, f"{folder}/in", rows.schema, 2), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    parts = [spark.read.schema(rows.schema).json(f"{folder}/out/{p}").select(F.lit(p).alias("part")) for p in ("raw", "filtered", "failed")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id AS id, CASE WHEN source IS NULL THEN 'unknown' ELSE source END AS data_source, 'Answer.' || chr(10) || CASE WHEN q <> '' AND NOT ends_with(q, '?') THEN q || '?' ELSE q END AS prompt_md5, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place
FROM (SELECT *, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS q FROM documents)""".replace("'Answer.' || chr(10) ||", "md5('Answer.' || chr(10) ||").replace("ELSE q END AS prompt_md5", "ELSE q END) AS prompt_md5"))
def nested_prompts(spark, sf_dir):
    """Nested rows written and read back: the whole prompt, and the row's place in its data set."""
    folder = shared_folder(spark, "nested")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("question"), F.array(F.lit("a")).alias("golden_answers"), F.col("source").alias("dataset"))
    files.write_nested(messages.prompt_rows(rows, "train", "Answer."), folder)
    back = spark.read.parquet(folder)
    return back.select(F.col("extra_info.source_id").cast("bigint").alias("id"), "data_source", F.md5(F.col("prompt")[0]["content"].cast("binary")).alias("prompt_md5"), F.col("extra_info")["index"].cast("bigint").alias("place"))


@query("""SELECT event_id, event_type = 'error' AS runtime_error, CASE WHEN event_type = 'error' THEN 'Timeout: ' || props END AS message FROM events""")
def runtime_failures(spark, sf_dir):
    """M5: records of what broke off, beside those that did not."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    broken = merge.runtime_failure(rows.where("event_type = 'error'"), F.lit("Timeout"), F.col("props"))
    told = broken.select("event_id", F.col("validation.runtime_error").alias("runtime_error"), F.concat_ws(": ", "validation.error_type", "validation.error_message").alias("message"))
    rest = rows.where("event_type IS DISTINCT FROM 'error'").select("event_id", F.lit(False).alias("runtime_error"), F.lit(None).cast("string").alias("message"))
    return told.unionByName(rest)


@query("SELECT event_type, round_even(avg(CAST(user_id % 8 AS DOUBLE)), 2) AS mean FROM events GROUP BY event_type")
def rounded_means(spark, sf_dir):
    """A17."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(reports.rounded_mean((F.col("user_id") % 8).cast("double")).alias("mean"))


def _bag(column: str) -> str:
    """SQL: the distinct words of a normalised text."""
    plain = f"translate({_ART.format(f'lower({column})')}, '{_PUNCT}', '')"
    return f"list_distinct(string_split({_COLLAPSE.format(plain)}, ' '))"


@query(f"""WITH c AS (SELECT conv_id, coalesce(max(CASE WHEN turn = 0 THEN text END), '') AS a, coalesce(max(CASE WHEN turn = 2 THEN text END), '') AS b FROM conversations GROUP BY conv_id),
n AS (SELECT conv_id, {_bag('a')} AS x, {_bag('b')} AS y FROM c)
SELECT conv_id, round(len(list_intersect(x, y)) / CAST(greatest(len(list_distinct(list_concat(x, y))), 1) AS DOUBLE), 9) AS copied FROM n""")
def query_copies(spark, sf_dir):
    """How far the second question of a conversation repeats the first."""
    said = lambda k: F.coalesce(F.max(F.when(F.col("turn") == k, F.col("text"))), F.lit(""))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(said(0).alias("a"), said(2).alias("b"))
    return rows.select("conv_id", F.round(reports.query_copy(F.col("a"), F.col("b")), 9).alias("copied"))


@query(r"""SELECT event_id, regexp_replace(regexp_replace(' "' || props || ''' ', '^\s+|\s+$', '', 'g'), '^[''"]|[''"]$', '', 'g') AS cleaned, array_to_string(list_filter([props, event_type], lambda x: x <> ''), '|') AS gold FROM events""")
def answer_texts(spark, sf_dir):
    """F5, S4."""
    given = F.array("props", F.concat(F.lit(" "), F.col("event_type"), F.lit("\n")), F.lit("  "))
    none = F.array().cast("array<string>")
    return table(spark, sf_dir, "events").select("event_id", tx.clean_prediction(F.concat(F.lit(' "'), "props", F.lit("' "))).alias("cleaned"), F.array_join(tx.gold_answers(none, given), "|").alias("gold"))


@query("""WITH g AS (SELECT source, count(*) * 100 AS n, count(DISTINCT lang) AS types, count(DISTINCT n_chars % 5) AS hops FROM documents GROUP BY source)
SELECT source, CAST(least(greatest(round_even(n * 0.10::DOUBLE + types * 1200 + hops * 1000, 0), 5000), n) AS BIGINT) AS target FROM g""")
def target_sizes(spark, sf_dir):
    """F16."""
    groups = table(spark, sf_dir, "documents").groupBy("source").agg((F.count(F.lit(1)) * 100).alias("n"), F.countDistinct("lang").alias("types"), F.countDistinct(F.col("n_chars") % 5).alias("hops"))
    return groups.select("source", tx.target_size(F.col("n"), F.col("types"), F.col("hops")).alias("target"))


@query("""SELECT conv_id, md5(coalesce(string_agg(t, chr(10) ORDER BY turn) FILTER (t <> ''), '')) AS texts FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations) GROUP BY conv_id""")
def response_texts(spark, sf_dir):
    """The texts of nested responses written as JSON."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    nested = F.struct(F.array(F.struct(F.transform("t", lambda x: F.struct(x["text"].alias("text"))).alias("content"))).alias("output"))
    return rows.select("conv_id", F.md5(external.gather_text(F.to_json(nested)).cast("binary")).alias("texts"))


@query("SELECT p_partkey, 'Part ' || p_name || ' {unknown} of size ' || p_size || '; by ' || p_brand || '.' AS prompt, array_to_string(list_sort(list_distinct(['size-' || p_size, 'b-' || p_partkey % 9])), '|') AS ids, array_to_string(list_distinct(['size-' || p_size, 'b-' || p_partkey % 9]), '|') <> '' AS named FROM part")
def rendered_prompts(spark, sf_dir):
    """Templates filled from columns, ids in backticks."""
    part = table(spark, sf_dir, "part")
    prompt = messages.render("Part {name} {unknown} of size {size}; by {brand}.", name=F.col("p_name"), size=F.col("p_size"), brand=F.col("p_brand"))
    told = F.concat(F.lit("use `size-"), F.col("p_size").cast("string"), F.lit("` and `b-"), (F.col("p_partkey") % 9).cast("string"), F.lit("`, `Not An Id`, then `size-"), F.col("p_size").cast("string"), F.lit("`"))
    ids, ordered = packets.bank_ids(told), packets.bank_ids(told, in_order=True)
    return part.select("p_partkey", prompt.alias("prompt"), F.array_join(ids, "|").alias("ids"), (F.startswith(F.array_join(ordered, "|"), F.lit("size-")) & (F.size(ids) == F.size(ordered))).alias("named"))

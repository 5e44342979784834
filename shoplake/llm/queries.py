"""The subpackage's registered queries: each applies one operator to its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplake.functions.cluster import ship_package
from shoplake.llm import chat, decontam, lm, merkle, packing, quality, ranked, repeats, sharding, simhash, toxicity, urllists, warc
from shoplake.llm.sql import ORACLE_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small sources are drawn on more than their size, as mixtures for training are, until they run dry."""
    return packing.pack(table(spark, sf_dir, "documents"), temperature=1.5)


#: What the derived tools accept.
TOOLS = [
    chat.Field("search", "query", "string"), chat.Field("search", "limit", "double", True, 1, 40), chat.Field("search", "after", "array<string>", False),
    chat.Field("lookup", "query", "string"), chat.Field("lookup", "limit", "double", False, 0, 30), chat.Field("lookup", "after", "array<string>", False),
]


def op2_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns stand for tool calls, user turns answer the turn before.

    A call waits for those two and four turns before, if the conversation has
    such turns; identifiers repeat from one conversation to the next.
    """
    turns = table(spark, sf_dir, "conversations")
    text = F.coalesce("text", F.lit(""))
    ident = lambda turn: F.concat(F.lit("call-"), turn.cast("string"))
    name = F.element_at(F.array(F.lit("search"), F.lit("lookup"), F.lit("paint")), (F.length(text) % 3 + 1).cast("int"))
    query = F.regexp_extract(text, "^\\p{L}+", 0)
    needs = F.array_compact(F.array(*[F.when(F.col("turn") >= back, ident(F.col("turn") - back)) for back in (2, 4)]))
    limit = F.concat((F.length(text) % 50).cast("string"), F.element_at(F.array(F.lit(""), F.lit(".0"), F.lit("e0")), (F.length(text) % 3 + 1).cast("int")))
    parts = [F.concat(F.lit(' "limit" : '), limit), F.when(query != "", F.concat(F.lit('"query":"'), query, F.lit('"'))), F.when(F.size(needs) > 0, F.concat(F.lit('"after":["'), F.array_join(needs, '", "'), F.lit('"]')))]
    arguments = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    calls = turns.filter("role = 'assistant'").select("conv_id", ident(F.col("turn")).alias("call_id"), F.col("turn").cast("long").alias("turn"), name.alias("name"), arguments.alias("arguments"))
    results = turns.filter("role = 'user' and turn >= 1").select("conv_id", ident(F.col("turn") - 1).alias("call_id"), F.col("turn").cast("long").alias("turn"), F.md5(text).alias("content"))
    return chat.link(calls, results, TOOLS)


def op3_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(table(spark, sf_dir, "documents"), fold(10) != 0)
    return scored.withColumn("held_out", fold(10) == 0)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def fold(n: int):
    """The remainder of crc32(doc_id as text), which sets rows apart for checks."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.fit(docs, labels, fold(5) != 0)


def op5_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return scored.withColumn("held_out", fold(5) == 0)


def op6_temporal_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch days follow page ids; the list is derived from the hosts: added, removed and added again.

    Entries are hosts, hosts with a path, and domains above a host.
    """
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 365).cast("int")).alias("fetched"))
    hosts = pages.select(urllists.host(F.col("url")).alias("host")).filter("host <> ''").distinct()
    above = F.regexp_replace("host", "^[^.]+\\.(?=[^.]+\\.)", "")
    entry = F.when(F.length("host") % 5 == 1, F.concat("host", F.lit("/en"))).when(F.length("host") % 5 == 2, above).otherwise(F.col("host"))
    step = F.explode(F.array(F.struct(F.lit("add").alias("action"), F.lit(0).alias("plus")), F.struct(F.lit("remove").alias("action"), F.lit(60).alias("plus")), F.struct(F.lit("add").alias("action"), F.lit(150).alias("plus"))))
    dated = hosts.filter(F.length("host") % 3 != 0).select(entry.alias("entry"), (F.length("host") * 7 % 200).alias("start"), step.alias("e"))
    # Several hosts may give one entry; the earliest start counts.
    dated = dated.groupBy("entry", "e").agg(F.min("start").alias("start"))
    events = dated.select("entry", "e.action", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("start") + F.col("e.plus")).cast("int")).alias("day"))
    return urllists.judge(captures, events)


def op7_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards in two regions; the ninth joins the second rack of the second region."""
    tree = sharding.even_tree(8)
    return sharding.assign(table(spark, sf_dir, "documents"), tree, sharding.grown(tree, 1, 3, 8))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page is fetched three times: in full, then twice conditionally, with another entity tag the last time for some.

    Header names differ in case, some tags are weak, and pages whose ids divide
    by seven send no tag but a modification date.
    """
    pages = table(spark, sf_dir, "pages")
    k = F.col("k")
    visits = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("tag"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string").alias("size"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    ts = (F.col("page_id") % 1000) * 600 + k * 200_000
    dated = F.col("page_id") % 7 == 0
    strong = F.when((k == 2) & (F.col("page_id") % 5 == 0), F.reverse("tag")).otherwise(F.col("tag"))
    etag = F.when(dated, F.lit(None)).when(k == 1, F.concat(F.lit("W/"), strong)).otherwise(strong)
    modified = F.when(dated, F.concat(F.lit("m"), (F.col("page_id") % 11).cast("string"), F.when((k == 2) & (F.col("page_id") % 3 == 0), F.lit("later")).otherwise(F.lit(""))))
    day = F.concat(F.lit("t"), ts.cast("string"))
    headers = F.when(k == 0, F.create_map(F.lit("Content-Length"), F.col("size"), F.lit("content-type"), F.lit("text/html"), F.lit("Date"), day, F.lit("X-Tag"), F.col("tag"))).otherwise(
        F.create_map(F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("content-length"), F.lit("0"), F.lit("DATE"), day)
    )
    captures = visits.select((F.col("page_id") * 3 + k).alias("record_id"), "url", ts.alias("ts"), F.when(k == 0, 200).otherwise(304).alias("status"), etag.alias("etag"), modified.alias("last_modified"), headers.alias("headers"))
    return warc.resolve(captures)


def op11_tput_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the rows have their text lower-cased behind the manifest's back."""
    return merkle.audit(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 3 == 0)


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_mixture_packing, op2_tool_links, op3_attention_scores, op4_quality_rules, op5_toxic_segments, op6_temporal_lists, op7_hash_tree_sharding, op8_simhash_near_dedup, op9_spaced_seeds, op10_revisits, op11_tput_search, op12_merkle_manifest, op13_suffix_array_dedup)}

"""The thin queries over the given tables: rows come from the operators, digests are derived here."""

from __future__ import annotations

import zlib

import pyarrow as pa
from public_tokenizers import path
from pyspark.sql import Column
from pyspark.sql import functions as F

from lacuna.llm import bitplanes, byte_bpe, conversations, decontaminate, hash_forest, isolation, lang_id, line_templates, near_dup, periodic, quality, shards, storage, url_filter
from lacuna.llm.registry import query, table


@query("op2_byte_bpe")
def op2(spark, sf_dir):
    """Ids and round trip of every whole text."""
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), path("byte_bpe_multi_50k.tiktoken"))


@query("op4_bitplanes")
def op4(spark, sf_dir):
    """Token files of all texts, read back."""
    folder = storage.folder(spark, "ids")
    bitplanes.write_ids(table(spark, sf_dir, "documents"), path("word_bpe_49k.json"), 1, folder)
    return bitplanes.read_ids(spark, folder)


def fold(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo ``modulus``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


@query("op5_lang_id")
def op5(spark, sf_dir):
    """Language of every whole text, learned outside the held-out fold."""
    documents, pieces = table(spark, sf_dir, "documents"), path("piece_bpe_32k.model")
    model = lang_id.fit(documents.filter(fold(4) != 2), pieces)
    found = lang_id.predict(documents, model, pieces)
    return found.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op10_sampled_splitters", shards.SQL)
def op10(spark, sf_dir):
    """All documents in 24 shards of near-equal bytes."""
    found = shards.shard_by_bytes(table(spark, sf_dir, "documents"), 24)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op6_quadratic_discriminant")
def op6(spark, sf_dir):
    """Quality of every whole text, learned outside the held-out fold."""
    stats = storage.written(quality.document_statistics(table(spark, sf_dir, "documents")), "statistics")
    model = quality.fit(stats.filter(fold(3) != 1), table(spark, sf_dir, "labels"))
    found = quality.predict(stats, model)
    held_out = F.coalesce(fold(3) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op11_isolation_forest")
def op11(spark, sf_dir):
    """Base rules and isolation forest over every whole text."""
    stats = storage.written(isolation.rule_statistics(table(spark, sf_dir, "documents")), "statistics")
    found = storage.written(isolation.scored(stats, isolation.fit(stats)), "scored")
    threshold = isolation.calibrate(found, table(spark, sf_dir, "labels"))
    return isolation.verdicts(found, threshold).select("doc_id", *isolation.COUNTS, "base_failed", "kept", "score")


def with_planted_repeats(documents):
    """``doc_id, text``, where the end of every tenth text (by its id's hash) repeats itself; a null id changes nothing."""

    def planted(doc_id, text):
        h = zlib.crc32(str(doc_id).encode())
        words = (text or "").encode().split()
        if doc_id is None or h % 10 or not words:
            return text
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return b" ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, n)]).decode()

    def run(batches):
        for batch in batches:
            for block in periodic.blocks([batch], size=periodic.BLOCK):
                ids, texts = block.column("doc_id"), block.column("text").to_pylist()
                done = pa.array([planted(i, t) for i, t in zip(ids.to_pylist(), texts)], pa.string())
                yield pa.RecordBatch.from_arrays([ids, done], ["doc_id", "text"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, text string")


#: Of two runs the one with the greater exact length / period first; of equal ones the earlier one, then the shorter period.
BY_EXPONENT = """array_sort(runs, (x, y) -> case when x.length * y.period > y.length * x.period then -1 when x.length * y.period < y.length * x.period then 1
  when x.start <> y.start then if(x.start < y.start, -1, 1) else if(x.period < y.period, -1, if(x.period > y.period, 1, 0)) end)"""


@query("op12_recompression")
def op12(spark, sf_dir):
    """Periodic runs of every whole text, with planted ones, and the texts without their repetitions."""
    found = periodic.periodic_runs(with_planted_repeats(table(spark, sf_dir, "documents")))
    found = found.withColumn("best", F.expr(f"get({BY_EXPONENT}, 0)"))
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def damaged(rows):
    """Conversation rows, dropped, emptied, cut, repeated or given to the user by the hash of their key."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    text, h = F.coalesce("text", space), F.col("_h")
    hashed = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("_h")).filter(h != 0)
    hashed = hashed.withColumn("text", F.when(h == 1, "").when(h == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    hashed = hashed.withColumn("role", F.when(h == 4, "user").otherwise(F.col("role")))
    return hashed.withColumn("_copy", F.explode(F.when(h == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_h", "_copy")


@query("op13_hirschberg")
def op13(spark, sf_dir):
    """Damaged conversations: their faults, the cheapest repair and a digest of the repaired turns."""
    rows = table(spark, sf_dir, "conversations")
    placed, edits, report = conversations.repair(damaged(rows))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    found = rows.select("conv_id").distinct()
    parts = [report, conversations.audits(edits), conversations.digests(conversations.repaired(placed, edits))]
    for part in parts:
        found = conversations.matched(found, part, how="left")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return found.select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


@query("op7_minhash_hamming", near_dup.SQL)
def op7(spark, sf_dir):
    """Near-duplicate groups of all documents."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op9_spaced_seeds", decontaminate.SQL)
def op9(spark, sf_dir):
    """Documents that overlap with benchmark items."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_line_templates", line_templates.SQL)
def op8(spark, sf_dir):
    """All documents without the lines of recurring templates."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.clean(documents).select("doc_id", "n_lines", "n_dropped", "text")


@query("op3_hash_forest", hash_forest.SQL)
def op3(spark, sf_dir):
    """The 20 nearest others of every twentieth vector."""
    return hash_forest.search(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", 20)


# Captures and list events are drawn from the hosts of ``pages`` by arithmetic that Spark and SQL share:
# a page is fetched at a second of a year that its id fixes, a host is listed at days that its md5 fixes.
FETCHED = "cast(timestamp'2024-01-01 00:00:00' as timestamp) + make_interval(0, 0, 0, 0, 0, 0, (page_id * 7919977) % 31536000)"
EVENTS = """
with h as (
  select host, cast(conv(substr(md5(host), 1, 4), 16, 10) as int) as x from hosts),
e as (
  select case when x % 4 = 3 then 'known' else concat('bad', x % 3) end as list, case when x % 4 = 3 then 'allow' else 'block' end as verdict,
    case x % 4 when 0 then 'host' when 1 then 'domain' when 2 then 'prefix' else 'host' end as kind,
    case x % 4 when 1 then substr(host, instr(host, '.') + 1) when 2 then concat(host, '/en') else host end as pattern,
    x % 300 as day, (x % 7 + 1) * 15 as length, x from h)
select list, verdict, kind, pattern, 'add' as action, timestamp'2024-01-01' + make_interval(0, 0, 0, day) as at from e
union all select list, verdict, kind, pattern, 'remove', timestamp'2024-01-01' + make_interval(0, 0, 0, day + length) from e where x % 3 <> 0
union all select list, verdict, kind, pattern, 'add', timestamp'2024-01-01' + make_interval(0, 0, 0, day + length + 40) from e where x % 5 = 0
"""
URL_SQL = r"""
with p as (
  select page_id, url, timestamp '2024-01-01' + to_seconds((page_id * 7919977) % 31536000) as fetched,
    rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.') as host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') as parts from pages),
h as (select host, ('0x' || substr(md5(host), 1, 4))::int as x from (select distinct host from p where host <> '')),
e as (
  select case when x % 4 = 3 then 'known' else 'bad' || (x % 3) end as list, case when x % 4 = 3 then 'allow' else 'block' end as verdict,
    case x % 4 when 0 then 'host' when 1 then 'domain' when 2 then 'prefix' else 'host' end as kind,
    case x % 4 when 1 then substr(host, instr(host, '.') + 1) when 2 then host || '/en' else host end as pattern,
    x % 300 as day, (x % 7 + 1) * 15 as length, x from h),
events as (
  select list, verdict, kind, pattern, 1 as active, timestamp '2024-01-01' + to_days(day) as moment from e
  union all select list, verdict, kind, pattern, 0, timestamp '2024-01-01' + to_days(day + length) from e where x % 3 <> 0
  union all select list, verdict, kind, pattern, 1, timestamp '2024-01-01' + to_days(day + length + 40) from e where x % 5 = 0),
state as (select list, verdict, kind, pattern, moment, min(active) as active from events group by all),
met as (
  select p.page_id, p.url, p.fetched, s.list, s.verdict, s.kind, s.pattern, arg_max(s.active, s.moment) as active
  from p join state s on s.moment <= p.fetched and p.host <> '' and case s.kind
    when 'host' then s.pattern = p.host
    when 'domain' then p.host = s.pattern or suffix(p.host, '.' || s.pattern)
    else split_part(s.pattern, '/', 1) = p.host and list_aggregate(p.parts, 'string_agg', '/') || '/' like substr(s.pattern, instr(s.pattern, '/') + 1) || '/%' end
  group by all),
found as (
  select page_id, url, fetched, count(*) as n_entries, bool_or(verdict = 'block') and not bool_or(verdict = 'allow') as blocked,
    string_agg(distinct list, ',' order by list) as lists
  from met where active = 1 group by all)
select p.page_id, coalesce(blocked, false) as blocked, coalesce(n_entries, 0) as n_entries, coalesce(lists, '') as lists
from p left join found f on p.page_id = f.page_id and p.url = f.url and p.fetched = f.fetched
"""


@query("op1_temporal_list", URL_SQL)
def op1(spark, sf_dir):
    """Every page against the list entries that were active when it was fetched."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("host")).filter("host <> ''").distinct()
    events = spark.sql(EVENTS.replace("from hosts", "from {hosts}"), hosts=hosts)
    captures = pages.select(F.col("page_id").alias("capture_id"), "url", F.expr(FETCHED).alias("fetched"))
    return url_filter.url_filter(captures, events).withColumnRenamed("capture_id", "page_id")

"""One query per operator, each with the SQL that gives the same rows.

A query is registered by ``@query(sql)`` under its function's name.
"""

from __future__ import annotations

import atexit
import json
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, sizes as S, text as X
from ..functions import hashing as H
from ..operators import catalog, layout, lifecycle, lookup, metrics, protocol, snapshot, store
from ..sources import kv, readers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; a local master may do without the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="stillwater-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        base = f"file://{local}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def key8(c: str):
    return F.lpad(F.col(c).cast("string"), 8, "0")


def order_pairs(spark, sf) -> DataFrame:
    return t(spark, sf, "orders").select(key8("o_orderkey").alias("key"), F.concat_ws("|", "o_custkey", "o_orderstatus", "o_orderpriority").alias("value"))


def order_requests(spark, sf) -> DataFrame:
    k = t(spark, sf, "lineitem").select("l_orderkey").distinct()
    return k.select(key8("l_orderkey").alias("key")).unionByName(k.select(F.lpad((F.col("l_orderkey") + 50_000_000).cast("string"), 8, "0").alias("key")))


ORD = "(select lpad(o_orderkey::varchar, 8, '0') as key, o_custkey::varchar || '|' || o_orderstatus || '|' || o_orderpriority as value from orders)"
REQ = "(select lpad(k::varchar, 8, '0') as key from (select distinct l_orderkey as k from lineitem union all select distinct l_orderkey + 50000000 from lineitem))"


def fp_sql(source: str, seed: int = 0, out: str = "fp") -> str:
    return f"({H.xxh64_sql(source, 'key', seed, out)})"


def u(fp: str) -> str:
    return f"({fp}::hugeint + case when {fp} < 0 then 18446744073709551616::hugeint else 0::hugeint end)"


def high(fp: str) -> str:
    return f"({u(fp)} // 4294967296)::bigint"


def enc(n: str) -> str:
    return f"((({n} + 12 + 7) // 8) * 8)::bigint"


# ------------------------------------------------------------------ lookups and fingerprints


@query(f"select r.key, (r.fp & 63)::int as partition_id, case when o.key is null then 'miss' else 'hit' end as status, o.value from {fp_sql(REQ)} r left join {ORD} o on r.key = o.key")
def kv_lookup_hit_miss(spark, sf):
    found = lookup.lookup(order_requests(spark, sf), layout.addressed(order_pairs(spark, sf), 64), 64)
    return found.select("key", "partition_id", "status", "value")


@query(f"select key, fp, vfp as vfp4, case when vfp = 0 then 1 else vfp end as vfp5 from {fp_sql(fp_sql(ORD), H.VERIFY_SEED, 'vfp')}")
def fingerprint_verify(spark, sf):
    k = F.col("key")
    return order_pairs(spark, sf).select("key", H.fingerprint(k).alias("fp"), H.verify_fingerprint(k, 4).alias("vfp4"), H.verify_fingerprint(k, 5).alias("vfp5"))


@query(f"select key, fence, case when fence = 0 then 1 else fence end as cfp, (case when fence = 0 then 1 else fence end) % 1021 as home from (select key, {high('fp')} as fence from {fp_sql(ORD)})")
def compact_fp_fence(spark, sf):
    fp = H.fingerprint(F.col("key"))
    cfp = H.compact_fingerprint(fp)
    return order_pairs(spark, sf).select("key", H.fence(fp).alias("fence"), cfp.alias("cfp"), H.home_position(cfp, F.lit(1021)).alias("home"))


CUST = "(select lpad(c_custkey::varchar, 8, '0') as key, c_name as value from customer)"


@query(f"select (fp & 15)::int as partition_id, count(*) as n_keys, sum(strlen(value))::bigint as sum_bytes, min(strlen(value))::bigint as min_bytes, max(strlen(value))::bigint as max_bytes, (sum(strlen(value)) // count(*))::bigint as mean_bytes from {fp_sql(CUST)} group by 1")
def partition_stats(spark, sf):
    pairs = t(spark, sf, "customer").select(key8("c_custkey").alias("key"), F.col("c_name").alias("value"))
    return layout.partition_stats(layout.addressed(pairs, 16))


def doc_lengths(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.octet_length("text").cast("long").alias("length"))


_LES = ", ".join(map(str, layout.LES))


@query(f"with d as (select greatest(strlen(text), 1) as n from documents) select le::bigint as le, (select count(*) from d where n <= le) as n from unnest([{_LES}]) x(le) union all select null, count(*) from d where n > {layout.LES[-1]}")
def size_histogram_le(spark, sf):
    return layout.size_histogram(doc_lengths(spark, sf))


@query("select doc_id, strlen(text)::bigint as length, (((strlen(text) + 12 + 63) // 64) * 64)::bigint as aligned from documents")
def v4_record_sizes(spark, sf):
    return doc_lengths(spark, sf).withColumn("aligned", S.aligned_size(F.col("length")))


def placed_orders(spark, sf, n):
    return layout.addressed(order_pairs(spark, sf), n).withColumn("length", F.octet_length("value").cast("long"))


@query(f"select key, p as partition_id, (coalesce(sum(a) over (partition by p order by key rows between unbounded preceding and 1 preceding), 0) // 64)::bigint as offset_units from (select key, (fp & 15)::int as p, ((strlen(value) + 12 + 63) // 64) * 64 as a from {fp_sql(ORD)})")
def v4_offsets(spark, sf):
    return layout.record_offsets(placed_orders(spark, sf, 16), "key", F.substring("key", 1, 5)).select("key", "partition_id", "offset_units")


@query(f"select partition_id, n_keys, buckets, buckets * 8 as index_bytes, coalesce(sum(((buckets * 8 + 2097151) // 2097152) * 2097152) over (order by partition_id rows between unbounded preceding and 1 preceding), 0)::bigint as index_offset from (select (fp & 63)::int as partition_id, count(*) as n_keys, (count(*) * 20 + 18) // 19 as buckets from {fp_sql(ORD)} group by 1)")
def v4_index_layout(spark, sf):
    return layout.index_layout(layout.partition_stats(placed_orders(spark, sf, 64))).select("partition_id", "n_keys", "buckets", "index_bytes", "index_offset")


@query("select lpad(l_orderkey::varchar, 8, '0') || '-' || l_linenumber::varchar as key, count(*) as n from lineitem group by 1 having count(*) > 1")
def dup_key_guard(spark, sf):
    return layout.duplicate_keys(t(spark, sf, "lineitem").select(F.concat_ws("-", key8("l_orderkey"), "l_linenumber").alias("key")))


@query(f"select length(bin({enc('strlen(text)')}))::bigint as bucket, count(*) as n from documents group by 1")
def v5_encoded_sizes_log2(spark, sf):
    return layout.size_classes(doc_lengths(spark, sf))


@query(f"with c as (select length(bin({enc('strlen(text)')}))::bigint as b, count(*) as n from documents group by 1), w as (select b, sum(n) over (order by b) as cum, sum(n) over () as tot from c) select coalesce(least(greatest((2 ** (min(b) + 1))::bigint, 4096), 65536), 4096)::bigint as block_size from w where 2 * cum >= tot")
def block_size_autotune(spark, sf):
    return layout.block_size(layout.size_classes(doc_lengths(spark, sf)))


DOCKEY = "(select lpad(doc_id::varchar, 8, '0') as key, strlen(text)::bigint as length from documents)"


@query(f"select key, partition_id, ool as out_of_line, {enc('case when ool then 12 else length end')} as stored_length, case when ool then coalesce(sum(case when ool then length else 0 end) over (partition by partition_id order by uf, key rows between unbounded preceding and 1 preceding), 0)::bigint end as heap_offset from (select key, (fp & 3)::int as partition_id, length, length > 2048 as ool, {u('fp')} as uf from {fp_sql(DOCKEY)})")
def inline_vs_heap(spark, sf):
    docs = t(spark, sf, "documents").select(key8("doc_id").alias("key"), F.octet_length("text").cast("long").alias("length"))
    out = layout.heap_offsets(layout.inlined(layout.addressed(docs, 4), 4096))
    return out.select("key", "partition_id", "out_of_line", "stored_length", "heap_offset")


PACK = f"""with recursive r as (select key, p, size, {u('fp')} as uf, fp, row_number() over (partition by p order by {u('fp')}, key) as rn,
    sum(size) over (partition by p order by {u('fp')}, key rows unbounded preceding) as cum
  from (select key, fp, (fp & 3)::int as p, {enc('strlen(value)')} as size from {fp_sql(ORD)})),
b as (select p, 0::bigint as block, 0::hugeint as base, 1::bigint as first_rn from r group by p
  union all select b.p, any_value(b.block) + 1, min(r.cum - r.size), min(r.rn) from b join r on r.p = b.p and r.rn > b.first_rn and r.cum - b.base > 4092 group by b.p),
k as (select r.key, r.p as partition_id, r.fp, r.uf, b.block, (r.cum - r.size - b.base)::bigint as block_offset
  from r asof join b on r.p = b.p and r.rn >= b.first_rn)"""


def packed_orders(spark, sf):
    placed = placed_orders(spark, sf, 4).select("key", "fp", "partition_id", S.encoded_length(F.col("length")).alias("stored_length"))
    return layout.packed_blocks(placed, 4096)


@query(f"{PACK} select key, partition_id, block, block_offset from k")
def v5_block_packing(spark, sf):
    return packed_orders(spark, sf).select("key", "partition_id", "block", "block_offset")


FENCES = f"{PACK}, f as (select partition_id, block, min({high('fp')}) as fence, count(*) as n_records from k group by 1, 2)"


@query(f"{FENCES} select * from f")
def v5_fences(spark, sf):
    return layout.block_fences(packed_orders(spark, sf))


def probes(spark, sf):
    req = order_requests(spark, sf).withColumn("fp", H.fingerprint(F.col("key")))
    return req.withColumn("partition_id", H.partition_of(F.col("fp"), 4))


CAND = f"""{FENCES}, q as (select key, (fp & 3)::int as partition_id, {high('fp')} as h from {fp_sql(REQ)}),
c as (select q.key, q.partition_id, f.block, 0 as back from q join f on f.partition_id = q.partition_id and f.fence = q.h
  union all select q.key, q.partition_id, max(f.block), 1 from q join f on f.partition_id = q.partition_id and f.fence < q.h group by 1, 2)"""


@query(f"{CAND} select key, partition_id, block, row_number() over (partition by key order by back, block) as ordinal from c")
def candidate_blocks(spark, sf):
    return layout.candidate_blocks(probes(spark, sf), layout.block_fences(packed_orders(spark, sf)))


@query(f"{CAND}, n as (select key, count(*) as reads from c group by 1) select q.key, case when o.key is null then 'miss' else 'hit' end as status, coalesce(reads, 0)::bigint as reads, o.key is null and coalesce(reads, 0) > 0 as io from q left join n using (key) left join {ORD} o on o.key = q.key")
def lookup_cost_no_sketch(spark, sf):
    fences = layout.block_fences(packed_orders(spark, sf))
    found = lookup.lookup(order_requests(spark, sf), layout.addressed(order_pairs(spark, sf), 4), 4)
    return lookup.lookup_cost(found, layout.candidate_blocks(probes(spark, sf), fences)).select("key", "status", "reads", "io")


@query(f"select ({u('fp')} // 1152921504606846976)::bigint as bucket, count(*) as n from {fp_sql(ORD)} group by 1")
def radix_buckets(spark, sf):
    n = S.radix_buckets(16 * S.RADIX_TARGET)
    return order_pairs(spark, sf).groupBy(H.radix_bucket(H.fingerprint(F.col("key")), n).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"select count(*) as n_hits, count(*) as n_kept from {REQ} r join {ORD} o using (key)")
def bloom_prefilter(spark, sf):
    snap = layout.addressed(order_pairs(spark, sf), 4)
    buckets = store.filter_buckets(snap)
    kept = store.filtered(probes(spark, sf), store.partition_filters(snap, buckets), buckets).select("key", F.lit(1).alias("kept"))
    hits = order_requests(spark, sf).join(snap.select("key"), "key")
    return hits.join(kept, "key", "left").agg(F.count("*").alias("n_hits"), F.count("kept").alias("n_kept"))


@query(f"select key, ({u('fp')} % 4294967296)::bigint as checksum from {fp_sql(ORD)}")
def checksum32(spark, sf):
    return order_pairs(spark, sf).select("key", H.checksum32(F.col("key")).alias("checksum"))


# ------------------------------------------------------------------ catalog, protocol, metrics


def conversation_catalog(spark, sf):
    c = t(spark, sf, "conversations").where("conv_id % 3 <> 0").select("conv_id").distinct()
    return c.select(F.concat(F.lit("conv-"), F.col("conv_id") % 5).alias("dataset"), F.col("conv_id").cast("string").alias("key_prefix"), F.lit("v1").alias("version_id"), F.lit("/m").alias("mount_path"))


@query("select conv_id || ':' || turn as key, conv_id::varchar as prefix, turn::varchar as bare_key, case when conv_id % 3 <> 0 then 'conv-' || (conv_id % 5) end as dataset, case when conv_id % 3 <> 0 then 'routed' else 'unknown' end as outcome from conversations union all select 'nocolon', null, null, null, 'no_prefix' union all select 'ds:key:with:colons', 'ds', 'key:with:colons', null, 'unknown'")
def prefix_route(spark, sf):
    keys = t(spark, sf, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("key"))
    extra = spark.createDataFrame([("nocolon",), ("ds:key:with:colons",)], "key string")
    return catalog.route(keys.unionByName(extra), conversation_catalog(spark, sf))


def lookups(spark, sf):
    e = t(spark, sf, "events")
    dataset = F.when(F.col("event_id") % 7 != 0, F.col("event_type"))
    return e.select(dataset.alias("dataset"), F.element_at(F.array(F.lit("hit"), F.lit("miss"), F.lit("miss_io")), (F.col("event_id") % 3 + 1).cast("int")).alias("result"), "value", "event_type")


LOOK = "(select case when event_id % 7 <> 0 then event_type end as dataset, case event_id % 3 when 0 then 'hit' when 1 then 'miss' else 'miss_io' end as result, value, event_type from events)"


@query(f"select coalesce(dataset, '_unknown') as dataset, result, count(*) as n from {LOOK} group by 1, 2")
def unknown_prefix_counts(spark, sf):
    return metrics.lookup_counts(lookups(spark, sf))


@query(f"select dataset, case when count(*) filter (where result <> 'hit') > 0 then (count(*) filter (where result = 'miss_io') * 1000000 // count(*) filter (where result <> 'hit'))::bigint end as ratio_ppm from {LOOK} group by 1")
def miss_io_ratio(spark, sf):
    return metrics.miss_io_ratio(lookups(spark, sf))


def _hist_sql(source: str, value: str, bounds: list, by: str) -> str:
    k = f"{by}, " if by else ""
    parts = [f"select {k}{i}::bigint as bucket, count(*) filter (where {value} <= {b}::double) as n from {source} {'group by ' + by if by else ''}" for i, b in enumerate(bounds)]
    return " union all ".join([*parts, f"select {k}{len(bounds)}::bigint, count({value}) from {source} {'group by ' + by if by else ''}"])


@query(_hist_sql(LOOK, "(value / 1000.0::double)", metrics.LATENCY_SECONDS, "result"))
def latency_histogram(spark, sf):
    return metrics.histogram(lookups(spark, sf), F.col("value") / F.lit(1000.0), metrics.LATENCY_SECONDS, ["result"])


@query(_hist_sql("documents", "strlen(text)", metrics.RESPONSE_BYTES, ""))
def response_bytes_histogram(spark, sf):
    return metrics.histogram(doc_lengths(spark, sf), F.col("length"), metrics.RESPONSE_BYTES, [])


def _part_catalog(spark, sf, keep: str, version: str):
    return t(spark, sf, "part").where(keep).select(
        F.col("p_brand").alias("dataset"), F.concat(F.lit("p"), "p_partkey").alias("key_prefix"), F.concat(F.lit("v"), F.expr(version)).alias("version_id"), F.lit("/m").alias("mount_path")
    )


def _old_new(spark, sf):
    return _part_catalog(spark, sf, "p_partkey % 7 <> 0", "p_size"), _part_catalog(spark, sf, "p_partkey % 5 <> 0", "p_size + if(p_partkey % 3 = 0, 1, 0)")


OLD = "(select p_brand as dataset, 'p' || p_partkey as key_prefix, 'v' || p_size as version_id from part where p_partkey % 7 <> 0)"
NEW = "(select p_brand as dataset, 'p' || p_partkey as key_prefix, 'v' || (p_size + case when p_partkey % 3 = 0 then 1 else 0 end) as version_id from part where p_partkey % 5 <> 0)"


@query(f"select coalesce(a.key_prefix, b.key_prefix) as key_prefix, case when a.key_prefix is null then 'added' when b.key_prefix is null then 'removed' when a.version_id = b.version_id then 'unchanged' else 'updated' end as change, a.version_id as old_version, b.version_id as new_version from {OLD} a full join {NEW} b on a.key_prefix = b.key_prefix")
def catalog_diff(spark, sf):
    return catalog.diff(*_old_new(spark, sf))


@query("select p_brand as key_prefix, count(*) as n from part group by 1 having count(*) > 1")
def catalog_duplicate_prefix(spark, sf):
    return catalog.duplicate_prefixes(t(spark, sf, "part").select(F.col("p_brand").alias("key_prefix")))


@query("select n_name as dataset, 'v' || n_regionkey as version_id, strftime(timestamp '2024-01-15 10:30:00' + to_hours(n_nationkey), '%Y-%m-%dT%H:%M:%SZ') as loaded_at from nation")
def version_endpoint(spark, sf):
    at = F.expr("timestamp '2024-01-15 10:30:00' + make_interval(0, 0, 0, 0, n_nationkey)")
    return catalog.versions(t(spark, sf, "nation").select(F.col("n_name").alias("dataset"), F.concat(F.lit("v"), "n_regionkey").alias("version_id"), at.alias("loaded_at")))


LINE = """case event_id % 8 when 0 then 'mg k' || event_id || ' v t' when 1 then 'mg  k' || event_id || ' k v N300' when 2 then 'version'
 when 3 then 'ms k' || event_id || ' 5 T0' when 4 then 'md k' || event_id when 5 then 'mg k' || event_id
 when 6 then case when event_id % 64 = 6 then 'quit' else 'mg k' || event_id || ' h' end else case when event_id % 128 = 7 then 'bogus' else 'ma k' || event_id end end"""


def command_lines(spark, sf):
    return t(spark, sf, "events").select(F.col("user_id").alias("conn"), F.col("event_id").alias("seq"), F.expr(LINE).alias("line"))


@query(f"""with l as (select user_id as conn, event_id as seq, {LINE} as line, string_split_regex({LINE}, ' +') as w from events),
p as (select *, case when w[1] = 'mg' then 'get' when line = 'version' then 'version' when line = 'quit' then 'quit' when w[1] in ('ms', 'md', 'ma') then 'write_rejected' else 'error' end as kind from l),
e as (select *, coalesce(max(case when kind in ('error', 'quit') then 1 else 0 end) over (partition by conn order by seq rows between unbounded preceding and 1 preceding), 0) as ended from p)
select conn, seq, line, kind, case when kind = 'get' then w[2] end as key, kind = 'get' and list_contains(w[3:], 'v') as flag_v, kind = 'get' and list_contains(w[3:], 't') as flag_t,
kind = 'get' and list_contains(w[3:], 'h') as flag_h, kind = 'get' and list_contains(w[3:], 'k') as flag_k, case when w[1] = 'ms' then w[3]::bigint else 0 end as body_bytes from e where ended = 0""")
def mg_parse(spark, sf):
    return protocol.commands(command_lines(spark, sf))


RESP = f"""(select r.key, case when o.key is null then 'EN' || chr(13) || chr(10) else 'VA ' || strlen(o.value) || case when right(r.key, 1) in ('0', '1', '2', '3', '4') then ' k' || r.key else '' end
 || case when right(r.key, 1) in ('0', '5') then ' t-1' else '' end || chr(13) || chr(10) || o.value || chr(13) || chr(10) end as response, o.value from {REQ} r left join {ORD} o on r.key = o.key)"""


def responses(spark, sf):
    found = lookup.lookup(order_requests(spark, sf), layout.addressed(order_pairs(spark, sf), 64), 64)
    last = F.substring("key", -1, 1)
    text = protocol.response(F.lit("get"), F.col("key"), F.col("value"), F.col("status"), last < "5", last.isin("0", "5"))
    return found.select("key", text.alias("response"))


@query(f"select key, response from {RESP}")
def mg_response(spark, sf):
    return responses(spark, sf)


@query(f"select key, case when value is null then 'miss' else 'hit' end as outcome, value, strlen(value)::bigint as declared from {RESP}")
def client_response_parse(spark, sf):
    return responses(spark, sf).select("key", *[c.alias(n) for n, c in protocol.client_parsed(F.col("response")).items()])


@query("""with g as (select user_id % 10 as part, ts as effective, row_number() over (partition by user_id % 10 order by ts, event_id) as generation from events where event_id % 50 = 0)
select e.event_id, (select max(g.generation) from g where g.part = e.user_id % 10 and g.effective <= e.ts) as generation from events e where e.event_id % 50 <> 0""")
def generation_asof(spark, sf):
    from pyspark.sql import Window

    e = t(spark, sf, "events").withColumn("part", F.col("user_id") % 10)
    g = e.where("event_id % 50 = 0").select("part", F.col("ts").alias("effective"), F.row_number().over(Window.partitionBy("part").orderBy("ts", "event_id")).alias("generation"))
    return catalog.generation_at(e.where("event_id % 50 <> 0").select("part", "event_id", "ts"), g, "ts").select("event_id", "generation")


METRIC_TEXT = [
    "# HELP requests_total All requests", "# TYPE requests_total counter", 'requests_total{result="hit"} 12', 'requests_total_total{result="miss"} 3 1700000000', "",
    "# HELP up Is it up", "up 1", "nohelp 2.5 99", "broken", 'open{brace 1', "  padded   7  ", "# EOF",
]


@query("""select 1::bigint as doc, pos::bigint as pos, name, value, help from (values (3, 'requests_total{result="hit"}', '12', 'All requests'), (4, 'requests_total_total{result="miss"}', '3', 'All requests'),
(7, 'up', '1', 'Is it up'), (8, 'nohelp', '2.5', ''), (11, 'padded', '7', '')) v(pos, name, value, help)""")
def metrics_text_parse(spark, sf):
    lines = spark.createDataFrame([(1, k + 1, x) for k, x in enumerate(METRIC_TEXT)], "doc long, pos long, line string")
    return metrics.parse_text(lines)


@query("""select 0 as ord, '# HELP kv_lookup_total Lookup outcomes by dataset and result' as line union all select 1, '# TYPE kv_lookup_total counter'
union all select 2, 'kv_lookup_total{dataset="' || dataset || '",result="' || result || '"} ' || n from (select coalesce(dataset, '_unknown') as dataset, result, count(*) as n from """ + LOOK + " group by 1, 2)")
def metrics_exposition(spark, sf):
    return metrics.exposition(metrics.lookup_counts(lookups(spark, sf)), "kv_lookup_total", "Lookup outcomes by dataset and result", ["dataset", "result"])


@query("select case when user_id % 2 = 0 then 'unix' else 'tcp' end as transport, count(*) filter (where event_id % 3 <> 2) as total, count(*) filter (where event_id % 3 <> 2) - count(*) filter (where event_id % 3 = 2) as active from events group by 1")
def connection_counts(spark, sf):
    e = t(spark, sf, "events").select(F.when(F.col("user_id") % 2 == 0, "unix").otherwise("tcp").alias("transport"), F.when(F.col("event_id") % 3 == 2, "close").otherwise("open").alias("event"))
    return metrics.connection_counts(e)


@query("""select doc_id, p as printable, sha256(case when p then x else lower(hex(encode(x))) end) as shown_sha256, strlen(case when p then x else lower(hex(encode(x))) end)::bigint as shown_bytes
from (select doc_id, x, not regexp_matches(x, '[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F]') as p from (select doc_id, case when doc_id % 5 = 0 then chr(1) || text else text end as x from documents))""")
def display_value(spark, sf):
    x = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("\x01"), "text")).otherwise(F.col("text")).cast("binary")
    return t(spark, sf, "documents").select("doc_id", X.printable(x).alias("printable"), F.sha2(X.display_value(x), 256).alias("shown_sha256"), F.octet_length(X.display_value(x)).cast("long").alias("shown_bytes"))


_RES = "rtrim(left(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), 253), '-')"


@query(f"select page_id, {_RES.format(chr(39) + 'build-' + chr(39) + ' || url || ' + chr(39) + '-v1' + chr(39))} as name, {_RES.format(chr(39) + 'va-' + chr(39) + ' || url')} as attachment, regexp_full_match(url, '[a-z0-9._-]+') as valid, 'part-' || lpad((page_id % 64)::varchar, 2, '0') as dir from pages")
def resource_names(spark, sf):
    return t(spark, sf, "pages").select(
        "page_id", X.resource_name(F.lit("build"), F.col("url"), F.lit("v1")).alias("name"), X.attachment_name(F.col("url")).alias("attachment"),
        X.valid_name(F.col("url")).alias("valid"), S.partition_dir(F.col("page_id") % 64, 64).alias("dir"),
    )


# ------------------------------------------------------------------ lifecycle


def order_versions(spark, sf, dataset: str, states: dict[str, str]):
    state = F.create_map(*[F.lit(x) for kv_ in states.items() for x in kv_])[F.col("o_orderstatus")]
    return t(spark, sf, "orders").select(F.expr(dataset).alias("dataset"), F.concat(F.lit("v"), "o_orderkey").alias("version_id"), F.col("o_orderdate").alias("created"), state.alias("state"))


def _versions_sql(dataset: str, states: dict[str, str]) -> str:
    case = " ".join(f"when '{a}' then '{b}'" for a, b in states.items())
    return f"(select {dataset} as dataset, 'v' || o_orderkey as version_id, o_orderdate as created, case o_orderstatus {case} end as state from orders)"


_DS, _S1 = "'ds-' || (o_orderkey % 500)", {"O": "active", "F": "retired", "P": "ready"}


@query(f"select v.dataset, v.version_id, p.p_brand as key_prefix from {_versions_sql(_DS, _S1)} v join part p on v.dataset = 'ds-' || p.p_partkey where v.state = 'active'")
def active_join_dataset(spark, sf):
    datasets = t(spark, sf, "part").select(F.concat(F.lit("ds-"), "p_partkey").alias("dataset"), F.col("p_brand").alias("key_prefix"))
    return lifecycle.active_versions(order_versions(spark, sf, _DS, _S1), datasets).select("dataset", "version_id", "key_prefix")


@query("""with n as (select s_suppkey as node, s_nationkey as nation, s_suppkey % 3 as tier from supplier), d as (select p_partkey as dataset, p_size % 4 as size from part),
b as (select n_nationkey as k from nation where n_nationkey % 5 <> 0), m as (select n.node, b.k from n join b on n.nation = b.k and (b.k % 4 <> 1 or n.tier = 1)),
x as (select distinct m.node, d.dataset from m join d on m.k % 3 <> 1 or d.size = m.k % 4)
select node, dataset from x union all select n.node, d.dataset from n cross join d where n.node not in (select node from m)""")
def node_assignments(spark, sf):
    s, m = (lambda c: F.col(c).cast("string")), F.create_map
    nodes = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"), m(F.lit("nation"), s("s_nationkey"), F.lit("tier"), (F.col("s_suppkey") % 3).cast("string")).alias("labels"))
    data = t(spark, sf, "part").select(F.col("p_partkey").alias("dataset"), m(F.lit("brand"), F.col("p_brand"), F.lit("size"), (F.col("p_size") % 4).cast("string")).alias("dataset_labels"))
    k = F.col("n_nationkey")
    on_node = F.when(k % 4 == 1, m(F.lit("nation"), s("n_nationkey"), F.lit("tier"), F.lit("1"))).otherwise(m(F.lit("nation"), s("n_nationkey")))
    on_data = F.when(k % 3 == 1, m(F.lit("size"), (k % 4).cast("string"))).when(k % 3 == 2, F.expr("cast(map() as map<string,string>)"))
    bindings = t(spark, sf, "nation").where("n_nationkey % 5 <> 0").select(k.alias("binding"), on_node.alias("node_selector"), on_data.alias("dataset_selector"))
    return lifecycle.assignments(nodes, data, bindings)


def node_states(spark, sf):
    e = t(spark, sf, "events").select(
        (F.col("user_id") % 120).alias("node"), F.concat(F.lit("d"), F.col("event_id") % 3).alias("dataset"), F.concat(F.lit("v"), F.col("event_id") % 4).alias("version_id"),
        F.expr("case event_id % 5 when 0 then 'error' when 1 then 'active' when 2 then 'active' else 'mounting' end").alias("phase"), "ts", "event_id",
        F.concat_ws("/", F.col("user_id") % 120, F.col("event_id") % 3).alias("k"),
    )
    return lifecycle.latest(e, "k", [F.desc("ts"), F.desc("event_id")])


STATES = "(select node, dataset, version_id, phase from (select user_id % 120 as node, 'd' || (event_id % 3) as dataset, 'v' || (event_id % 4) as version_id, case event_id % 5 when 0 then 'error' when 1 then 'active' when 2 then 'active' else 'mounting' end as phase, row_number() over (partition by user_id % 120, event_id % 3 order by ts desc, event_id desc) as r from events) where r = 1)"
WANT = "(select 'd' || a as dataset, 'v' || b as version_id from range(3) x(a), range(4) y(b))"


def wanted(spark):
    return spark.range(12).select(F.concat(F.lit("d"), F.expr("id div 4")).alias("dataset"), F.concat(F.lit("v"), F.col("id") % 4).alias("version_id"))


@query(f"""with s as {STATES}, w as {WANT}, n as (select distinct s_suppkey as node from supplier)
select w.dataset, w.version_id, count(*) as total, count(*) filter (where phase = 'error') as error, count(*) filter (where phase = 'active' and s.version_id = w.version_id) as converged,
count(*) - count(*) filter (where phase = 'error') - count(*) filter (where phase = 'active' and s.version_id = w.version_id) as pending
from w cross join n left join s on s.node = n.node and s.dataset = w.dataset group by 1, 2""")
def rollout_status(spark, sf):
    nodes = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"))
    return lifecycle.rollout(nodes, node_states(spark, sf).select("node", "dataset", "version_id", "phase"), wanted(spark))


_HELD = "not exists (select 1 from s where s.dataset = w.dataset and s.version_id = w.version_id)"


@query(f"""with s as {STATES} select dataset, version_id, {_HELD} as drained, {_HELD} and not exists (select 1 from supplier where s_suppkey not in (select node from s)) as drained_everywhere from {WANT} w""")
def drained_versions(spark, sf):
    """Over the nodes that have reported, and over all nodes, some of which may be silent."""
    states = node_states(spark, sf).select("node", "dataset", "version_id")
    known = lifecycle.drained(states.select("node").distinct(), states, wanted(spark))
    everywhere = lifecycle.drained(t(spark, sf, "supplier").select(F.col("s_suppkey").alias("node")), states, wanted(spark))
    return known.join(everywhere.withColumnRenamed("drained", "drained_everywhere"), ["dataset", "version_id"])


@query("select o_orderkey, 'pv-' || (o_orderkey % 1000) as volume from orders where o_orderstatus = 'F' and 'pv-' || (o_orderkey % 1000) not in (select 'pv-' || (l_orderkey % 1000) from lineitem where l_quantity > 49)")
def retire_ready(spark, sf):
    v = t(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("pv-"), F.col("o_orderkey") % 1000).alias("volume"), F.when(F.col("o_orderstatus") == "F", "retired").otherwise("active").alias("state"))
    a = t(spark, sf, "lineitem").where("l_quantity > 49").select(F.concat(F.lit("pv-"), F.col("l_orderkey") % 1000).alias("volume"))
    return lifecycle.retirable(v, a).select("o_orderkey", "volume")


_S2 = {"F": "retired", "O": "retired", "P": "active"}


@query(f"select dataset, version_id from (select *, row_number() over (partition by dataset order by created desc, version_id desc) as r from {_versions_sql('o_custkey', _S2)} where state = 'retired') where r > 3")
def retention_excess(spark, sf):
    return lifecycle.retention_excess(order_versions(spark, sf, "o_custkey", _S2), 3).select("dataset", "version_id")


@query("""with v as (select o_custkey as dataset, o_orderkey % 10 as n, o_orderstatus as s from orders)
select c_custkey as dataset, 'v' || (coalesce(max(n), 0) + 1) as version_id from customer left join v on v.dataset = c_custkey where c_custkey not in (select dataset from v where s = 'P') group by 1""")
def ensure_version(spark, sf):
    v = t(spark, sf, "orders").select(
        F.col("o_custkey").alias("dataset"), F.concat(F.lit("v"), F.col("o_orderkey") % 10, F.lit("-x")).alias("version_id"),
        F.expr("case o_orderstatus when 'P' then 'building' else 'retired' end").alias("state"),
    )
    return lifecycle.next_versions(t(spark, sf, "customer").select(F.col("c_custkey").alias("dataset")), v)


_S3 = {"O": "ready", "F": "active", "P": "retired"}


@query(f"""with v as {_versions_sql('o_custkey', _S3)}, w as (select *, row_number() over (partition by dataset, state order by created desc, version_id desc) as r, max(case when state = 'ready' then 1 else 0 end) over (partition by dataset) as any_ready from v)
select dataset, version_id, case when any_ready = 0 then state when state = 'ready' and r = 1 then 'active' when state in ('ready', 'active') then 'retired' else state end as state from w""")
def promote_latest_ready(spark, sf):
    return lifecycle.promoted(order_versions(spark, sf, "o_custkey", _S3)).select("dataset", "version_id", "state")


@query(f"""with v as {_versions_sql('o_custkey', _S3)} select dataset, version_id as active_version from (select *, row_number() over (partition by dataset order by created desc, version_id desc) as r from v where state = 'active') where r = 1""")
def active_version(spark, sf):
    return lifecycle.active_of(order_versions(spark, sf, "o_custkey", _S3))


_EVENT = "case event_id % 6 when 0 then 'start' when 1 then 'done' when 2 then 'promote' when 3 then 'retire' when 4 then 'drop' else 'fail' end"


@query(f"""with recursive e as (select user_id as version, ts as tm, {_EVENT} as event, row_number() over (partition by user_id order by event_id) as rn from events),
s as (select version, 0::bigint as rn, '' as state, null::timestamp as since, 0::bigint as moves from (select distinct version from e)
  union all select version, rn, nxt, case when state = '' and nxt = 'building' then tm else since end, moves + case when nxt <> state then 1 else 0 end from (
    select s.version, e.rn, s.state, s.since, s.moves, e.tm, case when s.state = '' and e.event = 'start' then 'building' when s.state = 'building' and (epoch(date_trunc('second', e.tm))::bigint - epoch(date_trunc('second', s.since))::bigint > 1800 or e.event = 'fail') then 'failed'
      when s.state = 'building' and e.event = 'done' then 'ready' when s.state = 'ready' and e.event = 'promote' then 'active' when s.state = 'active' and e.event = 'retire' then 'retired' when s.state = 'retired' and e.event = 'drop' then 'deleted' else s.state end as nxt
    from s join e on e.version = s.version and e.rn = s.rn + 1))
select version, arg_max(state, rn) as state, max(moves) as moves from s group by 1""")
def version_state_fold(spark, sf):
    e = t(spark, sf, "events").select(F.col("user_id").alias("version"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), F.expr(_EVENT).alias("event"))
    return lifecycle.fold_version(e)


@query("select event_id, sum(c) over (partition by user_id order by event_id)::bigint as generation from (select user_id, event_id, case when event_type is not distinct from lag(event_type) over (partition by user_id order by event_id) then 0 else 1 end as c from events)")
def broker_generations(spark, sf):
    return lifecycle.generations(t(spark, sf, "events"), "user_id", ["event_id"], F.col("event_type")).select("event_id", "generation")


@query("select o_custkey as dataset, strftime(o_orderdate, '%Y%m%d-%H%M%S') as version_id from orders where o_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def cron_fire_guard(spark, sf):
    o = t(spark, sf, "orders")
    due = o.select(F.col("o_custkey").alias("dataset"), F.col("o_orderdate").alias("at"))
    v = o.select(F.col("o_custkey").alias("dataset"), F.when(F.col("o_orderstatus") == "P", "building").otherwise("ready").alias("state"))
    return lifecycle.schedule_fires(due, v).select("dataset", "version_id")


@query("select n_name as dataset, row_number() over (order by n_name) - 1 as delay from nation")
def catch_up_delays(spark, sf):
    return lifecycle.catch_up_delays(t(spark, sf, "nation").select(F.col("n_name").alias("dataset"))).select("dataset", F.col("delay").cast("long").alias("delay"))


@query("select i::bigint as attempt, least(2 ** (i - 1), 30)::bigint as seconds, (least(0.5 * 2 ** (i - 1), 5) * 1000)::bigint as unmount_ms from range(1, 13) x(i)")
def backoff_schedule(spark, sf):
    a = F.col("id")
    return spark.range(1, 13).select(a.alias("attempt"), lifecycle.backoff(a, *lifecycle.BACKOFF).cast("long").alias("seconds"), (lifecycle.backoff(a, *lifecycle.UNMOUNT_BACKOFF) * 1000).cast("long").alias("unmount_ms"))


_NODE = "case event_id % 4 when 0 then 'assign' when 1 then 'attached' when 2 then 'mounted' else 'failed' end"


@query(f"""with recursive e as (select user_id as node, {_NODE} as event, row_number() over (partition by user_id order by event_id) as rn from events),
s as (select node, 0::bigint as rn, '' as phase, 0::bigint as moves from (select distinct node from e)
  union all select node, rn, nxt, moves + case when nxt <> phase then 1 else 0 end from (select s.node, e.rn, s.phase, s.moves,
    case when e.event = 'assign' then 'attaching' when s.phase = 'attaching' and e.event = 'attached' then 'mounting' when s.phase = 'mounting' and e.event = 'mounted' then 'active'
      when s.phase in ('attaching', 'mounting') and e.event = 'failed' then 'error' else s.phase end as nxt from s join e on e.node = s.node and e.rn = s.rn + 1))
select node, arg_max(phase, rn) as phase, max(moves) as moves from s group by 1""")
def node_phase_fold(spark, sf):
    return lifecycle.fold_node(t(spark, sf, "events").select(F.col("user_id").alias("node"), F.col("event_id").alias("seq"), F.expr(_NODE).alias("event")))


# ------------------------------------------------------------------ sources, values, snapshots


def nation_csv(spark, sf) -> str:
    rows = t(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()  # 25 rows
    return "\n".join(["n_nationkey,n_name,n_regionkey", *[f"{r[0]},{r[1]},{r[2]}" for r in rows]])


@query("select n_nationkey, n_name, n_regionkey from nation")
def load_csv_inferred(spark, sf):
    return readers.csv_text(spark, nation_csv(spark, sf))


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity > 45 and l_returnflag = 'R'")
def project_and_restrict(spark, sf):
    return readers.table(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"], "l_quantity > 45 and l_returnflag = 'R'")


def order_thirds(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return [o.where(F.col("o_orderkey") % 3 == k) for k in range(3)]


@query("select least(count(*), 1000)::bigint as n from orders")
def row_cap(spark, sf):
    return readers.capped(order_thirds(spark, sf), 1000).agg(F.count("*").alias("n"))


@query("select o_orderkey, o_custkey from orders")
def union_sources(spark, sf):
    return readers.union(order_thirds(spark, sf))


@query("select case when length(k) <= 64 then k else left(k, 64) || '…' end as key_preview, n as value_length from (select lpad(doc_id::varchar, 8, '0') || ':' || left(text, 80) as k, strlen(text)::bigint as n from documents) where n > 4096")
def oversize_report(spark, sf):
    pairs = t(spark, sf, "documents").select(F.concat(key8("doc_id"), F.lit(":"), F.substring("text", 1, 80)).cast("binary").alias("key"), F.col("text").alias("value"))
    return kv.oversized(pairs, 4096)


def document_pairs(spark, sf):
    return t(spark, sf, "documents").select(key8("doc_id").cast("binary").alias("key"), F.col("text").cast("binary").alias("value"))


@query("select count(*) as n, count(*) as n_equal, sum(strlen(text))::bigint as raw_bytes, true as smaller from documents")
def zstd_roundtrip_stats(spark, sf):
    """All texts through a dictionary trained on the build's own sample."""
    d, _ = store.dictionary_of(layout.addressed(document_pairs(spark, sf), 64))
    docs = document_pairs(spark, sf).select(F.col("value").alias("v"))
    packed = docs.select("v", codec.compress(F.col("v"), d).alias("c"))
    back = packed.select("v", "c", codec.decompress(F.col("c.stored"), F.col("c.compressed"), d).alias("b"))
    return back.agg(
        F.count("*").alias("n"), F.count_if(F.col("b") == F.col("v")).alias("n_equal"), F.sum(F.octet_length("v")).alias("raw_bytes"), (F.sum(F.octet_length("c.stored")) < F.sum(F.octet_length("v"))).alias("smaller")
    )


@query("select lpad(doc_id::varchar, 8, '0') as key, 'hit' as status, sha256(text) as value_sha256 from documents union all select lpad((doc_id + 50000000)::varchar, 8, '0'), 'miss', null from documents")
def compressed_get(spark, sf):
    """A snapshot compressed with its own dictionary, asked for every key and as many that it lacks."""
    root = scratch_path(spark, "compressed")
    store.build(document_pairs(spark, sf), root, n=4, compression="zstd-dict")
    keys = t(spark, sf, "documents").select("doc_id")
    asked = keys.unionByName(keys.select((F.col("doc_id") + 50_000_000).alias("doc_id"))).select(key8("doc_id").alias("key"))
    found = store.Lookup(spark, root).get(asked)
    return found.select(F.col("key").cast("string").alias("key"), F.when(F.col("status") == "hit", "hit").otherwise("miss").alias("status"), F.sha2("value", 256).alias("value_sha256"))


@query("""with p as (select (fp & 3)::int as partition_id, strlen(text) as n from (select * from """ + fp_sql("(select lpad(doc_id::varchar, 8, '0') as key, text from documents)") + """))
select partition_id, count(*) as n_keys, sum(n)::bigint as raw_bytes, true as smaller, true as adds_up, true as sample_smaller from p group by rollup (partition_id)""")
def compressed_build_stats(spark, sf):
    """Statistics of a compressed build by partition and in all, from its manifest, and its sample's ratio."""
    meta = store.build(document_pairs(spark, sf), scratch_path(spark, "stats"), n=4, compression="zstd-dict")
    rows = [(p["id"], p) for p in meta["partitions"]] + [(None, meta["stats"])]
    out = [(i, p["n_keys"], p["raw_bytes"], p["stored_bytes"] < p["raw_bytes"], p["n_compressed"] + p["n_raw"] == p["n_keys"], meta["sample"]["stored_bytes"] < meta["sample"]["raw_bytes"]) for i, p in rows]
    return spark.createDataFrame(out, "partition_id int, n_keys long, raw_bytes long, smaller boolean, adds_up boolean, sample_smaller boolean")


@query(f"select r.key, case when o.key is null then 'miss' else 'hit' end as status, o.value from {REQ} r left join {ORD} o on r.key = o.key")
def load_then_get(spark, sf):
    """From a load specification to a published snapshot to a batch of gets on it."""
    root = scratch_path(spark, "load")
    source = scratch_path(spark, "source")
    order_pairs(spark, sf).write.parquet(source)
    spec = kv.LoadSpec.from_json(json.dumps({"source": {"table": {"path": source}}, "key": "key", "value": "value", "partitions": 4, "output": root}))
    spec.load(spark)
    found = store.Lookup(spark, root).get(order_requests(spark, sf))
    return found.select(F.col("key").cast("string").alias("key"), F.when(F.col("status") == "hit", "hit").otherwise("miss").alias("status"), F.col("value").cast("string").alias("value"))


@query(f"select (fp & 3)::int as partition_id, count(*) as n_keys, 0::bigint as lost, true as few_pass from {fp_sql(ORD)} group by 1")
def partition_filters(spark, sf):
    """A filter per partition: no key of it is lost, and of keys that it lacks under one in a hundred passes."""
    placed = layout.addressed(order_pairs(spark, sf), 4)
    buckets = store.filter_buckets(placed)
    filters = store.partition_filters(placed, buckets)
    kept = store.filtered(placed.select("key", "partition_id", "fp"), filters, buckets).groupBy("partition_id").agg(F.count("*").alias("kept"))
    absent = t(spark, sf, "orders").select(F.lpad((F.col("o_orderkey") + 50_000_000).cast("string"), 8, "0").alias("key"))
    others = layout.addressed(absent, 4).select("key", "partition_id", "fp")
    passed = store.filtered(others, filters, buckets).groupBy("partition_id").agg(F.count("*").alias("passed"))
    rows = placed.groupBy("partition_id").agg(F.count("*").alias("n_keys")).join(kept, "partition_id", "left").join(passed, "partition_id", "left")
    return rows.select("partition_id", "n_keys", (F.col("n_keys") - F.coalesce("kept", F.lit(0))).alias("lost"), (F.coalesce("passed", F.lit(0)) <= 5 + F.col("n_keys") / 100).alias("few_pass"))


@query(f"""with p as (select count(*) as n_keys, (count(*) * 20 + 18) // 19 as buckets from {fp_sql(ORD)} group by fp & 63)
select count(*) as partitions, sum(buckets)::bigint as buckets, min(n_keys * 1000000 // buckets)::bigint as fill_min, max(n_keys * 1000000 // buckets)::bigint as fill_max, (sum(n_keys) * 1000000 // sum(buckets))::bigint as fill_mean,
count(*) filter (where buckets * 8 > 2097152) as overflow_partitions, 0::bigint as retries from p""")
def index_stats(spark, sf):
    return layout.index_stats(layout.index_layout(layout.partition_stats(placed_orders(spark, sf, 64))))


_CROWD = "(select lpad((l_orderkey % 7)::varchar, 8, '0') as key from lineitem)"


@query(f"select (fp & 3)::int as partition_id, case when {high('fp')} = 0 then 1 else {high('fp')} end as cfp, count(*) as n from {fp_sql(_CROWD)} group by 1, 2 having count(*) > 255")
def crowd_guard(spark, sf):
    """Compact fingerprints that a version 4 table could not hold."""
    pairs = t(spark, sf, "lineitem").select(F.lpad((F.col("l_orderkey") % 7).cast("string"), 8, "0").alias("key"))
    return layout.crowded_fingerprints(layout.addressed(pairs, 4))


@query(f"""with e as (select user_id as conn, event_id as seq, event_id % 9 as m, case when event_id % 9 = 4 then 'version' when event_id % 9 = 5 then 'ms k 3' when event_id % 9 = 6 then 'mg none:1 v' when event_id % 9 = 7 then 'mg nocolon v'
   else 'mg orders:' || lpad((event_id % 3000 + 1)::varchar, 8, '0') || ' v k' end as line, lpad((event_id % 3000 + 1)::varchar, 8, '0') as k from events)
select conn, row_number() over (partition by conn order by seq) as seq, case when m = 4 then 'VERSION 0.1.0 gen/1' || chr(13) || chr(10) when m = 5 then 'SERVER_ERROR read-only' || chr(13) || chr(10) when m = 6 then 'EN' || chr(13) || chr(10)
 when m = 7 then 'SERVER_ERROR internal error' || chr(13) || chr(10) when o.key is null then 'EN' || chr(13) || chr(10) else 'VA ' || strlen(o.value) || ' korders:' || e.k || chr(13) || chr(10) || o.value || chr(13) || chr(10) end as response
from e left join {ORD} o on o.key = e.k and e.m not in (4, 5, 6, 7)""")
def request_path(spark, sf):
    """Bytes of many connections: framed, parsed, routed by prefix, looked up in a stored snapshot, answered in order."""
    root = scratch_path(spark, "served")
    store.build(order_pairs(spark, sf).select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value")), root, n=4)
    key = F.lpad((F.col("event_id") % 3000 + 1).cast("string"), 8, "0")
    m = F.col("event_id") % 9
    line = F.when(m == 4, "version\r\n").when(m == 5, "ms k 3\r\nabc\r\n").when(m == 6, "mg none:1 v\r\n").when(m == 7, "mg nocolon v\r\n").otherwise(F.concat(F.lit("mg orders:"), key, F.lit(" v k\r\n")))
    chunks = t(spark, sf, "events").select(F.col("user_id").alias("conn"), F.col("event_id").alias("seq"), line.cast("binary").alias("data"))
    entries = spark.createDataFrame([("orders", "orders", "v1", "/m")], "dataset string, key_prefix string, version_id string, mount_path string")
    out = protocol.served(chunks, entries, store.LookupFactory(spark, {"orders": root}), generation=1)
    return out.select("conn", "seq", F.col("response").cast("string").alias("response"))


@query("""select user_id as phase, ts as at, n - ln as keys, b - lb as bytes, case when e > le then floor((n - ln) / ((e - le) / 1e6::double))::bigint end as keys_per_second, case when e > le then floor((b - lb) / ((e - le) / 1e6::double))::bigint end as bytes_per_second
from (select *, lag(n) over w as ln, lag(b) over w as lb, lag(e) over w as le from (select user_id, ts, epoch_us(ts) as e, max(event_id) as n, max(event_id) * 3 as b from events group by 1, 2, 3) window w as (partition by user_id order by ts)) where le is not null""")
def progress_rates(spark, sf):
    e = t(spark, sf, "events").groupBy(F.col("user_id").alias("phase"), F.col("ts").alias("at")).agg(F.max("event_id").alias("keys"), (F.max("event_id") * 3).alias("bytes"))
    return store.progress_rates(e)


@query("select c_custkey, c_name, c_nationkey, c_acctbal from customer")
def protobuf_roundtrip(spark, sf):
    c = t(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    d, name = codec.resolve_descriptor([(f.name, f.dataType.simpleString()) for f in c.schema], "shop", "Customer")
    packed = c.select(codec.encode_message([F.col(x) for x in c.columns], c.columns, d, name).alias("m"))
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in c.schema)
    return packed.select(F.from_json(codec.decode_message(F.col("m"), d, name), kind).alias("r")).select("r.*")


@query("select lpad(c_custkey::varchar, 8, '0') as key, c_name as value from customer")
def snapshot_roundtrip(spark, sf):
    root = scratch_path(spark, "snapshot")
    pairs = t(spark, sf, "customer").select(key8("c_custkey").cast("binary").alias("key"), F.col("c_name").cast("binary").alias("value"))
    snapshot.write(pairs, root, n=4)
    data, _ = snapshot.open_snapshot(spark, root)
    return data.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query(f"""with d as (select key, (fp & 3)::int as p, {u('fp')} as uf, length from {fp_sql(DOCKEY)} where length > 0)
select key, used from (select key, sum(length + 8) over (order by uf, key rows unbounded preceding)::bigint as used from d where p = (select min(p) from d)) where used <= {codec.SAMPLE_BYTES}""")
def sample_prefix(spark, sf):
    return store.first_sample(layout.addressed(document_pairs(spark, sf), 4)).select(F.col("key").cast("string").alias("key"), "used")


NAMES = ["a.b.c", "a.b.c.d", "projects/p/datasets/d/tables/t", "a.b", "nodots"]


@query("select name, resource, project from (values ('a.b.c', 'projects/a/datasets/b/tables/c', 'a'), ('a.b.c.d', 'projects/a/datasets/b/tables/c.d', 'a'), ('projects/p/datasets/d/tables/t', 'projects/p/datasets/d/tables/t', 'p'), ('a.b', null, null), ('nodots', null, null)) v(name, resource, project)")
def table_name_parse(spark, sf):
    n = F.col("name")
    return spark.createDataFrame([(x,) for x in NAMES], "name string").select("name", X.table_resource(n).alias("resource"), X.table_project(n).alias("project"))


@query("select uri, bucket, object, error from (values ('gs://b/o/x', 'b', 'o/x', null), ('s3://b/o', null, null, 'scheme'), ('gs://b', null, null, 'no object path'), ('gs:///o', null, null, 'empty bucket or object'), ('gs://b/', null, null, 'empty bucket or object')) v(uri, bucket, object, error)")
def object_uri_parse(spark, sf):
    b, o, e = X.object_uri(F.col("uri"))
    uris = ["gs://b/o/x", "s3://b/o", "gs://b", "gs:///o", "gs://b/"]
    return spark.createDataFrame([(x,) for x in uris], "uri string").select("uri", b.alias("bucket"), o.alias("object"), e.alias("error"))


SERVED = "(select p_brand || p_partkey as dataset, 'v' || (p_size + case when p_partkey % 4 = 0 then 1 else 0 end) as version_id from part where p_partkey % 3 <> 0)"


@query(f"select coalesce(a.dataset, b.dataset) as dataset, a.version_id as catalog_version, b.version_id as served_version, coalesce(a.version_id = b.version_id, false) as converged from (select p_brand || p_partkey as dataset, 'v' || p_size as version_id from part where p_partkey % 5 <> 0) a full join {SERVED} b on a.dataset = b.dataset")
def served_vs_catalog(spark, sf):
    p = t(spark, sf, "part")
    name = F.concat("p_brand", "p_partkey").alias("dataset")
    a = p.where("p_partkey % 5 <> 0").select(name, F.concat(F.lit("v"), "p_size").alias("version_id"))
    b = p.where("p_partkey % 3 <> 0").select(name, F.concat(F.lit("v"), F.expr("p_size + if(p_partkey % 4 = 0, 1, 0)")).alias("version_id"))
    return catalog.compare_served(a, b)


@query("select n_nationkey::varchar as key, n_name as value from nation")
def config_load(spark, sf):
    spec = kv.LoadSpec.from_json(json.dumps({"source": {"csv": {"data": nation_csv(spark, sf)}}, "key": "n_nationkey", "value": "n_name", "partitions": 4}))
    return spec.pairs(spark).select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query("""select 'p' || p_partkey as dataset, p_brand as key_prefix, 'v' || p_size as version_id, '/m' as mount_path from part where p_partkey % 2 = 0 and p_partkey <> 10
union all select 'p10', 'promoted', 'v99', '/m99'""")
def catalog_write(spark, sf):
    p = t(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("dataset"), F.col("p_brand").alias("key_prefix"), F.concat(F.lit("v"), "p_size").alias("version_id"), F.lit("/m").alias("mount_path"), (F.col("p_partkey") % 2 == 0).alias("active"))
    promo = spark.createDataFrame([("p10", "promoted", "v99", "/m99")], "dataset string, key_prefix string, version_id string, mount_path string")
    return catalog.promoted(p, F.col("active"), promo)


@query("select distinct k::varchar as key from (select l_orderkey as k from lineitem union all select -l_orderkey from lineitem)")
def int_key_stringify(spark, sf):
    li = t(spark, sf, "lineitem").select("l_orderkey")
    both = li.unionByName(li.select((-F.col("l_orderkey")).alias("l_orderkey")))
    return both.select(kv.key_bytes(both, "l_orderkey").cast("string").alias("key")).distinct()


@query("""select i::bigint as i, case when r < 1000 then printf('%.1f B/s', r / 1.0::double) when r < 1000000 then printf('%.1f KB/s', r / 1000.0::double) when r < 1000000000 then printf('%.1f MB/s', r / 1000000.0::double)
 when r < 1000000000000 then printf('%.1f GB/s', r / 1000000000.0::double) else printf('%.1f TB/s', r / 1000000000000.0::double) end as bandwidth,
 case when s < 60 then s || 's' when s < 3600 then (s // 60) || 'm' || (s % 60) || 's' else (s // 3600) || 'h' || ((s // 60) % 60) || 'm' end as duration,
 case i % 5 when 0 then 'phase-active' when 1 then 'phase-error' when 2 then 'phase-progress' when 3 then 'phase-progress' else '' end as class
 from (select i, (7 ** i)::bigint as r, (i * i * i * 13)::bigint as s from range(0, 17) x(i))""")
def text_formats(spark, sf):
    r = spark.range(17).select(F.col("id").alias("i"), F.expr("cast(pow(7, id) as bigint)").alias("r"), F.expr("id * id * id * 13").alias("s"))
    phase = F.element_at(F.array(*[F.lit(x) for x in ("active", "error", "attaching", "mounting", "pending")]), (F.col("i") % 5 + 1).cast("int"))
    return r.select("i", X.human_bandwidth(F.col("r")).alias("bandwidth"), X.duration_text(F.col("s")).alias("duration"), X.phase_class(phase).alias("class"))


METAS = ['{"encoding":{"protobuf":{"descriptor":"QUJD","message_name":"a.B"}},"index":{"index_bytes":77}}', '{"encoding":{"raw":{}},"stats":{"index":{"index_bytes":5}}}', "{}", "not json", ""]


@query("select i::bigint as i, descriptor, message_name, index_bytes::bigint as index_bytes from (values (0, 'QUJD', 'a.B', 77), (1, '', '', 0), (2, '', '', 0), (3, '', '', 0), (4, '', '', 0)) v(i, descriptor, message_name, index_bytes)")
def manifest_fields(spark, sf):
    m = spark.createDataFrame(list(enumerate(METAS)), "i long, meta string")
    m = m.withColumn("meta", F.coalesce("meta", F.lit("")))
    return m.select(
        "i", codec.manifest_field(F.col("meta"), "$.encoding.protobuf.descriptor").alias("descriptor"),
        codec.manifest_field(F.col("meta"), "$.encoding.protobuf.message_name").alias("message_name"), codec.manifest_field(F.col("meta"), "$.index.index_bytes", default=0).alias("index_bytes"),
    )


@query("select doc_id, base64(encode(text)) as packed from documents")
def base64_documents(spark, sf):
    return t(spark, sf, "documents").select("doc_id", codec.base64_text(F.col("text").cast("binary")).alias("packed"))


_CRON = ["*/15 * * * *", "0 2 * * 1-5", "30 4 1,15 * 5", "5 0 * 8 *"]


@query("""with c as (select ts as "at", minute(ts) as m, hour(ts) as h, day(ts) as d, month(ts) as mo, dayofweek(ts) as w from (select distinct date_trunc('minute', ts) as ts from events)),
hit as (select "at", 0 as k from c where m % 15 = 0 union all select "at", 1 from c where m = 0 and h = 2 and w between 1 and 5 union all select "at", 2 from c where m = 30 and h = 4 and (d in (1, 15) or w = 5) union all select "at", 3 from c where m = 5 and h = 0 and mo = 8)
select n_name as dataset, "at" from nation join hit on n_nationkey % 4 = k""")
def cron_due(spark, sf):
    """Schedules in five fields, over every minute in which something happened."""
    cron = F.element_at(F.array(*[F.lit(x) for x in _CRON]), (F.col("n_nationkey") % 4 + 1).cast("int"))
    schedules = t(spark, sf, "nation").select(F.col("n_name").alias("dataset"), cron.alias("cron"))
    clock = t(spark, sf, "events").select(F.date_trunc("minute", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("at")).distinct()
    return lifecycle.due_schedules(schedules, clock)


@query("""select s_suppkey as node, s_nationkey % 3 as error, s_suppkey % 5 as converged from supplier where s_suppkey % 7 = 0 or s_suppkey % 4 = 0 or s_nationkey % 3 <> 0""")
def status_patch(spark, sf):
    """Statuses to write: changed, or not there yet."""
    wanted = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"), (F.col("s_nationkey") % 3).alias("error"), (F.col("s_suppkey") % 5).alias("converged"))
    there = wanted.where("node % 7 <> 0").select("node", F.lit(0).cast(wanted.schema["error"].dataType).alias("error"), F.when(F.col("node") % 4 == 0, -1).otherwise(F.col("converged")).cast(wanted.schema["converged"].dataType).alias("converged"))
    return lifecycle.status_patches(there, wanted, "node")


@query("select 0 as ord, '# HELP doc_bytes Sizes' as line union all select 1, '# TYPE doc_bytes histogram' union all "
    + " union all ".join(f"select 2, 'doc_bytes_bucket{{lang=\"' || replace(coalesce(lang, 'a\"b'), '\"', chr(92) || '\"') || '\",le=\"{b:g}\"}} ' || count(*) filter (where strlen(text) <= {b}) from documents group by lang" for b in metrics.RESPONSE_BYTES)
    + " union all select 2, 'doc_bytes_bucket{lang=\"' || replace(coalesce(lang, 'a\"b'), '\"', chr(92) || '\"') || '\",le=\"+Inf\"} ' || count(text) from documents group by lang"
    + " union all select 3, 'doc_bytes_sum{lang=\"' || replace(coalesce(lang, 'a\"b'), '\"', chr(92) || '\"') || '\"} ' || sum(strlen(text)) from documents group by lang"
    + " union all select 4, 'doc_bytes_count{lang=\"' || replace(coalesce(lang, 'a\"b'), '\"', chr(92) || '\"') || '\"} ' || count(text) from documents group by lang")
def histogram_exposition(spark, sf):
    d = t(spark, sf, "documents").select(F.coalesce("lang", F.lit('a"b')).alias("lang"), F.octet_length("text").cast("long").alias("n"))
    cells = metrics.histogram(d, F.col("n"), metrics.RESPONSE_BYTES, ["lang"])
    return metrics.histogram_exposition(cells, "doc_bytes", "Sizes", ["lang"], metrics.RESPONSE_BYTES, d.groupBy("lang").agg(F.sum("n").alias("total")))


@query("select 'p' || p_partkey as dataset, p_brand || '-' || p_partkey as key_prefix, 'v' || p_size as version_id, '/m' as mount_path from part")
def catalog_file(spark, sf):
    """A catalog written as a file and read again."""
    p = t(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("dataset"), F.concat("p_brand", F.lit("-"), "p_partkey").alias("key_prefix"), F.concat(F.lit("v"), "p_size").alias("version_id"), F.lit("/m").alias("mount_path"))
    path = f"{scratch_path(spark, 'catalog')}/catalog.json"
    catalog.write(p, path)
    return catalog.read(spark, path)


@query("select o_orderkey, 'pv-' || (o_orderkey % 1000) as volume from orders where o_orderstatus = 'F' and 'pv-' || (o_orderkey % 1000) in (select 'pv-' || (l_orderkey % 1000) from lineitem where l_quantity > 49)")
def touched_versions(spark, sf):
    v = t(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("pv-"), F.col("o_orderkey") % 1000).alias("volume"), F.when(F.col("o_orderstatus") == "F", "retired").otherwise("active").alias("state"))
    a = t(spark, sf, "lineitem").where("l_quantity > 49").select(F.concat(F.lit("pv-"), F.col("l_orderkey") % 1000).alias("volume"))
    return lifecycle.touched_by(a, v).select("o_orderkey", "volume")


@query("select user_id as node, arg_max(event_type, event_id) as report from events group by 1")
def state_reports(spark, sf):
    """The full state that each node reported last."""
    e = t(spark, sf, "events").select(F.col("user_id").alias("node"), F.col("event_type").alias("report"), "event_id")
    return lifecycle.latest(e, "node", [F.desc("event_id")]).select("node", "report")


@query("select n_name || '-v' || n_regionkey as version_name, 'shop.' || n_name as full_name, n_name as bare_name from nation")
def qualified_names(spark, sf):
    return t(spark, sf, "nation").select(
        X.version_name(F.col("n_name"), F.concat(F.lit("v"), "n_regionkey")).alias("version_name"), X.qualified_name(F.lit("shop"), F.col("n_name")).alias("full_name"), X.qualified_name(F.lit(""), F.col("n_name")).alias("bare_name"),
    )


@query("select json_object('datasets', list(json_object('dataset', n_name, 'version_id', 'v' || n_regionkey, 'loaded_at', '2024-01-15T10:30:00Z') order by n_name))::varchar as body from nation")
def version_body(spark, sf):
    at = F.expr("timestamp '2024-01-15 10:30:00'")
    return catalog.version_json(t(spark, sf, "nation").select(F.col("n_name").alias("dataset"), F.concat(F.lit("v"), "n_regionkey").alias("version_id"), at.alias("loaded_at")))


@query("select p_partkey, length(p_name) > 0 and not regexp_matches(p_name, '[ \r\n]') as valid from part")
def client_keys(spark, sf):
    return t(spark, sf, "part").select("p_partkey", protocol.valid_client_key(F.col("p_name")).alias("valid"))

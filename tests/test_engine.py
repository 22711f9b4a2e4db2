"""Operators of the snapshot engine: round trips, rejections, and queries against DuckDB."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from stillwater.functions import codec, hashing, sizes
from stillwater.functions import text as X
from stillwater.operators import catalog, layout, lifecycle, lookup, protocol, snapshot, store
from stillwater.plans import catalogue
from stillwater.sources import kv, readers
from stillwater.streaming import streams

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(name, spark, sf, duck):
    df = catalogue.QUERIES[name](spark, sf)
    cur = duck.execute(catalogue.SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    got = sorted(repr([r[c] for c in sorted(columns)]) for r in df.collect())
    want = sorted(repr([r[columns.index(c)] for c in sorted(columns)]) for r in cur.fetchall())
    assert got == want and want


def test_hash_with_any_seed_equals_xxh64(spark):
    import random

    import xxhash

    rng = random.Random(0)
    keys = [bytes(rng.randrange(256) for _ in range(n)) for n in list(range(40)) + [64, 100, 199]]
    df = spark.createDataFrame([(k,) for k in keys], "k binary")
    for seed in (0, hashing.VERIFY_SEED, 1, 42):
        got = [r.h for r in df.select(hashing.xxh64(F.col("k"), seed).alias("h")).collect()]
        assert [h % (1 << 64) for h in got] == [xxhash.xxh64(k, seed=seed).intdigest() for k in keys]
    assert df.limit(1).select(hashing.xxh64(F.lit(None).cast("binary")).alias("h")).first().h is None


def test_bad_partition_counts_are_rejected():
    for n in (0, 3, 65):
        with pytest.raises(ValueError):
            hashing.partition_of(F.lit(1), n)


def test_radix_bucket_table():
    assert [sizes.radix_buckets(b, 100) for b in (0, 1, 100, 101, 200, 201, 401, 10**9)] == [1, 1, 1, 2, 2, 4, 8, 64]
    assert sizes.radix_buckets(10, 0) == 1


@pytest.mark.parametrize("classes,want", [([(13, 5)], 16384), ([(5, 3)], 4096), ([(20, 1)], 65536), ([], 4096)])
def test_block_size_of_the_median_class(spark, classes, want):
    assert layout.block_size(spark.createDataFrame(classes, "bucket long, n long")).first().block_size == want


@pytest.mark.parametrize("fences,h,want", [
    ([10, 20, 30], 20, [1, 0]), ([10, 20, 30], 25, [1]), ([10, 20, 30], 5, []), ([10, 20, 30], 10, [0]), ([10, 20, 30], 99, [2]),
    ([10, 20, 20, 20, 30], 20, [1, 2, 3, 0]), ([10, 20, 20, 20, 30], 21, [3]), ([10, 20, 20], 20, [1, 2, 0]), ([], 20, []),
])
def test_candidate_block_table(spark, fences, h, want):
    f = spark.createDataFrame([(0, i, x) for i, x in enumerate(fences)], "partition_id int, block long, fence long")
    p = spark.createDataFrame([("k", 0, h << 32)], "key string, partition_id int, fp long")
    assert [r.block for r in layout.candidate_blocks(p, f).orderBy("ordinal").collect()] == want


def test_robin_hood_finds_every_key():
    cfps = [(k * 2654435761) % (1 << 32) for k in range(200)]
    slots = layout.probe_hash_table(cfps, 211)
    assert sorted(s[0] for s in slots if s) == sorted(cfps)
    assert all(slots[(c + p) % 211] is not None for c, p in (s for s in slots if s))


def test_lookup_hits_misses_and_empty_values(spark):
    pairs = spark.createDataFrame([("hello", "world"), ("alpha", "beta gamma"), ("empty", "")], "key string, value string")
    asked = spark.createDataFrame([("hello",), ("empty",), ("absent",)], "key string")
    got = {r.key: (r.status, r.value) for r in lookup.lookup(asked, layout.addressed(pairs, 1), 1).collect()}
    assert got == {"hello": ("hit", "world"), "empty": ("hit", ""), "absent": ("miss", None)}


def test_snapshot_round_trip_resume_and_damage(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    big = b"\xab" * (1 << 20)
    pairs = readers.pairs(spark, [(b"a", b"1"), (b"big", big), (b"e", b"")])
    meta = snapshot.write(pairs, root, n=4, marker="rename")
    assert snapshot.write(pairs.limit(0), root, n=8) == meta  # complete: left as it is
    data, _ = snapshot.open_snapshot(spark, root)
    assert {(bytes(r.key), bytes(r.value)) for r in data.collect()} == {(b"a", b"1"), (b"big", big), (b"e", b"")}
    path = f"{tmp_path}/s/meta.json"
    text = open(path).read()
    for broken in (text.replace('"n_keys": 1', '"n_keys": 2', 1), "{", json.dumps({"version": 99}), json.dumps({"version": 1})):
        os.remove(path)
        for crc in (f"{tmp_path}/s/.meta.json.crc",):
            if os.path.exists(crc):
                os.remove(crc)
        open(path, "w").write(broken)
        with pytest.raises(snapshot.SnapshotError):
            snapshot.open_snapshot(spark, root)
    os.remove(path)
    with pytest.raises(snapshot.SnapshotError):
        snapshot.describe(spark, root)


def test_empty_snapshot_opens(spark, tmp_path):
    root = f"file://{tmp_path}/e"
    snapshot.write(readers.pairs(spark, []), root, n=4, marker="direct")
    data, meta = snapshot.open_snapshot(spark, root)
    assert data.count() == 0 and meta["stats"]["n_keys"] == 0


def test_duplicate_policies(spark):
    pairs = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], "key string, value string")
    assert snapshot.deduplicated(pairs, "keep_all_count").count() == 3
    kept = snapshot.deduplicated(pairs, "first_by", [F.desc("value")]).collect()
    assert sorted((r.key, r.value) for r in kept) == [("a", "2"), ("b", "3")]
    with pytest.raises(Exception, match="duplicate key"):
        snapshot.deduplicated(pairs, "error").collect()


def test_key_and_value_rules(spark):
    df = spark.createDataFrame([(-42, 1.5, "v", b"b", None)], "i long, d double, s string, b binary, n string")
    assert df.select(kv.key_bytes(df, "i").alias("k")).first().k == b"-42"
    u = df.select(F.lit("18446744073709551615").cast("decimal(20,0)").alias("u"))
    assert u.select(kv.key_bytes(u, "u").alias("k")).first().k == b"18446744073709551615"
    assert df.select(kv.raw_value(df, "n").alias("v")).first().v == b""
    for bad in (lambda: kv.key_bytes(df, "d"), lambda: kv.raw_value(df, "i"), lambda: kv.key_bytes(df, "missing")):
        with pytest.raises(kv.SchemaError):
            bad()


def test_oversized_and_null_keys_raise(spark):
    pairs = readers.pairs(spark, [(b"fine", b"12345678")])
    assert kv.checked(pairs, 8).count() == 1
    with pytest.raises(Exception, match="the-culprit"):
        kv.checked(readers.pairs(spark, [(b"the-culprit", b"123456789")]), 8).collect()
    with pytest.raises(Exception, match="null key"):
        kv.checked(readers.pairs(spark, [(None, b"1")])).collect()


def test_csv_inference_stops_at_100_rows_and_fails_later(spark, tmp_path):
    p = f"{tmp_path}/x.csv"
    open(p, "w").write("\n".join(["k,v", *[f"{i},a" for i in range(100)], "oops,b"]))
    df = readers.csv_file(spark, f"file://{p}")
    assert df.schema["k"].dataType.simpleString() == "int"
    with pytest.raises(Exception):
        df.collect()
    typed = readers.csv_file(spark, f"file://{p}", "k string, v string")
    assert typed.count() == 101
    assert readers.csv_text(spark, "key,value", "key string, value string").count() == 0


def test_row_cap_and_drain(spark):
    parts = [spark.range(1000).select(F.col("id").cast("string").alias("key")) for _ in range(2)]
    assert readers.capped(parts, 250).count() == 250 and readers.capped(parts, 5000).count() == 2000
    seen = readers.drain(readers.pairs(spark, [(b"ab", b"cde"), (b"f", b"")]))
    assert seen == {"keys": 2, "bytes": 6}
    assert readers.estimated(spark.range(10), 5)[0] == 5


def test_load_spec(spark):
    spec = kv.LoadSpec.from_json(json.dumps({"source": {"csv": {"data": "id,score\n1,2.5\n-7,3.5"}}, "key": "id", "encoding": "protobuf", "package": "p"}))
    rows = spec.pairs(spark).collect()
    assert sorted(bytes(r.key) for r in rows) == [b"-7", b"1"]
    assert spec.dry_run(spark).names == ["key", "value"]
    assert kv.LoadSpec({"csv": {}}, version=4, compression="auto", include_key=True).warnings()
    for bad in ('{"key": "k"}', '{"source": {}, "wrong": 1}'):
        with pytest.raises(ValueError):
            kv.LoadSpec.from_json(bad)
    assert kv.parse_table("a.b.c", "bill") == ("bill", "projects/a/datasets/b/tables/c")
    with pytest.raises(ValueError):
        kv.parse_table("a.b")


def test_compression_keeps_only_gains_and_rejects_damage(spark):
    df = spark.createDataFrame([(b"x" * 1000,), (b"short",), (os.urandom(200),)], "v binary")
    rows = df.select(codec.compress(F.col("v")).alias("c"), "v").collect()
    assert [r.c.compressed for r in rows] == [True, False, False]
    assert codec.frame_content_size(bytes(rows[0].c.stored)) == 1000
    bad = spark.createDataFrame([(bytes(rows[0].c.stored)[:-3], True)], "s binary, f boolean")
    with pytest.raises(Exception):
        bad.select(codec.decompress(F.col("s"), F.col("f"))).collect()


def test_protobuf_presence_and_descriptors():
    d, name = codec.resolve_descriptor([("a", "bigint"), ("t", "timestamp"), ("s", "string")], "p", "M")
    m = codec.message_class(d, name)()
    assert not m.HasField("a") and m.SerializeToString() == b""
    with pytest.raises(ValueError):
        codec.resolve_descriptor([("a", "bigint")], None, "M")
    with pytest.raises(ValueError):
        codec.resolve_descriptor([("a", "bigint")], "p", "M", "QUJD")


def test_selectors(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"},)], "l map<string,string>")
    ask = lambda op, k, v=None: df.select(lifecycle.requirement_matches(F.col("l"), k, op, v).alias("r")).first().r
    assert ask("In", "a", ["1", "9"]) and not ask("In", "a", ["9"]) and not ask("In", "z", ["1"])
    assert ask("NotIn", "a", ["9"]) and ask("NotIn", "z", ["1"]) and ask("Exists", "b") and ask("DoesNotExist", "z") and not ask("Odd", "a")


def test_gone_nodes_get_empty_lists_and_upsert_replaces(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "node long, dataset string")
    known, present = spark.createDataFrame([(1,), (2,)], "node long"), spark.createDataFrame([(1,)], "node long")
    assert {r.node: r.datasets for r in lifecycle.with_gone_nodes(a, known, present).collect()} == {1: ["x", "y"], 2: []}
    assert sorted(tuple(r) for r in lifecycle.upserted(a, spark.createDataFrame([(1, "z")], a.schema), ["node"]).collect()) == [(1, "z")]
    state = spark.createDataFrame([(1, 5), (2, 3)], "node long, generation long")
    clients = spark.createDataFrame([(1, 4), (2, 3)], "node long, seen long")
    assert [r.node for r in lifecycle.long_poll(state, clients).collect()] == [1]


def test_stream_framing_skips_bodies_and_waits_for_the_rest(spark):
    chunks = spark.createDataFrame([(1, 1, b"mg a v\r\nms k 5 T0\r\nhe"), (1, 2, b"l\r\n\r\nversion\r\nmg unfin"), (2, 1, b"bogus\r\n")], "conn long, seq long, data binary")
    lines = protocol.framed_stream(chunks).orderBy("conn", "seq").collect()
    assert [(r.conn, r.line) for r in lines] == [(1, "mg a v"), (1, "ms k 5 T0"), (1, "version"), (2, "bogus")]


def test_protocol_edges(spark):
    lines = ["mg a", "mg a ", "mg", "mg  a   k", "version ", "quit", "ms a b", "md", "ma x"]
    df = spark.createDataFrame([(k, 1, x) for k, x in enumerate(lines)], "conn long, seq long, line string")
    got = [r.kind for r in protocol.commands(df).orderBy("conn").collect()]
    assert got == ["get", "error", "error", "get", "error", "quit", "error", "write_rejected", "write_rejected"]


def test_duplicate_prefix_keeps_the_served_catalog(spark):
    one = spark.createDataFrame([("a", "p", "v1", "/a")], "dataset string, key_prefix string, version_id string, mount_path string")
    served = catalog.Served(one.limit(0))
    assert served.swap(one) and served.generation == 1
    assert not served.swap(one.unionByName(one)) and served.generation == 1 and served.entries.count() == 1


def test_catalog_watch_swaps_on_the_catalog_file_only(spark, tmp_path):
    folder = tmp_path / "c"
    folder.mkdir()
    served = catalog.Served(spark.createDataFrame([], "dataset string, key_prefix string, version_id string, mount_path string"))
    (folder / "other.json").write_text("{}")
    q = streams.catalog_watch(spark, f"file://{folder}", served).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/k").start()
    q.awaitTermination(60)
    assert served.generation == 0
    (folder / "catalog.json").write_text(json.dumps({"entries": [{"dataset": "d", "key_prefix": "p", "version_id": "v1", "mount_path": "/m"}]}))
    q = streams.catalog_watch(spark, f"file://{folder}", served).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/k").start()
    q.awaitTermination(60)
    assert served.generation == 1 and served.entries.first().dataset == "d"


def test_streamed_states_equal_the_batch_fold(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").selectExpr("user_id as version", "event_id as seq", "ts as at", f"{catalogue._EVENT} as event")
    events.coalesce(1).write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e")
    q = streams.version_states(stream).writeStream.outputMode("update").format("memory").queryName("states").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.version: r.state for r in spark.sql("select * from states").collect()}
    want = {r.version: r.state for r in lifecycle.fold_version(events).collect()}
    assert got == want


def test_hex_dump_and_descriptor_fallback(spark):
    assert spark.createDataFrame([(b"hello\x00",)], "b binary").select(codec.hex_dump("b").alias("d")).first().d.startswith("00000000  68 65 6c 6c 6f 00")
    a = spark.createDataFrame([("p",), ("q",)], "key_prefix string")
    d = spark.createDataFrame([("p", None), ("r", "D")], "key_prefix string, descriptor string")
    assert {r.key_prefix: r.descriptor for r in catalog.with_descriptor(a, d).collect()} == {"p": "D", "q": "D"}


def test_long_names_are_cut_and_trimmed(spark):
    got = spark.range(1).select(X.resource_name(F.lit("a" * 252), F.lit("--b")).alias("n")).first().n
    assert len(got) <= 253 and not got.endswith("-")


def test_snapshot_data_source_reads_pairs_and_refuses_incomplete(spark, tmp_path):
    from stillwater.sources import datasource

    datasource.register(spark)
    root = f"file://{tmp_path}/s"
    snapshot.write(readers.pairs(spark, [(b"a", b"1"), (b"b", b"")]), root, n=2)
    got = spark.read.format("kv_snapshot").load(root).collect()
    assert {(bytes(r.key), bytes(r.value)) for r in got} == {(b"a", b"1"), (b"b", b"")}
    os.remove(f"{tmp_path}/s/meta.json")
    with pytest.raises(Exception):
        spark.read.format("kv_snapshot").load(root).collect()


# ---------------------------------------------------------------- stored snapshots


def docs_like(spark, n=300):
    return readers.pairs(spark, [(b"k%d" % k, b"" if k % 50 == 0 else (b"value %d " % (k % 9)) * (k % 40)) for k in range(n)])


@pytest.mark.parametrize("compression", ["none", "zstd", "zstd-dict"])
@pytest.mark.parametrize("version", [4, 5])
def test_build_get_and_scan(spark, tmp_path, compression, version):
    root, told = f"file://{tmp_path}/s", []
    pairs = docs_like(spark)
    meta = store.build(pairs, root, n=4, version=version, compression=compression, progress=told.append)
    want = {bytes(r.key): bytes(r.value) for r in pairs.collect()}
    assert meta["stats"]["n_keys"] == len(want) == sum(p["n_keys"] for p in meta["partitions"])
    assert meta["stats"]["raw_bytes"] == sum(map(len, want.values()))
    assert (meta["stats"]["n_compressed"] > 0) == (compression != "none" and version == 5)
    assert [p.phase for p in told] == ["plan", "data", "filters"] and not any(p.skipped for p in told) and told[1].keys_per_second > 0
    look = store.LookupFactory(spark, {"d": root}).lookup("d")
    assert {bytes(r.key): bytes(r.value) for r in look.scan().collect()} == want
    asked = spark.createDataFrame([(k,) for k in [*want, b"none", b"k0", b"absent"]], "key binary")
    got = look.get(asked).collect()
    assert len(got) == len(want) + 3
    for r in got:
        k = bytes(r.key)
        assert (r.status, r.value and bytes(r.value)) == ("hit", want[k] or r.value) if k in want else r.status in ("miss", "miss_io")
    assert look.get_one(b"k7") == ("hit", want[b"k7"]) and look.get_one(b"no")[1] is None


def test_build_goes_on_where_it_broke_off(spark, tmp_path):
    root, told = f"file://{tmp_path}/s", []
    store.build(docs_like(spark), root, n=2, compression="zstd-dict")
    before = sorted(os.listdir(tmp_path / "s" / "data"))
    os.remove(tmp_path / "s" / "meta.json")
    store.build(docs_like(spark), root, n=2, compression="zstd-dict", progress=told.append)
    assert all(p.skipped for p in told) and sorted(os.listdir(tmp_path / "s" / "data")) == before
    os.remove(tmp_path / "s" / "meta.json")
    with pytest.raises(snapshot.SnapshotError):
        store.build(docs_like(spark), root, n=4, compression="zstd-dict")


def test_damage_is_an_error_and_never_a_miss(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    store.build(docs_like(spark), root, n=2, compression="zstd-dict")
    bad = store.partition_filters(store.Lookup(spark, root).data).withColumn("checksum", F.col("checksum") + 1)
    with pytest.raises(Exception, match="damaged filter"):
        store.filtered(store.Lookup(spark, root).probes(docs_like(spark)), bad).collect()
    if (tmp_path / "s" / "dict.bin").exists():
        (tmp_path / "s" / "dict.bin").write_bytes(b"x")
        for f in (tmp_path / "s").glob(".dict.bin.crc"):
            f.unlink()
        with pytest.raises(snapshot.SnapshotError):
            store.Lookup(spark, root)
    with pytest.raises(ValueError):
        codec.frame_content_size(bytes([0b00101000, 5]))


def test_empty_build_opens_and_misses(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    store.build(readers.pairs(spark, []), root, n=2)
    assert store.Lookup(spark, root).get_one(b"a") == ("miss", None)


def test_duplicates_in_one_shuffle(spark, tmp_path):
    rows = readers.pairs(spark, [(b"a", b"1"), (b"a", b"2"), (b"b", b"3")])
    placed = layout.addressed(rows, 2)
    assert snapshot.unique(placed, "keep_all_count", None, 2).count() == 3
    assert {(bytes(r.key), bytes(r.value)) for r in snapshot.unique(placed, "first_by", [F.desc("value")], 2).collect()} == {(b"a", b"2"), (b"b", b"3")}
    with pytest.raises(Exception, match="duplicate key"):
        store.build(rows, f"file://{tmp_path}/s", n=2)
    plan = snapshot.unique(placed, "error", None, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_a_published_manifest_is_replaced_in_one_step(spark, tmp_path):
    path = f"file://{tmp_path}/m.json"
    for text in ("one", "two"):
        snapshot.publish(spark, path, text)
        assert (tmp_path / "m.json").read_text() == text and not (tmp_path / "m.json.tmp").exists()


def test_load_publishes_protobuf_and_patches_descriptors(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    spec = kv.LoadSpec.from_json(json.dumps({"source": {"csv": {"data": "id,name\n1,a\n2,b\n"}}, "key": "id", "encoding": "protobuf", "package": "p", "include_key": True, "partitions": 2, "output": root}))
    meta = spec.load(spark)
    pb = meta["encoding"]["protobuf"]
    descriptor = __import__("base64").b64decode(pb["descriptor"])
    got = store.Lookup(spark, root).scan().select(codec.decode_message(F.col("value"), descriptor, pb["message_name"]).alias("j")).collect()
    assert sorted(json.loads(r.j)["id"] for r in got) == [1, 2]
    assert store.with_descriptor(spark, root, b"x", "p.R")["encoding"] == snapshot.describe(spark, root)["encoding"] == {"protobuf": {"descriptor": "eA==", "message_name": "p.R"}}
    numbers = spark.createDataFrame([(5,)], "n long").select(codec.encode_message([F.col("n")], ["n"], codec.file_descriptor([("n", "bigint")], "p", "M"), "p.M").alias("v"))
    assert numbers.select(codec.decode_message(F.col("v"), codec.file_descriptor([("n", "bigint")], "p", "M"), "p.M", False).alias("j")).first().j == '{"n":"5"}'


def test_length_limits(spark):
    rows = readers.pairs(spark, [(b"a", b"12345")])
    assert kv.checked(rows, 5).count() == 1
    with pytest.raises(Exception, match="over 4"):
        kv.checked(rows, 4).collect()
    assert "over 1073741823" in kv.checked(rows, 1 << 40)._jdf.queryExecution().toString()


@pytest.mark.parametrize("buckets", [1, 4, 64])
def test_packing_side_by_side_equals_one_fold(spark, buckets):
    rng = __import__("random").Random(buckets)
    rows = [(f"{k:05d}", rng.getrandbits(64) - (1 << 63), k % 2, 8 * rng.choice([2, 3, 9, 40, 200, 255, 260])) for k in range(900)]
    records = spark.createDataFrame(rows, "key string, fp long, partition_id int, stored_length long")
    want = {}
    for p in (0, 1):
        block = used = 0
        for key, fp, _, size in sorted((r for r in rows if r[2] == p), key=lambda r: (r[1] % (1 << 64), r[0])):
            if used and used + size > 2044:
                block, used = block + 1, 0
            want[key] = (p, block, used)
            used += size
    got = {r.key: (r.partition_id, r.block, r.block_offset) for r in layout.packed_blocks(records, 2048, buckets).collect()}
    assert got == want


def test_crowded_fingerprints_are_refused(spark):
    pairs = layout.addressed(readers.pairs(spark, [(b"same", b"%d" % k) for k in range(256)]), 2)
    with pytest.raises(ValueError, match="256 records"):
        layout.refuse_crowded(pairs)
    layout.refuse_crowded(pairs.limit(255))


@pytest.mark.parametrize("text", ["* * * *", "60 * * * *", "*/0 * * * *", "a * * * *", "5-1 * * * *", "* * 0 * *", "* * * 13 *"])
def test_bad_schedules_are_rejected(text):
    with pytest.raises(ValueError):
        lifecycle.cron_due(text, F.lit(None).cast("timestamp"))


def test_folds_take_hot_keys_and_null_times(spark):
    rows = [(1, k, None, "start" if k == 0 else "other") for k in range(30_000)] + [(1, 30_000, None, "done"), (2, 0, None, "done")]
    got = lifecycle.fold_version(spark.createDataFrame(rows, "version long, seq long, at timestamp, event string")).collect()
    assert {(r.version, r.state, r.moves) for r in got} == {(1, "ready", 2), (2, "", 0)}


def test_idle_sessions_and_periodic_reports(spark, tmp_path):
    at = "timestamp '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,"
    rows = spark.range(1).selectExpr(f"explode(array({at}0), {at}200), {at}900))) as at").withColumn("conn", F.lit(1))
    assert sorted(r.n for r in streams.idle_sessions(rows).collect()) == [1, 2]
    assert [r.n for r in streams.idle_sessions(rows, 0).collect()] == [3]
    spark.range(3).write.parquet(f"{tmp_path}/r")
    stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/r")
    q = streams.periodic(stream, 1).format("memory").queryName("reports").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select * from reports").count() == 3


def test_catalog_files_refuse_shared_prefixes(spark, tmp_path):
    rows = spark.createDataFrame([("a", "p", "v1", "/m"), ("b", "p", "v1", "/m")], "dataset string, key_prefix string, version_id string, mount_path string")
    with pytest.raises(ValueError):
        catalog.write(rows, f"file://{tmp_path}/c.json")
    catalog.write(rows.limit(1), f"file://{tmp_path}/c.json")
    assert catalog.read(spark, f"file://{tmp_path}/c.json").count() == 1


def test_assignments_equal_plain_sets_and_shuffle_no_pairs(spark):
    rng = __import__("random").Random(3)
    label = lambda: {k: rng.choice("xyz") for k in "ab" if rng.random() < 0.8}
    n = [(k % 40, label()) for k in range(50)]  # ten nodes have two rows
    d = [(f"d{k % 60}", label()) for k in range(70)]
    pick = lambda: rng.choice([None, {}, {"a": "x"}, {"a": "y", "b": "z"}, {"b": "x"}, {"a": None}])
    b = [(k, rng.choice([{"a": "x"}, {"a": "y", "b": "z"}, {"b": "x"}, {"a": None}]), pick()) for k in range(8)]

    def fits(selector, labels):
        return not selector or all(v is not None and labels.get(k) == v for k, v in selector.items())

    met = {(x, i) for x, own in n for i, s, _ in b if fits(s, own)}
    want = sorted({(x, y) for x, i in met for j, _, s in b if i == j for y, own in d if fits(s, own)})
    bound = {x for x, _ in met}
    want = sorted(want + [(x, y) for x, _ in n if x not in bound for y, _ in d])
    assert 0 < len(bound) < 40
    got = lifecycle.assignments(
        spark.createDataFrame(n, "node long, labels map<string,string>"), spark.createDataFrame(d, "dataset string, dataset_labels map<string,string>"),
        spark.createDataFrame(b, "binding long, node_selector map<string,string>, dataset_selector map<string,string>"),
    )
    assert sorted(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not __import__("re").search(r"hashpartitioning\(node#\d+L?, dataset#", plan) and "Cross" not in plan.split("Generate explode(transform(datasets")[0]


def test_catalog_files_have_any_number_of_entries(spark, tmp_path):
    columns = ["dataset", "key_prefix", "version_id", "mount_path"]
    odd = [("a,\n\r]}", "p\u2028\"", None, ",,"), ("ü", "{\"entries\":\t[", "v", "]}"), (None, "", "", "\t")]
    many = catalog.BROADCAST_ENTRIES + 1
    rows = spark.range(many).selectExpr("'d' || id as dataset", "'p' || id as key_prefix", "'v1' as version_id", "'/m' as mount_path").unionByName(spark.createDataFrame(odd, ", ".join(f"{c} string" for c in columns)))
    path = f"file://{tmp_path}/c.json"
    for _ in range(2):  # the second replaces the first
        catalog.write(rows, path)
    back = catalog.read(spark, path)
    assert back.columns == columns and back.count() == many + 3 and back.exceptAll(rows).isEmpty() and rows.exceptAll(back).isEmpty()
    document = json.loads((tmp_path / "c.json").read_text())["entries"]
    assert len(document) == many + 3 and {tuple(e[c] for c in columns) for e in document} >= set(odd)
    assert [e["key_prefix"].encode() for e in document] == sorted(e["key_prefix"].encode() for e in document)
    assert sorted(x for x in os.listdir(tmp_path) if not x.startswith(".")) == ["c.json"]
    (tmp_path / "d.json").write_text(json.dumps({"entries": document[:5]}, indent=1))
    assert {tuple(r) for r in catalog.read(spark, f"file://{tmp_path}/d.json").collect()} == {tuple(e[c] for c in columns) for e in document[:5]}
    catalog.write(rows.limit(0), path)
    assert catalog.read(spark, path).isEmpty() and json.loads((tmp_path / "c.json").read_text()) == {"entries": []}


def test_filters_are_built_and_asked_batch_by_batch(spark, monkeypatch):
    monkeypatch.setattr(store, "FILTER_KEYS", 4_000)
    keys = spark.range(30_000).selectExpr("cast('k' || id as binary) as key", "cast(null as binary) as value")
    placed = layout.addressed(keys, 2).select("partition_id", "fp", "key")
    buckets = store.filter_buckets(placed)
    assert buckets == 4 and store.filter_buckets(placed.limit(0)) == 1
    filters = store.partition_filters(placed.unionByName(placed), buckets).cache()
    assert filters.agg(F.sum("n_keys")).first()[0] == 60_000 and filters.count() == 8
    assert filters.where(F.octet_length("filter") * 8 > F.col("n_keys") / 2 * 12 + 64).isEmpty()  # as large as distinct keys ask for
    absent = layout.addressed(spark.range(30_000).selectExpr("cast('a' || id as binary) as key", "cast(null as binary) as value"), 2).select("key", "fp", "partition_id")
    got = store.filtered(placed.unionByName(absent).unionByName(placed), filters, buckets)
    assert got.columns == ["partition_id", "fp", "key"]
    n = {bool(r.there): r.n for r in got.groupBy(F.col("key").cast("string").startswith("k").alias("there")).agg(F.count("*").alias("n")).collect()}
    assert n[True] == 60_000 and n.get(False, 0) < 600
    one = F.col("bucket") == 0
    assert store.filtered(placed, filters.where(~one), buckets).count() == 30_000 - filters.where(one).agg(F.sum("n_keys") / 2).first()[0]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and "InPandas" not in plan
    assert "_side" in next(x for x in plan.split("\n") if "Sort [" in x)  # nothing sorts again above the order that has the filter first


def test_gets_hold_no_group_of_requests(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "FILTER_KEYS", 40)
    root = f"file://{tmp_path}/s"
    assert store.build(docs_like(spark), root, n=2)["filter_buckets"] == 4
    got = store.Lookup(spark, root).get(docs_like(spark))
    assert got.where("status = 'hit'").count() == 300
    assert "CoGroup" not in got._jdf.queryExecution().executedPlan().toString()

"""MinHash near-dedup with circulant permutations.

A document is the set of its distinct five-word shingles.  One permutation
scatters the shingles over a ring of ``RING`` places; a second one gives every
place a value, and shifting it by k places gives signature coordinate k, so all
coordinates of a shingle are one contiguous slice of a table.  ``ROWS``
coordinates make a band; equal bands make candidates; candidates are confirmed
on the full shingle sets.

Links are found without listing the pairs of a bucket:

1. documents with equal shingle sets are one class, and only the class's
   smallest id goes on;
2. in a first round each class is compared with one class, the one that most
   often is the most popular in its buckets;
3. classes that share a bucket with a large component are compared with all its
   members, by blocks, and so are the many classes around one popular class with
   each other;
4. in later rounds a bucket whose members already share a component is done; in
   the others the first remaining members, by size of component and popularity
   (4, then 16, 64, ...), are compared with the members of other components,
   until none is left.  A pair is skipped only if it was tested, if its
   signatures differ too much, or if the triangle inequality of Jaccard distance
   rules it out.

With 48 bands of 5 rows a pair of similarity 0.75 shares no band with
probability 2.3e-6, one of 0.8 with 5e-9.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, long_list, mix, shingle_sets, text_blocks, text_buffer
from .components import connected_components

RING_BITS = 20
BANDS, ROWS = 48, 5
THRESHOLD = (75, 100)
#: Longs that hold one bit of every coordinate, and bits that may differ in a candidate of the later rounds:
#: an eighth of them differ at similarity 0.75 on average, and more than the limit with probability 1e-6.
WORDS = -(-BANDS * ROWS // 64)
BITS = [f"b{k}" for k in range(WORDS)]
MAX_DIFFERENT = 56
#: Members of an open bucket that the first of the later rounds compares with the others.
FIRST_PIVOTS = 4
#: Classes of a large component, and classes by classes that one task compares.
LARGE, BLOCK = 32, 384


class Circulant:
    """Signatures from two permutations of a ring, the second circularly shifted."""

    def __init__(self, coordinates: int = BANDS * ROWS, seed: int = 7):
        rng = np.random.default_rng(seed)
        size = 1 << RING_BITS
        self.scatter = rng.permutation(size).astype(np.uint32)
        values = rng.permutation(size).astype(np.uint32)
        ring = np.concatenate([values, values[:coordinates]])
        self.shifted = np.lib.stride_tricks.sliding_window_view(ring, coordinates)
        self.coordinates = coordinates

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        places = self.scatter[(shingles >> np.uint64(64 - RING_BITS)).astype(np.int64)]
        low = np.full(self.coordinates, np.iinfo(np.uint32).max, np.uint32)
        for a in range(0, len(places), 1024):
            np.minimum(low, self.shifted[places[a : a + 1024]].min(axis=0), out=low)
        return low

    @staticmethod
    def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
        values = signature.reshape(-1, rows).astype(np.uint64)
        h = np.arange(len(values), dtype=np.uint64)
        for j in range(rows):
            h = mix(h * np.uint64(0xE7037ED1A0B428DB) + values[:, j] + np.uint64(1))
        return h.view(np.int64)

    @staticmethod
    def bits(signature: np.ndarray) -> np.ndarray:
        """The lowest bit of every coordinate, in longs."""
        packed = np.packbits((signature & 1).astype(np.uint8))
        return np.pad(packed, (0, 8 * WORDS - len(packed))).view(np.int64)


def _signatures(batches):
    rings = Circulant()
    for batch, a, b, data, offsets in text_blocks(batches):
        sets = shingle_sets(data, offsets)
        sizes = np.array([len(s) for s in sets], np.int64)
        prints = np.array([[mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)] for s in sets], np.uint64)
        signed = [rings.signature(s) if len(s) else None for s in sets]
        keys = [np.zeros(0, np.int64) if s is None else rings.bands(s) for s in signed]
        bits = np.array([np.zeros(WORDS, np.int64) if s is None else rings.bits(s) for s in signed])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).slice(a, b - a),
                pa.array(sizes),
                pa.array(prints[:, 0].view(np.int64)),
                pa.array(prints[:, 1].view(np.int64)),
                long_list(np.concatenate(keys), [len(k) for k in keys]),
                *[pa.array(np.ascontiguousarray(bits[:, k])) for k in range(WORDS)],
            ],
            ["id", "n", "f1", "f2", "bands", *BITS],
        )


def signatures(docs: DataFrame) -> DataFrame:
    """(id, text) to set size, 128-bit set fingerprint, band keys and one bit per coordinate."""
    return docs.mapInArrow(_signatures, "id long, n long, f1 long, f2 long, bands array<long>, " + ", ".join(f"{b} long" for b in BITS))


def _confirm(batches):
    for batch in batches:
        left, right = [], []
        for name, out in (("text_a", left), ("text_b", right)):
            data, offsets = text_buffer(batch.column(batch.schema.get_field_index(name)))
            for a in range(batch.num_rows):
                out.append((data[offsets[a] : offsets[a + 1]], np.array([0, offsets[a + 1] - offsets[a]])))
        linked, far = np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows, bool)
        ids, memo, memo_of = batch.column(0).to_pylist(), None, None
        for k, (x, y) in enumerate(zip(left, right)):
            if memo is None or ids[k] != memo_of:
                memo, memo_of = shingle_sets(*x)[0], ids[k]
            other = shingle_sets(*y)[0]
            common = len(np.intersect1d(memo, other, assume_unique=True))
            union = len(memo) + len(other) - common
            linked[k] = common > 0 and THRESHOLD[1] * common >= THRESHOLD[0] * union
            far[k] = 2 * common < union
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked), pa.array(far)], ["a", "b", "linked", "far"])


def confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Exact test of ``pairs(a, b)`` on the full shingle sets of ``docs(id, text)``.

    ``linked``: similarity of 0.75 or more; ``far``: less than 0.5.
    """
    with_a = pairs.join(docs.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(docs.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a long, b long, linked boolean, far boolean")


def _compare_blocks(every: bool):
    """Rows sorted by block, its own members before the others: links between the two.

    One link of each other row that has one, or (``every``) as many as it takes
    to join all that are linked in the block.
    """
    def run(batches):
        block, held, index, root, a, b = None, [], None, {}, [], []

        def top(x):
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        for batch in batches:
            data, offsets = text_buffer(batch.column(batch.schema.get_field_index("text")))
            for k, row in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)))):
                where, other, node = row[:3], row[3], row[4]
                shingles = shingle_sets(data[offsets[k] : offsets[k + 1]], np.array([0, offsets[k + 1] - offsets[k]]))[0]
                if where != block:
                    block, held, index, root = where, [], None, {}
                if not other:
                    held.append((node, shingles))
                    continue
                if not held:
                    continue
                if index is None:
                    flat = np.concatenate([s for _, s in held])
                    owner = np.repeat(np.arange(len(held)), [len(s) for _, s in held])
                    order = np.argsort(flat, kind="stable")
                    index = flat[order], owner[order], np.array([len(s) for _, s in held])
                lo, hi = np.searchsorted(index[0], shingles, "left"), np.searchsorted(index[0], shingles, "right")
                n = hi - lo
                at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                common = np.bincount(index[1][at], minlength=len(held))
                hit = np.flatnonzero((common > 0) & (THRESHOLD[1] * common >= THRESHOLD[0] * (len(shingles) + index[2] - common)))
                for h in hit if every else hit[:1]:
                    x = held[h][0]
                    if x != node and (not every or top(x) != top(node)):
                        root[top(x)] = top(node)
                        a.append(node)
                        b.append(x)
            if len(a) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def compared(asks: DataFrame, groups: DataFrame, docs: DataFrame, every: bool) -> DataFrame:
    """Links of ``asks(rep, big)`` with the members ``groups(rep, big)`` of the same group, by blocks."""
    plan = asks.groupBy("big").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("rows")).join(
        groups.groupBy("big").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("columns")), "big"
    )
    part = F.xxhash64("rep")
    others = asks.select("rep", "big").join(plan, "big").select(
        "big", F.pmod(part, F.col("rows")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("j"), F.lit(True).alias("other"), F.col("rep").alias("id")
    )
    own = groups.select("rep", "big").join(plan, "big").select(
        "big", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), F.pmod(part, F.col("columns")).cast("int").alias("j"), F.lit(False).alias("other"), F.col("rep").alias("id")
    )
    rows = others.unionByName(own).join(docs, "id").select("big", "i", "j", "other", "id", "text")
    return rows.repartition("big", "i", "j").sortWithinPartitions("big", "i", "j", "other").mapInArrow(_compare_blocks(every), "a long, b long")


def links_to_large(members: DataFrame, state: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame | None:
    """A link, if there is one, between each class and each large component it shares a bucket with.

    The class is compared with all members of the component, block by block:
    ``BLOCK`` by ``BLOCK`` classes in a task, counted there by an inverted index,
    so no pair becomes a row and no component is gathered in one place.
    """
    named = members.join(state, "rep").select("key", "rep", "label", "lsize")
    large = named.where(F.col("lsize") >= LARGE).select("key", F.col("label").alias("big"), F.col("lsize").alias("bsize")).distinct()
    asks = named.join(large, "key").where("label <> big and (lsize < bsize or (lsize = bsize and label > big))").select("rep", "big", "bsize").distinct()
    asks = scratch.save(asks, "asks", few=True)
    if asks.isEmpty():
        return None
    groups = state.join(asks.select(F.col("big").alias("label")).distinct(), "label").select("rep", F.col("label").alias("big"))
    return scratch.save(compared(asks, groups, docs, False), "large")


def linked_classes(members: DataFrame, bits: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``members(key, rep, n)`` of the buckets and ``bits(rep, ...)`` to ``(node, label)`` of all that link.

    Popular members (those with many companions over all their buckets) come
    first, as they are the likeliest to be what others are copies of.
    """
    sized = members.join(members.groupBy("key").agg(F.count("*").alias("size")), "key")
    popular = sized.groupBy("rep").agg(F.sum("size").alias("pop"), F.max("n").alias("n")).join(bits, "rep")
    popular = scratch.save(popular.dropDuplicates(["rep"]), "popular", few=True)
    ranked = members.select("key", "rep").join(popular, "rep")
    top = ranked.groupBy("key").agg(F.max(F.struct("pop", (-F.col("rep")).alias("r"))).alias("t")).select("key", (-F.col("t.r")).alias("center"))
    votes = members.join(top, "key").where("rep <> center").groupBy("rep", "center").count()
    best = votes.groupBy("rep").agg(F.max(F.struct("count", (-F.col("center")).alias("c"))).alias("best"))
    pairs = best.select((-F.col("best.c")).alias("a"), F.col("rep").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("a").alias("hub"), F.col("b").alias("rep"))
    pairs = scratch.save(pairs, "pairs", few=True)
    tested = scratch.save(confirm(pairs.select("a", "b").distinct(), docs), "tested")
    hubs = scratch.save(pairs.join(tested.where("linked"), ["a", "b"]).select("rep", "hub").distinct(), "hubs", few=True)
    scratch.release()
    labels = connected_components(tested.where("linked").select("a", "b"), scratch)
    scratch.release()

    def state_of(labels: DataFrame) -> DataFrame:
        sizes = labels.groupBy("label").agg(F.count("*").alias("lsize"))
        state = popular.join(labels, popular.rep == labels.node, "left").select("rep", "pop", "n", *BITS, F.coalesce("label", "rep").alias("label"))
        return state.join(sizes, "label", "left").select("rep", "pop", "n", *BITS, "label", F.coalesce("lsize", F.lit(1)).alias("lsize"))

    # after this no class links with a component that was large, unless it has joined it
    state = scratch.save(state_of(labels), "state", few=True)
    settled = state.where(F.col("lsize") >= LARGE).select("rep")
    more = links_to_large(members, state, docs, scratch)
    scratch.release()
    if more is not None:
        labels = connected_components(more, scratch, labels)
        scratch.release()

    # classes around one popular class, whether they link with it or not, are compared with each other by blocks too
    around = pairs.select("rep", F.col("hub").alias("big")).unionByName(pairs.select(F.col("hub").alias("rep"), F.col("hub").alias("big"))).distinct()
    around = around.join(settled, "rep", "left_anti")
    full = around.groupBy("big").agg(F.count("*").alias("size")).where(F.col("size") >= LARGE).select("big")
    around = scratch.save(around.join(full, "big", "left_semi"), "around", few=True)
    if not around.isEmpty():
        labels = connected_components(scratch.save(compared(around, around, docs, True), "links"), scratch, labels)
        scratch.release()
    own = around.groupBy("rep").agg(F.collect_set("big").alias("groups"))

    active, pivots = members.select("key", "rep"), FIRST_PIVOTS
    while True:
        named = active.join(state_of(labels), "rep").join(settled, "rep", "left_anti").join(own, "rep", "left")
        open_ = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
        named = scratch.save(named.join(open_, "key", "left_semi"), "open", few=True)
        scratch.release()
        if named.isEmpty():
            return labels
        order = Window.partitionBy("key").orderBy(F.desc("lsize"), F.desc("pop"), "rep")
        first = named.withColumn("r", F.row_number().over(order)).where(F.col("r") <= pivots)
        first = scratch.save(first.select("key", F.col("rep").alias("p"), F.col("n").alias("np"), F.col("label").alias("lp"), F.col("groups").alias("pgroups"), *[F.col(b).alias(f"p{b}") for b in BITS]), "pivots", few=True)
        different = " + ".join(f"bit_count({b} ^ p{b})" for b in BITS)
        found = (
            named.join(first, "key")
            .where(f"label <> lp and {different} <= {MAX_DIFFERENT} and not coalesce(arrays_overlap(groups, pgroups), false)")
            .where(f"{THRESHOLD[1]} * least(n, np) >= {THRESHOLD[0]} * greatest(n, np)")
            .select(F.least("p", "rep").alias("a"), F.greatest("p", "rep").alias("b"))
            .distinct()
            .join(tested.select("a", "b"), ["a", "b"], "left_anti")
        )
        # a text less than 0.5 similar to a hub is less than 0.75 similar to every text that is 0.75 similar to the hub
        apart = tested.where("far").select("a", "b")
        apart = apart.unionByName(apart.select(F.col("b").alias("a"), F.col("a").alias("b")))
        for x, y in (("a", "b"), ("b", "a")):
            known = found.join(hubs.select(F.col("rep").alias(x), F.col("hub").alias("h")), x, "left")
            found = known.join(apart.select(F.col("a").alias(y), F.col("b").alias("h")), [y, "h"], "left_anti").select("a", "b")
        news = scratch.save(confirm(scratch.save(found, "pairs", few=True), docs), "tested")
        scratch.release()
        tested = tested.unionByName(news)
        if not news.where("linked").isEmpty():
            labels = connected_components(news.where("linked").select("a", "b"), scratch, labels)
        active = named.select("key", "rep").join(first.select("key", F.col("p").alias("rep")), ["key", "rep"], "left_anti")
        pivots *= 4


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents linked by Jaccard similarity of 0.75 or more.

    Returns ``id_col, n_shingles, component_id, kept``, a row per input row.
    Null and empty texts have no shingles and link with nothing; texts of fewer
    than five words are one shingle; repeated rows get equal results; a row with
    a null id takes part under its text's class and is never the one kept if an
    id is known.  Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = scratch.save(signatures(docs), "signatures")

    classes = scratch.save(
        signed.where("n > 0").groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.min("n").alias("n")), "classes"
    )
    reps = classes.where("rep is not null").select(F.col("rep").alias("id"))
    keyed = signed.select("id", "bands", "n").join(reps, "id", "left_semi")
    rows = keyed.select(F.explode("bands").alias("key"), F.col("id").alias("rep"), "n")
    buckets = rows.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("key")
    members = scratch.save(rows.join(buckets, "key", "left_semi").distinct(), "members")
    labels = linked_classes(members, signed.select(F.col("id").alias("rep"), *BITS), docs, scratch)

    named = classes.join(labels, classes.rep == labels.node, "left").select("f1", "f2", F.coalesce("label", "rep").alias("label"))
    named = scratch.save(named, "labels")
    scratch.drop(members)
    out = (
        signed.select("id", "n", F.when(F.col("n") > 0, F.col("f1")).alias("f1"), "f2")
        .join(named, ["f1", "f2"], "left")
        .select("id", F.col("n").alias("n_shingles"), F.coalesce("label", "id").alias("component_id"))
    )
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


#: The same by brute force, for small tables: all pairs that share a shingle.
ORACLE_SQL = r"""
with recursive d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\f\r]+'), lambda w: w <> '') as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as x from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from d where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
e as (select a, b from (select p.doc_id as a, q.doc_id as b, count(*) as c from s p join s q on p.x = q.x and p.doc_id <> q.doc_id group by 1, 2)
    join n u on u.doc_id = a join n v on v.doc_id = b where 100 * c >= 75 * (u.n + v.n - c)),
reach as (select doc_id as a, doc_id as b from d union select r.a, e.b from reach r join e on e.a = r.b)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.c as component_id, m.c = d.doc_id as kept
from d left join n using (doc_id) join (select a, min(b) as c from reach group by a) m on m.a = d.doc_id
"""

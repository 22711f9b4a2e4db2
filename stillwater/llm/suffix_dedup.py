"""Removal of long repeated byte strings, exact to the byte.

Every string of ``length`` bytes (a window) is assigned to its anchor, the
leftmost smallest hash of the 32-byte strings inside it.  The anchor depends on
the window's content alone, so equal windows have equal anchors at equal
offsets.  Neighbouring windows share anchors: a run of windows with one anchor is
one row (about one row per 130 windows), and all questions are settled inside
the groups of rows with equal anchor hashes:

* an anchor that occurs once holds no repeated window (most of a corpus);
* runs that are equal as whole strings repeat as a whole; a run that follows an
  equal one in the same text (periodic text) is counted with it in one row;
* the runs left, equal in part only, are laid out by their distinct strings, the
  windows are sorted, and adjacent ones compared.  Groups of many distinct
  strings are dealt out window by window and counted by partial aggregation, so
  none is ever gathered in one task.

Byte strings are compared by 64-bit hashes inside a group of equal 64-bit anchor
hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RollingHash, Scratch, text_blocks, text_buffer

LENGTH = 400
#: Length for passages: fifty words of prose are seldom fewer bytes.
PASSAGE = 200
GRAM = 32
#: Distinct strings of one anchor (some 600 bytes each) that one task compares; larger groups are dealt out by window.
GROUP_STRINGS = 2_000
_PLACE_BITS = np.uint64(24)
#: Bytes of one text parsed at a time; a cut inside a longer text only splits runs.
SEGMENT = 8 << 20


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    size, low = 1, values
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    n = len(values) - width + 1
    return np.minimum(low[:n], low[width - size : width - size + n])


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH):
    """(text, first window, number of windows, anchor hash, string hash, equal runs in a row) of every run."""
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64))
    rolling = RollingHash(data)
    grams = rolling.span(np.arange(len(data) - GRAM + 1), np.arange(GRAM, len(data) + 1))
    place = np.uint64((1 << int(_PLACE_BITS)) - 1)
    low = sliding_minimum((grams & ~place) | np.arange(len(grams), dtype=np.uint64), length - GRAM + 1)
    anchor = (low & place).astype(np.int64)
    text = np.searchsorted(offsets, np.arange(len(anchor)), "right") - 1
    inside = np.arange(len(anchor)) + length <= offsets[text + 1]
    change = np.ones(len(anchor) + 1, bool)
    change[1:-1] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(inside & change[:-1])
    last = np.flatnonzero(inside & change[1:])
    owner, n, key, whole = text[first], last - first + 1, grams[anchor[first]], rolling.span(first, last + length)
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1] + n[:-1]) | (n[1:] != n[:-1]) | (key[1:] != key[:-1]) | (whole[1:] != whole[:-1]) | (owner[1:] != owner[:-1])
    head = np.flatnonzero(new)
    return owner[head], first[head] - offsets[owner[head]], n[head], key[head], whole[head], np.diff(np.append(head, len(first)))


def _parse(length: int):
    def run(batches):
        for batch, a, b, data, offsets in text_blocks(batches):
            step = SEGMENT - length + 1
            for at in range(0, max(1, len(data) - length + 1), step):
                part = data[at : at + SEGMENT]
                text, first, count, anchor, whole, times = runs(part, np.clip(offsets - at, 0, len(part)), length)
                first = first + np.maximum(at - offsets[text], 0)
                uid = batch.column(0).slice(a, b - a).take(pa.array(text))
                yield pa.RecordBatch.from_arrays(
                    [uid, pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(first), pa.array(count), pa.array(times)],
                    ["uid", "anchor", "string", "first", "n", "times"],
                )

    return run


def _cut(length: int):
    """The bytes of the wanted strings of each text: rows (anchor, string, copies, n, bytes)."""
    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(batch.schema.get_field_index("text")))
            out = []
            for k, wanted in enumerate(batch.column(batch.schema.get_field_index("wanted")).to_pylist()):
                raw = data[offsets[k] : offsets[k + 1]].tobytes()
                out += [(w["anchor"], w["string"], w["copies"], w["n"], raw[w["first"] : w["first"] + w["n"] + length - 1]) for w in wanted]
            for a in range(0, len(out), 4096):
                cols = list(zip(*out[a : a + 4096]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2]), pa.array(cols[3]), pa.array(cols[4], pa.binary())], ["anchor", "string", "copies", "n", "bytes"]
                )

    return run


def _window_hashes(blobs: list[bytes], counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of the strings, and the string it is in."""
    data = np.frombuffer(b"".join(blobs), np.uint8)
    base = np.cumsum([0] + [len(x) for x in blobs[:-1]])
    owner = np.repeat(np.arange(len(blobs)), counts)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + base[owner]
    return RollingHash(data).span(start, start + length), owner


def ranges(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _compare(length: int):
    """Repeated window ranges of the single strings, group by group of a stream sorted by anchor."""
    def settle(rows):
        rows = list({r[1]: r for r in rows}.values())  # repeated input rows cut the same string twice
        counts = np.array([r[3] for r in rows], np.int64)
        hashes, owner = _window_hashes([r[4] for r in rows], counts, length)
        order = np.argsort(hashes, kind="stable")
        same = hashes[order][1:] == hashes[order][:-1]
        hit = np.zeros(len(hashes), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        at = np.cumsum(counts) - counts
        return [(r[0], r[1], ranges(hit[at[k] : at[k] + counts[k]])) for k, r in enumerate(rows) if r[2] == 1]

    def batch_of(out):
        return pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([[{"lo": x, "hi": y} for x, y in o[2]] for o in out], RANGES)],
            ["anchor", "string", "ranges"],
        )

    def run(batches):
        group, out = [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and group[0][0] != row[0]:
                    out += settle(group)
                    group = []
                    if len(out) >= 4096:
                        yield batch_of(out)
                        out = []
                group.append(row)
        if group:
            out += settle(group)
        if out:
            yield batch_of(out)

    return run


RANGES = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
_RANGES = "array<struct<lo:long,hi:long>>"


def _deal_windows(length: int):
    def run(batches):
        for batch in batches:
            anchor, string, copies, n, blob = (c.to_pylist() for c in batch.columns)
            for a in range(0, len(blob), 256):
                counts = np.array(n[a : a + 256], np.int64)
                hashes, owner = _window_hashes(blob[a : a + 256], counts, length)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                pick = pa.array(owner + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pick), batch.column(1).take(pick), batch.column(2).take(pick), pa.array(place), pa.array(hashes.view(np.int64))],
                    ["anchor", "string", "copies", "place", "window"],
                )

    return run


def _remove(keep_text: bool):
    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index
            data, offsets = text_buffer(batch.column(at("text")))
            total, removed, count, sha, kept = [], [], [], [], []
            spans = batch.column(at("spans"))
            lo, hi = (spans.values.field(x).to_numpy(zero_copy_only=False) for x in ("lo", "hi"))
            span_at = spans.offsets.to_numpy()
            for k in range(len(batch)):
                raw = data[offsets[k] : offsets[k + 1]]
                edge = np.zeros(len(raw) + 1, np.int32)
                np.add.at(edge, lo[span_at[k] : span_at[k + 1]], 1)
                np.add.at(edge, hi[span_at[k] : span_at[k + 1]], -1)
                mask = np.cumsum(edge[:-1]) > 0
                rest = raw[~mask].tobytes()
                total.append(len(raw))
                removed.append(int(mask.sum()))
                count.append(len(ranges(mask)))
                sha.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest.decode("utf-8", "ignore") if keep_text else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: -2], pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())],
                [*batch.schema.names[: -2], "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"],
            )

    return run


def repeated_spans(docs: DataFrame, scratch: Scratch, length: int = LENGTH) -> DataFrame:
    """``docs(uid, text)`` to ``uid, spans``: byte ranges covered by repeated windows (they may overlap).

    Counts per string and per anchor are aggregated before anything is joined,
    and every join reads written tables alone, so that adaptive execution splits
    the one anchor or string that many rows share.
    """
    parsed = scratch.save(docs.select("uid", "text").mapInArrow(_parse(length), "uid long, anchor long, string long, first long, n long, times long"), "runs")
    strings = parsed.groupBy("anchor", "string").agg(F.sum("times").alias("copies"), F.min(F.struct("uid", "first")).alias("at"), F.max("n").alias("n"))
    strings = scratch.save(strings.select("anchor", "string", "copies", "at.uid", "at.first", "n"), "all-strings")
    live = strings.groupBy("anchor").agg(F.sum("copies").alias("c"), F.count("*").alias("strings")).where("c > 1")
    live = scratch.save(live.select("anchor", "strings"), "live")
    shared = scratch.save(strings.join(live, "anchor"), "shared")
    several = shared.where("strings > 1")
    wanted = several.groupBy("uid").agg(F.collect_list(F.struct("anchor", "string", "copies", "n", "first")).alias("wanted"))
    wanted = scratch.save(wanted, "wanted")
    cut = docs.select("uid", "text").join(wanted, "uid").select("text", "wanted")
    cut = scratch.save(cut.mapInArrow(_cut(length), "anchor long, string long, copies long, n long, bytes binary"), "bytes")
    scratch.drop(strings, wanted)

    large = scratch.save(live.where(F.col("strings") > GROUP_STRINGS).select("anchor"), "large")
    small = cut.join(large, "anchor", "left_anti")
    settled = small.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare(length), f"anchor long, string long, ranges {_RANGES}")
    dealt = scratch.save(cut.join(large, "anchor", "left_semi").mapInArrow(_deal_windows(length), "anchor long, string long, copies long, place long, window long"), "windows")
    twice = (
        dealt.groupBy("anchor", "window")
        .agg(F.min("string").alias("lo"), F.max("string").alias("hi"), F.max("copies").alias("k"))
        .where("lo <> hi or k > 1").select("anchor", "window")
    )
    twice = scratch.save(twice, "twice")
    hit = dealt.where("copies = 1").join(twice, ["anchor", "window"])
    hit = hit.groupBy("anchor", "string").agg(F.collect_set(F.struct(F.col("place").alias("lo"), (F.col("place") + 1).alias("hi"))).alias("ranges"))
    settled = scratch.save(settled.unionByName(hit), "ranges")
    scratch.drop(cut, dealt, twice)

    # a string with one copy has one row; the rows of strings with more are covered whole
    once = shared.where("copies = 1").join(settled, ["anchor", "string"]).select("uid", "first", "ranges").where("size(ranges) > 0")
    whole = scratch.save(shared.where("copies > 1").select("anchor", "string"), "whole")
    all_of = parsed.join(whole, ["anchor", "string"]).select(
        "uid", "first", F.array(F.struct(F.lit(0).cast("long").alias("lo"), (F.col("n") * F.col("times")).alias("hi"))).alias("ranges")
    )
    found = scratch.save(once.unionByName(all_of), "found")
    scratch.drop(parsed, shared, live, settled, large, whole)
    spans = found.select("uid", "first", F.explode("ranges").alias("r")).select(
        "uid", F.struct((F.col("first") + F.col("r.lo")).alias("lo"), (F.col("first") + F.col("r.hi") + (length - 1)).alias("hi")).alias("s")
    )
    out = scratch.save(spans.groupBy("uid").agg(F.collect_set("s").alias("spans")), "spans")
    scratch.drop(found)
    return out


def _with_removed(docs: DataFrame, keep: list, text_col: str, id_col: str, keep_text: bool, schema: str, length: int) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "suffix")
    uid = F.xxhash64(F.col(id_col), F.col(text_col))
    named = docs.select(uid.alias("uid"), F.col(text_col).alias("text"))
    spans = repeated_spans(named, scratch, length)
    full = docs.select(*keep, uid.alias("uid"), F.col(text_col).alias("text")).join(spans, "uid", "left")
    columns = [c for c in full.columns if c not in ("uid", "text", "spans")]
    return full.select(*columns, "text", "spans").mapInArrow(_remove(keep_text), schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept_sha256`` per row.

    A byte goes if any string of ``length`` bytes over it also starts anywhere
    else, in the same or another row; all copies go.  Null and empty texts have
    no bytes; texts under ``length`` bytes lose nothing; repeated rows of so many
    bytes lose everything; ties do not arise; other columns are ignored, whatever
    their names.
    """
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    out = _with_removed(docs, [F.col(id_col).cast("long").alias("id")], text_col, id_col, False, schema, length)
    return out.drop("kept_text").withColumnRenamed("id", id_col)


def with_passages(removed: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = PASSAGE) -> DataFrame:
    """``remove_repeats``'s rows with ``n_shared`` (bytes of strings of ``length`` bytes that also start elsewhere) and ``shared``.

    Tells of passages that are too short for the removal.  Rows are matched by id;
    those of one id get the greatest ``n_shared`` among them.
    """
    short = remove_repeats(docs, id_col, text_col, length).where("n_removed > 0").groupBy(id_col).agg(F.max("n_removed").alias("n_shared"))
    n = F.coalesce("n_shared", F.lit(0)).cast("long")
    return removed.join(short, removed[id_col].eqNullSafe(short[id_col]), "left").select(*[removed[c] for c in removed.columns], n.alias("n_shared"), (n > 0).alias("shared"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars", length: int = PASSAGE) -> DataFrame:
    """All rows of ``docs`` with repeated strings cut from the text, ``count_col`` counted anew.

    A character cut in two by the end of a removed string goes as a whole.  A
    null text stays null.
    """
    keep = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    kind = docs.select(keep).schema["row"].dataType.simpleString()
    schema = f"row {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    out = _with_removed(docs, [keep], text_col, id_col, True, schema, length)
    text = F.when(F.col(f"row.`{text_col}`").isNotNull(), F.col("kept_text"))
    columns = []
    for c in docs.columns:
        if c == text_col:
            columns.append(text.alias(c))
        elif c == count_col:
            columns.append(F.length(text).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(f"row.`{c}`").alias(c))
    return out.select(*columns)

"""Benchmark decontamination with one Aho-Corasick automaton.

Test items are normalised to runs of words; every window of 13 words (or the
whole item if it is shorter) becomes a pattern, with its item ids as payload.
Each document is normalised once, scanned once, and hits are mapped back to the
byte offsets of the original text.
"""

from __future__ import annotations

import hashlib
import pickle

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_blocks, word_bounds

WINDOW = 13
#: Bytes of normalised item text that one automaton takes; more items are scanned in blocks.
#: A node of the automaton takes some 50 bytes, and a byte of a pattern is a node at most.
AUTOMATON_BYTES = 8 << 20

#: Text that is held while several automata pass over it.
GROUP_BYTES = 32 << 20

#: Word bytes: digits, letters (lower-cased) and everything beyond ASCII.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x41:0x5B] = WORD[0x61:0x7B] = WORD[0x80:] = True
FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if WORD[b] else 32 for b in range(256))


def item_windows(text: str | None, window: int = WINDOW) -> list[bytes]:
    words = (text or "").encode().translate(FOLD).split(b" ")
    words = [w for w in words if w]
    if not words:
        return []
    return [b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


def build_automaton(items: list[tuple[int, str | None]]) -> ahocorasick.Automaton:
    """Patterns carry (number of words, item ids); spaces fence the words.  An item without an id is a pattern without a name."""
    owners: dict[bytes, set] = {}
    for item, text in items:
        for w in item_windows(text):
            owners.setdefault(w, set()).add(item)
    automaton = ahocorasick.Automaton()
    for w, ids in owners.items():
        automaton.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, tuple(sorted(i for i in ids if i is not None))))
    if owners:
        automaton.make_automaton()
    return automaton


def scan(automaton: ahocorasick.Automaton, words: bytes, n_words: int) -> tuple[np.ndarray, set]:
    """Mask of the words that a pattern covers, and the items found.  ``words`` is fenced by spaces."""
    hit, found = np.zeros(n_words, bool), set()
    if n_words and len(automaton):
        ends = None
        for at, (size, ids) in automaton.iter(words.decode("latin-1")):
            if ends is None:
                ends = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)[1:]
            last = int(np.searchsorted(ends, at)) + 1
            hit[last - size : last] = True
            found.update(ids)
    return hit, found


def _scan_group(automata, group):
    """Each block of ``group`` with its word bounds, and per text the words covered and items found by any automaton."""
    out = []
    for batch, a, b, data, offsets in group:
        starts, ends, per = word_bounds(data, offsets, WORD)
        raw, n_words = data.tobytes().translate(FOLD), np.diff(per)
        words = [b" " + b" ".join(raw[offsets[k] : offsets[k + 1]].split()) + b" " for k in range(b - a)]
        out.append((batch, a, b, offsets, starts, ends, per, words, [np.zeros(n, bool) for n in n_words], [set() for _ in n_words]))
    for automaton in automata:
        for *_, words, masks, found in out:
            for k, mask in enumerate(masks):
                hit, items = scan(automaton, words[k], len(mask))
                mask |= hit
                found[k] |= items
        del automaton  # before the next one is built
    for batch, a, b, offsets, starts, ends, per, _, masks, found in out:
        yield batch, a, b, offsets, starts, ends, per, masks, found


#: The automaton of this worker process, by the digest of its items.
_built: dict[bytes, ahocorasick.Automaton] = {}


def worker_automaton(packed: bytes) -> ahocorasick.Automaton:
    """The automaton of pickled items, kept from task to task."""
    key = hashlib.sha256(packed).digest()
    if key not in _built:
        _built.clear()
        _built[key] = build_automaton(pickle.loads(packed))
    return _built[key]


def _scanned(packed, batches):
    """``_scan_group`` over all texts; one automaton is in memory at a time.

    A single automaton is kept by the worker, several are built anew for
    each ``GROUP_BYTES`` of text.
    """
    kept = [worker_automaton(packed[0].value)] if len(packed) == 1 else None
    group, size = [], 0
    for block in text_blocks(batches):
        group.append(block)
        size += len(block[3])
        if kept or size >= GROUP_BYTES:
            yield from _scan_group(kept or (build_automaton(pickle.loads(p.value)) for p in packed), group)
            group, size = [], 0
    if group:
        yield from _scan_group((build_automaton(pickle.loads(p.value)) for p in packed), group)


def leaks(hit: np.ndarray, window: int = WINDOW) -> bool:
    """Whether a full window of words in a row is hit, or 5 % of all words are."""
    if 20 * int(hit.sum()) >= max(1, len(hit)):
        return True
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return bool(len(edge)) and int((edge[1::2] - edge[::2]).max()) >= window


def _scanner(packed):
    def run(batches):
        for batch, a, b, offsets, starts, ends, per, masks, found in _scanned(packed, batches):
            spans = []
            for k, hit in enumerate(masks):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                base = per[k]
                spans.append([
                    {"first_word": int(x), "n": int(y - x), "start": int(starts[base + x] - offsets[k]), "end": int(ends[base + y - 1] - offsets[k])}
                    for x, y in zip(edge[::2], edge[1::2])
                ])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(np.diff(per).astype(np.int64)), pa.array([sorted(f) for f in found], pa.list_(pa.int64())), pa.array(spans, SPANS)],
                ["id", "n_words", "items", "spans"],
            )

    return run


def _cleaner(packed):
    def run(batches):
        for batch, a, b, *_, masks, _ in _scanned(packed, batches):
            yield batch.slice(a, b - a).filter(pa.array([not leaks(m) for m in masks], pa.bool_()))

    return run


SPANS = pa.list_(pa.struct([("first_word", pa.int64()), ("n", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
_SCHEMA = "id long, n_words long, items array<long>, spans array<struct<first_word:long,n:long,start:long,end:long>>"


def _item_blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """Item lists that each fit one automaton."""
    rows, size = [], 0
    for r in benchmark.select(F.col(id_col).cast("long"), text_col).toLocalIterator():
        grown = WINDOW * len((r[1] or "").encode())
        if rows and size + grown > AUTOMATON_BYTES:
            yield rows
            rows, size = [], 0
        rows.append((r[0], r[1]))
        size += grown
    yield rows


def _packed(benchmark: DataFrame, item_col: str, item_text_col: str) -> list:
    spark = benchmark.sparkSession
    return [spark.sparkContext.broadcast(pickle.dumps(rows)) for rows in _item_blocks(benchmark, item_col, item_text_col)]


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``id, n_words, items, spans`` for every row: items found and hit runs of words.

    Spans give word and byte offsets in the original UTF-8 text.  One automaton
    is broadcast if the patterns fit ``AUTOMATON_BYTES``; a larger benchmark is
    cut into blocks, which are united text by text, so rows with a null or
    repeated id stay apart.  Null and empty texts have no words; an item without
    words is never found; repeated items share a pattern; an item without an id
    marks words but is neither counted nor named.  A very long text is scanned as
    one.  Ties do not arise; other columns are ignored, whatever their names.
    No shuffle.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(_scanner(_packed(benchmark, item_col, item_text_col)), _SCHEMA)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns and the text in ``text``, that do not leak test items.

    A row leaks if 13 words in a row are hit, however long its text, or 5 % of its
    words are (which short items alone may do).  Decided by row: null and repeated ids play no part.  No shuffle.
    """
    return docs.mapInArrow(_cleaner(_packed(benchmark, item_col, item_text_col)), docs.schema)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row: words, hit words, items, and whether 5 % or more of the words are hit."""
    hits = benchmark_hits(docs, benchmark, id_col, text_col, item_col, item_text_col)
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["n"])
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return hits.select(
        F.col("id").alias(id_col),
        "n_words",
        covered.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), '{u}', '{l}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')".format(u=_UPPER, l=_LOWER)

ORACLE_SQL = f"""
with d as (select doc_id, {_WORDS} as ws from documents), b as (select item_id, {_WORDS} as ws from benchmark),
pat as (select distinct item_id, least(len(ws), {WINDOW}) as n, array_to_string(ws[i:i + least(len(ws), {WINDOW}) - 1], ' ') as p
    from (select item_id, ws, unnest(range(1, greatest(len(ws) - {WINDOW} + 1, 1) + 1)) as i from b where len(ws) > 0)),
sizes as (select distinct n from pat),
win as (select doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') as p from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from d, sizes where len(ws) >= n)),
hit as (select w.doc_id, w.n, w.i, pat.item_id from win w join pat on pat.n = w.n and pat.p = w.p),
words as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from hit) group by doc_id),
items as (select doc_id, count(item_id) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as names from (select distinct doc_id, item_id from hit) group by doc_id)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(names, '')) as items_sha256,
    coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join words using (doc_id) left join items using (doc_id)
"""

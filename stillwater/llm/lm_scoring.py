"""Language-model scoring by a hierarchical Pitman-Yor bigram model.

Every context word has a restaurant whose customers are the words seen after it;
all context restaurants share one parent over single words, which shares a
uniform base over the V known words and the unknown one.  The state is the
number of tables that each dish has in each restaurant.  A Gibbs sweep alternates
the two levels: given the parent's tables all customers of every dish of every
context leave and sit down anew by the Chinese-restaurant rule, and the number of
their tables is drawn from its conditional distribution (``drawn_tables``); the
tables so drawn are the parent's customers, whose own tables are drawn next; the
other dishes' tables are those of the sweep before, so shards sample side by side.  After burn-in every sweep gives
a predictive probability of each pair, and the mean of these probabilities is the
model's.

Data flow, with nothing but a few numbers per shard on the driver:

1. *chunks*: a task turns its documents into (context, word) pairs, sorts them
   and writes one file with a segment per shard; a pair's shard is its hash, so
   a frequent context or word is spread over all shards;
2. *shards* add up the pairs of all chunks, keep those with several customers
   (one customer is one table for good) and send, for each word they hold, its
   counts and tables to the word's owner (*words*), which replies with the sums;
3. each sweep reads only what was kept: shards draw, words draw, words reply;
4. shards answer each chunk with the mean probabilities of its pairs, and the
   chunk's task adds them up by document.

Files lie in the shared folder under names unique to the task attempt, and only
files named by Spark's committed manifests are read.  Words are 64-bit hashes.
"""

from __future__ import annotations

import struct
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, id_remainder, mix, remove_path, text_blocks, word_hashes
from .records import open_folder

#: Text bytes of one chunk and of one shard (a shard holds the pairs of so much text).
CHUNK_BYTES, SHARD_BYTES = 14 << 20, 12 << 20
END = np.uint64(0x243F6A8885A308D3)
STRENGTH = 1.0
#: Sweeps before the first that counts, and sweeps that count.
BURN_IN, SAMPLES = 3, 3
#: Customers of a dish up to which its number of tables is drawn exactly.
EXACT = 512


# ------------------------------------------------------------------ files of segments


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed byte planes."""
    parts = [struct.pack("<I", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts.append(struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)))
        parts.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    (n,), at, out = struct.unpack_from("<I", raw), 4, []
    for _ in range(n):
        kind, size = struct.unpack_from("<2sQ", raw, at)
        dtype = np.dtype("<" + kind.decode())
        at += 10
        planes = np.frombuffer(raw, np.uint8, size * dtype.itemsize, at).reshape(dtype.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).view(dtype).reshape(-1))
        at += size * dtype.itemsize
    return out


def steps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=np.uint64(0))


def write_segments(folder: str, segments: list[bytes]) -> str:
    files, root = open_folder(folder)
    files.create_dir(root, recursive=True)
    name = uuid.uuid4().hex
    offsets = np.cumsum([8 * (len(segments) + 1)] + [len(s) for s in segments]).astype("<u8")
    with files.open_output_stream(f"{root}/{name}") as f:
        f.write(offsets.tobytes())
        for s in segments:
            f.write(s)
    return f"{folder}/{name}"


def read_segment(path: str, k: int) -> list[np.ndarray]:
    files, at = open_folder(path)
    with files.open_input_file(at) as f:
        a, b = struct.unpack("<QQ", f.read_at(16, 8 * k))
        return unpack(f.read_at(b - a, a))


def owner(words: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` equal hash ranges each word is in."""
    return ((words >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def pair_hash(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return mix(u * np.uint64(0x9E3779B97F4A7C15) + mix(v))


# ------------------------------------------------------------------ 1: chunks


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the texts, each closed by ``END``, and tokens per text."""
    words, per = word_hashes(data, offsets)
    n = np.diff(per)
    out = np.empty(len(words) + len(n), np.uint64)
    out[np.arange(len(words)) + np.repeat(np.arange(len(n)), n)] = words
    out[per[1:] + np.arange(len(n))] = END
    return out, n + 1


def chunk_segments(found: np.ndarray, doc: np.ndarray, train: np.ndarray, shards: int) -> list[bytes]:
    """A segment per shard: context list, word list, pairs, counts, and the document of each token."""
    vocabulary, v = np.unique(found, return_inverse=True)
    u = np.concatenate([[np.searchsorted(vocabulary, END)], v[:-1]])
    code = (u.astype(np.uint64) << np.uint64(32)) | v.astype(np.uint64)
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    size = np.diff(first, append=len(code))
    pu, pv = (code[first] >> np.uint64(32)).astype(np.int64), (code[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    learnt = np.add.reduceat(train[doc[order]].astype(np.int64), first)
    shard = owner(pair_hash(vocabulary[pu], vocabulary[pv]), shards).astype(np.int64)
    of_token = np.repeat(shard, size)
    docs, out = doc[order], []
    for r in range(shards):
        p = np.flatnonzero(shard == r)
        lu, ui = np.unique(pu[p], return_inverse=True)
        lv, vi = np.unique(pv[p], return_inverse=True)
        out.append(pack(
            steps(vocabulary[lu]), np.bincount(ui, minlength=len(lu)).astype(np.uint32), steps(vocabulary[lv]), vi.astype(np.uint32),
            size[p].astype(np.uint32), learnt[p].astype(np.uint32), docs[of_token == r].astype(np.uint32),
        ))
    return out


def _chunker(folder: str, shards: int):
    def close(held):
        found, n, ids, null, train = (np.concatenate(x) for x in zip(*held))
        doc = np.repeat(np.arange(len(n)), n)
        table = pack(ids, null.astype(np.uint8), (~train).astype(np.uint8), n.astype(np.uint32))
        path = write_segments(folder, [*chunk_segments(found, doc, train, shards), table])
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(n)], pa.int64())], ["path", "n_docs"])

    def run(batches):
        held, size = [], 0
        for batch, a, b, data, offsets in text_blocks(batches):
            found, n = tokens(data, offsets)
            ids = batch.column(0).slice(a, b - a)
            train = np.array(batch.column(1).slice(a, b - a).to_pylist(), bool)
            held.append((found, n, np.array(ids.fill_null(0).to_numpy(zero_copy_only=False), np.int64), np.array(ids.is_null().to_pylist(), bool), train))
            size += len(data)
            if size >= CHUNK_BYTES:
                yield close(held)
                held, size = [], 0
        if held:
            yield close(held)

    return run


# ------------------------------------------------------------------ 2: shards and words


class Shard:
    """The pairs of one shard over all chunks."""

    def __init__(self, chunks: list[str], r: int):
        keys, us, vs, learnt, self.sizes, self.docs = [], [], [], [], [], []
        for path in chunks:
            lu, runs, lv, vi, size, train, doc = read_segment(path, r)
            u, v = np.repeat(np.cumsum(lu, dtype=np.uint64), runs), np.cumsum(lv, dtype=np.uint64)[vi]
            keys.append(pair_hash(u, v))
            us.append(u)
            vs.append(v)
            learnt.append(train)
            self.sizes.append(size)
            self.docs.append(doc)
        self.cuts = np.cumsum([0] + [len(k) for k in keys])
        _, first, self.pair = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        u, v = np.concatenate(us)[first], np.concatenate(vs)[first]
        self.words = np.union1d(u, v)
        self.u, self.v = np.searchsorted(self.words, u), np.searchsorted(self.words, v)
        self.c = np.bincount(self.pair, np.concatenate(learnt), len(first)).astype(np.int64)

    def sums(self, index: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.bincount(index, values, len(self.words)).astype(np.float64)


def send(folder: str, words: np.ndarray, values: list[np.ndarray], parts: int) -> str:
    """A file with a segment per owner; ``words`` ascend, so each is a slice."""
    cut = np.searchsorted(owner(words, parts), np.arange(parts + 1))
    return write_segments(folder, [pack(steps(words[a:b]), *(x[a:b] for x in values)) for a, b in zip(cut[:-1], cut[1:])])


def received(paths: list[str], r: int) -> list[np.ndarray]:
    """The owners' replies to shard ``r``, in the order of its words."""
    return [np.concatenate(x) for x in zip(*(read_segment(p, r) for p in paths))]


@lru_cache(maxsize=4)
def log_stirling(d: float, n: int = 512) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: weight of all seatings of c customers (row) at t tables (column)."""
    out = np.full((n + 1, n + 2), -np.inf)
    out[1, 1] = 0
    t = np.arange(n + 2)
    for k in range(1, n):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = np.where((t >= 1) & (t <= k), out[k] + np.log(np.maximum(k - d * t, 1e-300)), -np.inf)
        out[k + 1, 1:] = np.logaddexp(stay[1:], out[k, :-1])
    return out


def drawn_tables(c: np.ndarray, w: np.ndarray, d: float, rng) -> np.ndarray:
    """Tables of dishes whose ``c`` customers all sit down anew, where a new table weighs ``w``.

    Seatings of c customers at t tables weigh ``w ** t`` times the generalised
    Stirling number, so up to ``EXACT`` customers the number is drawn from its
    conditional distribution.  Beyond, from the saddle point of that
    distribution's generating function exp(w / d (1 - (1 - x) ** d)).
    """
    table, t = log_stirling(d), np.ones(len(c))
    order = np.argsort(c, kind="stable")
    sizes, first = np.unique(c[order], return_index=True)
    for size, a, b in zip(sizes.tolist(), first, np.append(first[1:], len(c))):
        if not 1 < size <= EXACT:
            continue
        step = max(1, (1 << 20) // size)
        for lo in range(a, b, step):
            rows = order[lo : min(lo + step, b)]
            p = np.log(w[rows])[:, None] * np.arange(1, size + 1) + table[size, 1 : size + 1]
            p = np.cumsum(np.exp(p - p.max(axis=1, keepdims=True)), axis=1)
            t[rows] = 1 + (p < (rng.random(len(rows)) * p[:, -1])[:, None]).sum(axis=1)
    large = np.flatnonzero(c > EXACT)
    if len(large):
        n, v = c[large].astype(np.float64), w[large]
        low, high = np.full(len(n), -700.0), np.zeros(len(n))  # logarithm of 1 - x, where v x (1 - x) ** (d - 1) = n
        for _ in range(60):
            y = (low + high) / 2
            beyond = np.log(v) + np.log(-np.expm1(y)) + (d - 1) * y > np.log(n)
            low, high = np.where(beyond, y, low), np.where(beyond, high, y)
        x = -np.expm1(high)
        mean = v / d * -np.expm1(d * high)
        spread = np.maximum(mean - n * n / (n + v * (1 - d) * x * x * np.exp((d - 2) * high)), 0)
        drawn = np.where(mean < 50, rng.poisson(np.minimum(mean, 50)), np.rint(mean + np.sqrt(spread) * rng.normal(size=len(n))))
        t[large] = np.clip(1 + drawn, 1, n)
    return t


def discount(ones: float, twos: float) -> float:
    return float(np.clip(ones / max(ones + 2 * twos, 1), 0.05, 0.95))


def _whole(x: np.ndarray) -> np.ndarray:
    return np.rint(x).astype(np.uint32) if len(x) == 0 or x.max() < 1 << 32 else np.rint(x).astype(np.uint64)


def _counter(chunks: list[str], folder: str, kept: str, shards: int):
    """First exchange, every pair with one table; keeps the pairs with several customers for the sweeps."""
    def run(batches):
        for batch in batches:
            for r in batch.column(0).to_pylist():
                s = Shard(chunks, r)
                one, many = (s.c > 0).astype(np.float64), np.flatnonzero(s.c > 1)
                path = send(folder, s.words, [_whole(s.sums(s.v, s.c)), _whole(s.sums(s.u, one)), _whole(s.sums(s.v, one))], shards)
                single = (s.c == 1).astype(np.float64)
                state = write_segments(kept, [pack(steps(s.words), s.u[many].astype(np.uint32), s.v[many].astype(np.uint32), _whole(s.c[many]), _whole(s.sums(s.u, single)), _whole(s.sums(s.v, single)))])
                yield pa.RecordBatch.from_pylist([{"part": r, "path": f"{path}|{state}", "a": float((s.c == 1).sum()), "b": float((s.c == 2).sum()), "c": 0.0, "d": 0.0, "e": 0.0, "f": 0.0}])

    return run


def _word_owner(requests: list[str], folder: str, seed: int, m: dict | None = None):
    """Sum what the shards sent, seat the parent's customers, reply."""
    def run(batches):
        for batch in batches:
            for q in batch.column(0).to_pylist():
                sent = [read_segment(p, q) for p in requests]
                each = [np.cumsum(x[0], dtype=np.uint64) for x in sent]
                words, at = np.unique(np.concatenate(each), return_inverse=True)
                sums = [np.bincount(at, np.concatenate([x[k] for x in sent]), len(words)) for k in range(1, len(sent[0]))]
                n = np.rint(sums[-1]).astype(np.int64)
                own = discount((n == 1).sum(), (n == 2).sum()) if m is None else m["d1"]
                new = own if m is None else (STRENGTH + own * m["t"]) / (m["V"] + 1)
                tables = np.where(n > 0, drawn_tables(n, np.full(len(n), new), own, np.random.default_rng((seed, q))), 0)
                sums.append(tables)
                cut = np.cumsum([0] + [len(x) for x in each])
                path = write_segments(folder, [pack(*(_whole(x[at[a:b]]) for x in sums)) for a, b in zip(cut[:-1], cut[1:])])
                c = sums[0] if len(sums) == 4 else np.zeros(0)
                yield pa.RecordBatch.from_pylist([{"part": q, "path": path, "a": float(c.sum()), "b": float((c > 0).sum()), "c": float(sums[-2].sum()), "d": float(tables.sum()), "e": float((n == 1).sum()), "f": float((n == 2).sum())}])

    return run


def parent(n: np.ndarray, tables: np.ndarray, total: float, total_tables: float, known: float, d: float) -> np.ndarray:
    """Predictive probability of each word in the parent restaurant."""
    return (np.maximum(n - d * tables, 0) + (STRENGTH + d * total_tables) / (known + 1)) / (STRENGTH + total)


def predictive(c, t, c_u, t_u, base, d: float):
    """Probability of a word after a context: its own customers and tables there, the context's, and the parent's probability."""
    room = STRENGTH + c_u
    return np.maximum(c - d * t, 0) / room + (STRENGTH + d * t_u) / room * base


def _sampler(kept: list[str], replies: list[str], folder: str, drawn: str, shards: int, m: dict, seed: int):
    """Draw the tables of the pairs with several customers; the sums go to the words' owners."""
    def run(batches):
        for batch in batches:
            for r in batch.column(0).to_pylist():
                words, u, v, c, ones_u, ones_v = read_segment(kept[r], 0)
                words = np.cumsum(words, dtype=np.uint64)
                t_u, n_v, t_v = (x.astype(np.float64) for x in received(replies, r)[-3:])
                base = parent(n_v, t_v, m["n"], m["t"], m["V"], m["d1"])
                t = drawn_tables(c.astype(np.int64), (STRENGTH + m["d"] * t_u[u]) * base[v], m["d"], np.random.default_rng((seed, r)))
                sums = [_whole(np.bincount(k, t, len(words)) + ones) for k, ones in ((u, ones_u), (v, ones_v))]
                path, state = send(folder, words, sums, shards), write_segments(drawn, [pack(_whole(t))])
                yield pa.RecordBatch.from_pylist([{"part": r, "path": f"{path}|{state}", "a": 0.0, "b": 0.0, "c": 0.0, "d": 0.0, "e": 0.0, "f": 0.0}])

    return run


# ------------------------------------------------------------------ 4: scores


def rounded(x: np.ndarray) -> np.ndarray:
    """To 16 significant bits, so that the last byte of each answer takes no room."""
    return ((x.astype(np.float32).view(np.uint32) + np.uint32(0x80)) & np.uint32(0xFFFFFF00)).view(np.float32)


def _scorer(chunks: list[str], counts: list[str], samples: list[tuple[list[str], list[str], dict]]):
    """Answer every chunk: log10 of the mean probability of each of its pairs over the samples, and the count of each of its words."""
    def run(batches):
        for batch in batches:
            for r in batch.column(0).to_pylist():
                s = Shard(chunks, r)
                c_word = received(counts, r)[0].astype(np.float64)
                many, p = np.flatnonzero(s.c > 1), np.zeros(len(s.c))
                for states, replies, m in samples:
                    t_u, n_v, t_v = (x.astype(np.float64) for x in received(replies, r))
                    t = (s.c > 0).astype(np.float64)
                    t[many] = read_segment(states[r], 0)[0]
                    base = parent(n_v, t_v, m["n"], m["t"], m["V"], m["d1"])
                    p += predictive(s.c, t, c_word[s.u], t_u[s.u], base[s.v], m["d"])
                score, of_pair = rounded(np.log10(p / len(samples))), _whole(c_word[s.v])
                for k in range(len(chunks)):
                    pair = s.pair[s.cuts[k] : s.cuts[k + 1]]
                    answer = pack(score[pair], of_pair[pair])
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([r], pa.int64()), pa.array([answer], pa.binary())], ["chunk", "shard", "answer"])

    return run


def _finisher(chunks: list[str], shards: int, m: dict):
    """Add up each chunk's answers by document; rows sorted by chunk, and the chunk's own file read again."""
    def rows(table, total):
        ids, null, held, n = table
        score, base, known = total
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, mask=null.astype(bool)), pa.array(held.astype(bool)), pa.array(n.astype(np.int64)), pa.array(np.rint(known).astype(np.int64)),
                pa.array(np.full(len(ids), int(m["N"]), np.int64)), pa.array(base), pa.array(score), pa.array(10 ** (-score / n)),
            ],
            ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
        )

    def run(batches):
        at, table, total = None, None, None
        for batch in batches:
            for k, r, answer in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if k != at:
                    if at is not None:
                        yield rows(table, total)
                    at, table = k, read_segment(chunks[k], shards)
                    total = np.zeros((3, len(table[0])))
                *_, per, _, doc = read_segment(chunks[k], r)
                p, c = unpack(answer)
                pair = np.repeat(np.arange(len(per)), per)
                for j, x in enumerate((p, np.log10((c + 1.0) / (m["N"] + m["V"] + 1)), c > 0)):
                    total[j] += np.bincount(doc, x[pair], len(table[0]))
        if at is not None:
            yield rows(table, (total[0], total[1], total[2]))

    return run


_PART = "part long, path string, a double, b double, c double, d double, e double, f double"
_OUT = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def score_documents(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """Learn from the rows where ``held_out`` is false, score every row.

    ``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score,
    perplexity``; scores are log10 probabilities of the whole text with its end.
    Null and empty texts are the end alone; repeated rows count and are scored
    each; a null id is scored like others (its remainder is unknown: it trains);
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    held = F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (~held).alias("train"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))

    def parts(function, name):
        """One task per shard; the small manifest is stored before it is read."""
        table = scratch.save(spark.range(0, shards, 1, shards).mapInArrow(function, _PART), name)
        return sorted(table.collect(), key=lambda p: p.part)

    made = scratch.save(rows.mapInArrow(_chunker(scratch.path("chunks"), shards), "path string, n_docs long"), "manifest")
    chunks = sorted((r.path, r.n_docs) for r in made.collect())
    if not chunks:
        return rows.limit(0).select(
            F.col("id").alias(id_col), (~F.col("train")).alias("held_out"),
            *[F.lit(0).cast(t).alias(n) for n, t in (x.split() for x in _OUT.split(", ")[2:])],
        )
    paths = [p for p, _ in chunks]
    asked = scratch.path("counts")
    sent = parts(_counter(paths, asked, scratch.path("kept"), shards), "counted")
    kept = [p.path.split("|")[1] for p in sent]
    first = parts(_word_owner([p.path.split("|")[0] for p in sent], scratch.path("replies"), seed), "owned")
    m = {"N": sum(p.a for p in first), "V": sum(p.b for p in first), "n": sum(p.c for p in first), "t": sum(p.d for p in first)}
    m["d"] = discount(sum(p.a for p in sent), sum(p.b for p in sent))
    m["d1"] = discount(sum(p.e for p in first), sum(p.f for p in first))
    remove_path(spark, asked)
    counts = [p.path for p in first]
    replies, samples, left = counts, [], []
    for sweep in range(BURN_IN + SAMPLES):
        asked, states, answers = (scratch.path(x) for x in ("asked", "tables", "replies"))
        drawn = parts(_sampler(kept, replies, asked, states, shards, m, seed + 2 * sweep + 1), "drawn")
        second = parts(_word_owner([p.path.split("|")[0] for p in drawn], answers, seed + 2 * sweep + 2, m), "owned")
        remove_path(spark, asked)
        for path in left:  # nothing reads the sweep before any more
            remove_path(spark, path)
        m = m | {"n": sum(p.c for p in second), "t": sum(p.d for p in second)}
        replies = [p.path for p in second]
        left = [] if sweep >= BURN_IN else [states, answers]
        if sweep >= BURN_IN:
            samples.append(([p.path.split("|")[1] for p in drawn], replies, m))
    remove_path(spark, kept[0].rsplit("/", 1)[0])
    answers = spark.range(0, shards, 1, shards).mapInArrow(_scorer(paths, counts, samples), "chunk long, shard long, answer binary")
    n = min(len(paths), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = answers.repartition(n, "chunk").sortWithinPartitions("chunk", "shard")
    return dealt.mapInArrow(_finisher(paths, shards, m), _OUT).withColumnRenamed("id", id_col)


def language_model_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores with the rows held out whose id remainder modulo 7 is 2."""
    return score_documents(docs, id_remainder(id_col, 7) == 2, id_col, text_col)

"""Quality rules with thresholds taken from the data, in DataFrame functions only.

Each document gets counts; each (lang, source) group gets a mergeable quantile
sketch of every measure: counts of integer buckets that keep six significant
bits, so a quantile is off by 1/32 at most, merging is addition, and the order
of merging does not matter.  Sketches of small groups are merged upwards (all
sources of the language, then everything).  A document is rejected where a
measure lies outside its group's fences, the quartiles widened by three times
their distance (or by a least margin where the quartiles almost coincide).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fits_broadcast

#: White space of the word rule.
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: measure: (numerator, denominator, scale, least margin above, least margin below or None)
MEASURES = {
    "symbols": ("n_symbols", "n_words", 1000, 150, None),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 300, None),
    "repeats": ("n_repeat_words", "n_words", 1000, 200, None),
    "word_length": ("word_chars", "n_words", 100, 200, 200),
}
SPREAD = 3
#: Documents that a group's own sketch must hold; smaller groups use the merged one.
LEAST_GROUP = 50
#: Threshold rows (one per language and source) that are broadcast; more are joined by shuffle.
BROADCAST_GROUPS = 50_000


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the array."""
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    )

    def covered(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def count(p: Column) -> Column:
            same = F.filter(
                p,
                lambda x, k: F.coalesce(F.get(p, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False)),
            )
            return F.size(F.array_distinct(F.flatten(F.transform(same, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ranked, count))

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(hashes, covered))


def measured(docs: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    """``keep`` columns with the counts of the rules and ``base_failed``."""
    text = F.coalesce(text, F.lit(""))
    packed = F.translate(text, BLANKS, "")
    bare = F.btrim(text, F.lit(BLANKS))
    n_words = F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, "[ \\t\\n\\x0B\\f\\r]+")))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    return docs.select(
        *keep,
        n_words.cast("long").alias("n_words"),
        F.length(packed).cast("long").alias("word_chars"),
        (F.length(packed) - F.length(F.translate(packed, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("_lines"),
        let(F.split(bare, "[ \\t\\n\\x0B\\f\\r]+"), repeat_words).cast("long").alias("n_repeat_words"),
    ).select(
        *[c for c in docs.select(*keep).columns],
        "n_words", "word_chars", "n_symbols",
        F.col("_lines.n").alias("n_lines"), F.col("_lines.dup").alias("n_dup_lines"), "n_repeat_words",
        F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words").alias("base_failed"),
    )


def bucket(v: Column) -> Column:
    """Lower end of the sketch bucket of a non-negative integer."""
    s = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, s), s)


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket) with the number of documents; adding rows merges sketches."""
    values = F.array(*[
        F.struct(F.lit(m).alias("m"), bucket(F.expr(f"{scale} * {num} div nullif({den}, 0)")).alias("b")) for m, (num, den, scale, _, _) in MEASURES.items()
    ])
    return (
        counted.where("not base_failed")
        .select("lang", "source", F.explode(values).alias("x"))
        .groupBy("lang", "source", F.col("x.m").alias("m"), F.col("x.b").alias("b"))
        .agg(F.count("*").alias("c"))
    )


def fences(sketch: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """Sketch size and fences of each measure of each group of ``keys``."""
    merged = sketch.groupBy(*keys, "m", "b").agg(F.sum("c").alias("c"))
    w = Window.partitionBy(*keys, "m")
    up = merged.select(
        *keys, "m", "b",
        F.sum("c").over(w.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)).alias("cum"), F.sum("c").over(w).alias("n"),
    )
    q = up.groupBy(*keys, "m").agg(
        F.max("n").alias(f"n{tag}"), F.min(F.expr("if(4 * cum >= n, b, null)")).alias("q1"), F.min(F.expr("if(4 * cum >= 3 * n, b, null)")).alias("q3")
    )
    above = F.create_map(*[F.lit(x) for m, d in MEASURES.items() for x in (m, d[3])])[F.col("m")]
    below = F.create_map(*[F.lit(x) for m, d in MEASURES.items() if d[4] is not None for x in (m, d[4])])[F.col("m")]
    spread = SPREAD * (F.col("q3") - F.col("q1"))
    return q.select(
        *keys, "m", f"n{tag}", (F.col("q3") + F.greatest(spread, above)).alias(f"hi{tag}"),
        F.when(below.isNotNull(), F.col("q1") - F.greatest(spread, below)).alias(f"lo{tag}"),
    )


def thresholds(sketch: DataFrame) -> DataFrame:
    """A row per (lang, source): upper and lower fence of each measure."""
    own, of_lang, of_all = fences(sketch, ["lang", "source"], "2"), fences(sketch, ["lang"], "1"), fences(sketch, [], "0")
    l1 = of_lang.withColumnsRenamed({"lang": "lang_", "m": "m_"})
    all_ = own.join(l1, F.col("lang").eqNullSafe(F.col("lang_")) & (F.col("m") == F.col("m_"))).drop("lang_", "m_").join(of_all, "m")

    def pick(x: str) -> Column:
        return F.when(F.col("n2") >= LEAST_GROUP, F.col(f"{x}2")).when(F.col("n1") >= LEAST_GROUP, F.col(f"{x}1")).otherwise(F.col(f"{x}0"))

    chosen = all_.select("lang", "source", "m", pick("hi").alias("hi"), pick("lo").alias("lo"))
    return chosen.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("m") == m, F.col(x))).alias(f"{m}_{x}") for m in MEASURES for x in ("hi", "lo")]
    )


def judged(counted: DataFrame, scratch: Scratch) -> DataFrame:
    """``counted`` (a stored table) with ``kept``: joined with its group's thresholds."""
    limits = scratch.save(thresholds(sketches(counted)), "thresholds").withColumnsRenamed({"lang": "lang_", "source": "source_"})
    if fits_broadcast(limits, BROADCAST_GROUPS):
        limits = F.broadcast(limits)
    match = counted.lang.eqNullSafe(limits.lang_) & counted.source.eqNullSafe(limits.source_)
    inside = F.lit(True)
    for m, (num, den, scale, _, _) in MEASURES.items():
        v = F.expr(f"{scale} * {num} div nullif({den}, 0)")
        inside = inside & F.coalesce(v <= F.col(f"{m}_hi"), F.lit(True)) & F.coalesce(v >= F.col(f"{m}_lo"), F.lit(True))
    return counted.join(limits, match, "left").withColumn("kept", ~F.col("base_failed") & inside)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts and verdict per input row: ``id_col`` and ``COUNTS``.

    Null and empty texts have no words and fail; a null language or source is a
    group like any other; repeated rows get equal results and count each in the
    sketches; other columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    keep = [F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source")]
    counted = scratch.save(measured(docs, F.col(text_col), keep), "counts")
    return judged(counted, scratch).select(F.col("id").alias(id_col), *COUNTS)


def quality_filter(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns unchanged."""
    scratch = Scratch(docs.sparkSession, "quality")
    keep = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source")]
    counted = scratch.save(measured(docs, F.col(text_col), keep), "counts")
    return judged(counted, scratch).where("kept").select("row.*")


def _measure_sql(table: str) -> str:
    return " union all ".join(
        f"select lang, source, '{m}' as m, ({scale} * {num}) // {den} as v from {table} where not base_failed" for m, (num, den, scale, _, _) in MEASURES.items()
    )


def _fence_sql(keys: str, tag: str) -> str:
    k = f"{keys}, " if keys else ""
    above = " ".join(f"when '{m}' then {d[3]}" for m, d in MEASURES.items())
    below = " ".join(f"when '{m}' then {d[4]}" for m, d in MEASURES.items() if d[4] is not None)
    return f"""(select {k}m, n as n{tag}, q3 + greatest({SPREAD} * (q3 - q1), case m {above} end) as hi{tag},
        case when m in ({', '.join(f"'{m}'" for m, d in MEASURES.items() if d[4] is not None)}) then q1 - greatest({SPREAD} * (q3 - q1), case m {below} else 0 end) end as lo{tag}
      from (select {k}m, max(n) as n, min(b) filter (where 4 * cum >= n) as q1, min(b) filter (where 4 * cum >= 3 * n) as q3
        from (select {k}m, b, sum(c) over (partition by {k}m order by b) as cum, sum(c) over (partition by {k}m) as n
          from (select {k}m, b, sum(c) as c from sketch group by {k}m, b)) group by {k}m))"""


_PICK = "case when n2 >= {least} then {x}2 when n1 >= {least} then {x}1 else {x}0 end as {x}"

ORACLE_SQL = f"""
with d as (select doc_id, lang, source, coalesce(text, '') as text,
    list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '') as ws from documents),
lines as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0b\\f\\r]')) as ls from d),
tri as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as t from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from d where len(ws) >= 3)),
rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from (select doc_id, i, count(*) over (partition by doc_id, t) as k from tri) where k > 1) group by doc_id),
counts as (select d.doc_id, lang, source, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, len(ls)::bigint as n_lines, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
    coalesce(rep.n, 0)::bigint as n_repeat_words from d join lines using (doc_id) left join rep using (doc_id)),
judged as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counts),
sketch as (select lang, source, m, (v >> s) << s as b, count(*) as c from (select *, greatest(length(bin(v)) - 6, 0)::bigint as s from ({_measure_sql('judged')})) group by all),
limits as (select lang, source, m, {_PICK.format(x='hi', least=LEAST_GROUP)}, {_PICK.format(x='lo', least=LEAST_GROUP)}
    from {_fence_sql('lang, source', '2')} a join {_fence_sql('lang', '1')} b using (lang, m) join {_fence_sql('', '0')} c using (m)),
wide as (select lang, source, {', '.join(f"max({x}) filter (where m = '{m}') as {m}_{x}" for m in MEASURES for x in ('hi', 'lo'))} from limits group by lang, source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed and {' and '.join(f"coalesce(({s} * {num}) // {den} <= {m}_hi, true) and coalesce(({s} * {num}) // {den} >= {m}_lo, true)" for m, (num, den, s, _, _) in MEASURES.items())} as kept
from judged left join wide on judged.lang is not distinct from wide.lang and judged.source is not distinct from wide.source
"""

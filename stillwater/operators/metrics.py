"""Counters, histograms, and the metrics text in both directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Histogram bounds.
LATENCY_SECONDS = [0.00005, 0.0001, 0.00025, 0.0005, 0.001, 0.0025, 0.005, 0.01, 0.05, 0.1]
RESPONSE_BYTES = [64, 256, 1024, 4096, 16384, 65536, 262144, 1048576]


def lookup_counts(lookups: DataFrame) -> DataFrame:
    """Lookups by dataset and result; an unknown prefix counts as ``_unknown``."""
    return lookups.groupBy(F.coalesce("dataset", F.lit("_unknown")).alias("dataset"), "result").agg(F.count("*").alias("n"))


def miss_io_ratio(lookups: DataFrame) -> DataFrame:
    """Misses that read over all misses, in millionths; null without misses."""
    io, miss = F.count_if(F.col("result") == "miss_io"), F.count_if(F.col("result").isin("miss", "miss_io"))
    return lookups.groupBy("dataset").agg(F.when(miss > 0, F.floor(io * 1_000_000 / miss)).cast("long").alias("ratio_ppm"))


def histogram(rows: DataFrame, value: Column, bounds: list, by: list[str]) -> DataFrame:
    """Cumulative counts up to each bound and in all (``le`` null), by group, in one aggregation."""
    counts = [F.count_if(value <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = rows.groupBy(*by).agg(*counts, F.count(value).alias("all"))
    cells = [F.struct(F.lit(i).cast("long").alias("bucket"), F.col(f"b{i}").alias("n")) for i in range(len(bounds))] + [F.struct(F.lit(len(bounds)).cast("long").alias("bucket"), F.col("all").alias("n"))]
    return wide.select(*by, F.explode(F.array(*cells)).alias("x")).select(*by, "x.bucket", "x.n")


def connection_counts(events: DataFrame) -> DataFrame:
    """Connections opened, and open now, by transport."""
    opened, closed = F.count_if(F.col("event") == "open"), F.count_if(F.col("event") == "close")
    return events.groupBy("transport").agg(opened.alias("total"), (opened - closed).alias("active"))


def label_value(value: Column) -> Column:
    """A label's text with backslash, quote and line feed escaped."""
    text = F.replace(value.cast("string"), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def _tags(labels: list[str], more: list[tuple[str, Column]] = ()) -> Column:
    pairs = [(x, label_value(F.col(x))) for x in labels] + list(more)
    if not pairs:
        return F.lit("")
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'{x}="'), v, F.lit('"')) for x, v in pairs]), F.lit("}"))


def _family(rows: DataFrame, name: str, kind: str, help_text: str) -> DataFrame:
    text = help_text.replace("\\", "\\\\").replace("\n", "\\n")
    head = rows.sparkSession.createDataFrame([(0, f"# HELP {name} {text}"), (1, f"# TYPE {name} {kind}")], "ord int, line string")
    return head.unionByName(rows.select("ord", "line")).orderBy("ord", "line")


def exposition(values: DataFrame, name: str, help_text: str, labels: list[str], kind: str = "counter") -> DataFrame:
    """Text lines (``ord, line``) of a counter or gauge family over ``values(*labels, n)``, version 0.0.4, sorted by labels."""
    rows = values.select(F.lit(2).alias("ord"), F.concat(F.lit(name), _tags(labels), F.lit(" "), F.col("n").cast("string")).alias("line"))
    return _family(rows, name, kind, help_text)


def histogram_exposition(cells: DataFrame, name: str, help_text: str, labels: list[str], bounds: list, sums: DataFrame) -> DataFrame:
    """Lines of a histogram family: ``cells(*labels, bucket, n)`` as ``histogram`` gives them, ``sums(*labels, total)``."""
    edge = F.when(F.col("bucket") == len(bounds), "+Inf").otherwise(F.element_at(F.array(*[F.lit(f"{b:g}") for b in bounds], F.lit("+Inf")), (F.col("bucket") + 1).cast("int")))
    line = lambda suffix, tags, value: F.concat(F.lit(name + suffix), tags, F.lit(" "), value.cast("string")).alias("line")
    buckets = cells.select(F.lit(2).alias("ord"), line("_bucket", _tags(labels, [("le", edge)]), F.col("n")))
    counts = cells.where(F.col("bucket") == len(bounds)).select(F.lit(4).alias("ord"), line("_count", _tags(labels), F.col("n")))
    totals = sums.select(F.lit(3).alias("ord"), line("_sum", _tags(labels), F.col("total")))
    return _family(buckets.unionByName(totals).unionByName(counts), name, "histogram", help_text)


def parse_text(lines: DataFrame) -> DataFrame:
    """``lines(doc, pos, line)`` to ``doc, pos, name, value, help``.

    Labels stay in the name; a timestamp is ignored; help is that of the name
    without labels, else without ``_total``; malformed lines are left out.
    """
    text = F.btrim("line", F.lit(" \t\r\n"))
    clean = lines.select("doc", "pos", text.alias("line")).where("line <> '' and line <> '# EOF'")
    name = F.regexp_extract("line", "^# HELP ([^ ]+) (.*)$", 1)
    helps = clean.where("line like '# HELP %'").select("doc", name.alias("name"), F.regexp_extract("line", "^# HELP ([^ ]+) (.*)$", 2).alias("help"), "pos").where("name <> ''")
    helps = helps.groupBy("doc", "name").agg(F.max_by("help", "pos").alias("help"))
    brace = F.instr("line", "{") > 1
    labelled, plain = "^([^{]+\\{[^}]*\\})\\s*([^ ]*)", "^(\\S+)\\s+(\\S+)"
    rows = clean.where("line not like '#%'").select(
        "doc", "pos",
        F.when(brace, F.regexp_extract("line", labelled, 1)).otherwise(F.regexp_extract("line", plain, 1)).alias("name"),
        F.when(brace, F.regexp_extract("line", labelled, 2)).otherwise(F.regexp_extract("line", plain, 2)).alias("value"),
    ).where("name <> ''")
    rows = rows.withColumn("base", F.when(F.instr("name", "{") > 1, F.substring_index("name", "{", 1)).otherwise(F.col("name"))).withColumn("short", F.regexp_replace("base", "_total$", ""))
    a, b = helps.select("doc", F.col("name").alias("base"), F.col("help").alias("h1")), helps.select("doc", F.col("name").alias("short"), F.col("help").alias("h2"))
    out = rows.join(a, ["doc", "base"], "left").join(b, ["doc", "short"], "left")
    return out.select("doc", "pos", "name", "value", F.coalesce(F.nullif("h1", F.lit("")), "h2", F.lit("")).alias("help"))

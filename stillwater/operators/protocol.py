"""The read-only line protocol: commands parsed, responses framed, per connection and in order."""

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEMVER = "0.1.0"


def parsed(line: Column) -> dict[str, Column]:
    """Kind, key, flags and body length of a command line without its CRLF."""
    get = line.rlike("^mg +[^ ]+( +[^ ]+)* *$") & ~line.rlike("^mg +[^ ]+.* $")
    words = F.filter(F.split(line, " +"), lambda w: w != "")
    flags = F.transform(F.slice(words, 3, 1_000_000), lambda w: F.substring(w, 1, 1))
    write = line.rlike("^ms +[^ ]+ +[0-9]+")
    kind = (
        F.when(get, "get").when(line == "version", "version").when(line == "quit", "quit")
        .when(write, "write_rejected").when(line.rlike("^m[da]"), "write_rejected").otherwise("error")
    )
    out = {"kind": kind, "key": F.when(get, F.get(words, F.lit(1)))}
    for f in "vthk":
        out[f"flag_{f}"] = F.when(get, F.array_contains(flags, f)).otherwise(F.lit(False))
    out["body_bytes"] = F.when(write, F.regexp_extract(line, "^ms +[^ ]+ +([0-9]+)", 1).cast("long")).otherwise(F.lit(0))
    return out


def commands(lines: DataFrame) -> DataFrame:
    """``lines(conn, seq, line)`` parsed; rows after a connection's first error or quit are dropped."""
    out = lines.withColumns(parsed(F.col("line")))
    before = Window.partitionBy("conn").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max(F.col("kind").isin("error", "quit")).over(before), F.lit(False))
    return out.withColumn("_e", ended).where("not _e").drop("_e")


def framed_stream(chunks: DataFrame) -> DataFrame:
    """``chunks(conn, seq, data)`` of raw bytes to ``conn, seq, line`` of complete commands.

    Bytes of a connection are joined in order and cut at CRLF; the body of an
    ``ms`` command and its CRLF are skipped.  An incomplete last command is not
    returned.  A connection is bounded by its own traffic in the batch.
    """
    def cut(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        data, lines = b"".join(bytes(x) for x in pdf.sort_values("seq")["data"]), []
        at = 0
        while (end := data.find(b"\r\n", at)) >= 0:
            line = data[at:end]
            words = line.split()
            skip = int(words[2]) + 2 if line.startswith(b"ms ") and len(words) > 2 and words[2].isdigit() else 0
            if end + 2 + skip > len(data):
                break
            lines.append(line.decode("utf-8", "replace"))
            at = end + 2 + skip
        return pd.DataFrame({"conn": [key[0]] * len(lines), "seq": range(1, len(lines) + 1), "line": lines})

    return chunks.groupBy("conn").applyInPandas(cut, "conn long, seq long, line string")


def response(kind: Column, key: Column, value: Column, status: Column, flag_k: Column, flag_t: Column, generation: int = 0) -> Column:
    """Framed text: VA with its echoes (key, then t-1), EN, errors, version; quit answers nothing."""
    hit = F.concat(
        F.lit("VA "), F.octet_length(value).cast("string"), F.when(flag_k, F.concat(F.lit(" k"), key)).otherwise(""),
        F.when(flag_t, " t-1").otherwise(""), F.lit("\r\n"), value, F.lit("\r\n"),
    )
    return (
        F.when((kind == "get") & (status == "hit"), hit).when((kind == "get") & (status == "miss"), "EN\r\n")
        .when(kind == "get", "SERVER_ERROR internal error\r\n").when(kind == "version", f"VERSION {SEMVER} gen/{generation}\r\n")
        .when(kind == "write_rejected", "SERVER_ERROR read-only\r\n").when(kind == "error", "ERROR\r\n").otherwise("")
    )


def valid_client_key(key: Column) -> Column:
    return (F.length(key) > 0) & ~key.rlike("[ \r\n]")


def client_parsed(text: Column) -> dict[str, Column]:
    """What a client reads from one framed response."""
    head = F.substring_index(text, "\r\n", 1)
    n = F.regexp_extract(head, "^VA ([0-9]+)", 1)
    body = F.substring(text, F.length(head) + 3, F.length(text))
    hit = head.startswith("VA ")
    return {
        "outcome": F.when(hit, "hit").when(head == "EN", "miss").when(head.startswith("SERVER_ERROR") | head.startswith("ERROR"), "error").otherwise("bad"),
        "value": F.when(hit, F.substring(body, F.lit(1), F.length(body) - 2)),
        "declared": F.when(hit, n.cast("long")),
    }


def response_bytes(kind: Column, key: Column, value: Column, status: Column, flag_k: Column, flag_t: Column, generation: int = 0) -> Column:
    """``response`` over a stored binary value: the header as text, the value as it is."""
    b = lambda x: (F.lit(x) if isinstance(x, str) else x).cast("binary")
    head = F.concat(F.lit("VA "), F.octet_length(value).cast("string"), F.when(flag_k, F.concat(F.lit(" k"), key)).otherwise(""), F.when(flag_t, " t-1").otherwise(""), F.lit("\r\n"))
    hit = F.concat(b(head), value, b("\r\n"))
    return F.when((kind == "get") & (status == "hit"), hit).otherwise(b(response(kind, key, F.lit(""), status, flag_k, flag_t, generation)))


def served(chunks: DataFrame, entries: DataFrame, lookups, generation: int = 0) -> DataFrame:
    """``chunks(conn, seq, data)`` of raw bytes to ``conn, seq, response``: a response per complete command, in its connection's order.

    Keys are routed by prefix to a dataset, whose ``Lookup`` in ``lookups`` (a
    factory) answers; an unknown prefix is a miss, a key without a prefix an
    internal error.  After an error or quit a connection gets nothing more.  Sort
    by ``conn, seq`` to write; the rows are not collected anywhere.
    """
    from . import catalog

    asked = commands(framed_stream(chunks))
    routed = catalog.route(asked.where("kind = 'get'").select("conn", "seq", "key"), entries)
    found = None
    for dataset in sorted(lookups.roots):
        mine = routed.where((F.col("outcome") == "routed") & (F.col("dataset") == dataset))
        got = lookups.lookup(dataset).get(mine.select(F.col("bare_key").cast("binary").alias("key")).distinct())
        one = mine.select("conn", "seq", F.col("bare_key").cast("binary").alias("k")).join(got.withColumnRenamed("key", "k"), "k").select("conn", "seq", "status", "value")
        found = one if found is None else found.unionByName(one)
    rows = asked.join(routed.select("conn", "seq", "outcome"), ["conn", "seq"], "left")
    if found is not None:
        rows = rows.join(found, ["conn", "seq"], "left")
    else:
        rows = rows.withColumns({"status": F.lit(None).cast("string"), "value": F.lit(None).cast("binary")})
    status = F.when(F.col("outcome") == "unknown", "miss").when(F.col("status").startswith("miss"), "miss").when(F.col("outcome") == "routed", F.col("status")).otherwise("error")
    answer = response_bytes(F.col("kind"), F.col("key"), F.col("value"), status, F.col("flag_k"), F.col("flag_t"), generation)
    return rows.select("conn", "seq", answer.alias("response")).where(F.octet_length("response") > 0)

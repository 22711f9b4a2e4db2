"""Names, previews and display texts, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import hex_lower

VALID_NAME = "^[a-z0-9._-]+$"


def key_preview(key: Column, limit: int = 64) -> Column:
    """Text of a key for messages: invalid bytes replaced, cut after ``limit`` characters."""
    text = F.make_valid_utf8(key.cast("string"))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit), F.lit("…")))


def prefix_of(key: Column) -> Column:
    """What stands before the first colon; null if there is none."""
    at = F.instr(key, ":")
    return F.when(at > 0, F.substring(key, F.lit(1), at - 1))


def bare_key(key: Column) -> Column:
    at = F.instr(key, ":")
    return F.when(at > 0, F.substring(key, at + 1, F.length(key)))


def valid_name(name: Column) -> Column:
    return name.rlike(VALID_NAME)


def resource_name(*parts: Column) -> Column:
    """Lower-case name for a build resource: other characters become single hyphens, 253 at most."""
    name = F.regexp_replace(F.lower(F.concat_ws("-", *parts)), "[^a-z0-9]+", "-")
    return F.rtrim(F.substring(name, 1, 253), F.lit("-"))


def attachment_name(volume: Column, prefix: str = "va") -> Column:
    return resource_name(F.lit(prefix), volume)


def version_name(dataset: Column, version: Column) -> Column:
    return F.concat_ws("-", dataset, version)


def schedule_version(ts: Column) -> Column:
    """Version id of a scheduled build, the UTC time of its start."""
    return F.date_format(ts, "yyyyMMdd-HHmmss")


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def printable(value: Column) -> Column:
    """Valid UTF-8 without control characters other than tab, newline and return."""
    text = value.cast("string")
    return F.is_valid_utf8(text) & ~F.coalesce(text.rlike("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]"), F.lit(False))


def display_value(value: Column) -> Column:
    return F.when(printable(value), value.cast("string")).otherwise(hex_lower(value))


def human_bandwidth(rate: Column) -> Column:
    """Bytes a second in steps of 1000 with one decimal."""
    units = ["B/s", "KB/s", "MB/s", "GB/s", "TB/s"]
    out = F.format_string("%.1f " + units[-1], rate / 1e12)
    for k in reversed(range(4)):
        out = F.when(rate < 1000 ** (k + 1), F.format_string("%.1f " + units[k], rate.cast("double") / 1000.0**k)).otherwise(out)
    return out


def duration_text(seconds: Column) -> Column:
    s = seconds.cast("long")
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 3600, F.format_string("%dm%ds", F.floor(s / 60), s % 60))
        .otherwise(F.format_string("%dh%dm", F.floor(s / 3600), F.floor(s / 60) % 60))
    )


def phase_class(phase: Column) -> Column:
    return (
        F.when(phase == "active", "phase-active").when(phase == "error", "phase-error")
        .when(phase.isin("attaching", "mounting"), "phase-progress").otherwise("")
    )


def table_resource(name: Column) -> Column:
    """Full resource name of a dotted or full table name; null if malformed."""
    parts = F.split(name, "\\.", 3)
    dotted = F.when(F.size(parts) == 3, F.format_string("projects/%s/datasets/%s/tables/%s", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))))
    return F.when(name.startswith("projects/"), name).otherwise(dotted)


def table_project(name: Column, override: Column | None = None) -> Column:
    """Project to bill: the override, else the table's; null if malformed."""
    own = F.when(name.startswith("projects/"), F.get(F.split(name, "/"), F.lit(1))).when(
        F.size(F.split(name, "\\.", 3)) == 3, F.get(F.split(name, "\\.", 3), F.lit(0))
    )
    return own if override is None else F.when(own.isNotNull(), F.coalesce(override, own))


def object_uri(uri: Column, scheme: str = "gs://") -> tuple[Column, Column, Column]:
    """Bucket, object and error (null if well formed) of an object URI."""
    rest = F.when(uri.startswith(scheme), F.substring(uri, F.lit(len(scheme) + 1), F.length(uri)))
    at = F.instr(rest, "/")
    bucket, name = F.substring(rest, F.lit(1), at - 1), F.substring(rest, at + 1, F.length(rest))
    error = (
        F.when(rest.isNull(), "scheme").when(at == 0, "no object path")
        .when((F.length(bucket) == 0) | (F.length(name) == 0), "empty bucket or object")
    )
    ok = error.isNull()
    return F.when(ok, bucket), F.when(ok, name), error


def qualified_name(package: Column, message: Column) -> Column:
    return F.when(F.coalesce(package, F.lit("")) == "", message).otherwise(F.concat_ws(".", package, message))

"""The corpus pipeline: five stages over ``documents``, each one of the llm operators.

Every stage takes the rows that the one before it kept and decides on them
alone.  All but the last return rows with the columns of ``documents``:

* quality rules: rejected documents go;
* near duplicates: of every group the document with the smallest id stays;
* repeated strings: every 200-byte string that starts twice is cut from the
  texts (fifty words are seldom shorter), and ``n_chars`` counted anew; no
  document goes;
* decontamination: documents with 13 words in a row inside benchmark windows, or
  with such windows over 5 % or more of their words, go;
* packing: pieces of the documents in sequences of 4096 ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillwater.llm import queries
from stillwater.llm.common import Scratch, fits_broadcast
from stillwater.llm.decontaminate import without_contaminated
from stillwater.llm.minhash import near_duplicates
from stillwater.llm.packing import pack_documents
from stillwater.llm.quality import quality_filter
from stillwater.llm.suffix_dedup import without_repeats


#: Ids of dropped documents up to which they are broadcast: some 16 MB.
BROADCAST_IDS = 1_000_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without an id stay: nothing names the row that would replace them.  Rows of one id go together.

    The ids that go are written and counted: few are broadcast, so that no text is
    shuffled; many are joined by shuffle.
    """
    dropped = near_duplicates(docs).where("doc_id is not null and not kept").select("doc_id").distinct()
    dropped = Scratch(spark, "dropped").save(dropped, "ids")
    side = F.broadcast(dropped) if fits_broadcast(dropped, BROADCAST_IDS) else dropped
    return docs.join(side, "doc_id", "left_anti").select(*docs.columns)


def repeated_string_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, queries.tokenizer_path("word_bpe_49k.json"), end_id=2)


#: Folders that the stages before the last have left, by place.
_left: dict[int, list[Scratch]] = {}


def tidy(k: int, stage):
    """The stage, first deleting what the one before it left, unless its input still rests on that.

    A stage's result is written before the next one starts, so its working
    tables have served; without this they would add up over the stages.
    """
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if left := _left.pop(k - 1, []):
            used = docs.inputFiles()
            for s in left:
                if not any(s.root.split(":")[-1].lstrip("/") in f for f in used):
                    s.remove()
        before = len(Scratch.made)
        out = stage(spark, docs, sf_dir)
        _left[k] = Scratch.made[before:]
        return out

    run_stage.__doc__ = stage.__doc__
    return run_stage


STAGES = [
    (name, tidy(k, stage))
    for k, (name, stage) in enumerate([
        ("quality rules", quality_stage),
        ("near duplicates", near_duplicate_stage),
        ("repeated strings", repeated_string_stage),
        ("decontamination", decontamination_stage),
        ("packing", packing_stage),
    ])
]

#: The near-duplicate, token and checksum stages have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

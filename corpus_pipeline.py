"""The corpus pipeline: language ID, line dedup, near duplicates, decontamination, mixing.

Each stage takes all that its predecessor kept. `run` writes what a stage returns as Parquet in
the shared folder, reads it again for the next one, and deletes what it has read.

All stages take only the columns of `documents`, so further columns cannot clash, and give an
empty table for an empty one. A null id is a value like any other; texts are taken whole whatever
their length; rows that repeat id and text are told apart from rows that only share the id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm import entropy_mix, jaccard_join, line_templates, ppm, winnow
from tessera.llm.common import keyed_columns, numbered_copies, remove_stored, scratch_space, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Texts of at least so many bytes that every language codes in more bits than raw bytes are rejected.
REJECT_BYTES, REJECT_BITS = 100, 8.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts in no language that was learned, and gives unlabelled ones the predicted language.

    Null texts, texts without a letter (empty ones too) and texts of `REJECT_BYTES` or more that
    every language codes in more than `REJECT_BITS` bits a byte go; without any labelled row all go.
    Labels that are there stay. Repeated rows share their fate; ties go to the label that sorts first.
    """
    trees = ppm.fit(docs.where(~ppm.held_out()))
    found = ppm.identify(docs.select(*COLUMNS), trees)
    raw = (F.octet_length("text") >= REJECT_BYTES) & (F.col("bits") > REJECT_BITS)
    kept = found.where((F.col("lang_pred") != ppm.UND) & ~raw)
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines of recurring templates; a document that loses all its lines goes.

    Lines that stand in full in a few documents stay: copies of documents are the next stage's
    work, which should see them whole. Null and empty texts stay as they are; n_chars follows a text
    that has changed. Of equal lines those of the smallest id stay, in all its rows.
    """
    out = line_templates.dedup_lines(docs.select(*COLUMNS), exact_tokens=None)
    kept = out.where((F.col("n_dropped") == 0) | (F.col("n_dropped") < F.col("n_lines")))
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each class of near duplicates.

    A null id is the least one; of rows with that id the text with the smallest hash stays, and of
    rows that repeat id and text one. Null and empty texts are classes of their own, one for each id.
    """
    firsts = jaccard_join.join(docs).where("first").groupBy(F.col("kd").alias("__kd"), F.col("th").alias("__th")).agg(F.count("*").alias("__n"))
    kept = docs.select(*COLUMNS).withColumns(keyed_columns()).join(firsts, ["__kd", "__th"])
    # rows that repeat id and text are the only ones with one key
    again = kept.where("__n > 1").dropDuplicates(["__kd", "__th"])
    return kept.where("__n = 1").unionByName(again).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold too much of the benchmark: one hit word in `winnow.ONE_IN`, at least one.

    Null and empty texts stay; an empty benchmark drops nothing; repeated rows share their fate.
    """
    out = winnow.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return out.where(~winnow.contaminated(F.col("n_hit"), F.col("n_words"))).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its copies, numbered from 1 in `copy`.

    Rows that repeat id, text and source share the copies that they get together, so that each has
    the same number or one more; `copy` numbers those of one row. Null and empty texts have no
    words and are not taken; a null source is a source of its own.
    """
    keys = keyed_columns() | {"__source": F.col("source")}
    taken = entropy_mix.mix(docs).groupBy("kd", "th", "source").agg(F.count("*").alias("__n"), F.sum("copies").alias("__all")).where("__all > 0")
    taken = taken.withColumnsRenamed({"kd": "__kd", "th": "__th", "source": "__from"})
    same = ["__kd", "__th"]
    out = docs.select(*COLUMNS).withColumns(keys).join(taken, same).where(F.col("__source").eqNullSafe(F.col("__from"))).drop("__from")
    once = out.where("__n = 1").withColumn("__copies", F.col("__all"))
    # of repeated rows, equal ones are counted, and the copies are dealt along them
    many = out.where("__n > 1").groupBy(*COLUMNS, *same, "__source", "__n", "__all").agg(F.count("*").alias("__rows"))
    upto = F.sum("__rows").over(W.partitionBy(*same, "__source").orderBy(*COLUMNS).rowsBetween(W.unboundedPreceding, 0))
    many = numbered_copies(many.withColumn("__before", upto - F.col("__rows")), "__rows", "__nth")
    place = F.col("__before") + F.col("__nth")
    share = lambda k: F.floor(k * F.col("__all") / F.col("__n"))
    many = many.withColumn("__copies", share(place + 1) - share(place))
    both = once.select(*COLUMNS, "__copies").unionByName(many.select(*COLUMNS, "__copies"))
    return numbered_copies(both, "__copies", "copy").select(*COLUMNS, (F.col("copy") + 1).alias("copy"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language ID", language),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mixture),
]

#: The stages learn, iterate and hash, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        if i + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)  # its rows are read from what the last stage but one has kept
        with scratch_space(spark) as keep:
            docs = keep(stored(stage(spark, docs, sf_dir), "pipeline"))
        if before is not None:
            remove_stored(before)
        before = docs
    return docs

"""Token counts behind a digest cache.

The cache is a Parquet table in shared storage, keyed by the SHA-256 of the normalised text
and of the tokenizer's file. A batch is grouped by digest, so that each distinct text is sent
once by each task that has it, and joined to the cache; only the texts that it misses are
encoded, and their counts are appended. Rows then get their counts by digest; that join is
left to adaptive execution to split where one text has very many copies.

Counts are those of the vocabulary's own library. A rank file of the same vocabulary may be
given, which another library counts several times as fast; texts that it can't count, such as
very long runs of white space, are counted by the vocabulary's library.

Defined results: null counts as the empty text (0 tokens); repeated rows and ids each get
their row back; a text is encoded whole whatever its length. Only the id and the text are
read, so further columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import os

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import remove, scratch, scratch_space, slices, stored, table

VOCABULARY = "byte_bpe_50k.json"
#: The same vocabulary as ranks, which another library counts several times as fast.
RANKS = "byte_bpe_50k.tiktoken"
LIMIT = 1024


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def encoder(path: str):
    """A function from texts to token counts, for a .json or a .model file."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


def ranked_encoder(path: str, special: dict[str, int]):
    """The same function by a rank file; special strings in texts are one token each, as in the .json file's default."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    model = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda texts: [len(model.encode(x, allowed_special="all")) for x in texts]


def combined_encoder(ranks: str, special: dict[str, int], vocabulary: str):
    """Counts by the rank file, and by the vocabulary's library where that fails on a text."""
    fast, exact = ranked_encoder(ranks, special), None

    def count(texts: list[str]) -> list[int]:
        nonlocal exact
        out = []
        for text in texts:
            try:
                out += fast([text])
            except ValueError:  # its patterns have a bound on backtracking
                exact = exact or encoder(vocabulary)
                out += exact([text])
        return out

    return count


def specials(path: str) -> dict[str, int]:
    from tokenizers import Tokenizer

    return {token.content: i for i, token in Tokenizer.from_file(path).get_added_tokens_decoder().items()}


def probes(special: dict[str, int]) -> list[str]:
    """Texts in which every character below U+3000 meets letters, digits, marks and spaces."""
    return [f"a{c}b 1{c}2 {c}{c}! {c}  {c}\n" for c in map(chr, range(0x3000))] + ["", *special, "a ".join(special) + " b'll 've  \n\n x"]


class TokenCache:
    """Counts by (tokenizer digest, text digest), kept as an append-only Parquet table.

    path: the table's folder, in storage that driver and executors share.
    vocabulary: the tokenizer's file on the driver; it is shipped to the executors, and its
    digest versions the cache, so another vocabulary never meets these counts.
    ranks: a rank file of the same vocabulary, for faster counts; it must count like the
    vocabulary on a set of probes, or the constructor raises.
    """

    FIELDS = "text_digest binary, n_tokens long, tokenizer string"

    def __init__(self, spark: SparkSession, path: str, vocabulary: str, ranks: str | None = None):
        self.spark, self.path, self.version = spark, path, file_digest(vocabulary)
        self.name = os.path.basename(vocabulary)
        self.special = specials(vocabulary) if ranks else {}
        self.ranks = os.path.basename(ranks) if ranks else None
        if ranks:
            texts = probes(self.special)
            if encoder(vocabulary)(texts) != ranked_encoder(ranks, self.special)(texts):
                raise ValueError(f"{ranks} does not count like {vocabulary}")
            spark.sparkContext.addFile(ranks)
        spark.sparkContext.addFile(vocabulary)

    def appended(self) -> DataFrame:
        """(text_digest, n_tokens) of this tokenizer; two jobs may have appended the same digest."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], self.FIELDS).select("text_digest", "n_tokens")
        rows = self.spark.read.schema(self.FIELDS).parquet(self.path)
        return rows.where(F.col("tokenizer") == self.version).select("text_digest", "n_tokens")

    def entries(self, of: DataFrame | None = None) -> DataFrame:
        """A count for each digest, or for those digests only that another table names."""
        rows = self.appended()
        if of is not None:  # what is grouped and written follows the batch, not the history
            rows = rows.join(of.select("text_digest").distinct(), "text_digest", "left_semi")
        return rows.groupBy("text_digest").agg(F.min("n_tokens").alias("n_tokens"))

    def _rows(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("text_digest", F.unhex(F.sha2(F.encode("text", "utf-8"), 256)))

    def fill(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Encodes the distinct texts that the cache misses and appends their counts."""
        rows, name, version, ranks, special = self._rows(docs, id_col, text_col), self.name, self.version, self.ranks, self.special
        distinct = rows.groupBy("text_digest").agg(F.first("text").alias("text"))
        misses = distinct.join(self.appended(), "text_digest", "left_anti")

        def encode(batches):
            count = combined_encoder(SparkFiles.get(ranks), special, SparkFiles.get(name)) if ranks else encoder(SparkFiles.get(name))
            for batch in batches:
                for part in slices(batch):
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count(part.column(1).to_pylist()), pa.int64())], ["text_digest", "n_tokens"])

        counts = misses.mapInArrow(encode, "text_digest binary, n_tokens long")
        counts.withColumn("tokenizer", F.lit(version)).write.mode("append").parquet(self.path)

    def count(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
        """Fills the cache and returns doc_id, n_bytes, n_tokens, over_limit for every row."""
        self.fill(docs, id_col, text_col)
        rows = self._rows(docs, id_col, text_col).select("doc_id", "text_digest", F.octet_length("text").cast("long").alias("n_bytes"))
        with scratch_space(self.spark) as keep:
            # a written table, so that the join's rows come from plain shuffles, which can be split
            found = rows.join(keep(stored(self.entries(rows), "token-counts")), "text_digest", "left")
            return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


#: The setting that names a cache to be used and extended; without it a query starts with none.
CACHE = "spark.tessera.tokenCache"


def op5_token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = spark.conf.get(CACHE, None)
    path = named or scratch(spark, "token-cache")
    cache = TokenCache(spark, path, vocabulary_path(), vocabulary_path(RANKS))
    out = cache.count(table(spark, sf_dir, "documents"))
    if not named:
        remove(spark, path)  # the counts of the result are a table of their own
    return out

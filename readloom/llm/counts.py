"""Token counts: rollups maintained by deltas.

A change is a pair of images of a document's count, before and after: an insert has no before, a delete no after, a
revised count has both. Its signed rows add to totals by source, language and tokenizer version. A batch is written as one
folder of summed deltas of its own and committed by renaming that to the batch's name, which fails if the name is taken: of
two writers of one batch one commits. A batch that is delivered again is left out, and one whose job was lost is written
anew, so every batch counts once. Totals are the sums over the committed batches; `compact` replaces many batches by one of
their sum and keeps their ids: it sums just the folders that it has listed, so a batch committed meanwhile stays apart.

A null source or language is a group of its own. A null text has 0 tokens and counts as a document. Repeated rows of one
batch each count. Groups whose documents and tokens are both 0 are left out. Without a committed batch totals are empty;
an empty batch commits and adds nothing. Other columns are not read.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import scratch, tidy

KEYS = ("source", "lang", "tokenizer_version")
DELTA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"
IMAGE = "struct<source:string,lang:string,tokenizer_version:string,n_tokens:bigint>"


@lru_cache(2)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs without the text, with its number of tokens."""
    at = docs.columns.index(text_col)
    kept = [i for i in range(len(docs.columns)) if i != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoding(path, pattern)
        for b in batches:
            n = [len(e.encode_ordinary(t)) if t else 0 for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), pa.array(n, pa.int64())], [*(b.schema.names[i] for i in kept), out])

    from pyspark.sql.types import StructType

    return docs.mapInArrow(tidy(run), StructType([docs.schema.fields[i] for i in kept]).add(out, "long"))


def signed(changes: DataFrame) -> DataFrame:
    """Changes (before, after: IMAGE or null) as rows to add."""
    both = F.array(*[F.struct(F.col(c).alias("image"), F.lit(s).cast("long").alias("n_docs")) for c, s in (("before", -1), ("after", 1))])
    rows = changes.select(F.explode(both).alias("x")).select("x.image", "x.n_docs").where("image is not null")
    return rows.select(*[F.col(f"image.{k}").alias(k) for k in KEYS], "n_docs", (F.coalesce("image.n_tokens", F.lit(0)) * F.col("n_docs")).alias("n_tokens"))


def images() -> Column:
    """The image of a document's count, from rows with KEYS and n_tokens."""
    return F.struct(*[F.col(k) for k in KEYS], F.col("n_tokens")).cast(IMAGE)


def inserts(counted: DataFrame) -> DataFrame:
    """Changes that add rows (KEYS, n_tokens)."""
    return counted.select(F.lit(None).cast(IMAGE).alias("before"), images().alias("after"))


def deletes(counted: DataFrame) -> DataFrame:
    """Changes that take rows (KEYS, n_tokens) away."""
    return counted.select(images().alias("before"), F.lit(None).cast(IMAGE).alias("after"))


class TokenRollup:
    """Totals under `root`, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _names(self) -> list[str]:
        p = self._path("")
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    @staticmethod
    def _name(batch_id: str) -> str:
        return "batch-" + base64.b16encode(batch_id.encode()).decode()

    def _publish(self, deltas: DataFrame, name: str) -> bool:
        """Writes deltas and names them at once; False if the name is taken, by another writer of the same batch."""
        sc = self.spark.sparkContext
        fs, new, options = sc._jvm.org.apache.hadoop.fs, self._path(f".new-{uuid.uuid4().hex}"), sc._gateway.new_array(sc._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        deltas.write.parquet(new.toString())
        files = fs.FileContext.getFileContext(new.toUri(), sc._jsc.hadoopConfiguration())
        try:
            files.rename(new, self._path(name), options)
        except Exception:
            files.delete(new, True)
            if name not in self._names():
                raise
            return False
        return True

    def _state(self) -> tuple[list[str], set[str]]:
        """The folders to sum: the last compaction and the batches that it doesn't hold; and the names that it holds."""
        names = self._names()
        sums = [n for n in names if n.startswith("sum-")][-1:]
        held = {r[0] for n in sums for r in self.spark.read.text(f"{self.root}/{n.replace('sum-', 'held-')}").collect()}  # a short line a batch
        return sums + [n for n in names if n.startswith("batch-") and n not in held], held

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds a batch; False if it had been added before."""
        name = self._name(batch_id)
        if name in self._names() or name in self._state()[1]:
            return False
        deltas = signed(changes).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return self._publish(deltas.where("n_docs <> 0 or n_tokens <> 0"), name)

    def _sum(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], DELTA)
        rows = self.spark.read.schema(DELTA).parquet(*(f"{self.root}/{n}" for n in names))
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        return self._sum(self._state()[0])

    def compact(self) -> None:
        """One folder of sums for all batches so far. The list of their ids is written first; naming the sums is the commit."""
        names, held = self._state()
        ids = sorted(held | {n for n in names if n.startswith("batch-")})
        if len(names) > 1:
            number = f"{len(ids):012d}-{uuid.uuid4().hex}"
            self.spark.createDataFrame([(x,) for x in ids], "value string").coalesce(1).write.text(f"{self.root}/held-{number}")
            self._publish(self._sum(names), f"sum-{number}")


PROVISIONAL = "white_space"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after these batches, each delivered twice: all documents with a provisional count of words; a third of them
    once more, by mistake; the deletion of these; and the revision of every document to the tokenizer's count."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    name = "byte_bpe_50k.tiktoken"
    spaces = F.length(F.col("text")) - F.length(F.translate("text", " ", ""))
    early = docs.select("doc_id", "source", "lang", F.lit(PROVISIONAL).alias("tokenizer_version"), F.coalesce(spaces.cast("long"), F.lit(0)).alias("n_tokens"), "text")
    again = early.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0)
    exact = F.struct("source", "lang", F.lit(name).alias("tokenizer_version"), F.col("exact").alias("n_tokens")).cast(IMAGE)
    revised = count_tokens(early, public_tokenizers.path(name), public_tokenizers.PATTERN, out="exact")
    rollup = TokenRollup(spark, f"{scratch(spark)}/token-rollup-{uuid.uuid4().hex}")
    for batch, changes in (("load", inserts(early)), ("load-again", inserts(again)), ("withdraw", deletes(again)), ("revise", revised.select(images().alias("before"), exact.alias("after")))):
        for _ in range(2):
            rollup.commit(batch, changes)
        if batch == "withdraw":
            rollup.compact()
    return rollup.totals()

"""Documents that arrive one by one: a file stream, cut and embedded as it comes, kept by document.

Each batch writes what it made in folders of its own number: chunk rows of sound documents, and those that can't be ingested. A batch that runs
again replaces its folders, so nothing is there twice and no batch rewrites what others wrote. A document that arrives again
replaces its older self: readers take the chunks of its last batch. Whether one that arrives without text does so too is ``emptied``. ``fold`` moves
what has gathered into a chunk index and drops it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.functions.text import trim
from lectern.operators.chunking import chunk_adaptive
from lectern.operators.index import ChunkIndex
from lectern.operators.ingest import ingested

from .sinks import BatchTable, drop_batches, last_written, run_batches, shuffles_dropped

#: Chunks of a document as they are kept until they are folded into an index.
CHUNK = "doc_id string, chunk_id string, chunk_index int, content string, embedding array<double>, embedder string, source string"
REFUSED = "doc_id string, problem string"
#: Ids of documents that each task may hold.
FEW = 100_000


class Arrivals:
    """Chunks of documents that arrive in a folder, kept in another one that all executors share.

    A document that can't be ingested leaves its older self as it is, or takes it away if documents can be ``emptied``.
    """

    def __init__(self, spark: SparkSession, path: str, embedder: str = "hashed", chunker: Callable[[str], Column] = chunk_adaptive, run: str = "arrivals", emptied: bool = False):
        self.spark, self.path, self.embedder, self.chunker, self.emptied = spark, path.rstrip("/"), embedder, chunker, emptied
        self.chunks, self.refused = BatchTable(f"{self.path}/chunks", run), BatchTable(f"{self.path}/refused", run)

    def write(self, docs: DataFrame, number: int) -> None:
        """One batch: ``doc_id``, ``text``, and ``source`` and ``arrived`` if there. Of a document that is in it twice the later row counts."""
        shaped = docs.select(
            F.col("doc_id").cast("string").alias("doc_id"), "text",
            (F.col("source") if "source" in docs.columns else F.lit(None)).cast("string").alias("source"),
            (F.col("arrived") if "arrived" in docs.columns else F.lit(0)).alias("arrived"),
        )
        sound = trim(F.coalesce("text", F.lit(""))) != ""
        # unless documents can be emptied, a row that can't be ingested doesn't replace one that can
        first = ("arrived", "sound") if self.emptied else ("sound", "arrived")
        shaped = shaped.withColumn("sound", sound)
        # where no document is there twice, and each core has a part, texts stay where they are read
        spread = shaped.rdd.getNumPartitions() >= self.spark.sparkContext.defaultParallelism
        once = spread and shaped.groupBy("doc_id").count().where("count > 1").isEmpty()
        latest = shaped if once else last_written(shaped, "doc_id", order=(*first, "text"))
        made = ingested(latest, self.embedder, chunker=self.chunker, keep=("source",))
        with shuffles_dropped(docs.sparkSession):  # a stream's batches have a session of their own
            self.chunks.write(made.select(*[F.col(c.split(" ")[0]).cast(c.split(" ", 1)[1]) for c in CHUNK.split(", ")]), number)
            # the others, told by their ids: texts are neither shuffled nor cut again
            told = shaped.groupBy("doc_id").agg(F.max(F.struct(*first))["sound"].alias("sound"))
            held = self.chunks.read(self.spark, CHUNK).where((F.col("run") == self.chunks.run) & (F.col("batch") == number)).select(F.col("doc_id").alias("_held")).distinct()
            refused = told.join(held, F.col("doc_id").eqNullSafe(F.col("_held")), "left_anti")
            self.refused.write(refused.select("doc_id", F.when(F.col("sound"), "no chunks").otherwise("no text").alias("problem")), number)

    def run(self, stream: DataFrame) -> StreamingQuery:
        """Ingest what has arrived since the last call."""
        return run_batches(stream, self.write, f"{self.path}/checkpoint")

    def _named(self) -> DataFrame:
        """Documents that have arrived and count, with the batches they came in."""
        named = self.chunks.read(self.spark, CHUNK).select("doc_id", "batch")
        return named.unionByName(self.refused.read(self.spark, REFUSED).select("doc_id", "batch")) if self.emptied else named

    def rows(self) -> DataFrame:
        """Chunk rows of each document's last batch; documents without an id have none."""
        return self._last()[0]

    def _last(self) -> tuple[DataFrame, bool]:
        """``rows``, and whether they are shuffled, as many documents came again."""
        rows = self.chunks.read(self.spark, CHUNK).drop("run").where("doc_id is not null")
        came = self._named().groupBy("doc_id").agg(F.sort_array(F.collect_set("batch")).alias("came"))
        older = came.where(F.size("came") > 1).select("doc_id", F.explode(F.slice("came", F.lit(1), F.size("came") - 1)).alias("batch"))
        replaced = {r["batch"]: r["count"] for r in older.groupBy("batch").count().collect()}
        many = sum(replaced.values()) > FEW
        older = older.hint("shuffle_hash") if many else F.broadcast(older)
        # batches of which no document came again are read as they lie
        mixed = F.col("batch").isin(list(replaced))
        last = rows.where(mixed).join(older, ["doc_id", "batch"], "left_anti").select(rows.columns)
        return rows.where(~mixed).unionByName(last).drop("batch"), many

    def problems(self) -> DataFrame:
        """Documents of which no arrival gathered here could be ingested (of those that can be emptied, the last), and why not the last."""
        last = last_written(self.refused.read(self.spark, REFUSED).drop("run"), "doc_id")
        held = (self.rows() if self.emptied else self.chunks.read(self.spark, CHUNK)).select("doc_id").distinct()
        return last.drop("batch").join(held, "doc_id", "left_anti")

    def fold(self, index: ChunkIndex) -> None:
        """Put the gathered documents in the place of their older selves in the index, then drop what was gathered.

        Repeating it after a failure midway changes nothing. Not while a batch runs.
        """
        with shuffles_dropped(self.spark):
            rows, many = self._last()
            index.replace_documents(rows, self._named().select("doc_id") if self.emptied else None, stored=True, dealt=many)
        drop_batches(self.spark, self.chunks, *([self.refused] if self.emptied else []))


def arriving(spark: SparkSession, folder: str, schema, files_a_batch: int | None = None) -> DataFrame:
    """Documents as a stream of the Parquet files that appear in a folder."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(folder)

"""A corpus of documents and their chunks as versions: a load is one change, readers see whole documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolume.operators.retrieval import reconcile_corpus
from cargolume.session import path_exists
from cargolume.streaming.ledger import Ledger

META = ("title", "topic", "source_path", "content_sha256")
CHANGE_SCHEMA = (
    "document_id string, title string, topic string, source_path string, content_sha256 string, "
    "action string, chunk_attempt string, attempt string"
)


class CorpusStore:
    """Documents and chunks below one folder.

    A load writes what it changes below a name of its own and then makes the next version of the ledger;
    of two loads that saw the same version, the later one reconciles again. A deleted document leaves a
    tombstone. Chunks of unchanged documents are neither read nor written by a load; a document whose
    metadata alone changed goes on pointing at the chunks it had.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.ledger = Ledger(spark, f"{root}/ledger")

    def versions(self) -> DataFrame:
        """(version, attempt) of every committed load."""
        return self.ledger.rows().select(F.col("ledger_version").alias("version"), "attempt")

    def newest(self) -> int:
        return self.versions().agg(F.max("version")).first()[0] or 0

    def documents(self, version: int | None = None) -> DataFrame:
        """Documents as of a version: the last change of each, without tombstones."""
        if not path_exists(self.spark, f"{self.root}/changes"):
            return self.spark.createDataFrame([], CHANGE_SCHEMA).select("document_id", *META, "chunk_attempt")
        loads = self.versions()
        if version is not None:
            loads = loads.filter(F.col("version") <= version)
        changes = self.spark.read.schema(CHANGE_SCHEMA).parquet(f"{self.root}/changes")
        last = F.max_by(F.struct(*META, "chunk_attempt", "action"), "version").alias("last")
        latest = changes.join(loads, "attempt").groupBy("document_id").agg(last).filter("last.action <> 'delete'")
        return latest.select("document_id", *[f"last.{c}" for c in (*META, "chunk_attempt")])

    def chunks(self, version: int | None = None) -> DataFrame:
        """Chunks of the documents as of a version, with their current title."""
        current = self.documents(version).select("document_id", "title", F.col("chunk_attempt").alias("attempt"))
        return self.spark.read.parquet(f"{self.root}/chunks").join(current, ["document_id", "attempt"]).drop("attempt")

    def load(self, wanted: DataFrame, chunk: Callable[[DataFrame], DataFrame]) -> int:
        """Makes the corpus equal `wanted` and returns its version; without a change no version is made.

        `chunk` turns documents, with all their columns, into chunks that carry `document_id`.
        """
        repeated = wanted.groupBy("document_id").count().filter("count > 1 or document_id is null").first()
        if repeated:
            raise ValueError(f"document id {repeated['document_id']!r} is null or repeated")
        while True:
            version, attempt = self.newest(), uuid.uuid4().hex
            stored = self.documents(version)
            actions = reconcile_corpus(stored, wanted).filter("action <> 'keep'")
            fresh = F.col("action").isin("insert", "replace")
            pointed = F.when(fresh, F.lit(attempt)).otherwise(F.col("chunk_attempt"))
            changes = (
                actions.join(wanted.select("document_id", *META), "document_id", "left")
                .join(stored.select("document_id", "chunk_attempt"), "document_id", "left")
                .select("document_id", *META, "action", pointed.alias("chunk_attempt"))
            )
            own = f"{self.root}/changes/attempt={attempt}"
            changes.write.parquet(own)
            written = self.spark.read.schema(changes.schema).parquet(own)
            count = written.count()
            if not count:
                return version
            rebuilt = wanted.join(written.filter(fresh).select("document_id"), "document_id", "left_semi")
            chunk(rebuilt).write.parquet(f"{self.root}/chunks/attempt={attempt}")
            entry = {"query_id": "corpus", "batch_id": version + 1, "attempt": attempt, "row_count": count}
            if self.ledger.append(version + 1, entry):
                if self.ledger.due(version + 1):
                    self.ledger.compact(version + 1)
                return version + 1

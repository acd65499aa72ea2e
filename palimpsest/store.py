"""A versioned store: Parquet relations partitioned by revision, committed by a row in `revisions`.

Writers add the partition revision=R to each relation and the row in `revisions` last; readers see committed
revisions only. A purge writes a new generation beside the old one and then moves the pointer, one small table that is
added to, to it. All of it goes through Spark's readers and writers, so a store can stand wherever they reach.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.schemas import RELATIONS
from palimpsest.sources.sinks import decrypted, encrypted


class Store:
    """key: 16, 24 or 32 bytes; the containers of a store with one are encrypted, each with a nonce of its own."""

    def __init__(self, spark: SparkSession, path: str, key: bytes | None = None):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def create(self) -> Store:
        """An empty store of generation 0."""
        self._point(0)
        return self

    def _point(self, generation: int) -> None:
        self.spark.range(1).select(F.lit(generation).alias("generation"), F.current_timestamp().alias("since")).coalesce(1).write.mode("append").parquet(f"{self.path}/pointer")

    @property
    def generation(self) -> int:
        return self.spark.read.parquet(f"{self.path}/pointer").agg(F.max("generation")).first()[0]

    def _folder(self, relation: str, generation: int | None = None) -> str:
        return f"{self.path}/generation={self.generation if generation is None else generation}/{relation}"

    def append(self, relation: str, rows: DataFrame, revision: int | None, generation: int | None = None) -> None:
        """Rows of one revision, or with None of those that their column `revision` says, in one job."""
        names = [x.split()[0] for x in _columns(relation)]
        if relation == "containers" and self.key:
            rows = encrypted(rows, self.key)
        folder = self._folder(relation, generation)
        if revision is None:
            rows.select(*names).write.mode("append").partitionBy("revision").parquet(folder)
        else:
            rows.select(*(n for n in names if n != "revision")).write.mode("append").parquet(f"{folder}/revision={revision}")

    def commit(self, revision: int, created_at=None, generation: int | None = None) -> None:
        t = F.current_timestamp() if created_at is None else F.lit(created_at).cast("timestamp")
        self.append("revisions", self.spark.range(1).select(t.alias("created_at")).coalesce(1), revision, generation)

    def _all(self, relation: str) -> DataFrame:
        schema = RELATIONS[relation]
        try:
            rows = self.spark.read.schema(schema).parquet(self._folder(relation))
            return decrypted(rows, self.key) if relation == "containers" and self.key else rows
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)  # nothing of this relation was written yet

    def revisions(self) -> DataFrame:
        return self._all("revisions")

    def last_revision(self) -> int:
        return self.revisions().agg(F.max("revision")).first()[0] or 0

    def read(self, relation: str) -> DataFrame:
        """Rows of committed revisions. Revisions are few: one row for each run of backup."""
        return self._all(relation).join(F.broadcast(self.revisions().select("revision")), "revision", "left_semi") if relation != "revisions" else self.revisions()

    def tree(self, revision: int) -> DataFrame:
        """The complete file tree of one revision; only its partition is read."""
        return self.read("file_tree").where(F.col("revision") == revision)

    def upto(self, relation: str, revision: int) -> DataFrame:
        return self.read(relation).where(F.col("revision") <= revision)


def _columns(relation: str) -> list[str]:
    out, depth, start, text = [], 0, 0, RELATIONS[relation]
    for i, c in enumerate(text):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()]

"""Exact deduplication by stateful streaming, with full bytes checked on hits.

Documents land in a table whose row number is their content locator.  A
Structured Streaming query folds the landed digests into keyed state on disk
(RocksDB) that never expires: per digest the keeper's stable identifier, its
content locator and the number of copies.  Rows that hit a digest with more
than one copy are then compared, byte for byte, with the content the state
points at; digests whose texts differ are grouped again by the whole text.

All of it is DataFrame operations.  Copies are pre-aggregated before each
shuffle.  The joins from documents to state have one state row a digest and are
sort-merge joins at every size, so adaptive execution can split a digest that
holds a third of all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intervale.llm.runtime import Scratch, ascii_lower, bit_filter, dropping_shuffles, exists, new_name, prepare

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # A store leaves its executor's disk once its part is committed to the shared folder.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}

def sha256_digest(normalised: Column) -> Column:
    return F.sha2(normalised.cast("binary"), 256)


class ExactDedup:
    """Groups of equal texts of one table.

    Texts are equal when identical after lower-casing A-Z; null counts as the
    empty text.  Of a group the row with the largest id stays; among rows that
    repeat that id, or where every id is null, the one that landed last.  Any
    further columns are carried as they are, whatever their names.
    """

    def __init__(
        self,
        docs: DataFrame,
        *,
        id_col: str = "doc_id",
        text_col: str = "text",
        digest: Callable[[Column], Column] = sha256_digest,
        files_per_trigger: int = 4096,
        folder: str | None = None,
        label: str = "exact",
    ):
        spark = prepare(docs.sparkSession)
        self.scratch = Scratch(spark, label)
        self.home = folder.rstrip("/") if folder else self.scratch.root
        self.id_col, self.text_col, self.columns = id_col, text_col, docs.columns
        self.row, self.key = new_name("row", docs.columns), new_name("digest", docs.columns)
        self._filter: Callable[[Column], Column] | None = None
        normalised = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
        at, first = f"{self.home}/landed", 0
        if exists(spark, at):  # rows of earlier calls keep their numbers
            first = (spark.read.parquet(at).agg(F.max(self.row)).first()[0] or 0) + 1
        landed = docs.withColumns({self.row: F.monotonically_increasing_id() + F.lit(first).cast("long"), self.key: digest(normalised)})
        with dropping_shuffles(spark):
            landed.write.mode("append").option("compression", "zstd").parquet(at)
        self.landed = spark.read.schema(landed.schema).parquet(at)
        self.groups = self._fold(files_per_trigger)

    def _fold(self, files_per_trigger: int) -> DataFrame:
        """(digest, keep_id, keep_row, group_size) of digests with two rows or more."""
        spark, home = self.landed.sparkSession, self.home
        fields = [self.landed.schema[c] for c in (self.key, self.id_col, self.row)]
        schema = type(self.landed.schema)(fields)
        arriving = (
            spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{home}/landed")
            .select(F.col(self.key).alias("digest"), F.struct(F.col(self.id_col).alias("id"), F.col(self.row).alias("row")).alias("keeper"))
        )
        state = arriving.groupBy("digest").agg(F.max("keeper").alias("keeper"), F.count("*").alias("group_size"))

        def put(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(f"{home}/state/epoch={epoch}")

        before = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}
        for k, v in STATE_SETTINGS.items():
            spark.conf.set(k, v)
        try:
            query = state.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{home}/stream").trigger(availableNow=True).start()
            query.awaitTermination()
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        epochs = spark.read.schema(state.schema).parquet(f"{home}/state") if exists(spark, f"{home}/state") else spark.createDataFrame([], state.schema)
        # Keepers and sizes only grow, so the largest of each is the state's last word.
        latest = epochs.groupBy("digest").agg(F.max("keeper").alias("keeper"), F.max("group_size").alias("group_size"))
        groups = latest.where("group_size > 1").select("digest", F.col("keeper.id").alias("keep_id"), F.col("keeper.row").alias("keep_row"), "group_size")
        return self.scratch.table(groups, "groups")

    def _text(self, column: str) -> Column:
        return ascii_lower(F.coalesce(F.col(column), F.lit("")))

    def _collisions(self) -> DataFrame:
        """Digests of which some row's bytes differ from the content that the state points at."""
        rows = self.landed.where(self._may_have_copies()).select(F.col(self.key).alias("digest"), F.col(self.row).alias("row"), F.col(self.text_col).alias("text"))
        hits = rows.join(self.groups.select("digest", "keep_row").hint("merge"), "digest")
        kept = hits.where("row = keep_row").select("digest", F.col("text").alias("kept_text"))
        differ = hits.where("row != keep_row").join(kept.hint("merge"), "digest").where(self._text("text") != self._text("kept_text"))
        return self.scratch.table(differ.select("digest").distinct(), "collisions")

    def _may_have_copies(self) -> Column:
        """True for every row whose digest has a group, and for few others, so that the texts of the rest aren't shuffled."""
        if self._filter is None:
            self._filter = bit_filter(self.groups.select("digest"))
        return self._filter(F.col(self.key))

    def result(self) -> DataFrame:
        """The landed rows with a struct named by ``decision`` of keep_id, keep_row and group_size.

        Only rows that may have a copy are joined with the state.
        """
        collided, maybe = self._collisions(), self._may_have_copies()
        self.decision = new_name("decision", self.columns)
        own = F.struct(F.col(self.id_col).alias("keep_id"), F.col(self.row).alias("keep_row"), F.lit(1).cast("long").alias("group_size"))

        def decide(rows: DataFrame, groups: DataFrame) -> DataFrame:
            groups = groups.select(F.col("digest").alias(self.key), F.struct("keep_id", "keep_row", "group_size").alias(self.decision))
            joined = rows.join(groups.hint("merge"), self.key, "left")
            return joined.withColumn(self.decision, F.coalesce(self.decision, own))

        alone, rest = self.landed.where(~maybe).withColumn(self.decision, own), self.landed.where(maybe)
        if collided.isEmpty():
            return alone.unionByName(decide(rest, self.groups))
        again = collided.select(F.col("digest").alias(self.key))
        plain = decide(rest.join(again, self.key, "left_anti"), self.groups)
        suspects = rest.join(again, self.key, "left_semi").withColumn(self.key, self._text(self.text_col))
        keeper = F.max(F.struct(F.col(self.id_col).alias("id"), F.col(self.row).alias("row")))
        by_text = suspects.groupBy(F.col(self.key).alias("digest")).agg(keeper.alias("keeper"), F.count("*").alias("group_size"))
        by_text = by_text.select("digest", F.col("keeper.id").alias("keep_id"), F.col("keeper.row").alias("keep_row"), "group_size")
        return alone.unionByName(plain).unionByName(decide(suspects, by_text))

    def kept(self) -> DataFrame:
        """The rows that stay, with the columns of the input."""
        return self.result().where(F.col(self.decision)["keep_row"] == F.col(self.row)).select(*self.columns)


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Rows that repeat an id keep a row each, of which the one that landed last can be kept.
    """
    dedup = ExactDedup(docs.select(id_col, text_col), id_col=id_col, text_col=text_col, **options)
    rows = dedup.result()
    decision = F.col(dedup.decision)
    return rows.select(
        F.col(id_col).alias("doc_id"),
        decision["keep_id"].alias("keep_id"),
        decision["group_size"].alias("group_size"),
        (decision["keep_row"] == F.col(dedup.row)).alias("kept"),
        (F.col(dedup.key) if options.get("digest") is None else sha256_digest(dedup._text(text_col))).alias("text_sha256"),
    )

"""The driver's tables as domain tables, and the same as SQL.

Times are whole microseconds for events and character offsets for
conversations, so that both engines agree exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = "recording_id"
HOUR = 3_600_000_000


class Tables:
    """Domain tables over one folder of the driver's tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def events(self) -> DataFrame:
        return self.raw("events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))

    def frames(self) -> DataFrame:
        return self.events().where("event_type = 'error'").select(F.col("user_id").alias(KEY), F.col("event_id").alias("frame_id"), F.col("us").alias("ts"), F.col("value").alias("score"))

    def segments(self) -> DataFrame:
        """Events of a user up to 12 h apart, from the first to an hour past the last."""
        order = Window.partitionBy(KEY).orderBy("us", "event_id")
        rows = self.events().where("event_type <> 'error'").select(F.col("user_id").alias(KEY), "event_id", "us")
        fresh = F.when(F.col("us") - F.lag("us").over(order) <= 12 * HOUR, 0).otherwise(1)
        rows = rows.withColumn("fresh", fresh).withColumn("n", F.sum("fresh").over(order) - 1)
        return rows.groupBy(KEY, F.col("n").alias("segment_id")).agg(F.min("us").alias("start"), (F.max("us") + HOUR).alias("stop")).withColumn("seq", F.col("segment_id"))

    def lines(self) -> DataFrame:
        """Turns of a conversation as segments over its characters."""
        order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
        rows = self.raw("conversations").withColumn("stop", F.sum(F.length("text") + 1).over(order) - 1)
        return rows.select(F.col("conv_id").alias(KEY), F.col("turn").alias("segment_id"), F.col("turn").alias("seq"), (F.col("stop") - F.length("text")).alias("start"), "stop", "text", "role")

    def words(self) -> DataFrame:
        """Words of the lines that are no system's, each with its characters' offsets."""
        cut = self.lines().where("role <> 'system'").select(KEY, "segment_id", F.col("start").alias("at"), F.posexplode(F.split("text", " ")).alias("word_pos", "word"))
        before = Window.partitionBy(KEY, "segment_id").orderBy("word_pos").rowsBetween(Window.unboundedPreceding, -1)
        start = F.col("at") + F.coalesce(F.sum(F.length("word") + 1).over(before), F.lit(0))
        rows = cut.select(KEY, "segment_id", F.col("word_pos").cast("long").alias("word_pos"), "word", start.alias("start"))
        return rows.withColumn("stop", F.col("start") + F.length("word"))

    def markers(self) -> DataFrame:
        """Every third character span of 120, less some at its ends, up to a conversation's end."""
        ends = self.lines().groupBy(KEY).agg(F.max("stop").alias("last"))
        rows = ends.select(KEY, "last", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / 120))).alias("id")).where("id % 3 <> 1")
        return rows.select(KEY, F.col("id").alias("marker_id"), (F.col("id") * 120 + 7).alias("start"), F.least(F.col("id") * 120 + 113, "last").alias("stop")).where("start < stop")

    def chapters(self) -> DataFrame:
        """Ranges of line numbers of each customer's orders: chapter = order, up to four blocks from its place in the list."""
        order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
        rows = self.raw("orders").withColumn("n", F.row_number().over(order).cast("long"))
        first = (F.col("n") - 1) * 3
        return rows.select(F.col("o_custkey").alias(KEY), F.col("o_orderkey").alias("chapter_id"), F.col("n").alias("seq"), first.alias("block_id_start"), (first + 3).alias("block_id_end"))

    def judged(self) -> DataFrame:
        docs = self.raw("documents").join(self.raw("labels"), "doc_id")
        return docs.select(
            F.concat(F.lit("rec-"), "lang").alias(KEY), F.col("doc_id").alias("frame_id"), (F.col("toxic") == 0).alias("is_meaningful"), F.concat(F.lit(" "), "source", F.lit(" ")).alias("semantic_key"),
            F.col("quality").alias("quality_score"), F.col("text").alias("visible_text"), (F.col("doc_id") % 7).cast("double").alias("sharpness"),
        )


FRAMES = "SELECT user_id AS recording_id, event_id AS frame_id, epoch_us(ts) AS ts, value AS score FROM events WHERE event_type = 'error'"
SEGMENTS = """
    SELECT recording_id, segment_id, min(us) AS start, max(us) + 3600000000 AS stop FROM (
      SELECT recording_id, us, (sum(fresh) OVER (PARTITION BY recording_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS segment_id FROM (
        SELECT user_id AS recording_id, event_id, epoch_us(ts) AS us,
               CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) <= 43200000000 THEN 0 ELSE 1 END AS fresh
        FROM events WHERE event_type <> 'error'))
    GROUP BY recording_id, segment_id"""
LINES = """
    SELECT conv_id AS recording_id, turn AS segment_id, turn AS seq, role, text, stop - length(text) AS start, stop FROM (
      SELECT *, (sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS stop FROM conversations)"""
WORDS = f"""
    SELECT recording_id, segment_id, word_pos, word, start, start + length(word) AS stop FROM (
      SELECT recording_id, segment_id, (i - 1)::BIGINT AS word_pos, w[i] AS word,
             origin + CASE WHEN i = 1 THEN 0 ELSE length(array_to_string(w[1:i-1], ' ')) + 1 END AS start
      FROM (SELECT recording_id, segment_id, start AS origin, w, unnest(range(1, len(w) + 1)) AS i
            FROM (SELECT *, string_split(text, ' ') AS w FROM ({LINES}) WHERE role <> 'system')))"""
MARKERS = f"""
    SELECT recording_id, id AS marker_id, id * 120 + 7 AS start, least(id * 120 + 113, last) AS stop FROM (
      SELECT recording_id, last, unnest(range(0, last // 120 + 1)) AS id FROM (SELECT recording_id, max(stop) AS last FROM ({LINES}) GROUP BY recording_id))
    WHERE id % 3 <> 1 AND id * 120 + 7 < least(id * 120 + 113, last)"""
CHAPTERS = """
    SELECT o_custkey AS recording_id, o_orderkey AS chapter_id, n AS seq, (n - 1) * 3 AS block_id_start, (n - 1) * 3 + 3 AS block_id_end
    FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)"""
JUDGED = """
    SELECT 'rec-' || lang AS recording_id, doc_id AS frame_id, toxic = 0 AS is_meaningful, source AS semantic_key, quality AS quality_score,
           length(regexp_replace(text, '\\s+', '', 'g')) AS visible_length, (doc_id % 7)::DOUBLE AS sharpness
    FROM documents JOIN labels USING (doc_id)"""

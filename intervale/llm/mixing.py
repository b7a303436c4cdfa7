"""Temperature mixing of sources, realised as budgeted block permutations.

A source with token share p gets weight p**a, normalised.  The exponent a is
bisected between 0 (all sources alike) and 1 (as found) so that the mixture
meets a target entropy, or so that no source is repeated more than a limit.

The weights become passes: a source's quota of tokens is some whole passes over
its documents and a rest.  Its documents fall into blocks by a hash of the id,
so that a block has about ``block_docs`` rows however large the source is; each
pass permutes the blocks, and the rest takes blocks in that order until it is
spent, the last one document by document.  Without a budget the quota is the
least that passes over every source once, so no document is lost.

All of it is DataFrame operations: the driver sees one row a source, running
sums go over blocks, and only a source's one divided block is ordered by row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intervale.llm.runtime import Scratch, prepare

WORD = r"[^\x20\x09-\x0D]+"
STEPS = 60
#: Sources that a mixture can have; a row of counts for each comes to the driver, and one of the plan goes back.
MOST_SOURCES = 100_000
#: Rows of divided blocks, at most about ``block_docs`` a source, up to which they are broadcast.
MOST_DIVIDED = 500_000


def weights(shares: list[float], exponent: float) -> list[float]:
    powers = [p**exponent if p > 0 else 0.0 for p in shares]
    total = sum(powers)
    return [x / total if total else 0.0 for x in powers]


def entropy(parts: list[float]) -> float:
    return -sum(p * math.log(p) for p in parts if p > 0)


def bisect_exponent(shares: list[float], *, target_entropy: float | None = None, max_repeat: float | None = None, budget_share: float | None = None) -> float:
    """The smallest exponent in 0..1 within the repetition limit, or the one that meets the entropy.

    Repetition is a source's passes: against the least repeated source, or
    against a budget given as a share of all tokens.  An entropy out of reach
    gives the nearer end.
    """
    live = [p for p in shares if p > 0]

    def within(a: float) -> bool:
        w = weights(live, a)
        if target_entropy is not None:
            return entropy(w) <= target_entropy
        passes = [x / p for x, p in zip(w, live, strict=True)]
        least = min(passes) if budget_share is None else 1.0 / budget_share
        return max(passes) / least <= max_repeat

    low, high = 0.0, 1.0
    if not live or (target_entropy is None and max_repeat is None):
        return 1.0
    if within(low):
        return low
    for _ in range(STEPS):
        middle = (low + high) / 2
        low, high = (low, middle) if within(middle) else (middle, high)
    return high


@dataclass(frozen=True)
class Share:
    key: str
    tokens: int
    docs: int
    weight: float
    quota: int
    passes: int
    rest: int
    blocks: int


def plan(found: list[tuple[str, int, int]], *, budget: int | None, block_docs: int, **target) -> tuple[float, list[Share]]:
    """(key, tokens, docs) of each source -> the exponent, and each source's weight and quota."""
    total = sum(t for _, t, _ in found)
    shares = [t / total if total else 0.0 for _, t, _ in found]
    exponent = bisect_exponent(shares, budget_share=budget / total if budget and total else None, **target)
    w = weights(shares, exponent)
    spent = budget if budget is not None else max((t / x for (_, t, _), x in zip(found, w, strict=True) if x > 0), default=0.0)
    out = []
    for (key, tokens, docs), x in zip(found, w, strict=True):
        quota = round(x * spent)
        passes, rest = divmod(quota, tokens) if tokens else (1, 0)  # a source without tokens is passed once
        out.append(Share(key, tokens, docs, x, quota, passes, rest, -(-docs // block_docs)))
    return exponent, out


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def _place(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


class Mixture:
    """A mixture of the sources of one table.

    A null source is a source of its own; a null text has no tokens; rows that
    repeat both id and length stay or go together.  ``max_repeat`` or
    ``target_entropy`` sets the exponent; neither keeps the shares as found.
    """

    def __init__(
        self,
        docs: DataFrame,
        *,
        id_col: str = "doc_id",
        text_col: str = "text",
        source_col: str = "source",
        max_repeat: float | None = 2.0,
        target_entropy: float | None = None,
        budget: int | None = None,
        block_docs: int = 4096,
        seed: str = "mix",
        label: str = "mixture",
    ):
        self.spark = prepare(docs.sparkSession)
        self.scratch = Scratch(self.spark, label)
        self.docs, self.seed, self.block_docs = docs, seed, block_docs
        self.id = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
        self.tokens = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
        self.key = _key(F.col(source_col))
        slim = docs.select(self.key.alias("key"), self.id.alias("id"), self.tokens.alias("tokens"))
        self.slim = self.scratch.table(slim, "slim")
        found = self.slim.groupBy("key").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).orderBy("key").limit(MOST_SOURCES + 1).collect()
        if len(found) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        self.exponent, self.shares = plan([(r.key, r.tokens, r.docs) for r in found], budget=budget, block_docs=block_docs, max_repeat=max_repeat, target_entropy=target_entropy)
        self.source_plan = self.spark.createDataFrame(
            [(s.key, s.weight, s.passes, s.rest, s.blocks) for s in self.shares], "key string, weight double, passes int, rest long, blocks int"
        )  # one row a source
        self.taken = self.scratch.table(self._taken(), "taken")

    def _block(self) -> Column:
        return (F.conv(F.substring(_place(F.lit(self.seed), "id"), 1, 8), 16, 10).cast("long") % F.col("blocks")).cast("int")

    def _taken(self) -> DataFrame:
        """(key, block, pass, block_rank, left): left is null for whole blocks, else what the rest has for that block."""
        blocks = self.slim.join(F.broadcast(self.source_plan), "key").withColumn("block", self._block())
        blocks = blocks.groupBy("key", "block", "passes", "rest").agg(F.sum("tokens").alias("tokens"))
        turns = blocks.withColumn("pass", F.explode(F.expr("sequence(1, passes + if(rest > 0, 1, 0))")))
        turns = turns.withColumn("place", _place(F.lit(self.seed), "key", F.col("pass").cast("string"), F.col("block").cast("string")))
        order = Window.partitionBy("key", "pass").orderBy("place", "block")
        turns = turns.withColumn("block_rank", F.row_number().over(order)).withColumn("after", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        before = F.col("after") - F.col("tokens")
        last = F.col("pass") > F.col("passes")
        return turns.where(~last | (before < F.col("rest"))).select(
            "key", "block", "pass", "block_rank", F.when(last & (F.col("after") > F.col("rest")), F.col("rest") - before).alias("left")
        )

    def _divided(self) -> DataFrame:
        """(key, block, pass, id, tokens) that a divided block still takes; one block a source."""
        parts = self.taken.where("left is not null")
        rows = self.slim.join(F.broadcast(self.source_plan.select("key", "blocks")), "key").withColumn("block", self._block())
        units = rows.join(parts, ["key", "block"]).groupBy("key", "block", "pass", "left", "id", "tokens").agg(F.sum("tokens").alias("sum"))
        order = Window.partitionBy("key", "block", "pass").orderBy(_place(F.lit(self.seed), F.col("pass").cast("string"), "id"), "id", "tokens")
        spent = F.sum("sum").over(order.rowsBetween(Window.unboundedPreceding, 0))
        return units.withColumn("spent", spent).where("spent <= left").select("key", "block", "pass", "id", "tokens")

    def draws(self) -> DataFrame:
        """A row for each document and pass: struct ``row`` of the input's columns, then key, weight, tokens, block, pass, block_rank."""
        rows = self.docs.select(F.struct(*[F.col(f"`{c}`") for c in self.docs.columns]).alias("row"), self.key.alias("key"), self.id.alias("id"), self.tokens.alias("tokens"))
        rows = rows.join(F.broadcast(self.source_plan.select("key", "weight", "blocks")), "key").withColumn("block", self._block())
        kept = self.scratch.table(self._divided(), "divided").withColumn("unit", F.lit(True))
        if len(self.shares) * self.block_docs <= MOST_DIVIDED:
            kept = F.broadcast(kept)
        drawn = rows.join(self.taken, ["key", "block"]).join(kept, ["key", "block", "pass", "id", "tokens"], "left")
        return drawn.where("left is null or unit").select("row", "key", "weight", "tokens", "block", "pass", "block_rank")

    def documents(self) -> DataFrame:
        """The mixture as rows of the input, a document once for each pass that draws it."""
        return self.draws().select("row.*")


def mixed_sources(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, n_tokens, weight (of the source), pass, block, block_rank: a row for each document and pass."""
    ids, sources = options.get("id_col", "doc_id"), options.get("source_col", "source")
    mixture = Mixture(docs.select(ids, options.get("text_col", "text"), sources), **options)
    return mixture.draws().select(
        F.col(f"row.{ids}").alias("doc_id"), F.col(f"row.{sources}").alias("source"), F.col("tokens").alias("n_tokens"),
        F.round("weight", 9).alias("weight"), F.col("pass").cast("int").alias("pass"), "block", F.col("block_rank").cast("int").alias("block_rank"),
    )

"""Prompt experiments: variants, assignment, result logs and winner scores."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ampersift.functions.columns import as_col, quoted, ratio

# Price per token.
INPUT_TOKEN_PRICE = 0.075 / 1_000_000
OUTPUT_TOKEN_PRICE = 0.30 / 1_000_000


@dataclass(frozen=True)
class Variant:
    """A prompt variant; ``prompt`` holds a ``{context}`` slot."""

    id: str
    name: str
    description: str
    temperature: float = 0.7
    max_tokens: int = 2048
    prompt: str = "{context}"


# The variants on offer and the traffic split in production.
VARIANTS = (
    Variant("control", "Control (Original)", "Original prompt with balanced approach"),
    Variant(
        "concise",
        "Concise Variant",
        "Short, actionable responses optimized for quick reading",
        temperature=0.5,
        max_tokens=512,
    ),
    Variant(
        "detailed",
        "Detailed Variant",
        "Comprehensive answers with examples and detailed explanations",
        temperature=0.8,
        max_tokens=3072,
    ),
    Variant(
        "conversational",
        "Conversational Variant",
        "Friendly, conversational tone for better engagement",
        temperature=0.9,
    ),
    Variant(
        "technical",
        "Technical Variant",
        "Technical, precise answers for expert users",
        temperature=0.3,
    ),
)
TRAFFIC_SPLIT = {"control": 0.4, "concise": 0.2, "detailed": 0.2, "conversational": 0.2}


@dataclass(frozen=True)
class Experiment:
    """Enabled variants and their shares; equal shares when none are given."""

    variants: tuple[Variant, ...] = VARIANTS
    split: dict[str, float] = field(default_factory=dict)

    @classmethod
    def with_enabled(cls, enabled: Sequence[str] = (), split: dict[str, float] | None = None) -> Experiment:
        """Only the known ids in ``enabled``; all variants when it is empty."""
        known = {v.id: v for v in VARIANTS}
        chosen = tuple(known[i] for i in enabled if i in known) if enabled else VARIANTS
        return cls(chosen, dict(split or {}))

    def with_prompts(self, prompts: dict[str, str]) -> Experiment:
        """The same experiment with the given prompt of each variant (``{context}`` slot)."""
        changed = tuple(replace(v, prompt=prompts.get(v.id, v.prompt)) for v in self.variants)
        return replace(self, variants=changed)

    @property
    def shares(self) -> dict[str, float]:
        return self.split or {v.id: 1.0 / len(self.variants) for v in self.variants}

    @property
    def fallback(self) -> str:
        ids = [v.id for v in self.variants]
        return "control" if "control" in ids else ids[0]

    def dimension(self, spark: SparkSession) -> DataFrame:
        """One row per variant, in order, with its traffic percentage."""
        rows = [
            (i, v.id, v.name, v.description, v.temperature, v.max_tokens, self.shares.get(v.id, 0.0) * 100)
            for i, v in enumerate(self.variants)
        ]
        return spark.createDataFrame(
            rows,
            "ordinal int, variant_id string, name string, description string, "
            "temperature double, max_tokens int, traffic_pct double",
        )


LIVE = Experiment(tuple(v for v in VARIANTS if v.id in TRAFFIC_SPLIT), TRAFFIC_SPLIT)


def user_bucket(user: str | Column) -> Column:
    """A stable bucket 0..99 from the md5 of the user id."""
    digest = F.md5(as_col(user).cast("string"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100


def variant_for(position: Column, experiment: Experiment = LIVE) -> Column:
    """The variant whose cumulative share first reaches ``position`` (inclusive)."""
    chosen = None
    reached = 0.0
    for variant_id, share in experiment.shares.items():
        reached += share
        hit = position <= F.lit(reached)
        chosen = F.when(hit, variant_id) if chosen is None else chosen.when(hit, variant_id)
    return chosen.otherwise(experiment.fallback)


def assign_variant(
    df: DataFrame,
    user: str = "user_id",
    override: str | None = None,
    experiment: Experiment = LIVE,
    seed: int = 42,
) -> DataFrame:
    """Add ``variant_id`` and ``rejected``.

    An override naming a known variant wins and an unknown one is rejected.
    Users map to a fixed variant; rows without a user are drawn at random.
    """
    who = quoted(user).cast("string")
    place = F.when(F.length(who) > 0, user_bucket(who) / F.lit(100.0)).otherwise(F.rand(seed))
    # its own column, so that one draw is compared with all shares
    placed = df.withColumn("_place", place)
    assigned = variant_for(F.col("_place"), experiment)
    if override is None:
        return placed.withColumns({"variant_id": assigned, "rejected": F.lit(False)}).drop("_place")
    asked = quoted(override)
    given = F.coalesce(F.length(asked) > 0, F.lit(False))
    known = F.coalesce(asked.isin(*[v.id for v in VARIANTS]), F.lit(False))
    return placed.withColumns(
        {
            "variant_id": F.when(given, F.when(known, asked)).otherwise(assigned),
            "rejected": given & ~known,
        }
    ).drop("_place")


def estimate_tokens(text: str | Column) -> Column:
    return F.floor(F.length(as_col(text)) / 4)


def token_cost(tokens_in: Column, tokens_out: Column) -> Column:
    return tokens_in * F.lit(INPUT_TOKEN_PRICE) + tokens_out * F.lit(OUTPUT_TOKEN_PRICE)


def ab_summary(log: DataFrame, digits: int = 4) -> DataFrame:
    """Latency, tokens, cost and satisfaction per variant, rounded half-even."""
    def b(c: Column, name: str) -> Column:
        return F.bround(c, digits).alias(name)

    return log.groupBy("variant_id").agg(
        b(F.avg("latency"), "latency_mean"),
        b(F.stddev_samp("latency"), "latency_std"),
        F.count("latency").alias("latency_count"),
        F.sum("tokens_input").alias("tokens_input_sum"),
        F.sum("tokens_output").alias("tokens_output_sum"),
        b(F.sum("cost"), "cost_sum"),
        b(F.avg("cost"), "cost_mean"),
        b(F.avg("satisfaction_score"), "satisfaction_mean"),
        b(F.stddev_samp("satisfaction_score"), "satisfaction_std"),
        F.count("satisfaction_score").alias("satisfaction_count"),
    )


def variant_stats(log: DataFrame, experiment: Experiment = LIVE) -> DataFrame:
    """Per-variant totals and means; variants without traffic get zeros.

    A satisfaction of 0 counts as not given. One pass covers all variants.
    """
    score = F.col("satisfaction_score")
    stats = log.groupBy("variant_id").agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.avg("latency").alias("avg_latency"),
        F.avg(F.col("tokens_input") + F.col("tokens_output")).alias("avg_tokens"),
        F.sum("cost").alias("total_cost"),
        F.avg(F.when(score != 0, score)).alias("avg_satisfaction"),
    )
    figures = ["total_queries", "avg_latency", "avg_tokens", "total_cost", "avg_satisfaction"]
    # both sides hold one row per variant
    joined = experiment.dimension(log.sparkSession).join(stats, "variant_id", "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in figures})


def variant_report(log: DataFrame, experiment: Experiment = LIVE) -> DataFrame:
    """Variant settings beside their statistics and the comparison score."""
    per_query = ratio(F.col("total_cost"), F.col("total_queries"))
    score = (
        F.lit(0.3) / (F.col("avg_latency") + 0.1)
        + F.lit(0.3) / (per_query + 0.001)
        + F.col("avg_satisfaction") * 0.4
    )
    return variant_stats(log, experiment).withColumn("score", F.when(F.col("total_queries") > 0, score))


def comparison_winner(log: DataFrame, experiment: Experiment = LIVE) -> DataFrame:
    """The variant with the greatest positive score; ties go to the earlier variant."""
    scored = variant_report(log, experiment)
    contender = F.col("score") > 0
    return scored.agg(
        F.max_by(
            F.when(contender, F.col("variant_id")),
            F.when(contender, F.struct(F.col("score"), -F.col("ordinal"))),
        ).alias("winner"),
        F.max(F.when(contender, F.col("score"))).alias("score"),
    )


def recommend(log: DataFrame) -> DataFrame:
    """Variants ranked by speed, cost and satisfaction."""
    stats = log.groupBy("variant_id").agg(
        F.avg("latency").alias("latency"),
        F.avg("cost").alias("cost"),
        F.coalesce(F.avg("satisfaction_score"), F.lit(0.0)).alias("satisfaction"),
    )
    scored = stats.withColumn(
        "total_score",
        F.lit(0.30) / (F.col("latency") + 0.1)
        + F.lit(0.20) / (F.col("cost") + 0.001)
        + F.col("satisfaction") * 0.50,
    )
    # one row per variant
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("total_score").desc(), "variant_id")
    return scored.withColumn("rank", F.row_number().over(order)).withColumn(
        "is_winner", F.col("rank") == 1
    )


def traffic_share(log: DataFrame) -> DataFrame:
    """Share of queries in percent and mean satisfaction per variant."""
    counted = log.groupBy("variant_id").agg(
        F.count(F.lit(1)).alias("queries"), F.avg("satisfaction_score").alias("avg_satisfaction")
    )
    everything = Window.partitionBy(F.lit(0))
    return counted.withColumn("share_pct", F.col("queries") * 100.0 / F.sum("queries").over(everything))

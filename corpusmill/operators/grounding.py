"""Per-turn ranking state of sessions, as running windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def score(a: Column, b: Column, turn: Column, last: Column, shown: Column) -> Column:
    """Pool weight x matches x staleness x frequency."""
    n = a + b
    pool = F.when((a > 0) & (b > 0), 3).when(a > 0, 2).when(b > 0, 1).otherwise(0)
    often = F.when(shown > 0, F.least(F.lit(1.0), n / shown)).otherwise(1.0)
    return pool * n / F.greatest(turn - last + 1, F.lit(1)) * often


def threshold(turn: Column) -> Column:
    return 0.4 * (1 - 1 / F.greatest(turn, F.lit(1)))


def match_state(matches: DataFrame) -> DataFrame:
    """Counters of each (session, node) after each of its turns. matches: session, turn, node, pool ('A' or 'B')."""
    per = matches.groupBy("session", "node", "turn").agg(F.count_if(F.col("pool") == "A").alias("a"), F.count_if(F.col("pool") == "B").alias("b"))
    so_far = Window.partitionBy("session", "node").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return per.select("session", "node", "turn", F.sum("a").over(so_far).alias("a_count"), F.sum("b").over(so_far).alias("b_count"))


def ranked(matches: DataFrame, k: int = 8) -> DataFrame:
    """At each session's last turn, its nodes at or over the threshold, best k."""
    state = match_state(matches)
    last = state.groupBy("session", "node").agg(F.max_by(F.struct("a_count", "b_count", "turn"), "turn").alias("s"))
    now = matches.groupBy("session").agg(F.max("turn").alias("now"))
    s = last.join(now, "session").select("session", "node", "now", F.round(score(F.col("s.a_count"), F.col("s.b_count"), F.col("now"), F.col("s.turn"), F.lit(0)), 6).alias("score"))
    s = s.where(F.col("score") >= threshold(F.col("now")))
    rank = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("score"), "node"))
    return s.withColumn("rank", rank).where(F.col("rank") <= k).select("session", "node", "score", "rank")


def delta(matches: DataFrame, turn: int, interval: int = 10) -> DataFrame:
    """Nodes by what changed from the snapshot `interval` turns ago (the first is taken after turn 1) to the state after `turn`; the first class that holds counts.

    new_ab: in both pools now, in neither then; promoted: in both now, only in A then; b_persistent: in B more than once and never in A;
    faded: seen then, and silent for the interval.
    """
    then = F.col("turn") <= max(turn - interval, 1)
    count = lambda pool, when, name: F.count_if((F.col("pool") == pool) & when).alias(name)
    now = F.lit(True)
    both = matches.where(F.col("turn") <= turn).groupBy("session", "node").agg(count("A", now, "a"), count("B", now, "b"), count("A", then, "pa"), count("B", then, "pb"), F.max("turn").alias("last"))
    in_both = "a > 0 and b > 0"
    kind = (
        F.when(F.expr(f"{in_both} and pa = 0 and pb = 0"), "new_ab")
        .when(F.expr(f"{in_both} and pa > 0 and pb = 0"), "promoted")
        .when(F.expr("a = 0 and b > 1"), "b_persistent")
        .when(F.expr("(pa > 0 or pb > 0)") & (F.col("last") < turn - interval), "faded")
    )
    return both.select("session", "node", kind.alias("kind")).where("kind is not null")


def last_turns(turns: DataFrame, n: dict[str, int]) -> DataFrame:
    """Of each session the last n[role] texts of each role, in order, joined by line feeds."""
    rank = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy(F.desc("turn")))
    most = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in n.items() for x in kv]), F.col("role")), F.lit(0))
    kept = turns.withColumn("rank", rank).where(F.col("rank") <= most)
    return kept.groupBy("conv_id", "role").agg(F.array_join(F.array_sort(F.collect_list(F.struct("turn", "text"))).getField("text"), "\n").alias("text"), F.count("*").alias("n"))


def merged_pools(a: Column, b: Column) -> Column:
    """What both hold first, then a's own, then b's own."""
    return F.concat(F.array_intersect(a, b), F.array_except(a, b), F.array_except(b, a))

"""Session briefings: capped groups of an agent's facts and memories as lines that fit a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators import facts as fact_ops
from memlake.operators import scope
from memlake.operators.text import fit_budget

# Lines a group may have, in the order in which groups are filled.
CAPS = {"fact": 12, "todo": 6, "decision": 5, "bug": 5, "fix": 5}


def lines(fragments: DataFrame, events: DataFrame, agent_of: Column, now: Column) -> DataFrame:
    """(agent_id, section, place, line): current facts and open memories of each kind, newest first, under the groups' caps.

    agent_of names the agent of a fact event. Each group is ranked below its cap
    before anything is collected.
    """
    held = fact_ops.current(events.withColumn("agent_id", agent_of), now)
    known = held.select("agent_id", F.lit("fact").alias("section"), F.col("valid_from").alias("at"), F.concat_ws(" ", F.col("subject").cast("string"), "attribute", F.lit("is"), "value").alias("line"))
    kinds = [k for k in CAPS if k != "fact"]
    seen = scope.open_memories(fragments).withColumn("section", F.coalesce(scope.kind(F.col("tags")), scope.labelled_kind(F.col("content")))).filter(F.col("section").isin(*kinds))
    said = seen.select("agent_id", "section", F.col("created_at").alias("at"), F.concat(F.lit("- "), F.regexp_replace(F.substring("content", 1, 160), r"\s+", " ")).alias("line"))
    cap = F.element_at(F.create_map(*[F.lit(x) for pair in CAPS.items() for x in pair]), F.col("section"))
    w = Window.partitionBy("agent_id", "section").orderBy(F.col("at").desc(), "line")
    return known.unionByName(said).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= cap).select("agent_id", "section", "place", "line")


def briefing(ranked: DataFrame, budget: int) -> DataFrame:
    """One text an agent: its lines by section and place, as many whole ones as fit the budget."""
    order = F.array_position(F.array(*map(F.lit, CAPS)), F.col("section")).cast("long")
    rows = ranked.withColumn("priority", order).withColumn("spot", order * 1000 + F.col("place"))
    fitted = fit_budget(rows, "agent_id", "priority", "line", "spot", budget)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("spot", "line"))), lambda x: x["line"]), "\n")
    return fitted.groupBy("agent_id").agg(joined.alias("text"))

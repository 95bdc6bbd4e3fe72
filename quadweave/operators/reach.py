"""What can be reached over links from given starts: closures that never hold more than their starts ask for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadweave.operators.hot import joined
from quadweave.steps import written

#: Links up to which they are sent to all tasks, where each start walks by itself; beyond it, all starts take a step a round.
BROADCAST_LINKS = 200_000
#: Rounds after which what was reached is written as one table.
COMPACT = 16


def reach(links: DataFrame, starts: DataFrame, zero: bool = False, most: int = 100_000) -> DataFrame:
    """(s, o) for every o that a start s reaches over one or more links (s, o); with `zero`, also (s, s) for every start.

    starts: a column s.  Names are strings; cycles end; starts without links reach nothing but themselves.  Longer walks than `most` links are errors."""
    own = starts.select("s").where("s is not null").distinct()
    steps = written(links.select("s", "o").where("s is not null and o is not null").distinct(), "links")
    found = _walked(steps, own) if steps.count() <= BROADCAST_LINKS else _in_rounds(steps, own, most)
    return found.unionByName(own.select("s", F.col("s").alias("o"))).distinct() if zero else found


def _walked(links: DataFrame, starts: DataFrame) -> DataFrame:
    """Every start's walk in one task, over links of a checked number."""
    follow: dict[str, list[str]] = {}
    for r in links.toLocalIterator():
        follow.setdefault(r["s"], []).append(r["o"])
    shared = links.sparkSession.sparkContext.broadcast(follow)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for start in batch.column(0).to_pylist():
                seen: set[str] = set()
                open_ends = list(shared.value.get(start, ()))
                while open_ends:
                    end = open_ends.pop()
                    if end not in seen:
                        seen.add(end)
                        open_ends += shared.value.get(end, ())
                if seen:
                    yield pa.RecordBatch.from_arrays([pa.array([start] * len(seen), pa.string()), pa.array(list(seen), pa.string())], ["s", "o"])

    return starts.mapInArrow(run, "s string, o string")


def _in_rounds(links: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """A link a round from the last round's ends; pairs that are known do not walk on."""
    ahead = links.select(F.col("s").alias("m"), "o")
    frontier = written(links.join(starts, "s", "left_semi"), "reached")
    reached = [frontier]
    for _ in range(most):
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, reached)
        further = joined(frontier.select("s", F.col("o").alias("m")), ahead, ["m"]).select("s", "o").distinct()
        frontier = written(further.join(reduce(DataFrame.unionByName, reached), ["s", "o"], "left_anti"), "reached")
        reached.append(frontier)
        if len(reached) >= COMPACT:
            reached = [written(reduce(DataFrame.unionByName, reached), "reached")]
    raise ValueError(f"a walk is longer than {most} links")

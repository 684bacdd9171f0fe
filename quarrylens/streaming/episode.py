"""Episodes of edit events: per-key state over a stream, and the same over a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarrylens.operators import grading, measures
from quarrylens.session import cut
from quarrylens.streaming.actions import EDITS

OUTPUT = "episode_id string, events long, step long, edits long, done boolean"
STATE = "ids array<string>, step array<long>, edits array<long>, done array<boolean>, begun array<boolean>"
#: A call of Python with its state costs milliseconds, so episodes go to it by their hashes in this many groups, each a small part of all.
GROUPS = 1024


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The events of a group's episodes in one micro-batch, all episodes at once."""
    rows = pd.concat(list(frames)).sort_values(["episode_id", "seq", "action_type"])
    of, ids = pd.factorize(rows["episode_id"], use_na_sentinel=False)
    ids = [None if pd.isna(x) else x for x in ids]
    held = [list(x) for x in state.get] if state.exists else [[] for _ in range(5)]
    place = {x: i for i, x in enumerate(held[0])}
    for x in ids:
        if x not in place:
            place[x] = len(place)
            for column, v in zip(held, (x, 0, 0, False, False), strict=True):
                column.append(v)
    mine = np.array([place[x] for x in ids])
    step, edits, done, begun = (np.array(x) for x in held[1:])
    kind, at, n = rows["action_type"].to_numpy(object), np.arange(len(rows)), len(ids)
    reset = np.full(n, -1)  # the last of each episode; what stood before it doesn't count
    np.maximum.at(reset, of[kind == "reset"], at[kind == "reset"])
    anew = reset >= 0
    step[mine[anew]], edits[mine[anew]], done[mine[anew]], begun[mine[anew]] = 0, 0, False, True
    live = (begun & ~done)[mine][of] & (at > reset[of])
    submit = np.full(n, len(rows))  # the first of each that counts; nothing counts after it
    ends = live & (kind == "submit")
    np.minimum.at(submit, of[ends], at[ends])
    live &= at <= submit[of]
    step[mine] += np.bincount(of[live], minlength=n)
    edits[mine] += np.bincount(of[live & np.isin(kind.astype(str), EDITS)], minlength=n)
    done[mine] |= submit < len(rows)
    state.update((held[0], step.tolist(), edits.tolist(), done.tolist(), begun.tolist()))
    yield pd.DataFrame({"episode_id": pd.Series(ids, dtype=object), "events": np.bincount(of, minlength=n), "step": step[mine], "edits": edits[mine], "done": done[mine]})


def episode_states(events: DataFrame) -> DataFrame:
    """A stream of states from a stream of events (episode_id, seq, action_type): a reset begins an episode, every other
    event is a step, submit ends it. Events before a reset or after the end change nothing. Order is that of seq within
    a micro-batch. The state of a group holds those of its episodes."""
    of = F.pmod(F.xxhash64("episode_id"), F.lit(GROUPS)).alias("of")
    return events.select(of, "episode_id", "seq", "action_type").groupBy("of").applyInPandasWithState(_update, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def _carry(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(frames)).sort_values(["episode_id", "step"], ignore_index=True)
    held = dict(zip(*state.get, strict=True)) if state.exists else {}
    of, ids = pd.factorize(rows["episode_id"], use_na_sentinel=False)
    ids = [None if pd.isna(x) else x for x in ids]
    rows["value"] = rows["value"].groupby(of).ffill().fillna(pd.Series([held.get(x) for x in ids], dtype="float64").take(of).set_axis(rows.index))
    last = rows["value"].to_numpy()[np.flatnonzero(np.diff(of, append=-1))]  # in the order of ids, as rows are sorted by them
    held |= {x: None if pd.isna(v) else float(v) for x, v in zip(ids, last, strict=True)}
    state.update((list(held), list(held.values())))
    yield rows[["episode_id", "step", "value"]]


def carried_stream(events: DataFrame) -> DataFrame:
    """A stream of events (episode_id string, step long, value double) where a null keeps the value of the step before, which the
    state of the episode's group holds from one micro-batch to the next."""
    of = F.pmod(F.xxhash64("episode_id"), F.lit(GROUPS)).alias("of")
    held = "ids array<string>, value array<double>"
    return events.select(of, "episode_id", "step", "value").groupBy("of").applyInPandasWithState(_carry, "episode_id string, step long, value double", held, "append", GroupStateTimeout.NoTimeout)


def to_folder(stream: DataFrame, path: str, mode: str = "update") -> DataFrame:
    """Runs a stream over what there is and gives the rows of all its micro-batches, each a folder of Parquet with its number:
    a batch that is run again writes over its own. Checkpoints stand beside."""

    def each(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/rows/at={number}")

    run = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    schema = stream.schema.add("batch", "long")
    return stream.sparkSession.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{path}/rows")


def regrade(edits: DataFrame, baseline: DataFrame, path: str) -> DataFrame:
    """episode_id, step, grader_id, score, added of a stream of snapshots (episode_id, step, path, text), one for each edit: each
    micro-batch is measured and graded, as dead code and style, against the snapshots of baseline, which are earlier."""

    first = measures.snapshot_nodes(baseline).persist()
    measured = {"symbol": cut(measures.symbol_measures(first)), "style": cut(measures.style_measures(first, baseline))}  # once, and not in each micro-batch
    first.unpersist()

    def each(batch: DataFrame, number: int) -> None:
        wanted = batch.select("episode_id", "step").distinct().persist()
        nodes = measures.snapshot_nodes(batch).persist()
        now = {"symbol": measures.symbol_measures(nodes), "style": measures.style_measures(nodes, batch)}
        own = {k: measured[k].join(wanted.select("episode_id").distinct(), "episode_id", "left_semi").unionByName(now[k]) for k in now}
        symbol, style = (grading.graded(own[k], grading.GRADERS[k]) for k in ("symbol", "style"))
        grades = symbol.unionByName(style).select("episode_id", "step", "grader_id", "score", "added").join(wanted, ["episode_id", "step"], "left_semi")
        grades.write.mode("overwrite").parquet(f"{path}/rows/at={number}")
        nodes.unpersist()
        wanted.unpersist()

    run = edits.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return edits.sparkSession.read.schema("episode_id string, step int, grader_id string, score double, added double").option("recursiveFileLookup", True).parquet(f"{path}/rows")


def episode_table(events: DataFrame) -> DataFrame:
    """The last state of each episode of a batch, by windows: what counts stands after the last reset and before the
    first submit after it."""
    order = Window.partitionBy("episode_id").orderBy("seq", "action_type")
    up_to = order.rowsBetween(Window.unboundedPreceding, 0)
    runs = events.withColumn("run", F.sum((F.col("action_type") == "reset").cast("int")).over(up_to))
    last = runs.withColumn("last", F.max("run").over(Window.partitionBy("episode_id"))).where("run = last")
    before = Window.partitionBy("episode_id").orderBy("seq", "action_type").rowsBetween(Window.unboundedPreceding, -1)
    live = last.withColumn("ended", F.coalesce(F.max((F.col("action_type") == "submit").cast("int")).over(before), F.lit(0)))
    counts = (F.col("run") > 0) & (F.col("ended") == 0) & (F.col("action_type") != "reset")
    return live.groupBy("episode_id").agg(F.count_if(counts).alias("step"), F.count_if(counts & F.col("action_type").isin(*EDITS)).alias("edits"), F.max(counts & (F.col("action_type") == "submit")).alias("done"))

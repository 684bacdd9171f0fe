"""Episodes of actions with keyed state: what an agent did and sees, carried from one micro-batch to the next."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The actions of an agent; those that edit are graded, and submit ends an episode.
KINDS = ("view_file", "list_directory", "search_codebase", "git_diff", "edit_file", "edit_files", "run_shell", "submit")
EDITS = ("edit_file", "edit_files")
#: How many of the last actions are kept.
RECENT = 6
EVENTS = "episode_id string, seq long, at timestamp, action_type string, path string, paths array<string>, query string, line_start long, line_end long"
OUTPUT = "episode_id string, seq long, run long, step long, action_type string, edits long, graded boolean, done boolean, tree string, active_file string, shows string, line_start long, line_end long, files_edited long, recent string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Typed state needs this store; the session's own setting comes back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, PROVIDER)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class Episodes(StatefulProcessor):
    """One row for each action that counts, with the state after it.

    A reset begins a run of an episode: no steps, the folder "." listed, and its path shown. Each action after it is a step, until
    submit, or until nothing has come for idle_ms. Other actions change nothing and give no row.

    view_file shows path from line_start to line_end and keeps the listed folder; list_directory lists path and keeps what is
    shown; search_codebase shows its query and no file; edit_file shows path, edit_files the last of paths, the files that it
    could change, and what was shown before without any; git_diff and run_shell change nothing. Both edits are graded,
    edit_files too where nothing could be changed.

    State: episode (a value), context (a value), edited (a map from path to the step of its last edit), recent (a list),
    and a timer that ends a run on which nothing comes any more.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.episode = handle.getValueState("episode", "run long, step long, edits long, done boolean, last_ms long")
        self.context = handle.getValueState("context", "tree string, shows string, line_start long, line_end long")
        self.edited = handle.getMapState("edited", "path string", "step long")
        self.recent = handle.getListState("recent", "action_type string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = sorted((r for frame in rows for r in zip(*(frame[c].tolist() for c in ("seq", "at", "action_type", "path", "paths", "query", "line_start", "line_end")), strict=True)), key=lambda r: r[0])  # of one key in one micro-batch
        # Each look at the state is a message to the store, so what a run that is over has left, which nothing asks for, isn't read.
        held = self.episode.get()
        before = (0, 0, 0, True, 0) if held is None else tuple(held)
        run, step, edits, done, last = before
        context, recent, edited = (None, None, None, None), [], {}
        if not done:
            context, recent = tuple(self.context.get()), [r[0] for r in self.recent.get()]
            edited = {k[0]: v[0] for k, v in self.edited.iterator()} if edits else {}
        was_shown, was_recent = context, recent
        touched, anew, out = {}, False, []

        def tell(seq, kind, graded=False):
            tree, shows, a, b = context
            out.append((key[0], seq, run, step, kind, edits, graded, done, tree, shows[5:] if shows and shows.startswith("file:") else None, shows, a, b, len(edited), ",".join(recent)))

        for seq, at, kind, path, paths, query, a, b in events:
            now = int(pd.Timestamp(at).value // 1_000_000)
            if not done and now > last + self.idle_ms:
                done = True
                tell(None, "idle")
            if kind == "reset":
                run, step, edits, done, context, recent, edited, touched, anew = run + 1, 0, 0, False, (".", f"file:{path}", None, None), [], {}, {}, True
                last = now
                tell(seq, kind)
                continue
            if done or kind not in KINDS:
                continue
            last, step, graded = now, step + 1, kind in EDITS
            edits += graded
            recent = [*recent, kind][-RECENT:]
            changed = [path] if kind == "edit_file" else list(paths) if kind == "edit_files" and paths is not None else []
            for x in changed:
                edited[x] = touched[x] = step
            if kind == "view_file":
                context = (context[0], f"file:{path}", *(None if pd.isna(x) else int(x) for x in (a, b)))
            elif kind == "list_directory":
                context = (path, *context[1:])
            elif kind == "search_codebase":
                context = (context[0], f"search:{query}", None, None)
            elif changed:
                context = (context[0], f"file:{changed[-1]}", None, None)
            done = kind == "submit"
            tell(seq, kind, graded)
        # A run that isn't over has one timer, and no other has one.
        timers = [None if over else at + self.idle_ms for over, at in ((before[3], before[4]), (done, last))]
        if timers[0] != timers[1]:
            if timers[0] is not None:
                self.handle.deleteTimer(timers[0])
            if timers[1] is not None:
                self.handle.registerTimer(timers[1])
        if held is None or before != (run, step, edits, done, last):
            self.episode.update((run, step, edits, done, last))
        if anew or context != was_shown:
            self.context.update(context)
        if anew and before[0]:
            self.edited.clear()
        for x, n in touched.items():
            self.edited.updateValue((x,), (n,))
        if recent and (anew or recent != was_recent):
            self.recent.put([(x,) for x in recent])
        elif anew and before[0]:
            self.recent.clear()
        if out:
            yield _frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        run, step, edits, done, last = self.episode.get()
        tree, shows, a, b = self.context.get()
        self.episode.update((run, step, edits, True, last))
        recent = [r[0] for r in self.recent.get()] if self.recent.exists() else []
        n = len(list(self.edited.keys())) if self.edited.exists() else 0
        if not done:
            yield _frame([(key[0], None, run, step, "idle", edits, False, True, tree, shows[5:] if shows.startswith("file:") else None, shows, a, b, n, ",".join(recent))])

    def close(self) -> None:
        pass


#: Columns of OUTPUT that are never null, as numpy has them; the others are objects.
SURE = {"run": "int64", "step": "int64", "edits": "int64", "graded": "bool", "done": "bool", "files_edited": "int64"}
NAMES = [x.split()[0] for x in OUTPUT.split(", ")]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({c: np.array(x, SURE[c]) if c in SURE else pd.Series(x, dtype=object) for c, x in zip(NAMES, zip(*rows, strict=True), strict=True)})


def episode_stream(events: DataFrame, late: str = "1 day", idle_hours: float = 72.0) -> DataFrame:
    """A stream of OUTPUT from a stream of EVENTS, in the order of seq within a micro-batch; events that come later than
    late behind the latest are dropped. The query must run within state_store(spark)."""
    return events.withWatermark("at", late).groupBy("episode_id").transformWithStateInPandas(Episodes(int(idle_hours * 3_600_000)), OUTPUT, "append", "EventTime")


def state_table(spark: SparkSession, checkpoint: str, variable: str, batch: int | None = None) -> DataFrame:
    """key, and value or what else the variable has, of all keys as they stood after a micro-batch, the last if none is given; read
    from the checkpoint of a stream, within state_store(spark)."""
    reader = spark.read.format("statestore").option("stateVarName", variable)
    return (reader if batch is None else reader.option("batchId", batch)).load(checkpoint)


def dealt(rows: DataFrame, by: str, parts: int, path: str) -> str:
    """Writes rows as a folder of files that a stream reads one after the other, each later in by than those before; gives
    the folder. The parts cover equal ranges of by; rows without it are left out."""
    at = F.col(by).cast("double")
    low, high = rows.agg(F.min(at), F.max(at)).first()
    bounds = [] if low is None else [low + (high - low) * i / parts for i in range(1, parts)]
    which = sum((F.when(at > b, 1).otherwise(0) for b in bounds), F.lit(0))
    for i in range(parts):
        rows.where(which == i).coalesce(1).write.mode("append").parquet(path)
    return path


def run_to_end(stream: DataFrame, path: str, mode: str = "append") -> tuple[DataFrame, int]:
    """All rows of a stream over what there is, with the micro-batch of each, and how many input rows were dropped as too late; a
    micro-batch that runs again writes over its own folder. The checkpoint is the folder state below path."""

    def each(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/rows/at={number}")

    run = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    dropped = sum(op["numRowsDroppedByWatermark"] for p in run.recentProgress for op in p["stateOperators"])
    return stream.sparkSession.read.schema(stream.schema.add("batch", "long")).option("recursiveFileLookup", True).parquet(f"{path}/rows"), dropped


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """episode_id, begin, end, events, last_seq of a stream of events (episode_id, seq, at): stretches without a gap, told once no event
    can join them any more."""
    held = events.withWatermark("at", late).groupBy("episode_id", F.session_window("at", gap).alias("w"))
    return held.agg(F.count("*").alias("events"), F.max("seq").alias("last_seq")).select("episode_id", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "events", "last_seq")

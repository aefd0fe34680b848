"""The background sweep: a loop that wakes by a signal, by an interval, by pending files or by how full the volume is, and
decides from tables what a pass works on. The loop itself keeps a few numbers; all lists stay tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.placement import pending


@dataclass
class State:
    """What the loop remembers from tick to tick: ticks since the last pass, the fill at the end of the last pass that the
    fill woke, whether that pass is owed another one, and ticks that gave way to writers."""

    ticks: int = 0
    floor: int = 0
    owed: bool = False
    gave_way: int = 0
    first: bool = True


@dataclass
class Tick:
    """What one tick sees: a signal, open handles, blocks in use, files pending and whether writes are going on."""

    signal: bool = False
    open_handles: int = 0
    fill: int = 0
    pending: int = 0
    writing: bool = False


def due(state: State, tick: Tick, interval: int = -1, watermark: int = 0) -> str:
    """What a tick does: 'manual' on a signal, 'periodic' by the interval (0: at each tick, below 0: never) unless files are
    open, 'watermark' if the fill is at the mark and above where the last such pass left it (or a pass is owed), 'drain' for
    pending files unless writes are going on, else ''. Changes the state."""
    if tick.signal:
        state.ticks = 0
        return "manual"
    state.ticks += 1
    if interval >= 0 and state.ticks >= interval:
        state.ticks = 0
        if tick.open_handles <= 0:
            return "periodic"
    if watermark:
        if tick.fill < watermark:
            state.floor = 0
        elif tick.fill > state.floor or (state.owed and not state.first):
            state.floor, state.owed, state.first = tick.fill, not state.owed, False
            return "watermark"
    if tick.pending and not tick.writing:
        state.gave_way = 0
        return "drain"
    state.gave_way += bool(tick.pending)
    return ""


def work(kind: str, marks: DataFrame, done: DataFrame, live: DataFrame, cap: int) -> DataFrame:
    """The files of a pass, (ino): a drain takes pending ones, the oldest first, at most cap; any other pass takes every
    live file and so settles the pending ones, too."""
    return pending(marks, done, cap).select("ino") if kind == "drain" else live.select("ino").distinct()


def run(ticks: list[Tick], tables: Callable[[], tuple[DataFrame, DataFrame, DataFrame]], sweep: Callable[[str, DataFrame], None], cap: int, interval: int = -1, watermark: int = 0) -> list[str]:
    """The loop over a list of ticks: tables() gives (marks, done, live) as they are, sweep() works on a pass's files.
    Returns what each tick did. A pass acts only on a list that was read to its end: an error in it ends the loop."""
    state, out = State(), []
    for tick in ticks:
        kind = due(state, tick, interval, watermark)
        if kind:
            sweep(kind, work(kind, *tables(), cap))
        out.append(kind)
    return out


def drains(marks: DataFrame, done: DataFrame, cap: int) -> DataFrame:
    """(ino, since, pass): in which drain of at most cap files each pending file is settled, counted from 1, if nothing else
    comes. The place in the order is a running count by ranges, so no task holds all pending files."""
    from quarry.operators.heat import prefix_sums

    open_ = pending(marks, done, None).withColumn("one", F.lit(1).cast("long"))
    placed = prefix_sums(open_, "one", [F.col("since").asc(), F.col("ino").asc()])
    return placed.select("ino", "since", F.expr(f"(total - 1) div {cap} + 1").alias("pass"))

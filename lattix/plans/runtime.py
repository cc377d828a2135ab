"""Terminal operations: computing arrays, callbacks, history, guards."""

from __future__ import annotations

import contextlib
import csv
import time
import warnings
from dataclasses import asdict, dataclass
from html import escape
from pathlib import Path

import numpy as np

from .. import array as core
from ..array import Array


@dataclass(frozen=True)
class ArrayEvent:
    """One array that was computed."""

    number: int
    shape: tuple
    dtype: str
    nbytes: int
    start: float
    end: float | None = None


@dataclass(frozen=True)
class TaskEvent:
    """One Spark task of a computation, as Spark's status store has it. Times are seconds since 1970, sizes bytes."""

    stage: int
    operation: str
    task: int
    executor: str
    start: float
    end: float
    run_time: float
    peak_memory: int
    rows_read: int
    shuffle_written: int
    spilled: int


class Callback:
    """Hooks around computation; also a context manager that makes it active.

    Task events follow when all arrays are computed, since Spark's status store has them then.
    """

    active: list[Callback] = []

    def on_compute_start(self, arrays) -> None:
        pass

    def on_array_start(self, event: ArrayEvent) -> None:
        pass

    def on_array_end(self, event: ArrayEvent) -> None:
        pass

    def on_task_end(self, event: TaskEvent) -> None:
        pass

    def on_compute_end(self, arrays) -> None:
        pass

    def __enter__(self):
        Callback.active.append(self)
        return self

    def __exit__(self, *_):
        Callback.active.remove(self)


class HistoryCallback(Callback):
    """Writes to a folder: plan.csv (arrays and their Spark plans), events.csv (arrays), tasks.csv, and stats.csv, a row for each stage."""

    def __init__(self, folder: str = "history"):
        self.folder, self.plans, self.events, self.tasks = Path(folder), [], [], []

    def on_compute_start(self, arrays) -> None:
        self.plans = [{"array": i, "shape": a.shape, "dtype": str(a.dtype), "chunks": a.chunksize, "plan": explain(a)} for i, a in enumerate(arrays)]

    def on_array_end(self, event) -> None:
        self.events.append(asdict(event))

    def on_task_end(self, event) -> None:
        self.tasks.append(event)

    def on_compute_end(self, arrays) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        for name, rows in (("plan.csv", self.plans), ("events.csv", self.events), ("tasks.csv", [asdict(t) for t in self.tasks]), ("stats.csv", analyze(self.tasks))):
            if rows:
                with (self.folder / name).open("w", newline="") as f:
                    out = csv.DictWriter(f, rows[0])
                    out.writeheader()
                    out.writerows(rows)


class ProgressCallback(Callback):
    """Prints each array as it is done."""

    def on_array_end(self, event) -> None:
        print(f"array {event.number}: {event.shape} {event.dtype}, {event.end - event.start:.2f} s")


class MemoryWarningCallback(Callback):
    """Warns of tasks whose execution memory came near to what the arrays' specification allows."""

    def __init__(self, share: float = 0.8):
        self.share, self._allowed = share, 0

    def on_compute_start(self, arrays) -> None:
        self._allowed = min(a.spec.allowed_mem for a in arrays)

    def on_task_end(self, event) -> None:
        if event.peak_memory > self.share * self._allowed:
            warnings.warn(f"task {event.task} of stage {event.stage} ({event.operation}) took {event.peak_memory:,} bytes of {self._allowed:,}", stacklevel=2)


class TimelineCallback(Callback):
    """Writes an SVG with a bar for each task, by start, coloured by stage."""

    def __init__(self, path: str = "timeline.svg"):
        self.path, self.tasks = Path(path), []

    def on_task_end(self, event) -> None:
        self.tasks.append(event)

    def on_compute_end(self, arrays) -> None:
        tasks = sorted(self.tasks, key=lambda t: (t.start, t.task))
        begin = min((t.start for t in tasks), default=0.0)
        scale = 800 / max(max((t.end for t in tasks), default=0.0) - begin, 1e-3)
        bars = [f'<rect x="{(t.start - begin) * scale:.1f}" y="{4 * i}" width="{max((t.end - t.start) * scale, 1):.1f}" height="3" fill="hsl({t.stage * 67 % 360},60%,50%)"><title>stage {t.stage}: {escape(t.operation)}</title></rect>' for i, t in enumerate(tasks)]
        self.path.write_text(f'<svg xmlns="http://www.w3.org/2000/svg" width="800" height="{4 * len(tasks)}">{"".join(bars)}</svg>')


#: Tasks of a stage that are read from Spark's status store at most; it keeps no more itself by default.
MAX_TASKS = 100_000


def _stages() -> list:
    store, gateway = core.session().sparkContext._jsc.sc().statusStore(), core.session().sparkContext._gateway
    found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return [found.apply(i) for i in range(found.size())]


def task_events(after: int) -> list[TaskEvent]:
    """The finished tasks of all stages with higher numbers than ``after``."""
    out, store = [], core.session().sparkContext._jsc.sc().statusStore()
    for stage in _stages():
        if stage.stageId() <= after:
            continue
        tasks = store.taskList(stage.stageId(), stage.attemptId(), MAX_TASKS)
        for t in (tasks.apply(i) for i in range(tasks.size())):
            if t.duration().isEmpty() or t.taskMetrics().isEmpty():
                continue
            m, start = t.taskMetrics().get(), t.launchTime().getTime() / 1000
            out.append(TaskEvent(stage.stageId(), stage.name(), t.taskId(), t.executorId(), start, start + t.duration().get() / 1000, m.executorRunTime() / 1000, m.peakExecutionMemory(), m.inputMetrics().recordsRead(), m.shuffleWriteMetrics().bytesWritten(), m.diskBytesSpilled()))
    return out


def analyze(tasks: list[TaskEvent]) -> list[dict]:
    """A row for each stage: tasks, the time they took, peak memory, and how busy the cores that it used at once were."""
    out = []
    for stage in sorted({t.stage for t in tasks}):
        own = [t for t in tasks if t.stage == stage]
        begin, end = min(t.start for t in own), max(t.end for t in own)
        changes = sorted([(t.start, 1) for t in own] + [(t.end, -1) for t in own])
        at_once, most = 0, 1
        for _, change in changes:
            at_once += change
            most = max(most, at_once)
        busy = sum(t.end - t.start for t in own)
        out.append({
            "stage": stage, "operation": own[0].operation, "tasks": len(own), "seconds": round(end - begin, 3), "task_seconds": round(busy, 3), "longest": round(max(t.end - t.start for t in own), 3),
            "peak_memory": max(t.peak_memory for t in own), "utilisation": round(busy / max((end - begin) * most, 1e-9), 3), "shuffle_written": sum(t.shuffle_written for t in own), "spilled": sum(t.spilled for t in own),
        })
    return out


def explain(x: Array) -> str:
    return x.cells()._jdf.queryExecution().toString()


#: Arrays of so many elements or more come to the driver packed: bytes of values, and of the gaps between their places.
PACKED_ELEMENTS = 1_000_000


def _packed(x: Array) -> np.ndarray:
    """What to_numpy gives. Tasks pack what they have, for a row of coordinates and a value takes several times the bytes of the value."""
    shape, dtype, ndim = x.shape, x.dtype, x.ndim

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.ravel_multi_index([batch.column(f"d{i}").to_numpy() for i in range(ndim)], shape)
            values, gaps = _flat(batch.column("v"), dtype), np.diff(place)
            if len(gaps) and gaps.min() < 0:
                order = np.argsort(place, kind="stable")
                place, values = place[order], values[order]
                gaps = np.diff(place)
            # Of a run of neighbours nothing but its start is sent.
            gaps = gaps.astype(np.min_scalar_type(int(gaps.max()))) if len(gaps) and (gaps != 1).any() else gaps[:0]
            yield pa.RecordBatch.from_arrays([pa.array([int(place[0])]), pa.array([gaps.tobytes()], pa.binary()), pa.array([gaps.itemsize], pa.int32()), pa.array([values.tobytes()], pa.binary())], names=["start", "gaps", "width", "data"])

    out, count = np.zeros(x.size, dtype), 0
    for batch in x.cells().mapInArrow(run, "start long, gaps binary, width int, data binary").toArrow().to_batches():
        for start, gaps, width, data in zip(*batch.columns, strict=True):
            values, steps = np.frombuffer(data.as_buffer(), dtype), np.frombuffer(gaps.as_buffer(), f"u{width.as_py()}")
            first, count = start.as_py(), count + len(values)
            if len(steps):
                out[np.concatenate([[first], first + np.cumsum(steps, dtype=np.int64)])] = values
            else:
                out[first : first + len(values)] = values
    if count != x.size:
        raise RuntimeError(f"{count} elements for shape {shape}")
    return out.reshape(shape)


def _flat(value, dtype) -> np.ndarray:
    """The elements of an Arrow column."""
    if dtype.kind == "c":
        value = np.asarray(value.field(0)) + 1j * np.asarray(value.field(1))
    elif dtype.name == "uint64":
        value = np.array([int(v) for v in value.to_pylist()], np.uint64)
    else:
        value = value.to_numpy(zero_copy_only=False)
    return value.astype(dtype)


def to_numpy(x: Array) -> np.ndarray:
    if core._guard["raise"]:
        raise RuntimeError("an array was computed where that isn't allowed")
    if x.ndim and x.size >= PACKED_ELEMENTS:
        return _packed(x)
    table = x.cells().toArrow()
    out = np.zeros(x.shape, x.dtype)
    flat = _flat(table.column("v").combine_chunks(), x.dtype)
    if len(flat) != x.size:
        raise RuntimeError(f"{len(flat)} elements for shape {x.shape}")
    at = tuple(table.column(f"d{i}").to_numpy() for i in range(x.ndim))
    if x.ndim:
        out[at] = flat
    else:
        out[()] = flat[0]
    return out


def run(arrays, callbacks=None) -> tuple[np.ndarray, ...]:
    hooks = [*Callback.active, *(callbacks or [])]
    for h in hooks:
        h.on_compute_start(arrays)
    wanted = [h for h in hooks if type(h).on_task_end is not Callback.on_task_end]
    before = max((s.stageId() for s in _stages()), default=-1) if wanted else -1
    out = []
    for i, x in enumerate(arrays):
        event = ArrayEvent(i, x.shape, str(x.dtype), x.nbytes, time.time())
        for h in hooks:
            h.on_array_start(event)
        out.append(to_numpy(x))
        event = ArrayEvent(**{**asdict(event), "end": time.time()})
        for h in hooks:
            h.on_array_end(event)
    for event in task_events(before) if wanted else ():
        for h in wanted:
            h.on_task_end(event)
    for h in hooks:
        h.on_compute_end(arrays)
    return tuple(out)


def compute(*arrays: Array, callbacks=None) -> tuple[np.ndarray, ...]:
    if any(a.spec != arrays[0].spec for a in arrays):
        raise ValueError("arrays with different specs")
    return run(list(arrays), callbacks)


def visualize(*arrays: Array) -> str:
    """The plans of arrays as text."""
    return "\n\n".join(explain(a) for a in arrays)


@contextlib.contextmanager
def raise_if_computes():
    """Inside, computing any array is an error."""
    core._guard["raise"] = True
    try:
        yield
    finally:
        core._guard["raise"] = False


def measure_reserved_mem() -> int:
    """Peak memory in bytes of a Python worker that has done nothing but start."""
    import resource

    def peak(batches):
        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"m": [resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024]})

    return core.session().range(1).mapInArrow(peak, "m long").first()["m"]

"""Live linking of detections: tracks that stay open over micro-batches, in keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orbitrace.operators.graph import node_ranks

#: The open frame (names and places of its detections) and the rows of frames that are not complete, as the bytes of arrays: a
#: list of numbers would be made and read one number at a time in every batch.
STATE = "last_t int, ids binary, names array<string>, places binary, waiting binary"
#: Rows that a task packs at a time.
PACKED = 1_000_000
#: A row that waits.
WAITING = np.dtype([("w_ts", "<i8"), ("w_t", "<i4"), ("w_id", "<i8"), ("w_x", "<f8"), ("w_y", "<f8"), ("w_z", "<f8")])


def near_pairs(a: np.ndarray, b: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers ``i, j`` of the points of two frames at most ``radius`` apart, and their distances, by grid cells."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    low = np.floor(np.minimum(a.min(axis=0), b.min(axis=0)) / radius) - 1
    ca, cb = (np.floor(p / radius) - low for p in (a, b))
    wide = np.maximum(ca.max(axis=0), cb.max(axis=0)) + 2
    code = lambda c: ((c[:, 0] * wide[1] + c[:, 1]) * wide[2] + c[:, 2]).astype(np.int64)
    order = np.argsort(code(cb), kind="stable")
    sorted_ = code(cb)[order]
    found = []
    for step in np.ndindex(3, 3, 3):
        at = code(ca + np.array(step) - 1)
        first, last = np.searchsorted(sorted_, at), np.searchsorted(sorted_, at, side="right")
        many = last - first
        i = np.repeat(np.arange(len(a)), many)
        j = order[np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())]
        found.append((i, j))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    d = a[i] - b[j]
    d = np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2])
    keep = d <= radius
    return i[keep], j[keep], d[keep]


def link_frame(ids: list, names: list, places: np.ndarray, t: int, new_ids: list, new_places: np.ndarray, radius: float) -> list[str]:
    """Names of a frame's detections: those of the frame before that are nearest, one to one, nearest first, ties by the smaller
    ids; others begin a track named by themselves."""
    out = [f"{t}:{x}" for x in new_ids]
    i, j, d = near_pairs(places, new_places, radius)
    used, taken = set(), set()
    order = np.lexsort((np.array(new_ids, np.int64)[j], np.array(ids, np.int64)[i], d))
    for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
        if a not in used and b not in taken:
            used.add(a)
            taken.add(b)
            out[b] = names[a]
    return out


def _packed(key: str, time: str):
    """A row ``key, time, rows`` for the rows of a key and time that a task holds, up to ``PACKED`` rows at a time."""

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        at = whole.column(time).cast(pa.int64()).to_numpy()
        rows = np.empty(len(at), WAITING)
        rows["w_ts"] = at // 1000
        for c in ("t", "id", "x", "y", "z"):
            rows[f"w_{c}"] = whole.column(c).to_numpy()
        code = np.column_stack([node_ranks(whole.column(key)), at])
        _, first, frame, many = np.unique(code, axis=0, return_index=True, return_inverse=True, return_counts=True)
        parts = np.split(rows[np.argsort(frame.ravel(), kind="stable")], np.cumsum(many)[:-1])
        take = pa.array(first)
        return pa.RecordBatch.from_arrays([whole.column(key).take(take), whole.column(time).take(take), pa.array([x.tobytes() for x in parts], pa.binary())], names=[key, time, "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PACKED:
                yield pack(held)
                held, n = [], 0
        if n:
            yield pack(held)

    return run


def link_stream(stream: DataFrame, radius: float, key: str, time: str = "ts", late: str = "0 seconds") -> DataFrame:
    """``key, t, id, track_id`` of a stream of detections ``key, t, id, x, y, z`` with the frame's event time: what
    ``link_frames`` gives for all frames of a key, as they become complete.

    A frame is complete when the watermark, ``late`` behind the newest time, has reached its time; until then its rows
    wait in the key's state, beside the names and places of the last complete frame, and later ones are dropped. So what
    a key holds is its open frames. All rows of a frame have one time, and times grow with the frames. Rows with a null
    in any column are left out. A frame that does not follow the one before begins all its tracks anew.
    """
    kind = dict(stream.dtypes)[key]
    rows = stream.select(key, time, "t", "id", "x", "y", "z").dropna()
    # Spark sends a key's state again with every ten thousand of its rows, so the rows of a frame become one
    rows = rows.mapInArrow(_packed(key, time), f"`{key}` {kind}, `{time}` timestamp, rows binary").withWatermark(time, late)

    def update(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, ids, names, places, held = state.get if state.exists else (-1, b"", [], b"", b"")
        ids, names, places = np.frombuffer(ids, np.int64).tolist(), list(names), np.frombuffer(places).reshape(-1, 3)
        parts = [np.frombuffer(held, WAITING)]
        for pdf in frames:
            parts.extend(np.frombuffer(x, WAITING) for x in pdf["rows"])
        waiting = np.concatenate(parts)
        reached = state.getCurrentWatermarkMs()
        ready, waiting = waiting[waiting["w_ts"] <= reached], waiting[waiting["w_ts"] > reached]
        ready = ready[np.lexsort((ready["w_id"], ready["w_t"]))]
        out = []
        for frame in np.split(ready, np.flatnonzero(np.diff(ready["w_t"])) + 1) if len(ready) else ():
            t = int(frame["w_t"][0])
            if t != last + 1:
                ids, names, places = [], [], np.zeros((0, 3))
            new, at = frame["w_id"].tolist(), np.column_stack([frame[c] for c in ("w_x", "w_y", "w_z")])
            names = link_frame(ids, names, places, t, new, at, radius)
            last, ids, places = t, new, at
            out.append(pd.DataFrame({key: [name[0]] * len(new), "t": np.int32(t), "id": new, "track_id": names}))
        state.update((last, np.array(ids, np.int64).tobytes(), names, np.ascontiguousarray(places).tobytes(), waiting.tobytes()))
        if len(waiting):
            state.setTimeoutTimestamp(max(int(waiting["w_ts"].min()), reached + 1))
        yield from out

    out = f"{key} {kind}, t int, id bigint, track_id string"
    return rows.groupBy(key).applyInPandasWithState(update, out, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_available(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the result of a stream to a Parquet table until all input that is there is read. With the same checkpoint a later
    run goes on where this one ended, and one that broke off repeats no row."""
    return result.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

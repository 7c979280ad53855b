"""What tasks do with the lines of a split, in the order they are read: follow quotes, and put records together.

Functions for ``mapInArrow``. They are sent to workers by value, so these need not have this library.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What a line does to the state, outside (0) or inside (1) a quoted cell: leaves it, ends outside, ends inside, or turns it.
KEEPS, OUT, IN, TURNS = range(4)
SPLITS_DDL = (
    "file string, start long, after0 int, after1 int, first0 long, last0 long, first1 long, last1 long, header long"
)
RECORDS_DDL = "file string, start long, id long, text string"


def states(kind: np.ndarray, before: int) -> tuple[np.ndarray, int]:
    """The state before every line, and after the last: that of the last line that sets it, turned by those since."""
    turns = np.concatenate(([0], np.cumsum(kind == TURNS)))
    sets = (kind == OUT) | (kind == IN)
    last = np.concatenate(([-1], np.maximum.accumulate(np.where(sets, np.arange(len(kind)), -1))))
    base = np.where(last >= 0, kind[last] == IN, before)
    since = turns - np.where(last >= 0, turns[last + 1], 0)
    found = (base + since) % 2
    return found[:-1], int(found[-1])


def runs(batch: pa.RecordBatch) -> list[tuple[int, int]]:
    """Where the lines of one split start and stop in a batch."""
    start = batch.column("start").to_numpy()
    file = batch.column("file")
    changed = (start[1:] != start[:-1]) | pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
    return list(zip(cuts, cuts[1:])) if batch.num_rows else []


def split_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each split, for each state it may start in: that after it, and where its first and last records begin.

    ``header`` is the first record that isn't blank, of a file's first split.
    """
    names = [part.split()[0] for part in SPLITS_DDL.split(", ")]
    held: dict[str, list] = {name: [] for name in names}
    key, after, first, last, header = None, [0, 1], [None, None], [None, None], None

    def close() -> None:
        for name, value in zip(names, (*key, *after, first[0], last[0], first[1], last[1], header)):
            held[name].append(value)

    for batch in batches:
        kinds, ids, blank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "id", "blank"))
        for low, high in runs(batch):
            now = (batch.column("file")[low].as_py(), batch.column("start")[low].as_py())
            if now != key:
                if key is not None:
                    close()
                key, after, first, last, header = now, [0, 1], [None, None], [None, None], None
            for own in (0, 1):
                state, after[own] = states(kinds[low:high], after[own])
                begins = ids[low:high][state == 0]
                if len(begins):
                    first[own] = int(begins[0]) if first[own] is None else first[own]
                    last[own] = int(begins[-1])
                if not own and header is None and now[1] == 0:
                    shown = ids[low:high][(state == 0) & ~blank[low:high]]
                    header = int(shown[0]) if len(shown) else None
    if key is not None:
        close()
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 5]
    yield pa.RecordBatch.from_arrays([pa.array(held[n], t) for n, t in zip(names, kinds)], names)


def whole_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records that begin and end in one split, but the header; a record of one line is passed on as it is."""
    key, state, pending, header = None, 0, None, None

    def joined(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) or [()] * 4
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["file", "start", "id", "text"])

    def ended(found: list[tuple]) -> None:
        if pending is not None and pending[0] != header:
            found.append((*key, pending[0], "\n".join(pending[1])))

    for batch in batches:
        file, start, id_, value = (batch.column(c) for c in ("file", "start", "id", "value"))
        kinds, ids = batch.column("kind").to_numpy(), id_.to_numpy()
        found: list[tuple] = []
        for low, high in runs(batch):
            now = (file[low].as_py(), start[low].as_py())
            if now != key:
                if state == 0:  # else the last record goes on in the next split
                    ended(found)
                key, pending = now, None
                state, header = batch.column("before")[low].as_py(), batch.column("header")[low].as_py()
            each, state = states(kinds[low:high], state)
            begins = np.flatnonzero(each == 0) + low
            stop = int(begins[0]) if len(begins) else high
            if pending is not None and stop > low:
                pending[1].extend(value[low:stop].to_pylist())
            if not len(begins):
                continue
            ended(found)
            sizes = np.diff(begins)
            alone = begins[:-1][sizes == 1]
            alone = alone[ids[alone] != header] if header is not None else alone
            if len(alone):
                rows = pa.array(alone)
                yield pa.RecordBatch.from_arrays([c.take(rows) for c in (file, start, id_, value)], ["file", "start", "id", "text"])
            for k in np.flatnonzero(sizes > 1).tolist():
                if ids[begins[k]] != header:
                    found.append((*now, int(ids[begins[k]]), "\n".join(value[begins[k] : begins[k + 1]].to_pylist())))
            pending = (int(ids[begins[-1]]), value[int(begins[-1]) : high].to_pylist())
        if found:
            yield joined(found)
    if key is not None and state == 0:
        ended(last := [])
        if last:
            yield joined(last)

"""Replaying logs of edits: commits, undos and redos, of any length.

A key's versions are places 0, 1, 2, ...; a commit writes the place after the current one
and what lies beyond is gone, an undo goes a place back and a redo one forward, as far as
there is one.  The last ``limit`` versions are kept.  A chunk of actions is summed up as a
table from every state it may be entered in (how many versions lie before and after the
current one) to the state it is left in; the version that stands at a place is the last commit there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarframe.operators.chunks import carried, numbered
from sonarframe.operators.intervals import HISTORY_LIMIT
from sonarframe.work import table

COMMIT, UNDO, REDO = "commit", "undo", "redo"
#: Actions of a chunk: each is a step over all states until the first commit, and over the few that are left then.
CHUNK = 1 << 14


def _walk(codes: list[int], back: np.ndarray, ahead: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States after the actions (1 commit, 2 undo, 3 redo) for states before them: versions before and after the current one, and versions dropped."""
    back, ahead, dropped = back.copy(), ahead.copy(), np.zeros(len(back), dtype=np.int64)
    of = np.arange(len(back))
    for code in codes:
        if code == 1:
            full = back == limit - 1
            dropped += full
            back += ~full
            if ahead.any():  # states that differed by what lay ahead are one
                ahead[:] = 0
            if len(back) > limit:
                key, first, again = np.unique(np.stack([back, dropped]), axis=1, return_index=True, return_inverse=True)
                of, back, ahead, dropped = again.reshape(-1)[of], key[0], ahead[first], key[1]
        elif code == 2:
            can = back > 0
            back -= can
            ahead += can
        elif code == 3:
            can = ahead > 0
            back += can
            ahead -= can
    return back[of], ahead[of], dropped[of]


def replay(actions: DataFrame, keys: list[str], order: list[str], action: str, version: str, limit: int = HISTORY_LIMIT, chunk: int = CHUNK) -> DataFrame:
    """``actions`` with ``current`` (the version that stands after each), ``can_undo`` and ``can_redo``.

    ``version`` is what a commit writes.  A key begins with nothing: its first commit can't be undone, and
    actions before it change nothing.  Other actions than commit, undo and redo, and null, change nothing.
    """
    code = F.when(F.col(action) == COMMIT, 1).when(F.col(action) == UNDO, 2).when(F.col(action) == REDO, 3).otherwise(0)
    placed = numbered(actions.withColumn("__code", code).withColumn("__version", F.col(version)), keys, order, chunk)
    kind = dict(placed.dtypes)["__version"]
    # state 0 is nothing yet; others are (back, ahead) with back + ahead < limit
    backs = np.array([b for b in range(limit) for _ in range(limit - b)])
    aheads = np.array([a for b in range(limit) for a in range(limit - b)])
    number = {(int(b), int(a)): i + 1 for i, (b, a) in enumerate(zip(backs, aheads))}

    def from_nothing(codes: list[int]) -> list[int] | None:
        """The actions after the first commit, None if there's none."""
        return codes[codes.index(1) + 1 :] if 1 in codes else None

    def summarise(rows: pa.Table) -> dict[str, pa.Array]:
        codes = rows["__code"].to_pylist()
        back, ahead, dropped = _walk([c for c in codes if c], backs, aheads, limit)
        to = [0, *(number[b, a] for b, a in zip(back.tolist(), ahead.tolist()))]
        gone = [0, *dropped.tolist()]
        rest = from_nothing(codes)
        if rest is not None:
            (b,), (a,), (g,) = _walk([c for c in rest if c], np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), limit)
            to[0], gone[0] = number[int(b), int(a)], int(g)
        return {"to": pa.array([to], pa.list_(pa.int32())), "gone": pa.array([gone], pa.list_(pa.int64()))}

    def combine(rows: pa.Table) -> dict[str, pa.Array]:
        state, low, states, lows = 0, 0, [], []
        for to, gone in zip(rows["to"], rows["gone"]):
            states.append(state)
            lows.append(low)
            low += gone[state].as_py()
            state = to[state].as_py()
        return {"state": pa.array(states, pa.int32()), "low": pa.array(lows, pa.int64())}

    def apply(rows: pa.Table) -> dict[str, pa.Array]:
        state, low = rows["state"][0].as_py(), rows["low"][0].as_py()
        back, ahead = (int(backs[state - 1]), int(aheads[state - 1])) if state else (-1, 0)
        places, undo, redo, lows = [], [], [], []
        for code in rows["__code"].to_pylist():
            if code == 1:
                full = back == limit - 1
                low, back, ahead = low + full, back + (not full), 0
            elif code == 2 and back > 0:
                back, ahead = back - 1, ahead + 1
            elif code == 3 and ahead > 0:
                back, ahead = back + 1, ahead - 1
            places.append(low + back if back >= 0 else None)
            undo.append(back > 0)
            redo.append(ahead > 0)
            lows.append(low)
        return {"__at": pa.array(places, pa.int64()), "can_undo": pa.array(undo), "can_redo": pa.array(redo), "__low": pa.array(lows, pa.int64())}

    walked = carried(placed, keys, summarise, "to array<int>, gone array<long>", combine, "state int, low long", apply, "__at long, can_undo boolean, can_redo boolean, __low long")

    # the last commit at each place that is still kept when a chunk ends
    def written(rows: pa.Table) -> dict[str, pa.Array]:
        last: dict[int, object] = {}
        for code, at, v in zip(rows["__code"].to_pylist(), rows["__at"].to_pylist(), rows["__version"]):
            if code == 1:
                last[at] = v
        low = rows["__low"][-1].as_py()
        kept = [(at, v) for at, v in last.items() if at >= low]
        of = rows.schema.field("__version").type
        return {"places": pa.array([[at for at, _ in kept]], pa.list_(pa.int64())), "versions": pa.array([[v.as_py() for _, v in kept]], pa.list_(of)), "lowest": pa.array([low], pa.int64())}

    def before(rows: pa.Table) -> dict[str, pa.Array]:
        known, places, versions = {}, [], []
        for at, v, low in zip(rows["places"].to_pylist(), rows["versions"].to_pylist(), rows["lowest"].to_pylist()):
            places.append(list(known))
            versions.append(list(known.values()))
            known |= dict(zip(at, v))
            known = {p: x for p, x in known.items() if low <= p < low + limit}
        return {"known": pa.array(places, pa.list_(pa.int64())), "were": pa.array(versions, rows.schema.field("versions").type)}

    def read(rows: pa.Table) -> dict[str, pa.Array]:
        known = dict(zip(rows["known"][0].as_py(), rows["were"][0].as_py()))
        out = []
        for code, at, v in zip(rows["__code"].to_pylist(), rows["__at"].to_pylist(), rows["__version"].to_pylist()):
            if code == 1:
                known[at] = v
            out.append(known[at] if at is not None else None)
        return {"current": pa.array(out, rows.schema.field("__version").type)}

    found = carried(table(walked, "walked"), keys, written, f"places array<long>, versions array<{kind}>, lowest long", before, f"known array<long>, were array<{kind}>", read, f"current {kind}")
    return found.select(*actions.columns, "current", "can_undo", "can_redo")

"""State by file in a stream: lines of files that arrive in pieces, numbered and with what earlier lines of the file said.

Each file's state holds its next line number, the end of an unfinished line, and the session, project and model that its
last state lines named, so a piece is read once and the history isn't.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LINES = "rel string, line_idx bigint, line string, raw_bytes bigint, sid string, cwd string, model string"
STATE = "line_idx bigint, rest binary, sid string, cwd string, model string"
SAID = ("sid", "cwd", "model")
OUT = Row(*[c.split()[0] for c in LINES.split(", ")])
#: State of a file of which nothing has been read.
NEW = (0, b"", None, None, None)


def state_of(line: str) -> dict[str, str | None]:
    """What a rollout's state line says: sid and cwd, or model; nothing of other lines."""
    if '"session_meta"' not in line and '"turn_context"' not in line:
        return {}
    try:
        j = json.loads(line)
        kind, said = j.get("type"), j.get("payload")
        if kind == "session_meta" and isinstance(said, dict):
            ids = [x for x in (said.get("session_id"), said.get("id")) if x is not None]
            return {"sid": str(ids[0]) if ids else "", "cwd": said.get("cwd")}
        if kind == "turn_context" and isinstance(said, dict) and said.get("model") is not None:
            return {"model": str(said["model"])}
    except (ValueError, AttributeError):
        pass
    return {}


class _Lines(StatefulProcessor):
    """Works on plain rows and asks for the state once: a file has few pieces, so a data frame a file would cost more than its lines."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("file", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        pieces = sorted(((r.mtime_micros, r.start, r.kind, r.value) for r in rows), key=lambda x: x[:2])
        n, rest, *said = self.state.get() or NEW
        for _, start, kind, value in pieces:
            if kind == "remove" or start == 0:  # gone, or to be read from its beginning
                n, rest, *said = NEW
            *whole, rest = (bytes(rest) + bytes(value or b"")).split(b"\n")
            for raw in whole:
                line = raw.decode("utf-8", "replace").removesuffix("\r")
                if now := state_of(line):
                    said = [now.get(c, before) for c, before in zip(SAID, said)]
                if line.strip():
                    yield OUT(key[0], n, line, len(line.encode()), *said)
                n += 1
        if pieces and pieces[-1][2] == "remove":
            self.state.clear()
        else:
            self.state.update((n, bytes(rest), *said))

    def close(self) -> None:
        pass


def lines_with_state(changes: DataFrame) -> DataFrame:
    """Finished lines of a `file_changes` stream with `tail`, numbered through each file, with session, folder and model as of that line.

    Needs a state store that keeps columns: spark.sql.streaming.stateStore.providerClass of RocksDB.
    """
    some = changes.select("rel", "kind", "mtime_micros", "start", "value")
    return some.groupBy("rel").transformWithState(_Lines(), LINES, "Append", "None")


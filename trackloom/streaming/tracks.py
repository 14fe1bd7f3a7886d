"""Streams of detections and of label files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trackloom.operators.tracking import BOX, STATE, Lanes, configured
from trackloom.sources.folders import file_stream
from trackloom.streaming.keyed import together, with_state

ONLINE = "video_id bigint, frame_id bigint, det_idx int, number int, class_id int, x1 double, y1 double, x2 double, y2 double, late boolean"
#: A live track's columns in the state: those of ``STATE``, one for each number.
COLUMNS = [(name if width == 1 else f"{name}_{k}", {np.int64: "bigint", np.float32: "float", np.float64: "double"}[kind]) for name, width, kind in STATE if name != "lane" for k in range(width)]


class TrackVideo(StatefulProcessor):
    """State of a video: ``progress``, its last frame and how many tracks began and ended, and ``live``, a row for each live track. Both go ``idle_ms`` after the video's last row, if that is given."""

    def __init__(self, method: str, config: dict, idle_ms: int | None):
        self.method, self.config, self.idle_ms = method, config, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.progress = handle.getValueState("progress", "last bigint, begun bigint, ended bigint", self.idle_ms)
        self.live = handle.getListState("live", ", ".join(f"{c} {kind}" for c, kind in COLUMNS), self.idle_ms)

    def _held(self) -> tuple[Lanes, int | None]:
        own = Lanes(self.method, self.config)
        own.open(np.array([True]))
        if not self.progress.exists():
            return own, None
        last, own.begun[0], own.ended[0] = self.progress.get()
        rows, at = np.array(list(self.live.get()), np.float64).reshape(-1, len(COLUMNS)), 0
        own.tracks.lane = np.zeros(len(rows), np.int64)
        for name, width, kind in STATE:
            if name != "lane":
                setattr(own.tracks, name, (rows[:, at : at + width] if width > 1 else rows[:, at]).astype(kind))
                at += width
        return own, last

    def _hold(self, own: Lanes, last: int) -> None:
        self.progress.update((int(last), int(own.begun[0]), int(own.ended[0])))
        columns = [c for name, width, _ in STATE if name != "lane" for c in (getattr(own.tracks, name).T if width > 1 else [getattr(own.tracks, name)])]
        rows = list(zip(*[c.tolist() for c in columns], strict=True))
        if rows:
            self.live.put(rows)
        else:
            self.live.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        f = together(rows).sort_values(["frame_id", "det_idx"], kind="stable")
        own, last = self._held()
        late = np.zeros(len(f), bool) if last is None else f["frame_id"].to_numpy() <= last
        fresh = f[~late]
        if len(fresh):
            own.run(np.zeros(len(fresh), np.int64), fresh.assign(ordinal=fresh["frame_id"]))
            self._hold(own, fresh["frame_id"].max())
        out = own.taken()
        passed = f[late & f["det_idx"].notna().to_numpy()]
        columns = ["frame_id", "det_idx", "number", "class_id", *BOX]
        found = out[out["det_idx"].notna()][columns].assign(late=False)
        told = pd.concat([x for x in (found, passed[["frame_id", "det_idx", "class_id", *BOX]].assign(number=None, late=True)) if len(x)] or [found])
        if len(told):
            told = told.astype({c: "Int64" for c in ("frame_id", "det_idx", "number", "class_id")})
            yield told.assign(video_id=key[0])[["video_id", *columns, "late"]]


def online_tracker(detections: DataFrame, method: str = "sparse_track", params: dict | None = None, idle_ms: int | None = None) -> DataFrame:
    """(video_id, frame_id, det_idx, number, class_id, smoothed box, late): the forward pass over a stream of detections.

    A video's live tracks are its state, in named columns, so that a stream goes on from its checkpoint also where the code was
    changed. Frames are taken in order within a batch, and a frame's detections have to come in one batch. What comes for a frame
    that has passed is ``late``: such rows have their own box and no number. An empty frame comes as a row without det_idx. At
    the end the other rows are those of ``run_tracker``'s forward pass. The state of a video is dropped ``idle_ms`` after its last row.
    """
    processor = TrackVideo(method, configured(method, params), idle_ms)
    rows = detections.select("video_id", F.col("frame_id").cast("bigint").alias("frame_id"), "det_idx", "class_id", "score", *BOX)
    return with_state(rows, "video_id", processor, ONLINE)


def label_stream(spark: SparkSession, path: str, settle: float = 2) -> DataFrame:
    """(file, line_no, line) of label files as they arrive in a folder, one row a line that isn't blank; a file without any is one row of nulls, as it says that its frame has no boxes."""
    text = file_stream(spark, path, ".txt", settle)
    lines = F.filter(F.transform(F.split("value", "\r?\n"), lambda x, k: F.struct(k.alias("line_no"), x.alias("line"))), lambda s: F.trim(s["line"]) != "")
    return text.select(F.col("path").alias("file"), F.explode_outer(lines).alias("l")).select("file", "l.line_no", "l.line")


def answer_stream(spark: SparkSession, path: str, schema: str = "image string, width int, height int, answer string, error string") -> DataFrame:
    """Model answers as JSON lines arrive in a folder."""
    return spark.readStream.schema(schema).json(path)

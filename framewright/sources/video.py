"""Adapter boundary for raw video: decoding and landmark detection are outside libraries.

``decode(path)`` yields frames and ``detect(frame)`` returns five features or
None; both are made on the executor, once a task, by the factories given.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from framewright.schema import FEATURES, FRAME, SENTINEL


def extract(videos: DataFrame, decoder: Callable, detector: Callable, skip: int = 5, max_frames: int | None = None) -> DataFrame:
    """Frames of each video of (video_id, video_path); a video that does not open or whose decoding fails gives none.

    ``catalog.video_status`` counts those; the reason is in the executor's log.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode, detect = decoder(), detector()
        try:
            for part in parts:
                for video, path in zip(part["video_id"], part["video_path"]):
                    rows: list[tuple] = []
                    try:
                        for raw, frame in enumerate(decode(path)):
                            if raw % skip:
                                continue
                            if max_frames and max_frames > 0 and len(rows) >= max_frames:
                                break
                            rows.append((video, len(rows), *(detect(frame) or SENTINEL)))
                    except Exception:  # one bad video must not end the job
                        logging.getLogger(__name__).exception("%s is skipped", path)
                        rows = []
                    yield pd.DataFrame(rows, columns=["video_id", "frame_idx", *FEATURES])
        finally:
            for tool in (decode, detect):
                if hasattr(tool, "close"):
                    tool.close()

    return videos.select("video_id", "video_path").mapInPandas(run, FRAME)

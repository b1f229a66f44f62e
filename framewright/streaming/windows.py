"""The sliding window over a stream of frames, as a stateful operator.

State is the last ``length`` - 1 frames of a video, so it does not grow with
the stream.  Frames of a video must arrive in order of ``frame_idx`` across
micro-batches; within one they are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from framewright.schema import FEATURES


def streaming_windows(frames: DataFrame, length: int, step: int = 1) -> DataFrame:
    def run(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = [list(r) for r in state.get[0]] if state.exists else []
        new = pd.concat(list(parts)).sort_values("frame_idx")
        rows, out = kept + new[["frame_idx", *FEATURES]].astype(float).values.tolist(), []
        for at in range(len(rows) - length + 1):
            first = int(rows[at][0])
            if first % step == 0:
                out.append((key[0], first // step, [r[1:] for r in rows[at : at + length]]))
        state.update(([tuple(r) for r in rows[-(length - 1) :]] if length > 1 else [],))
        yield pd.DataFrame(out, columns=["video_id", "window_id", "x"])

    frame = "struct<frame_idx: double, " + ", ".join(f"{c}: double" for c in FEATURES) + ">"
    return frames.groupBy("video_id").applyInPandasWithState(run, "video_id string, window_id int, x array<array<float>>", f"last array<{frame}>", "append", "NoTimeout")

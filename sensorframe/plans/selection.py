"""Frames of windows to one pooled vector per window, over the most telling frames only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from sensorframe.operators.vectors import mean_pool, scored_frames, short_windows, top_k_frames


def selected_windows(
    frames: DataFrame, window: Sequence[str], frame: str, value: str, k: int, method: str = "shannon", standardised: bool = True
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chosen frames in time order, the mean of each window's chosen vectors, and the windows too short to choose from.

    Scores use standardised vectors; what is pooled are the vectors as they came.
    """
    scored = scored_frames(frames, value, method, standardised)
    chosen = top_k_frames(scored, window, frame, k)
    return chosen, mean_pool(chosen, window, value), short_windows(frames, window, k)

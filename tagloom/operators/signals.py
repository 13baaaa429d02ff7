"""Windows over signals that are arrays: segments of a waveform, patches of a spectrogram's frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def segments(signals: DataFrame, length: int, hop: int, pad: bool = False) -> DataFrame:
    """id, segment and samples of windows of `length` samples, each `hop` further; what is left at the end is filled with zeros if `pad`, else dropped."""
    n = F.size("samples")
    last = F.ceil((n - length) / hop) if pad else F.floor((n - length) / hop)
    starts = F.when((n >= length) | (F.lit(pad) & (n > 0)), F.sequence(F.lit(0), F.greatest(last, F.lit(0)).cast("int"))).otherwise(F.array().cast("array<int>"))
    each = signals.select("id", "samples", F.explode(starts).alias("segment"))
    cut = F.slice("samples", F.col("segment") * hop + 1, length)
    zeros = F.array_repeat(F.lit(0.0), length - F.size(cut))
    return each.select("id", "segment", F.concat(cut, zeros).alias("samples"))


def patches(frames: DataFrame, length: int, hop: int) -> DataFrame:
    """id, patch and frames of windows of `length` frames; an incomplete one at the end is dropped. Frames are arrays in an array `samples`."""
    n = F.size("samples")
    starts = F.when(n >= length, F.sequence(F.lit(0), F.floor((n - length) / hop).cast("int"))).otherwise(F.array().cast("array<int>"))
    return frames.select("id", "samples", F.explode(starts).alias("patch")).select("id", "patch", F.slice("samples", F.col("patch") * hop + 1, length).alias("frames"))

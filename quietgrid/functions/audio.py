"""Waveform columns: level, zero crossings, sound labels, muting, fixed lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rms_level(samples: Column) -> Column:
    """20 log10 of the root mean square; an empty waveform is -120."""
    total = F.aggregate(samples, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    rms = F.greatest(F.sqrt(total / F.size(samples) + 1e-12), F.lit(1e-12))
    return F.when(F.size(samples) > 0, 20 * F.log10(rms)).otherwise(-120.0)


def zero_crossings(samples: Column) -> Column:
    """Share of neighbouring samples whose signs differ."""
    n = F.size(samples)
    pairs = F.zip_with(F.slice(samples, 1, n - 1), F.slice(samples, 2, n - 1), lambda a, b: ((a < 0) != (b < 0)).cast("int"))
    return F.when(n >= 2, F.aggregate(pairs, F.lit(0), lambda acc, x: acc + x) / (n - 1)).otherwise(0.0)


def duration(samples: Column, rate: int) -> Column:
    return F.size(samples) / F.lit(rate)


def sound_labels(level: Column, crossings: Column) -> Column:
    """Array of struct(confidence, label), the surest first."""
    label = lambda name, c: F.struct(F.lit(c).alias("confidence"), F.lit(name).alias("label"))
    loud = F.array_compact(F.array(
        F.when(level > -12, label("loud_noise", 0.6)),
        F.when(crossings.between(0.02, 0.18) & (level > -45) & (level < -5), label("speech", 0.55)),
        F.when((crossings > 0.22) & (level > -25), label("glass_break_or_alarm", 0.45)),
    ))
    return F.when(level < -45, F.array(label("silence", 0.8))).when(F.size(loud) > 0, loud).otherwise(F.array(label("ambient_sound", 0.5)))


def frames(samples: Column, size: int) -> Column:
    """The waveform cut into frames of ``size`` samples, the last one shorter."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(samples) / F.lit(size)).cast("int") - 1)), lambda i: F.slice(samples, i * size + 1, size))


def mute_speech(samples: Column, size: int) -> Column:
    """Frames that sound like speech become zeros."""

    def one(f: Column) -> Column:
        level, crossings = rms_level(f), zero_crossings(f)
        return F.when(crossings.between(0.02, 0.18) & (level > -45) & (level < -5), F.transform(f, lambda x: F.lit(0.0).cast("float"))).otherwise(f)

    return F.flatten(F.transform(frames(samples, size), one))


def reverse_chunks(samples: Column, size: int) -> Column:
    return F.flatten(F.transform(frames(samples, size), F.reverse))


def silence(samples: Column) -> Column:
    return F.transform(samples, lambda x: F.lit(0.0).cast("float"))


def fit_length(samples: Column, n: int) -> Column:
    """Cut at n, or zeros appended up to n."""
    return F.slice(F.concat(samples, F.array_repeat(F.lit(0.0).cast("float"), n)), 1, n)


def resample(values: Column, n: int) -> Column:
    """n elements at evenly spaced positions, ends included, rounded half-even."""
    step = (F.size(values) - 1) / F.lit(float(max(1, n - 1)))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.element_at(values, (F.bround(i * step, 0) + 1).cast("int")))

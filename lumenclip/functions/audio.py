"""Tones as 16-bit mono PCM: samples, WAV files and back, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RATE = 48_000


def tone_samples(frequency: Column, duration: Column, rate: int = RATE) -> Column:
    """The samples of a sine at half of full volume, cut to whole numbers; none where there is no duration."""
    n = F.floor(duration * rate).cast("int")
    wave = lambda i: (F.lit(32767 * 0.5) * F.sin(F.lit(2 * 3.141592653589793) * frequency * (i / rate))).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), wave)).otherwise(F.array().cast("array<int>"))


def _little(value: Column, size: int) -> Column:
    """Hexadecimal digits of a number's bytes, the lowest first."""
    byte = lambda i: F.lpad(F.hex(F.shiftright(value, 8 * i).bitwiseAND(255)), 2, "0")
    return F.concat(*[byte(i) for i in range(size)])


def wav(samples: Column, rate: int = RATE) -> Column:
    """A WAV file of 16-bit samples."""
    size = F.size(samples) * 2
    number = lambda v, n: _little(F.lit(v) if isinstance(v, int) else v, n)
    header = [F.lit(b"RIFF".hex()), number(size + 36, 4), F.lit((b"WAVE" + b"fmt ").hex()), number(16, 4), number(1, 2), number(1, 2), number(rate, 4), number(rate * 2, 4), number(2, 2), number(16, 2), F.lit(b"data".hex()), number(size, 4)]
    return F.unhex(F.concat(*header, F.array_join(F.transform(samples, lambda s: _little(s, 2)), "")))


def wav_samples(content: Column) -> Column:
    """The samples of such a file, as far as its bytes go."""
    n = F.floor((F.octet_length(content) - 44) / 2).cast("int")

    def sample(i: Column) -> Column:
        at = F.substr(content, i * 2 + 45, F.lit(2))
        low, high = (F.conv(F.hex(F.substr(at, F.lit(k), F.lit(1))), 16, 10).cast("int") for k in (1, 2))
        value = high * 256 + low
        return F.when(value > 32767, value - 65536).otherwise(value)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), sample)).otherwise(F.array().cast("array<int>"))

"""Small column functions: numbers, colours, clocks, names, array arithmetic.

Null gives null unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Colour stops of a heat map (place, red, green, blue).
HEAT_STOPS = ((0.0, 13, 17, 16), (0.5, 255, 176, 32), (1.0, 255, 59, 48))
# Ease of a relocation in metres per frame beyond so many metres.
FAR_MOVE, FAR_RATE = 8.0, 0.29


def _usable(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def half_up(c: Column) -> Column:
    """Nearest whole number, halves towards plus infinity."""
    return F.floor(c + 0.5)


def glide_rate(moved: Column, rate: float) -> Column:
    return F.when(moved > FAR_MOVE, FAR_RATE).otherwise(rate)


def heat_colour(value: Column, largest: Column) -> Column:
    """``rgb(r, g, b)`` between the stops; what is not a finite number counts as 0."""
    t = clamp(F.when(_usable(value) & _usable(largest) & (largest > 0), value / largest).otherwise(0.0))
    (a, *low), (m, *mid), (b, *high) = HEAT_STOPS
    f = F.when(t <= m, (t - a) / (m - a)).otherwise((t - m) / (b - m))
    part = lambda k: half_up(F.when(t <= m, lerp(F.lit(low[k]), F.lit(mid[k]), f)).otherwise(lerp(F.lit(mid[k]), F.lit(high[k]), f))).cast("string")
    return F.concat(F.lit("rgb("), part(0), F.lit(", "), part(1), F.lit(", "), part(2), F.lit(")"))


def _seconds(c: Column) -> Column:
    return F.when(_usable(c) & (c >= 0), c).otherwise(0.0)


def clock(seconds: Column) -> Column:
    """``m:ss.t``; what is no time counts as 0."""
    tenths = F.floor(_seconds(seconds) * 10 + 1e-9)
    return F.format_string("%d:%02d.%d", F.floor(tenths / 600), F.floor((tenths % 600) / 10), tenths % 10)


def duration(seconds: Column) -> Column:
    """``m:ss``, rounded; what is no time counts as 0."""
    total = half_up(_seconds(seconds))
    return F.format_string("%d:%02d", F.floor(total / 60), total % 60)


def bytes_text(n: Column) -> Column:
    """``x.x KB`` or from 1,048,576 bytes ``x.x MB``; what is no size counts as 0."""
    size = _seconds(n.cast("double"))
    return F.when(size < 1_048_576, F.format_string("%.1f KB", size / 1024)).otherwise(F.format_string("%.1f MB", size / 1_048_576))


def display_name(name: Column, file: Column) -> Column:
    """The trimmed name, else the file's name without folder and ending, else ``match``."""
    stem = F.regexp_replace(F.regexp_extract(F.coalesce(file, F.lit("")), r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.nullif(stem, F.lit("")), F.lit("match"))


def escaped(c: Column) -> Column:
    """Text fit for mark-up."""
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


def text_problem(c: Column, longest: int) -> Column:
    """``too long`` by code points, ``control character``, or null for a good text."""
    return F.when(F.char_length(c) > longest, "too long").when(c.rlike(r"[\x00-\x1f\x7f]"), "control character")


def seconds_in(c: Column, low: float = 5.0, high: float = 600.0) -> Column:
    """The number that a text says if it is finite and from ``low`` to ``high``, else null."""
    v = F.trim(c).try_cast("double")
    return F.when(_usable(v) & v.between(low, high), v)


def digits(number: Column) -> Column:
    """``tens, ones`` of a shirt number from 0 to 99; tens 10 says that there is one digit only."""
    return F.when(number.between(0, 99), F.struct(F.when(number < 10, 10).otherwise(F.floor(number / 10)).cast("int").alias("tens"), (number % 10).cast("int").alias("ones")))


def number_of(tens: Column, ones: Column) -> Column:
    return F.when(tens == 10, ones).otherwise(tens * 10 + ones)


def softmax(scores: Column) -> Column:
    e = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def number_distribution(tens: Column, ones: Column) -> Column:
    """Probabilities of the numbers 0 to 99 from those of two digits (eleven each, the last one says "none")."""
    one = lambda k: F.element_at(tens, F.lit(11)) * F.get(ones, k)
    two = lambda k: F.get(tens, F.floor(k / 10).cast("int")) * F.get(ones, k % 10)
    return F.transform(F.sequence(F.lit(0), F.lit(99)), lambda k: F.when(k < 10, one(k)).otherwise(two(k)))


def sharpened(p: Column, none: Column, legible: float = 0.0, sure: float = 0.0, power: float = 1.0) -> Column:
    """Evidence that is legible and sure enough, raised to ``power`` and scaled to 1; zeros otherwise."""
    kept = (1 - none >= legible) & (F.array_max(p) >= sure)
    raised = F.transform(p, lambda v: F.pow(v, F.lit(power)))
    total = F.greatest(F.aggregate(raised, F.lit(0.0), lambda a, b: a + b), F.lit(1e-9))
    return F.when(kept, F.transform(raised, lambda v: v / total)).otherwise(F.transform(p, lambda v: F.lit(0.0)))


def clipped_box(box: Column, width: float, height: float, least: float = 1.0) -> Column:
    """The part of ``x, y, w, h`` inside the image; null if it is lower than ``least``."""
    x0, y0 = clamp(box[0], 0, width), clamp(box[1], 0, height)
    x1, y1 = clamp(box[0] + box[2], 0, width), clamp(box[1] + box[3], 0, height)
    return F.when((x1 > x0) & (y1 - y0 >= least), F.array(x0, y0, x1 - x0, y1 - y0))


def swapped_team(team: Column) -> Column:
    return F.when(team == "left", "right").when(team == "right", "left").otherwise(team)


def hashed_noise(spread: float, seed: int, *key: Column) -> Column:
    """Gaussian noise that depends on the key alone, so a run repeats it whatever the partitioning; rows of one key share it."""
    u = lambda k: (F.pmod(F.xxhash64(*key, F.lit(seed + k)), F.lit(1_000_003)) + 0.5) / 1_000_003.0
    return spread * F.sqrt(-2 * F.ln(u(0))) * F.cos(2 * F.pi() * u(1))


def hashed_share(seed: int, *key: Column) -> Column:
    """A number from 0 to 1 that depends on the key alone (random drops, shards)."""
    return (F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1_000_003)) + 0.5) / 1_000_003.0


def colour(c: Column, other: str) -> Column:
    """A ``#rrggbb`` colour in lower case, else ``other``."""
    return F.when(c.rlike(r"^#[0-9A-Fa-f]{6}$"), F.lower(c)).otherwise(other)


def retry_after(now: Column, first_hit: Column, window: float) -> Column:
    """Whole seconds until the oldest hit leaves the window, 1 at least."""
    return F.greatest(F.lit(1), F.ceil(window - (now - first_hit)))


def progress_fraction(frames: Column, seconds: Column, fps: int = 25) -> Column:
    """Share of the frames that a length in seconds holds, from 0 to 1; 1 where it holds none, null without a length."""
    total = F.floor(seconds * fps)
    return F.when(seconds.isNull() | (seconds == 0), None).when(total > 0, clamp(F.greatest(frames, F.lit(0)) / total)).otherwise(1.0)


def chunk_start(frame: Column, first: Column, size: int) -> Column:
    return first + F.floor((frame - first) / size) * size


def chunk_ranges(first: Column, last: Column, size: int) -> Column:
    """Array of ``start, end`` of blocks of ``size`` from first to last; empty if last comes before first."""
    starts = F.when(first <= last, F.sequence(first, last, F.lit(size))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + size - 1, last).alias("end")))


def rounded(df, places: int = 2):
    """The frame with every double rounded, also inside arrays and structs."""
    from pyspark.sql import types as T

    def on(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.round(c, places)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda e: on(e, kind.elementType))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[on(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        if isinstance(kind, T.MapType):
            return F.transform_values(c, lambda _, v: on(v, kind.valueType))
        return c

    return df.select(*[on(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])

"""Column helpers with the semantics that built-ins don't have."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def nearest_rank(values: Column, q: float) -> Column:
    """Element at floor(q * (n - 1)) of the sorted values (an array column); null if empty."""
    at = F.floor(F.lit(q) * (F.size(values) - 1)).cast("int") + 1
    return F.when(F.size(values) > 0, F.element_at(F.array_sort(values), F.greatest(at, F.lit(1))))


def entropy(p: Column) -> Column:
    """Natural-log Shannon entropy of an array that is normalised first; 0 if its sum is 0.  One pass."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("l"))
    step = lambda a, x: F.struct((a["s"] + x).alias("s"), (a["l"] + F.when(x > 0, x * F.log(x)).otherwise(0.0)).alias("l"))
    return F.aggregate(p, start, step, lambda a: F.when(a["s"] > 0, F.log(a["s"]) - a["l"] / a["s"]).otherwise(0.0))


def gini(values: Column) -> Column:
    """Gini coefficient of an array; 0 if its sum is 0."""
    n = F.size(values)
    ranked = F.transform(F.array_sort(values), lambda x, i: (2 * (i + 1) - n - 1) * x)
    return F.when(total(values) > 0, total(ranked) / (n * total(values))).otherwise(F.lit(0.0))


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounding with halves towards plus infinity, on the binary value."""
    return F.floor(x * float(10**digits) + 0.5) / float(10**digits)


def unit_range(x: Column, low: Column, high: Column) -> Column:
    """Place of x between low and high; 0.5 if they are equal."""
    return F.when(high > low, (x - low) / F.nullif(high - low, F.lit(0.0))).otherwise(F.lit(0.5))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def peak_gain(peak: Column) -> Column:
    """Gain that takes a peak to 0.9, 50 at most; near silence is left as it is."""
    return F.when(peak > 1e-6, F.least(F.lit(50.0), F.lit(0.9) / peak)).otherwise(F.lit(1.0))


def mel(hz: Column) -> Column:
    return 2595 * F.log10(1 + hz / 700)


def hertz(m: Column) -> Column:
    return 700 * (F.pow(F.lit(10.0), m / 2595) - 1)


def first_filled(*fields: Column, fallback: str) -> Column:
    """The first field that is neither null nor empty."""
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in fields], F.lit(fallback))


def palette_index(name: Column, colours: int) -> Column:
    """Stable palette entry of a name: its characters folded as h * 31 + code, modulo 2**32."""
    codes = F.transform(F.filter(F.split(name, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.pmod(F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(1 << 32))), F.lit(colours))


def file_stem(path: Column) -> Column:
    """Name of a file without its folders and its extension."""
    return F.regexp_replace(F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"([^/]*)$", 1), r"\.[^.]*$", "")


def sanitised(text: Column, size: int = 40) -> Column:
    """Runs of characters other than letters, digits, _ and - become one _; cut to ``size``."""
    return F.substring(F.regexp_replace(text, r"[^A-Za-z0-9_-]+", "_"), 1, size)


def id_time_ms(name: Column) -> Column:
    """Epoch milliseconds (UTC) of an id that ends in _YYYYMMDD_HHMMSS, else null."""
    stamp = F.regexp_extract(name, r"_(\d{8}_\d{6})$", 1)
    return F.when(stamp != "", F.unix_millis(F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit("yyyyMMdd_HHmmss"))))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: total(F.zip_with(x, y, lambda p, q: p * q))
    return dot(a, b) / ((F.sqrt(dot(a, a)) + 1e-9) * (F.sqrt(dot(b, b)) + 1e-9))


def arg_max(values: Column) -> Column:
    """Place (from 0) of the first largest value; null if empty."""
    return F.when(F.size(values) > 0, (F.array_position(values, F.array_max(values)) - 1).cast("int"))


NOTES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


def triad(chroma: Column, silence: float = 0.05, least: float = 0.55) -> tuple[Column, Column]:
    """Note and chord of twelve pitch classes: the best of 24 triads by share; '—' in near silence or without a clear one."""
    at = lambda i: F.get(chroma, F.lit(i % 12))
    shapes = [(root, name, third) for root in range(12) for name, third in (("maj", 4), ("min", 3))]
    scores = F.array(*[(at(root) + at(root + third) + at(root + 7)) / total(chroma) for root, _, third in shapes])
    labels = F.array(*[F.lit(f"{NOTES[root]} {name}") for root, name, _ in shapes])
    quiet = total(chroma) < silence
    note = F.when(quiet, "—").otherwise(F.get(F.array(*[F.lit(n) for n in NOTES]), arg_max(chroma)))
    return note, F.when(quiet | (F.array_max(scores) <= least), "—").otherwise(F.get(labels, arg_max(scores)))


def top_labels(labels: dict[str, Column], k: int) -> Column:
    """Names of the k largest positive values, the largest first, ties by order of naming."""
    entries = F.array(*[F.struct((-v).alias("v"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (n, v) in enumerate(labels.items())])
    return F.transform(F.slice(F.array_sort(F.filter(entries, lambda e: e["v"] < 0)), 1, k), lambda e: e["n"])


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))

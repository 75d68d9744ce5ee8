"""Recordings as tables of frames: one row per recording ``rec`` and frame number ``i`` (from 0).

A frame holds its magnitude spectrum ``s`` and its samples ``x``.  Windows run
inside a recording, groupings combine before they shuffle, and medians are
nearest ranks found without gathering a recording's rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalar import arg_max, clamp, cosine, entropy, gini, half_up, total, unit_range
from ..sources.storage import written
from .select import nearest_ranks
from .sequence import islands
from .vectors import descriptors, rms, zero_crossings


def by_time():
    return W.partitionBy("rec").orderBy("i")


def framed(df: DataFrame, samples: str, size: int, hop: int) -> DataFrame:
    """``df`` with its samples replaced by i and x: frames of ``size`` samples every ``hop``, whole ones only."""
    starts = F.when(F.size(samples) >= size, F.sequence(F.lit(0), F.floor((F.size(samples) - size) / hop).cast("int"))).otherwise(F.array().cast("array<int>"))
    return df.withColumn("i", F.explode(starts)).withColumn("x", F.slice(samples, F.col("i") * hop + 1, F.lit(size))).withColumn("i", F.col("i").cast("long")).drop(samples)


def described(frames: DataFrame, hz: float) -> DataFrame:
    """rec, i and the nine descriptors of each frame, of its spectrum and of its samples."""
    d = frames.select("rec", "i", "s", descriptors(F.col("s"), hz).alias("d"), rms(F.col("x")).alias("rms"), zero_crossings(F.col("x")).alias("zcr"))
    return d.select("rec", "i", "s", "d.*", "rms", "zcr")


def recording_means(described_: DataFrame) -> DataFrame:
    """rec and the eight means of its frames; the changes of centroid and rms are frequency and amplitude modulation."""
    step = lambda c: F.abs(F.col(c) - F.lag(c).over(by_time()))
    d = described_.withColumns({"fm": step("centroid"), "am": step("rms")})
    names = {"centroid": "centroid", "spread": "bandwidth", "entropy": "entropy", "crest": "crest", "slope": "slope", "fm": "fm", "am": "am", "tonality": "flatness"}
    return d.groupBy("rec").agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(n) for n, c in names.items()])


def mean_spectrum(frames: DataFrame) -> DataFrame:
    return frames.select("rec", F.posexplode("s").alias("k", "m")).groupBy("rec", "k").agg(F.avg("m").alias("m"))


def band_edges(bins: int, hz: float, rate: float, count: int = 10) -> list[tuple[int, int, float, float]]:
    """First and last + 1 bin, and frequencies, of ``count`` equal bands up to half the rate; fractional edges share a bin."""
    import math

    edges = [k / count * rate / 2 for k in range(count + 1)]
    return [(max(1, math.floor(lo / hz)), min(bins, math.ceil(hi / hz)), lo, hi) for lo, hi in zip(edges, edges[1:])]


def band_occupancy(frames: DataFrame, edges: Sequence[tuple[int, int, float, float]], ratio: float = 1.8) -> DataFrame:
    """rec, band, occupancy, mean_energy: the part of frames over ``ratio`` times the band's own median."""
    energy = F.array(*[total(F.slice("s", lo + 1, max(hi - lo, 0))) for lo, hi, *_ in edges])
    e = frames.select("rec", F.posexplode(energy).alias("band", "e"))
    median = nearest_ranks(e, ["rec", "band"], "e", {"median": 0.5})
    return e.join(median, ["rec", "band"]).groupBy("rec", "band").agg(
        F.avg((F.col("e") > (F.col("median") + 1e-9) * ratio).cast("double")).alias("occupancy"), F.avg("e").alias("mean_energy")
    )


def diversity_of_bands(occupancy: DataFrame) -> DataFrame:
    """rec, adi (Shannon) and aei (Gini) of the occupancies of a recording's bands."""
    o = occupancy.groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("band", "occupancy"))).alias("b"))
    values = F.transform("b", lambda b: b["occupancy"])
    return o.select("rec", entropy(values).alias("adi"), gini(values).alias("aei"))


def acoustic_entropy(frames: DataFrame) -> DataFrame:
    """rec, ht, hf, h: normalised entropy of the envelope, of the mean spectrum, and their product."""
    return acoustic_entropy_of(frames.select("rec", rms(F.col("x")).alias("r")), mean_spectrum(frames))


def acoustic_entropy_of(envelope: DataFrame, mean: DataFrame) -> DataFrame:
    """``acoustic_entropy`` of rec, r by frame and rec, m by bin."""
    part = lambda x: F.sum(F.when(F.col(x) > 0, F.col(x) * F.log(x)).otherwise(0.0))
    shannon = lambda x, n: F.when((F.sum(x) > 0) & (F.count(x) > 1), (F.log(F.sum(x)) - part(x) / F.sum(x)) / F.log(F.count(x))).otherwise(0.0).alias(n)
    t = envelope.groupBy("rec").agg(shannon("r", "ht"))
    f = mean.groupBy("rec").agg(shannon("m", "hf"))
    return t.join(f, "rec").withColumn("h", F.col("ht") * F.col("hf"))


def complexity(frames: DataFrame, per_cluster: int) -> DataFrame:
    """rec, cluster, aci: sums over bins of the changes in a cluster of frames over its intensity; lone last frames don't count."""
    c = frames.withColumn("cluster", F.floor(F.col("i") / per_cluster))
    w = W.partitionBy("rec", "cluster").orderBy("i")
    change = F.coalesce(F.zip_with("s", F.lag("s").over(w), lambda x, y: F.abs(x - y)), F.transform("s", lambda x: F.lit(0.0)))
    c = c.select("rec", "cluster", "s", change.alias("change"))
    cells = c.select("rec", "cluster", F.posexplode(F.arrays_zip(F.col("s").alias("m"), F.col("change").alias("d"))).alias("k", "c"))
    bins = cells.groupBy("rec", "cluster", "k").agg(F.sum("c.m").alias("m"), F.sum("c.d").alias("d"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    return bins.groupBy("rec", "cluster").agg(F.sum(F.when(F.col("m") > 0, F.col("d") / F.col("m")).otherwise(0.0)).alias("aci"))


def evenly(frames: DataFrame, n: int | Callable[[Column], Column]) -> DataFrame:
    """a (from 0) and the frames at n even places of each recording, first and last included; n may follow from its frames."""
    size = frames.groupBy("rec").agg(F.count(F.lit(1)).alias("_n"))
    count = F.least(n(F.col("_n")) if callable(n) else F.lit(n), F.col("_n")).cast("int")
    at = size.withColumn("a", F.explode(F.sequence(F.lit(0), count - 1))).select("rec", "a", half_up(F.col("a") / F.greatest(count - 1, F.lit(1)) * (F.col("_n") - 1)).cast("long").alias("i"))
    return at.join(frames, ["rec", "i"])


def self_similarity(frames: DataFrame, n: int | Callable[[Column], Column]) -> DataFrame:
    """rec, a, b, similarity of the spectra at n even places, all pairs of these bounded many places, both ways."""
    e = evenly(frames, n).select("rec", "a", "s")
    f = e.select("rec", F.col("a").alias("b"), F.col("s").alias("s2"))
    upper = e.join(f, "rec").where("a <= b").select("rec", "a", "b", half_up(cosine(F.col("s"), F.col("s2")), 3).alias("similarity"))
    return upper.unionByName(upper.where("a < b").select("rec", F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))


def harmonic_pitch(s: Column, low: int, high: int) -> Column:
    """Struct v, b: the largest product of a bin with its second and third multiple, the lowest bin on ties."""
    product = lambda b: F.get(s, b) * F.coalesce(F.get(s, 2 * b), F.lit(0.0)) * F.coalesce(F.get(s, 3 * b), F.lit(0.0))
    start = F.struct(F.lit(-1.0).alias("v"), F.lit(low).alias("b"))
    better = lambda a, b: F.when(product(b) > a["v"], F.struct(product(b).alias("v"), b.alias("b"))).otherwise(a)
    return F.aggregate(F.sequence(F.lit(low), F.lit(max(low, high))), start, better)


def harmonic(hz: float, bins: int, lowest: float = 80.0, highest: float = 5000.0) -> Column:
    """The harmonic product of a frame's spectrum between two frequencies."""
    import math

    low, high = max(1, math.floor(lowest / hz)), min(bins // 3, math.ceil(highest / hz))
    return harmonic_pitch(F.col("s"), low, high)


def pitch(frames: DataFrame, hz: float, bins: int) -> DataFrame:
    """rec, i, hz, voicing of each frame: harmonic product, its cube root and the loudness over the recording's largest."""
    return voiced(frames.select("rec", "i", rms(F.col("x")).alias("rms"), harmonic(hz, bins).alias("p")), hz)


def voiced(described_: DataFrame, hz: float) -> DataFrame:
    """``pitch`` of frames that have rms and their harmonic product p."""
    p = described_.select("rec", "i", F.col("rms").alias("r"), "p").withColumn("v", F.cbrt(F.greatest("p.v", F.lit(0.0))))
    top = p.groupBy("rec").agg(F.greatest(F.max("v"), F.lit(1e-9)).alias("_v"), F.greatest(F.max("r"), F.lit(1e-9)).alias("_r"))
    voicing = half_up(F.least(F.lit(1.0), F.col("v") / F.col("_v") * F.sqrt(F.col("r") / F.col("_r"))), 3)
    return p.join(top, "rec").select("rec", "i", half_up(F.col("p.b") * hz).alias("hz"), voicing.alias("voicing"))


def chroma(s: Column, hz: float, lowest: float = 55.0, a4: float = 440.0) -> Column:
    """Magnitude in each of twelve pitch classes, the octave folded; bins below ``lowest`` are left out."""
    of = lambda i: F.pmod(F.floor(12 * F.log2(i * hz / a4) + 0.5), F.lit(12))
    part = lambda c: total(F.transform(s, lambda x, i: F.when((i >= 1) & (i * hz >= lowest) & (of(i) == c), x).otherwise(0.0)))
    return F.array(*[part(c) for c in range(12)])


def flux(frames: DataFrame) -> DataFrame:
    """``frames`` with flux: the rises of a spectrum over the one before, 0 for the first."""
    rise = total(F.zip_with("s", F.lag("s").over(by_time()), lambda x, y: F.greatest(x - y, F.lit(0.0))))
    return frames.withColumn("flux", F.coalesce(rise, F.lit(0.0)))


def log_spectrogram(spectra: Column) -> Column:
    """Spectra of a window in one flat vector of ln(1 + x)."""
    return F.transform(F.flatten(spectra), F.log1p)


def point_grid(frames: DataFrame, hz: float, hop_seconds: float, window: int = 6, hop: int = 2, most: int | None = 700) -> DataFrame:
    """Windows of ``window`` frames every ``hop``, or as many as make at most about ``most`` of a recording; with None, every ``hop`` however long it is.

    rec, id, t, amplitude (over the span), dominant_hz (peak of the loudest frame),
    centroid_hz and flux (means), feature (the flat log spectrogram).
    """
    step = F.lit(hop)
    if most is not None:
        step = F.greatest(step, F.ceil(F.count(F.lit(1)).over(W.partitionBy("rec")) / most))
    ahead = W.partitionBy("rec").orderBy("i").rowsBetween(0, window - 1)
    d = flux(frames).select("rec", "i", "s", "flux", rms(F.col("x")).alias("r"), descriptors(F.col("s"), hz)["centroid"].alias("c"), step.alias("step"))
    # of frames that are equally loud the first counts
    loud = F.max_by("s", F.struct("r", (-F.col("i")).alias("i"))).over(ahead)
    p = d.select(
        "rec", "i", "step", F.count(F.lit(1)).over(ahead).alias("n"), F.sqrt(F.avg(F.col("r") * F.col("r")).over(ahead)).alias("amplitude"), loud.alias("loud"),
        F.avg("c").over(ahead).alias("centroid_hz"), F.avg("flux").over(ahead).alias("flux"), F.collect_list("s").over(ahead).alias("spectra"),
    ).where((F.col("n") == window) & (F.col("i") % F.col("step") == 0))
    t = F.col("i") * hop_seconds
    return p.select(
        "rec", F.concat_ws("_", F.col("rec").cast("string"), F.format_string("%.3f", t)).alias("id"), t.alias("t"), "amplitude",
        (arg_max(F.col("loud")) * F.lit(float(hz))).alias("dominant_hz"), "centroid_hz", "flux", log_spectrogram(F.col("spectra")).alias("feature"),
    )


def louder_points(points: DataFrame, share: float = 0.2) -> DataFrame:
    """The points at or above their recording's own quantile of amplitude."""
    least = nearest_ranks(points, ["rec"], "amplitude", {"_least": share})
    return points.join(least, "rec").where(F.col("amplitude") >= F.col("_least")).drop("_least")


def visual_channels(points: DataFrame, position: Sequence[str], spread: float) -> DataFrame:
    """Points with their position scaled to ``spread`` at most, and amplitude, frequency, flux and centroid in [0, 1]."""
    furthest = F.max(F.greatest(*[F.abs(F.col(p)) for p in position]))
    ends = points.groupBy("rec").agg(
        furthest.alias("_far"), F.max("centroid_hz").alias("_c"), *[f(c).alias(f"_{n}_{c}") for c in ("amplitude", "dominant_hz", "flux") for n, f in (("lo", F.min), ("hi", F.max))]
    )
    unit = lambda c: unit_range(F.col(c), F.col(f"_lo_{c}"), F.col(f"_hi_{c}"))
    scale = F.when(F.col("_far") > 0, F.lit(float(spread)) / F.col("_far")).otherwise(F.lit(1.0))
    of_top = F.when(F.col("_c") > 0, clamp(F.col("centroid_hz") / F.col("_c"), float("-inf"), 1.0)).otherwise(F.lit(0.5))
    return points.join(ends, "rec").select(
        *points.columns, *[(F.col(p) * scale).alias(f"scaled_{p}") for p in position],
        unit("amplitude").alias("amplitude_norm"), unit("dominant_hz").alias("color_t"), unit("flux").alias("flux_norm"), of_top.alias("centroid_norm"),
    )


def panel(frames: DataFrame, stride: int, group: int) -> DataFrame:
    """rec, frame, band, value: every ``stride``-th spectrum in groups of bins, ln(1 + mean) over the recording's largest, to 3 digits."""
    n = F.ceil(F.size("s") / group).cast("int")
    groups = F.transform(F.sequence(F.lit(0), n - 1), lambda g: F.log1p(total(F.slice("s", g * group + 1, F.lit(group))) / F.size(F.slice("s", g * group + 1, F.lit(group)))))
    p = frames.where(F.col("i") % stride == 0).select("rec", (F.col("i") / stride).cast("long").alias("frame"), F.posexplode(groups).alias("band", "v"))
    top = p.groupBy("rec").agg(F.greatest(F.max("v"), F.lit(1e-9)).alias("_top"))
    return p.join(top, "rec").select("rec", "frame", "band", half_up(F.col("v") / F.col("_top"), 3).alias("value"))


#: Digits that each series is rounded to.
DIGITS = {"centroid": 0, "rolloff": 0, "bandwidth": 0, "freqMod": 0, "flux": 2, "crest": 2, "flatness": 4, "entropy": 4, "zcr": 4, "rms": 5, "ampMod": 5, "slope": 6}


def series(frames: DataFrame, hz: float, stride: int) -> DataFrame:
    """rec, frame and twelve rounded series at every ``stride``-th frame; changes are against the kept frame before, 0 at first."""
    return paced(described(frames, hz).join(flux(frames).select("rec", "i", "flux"), ["rec", "i"]), stride)


def paced(described_: DataFrame, stride: int) -> DataFrame:
    """``series`` of frames that have their descriptors and flux."""
    kept = described_.where(F.col("i") % stride == 0)
    top = kept.groupBy("rec").agg(F.greatest(F.max("flux"), F.lit(1e-9)).alias("_flux"))
    d = kept.join(top, "rec").withColumn("flux", F.col("flux") / F.col("_flux"))
    for name, of in (("freqMod", "centroid"), ("ampMod", "rms")):
        d = d.withColumn(name, F.coalesce(F.abs(F.col(of) - F.lag(of).over(by_time())), F.lit(0.0)))
    return d.select("rec", (F.col("i") / stride).cast("long").alias("frame"), *[half_up(F.col(c), n).alias(c) for c, n in DIGITS.items()])


def _runs(described_: DataFrame, hop: float) -> tuple[DataFrame, DataFrame]:
    """The frames, and runs (first_row, last_row) of those louder than the recording's own 85 % rank."""
    import math

    frames_in = lambda seconds: max(1, math.floor(seconds / hop + 0.5))
    loud = nearest_ranks(described_, ["rec"], "rms", {"_limit": 0.85})
    d = written(described_.select("rec", "i", "rms", "centroid").join(loud, "rec"))
    return d, islands(d, "rec", "i", "i", F.col("rms") > F.col("_limit"), frames_in(0.06), frames_in(0.035))


def contours(described_: DataFrame, hop: float, length: int, value: str = "centroid") -> DataFrame:
    """rec, first (frame of its start) and v: the course of ``value`` over each syllable at ``length`` even places.

    A place between two frames is on the line between them.  Only the frames at these
    places meet the syllable, so a long syllable is no larger than a short one.
    """
    _, runs = _runs(described_, hop)
    span = F.col("last_row") - F.col("first_row")
    places = runs.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).withColumn("_at", F.col("a") / max(1, length - 1) * span)
    ends = F.array(F.struct(F.floor("_at").alias("o"), (1 - (F.col("_at") - F.floor("_at"))).alias("w")), F.struct((F.floor("_at") + 1).alias("o"), (F.col("_at") - F.floor("_at")).alias("w")))
    ends = places.withColumn("_e", F.explode(ends)).where("_e.w > 0").select("rec", (F.col("first_row") - 1).cast("long").alias("first"), "a", (F.col("first_row") - 1 + F.col("_e.o")).cast("long").alias("i"), "_e.w")
    met = ends.join(described_.select("rec", "i", F.col(value).alias("x")), ["rec", "i"]).groupBy("rec", "first", "a").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    found = met.groupBy("rec", "first").agg(F.array_sort(F.collect_list(F.struct("a", "x"))).alias("p"))
    return found.select("rec", "first", F.transform("p", lambda p: p["x"]).alias("v"))


def syllables(described_: DataFrame, hop: float) -> DataFrame:
    """rec, start, end, duration, peak_hz, peak_amp of runs of frames louder than the recording's own 85 % rank.

    Pauses of at most 0.06 s are filled, a leading one too; runs under 0.035 s go.
    """
    d, runs = _runs(described_, hop)
    inside = d.join(runs.select(F.col("rec").alias("_rec"), "first_row", "last_row"), (F.col("rec") == F.col("_rec")) & (F.col("i") >= F.col("first_row") - 1) & (F.col("i") < F.col("last_row")))
    peaks = inside.groupBy("rec", "first_row", "last_row").agg(F.max_by("centroid", F.struct("rms", (-F.col("i")).alias("i"))).alias("c"), F.max("rms").alias("r"))
    return peaks.select(
        "rec", half_up((F.col("first_row") - 1) * hop, 3).alias("start"), half_up(F.col("last_row") * hop, 3).alias("end"),
        half_up((F.col("last_row") - F.col("first_row") + 1) * hop, 3).alias("duration"), half_up(F.col("c")).alias("peak_hz"), half_up(F.col("r"), 4).alias("peak_amp"),
    )


def analysed(frames: DataFrame, hz: float, bins: int) -> DataFrame:
    """rec, i, s, the descriptors, flux and harmonic product p of each frame, in one pass, written for all that reads them."""
    d = flux(frames).select("rec", "i", "s", "flux", descriptors(F.col("s"), hz).alias("d"), rms(F.col("x")).alias("rms"), zero_crossings(F.col("x")).alias("zcr"), harmonic(hz, bins).alias("p"))
    return written(d.select("rec", "i", "s", "flux", "d.*", "rms", "zcr", "p"))


@dataclass
class Analysis:
    """The tables of a recording's analysis, by rec: pitch by frame, syllables, clusters, similarity of places, bands, indices."""

    pitch: DataFrame
    syllables: DataFrame
    complexity: DataFrame
    similarity: DataFrame
    bands: DataFrame
    indices: DataFrame


def analysis(frames: DataFrame, hz: float, bins: int, rate: float, hop: float) -> Analysis:
    """All of a recording's analysis from one pass over its frames.

    Self-similarity has four places a second, 100 at least and 220 at most.  A cluster
    of the complexity is a second.  Indices: adi and aei of the bands' occupancies, bi
    (area of the mean spectrum in dB over its least, 2 to 8 kHz), and the entropies.
    """
    import math

    t = analysed(frames, hz, bins)
    places = lambda n: F.least(F.lit(220.0), F.greatest(F.lit(100.0), half_up(n * hop * 4)))
    occupancy = band_occupancy(t, band_edges(bins, hz, rate)).withColumns({c: half_up(F.col(c), 3) for c in ("occupancy", "mean_energy")})
    mean = mean_spectrum(t)
    db = 10 * F.log10(F.col("m") + 1e-9)
    low, high = max(1, math.floor(2000 / hz)), min(bins, math.ceil(8000 / hz))
    area = mean.where((F.col("k") >= low) & (F.col("k") < high)).groupBy("rec").agg(((F.sum(db) - F.count(db) * F.min(db)) * (hz / 1000)).alias("bi"))
    entropies = acoustic_entropy_of(t.select("rec", F.col("rms").alias("r")), mean)
    indices = diversity_of_bands(occupancy).join(entropies, "rec").join(area, "rec", "left")
    digits = {"adi": 3, "aei": 3, "bi": 2, "h": 3, "ht": 3, "hf": 3}
    return Analysis(
        voiced(t, hz), syllables(t, hop), complexity(t, max(2, int(1 / hop + 0.5))), self_similarity(t, places), occupancy,
        indices.select("rec", *[half_up(F.coalesce(F.col(c), F.lit(0.0)), n).alias(c) for c, n in digits.items()]),
    )


def syllable_summary(found: DataFrame, frames: DataFrame, hop: float) -> DataFrame:
    """rec, count, mean_duration, mean_gap, repetition_rate of every recording, 0 where it has none."""
    gap = half_up(F.col("start") - F.lag("end").over(W.partitionBy("rec").orderBy("start")), 3)
    s = found.withColumn("gap", gap).groupBy("rec").agg(F.count(F.lit(1)).alias("n"), F.avg("duration").alias("d"), F.avg("gap").alias("g"))
    span = frames.groupBy("rec").agg((F.count(F.lit(1)) * hop).alias("span"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return span.join(s, "rec", "left").select(
        "rec", F.coalesce("n", F.lit(0)).alias("count"), half_up(zero(F.col("d")), 3).alias("mean_duration"), half_up(zero(F.col("g")), 3).alias("mean_gap"),
        half_up(zero(F.col("n") / F.col("span")), 2).alias("repetition_rate"),
    )


def summary_features(frames: DataFrame, hz: float, bins: int, hop: float, stride: int = 1) -> DataFrame:
    """One row per recording: the fourteen features that tell recordings apart."""
    frames = d = analysed(frames, hz, bins)
    s = written(paced(d, stride))
    means = s.groupBy("rec").agg(*[F.avg(c).alias(c) for c in ("centroid", "bandwidth", "flatness", "entropy", "flux", "zcr")])
    wide = nearest_ranks(s, ["rec"], "centroid", {"c9": 0.9, "c1": 0.1})
    p = voiced(d, hz)
    tonal = p.groupBy("rec").agg(F.avg((F.col("voicing") > 0.15).cast("double")).alias("voicedFrac"))
    tones = nearest_ranks(p.where("voicing > 0.15 and hz > 0"), ["rec"], "hz", {"p9": 0.9, "p1": 0.1})
    calls = syllable_summary(syllables(d, hop), frames, hop)
    per = max(2, int(1 / hop + 0.5))
    aci = complexity(frames, per).groupBy("rec").agg(half_up(F.sum("aci"), 1).alias("aci"))
    dur = frames.groupBy("rec").agg((F.count(F.lit(1)) * hop).alias("dur"))
    rows = dur.join(calls, "rec").join(aci, "rec", "left").join(means, "rec").join(wide, "rec").join(tonal, "rec").join(tones, "rec", "left")
    return rows.select(
        "rec", "dur", F.col("repetition_rate").alias("repRate"), F.col("mean_duration").alias("syllDur"), F.col("mean_gap").alias("gap"),
        (F.coalesce("aci", F.lit(0.0)) / F.col("dur")).alias("aciPerSec"), "centroid", (F.col("c9") - F.col("c1")).alias("centroidRange"),
        "bandwidth", "flatness", "entropy", "flux", "zcr", "voicedFrac", F.coalesce(F.col("p9") - F.col("p1"), F.lit(0.0)).alias("pitchRange"),
    )


def loudest_part(samples: Column, size: int, hop: int) -> Column:
    """Struct at, rms of the loudest ``size`` samples: starts every ``hop``, the earliest on ties, the end last; missing samples are 0."""
    last = F.greatest(F.size(samples) - size, F.lit(0))
    power = lambda a: F.sqrt(total(F.transform(F.slice(samples, a + 1, F.lit(size)), lambda x: x * x)) / size)
    starts = F.array_union(F.sequence(F.lit(0), last, F.lit(hop)), F.array(last))
    start = F.struct(F.lit(0).alias("at"), F.lit(-1.0).alias("rms"))
    better = lambda a, k: F.when(power(k) > a["rms"], F.struct(k.alias("at"), power(k).alias("rms"))).otherwise(a)
    return F.aggregate(starts, start, better)

"""Scalar functions over steps, notes, durations and names, as column expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ostinato.functions import dims


def step_of_note(note: Column, bend: Column, full_scale: int = 8191) -> Column:
    """The absolute step of a MIDI note with a bend of two semitones at full scale."""
    return F.rint(note * dims.STEPS / 12 + bend / full_scale * 200 * dims.STEPS / 1200).cast("int")


def note_of_step(step: Column) -> Column:
    """The nearest MIDI note, 0 to 127."""
    return F.least(F.greatest(F.rint(step * 12 / dims.STEPS).cast("int"), F.lit(0)), F.lit(127))


def bend_of_step(step: Column, full_scale: int = 8191) -> Column:
    """The bend from the nearest note to the step, rounded half to even and clamped to its range."""
    cents = (step * F.lit(1200) / dims.STEPS) - note_of_step(step) * 100
    return F.least(F.greatest(F.rint(cents / 200 * full_scale).cast("int"), F.lit(-8192)), F.lit(8191))


def nearest(value: Column, grid: list) -> Column:
    """The grid value nearest to one; the smaller of two that are as near."""
    grid = sorted(grid)
    found = F.lit(grid[-1])
    for low, high in reversed(list(zip(grid, grid[1:], strict=False))):
        found = F.when(value <= (low + high) / 2, F.lit(low)).otherwise(found)
    return F.when(value.isNotNull(), found)


def quantised_duration(beats: Column) -> Column:
    """The grid duration nearest to a number of beats; the shortest where it is not positive."""
    return F.when(beats <= 0, F.lit(dims.DURATIONS[0])).otherwise(nearest(beats, dims.DURATIONS))


def velocity_bin(velocity: Column, bins: int = dims.VELOCITY_BINS) -> Column:
    """1 to ``bins``; 1 for velocities that are not positive."""
    return F.when(velocity <= 0, F.lit(1)).otherwise(F.least(F.greatest(F.ceil(velocity / 127 * bins).cast("int"), F.lit(1)), F.lit(bins)))


def velocity_of_bin(bin_: Column, bins: int = dims.VELOCITY_BINS) -> Column:
    return F.least(F.greatest(F.rint(bin_ / bins * 127).cast("int"), F.lit(1)), F.lit(127))


def ratio_of_step(step: Column) -> Column:
    return F.pow(F.lit(2.0), step / dims.STEPS)


def step_of_ratio(ratio: Column) -> Column:
    return F.rint(F.log2(ratio) * dims.STEPS).cast("int")


def semitone_ratio(semitones: Column) -> Column:
    return F.pow(F.lit(2.0), semitones / 12)


def hertz_of_step(step: Column) -> Column:
    return F.lit(440.0) * F.pow(F.lit(2.0), step / dims.STEPS - F.lit(69 / 12))


def hertz_of_note(note: Column, bend_semitones: Column | None = None) -> Column:
    bent = note if bend_semitones is None else note + bend_semitones
    return F.lit(440.0) * F.pow(F.lit(2.0), (bent - 69) / 12)


def cents_of_ratio(ratio: Column) -> Column:
    return F.log2(ratio) * 1200


def cents_from_semitone(step: Column) -> Column:
    """How far a step is from the nearest semitone."""
    cents = step * F.lit(1200) / dims.STEPS
    return cents - F.rint(cents / 100) * 100


def retuned_hertz(note: Column, step: Column) -> Column:
    """The frequency of a note whose pitch class sounds at a step of the octave; deviations wrap at half an octave."""
    off = step - F.pmod(note, F.lit(12)) * dims.STEPS / 12
    off = F.when(off > 26.5, off - dims.STEPS).when(off < -26.5, off + dims.STEPS).otherwise(off)
    return hertz_of_note(note) * F.pow(F.lit(2.0), off / dims.STEPS)


def cents_between(target: Column, base: Column) -> Column:
    """0 where the base isn't positive."""
    return F.when(base > 0, F.log2(target / base) * 1200).otherwise(F.lit(0.0))


def bend_of_cents(cents: Column, range_cents: int = 200) -> Column:
    """Truncated toward zero and clamped."""
    return F.least(F.greatest((cents / range_cents * 8192).cast("int"), F.lit(-8192)), F.lit(8191))


def pitch_class(step: Column) -> Column:
    return F.pmod(step, F.lit(dims.STEPS))


def intervals(steps: Column, root: Column) -> Column:
    """The distinct intervals above a root within the octave, ascending, without the root itself."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(steps, lambda s: F.pmod(s - root, F.lit(dims.STEPS))), lambda x: x != 0)))


def in_zone(found: Column, zone: tuple[int, int]) -> Column:
    """The lowest interval in a zone, or null."""
    return F.array_min(F.filter(found, lambda x: x.between(*zone)))


def in_grid(found: Column, zone: tuple[int, int], grid: list[int]) -> Column:
    """The lowest interval in a zone, moved to the nearest of a grid (the smaller of two as near); null without one.

    The zone's few steps are a literal array, so the interval is looked up and computed once.
    """
    moved = [min(grid, key=lambda g: (abs(g - x), g)) for x in range(zone[0], zone[1] + 1)]
    return F.get(F.array(*[F.lit(g) for g in moved]), (in_zone(found, zone) - zone[0]).cast("int"))


def chord_tones(found: Column) -> Column:
    """third, fifth and seventh of a chord's intervals; a missing fifth is the perfect one, others are null."""
    third, fifth, seventh = (in_grid(found, zone, grid) for zone, grid in ((dims.THIRD_ZONE, dims.THIRDS), (dims.FIFTH_ZONE, dims.FIFTHS), (dims.SEVENTH_ZONE, dims.SEVENTHS)))
    return F.struct(third.alias("third"), F.coalesce(fifth, F.lit(dims.DEFAULT_FIFTH)).alias("fifth"), seventh.alias("seventh"))


def tone_ratios(tones: Column) -> Column:
    """alpha, beta and gamma of (third, fifth, seventh): without a third alpha is 1, without a seventh gamma equals beta."""
    alpha = F.coalesce(ratio_of_step(tones["third"]), F.lit(1.0))
    gamma = ratio_of_step(F.coalesce(tones["seventh"], tones["fifth"]))
    return F.struct(alpha.alias("alpha"), ratio_of_step(tones["fifth"]).alias("beta"), gamma.alias("gamma"))


def chord_ratios(found: Column) -> Column:
    """alpha, beta and gamma of a chord's intervals: of its third, its fifth and its seventh. Each is found once."""
    return F.get(F.transform(F.transform(F.array(found), chord_tones), tone_ratios), F.lit(0))


def chord_label(tones: Column) -> Column:
    """The signs of (third, fifth, seventh), joined by hyphens; a dash where one is missing."""
    sign = lambda names, step: F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[step], F.lit("–"))
    return F.concat_ws("-", sign(dims.THIRD_SIGNS, tones["third"]), sign(dims.FIFTH_SIGNS, tones["fifth"]), sign(dims.SEVENTH_SIGNS, tones["seventh"]))


def extra_intervals(found: Column) -> Column:
    """Intervals that are no chord's third, fifth or seventh: all but the lowest of each zone."""
    return F.array_except(found, F.array(*[in_zone(found, z) for z in (dims.THIRD_ZONE, dims.FIFTH_ZONE, dims.SEVENTH_ZONE)]))


def style_label(raw: Column) -> Column:
    """The style of a raw name: whole names first, else the last listed word that occurs; null if there is none."""
    name = F.trim(raw)
    squeezed = F.lower(F.replace(F.replace(F.replace(name, F.lit("&"), F.lit("n")), F.lit(" and "), F.lit(" n ")), F.lit(" "), F.lit("")))
    found = F.lit(None).cast("string")
    for word, label in dims.STYLE_WORDS:
        hit = squeezed.isin(*dims.RNB_SPELLINGS) if word == dims.RNB else name.contains(word)
        found = F.when(hit, F.lit(label)).otherwise(found)
    for whole, label in dims.STYLE_NAMES.items():
        found = F.when(name == whole, F.lit(label)).otherwise(found)
    return F.when(F.length(name) > 0, found)


def format_style(raw: Column) -> Column:
    """The style of a raw name by the older rules: of words that occur the last listed, then whole names; else itself."""
    found = raw
    for word, label in dims.FORMAT_STYLE_WORDS:
        found = F.when(raw.contains(word), F.lit(label)).otherwise(found)
    for names, label in dims.FORMAT_STYLE_NAMES:
        late = F.when(raw.isin(*names), F.lit(label))
        found = F.coalesce(late, found)
    for names, label in dims.FORMAT_EARLY_NAMES:
        hit = F.greatest(*[raw.contains(word) for word, _ in dims.FORMAT_STYLE_WORDS])
        found = F.when(raw.isin(*names) & ~hit, F.lit(label)).otherwise(found)
    return found


def clip_parts(file: Column) -> Column:
    """(source, style, type) of a clip's file name: of model_A, model_B and dataset the first that occurs; the rest by its end."""
    stem = F.regexp_replace(file, r"(?i)\.(wav|mp3)$", "")
    part = lambda k: F.nullif(F.regexp_extract(stem, r"(?i)__([a-z0-9]+)__type_([A-Za-z0-9_]+)$", k), F.lit(""))
    source = F.when(stem.contains("model_A"), "model_A").when(stem.contains("model_B"), "model_B").when(stem.contains("dataset"), "dataset")
    return F.struct(source.alias("source"), part(1).alias("style"), F.concat(F.lit("type_"), part(2)).alias("type"))


def form_label(raw: Column) -> Column:
    """The label of a form marker with or without its prefix, in any case; null if there is none."""
    label = F.upper(F.trim(F.regexp_replace(F.trim(raw), "(?i)^form_", "")))
    for alias, meant in dims.FORM_ALIASES.items():
        label = F.when(label == alias, F.lit(meant)).otherwise(label)
    return F.when(label.isin(dims.FORMS), label)


def semantic_step(step: Column) -> Column:
    """What a step above the root is called; ``step<n>`` where it has no name."""
    names = F.array(*[F.lit(dims.SEMANTIC_STEPS.get(s, f"step{s}")) for s in range(dims.STEPS)])
    return F.get(names, F.pmod(step, F.lit(dims.STEPS)).cast("int"))


def chord_name(third: Column, fifth: Column, seventh: Column) -> Column:
    """The name of a chord by the qualities of its third, fifth and seventh: from the table, else put together of parts."""
    table = F.create_map(*[F.lit(x) for k, n in dims.chord_names().items() for x in ("|".join(v or "" for v in k), n)])
    parts = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    alias = F.when(fifth == "diminished-fifth", F.lit("diminished")).otherwise(fifth)
    known = table[F.concat_ws("|", F.coalesce(third, F.lit("")), F.coalesce(alias, F.lit("")), F.coalesce(F.replace(seventh, F.lit("-"), F.lit("")), F.lit("")))]
    base = F.coalesce(parts(dims.THIRD_PREFIXES)[third], F.concat(F.lit("("), F.coalesce(third, F.lit("None")), F.lit(")")))
    middle = F.coalesce(parts(dims.FIFTH_SUFFIXES)[fifth], F.concat(F.lit("("), fifth, F.lit(")")), F.lit(""))
    plain = F.coalesce(parts(dims.SEVENTH_SUFFIXES)[seventh], F.lit(""))
    minor = F.when((third == "major") | base.endswith("m"), F.lit("7")).otherwise(F.lit("m7"))
    full = (middle.contains("dim")) | (middle == "(b5)")
    end = F.when(seventh.isNull(), F.lit("")).when(seventh == "minor", minor).when((seventh == "diminished-seventh") & full, F.lit("7")).when((seventh == "diminished-seventh") & (middle == ""), F.lit("dim7")).otherwise(plain)
    whole = F.when((seventh == "diminished-seventh") & (base == "m") & fifth.isin("diminished", "diminished-fifth"), F.lit("dim7")).otherwise(F.concat(base, middle, end))
    return F.coalesce(known, whole)


def learning_rate(step: Column, peak: float, least: float, warm: int, last: int) -> Column:
    """Linear up to the peak, then half a cosine down to the least."""
    import math

    share = (step - warm) / (last - warm)
    curve = F.lit(least) + (F.lit(1.0) + F.cos(share * math.pi)) * 0.5 * (peak - least)
    return F.when(step < warm, step * (peak / warm)).when(step > last, F.lit(least)).otherwise(curve)


def is_duration(token: Column) -> Column:
    """Whether a token reads as a number. What can't begin one isn't tried, as a failed try costs far more than the look."""
    return F.when(token.rlike(r"^[\x00-\x20]*[-+.0-9iInN]"), token.try_cast("double").isNotNull()).otherwise(F.lit(False))

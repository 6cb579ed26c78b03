"""Charts of twelve semitones relabelled in 53 steps: roots and qualities by the scale of their key, the rest as it is.

What a token is depends on its neighbours only, so a song is one array of tokens, and the names of its scale, which come
from a join with a dimension made of the scales, are another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.functions import dims, music, spelling

# Third, fifth and seventh of each quality in semitones, and tokens that are no chord.
QUALITY_SEMITONES = {
    "maj": (4, 7, None), "maj6": (4, 7, None), "maj7": (4, 7, 11), "m": (3, 7, None), "m6": (3, 7, None), "m7": (3, 7, 10), "m_maj7": (3, 7, 11),
    "dom7": (4, 7, 10), "sus": (5, 7, None), "sus4": (5, 7, None), "sus2": (2, 7, None), "sus7": (5, 7, 10), "o": (3, 6, None), "o7": (3, 6, 9),
    "ø7": (3, 6, 10), "o_maj7": (3, 6, 11), "aug": (4, 8, None), "power": (None, 7, None), "N.C.": (None, None, None),
}
PLAIN = (4, 7, None)
PLAIN_SEMITONES = tuple(-1 if x is None else x for x in PLAIN)
STRUCTURE = [".", "|", "||", ":|", "|:", "b||", "e||", "/", "N.C.", "<style>"]
BEFORE_NO_QUALITY = ["|", "|:", ":|", "e||", "b||", "/", "."]


def root_dim(spark: SparkSession) -> DataFrame:
    """(tonic_name, pc): spellings of the twelve pitch classes."""
    return spark.createDataFrame([(n, int(pc)) for n, pc in TONIC_CLASSES.items()], "tonic_name string, pc int")


#: The pitch class of each spelling.
TONIC_CLASSES = {n: ((spelling.LINE.index(n) - spelling.LINE.index("C")) * 7) % 12 for n in dims.TONICS}


def pitch_class_of(name: Column) -> Column:
    """0 to 11, null for other names."""
    return F.create_map(*[F.lit(x) for kv in TONIC_CLASSES.items() for x in kv])[name]


def name_dim(spark: SparkSession, unnamed: bool = False) -> DataFrame:
    """(type, tonic, pc, third, fifth, seventh, root_name, quality_name): names of chords in every scale, from semitones.

    A step without a name counts as missing, or as ``step<n>`` if ``unnamed``. 14 types by 12 tonics by 12 roots by the
    intervals that qualities have; a missing interval is -1.
    """
    semitones = sorted({tuple(-1 if x is None else x for x in v) for v in QUALITY_SEMITONES.values()})
    shapes = spark.createDataFrame(semitones, "third int, fifth int, seventh int")
    scales = [(kind, tonic, [*dims.chromatic_scale(kind, tonic)]) for kind in dims.SCALES for tonic in range(12)]
    rows = spark.createDataFrame(scales, "type string, tonic int, scale array<int>").withColumn("pc", F.explode(F.sequence(F.lit(0), F.lit(11)))).crossJoin(F.broadcast(shapes))
    root = F.get("scale", F.col("pc"))

    def name(interval: str) -> Column:
        step = F.pmod(F.get("scale", (F.col("pc") + F.col(interval)) % 12) - root, F.lit(dims.STEPS))
        named = music.semantic_step(step)
        return F.when(F.col(interval) >= 0, named if unnamed else F.when(~named.startswith("step"), named))

    rows = rows.withColumns({f"_{c}": name(c) for c in ("third", "fifth", "seventh")})
    note = F.element_at(F.array(*[F.lit(n) for n in dims.NOTE_NAMES]), root + 1)
    return rows.select("type", "tonic", "pc", "third", "fifth", "seventh", note.alias("root_name"), music.chord_name(F.col("_third"), F.col("_fifth"), F.col("_seventh")).alias("quality_name"))


def _code(third, fifth, seventh):
    return third * 10_000 + fifth * 100 + seventh


#: Codes of the intervals that qualities have, as name_dim has them.
SHAPES = sorted(_code(*(-1 if x is None else x for x in v)) for v in set(QUALITY_SEMITONES.values()))


def _with_names(songs: DataFrame, dim: DataFrame) -> DataFrame:
    """Adds ``_names`` of the song's type and tonic: a struct for each pitch class and shape in turn."""
    entry = F.struct("pc", _code(F.col("third"), F.col("fifth"), F.col("seventh")).alias("code"), "root_name", "quality_name")
    names = dim.groupBy("type", "tonic").agg(F.array_sort(F.collect_list(entry)).alias("_names"))
    return songs.join(F.broadcast(names), ["type", "tonic"], "left")  # as many rows as there are scales and keys


def _name(root: Column, semitones: list[Column]) -> Column:
    """The names of a chord, null where its root or its intervals are not in the dimension."""
    return _name_of_code(root, _code(*semitones))


def _name_of_code(root: Column, code: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(c) for c in SHAPES]), code)
    return F.get("_names", (pitch_class_of(root) * len(SHAPES) + F.nullif(at, F.lit(0)) - 1).cast("int"))


def _gathered(df: DataFrame, key: list[str], pos: str, token: str) -> DataFrame:
    toks = F.transform(F.array_sort(F.collect_list(F.struct(pos, token))), lambda r: r[token])
    return df.groupBy(*key).agg(toks.alias("toks"), F.first("type").alias("type"), F.first("tonic").alias("tonic"))


def _semitones(quality: Column, k: int) -> Column:
    known = F.create_map(*[x for q, v in QUALITY_SEMITONES.items() for x in (F.lit(q), F.lit(-1 if v[k] is None else v[k]))])
    return F.coalesce(known[quality], F.lit(-1 if PLAIN[k] is None else PLAIN[k]))


def relabelled(df: DataFrame, key: list[str], dim: DataFrame, pos: str = "pos", token: str = "tok") -> DataFrame:
    """(key, pos, tok) of (key, pos, tok, type, tonic), of which a song has one type and tonic, by relabelled_of."""
    return relabelled_of(_gathered(df, key, pos, token), key, dim).select(*key, F.posexplode("toks").alias(pos, "tok"))


def relabelled_of(songs: DataFrame, key: list[str], dim: DataFrame) -> DataFrame:
    """(key, toks) of (key, toks, type, tonic): a root becomes the name of its step, its quality that of its chord.

    A root is a spelled pitch class that doesn't follow a slash; the token after it is its quality unless it is structural,
    a form mark, a duration or a root. A root without a quality gets the name of a plain chord, if that has one; a quality
    whose chord has no name stays. After a slash only the root is renamed. ``dim`` is name_dim.
    """
    key_name = lambda c: c.isin(dims.TONICS)
    other = lambda c: c.isin(STRUCTURE) | c.startswith("Form_") | music.is_duration(c) | key_name(c)
    semitones = lambda quality: [_semitones(quality, k) for k in range(3)]
    text = lambda c: F.coalesce(c, F.lit(""))

    def parts(tok: Column, i: Column) -> Column:
        before, after = F.get("toks", i - 1), F.get("toks", i + 1)
        is_quality = F.coalesce(key_name(before) & (text(F.get("toks", i - 2)) != "/"), F.lit(False)) & ~other(tok)
        root, plain = _name(tok, semitones(F.lit(""))), lambda name: F.nullif(name["quality_name"], F.lit(""))
        bare = F.when((text(before) != "/") & ~F.coalesce(~other(after), F.lit(False)), plain(root))
        return F.when(key_name(tok), F.array(root["root_name"], bare)).when(is_quality, F.array(F.coalesce(plain(_name(before, semitones(tok))), tok))).otherwise(F.array(tok))

    return _spread(_with_names(songs, dim), key, parts)


def _spread(songs: DataFrame, key: list[str], parts) -> DataFrame:
    return songs.select(*key, F.filter(F.flatten(F.transform("toks", parts)), lambda t: t.isNotNull()).alias("toks"))


def semitones_of_text(quality: Column) -> list[Column]:
    """Third, fifth and seventh in semitones, told by the first of some words that a quality's text holds."""
    has = lambda *words: F.greatest(*[quality.contains(w) for w in words]) if len(words) > 1 else quality.contains(words[0])
    kinds = [
        ("maj7", has("maj7", "Maj7")), ("maj", has("maj")), ("dom7", has("dom7") | (quality == "7")), ("m7", has("m7", "min7")),
        ("m", has("m", "min")), ("dim", has("dim", "ø")), ("aug", has("aug", "+")),
    ]
    kind = F.lit("plain")
    for name, hit in reversed(kinds):
        kind = F.when(hit, name).otherwise(kind)
    seven = quality.contains("7")
    third = F.when(kind.isin("m7", "m", "dim"), 3).otherwise(4)
    fifth = F.when(kind == "dim", 6).when(kind == "aug", 8).otherwise(7)
    seventh = F.when(kind == "maj7", 11).when(kind.isin("dom7", "m7"), 10).when((kind == "m") & seven, 10).when((kind == "dim") & quality.contains("ø"), 10).when((kind == "dim") & seven, 9).when((kind == "aug") & seven, 10).otherwise(-1)
    return [third, fifth, seventh]


def relabelled_by_text(df: DataFrame, key: list[str], dim: DataFrame, pos: str = "pos", token: str = "tok") -> DataFrame:
    """(key, pos, tok) of (key, pos, tok, type, tonic), of which a song has one type and tonic, by relabelled_by_text_of."""
    return relabelled_by_text_of(_gathered(df, key, pos, token), key, dim).select(*key, F.posexplode("toks").alias(pos, "tok"))


def relabelled_by_text_of(songs: DataFrame, key: list[str], dim: DataFrame) -> DataFrame:
    """The older rule: as relabelled_of, but a quality is read by what its text holds, and may itself be a spelled root.

    So of roots that follow each other every second one is a quality. A name stands after every root, also an empty one.
    ``dim`` is name_dim with names for all steps.
    """
    slashed = lambda i: F.coalesce(F.get("toks", i - 1) == "/", F.lit(False))
    blocked = lambda c: c.isin(BEFORE_NO_QUALITY) | c.startswith("Form_") | F.regexp_replace(c, r"^([^.]*)\.", "$1").rlike(r"^\d+$")
    # Runs of spelled tokens: the first, third ... are roots (R), the others their qualities (q).
    letters = F.array_join(F.transform("toks", lambda t, i: F.when(t.isin(dims.TONICS) & ~slashed(i), "R").otherwise("x")), "")
    roles = F.split(F.regexp_replace(letters, "RR", "Rq"), "")
    # Each step once for each token: a root's quality, the code of its intervals, its names.
    named = _with_names(songs, dim).withColumn("_roles", roles)
    quality = lambda role, i: F.when(role == "R", F.when(~blocked(F.get("toks", i + 1)), F.get("toks", i + 1)).otherwise(""))
    named = named.withColumn("_qualities", F.transform("_roles", quality))
    named = named.withColumn("_codes", F.transform("_qualities", lambda q: F.when(q.isNotNull(), _code(*semitones_of_text(q)))))
    named = named.withColumn("_roots", F.transform("_codes", lambda c, i: F.when(c.isNotNull(), _name_of_code(F.get("toks", i), c))))

    def parts(tok: Column, i: Column) -> Column:
        root = F.get("_roots", i)
        is_quality = F.coalesce(F.get("_roles", i - 1) == "R", F.lit(False)) & ~blocked(tok)
        bass = _name_of_code(tok, F.lit(_code(*PLAIN_SEMITONES)))["root_name"]
        return F.when(F.get("_roles", i) == "R", F.array(root["root_name"], root["quality_name"])).when(slashed(i) & tok.isin(dims.TONICS), F.array(bass)).when(is_quality, F.array().cast("array<string>")).otherwise(F.array(tok))

    return _spread(named, key, parts)


def pair_corpus(files: DataFrame, texts: DataFrame, stem: str = "stem", base: str = "base") -> tuple[DataFrame, DataFrame]:
    """Files of a type with the text of their song: (stem, base, text, type, key) of those paired, and (status, n) of all.

    Statuses in this order: a bad stem, a missing text, a text that can't be read (null ``tokens``), written.
    """
    parts = spelling.stem_parts(F.col(stem))
    named = files.select(stem, parts.alias("_p")).withColumn(base, F.when(F.col("_p.type").isNotNull(), F.regexp_extract(stem, r"^(.*)_type_\d+_\w+$", 1)))
    joined = named.join(texts.select(base, "tokens", F.lit(True).alias("_found")), base, "left")
    status = F.when(F.col("_p.type").isNull(), "bad_stem").when(F.col("_found").isNull(), "missing_text").when(F.col("tokens").isNull(), "bad_text").otherwise("written")
    joined = joined.withColumn("status", status)
    report = joined.groupBy("status").agg(F.count("*").alias("n"))
    return joined.where("status = 'written'").select(stem, base, "tokens", F.col("_p.type").alias("type"), F.col("_p.key").alias("key")), report

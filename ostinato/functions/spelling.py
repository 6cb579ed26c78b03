"""Note names on the line of fifths, chord symbols and file names."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The line of fifths from Fbb to B##: seven letters in five alterations.
LINE = [letter + accidental for accidental in ("bb", "b", "", "#", "##") for letter in "FCGDAEB"]

# Notes and qualities of charts, tokens that are no chord, and tokens after which a root has no quality.
NOTES = ["C", "D", "E", "F", "G", "A", "B", "F#", "C#", "G#", "D#", "A#", "E#", "Bb", "Eb", "Ab", "Db", "Gb", "Cb", "Fb"]
NATURES = ["maj", "maj6", "maj7", "m", "m7", "m_maj7", "m6", "dom7", "ø7", "o7", "o", "power", "sus", "sus7", "sus2", "sus4", "aug", "o_maj7"]
MARKS = [".", "<start>", "<end>", "<pad>"]
NO_CHORDS = [
    *MARKS, "|", "||", "b||", "e||", "|:", ":|", "Repeat_0", "Repeat_1", "Repeat_2", "Repeat_3", "Intro", "Form_A", "Form_B", "Form_C", "Form_D",
    "Form_verse", "Form_intro", "Form_Coda", "Form_Head", "Form_Segno",
]
STRUCTURE = [".", "|", "||", ":|", "|:", "b||", "e||", "/"]
SPELLINGS = ["C", "C#", "Db", "D", "D#", "Eb", "E", "F", "F#", "Gb", "G", "G#", "Ab", "A", "A#", "Bb", "B"]
#: Other spellings of a tonic.
ENHARMONIC = {"C#": "Db", "Db": "C#", "D#": "Eb", "Eb": "D#", "F#": "Gb", "Gb": "F#", "G#": "Ab", "Ab": "G#", "A#": "Bb", "Bb": "A#", "E#": "F", "B#": "C", "Cb": "B", "B": "Cb", "E": "Fb", "Fb": "E"}

# Qualities of kinds by name and by printed text.
KIND_NAMES = {
    "major": "maj", "minor": "m", "dominant": "dom7", "major-seventh": "maj7", "minor-seventh": "m7", "diminished": "o", "diminished-seventh": "o7",
    "half-diminished": "ø7", "augmented": "aug", "suspended-fourth": "sus4", "suspended-second": "sus2", "major-sixth": "maj6", "minor-sixth": "m6",
    "major-ninth": "maj9", "minor-ninth": "m9", "dominant-ninth": "dom9",
}
KIND_TEXTS = {
    "": "maj", "major": "maj", "minor": "m", "m": "m", "dominant": "dom7", "7": "dom7", "maj7": "maj7", "major-seventh": "maj7", "min7": "m7",
    "minor-seventh": "m7", "diminished": "o", "dim": "o", "augmented": "aug", "sus4": "sus4", "sus2": "sus2", "6": "maj6", "major-sixth": "maj6",
}
# Ticks, name and length in whole notes.
DURATION_CLASSES = [
    (3072, "whole", 1.0), (2304, "dotted_half", 0.75), (2048, "double_triplet_quarter", 0.6666666666666666), (1536, "half", 0.5),
    (1316, "less_than_half", 0.428385416666667), (1152, "dotted_quarter", 0.375), (1024, "triplet_quarter", 0.3333333333333333),
    (877, "more_than_quarter", 0.285481770833333), (768, "quarter", 0.25), (682, "other_note", 0.222005208333333), (614, "quintuplet", 0.2),
    (384, "eighth", 0.125), (341, "less_than_eighth", 0.111002604166667), (192, "sixteenth", 0.0625), (96, "thirtysecond", 0.0325), (48, "sixtyfourth", 0.01625),
]
# Literal tokens and what stands for them.
REPLACEMENTS = {
    "minor-11th": "m add 11", "dominant-ninth": "dom7 add 9", "dominant-13th": "dom7 add 13", "dominant-11th": "dom7 add 11", "diminished": "o",
    "minor-ninth": "m7 add 9", "none": "N.C.", "major-sixth": "maj6", "diminished-seventh": "o7", "major-ninth": "maj7 add 9", "minor-sixth": "m6",
    "alter b9": "dom7 add b9", "minor": "m", "major-seventh": "maj7", "dominant": "dom7", "minor-seventh": "m7", "major": "maj", "augmented": "aug",
    "diminished-maj-seventh": "o_maj7", "suspended-fourth": "sus4", "minor-add-ninth": "m add 9",
    "add 4 subtract 3 add b9 add 4 subtract 3 add b9 alter #5": "sus7 add #5 add b9", "add b9 add 4 subtract 3 add b9 add 4 subtract 3": "sus7 add b9",
    "add 4 subtract 3 add b9 add 4 subtract 3": "sus7 add b9", "add b9 add 4 subtract 3 add #9 alter #5": "sus7 add b9",
    "add b9 add 4 subtract 3 add b9 alter #5": "sus7 add b9", "add 4 subtract 3 add 4 subtract 3": "", "add 4 subtract 3 add b9 alter #5": "sus7 add b9",
    "alter #5 add b9 add 4 subtract 3": "sus7 add b9", "add 4 subtract 3 add #9 alter #5": "sus7 add b9", "add #9 alter b5 add #9 alter b5": "alter b5 add #9",
    "add b9 alter b5 add b9 alter b5": "alter b5 add b9", "add #11 add #11 add #11 add #11": "add #11", "add #9 alter #5 add b9 alter #5": "add b9 alter #5",
    "add b9 add 4 subtract 3 add b9": "sus7 add b9", "add #11 add #9 add #11 add #9": "add #11 add #9", "add 7 add b9 add 4 subtract 3": "sus7 add b9",
    "add 4 subtract 3 alter #11": "sus7 add #11", "alter b5 alter b5 alter b5": "alter b5", "add 4 subtract 3 alter #5": "sus7 add #5 add b9",
    "alter b5 add 4 subtract 3": "sus4 add b9", "alter #5 add 4 subtract 3": "sus4", "add 4 subtract 3 alter b5": "sus4 add b9",
    "add 4 subtract 3 alter b9": "sus4 add b9", "add 4 subtract 3 add #11": "sus4 add #11", "add #11 add b9 alter #11": "sus7 add b9",
    "add 4 subtract 3 add b13": "sus4 add b9", "alter #5 add #9 alter #5": "alter #5 add #9", "alter b5 add b9 alter b5": "alter b5 add b9",
    "add b13 add 4 subtract 3": "sus7 add b9", "add #11 add 4 subtract 3": "sus7", "add 4 subtract 3 add #9": "sus7 add b9", "add 4 subtract 3 add b9": "sus7 add b9",
    "add b9 add 4 subtract 3": "sus7 add b9", "add #11 add #11 add #11": "add #11", "add #11 add b9 add #11": "add b9 add #11",
    "add b9 add b9 alter #5": "alter #5 add b9", "add 4 subtract 3 add 9": "", "add 4 subtract 3 add 7": "sus7", "add #9 alter #5 add #9": "alter #5 add #9",
    "add b9 alter #5 add b9": "alter #5 add b9", "add b9 alter #5 add #9": "alter #5 add #9", "add b13 add b9 add b9": "add b9 add b13",
    "add 9 add #11 add b9": "add 9 add #11", "add b9 add b9 add b9": "add b9", "alter #11 alter #11": "alter #11", "add b9 add b9 add 9": "add b9",
    "add 9 add b9 add b9": "add b9", "add 9 add #7 add 9": "add #7 add 9", "add 9 add 9 add 9": "add 9", "alter b5 alter b5": "alter b5",
    "alter #5 alter #5": "alter #5", "alter b5 alter #5": "alter b5", "alter #5 alter b5": "alter #5", "alter b9 alter b9": "alter b9", "add 7 add 7 add 7": "add 7",
    "add 4 subtract 3": "", "add b13 add b13": "add b13", "add #11 add #11": "add #11", "add b9 add b9": "add b9", "add b9 add #9": "add b9", "add #7 add #7": "add #7",
    "add #9 add #9": "add #9", "add b6 add b6": "add b6", "add #9 add b9": "add b9", "add 9 add #9": "add #9", "*..........*": "", "add b9 add 9": "add b9",
    "add 9 add b9": "add b9", "add 9 add 9": "add 9", "add 2 add 2": "add 9", "add 7 add 2": "add 7 add 9", "add 7 add 7": "add 7", "dim(maj7)": "o_maj7",
    "7susadd3": "sus7", "m(add9)": "m7 add 9", "*-add9*": "m7 add9", "7b5#5*": "dom7 add #5", "13sus4": "sus7 add 13", "*sus4*": "sus4", "7sus4": "sus7",
    "*mb9*": "m7 add b9", "9sus4": "sus7 add 9", "*dim*": "o", "maj13": "maj7 add 13", "*mM7*": "m_maj7", "*ø11*": "ø7 add 11", "*7+*": "aug7", "*m7*": "m7",
    "*-3*": "m7", "6b5*": "G dom7", "7alt": "dom7 add b9", "maj9": "maj7 add 9", "-b5*": "m add b5", "6#9*": "maj add 6 add 9", "#5#9": "add #5 add b9", "*m*": "m7",
    "m69": "m add 6 add 9", "m11": "m add 11", "*O*": "o", "-7s": "m_maj7", "**": "maj", "G7": "G dom7", "69": "maj add 6 add 9", "E*": "E", "m9": "m7 add 9",
    "11": "dom7 add 77", "A*": "A", "G*": "G", "13": "dom7 add 13", "+7": "dom7", "C*": "C", "6": "maj add 6", "9": "dom7 add 9", "7": "dom7", "+": "aug", "5": "power",
}


def place(note: Column) -> Column:
    """Where a note stands on the line, from 0 to 34; null for other names."""
    at = F.array_position(F.array(*[F.lit(n) for n in LINE]), note)
    return F.when(at > 0, (at - 1).cast("int"))


def fifths_between(a: Column, b: Column) -> Column:
    return place(b) - place(a)


def note_at(position: Column) -> Column:
    """The note at a place of the line, which closes to a circle of 35."""
    return F.when(position.isNotNull(), F.element_at(F.array(*[F.lit(n) for n in LINE]), (F.pmod(position, F.lit(len(LINE))) + 1).cast("int")))


def transposed(note: Column, old_key: Column, new_key: Column) -> Column:
    """A note as far from the new key as it was from the old one.

    Going from note to note by distances on the line adds up to one shift, so no window is needed.
    """
    return note_at(place(note) + place(new_key) - place(old_key))


def semitone(note: Column) -> Column:
    """0 to 11; a fifth is seven semitones and C is 0."""
    return F.pmod((place(note) - LINE.index("C")) * 7, F.lit(12)).cast("int")


def semitones_between(a: Column, b: Column) -> Column:
    return F.pmod(semitone(b) - semitone(a), F.lit(12)).cast("int")


def split_chord(symbol: Column) -> Column:
    """Root, nature and extension of a chord symbol without its bass.

    The root is one character, and as many more as accidentals are found together anywhere in the first word, at most
    three: so the flat of ``Cm7b5`` makes its root ``Cm``. What follows the first space is the extension.
    """
    head = F.substring_index(symbol, " ", 1)
    rest = F.substr(head, F.lit(2))
    more = F.lit(0)
    for n in (1, 2, 3):
        more = F.when(rest.contains("#" * n) | rest.contains("b" * n), F.lit(n)).otherwise(more)
    root = F.substr(head, F.lit(1), more + 1)
    extension = F.rtrim(F.substr(symbol, F.length(head) + 2))
    return F.struct(root.alias("root"), F.substr(head, more + 2).alias("nature"), extension.alias("extension"))


def split_slash(symbol: Column) -> Column:
    """The chord and its bass, which is null without a slash."""
    parts = F.split(symbol, "/")
    return F.struct(parts[0].alias("chord"), F.get(parts, F.lit(1)).alias("bass"))


def chord_parts(symbol: Column) -> Column:
    """Root, nature and extension of a chord as an array without empty ones; a bass is split in the same way after a slash."""
    split = lambda s: F.filter(F.array(split_chord(s)["root"], split_chord(s)["nature"], split_chord(s)["extension"]), lambda x: x != "")
    both = split_slash(symbol)
    return F.when(both["bass"].isNotNull(), F.concat(split(both["chord"]), F.array(F.lit("/")), split(both["bass"]))).otherwise(split(symbol))


def chord_tokens(symbols: Column, ignore: list[str] = NO_CHORDS) -> Column:
    """A dot and its parts for each chord; ignored tokens pass as they are."""
    return F.flatten(F.transform(symbols, lambda s: F.when(s.isin(ignore), F.array(s)).otherwise(F.concat(F.array(F.lit(".")), chord_parts(s)))))


def timed_chord_tokens(symbols: Column, durations: Column, ignore: list[str] = NO_CHORDS) -> Column:
    """(token, duration): a dot, the duration and the parts of each chord, all with its duration."""
    pairs = F.arrays_zip(symbols.alias("s"), durations.alias("d"))

    def one(p: Column) -> Column:
        tokens = F.when(p["s"].isin(ignore), F.array(p["s"])).otherwise(F.concat(F.array(F.lit("."), p["d"].cast("string")), chord_parts(p["s"])))
        return F.transform(tokens, lambda t: F.struct(t.alias("token"), p["d"].alias("duration")))

    return F.flatten(F.transform(pairs, one))


def split_compound(tokens: Column) -> Column:
    """``X add Y`` becomes ``X`` and ``add Y``, else ``X alter Y`` likewise; what follows a second separator is lost."""

    def one(t: Column) -> Column:
        cut = lambda word: F.array(F.split(t, f" {word} ")[0], F.concat(F.lit(f"{word} "), F.split(t, f" {word} ")[1]))
        return F.when(t.contains(" add "), cut("add")).when(t.contains(" alter "), cut("alter")).otherwise(F.array(t))

    return F.flatten(F.transform(tokens, one))


def split_extensions(tokens: Column) -> Column:
    """Tokens of several additions and alterations become one for each pair of words, after the nature if there is one."""

    def one(t: Column) -> Column:
        words = F.split(t, " ")
        n = F.size(words)
        first = n % 2
        pairs = F.transform(F.sequence(F.lit(1), F.floor(n / 2).cast("int")), lambda k: F.concat_ws(" ", F.slice(words, first + k * 2 - 1, 2)))
        split = F.when(first == 1, F.concat(F.slice(words, 1, 1), pairs)).otherwise(pairs)
        return F.when((t.contains("add") | t.contains("alter")) & (n > 2), split).otherwise(F.array(t))

    return F.flatten(F.transform(tokens, one))


def with_plain_quality(tokens: Column, names: list[str] = LINE) -> Column:
    """A bare root gets the quality ``maj``: one at the end, or before a structural or form token, but for a bass.

    What stands before the first token is the last one, which matters where that is a slash.
    """

    def one(t: Column, i: Column) -> Column:
        after, before = F.get(tokens, i + 1), F.when(i == 0, F.element_at(tokens, -1)).otherwise(F.get(tokens, i - 1))
        bare = t.isin(names) & (after.isNull() | after.isin(STRUCTURE) | after.startswith("Form_")) & (before != "/")
        return F.when(F.coalesce(bare, F.lit(False)), F.array(t, F.lit("maj"))).otherwise(F.array(t))

    return F.flatten(F.transform(tokens, one))


def without_empty(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t != "")


def sounding(notes: Column) -> Column:
    """The notes of a voicing's slots, without the empty ones."""
    return F.filter(notes, lambda n: n > 0)


def in_plain_meter(signature: Column) -> Column:
    return signature.isin("4/4", "2/4")


def as_method_a(tokens: Column) -> Column:
    """Notes of the other vocabulary under the usual prefix."""
    return F.transform(tokens, lambda t: F.regexp_replace(t, "^H_", "PV_"))


def literal_replaced(tokens: Column) -> Column:
    """Whole tokens by REPLACEMENTS, ``G dom7`` in two, and an extension that is named twice in a row once."""
    known = F.create_map(*[F.lit(x) for kv in REPLACEMENTS.items() for x in kv])
    changed = F.transform(tokens, lambda t: F.coalesce(known[t], t))
    parted = F.flatten(F.transform(changed, lambda t: F.when(t == "G dom7", F.array(F.lit("G"), F.lit("dom7"))).otherwise(F.array(t))))

    def once(t: Column) -> Column:
        w = F.split(t, " ")
        doubled = (F.size(w) >= 5) & (F.concat(F.get(w, F.lit(1)), F.get(w, F.lit(2))) == F.concat(F.get(w, F.lit(3)), F.get(w, F.lit(4))))
        return F.when(F.coalesce(doubled, F.lit(False)), F.concat_ws(" ", F.slice(w, 1, 3))).otherwise(t)

    return F.transform(parted, once)


def kind_symbol(root: Column, kind: Column, bass: Column, by_text: bool = False) -> Column:
    """Root, quality and bass of a chart's harmony in one symbol; kinds go by name, or ``by_text`` by what is printed."""
    names = KIND_TEXTS if by_text else KIND_NAMES
    plain = F.lower(F.coalesce(kind, F.lit("")))
    plain = plain if by_text else F.when(plain == "", "major").otherwise(plain)
    quality = F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[plain], plain)
    slash = F.when(F.coalesce(bass, F.lit("")) != "", F.concat(F.lit(" /"), bass)).otherwise("")
    return F.concat(F.trim(F.concat_ws(" ", root, quality)), slash)


def key_name(fifths: Column, mode: Column) -> Column:
    """The tonic with so many sharps (or flats, below 0), up to six; null for others."""
    return F.when(fifths.between(-6, 6) & mode.isin("major", "minor"), note_at(fifths + F.when(mode == "major", LINE.index("C")).otherwise(LINE.index("A"))))


def duration_class(ticks: Column) -> Column:
    """(name, length) of a duration in ticks of which 3072 are a whole note; null for others."""
    names = F.create_map(*[F.lit(x) for t, n, _ in DURATION_CLASSES for x in (t, n)])
    lengths = F.create_map(*[F.lit(x) for t, _, n in DURATION_CLASSES for x in (t, n)])
    return F.struct(names[ticks].alias("name"), lengths[ticks].alias("length"))


# --- scales and transposition


@cache
def key_signature(tonic: str, mode: str) -> int | None:
    """Sharps of a key, flats below 0; None beyond seven of either."""
    place_ = LINE.index(tonic) - LINE.index({"major": "C", "minor": "A", "dominant": "G"}[mode])
    return place_ if -7 <= place_ <= 7 else None


@cache
def spelled_scale(tonic: str, mode: str) -> tuple[str, list[str]]:
    """The tonic that spells a key with fewer signs, and the seven notes of its scale.

    Double accidentals are respelled first. A key that can't be spelled either way has plain notes.
    """
    if len(tonic) == 3:
        tonic = LINE[LINE.index(tonic) + (-12 if "#" in tonic else 12)]
    own, other = key_signature(tonic, mode), ENHARMONIC.get(tonic)
    theirs = key_signature(other, mode) if other else None
    if other and ((own is None) or (theirs is not None and abs(own) > abs(theirs))):
        tonic, own = other, theirs
    signs = own or 0
    altered = {n[0]: n for n in (LINE[LINE.index("F#") : LINE.index("F#") + signs] if signs > 0 else LINE[LINE.index("Bb") + signs + 1 : LINE.index("Bb") + 1])}
    at = "CDEFGAB".index(tonic[0])
    return tonic, [altered.get(n, n) for n in ("CDEFGAB" * 2)[at : at + 7]]


def respelled(note: Column, mode: str) -> Column:
    """A note as the tonic of a key of this mode with fewer signs."""
    return F.create_map(*[F.lit(x) for n in LINE for x in (n, spelled_scale(n, mode)[0])])[note]


def scale_table(spark: SparkSession) -> DataFrame:
    """(tonic, mode, spelled, nth, note): scales of all 35 tonics in three modes."""
    rows = [(t, m, *spelled_scale(t, m)) for t in LINE for m in ("major", "minor", "dominant")]
    wide = spark.createDataFrame(rows, "tonic string, mode string, spelled string, notes array<string>")
    return wide.select("tonic", "mode", "spelled", F.posexplode("notes").alias("nth", "note"))


def scale_degree(scale: Column, note: Column) -> Column:
    """Where a note stands in a scale's array: itself, else its flat or its sharp, else its letter; -1 if none does."""
    at = lambda n: F.nullif((F.array_position(scale, n) - 1).cast("int"), F.lit(-1))
    letter = F.when(F.length(note) > 1, at(F.substring(note, 1, 1)))
    return F.coalesce(at(note), at(F.concat(note, F.lit("b"))), at(F.concat(note, F.lit("#"))), letter, F.lit(-1))


def notes_at_semitone(position: Column) -> Column:
    """The spellings of a pitch class, as an array."""
    return F.filter(F.array(*[F.lit(n) for n in SPELLINGS]), lambda n: semitone(n) == position)


def chromatic_distance(start: Column, note: Column) -> Column:
    """Semitones from one spelled note up to another; null unless both are among the spellings of twelve pitch classes."""
    return F.when(start.isin(SPELLINGS) & note.isin(SPELLINGS), semitones_between(start, note))


def transposed_songs(df: DataFrame, key: list[str], pos: str = "pos", token: str = "tok", by_first_letter: bool = True) -> DataFrame:
    """``df`` of (key, pos, tok, old_key, new_key) with its notes transposed.

    A note keeps its distance from the key on the line of fifths and is respelled by the mode of its quality, the next
    token. ``by_first_letter`` tells minor by a quality that begins with m, as charts were made; else by its name. A note
    that is followed by a step of -1 which has become -13 is respelled from the note after it.
    """
    note = F.col(token).isin(NOTES)
    whole, notes = Window.partitionBy(*key).orderBy(pos), Window.partitionBy(*key, "_note").orderBy(pos)
    after = F.coalesce(F.lead(token).over(whole), F.col(token))
    quality = F.when(after.isin(NO_CHORDS), "maj").otherwise(after)
    rows = df.withColumn("_quality", quality).withColumn("_note", note)
    moved = transposed(F.col(token), F.col("old_key"), F.col("new_key"))
    if by_first_letter:
        spelled = F.when(F.col("_quality").startswith("m"), respelled(moved, "minor")).otherwise(moved)
    else:
        modes = {"major": ("maj", "maj7", "maj6"), "minor": ("m", "m7", "m6"), "dominant": ("dom7",)}
        spelled = moved
        for mode, names in modes.items():
            spelled = F.when(F.col("_quality").isin(*names), respelled(moved, mode)).otherwise(spelled)
    rows = rows.withColumn("_moved", F.when(F.col("_note"), spelled))
    following, step = F.lead("_moved").over(notes), F.lead(place(F.col(token))).over(notes) - place(F.col(token))
    wide = F.col("_note") & (step == -1) & (fifths_between(F.col("_moved"), following) == -13)
    repaired = F.when(F.coalesce(wide, F.lit(False)), respelled(note_at(place(following) + 1), "major")).otherwise(F.col("_moved"))
    return rows.withColumn("_moved", repaired).withColumn(token, F.coalesce("_moved", token)).drop("_moved", "_quality", "_note")


STEM = r"^(\d+)_(.+)_([A-G][#b]?)_(major|minor)_(type_\d+_\w+)$"


def stem_parts(stem: Column) -> Column:
    """Index, song, key, mode and type of a file stem; all null if it isn't one."""
    part = lambda k: F.nullif(F.regexp_extract(stem, STEM, k), F.lit(""))
    return F.struct(part(1).cast("int").alias("idx"), part(2).alias("song"), part(3).alias("key"), part(4).alias("mode"), part(5).alias("type"))


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(name), r"[^\w\- ]", ""), r"\s+", "_")


def one_bar_line(token: Column) -> Column:
    """Double bars and repeat signs as plain bar lines."""
    return F.when(token.isin("e||", "b||", "||", "|:", ":|"), F.lit("|")).otherwise(token)

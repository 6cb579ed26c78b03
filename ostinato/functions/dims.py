"""Small dimensions: tuning, naming, forms and styles, as values and as tables of a few dozen rows to broadcast."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession

# The octave has 53 steps; zones, canonical steps and grids that results depend on.
STEPS = 53
THIRD_ZONE, FIFTH_ZONE, SEVENTH_ZONE = (10, 22), (24, 35), (42, 52)
THIRDS = [11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 22]
FIFTHS = [26, 31, 35]
SEVENTHS = [42, 43, 44, 45, 46, 47, 48, 49, 50, 51]
DEFAULT_FIFTH = 31
DURATIONS = [0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0, 16.0]
VELOCITY_BINS = 8
LOWEST_STEP, HIGHEST_STEP, MOST_NOTES = 106, 424, 8
ROUGHNESS = {"dstar": 0.24, "s1": 0.0207, "s2": 18.96, "c1": 5.0, "c2": -5.0, "a1": -3.51, "a2": -5.75}

# The seven step distances of each scale type.
SCALES = {
    "type_0_major": [0, 9, 9, 4, 9, 9, 9],
    "type_0_minor": [0, 9, 4, 9, 9, 4, 9],
    "type_1_neutral": [0, 8, 7, 7, 9, 8, 7],
    "type_1_minor": [0, 7, 7, 8, 7, 7, 9],
    "type_2_subminor": [0, 9, 3, 10, 9, 3, 10],
    "type_2_minor": [0, 10, 9, 9, 3, 10, 9],
    "type_3_major": [0, 9, 8, 5, 9, 8, 5],
    "type_3_minor": [0, 5, 9, 9, 8, 5, 9],
    "type_4_upmajor": [0, 10, 9, 3, 9, 10, 9],
    "type_4_minor": [0, 9, 3, 10, 9, 3, 9],
    "type_5_major_v2": [0, 9, 9, 5, 8, 8, 9],
    "type_5_minor": [0, 9, 5, 9, 9, 5, 8],
    "type_6_neutral_n": [0, 8, 7, 7, 9, 5, 10],
    "type_6_minor": [0, 10, 7, 8, 7, 7, 9],
}

# Names of the 53 pitch classes.
NOTE_NAMES = [
    "C", "^C", "^^C", "vvC#", "vC#", "C#", "^C#", "^^C#", "vD", "D",
    "^D", "^^D", "vvD#", "vD#", "D#", "^^Eb", "vvE", "vE", "E", "^E",
    "^^E", "vF", "F", "^F", "^^F", "vvF#", "vF#", "F#", "^F#", "^^F#",
    "vG", "G", "^G", "^^G", "vvG#", "vG#", "G#", "^G#", "vvA", "vA",
    "A", "^A", "^^A", "vBb", "Bb", "^Bb", "^^Bb", "vvB", "vB", "B",
    "^B", "^^B", "vC",
]

# What a step above the root is called.
SEMANTIC_STEPS = {
    9: "major-second", 10: "augmented-second", 11: "subminor", 12: "downminor", 13: "minor", 14: "neutral-minor", 15: "neutral",
    16: "neutral-major", 17: "downmajor", 18: "major", 19: "upmajor", 20: "supermajor", 21: "ultramajor", 22: "fourth",
    26: "diminished-fifth", 28: "subdiminished", 29: "downdiminished", 30: "diminished", 31: "perfect", 32: "augmented",
    33: "upaugmented", 35: "augmented-fifth", 39: "major-sixth", 40: "diminished-seventh", 42: "subminor", 43: "downminor",
    44: "minor", 45: "neutral-minor", 46: "neutral", 47: "neutral-major", 48: "downmajor", 49: "major", 50: "upmajor", 51: "supermajor",
}

# Names of seventh chords on a perfect fifth, a row for each third, a column for each seventh of NAMED_SEVENTHS.
NAMED_SEVENTHS = ["supermajor", "upmajor", "major", "downmajor", "neutral-major", "neutral", "neutral-minor", "minor", "downminor", "subminor"]
SEVENTH_CHORDS = {
    "supermajor": ["S^S^7", "S^^7", "S^M7", "S^^7", "S^NM7", "S^N7", "S^Nm7", "S^m7", "S^vm7", "S^sm7"],
    "upmajor": ["^S^7", "^^7", "^M7", "^v7", "^NM7", "^N7", "^Nm7", "^m7", "^vm7", "^sm7"],
    "major": ["S^7", "^M7", "maj7", "vM7", "NM7", "N7", "Nm7", "7", "vm7", "sm7"],
    "downmajor": ["vMS^7", "vM^M7", "vMM7", "vMvM7", "vMNM7", "vMN7", "vMNm7", "vMm7", "vMvm7", "vMsm7"],
    "neutral-major": ["NMS^7", "NM^7", "NMM7", "NMvM7", "NMNM7", "NMN7", "NMNm7", "NMm7", "NMvm7", "NMsm7"],
    "neutral": ["NS^7", "N^7", "NM7", "NvM7", "NNM7", "NN7", "NNm7", "Nm7", "Nvm7", "Nsm7"],
    "neutral-minor": ["NmS^7", "Nm^7", "NmM7", "NmvM7", "NmNM7", "NmN7", "NmNm7", "Nmm7", "Nmvm7", "Nmsm7"],
    "minor": ["mS^7", "m^7", "mM7", "mvM7", "mNM7", "mN7", "mNm7", "m7", "mvm7", "msm7"],
    "downminor": ["vmS^7", "vm^7", "vmM7", "vmvM7", "vmNM7", "vmN7", "vmNm7", "vmm7", "vmvm7", "vmsm7"],
}
# Further names, by third, fifth, seventh.
OTHER_CHORDS = [
    ("subminor", "perfect", "supermajor", "smS^7"), ("subminor", "perfect", "subminor", "smsm7"), ("subminor", "perfect", "minor", "smm7"),
    ("subminor", "perfect", "neutral", "smN7"), ("subminor", "perfect", "major", "smM7"),
    ("minor", "diminished", "subminor", "smø7"), ("minor", "diminished", "minor", "ø7"), ("minor", "diminished", "neutral", "øN7"),
    ("minor", "diminished", "major", "øM7"), ("minor", "diminished", "supermajor", "øS^7"),
    ("major", "augmented", "subminor", "M+sm7"), ("major", "augmented", "minor", "M+m7"), ("major", "augmented", "neutral", "M+N7"),
    ("major", "augmented", "major", "M+7"), ("major", "augmented", "supermajor", "M+S^7"),
    ("major", "perfect", None, ""), ("minor", "perfect", None, "m"), ("diminished", "diminished", None, "dim"),
]
# Parts of names that are in no table.
THIRD_PREFIXES = {
    "supermajor": "S^", "ultramajor": "S^^", "upmajor": "^", "major": "", "downmajor": "vM", "neutral-major": "NM", "neutral": "N",
    "neutral-minor": "Nm", "minor": "m", "downminor": "vm", "subminor": "sm",
}
FIFTH_SUFFIXES = {
    "perfect": "", "diminished": "dim", "augmented": "+", "diminished-fifth": "(b5)", "augmented-fifth": "(#5)",
    "major-second": "(sus2)", "fourth": "(sus4)", "downdiminished": "vdim", "subdiminished": "sdim", "upaugmented": "^+",
}
SEVENTH_SUFFIXES = {
    "supermajor": "S^7", "upmajor": "^7", "major": "M7", "downmajor": "vM7", "neutral-major": "NM7", "neutral": "N7",
    "neutral-minor": "Nm7", "minor": "7", "downminor": "vm7", "subminor": "sm7", "diminished-seventh": "dim7", "major-sixth": "6",
}

# Signs of thirds, fifths and sevenths.
THIRD_SIGNS = {11: "sm", 12: "vm", 13: "m", 14: "^m", 15: "n", 16: "N", 17: "vM", 18: "M", 19: "^M", 20: "SM", 22: "sus4"}
FIFTH_SIGNS = {26: "ø", 31: "P", 35: "+"}
SEVENTH_SIGNS = {42: "sm7", 43: "vm7", 44: "m7", 45: "^m7", 46: "n7", 47: "N7", 48: "vM7", 49: "M7", 50: "^M7", 51: "SM7"}

# Whole style names, then words; of words that occur, the last in this list decides.
STYLE_NAMES = {
    "Moderately": "Pop", "Even 8th's": "Even 8ths", "Even 8's": "Even 8ths", "Even 8ths": "Even 8ths", "R'n'B": "RnB", "RnB": "RnB",
    "Beatles": "Rock", "Afoxe": "Afoxé", "Afoxé": "Afoxé", "Worship": "Gospel", "Traditional Gospel": "Gospel", "Hymn": "Gospel", "Deliberately": "Pop",
}
#: In the list of words it stands for a whole name in one of these spellings, without spaces and in lower case.
RNB, RNB_SPELLINGS = "R&B in any spelling", ["rnb", "rhythmnblues", "rhythmblues"]
STYLE_WORDS = [
    ("Swing", "Jazz"), ("Blues", "Blues"), ("Folk", "Folk"), ("Fusion", "Jazz"), ("Jazz", "Jazz"), ("Bossa", "Bossa"), ("Reggae", "Reggae"),
    ("Samba", "Samba"), ("Funk", "Funk"), ("Pop", "Pop"), ("Son", "Son"), ("Rock", "Rock"), ("Soul", "Soul"), (RNB, "RnB"),
    ("Balad", "Balad"), ("Ballad", "Balad"), ("Latin", "Son"), ("Salsa", "Son"), ("Bachata", "Son"), ("Bolero", "Son"), ("Mambo", "Son"),
    ("Merengue", "Son"), ("Montuno", "Son"), ("Calypso", "Son"), ("Tango", "Son"), ("Cha Cha", "Son"), ("Chacarera", "Son"),
    ("Baião", "Samba"), ("Afro", "Samba"), ("Choro", "Samba"), ("Marchinha", "Samba"), ("Frevo", "Samba"), ("Maxixe", "Samba"), ("Forró", "Samba"),
    ("Shuffle", "Blues"), ("Waltz", "Jazz"), ("Disco", "Pop"),
]
# Words and whole names of the older style rules; early names give way to words.
FORMAT_STYLE_WORDS = [
    ("Swing", "Jazz"), ("Blues", "Blues"), ("Folk", "Folk"), ("Fusion", "Jazz"), ("Jazz", "Jazz"), ("Bossa", "Bossa"), ("Reggae", "Reggae"), ("Folk", "Folk"),
    ("Samba", "Samba"), ("Funk", "Funk"), ("Pop", "Pop"), ("Son", "Son"), ("Rock", "Rock"), ("Soul", "Soul"), ("Balad", "Balad"),
]
FORMAT_STYLE_NAMES = [
    (["R'n'B"], "RnB"), (["Beatles"], "Rock"), (["Afoxe"], "Afoxé"), (["Worship"], "Gospel"), (["Traditional Gospel"], "Gospel"), (["Deliberately"], "Pop"),
]
FORMAT_EARLY_NAMES = [(["Moderately"], "Pop"), (["Even 8th's", "Even 8's"], "Even 8ths")]
# Labels of form markers, their aliases, and the raw markers of text sidecars.
FORMS = ["INTRO", "A", "B", "C", "D", "VERSE", "HEAD", "CODA", "SEGNO"]
FORM_ALIASES = {"IN": "INTRO", "INTR": "INTRO", "OUTRO": "CODA"}
RAW_FORMS = {
    "Form_A": "FORM_A", "Form_B": "FORM_B", "Form_C": "FORM_C", "Form_D": "FORM_D", "Form_Head": "FORM_HEAD", "Form_Coda": "FORM_CODA",
    "Form_Segno": "FORM_SEGNO", "Form_intro": "FORM_INTRO", "Form_verse": "FORM_VERSE", "Intro": "FORM_INTRO",
}
# Spellings of tonics.
TONICS = ["C", "C#", "Db", "D", "D#", "Eb", "E", "F", "F#", "Gb", "G", "G#", "Ab", "A", "A#", "Bb", "B"]


def half_even(x: float) -> int:
    return round(x)


@cache
def chromatic_scale(kind: str, tonic: int = 0) -> tuple[int, ...]:
    """The steps of the twelve pitch classes in a scale type, for a tonic from 0 to 11.

    The seven notes of the scale stand at the semitone nearest to them; the others are spaced evenly between their
    neighbours, rounded half to even.
    """
    placed, step = {12: STEPS}, 0
    for distance in SCALES[kind]:
        step += distance
        placed.setdefault(half_even(step * 12 / STEPS), step)
        if half_even(step * 12 / STEPS) < 12:
            placed[half_even(step * 12 / STEPS)] = step
    placed[12] = STEPS
    spots, from_root = sorted(placed), []
    for pc in range(12):
        low = max(p for p in spots if p <= pc)
        high = min(p for p in spots if p > pc)
        from_root.append(placed[low] if low == pc else half_even(placed[low] + (placed[high] - placed[low]) * (pc - low) / (high - low)))
    root = half_even(tonic * STEPS / 12)
    return tuple((root + from_root[(pc - tonic) % 12]) % STEPS for pc in range(12))


@cache
def chord_names() -> dict[tuple[str, str, str | None], str]:
    """Names by third, fifth and seventh, without hyphens in the seventh."""
    table = {(third, "perfect", seventh.replace("-", "")): name for third, names in SEVENTH_CHORDS.items() for seventh, name in zip(NAMED_SEVENTHS, names, strict=True)}
    return table | {(t, f, s): n for t, f, s, n in OTHER_CHORDS}


def scale_table(spark: SparkSession) -> DataFrame:
    """type, tonic, pc, step: 14 types by 12 tonics by 12 pitch classes."""
    rows = [(kind, tonic, pc, step) for kind in SCALES for tonic in range(12) for pc, step in enumerate(chromatic_scale(kind, tonic))]
    return spark.createDataFrame(rows, "type string, tonic int, pc int, step int")


def note_table(spark: SparkSession) -> DataFrame:
    """name, pc; of a name that occurs twice the last place counts, as in a dictionary."""
    return spark.createDataFrame(list({n: i for i, n in enumerate(NOTE_NAMES)}.items()), "name string, pc int")


def semantic_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SEMANTIC_STEPS.items()), "step int, semantic string")


def chord_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*k, n) for k, n in chord_names().items()], "third string, fifth string, seventh string, name string")


def type_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, k) for i, k in enumerate(SCALES)], "ordinal int, type string")


def values_sql(rows: list[tuple], names: str) -> str:
    """A table literal in SQL; the plans' SQL shares the dimensions this way."""
    literal = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    return "(VALUES " + ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in rows) + f") AS dim({names})"

"""Charts: MusicXML files and text sidecars as event rows, and the small JSON dimensions beside them."""

from __future__ import annotations

import ast
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ostinato.functions import dims, music
from ostinato.functions.batches import bounded

# Accidentals by alteration, and tokens that stand for bars.
ALTERATIONS = {-2: "bb", -1: "b", 0: "", 1: "#", 2: "##"}
BARS = ["|", "|:", ":|"]
SKIPPED_BARS = ["||", "b||", "e||"]
CHART_ROWS = "path string, pos int, kind string, token string, duration double, error string"


def _map_files(files: DataFrame, parse, schema: str) -> DataFrame:
    """Rows of ``parse(content)`` for each (path, content); a file that can't be parsed has one row with ``error``."""
    to = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = [r | {"path": path} for r in parse(content)]
                except (ValueError, SyntaxError, AttributeError, RecursionError, MemoryError, ET.ParseError) as e:
                    rows = [{"path": path, "error": f"{type(e).__name__}: {e}"[:200]}]
                yield pa.RecordBatch.from_pylist([dict.fromkeys(to.names) | r for r in rows], schema=to)

    return bounded(files).mapInArrow(run, schema)


# --- MusicXML


def _altered(step: str, alter: str | None) -> str:
    return step + ALTERATIONS.get(int(alter or 0), "")


def chord_symbol(harmony: ET.Element) -> str:
    """Root, kind, degrees and bass of a harmony element as one symbol."""
    text = lambda path, default="": harmony.findtext(path) or default
    degrees = [f" {d.findtext('degree-type')} {ALTERATIONS.get(int(d.findtext('degree-alter') or 0), '')}{d.findtext('degree-value')}" for d in harmony.iter("degree")]
    bass = harmony.find("bass")
    slash = "/" + _altered(bass.findtext("bass-step"), bass.findtext("bass-alter")) if bass is not None else ""
    return _altered(text("root/root-step"), text("root/root-alter", None)) + text("kind") + "".join(degrees) + slash


def _opening_bar(measure: ET.Element) -> str:
    """The bar token of a measure: a repeat's beginning, or a coda sign that leaves or enters it."""
    children = list(measure)
    repeat = measure.find("barline/repeat")
    bar = "|:" if repeat is not None and repeat.get("direction") == "forward" else "|"
    for at, child in enumerate(children):
        if child.find("direction-type/coda") is not None:
            bar = "b||" if at < len(children) - 2 else "e||" if at == len(children) - 1 else bar
    return bar


def measure_rows(measure: ET.Element, divisions: int) -> Iterator[tuple[str, str, float]]:
    """(kind, token, duration): form signs, the bar, an ending, chords that last as long as the next note, a closing repeat."""
    first = measure.find("direction/direction-type")
    if first is not None:
        for sign, form in (("segno", "Form_Segno"), ("coda", "Form_Coda")):
            if first.find(sign) is not None:
                yield "form", form, 0.0
        if (rehearsal := first.findtext("rehearsal")) is not None:
            yield "form", f"Form_{rehearsal}", 0.0
    yield "bar", _opening_bar(measure), 0.0
    ending = measure.find("barline/ending")
    if ending is not None and ending.get("number") is not None:
        yield "repeat", f"Repeat_{ending.get('number')}", 0.0
    length = 0.0
    chords: list[tuple[str, float]] = []
    for child in reversed(list(measure)):
        if child.tag == "note":
            length = int(child.findtext("duration") or 0) / divisions
        elif child.tag == "harmony":
            chords.append((chord_symbol(child), length))
    for symbol, duration in reversed(chords):
        yield "chord", symbol, duration
    for line in measure.findall("barline"):
        repeat = line.find("repeat")
        if repeat is not None and repeat.get("direction") == "backward":
            yield "bar", ":|", 0.0


def parsed_xml(content: bytes) -> ET.Element:
    """The root of a document without namespaces. One that declares entities is refused: they could expand without bound."""
    if b"<!ENTITY" in content:
        raise ValueError("the document declares entities")
    root = ET.fromstring(content)  # noqa: S314
    for element in root.iter():
        element.tag = element.tag.rpartition("}")[2]
    return root


def chart_rows(content: bytes) -> Iterator[dict]:
    root = parsed_xml(content)
    divisions = int(root.findtext(".//attributes/divisions") or 1)
    rows = (row for measure in root.findall(".//measure") for row in measure_rows(measure, divisions))
    for pos, (kind, token, duration) in enumerate(rows):
        yield {"pos": pos, "kind": kind, "token": token, "duration": duration}


def _binary(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "content")


def read_charts(spark: SparkSession, folder: str, pattern: str = "*.{xml,musicxml}") -> DataFrame:
    """(path, pos, kind, token, duration, error): the tokens of every chart in order; namespaces don't matter."""
    return _map_files(_binary(spark, folder, pattern), chart_rows, CHART_ROWS)


HARMONY_ROWS = "path string, nth int, root string, kind string, kind_text string, bass string, error string"


def harmony_rows(content: bytes) -> Iterator[dict]:
    """Root, kind by name, kind as printed, and bass of every harmony, in order."""
    spelled = lambda e, part: _altered(e.findtext(f"{part}/{part}-step"), e.findtext(f"{part}/{part}-alter")) if e.find(f"{part}/{part}-step") is not None else None
    for nth, h in enumerate(parsed_xml(content).iter("harmony")):
        kind = h.find("kind")
        yield {"nth": nth, "root": spelled(h, "root"), "kind": (kind.text or "").strip() if kind is not None else "", "kind_text": kind.get("text", "") if kind is not None else "", "bass": spelled(h, "bass")}


def read_harmonies(spark: SparkSession, folder: str, pattern: str = "*.{xml,musicxml}") -> DataFrame:
    """(path, nth, root, kind, kind_text, bass, error): the harmonies of every chart alone."""
    return _map_files(_binary(spark, folder, pattern), harmony_rows, HARMONY_ROWS)


META_ROWS = "path string, song_name string, composer string, style string, midi_key int, total double, bars int, software string, encoding_date string, error string"


def _meta(content: bytes) -> Iterator[dict]:
    root = parsed_xml(content)
    divisions = int(root.findtext(".//attributes/divisions") or 1)
    creator = {c.get("type"): c.text for c in root.iter("creator")}
    total = sum(int(n.findtext("duration") or 0) / divisions for n in root.iter("note"))
    yield {"song_name": root.findtext(".//work-title") or root.findtext(".//movement-title"), "composer": creator.get("composer"), "style": creator.get("lyricist"), "midi_key": int(root.findtext(".//key/fifths") or 0), "total": float(total), "bars": len(root.findall(".//measure")), "software": root.findtext(".//software"), "encoding_date": root.findtext(".//encoding-date")}


def read_metadata(spark: SparkSession, folder: str, pattern: str = "*.{xml,musicxml}") -> DataFrame:
    """A song's metadata; its time signature is the rounded mean length of a bar, in quarters, or in eighths if that is six."""
    rows = _map_files(_binary(spark, folder, pattern), _meta, META_ROWS)
    beats = F.when(F.col("bars") > 0, F.rint(F.col("total") / F.col("bars")).cast("int"))
    return rows.withColumn("time_signature", F.when(beats == 6, "6/8").when(beats.isNotNull(), F.concat(beats.cast("string"), F.lit("/4"))))


# --- sidecars

STEM = r"([^/]+)\.txt$"


def sidecar_tokens(content: str) -> Iterator[dict]:
    value = ast.literal_eval(content)
    if not isinstance(value, list):
        raise ValueError("not a list")
    for pos, token in enumerate(value):
        yield {"pos": pos, "token": str(token)}


def read_sidecars(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(path, pos, token, error) of text files that each hold one list literal."""
    files = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(folder, wholetext=True)
    return _map_files(files.select(F.col("_metadata.file_path").alias("path"), "value"), sidecar_tokens, "path string, pos int, token string, error string")


def token_lists(tokens: DataFrame) -> DataFrame:
    """(path, tokens) of read_sidecars, in order; null where a file couldn't be read."""
    grouped = tokens.groupBy("path").agg(F.max("error").alias("_e"), F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("_t"))
    return grouped.select("path", F.when(F.col("_e").isNull(), F.transform("_t", lambda r: r["token"])).alias("tokens"))


def is_stop(token: Column) -> Column:
    """Whether a token ends the extensions of a chord."""
    return token.isin(".", "/", *BARS, *SKIPPED_BARS, *dims.RAW_FORMS) | token.rlike(r"^Repeat_\d+$")


def sidecar_events(tokens: DataFrame) -> DataFrame:
    """(path, event, kind, token, duration, root, quality, extensions, slash_bass) of (path, pos, token).

    A chord begins at a dot that isn't within another chord's first four tokens; its duration, root and quality follow
    whatever they are, then extensions up to a token that ends them, then a bass after a slash. Bars and known form marks
    are events of their own; repeats, double bars and unknown tokens are left out. A dot without a root ends the file.
    The tokens of one file are one array and folded from left to right: what a dot is depends on what came before.
    """
    rows = tokens.where("pos is not null").groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda r: r["token"]).alias("t"))
    begins = F.when(F.get("t", F.lit(0)) == "<style>", 2).otherwise(0)
    # The state: how many tokens of the open chord's head are still to come, and the places where chords begin.
    fold = F.aggregate(
        F.sequence(begins, F.size("t") - 1),
        F.struct(F.lit(0).alias("head"), F.array().cast("array<int>").alias("starts")),
        lambda s, i: F.when(s["head"] > 0, F.struct((s["head"] - 1).alias("head"), s["starts"].alias("starts")))
        .when(F.get("t", i) == ".", F.struct(F.lit(3).alias("head"), F.concat(s["starts"], F.array(i)).alias("starts")))
        .otherwise(F.struct(F.lit(0).alias("head"), s["starts"].alias("starts"))),
    )
    marked = rows.where(F.size("t") > begins).withColumn("starts", fold["starts"])
    cut = F.array_min(F.filter("starts", lambda i: i + 2 >= F.size("t")))
    flat = marked.select("path", "starts", F.coalesce(cut, F.lit(1 << 30)).alias("cut"), begins.alias("begins"), "t", F.posexplode("t").alias("pos", "token")).where("pos >= begins and pos < cut")
    # The chord that a token belongs to begins at the last start at or before it.
    start = F.array_max(F.filter("starts", lambda i: i <= F.col("pos")))
    placed = flat.withColumn("start", start).withColumn("at", F.col("pos") - start)
    rest = F.slice("t", F.col("start") + 5, F.size("t"))
    stop = F.array_position(F.transform(rest, is_stop), True).cast("int")
    n_ext = F.when(stop > 0, stop - 1).otherwise(F.size(rest))
    slashed = F.get(rest, n_ext) == "/"
    placed = placed.withColumn("n_ext", n_ext).withColumn("slashed", F.coalesce(slashed, F.lit(False))).withColumn("rest", rest)
    used = F.lit(4) + F.col("n_ext") + F.when(F.col("slashed"), 2).otherwise(0)
    chord = F.col("at") == 0
    form = F.create_map(*[F.lit(x) for kv in dims.RAW_FORMS.items() for x in kv])[F.col("token")]
    mark = F.when(F.col("token").isin(BARS), F.col("token")).otherwise(form)
    kept = placed.where(chord | ((F.col("start").isNull() | (F.col("at") >= used)) & mark.isNotNull()))
    number = F.get("t", F.col("start") + 1)
    grid = music.quantised_duration(F.coalesce(number.try_cast("double"), F.lit(1.0)))
    value = lambda c: F.when(chord, c)
    return kept.select(
        "path", (F.row_number().over(_by_path()) - 1).alias("event"), F.when(chord, "chord").otherwise("structure").alias("kind"), F.when(~chord | F.col("start").isNull(), mark).alias("token"), value(grid).alias("duration"),
        value(F.get("t", F.col("start") + 2)).alias("root"), value(F.coalesce(F.get("t", F.col("start") + 3), F.lit(""))).alias("quality"), value(F.slice("rest", 1, F.col("n_ext"))).alias("extensions"), value(F.when(F.col("slashed"), F.get("rest", F.col("n_ext") + 1))).alias("slash_bass"),
    )


def _by_path():
    from pyspark.sql import Window

    return Window.partitionBy("path").orderBy("pos")


def sidecar_headers(tokens: DataFrame) -> DataFrame:
    """(path, style_raw, header): style, tonality and type tokens; tonality from the file's name, type from its folder."""
    style = F.max(F.when(F.col("pos") == 1, F.col("token")))
    marked = F.max(F.when(F.col("pos") == 0, F.col("token"))) == "<style>"
    rows = tokens.groupBy("path").agg(F.when(marked, style).alias("style_raw"))
    tonality = F.regexp_extract("path", r"_([A-G][#b]?_(?:major|minor))_type_", 1)
    kind = F.regexp_extract("path", r"/type_([^/]+)/[^/]+$", 1)
    label = music.style_label(F.col("style_raw"))
    some = lambda c, *parts: F.when(c, F.array(*parts)).otherwise(F.array().cast("array<string>"))
    header = F.concat(
        some(label.isNotNull(), F.lit("<style>"), F.concat(F.lit("STYLE_"), label)),
        some(tonality != "", F.lit("<tonality>"), F.concat(F.lit("TONALITY_"), tonality)), some(kind != "", F.concat(F.lit("TYPE_"), kind)),
    )
    return rows.select("path", "style_raw", header.alias("header"))


# --- JSON dimensions


def read_alphabet(spark: SparkSession, path: str) -> DataFrame:
    """(group, value) of an alphabet file: names of roots, qualities, extensions and basses, without the empty one."""
    schema = ", ".join(f"{g} map<string, bigint>" for g in ("roots", "qualities", "extensions", "slash_bases"))
    wide = spark.read.schema(schema).json(path, multiLine=True)
    parts = F.array(*[F.struct(F.lit(g).alias("group"), F.map_keys(g).alias("values")) for g in wide.columns])
    return wide.select(F.explode(parts).alias("p")).select("p.group", F.explode("p.values").alias("value")).where("value <> ''").orderBy("group", "value")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(tok, id) of a vocabulary file."""
    wide = spark.read.schema("token_to_id map<string, int>").json(path, multiLine=True)
    return wide.select(F.explode("token_to_id").alias("tok", "id"))


SONG_SCHEMA = "file string, type_label string, style_label string, token_ids array<int>, chord_spans array<int>, eigenspace_4d array<array<double>>, n_chords int, n_tokens int"


def read_songs(spark: SparkSession, folder: str) -> DataFrame:
    """Songs of one JSON file each; unreadable ones have their text in ``_corrupt_record``."""
    return spark.read.schema(f"{SONG_SCHEMA}, _corrupt_record string").json(folder, mode="PERMISSIVE", multiLine=True)


META_SCHEMA = "song_name string, composer string, style string, tonality string, midi_key int, time_signature string, decade string, _corrupt_record string"


def read_song_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """(path, metadata) of one JSON file for each song; unreadable ones are left to the caller by ``_corrupt_record``."""
    rows = spark.read.schema(META_SCHEMA).option("recursiveFileLookup", "true").json(folder, mode="PERMISSIVE", multiLine=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), "*")


def style_map(metadata: DataFrame) -> DataFrame:
    """(name, style) of readable metadata by normalised song name; of several files the last by path counts."""
    from ostinato.operators.joins import normalised_name

    readable = metadata.where("_corrupt_record is null and song_name is not null")
    return readable.groupBy(normalised_name(F.col("song_name")).alias("name")).agg(F.max_by("style", "path").alias("style"))


def parallel_path(path: Column, source: str, target: str, extension: str) -> Column:
    """The file of the same stem in a parallel folder, with another extension."""
    return F.regexp_replace(F.replace(path, F.lit(f"/{source}/"), F.lit(f"/{target}/")), r"\.[^./]+$", extension)


def with_parallel_metadata(files: DataFrame, metadata: DataFrame, source: str, target: str, **defaults) -> DataFrame:
    """Files with the metadata of their parallel sidecar (path, columns named in ``defaults``); defaults where there is none."""
    own = metadata.select(F.col("path").alias("_meta_path"), *[F.col(c).alias(f"_m_{c}") for c in defaults])
    joined = files.join(own, parallel_path(F.col("path"), source, target, ".json") == F.col("_meta_path"), "left")
    return joined.withColumns({c: F.coalesce(f"_m_{c}", F.lit(v)) for c, v in defaults.items()}).drop("_meta_path", *[f"_m_{c}" for c in defaults])

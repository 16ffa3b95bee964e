"""Saved data sets, their metadata tables and sizes, and registries of what reads and writes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Short names of newsgroups.
NEWSGROUPS = {
    "world": "talk.politics.misc", "sports": "rec.sport.baseball", "business": "misc.forsale", "science": "sci.space", "technology": "comp.graphics", "medicine": "sci.med", "cars": "rec.autos", "hockey": "rec.sport.hockey",
    "electronics": "sci.electronics", "crypto": "sci.crypt", "religion": "soc.religion.christian", "guns": "talk.politics.guns", "atheism": "alt.atheism", "mac": "comp.sys.mac.hardware",
    "pc_hardware": "comp.sys.ibm.pc.hardware", "windows": "comp.os.ms-windows.misc", "x_windows": "comp.windows.x", "motorcycles": "rec.motorcycles", "mideast": "talk.politics.mideast", "religion_misc": "talk.religion.misc",
}
# Clips of a demo category, by media type and, for images, source.
DEMO_SIZES = {"audio": 40, "video": 10, "paragraph": 50, "caltech101": 80, "image": 100}


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key), key)


def newsgroup(alias: Column) -> Column:
    """The newsgroup of a short name; other names are newsgroups already."""
    return _looked_up(NEWSGROUPS, alias)


def newsgroup_alias(group: Column) -> Column:
    return _looked_up({v: k for k, v in NEWSGROUPS.items()}, group)


def demo_size(media_type: Column, source: Column, n_categories: Column) -> Column:
    """How many clips a demo data set has; unknown types count as audio."""
    each = F.when((media_type == "image") & F.coalesce(source == "caltech101", F.lit(False)), F.lit(DEMO_SIZES["caltech101"]))
    for kind in ("image", "video", "paragraph"):
        each = each.when(media_type == kind, F.lit(DEMO_SIZES[kind]))
    return n_categories * each.otherwise(F.lit(DEMO_SIZES["audio"]))


def read_sound_metadata(spark: SparkSession, path: str) -> DataFrame:
    """filename, category, esc10, target, fold of a metadata table in CSV; of rows with one filename the last in order stays."""
    rows = spark.read.option("header", True).csv(path)
    missing = {"filename", "category", "esc10", "target", "fold"} - set(rows.columns)
    if missing:
        raise ValueError(f"a metadata table needs the columns {sorted(missing)}")
    typed = rows.select("filename", "category", (F.col("esc10") == "True").alias("esc10"), F.col("target").cast("int").alias("target"), F.col("fold").cast("int").alias("fold"))
    last = typed.groupBy("filename").agg(F.max(F.struct("fold", "target", "category", "esc10")).alias("r"))
    return last.select("filename", "r.category", "r.esc10", "r.target", "r.fold")


def _optional(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def normalised(saved: DataFrame, files: DataFrame | None = None, origin: str | None = None) -> DataFrame:
    """Clips of a saved table, whatever it has: id, type, duration, file_size, md5, filename, category, origin, origin_name,
    embedding, content, word_count, character_count, width, height.

    The content is the row's own, its text, or that of the file of its name among ``files`` (filename, content); rows
    without any go.  The hash is always taken anew; what else is missing gets a default, ``origin`` for the origin.
    """
    column = lambda name, kind: _optional(saved, name, kind).alias(name)
    own = F.coalesce(_optional(saved, "content", "binary"), F.encode(_optional(saved, "text", "string"), "UTF-8"))
    kept = [column(n, t) for n, t in (("duration", "double"), ("file_size", "long"), ("category", "string"), ("origin", "string"), ("origin_name", "string"), ("word_count", "int"), ("character_count", "int"), ("width", "int"), ("height", "int"), ("embedding", "array<double>"))]
    kind = F.coalesce(_optional(saved, "type", "string"), F.lit("audio"))
    rows = saved.select("id", kind.alias("type"), _optional(saved, "filename", "string").alias("given"), own.alias("content"), *kept)
    if files is not None:
        # Only rows without content of their own meet the files.
        bare = rows.where("content IS NULL").drop("content").join(files.select(F.col("filename").alias("given"), "content"), "given", "left")
        rows = rows.where("content IS NOT NULL").unionByName(bare)
    rows = rows.where("octet_length(content) > 0")
    name = F.coalesce("given", F.concat(F.lit("clip_"), F.col("id"), F.lit("."), F.col("type")))
    return rows.select(
        "id", "type", F.coalesce("duration", F.lit(0.0)).alias("duration"), F.coalesce("file_size", F.octet_length("content").cast("long")).alias("file_size"), F.md5("content").alias("md5"), name.alias("filename"),
        F.coalesce("category", F.lit("unknown")).alias("category"), F.coalesce("origin", F.lit(origin)).alias("origin"), F.coalesce("origin_name", name).alias("origin_name"),
        "embedding", "content", "word_count", "character_count", "width", "height",
    )


def read_saved(spark: SparkSession, path: str, files: DataFrame | None = None, origin: str | None = None) -> DataFrame:
    """Normalised clips of a saved data set: Parquet, or JSON lines where the path says so."""
    reader = spark.read.json if path.rstrip("/").endswith((".json", ".jsonl")) else spark.read.parquet
    return normalised(reader(path), files, origin)


@dataclass
class Registry:
    """Named readers or writers, each with the fields that it needs; what is called is told by name."""

    kind: str
    entries: dict[str, tuple[Callable, tuple[str, ...]]] = field(default_factory=dict)

    def add(self, name: str, call: Callable, *fields: str) -> None:
        if name in self.entries:
            raise ValueError(f"there is a {self.kind} of that name already: {name}")
        self.entries[name] = call, fields

    def names(self) -> list[str]:
        return sorted(self.entries)

    def run(self, name: str, *args, **values):
        """Calls an entry; every field that it declares must be given and not be blank."""
        if name not in self.entries:
            raise ValueError(f"no {self.kind} of that name: {name}")
        call, fields = self.entries[name]
        blank = [f for f in fields if values.get(f) is None or (isinstance(values[f], str) and not values[f].strip())]
        if blank:
            raise ValueError(f"{name} needs {', '.join(blank)}")
        return call(*args, **values)


def registries() -> dict[str, Registry]:
    """What the engine has: data set importers, label importers, detector importers and exporters."""
    from lumenclip.sources import archives, readers, sinks

    out = {kind: Registry(kind) for kind in ("importer", "label importer", "detector importer", "exporter")}
    for name, call, fields in (("folder", readers.read_folder, ("path", "media_type")), ("archive", archives.read_archive, ("path",)), ("saved", read_saved, ("path",)), ("feed", readers.read_feed, ("path", "most"))):
        out["importer"].add(name, call, *fields)
    for name, call in (("json", readers.read_json_labels), ("csv", readers.read_csv_labels)):
        out["label importer"].add(name, call, "path")
    out["detector importer"].add("file", readers.read_detectors, "path")
    for name, call, fields in (("file", sinks.write_results_json, ("detectors", "media_type", "path")), ("csv", sinks.write_results_csv, ("path",)), ("dataset", sinks.write_dataset, ("path",)), ("labels", sinks.write_labels, ("path",))):
        out["exporter"].add(name, call, *fields)
    return out

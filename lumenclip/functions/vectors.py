"""Vector and text expressions, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, z: s + z)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def mlp_score(x: Column, w1: Column, b1: Column, w2: Column, b2: Column) -> Column:
    """One hidden layer with ReLU, then a sigmoid."""
    hidden = F.zip_with(w1, b1, lambda row, b: F.greatest(dot(row, x) + b, F.lit(0.0)))
    return 1 / (1 + F.exp(-(dot(hidden, w2) + b2)))


def stripped(text: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))


def origin_key(importer: Column, params: Column, name: Column) -> Column:
    """Equal for equal origins, whatever the order of their parameters (an array of structs k, v)."""
    return F.concat_ws("\u0000", importer, F.to_json(F.array_sort(params)), name)


def origin_display(importer: Column, params: Column) -> Column:
    """The importer, with the first parameter's value where there is one."""
    return F.when(F.size(params) > 0, F.concat(importer, F.lit("("), params[0]["v"], F.lit(")"))).otherwise(importer)


#: MIME types by extension, and those of each media type's other files.
MIME_TYPES = {".wav": "audio/wav", ".mp3": "audio/mpeg", ".ogg": "audio/ogg", ".flac": "audio/flac", ".m4a": "audio/mp4", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".webp": "image/webp", ".bmp": "image/bmp", ".mp4": "video/mp4", ".webm": "video/webm", ".mov": "video/quicktime", ".avi": "video/x-msvideo", ".txt": "text/plain", ".md": "text/markdown"}
MIME_DEFAULTS = {"image": "image/jpeg", "video": "video/mp4", "audio": "audio/wav", "paragraph": "text/plain"}


def _of(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def mime_type(filename: Column, media_type: Column | None = None, default: str = "application/octet-stream") -> Column:
    """By the extension, in any case; else, with a media type, that type's own default.  What an extension says of another
    media type than the given one doesn't count."""
    found = _of(MIME_TYPES, F.lower(F.regexp_extract(filename, r"(\.[^.]+)$", 1)))
    if media_type is not None:
        usual = _of(MIME_DEFAULTS, media_type)
        found = F.coalesce(F.when(F.substring_index(found, "/", 1) == F.substring_index(usual, "/", 1), found), usual)
    return F.coalesce(found, F.lit(default))

"""File names, paths and addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import BLANKS

# File endings each step of the catalog accepts.
IMPORT_TYPES = ["png", "jpg", "jpeg", "gif", "webp", "svg"]
INGEST_TYPES = ["png", "jpg", "jpeg", "gif", "webp"]
CONVERT_TYPES = ["png", "jpg", "jpeg", "gif", "bmp", "tiff", "webp"]
ENCODE_TYPES = ["jpg", "jpeg", "png", "gif", "bmp", "webp"]
LABEL_TYPES = ["png", "jpg", "jpeg", "gif", "webp", "pdf"]
# The name given to a file whose own name cleans to nothing, and
# the folder assets are served from.
FALLBACK_STEM = "emoji"
ASSET_ROOT = "/emojis/"


# What a stem loses when it is cleaned, in this order, and the copy numbers
# that are trimmed before.
CLEANING = [
    (f"^[0-9]+[-_{BLANKS}]+", ""),
    ("[-_]+$", ""),
    ("^[-_]+", ""),
    ("[-_]+", "-"),
    ("[^a-z0-9-]", ""),
    ("-+", "-"),
]
COPY_NUMBER = f"[-_{BLANKS}][1-3]$"

# The last dot and what follows it, unless the dot leads the name; two dots alone are a name, too.
# As one pattern it mentions the name once, so that names built from names stay short expressions.
ENDING = r"(?s)(?<=.)\.[^.]+\z|(?<=[^.]|..)\.\z"


def stem_of(name: Column) -> Column:
    """Everything before the last dot; a name whose only dot leads it has no ending."""
    return F.regexp_replace(name, ENDING, "")


def extension_of(name: Column) -> Column:
    """The ending with its dot, or an empty string."""
    return F.regexp_extract(name, ENDING, 0)


def has_extension(name: Column, types: list[str], case_sensitive: bool = False) -> Column:
    ending = extension_of(name)
    return (ending if case_sensitive else F.lower(ending)).isin(["." + t for t in types])


def normalize_filename(name: Column, fallback: str = FALLBACK_STEM) -> Column:
    """A web-safe name: lower case, leading numbering gone, only letters, digits and single dashes."""
    stem = F.lower(stem_of(name))
    for pattern, replacement in [*CLEANING, ("^$", fallback)]:
        stem = F.regexp_replace(stem, pattern, replacement)
    return F.concat(stem, F.lower(extension_of(name)))


def trim_numbered_name(name: Column, fallback: str = FALLBACK_STEM) -> Column:
    """Drop one trailing copy number from 1 to 3 with its separator."""
    stem = F.regexp_replace(F.regexp_replace(stem_of(name), COPY_NUMBER, ""), "^$", fallback)
    return F.concat(stem, extension_of(name))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def stable_id(name: Column, length: int = 8) -> Column:
    """Hex id from the name. Eight digits suit small catalogs; lengthen it for large ones."""
    return F.substring(F.md5(name), 1, length)


def asset_path(name: Column, root: str = ASSET_ROOT) -> Column:
    return F.concat(F.lit(root), name)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "(?<=.)/+$", ""), "/"), -1)


def created_day(created: Column) -> Column:
    return F.date_format(created, "yyyy-MM-dd")


def mime_type(name: Column) -> Column:
    ending = F.regexp_replace(F.lower(extension_of(name)), r"^\.", "")
    return F.concat(F.lit("image/"), F.when(ending == "jpg", F.lit("jpeg")).otherwise(ending))


def display_label(name: Column) -> Column:
    return F.regexp_replace(F.split(name, "[.]")[0], "/.*/", "")


def animated_by_extension(name: Column) -> Column:
    return name.endswith(".webp") | name.endswith(".gif")


def absolute_url(path: Column, origin: str | None) -> Column:
    """``path`` below ``origin`` unless it already names a host; no origin leaves it as it is."""
    if origin is None:
        return path
    rooted = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    complete = path.startswith("http://") | path.startswith("https://")
    return F.when(complete, path).otherwise(F.concat(F.lit(origin), rooted))


def result_url(url: Column, base: str, term: Column | None = None, parameter: str | None = None) -> Column:
    """A hit's address, with one highlight parameter per word of the term if one is named."""
    joined = F.regexp_replace(F.concat(F.lit(base + "/"), url), "/+", "/")
    full = F.when(url.rlike("^(https?:)?//"), url).otherwise(F.regexp_replace(joined, "^(https?:/)", "$1/"))
    if parameter is None or term is None:
        return full
    words = F.split(term, f"[{BLANKS}]+")
    query = F.array_join(F.transform(words, lambda w: F.concat(F.lit(parameter + "="), F.url_encode(w))), "&")
    address, fragment = F.regexp_extract(full, "^([^#]*)", 1), F.regexp_extract(full, "(#.*)$", 1)
    joint = F.when(address.contains("?"), F.lit("&")).otherwise(F.lit("?"))
    return F.concat(address, joint, query, fragment)

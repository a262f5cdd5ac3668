"""Path and name functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Media types by file extension.
MEDIA = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "gif": "image/gif", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "pdf": "application/pdf", "json": "application/json", "txt": "text/plain"}


def parts(c: Column) -> Column:
    """Non-empty parts of a path with either separator."""
    return F.filter(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")


def same_path(c: Column) -> Column:
    """One spelling of a path: forward separators, none doubled, no leading `./`, no outer blanks."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"[\\/]+", "/"), r"^(?:\./)+", "")


def path_key(c: Column) -> Column:
    """Comparison key: parts without blanks (underscores instead), lower case, joined with /."""
    return F.lower(F.array_join(F.transform(parts(F.trim(c)), lambda p: F.replace(p, F.lit(" "), F.lit("_"))), "/"))


def basename(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/\\]*)$", 1)


def parent_name(c: Column) -> Column:
    """Name of the folder a path lies in, or null."""
    p = parts(c)
    return F.when(F.size(p) > 1, F.get(p, F.size(p) - 2))


def stem(c: Column) -> Column:
    """The base name without its last extension."""
    return F.regexp_replace(basename(c), r"(?<=.)\.[^.]*$", "")


def extension(c: Column) -> Column:
    """The last extension in lower case, without the dot; empty if none."""
    return F.lower(F.regexp_extract(basename(c), r".\.([^.]*)$", 1))


def title(c: Column) -> Column:
    """The stem with blanks for underscores."""
    return F.replace(stem(c), F.lit("_"), F.lit(" "))


def media_type(c: Column) -> Column:
    pairs = [x for k, v in MEDIA.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), extension(c)), F.lit("application/octet-stream"))


def image_url(c: Column, bucket: str | None = None, prefix: str = "") -> Column:
    """A proxy address with the path as a form field if a bucket is set, else a static path, percent-encoded but for its slashes."""
    path = F.regexp_replace(c, f"^{prefix}", "") if prefix else c
    if bucket:
        return F.concat(F.lit(f"/image?bucket={bucket}&path="), F.url_encode(path))
    return F.concat(F.lit("/static/"), F.replace(F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")))


def season_of_folder(c: Column) -> Column:
    """`FWyyyy-yyyy` or `SSyyyy` from a folder such as `alta_moda_1986-87_fw` or `FW_1986_87`; null if there is none."""
    low = F.lower(c)
    out = F.lit(None).cast("string")
    for year, tail in ((r"(\d{4})[-_](\d{2})[-_]fw", None), (r"fw[-_](\d{4})[-_](\d{2})", None)):
        y = F.regexp_extract(low, year, 1)
        out = F.when(low.rlike(year), F.concat(F.lit("FW"), y, F.lit("-"), (F.try_to_number(y, F.lit("9999")).cast("int") + 1).cast("string"))).otherwise(out)
    for year in (r"(\d{4})[-_]ss(?![a-z])", r"(?<![a-z])ss[-_](\d{4})"):
        out = F.when(low.rlike(year), F.concat(F.lit("SS"), F.regexp_extract(low, year, 1))).otherwise(out)
    return out


def file_code(c: Column) -> Column:
    """Digits only, padded to three places but never cut; null without digits."""
    digits = F.regexp_replace(c, r"\D", "")
    return F.when(digits == "", None).when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits)


def within(c: Column, root: str) -> Column:
    """Whether a path stays inside a folder: below it and without parent steps."""
    return same_path(c).startswith(root.rstrip("/") + "/") & ~F.array_contains(parts(c), "..")


def chunk_id(doc: Column, position: Column) -> Column:
    """First 16 hexadecimal digits of the name's SHA-256, a dash and the position."""
    return F.concat_ws("-", F.substring(F.sha2(doc, 256), 1, 16), position.cast("string"))

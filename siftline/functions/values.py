"""Scalar expressions and option helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of files by extension.
CATEGORIES = {
    "photo": "jpg jpeg png gif webp heic bmp tiff tif svg",
    "video": "mp4 mov avi mkv webm m4v",
    "document": "pdf doc docx xls xlsx ppt pptx txt md csv rtf odt",
    "audio": "mp3 wav flac m4a aac ogg",
    "archive": "zip tar gz 7z rar bz2 xz",
}
LABELS = {"photo": "Photos", "video": "Videos", "document": "Documents", "audio": "Audio", "archive": "Archives", "other": "Other"}
# Media types that a preview can show.
MEDIA = {
    "image/jpeg": "jpg jpeg",
    "image/png": "png",
    "image/gif": "gif",
    "image/webp": "webp",
    "image/bmp": "bmp",
    "image/svg+xml": "svg",
    "audio/mpeg": "mp3",
    "audio/wav": "wav",
    "audio/flac": "flac",
    "audio/mp4": "m4a",
    "audio/aac": "aac",
    "audio/ogg": "ogg",
}
PREVIEW_LIMIT = 25 << 20
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "bmp")


def _by_word(words: dict[str, str], key: Column) -> Column:
    out = F.lit(None).cast("string")
    for value, keys in words.items():
        out = F.when(key.isin(*keys.split()), value).otherwise(out)
    return out


def category(path: Column) -> Column:
    """By what follows the last dot of the whole path, so a hidden .jpg is a photo."""
    ext = F.lower(F.when(F.contains(path, F.lit(".")), F.substring_index(path, ".", -1)))
    return F.coalesce(_by_word(CATEGORIES, ext), F.lit("other"))


def media_type(extension: Column) -> Column:
    return _by_word(MEDIA, F.lower(extension))


def preview(content: Column, extension: Column) -> Column:
    """A data URI of a file that can be shown; null for others and too large ones."""
    media = media_type(extension)
    return F.when(media.isNotNull() & (F.octet_length(content) <= PREVIEW_LIMIT), F.concat(F.lit("data:"), media, F.lit(";base64,"), F.regexp_replace(F.base64(content), "\\s", "")))


def sample_start(size: Column, sample: int) -> tuple[Column, Column, Column]:
    """Offsets of the head, middle and tail samples."""
    sample = max(sample, 1)
    return F.lit(0).cast("long"), F.greatest(F.floor(size / 2).cast("long") - sample // 2, F.lit(0)), F.greatest(size - sample, F.lit(0))


def samples(content: Column, size: Column, sample: int) -> Column:
    """The three samples of a content, joined."""
    return F.concat(*(F.substring(content, at.cast("int") + 1, F.lit(max(sample, 1))) for at in sample_start(size, sample)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def percent(done: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(100.0)).otherwise(done / total * 100.0)


def human_bytes(n: Column) -> Column:
    """In steps of 1024 to TB, one decimal beyond bytes."""
    out = F.format_string("%.1f TB", n / float(1 << 40))
    for power, unit in ((30, "GB"), (20, "MB"), (10, "KB")):
        out = F.when(n < 1 << (power + 10), F.format_string(f"%.1f {unit}", n / float(1 << power))).otherwise(out)
    return F.when(n < 1024, F.format_string("%d B", n)).otherwise(out)


def ago(then_ms: Column, now_ms: Column) -> Column:
    minutes = F.floor((now_ms - then_ms) / 60000)
    return (
        F.when(minutes < 1, F.lit("Just now"))
        .when(minutes < 60, F.format_string("%dm ago", minutes))
        .when(minutes < 1440, F.format_string("%dh ago", F.floor(minutes / 60)))
        .otherwise(F.format_string("%dd ago", F.floor(minutes / 1440)))
    )


def rounded(x: Column) -> Column:
    """Half up, towards plus infinity."""
    return F.floor(x + 0.5)


def from_little_endian(hex_: Column) -> Column:
    """The hexadecimal digits of a number from those of its little-endian bytes."""
    pairs = F.transform(F.sequence(F.lit(1), F.lit(31), F.lit(2)), lambda i: F.substring(hex_, i, F.lit(2)))
    return F.when(F.length(hex_) == 32, F.lower(F.array_join(F.reverse(pairs), "")))


def cache_batch(size: int) -> int:
    """Files of a size that are hashed between two writes of the cache: 256, or about 1 GiB of them."""
    return min(256, max(1, (1 << 30) // max(size, 1)))


def millis(ns: Column) -> Column:
    return F.floor(ns / 1_000_000).cast("long")


def parse_size(text: str | None) -> int | None:
    """Bytes of '10', '4 KB', '1.5m'; None for an empty text."""
    text = unquoted(text or "")
    if not text:
        return None
    if not (m := re.fullmatch(r"(\d+(?:\.\d+)?)\s*([kmgt]?)(?:i?b)?", text.lower())):
        raise ValueError(f"not a size: {text}")
    return int(float(m[1]) * 1024 ** " kmgt".index(m[2] or " "))


def unquoted(text: str) -> str:
    """Without white space and one pair of matching quotes around."""
    text = text.strip()
    return text[1:-1].strip() if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'" else text


def parse_list(text: str | None) -> list[str]:
    return [x for part in (text or "").split(",") if (x := unquoted(part))]


def confirmed(answer: str) -> bool:
    return answer.strip().lower() in ("y", "yes")

"""Predicates over a file table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import paths
from siftline.functions.values import IMAGE_EXTENSIONS, category
from siftline.model import ScanOptions


def size_between(size: Column, least: int | None, most: int | None) -> Column:
    out = F.lit(True)
    if least is not None:
        out = out & (size >= least)
    return out if most is None else out & (size <= most)


def extension_allowed(extension: Column, include: Sequence[str] | None, exclude: Sequence[str] | None) -> Column:
    """An empty list filters nothing; without an extension a file is in no list; exclusion wins."""
    ext = F.lower(extension)
    out = F.lit(True)
    if include:
        out = F.coalesce(ext.isin(*(x.lower() for x in include)), F.lit(False))
    if exclude:
        out = out & ~F.coalesce(ext.isin(*(x.lower() for x in exclude)), F.lit(False))
    return out


def same_device(dev: Column, root_dev: int | None) -> Column:
    """An unknown device is let through."""
    return F.lit(True) if root_dev is None else F.coalesce(dev == root_dev, F.lit(True))


def filtered(files: DataFrame, options: ScanOptions, root_dev: int | None = None) -> DataFrame:
    path = F.col("path")
    out = files.where(size_between(F.col("size"), options.min_size, options.max_size))
    if options.include_extensions or options.exclude_extensions:
        out = out.where(extension_allowed(paths.extension(path), options.include_extensions, options.exclude_extensions))
    if options.exclude_paths:
        out = out.where(~paths.under_any(path, options.exclude_paths))
    if root_dev is not None and not options.cross_filesystems:
        out = out.where(same_device(F.col("dev"), root_dev))
    return out


def image_options(options: ScanOptions) -> ScanOptions:
    """The same, for images alone."""
    from dataclasses import replace

    return replace(options, include_extensions=IMAGE_EXTENSIONS, exclude_extensions=None)


def in_category(groups: DataFrame, wanted: str) -> DataFrame:
    """Groups whose first path is of a category."""
    return groups.where(category(F.col("paths")[0]) == wanted)


def in_scope(groups: DataFrame, folder: str) -> DataFrame:
    """Groups whose first path is at or below a folder."""
    return groups.where(paths.under(F.col("paths")[0], folder))

"""Schemas, options, rules, actions and errors."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

FILES = "path string, size long, dev long, ino long, mtime_ns long"
ERRORS = "path string, stage string, message string"
HASH_CACHE = "path string, size long, mtime_ns long, hash string"
#: A row for each folder (kind dir, with its mtime), and for each of its files and subfolders (kinds file and sub).
WALK_INDEX = "rules string, dir string, kind string, name string, size long, dev long, ino long, mtime_ns long"
IMPORT_CACHE = "dev long, ino long, chunk_pos long, chunk_len long, modified_ms long, file_len long, data_len long, hash string"
SCANS = (
    "id long, root string, started_at long, files_scanned long, bytes_scanned long, duplicate_groups long, duplicate_files long, "
    "action_kind string, action_applied boolean, bytes_reclaimed long, files_acted_on long"
)
ACTIONS = "id long, scan_id long, path string, kind string, bytes long, succeeded boolean, error string"
JOURNAL = "op string, path string, kept string, `from` string, `to` string"


class ScanError(Exception):
    """A scan that can't begin or go on."""


class InvalidRoot(ScanError):
    """The root isn't a readable directory."""


class NotADirectory(ScanError):
    """A folder action's folder isn't one."""


class NoConfirmedDuplicate(ScanError):
    """A file of a folder to remove has no confirmed copy at the same place in the folder to keep."""


class PlanFileError(Exception):
    """A plan or journal that can't be read."""


class Rule(Enum):
    ALPHABETICAL = "alphabetical"
    NEWEST = "newest"
    OLDEST = "oldest"
    SHORTEST_PATH = "shortest-path"
    LONGEST_PATH = "longest-path"


class Action(Enum):
    REPORT = "report"
    DELETE = "delete"
    TRASH = "trash"
    HARDLINK = "hardlink"
    REFLINK = "reflink"
    MOVE = "move"
    COPY = "copy"

    @classmethod
    def parse(cls, word: str, archive_dir: str | None = None) -> Action:
        """The action of a word; move and copy need an archive folder."""
        found = cls(word.strip().lower())
        if found in (cls.MOVE, cls.COPY) and not archive_dir:
            raise ValueError(f"{word} needs an archive folder")
        return found


@dataclass(frozen=True)
class ScanOptions:
    follow_symlinks: bool = False
    cross_filesystems: bool = False
    verify: bool = False
    small_file_threshold: int = 131072
    partial_hash_sample_size: int = 16384
    read_parallelism: int | None = None
    rescan_all: bool = False
    min_size: int | None = None
    max_size: int | None = None
    include_extensions: tuple[str, ...] | None = None
    exclude_extensions: tuple[str, ...] | None = None
    exclude_paths: tuple[str, ...] = field(default_factory=tuple)


@dataclass(frozen=True)
class PerceptualOptions:
    max_hamming_distance: int = 10

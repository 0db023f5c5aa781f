"""Plan files, journals and profiles: small JSON documents that the driver reads and writes."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from siftline.model import JOURNAL, Action, PlanFileError

FORMAT, VERSION = "siftline-plan", 1
_OPS = {"delete": {"path"}, "trash": {"path"}, "hardlink": {"path", "kept"}, "reflink": {"path", "kept"}, "move": {"from", "to"}, "copy": {"from", "to"}}


def stamp(path: str) -> dict:
    return {"path": os.path.abspath(path), "mtime_ns": os.lstat(path).st_mtime_ns}


def write_plan(plan: DataFrame, root: str, action: Action, file: str, archive_dir: str | None = None, protected: Iterable[str] = ()) -> int:
    """A reviewable plan of planned rows (group_id, size, kept, path); gives the number of targets.

    Files are stamped as they are now; a group with a file that can't be is left out.
    """
    if action is Action.REPORT:
        raise ValueError("a plan needs an action")
    groups: dict[str, dict] = {}
    for r in plan.orderBy("group_id", "path").toLocalIterator():
        groups.setdefault(r["group_id"], {"size": r["size"], "kept": r["kept"], "targets": []})["targets"].append(r["path"])
    out = []
    for g in groups.values():
        try:
            out.append({"size": g["size"], "kept": stamp(g["kept"]), "targets": [stamp(t) for t in g["targets"]]})
        except OSError:
            continue
    doc = {"format": FORMAT, "version": VERSION, "root": os.path.abspath(root), "created_at": int(time.time()), "action": {"kind": action.value, **({"archive_dir": archive_dir} if archive_dir else {})}, "protected": sorted(protected), "groups": out}
    with open(file, "w", encoding="utf-8") as f:
        json.dump(doc, f, indent=2, ensure_ascii=False)
    return sum(len(g["targets"]) for g in out)


def _only(doc: object, wanted: dict, where: str, optional: frozenset = frozenset()) -> dict:
    if not isinstance(doc, dict):
        raise PlanFileError(f"{where}: not an object")
    if unknown := doc.keys() - wanted.keys():
        raise PlanFileError(f"{where}: unknown field {sorted(unknown)[0]}")
    for k, kind in wanted.items():
        if k not in doc and k not in optional:
            raise PlanFileError(f"{where}: no field {k}")
        if k in doc and not isinstance(doc[k], kind):
            raise PlanFileError(f"{where}: {k} is no {kind.__name__}")
    return doc


def read_plan(file: str) -> dict:
    """A plan, checked: nothing unknown, nothing missing, the right format and version."""
    with open(file, encoding="utf-8") as f:
        try:
            doc = json.load(f)
        except json.JSONDecodeError as e:
            raise PlanFileError(f"{file}: line {e.lineno}: {e.msg}") from e
    if isinstance(doc, dict) and doc.get("format") != FORMAT:
        raise PlanFileError(f"{file}: not a plan file (format {doc.get('format')!r})")
    if isinstance(doc, dict) and doc.get("version") != VERSION:
        raise PlanFileError(f"{file}: plan version {doc.get('version')} unsupported (expected {VERSION})")
    _only(doc, {"format": str, "version": int, "root": str, "created_at": int, "action": dict, "protected": list, "groups": list}, file, frozenset({"protected"}))
    _only(doc["action"], {"kind": str, "archive_dir": str}, f"{file}: action", frozenset({"archive_dir"}))
    Action.parse(doc["action"]["kind"], doc["action"].get("archive_dir"))
    for g in doc["groups"]:
        _only(g, {"size": int, "kept": dict, "targets": list}, f"{file}: group")
        for s in (g["kept"], *g["targets"]):
            _only(s, {"path": str, "mtime_ns": int}, f"{file}: file")
    return doc


def plan_rows(spark: SparkSession, doc: dict) -> DataFrame:
    """group_id, size, path, mtime_ns, role (kept or target) of a plan."""
    rows = [(str(k), g["size"], s["path"], s["mtime_ns"], role) for k, g in enumerate(doc["groups"]) for role, files in (("kept", [g["kept"]]), ("target", g["targets"])) for s in files]
    return spark.createDataFrame(rows, "group_id string, size long, path string, mtime_ns long, role string")


class Journal:
    """What was done, a JSON line each, on the disk before the next group begins."""

    def __init__(self, file: str) -> None:
        self.file = file

    def append(self, entries: list[dict]) -> None:
        with open(self.file, "a", encoding="utf-8") as f:
            f.writelines(json.dumps(e, ensure_ascii=False) + "\n" for e in entries)
            f.flush()
            os.fsync(f.fileno())

    def entries(self) -> list[dict]:
        out = []
        with open(self.file, encoding="utf-8") as f:
            for number, line in enumerate(f, 1):
                if not line.strip():
                    continue
                try:
                    entry = json.loads(line)
                    fields = _OPS[entry["op"]]
                except (ValueError, KeyError, TypeError) as e:
                    raise PlanFileError(f"{self.file}: line {number}: {e}") from e
                if entry.keys() != fields | {"op"}:
                    raise PlanFileError(f"{self.file}: line {number}: fields of {entry['op']} are {sorted(fields)}")
                out.append(entry)
        return out

    def rows(self, spark: SparkSession) -> DataFrame:
        """seq and the fields of all entries; newest first is orderBy seq, descending."""
        names = [n.strip("`").split()[0].strip("`") for n in JOURNAL.split(", ")]
        return spark.createDataFrame([(k, *(e.get(n) for n in names)) for k, e in enumerate(self.entries())], f"seq long, {JOURNAL}")


class Profiles:
    """Named roots and options in one JSON list."""

    def __init__(self, file: str) -> None:
        self.file = file

    def all(self) -> list[dict]:
        if not os.path.exists(self.file) or not os.path.getsize(self.file):
            return []
        with open(self.file, encoding="utf-8") as f:
            return json.load(f)

    def _write(self, profiles: list[dict]) -> None:
        with open(f"{self.file}.new", "w", encoding="utf-8") as f:
            json.dump(profiles, f, indent=2)
        os.replace(f"{self.file}.new", self.file)

    def save(self, name: str, root: str, options: dict) -> None:
        new, old = {"name": name, "root": root, "options": options}, self.all()
        self._write([new if p["name"] == name else p for p in old] + [new] * all(p["name"] != name for p in old))

    def remove(self, name: str) -> None:
        self._write([p for p in self.all() if p["name"] != name])

"""Files of the library's own data sources: listing, planning and committing on any file system that pyarrow opens.

Tasks write files under names of their own (``task-<unique>``).  A job counts once its list of files is written, in one
small file under ``_commits``; until then, and for tasks that failed or ran twice, nothing of it is read.
Files that other programs put into the folder are read as they are.
"""

from __future__ import annotations

import json
import sys
import uuid
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql.datasource import InputPartition, WriterCommitMessage

COMMITS = "_commits"
OWN = "task-"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Files(InputPartition):
    """Files (path, bytes) that one task reads, as ``value``."""


@dataclass
class Written(WriterCommitMessage):
    """What one task has written: (name, bytes) or (name, bytes, facts) of its files, and the rows in them and left out."""

    files: list
    rows: int = 0
    rejected: int = 0


def new_name(suffix: str) -> str:
    return f"{OWN}{uuid.uuid4().hex}{suffix}"


def _manifests(system: pafs.FileSystem, root: str) -> list[str]:
    found = system.get_file_info(pafs.FileSelector(f"{root}/{COMMITS}", allow_not_found=True))
    return sorted(f.path for f in found if f.type == pafs.FileType.File and f.path.endswith(".json"))


def facts(uri: str) -> dict[str, dict]:
    """What the commits say of each file, by name: its bytes, and what the writer measured."""
    system, root = file_system(uri)
    out = {}
    for manifest in _manifests(system, root.rstrip("/")):
        with system.open_input_stream(manifest) as f:
            out.update({e["name"]: e for e in json.loads(f.read())["files"]})
    return out


def list_files(uri: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """Paths and sizes of the folder's readable files (or of the one file named), in order."""
    system, root = file_system(uri)
    root = root.rstrip("/")
    here = system.get_file_info(root)
    if here.type == pafs.FileType.File:
        return [(root, here.size)]
    if here.type == pafs.FileType.NotFound:
        raise FileNotFoundError(uri)
    committed = facts(uri)
    out = []
    for f in system.get_file_info(pafs.FileSelector(root, recursive=True)):
        name = f.path.rsplit("/", 1)[-1]
        inner = f.path[len(root) + 1:]
        if f.type != pafs.FileType.File or not name.endswith(suffixes) or any(p.startswith(("_", ".")) for p in inner.split("/")):
            continue
        if not name.startswith(OWN) or name in committed:
            out.append((f.path, f.size))
    return sorted(out)


def plan(files: list[tuple[str, int]], most_bytes: int) -> list[Files]:
    """Neighbouring files share a task up to ``most_bytes``; a larger file has one of its own."""
    groups: list[list] = []
    room = 0
    for path, size in files:
        if not groups or size > room:
            groups.append([])
            room = most_bytes
        groups[-1].append((path, size))
        room -= size
    return [Files(g) for g in groups]


def commit(uri: str, messages: list, overwrite: bool) -> None:
    """Make the files of a job readable; with ``overwrite`` the files of earlier jobs go after that."""
    system, root = file_system(uri)
    root = root.rstrip("/")
    old = _manifests(system, root) if overwrite else []
    system.create_dir(f"{root}/{COMMITS}", recursive=True)
    told = [m for m in messages if m is not None]
    files = [{"name": f[0], "bytes": f[1], **(f[2] if len(f) > 2 else {})} for m in told for f in m.files]
    with system.open_output_stream(f"{root}/{COMMITS}/{uuid.uuid4().hex}.json") as f:
        f.write(json.dumps({"files": files, "rows": sum(m.rows for m in told), "rejected": sum(m.rejected for m in told)}).encode())
    for manifest in old:
        with system.open_input_stream(manifest) as f:
            gone = json.loads(f.read())["files"]
        system.delete_file(manifest)
        for e in gone:
            system.delete_file(f"{root}/{e['name']}")


def abort(uri: str, messages: list) -> None:
    """Remove what the tasks of a failed job report; what they don't is never read."""
    system, root = file_system(uri)
    for m in messages:
        for f in m.files if m is not None else ():
            path = f"{root.rstrip('/')}/{f[0]}"
            if system.get_file_info(path).type == pafs.FileType.File:
                system.delete_file(path)


# Data sources run in Python workers; they travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["file_system", "Files", "Written", "new_name", "list_files", "facts", "plan", "commit", "abort"]

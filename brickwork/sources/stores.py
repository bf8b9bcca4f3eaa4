"""File systems as tasks reach them.

The driver resolves a path once, as Spark's readers would (:func:`qualified`), so that a path without scheme goes to the
cluster's default file system. Tasks then open the full address: ``file:`` as a mounted path, other schemes through
Arrow, one client per store and process. A store that Arrow does not know by its scheme is registered with a file system
object, which travels with the tasks.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator, Mapping
from functools import lru_cache

from pyarrow import fs as pafs
from pyspark.sql import SparkSession

from brickwork.session import shared_folder

#: Schemes of Hadoop connectors, and the one that Arrow has for the same store.
ALIASES = {"s3a": "s3", "s3n": "s3"}
_REGISTERED: dict[str, pafs.FileSystem] = {}


def register(address: str, system: pafs.FileSystem) -> None:
    """Open paths below ``address`` (``scheme://authority``, or ``scheme:`` for all of a scheme) through ``system``."""
    _REGISTERED[address.rstrip("/")] = system


def registered() -> dict[str, pafs.FileSystem]:
    """What tasks need to know; hand it to :func:`use` there."""
    return dict(_REGISTERED)


def use(known: Mapping[str, pafs.FileSystem]) -> None:
    _REGISTERED.update(known)


def qualified(spark: SparkSession, path: str) -> str:
    """Full address of a path, as Spark's readers resolve it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(found).toString()


def mounted(path: str) -> bool:
    """Whether an address is a mounted path, where files can be written at positions."""
    return path.startswith(("/", "file:")) and "file:" not in _REGISTERED


def local_path(path: str) -> str:
    return "/" + path[len("file:") :].lstrip("/") if path.startswith("file:") else path


def in_place_allowed(spark: SparkSession, folder: str) -> bool:
    """Whether all tasks see the same files below a mounted folder: in a local session, or in the shared folder."""
    if spark.sparkContext.master.startswith("local"):
        return True
    return os.path.join(local_path(folder), "").startswith(os.path.join(local_path(shared_folder(spark)), ""))


def _split(path: str) -> tuple[str, str, str]:
    """Scheme, authority and the path proper."""
    scheme, _, rest = path.partition(":")
    if not rest.startswith("//"):
        return scheme, "", rest
    authority, _, inner = rest[2:].partition("/")
    return scheme, authority, "/" + inner


@lru_cache(maxsize=None)
def _client(scheme: str, authority: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(f"{ALIASES.get(scheme, scheme)}://{authority}/")


def system_of(path: str) -> tuple[pafs.FileSystem, str]:
    """File system of an address, and the path inside it."""
    if path.startswith("/"):
        return pafs.LocalFileSystem(), path
    scheme, authority, inner = _split(path)
    for address in (f"{scheme}://{authority}", f"{scheme}:"):
        if address in _REGISTERED:
            return _REGISTERED[address], inner
    if scheme == "file":
        return pafs.LocalFileSystem(), local_path(path)
    system, root = _client(scheme, authority)
    return system, root.rstrip("/") + inner


def open_input(path: str):
    """Open a file for reading at positions."""
    system, inner = system_of(path)
    return system.open_input_file(inner)


def create(path: str):
    """Open a file for writing from its start; the folders above it are made where the store has folders."""
    system, inner = system_of(path)
    system.create_dir(os.path.dirname(inner), recursive=True)
    return system.open_output_stream(inner)


def exists(path: str) -> bool:
    system, inner = system_of(path)
    return system.get_file_info(inner).type != pafs.FileType.NotFound


def move(source: str, target: str) -> None:
    """Put a file in another one's place. A repeated move, whose source is gone, is done already."""
    if mounted(source):
        target = local_path(target)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        try:
            os.replace(local_path(source), target)
        except FileNotFoundError:
            if not os.path.exists(target):
                raise
        return
    system, inner = system_of(source)
    if not exists(source) and exists(target):
        return
    _, to = system_of(target)
    system.create_dir(os.path.dirname(to), recursive=True)
    if exists(target):
        system.delete_file(to)
    system.move(inner, to)


def make_folder(path: str) -> None:
    """Make a folder and those above it."""
    system, inner = system_of(path)
    system.create_dir(inner, recursive=True)


def make_below(root: str, folder: str) -> None:
    """Make a mounted folder below ``root``, which must be there: one that was deleted is not made again."""
    missing = []
    while folder != root and not os.path.isdir(folder):
        missing.append(folder)
        folder = os.path.dirname(folder)
    for one in reversed(missing):
        try:
            os.mkdir(one)
        except FileExistsError:
            pass


def delete_folder(path: str) -> None:
    """Delete a folder made by this package, if it is there. Tasks that are being stopped may still write to it."""
    system, inner = system_of(path)
    for left in range(9, -1, -1):
        if system.get_file_info(inner).type != pafs.FileType.Directory:
            return
        try:
            system.delete_dir(inner)
        except OSError:
            if not left:
                raise
            time.sleep(0.2)


def list_files(folder: str, suffix: str, recursive: bool) -> list[tuple[str, int]]:
    """Address and length of the files of a folder, in order; names that begin with ``_`` or ``.`` are hidden."""
    system, inner = system_of(folder)
    base = folder.rstrip("/")
    found = []
    for info in system.get_file_info(pafs.FileSelector(inner, recursive=recursive)):
        below = os.path.relpath(info.path.lstrip("/"), inner.lstrip("/"))  # some systems give paths without the first slash
        if info.type == pafs.FileType.File and below.endswith(suffix) and not any(p[0] in "_." for p in below.split("/")):
            found.append((f"{base}/{below}", info.size))
    return sorted(found)


def list_folder(folder: str) -> Iterator[tuple[str, str, int, bool]]:
    """Address, name, length and whether it is a folder, of everything right inside a folder; nothing if it is gone."""
    system, inner = system_of(folder)
    base = folder.rstrip("/")
    for info in system.get_file_info(pafs.FileSelector(inner, allow_not_found=True)):
        if info.type != pafs.FileType.NotFound:
            yield f"{base}/{info.base_name}", info.base_name, info.size or 0, info.type == pafs.FileType.Directory


def reachable(path: str) -> bool:
    """Whether tasks can open an address by themselves; other stores are known to Spark's readers only."""
    try:
        system_of(path)
    except (OSError, ValueError, NotImplementedError):  # Arrow's own errors are among these
        return False
    return True

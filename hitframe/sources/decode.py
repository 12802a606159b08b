"""Bytes of event records to Arrow batches of nested events, and file access shared by the sources."""

from __future__ import annotations

import glob
import hashlib
import os
import posixpath
import re

import numpy as np
import pyarrow as pa
from pyarrow import fs

# One hit is 16 bytes, little endian.
HIT_DTYPE = np.dtype([("time", "<i8"), ("energy", "<f4"), ("channel", "<i4")])

HIT_ARROW = pa.struct([("time", pa.int64()), ("energy", pa.float32()), ("channel", pa.int32())])
EVENTS_ARROW = pa.schema(
    [
        ("file_name", pa.string()),
        ("file_id", pa.int64()),
        ("event_id", pa.int64()),
        ("side1", pa.list_(HIT_ARROW)),
        ("side2", pa.list_(HIT_ARROW)),
        ("corrupt", pa.bool_()),
    ]
)

MODES = ("permissive", "dropmalformed", "failfast")


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """File system and bare path of a plain path or URI, so that shared stores work as well as mounted folders."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = path[len("file:") :]
    if path.startswith("s3a://"):
        path = "s3://" + path[len("s3a://") :]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def list_files(path: str) -> list[tuple[str, int]]:
    """Data files of a file, folder with all its subfolders, or (local) glob pattern in name order, with their sizes.

    Names that start with ``_`` or ``.`` are no data, nor is what lies in folders of such names. A place without data is an error.

    The paths of a store keep the scheme and host of ``path``, so that tasks open the same store.
    """
    path = path.rstrip("/")
    store, bare = open_fs(path)
    local = isinstance(store, fs.LocalFileSystem)
    prefix = "" if local else path[: len(path) - len(bare)]
    if local and glob.has_magic(bare):
        infos = store.get_file_info(sorted(glob.glob(bare)))
    else:
        info = store.get_file_info(bare)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        infos = [info]
    found = []
    for top in infos:
        below = [top] if top.is_file else store.get_file_info(fs.FileSelector(top.path, recursive=True))
        for i in below:
            inner = i.path[len(top.path) :] if not top.is_file else i.base_name
            if i.is_file and not any(part.startswith(("_", ".")) for part in inner.split("/")):
                found.append((prefix + i.path, i.size))
    if not found:
        raise FileNotFoundError(f"no data files in {path}")
    return sorted(found)


def base_name(path: str) -> str:
    return posixpath.basename(path)


def file_number(path: str) -> int:
    """64-bit identity of a file from its whole path: the same in every listing and stream, whatever lies beside it."""
    plain = re.sub(r"^s3a:", "s3:", re.sub(r"^file:/+", "/", path))
    return int.from_bytes(hashlib.blake2b(plain.encode("utf-8", "surrogateescape"), digest_size=8).digest(), "little", signed=True)


def numbered_files(path: str) -> list[tuple[str, int, int]]:
    """``list_files`` with the number of each file; two paths of one number are an error."""
    files = [(name, size, file_number(name)) for name, size in list_files(path)]
    if len({number for *_, number in files}) < len(files):
        raise ValueError(f"two files below {path} have the same number; read them separately")
    return files


def hit_lists(hits: np.ndarray, counts: np.ndarray, keep: np.ndarray | None) -> pa.ListArray:
    """Nested hit array from flat hits in event order and the number of hits per event; ``keep`` masks hits out."""
    if keep is not None:
        owner = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(owner[keep], minlength=len(counts))
        hits = hits[keep]
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    values = pa.StructArray.from_arrays(
        [pa.array(np.ascontiguousarray(hits[n])) for n in HIT_DTYPE.names], fields=list(HIT_ARROW)
    )
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def event_batch(
    name: str,
    file_id: int,
    first_event: int,
    sides: list[tuple[np.ndarray, np.ndarray]],
    corrupt: np.ndarray,
    min_energy: float | None,
) -> pa.RecordBatch:
    """One Arrow batch of consecutive events; ``sides`` has flat hits and counts per side (one side in group mode)."""
    n = len(corrupt)
    if len(sides) == 1:
        sides = [*sides, (np.zeros(0, HIT_DTYPE), np.zeros(n, np.int64))]
    columns = []
    for hits, counts in sides:
        # The threshold is inclusive and also drops energies that are not a number.
        keep = None if min_energy is None else hits["energy"] >= min_energy
        columns.append(hit_lists(hits, counts, keep))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([name] * n, pa.string()),
            pa.array(np.full(n, file_id, np.int64)),
            pa.array(np.arange(first_event, first_event + n, dtype=np.int64)),
            *columns,
            pa.array(corrupt),
        ],
        schema=EVENTS_ARROW,
    )

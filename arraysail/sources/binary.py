"""Arrays and volumes in files: npy, NIfTI-1, images and archives.

A file is one row of the ``binaryFile`` source, decoded in an Arrow batch on
the task that reads it.
"""

from __future__ import annotations

import gzip
import io
import os
import struct
import tarfile
import zipfile
from collections.abc import Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arraysail.functions.scalar import base_name, parent_name, stem

_CELLS = pa.schema([("path", pa.string()), ("index", pa.list_(pa.int32())), ("value", pa.float64())])
_ROWS_AT_ONCE = 100_000


def _cells(decode):
    def f(batches):
        for b in batches:
            for path, content in zip(b["path"].to_pylist(), b["content"].to_pylist()):
                a = decode(content)
                flat, shape = a.ravel(), a.shape
                for i in range(0, flat.size, _ROWS_AT_ONCE):
                    n = np.arange(i, min(i + _ROWS_AT_ONCE, flat.size))
                    index = np.stack(np.unravel_index(n, shape), 1).astype(np.int32) if shape else np.empty((len(n), 0), np.int32)
                    offsets = pa.array(np.arange(0, index.size + 1, max(index.shape[1], 1))[: len(n) + 1] if index.size else np.zeros(len(n) + 1), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(n)), pa.ListArray.from_arrays(offsets, pa.array(index.ravel())), pa.array(flat[n].astype(float))], schema=_CELLS)

    return f


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def decode_npy(content: bytes) -> np.ndarray:
    """Plain arrays alone; pickled objects are refused."""
    return np.load(io.BytesIO(content), allow_pickle=False)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(path, index, value) of every cell (SRC13)."""
    return files(spark, path, "*.npy").select("path", "content").mapInArrow(_cells(decode_npy), "path string, index array<int>, value double")


_NIFTI = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}


def decode_nifti(content: bytes) -> np.ndarray:
    """The scaled volume of a NIfTI-1 file, gzipped or not."""
    b = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    order = "<" if struct.unpack("<i", b[:4])[0] == 348 else ">"
    if struct.unpack(order + "i", b[:4])[0] != 348:
        raise ValueError("no NIfTI-1 header")
    dim = struct.unpack(order + "8h", b[40:56])
    kind, = struct.unpack(order + "h", b[70:72])
    start, slope, shift = struct.unpack(order + "3f", b[108:120])
    if kind not in _NIFTI:
        raise ValueError(f"data type {kind}")
    shape = dim[1 : dim[0] + 1]
    a = np.frombuffer(b, np.dtype(order + _NIFTI[kind]), int(np.prod(shape)), int(start)).reshape(shape, order="F")
    return a * slope + shift if slope and (slope != 1 or shift) else a


def encode_nifti(a: np.ndarray, slope: float = 1.0, shift: float = 0.0) -> bytes:
    """A NIfTI-1 file of a float32 volume."""
    h = bytearray(352)
    struct.pack_into("<i", h, 0, 348)
    struct.pack_into("<8h", h, 40, a.ndim, *a.shape, *[1] * (7 - a.ndim))
    struct.pack_into("<2h", h, 70, 16, 32)
    struct.pack_into("<3f", h, 108, 352.0, slope, shift)
    h[344:348] = b"n+1\0"
    return bytes(h) + np.asfortranarray(a, "<f4").tobytes(order="F")


def read_nifti(spark: SparkSession, path: str, dims: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """(path, dims, value) of every voxel (SRC09)."""
    got = files(spark, path, "*.nii*").select("path", "content").mapInArrow(_cells(decode_nifti), "path string, index array<int>, value double")
    return got.select("path", *[F.get("index", F.lit(i)).alias(d) for i, d in enumerate(dims)], "value")


def read_images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(stimulus, category, path, length, sha1) of files in a tree, category being the folder (SRC16, SNK13)."""
    f = files(spark, path, pattern)
    return f.select(stem("path").alias("stimulus"), parent_name("path").alias("category"), base_name("path").alias("filename"), "length", F.sha1("content").alias("sha1"), "path")


def members(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, size) of zip and tar archives (SRC22)."""

    def f(batches):
        for b in batches:
            rows = []
            for p, c in zip(b["path"].to_pylist(), b["content"].to_pylist()):
                if zipfile.is_zipfile(io.BytesIO(c)):
                    rows += [(p, i.filename, i.file_size) for i in zipfile.ZipFile(io.BytesIO(c)).infolist()]
                else:
                    with tarfile.open(fileobj=io.BytesIO(c)) as t:
                        rows += [(p, m.name, m.size) for m in t.getmembers() if m.isfile()]
            columns = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=["path", "member", "size"])

    return files(spark, path).select("path", "content").mapInArrow(f, "path string, member string, size long")


def unzip(archive: str, folder: str, password: str | None = None, remove: bool = True) -> list[str]:
    """Extracts what is not there yet; returns the members. Names that leave the folder are refused."""
    with zipfile.ZipFile(archive) as z:
        names = [n for n in z.namelist() if not n.endswith("/")]
        _safe(names, folder)
        if not all((Path(folder) / n).exists() for n in names):
            z.extractall(folder, pwd=password.encode() if password else None)
    if remove:
        os.remove(archive)
    return names


def untar(archive: str, folder: str, remove: bool = True) -> list[str]:
    with tarfile.open(archive) as t:
        names = [m.name for m in t.getmembers() if m.isfile()]
        _safe(names, folder)
        if not all((Path(folder) / n).exists() for n in names):
            t.extractall(folder, filter="data")
    if remove:
        os.remove(archive)
    return names


def _safe(names: Sequence[str], folder: str) -> None:
    root = Path(folder).resolve()
    for n in names:
        if not (root / n).resolve().is_relative_to(root):
            raise ValueError(f"{n} leaves the folder")

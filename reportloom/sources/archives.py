"""Members of zip archives of any size, read by their offsets.

The end of an archive lists its members.  A task reads that list alone and makes a row of
each member: archive, offset, size.  The rows are dealt out by size, so the members of
one large archive are read by many tasks, and of a member wanted only its own bytes are
read.  Members that are damaged, encrypted or packed in an unknown way are set aside with
the reason; so is an archive without a readable list.

Archives are opened where the tasks run, by their own address: local paths, ``hdfs``,
``s3``, ``gs`` and whatever else Arrow's file systems know.
"""

from __future__ import annotations

import struct
import zipfile
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBERS = (
    "path string, member string, offset long, packed long, size long, method int, crc long, error string"
)
CONTENT = "path string, member string, content binary, error string"
_STORED, _DEFLATED = zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED


def _opened(path: str):
    """A file to seek and read in, in whatever store holds it."""
    if ":" not in path:
        return fs.LocalFileSystem().open_input_file(path)
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    store, place = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return store.open_input_file(place)


def _listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = MEMBERS.replace(" string", "").replace(" long", "").replace(" int", "").split(", ")
    for frame in frames:
        for path in frame["path"]:
            rows = []
            try:
                with _opened(path) as file, zipfile.ZipFile(file) as archive:
                    for m in archive.infolist():
                        if not m.is_dir():
                            error = "encrypted" if m.flag_bits & 1 else None
                            rows.append((path, m.filename, m.header_offset, m.compress_size, m.file_size, m.compress_type, m.CRC, error))
            except (zipfile.BadZipFile, OSError, ValueError, struct.error) as problem:
                rows = [(path, None, None, None, None, None, None, f"not a readable archive: {problem}"[:200])]
            for at in range(0, len(rows), 10_000):
                yield pd.DataFrame(rows[at : at + 10_000], columns=names).astype(
                    {"offset": "Int64", "packed": "Int64", "size": "Int64", "method": "Int32", "crc": "Int64"}
                )


def list_members(archives: DataFrame, path: str = "path") -> DataFrame:
    """``path, member, offset, packed, size, method, crc, error`` of every member but folders.

    ``offset`` is that of the member's own header.  An archive that cannot be listed is a
    row without member.
    """
    return archives.select(F.col(path).alias("path")).mapInPandas(_listed, MEMBERS)


def _unpacked(file, offset: int, packed: int, size: int, method: int, crc: int) -> bytes:
    file.seek(offset)
    header = file.read(30)
    if len(header) < 30 or header[:4] != b"PK\x03\x04":
        raise ValueError("no member at its offset")
    name, extra = struct.unpack("<HH", header[26:30])
    file.seek(offset + 30 + name + extra)
    data = file.read(packed)
    if len(data) < packed:
        raise ValueError("cut off")
    if method == _DEFLATED:
        # No more than the size that was listed, whatever the bytes would unfold to.
        machine = zlib.decompressobj(-zlib.MAX_WBITS)
        data = machine.decompress(data, size + 1)
    elif method != _STORED:
        raise ValueError(f"packing method {method} is not known")
    if len(data) != size:
        raise ValueError("another size than listed")
    if zlib.crc32(data) != crc:
        raise ValueError("checksum differs")
    return data


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, file, rows, bulk = None, None, [], 0
    try:
        for frame in frames:
            for row in frame.itertuples(index=False):
                content, error = None, None if pd.isna(row.error) else row.error
                if error is None:
                    try:
                        if held != row.path:
                            if file is not None:
                                file.close()
                            file, held = _opened(row.path), row.path
                        content = _unpacked(file, int(row.offset), int(row.packed), int(row.size), int(row.method), int(row.crc))
                    except (ValueError, OSError, zlib.error) as problem:
                        error = str(problem)[:200]
                rows.append((row.path, row.member, content, error))
                bulk += len(content or b"")
                if bulk > 32_000_000 or len(rows) >= 1000:
                    yield pd.DataFrame(rows, columns=["path", "member", "content", "error"])
                    rows, bulk = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["path", "member", "content", "error"])
    finally:
        if file is not None:
            file.close()


def read_members(members: DataFrame, task_bytes: int = 64_000_000) -> DataFrame:
    """``path, member, content, error`` of listed members, each read by its offset.

    Members lie in tasks by archive and offset, about ``task_bytes`` of packed data in each.
    """
    total = members.agg(F.sum("packed")).first()[0] or 0
    tasks = max(1, -(-int(total) // task_bytes))
    dealt = members.repartitionByRange(tasks, "path", "offset").sortWithinPartitions("path", "offset")
    return dealt.mapInPandas(_read, CONTENT)


def zipped_files(
    spark: SparkSession, archives: str | Sequence[str], wanted: DataFrame | None = None, encoding: str = "utf-8"
) -> tuple[DataFrame, DataFrame]:
    """``source_file, content`` of the archives' members as text, and ``file_path, error_message`` of those set aside.

    ``source_file`` is ``<archive>/<member>``; of ``wanted`` the first column holds such
    names, and no bytes of other members are read.
    """
    listed = list_members(spark.read.format("binaryFile").load(archives).select("path"))
    name = F.concat_ws("/", "path", "member")
    if wanted is not None:
        names = wanted.select(F.col(wanted.columns[0]).alias("_wanted")).distinct()
        listed = listed.join(names, name == F.col("_wanted"), "left_semi")
    found = read_members(listed)
    good = found.filter("error IS NULL").select(name.alias("source_file"), F.decode("content", encoding).alias("content"))
    return good, found.filter("error IS NOT NULL").select(name.alias("file_path"), F.col("error").alias("error_message"))

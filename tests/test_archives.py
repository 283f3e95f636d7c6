"""Zip members by offset: large and damaged archives, and what is read."""

import os
import zipfile

import pytest

from reportloom.sources import archives as Z


def packed(path, members, offset=0, **options):
    """An archive behind so many bytes that take no room on the disk."""
    with open(path, "w+b") as file:
        file.truncate(offset)
        with zipfile.ZipFile(file, "a" if offset else "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in members.items():
                z.writestr(name, data, **options)
    return str(path)


def test_members_of_a_large_archive(spark, tmp_path):
    members = {f"in/{i:03d}.hl7": f"MSH|{i}|é\r" * (i + 1) for i in range(300)} | {"empty.hl7": "", "folder/": ""}
    path = packed(tmp_path / "big.zip", members, offset=(5 << 30) + 7)
    assert os.path.getsize(path) > 5 << 30  # beyond what one value can hold
    good, bad = Z.zipped_files(spark, path)
    found = {r.source_file.split("big.zip/")[1]: r.content for r in good.collect()}
    assert found == {k: v for k, v in members.items() if not k.endswith("/")} and bad.isEmpty()
    listed = Z.list_members(spark.createDataFrame([(path,)], "path string"))
    assert listed.filter("offset > 5368709120").count() == 301
    tasks = Z.read_members(listed, task_bytes=500)
    assert tasks.rdd.getNumPartitions() > 5 and tasks.filter("error IS NULL").count() == 301


def test_one_member_reads_its_own_bytes(spark, tmp_path, monkeypatch):
    path = packed(tmp_path / "a.zip", {"one.hl7": "MSH|1", "noise.bin": os.urandom(3_000_000), "two.hl7": "MSH|2" * 500})
    listed = Z.list_members(spark.createDataFrame([(path,)], "path string")).filter("member = 'two.hl7'").toPandas()
    read = []

    class Counted:
        def __init__(self, file):
            self._file = file

        def seek(self, at):
            return self._file.seek(at)

        def read(self, n):
            read.append(n)
            return self._file.read(n)

        def close(self):
            self._file.close()

    real = Z._opened
    monkeypatch.setattr(Z, "_opened", lambda p: Counted(real(p)))
    content = next(Z._read(iter([listed])))["content"][0]
    assert content == b"MSH|2" * 500 and sum(read) == 30 + int(listed["packed"][0])
    wanted = spark.createDataFrame([(f"file:{path}/two.hl7",), (f"file:{path}/none",)], "name string")
    good, _ = Z.zipped_files(spark, path, wanted)
    assert [r.content for r in good.collect()] == ["MSH|2" * 500]


def test_damaged_members_are_set_aside(spark, tmp_path):
    path = packed(tmp_path / "bad.zip", {"a.hl7": "A" * 1000, "b.hl7": "B" * 1000, "c.hl7": "C" * 1000})
    with zipfile.ZipFile(path) as z:
        places = {m.filename: m.header_offset for m in z.infolist()}
    raw = bytearray(open(path, "rb").read())
    raw[places["b.hl7"] + 30 + 5 + 3] ^= 0xFF  # inside the packed bytes
    raw[places["c.hl7"]] = 0  # the member's own header
    open(path, "wb").write(raw)
    lzma = packed(tmp_path / "lzma.zip", {"l.hl7": "L" * 100}, compress_type=zipfile.ZIP_LZMA)
    (tmp_path / "none.zip").write_bytes(b"this is no archive")
    (tmp_path / "empty.zip").write_bytes(b"")  # a file without any byte yields no row
    good, bad = Z.zipped_files(spark, [path, lzma, str(tmp_path / "none.zip"), str(tmp_path / "empty.zip")])
    assert [r.source_file.rsplit("/", 1)[1] for r in good.collect()] == ["a.hl7"]
    errors = {r.file_path.rsplit("/", 1)[1]: r.error_message for r in bad.collect()}
    assert set(errors) == {"b.hl7", "c.hl7", "l.hl7", "none.zip"}
    assert "offset" in errors["c.hl7"] and "method 14" in errors["l.hl7"] and "archive" in errors["none.zip"]


@pytest.mark.parametrize("size", [10, 5000])
def test_a_member_unfolds_to_its_listed_size(size):
    import io
    import zlib

    machine = zlib.compressobj(9, zlib.DEFLATED, -zlib.MAX_WBITS)
    data = machine.compress(b"0" * 100_000) + machine.flush()
    file = io.BytesIO(b"PK\x03\x04" + bytes(22) + b"\0\0\0\0" + data)
    with pytest.raises(ValueError, match="size"):
        Z._unpacked(file, 0, len(data), size, zipfile.ZIP_DEFLATED, 0)

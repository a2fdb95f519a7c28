"""Identity of files by content and by byte ranges, read whole or piece by piece."""

import hashlib
import os

import pytest

from vozlake.sources import contracts

SIZE = 1000


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in ner%20").mkdir()
    for name, content in (("a.bin", os.urandom(4321)), ("in ner%20/b é.bin", os.urandom(3000)), ("empty", b""), ("one", b"x")):
        (tmp_path / name).write_bytes(content)
    return tmp_path


def expected(folder):
    out = {}
    for path in (p for p in folder.rglob("*") if p.is_file() and p.name != "empty"):
        content = path.read_bytes()
        for at in range(0, len(content), SIZE):
            out[str(path.relative_to(folder)), len(content), at] = hashlib.sha256(content[at:at + SIZE]).hexdigest()
    return out


@pytest.mark.parametrize("whole", [0, 3500, 10_000])
def test_ranges_do_not_depend_on_the_way_of_reading(spark, folder, whole):
    got = contracts.range_digests(spark, str(folder), size=SIZE, whole=whole).collect()
    assert {(r.file, r.length, r.start): r.digest for r in got} == expected(folder) and len(got) == len(expected(folder))
    whole_files = {r.file: r.identity for r in contracts.file_digests(spark, str(folder), "text", whole=whole).collect()}
    assert whole_files == {p.name: hashlib.sha256(p.read_bytes()).hexdigest() + ":text" for p in folder.rglob("*") if p.is_file() and p.name != "empty"}


def test_changed_bytes_are_named(spark, folder, tmp_path):
    record = str(tmp_path.parent / f"{tmp_path.name}-record")
    contracts.range_digests(spark, str(folder), size=SIZE).write.parquet(record)
    recorded = spark.read.parquet(record)

    def compare():
        rows = contracts.compare_ranges(recorded, contracts.range_digests(spark, str(folder), size=SIZE)).collect()
        return {(r.file, r.status, r.start) for r in rows}

    assert {s for _, s, _ in compare()} == {"unchanged"}
    data = bytearray((folder / "a.bin").read_bytes())
    data[2999] ^= 1
    (folder / "a.bin").write_bytes(bytes(data) + b"y" * 700)
    (folder / "one").rename(folder / "two")
    assert compare() == {("a.bin", "changed", 2000), ("a.bin", "changed", 4000), ("a.bin", "changed", 5000), ("in ner%20/b é.bin", "unchanged", None),
                         ("one", "missing", None), ("two", "added", None)}


def test_a_sparse_file_above_two_gigabytes(spark, tmp_path):
    """The last byte of a file that no single value can hold."""
    with open(tmp_path / "big", "wb") as file:
        file.truncate((2 << 30) + 5)
        file.seek((2 << 30) + 4)
        file.write(b"!")
    size = 256 << 20
    got = {r.start: r.digest for r in contracts.range_digests(spark, str(tmp_path), size=size).collect()}
    zeros = hashlib.sha256(bytes(size)).hexdigest()
    assert got == {**{k * size: zeros for k in range(8)}, 8 * size: hashlib.sha256(b"\0\0\0\0!").hexdigest()}

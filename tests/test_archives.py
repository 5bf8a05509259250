"""Members of archives read in place; hostile ones are refused."""

import io
import tarfile
import zipfile

import pytest

from trellis.sources import archives as A
from trellis.sources.readers import BadInput

FILES = {"data/b.txt": b"text", "data/a.jsonl": b'{"x": 1}\n', "README.md": b"read me", "docs/c.MD": "é".encode(), "t.csv": b"a,b\n", "bin/x.bin": bytes(range(256)), "sub/README.md": b"", "empty.txt": b""}


def zipped(path, files=FILES):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.mkdir("data")
        for name, content in files.items():
            z.writestr(name, content)
    return str(path)


def tarred(path, files=FILES, extra=()):
    with tarfile.open(path, "w:gz") as t:
        for name, content in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(content)
            t.addfile(info, io.BytesIO(content))
        for info in extra:
            t.addfile(info)
    return str(path)


@pytest.mark.parametrize("make", [zipped, tarred])
def test_members_are_read_in_place(spark, tmp_path, make):
    path = make(tmp_path / "archive")
    got = A.members(spark, path)
    assert {r.name: bytes(r.content) for r in got.collect()} == FILES and got.rdd.getNumPartitions() == len(FILES)
    found = A.candidates(spark, path).collect()
    assert [r.name for r in found] == ["data/a.jsonl", "t.csv", "data/b.txt", "empty.txt", "docs/c.MD"] and found[-1].text == "é"
    assert sorted(p.name for p in tmp_path.iterdir()) == ["archive"]


@pytest.mark.parametrize("name", ["../x.txt", "a/../../x.txt", "/etc/x.txt", "..\\x.txt", "C:/x.txt", "\\x.txt"])
@pytest.mark.parametrize("make", [zipped, tarred])
def test_hostile_names(tmp_path, make, name):
    reader = A.ArchiveReader({"path": make(tmp_path / "archive", {"good.txt": b"x", name: b"y"})})
    with pytest.raises(BadInput, match="unsafe archive member path"):
        reader.partitions()


def test_links_sizes_and_repeats(spark, tmp_path):
    link = tarfile.TarInfo("link.txt")
    link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
    with pytest.raises(BadInput, match="is no file"):
        A.ArchiveReader({"path": tarred(tmp_path / "a", extra=[link])}).partitions()
    with zipfile.ZipFile(tmp_path / "b", "w") as z:
        info = zipfile.ZipInfo("link.txt")
        info.external_attr = 0o120777 << 16
        z.writestr(info, "/etc/passwd")
    with pytest.raises(BadInput, match="is a link"):
        A.ArchiveReader({"path": str(tmp_path / "b")}).partitions()
    bomb = zipped(tmp_path / "c", {"big.txt": b"0" * 100_000})
    with pytest.raises(BadInput, match="members are too large"):
        A.ArchiveReader({"path": bomb, "member_bytes": "1000"}).partitions()
    with pytest.raises(BadInput, match="archive is too large"):
        A.ArchiveReader({"path": zipped(tmp_path / "d"), "total_bytes": "10"}).partitions()
    with pytest.raises(Exception, match="unsafe archive member path"):
        A.members(spark, tarred(tmp_path / "e", {"../x": b""})).collect()
    assert A.members(spark, tarred(tmp_path / "f", {})).collect() == []

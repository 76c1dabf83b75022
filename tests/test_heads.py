"""First lines by range are the first lines of a whole scan."""

import gzip

import pytest

from vigilake.sources import heads
from vigilake.sources.formats import head_lines
from vigilake.sources.lines import scan_text


@pytest.fixture
def folder(tmp_path):
    texts = {"plain.log": "a\nb\n", "open end.log": "a\r\nb\rc", "100%[x].log": "x\n\n" * 40, "empty.log": "", "one.log": "y" * 200_000,
             "long.log": "".join(f"{n} {'z' * 5000}\r\n" for n in range(120)), "blank.log": "\n" * 300 + "late\nmore\n", "ä.log": "é\nü\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "packed.log.gz").write_bytes(gzip.compress(b"g1\ng2\n"))
    return str(tmp_path)


def test_same_lines_as_a_scan(spark, folder):
    def first(lines, n):
        rows = head_lines(lines, n).orderBy("source_file", "line_no").collect()
        return [(r.source_file, r.line_no, r.value) for r in rows]

    assert first(heads.head_scan(spark, folder, 50), 50) == first(scan_text(spark, folder), 50) != []
    spark.conf.set(heads.DIRECT_SETTING, "nothing")
    try:
        assert first(heads.head_scan(spark, folder), 50) == first(scan_text(spark, folder), 50)
    finally:
        spark.conf.unset(heads.DIRECT_SETTING)


def test_only_the_first_blocks_are_read(tmp_path):
    path = tmp_path / "big.log"
    path.write_bytes(b"line of a log\n" * 1_000_000)
    assert 50 <= len(heads.first_lines(f"file://{path}", 50)) < 10_000
    path.write_bytes(b"\n" * 200_000 + b"one\ntwo\n")
    assert heads.first_lines(f"file://{path}", 50)[-2:] == [b"one", b"two"]


def test_manifest(spark, folder):
    files = {r.source_file: r.length for r in heads.manifest(spark, folder).collect()}
    assert len(files) == 8 and min(files.values()) > 0  # a scan leaves empty files out
    assert any("100%25%5Bx%5D.log" in f or "100%25[x].log" in f for f in files)

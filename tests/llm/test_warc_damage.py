"""Damaged archives: every other record is still read; archives as files."""

import random

import pytest

from vistaquad.llm import warc


def archive(n=20):
    rng = random.Random(4)
    made = [warc.record(str(i), f"http://x/{i}", bytes(rng.choice(b"abcdefgh <>\n") for _ in range(rng.randint(0, 4000))) + warc.MAGIC * (i % 3), None) for i in range(n)]
    return made, b"".join(made)


def read(spark, *contents):
    rows = spark.createDataFrame([(str(i), bytes(c)) for i, c in enumerate(contents)], "path string, content binary")
    return warc.read_warc(rows).collect()


@pytest.mark.parametrize("record", [0, 7, 19])
@pytest.mark.parametrize("place", [0.0, 0.2, 0.5, 0.9, 1.0])
def test_one_flipped_byte_costs_one_record(spark, record, place):
    made, whole = archive()
    begin = sum(map(len, made[:record]))
    broken = bytearray(whole)
    broken[begin + int(place * (len(made[record]) - 1))] ^= 0x55
    rows = read(spark, broken)
    good = {r.record_id for r in rows if r.valid}
    assert good >= {str(i) for i in range(20)} - {str(record)} and len(rows) == 20


def test_cut_and_foreign_bytes(spark):
    made, whole = archive(5)
    rows = read(spark, whole[:-30], b"no archive at all", whole + b"\x1f\x8b\x08 trailing", b"junk" + whole, b"")
    assert sorted(r.record_id for r in rows if r.valid) == sorted([str(i) for i in range(4)] + [str(i) for i in range(5)] * 2)
    assert sum(not r.valid for r in rows) == 4


def test_files(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", "<p>" + "same text " * (200 if i % 2 else 1)) for i in range(30)] + [(50, None, None)], "page_id long, url string, html string").repartition(3)
    warc.write_warc_files(pages, str(tmp_path / "out"))
    found = list((tmp_path / "out").glob("*"))
    assert found and all(f.name.endswith(".warc.gz") for f in found)
    rows = warc.read_warc(spark.read.format("binaryFile").load(str(tmp_path / "out"))).collect()
    assert len(rows) == 31 and all(r.valid for r in rows) and {r.record_type for r in rows} == {"response", "revisit"}
    import gzip

    assert sum(gzip.decompress(f.read_bytes()).count(b"WARC/1.1\r\n") for f in found) == 31

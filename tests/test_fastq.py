"""FASTQ whatever the splits: empty reads, qualities that begin with ``@``, CRLF, blank ends, shards, broken files."""

import random

import pytest

from kmerflow import sources


def made(rng, n, name):
    out = []
    for k in range(n):
        size = rng.choice([0, 0, 1, 3, 9])
        out.append((f"{name}{k}/1", "".join(rng.choice("ACGT") for _ in range(size)), "".join(rng.choice("@@+I") for _ in range(size))))
    return out


def text_of(records, eol):
    return "".join(f"@{i} more{eol}{s}{eol}+{eol}{q}{eol}" for i, s, q in records)


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "60b", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("eol", ["\n", "\r\n"])
def test_any_split(spark, tmp_path, small_splits, eol):
    rng, want = random.Random(len(eol)), []
    for shard, name in enumerate("abc"):
        records = made(rng, 40, name)
        (tmp_path / f"{name}.fq").write_text(text_of(records, eol) + eol * shard, newline="")
        want += [(shard, k, len(want) + k, *r) for k, r in enumerate(records)] if not want else [(shard, k, want[-1][2] + 1 + k, *r) for k, r in enumerate(records)]
    got = sources.read_fastq(spark, str(tmp_path)).select("shard", "read_no", "number", "id", "sequence", "quality")
    assert sorted(map(tuple, got.collect())) == want


def test_no_line_end_at_the_end_and_empty_files(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@x\nAC\n+\n@I")
    (tmp_path / "b.fq").write_text("")
    (tmp_path / "c.fq").write_text("\n")
    (tmp_path / "d.fq").write_text("@e\n\n+\n\n")
    got = sources.read_fastq(spark, str(tmp_path)).select("id", "sequence", "quality").collect()
    assert sorted(map(tuple, got)) == [("e", "", ""), ("x", "AC", "@I")]


@pytest.mark.parametrize("text", ["@a\nAC\n+\nII\n@b\nAC\nII\n", "@a\nACG\n+\nII\n", "@a\nAC\n+\n@c\nAC\n+\nII\n", "@a\nAC\n+"])
def test_broken_records_raise(spark, tmp_path, text):
    (tmp_path / "a.fq").write_text(text)
    with pytest.raises(Exception, match="record of four lines|differ in length"):
        sources.read_fastq(spark, str(tmp_path)).collect()


def test_shards_pair_by_name(spark, tmp_path):
    for side in "12":
        (tmp_path / side).mkdir()
        for shard in "ab":
            n = 5 if shard == "a" else 3 + int(side)
            (tmp_path / side / f"{shard}_R{side}.fq").write_text(text_of([(f"{shard}{k}/{side}", "A" * (k % 3), "I" * (k % 3)) for k in range(n)], "\n"))
    r1, r2 = (sources.read_fastq(spark, str(tmp_path / side)) for side in "12")
    got = sorted(map(tuple, sources.interleave_pairs(r1, r2).select("shard", "read_no", "mate", "id").collect()))
    want = [(s, k, m, f"{'ab'[s]}{k}_{m}") for s in (0, 1) for k in range(5 if s == 0 else 4) for m in (1, 2)]
    assert got == want

"""Digests of files read in segments."""

import gzip
import hashlib
import random

from ledgerlens.sources import digests, inventory


def test_large_files_are_hashed_in_segments(spark, tmp_path):
    rng = random.Random(7)
    noise = rng.randbytes(70_000)
    texts = {
        "noise": noise, "ends.bin": noise + b"\n", "blank [1].bin": noise + b"\n\n\n",
        "bom.csv": digests.BOM + b"a,b\r\n1,2\n" * 900, "bom2.csv": digests.BOM + b"a\n" * 9000 + b"b",
        "one line": b"x" * 30_000, "feeds": b"\n" * 20_000, "few": b"a\n",
        "packed.csv.gz": gzip.compress(noise),
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text)
    raw = spark.read.format("binaryFile").load(str(tmp_path))
    rows = digests.digests(raw, whole=1000, segment=8192).collect()
    found = {r["path"].split("/")[-1]: (r["bytes"], r["sha256"]) for r in rows}
    assert found == {n: (len(t), hashlib.sha256(t).hexdigest()) for n, t in texts.items()}
    assert len(rows) == len(texts)


def test_no_task_reads_a_large_file_whole(spark, tmp_path, monkeypatch):
    text = random.Random(8).randbytes(200_000)
    (tmp_path / "a.bin").write_bytes(text)
    monkeypatch.setattr(digests, "WHOLE", 0)
    seen, run = [], type(spark.sparkContext).runJob

    def counted(self, rdd, function, partitions=None, allowLocal=False):
        seen.append((rdd.getNumPartitions(), partitions))
        return run(self, rdd, function, partitions, allowLocal)

    monkeypatch.setattr(type(spark.sparkContext), "runJob", counted)
    raw = spark.read.format("binaryFile").load(str(tmp_path))
    row, = digests.digests(raw, whole=0, segment=50_000).collect()
    assert row["sha256"] == hashlib.sha256(text).hexdigest()
    assert seen == [(4, [k]) for k in range(4)]
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "100000")
    try:  # below the reader's limit on whole files
        listed = inventory.files(spark, str(tmp_path))
        monkeypatch.undo()
        assert digests.digests(raw, whole=0).first()["sha256"] == row["sha256"]
        assert listed.columns == ["name", "bytes", "sha256"]
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")

"""Ranged reads of files on disk, and the mail folder as a stream that is stopped and started again."""

import hashlib
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from docengine.operators import catalog as C
from docengine.sources import ranges


def gguf(pairs):
    text = lambda s: struct.pack("<Q", len(s.encode())) + s.encode()
    return b"GGUF" + struct.pack("<IQQ", 3, 0, len(pairs)) + b"".join(text(k) + struct.pack("<I", 8) + text(v) for k, v in pairs)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at, rng = tmp_path_factory.mktemp("models"), random.Random(1)
    (at / "empty.bin").write_bytes(b"")
    (at / "odd.bin").write_bytes(rng.randbytes(10_007))
    (at / "long.gguf").write_bytes(gguf([("general.architecture", "llama"), ("tokens", "x" * 200_000), ("general.name", "Deep 7B")]) + b"\0" * 300_000)
    (at / "cut.gguf").write_bytes(gguf([("general.architecture", "llama"), ("tokens", "x" * 5000)])[:3000])
    head = json.dumps({f"layer.{i}": {"dtype": "F16", "shape": [1], "data_offsets": [0, 2]} for i in range(4000)}).encode()
    (at / "w.safetensors").write_bytes(struct.pack("<Q", len(head)) + head + b"\1" * 50_000)
    (at / "inner").mkdir()
    (at / "inner" / "deep.bin").write_bytes(b"deep")
    return at


def test_pieces_make_the_files(spark, folder):
    got = ranges.connect(spark, "file_ranges", path=folder, range_bytes=100_000, piece_bytes=33_000)
    files = {}
    for r in got.collect():
        assert len(r.content) <= 33_000
        files.setdefault(r.path, []).append((r.start, bytes(r.content)))
    whole = {p.rsplit("/", 1)[1]: b"".join(c for _, c in sorted(parts)) for p, parts in files.items()}
    assert whole == {p.name: p.read_bytes() for p in folder.iterdir() if p.is_file() and p.stat().st_size}
    assert got.rdd.getNumPartitions() > 5  # one file is many ranges


def test_heads_grow_until_they_are_whole(spark, folder):
    got = {r.path.rsplit("/", 1)[1]: r for r in ranges.connect(spark, "file_heads", path=f"file://{folder}", head_bytes=1024).collect()}
    assert got["long.gguf"].whole and len(got["long.gguf"].content) < 500_000
    assert got["w.safetensors"].whole and json.loads(bytes(got["w.safetensors"].content[8:]))["layer.3999"]
    assert len(got["odd.bin"].content) == 1024 and got["odd.bin"].whole and got["empty.bin"].content == b""
    assert len(got["cut.gguf"].content) == 3000  # the file itself is cut
    short = {r.path.rsplit("/", 1)[1]: r.whole for r in ranges.connect(spark, "file_heads", path=folder, head_bytes=1024, most_bytes=4096).collect()}
    assert not short["long.gguf"] and not short["w.safetensors"]
    heads = ranges.connect(spark, "file_heads", path=folder, name=r"\.gguf$", head_bytes=1024)
    kinds = heads.select(F.substring_index("path", "/", -1).alias("name"), C.gguf_metadata(F.col("content")).alias("m")).select("name", C.classify_gguf(F.col("m"), F.col("name")).alias("c"), F.col("m").isNull().alias("bad"))
    assert {(r.name, r.c.arch, r.c.params, r.bad) for r in kinds.collect()} >= {("long.gguf", "llama", kinds.where("name = 'long.gguf'").first().c.params, False)}


def test_digests(spark, folder):
    got = {r.path.rsplit("/", 1)[1]: (r.size, r.sha256) for r in ranges.connect(spark, "file_digests", path=folder, recursive=True).collect()}
    assert got == {p.name: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in folder.rglob("*") if p.is_file()}
    assert ranges.connect(spark, "file_digests", path=folder / "nowhere").count() == 0


def test_unknown_connector(spark):
    with pytest.raises(ValueError, match="mail_folder"):
        ranges.connect(spark, "nothing")


def test_mail_folder_is_read_once_over_restarts(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()
    mail = lambda uid: (box / f"{uid}.eml").write_bytes(f"Subject: mail {uid}\n\nbody".encode())

    def sync():
        s = ranges.connect(spark, "mail_folder", stream=True, path=box, since_uid=2)
        q = s.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.uid, bytes(r.content).decode()[9:].split("\n")[0]) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())

    for uid in (1, 2, 3, 10):
        mail(uid)
    (box / "note.txt").write_text("no mail")
    assert sync() == [(3, "mail 3"), (10, "mail 10")]
    assert sync() == [(3, "mail 3"), (10, "mail 10")]
    for uid in (11, 12):
        mail(uid)
    assert sync() == [(u, f"mail {u}") for u in (3, 10, 11, 12)]

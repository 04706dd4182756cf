"""Upload folders as a data source."""

import io
import os
import time

from docsheaf.sources import files, uploads


class Counted(io.BytesIO):
    asked = 0

    def read(self, n=-1):
        self.asked += n
        return super().read(n)


def test_only_heads_are_read():
    for body, head in ((b"%PDF-1.7" + b"x" * 10**6, b"%PDF"), (b" \n\t" * 2000 + b"%PDF", b"%PDF"), (b"", b""), (b" " * 5000, b""), (b"\xff\x00", b"\xff\x00")):
        stream = Counted(body)
        assert files.head_of(stream).startswith(head) and stream.asked <= 1024 * (2 + len(body) // 1024 if body[:1].isspace() else 2)


def written(folder, names):
    for name, body in names.items():
        target = folder / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(body)


def test_batches_of_files(spark, tmp_path):
    written(tmp_path, {"a/x.pdf": b"  %PDF-1.4 " + b"y" * 5000, "a/X.PDF": b"%PDF", "a/empty.png": b"", "b/no.pdf": b"plain", "b/é picture.png": b"\x89PNG", "b/c/deep.txt": b"text"})
    accepted, rejected = uploads.scan_uploads(spark, str(tmp_path))
    assert sorted((r.batch, r.name, r.kind) for r in accepted.collect()) == [("a", "X.PDF", "pdf"), ("a", "x (2).pdf", "pdf"), ("b", "é picture.png", "image")]
    assert sorted((r.name, r.reason) for r in rejected.collect()) == [("deep.txt", "type not allowed"), ("empty.png", "empty file"), ("no.pdf", "not a PDF file")]
    assert {r.size for r in files.upload_heads(spark, f"file://{tmp_path}").collect()} == {5011, 4, 0, 5}
    assert files.upload_heads(spark, f"{tmp_path}/none").count() == 0


def test_stream_gives_each_file_once(spark, tmp_path):
    folder, old = tmp_path / "in", time.time() - 100
    written(folder, {f"a/{k}.png": b"\x89PNG" for k in range(3)})
    for k in range(3):
        os.utime(folder / f"a/{k}.png", (old + k, old + k))

    def run():
        heads = files.upload_heads(spark, str(folder), stream=True)
        heads.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted(r.path.rsplit("/", 1)[1] for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run() == ["0.png", "1.png", "2.png"]
    written(folder, {"b/late.png": b"x", "b/new.png": b"y"})
    os.utime(folder / "b/late.png", (old + 50, old + 50))
    assert run() == ["0.png", "1.png", "2.png", "late.png"]  # new.png is too young
    os.utime(folder / "b/new.png", (old + 60, old + 60))
    assert run() == ["0.png", "1.png", "2.png", "late.png", "new.png"] == run()

"""Results that outlive lost tasks and restarts: the ledger of readers and the ordered event lines."""

import json
import os
import random
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest

from docsheaf.functions.readers import batch_read, ledger_read
from docsheaf.sources import uploads
from docsheaf.streaming import ordered

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def test_no_page_is_read_twice_when_a_task_is_lost(spark, tmp_path):
    """The reader notes its calls; once, in the middle, it kills the worker process, which ends the job. The second try
    reads only what the first one hadn't finished, and a later run nothing but what had failed."""
    calls, fuse = tmp_path / "calls", tmp_path / "fuse"
    calls.mkdir()
    fuse.write_text("")

    def reader(content, attempt):
        if content == "page 17" and fuse.exists():
            fuse.unlink()
            os._exit(1)
        (calls / f"{content} {attempt} {os.urandom(4).hex()}").write_text("")
        if content == "page 3":
            raise ValueError("unreadable")
        return {"text": "" if content == "page 5" and attempt == 1 else content.upper(), "finish": "stop"}

    def made():
        return sorted(p.name.rsplit(" ", 1)[0] for p in calls.iterdir())

    pages = spark.createDataFrame([(k, f"page {k % 25}") for k in range(40)], "k int, content string")
    df = ledger_read(pages, "k", "content", reader, str(tmp_path / "ledger"), partitions=1)
    with pytest.raises(Exception):
        df.collect()
    first = made()
    assert 0 < len(first) < 28
    rows = df.select("*").collect()  # a new plan: the old one keeps its failure
    assert len(made()) == len(set(made())) == 23 + 2 + 3 and set(first) < set(made())  # page 5 is read twice, page 3 three times
    want = [(k, 1, f"PAGE {k % 25}", None) for k in range(40) if k % 25 not in (3, 5)] + [(k, a, "PAGE 5" if a == 2 else "", None) for k in (5, 30) for a in (1, 2)] + [(k, a, None, "unreadable") for k in (3, 28) for a in (1, 2, 3)]
    assert sorted(map(str, ((r.k, r.attempt, r.text, r.error) for r in rows))) == sorted(map(str, want))
    df.select("*").collect()
    assert len(made()) == 28
    later = ledger_read(pages, "k", "content", reader, str(tmp_path / "ledger"), partitions=1)
    assert {(r.k, r.attempt, r.text) for r in later.collect()} == {(r.k, r.attempt, r.text) for r in rows} and len(made()) == 31
    other = ledger_read(pages.filter("k = 1"), "k", "content", reader, str(tmp_path / "ledger"), variant="tile")
    assert other.count() == 1 and len(made()) == 32


def test_ledger_rows_are_those_of_a_plain_read(spark, tmp_path):
    def reader(content, attempt):
        if content is None or len(content) % 7 == 0:
            raise ValueError("no")
        return {"text": content if attempt > len(content) % 3 else "", "finish": "length" if len(content) == 5 else "stop"}

    pages = spark.createDataFrame([(k, None if k == 3 else "x" * (k % 11)) for k in range(30)], "k int, content string")
    plain = sorted(map(str, batch_read(pages, "k", "content", reader).collect()))
    for flush in (1, 4):
        assert sorted(map(str, ledger_read(pages, "k", "content", reader, str(tmp_path / f"l{flush}"), flush=flush).collect())) == plain
    assert ledger_read(pages.limit(0), "k", "content", reader, str(tmp_path / "empty")).count() == 0


def test_lines_stay_in_order_over_batches_and_a_restart(spark, tmp_path):
    rng = random.Random(7)
    rows = [(f"t{t}", s, START + timedelta(seconds=s), f"{t}-{s}", s == 39) for t in range(6) for s in range(40)]
    rng.shuffle(rows)
    schema = "turn string, seq long, at timestamp, kind string, last boolean"

    def add(part, number):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{number}")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in").withWatermark("at", "1 day")
        uploads.stream_events_ndjson(ordered.in_order(stream, "turn", "kind string").drop("at"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()

    for k in range(2):
        add(rows[60 * k : 60 * k + 60], k)
    run()
    for k in range(2, 4):
        add(rows[60 * k : 60 * k + 60], k)
    run()  # from the checkpoint
    found = {}
    for file in sorted(Path(f"{tmp_path}/out").glob("batch=*/*.json")):
        for line in file.read_text().splitlines():
            event = json.loads(line)
            found.setdefault(event["turn"], []).append(event["seq"])
    assert found == {f"t{t}": list(range(40)) for t in range(6)}
    assert len(list(Path(f"{tmp_path}/out").glob("batch=*"))) >= 4

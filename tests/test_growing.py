"""Offsets and pieces of growing files, without a session; every line once, whatever the cuts."""

import io
import random

import pyarrow as pa

from spendmart.sources import growing
from spendmart.sources.growing import _Reader, lines_of, pieces_between


def texts(rng):
    return b"".join(bytes(rng.choices(b"ab", k=rng.randint(0, 9))) + rng.choice([b"\n", b"\r\n"]) for _ in range(rng.randint(0, 30)))


def test_every_line_is_in_one_piece():
    rng = random.Random(5)
    for _ in range(300):
        text, size = texts(rng), rng.randint(1, 40)
        want, at = [], 0
        for line in io.BytesIO(text).readlines():
            want.append((at, line))
            at += len(line)
        tasks = pieces_between({}, {"f": len(text)}, size)
        got = [x for task in tasks for p in task for x in lines_of(pa.BufferReader(text), p)]
        assert got == want


def test_small_files_share_a_task_and_large_ones_are_cut():
    tasks = pieces_between({"a": 10, "d": 50}, {"a": 10, "b": 5, "c": 5, "d": 20, "e": 250}, 100)
    assert [[(p.path, p.start, p.stop, p.first) for p in t] for t in tasks] == [
        [("b", 0, 5, True), ("c", 0, 5, True), ("d", 0, 20, True)],  # d was replaced by a shorter file
        [("e", 0, 100, True)], [("e", 100, 200, False)], [("e", 200, 250, False)],
    ]


def read(reader, start, end):
    return [row for task in reader.partitions(start, end) for batch in reader.read(task) for row in batch.to_pylist()]


def test_a_torn_tail_waits_and_a_retry_reads_the_same(tmp_path, monkeypatch):
    monkeypatch.setattr(growing, "_TAIL", 4)
    file = tmp_path / "p" / "s.jsonl"
    file.parent.mkdir()
    (tmp_path / "p" / "other.txt").write_text("no\n")
    reader = _Reader({"path": str(tmp_path)})
    file.write_bytes(b"a long torn tail without an end")
    assert reader.latestOffset() == {}
    file.write_bytes(b"one\ntwo\nthr")
    first = reader.latestOffset()
    assert first == {"p/s.jsonl": 8} and reader.latestOffset() == first
    file.write_bytes(b"one\ntwo\nthree\n")
    fresh = _Reader({"path": str(tmp_path)})  # as after a restart
    second = fresh.latestOffset()
    assert second == reader.latestOffset() == {"p/s.jsonl": 14}
    assert [r["value"] for r in read(reader, {}, first)] == [r["value"] for r in read(fresh, {}, first)] == ["one", "two"]
    assert [(r["block"], r["line"], r["value"]) for r in read(fresh, first, second)] == [(8, 8, "three")]


def test_a_missing_folder_has_no_lines(tmp_path):
    assert _Reader({"path": str(tmp_path / "none")}).latestOffset() == {}

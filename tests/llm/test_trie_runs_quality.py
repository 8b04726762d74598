"""The prefix trie, periodic runs and quality, as registered and by themselves, against brute force over awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from spendmart.llm import periodic, prefix_trie, quality, queries
from spendmart.llm import textbytes as tb

rng = random.Random(21)
SHA = lambda text: hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- prefix trie


def trie_by_force(rebuilt):
    members, kids, leaves, saved = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    for k in members:
        value = (len(members[k]) - 1) * len(k[-1][1]) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += value
            leaves[k[:d]] += not kids[k]
    return sorted(
        ((m[0], len(k), members[k[:-1]][0] if k else None, len(m), kids[k], leaves[k], saved[k], SHA(",".join(str(c) for c in m if len(rebuilt[c]) == len(k)))) for k, m in members.items()),
        key=str,
    )


def rebuild(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: tuple(own.get(c - int(math.fmod(c, 100)), [])[: h[c]] + own[c][h[c] :]) for c in own}


def conversations():
    rows = [(None, 0, "user", "of nobody"), (7, None, None, None), (7, 3, "user", ""), (-105, 1, "user", "é😀"), (-100, 0, "user", "é😀")]
    for c in range(0, 460, 3):
        for turn in range(rng.randint(1, 9)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["yes", "no", "why", "w" * 40])))
    hot = [(1000 + k, t, "user", f"the same {t}") for k in range(120) for t in range(7)]
    return rows + hot


SCHEMA = "conv_id long, turn long, role string, text string, hi string, n long"


def save(spark, rows, folder, name, schema, *extra):
    rows = [tuple(r) + extra for r in rows]
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(f"{folder}/{name}.parquet")


def test_prefix_trie_as_registered(spark, tmp_path):
    rows = conversations()
    save(spark, rows, tmp_path, "conversations", SCHEMA, "clash", 5)
    got = sorted(map(tuple, queries.QUERIES["op12_prefix_trie"](spark, str(tmp_path)).collect()), key=str)
    assert got == trie_by_force(rebuild(rows))


def test_prefix_trie_of_long_conversations(spark, tmp_path):
    """Conversations of several parts, copies of them, and one that leaves them deep down."""
    long = [("user", f"turn {t % 50}") for t in range(2600)]
    rows = [(c, 3 * t, *long[t]) for c in (1, 2, 5) for t in range(2600)]
    rows += [(9, t, *long[t]) for t in range(2100)] + [(9, 2100 + t, "user", "elsewhere") for t in range(300)] + [(11, 0, "user", "alone")]
    rows += [(12, None, *long[0])]
    blocks = prefix_trie.turn_blocks(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = sorted(map(tuple, prefix_trie.prefix_nodes(blocks.withColumnRenamed("before", "start")).collect()), key=str)
    whole = tuple(long)
    sequences = {1: whole, 2: whole, 5: whole, 9: whole[:2100] + (("user", "elsewhere"),) * 300, 11: (("user", "alone"),), 12: whole[:1]}
    members = defaultdict(list)
    for c, s in sorted(sequences.items()):
        for d in range(len(s) + 1):
            members[d, c if d > 2100 and c == 9 else c if c == 11 and d else 0].append(c)
    assert len(got) == len(members) == 2601 + 300 + 1
    saved = {0: 0}
    for d in range(2600, 0, -1):
        n = len(members[d, 0])
        saved[d] = saved.get(d + 1, 0) + (n - 1) * len(long[d - 1][1])
    by_place = {(g[1], g[3] if g[1] <= 2100 else g[0]): g for g in got if g[0] != 11}
    for d in (1, 2, 1023, 1024, 1025, 2048, 2049, 2100):
        g = by_place[d, len(members[d, 0])]
        assert g[4:7] == (2 if d == 2100 else 1, 2, saved[d]), d
    assert by_place[2600, 1] == (1, 2600, 1, 3, 0, 1, 2 * len(long[-1][1]), SHA("1,2,5"))
    assert by_place[2400, 9] == (9, 2400, 9, 1, 0, 1, 0, SHA("9"))
    assert by_place[2101, 9][2] == 1
    root = next(g for g in got if g[1] == 0)
    assert root == (1, 0, None, 6, 2, 3, saved[1], SHA(""))


def test_prefix_trie_of_nothing(spark):
    blocks = prefix_trie.turn_blocks(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert prefix_trie.prefix_nodes(blocks.withColumnRenamed("before", "start")).count() == 0


def test_radix_layouts_grow():
    root = prefix_trie.Node(b"")
    keys = [bytes([a, 7, b]) for a in range(256) for b in (1, 2)] + [bytes([3, 7]), b"", bytes([3])]
    for i, key in enumerate(keys):
        prefix_trie.insert(root, key, i)
    assert root.layout == 256 and sum(1 for _ in root.children()) == 256
    for i, key in enumerate(keys):
        node, at = root, 0
        while at < len(key):
            node, at = node.child(key[at]), at + 1
            assert key.startswith(node.path, at)
            at += len(node.path)
        assert i in node.ends
    sizes = []
    node = prefix_trie.Node(b"")
    for byte in range(60):
        prefix_trie.insert(node, bytes([byte]), byte)
        sizes.append(node.layout)
    assert sorted(set(sizes)) == [4, 16, 48, 256] and sizes[3] == 4 and sizes[4] == 16 and sizes[16] == 48 and sizes[48] == 256


# ---------------------------------------------------------------- periodic runs


def runs_by_force(words, exponent, least):
    found, n = {}, len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(least, exponent * q):
                found.setdefault((start, length), q)
    return sorted((s, q, length) for (s, length), q in found.items())


def query_by_force(doc_id, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        if h % 10 == 0:
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_by_force(words, 4, 6)
    drop = {i for s, q, length in runs for i in range(s + q, s + length)}
    best = None
    for s, q, length in runs:
        if best is None or length * best[1] > best[2] * q:
            best = s, q, length
    top = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    return (doc_id, len(runs), *top, SHA("".join(f"{s},{length},{q}\n" for s, q, length in runs)), SHA(" ".join(w for i, w in enumerate(words) if i not in drop)))


def texts():
    loops = [" ".join((["a", "b", "c"][: rng.randint(1, 3)] * 40)[: rng.randint(1, 90)]) for _ in range(30)]
    nested = " ".join(("x y x y x y x y z " * 5 + "q " + "m m m m m m m n " * 6).split())
    prose = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(80)]
    rows = list(enumerate([None, "", " \t\n", "one", nested, "é é é é é é é é", "w " * 3000, " ".join(map(str, range(4000))) + " k l" * 2000, *loops, *prose]))
    return rows + rows[:30] + [(None, nested), (None, None), (-3, nested)] + [(k, f"first {nested} last") for k in range(10**6, 10**6 + 60)]


def test_periodic_runs_as_registered(spark, tmp_path):
    rows = texts()
    save(spark, rows, tmp_path, "documents", "doc_id long, text string, runs string, h string, w int", "x", "y", 3)
    got = sorted(map(tuple, queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((query_by_force(*r) for r in rows), key=str)


@pytest.mark.parametrize("batch", [1, 7, 64, 10**6])
def test_catching_is_online(batch):
    """However the words are appended, the runs are the same; other exponents too."""
    for exponent, least in ((2, 2), (3, 1), (4, 6)):
        for _ in range(15):
            words = [rng.choice("ab" if rng.random() < 0.8 else "abc") for _ in range(rng.randint(0, 120))]
            rows = [" ".join(words), "a " * 9, ""]
            data = np.frombuffer("".join(rows).encode(), np.uint8)
            chunk = tb.Chunk(0, 3, data, np.cumsum([0, *map(len, rows)]))
            row, start, length, period = periodic.runs_of(tb.words(chunk), exponent, least, batch=batch)
            got = sorted(zip(start[row == 0].tolist(), period[row == 0].tolist(), length[row == 0].tolist()))
            assert got == runs_by_force(words, exponent, least)
            assert list(zip(row[row > 0], start[row > 0], period[row > 0], length[row > 0])) == [(1, 0, 1, 9)]


def test_periodic_runs_interface(spark):
    docs = spark.createDataFrame([(1, "go go go go go go on", "kept")], "doc_id long, text string, start string")
    row = periodic.periodic_runs(docs, keep=["doc_id", "start"]).first()
    assert row.n_words == 7 and [tuple(r) for r in row.runs] == [(0, 6, 1)] and row.collapsed_text == "go on" and row.start == "kept"
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs.withColumnRenamed("start", "runs"), keep=["runs"])


# ---------------------------------------------------------------- quality


def labelled(n=600):
    rows, labels = [], []
    for k in range(n):
        good = k % 4 > 0
        words = [rng.choice(["river", "stone", "under", "light", "and", "the", "of"]) + rng.choice(["", "s", "ed"]) for _ in range(rng.randint(20, 200))]
        text = ". ".join(words) if good else rng.choice([" ".join(words[:2] * 60), "!! ".join(words).upper(), " | ".join(words)])
        rows.append((k, text))
        if k % 3 != 2:
            labels.append((k, int(good)))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "x" * 300_000), (5004, "word " * 50_000), (None, "no id"), (3, "shares an id"), (3, "shares an id")]
    labels += labels[:40] + [(0, 1), (None, 1), (9, None), (12, 7), (99999, 1)]  # repeated, contradicted, useless
    return rows, labels


def fold(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_quality_as_registered(spark, tmp_path):
    rows, labels = labelled()
    save(spark, rows, tmp_path, "documents", "doc_id long, text string, score string, stats string", "x", "y")
    save(spark, labels, tmp_path, "labels", "doc_id long, quality int, toxic int, text string", 0, "z")
    got = queries.QUERIES["op11_quality"](spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    assert all(r.held_out == fold(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    truth = {k: k % 4 > 0 for k in range(600)}
    told = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(told) > 80 and sum(r.predicted == truth[r.doc_id] for r in told) / len(told) > 0.97
    # labels of held-out documents are never learned from
    flipped = [(k, 1 - q if k is not None and q in (0, 1) and fold(k) else q) for k, q in labels]
    save(spark, rows, tmp_path / "b", "documents", "doc_id long, text string")
    save(spark, flipped, tmp_path / "b", "labels", "doc_id long, quality int, toxic int", 0)
    again = {r.doc_id: r.score for r in queries.QUERIES["op11_quality"](spark, str(tmp_path / "b")).collect() if r.doc_id not in (3, None)}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in got if r.doc_id not in (3, None))


def test_quality_equals_the_formulas(spark):
    """The fit against densities worked out row by row with numpy's own covariance and inverse."""
    rows, labels = labelled(240)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stats = [(r.doc_id, np.array(r.stats)) for r in quality.document_statistics(docs, ["doc_id"]).collect()]
    kinds = defaultdict(set)
    for k, q in labels:
        if k is not None and q in (0, 1):
            kinds[k].add(q)
    known = [(x, next(iter(kinds[k]))) for k, x in stats if len(kinds.get(k, ())) == 1]
    x, y = np.array([v for v, _ in known]), np.array([q for _, q in known])
    scale = np.sqrt(sum(((x[y == k] - x[y == k].mean(0)) ** 2).sum(0) for k in (0, 1)) / len(x))
    scale[scale < 1e-9] = 1
    z = [(x[y == k] - x[y == k].mean(0)) / scale for k in (0, 1)]
    pooled, d = sum(v.T @ v for v in z) / len(x), x.shape[1]
    logs = []
    for k in (0, 1):
        n, own = len(z[k]), z[k].T @ z[k] / len(z[k])
        spread = sum(((np.outer(v, v) - own) ** 2).sum() for v in z[k]) / n**2
        share = min(1, spread / ((own - np.diag(np.diag(own))) ** 2).sum())
        cov = (1 - d / (d + n)) * own + d / (d + n) * pooled
        cov = (1 - share) * cov + share * np.diag(np.diag(cov)) + quality.RIDGE * np.eye(d)
        away = (np.array([v for _, v in stats]) - x[y == k].mean(0)) / scale
        logs.append(np.log(n / len(x)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away))
    expected = 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -700, 700)))
    told = spark.createDataFrame(labels, "doc_id long, label int")
    got = sorted((str(r.doc_id), r.score) for r in quality.classify(docs, told, learn="true").collect())
    for (a, p), (b, q) in zip(got, sorted((str(k), s) for (k, _), s in zip(stats, expected))):
        assert a == b and abs(p - q) < 1e-6


def test_quality_without_both_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    one = quality.classify(docs, spark.createDataFrame([(1, 1)], "doc_id long, label int"), learn="true").collect()
    assert [r.score for r in one] == [1.0, 1.0]
    none = quality.classify(docs, spark.createDataFrame([], "doc_id long, label int"), learn="true", threshold=0.3).collect()
    assert [(r.score, r.predicted) for r in none] == [(0.5, 1), (0.5, 1)]
    assert quality.classify(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, label int"), learn="true").count() == 0
    with pytest.raises(ValueError):
        quality.classify(docs.withColumn("Score", docs.doc_id), spark.createDataFrame([], "doc_id long, label int"), learn="true", keep=["Score"])

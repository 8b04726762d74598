"""Every operator against brute force, over rows made to be awkward: nulls, empty and long texts, ties, copies, clashing names."""

import base64
import hashlib
import random
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from spendmart.llm import (
    bpe,
    components,
    decontaminate,
    hosts,
    language,
    licenses,
    ngram_join,
    permutation_index,
    substrings,
    token_files,
    toxicity,
)

rng = random.Random(5)
VOCABULARY = ["the", "of", "and", "river", "stone", "light", "paper", "green", "under", "table", "Ñandú", "ärger", "été", "x1", "don't", "42"]


def prose(n):
    return " ".join(rng.choice(VOCABULARY) + str(rng.randint(0, 9)) * rng.randint(0, 1) for _ in range(n))


PASSAGE, SHORT = prose(70), prose(49)


def awkward():
    base = prose(150)
    near = base.split()
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "One"), (6, "two words"), (None, "text without an id"), (None, None)]
    rows += [(10 + k, base) for k in range(40)]
    for k in range(40):
        words = near[:]
        for _ in range(k % 6):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
        rows.append((100 + k, " ".join(words)))
    rows += [(200 + k, f"{prose(30)} {PASSAGE}\n{prose(20)}") for k in range(12)] + [(220, f"{PASSAGE} {PASSAGE}"), (221, PASSAGE), (222, SHORT), (223, SHORT)]
    rows += [(300, prose(400)), (300, prose(400)), (301, base), (301, base), (302, prose(30_000)), (303, "w" * 300_000), (304, "a" + "\u0303 漢字 😀 'll don't \u00a0 end ")]
    rows += [(-7, prose(60) + " " + PASSAGE)]
    rng.shuffle(rows)
    return rows


ROWS = awkward()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_substrings(docs, none):
    owner = {}
    split = lambda t: (t or "").encode().split()
    for doc, text in ROWS:
        words = split(text)
        for i in range(len(words) - 49) if doc is not None else ():
            key = tuple(words[i : i + 50])
            owner[key] = min(owner.get(key, doc), doc)
    want = []
    for doc, text in ROWS:
        words = split(text)
        gone = [False] * len(words)
        for i in range(len(words) - 49) if doc is not None else ():
            if owner[tuple(words[i : i + 50])] < doc:
                gone[i : i + 50] = [True] * 50
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        want.append((doc, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in substrings.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[2] for r in want) > 1000
    assert substrings.remove_repeats(none).count() == 0


def test_substrings_keeps_other_columns(spark):
    rows = spark.createDataFrame([(1, PASSAGE, "a", 5), (2, PASSAGE + " tail", "b", None)], "doc_id long, text string, fp string, cuts int")
    got = {r.doc_id: r for r in substrings.remove_repeats(rows.drop("cuts").withColumnRenamed("fp", "source"), keep=["source"]).collect()}
    assert (got[1].n_removed, got[1].kept_text, got[2].kept_text, got[2].source, got[2].intervals) == (0, None, "tail", "b", [[0, 70]])


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_near_duplicates(docs, none, width, percent):
    def grams(text):
        words = (text or "").encode().lower().split()
        return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) or (frozenset([tuple(words)]) if words else frozenset())

    sets = [(doc, grams(text)) for doc, text in ROWS]
    up = {doc: doc for doc, _ in sets if doc is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    named = [(d, s) for d, s in sets if d is not None and s]
    for i, (a, s) in enumerate(named):
        for b, t in named[:i]:
            both = len(s & t)
            if 100 * both >= percent * (len(s) + len(t) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    want = sorted(((d, len(s), None if d is None else root(d)) for d, s in sets), key=repr)
    got = sorted((tuple(r) for r in ngram_join.near_duplicates(docs, width, percent).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert got == want
    assert ngram_join.near_duplicates(none).count() == 0


def test_near_duplicates_over_blocks(docs, monkeypatch):
    whole = sorted(map(tuple, ngram_join.near_duplicates(docs, 3, 90).collect()), key=repr)
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 700)
    monkeypatch.setattr(ngram_join, "SLOT_BYTES", 1 << 14)
    assert sorted(map(tuple, ngram_join.near_duplicates(docs, 3, 90).collect()), key=repr) == whole


def test_components(spark):
    chain = [(k + 1, k) for k in range(60)] + [(100, 101), (102, 101), (7, 7)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(chain, "u long, v long")).collect()))
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize("block_words", [decontaminate.BLOCK_WORDS, 20])
def test_decontamination(spark, docs, none, monkeypatch, block_words):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block_words)
    items = [(1, PASSAGE), (2, "two words"), (3, "ONE"), (4, None), (5, "!?"), (None, PASSAGE), (6, prose(40)), (7, " ".join(PASSAGE.split()[5:30])), (10, "never seen words here")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    words_of = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    windows = defaultdict(set)
    for item, text in items:
        words = words_of(text)
        n = min(13, len(words))
        for i in range(len(words) - n + 1) if n and item is not None else ():
            windows[tuple(words[i : i + n])].add(item)
    want = []
    for doc, text in ROWS:
        words, found = words_of(text), set()
        hit = [0] * len(words)
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if mine := windows.get(tuple(words[i : i + n])):
                    found |= mine
                    hit[i : i + n] = [1] * n
        n_hit = sum(hit)
        want.append((doc, len(words), n_hit, len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= len(words)))
    found = decontaminate.verdicts(decontaminate.benchmark_matches(docs, benchmark))
    got = [tuple(r) for r in found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    whole = found.filter("doc_id = 221").first()
    assert {"item_id": "1", "start": 0, "length": len(words_of(PASSAGE))} in [m.asDict() for m in whole.matches]
    assert decontaminate.benchmark_matches(none, benchmark).count() == 0
    assert decontaminate.verdicts(decontaminate.benchmark_matches(docs, benchmark.limit(0))).filter("contaminated OR n_hit > 0").count() == 0


def test_bpe(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for doc, text in ROWS:
        ids = [x for part in re.findall(r"(?s).{1,3000}$|^.*", text or "")[:1] for x in other.encode_ordinary(text or "")] if text and len(text) < 200_000 else None
        want.append((doc, text, ids))
    got = bpe.encode_decode(docs, path).collect()
    digest = lambda ids: hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    expected = sorted(((d, len(i), digest(i)) for d, t, i in want if i is not None), key=repr)
    small = sorted(((r.doc_id, r.n_tokens, r.ids_sha256) for r in got if r.decoded and len(r.decoded) < 200_000), key=repr)
    assert small == expected
    assert sorted((r.doc_id, r.decoded) for r in got if r.doc_id is not None) == sorted((d, t or "") for d, t in ROWS if d is not None)
    assert all(r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest() for r in got)
    assert bpe.encode_decode(none, path).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(3).integers(0, 2**64, 5000, dtype=np.uint64))
    table, slots = bpe.PerfectHash.build(keys)
    assert sorted(slots) == list(range(len(keys)))
    assert (table.find(keys) == slots).all() and (table.find(keys ^ np.uint64(1)) == -1).all()


def test_token_files(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    known = docs.filter("doc_id IS NOT NULL AND doc_id NOT IN (300, 303)")
    start, want = 0, []
    for doc, text in sorted((d, t or "") for d, t in ROWS if d is not None and d not in (300, 303)):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        want.append((doc, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    segments = token_files.write_tokens(known, path)
    assert sorted(map(tuple, token_files.read_documents(segments).collect())) == want
    assert token_files.read_documents(token_files.write_tokens(none, path)).count() == 0
    assert token_files.read_documents(token_files.write_tokens(docs, path)).count() == len(ROWS)


def test_special_token_text(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["a <|endoftext|> b", "plain"]
    segments = token_files.write_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path)
    got = [r.n_tokens for r in token_files.read_documents(segments).orderBy("doc_id").collect()]
    assert got == [len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) + 1 for t in texts]


@pytest.mark.parametrize("top", [200, 50_000, 2**32 - 1])
def test_codes_give_random_access(top):
    source = np.random.default_rng(1)
    for n in (0, 1, 8, 511, 512, 513, 3000):
        ids = source.integers(0, top, n, dtype=np.uint32)
        segment = token_files.Segment.open(token_files.pack(ids))
        assert len(segment) == n and [segment.token(i) for i in range(n)] == ids.tolist()
        for _ in range(8):
            a, b = sorted(source.integers(0, n + 1, 2))
            assert (segment.tokens(a, b) == ids[a:b]).all()


def test_language(spark, none):
    letters = {"aa": "abcdea", "bb": "fghijk", "cc": "lmnopq"}
    word = lambda lang: "".join(rng.choice(letters[lang]) for _ in range(rng.randint(2, 6)))
    text = lambda lang, n=60: " ".join(word(lang) for _ in range(n))
    rows = [(k, text(lang), lang) for k, lang in enumerate(["aa", "bb", "cc"] * 20)] + [(900, None, "aa"), (901, text("aa"), None), (902, "", "bb")]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = [(1, text("aa")), (2, text("bb") + " " + text("cc")), (3, None), (4, ""), (5, "12 -- !"), (6, "٣٤ ——"), (7, "pq mn"), (8, text("cc", 40_000)), (None, text("bb"))]
    got = {r.doc_id: r for r in language.predict(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert [got[k].lang_pred for k in (1, 3, 4, 5, 6, 7, 8, None)] == ["aa", "und", "und", "und", "und", "cc", "cc", "bb"]
    assert set(got[2].shares) == {"bb", "cc"} and 0.35 < got[2].shares["bb"] < 0.65
    assert all(0 <= r.score <= 1 for r in got.values()) and got[3].score == 0
    assert language.predict(none, model).count() == 0
    blank = language.train(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang_pred for r in language.predict(spark.createDataFrame(asked, "doc_id long, text string"), blank).collect()} == {"und"}


def test_hosts(spark):
    rules = [hosts.Rule("allow", "org/"), hosts.Rule("block", "example.org/es/"), hosts.Rule("allow", "com/fr/")]
    urls = ["HTTP://WWW.Example.ORG/es/1?q#f", "http://example.org", "https://notexample.org/es/", "x", None, "http://bad.com/a#b", "http://sub.bad.com/fr/x", "http://new.net?x=/y", "://", "a://h.co.uk:80/p?://z/", "http://good.com/a"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    outcomes = [("bad.com", 1)] * 60 + [("good.com", 0)] * 60 + [("ok.net", 0)] * 9 + [(None, 1), ("x.org", None), ("x.org", 0)]
    got = {r.page_id: r for r in hosts.judge(pages, spark.createDataFrame(outcomes, "host string, bad int"), rules).collect()}
    assert [(got[k].host, got[k].path) for k in range(len(urls))] == [
        ("www.example.org", "/es/1"), ("example.org", ""), ("notexample.org", "/es/"), ("", ""), ("", ""), ("bad.com", "/a"),
        ("sub.bad.com", "/fr/x"), ("new.net", ""), ("", ""), ("h.co.uk:80", "/p"), ("good.com", "/a"),
    ]
    assert [got[k].rule for k in range(7)] == ["example.org/es/", None, "org/", None, None, None, "com/fr/"]
    assert [got[k].verdict for k in (0, 2, 5, 6, 10)] == ["block", "allow", "block", "allow", "allow"]
    assert got[6].level == "domain" and got[7].level == "suffix" and got[3].level == "all"
    no_labels = hosts.judge(pages, spark.createDataFrame([], "host string, bad int"), []).collect()
    assert len(no_labels) == len(urls) and {r.verdict for r in no_labels} == {"allow"}
    assert hosts.judge(pages.limit(0), spark.createDataFrame(outcomes, "host string, bad int"), rules).count() == 0


def test_toxicity(spark, none):
    rows, labels = [], []
    for k in range(240):
        bad = k % 4 == 0
        words = prose(60).split()
        if bad:
            for term in rng.sample(["villainous", "wretchy", "gromsome"], 2):
                words.insert(rng.randrange(len(words)), term)
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (999, None), (998, 7)], "doc_id long, toxic int"))
    asked = [(1, "you villainous wretchy thing"), (2, "you vilainous wretchi thing"), (3, 'they said "villainous" once'), (4, prose(200)), (5, None), (6, ""), (7, prose(20_000)), (None, "gromsome villainous")]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert [got[k].predicted for k in (1, 2, 4, 5, 6, 7, None)] == [1, 1, 0, 0, 0, 0, 1]
    assert got[1].score > got[3].score and all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.score(none, model).count() == 0
    plain = toxicity.train(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.score(spark.createDataFrame(asked, "doc_id long, text string"), plain).collect()} == {0}


def distance(a, b, prefix=False):
    row = list(range(len(a) + 1))
    best = row[-1]
    for y in b:
        new = [row[0] + 1]
        for i, x in enumerate(a):
            new.append(min(new[-1] + 1, row[i + 1] + 1, row[i] + (x != y)))
        row = new
        best = min(best, row[-1])
    return best if prefix else row[-1]


def test_automaton_equals_edit_distance():
    terms = [toxicity.Term("stone", False), toxicity.Term("ston", False), toxicity.Term("grunto", True), toxicity.Term("été", False)]
    automaton = toxicity.Automaton.of(terms)
    words = ["".join(rng.choice("stonegrué") for _ in range(rng.randint(1, 9))) for _ in range(4000)] + ["stone", "stones", "grunto", "gruntoxyz", "gruntxyz", "été"]
    for word in words:
        letters = automaton.letters[[ord(c) for c in word]]
        state = automaton.run(letters, np.array([0]), np.array([len(word)]))[0]
        near = [(d, k) for k, t in enumerate(terms) if (d := distance(t.text, word, t.stem)) <= t.edits]
        assert (automaton.term[state] >= 0) == bool(near), word
        if near:
            assert automaton.edits[state] == min(near)[0], word


def test_licenses(spark, none):
    rows = [(1, "Text.\nReleased under the MIT License.\nMore."), (2, "released under the MIT licence"), (3, None), (4, ""), (5, "a license to talk about many other things entirely"),
            (6, "Licensed under the Apache License, Version 2.0.\nAll rights reserved."), (7, "word " * 5000 + "Licensed under CC BY-NC 4.0. " + "word " * 5000), (None, "All rights reserved.")]
    got = sorted(((r.doc_id or 0, r.license, r.n_missing) for r in licenses.license_blocks(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got[:5] == [(0, "all-rights-reserved", 0), (1, "mit", 0), (2, "mit", 1), (6, "all-rights-reserved", 0), (6, "apache-2.0", 0)]
    assert {g[1] for g in got if g[0] == 7} == {"cc-by-nc-4.0"} and not any(g[0] == 5 for g in got)
    assert licenses.judge("released under the MIT licence")[4] == ["-license +licence"]
    assert licenses.license_blocks(none).count() == 0


@pytest.mark.parametrize("unit", [True, False])
def test_permutation_index(spark, unit):
    source = np.random.default_rng(2)
    vectors = source.normal(size=(3000, 16))
    if unit:
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[100:1100] = vectors[100]
    rows = [(int(k), [float(x) for x in v]) for k, v in enumerate(vectors)]
    rows += [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [None] + [1.0] * 15), (5080, [1.0]), (5100, []), (None, [1.0] * 16), (5120, [float("inf")] * 16)]
    got = defaultdict(list)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for r in permutation_index.search(frame, "vec_id % 20 = 0", best=20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ids, hit = np.arange(3000), 0
    for q in range(0, 3000, 20):
        scores = np.cumsum(vectors * vectors[q], axis=1)[:, -1]
        want = [int(k) for k in np.lexsort((ids, -scores)) if k != q][:20]
        hit += len(set(want) & {v for v, _ in got[q]})
        assert all(s == scores[v] for v, s in got[q]) and len(got[q]) == 20
        if unit and 100 <= q < 1100:
            assert [v for v, _ in got[q]][:3] == want[:3]
    assert set(got) == set(range(0, 3000, 20)) and hit / (150 * 20) >= 0.9
    few = permutation_index.search(frame.filter("vec_id < 3"), "vec_id = 0", best=20).collect()
    assert [(r.rank, r.query_id) for r in few] == [(1, 0), (2, 0)]
    assert permutation_index.search(frame.limit(0), "vec_id = 0").count() == 0

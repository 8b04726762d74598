"""What reviews found missing: one test per finding, each failing on the code before it."""

import random
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from spendmart.llm import decontaminate, hosts, language, licenses, ngram_join, permutation_index, queries, toxicity
from spendmart.llm.shared import materialize, scratch
from spendmart.session import checkpoint_folder

rng = random.Random(11)


def wrapped(text, mark="", width=12):
    words = text.split()
    return "\n".join(mark + " ".join(words[k : k + width]) for k in range(0, len(words), width))


@pytest.mark.parametrize("name", [n for n in licenses.TEMPLATES if n.endswith(("-text", "-notice"))])
def test_whole_notices_and_bodies(name):
    text = licenses.TEMPLATES[name]
    for block in (wrapped(text), wrapped(text, " * "), " ".join(text.split())):
        found = [(b[2][0], b[2][2]) for b in licenses.blocks_of(f"Some first line.\n\n{block}\n\nint main;\nAnd prose after it.") if b[2]]
        assert found == [(name, 0)]


def test_changed_and_neighbouring_bodies(spark):
    mit, bsd = licenses.TEMPLATES["mit-text"], licenses.TEMPLATES["bsd-2-clause-text"]
    changed = bsd.replace("COPYRIGHT HOLDERS AND CONTRIBUTORS", "REGENTS").replace("the distribution", "the package")
    text = f"Released under the MIT License.\n\nCopyright (c) 2020 A. Body\n\n{mit}\n{changed}\nEnd."
    rows = licenses.license_blocks(spark.createDataFrame([(1, text), (2, "Prose.\n" + wrapped(mit[: len(mit) // 2]))], "doc_id long, text string")).collect()
    got = sorted((r.line, r.license, r.n_missing) for r in rows if r.doc_id == 1)
    assert [g[1] for g in got] == ["mit", "mit-text", "bsd-2-clause-text"] and got[1][2] == 0 and 0 < got[2][2] <= 6
    assert [r.line for r in rows if r.license == "bsd-2-clause-text"] == [4 + mit.count("\n") + 1]
    assert not [r for r in rows if r.doc_id == 2]


def test_permutation_index_with_repeated_rows(spark):
    vectors = np.random.default_rng(4).normal(size=(400, 8))
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)]
    schema = "vec_id long, embedding array<double>"
    search = lambda more: sorted(map(tuple, permutation_index.search(spark.createDataFrame(rows + more, schema), "vec_id % 40 = 0").collect()))
    once = search([])
    assert search(rows) == once and len(once) == 200
    assert search([rows[7]] * 300 + [rows[40]] * 30) == once
    # one id, two vectors of equal score
    twins = [(1000 + k // 2, [1.0, float(k % 2), *[0.0] * 6]) for k in range(60)] + [(0, [1.0] + [0.0] * 7)]
    got = permutation_index.search(spark.createDataFrame(twins, schema), "vec_id = 0").collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)] == list(range(1000, 1020))


def test_toxicity_with_hundreds_of_terms(spark):
    name = lambda: "".join(rng.choice("bcdfghjklmnpqrstvwxz") + rng.choice("aeiou") for _ in range(5))
    common, terms = [name() for _ in range(60)], [name() for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(common) for _ in range(n))
    rows = [(k, f"{prose(20)} {terms[k // 8]} {prose(20)}", 1) for k in range(8 * len(terms))]
    rows += [(10_000 + k, prose(41), 0) for k in range(4 * len(rows))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    asked = [(k, f"{prose(15)} {term} {prose(15)}") for k, term in enumerate(terms)] + [(-1 - k, prose(31)) for k in range(100)]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert all(got[k].n_terms >= 1 and got[k].predicted == 1 for k in range(len(terms)))
    assert sum(got[-1 - k].predicted for k in range(100)) == 0


def test_language_mixtures_are_kept(spark):
    letters = {"aa": "abcd", "bb": "efgh", "cc": "ijkl", "dd": "mnop", "ee": "qrst", "ff": "uvwx"}
    text = lambda lang, n=80: " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(2, 6))) for _ in range(n))
    rows = [(k, text(lang), lang, "s", 1) for k, lang in enumerate(list(letters) * 10)]
    rows += [(100 + n, " ".join(text(lang) for lang in list(letters)[:n]), None, "s", 1) for n in range(1, 7)] + [(200, "12 !", None, "s", 1), (201, None, None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in language.predict(docs, language.train(docs)).collect()}
    for n in range(1, 7):
        assert set(got[100 + n].shares) == set(list(letters)[:n]) and abs(got[100 + n].score - 1 / n) < 0.1
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()} == {r[0] for r in rows} - {200, 201}


def test_items_without_an_id_and_with_text_ids_hit(spark):
    nobody, named = (" ".join(f"{kind}{k}" for k in range(30)) for kind in ("no", "na"))
    docs = spark.createDataFrame([(1, nobody), (2, named), (3, f"{nobody} {named}")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(None, nobody), ("arc-7/b", named), ("arc-10", named)], "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.verdicts(decontaminate.benchmark_matches(docs, benchmark)).collect()}
    assert [(got[k].n_hit, got[k].n_items, got[k]["items"]) for k in (1, 2, 3)] == [(30, 0, []), (30, 2, ["arc-10", "arc-7/b"]), (60, 2, ["arc-10", "arc-7/b"])]
    assert all(r.contaminated for r in got.values())


def test_half_known_labels_count(spark, tmp_path):
    """A page whose document is toxic is bad, whether its quality is known or not."""
    pages = [(k, f"https://{'bad' if k % 2 else 'good'}.net/en/{k}") for k in range(60)]
    labels = [(k, None if k % 2 else 1, 1 if k % 2 else None) for k in range(60)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.host: r.verdict for r in queries.QUERIES["op3_host_reputation"](spark, str(tmp_path)).collect()}
    assert got == {"bad.net": "block", "good.net": "allow"}


def test_the_first_of_equally_long_rules_wins(spark):
    rules = [hosts.Rule("block", "a.net/x"), hosts.Rule("allow", "a.net/x")]
    pages = spark.createDataFrame([("a.net", "/xy")], "host string, path string")
    assert pages.select(hosts.rule_for(pages.host, pages.path, rules).verdict.alias("v")).first().v == "block"


def test_texts_that_share_an_id_are_not_lost(spark, tmp_path):
    prose = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(120))
    a, b = prose(), prose()
    rows = [(1, a), (1, b), (2, b + " more"), (1, a), (3, prose()), (5, a), (None, a)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((str(r.doc_id), r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect())
    assert len(kept) == 4 and ("None", a) in kept and ("1", a) in kept and ("3", rows[4][1]) in kept
    assert len([t for _, t in kept if t in (b, b + " more")]) == 1


def test_one_large_group_of_near_copies(spark, monkeypatch):
    """Over many blocks: copies near the leader, a chain that drifts away from it, and others that only that chain ties in."""
    rng, base = random.Random(3), [f"w{i}" for i in range(120)]
    texts, drift = [], list(base)
    for k in range(90):
        words = list(base)
        words[rng.randrange(120)] = f"x{k}"
        texts.append(words)
    for k in range(30):
        drift[4 * k] = f"y{k}"
        texts.append(list(drift))
        words = list(drift)
        words[-1] = f"z{k}"
        texts.append(words)
    texts += [[f"far{i}" for i in range(120)], texts[5]]
    rng.shuffle(texts)
    sets = [{tuple(words[i : i + 3]) for i in range(118)} for words in texts]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            if 100 * len(s & sets[j]) >= 90 * len(s | sets[j]):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    docs = spark.createDataFrame([(i, " ".join(words)) for i, words in enumerate(texts)], "doc_id long, text string").repartition(5)
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 1500)
    got = dict(map(tuple, ngram_join.near_duplicates(docs, 3, 90).select("doc_id", "component_id").collect()))
    assert got == {i: root(i) for i in range(len(sets))} and len(set(got.values())) == 2


def tables(spark):
    folder = Path(checkpoint_folder(spark).removeprefix("file:"))
    return {p for p in folder.iterdir() if not p.name.startswith(".")}


def test_operators_leave_no_scratch_tables(spark):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    body = [[word() for _ in range(400)] for _ in range(40)]
    body += [b[:390] + [word() for _ in range(10)] for b in body[:10]] + [b[:80] + [word() for _ in range(300)] for b in body[10:20]]
    rows = [(k, " ".join(b), "en", "s", 1) for k, b in enumerate(body)] + [(3, "another text of this id", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for stage, left, n in (
        (corpus_pipeline.drop_near_duplicates, "first-of-group", 51),
        (corpus_pipeline.cut_repeats, "cuts", 61),
        (lambda s, d, _: ngram_join.near_duplicates(d.select("doc_id", "text")), "near-duplicates", 61),
    ):
        before = tables(spark)
        assert len(stage(spark, docs, "").collect()) == n
        new = tables(spark) - before
        assert [p.name.rsplit("-", 1)[0] for p in new] == [left]
        assert all("text" not in spark.read.parquet(str(p)).columns for p in new)


def test_scratch_goes_after_a_failure_and_keeps_what_it_is_told(spark):
    before = tables(spark)
    with scratch(spark) as keep:
        with scratch(spark) as keep_inner:
            inner = keep_inner(materialize(spark.range(5), "gone"), "inner")
        kept = keep(inner, "kept")
    assert kept.count() == 5
    with pytest.raises(ZeroDivisionError), scratch(spark):
        materialize(spark.range(5), "gone")
        1 / 0
    assert [p.name.split("-")[0] for p in tables(spark) - before] == ["kept"]

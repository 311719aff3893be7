"""Stages of the pipeline against brute force."""

from __future__ import annotations

import random
import re
from math import comb

import pytest
import sentencepiece

import corpus_pipeline
from tabulon.llm import nearpairs, pieces

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def said(pick, n):
    return [f"w{pick.randrange(10**6)}" for _ in range(n)]


def similarity(a, b, width=5):
    a, b = ({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_near_dedup_takes_five_words_and_four_fifths(spark):
    pick = random.Random(3)
    docs = {}
    for k in range(0, 60, 2):
        words = said(pick, 400)
        docs[k] = " ".join(words)
        if k % 4:  # one block added: 0.80 to below 0.85
            other = words + said(pick, pick.choice([75, 85, 95]))
        else:  # single words changed: below 0.8 of five words, above 0.85 of three
            other = list(words)
            for at in range(15, 400, 40):
                other[at] = "changed"
        docs[k + 1] = " ".join(other)
    frame = spark.createDataFrame([(k, t, "en") for k, t in docs.items()], "doc_id long, text string, lang string")
    got = corpus_pipeline.near_dedup(spark, frame, "")
    assert got.columns == frame.columns
    wanted = {k for k in docs if k % 2 == 0 or similarity(docs[k - 1], docs[k]) < 0.8}
    assert {r.doc_id for r in got.collect()} == wanted
    assert wanted == {k for k in docs if k % 4 != 3}


def test_near_dedup_keeps_one_row_of_each_group(spark):
    pick = random.Random(4)
    a, b, c, d, e = (" ".join(said(pick, 100)) for _ in range(5))
    near = a + " one more"
    rows = [(9, a), (9, a), (3, near), (None, a), (5, b), (5, b), (5, c), (None, d), (None, d), (7, e), (None, e), (8, ""), (8, None)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()
    wanted = [(3, near), (5, b), (5, c), (None, d), (7, e), (8, ""), (8, None)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, wanted))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert corpus_pipeline.near_dedup(spark, empty, "").collect() == []


def test_layout_follows_the_threshold():
    assert nearpairs.layout(85) == (12, 5, 23)
    for percent in (50, 70, 80, 85, 95, 100):
        chunks, symbols, distance = nearpairs.layout(percent)
        assert distance < 2 * chunks and chunks * symbols <= nearpairs.HASHES
        p = 1 - percent / 100
        beyond = lambda n, d: sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(d + 1, n + 1))  # noqa: B023, E731
        assert beyond(chunks * symbols, distance) < 3e-6


def test_signatures_meet_at_the_pipelines_threshold(spark):
    import numpy as np

    chunks, symbols, distance = nearpairs.layout(80)
    pick = np.random.default_rng(2)
    base = pick.integers(0, 1 << 16, (1, nearpairs.HASHES), dtype=np.uint16).repeat(200, 0)
    for k in range(1, 200):
        base[k, pick.choice(chunks * symbols, distance, replace=False)] += 1
    keys = {}
    for r in nearpairs.keys_of(spark.createDataFrame([(k, bytearray(r.tobytes())) for k, r in enumerate(base)], "id long, sig binary"), 80).collect():
        keys.setdefault(r.id, set()).add(r.key)
    assert all(keys[k] & keys[0] for k in range(200))


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """documents, labels and benchmark with good and bad documents, near copies, benchmark passages and secrets."""
    pick, root = random.Random(12), tmp_path_factory.mktemp("sf")
    fine = [f"{a}{b}" for a in ("riv", "ston", "gard", "lett", "hous", "light") for b in ("er", "en", "ing", "ed", "s", "ly")]
    good = lambda n: [pick.choice(fine) + str(pick.randrange(300)) for _ in range(n)]
    bad = lambda n: [pick.choice(["BUY!!", "CLICK!!", "FREE$$$", "WIN%%"]) + str(pick.randrange(9)) for _ in range(n)]
    items = [(k, " ".join(good(14))) for k in range(6)]
    rows, kinds = [], {}
    for k in range(240):
        words = bad(60) if k % 3 == 0 else good(60)
        if k % 12 == 1:
            words[20:20] = items[k // 12 % 6][1].split()
            kinds[k] = "leak"
        if k % 12 == 2:
            words[30:30] = ["token", "=", f'"{pick.randbytes(20).hex()}"']
            kinds[k] = "secret"
        if k % 12 == 5:
            words = [*rows[-1][1].split(), "more"]
            kinds[k] = "copy"
        rows.append((k, " ".join(words), "en", "src", 0))
        kinds.setdefault(k, "bad" if k % 3 == 0 else "good")
    spark.createDataFrame([(k, t, a, b, len(t)) for k, t, a, b, _ in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(k, int(k % 3 != 0), 0) for k in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), {r[0]: r[1] for r in rows}, kinds, items


def test_each_stage_against_brute_force(spark, corpus):
    root, texts, kinds, items = corpus
    docs = spark.read.parquet(f"{root}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "secret scans", "SentencePiece encoding and decoding"]
    odd = spark.createDataFrame([(900, None, "en", "s", None), (901, "", None, "s", 0), (None, "a b", "en", None, 3)], docs.schema)
    # quality: bad documents go, good ones stay
    kept = {r.doc_id for r in stages["quality classifier"](spark, docs, root).collect()}
    assert kept == {k for k in texts if k % 3}
    # near copies: one of each group, for all pairs of documents
    got = {r.doc_id for r in stages["MinHash near-dedup"](spark, docs.unionByName(odd), root).collect()}
    gone = {k for k in texts if any(similarity(texts[j], texts[k]) >= 0.8 for j in range(k))}
    assert got == {*texts, 900, 901, None} - gone and gone == {k for k, x in kinds.items() if x == "copy"}
    # benchmark passages: windows of ten words
    windows = {tuple(w[i : i + 10]) for _, t in items for w in [plain_words(t)] for i in range(len(w) - 9)}
    leaks = {k for k, t in texts.items() if any(tuple(plain_words(t)[i : i + 10]) in windows for i in range(len(texts[k].split())))}
    got = {r.doc_id for r in stages["benchmark decontamination"](spark, docs.unionByName(odd), root).collect()}
    assert got == {*texts, 900, 901, None} - leaks and leaks >= {k for k, x in kinds.items() if x == "leak"}
    # secrets: replaced where they stand, all else unchanged
    rows = stages["secret scans"](spark, docs.unionByName(odd), root).collect()
    for r in rows:
        whole = re.sub(r'(?<=token = ")[0-9a-f]{40}(?=")', "[SECRET]", texts[r.doc_id]) if r.doc_id in texts else {900: None, 901: "", None: "a b"}[r.doc_id]
        assert (r.text, r.n_chars) == (whole, None if whole is None else len(whole))
    assert len(rows) == len(texts) + 3
    # tokens: the library's, and back
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    rows = stages["SentencePiece encoding and decoding"](spark, docs.unionByName(odd), root).collect()
    assert all((r.ids, r.n_tokens, r.exact) == (library.encode(texts.get(r.doc_id, {None: "a b"}.get(r.doc_id, ""))), len(r.ids), True) for r in rows)


def test_run_applies_every_stage(spark, corpus):
    root, texts, kinds, items = corpus
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, root).collect()}
    leaks = {k for k, x in kinds.items() if x == "leak"}
    wanted = {k for k, x in kinds.items() if x in ("good", "secret")} - leaks
    assert wanted - {k - 1 for k in leaks} <= rows.keys() <= wanted | {k for k, x in kinds.items() if x == "copy"}
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    for k, r in rows.items():
        assert r.ids == library.encode(re.sub(r'(?<=token = ")[0-9a-f]{40}(?=")', "[SECRET]", texts[k]))
    empty = {n: spark.read.parquet(f"{root}/{n}.parquet").limit(0) for n in ("documents", "labels", "benchmark")}
    for n, frame in empty.items():
        frame.write.parquet(f"{root}/empty/{n}.parquet")
    assert corpus_pipeline.run(spark, f"{root}/empty").collect() == []

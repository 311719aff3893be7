"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeats and extra columns."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabulon.llm import decontaminate, lattice, nearpairs, pieces, quality, secrets, substrings
from tabulon.llm.common import Scratch, components
from tabulon.llm.words import Words, windows

WORD = r"[^\x20\x09-\x0D]+"
#: Words of 1,024 letters that meet in every rolling hash modulo 2^64.
THUE = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
ANTI = THUE.translate(str.maketrans("ab", "ba"))
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text, lower=False):
    text = text or ""
    return re.findall(WORD, text.translate(LOWER) if lower else text)


def made_docs(seed=1, n=60):
    """(doc_id, text): copies, near copies, shared passages, and the odd cases."""
    pick = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in "tsm" for b in "aeiou" for c in ("", "r", "ng", "é")]
    say = lambda k: [pick.choice(vocabulary) for _ in range(k)]
    passage, docs = say(70), []
    for i in range(n):
        words = say(pick.choice([3, 30, 120, 200]))
        if i % 5 == 0:
            at = pick.randint(0, len(words))
            words[at:at] = passage[pick.randint(0, 9) :]
        if i % 7 == 3 and docs:
            words = words_of(docs[-1][1])
            words[pick.randrange(len(words))] = "changed"
        docs.append((i * 3, " ".join(words).capitalize().replace(" t", "\n\tt", 2)))
    docs += [(990, f"{THUE} x y"), (991, f"{ANTI} x y"), (992, " ".join([*["w"] * 30, THUE, *["v"] * 30])), (993, " ".join([*["w"] * 30, ANTI, *["v"] * 30]))]
    docs += [(1000, docs[0][1]), (1001, None), (1002, ""), (1003, " \n\t "), (1004, "one"), (1005, "one two"), (1006, "one two"), (1007, " ".join(say(5000)))]
    return docs


def test_words():
    found = Words(pa.array(["a  bc\x0bd", None, "", " é x ", "y"]), lower=False)
    got = [bytes(found.buf[a:b]).decode() for a, b in zip(found.starts, found.ends, strict=True)]
    assert got == ["a", "bc", "d", "é x", "y"]
    assert found.counts.tolist() == [3, 0, 0, 1, 1]
    said = ["ab", "ab ab", "ba", "a\x00", "a", "x" * 15, "x" * 16, "x" * 17, "x" * 16, THUE, ANTI]
    x, y = Words(pa.array(said)).names()
    names = list(zip(x.tolist(), y.tolist(), strict=True))
    assert names[0] == names[1] == names[2] and names[7] == names[9]
    assert len(set(names)) == len({w for t in said for w in t.split()})
    order = "one two three four five six seven".split()
    for width in (1, 2, 3, 5, 7):
        lanes = windows(Words(pa.array([" ".join(order + order[::-1])])).names(), width)
        assert len(set(zip(*[v.tolist() for v in lanes], strict=True))) == len({tuple((order + order[::-1])[i : i + width]) for i in range(15 - width)})
    sliced = Words(pa.array(["zzz", "a b", "c"]).slice(1))
    assert sliced.counts.tolist() == [2, 1]


def test_components(spark):
    pick = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 140)] + [(pick.randint(0, 60), pick.randint(0, 60)) for _ in range(40)] + [(7, 7), (3, 1), (1, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = components(Scratch(spark, "test"), spark.createDataFrame(edges, "a long, b long"))
    assert dict(map(tuple, got.collect())) == {x: root(x) for x in parent}
    assert components(Scratch(spark, "test"), spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("batches", [1, 3])
def test_substrings(spark, batches):
    docs = made_docs(n=40)
    starts = {}
    for i, t in docs:
        w = words_of(t)
        for k in range(len(w) - 49):
            starts.setdefault(tuple(w[k : k + 50]), []).append(i)
    wanted = {}
    for i, t in docs:
        w = words_of(t)
        gone = {k + j for k in range(len(w) - 49) if min(starts[tuple(w[k : k + 50])]) < i for j in range(50)}
        wanted[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    frame = spark.createDataFrame([(i, t, "x", 5) for i, t in docs], "doc_id long, text string, kept string, a int")
    removed = substrings.dedup(Scratch(spark, "test"), frame.select("doc_id", "text"), batches)
    got = substrings.kept_text(frame, removed)
    assert got.columns == ["doc_id", "text", "a", "n_words", "n_removed", "kept"]
    rows = got.collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in rows} == wanted
    assert sum(r.n_removed for r in rows) > 300
    digest = {r.doc_id: r.kept_sha256 for r in substrings.kept_text(frame, removed, digests=True).collect()}
    assert digest == {i: hashlib.sha256(w[2].encode()).hexdigest() for i, w in wanted.items()}


def removed_words(docs):
    """Brute force: how many words each of docs (doc_id, text) loses."""
    starts = {}
    for i, t in docs:
        w = words_of(t)
        for k in range(len(w) - 49):
            starts.setdefault(tuple(w[k : k + 50]), []).append(i)
    return {i: len({k + j for w in [words_of(t)] for k in range(len(w) - 49) if min(starts[tuple(w[k : k + 50])]) < i for j in range(50)}) for i, t in docs}


@pytest.mark.parametrize("batches", [1, 2])
def test_substrings_that_a_document_repeats(spark, batches):
    own = lambda name, n: [f"{name}{k}" for k in range(n)]
    passage = own("p", 60)
    one = own("a", 80) + passage + own("b", 80)
    two = (own("c", 60) + passage + own("d", 60)) * 3
    docs = [(1, " ".join(one)), (2, " ".join(two)), (3, " ".join(own("e", 70) + two[:180] * 2))]
    wanted = removed_words(docs)
    assert wanted == {1: 0, 2: 180, 3: 360}
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = substrings.kept_text(frame, substrings.dedup(Scratch(spark, "test"), frame, batches)).collect()
    assert {r.doc_id: r.n_removed for r in got} == wanted


def test_substrings_over_compacted_runs(spark, monkeypatch):
    docs, compactions = made_docs(n=30), []
    compact = substrings.FingerprintIndex.compact
    monkeypatch.setattr(substrings.FingerprintIndex, "compact", lambda self: compactions.append(len(self.runs)) or compact(self))
    monkeypatch.setattr(substrings, "HOT", 2)  # so that anchors of three entries are dealt over parts
    docs = [(i if i < 900 else i - 880, t) for i, t in docs]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = substrings.kept_text(frame, substrings.dedup(Scratch(spark, "test"), frame, 8)).collect()
    assert {r.doc_id: r.n_removed for r in got} == removed_words(docs)
    assert compactions == [3, 3, 3]


def test_runs_are_joined_where_they_lie(spark):
    frame = spark.createDataFrame(made_docs(n=30), "doc_id long, text string")
    index = substrings.FingerprintIndex(Scratch(spark, "test"), buckets=3)
    index.ingest(frame.filter("doc_id < 50"), frame.filter("doc_id < 50"))
    anchors = substrings.spans_of(frame.filter("doc_id >= 50"), 50).select("fp").distinct()
    with substrings.sorted_buckets(spark):
        plan = index.met(anchors)._jdf.queryExecution().executedPlan().toString()
    run = plan[: plan.index("SelectedBucketsCount: 3 out of 3")].splitlines()
    join = next(k for k, line in enumerate(run) if "SortMergeJoin" in line)
    assert not [line for line in run[join + 1 :] if "Exchange" in line or "Sort " in line], plan


def test_substrings_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.kept_text(empty, substrings.dedup(Scratch(spark, "test"), empty)).collect() == []
    text = " ".join(f"w{k}" for k in range(60))
    twice = spark.createDataFrame([(None, text), (4, text), (4, text), (9, text)], "doc_id long, text string")
    got = substrings.kept_text(twice, substrings.dedup(Scratch(spark, "test"), twice)).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in got) == [(-1, 0), (4, 0), (4, 0), (9, 60)]


def brute_groups(docs):
    sets = {}
    for i, t in docs:
        w = words_of(t, lower=True)
        sets[i] = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize(("block", "text_block"), [(2048, 256), (3, 2)])
def test_near_groups(spark, block, text_block):
    docs = made_docs(seed=8, n=70)
    base = words_of(docs[11][1]) * 3
    for k in range(12):  # a chain in which neighbours are near and ends are not
        docs.append((2000 + k, " ".join(base[k * 8 : k * 8 + 250] + [f"z{j}" for j in range(k * 8, k * 8 + 40)])))
    frame = spark.createDataFrame([(i, t, True) for i, t in docs], "doc_id long, text string, kept boolean")
    got = nearpairs.near_groups(Scratch(spark, "test"), frame, block=block, text_block=text_block)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == brute_groups(docs)


def test_near_groups_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert nearpairs.near_groups(Scratch(spark, "test"), empty).collect() == []
    rows = [(None, "a b c"), (5, "A b c"), (5, "a b c"), (6, "a B\nc"), (7, None), (8, "")]
    got = nearpairs.near_groups(Scratch(spark, "test"), spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in got) == [(-1, 1, -1, True), (5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False), (7, 0, 7, True), (8, 0, 8, True)]


def test_every_pair_just_at_the_threshold_is_linked(spark):
    """400 pairs of similarity 0.85 to 0.86, each of words of its own."""
    pick, docs = random.Random(9), []
    for k in range(400):
        n = pick.choice([60, 150, 400])
        one = [f"{k}.{j}" for j in range(n)]
        two, at = list(one), 0
        while True:  # changed words, three shingles each, for as long as the pair stays alike
            new = [*two[:at], "changed", *two[at + 1 :]]
            a, b = ({tuple(w[i : i + 3]) for i in range(n - 2)} for w in (one, new))
            if 100 * len(a & b) < 85 * len(a | b):
                break
            two, at = new, at + pick.choice([3, 4])
        docs += [(2 * k, " ".join(one)), (2 * k + 1, " ".join(two))]
    got = nearpairs.near_groups(Scratch(spark, "test"), spark.createDataFrame(docs, "doc_id long, text string"))
    assert got.filter("component_id != doc_id - doc_id % 2").count() == 0


def test_columns_of_any_name_pass(spark):
    """The operators' own columns never meet the caller's."""
    own = ["s1", "s2", "sig", "component", "n", "id", "a", "b", "key", "slot", "__a", "__n", "__group", "__whole", "__key", "__spans", "kept_by"]
    rows = [(k, f"some text of document {k // 2}", *[f"{c}{k}" for c in own]) for k in range(6)]
    frame = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *[f"{c} string" for c in own]]))
    got = {r.doc_id: r for r in nearpairs.near_groups(Scratch(spark, "test"), frame).collect()}
    assert all(got[k].component_id == k - k % 2 and all(got[k][c] == f"{c}{k}" for c in own) for k in range(6))
    removed = substrings.dedup(Scratch(spark, "test"), frame)
    got = {r.doc_id: r for r in substrings.kept_text(frame, removed).collect()}
    assert all(got[k].n_words == 5 and all(got[k][c] == f"{c}{k}" for c in own) for k in range(6))


def test_columns_of_any_name_pass_the_other_operators(spark):
    own = ["quality", "row", "k", "found", "gaps", "__hidden", "__id", "__key", "word", "rid", "kept", "lp", "c", "n", "label", "pick", "spans2", "part", "model"]
    rows = [(j, f"the river flows {j} over stones and token = \"{hashlib.sha1(str(j).encode()).hexdigest()}\" end", *[f"{c}{j}" for c in own]) for j in range(12)]
    frame = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *[f"{c} string" for c in own]]))
    same = lambda frame: all(all(r[c] == f"{c}{r.doc_id}" for c in own) for r in frame.collect()) and frame.count() == 12
    labels = spark.createDataFrame([(j, j % 2) for j in range(12)], "doc_id long, quality int")
    assert same(quality.scored(frame, quality.train(frame, labels, "doc_id >= 0")))
    items = spark.createDataFrame([(1, "the river flows")], "item_id long, text string")
    found = decontaminate.contamination(frame, items)
    assert same(found) and found.filter("n_hit = 3").count() == 12
    several = decontaminate.contamination(frame, spark.createDataFrame([(1, "the river flows"), (2, "over stones")], "item_id long, text string"), group_bytes=4)
    assert same(several) and several.filter("n_hit = 5 AND items = array(1L, 2L)").count() == 12
    clean = secrets.redact(Scratch(spark, "test"), frame)
    assert same(clean) and clean.columns == frame.columns and clean.filter("text LIKE '%token = \"[SECRET]\" end'").count() == 12
    scratch = Scratch(spark, "test")
    model = lattice.train(scratch, frame.withColumn("learn", F.lit(True)), "learn")
    assert same(lattice.score(scratch, frame, model, ["doc_id", *own]))


def test_signatures_meet_within_the_distance(spark):
    """Any two signatures that differ in at most DISTANCE places share a key."""
    import numpy as np

    pick = np.random.default_rng(2)
    base = pick.integers(0, 1 << 16, (1, nearpairs.HASHES), dtype=np.uint16).repeat(200, 0)
    for k in range(1, 200):
        base[k, pick.choice(nearpairs.INDEXED, nearpairs.DISTANCE, replace=False)] += 1
    frame = spark.createDataFrame([(k, bytearray(r.tobytes())) for k, r in enumerate(base)], "id long, sig binary")
    keys = {}
    for r in nearpairs.keys_of(frame).collect():
        keys.setdefault(r.id, set()).add(r.key)
    assert all(len(keys[k] & keys[0]) > 0 for k in range(200))


def test_contamination(spark):
    docs = made_docs(seed=3, n=30)
    long = words_of(docs[7][1] * 2)
    items = [(1, " ".join(words_of(docs[2][1])[:14])), (2, "One, TWO!"), (3, None), (4, "?!"), (10, " ".join(long[3:30])), (11, " ".join(long[3:30])), (None, " ".join(words_of(docs[5][1])[:11]))]
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = []
    for i, t in items:
        w = find(t)
        windows += [(i, w[k : k + 10]) for k in range(max(1, len(w) - 9))] if w else []
    wanted = {}
    for d, t in docs:
        w = find(t)
        hit, ids = set(), set()
        for i, part in windows:
            for k in range(len(w) - len(part) + 1):
                if w[k : k + len(part)] == part:
                    hit |= set(range(k, k + len(part)))
                    ids |= {i} - {None}
        wanted[d] = (len(w), len(hit), sorted(ids))
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n_hit int, lang string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for group_bytes in (1 << 20, 60):  # one automaton, and several
        rows = decontaminate.contamination(frame, bench, group_bytes=group_bytes).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in rows} == wanted
        for r in rows:
            for s in r.spans:
                assert find(r.text[s.start : s.end]) == find(r.text)[s.first : s.last + 1]
    assert any(w[1] for w in wanted.values())
    none = decontaminate.contamination(frame, bench.limit(0)).collect()
    assert [r.n_hit for r in none] == [0] * len(docs)
    assert decontaminate.contamination(frame.limit(0), bench).collect() == []


def test_pieces(spark):
    pick = random.Random(5)
    bits = ["a", "the ", "  ", "\n", "\t", "▁", "é", "漢", "😀", "ing", "\x00", "<s>", "<0x0A>", "   ", "'", ".", "�", "1", "Q", "ung"]
    texts = ["".join(pick.choice(bits) for _ in range(pick.randint(0, 60))) for _ in range(800)]
    texts += ["", " ", None, "x" * 3000, "the " * 5000, "line\n" * 3000, "why" + "!" * 3000, "\n" * 3000, "\n a.\n.b", "漢" * 2000, *[t for _, t in made_docs(n=20)]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS ids", "'x' AS other", "'y' AS __text", "'z' AS __whole")
    got = {r.doc_id: r for r in pieces.encode_decode(frame).collect()}
    library = pieces.Pieces(pieces.default_model()).library
    for k, t in enumerate(texts):
        ids = library.encode(t or "")
        assert (got[k].n_tokens, got[k]["ids"], got[k].decoded, got[k].other, got[k]["__text"], got[k]["__whole"]) == (len(ids), ids, library.decode(ids), "x", "y", "z")
    digest = {r.doc_id: r for r in pieces.encode_decode(frame, digests=True).collect()}
    assert digest[3].ids_sha256 == hashlib.sha256(",".join(map(str, got[3]["ids"])).encode()).hexdigest()
    assert pieces.encode_decode(frame.limit(0)).collect() == []


def test_stretches_are_checked_against_the_library():
    p = pieces.Pieces(pieces.default_model())
    texts = ["the river", "\n a.\n.b", "漢\x00 é", "  two", "x" * 200, ""]
    for most in (1 << 20, 5, 40):  # whole, and in parts
        assert [(ids, text) for _, ids, text in pieces.coded(p, texts, False, most)] == [(p.library.encode(t), t) for t in texts]
        hashed = pieces.coded(p, texts, True, most)
        assert [x[1] for x in hashed] == [hashlib.sha256(",".join(map(str, p.library.encode(t))).encode()).hexdigest() for t in texts]
    p.raw[p.library.encode("river")[0]] = b" River"
    with pytest.raises(ValueError, match="decodes"):
        pieces.coded(p, texts, True)
    p.order[p.library.encode("river")[0]] = p.never
    with pytest.raises(ValueError, match="encodes"):
        pieces.coded(p, texts, True)


def test_decoding_of_any_ids():
    p = pieces.Pieces(pieces.default_model())
    pick = random.Random(6)
    for _ in range(500):
        ids = [pick.choice([0, 1, 2, pick.randrange(3, 259), pick.randrange(259, 32000)]) for _ in range(pick.randint(0, 6))]
        assert p.decode(ids) == p.library.decode(ids)
    assert p.decode([3 + 0xFF] * 5000) == "�" * 5000


def test_lattice_adds_all_segmentations():
    import itertools
    import math

    import numpy as np

    v = lattice.vocabulary(lattice.default_model())
    logp, _ = lattice.log_weights(v, 5000 * v.prior, 100.0)
    number = {b: i for i, b in enumerate(v.bytes)}
    for word in (b"the", b"\xc3\xa9t\xc3\xa9", b"zqx,"):
        text, total = b" " + word, 0.0
        for cuts in itertools.product([False, True], repeat=len(text) - 1):
            parts, at = [], 0
            for k, c in enumerate(cuts, 1):
                if c:
                    parts.append(text[at:k])
                    at = k
            parts.append(text[at:])
            if all(p in number for p in parts):
                total += math.exp(sum(logp[number[p]] for p in parts))
        rows = np.frombuffer(text, np.uint8)[None]
        assert lattice.forward(v, rows, logp)[0] == pytest.approx(math.log(total), rel=1e-9)
        assert (lattice.expected(v, rows, logp) * [len(b) for b in v.bytes]).sum() == pytest.approx(len(text))


def segmentations(v, logp, data):
    """Forward and backward sums and expected counts, piece by piece from a dict."""
    import math

    number = {b: i for i, b in enumerate(v.bytes) if b" " not in b[1:]}
    pieces_at = {(a, b): number[data[a:b]] for b in range(1, len(data) + 1) for a in range(max(0, b - v.longest), b) if data[a:b] in number}
    ahead, back = [1.0] + [0.0] * len(data), [0.0] * len(data) + [1.0]
    for (a, b), i in sorted(pieces_at.items(), key=lambda e: e[0][1]):
        ahead[b] += ahead[a] * math.exp(logp[i])
    for (a, b), i in sorted(pieces_at.items(), key=lambda e: -e[0][0]):
        back[a] += back[b] * math.exp(logp[i])
    counts = {}
    for (a, b), i in pieces_at.items():
        counts[i] = counts.get(i, 0) + ahead[a] * math.exp(logp[i]) * back[b] / ahead[-1]
    return math.log(ahead[-1]), counts


def test_long_words_like_short_ones():
    import numpy as np

    v = lattice.vocabulary(lattice.default_model())
    logp, _ = lattice.log_weights(v, 5000 * v.prior, 100.0)
    for word in (b" the", " ététhing漢".encode(), b" abcabcthing,"):
        data = np.frombuffer(word, np.uint8)
        total, counts = segmentations(v, logp, word)
        assert lattice.forward(v, data[None], logp)[0] == pytest.approx(total)
        for step in (3, 4096):
            assert lattice.forward_long(v, data, logp, step)[-1] == pytest.approx(total)
            got = lattice.expected_long(v, data, logp, step)
            assert {i: got[i] for i in np.flatnonzero(got > 1e-12)} == pytest.approx({i: c for i, c in counts.items() if c > 1e-12})
        assert lattice.expected(v, data[None], logp) == pytest.approx(got)
    long = np.frombuffer(b" " + b"the river " .replace(b" ", b"-") * 2000, np.uint8)[None]  # 20,000 bytes
    began = time.process_time()
    assert lattice.expected(v, long, logp).sum() > 1000 and np.isfinite(lattice.forward(v, long, logp)[0])
    assert time.process_time() - began < 10


def test_lm_scores_against_brute_force(spark):
    """Counts, two rounds of expected pieces, the mixture and the lattice alone, from plain Python."""
    import math

    import numpy as np

    docs = [(k, t) for k, t in made_docs(seed=9, n=12) if k < 900] + [(5000, "neverseen ünknown the the"), (5001, None), (5002, "z" * 90 + " tail")]
    learn = {k: zlib.crc32(str(k).encode()) % 5 != 1 for k, _ in docs}
    count = {}
    for k, t in docs:
        for w in words_of(t, lower=True) if learn[k] else []:
            count[w] = count.get(w, 0) + 1
    ends = sum(learn.values())
    v = lattice.vocabulary(lattice.default_model())
    counts, spelt = lattice.PRIOR * v.prior, lattice.PRIOR / 4
    for _ in range(2):
        logp, _ = lattice.log_weights(v, counts, spelt)
        counts, spelt = lattice.PRIOR * v.prior, lattice.PRIOR / 4 + len(count)
        for w in count:
            for i, x in segmentations(v, logp, b" " + w.encode())[1].items():
                counts[i] += x
    logp, stop = lattice.log_weights(v, counts, spelt)
    total = sum(count.values()) + ends
    one, two = (sum(c == k for c in count.values()) for k in (1, 2))
    discount = one / (one + 2 * two)
    wanted = {}
    for k, t in docs:
        mixed = alone = math.log(ends / total)
        for w in words_of(t, lower=True):
            own = segmentations(v, logp, b" " + w.encode())[0] + stop
            mixed += math.log(math.exp(own) * discount * len(count) / total + max(count.get(w, 0) - discount, 0) / total)
            alone += own + math.log(1 - ends / total)
        wanted[k] = (mixed / math.log(10), alone / math.log(10))
    frame = spark.createDataFrame([(k, t, learn[k]) for k, t in docs], "doc_id long, text string, learn boolean").repartition(5)
    scratch = Scratch(spark, "test")
    model = lattice.train(scratch, frame, "learn", head=20)
    assert np.allclose(model.pieces, counts, rtol=1e-6)
    rows = lattice.score(scratch, frame, model, ["doc_id"]).collect()
    assert {r.doc_id: (r.score, r.lattice_score) for r in rows} == {k: pytest.approx(x, rel=1e-6) for k, x in wanted.items()}


def test_lm_scores(spark):
    import math

    docs = [*made_docs(seed=9, n=40), (5000, "neverseenwords ünknown"), (1004, "one")]
    frame = spark.createDataFrame([(i, t, zlib.crc32(str(i).encode()) % 5 != 1) for i, t in docs], "doc_id long, text string, learn boolean")
    count = {}
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            for w in [*words_of(t, lower=True), None]:
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    for head in (1 << 18, 3):  # all words sent, and nearly all joined
        scratch = Scratch(spark, "test")
        model = lattice.train(scratch, frame, "learn", head=head)
        rows = lattice.score(scratch, frame, model, ["doc_id"]).collect()
        assert model.tokens == n and len(rows) == len(docs)
        texts = dict(docs)
        for r in rows:
            said = [*words_of(texts[r.doc_id], lower=True), None]
            base = sum(math.log10((count.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in said)
            assert (r.n_tokens, r.n_known) == (len(said), sum(w in count for w in said))
            assert r.base_score == pytest.approx(base) and r.score < 0
        if head == 3:
            assert {(r.doc_id, round(r.score, 6)) for r in rows} == first
        first = {(r.doc_id, round(r.score, 6)) for r in rows}
    words = model.words.toPandas()
    known = sum(math.exp(x) for x, c in zip(words.lp, words.c, strict=True) if c) + math.exp(model.end)
    assert 0.5 < known <= 1
    empty = frame.limit(0)
    nothing = lattice.train(Scratch(spark, "test"), empty, "learn")
    assert lattice.score(Scratch(spark, "test"), empty, nothing, ["doc_id"]).collect() == []


def test_quality(spark):
    pick = random.Random(2)
    good = [" ".join(pick.choice(["the", "river", "flows", "quietly", "over", "stones"]) for _ in range(40)) for _ in range(60)]
    bad = [" ".join(pick.choice(["BUY!!", "CLICK!!", "now!!", "the", "FREE$$$"]) for _ in range(40)) for _ in range(60)]
    rows = [(k, t, "en", 0.5) for k, t in enumerate(x for pair in zip(good, bad, strict=True) for x in pair)]
    docs = spark.createDataFrame([*rows, (500, None, "en", 0.1), (501, "", "en", 0.1), (None, "river", "de", 0.1)], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(120)] + [(None, 1), (500, None)], "doc_id long, quality int")
    model = quality.train(docs, labels, quality.learns())
    got = quality.scored(docs, model)
    assert got.columns == ["doc_id", "text", "lang", "score"]
    scores = {r.doc_id: r.score for r in got.collect()}
    held = [k for k in range(120) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all((scores[k] >= 0.7) == (k % 2 == 0) for k in held) and len(held) > 15
    assert scores[500] == scores[501] and all(0 <= s <= 1 for s in scores.values())
    assert quality.train(docs, labels, quality.learns()).bias == model.bias
    lone = quality.train(docs, labels.filter("quality = 1"), quality.learns())
    assert all(r.score > 0.7 for r in quality.scored(docs, lone).collect())
    assert quality.scored(docs.limit(0), model).collect() == []


def test_quality_of_repeats_and_long_texts(spark):
    say = lambda k, n: " ".join((["river", "stone"], ["BUY!!", "FREE$$$"])[k % 2][(k + j) % 2] + str(j % 9) for j in range(n))
    rows = [(k, say(k, 30)) for k in range(60)]
    rows += [(0, say(0, 30))] * 500 + [(0, say(0, 30 + j)) for j in range(100)] + [(60, say(0, 300_000)), (61, say(1, 300_000)), (62, "x" * 2_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(60)] * 3, "doc_id long, quality int")
    seen = []
    fit = quality.Model
    quality.Model, model = (lambda rows, good: seen.append(len(rows)) or fit(rows, good)), None
    try:
        model = quality.train(docs, labels, "doc_id >= 0", most=50)
        again = quality.train(docs.repartition(7), labels, "doc_id >= 0", most=50)
    finally:
        quality.Model = fit
    assert seen[0] == seen[1] <= 50 and (model.weight == again.weight).all()
    scores = {}
    for r in quality.scored(docs, model).collect():
        scores.setdefault(r.doc_id, []).append(r.score)
    assert len(scores[0]) == 601 and scores[60][0] > 0.5 > scores[61][0] and 0 <= scores[62][0] <= 1
    nobody = quality.train(docs, labels.limit(0), "doc_id >= 0")
    assert {r.score for r in quality.scored(docs, nobody).collect()} == {0.5}


def plain_features(text):
    """The n-grams of a text as a Python set: bytes, and words and pairs of them."""
    raw = text.encode()
    words = raw.split()
    grams = {(n, raw[i : i + n]) for n in (1, 2, 3) for i in range(len(raw) - n + 1)}
    return grams | {("w", w) for w in words} | {("p", a, b) for a, b in zip(words, words[1:], strict=False)}


def test_quality_query_against_brute_force(spark):
    """The query's rows and folds, its scores from each text alone, and what its features stand for."""
    import numpy as np

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in quality.op2_quality(spark, sf).collect()}
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert got.keys() == docs.keys()
    held = {k: zlib.crc32(str(k).encode()) % 4 == 2 for k in docs}
    assert all(got[k].held_out == held[k] and got[k].predicted == (got[k].score >= 0.7) for k in docs)
    rows = {k: next(quality.features(pa.array([t]))) for k, t in docs.items()}
    for k, t in docs.items():  # a place for each n-gram, but where two share one
        n = len(plain_features(t))
        assert n - len(rows[k]) <= n * n / (1 << quality.BITS) + 8 and len(rows[k]) <= n
    taught = sorted((k, labels[k], rows[k].tobytes()) for k in labels if k in docs and not held[k])
    model = quality.Model([np.frombuffer(r, np.int32) for _, _, r in taught], np.array([q == 1 for _, q, _ in taught], bool))
    counts = [np.full(1 << quality.BITS, 1.0) for _ in range(2)]
    for _, q, r in taught:
        counts[q][np.frombuffer(r, np.int32)] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    assert np.allclose(model.ratio, ratio, atol=1e-6)
    for k in docs:
        x = ratio[rows[k]]
        margin = float(model.weight[rows[k]] @ (x / np.sqrt(x @ x))) + model.bias if len(x) else model.bias
        assert got[k].score == pytest.approx(1 / (1 + np.exp(-(model.slope * margin + model.offset))), abs=1e-5)


def test_dual_descent_reaches_the_optimum():
    """At the optimum every dual variable meets its condition."""
    import numpy as np

    pick = np.random.default_rng(1)
    rows = [np.sort(pick.choice(50, 8, replace=False)).astype(np.int32) for _ in range(80)]
    y = np.array([1.0 if r[0] % 2 else -1.0 for r in rows])
    values = [quality.unit(np.ones(8)) for _ in rows]
    w, b = quality.dual_descent(rows, values, y, np.full(80, 0.5), epochs=2000)
    loss = lambda w, b: (w @ w + b * b) / 2 + 0.5 * sum(max(0, 1 - t * (w[r] @ v + b)) for r, v, t in zip(rows, values, y, strict=True))
    best = loss(w, b)
    for _ in range(50):
        step = np.zeros_like(w)
        step[:50] = pick.normal(0, 0.01, 50)
        assert loss(w + step, b + pick.normal(0, 0.01)) >= best - 1e-4


def test_secrets(spark):
    pick = random.Random(7)
    hexa = lambda n: "".join(pick.choice("0123456789abcdef") for _ in range(n))
    rows, hidden = [], {}
    for k in range(120):
        secret = ["AKIA" + "".join(pick.choice("ABCDEFGHJKLMNPQRSTUVWXYZ234567") for _ in range(16)), hexa(40), hexa(18)][k % 3]
        text = [f"some words {secret} and more", f'here token = "{secret}" follows', f"the password={secret} is set"][k % 3]
        if k % 2:
            text, secret = f"paid with {pick.randrange(10**15, 10**16)} at www.example2.com/path/to/files/index1.html ANOTHERSHOUTINGWORD", None
        rows.append((k, text, k))
        hidden[k] = secret
    rows += [(900, None, 0), (901, "", 0), (902, "é" * 50 + f' token: "{hexa(40)}"', 0), (None, "x " * 4000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found int")
    found = secrets.scan(Scratch(spark, "test"), docs).collect()
    texts = {r[0]: r[1] for r in rows}
    for f in found:
        assert texts[f.doc_id][f.start : f.start + len(f.candidate)] == f.candidate
    told = {(f.doc_id, f.candidate) for f in found if f.secret}
    wanted = {(k, s) for k, s in hidden.items() if s}
    assert told - wanted == {(902, texts[902][-41:-1])} and not wanted - told
    clean = secrets.redact(Scratch(spark, "test"), docs)
    assert clean.columns == docs.columns
    got = {r.doc_id: r.text for r in clean.collect()}
    assert all(s not in got[k] and "[SECRET]" in got[k] for k, s in hidden.items() if s)
    assert all(got[k] == texts[k] for k, s in hidden.items() if not s)
    assert got[900] is None and got[901] == "" and got[None] == texts[None]
    assert secrets.scan(Scratch(spark, "test"), docs.limit(0)).collect() == []


def test_secrets_of_other_shapes(spark):
    """Short, broken, all-letter and dotted secrets, and texts that only look like them."""
    pick = random.Random(11)
    letters, digits = "abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ", "23456789"
    mixed = lambda n: "".join(pick.choice(letters + digits) for _ in range(n - 1)) + pick.choice(digits)
    small = lambda n: "".join(pick.choice(letters[:25]) for _ in range(n))
    rows, hidden = [], {}
    for k in range(400):
        m, jwt = mixed(9), f"eyJ{mixed(20)}.eyJ{mixed(40)}.{mixed(30)}-_{mixed(11)}"
        secret, form = [(m, 'password = "{}"'), (f"{m[:4]}&{m[4:]}!", "run with pwd={} now"), (m, "postgres://admin:{}@db.example.com/main"), (small(12), "password='{}'"), (jwt, "Authorization: Bearer {} sent"), (jwt, "it was {} then"), (m, '{{"api_key": "{}"}}'), (m, "/login?token={}&user=ann")][k % 8]
        plain = ["the key: everything else follows", "password = getpass.getpass() in code", "see www.example2.com/path/to/files/index1.html", 'token = "${TOKEN}" and password: required', "no secret here"][k % 5]
        rows.append((2 * k, f"some words {form.format(secret)} and more"))
        hidden[2 * k] = secret
        rows.append((2 * k + 1, f"some words {plain} and more"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    told = {(f.doc_id, f.candidate) for f in secrets.scan(Scratch(spark, "test"), docs).collect() if f.secret}
    assert told == set(hidden.items())
    clean = {r.doc_id: r.text for r in secrets.redact(Scratch(spark, "test"), docs).collect()}
    assert clean == {k: t.replace(hidden[k], "[SECRET]") if k in hidden else t for k, t in rows}


def test_candidates_of_long_texts(spark):
    texts = [f"password={'a&b;' * 100_000}x", "eyJ" + "a" * 300_000 + ".b" * 10, "a" * 300_000, "key=" * 60_000, "a.b" * 100_000, "password='" + "x" * 200_000, "secret=hunter, then"]
    found = secrets.candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(texts[f.doc_id][f.start : f.start + len(f.candidate)] == f.candidate for f in found)
    assert {f.candidate for f in found if f.doc_id in (0, 6)} == {texts[0][9:], "hunter"}


def test_no_table_stays_in_the_catalog(spark):
    before = {t.name for t in spark.catalog.listTables()}
    frame = spark.createDataFrame(made_docs(n=20), "doc_id long, text string")
    removed = substrings.dedup(Scratch(spark, "test"), frame, 5)
    assert removed.count() > 0 and {t.name for t in spark.catalog.listTables()} == before

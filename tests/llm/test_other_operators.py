"""WARC bundles, chat formatting and vectors against brute force and round trips."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import chat, covertree, registry, warc
from tabulon.llm.common import Scratch


def test_archives(spark):
    pages = [(k, f"http://x/{k}", ("same" if k % 3 == 0 else f"page {k} é") * (k + 1 if k % 3 else 5)) for k in range(60)]
    pages += [(70, "http://x/a b\n", None), (71, None, ""), (None, "http://x/n", "same" * 5), (3, "http://x/3", "same" * 5), (80, "u", "\r\n\r\nWARC/1.1\r\n")]
    frame = spark.createDataFrame(pages, "id long, url string, payload string").withColumn("payload", F.coalesce("payload", F.lit(""))).withColumn("sha1", F.lit("x"))
    scratch = Scratch(spark, "test")
    index = scratch.save(warc.write_archives(warc.with_revisits(frame), scratch.folder("b"), frame_bytes=500, bundle_bytes=2000), "index")
    back = warc.read_archives(index).collect()
    assert len(back) == len(pages) and index.filter("frame > 0").count() > 5
    first = {}
    for i, _, p in pages:
        first[p or ""] = min([x for x in (first.get(p or ""), i) if x is not None], default=None)
    got = {(r.id, r.url): r for r in back}
    for i, url, p in pages:
        r = got[i, {"http://x/a b\n": "http://x/a%20b%0A"}.get(url, url or "")]
        data = (p or "").encode()
        response = i == first[p or ""]
        assert (r.payload_bytes, r.payload_digest) == (len(data), warc.digest(data))
        assert (r.record_type, r.refers_to) == (("response", None) if response else ("revisit", first[p or ""]))
        assert r.payload == (bytearray(data) if response else None)
    reader = warc.BundleReader(index.first().bundle)
    assert all(len(reader.frame(k)) == full for k, (_, _, full) in enumerate(reader.frames))
    none = scratch.save(warc.write_archives(warc.with_revisits(frame.limit(0)), scratch.folder("e")), "none")
    assert warc.read_archives(none).collect() == []


def test_small_payloads_stay_responses(spark):
    frame = spark.createDataFrame([(1, "u", "ab"), (2, "v", "ab"), (3, "w", "abc" * 9), (4, "x", "abc" * 9)], "id long, url string, payload string")
    got = {r.id: r.first for r in warc.with_revisits(frame, least_bytes=10).collect()}
    assert {k: f and f.id for k, f in got.items()} == {1: None, 2: None, 3: None, 4: 3}


def test_record_ids(spark):
    """One for each capture; a revisit names its response's."""
    rows = [(1, "u", "same"), (1, "v", "same"), (2, "u", "same"), (3, "w", "other"), (None, "n", "same"), (4, "long", "x" * 3_000_000)]
    frame = spark.createDataFrame([(*r, "s") for r in rows], "id long, url string, payload string, salt string")
    scratch = Scratch(spark, "test")
    index = scratch.save(warc.write_archives(warc.with_revisits(frame, salts=3), scratch.folder("b"), frame_bytes=100), "index").collect()
    assert len({r.record_id for r in index}) == len(rows)
    heads = {}
    for r in index:
        reader = warc.BundleReader(r.bundle)
        data = reader.frame(r.frame)[r.offset : r.offset + r.length]
        reader.close()
        heads[r.record_id] = dict(x.split(": ", 1) for x in data.partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:])
    assert all(h["WARC-Record-ID"] == k for k, h in heads.items())
    revisits = [h for h in heads.values() if h["WARC-Type"] == "revisit"]
    assert len(revisits) == 2
    for h in revisits:
        first = heads[h["WARC-Refers-To"]]
        assert (first["X-Page-ID"], first["WARC-Target-URI"], first["WARC-Type"]) == ("1", h["WARC-Refers-To-Target-URI"], "response")
    back = {(r.id, r.url): r for r in warc.read_archives(spark.createDataFrame(index)).collect()}
    assert back[4, "long"].payload_bytes == 3_000_000 and back[None, "n"].refers_to == 1


def fold(events):
    """The final messages, event by event."""
    turns = []
    for _, message, kind, role, text in sorted(events, key=lambda e: (e[0], e[1], e[2], e[3], e[4])):
        if kind == "message":
            turns.append([message, role, text, True])
        elif kind == "regenerate":
            turns = [t for t in turns if t[0] < message]
        else:
            if kind == "edit":
                turns = [t for t in turns if t[0] != message]
            hit = next((t for t in reversed(turns) if t[0] == message), None)
            if hit is None or hit[3]:
                turns.append([message, role, text, False])
            else:
                hit[2] += text
    return [(t[1], t[2]) for t in sorted(turns, key=lambda t: t[0])]


def test_folding_of_random_logs(spark):
    pick = np.random.default_rng(4)
    kinds = ["message", "delta", "delta", "delta", "edit", "regenerate"]
    logs = {c: [(k * 3, int(pick.integers(0, 6)), kinds[pick.integers(6)], "user", f"{k}<") for k in range(pick.integers(1, 60))] for c in range(60)}
    rows = [(c, *e, "extra") for c, log in logs.items() for e in log]
    frame = spark.createDataFrame(rows, "conv_id long, seq long, message long, kind string, role string, text string, alive string").repartition(7)
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.reconstruct(frame).collect()}
    assert got == {c: fold(log) for c, log in logs.items()}


def test_event_logs_fold_to_their_tables(spark):
    long = "ab😀<" * 50_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (1, 1, "assistant", "tie"), (1, None, None, None), (1, 2, "system", ""), (1, 3, "user", ""), (1, 4, "assistant", None), (2, 5, "tool", "x\ny"), (2, 5, "tool", "x\ny"), (None, 0, "user", "n")]
    said = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, message string")
    log = chat.event_log(said)
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    turns = chat.reconstruct(log)
    wanted = {}
    for c, _, role, text in sorted(rows, key=lambda r: (r[0] or 0, -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        wanted.setdefault(c, []).append((role or "", text or ""))
    assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in turns.collect()} == wanted
    back = chat.parse(chat.render(turns)).collect()
    assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in back} == wanted
    assert {r.conv_id: r.loss for r in back}[1] == long + "tie"


def test_folding(spark):
    log = [
        (1, 0, "delta", "user", "Hel"),
        (2, 0, "delta", "user", "lo <|im_"),
        (3, 0, "delta", "user", "end|>"),
        (4, 1, "delta", "assistant", "bad"),
        (5, 1, "edit", "assistant", "better"),
        (6, 1, "delta", "assistant", " still"),
        (7, 2, "delta", "user", "go on"),
        (8, 1, "regenerate", "", ""),
        (9, 1, "delta", "assistant", "good & <|im_start|>"),
        (10, 2, "message", "user\nx", "thanks &lt;"),
        (11, 3, "message", "assistant", ""),
    ]
    rows = [("a", *e) for e in log] + [(None, 1, 0, "message", None, None), ("b", 1, 0, None, "user", "x"), ("b", 1, 0, None, "user", "x")]
    frame = spark.createDataFrame(rows, "conv_id string, seq long, message long, kind string, role string, text string").withColumn("turns", F.lit(1)).repartition(5)
    turns = chat.reconstruct(frame)
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in turns.collect()}
    assert got == {"a": fold(log), None: [("", "")], "b": [("user", "x")] * 2}
    rendered = chat.render(turns)
    for r in rendered.collect():
        assert sum(m.chars for m in r["mask"]) == len(r.formatted)
        assert r.formatted.count(chat.START) == r.formatted.count(chat.END) == len(got[r.conv_id])
    back = {r.conv_id: r for r in chat.parse(rendered).collect()}
    assert {k: [(t.role, t.text) for t in r.turns] for k, r in back.items()} == got
    assert back["a"].loss == "".join(t for role, t in got["a"] if role == "assistant")
    assert chat.parse(chat.render(chat.reconstruct(frame.limit(0)))).collect() == []


def test_chat_is_native(spark):
    frame = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.parse(chat.render(chat.reconstruct(chat.event_log(frame))))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def brute_links(rows, cosine):
    ok = {}
    for i, v, label in rows:
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = (np.array(v, float), label)
    near = {i: [] for i, _, _ in rows}
    for a, (u, x) in ok.items():
        for b, (v, y) in ok.items():
            if a != b and x == y and len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= cosine:
                near[a].append(b)
    seen = {}
    for i in sorted(near):
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in seen:
                seen[k] = i
                todo += near[k]
    return {i: (len(near[i]), seen[i], seen[i] == i) for i in near}


@pytest.mark.parametrize(("block", "cosine"), [(2048, 0.93), (40, 0.93), (25, 0.5)])
def test_near_vectors(spark, block, cosine):
    pick = np.random.default_rng(3)
    rows = []
    for label in (0, 1, 2):
        centres = pick.normal(size=(12, 8))
        for k in range(90):
            v = centres[pick.integers(12)] * pick.uniform(0.5, 2) + pick.normal(size=8) * pick.choice([0.02, 0.2, 0.6])
            rows.append((label * 1000 + k, [float(np.float32(x)) for x in v], label))
    rows += [(5000 + k, rows[k % 3][1], 0) for k in range(30)]
    rows += [(6000, None, 0), (6001, [], 0), (6002, [0.0] * 8, 0), (6003, [None] + [1.0] * 7, 0), (6004, [float("nan")] * 8, 0), (6005, [float("inf")] * 8, 0), (6006, rows[0][1], None), (6007, [1.0, 2.0], 0), (6008, [1.0, 2.0], 0)]
    own = ["component", "weight", "links", "id", "v", "dim", "class", "low", "__v", "__row", "__sound", "__label"]
    frame = spark.createDataFrame([(*r, 1, *own) for r in rows], "vec_id long, embedding array<float>, label int, n_links int, " + ", ".join(f"{c} string" for c in own))
    got = covertree.near_vectors(Scratch(spark, "test"), frame, cosine, block)
    assert all(r[c] == c for r in got.collect() for c in own)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got.collect()} == brute_links(rows, cosine)


def test_nodes_far_apart_never_meet(spark):
    """Tight clusters on several blocks: their nodes' radii part them, so few block pairs are left."""
    pick = np.random.default_rng(8)
    centres = pick.normal(size=(16, 12))
    v = np.repeat(centres, 40, 0) + pick.normal(size=(640, 12)) * 0.02
    rows = [(k, x.tolist(), 0) for k, x in enumerate(v)] + [(k, v[k + 1].tolist(), 0) for k in range(3)]  # ids of two vectors
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    scratch = Scratch(spark, "test")
    classes = frame.select("label", F.lit(12).alias("dim"), F.col("embedding").alias("v"), F.col("vec_id").alias("id"), F.lit(1).alias("weight"), F.monotonically_increasing_id().alias("cid"))
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    placed, ranges = covertree.dealt_by_nodes(scratch, scratch.save(classes, "c"), sizes, 0.93, 40, 64)
    assert placed.count() == len(rows)
    nodes = ranges.collect()
    assert sum(r.blocks for r in nodes) >= 16
    assert sum(r.blocks * sum(p.blocks for p in r.partners) for r in nodes) < 0.3 * sum(r.blocks for r in nodes) ** 2
    got = covertree.near_vectors(scratch, frame.filter("vec_id > 2"), block=40)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got.collect()} == brute_links([r for r in rows if r[0] > 2], 0.93)


def test_near_vectors_of_odd_tables(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert covertree.near_vectors(Scratch(spark, "test"), frame).collect() == []
    same = spark.createDataFrame([(None, [1.0], 0), (2, [1.0], 0), (2, [1.0], 0)], "vec_id long, embedding array<float>, label int")
    got = covertree.near_vectors(Scratch(spark, "test"), same).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in got) == [(-1, 0, -1, True), (2, 1, 2, True), (2, 1, 2, True)]


def test_trees_bound_their_points():
    pick = np.random.default_rng(5)
    v = pick.normal(size=(400, 6))
    v[200:] = v[:200] + pick.normal(size=(200, 6)) * 0.01
    units = v / np.sqrt((v * v).sum(1))[:, None]
    tree = covertree.Tree(units)
    for n, points in enumerate(tree.points):
        assert covertree.distance(units[points] @ units[tree.centre[n]]).max() <= tree.radius[n] + 1e-12
        if tree.children[n] is not None:
            assert tree.centre[tree.children[n][0]] == tree.centre[n]
            assert sorted(np.concatenate([tree.points[k] for k in tree.children[n]])) == sorted(points)
    links = covertree.Links(np.ones(400, np.int64))
    assert covertree.walk(tree, tree, 0, links, 0.93) < 400 * 400 / 3


def test_registry():
    names = [f"op{n}_" for n in range(1, 11)]
    assert all(any(q.startswith(n) for q in registry.queries()) for n in names)
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"

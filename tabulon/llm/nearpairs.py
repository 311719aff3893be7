"""MinHash near-dedup by a multi-index Hamming join over b-bit signatures.

A document's set is its distinct shingles of `width` words (A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`);
fewer words make one shingle. Its signature has min-hashes of 16 bits, laid out by the threshold: at 0.85
60 in 12 chunks of 5. By the pigeonhole principle two signatures that differ in at most 23 places have a chunk
that differs in at most 1; each chunk is entered once for each place that may be wrong, so all pairs within
that distance meet under some key, and nothing turns one away but its full sets (or their sizes). A pair is
taken only in the first bucket that it shares. Two sets of similarity exactly 0.85 are farther apart than that
with a probability of about 2e-6, more similar ones with far less. `layout` gives these numbers for any threshold.

Sets hold names of 128 bits of the shingles, made from the words' bytes or BLAKE2b digests (see `words`); sets are
equal if 128 bits of all of them and their sizes are, and links are confirmed on full sets.

Rows follow the number of documents, not of pairs in a group. Equal sets are one class. Each class is first
confirmed against the smallest member of the buckets it mostly shares, which joins a group of copies to its
hub. Then only buckets that still hold two components are compared, in blocks; what leaves them is not the
near pairs but a spanning forest of them. The forest's edges are confirmed first; the documents of trees that
still hold two components come together in blocks with their texts, where all near pairs across components are
confirmed. No bucket is capped.

Defined cases: a null or empty text has an empty set and links with nothing; rows that share an id are one
node of the links; a null id links with nothing; repeated rows are one class; an empty table gives no
rows; whole texts of any length are read; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import Scratch, components, fresh, joined, table
from tabulon.llm.words import Names, Words, mix, slices, thrifty, windows

#: Min-hashes in a signature; a layout indexes some or all of them.
HASHES = 60
#: Probability that the signatures of a pair just at the threshold are farther apart than the index guarantees.
MISS = 2.5e-6


def farthest(n: int, percent: int, miss: float) -> int:
    """The least d such that sets of this similarity differ in more than d of n min-hashes less often than `miss`."""
    p, beyond = 1 - percent / 100, 1.0
    for d in range(n):
        beyond -= comb(n, d) * p**d * (1 - p) ** (n - d)
        if beyond <= miss:
            return d
    return n


@lru_cache
def layout(percent: int) -> tuple[int, int, int]:
    """Chunks, symbols in each, and in how many of them all a pair may differ.

    The longest chunks, and of these the fewest, of which one still differs in at most 1 symbol.
    """
    for symbols in (5, 4, 3, 2):
        for chunks in range(1, HASHES // symbols + 1):
            distance = farthest(chunks * symbols, percent, MISS)
            if distance < 2 * chunks:
                return chunks, symbols, distance
    raise ValueError(f"no layout of {HASHES} min-hashes finds pairs of similarity {percent} %")


CHUNKS, SYMBOLS, DISTANCE = layout(85)
INDEXED = CHUNKS * SYMBOLS
_FACTORS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
#: Up to so many ids are sent to the texts rather than the texts to the ids.
BROADCAST_IDS = 1_000_000
#: Members of a hub that one task confirms.
MEMBERS = 2048


def shingles(found: Words, width: int) -> tuple[Names, np.ndarray]:
    """Names of all texts' shingles, repeats included, and where each text's begin."""
    words = found.names()
    count = np.where(found.counts >= width, found.counts - width + 1, np.minimum(found.counts, 1))
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros((2, first[-1]), np.uint64)
    for k in range(1, width + 1):  # texts of fewer words are one shingle
        some = np.flatnonzero(found.counts >= width if k == width else found.counts == k)
        if len(some):
            many = count[some]
            within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            at, to = np.repeat(found.first[some], many) + within, np.repeat(first[some], many) + within
            for lane, named in zip(out, windows(words, k), strict=True):
                lane[to] = named[at]
    return (out[0], out[1]), first


def distinct(names: Names, first: np.ndarray, k: int) -> Names:
    """The set of text k's shingles, in order."""
    x, y = (lane[first[k] : first[k + 1]] for lane in names)
    order = ordered(x, y)
    x, y = x[order], y[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return x[new], y[new]


def ordered(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The order by x, then y; y is looked at only where it has to be."""
    order = np.argsort(x, kind="stable")
    same = x[order[1:]] == x[order[:-1]]
    return np.lexsort((y, x)) if (same & (y[order[1:]] != y[order[:-1]])).any() else order


def in_common(a: Names, b: Names) -> int:
    """The size of two sets' intersection."""
    x, y = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = ordered(x, y)
    x, y = x[order], y[order]
    return int(((x[1:] == x[:-1]) & (y[1:] == y[:-1])).sum())


def alike(a: Names, b: Names, percent: int) -> bool:
    common = in_common(a, b)
    return common > 0 and 100 * common >= percent * (len(a[0]) + len(b[0]) - common)


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """16-bit min-hashes of each text with shingles, a row each."""
    some = np.flatnonzero(np.diff(first))
    out = np.zeros((len(first) - 1, HASHES), np.uint16)
    if len(some):
        for k in range(HASHES):
            least = np.minimum.reduceat(h * _FACTORS[k], first[some])
            out[some, k] = mix(least).astype(np.uint16)
    return out


def sets_of(docs: DataFrame, width: int, own: list[str]) -> DataFrame:
    """docs without text, with n_shingles and, by the names `own`, two hashes of the set and its signature (binary)."""
    keep = [c for c in docs.columns if c not in ("text", "n_shingles", "component_id", "kept")]
    source = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                names, first = shingles(Words(batch.column(len(keep)), lower=True), width)
                n = batch.num_rows
                size, s = np.zeros(n, np.int64), np.zeros((2, n), np.uint64)
                for k in range(n):
                    x, y = distinct(names, first, k)
                    size[k], s[0, k], s[1, k] = len(x), x.sum(dtype=np.uint64), mix(y).sum(dtype=np.uint64)
                sig = pa.array([r.tobytes() for r in signatures(names[0], first)], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(size), pa.array(mix(s[0]).view(np.int64)), pa.array(s[1].view(np.int64)), sig], names=[*keep, "n_shingles", *own])

    schema = T.StructType([*source.schema.fields[:-1], T.StructField("n_shingles", T.LongType()), T.StructField(own[0], T.LongType()), T.StructField(own[1], T.LongType()), T.StructField(own[2], T.BinaryType())])
    return source.mapInArrow(thrifty(run), schema)


def keys_of(classes: DataFrame, percent: int = 85) -> DataFrame:
    """(key, slot, id): each chunk of a signature with each one of its symbols left out, which slot numbers."""
    chunks, symbols, _ = layout(percent)
    indexed = chunks * symbols

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                if not batch.num_rows:
                    continue
                sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, HASHES)[:, :indexed].reshape(-1, chunks, symbols).astype(np.uint64)
                keys = np.empty((len(sig), chunks, symbols), np.uint64)
                for gap in range(symbols):
                    value = np.zeros(sig.shape[:2], np.uint64)
                    for k in range(symbols):
                        if k != gap:
                            value = value * np.uint64(1 << 16) + sig[:, :, k]
                    keys[:, :, gap] = mix(mix(value) + (np.arange(chunks, dtype=np.uint64) * np.uint64(8) + np.uint64(gap + 1))[None, :] * np.uint64(0xD6E8FEB86659FD93))
                ids = np.repeat(batch.column(0).to_numpy(), indexed)
                slots = np.tile(np.arange(indexed, dtype=np.int8), len(sig))
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(slots), pa.array(ids)], names=["key", "slot", "id"])

    return classes.select("id", "sig").mapInArrow(thrifty(run), "key long, slot byte, id long")


def confirmed(scratch: Scratch, pairs: DataFrame, docs: DataFrame, width: int, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) of ids whose full sets have 100 * intersection >= percent * union."""
    ids = scratch.save(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), f"{name}-ids")
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids) if few else ids.hint("merge"), "doc_id")
    texts = scratch.save(texts, f"{name}-texts")
    # a hub of many members is sent to as many parts of them
    parts = scratch.save(pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts")), f"{name}-parts")
    left = texts.withColumnRenamed("doc_id", "a").join(parts.hint("merge"), "a").select("a", "text", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    one = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b").join(parts.hint("merge"), "a")
    one = one.withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).drop("parts")
    both = one.join(left.hint("merge"), ["a", "part"]).select("a", "b", "text", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                # a hub's text comes again and again: its set is made once
                rows = batch.column(2)
                h2, f2 = shingles(Words(batch.column(3), lower=True), width)
                ok = np.zeros(len(a), bool)
                for k in range(len(a)):
                    text = rows[k].as_py()
                    if text != last:
                        h, f = shingles(Words(pa.array([text]), lower=True), width)
                        last, kept = text, distinct(h, f, 0)
                    other = distinct(h2, f2, k)
                    ok[k] = alike(kept, other, percent)
                yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])

    out = scratch.save(both.mapInArrow(thrifty(run), "a long, b long").distinct(), name)
    scratch.drop(f"{name}-texts")
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int = 3) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches that end where a group does; rows come sorted by their first `keys` columns.

    Groups are bounded by their blocks, so what waits for the next batch is too.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        group = np.stack([batch.column(k).to_numpy() for k in range(keys)], 1)
        if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in range(keys)):
            yield combined(held)
            held = []
        change = np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1
        if len(change):
            yield combined([*held, batch.slice(0, change[-1])])
            held = [batch.slice(change[-1])]
        else:
            held.append(batch)
    if held:
        yield combined(held)


def combined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def groups_of(batch: pa.RecordBatch, keys: int = 3) -> np.ndarray:
    """Where each group of rows begins."""
    group = np.stack([batch.column(k).to_numpy() for k in range(keys)], 1)
    return np.concatenate([[0], np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1])


def near_pairs(batch: pa.RecordBatch, percent: int, homes: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b) of pairs with near signatures, in one group and in different components and blocks.

    Columns: three that name the group (the last two its blocks), slot, mine, id, component, size, sig.
    homes: only in the first bucket that a pair shares.
    """
    i, j, slot, mine, _, component, size = (batch.column(k).to_numpy() for k in range(1, 8))
    chunks, symbols, distance = layout(percent)
    sig = np.frombuffer(b"".join(batch.column(8).to_pylist()), np.uint16).reshape(-1, HASHES)[:, : chunks * symbols]
    first = groups_of(batch)
    ends = np.repeat(np.append(first[1:], len(i)), np.diff(np.append(first, len(i))))
    count = ends - np.arange(len(i)) - 1
    upto = np.concatenate([[0], np.cumsum(count)])
    at = 0
    while at < len(i):  # some rows with all that follow them in their groups
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + 200_000, "right")) - 1)
        a = np.repeat(np.arange(at, to), count[at:to])
        b = a + 1 + np.arange(len(a)) - (upto[a] - upto[at])
        ok = (component[a] != component[b]) & ((i[a] == j[a]) | (mine[a] != mine[b]))
        ok &= 100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b])
        a, b = a[ok], b[ok]
        indexed = (sig[a] != sig[b]).reshape(-1, chunks, symbols)
        near = indexed.sum((1, 2)) <= distance
        a, b, indexed = a[near], b[near], indexed[near]
        errors = indexed.sum(2)
        ok = np.ones(len(a), bool)
        if homes and len(a):
            chunk = (errors <= 1).argmax(1)
            ok &= chunk * symbols + indexed[np.arange(len(a)), chunk].argmax(1) == slot[a]
        if ok.any():
            yield a[ok], b[ok]
        at = to


def forest(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b): edges that join, in each group, the ids that near pairs join."""
    for batch in whole_groups(batches):
        found = list(near_pairs(batch, percent, homes=True))
        if found:
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            root = joined(batch.num_rows, a, b)
            some = np.flatnonzero(root != np.arange(batch.num_rows))
            ids = batch.column(5).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids[root[some]]), pa.array(ids[some])], names=["a", "b"])


def links_in(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b): links across components in each group, confirmed on the sets of the texts in column 9.

    A pair is skipped if links found before already join it.
    """
    for batch in whole_groups(batches):
        first = [*groups_of(batch).tolist(), batch.num_rows]
        for at, to in zip(first, first[1:], strict=False):
            group = batch.slice(at, to - at)
            h, begin = shingles(Words(group.column(9), lower=True), width)
            sets = [distinct(h, begin, k) for k in range(group.num_rows)]
            component, ids = group.column(6).to_numpy(), group.column(5).to_numpy()
            parent: dict[int, int] = {}

            def root(x: int, parent: dict[int, int] = parent) -> int:
                while (up := parent.get(x, x)) != x:
                    parent[x] = x = parent.get(up, up)
                return x

            found = []
            for a, b in near_pairs(group, percent, homes=False):
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    p, q = root(component[x]), root(component[y])
                    if p == q:
                        continue
                    if alike(sets[x], sets[y], percent):
                        parent[max(p, q)] = min(p, q)
                        found.append((ids[x], ids[y]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])


def blocked(rows: DataFrame, group: str) -> DataFrame:
    """rows (group, blocks, slot, id, component, size, sig, ...) once for each pair of blocks of the group that has them."""
    mine = F.pmod(F.xxhash64("id", "sig"), F.col("blocks")).cast("int")
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = [c for c in ("text",) if c in rows.columns]
    rows = rows.select(group, F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "slot", "mine", "id", "component", "size", "sig", *rest)
    return rows.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j")


def near_groups(scratch: Scratch, docs: DataFrame, width: int = 3, percent: int = 85, block: int = 2048, text_block: int = 256) -> DataFrame:
    """docs without text, with n_shingles, component_id and kept."""
    keep = [c for c in docs.columns if c not in ("text", "n_shingles", "component_id", "kept")]
    own = fresh(docs, "s1", "s2", "sig")
    sets = scratch.save(sets_of(docs, width, own), "sets")
    shown = sets.filter("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "n_shingles", *[F.col(a).alias(b) for a, b in zip(own, ("s1", "s2", "sig"), strict=True)])
    classes = shown.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig"))
    classes = scratch.save(classes, "classes")
    buckets = keys_of(classes, percent).groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("top")).filter("hub < top").select("key", "hub")
    buckets = scratch.save(buckets, "buckets")
    members = scratch.save(keys_of(classes, percent).join(buckets.hint("merge"), "key"), "members")
    # each class and the hub that it shares most keys with
    shares = members.filter("hub < id").groupBy("id", "hub").agg(F.count("*").alias("n"))
    hubs = shares.groupBy("id").agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("a"))
    hubs = scratch.save(hubs.select("a", F.col("id").alias("b")), "hubs")
    links = confirmed(scratch, hubs, docs, width, percent, "hub-links")
    labels = components(scratch, links, "first")
    # buckets that still hold more than one component
    placed = members.join(labels, "id", "left").select("key", "slot", "id", F.coalesce("component", "id").alias("component"))
    placed = scratch.save(placed, "placed")
    scratch.drop("members")
    open_ = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).filter("low < high")
    open_ = scratch.save(open_.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "open")
    signed = classes.select("id", F.col("n_shingles").alias("size"), "sig")
    left = placed.join(open_.hint("merge"), "key").join(signed.hint("merge"), "id")
    near = scratch.save(blocked(left, "key").mapInArrow(thrifty(lambda b: forest(b, percent)), "a long, b long").distinct(), "near")
    scratch.drop("placed")
    # first each tree's own edges, as many as documents; then, with texts, all near pairs of trees that still hold two components
    known = labels.select(F.col("id").alias("a"), F.col("component").alias("b"))
    labels = components(scratch, known.union(confirmed(scratch, near, docs, width, percent, "tree-links")), "joined")
    trees = components(scratch, near, "trees").withColumnRenamed("component", "tree")
    trees = scratch.save(trees.join(labels, "id", "left").select("id", "tree", F.coalesce("component", "id").alias("component")), "placed-trees")
    blocks = trees.groupBy("tree").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).filter("low < high")
    blocks = scratch.save(blocks.select("tree", F.ceil(F.col("n") / text_block).cast("int").alias("blocks")), "blocks")
    wanted = scratch.save(trees.join(blocks, "tree").select("id", "tree", "blocks", "component"), "wanted")
    ids = wanted.select(F.col("id").alias("doc_id"))
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids) if few else ids.hint("merge"), "doc_id")
    # rows that share an id give each of their texts with each of their signatures; sets decide
    rows = wanted.join(signed, "id").join(texts.withColumnRenamed("doc_id", "id"), "id").withColumn("slot", F.lit(0).cast("byte"))
    more = scratch.save(blocked(rows, "tree").mapInArrow(thrifty(lambda b: links_in(b, width, percent)), "a long, b long").distinct(), "more-links")
    known = labels.select(F.col("id").alias("a"), F.col("component").alias("b"))
    labels = components(scratch, known.union(more), "second")
    # rows that share an id are one node, so the smallest component of its classes is the id's
    named = classes.select("s1", "s2", F.col("n_shingles").alias("n"), "id").join(labels, "id", "left")
    named = scratch.save(named.select("s1", "s2", "n", F.coalesce("component", "id").alias("component")), "named")
    scratch.drop("classes", "buckets", "hubs", "hub-links", "open", "near", "tree-links", "placed-trees", "blocks", "wanted", "more-links")
    s1, s2, n, group = fresh(docs, "a", "b", "n", "group")
    named = named.select(F.col("s1").alias(s1), F.col("s2").alias(s2), F.col("n").alias(n), F.col("component").alias(group))
    out = sets.join(named.hint("merge"), (F.col(own[0]) == F.col(s1)) & (F.col(own[1]) == F.col(s2)) & (F.col("n_shingles") == F.col(n)), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(group, "doc_id"))
    return out.select(*keep, "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(Scratch(spark, "nearpairs"), table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN c ON c.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

"""Substring dedup: repeated passages found by a log-structured index of window fingerprints.

A window is `width` consecutive words. A word is removed if a window over it also starts in a document
with a smaller id. The index keeps, in sorted immutable runs (bucketed Parquet), what the windows of all
earlier documents look like; each new batch is merge-joined with the runs, its matches are verified, its new
entries become a run, and runs are compacted into one when there are more than a few.

Not each window is stored. Of the `width - GRAM + 1` grams of GRAM words in a window the one with the least
hash is its anchor, so equal windows have equal anchors, and neighbouring windows mostly share one. All
windows of one anchor occurrence form a span: about one entry in 20 windows. A span whose whole word
sequence occurs in a smaller document is removed at once. Where spans of one anchor differ (the ends of a
copied passage, or a gram in several contexts), their single windows are made anew from the texts of their
first documents, earlier ones too, and compared; copies add nothing.

Verified means equal names of 128 bits of whole word sequences, made from the words' bytes or, of words of more
than 15 bytes, from their BLAKE2b digests (see `words`), not by an algebra that chosen words could defeat.

Batches must come in ascending order of ids. Defined cases: a null or empty text has no words; texts of
fewer than `width` words lose nothing; rows with the same id count as one document for each other, and each
gives a row; a null id is never compared (its words stay); repeats within one document stay; empty tables
give no rows; other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import Scratch, fresh, table
from tabulon.llm.words import Names, Words, followed, slices, thrifty, windows

#: Words in an anchor.
GRAM = 10
SPANS = "fp long, h1 long, h2 long, doc_id long, a int, b int"
KEY = ["fp", "h1", "h2"]
#: Entries of one anchor in a part of a run, so none is one task's alone.
HOT = 100_000


@contextmanager
def sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """While plans are made here, a bucket of one sorted file counts as sorted."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)




def anchors(words: Names, counts: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Spans of all texts: (text, first and last window start, anchor), starts counted over all texts."""
    n = len(words[0])
    grams = n - GRAM + 1
    per = width - GRAM + 1
    if grams < per:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    h = windows(words, GRAM)[0]
    # the place of the least gram in each run of `per` grams, the leftmost of equals, by doubling steps
    best = np.arange(grams)
    reach = 1
    while reach < per:
        step = min(reach, per - reach)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(h[right] < h[left], right, left)
        reach += step
    text = np.repeat(np.arange(len(counts)), counts)
    starts = np.flatnonzero(text[: n - width + 1] == text[width - 1 :])
    best, text = best[starts], text[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (best[1:] != best[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return text[first], starts[first], starts[last], h[best[first]]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def spans_of(docs: DataFrame, width: int) -> DataFrame:
    """SPANS of docs (doc_id, text): anchor, name of the span's whole word sequence, its windows' starts a to b.

    The first and the last window cover a span, so their names and distance name it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = Words(batch.column(1))
                words = found.names()
                text, a, b, fp = anchors(words, found.counts, width)
                x, y = windows(words, width)
                h1, h2 = followed((x[a], y[a]), (x[b] + (b - a).astype(np.uint64), y[b]))
                ids = batch.column(0).to_numpy(zero_copy_only=False)[text].astype(np.int64)
                base = found.first[text]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (signed(fp), signed(h1), signed(h2), ids, (a - base).astype(np.int32), (b - base).astype(np.int32))], names=SPANS.replace(" long", "").replace(" int", "").split(", "))

    whole = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return whole.mapInArrow(thrifty(run), SPANS)


def windows_of(texts: DataFrame, width: int) -> DataFrame:
    """(w1, w2, doc_id, start) of the windows in texts (doc_id, text, spans: array of (a, b))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                found = Words(batch.column(1))
                chosen, owner = [], []
                for k, spans in enumerate(batch.column(2).to_pylist()):
                    for s in spans:
                        chosen.append(np.arange(s["a"], s["b"] + 1) + found.first[k])
                        owner.append(np.full(s["b"] - s["a"] + 1, k))
                if not chosen:
                    continue
                at, owner = np.concatenate(chosen), np.concatenate(owner)
                inside = at + width <= found.first[owner + 1]  # ids that rows share may have spans of another text
                at, owner = at[inside], owner[inside]
                x, y = windows(found.names(), width)
                ids = batch.column(0).to_numpy(zero_copy_only=False)[owner].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (signed(x[at]), signed(y[at]), ids, (at - found.first[owner]).astype(np.int32))], names=["w1", "w2", "doc_id", "start"])

    return texts.select("doc_id", "text", "spans").mapInArrow(thrifty(run), "w1 long, w2 long, doc_id long, start int")


def first_of(spans: DataFrame) -> DataFrame:
    """The first occurrence of each span."""
    return spans.groupBy(*KEY).agg(F.min(F.struct("doc_id", "a", "b")).alias("at")).select(*KEY, "at.*")


@dataclass
class Run:
    """An immutable run: entries (KEY, doc_id, a, b, part), in buckets by (fp, part), each one file sorted by KEY.

    hot: (fp, parts) of the anchors with more than HOT entries, which are dealt over parts by h1; others have part 0.
    """

    entries: DataFrame
    hot: DataFrame
    names: tuple[str, str]


class FingerprintIndex:
    """Runs of first occurrences of spans, (fp, h1, h2) -> (doc_id, a, b).

    A batch is merge-joined with each run where it lies: the batch's anchors go to the runs' buckets, the
    runs are neither shuffled nor sorted again. When there are more than `most_runs`, they become one.
    """

    def __init__(self, scratch: Scratch, width: int = 50, most_runs: int = 2, buckets: int | None = None):
        self.scratch, self.width, self.most_runs = scratch, width, most_runs
        self.buckets = buckets or int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[Run] = []
        self.n = 0

    def _save(self, frame: DataFrame, name: str) -> DataFrame:
        return self.scratch.save(frame, f"{name}-{self.n}")

    def met(self, anchors: DataFrame) -> DataFrame | None:
        """(KEY, doc_id, a, b) of all runs' entries at the batch's distinct anchors (fp)."""
        out = None
        for run in self.runs:
            asked = anchors.select("fp").join(run.hot.hint("broadcast"), "fp", "left") if run.hot is not None else anchors.select("fp", F.lit(1).alias("parts"))
            asked = asked.select("fp", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
            found = run.entries.join(asked.hint("merge"), ["fp", "part"]).select(*KEY, "doc_id", "a", "b")
            out = found if out is None else out.union(found)
        return out

    def ingest(self, docs: DataFrame, corpus: DataFrame, last: bool = False) -> DataFrame:
        """Removed window starts (doc_id, a, b) of a batch; corpus (doc_id, text) holds the batch and all before it.

        last: no batch will follow, so this one becomes no run.
        """
        self.n += 1
        spans = self._save(spans_of(docs, self.width), "spans")
        anchors = self._save(spans.groupBy("fp").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")), "anchors")
        with sorted_buckets(self.scratch.spark):
            known = self.met(anchors)
            known = known if known is None else self._save(known, "known")
        # anchors that occur in two documents
        shared = anchors.filter("low < high").select("fp")
        if known is not None:
            shared = shared.union(known.select("fp")).distinct()
        shared = self._save(shared, "shared")
        met = self._save(spans.join(shared, "fp"), "met")
        places = met.select(*KEY, "doc_id", "a", "b")
        firsts = first_of(places if known is None else places.unionByName(known))
        firsts = self._save(firsts, "firsts")
        owner = firsts.select(*KEY, F.col("doc_id").alias("owner"))
        covered = met.join(owner.hint("merge"), KEY).filter("owner < doc_id").select("doc_id", "a", "b")
        # single windows, where one anchor has spans of different words
        several = self._save(firsts.groupBy("fp").agg(F.count("*").alias("k")).filter("k > 1").select("fp"), "several")
        mixed = self._save(firsts.join(several.hint("merge"), "fp").select(*KEY, "doc_id", "a", "b"), "mixed")
        out = covered
        if not mixed.isEmpty():
            # a span that its first document repeats isn't covered there, so all its places take part
            repeats = met.join(mixed.select(*KEY, "doc_id").hint("merge"), [*KEY, "doc_id"])
            each = mixed.select("doc_id", "a", "b").union(repeats.select("doc_id", "a", "b")).groupBy("doc_id").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
            texts = corpus.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(each, "doc_id")
            found = self._save(windows_of(texts, self.width), "windows")
            first = found.groupBy("w1", "w2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("other")).filter("owner < other").select("w1", "w2", "owner")
            first = self._save(first, "repeated")
            again = found.join(first.hint("merge"), ["w1", "w2"]).filter("owner < doc_id")
            batch = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct() if known is not None else None
            again = again.select("doc_id", F.col("start").alias("a"), F.col("start").alias("b"))
            out = out.union(again if batch is None else again.join(batch, "doc_id", "left_semi"))
        removed = self._save(out, "removed")
        if not last:  # the batch's first occurrences that the history lacks
            hot = anchors.filter(F.col("n") > HOT).select("fp", F.ceil(F.col("n") / HOT).cast("int").alias("parts"))
            new = first_of(spans)
            self.runs.append(self._run(new.join(known.select(*KEY), KEY, "left_anti") if known is not None else new, hot))
            if len(self.runs) > self.most_runs:
                self.compact()
        for name in ("spans", "anchors", "known", "shared", "met", "firsts", "several", "mixed", "windows", "repeated"):
            self.scratch.drop(f"{name}-{self.n}")
        return removed

    def _run(self, new: DataFrame, hot: DataFrame) -> Run:
        hot = self._save(hot, "hot")
        some = not hot.isEmpty()
        parts = F.coalesce("parts", F.lit(1)) if some else F.lit(1)
        dealt = new.join(hot, "fp", "left") if some else new
        dealt = dealt.select(*KEY, "doc_id", "a", "b", F.pmod("h1", parts).cast("int").alias("part"))
        entries = self.scratch.save_buckets(dealt, f"run-{self.n}", ["fp", "part"], ["fp", "part", "h1", "h2"], self.buckets)
        return Run(entries, hot if some else None, (f"run-{self.n}", f"hot-{self.n}"))

    def compact(self) -> None:
        """Makes one run of all; no two have the same key."""
        old, every, hot = self.runs, None, None
        for r in old:
            part = r.entries.drop("part")
            every = part if every is None else every.union(part)
            # counted in the buckets; an anchor with more than HOT entries in all has its share of them in some run
            many = r.entries.groupBy("fp", "part").agg(F.count("*").alias("n")).filter(F.col("n") * len(old) > HOT)
            hot = many if hot is None else hot.union(many)
        hot = hot.groupBy("fp").agg(F.sum("n").alias("n")).select("fp", F.ceil(F.col("n") * len(old) / HOT).cast("int").alias("parts"))
        self.n += 1
        self.runs = [self._run(every, hot)]
        self._forget(old)

    def _forget(self, runs: list[Run]) -> None:
        for r in runs:
            self.scratch.drop(*r.names)

    def close(self) -> None:
        """Deletes the runs; what `ingest` returned stays."""
        self._forget(self.runs)
        self.runs = []


def dedup(scratch: Scratch, docs: DataFrame, batches: int = 4, width: int = 50) -> DataFrame:
    """(doc_id, a, b): removed window starts of all docs (doc_id, text), taken in `batches` ranges of ids."""
    index, out = FingerprintIndex(scratch, width), None
    ids = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, high = (int(ids[0]), int(ids[1])) if ids[0] is not None else (0, 0)
    edges = [low + (high + 1 - low) * k // batches for k in range(batches + 1)]
    for k in range(batches):
        upto = docs.filter(F.col("doc_id") < edges[k + 1])
        removed = index.ingest(upto.filter(F.col("doc_id") >= edges[k]), upto, last=k + 1 == batches)
        out = removed if out is None else out.union(removed)
    index.close()
    return out


def kept_text(docs: DataFrame, removed: DataFrame, width: int = 50, digests: bool = False) -> DataFrame:
    """docs with n_words, n_removed and kept (the kept words, joined by spaces; with digests its SHA-256 in place of text)."""
    name = "kept_sha256" if digests else "kept"
    keep = [c for c in docs.columns if c not in ("n_words", "n_removed", name) and not (digests and c == "text")]
    whole, own, key = fresh(docs, "whole", "spans", "key")
    spans = removed.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("a", "b")).alias(own))
    source = docs.select(*keep, F.coalesce("text", F.lit("")).alias(whole)).join(spans, F.col("doc_id") == F.col(key), "left").drop(key)
    schema = T.StructType([*source.schema.fields[:-2], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows = []
                for text, spans in zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist(), strict=True):
                    words, gone = text.encode("utf-8", "surrogatepass").split(), 0
                    n = len(words)
                    if spans:
                        mark = np.zeros(n + 1, np.int64)
                        for s in spans:
                            if s["b"] + width <= n:
                                mark[s["a"]] += 1
                                mark[s["b"] + width] -= 1
                        stays = np.cumsum(mark[:-1]) == 0
                        gone = int(n - stays.sum())
                        words = [words[i] for i in np.flatnonzero(stays)]
                    kept = b" ".join(words)
                    rows.append((n, gone, hashlib.sha256(kept).hexdigest() if digests else kept.decode("utf-8", "surrogatepass")))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.string()], strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=[*keep, "n_words", "n_removed", name])

    return source.mapInArrow(thrifty(run), schema)


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    removed = dedup(Scratch(spark, "substrings"), docs)
    return kept_text(docs, removed, digests=True).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)),
f AS (SELECT h, min(doc_id) AS o FROM w GROUP BY h),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM w JOIN f USING (h) WHERE o < doc_id),
k AS (SELECT doc_id, count(*) AS n_removed, list(p) AS gone FROM p GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN coalesce(array_to_string(ws, ' '), '') ELSE coalesce((SELECT string_agg(x, ' ' ORDER BY i) FROM (SELECT unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i) q WHERE NOT list_contains(gone, i)), '') END) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items scans each text once.

Text is lower-cased (A-Z) and cut into words (ASCII letters and digits and all other characters from U+0080);
an item's patterns are its windows of `width` words, or all its words where there are fewer. Matches end at
positions of the normalised text and are mapped to words, and those to character offsets of the original.

The patterns are broadcast in groups of at most `group_bytes`, one automaton and one pass over the texts for
each group, so the broadcast's size is bounded however large the test set gets and no pattern is left out; the
results of all passes but the last are saved, so that no worker holds two automata.

Defined cases: a null or empty text has no words; items without words match nothing; equal items are all
reported; an item with a null id counts for hits but has no id to report; repeated documents give a row
each; empty tables give no hits or no rows; other columns of the documents pass through.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import Scratch, table
from tabulon.llm.words import thrifty

_KEEP = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
#: Lower-cases A-Z and puts a space for every byte that isn't part of a word.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEEP else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def windows(words: list[bytes], width: int) -> list[bytes]:
    if not words:
        return []
    return [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


def pattern_groups(benchmark: DataFrame, width: int, group_bytes: int) -> Iterator[dict[bytes, tuple[int, list]]]:
    """Dicts of window -> (words, item ids), each of bounded size; the items stream through the driver."""
    group: dict[bytes, tuple[int, list]] = {}
    size = 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        words = words_of(row["text"])
        for w in dict.fromkeys(windows(words, width)):
            if w not in group:
                group[w] = (min(width, len(words)), [])
                size += len(w) + 2
            if row["item_id"] is not None:
                group[w][1].append(row["item_id"])
                size += 8
        if size >= group_bytes:
            yield group
            group, size = {}, 0
    if group:
        yield group


_BUILT: dict[str, tuple] = {}


def automaton(key: str, patterns: dict[bytes, tuple[int, list]]):
    """Built once in each worker process; only the newest is kept."""
    if key not in _BUILT:
        import ahocorasick

        _BUILT.clear()
        found = ahocorasick.Automaton()
        for w, value in patterns.items():
            found.add_word(f" {w.decode('latin-1')} ", value)
        found.make_automaton()
        _BUILT[key] = found
    return _BUILT[key]


def covered(text: str | None, machine) -> tuple[int, list[tuple[int, int]], set]:
    """(words in the text, spans of hit words [first, last], ids of the items with a window in it)."""
    words = words_of(text)
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    spans, items, ends = [], set(), None
    for end, (k, ids) in machine.iter(line):
        if ends is None:
            ends = np.cumsum([len(w) + 1 for w in words])
        last = int(np.searchsorted(ends, end))
        items.update(ids)
        first = last - k + 1
        while spans and first <= spans[-1][1] + 1:
            f, e = spans.pop()
            first, last = min(first, f), max(last, e)
        spans.append((first, last))
    return len(words), spans, items


def offsets(text: str, spans: list[tuple[int, int]]) -> list[dict]:
    """The spans with their character offsets [start, end) in the original text."""
    raw = text.encode("utf-8", "surrogatepass")
    inside = np.frombuffer(raw.translate(FOLD), np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    begins = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    place = lambda byte: int(begins[byte - 1]) if byte else 0
    return [{"first": f, "last": e, "start": place(int(edge[2 * f])), "end": place(int(edge[2 * e + 1]))} for f, e in spans]


SPANS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("first", "last", "start", "end")]))
_SPANS = pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "last", "start", "end")]))
OWN = ["n_words", "n_hit", "spans", "items"]


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, group_bytes: int = 32 << 20) -> DataFrame:
    """docs with n_words, n_hit, spans (of hit words, with offsets) and items (ids of items found)."""
    keep = [c for c in docs.columns if c not in OWN]
    out = docs.select(*keep)
    extra = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.LongType()))]
    schema = T.StructType([*out.schema.fields, *extra])
    sc, passes = docs.sparkSession.sparkContext, 0
    scratch = None
    for group in pattern_groups(benchmark, width, group_bytes) if not benchmark.isEmpty() else []:
        if passes:  # a pass is a job of its own, so a worker holds one automaton
            scratch = scratch or Scratch(docs.sparkSession, "contamination")
            out = scratch.save(out, f"pass-{passes}")
        out = out.mapInArrow(scan(sc.broadcast(group), uuid.uuid4().hex, keep, passes > 0), schema)
        passes += 1
    if not passes:
        out = out.mapInArrow(scan(sc.broadcast({}), uuid.uuid4().hex, keep, False), schema)
    return out


def scan(patterns, key: str, keep: list[str], more: bool):
    """One pass; `more`: the batches carry the results of earlier ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(key, patterns.value) if patterns.value else None
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                had = batch.select(["spans", "items"]).to_pylist() if more else None
                rows = []
                for k, text in enumerate(batch.column(keep.index("text")).to_pylist()):
                    n, spans, items = covered(text, machine) if machine is not None else (len(words_of(text)), [], set())
                    if had and (had[k]["spans"] or had[k]["items"]):
                        spans = merged([*spans, *[(s["first"], s["last"]) for s in had[k]["spans"]]])
                        items |= set(had[k]["items"])
                    rows.append((n, sum(e - f + 1 for f, e in spans), offsets(text, spans) if spans else [], sorted(items)))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), _SPANS, pa.list_(pa.int64())], strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(keep.index(c)) for c in keep], *columns], names=[*keep, *OWN])

    return thrifty(run)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
bw AS (SELECT item_id, ws, least(len(ws), 10) AS k, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS w FROM bw),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
dw AS (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) s WHERE len(ws) >= k),
occ AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN win ON win.k = dw.k AND win.w = array_to_string(ws[i:i + dw.k - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(x, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id
"""

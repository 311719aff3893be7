"""LM scoring: the marginal likelihood of texts over all segmentations into pieces of a given vocabulary.

A text is words (A-Z lower-cased, cut at `[\\x20\\x09-\\x0D]`), then an end. The model draws words until the
end: one met in training, by its count less a discount, or with the discounted share a new one, spelt as a
first piece, further pieces and a stop. Pieces are those of an existing vocabulary; its scores give their
first weights (a merge-type vocabulary scores by rank, read as Zipf's law), and expected counts over all
segmentations of all training words refine them. A word's probability adds every segmentation, by a
forward recursion in log space over the word's lattice; a text's is the product over its words and its
end. It sums to at most 1 over all texts.

What is learned grows with the corpus: a table of all words with their counts, kept as Parquet. The
commonest words, at most `head` of them, are broadcast for scoring; all others are joined. A word's
lattice is computed once, however often the word occurs.

Defined cases: a null text is empty and has one token, the end; repeated rows are scored each; without
training rows every count is 0 and the pieces keep their first weights; whole texts and words of any
length are scored; the caller's other columns aren't read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import Scratch, table
from tabulon.llm.pieces import SPACE, default_model
from tabulon.llm.words import LOWER_BYTES, thrifty

#: Words of more bytes are taken one by one, over their positions.
LONG = 64
#: Weight of the vocabulary's own scores against the corpus, in pieces.
PRIOR = 5000.0
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()


class Vocabulary:
    """Pieces as bytes (a word's mark is a space), found by hash; single bytes are always pieces."""

    def __init__(self, model: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=model)
        n = lib.get_piece_size()
        score = np.array([lib.get_score(i) for i in range(n)])
        self.bytes: list[bytes] = []
        prior = []
        ranked = {i: r for r, i in enumerate(sorted((i for i in range(n) if score[i] < 0), key=lambda i: -score[i]))}
        for i in range(n):
            text = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.bytes.append(bytes([int(text[3:-1], 16)]))
                prior.append(1 / (2.7 + n))
            elif not (lib.is_control(i) or lib.is_unknown(i)):
                self.bytes.append(text.replace(SPACE, " ").encode())
                prior.append(1 / (2.7 + ranked.get(i, n)))
        have = set(self.bytes)
        for b in range(256):
            if bytes([b]) not in have:
                self.bytes.append(bytes([b]))
                prior.append(1 / (2.7 + n))
        kept: dict[bytes, float] = {}
        for b, p in zip(self.bytes, prior, strict=True):
            kept[b] = kept.get(b, 0) + p
        self.bytes, self.prior = list(kept), np.array(list(kept.values()))
        self.prior /= self.prior.sum()
        self.size = len(self.bytes)
        self.begins = np.array([b.startswith(b" ") for b in self.bytes])
        usable = [i for i, b in enumerate(self.bytes) if b" " not in b[1:]]
        self.longest = max(len(self.bytes[i]) for i in usable)
        keys = np.array([self.hash_of(self.bytes[i]) for i in usable], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(usable, np.int32)[order]
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces have one hash")
        # Slots by the hash's high bits: the place of the first key that may be there, and how many share it.
        self.bits = 18
        slot = (self.mixed(self.keys) >> np.uint64(64 - self.bits)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        self.keys, self.ids, slot = self.keys[order], self.ids[order], slot[order]
        self.slot = np.searchsorted(slot, np.arange(1 << self.bits)).astype(np.int32)
        self.deepest = int(np.bincount(slot).max())
        self.keys = np.concatenate([self.keys, np.zeros(self.deepest, np.uint64)])
        self.ids = np.concatenate([self.ids, np.full(self.deepest, self.size, np.int32)])

    @staticmethod
    def mixed(h: np.ndarray) -> np.ndarray:
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)

    @staticmethod
    def hash_of(data: bytes) -> int:
        h = 0
        for b in data:
            h = (h * int(_BASE) + b + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes; `size` where there is none."""
        at = self.slot[self.mixed(h) >> np.uint64(64 - self.bits)]
        out = np.full(len(h), self.size, np.int32)
        for d in range(self.deepest):
            same = self.keys[at + d] == h
            if same.any():
                out[same] = self.ids[at + d][same]
        return out


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(model: str) -> Vocabulary:
    if model not in _VOCABULARIES:
        _VOCABULARIES[model] = Vocabulary(model)
    return _VOCABULARIES[model]


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The batches joined to larger ones: words of one length are scored together, the more the cheaper."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows or sum(b.nbytes for b in held) >= 16 << 20:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def by_length(words: list[bytes], most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, bytes as rows) of words of one length with their mark, in blocks of bounded size; long words each alone."""
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths):
        places = np.flatnonzero(lengths == length)
        step = max(1, most // (int(length) + 1) // 8) if length <= LONG else 1
        for k in range(0, len(places), step):
            part = places[k : k + step]
            yield part, np.frombuffer(b"".join(b" " + words[i] for i in part), np.uint8).reshape(len(part), length + 1)


def matches(vocab: Vocabulary, data: np.ndarray, low: int, high: int) -> list[list[tuple[int, int]]]:
    """For each end from low + 1 to high, the (start, piece) of all pieces that end there."""
    begin = max(0, low + 1 - vocab.longest)
    code = data[begin:high].astype(np.uint64) + np.uint64(1)
    h = np.zeros(len(code), np.uint64)
    found: list[list[tuple[int, int]]] = [[] for _ in range(high - low)]
    for length in range(1, min(vocab.longest, len(code)) + 1):
        h = h[: len(code) - length + 1] * _BASE + code[length - 1 :]
        first = max(0, low + 1 - length - begin)
        ids = vocab.find(h[first:])
        for k in np.flatnonzero(ids != vocab.size).tolist():
            start = begin + first + k
            found[start + length - low - 1].append((start, int(ids[k])))
    return found


def summed(terms: list[float]) -> float:
    top = max(terms, default=-math.inf)
    return top if top == -math.inf else top + math.log(sum([math.exp(t - top) for t in terms]))


def forward_long(vocab: Vocabulary, data: np.ndarray, logp: np.ndarray, step: int = 4096) -> np.ndarray:
    """log of the sum over all segmentations of data[:k], for every k; work and memory follow the pieces met."""
    at = np.full(len(data) + 1, -np.inf)
    at[0] = 0
    for low in range(0, len(data), step):
        for end, here in enumerate(matches(vocab, data, low, min(low + step, len(data))), low + 1):
            at[end] = summed([at[start] + logp[piece] for start, piece in here])
    return at


def expected_long(vocab: Vocabulary, data: np.ndarray, logp: np.ndarray, step: int = 4096) -> np.ndarray:
    """Expected counts of the pieces over all segmentations of one long word; the way back finds its pieces anew."""
    ahead = forward_long(vocab, data, logp, step)
    back = np.full(len(data) + 1, -np.inf)
    back[-1] = 0
    out = np.zeros(vocab.size + 1)
    for low in range((len(data) - 1) // step * step, -1, -step):
        high = min(low + step, len(data))
        for end, here in zip(range(high, low, -1), reversed(matches(vocab, data, low, high)), strict=True):
            for start, piece in here:
                value = logp[piece] + back[end]
                out[piece] += math.exp(min(ahead[start] + value - ahead[-1], 0.0)) if value > -math.inf else 0.0
                back[start] = np.logaddexp(back[start], value)
    return out[:-1]


def edges(vocab: Vocabulary, rows: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, end, rows in which that span is a piece, the pieces) by end."""
    n, length = rows.shape
    total = np.zeros((length + 1, n), np.uint64)
    for i in range(length):
        total[i + 1] = total[i] * _BASE + rows[:, i] + np.uint64(1)
    power = [np.uint64(1)]
    with np.errstate(over="ignore"):
        for _ in range(vocab.longest):
            power.append(power[-1] * _BASE)
    for end in range(1, length + 1):
        for start in range(max(0, end - vocab.longest), end):
            ids = vocab.find(total[end] - total[start] * power[end - start])
            some = np.flatnonzero(ids != vocab.size)
            if len(some):
                yield start, end, some, ids[some]


def forward(vocab: Vocabulary, rows: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """log of the sum over all segmentations of each row."""
    if rows.shape[1] > LONG + 1:
        return np.array([forward_long(vocab, row, logp)[-1] for row in rows])
    at = np.full((rows.shape[1] + 1, len(rows)), -np.inf)
    at[0] = 0
    for start, end, some, ids in edges(vocab, rows):
        at[end, some] = np.logaddexp(at[end, some], at[start, some] + logp[ids])
    return at[-1]


def expected(vocab: Vocabulary, rows: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces over all segmentations of all rows."""
    if rows.shape[1] > LONG + 1:
        return sum((expected_long(vocab, row, logp) for row in rows), np.zeros(vocab.size))
    found = list(edges(vocab, rows))
    ahead = np.full((rows.shape[1] + 1, len(rows)), -np.inf)
    back = ahead.copy()
    ahead[0] = back[-1] = 0
    for start, end, some, ids in found:
        ahead[end, some] = np.logaddexp(ahead[end, some], ahead[start, some] + logp[ids])
    pieces, shares = [], []
    for start, end, some, ids in sorted(found, key=lambda e: -e[0]):
        value = logp[ids] + back[end, some]
        pieces.append(ids)
        shares.append(np.exp(ahead[start, some] + value - ahead[-1, some]))
        back[start, some] = np.logaddexp(back[start, some], value)
    return np.bincount(np.concatenate(pieces), np.concatenate(shares), vocab.size) if pieces else np.zeros(vocab.size)


def log_weights(vocab: Vocabulary, weights: np.ndarray, words: float) -> tuple[np.ndarray, float]:
    """(log p by piece, log p of a stop): first pieces add up to 1, further ones and the stop too.

    -inf stands behind, where `find` points without a piece.
    """
    ahead, rest = weights[vocab.begins].sum(), weights[~vocab.begins].sum() + words
    p = np.where(vocab.begins, weights / ahead, weights / rest)
    with np.errstate(divide="ignore"):
        return np.append(np.log(p), -np.inf), math.log(words / rest)


@dataclass
class Model:
    """The learned counts: `words` (word binary, n, c; natural logs lp of the mixture, lat of the lattice alone) and the numbers that scores need."""

    words: DataFrame
    ends: int
    tokens: int
    types: int
    discount: float
    total: float
    pieces: np.ndarray
    head_from: int

    def base(self, c):
        """log10((c + 0.5) / (N + 0.5 (V + 1))) of counts, in numpy or of a column."""
        most = self.tokens + 0.5 * (self.types + 1)
        return F.log10((c + 0.5) / F.lit(most)) if isinstance(c, Column) else np.log10((c + 0.5) / most)

    @property
    def end(self) -> float:
        return math.log(max(self.ends, 0.5) / self.total)


def count_words(docs: DataFrame, learn: str, flush: int = 150_000) -> DataFrame:
    """(word, n, c): occurrences in all rows and in those where `learn` holds, added up before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every: Counter = Counter()
        taught: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = list(every)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(every.values(), pa.int64()), pa.array([taught[w] for w in words], pa.int64())], names=["word", "n", "c"])

        for batch in batches:
            for text, ok in zip(batch.column(0), batch.column(1), strict=True):
                words = tokens(text.as_py())
                every.update(words)
                if ok.as_py():
                    taught.update(words)
                if len(every) >= flush:
                    yield out()
                    every.clear()
                    taught.clear()
        if every:
            yield out()

    parts = docs.select("text", F.coalesce(learn, F.lit(False)).alias("learn")).mapInArrow(thrifty(count), "word binary, n long, c long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def train(scratch: Scratch, docs: DataFrame, learn: str, model: str | None = None, rounds: int = 2, head: int = 1 << 18) -> Model:
    """Learns from the rows of docs (text) where the column `learn` holds; lists the words of all rows."""
    spark, model = scratch.spark, model or default_model()
    words = scratch.save(count_words(docs, learn), "counts")
    ends = docs.filter(learn).count()
    size = F.floor(F.log2("n") * 8).alias("size")
    bins = words.groupBy(size).agg(F.count("*").alias("k"), F.min("n").alias("low"), F.sum("c").alias("c"), F.sum((F.col("c") > 0).cast("long")).alias("v"), F.sum((F.col("c") == 1).cast("long")).alias("n1"), F.sum((F.col("c") == 2).cast("long")).alias("n2")).orderBy(F.desc("size")).collect()
    held, types, seen, n1, n2 = sum(b["c"] for b in bins), sum(b["v"] for b in bins), 0, sum(b["n1"] for b in bins), sum(b["n2"] for b in bins)
    head_from = 1 << 62
    for b in bins:
        seen += b["k"]
        if seen > head:
            break
        head_from = b["low"]
    discount = n1 / (n1 + 2 * n2) if n1 else 0.5
    vocab = vocabulary(model)
    counts, spelt = PRIOR * vocab.prior, PRIOR / 4
    sc = spark.sparkContext
    for _ in range(rounds if types else 0):
        weights = sc.broadcast(log_weights(vocab, counts, spelt)[0])

        def expect(batches: Iterator[pa.RecordBatch], weights=weights) -> Iterator[pa.RecordBatch]:
            v, logp = vocabulary(model), weights.value
            total = np.zeros(v.size)
            for batch in gathered(batches):
                for _, rows in by_length(batch.column(0).to_pylist()):
                    total += expected(v, rows, logp)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["piece", "k"])

        found = words.filter("c > 0").select("word").mapInArrow(thrifty(expect), "piece int, k double").groupBy("piece").agg(F.sum("k").alias("k")).collect()
        counts, spelt = PRIOR * vocab.prior, PRIOR / 4 + types
        for r in found:
            counts[r["piece"]] += r["k"]
    total = max(held + ends, 1)
    new = max(discount * types, 0.5) / total
    logp, stop = log_weights(vocab, counts, spelt)
    logp, spell, alone = sc.broadcast(logp), stop + math.log(new), stop + math.log(max(total - ends, 0.5) / total)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in gathered(batches):
            c = batch.column(2).to_numpy().astype(float)
            lp = np.empty(batch.num_rows)
            for places, rows in by_length(batch.column(0).to_pylist()):
                lp[places] = forward(v, rows, logp.value)
            with np.errstate(divide="ignore"):
                both = np.logaddexp(lp + spell, np.log(np.maximum(c - discount, 0) / total))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(both), pa.array(lp + alone)], names=["word", "n", "c", "lp", "lat"])

    scored = scratch.save(words.mapInArrow(thrifty(score), "word binary, n long, c long, lp double, lat double"), "words")
    scratch.drop("counts")
    return Model(scored, ends, held + ends, types + (ends > 0), discount, total, counts, head_from)


def score(scratch: Scratch, docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """keep, n_tokens, n_known, base_score, score and lattice_score (log10) of every row of docs (text).

    lattice_score is the marginal of the lattice alone, without the words' counts. Rows are numbered once, in the
    plan that is saved, and all that follows reads what was saved.
    """
    top = model.words.filter((F.col("n") >= model.head_from) & (F.octet_length("word") <= LONG)).select("word", "c", "lp", "lat").toArrow()
    # at most `head` words of at most LONG bytes: their bound is a parameter of train()
    head = scratch.spark.sparkContext.broadcast((top.column("word").to_pylist(), *[top.column(c).to_numpy() for c in ("c", "lp", "lat")]))
    end_base, end_known, end_lp = float(model.base(np.array([model.ends]))[0]), int(model.ends > 0), model.end / math.log(10)
    most = model.tokens + 0.5 * (model.types + 1)
    numbers = {"k": "long", "n_known": "long", "base": "double", "lp": "double", "lat": "double"}
    held = docs.select(F.struct(*keep).alias("kept"), "text").withColumn("rid", F.monotonically_increasing_id())
    kinds = T.StructType([T.StructField("rid", T.LongType()), T.StructField("kept", held.schema["kept"].dataType), T.StructField("word", T.BinaryType()), *[T.StructField(n, T.LongType() if k == "long" else T.DoubleType()) for n, k in numbers.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, c, lp, lat = head.value
        place = {w: i for i, w in enumerate(words)}
        values = [np.append(x, 0.0) for x in (np.log10((c + 0.5) / most), lp / math.log(10), lat / math.log(10))]
        known = np.append(c > 0, False)
        last, get = len(words), place.get
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                row, word, *sums = out = tuple([] for _ in range(7))
                for k, text in enumerate(batch.column(1).to_pylist()):
                    said = tokens(text)
                    found = np.array([get(w, last) for w in said], np.int64) if said else np.zeros(0, np.int64)
                    rest = Counter([said[i] for i in np.flatnonzero(found == last)])
                    base, mixed, alone = [float(v[found].sum()) for v in values]
                    for column, x in zip(out, (k, None, len(said) + 1, int(known[found].sum()) + end_known, base + end_base, mixed + end_lp, alone + end_lp), strict=True):
                        column.append(x)
                    if rest:
                        n = len(rest)
                        for column, x in zip(out, ([k] * n, list(rest), list(rest.values()), [0] * n, *[[0.0] * n] * 3), strict=True):
                            column.extend(x)
                row = pa.array(row, pa.int64())
                kept = batch.column(0).take(pa.compute.if_else(pa.array([w is None for w in word], pa.bool_()), row, None))
                types = [pa.int64(), pa.int64(), *[pa.float64()] * 3]
                yield pa.RecordBatch.from_arrays([batch.column(2).take(row), kept, pa.array(word, pa.binary()), *[pa.array(x, t) for x, t in zip(sums, types, strict=True)]], names=["rid", "kept", "word", *numbers])

    parts = scratch.save(held.mapInArrow(thrifty(run), kinds), "parts")
    tail = parts.filter("word IS NOT NULL").select("rid", "word", "k").join(model.words.select("word", "c", "lp", "lat"), "word", "left")
    c, k = F.coalesce("c", F.lit(0)), F.col("k")
    tail = tail.select("rid", F.when(c > 0, k).otherwise(0).alias("known"), (k * model.base(c)).alias("base2"), (k * F.col("lp") / math.log(10)).alias("lp2"), (k * F.col("lat") / math.log(10)).alias("lat2"))
    tail = tail.groupBy("rid").agg(*[F.sum(x).alias(x) for x in ("known", "base2", "lp2", "lat2")])
    both = parts.filter("word IS NULL").join(tail.hint("merge"), "rid", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return both.select("kept.*", F.col("k").alias("n_tokens"), plus("n_known", "known").alias("n_known"), plus("base", "base2").alias("base_score"), plus("lp", "lp2").alias("score"), plus("lat", "lat2").alias("lattice_score"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "lattice")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.crc32(F.col("doc_id").cast("string")) % 5 == 1).alias("held_out"))
    model = train(scratch, docs.select("text", (~F.col("held_out")).alias("learn")), "learn")
    scored = score(scratch, docs, model, ["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "lattice_score")

"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Adjacent symbols are merged in the order of an agenda: pairs by score, then position. Symbols without a
piece fall back to their bytes. Text is first cut where no piece of the vocabulary joins the two
neighbouring characters, which no merge can cross. Of the stretches between, the distinct ones of up to
SHORT characters are merged all at once: in each round every stretch takes the first best pair of its
agenda, in numpy. A longer stretch has a heap of its own, where pairs whose symbols have changed are
skipped. Each Arrow batch holds every distinct stretch, and one text as it stands, against the sentencepiece
library's encoding and decoding.

Memory follows PART characters, not the text: a longer text is taken in parts, cut where no merge can cross,
whose ids and texts are joined (or hashed one after the other). Only a stretch itself is never cut.

Defined cases: a null text counts as empty; an empty text has no ids and decodes to itself; U+2581 in a
text is a space, as in the library; whole texts of any length are encoded; repeated rows and ids give a
row each; an empty table gives no rows; the caller's other columns pass through unread, whatever their
names (columns named as the result's are replaced).

Models handled: identity normalisation with a dummy prefix, white space kept, byte fallback. Others are
refused by the check of the first batch.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby
from operator import concat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import fresh, table
from tabulon.llm.words import mix, thrifty

SPACE = "▁"
#: Stretches of up to so many characters are merged together.
SHORT = 48
#: Characters that are encoded at a time.
PART = 1 << 19
#: A character that no piece has; it keeps a part's first symbol from the library's prefix.
GUARDS = map(chr, range(0xE000, 0xF8FF))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A vocabulary, and what is needed to merge, cut and decode with it."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        lib, n = self.library, self.library.get_piece_size()
        self.text = [lib.id_to_piece(i) for i in range(n)]
        self.byte = {int(self.text[i][3:-1], 16): i for i in range(n) if lib.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.unknown = lib.unk_id()
        self.control = {i for i in range(n) if lib.is_control(i)}
        special = self.control | set(self.byte_of) | {self.unknown}
        self.ids = {self.text[i]: i for i in range(n) if i not in special}
        #: How late a pair that makes this piece is merged.
        self.rank = {p: -lib.get_score(i) for p, i in self.ids.items()}
        self.digits = [str(i) for i in range(n)]
        #: What each piece decodes to, as bytes.
        self.raw = [self.text[i].replace(SPACE, " ").encode() for i in range(n)]
        for i, b in self.byte_of.items():
            self.raw[i] = bytes([b])
        for i in self.control:
            self.raw[i] = b""
        self.raw[self.unknown] = " ⁇ ".encode()
        self.guard = next(c for c in GUARDS if not any(c in p for p in self.ids))
        self.tables(n)

    def tables(self, n: int) -> None:
        """Symbols are numbered: pieces by their ids, then characters that only longer pieces have, then any other."""
        chars = sorted({c for p in self.ids for c in p})
        symbol = dict(self.ids)
        for c in chars:
            symbol.setdefault(c, n + len(symbol) - len(self.ids))
        self.other = n + len(symbol) - len(self.ids)
        #: By code point: the symbol's number, and a number of the characters that pieces have (0: none has it).
        self.symbols = np.full(0x110000, self.other, np.int32)
        self.classes = np.zeros(0x110000, np.int32)
        for k, c in enumerate(chars, 1):
            self.symbols[ord(c)], self.classes[ord(c)] = symbol[c], k
        self.wide = len(chars) + 1
        #: Whether some piece has the characters of two classes side by side.
        self.joined = np.zeros(self.wide * self.wide, bool)
        for p in self.ids:
            row = self.classes[np.frombuffer(p.encode("utf-32-le"), np.uint32)]
            self.joined[row[:-1] * self.wide + row[1:]] = True
        #: Places of pieces in the agenda's order; the last stands for no piece.
        late = np.full(n + 1, np.inf)
        for p, i in self.ids.items():
            late[i] = self.rank[p]
        self.order = np.unique(late, return_inverse=True)[1].astype(np.int64)
        self.never = int(self.order[n])
        # pairs of symbols that a piece joins, by slots of their hashes
        left, right, made = [], [], []
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = symbol.get(p[:k]), symbol.get(p[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(i)
        keys = self.pair(np.array(left, np.int64), np.array(right, np.int64))
        slot = self.slot(keys)
        at = np.argsort(slot, kind="stable")
        self.begins = np.searchsorted(slot[at], np.arange((1 << 20) + 1)).astype(np.int32)
        self.deepest = int(np.diff(self.begins).max()) if len(at) else 0
        self.keys = np.concatenate([keys[at], np.full(self.deepest, -1)])
        self.made = np.concatenate([np.array(made, np.int32)[at], np.full(self.deepest, n, np.int32)])
        self.none = n

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.astype(np.int64) << 32 | b.astype(np.int64)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.view(np.uint64)) >> np.uint64(44)).astype(np.int64)

    def joins(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The pieces that join symbols a[i] and b[i]; `none` where there is none."""
        keys = self.pair(a, b)
        at = self.begins[self.slot(keys)]
        out = np.where(self.keys[at] == keys, self.made[at], self.none)
        for d in range(1, self.deepest):
            same = self.keys[at + d] == keys
            out[same] = self.made[at + d][same]
        return out

    def agenda(self, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What merging leaves of the stretches symbols[first[k]:first[k + 1]]: symbols, and their number in each.

        One round takes the best pair of every stretch that still has one, the leftmost of equals.
        """
        symbols = symbols.copy()
        alive = np.ones(len(symbols), bool)
        place, begin = np.arange(len(symbols)), first[:-1]
        made = np.full(len(symbols), self.none, np.int32)
        made[:-1] = self.joins(symbols[:-1], symbols[1:])
        made[first[1:] - 1] = self.none
        while len(begin):
            at = np.arange(len(place))
            best = np.minimum.reduceat(self.order[made] << 32 | at, begin)
            open_ = best >> 32 < self.never
            i = best[open_] & 0xFFFFFFFF
            if not len(i):
                break
            size = np.diff(np.append(begin, len(place)))
            symbols[place[i]] = made[i]
            alive[place[i + 1]] = False
            stays = np.repeat(open_, size)
            stays[i + 1] = False
            # where the merged symbols are now, and whether their stretches go on behind and before them
            ends = (begin + size)[open_]
            starts = begin[open_]
            after, before = i + 2 < ends, i > starts
            made[i] = self.none
            made[i[after]] = self.joins(symbols[place[i[after]]], symbols[place[i[after] + 2]])
            made[i[before] - 1] = self.joins(symbols[place[i[before] - 1]], symbols[place[i[before]]])
            place, made = place[stays], made[stays]
            size = size[open_] - 1
            begin = np.cumsum(size) - size
        return symbols[alive], np.add.reduceat(alive, first[:-1], dtype=np.int64)

    def merge(self, stretch: str) -> list[str]:
        """The symbols that the agenda leaves of one stretch of any length."""
        symbols: list[str | None] = list(stretch)
        n, rank = len(symbols), self.rank.get
        agenda = [(r, i, i + 1, both) for i, both in enumerate(map(concat, stretch, stretch[1:])) if (r := rank(both)) is not None]
        if not agenda:
            return symbols
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapq.heapify(agenda)
        pop, push = heapq.heappop, heapq.heappush
        while agenda:
            _, i, j, both = pop(agenda)
            left, right = symbols[i], symbols[j]
            if left is None or right is None or left + right != both or after[i] != j:
                continue
            symbols[i], symbols[j] = both, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                new = both + symbols[k]
                if (r := rank(new)) is not None:
                    push(agenda, (r, i, k, new))
            h = before[i]
            if h >= 0:
                new = symbols[h] + both
                if (r := rank(new)) is not None:
                    push(agenda, (r, h, i, new))
        return [x for x in symbols if x is not None]

    def fallback(self, symbol: str) -> list[int]:
        return [self.byte[b] for b in symbol.encode("utf-8", "surrogatepass")] if self.byte else [self.unknown]

    def stretch_ids(self, stretch: str) -> list[int]:
        found = []
        for symbol in self.merge(stretch):
            known = self.ids.get(symbol)
            found += self.fallback(symbol) if known is None else [known]
        return found

    def encode(self, parts: list[str]) -> tuple[list[list[int]], list[str], list[list[int]]]:
        """Ids of each of some not empty texts, in which spaces are marks already; the distinct stretches and their ids."""
        lengths = np.array([len(p) for p in parts])
        line = "".join(parts)
        code = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.classes[code]
        cut = ~self.joined[kind[:-1] * self.wide + kind[1:]]
        borders = np.cumsum(lengths)
        cut[borders[:-1] - 1] = True
        starts = np.concatenate([[0], np.flatnonzero(cut) + 1])
        sizes = np.diff(np.append(starts, len(code)))
        rep, inverse = distinct(code, starts, sizes)
        # ids of distinct stretches, short ones first
        begin, size = starts[rep], sizes[rep]
        short = size <= SHORT
        first = np.concatenate([[0], np.cumsum(size[short])])
        where = ranges(begin[short], size[short])
        ids, count = self.agenda(self.symbols[code[where]], first) if len(where) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        spelt = ids >= self.none
        if spelt.any():  # characters without a piece are stretches of one symbol, or left alone in theirs
            ids, count = self.spelt(ids, count, spelt, code[where], first)
        order = np.concatenate([np.flatnonzero(short), np.flatnonzero(~short)])
        stretches = [line[b : b + s] for b, s in zip(begin[order].tolist(), size[order].tolist(), strict=True)]
        long = [self.stretch_ids(x) for x in stretches[len(first) - 1 :]]
        number = np.empty(len(rep), np.int64)
        number[order] = np.arange(len(rep))
        count = np.concatenate([count, np.array([len(x) for x in long], np.int64)])
        ids = np.concatenate([ids, *[np.array(x, np.int32) for x in long]]) if long else ids
        offset = np.cumsum(count) - count
        # each stretch of the texts takes its ids
        use = number[inverse]
        whole = ids[ranges(offset[use], count[use])]
        upto = np.concatenate([[0], np.cumsum(count[use])])
        edge = upto[np.searchsorted(starts, np.concatenate([[0], borders]))].tolist()
        own = ids.tolist()
        each = [own[a:b] for a, b in zip(offset.tolist(), (offset + count).tolist(), strict=True)]
        return [whole[a:b].tolist() for a, b in zip(edge, edge[1:], strict=False)], stretches, each

    def spelt(self, ids: np.ndarray, count: np.ndarray, spelt: np.ndarray, code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts with the bytes of the characters that have no piece."""
        owner = np.repeat(np.arange(len(count)), count)
        out = []
        for k in np.unique(owner[spelt]).tolist():
            out.append((k, self.stretch_ids(code[first[k] : first[k + 1]].tobytes().decode("utf-32-le", "surrogatepass"))))
        new = count.copy()
        new[[k for k, _ in out]] = [len(x) for _, x in out]
        result = np.empty(int(new.sum()), np.int32)
        begin, old = np.cumsum(new) - new, np.cumsum(count) - count
        same = np.ones(len(count), bool)
        same[[k for k, _ in out]] = False
        result[ranges(begin[same], new[same])] = ids[ranges(old[same], count[same])]
        for k, x in out:
            result[begin[k] : begin[k] + len(x)] = x
        return result, new

    def decode(self, ids: list[int], first: bool = True) -> str:
        """The text of ids; `first` drops the space of the dummy prefix."""
        try:
            text = b"".join([self.raw[i] for i in ids]).decode()
        except UnicodeDecodeError:  # bytes that are no characters
            text = self.decode_bytes(ids)
        if first and text.startswith(" "):
            begins = next((i for i in ids if i not in self.control), None)  # a byte keeps its space
            if begins not in self.byte_of and begins != self.unknown:
                return text[1:]
        return text

    def decode_bytes(self, ids: list[int]) -> str:
        out: list[str] = []
        for is_byte, run in groupby(ids, self.byte_of.__contains__):
            data = b"".join([self.raw[i] for i in run])
            out.append(decoded_bytes(data) if is_byte else data.decode())
        return "".join(out)

    def parts(self, text: str, most: int = PART) -> Iterator[str]:
        """The text with its prefix and marks, in parts of about `most` characters that no merge joins."""
        marked = SPACE + text.replace(" ", SPACE)
        at = 0
        while len(marked) - at > most:
            to = at + most
            while to < len(marked) and self.together(marked[to - 1], marked[to]):
                to += 1
            yield marked[at:to]
            at = to
        if at < len(marked):
            yield marked[at:]

    def together(self, a: str, b: str) -> bool:
        return bool(self.joined[self.classes[ord(a)] * self.wide + self.classes[ord(b)]])

    def check(self, stretches: list[str], ids: list[list[int]], decoded: list[str]) -> None:
        """Raises if the library encodes a stretch or decodes its ids otherwise.

        The library puts a mark before what it is asked, which stands for a stretch's own; other stretches come behind the guard.
        """
        plain = [len(x) > 1 and x[0] == SPACE for x in stretches]
        told = self.library.encode([x[1:] if p else self.guard + x for x, p in zip(stretches, plain, strict=True)], num_threads=1)
        back = self.library.decode(ids, num_threads=1)
        guard = len(self.library.encode(self.guard))
        for x, p, own, theirs, text, other in zip(stretches, plain, ids, told, decoded, back, strict=True):
            if own != (theirs if p else theirs[guard:]):
                raise ValueError(f"the library encodes {x[:80]!r} otherwise than the agenda")
            if text != other:
                raise ValueError(f"the library decodes the ids of {x[:80]!r} otherwise")


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), then those of start[1], ..."""
    upto = np.cumsum(size)
    return np.repeat(start - upto + size, size) + np.arange(int(upto[-1]) if len(upto) else 0)


def distinct(code: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct stretch, and which of them each stretch is; equal hashes are held against the characters."""
    h = mix(sizes.astype(np.uint64))
    left = np.arange(len(starts))
    for k in range(min(SHORT, int(sizes.max()))):
        left = left[sizes[left] > k]
        h[left] = mix(h[left] ^ code[starts[left] + k])
    long = np.flatnonzero(sizes > SHORT)  # taken as they are
    h[long] = mix(long.astype(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15))
    _, rep, inverse = np.unique(h, return_index=True, return_inverse=True)
    first = rep[inverse]
    if (sizes[first] != sizes).any() or (code[ranges(starts[first], sizes)] != code[ranges(starts, sizes)]).any():
        return np.arange(len(starts)), np.arange(len(starts))
    return rep, inverse


def decoded_bytes(data: bytes) -> str:
    """UTF-8, with one U+FFFD for each byte that isn't part of a character."""
    out, at = [], 0
    while True:
        try:
            out.append(data[at:].decode())
            return "".join(out)
        except UnicodeDecodeError as bad:
            out.append(data[at : at + bad.start].decode() + "�")
            at += bad.start + 1


_PIECES: dict[str, Pieces] = {}


def pieces_of(model: str) -> Pieces:
    """One vocabulary for each worker process and model."""
    if model not in _PIECES:
        _PIECES[model] = Pieces(model)
    return _PIECES[model]


class Coded:
    """The results of one text, gathered from its parts."""

    def __init__(self, digests: bool):
        self.n, self.digests = 0, digests
        self.ids, self.text = (hashlib.sha256(), hashlib.sha256()) if digests else ([], [])

    def add(self, pieces: Pieces, ids: list[int], text: str) -> None:
        if self.digests:
            self.ids.update(("," if self.n else "").encode() + ",".join([pieces.digits[i] for i in ids]).encode())
            self.text.update(text.encode("utf-8", "surrogatepass"))
        else:
            self.ids += ids
            self.text.append(text)
        self.n += len(ids)

    def result(self) -> tuple:
        return (self.n, self.ids.hexdigest(), self.text.hexdigest()) if self.digests else (self.n, self.ids, "".join(self.text))


def coded(pieces: Pieces, texts: list[str], digests: bool, most: int = PART) -> list[tuple]:
    """(number of ids, ids, decoded text) of each text, or with digests their SHA-256; all checked."""
    out = [Coded(digests) for _ in texts]
    held: list[tuple[int, str, bool]] = []

    def flush() -> None:
        parts = [p for _, p, _ in held]
        ids, stretches, each = pieces.encode(parts)
        pieces.check(stretches, each, [pieces.decode(x) for x in each])
        decoded = [pieces.decode(x, first=begins) for x, (_, _, begins) in zip(ids, held, strict=True)]
        for j, (p, (_, _, begins)) in enumerate(zip(parts, held, strict=True)):
            if begins and len(p) <= most // 16:  # one text as it stands
                pieces.check([p], [ids[j]], [decoded[j]])
                break
        for (k, _, _), x, text in zip(held, ids, decoded, strict=True):
            out[k].add(pieces, x, text)
        held.clear()

    size = 0
    for k, text in enumerate(texts):
        for j, part in enumerate(pieces.parts(text, most) if text else ()):
            if size + len(part) > most and held:
                flush()
                size = 0
            held.append((k, part, j == 0))
            size += len(part)
    if held:
        flush()
    return [x.result() for x in out]


def encode_decode(docs: DataFrame, model: str | None = None, column: str = "text", digests: bool = False) -> DataFrame:
    """Adds n_tokens, ids (array<int>) and decoded to docs; with digests, their SHA-256 in place of the two."""
    model = model or default_model()
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"]
    kinds = [T.LongType(), *[T.StringType()] * 2] if digests else [T.LongType(), T.ArrayType(T.IntegerType()), T.StringType()]
    keep = [c for c in docs.columns if c not in names and (c != column or not digests)]
    source = docs.select(*keep, F.coalesce(column, F.lit("")).alias(fresh(docs, "whole")))
    schema = T.StructType([*source.schema.fields[:-1], *[T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]])
    arrow = [pa.int64(), *([pa.string()] * 2 if digests else [pa.list_(pa.int32()), pa.string()])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows = coded(pieces, batch.column(batch.num_columns - 1).to_pylist(), digests)
                extra = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *extra], names=[*keep, *names])

    return source.mapInArrow(thrifty(run), schema)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs, digests=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")

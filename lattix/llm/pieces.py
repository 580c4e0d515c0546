"""SentencePiece encoding and decoding as a max-plus scan.

A segmentation scores the sum of its pieces' weights; the best one is a longest
path.  A text's spaces are word starts: no piece holds a space after another
character, so every segmentation is cut there and words are solved one by one
(and remembered).  A giant document is dealt into chunks of `chunk` characters,
cut anywhere.  The state at a chunk's border is how many characters before it the
last cut lies; each chunk gives the matrix of best scores from entry state to exit
state, and matrices are combined associatively under (max, +): in pairs within blocks of FAN chunks, then
pairwise over the blocks of a document, so that its borders follow block by block, and those inside a
block, from its two, in parallel.  Then each chunk, between its two cuts, is traced back on its own.

Ties: of paths of equal weight the one wins whose last piece is shortest, then the one before it, and so on.  The choice
at a place needs only the weights up to it, so words and spans between two cuts of the winner give the same
pieces alone as within the text.  Across chunks a matrix carries, beside the weights, the order of its entry states by this
rule for each exit state; products keep both.  Ids therefore do not depend on `chunk` or on the path taken.

Weights: the vocabulary is a BPE file whose scores are merge ranks, so the unigram
weights come from Zipf's law over the rank, as whole numbers (weight 2^20 = one nat): sums
are exact and do not depend on how a text is dealt.  Characters without a piece are
encoded by their UTF-8 bytes, also the space mark itself, so decoding returns every text as it
was.  The model file is a parameter and is read where it is used.

Defined results: null and empty texts have no pieces, and no pieces decode to the empty text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lattix.session import cut

CHUNK = 1 << 15
FAN = 32
NEG = -(1 << 60)
SCALE = 1 << 20
UNIT = re.compile(r" +[^ ]*")
REMEMBER = 250_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _hash(codes: np.ndarray) -> np.ndarray:
    h = np.zeros(len(codes), np.uint64)
    for k in range(codes.shape[1]):
        h = h * MULTIPLIER + codes[:, k].astype(np.uint64)
    return h


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        total = math.log(sum(1 / (r + 2) for r in range(len(normal))))
        self.ids = {sp.id_to_piece(i).replace("▁", " "): i for i in normal}
        self.weight = {sp.id_to_piece(i).replace("▁", " "): -round(SCALE * (math.log(r + 2) + total)) for r, i in enumerate(normal)}
        self.weight_of = {i: self.weight[p] for p, i in self.ids.items()}
        self.unknown = min(self.weight.values()) - 10 * SCALE
        self.longest = max(map(len, self.ids))
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(sp.get_piece_size()) if sp.is_byte(i)}
        self.raw = [b""] * sp.get_piece_size()
        for p, i in self.ids.items():
            self.raw[i] = p.encode()
        for b, i in self.bytes.items():
            self.raw[i] = bytes([b])
            if b < 128 and chr(b) not in self.ids:  # one byte, so as good as a piece of its own
                self.ids[chr(b)], self.weight[chr(b)] = i, self.unknown
        self.known: dict[str, tuple[int, ...]] = {}
        self.tables: dict[int, tuple] = {}

    def edges_to(self, u: str, e: int, lo: int) -> Iterator[tuple[int, int]]:
        """(start, weight) of the pieces u[start:e] with start >= lo, shortest first."""
        get = self.weight.get
        if e - 1 >= lo:
            yield e - 1, get(u[e - 1 : e], self.unknown)
        for s in range(e - 2, max(lo, e - self.longest) - 1, -1):
            if (w := get(u[s:e])) is not None:
                yield s, w

    def solve(self, u: str) -> tuple[int, ...]:
        n = len(u)
        best, back = [0] + [NEG] * n, [0] * (n + 1)
        get, longest, unknown = self.weight.get, self.longest, self.unknown
        for e in range(1, n + 1):
            s = e - 1
            top, at = best[s] + get(u[s:e], unknown), s
            for s in range(e - 2, max(0, e - longest) - 1, -1):  # shortest first: it wins ties
                w = get(u[s:e])
                if w is not None and best[s] + w > top:
                    top, at = best[s] + w, s
            best[e], back[e] = top, at
        out: list[int] = []
        e = n
        while e:
            s = back[e]
            piece = u[s:e]
            if piece in self.ids:
                out.append(self.ids[piece])
            else:
                out += [self.bytes[b] for b in reversed(piece.encode("utf-8", "surrogatepass"))]
            e = s
        return tuple(reversed(out))

    def learn(self, words: set[str]) -> None:
        """Solves the words (each stands for a unit: a space and the word) that are not yet remembered, all of one length at once."""
        if len(self.known) > REMEMBER:
            self.known.clear()
        by_len: dict[int, list[str]] = {}
        for w in words:
            if w not in self.known:
                if len(w) < 64:
                    by_len.setdefault(len(w) + 1, []).append(w)
                else:
                    self.known[w] = self.solve(" " + w)
        for n, some in by_len.items():
            self._solve_length(n, some)

    def _table(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted hashes, weights and ids of the pieces of a length."""
        if size not in self.tables:
            own = [p for p in self.ids if len(p) == size]
            h = _hash(np.frombuffer("".join(own).encode("utf-32-le"), np.uint32).reshape(len(own), size)) if own else np.empty(0, np.uint64)
            order = np.argsort(h)
            assert len(np.unique(h)) == len(own)
            self.tables[size] = h[order], np.array([self.weight[p] for p in own], np.int64)[order], np.array([self.ids[p] for p in own], np.int32)[order]
        return self.tables[size]

    def _solve_length(self, n: int, words: list[str]) -> None:
        codes = np.frombuffer((" " + " ".join(words)).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n).astype(np.uint64)
        best = np.full((n + 1, len(words)), NEG, np.int64)
        back = np.zeros((n + 1, len(words)), np.int64)
        piece = np.full((n + 1, len(words)), -1, np.int32)
        best[0] = 0
        found: list[list] = [[] for _ in range(n + 1)]
        h = np.zeros_like(codes)
        for size in range(1, min(self.longest, n) + 1):
            h = h[:, : n - size + 1] * MULTIPLIER + codes[:, size - 1 :]
            table, weights, ids = self._table(size)
            if not len(table):
                continue
            at = np.minimum(np.searchsorted(table, h), len(table) - 1)
            ok = table[at] == h
            for s in np.flatnonzero(ok.any(axis=0)):
                found[s + size].append((size, np.where(ok[:, s], weights[at[:, s]], NEG), ids[at[:, s]]))
        for e in range(1, n + 1):
            best[e] = best[e - 1] + self.unknown
            back[e] = e - 1
            for size, w, ids in found[e]:
                got = best[e - size] + w
                better = got > best[e]
                best[e][better], back[e][better], piece[e][better] = got[better], e - size, ids[better]
        rows = np.arange(len(words))
        e, steps = np.full(len(words), n), []
        odd = np.zeros(len(words), bool)
        while e.any():
            live = e > 0
            got = np.where(live, piece[e, rows], -2)
            odd |= got == -1
            steps.append(got)
            e = np.where(live, back[e, rows], 0)
        lists = np.array(steps[::-1]).T.tolist()
        for w, ids, by_byte in zip(words, lists, odd.tolist()):
            self.known[w] = self.solve(" " + w) if by_byte else tuple(i for i in ids if i >= 0)

    def encode_span(self, t: str) -> np.ndarray:
        """Pieces of text whose ends are cuts; t counts from a cut on and may start inside a word."""
        head: tuple[int, ...] = ()
        first = t.find(" ")
        if first:
            head = self.solve(t if first < 0 else t[:first])
            t = "" if first < 0 else t[first:]
        words = self.split(t)
        self.learn(set(words))
        return np.fromiter(chain(head, chain.from_iterable(map(self.known.__getitem__, words))), np.int32)

    @staticmethod
    def split(t: str) -> list[str]:
        """Units of a text that starts with a space, each without its first space."""
        if not t:
            return []
        return [u[1:] for u in UNIT.findall(t)] if "  " in t else t[1:].split(" ")

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        parts = [self.split(" " + t) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(parts)))
        get = self.known.__getitem__
        return [np.fromiter(chain.from_iterable(map(get, words)), np.int32) for words in parts]

    def encode(self, t: str) -> list[int]:
        return self.encode_many([t])[0].tolist()

    def decode(self, ids) -> str:
        raw = self.raw
        return b"".join([raw[i] for i in ids]).decode("utf-8", "surrogatepass")[1:]

    def score(self, ids) -> int:
        """Weight of a decoded path; bytes count as their character's."""
        by_id = self.weight_of
        runs = b"".join([self.raw[i] for i in ids if i not in by_id]).decode("utf-8", "surrogatepass")
        return sum(by_id[i] for i in ids if i in by_id) + self.unknown * len(runs)

    def transfer(self, local: str, context: int) -> np.ndarray:
        """2 x states x states: best scores of a chunk, local[context:] with the context before it, and the order of entries.

        Entry s: the last cut lies s characters before the border; exit t likewise before the end.  An exit before the
        border is an entry that no cut of the chunk followed.
        """
        size, end = self.longest, len(local)
        best, order = np.full((end + 1, size), NEG, np.int64), np.zeros((end + 1, size), np.int64)
        best[context, 0] = 0
        for e in range(context + 1, end + 1):
            row, key = best[e], np.full(size, size * (size + 1), np.int64)
            for s, w in self.edges_to(local, e, max(0, context - size + 1)):
                if s >= context:
                    got = best[s] + w
                    better = got > row
                    row[better], key[better] = got[better], (e - s) * size + order[s][better]
                elif w > row[context - s]:
                    row[context - s], key[context - s] = w, (e - s) * size
            order[e] = _ranks(key)
        out = np.zeros((2, size, size), np.int64)
        out[0] = NEG
        for t in range(size):
            if end - t >= context:
                out[0, :, t], out[1, :, t] = best[end - t], order[end - t]
            else:
                out[0, context - end + t, t] = 0
        return _with_order(out[0], out[1])

    def chunk_matrix(self, local: str, context: int) -> np.ndarray:
        """transfer(), but the words between the chunk's first and last forced cut are solved word by word."""
        size = self.longest
        cuts = [m.start() for m in re.finditer(r"(?<=[^ ]) ", local) if m.start() >= context]
        cuts = [c for c in cuts if len(local) - c >= size] if cuts and len(local) - cuts[-1] < size else cuts  # exit states reach back over the last cut
        if not cuts:
            return self.transfer(local, context)
        lo, hi = cuts[0], cuts[-1]
        if lo > context:
            into, order = self.transfer(local[:lo], context)[:, :, 0]
        else:
            into, order = np.where(np.arange(size) == 0, 0, NEG), np.zeros(size, np.int64)
        out_of = self.transfer(local[hi:], 0)[0, 0]
        got = into[:, None] + self.path_weight(local[lo:hi]) + out_of[None, :]
        got = np.where((into[:, None] <= NEG // 2) | (out_of[None, :] <= NEG // 2), NEG, got)
        return _with_order(got, order[:, None])

    def path_weight(self, t: str) -> int:
        """Weight of the best path of whole units."""
        total, words = 0, self.split(t)
        self.learn(set(words))
        for w, many in Counter(words).items():
            total += many * self.score(self.known[w])
        return total


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Places of the values of each column in its order, equal values in the order of rows."""
    return np.argsort(np.argsort(keys, axis=0, kind="stable"), axis=0, kind="stable")


def _with_order(scores: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """A chunk's matrix of scores with the order of its entries; those that lead nowhere come last."""
    return np.stack([np.maximum(scores, NEG), _ranks(np.where(scores <= NEG // 2, keys.max() + 1, keys))])


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of two chunks' matrices, with the order of entries; associative."""
    size = a.shape[1]
    through = a[0][:, :, None] + b[0][None, :, :]
    top = through.max(axis=1)
    mid = np.where(through == top[:, None, :], b[1][None, :, :], size).argmin(axis=1)
    return _with_order(top, b[1][mid, np.arange(size)[None, :]] * size + np.take_along_axis(a[1], mid, axis=1))


def product(mats: list[np.ndarray]) -> np.ndarray:
    """Product of neighbours' matrices, in pairs."""
    while len(mats) > 1:
        mats = [combine(*mats[k : k + 2]) if k + 1 < len(mats) else mats[k] for k in range(0, len(mats), 2)]
    return mats[0]


def border_states(mats: list[np.ndarray], enter: int = 0, leave: int = 0) -> list[int]:
    """The winner's state at each border: entry of the first chunk, ..., exit of the last; these two are given."""
    if len(mats) == 1:
        return [enter, leave]
    half = len(mats) // 2
    left, right = product(mats[:half]), product(mats[half:])
    through = left[0][enter] + right[0][:, leave]
    mid = int(np.where(through == through.max(), right[1][:, leave], len(through)).argmin())
    return border_states(mats[:half], enter, mid)[:-1] + border_states(mats[half:], mid, leave)


def chunks(t: str, chunk: int, size: int) -> list[tuple[int, str, int]]:
    """(k, local text, context) of a padded text; the last chunk is never shorter than a piece can be."""
    marks = list(range(0, len(t), chunk))
    if len(marks) > 1 and len(t) - marks[-1] < size:
        marks.pop()
    ends = [*marks[1:], len(t)]
    return [(k, t[max(0, a - size + 1) : b], min(a, size - 1)) for k, (a, b) in enumerate(zip(marks, ends))]


def _list_array(rows: list) -> pa.Array:
    flat = [np.asarray(r, np.int32) if r is not None else np.empty(0, np.int32) for r in rows]
    offsets = np.r_[0, np.cumsum([len(r) for r in flat])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32)))


def encode(docs: DataFrame, text: str = "text", ids_as: str = "ids", model: str | None = None, chunk: int = CHUNK, decoded_as: str | None = None) -> DataFrame:
    """docs with the piece ids of every whole text (and, if asked for, the text decoded from them) added; other columns
    pass through."""
    path = model or default_model()
    cols = [c for c in docs.columns if c not in (ids_as, decoded_as)]
    at = cols.index(text)
    docs = docs.select(*cols)
    added = [ids_as, decoded_as] if decoded_as else [ids_as]
    giant = F.coalesce(F.length(text) > 2 * chunk, F.lit(False))
    kinds = [StructField(ids_as, ArrayType(IntegerType())), StructField(decoded_as or "", StringType())]
    schema = StructType([*docs.schema.fields, *kinds[: len(added)]])

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(path)
        for b in batches:
            for lo in range(0, len(b), 1024):
                part = b.slice(lo, 1024)
                ids = p.encode_many([t or "" for t in part.column(at).to_pylist()])
                more = [_list_array(ids)]
                if decoded_as:
                    more.append(pa.array([p.decode(i.tolist()) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*cols, *added])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = load(path).longest
        for b in batches:
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for k, local, context in chunks(" " + t, chunk, size):
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([k], pa.int32()), pa.array([local]), pa.array([context], pa.int32())], names=["key", "k", "local", "context"])

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(path)
        for b in batches:
            m = [p.chunk_matrix(t.as_py(), c.as_py()).tobytes() for t, c in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(m, pa.binary())], names=["key", "k", "m"])

    def read(m) -> list[np.ndarray]:
        size = load(path).longest
        return [np.frombuffer(x, np.int64).reshape(2, size, size) for x in m]

    def block(group):
        import pandas as pd

        group = group.sort_values("k")
        return pd.DataFrame({"key": group["key"][:1], "block": group["block"][:1], "m": [product(read(group["m"])).tobytes()]})

    def blocks(group):
        import pandas as pd

        group = group.sort_values("block")
        found = border_states(read(group["m"]))
        return pd.DataFrame({"key1": group["key"], "block1": group["block"], "enter": found[:-1], "leave": found[1:]})

    def states(group):
        import pandas as pd

        group = group.sort_values("k")
        found = border_states(read(group["m"]), int(group["enter"].iloc[0]), int(group["leave"].iloc[0]))
        return pd.DataFrame({"key2": group["key"], "k2": group["k"], "enter": found[:-1], "leave": found[1:]})

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(path)
        for b in batches:
            key, k, local, context, enter, leave = b.to_pydict().values()
            ids = _list_array([p.encode_span(t[c - i : len(t) - o]) for t, c, i, o in zip(local, context, enter, leave)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), ids], names=["key", "k", "ids"])

    small = docs.where(~giant).mapInArrow(plain, schema)
    big = cut(docs.where(giant).withColumn("__key", F.monotonically_increasing_id()))
    if big.isEmpty():
        return small
    dealt = cut(big.select(F.col("__key").alias("key"), F.col(text).alias("t")).mapInArrow(deal, "key bigint, k int, local string, context int").repartition(F.col("key"), F.col("k")))
    mats = cut(dealt.mapInArrow(matrices, "key bigint, k int, m binary").withColumn("block", F.floor(F.col("k") / FAN).cast("int")))
    outer = mats.groupBy("key", "block").applyInPandas(block, "key bigint, block int, m binary")
    outer = outer.groupBy("key").applyInPandas(blocks, "key1 bigint, block1 int, enter int, leave int")
    inner = mats.join(outer, (F.col("key") == F.col("key1")) & (F.col("block") == F.col("block1")))
    best = inner.select("key", "block", "k", "m", "enter", "leave").groupBy("key", "block").applyInPandas(states, "key2 bigint, k2 int, enter int, leave int")
    traced = dealt.join(best, (F.col("key") == F.col("key2")) & (F.col("k") == F.col("k2"))).select("key", "k", "local", "context", "enter", "leave").mapInArrow(trace, "key bigint, k int, ids array<int>")
    whole = traced.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias(ids_as))
    large = big.join(whole, F.col("__key") == F.col("key")).select(*cols, ids_as)
    return small.unionByName(decode(large, ids_as, decoded_as, path) if decoded_as else large)


def decode(df: DataFrame, ids: str = "ids", text_as: str = "decoded", model: str | None = None) -> DataFrame:
    """df with the text of each id list added (null ids: null)."""
    path = model or default_model()
    cols = [c for c in df.columns if c != text_as]
    at = cols.index(ids)
    df = df.select(*cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(path)
        for b in batches:
            for lo in range(0, len(b), 512):
                part = b.slice(lo, 512)
                got = [None if x is None else p.decode(x) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.string())], names=[*cols, text_as])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(text_as, StringType())]))


def query(spark, sf_dir: str) -> DataFrame:
    from lattix.session import read_table

    out = encode(read_table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text")), decoded_as="decoded")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"), "ids")

"""Language-model scores: a gated recurrent network in numpy, and the add-one unigram base.

Tokens are words (ASCII white space, A-Z folded) and one end a text.  Token counts
cover all training texts.  The network knows the `VOCAB` - 2 commonest tokens, the end and one
entry for all others, dealt by frequency into classes: P(token) = P(class | state) P(token | class, state);
a token of the remainder also takes the add-one share of its count among all of the remainder, so
every text has a proper probability.  Output biases begin as the unigram of the counts, so that the untrained network is
about the base, and training starts from there.

Training is truncated backpropagation through time (windows of STEPS tokens, the state carried
on) by tasks over their shares of all training texts, each text in one of `rounds` rounds and every token learned once; a task
keeps its Adagrad memory through a round, and the tasks' weights are averaged after each.  Texts are dealt to tasks and
rounds by id and text, so copies of a text
with ids of their own are spread.  Scoring carries the
state over the whole text, whatever its length; texts of a batch advance together and leave as they end, and the
output layer is worked off class by class.

Scale: counts are combined per task and then by token; the `HOT` commonest counts (a
fixed bound) are looked up in place, all others are joined by token, where no token is hot.

Defined results: null text is empty (one end token); rows with equal ids are scored one by one; with no training text
every token is unknown and the untrained network scores.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.llm.common import fold, is_fold
from lattix.session import cut

VOCAB, CLASSES, SIZE, STEPS = 2048, 32, 16, 16
END, OTHER = 0, 1
RATE = 0.3
HOT = 1 << 18
AT_ONCE = 1 << 22
END_WORD = b"\n"  # no word holds white space
LN10 = math.log(10)


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, c) over the one text column; each task sends each token once a quarter of a million distinct ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["token", "c"])
            held.clear()
            return out

        for b in batches:
            for lo in range(0, len(b), 256):
                held.update(chain.from_iterable(split(t) for t in b.column(0).slice(lo, 256).to_pylist()))
                held[END_WORD] += min(256, len(b) - lo)
                if len(held) > 250_000:
                    yield flush()
        if held:
            yield flush()

    return texts.mapInArrow(run, "token string, c bigint").groupBy("token").agg(F.sum("c").alias("c"))


def least_common(counts: DataFrame, most: int) -> int:
    """The least count such that at most `most` tokens have it or more.  Reads one row a distinct count, of which
    there are at most about the root of twice the corpus' length."""
    held, least = 0, None
    for c, n in sorted(((r[0], r[1]) for r in counts.groupBy("c").count().collect()), reverse=True):
        if held + n > most:
            break
        held, least = held + n, c
    return least if least is not None else 1 << 62


class Net:
    """Weights as a list of arrays: input table, recurrent matrix, biases, class and token output layers."""

    def __init__(self, weights: list[np.ndarray]):
        self.w = weights
        self.memory = [np.full_like(w, 1e-2) for w in weights]  # Adagrad's, for as long as the net lives

    @classmethod
    def fresh(cls, counts: np.ndarray | None = None, seed: int = 11) -> Net:
        """Small random weights; with counts of the entries, output biases that give their unigram (add one) whatever the state."""
        r = np.random.default_rng(seed)
        f = np.float32
        share = np.log((np.ones(VOCAB) if counts is None else counts + 1.0).reshape(CLASSES, -1))
        cb = np.log(np.exp(share).sum(axis=1))
        return cls([r.normal(0, 0.1, (VOCAB, 3 * SIZE)).astype(f), r.normal(0, 1 / math.sqrt(SIZE), (SIZE, 3 * SIZE)).astype(f), np.zeros(3 * SIZE, f), r.normal(0, 0.02, (SIZE, CLASSES)).astype(f), (cb - cb.max()).astype(f), r.normal(0, 0.02, (CLASSES, SIZE, VOCAB // CLASSES)).astype(f), (share - cb[:, None]).astype(f)])

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple:
        """One token of every row: (new state, what backward needs)."""
        e, u, b = self.w[:3]
        a = e[x] + b
        zr = 1 / (1 + np.exp(-(a[:, : 2 * SIZE] + h @ u[:, : 2 * SIZE])))
        z, r = zr[:, :SIZE], zr[:, SIZE:]
        rh = r * h
        c = np.tanh(a[:, 2 * SIZE :] + rh @ u[:, 2 * SIZE :])
        return h + z * (c - h), (z, r, rh, c)

    def output(self, h: np.ndarray, y: np.ndarray, grads: list[np.ndarray] | None = None, real: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of y after states h, class by class; with grads, also d(-log p)/dh (0 where not real)."""
        _, _, _, cw, cb, tw, tb = self.w
        width = VOCAB // CLASSES
        k, place = y // width, y % width
        every = np.arange(len(y))

        def layer(h: np.ndarray, w: np.ndarray, b: np.ndarray, to: np.ndarray, real: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
            """Log probability of the places `to`, and d(-log p)/d logits."""
            logit = h @ w
            logit += b
            np.clip(logit, -60, 60, out=logit)  # in place of each row's maximum, which costs more than all else here; still sums to 1
            ex = np.exp(logit)
            total = ex @ np.ones(ex.shape[1], ex.dtype)
            rows = every[: len(h)]
            logp = logit[rows, to] - np.log(total)
            if grads is not None:
                ex /= total[:, None]
                ex[rows, to] -= 1
                if real is not None:
                    ex *= real[:, None]
            return logp, ex

        logp, d = layer(h, cw, cb, k, real)
        dh = None
        if grads is not None:
            dh = d @ cw.T
            grads[3] += h.T @ d
            grads[4] += d.sum(axis=0)
        order = np.argsort(k.astype(np.int16), kind="stable")  # 16 bits are sorted by radix
        stops = np.r_[0, np.cumsum(np.bincount(k, minlength=CLASSES))].tolist()
        h, place, real = h[order], place[order], None if real is None else real[order]
        inner, back = np.empty_like(logp), None if grads is None else np.empty_like(h)
        for c in range(CLASSES):
            own = slice(stops[c], stops[c + 1])
            if own.start == own.stop:
                continue
            inner[own], d = layer(h[own], tw[c], tb[c], place[own], None if real is None else real[own])
            if grads is not None:
                np.matmul(d, tw[c].T, out=back[own])
                grads[5][c] += h[own].T @ d
                grads[6][c] += d.sum(axis=0)
        logp[order] += inner
        if grads is not None:
            dh[order] += back
        return logp, dh

    def gradients(self, x: np.ndarray, y: np.ndarray, h: np.ndarray, real: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, float]:
        """Backpropagation through a window (steps x streams): gradients of the summed -log p (of the input table: of the rows
        of the entries that occur), those entries, the last state, that sum."""
        u = self.w[1]
        grads = [None, *(np.zeros_like(w) for w in self.w[1:])]
        states, kept = [h], []
        for t in range(len(x)):
            h, mid = self.step(x[t], h)
            states.append(h)
            kept.append(mid)
        logp, dhs = self.output(np.concatenate(states[1:]), y.ravel(), grads, None if real.all() else real.ravel())
        dhs = dhs.reshape(len(x), *h.shape)
        dh = np.zeros_like(h)
        das = np.empty((len(x), len(h), 3 * SIZE), h.dtype)
        for i in range(len(x) - 1, -1, -1):
            z, r, _, c = kept[i]
            before = states[i]
            d = dh + dhs[i]
            dc = d * z * (1 - c * c)
            drh = dc @ u[:, 2 * SIZE :].T
            da = das[i]
            da[:, :SIZE] = d * (c - before) * z * (1 - z)
            da[:, SIZE : 2 * SIZE] = drh * before * r * (1 - r)
            da[:, 2 * SIZE :] = dc
            dh = d * (1 - z) + drh * r + da[:, : 2 * SIZE] @ u[:, : 2 * SIZE].T
        da = das.reshape(-1, 3 * SIZE)
        grads[2] += da.sum(axis=0)
        grads[1][:, : 2 * SIZE] += np.concatenate(states[:-1]).T @ da[:, : 2 * SIZE]
        grads[1][:, 2 * SIZE :] += np.concatenate([k[2] for k in kept]).T @ da[:, 2 * SIZE :]
        flat = x.ravel()
        order = np.argsort(flat.astype(np.int16), kind="stable")
        first = np.flatnonzero(np.r_[True, flat[order][1:] != flat[order][:-1]])
        grads[0] = np.add.reduceat(da[order], first, axis=0)
        return grads, flat[order][first], h, -float((logp * real.ravel()).sum())

    def learn(self, ids: np.ndarray, streams: int = 256, rate: float = 0.3) -> int:
        """Truncated backpropagation over one token sequence, dealt to parallel streams; every token after the first is learned once
        (Adagrad on the mean gradient).  Short sequences have fewer streams, of 64 windows."""
        n = len(ids) - 1
        if n < 1:
            return 0
        streams = max(1, min(streams, n // (64 * STEPS)))
        length = -(-n // streams)
        place = np.arange(length)[:, None] + length * np.arange(streams)
        real = (place < n).astype(np.float32)
        place = np.minimum(place, n - 1)
        x, y = ids[place], ids[place + 1]
        h = np.zeros((streams, SIZE), np.float32)
        for lo in range(0, length, STEPS):
            hi = min(length, lo + STEPS)
            grads, entries, h, _ = self.gradients(x[lo:hi], y[lo:hi], h, real[lo:hi])
            scale = STEPS / max(1.0, float(real[lo:hi].sum()))
            for k, (w, g, m) in enumerate(zip(self.w, grads, self.memory)):
                g *= scale
                np.clip(g, -1, 1, out=g)
                at = entries if k == 0 else ...
                sq = m[at] + g * g
                m[at] = sq
                np.sqrt(sq, out=sq)
                g /= sq
                g *= rate
                w[at] -= g
        return n

    def score(self, texts: list[np.ndarray], chunk: int = 1 << 14) -> np.ndarray:
        """Natural log probability of each text (token ids without the end), the end included."""
        lens = np.array([len(t) + 1 for t in texts])
        order = np.argsort(-lens, kind="stable")
        lens = lens[order]
        offsets = np.r_[0, np.cumsum(lens)]
        flat = np.concatenate([np.r_[texts[i], END] for i in order]) if len(texts) else np.empty(0, int)
        active = np.searchsorted(-lens, -np.arange(lens[0] if len(lens) else 0), side="left")  # texts longer than t
        out = np.zeros(len(texts))
        h = np.zeros((len(texts), SIZE), np.float32)
        x = np.full(len(texts), END)
        hs, ys, rows, held = [], [], [], 0

        def flush():
            nonlocal held
            if hs:
                logp, _ = self.output(np.concatenate(hs), np.concatenate(ys))
                out[:] += np.bincount(np.concatenate(rows), weights=logp, minlength=len(out))
                hs.clear(), ys.clear(), rows.clear()
                held = 0

        every = np.arange(len(texts))
        for t, a in enumerate(active.tolist()):
            h, _ = self.step(x[:a], h[:a])
            x = flat[offsets[:a] + t]
            hs.append(h), ys.append(x), rows.append(every[:a])
            held += a
            if held >= chunk:
                flush()
        flush()
        back = np.empty(len(texts))
        back[order] = out
        return back


def vocabulary(top: list[bytes]) -> dict[bytes, int]:
    """Ids by falling count: the end and the remainder lead, classes are consecutive runs."""
    return {w: i + 2 for i, w in enumerate([w for w in top if w != END_WORD][: VOCAB - 2])}


def _ids(texts: list[list[bytes]], known: dict[bytes, int]) -> list[np.ndarray]:
    return [np.fromiter(map(known.get, t, repeat(OTHER)), np.int64, len(t)) for t in texts]


def train(texts: DataFrame, known: dict[bytes, int], tokens: int, counts: np.ndarray | None = None, rounds: int = 3, tokens_a_task: int = 4_000_000, most_tasks: int = 256) -> Net:
    """texts: (doc, text); tokens: about how many tokens it has.  Rounds of local training and averaging."""
    tasks = int(max(1, min(most_tasks, tokens // tokens_a_task)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.r_[i, END].astype(np.int16).tobytes() for i in _ids([split(t) for t in b.column(0).to_pylist()], known)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(ids, pa.binary())], names=["key", "ids"])

    rows = texts.select("text", F.xxhash64("doc", "text").alias("key")).mapInArrow(encode, "key bigint, ids binary")
    rows = cut(rows.withColumn("part", F.pmod("key", F.lit(tasks)).cast("int")).repartition(tasks, "part").sortWithinPartitions("key", "ids"))
    net = Net.fresh(counts)
    for turn in range(rounds):
        now = net

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, seen, held, size = Net([w.copy() for w in now.w]), 0, [np.zeros(1, np.int16)], 1
            for b in batches:
                for v in b.column(0):
                    held.append(np.frombuffer(v.as_py(), np.int16))
                    size += len(held[-1])
                    if size > 1_000_000:
                        seen += own.learn(np.concatenate(held).astype(np.int64), rate=RATE / (1 + now_turn))
                        held, size = [np.zeros(1, np.int16)], 1
            seen += own.learn(np.concatenate(held).astype(np.int64), rate=RATE / (1 + now_turn))
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([np.concatenate([w.ravel() for w in own.w]).tobytes()], pa.binary())], names=["seen", "w"])

        now_turn = turn
        got = rows.where(F.pmod(F.shiftright("key", 20), F.lit(rounds)) == turn).select("ids").mapInArrow(run, "seen bigint, w binary").collect()
        if got:
            share = np.array([r["seen"] for r in got], np.float64)
            flat = sum(np.frombuffer(bytes(r["w"]), np.float32) * (s / share.sum()) for r, s in zip(got, share)).astype(np.float32)
            stops = np.cumsum([w.size for w in net.w])[:-1]
            net = Net([v.reshape(w.shape) for v, w in zip(np.split(flat, stops), net.w)])
    return net


def score_texts(docs: DataFrame, is_training, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row; is_training is a Column over docs."""
    rows = docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text"), F.coalesce(is_training, F.lit(False)).alias("training"))
    counts = cut(token_counts(rows.where("training").select("text")))
    total, distinct, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("token") == END_WORD.decode(), F.col("c"))), F.lit(0))).first()
    top = sorted(((r[0].encode(), r[1]) for r in counts.where(F.col("c") >= least_common(counts, hot)).collect()), key=lambda x: (-x[1], x[0]))
    known = vocabulary([w for w, _ in top[:VOCAB]])
    count_of = dict(top)
    vocab_tokens = sum(count_of[w] for w in known) + ends
    rest = math.log10(total - vocab_tokens + max(0, distinct - len(known) - 1) + 1)
    base = math.log10(total + distinct + 1)
    entry = np.zeros(VOCAB)
    entry[[END, OTHER]] = ends, total - vocab_tokens
    for w, i in known.items():
        entry[i] = count_of[w]
    net = train(rows.where("training").select("doc", "text"), known, int(total), entry)
    common = [w for w, _ in top if w != END_WORD]
    place_of = {w: i for i, w in enumerate(common)}
    # by place; the last one is that of a missed token
    log_at = np.array([math.log10(count_of[w] + 1) for w in common] + [0.0])
    entry_at = np.array([known.get(w, OTHER) for w in common] + [OTHER])
    end_log = math.log10(ends + 1)
    end_known = int(ends > 0)
    complete = distinct <= hot
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            texts, others = [], []
            for t in b.column(1):
                words = split(t.as_py())
                at = np.fromiter(map(place_of.get, words, repeat(len(common))), np.int64, len(words))
                ids, logs = entry_at[at], log_at[at]
                missed = np.flatnonzero(at == len(common)).tolist()
                texts.append(ids)
                # a token of the remainder takes its share of it; a missed one's count is added later
                others.append(logs[ids == OTHER].sum() - (ids == OTHER).sum() * rest)
                for c, v in zip(out, (len(words) + 1, len(words) - len(missed) + end_known, logs.sum() + end_log, None, None, [] if complete else [words[i] for i in missed])):
                    c.append(v)
            # as many texts at once as a bound of tokens lets in, so that the steps of the longest are shared by many
            turn = np.cumsum([len(t) for t in texts]) // AT_ONCE
            stops = np.r_[0, np.flatnonzero(np.diff(turn)) + 1, len(texts)]
            logp = np.concatenate([net.score(texts[x:y]) for x, y in zip(stops[:-1], stops[1:])]) if texts else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), pa.array(logp / LN10 + np.array(others)), pa.array(out[5], pa.list_(pa.binary())).cast(pa.list_(pa.string()))],
                names=["doc", "n_tokens", "n_known", "logs", "score", "missed"],
            )

    scored = cut(rows.select("doc", "text").mapInArrow(run, f"doc {kind}, n_tokens bigint, n_known bigint, logs double, score double, missed array<string>").withColumn("row", F.monotonically_increasing_id()))
    missed = scored.where(F.size("missed") > 0).select("row", F.explode_outer("missed").alias("token")).groupBy("row", "token").agg(F.count("*").alias("times"))
    more = missed.join(counts, "token").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more_logs"))
    out = scored.drop("missed").join(more, "row", "left")
    extra = F.coalesce("more_logs", F.lit(0.0))
    return out.select(
        F.col("doc").alias(doc_id), "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + extra - F.col("n_tokens") * base).alias("base_score"), (F.col("score") + extra).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    from lattix.session import read_table

    out = score_texts(read_table(spark, sf_dir, "documents"), fold("doc_id", 7) != 2)
    return out.select("doc_id", is_fold("doc_id", 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

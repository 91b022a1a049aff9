"""Language-model scores of whole texts by a gated recurrent network in numpy.

The output softmax is factored into classes of words, so that a token costs the class and its words, not the vocabulary.
The network knows the end, an unknown mark and the most frequent training words, as many as make up a share of all
training tokens, so its vocabulary grows with the corpus; an unknown word is priced by the mark times its share of the
rest of the training counts, so scores are of the whole text and sum to one over all texts.

Counts cover all training words. Training covers all training documents: they are dealt by a hash of their content over
replicas of about `replica_tokens` tokens each, whatever the partitions of the input; from one start (driver, a bounded
sample) each replica goes over its documents by truncated backpropagation, and parameters are averaged by tokens.
Documents follow each other in lanes of about equal length; state is carried from window to window to the end of each
document and starts anew with the next.
"""

from __future__ import annotations

import ctypes
import glob
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, row_ids, slices, split_words, staged, text_of

END, UNKNOWN = 0, 1


def one_thread() -> None:
    """A task has one core: idle threads of the matrix library would spin on the others."""
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), "..", "numpy.libs", "*openblas*")):
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


def class_bounds(counts: np.ndarray) -> np.ndarray:
    """First words of the classes and the number of words. A class holds about 1 / sqrt(p) words of probability p, which
    makes the expected cost of a token, its classes and the words of its class, least."""
    p = np.sqrt(counts / counts.sum())
    return np.append(np.flatnonzero(np.diff(np.floor(np.cumsum(p) - p / 2), prepend=-1)), len(counts))


def order_of(ids: np.ndarray) -> np.ndarray:
    """A stable order of numbers from 0 to 2**32 - 1, by their halves: those of 16 bits are sorted without comparisons."""
    order = np.argsort(ids.astype(np.uint16), kind="stable")
    high = ids >> 16
    return order.take(np.argsort(high.astype(np.uint16).take(order), kind="stable")) if high.any() else order


class Network:
    """GRU of `hidden` units over as many words as counts; float32. Words come in the order of their counts."""

    def __init__(self, hidden: int, counts: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.hidden, v = hidden, len(counts)
        c = counts + 0.5
        self.bounds = class_bounds(c)
        self.classes = len(self.bounds) - 1
        self.cls = np.repeat(np.arange(self.classes), np.diff(self.bounds))
        total = np.add.reduceat(c, self.bounds[:-1])
        draw = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        self.p = {
            "x": draw(v, 3 * hidden, scale=0.3), "u": draw(hidden, 3 * hidden, scale=hidden**-0.5),
            # The last column is the bias: states are followed by a 1.
            "c": np.concatenate([draw(self.classes, hidden, scale=0.05), np.log(total / total.sum()).astype(np.float32)[:, None]], 1),
            "w": np.concatenate([draw(v, hidden, scale=0.05), np.log(c / total[self.cls]).astype(np.float32)[:, None]], 1),
        }
        self.g = {k: np.full_like(a, 1e-4) for k, a in self.p.items()}  # Adagrad

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.p.values()])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for k, a in self.p.items():
            self.p[k] = flat[at : at + a.size].astype(np.float32).reshape(a.shape)
            at += a.size
        return self

    def step(self, a: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """The next states from the words' rows of `x` and the states; also the candidate's recurrent part."""
        out, _, un = self.advance(a, h.T, self.turned())
        return out.T, un.T

    def turned(self) -> np.ndarray:
        """`u` for `advance`: turned, the gates' part negative."""
        out = self.p["u"].T.copy()
        out[: 2 * self.hidden] *= -1
        return out

    def advance(self, a: np.ndarray, h: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
        """`step` with a column for each lane, as long rows cost less than many of 16; u: `turned`. The next states, gates and candidate, its recurrent part."""
        n = self.hidden
        both = a.T.copy()
        from_h = u @ h
        gates, new, un = both[: 2 * n], both[2 * n :], from_h[2 * n :]
        np.subtract(from_h[: 2 * n], gates, out=gates)
        with np.errstate(over="ignore"):  # the sigmoid is 0 there
            np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        new += both[n : 2 * n] * un
        np.tanh(new, out=new)
        out = h - new
        out *= both[:n]
        out += new
        return out, both, un

    def _softmax(self, h: np.ndarray, table: np.ndarray, small: bool, grad: np.ndarray | None, dh: np.ndarray | None, block: int = 1 << 17) -> np.ndarray:
        """The log of the sum of exp(table @ h) for each row of h, about `block` terms at once; with grad, adds what the sum gives to the gradients of the loss."""
        out = np.empty(len(h), h.dtype)
        ones = np.ones(len(table), h.dtype)
        rows = max(64, block // len(table))
        for at in range(0, len(h), rows):
            part = h[at : at + rows]
            e = part @ table.T
            top = 0
            if not small:
                top = e.max(1)
                e -= top[:, None]
            np.exp(e, out=e)
            total = e @ ones
            if grad is not None:
                grad += e.T @ (part / total[:, None])
                back = e @ table[:, :-1]
                back /= total[:, None]
                dh[at : at + rows] += back
            out[at : at + rows] = np.log(total) + top
        return out

    def output(self, h: np.ndarray, ids: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probabilities of ids after states h; with grads, also adds those of the loss and returns dh."""
        n, c, w = self.hidden, self.p["c"], self.p["w"]
        order = order_of(ids)  # by class, then word
        goal = ids.take(order)
        cls = self.cls.take(goal)
        h1 = np.ones((len(ids), n + 1), h.dtype)
        h1[:, :n] = h.take(order, 0)
        # States lie within -1 and 1, so this bounds every logit; exp needs no shift below it.
        small = all((np.abs(a[j : j + 1024]) @ np.ones(n + 1, a.dtype)).max() < 80 for a in (c, w) for j in range(0, len(a), 1024))
        chosen = c.take(cls, 0)
        chosen += w.take(goal, 0)
        logp = np.einsum("ij,ij->i", h1, chosen)
        dh = None
        if grads is not None:
            dh = -chosen[:, :n]
            first = np.flatnonzero(np.diff(goal, prepend=-1))
            sums, own = np.add.reduceat(h1, first), cls[first]
            grads["w"][goal[first]] -= sums
            first = np.flatnonzero(np.diff(own, prepend=-1))
            grads["c"][own[first]] -= np.add.reduceat(sums, first)
        logp -= self._softmax(h1, c, small, None if grads is None else grads["c"], dh)
        at = np.searchsorted(cls, np.arange(self.classes + 1))
        for k in np.flatnonzero(np.diff(at)):
            i, words = slice(at[k], at[k + 1]), slice(self.bounds[k], self.bounds[k + 1])
            logp[i] -= self._softmax(h1[i], w[words], small, None if grads is None else grads["w"][words], None if dh is None else dh[i])
        out = np.empty_like(logp)
        out[order] = logp
        if dh is None:
            return out, None
        back = np.empty_like(dh)
        back[order] = dh
        return out, back

    def window(self, xs: list[np.ndarray], ys: list[np.ndarray], h: np.ndarray, rate: float, floor: int, news: list[np.ndarray] | None = None) -> tuple[np.ndarray, float]:
        """Truncated backpropagation over one window of lanes (shrinking), and an Adagrad step; news: lanes whose state starts anew at each step. Returns the state and the summed log probability."""
        grads = {k: np.zeros_like(a) for k, a in self.p.items() if k != "x"}
        n, ids = self.hidden, np.concatenate(xs)
        at = np.cumsum([0, *(len(x) for x in xs)]).tolist()
        state = np.empty((len(ids), n), h.dtype)
        last, now, turned, held = h.copy(), h.T.copy(), self.turned(), []
        for t in range(len(xs)):
            i = slice(at[t], at[t + 1])
            now = now[:, : at[t + 1] - at[t]]
            if news is not None and len(news[t]):
                now[:, news[t]] = 0
            out, both, un = self.advance(self.p["x"].take(xs[t], 0), now, turned)
            held.append((now, both, un))
            state[i] = out.T
            last[: out.shape[1]] = state[i]
            now = out
        logp, dout = self.output(state, np.concatenate(ys), grads)
        back = np.empty((len(ids), 3 * n), h.dtype)
        dh = np.zeros((n, 0), h.dtype)
        for t in range(len(xs) - 1, -1, -1):
            i = slice(at[t], at[t + 1])
            now, both, un = held.pop()
            z, r, new = both[:n], both[n : 2 * n], both[2 * n :]
            d = dout[i].T.copy()
            d[:, : dh.shape[1]] += dh
            g = np.empty_like(both)
            dz, dr, dn = g[:n], g[n : 2 * n], g[2 * n :]
            rest = 1 - z
            rest *= d
            np.multiply(new, new, out=dn)
            np.subtract(1, dn, out=dn)
            dn *= rest
            np.subtract(now, new, out=dz)
            dz *= rest
            dz *= z
            np.subtract(1, r, out=dr)
            dr *= r
            dr *= un
            dr *= dn
            back[i] = g.T
            dn *= r  # from here on of the candidate's recurrent part
            grads["u"] += now @ g.T
            dh = self.p["u"] @ g
            d *= z
            dh += d
            if news is not None and len(news[t]):
                dh[:, news[t]] = 0
        scale = h.dtype.type(1 / max(len(logp), floor))
        for k, whole in grads.items():
            for j in range(0, len(whole), 1024):  # rows that stay in the cache of a core
                g, squares = whole[j : j + 1024], self.g[k][j : j + 1024]
                g *= scale
                root = g * g
                squares += root
                np.sqrt(squares, out=root)
                g *= rate
                g /= root
                self.p[k][j : j + 1024] -= g
        order = order_of(ids)
        first = np.flatnonzero(np.diff(ids.take(order), prepend=-1))
        seen = ids.take(order[first])
        # Sums over narrow rows: one over all columns takes twice as long.
        parts, order = back.reshape(-1, n), order * 3
        g = np.concatenate([np.add.reduceat(parts.take(order + k, 0), first) for k in range(3)], 1)
        g *= scale
        squares = self.g["x"].take(seen, 0)
        squares += g * g
        self.g["x"][seen] = squares
        g *= rate
        g /= np.sqrt(squares)
        self.p["x"][seen] -= g
        return last, float(logp.sum())


def _lanes(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, longest first: their numbers, starts, and how many are longer than each step."""
    n = np.diff(offsets)
    order = np.argsort(-n, kind="stable")
    active = np.searchsorted(-n[order], -np.arange(n.max(initial=0)), side="left")
    return order, offsets[:-1][order], active


def dealt_lanes(offsets: np.ndarray, least: int, most: int = 1 << 30) -> list[list[int]]:
    """Documents dealt over lanes of about equal length, the longest lane first; as many lanes as fill it and `least` steps, `most` at most."""
    n = np.diff(offsets)
    lanes = max(1, min(len(n), most, int(n.sum()) // max(int(n.max(initial=1)), least)))
    held: list[list[int]] = [[] for _ in range(lanes)]
    heap = [(0, k) for k in range(lanes)]
    for d in np.argsort(-n, kind="stable").tolist():
        size, k = heapq.heappop(heap)
        held[k].append(d)
        heapq.heappush(heap, (size + int(n[d]), k))
    sizes = [sum(int(n[d]) for d in ds) for ds in held]
    return [held[k] for k in sorted(range(lanes), key=lambda k: -sizes[k])]


def train_lanes(net: Network, ids: np.ndarray, offsets: np.ndarray, steps: int, rate: float, floor: int, least: int = 1024, tokens: int = 16_384) -> None:
    """Goes over all documents, one after the other in each lane; a document's state is carried through all its windows.

    A window has `steps` steps or, with few lanes, as many as make up about `tokens` tokens, 256 at most.
    """
    if len(offsets) < 2:
        return
    lanes = dealt_lanes(offsets, least, max(tokens // steps, 1))
    n = np.diff(offsets)
    at = [np.concatenate([np.arange(offsets[d], offsets[d + 1]) for d in ds]) for ds in lanes]
    sizes = np.array([len(x) for x in at])
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
    begins: dict[int, list[int]] = {}
    for k, ds in enumerate(lanes):
        for t in np.cumsum([0, *(int(n[d]) for d in ds[:-1])]).tolist():
            begins.setdefault(t, []).append(k)
    table = np.zeros((sizes[0], len(lanes)), np.int64)
    for k, x in enumerate(at):
        table[: len(x), k] = ids[x]
    steps = min(max(steps, tokens // len(lanes)), max(steps, 256))
    h = np.zeros((len(lanes), net.hidden), np.float32)
    none = np.zeros(0, np.int64)
    for t0 in range(0, len(active), steps):
        span = range(t0, min(t0 + steps, len(active)))
        # A document follows the end of the one before.
        xs = [table[t - 1, : active[t]] if t else np.full(active[0], END) for t in span]
        ys = [table[t, : active[t]] for t in span]
        news = [np.array(begins[t], np.int64) if t in begins else none for t in span]
        now, _ = net.window(xs, ys, h[: active[t0]], rate, floor, news)
        h[: len(now)] = now


def score_lanes(net: Network, ids: np.ndarray, offsets: np.ndarray, block: int = 60_000) -> np.ndarray:
    """log10 probability of each document's ids."""
    order, starts, active = _lanes(ids, offsets)
    h, turned = np.zeros((net.hidden, len(starts)), np.float32), net.turned()
    sums = np.zeros(len(starts))
    states, goals, lanes, n = [], [], [], 0
    last = np.full(len(starts), END)
    for t, k in enumerate(active.tolist()):
        h = net.advance(net.p["x"].take(last[:k], 0), h[:, :k], turned)[0]
        last = ids.take(starts[:k] + t)
        states.append(h.T)
        goals.append(last)
        lanes.append(k)
        n += k
        if n >= block or t == len(active) - 1:
            logp = net.output(np.concatenate(states), np.concatenate(goals))[0]
            who = np.concatenate([np.arange(k) for k in lanes])
            sums += np.bincount(who, logp, len(sums))
            states, goals, lanes, n = [], [], [], 0
    out = np.zeros(len(sums))
    out[order] = sums / np.log(10)
    return out


def _lm_ids(texts: pa.Array, vocabulary: pa.Array, frequent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Network ids with ends, their offsets; words' codes, offsets, distinct words, and each distinct word's place in the vocabulary or -1."""
    codes, distinct, offsets = split_words(texts, lower=True)
    place = pc.fill_null(pc.index_in(distinct, vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    own = np.where((place >= 0) & (place < frequent), place + 2, UNKNOWN)
    n = len(offsets) - 1
    ids = np.full(len(codes) + n, END, np.int64)
    ids[np.arange(len(codes)) + row_ids(offsets)] = own[codes]
    return ids, offsets + np.arange(n + 1), codes, offsets, distinct, place


class Counts:
    """Training counts: the table of all words, and the frequent ones at hand: about `most`, and more where `share` of the tokens needs more."""

    def __init__(self, table: DataFrame, most: int, share: float):
        self.table = table
        # Words of at least the count at which no more than `most` remain or `share` is reached, found on about 1,000 classes of counts.
        level = F.floor(F.log2("c") * 16).cast("int")
        self.words, self.tokens = table.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
        least, held, covered = 1 << 30, 0, 0
        for lv, n, c in sorted(map(tuple, table.groupBy(level.alias("level")).agg(F.count("*"), F.sum("c")).collect()), reverse=True):
            if held + n > most and covered >= share * self.tokens:
                break
            least, held, covered = lv, held + n, covered + c
        # Sorted on the driver.
        t = table.filter(level >= least).toArrow().sort_by([("c", "descending"), ("word", "ascending")])
        self.vocabulary, self.c = t["word"].combine_chunks() if t.num_rows else pa.array([], pa.string()), t["c"].to_numpy().astype(np.int64)
        #: So many of the most frequent words make up the share.
        self.needed = min(int(np.searchsorted(np.cumsum(self.c), share * self.tokens)) + 1, len(self.c))


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c over all texts; each task adds up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 16_000_000):
                codes, distinct, _ = split_words(part.column("text"), lower=True)
                yield pa.RecordBatch.from_arrays([distinct, pa.array(np.bincount(codes, minlength=len(distinct)).astype(np.int64))], names=["word", "c"])

    return docs.select(text_of().alias("text")).mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def fit(train: DataFrame, counts: Counts, n_docs: int, hidden: int, frequent: int, steps: int, rate: float, start_docs: int, replica_tokens: int) -> Network:
    """The network after all training rows (doc_id, text); without rows, the untrained one. Rows and their order in a replica follow from their content."""
    known = np.zeros(frequent + 2)
    known[END], known[UNKNOWN] = n_docs, counts.tokens - counts.c[:frequent].sum()
    known[2 : frequent + 2] = counts.c[:frequent]
    words = counts.vocabulary[:frequent]
    net = Network(hidden, known)
    start = train.orderBy(F.xxhash64("text"), "text").limit(start_docs).select("text").toArrow()["text"].combine_chunks()
    for at in range(0, len(start), 50):
        ids, offsets, *_ = _lm_ids(start[at : at + 50], words, frequent)
        train_lanes(net, ids, offsets, steps, rate, 500, 128, 2048)
    shared = train.sparkSession.sparkContext.broadcast((net, words))
    replicas = max(1, -(-(counts.tokens + n_docs) // replica_tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import copy

        one_thread()
        start, words = shared.value
        own, tokens, replica = copy.deepcopy(start), 0, -1

        def parameters() -> pa.RecordBatch:
            flat = own.flat()
            at = np.arange(0, len(flat), 20_000)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), replica), pa.int64()), pa.array(at, pa.int32()), pa.ListArray.from_arrays(pa.array(np.append(at, len(flat)), pa.int32()), pa.array(flat)), pa.array(np.full(len(at), tokens))], names=["replica", "i", "x", "n"])

        for rows, text in _gathered(batches, 12_000_000):
            if rows != replica:
                if tokens:
                    yield parameters()
                own, tokens, replica = copy.deepcopy(start), 0, rows
            ids, offsets, *_ = _lm_ids(text, words, len(words))
            train_lanes(own, ids, offsets, steps, rate / 2, 1500)
            tokens += len(ids)
        if tokens:
            yield parameters()

    def average(group: pa.Table) -> pa.Table:
        group = group.sort_by("replica")
        n = group["n"].to_numpy().astype(np.float64)
        x = group["x"].combine_chunks().flatten().to_numpy().reshape(len(n), -1)
        return pa.table({"i": group["i"][:1], "x": pa.array([(n @ x / n.sum()).astype(np.float32)], pa.list_(pa.float32()))})

    h = F.xxhash64("doc_id", "text")
    dealt = train.select(F.pmod(h, F.lit(replicas)).alias("replica"), h.alias("h"), "text").repartitionById(replicas, F.col("replica").cast("int")).sortWithinPartitions("replica", "h")
    found = dealt.select("replica", "text").mapInArrow(run, "replica long, i int, x array<float>, n long")
    mean = found.groupBy("i").applyInArrow(average, "i int, x array<float>").toArrow()
    return net.load(mean.sort_by("i")["x"].combine_chunks().flatten().to_numpy()) if mean.num_rows else net


def _gathered(batches: Iterator[pa.RecordBatch], most: int, long: int = 16_000) -> Iterator[tuple[int, pa.Array]]:
    """(replica, texts) of about `most` bytes, whatever the batches; texts over `long` bytes come together, so that few slices have long lanes."""
    held: dict[bool, list[pa.Array]] = {False: [], True: []}
    size, replica = {False: 0, True: 0}, None
    for batch in batches:
        ends = np.flatnonzero(np.diff(batch.column("replica").to_numpy())) + 1
        for a, b in zip([0, *ends], [*ends, batch.num_rows]):
            now = batch.column("replica")[a].as_py()
            if now != replica:
                if rest := held[False] + held[True]:
                    yield replica, pa.concat_arrays(rest)
                held, size, replica = {False: [], True: []}, {False: 0, True: 0}, now
            texts = batch.column("text").slice(a, b - a)
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            for kind in (False, True):
                own = np.flatnonzero((sizes > long) == kind)
                text, ends_at = texts.take(pa.array(own)), np.cumsum(sizes[own])
                at = 0
                while at < len(text):
                    before = ends_at[at - 1] if at else 0
                    end = max(at + 1, int(np.searchsorted(ends_at, before + most - size[kind], side="right")))
                    held[kind].append(text.slice(at, end - at))
                    size[kind] += int(ends_at[end - 1] - before)
                    at = end
                    if size[kind] >= most or at < len(text):
                        yield replica, pa.concat_arrays(held[kind])
                        held[kind], size[kind] = [], 0
    if rest := held[False] + held[True]:
        yield replica, pa.concat_arrays(rest)


def _parted(batches: Iterator[pa.RecordBatch], most: int, long: int = 16_000) -> Iterator[pa.RecordBatch]:
    """Slices of about `most` bytes of text; rows with texts over `long` bytes come together."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, "text", most):
            far = pc.greater(pc.binary_length(part.column("text")), long)
            near = part.filter(pc.invert(far))
            if near.num_rows:
                yield near
            apart = part.filter(far)
            if apart.num_rows:
                held.append(apart)
                size += sum(pc.binary_length(apart.column("text")).to_pylist())
            if size >= most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def lm_scores(docs: DataFrame, folds: int = 5, held: int = 1, hidden: int = 16, words: int = 1022, steps: int = 32, rate: float = 0.1, start_docs: int = 400, frequent: int = 200_000, share: float = 0.8, replica_tokens: int = 4_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; scores are log10 probabilities.

    The held fold trains nothing. A null or empty text is its end alone; repeated rows score alike (and train twice).
    With no training rows, base_score is 0 and the network is the untrained one. Words beyond the `frequent` ones are
    priced by a join with the counts of all training words. The network's words make up `share` of the training tokens,
    and are `words` at least. Extra columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_fold("doc_id", folds) == held).alias("held_out"), text_of().alias("text"))
    train = rows.filter(~F.col("held_out"))
    n_docs = train.count()
    counts = Counts(staged(word_counts(train), "word-counts"), frequent, share)
    n_frequent = min(len(counts.vocabulary), max(words, counts.needed))
    net = fit(train, counts, n_docs, hidden, n_frequent, steps, rate, start_docs, replica_tokens)
    n_train, distinct_words = counts.tokens + n_docs, counts.words + (n_docs > 0)
    floor = np.log10(n_train + 0.5 * (distinct_words + 1))
    rest = np.log10(counts.tokens - counts.c[:n_frequent].sum() + 0.5 * (counts.words - n_frequent + 1))
    end = np.log10(n_docs + 0.5)
    shared = docs.sparkSession.sparkContext.broadcast((net, counts.vocabulary, np.log10(counts.c + 0.5)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        net, vocabulary, logs = shared.value
        for part in _parted(batches, 8_000_000):
            ids, ends, codes, offsets, distinct, place = _lm_ids(part.column("text"), vocabulary, n_frequent)
            n, row = part.num_rows, row_ids(offsets)
            p = place[codes]
            value = np.where(p >= 0, np.append(logs, 0.0)[p], 0.0)
            add = lambda x: np.bincount(row, x, n).astype(float)  # noqa: E731  whole numbers if there is no word
            far = np.flatnonzero(p < 0)
            keys, tf = np.unique(row[far] * max(len(distinct), 1) + codes[far], return_counts=True)
            held_by = np.concatenate([[0], np.cumsum(np.bincount(keys // max(len(distinct), 1), minlength=n))])
            words = pa.StructArray.from_arrays([distinct.take(pa.array(keys % max(len(distinct), 1))), pa.array(tf.astype(np.int64))], names=["word", "n"])
            yield pa.RecordBatch.from_arrays(
                [part.column("uid"), part.column("doc_id"), part.column("held_out"), pa.array(np.diff(ends)), pa.array(add((p >= 0) * 1.0).astype(np.int64)), pa.array(add(value)), pa.array(add(np.where(p >= n_frequent, value, 0.0))), pa.array(add((p < 0) | (p >= n_frequent)).astype(np.int64)), pa.array(score_lanes(net, ids, ends, 60_000)), pa.ListArray.from_arrays(pa.array(held_by, pa.int32()), words)],
                names=["uid", "doc_id", "held_out", "n_tokens", "n_near", "near", "near_unknown", "n_unknown", "network", "far"],
            )

    schema = "uid long, doc_id long, held_out boolean, n_tokens long, n_near long, near double, near_unknown double, n_unknown long, network double, far array<struct<word:string,n:bigint>>"
    scored = staged(rows.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(run, schema), "lm")
    far = scored.select("uid", F.explode("far").alias("f")).select("uid", "f.word", "f.n")
    far = far.join(counts.table, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    far = far.groupBy("uid").agg(F.sum(F.col("n") * F.log10(F.col("c") + 0.5)).alias("far_log"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_far"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = scored.drop("far").join(far, "uid", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_near") + zero("n_far") + F.lit(int(n_docs > 0))).cast("long").alias("n_known"), F.lit(int(n_train)).cast("long").alias("train_tokens"),
        (F.col("near") + zero("far_log") + F.lit(float(end)) - F.col("n_tokens") * F.lit(float(floor))).alias("base_score"),
        (F.col("network") + F.col("near_unknown") + zero("far_log") - F.col("n_unknown") * F.lit(float(rest))).alias("score"),
    )

"""LM scoring: a log-bilinear model trained by noise-contrastive estimation, over counts of the whole corpus."""

from __future__ import annotations

import copy
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelake.llm import common as C
from bytelake.llm.quality import held_out

#: Words with RARE training tokens or more, as far as all tasks hold them (HELD), are told apart; all others are dealt by
#: hash to CLASSES classes (a power of two), each with an output and a context of its own.
RARE, CLASSES = 64, 64
#: Length of the vectors, and words before a token that predict it, each position with a matrix of its own.
WIDTH, CONTEXT = 8, 2
#: Tokens of a step of training, noise outputs a true one, learning rate.
BATCH, NOISE, RATE = 8_192, 8, 0.1
#: Tokens scored at once.
SCORED = 8_192
#: Tokens that a copy trains on, on average at least, for each output of the model: what the copies send grows with the tokens.
PER_ROW = 64
#: Rows of the model that are averaged and sent together.
BLOCK = 1_024
#: Words whose counts all tasks hold (12 bytes each); counts of rarer words come by a join.
HELD = 1 << 18
FLUSH = 400_000
END = 0  # the hash that stands for a text's end


#: A random number for each byte at each of a word's first places; longer words are hashed one by one.
_PLACES = 64
_RANDOM = np.random.default_rng(11).integers(0, 1 << 64, _PLACES << 8, np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


def hash_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of texts laid end to end, each text's end (END) among them, and the texts' first places.

    The words are those of common.split_words; a word's hash is the sum of random numbers for its bytes by place. A null
    text has its end alone.
    """
    if not len(texts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    texts = texts.fill_null("").cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    word = ~_SPACE[data]
    edge = np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    first, last = edge[:-1] == 1, edge[1:] == -1
    cut = bounds[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut], last[cut - 1] = word[cut], word[cut - 1]
    at = np.flatnonzero(first)
    size = np.flatnonzero(last) + 1 - at
    x = _LOWER[data[word]].astype(np.int64)
    start = np.cumsum(size) - size
    place = np.arange(len(x)) - np.repeat(start, size)
    h = np.add.reduceat(_RANDOM[np.minimum(place, _PLACES - 1) << 8 | x], start) if len(start) else np.empty(0, np.uint64)
    for i in np.flatnonzero(size > _PLACES).tolist():
        h[i] = xxhash.xxh3_64_intdigest(_LOWER[data[at[i] : at[i] + size[i]]].tobytes())
    text = np.searchsorted(bounds, at, side="right") - 1
    out = np.full(len(h) + len(texts), END, np.uint64)
    out[np.arange(len(h)) + text] = np.where(h == END, np.uint64(1), h)
    return out, np.searchsorted(at, bounds[:-1]) + np.arange(len(texts))


def count_words(docs: DataFrame) -> DataFrame:
    """(h, c): tokens of all texts (column t), ends included, by hash."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter()

        def rows():
            h = np.fromiter(total.keys(), np.uint64, len(total))
            return pa.RecordBatch.from_arrays([pa.array(C.signed(h)), pa.array(np.fromiter(total.values(), np.int64, len(total)))], ["h", "c"])

        for rb in C.pieces(batches):
            h, n = np.unique(hash_tokens(rb.column(0))[0], return_counts=True)
            for k, c in zip(h.tolist(), n.tolist(), strict=True):
                total[k] += c
            if len(total) > FLUSH:
                yield rows()
                total.clear()
        if total:
            yield rows()

    return docs.select("t").mapInArrow(go, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def word_class(h: np.ndarray) -> np.ndarray:
    """The class of a word that isn't told apart: the top bits of its hash."""
    return (h >> np.uint64(65 - CLASSES.bit_length())).astype(np.int64)


class Index:
    """Symbols and counts of words by sorted hash. Symbols: the vocabulary by falling count, then the classes of all
    other words, then STOP (as a context: a text's start)."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        """Both by falling count; the end isn't among them."""
        self.words = int((counts >= RARE).sum())
        self.stop = self.words + CLASSES
        order = np.argsort(hashes)
        self.hash, self.count = hashes[order], counts[order]
        self.symbol = np.where(order < self.words, order, self.words + word_class(self.hash))
        # Where hashes of equal top bits begin: a look-up tries one place, and few ones the next.
        self.shift = np.uint64(64 - max(1, len(hashes).bit_length() + 1))
        self.begin = np.searchsorted(self.hash, np.arange(1 << int(64 - self.shift), dtype=np.uint64) << self.shift).astype(np.int32)

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and count of each hash; count -1 where it isn't held."""
        symbol, count = np.where(h == END, self.stop, self.words + word_class(h)), np.full(len(h), -1)
        if not len(self.hash):
            return symbol, count
        left, at = np.arange(len(h)), self.begin[h >> self.shift].astype(np.int64)
        while len(left):
            held = self.hash[np.minimum(at, len(self.hash) - 1)]
            own = h[left]
            there = (held == own) & (at < len(self.hash))
            found = left[there]
            symbol[found], count[found] = self.symbol[at[there]], self.count[at[there]]
            more = (held < own) & (at + 1 < len(self.hash))
            left, at = left[more], at[more] + 1
        return symbol, count


def contexts(symbols: np.ndarray, starts: np.ndarray, stop: int) -> np.ndarray:
    """The CONTEXT symbols before each token of texts laid end to end, nearest first; before a text's start: stop."""
    at = np.arange(len(symbols)) - np.repeat(starts, np.diff(np.append(starts, len(symbols))))
    out = np.full((CONTEXT, len(symbols)), stop, np.int64)
    for k in range(1, min(CONTEXT, len(symbols) - 1) + 1):
        out[k - 1, k:] = np.where(at[k:] >= k, symbols[:-k], stop)
    return out


def _sum_rows(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows by their value of at, 0 to size - 1."""
    return np.stack([np.bincount(at, rows[:, j], size) for j in range(rows.shape[1])], 1).astype(np.float32)


def _tree(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Huffman's tree over outputs: each inner node's two children, outputs first, then inner nodes in their order of
    making, and its right child's share of its weight."""
    size, order = len(weights), np.argsort(weights, kind="stable").tolist()
    weight = [*weights.tolist(), *[0.0] * (size - 1)]
    child, share, leaf, inner = np.empty((max(size - 1, 0), 2), np.int64), np.empty(max(size - 1, 0)), 0, size
    for new in range(size, 2 * size - 1):
        pair = []
        for _ in range(2):  # outputs by rising weight and inner nodes, made by rising weight: the lighter head
            if leaf < size and (inner >= new or weight[order[leaf]] <= weight[inner]):
                pair.append(order[leaf])
                leaf += 1
            else:
                pair.append(inner)
                inner += 1
        weight[new] = weight[pair[0]] + weight[pair[1]]
        child[new - size], share[new - size] = pair, weight[pair[1]] / weight[new]
    return child, share


class Model:
    """A log-bilinear model: the context's vectors, each through the matrix of its position, add up to a prediction,
    whose products with the vectors of a tree's inner nodes, and their biases, say which way to go.

    Outputs are the leaves of a tree by frequency, so that a token costs about as many products as its outputs have
    bits, whatever the vocabulary's size; the probability of an output is the product of its path's turns. Training
    changes only rows that a step meets.
    """

    def __init__(self, counts: np.ndarray, seed: int = 7):
        rng, size = np.random.default_rng(seed), len(counts)
        child, share = _tree(counts + 0.5)
        parent, turn = np.full(2 * size - 1, -1), np.zeros(2 * size - 1, bool)
        for side in (0, 1):
            parent[child[:, side]], turn[child[:, side]] = np.arange(size - 1), side
        node, bit, of, up = [], [], [], np.arange(size)
        who = np.arange(size)
        while len(who):  # a step up from all outputs at once
            above = parent[up]
            who, up, above = who[above >= 0], up[above >= 0], above[above >= 0]
            node.append(above), bit.append(turn[up]), of.append(who)
            up = above + size
        of = np.concatenate(of)
        order = np.argsort(of, kind="stable")
        self.node, self.bit = (np.concatenate(x)[order].astype(t) for x, t in ((node, np.int32), (bit, np.float32)))
        self.length = np.bincount(of, minlength=size)
        self.begin = np.cumsum(self.length) - self.length
        self.share = share.astype(np.float32)
        self.context = rng.normal(0, 0.1, (size, WIDTH)).astype(np.float32)
        self.matrix = np.concatenate([np.eye(WIDTH)] * CONTEXT).astype(np.float32)
        self.output = np.zeros((size - 1, WIDTH), np.float32)
        self.bias = (np.log(share) - np.log1p(-share)).astype(np.float32)[:, None]
        self.params = [self.context, self.matrix, self.output, self.bias]

    def copy(self) -> Model:
        """A model with parameters of its own, and the same tree."""
        new = copy.copy(self)
        new.context, new.matrix, new.output, new.bias = new.params = [p.copy() for p in self.params]
        return new

    def predict(self, context: np.ndarray) -> np.ndarray:
        return sum(self.context.take(c, axis=0) @ self.matrix[k * WIDTH : (k + 1) * WIDTH] for k, c in enumerate(context))

    def paths(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nodes and turns of the outputs' paths laid end to end, the paths' lengths and first places."""
        n = self.length.take(symbols)
        first = np.cumsum(n) - n
        at = np.repeat(self.begin.take(symbols) - first, n) + np.arange(n.sum())
        return self.node.take(at), self.bit.take(at), n, first

    def log_probabilities(self, symbols: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Natural log-probability of each symbol after its context."""
        out = np.zeros(len(symbols))
        for a in range(0, len(symbols), SCORED):
            node, bit, n, first = self.paths(symbols[a : a + SCORED])
            h = np.repeat(self.predict(context[:, a : a + SCORED]), n, axis=0)
            x = np.einsum("ij,ij->i", h, self.output.take(node, axis=0)) + self.bias.take(node)
            x *= 1 - 2 * bit
            turns = np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x)))  # -log of the turn's probability
            out[a : a + SCORED] = -np.add.reduceat(turns, first, dtype=np.float64)
        return out

    def train(self, symbols: np.ndarray, context: np.ndarray, seen: list[np.ndarray], rng: np.random.Generator | None = None) -> None:
        """One step of noise-contrastive estimation by AdaGrad: at each node of a path the turn taken is told from NOISE
        turns by frequency, of which, as there are two kinds, the expectation is taken instead of a draw. seen: sums of
        squared gradients."""
        node, bit, n, first = self.paths(symbols)
        own, before = self.output.take(node, axis=0), np.repeat(self.predict(context), n, axis=0)
        x = np.einsum("ij,ij->i", before, own) + self.bias.take(node)
        p, q = 1 / (1 + np.exp(np.clip(-x, -30, 30))), self.share.take(node)
        right, left = p / (p + NOISE * q), (1 - p) / (1 - p + NOISE * (1 - q))  # of one kind of turn, the true ones' share
        true = (1 - np.where(bit > 0, right, left)) * (bit - p)
        e = (NOISE * (q * right * (1 - p) - (1 - q) * left * p) - true) / np.float32(len(symbols))
        own *= e[:, None]
        before *= e[:, None]
        dh = np.add.reduceat(own, first, axis=0)
        rows, at = _touched(node, len(self.output))
        self._step(2, rows, _sum_rows(at, before, len(rows)), seen)
        self._step(3, rows, np.bincount(at, e, len(rows))[:, None].astype(np.float32), seen)
        rows, at = _touched(context.reshape(-1), len(self.context))
        d_context, d_matrix, vectors = np.zeros((len(rows), WIDTH), np.float32), np.zeros_like(self.matrix), self.context.take(rows, axis=0)
        for k, c in enumerate(at.reshape(context.shape)):
            block, by = slice(k * WIDTH, (k + 1) * WIDTH), _sum_rows(c, dh, len(rows))
            d_matrix[block] = vectors.T @ by
            d_context += by @ self.matrix[block].T
        self._step(0, rows, d_context, seen)
        self._step(1, np.arange(len(self.matrix)), d_matrix, seen)

    def _step(self, i: int, rows: np.ndarray, d: np.ndarray, seen: list[np.ndarray]) -> None:
        s = seen[i].take(rows, axis=0) + d * d
        seen[i][rows] = s
        self.params[i][rows] -= RATE * d / np.sqrt(s + 1e-8)


def _touched(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of at, all less than size, and each one's place among them."""
    there = np.zeros(size, bool)
    there[at] = True
    rows = np.flatnonzero(there)
    place = np.empty(size, np.int32)
    place[rows] = np.arange(len(rows))
    return rows, place.take(at)


def fit(docs: DataFrame, index, counts: np.ndarray) -> Model:
    """A model trained on all tokens of all texts (column t), once.

    Each task trains a copy on its own texts, from one start; the copies' rows, as far as a task's texts met them, are
    then averaged, weighted by how many tokens trained them, by grouped aggregation. A task reads so many partitions that
    there is no more than a copy for PER_ROW tokens an output: as outputs end at HELD and CLASSES, a task's tokens are
    bounded, and rows sent are in proportion to the tokens. Only the averaged rows, no more than twice HELD, reach the driver.
    """
    copies = max(1, int(counts.sum() / (PER_ROW * len(counts))))
    begun = Model(counts)
    start = docs.sparkSession.sparkContext.broadcast(begun)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = start.value.copy()
        seen = [np.full(p.shape, 1e-6, np.float32) for p in model.params]
        words, met = np.zeros(len(model.context), np.int64), np.zeros(len(model.context), np.int64)
        for rb in C.pieces(batches):
            h, starts = hash_tokens(rb.column(0))
            symbols = index.value(h)[0]
            context = contexts(symbols, starts, index.value.stop)
            for a in range(0, len(symbols), BATCH):
                model.train(symbols[a : a + BATCH], context[:, a : a + BATCH], seen)
            words += np.bincount(symbols, minlength=len(words))
            met += np.bincount(context.reshape(-1), minlength=len(met))
        nodes = np.zeros(len(model.output), np.int64)
        for a in range(0, len(words), SCORED):  # a node is met by all tokens below it
            some = np.arange(a, min(a + SCORED, len(words)))
            node, _, n, _ = model.paths(some)
            nodes += np.bincount(node, np.repeat(words[some], n), len(nodes)).astype(np.int64)
        for i, n in enumerate([met, np.full(len(model.matrix), words.sum()), nodes, nodes]):
            rows = np.flatnonzero(n)
            for at in np.split(rows, np.flatnonzero(np.diff(rows // BLOCK)) + 1) if len(rows) else []:
                cells = [pa.array([x], kind) for x, kind in ((i, pa.int64()), (at[0] // BLOCK, pa.int64()), *((y.tobytes(), pa.binary()) for y in (at, n[at], model.params[i][at])))]
                yield pa.RecordBatch.from_arrays(cells, ["part", "block", "at", "n", "vec"])

    def mean(tb: pa.Table) -> dict:
        i, block = tb.column("part")[0].as_py(), tb.column("block")[0].as_py()
        whole, total = np.zeros((BLOCK, begun.params[i].shape[1])), np.zeros(BLOCK)
        for at, n, vec in zip(*(tb.column(c).to_pylist() for c in ("at", "n", "vec")), strict=True):
            at, n = np.frombuffer(at, np.int64) - block * BLOCK, np.frombuffer(n, np.int64)
            whole[at] += n[:, None] * np.frombuffer(vec, np.float32).reshape(len(at), -1)
            total[at] += n
        at = np.flatnonzero(total)
        out = np.empty((2, 1), object)
        out[:, 0] = [(at + block * BLOCK).tobytes(), (whole[at] / total[at, None]).astype(np.float32).tobytes()]
        return {"part": np.array([i]), "at": out[0], "vec": out[1]}

    names = ["part", "at", "vec"]
    sent = docs.select("t").coalesce(copies).mapInArrow(go, "part long, block long, at binary, n binary, vec binary")
    got = C.run_groups(sent, ["part", "block"], mean, "part long, at binary, vec binary", names).toArrow()
    model = begun.copy()
    for i, at, vec in zip(*(got[c].to_pylist() for c in names), strict=True):
        at = np.frombuffer(at, np.int64)
        model.params[i][at] = np.frombuffer(vec, np.float32).reshape(len(at), -1)
    return model


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words of the text, A-Z lower-cased, and one end; a null text has the end alone. Learning uses
    the whole texts whose crc32(doc_id) modulo 7 is not 2 (a null id is learned from). base_score is the sum of
    log10 (c + 1) / (N + V + 1); score is the model's log10 probability: of each token, given the two before, by
    the log-bilinear network, and for words that it doesn't tell apart, that of their class times their add-one share of
    it, with one unseen word, so that probabilities add up to 1. Repeated rows are scored each; with
    nothing to learn from, every token is unseen; an empty table gives no rows; other columns are ignored.

    Words are counted, and the network trained, over all training texts (see fit). The most frequent HELD words' counts go to
    every task; other words leave a row each, which joins the full table of counts.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).cast("long").alias("k"), F.col(text).cast("string").alias("t"), held_out(doc_id, 7).alias("out"))
    base = base.withColumn("row", F.monotonically_increasing_id())
    known = base.where("NOT out").select("t")
    counts, seen = C.materialize(count_words(known), F.sum("c").alias("n"), F.count("*").alias("v"))
    n, v = seen["n"] or 0, seen["v"]
    ends = sum(r["c"] for r in counts.where(F.col("h") == END).collect())
    top = counts.where(F.col("h") != END).orderBy(F.desc("c"), "h").limit(HELD).toArrow()
    index = Index(top["h"].to_numpy().view(np.uint64), top["c"].to_numpy())
    sent = spark.sparkContext.broadcast(index)
    named = top.slice(0, index.words)
    # Tokens and words of each class but for those of its words that are told apart.
    own = F.shiftrightunsigned("h", 65 - CLASSES.bit_length()).alias("i")
    tokens, kinds = np.zeros((2, CLASSES))
    for i, c, k in counts.where(F.col("h") != END).groupBy(own).agg(F.sum("c"), F.count("*")).collect():
        tokens[i], kinds[i] = c, k
    of = word_class(named["h"].to_numpy().view(np.uint64))
    tokens -= np.bincount(of, named["c"].to_numpy(), CLASSES)
    kinds -= np.bincount(of, minlength=CLASSES)
    fitted = spark.sparkContext.broadcast(fit(known, sent, np.array([*named["c"].to_pylist(), *tokens, ends], float)))
    rest = tokens + kinds + 1  # tokens of a class's words, plus one for each and the unseen
    all_words = n + v + 1

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in C.pieces(batches):
            h, starts = hash_tokens(rb.column(1))
            symbols, c = sent.value(h)
            stop = h == END
            c[stop] = ends
            here = c >= 0
            score = fitted.value.log_probabilities(symbols, contexts(symbols, starts, sent.value.stop)) / np.log(10)
            shared = np.flatnonzero((symbols >= sent.value.words) & ~stop)
            score[shared] += np.log10(np.where(here[shared], c[shared] + 1, 1) / rest[symbols[shared] - sent.value.words])
            base = np.where(here, np.log10((np.maximum(c, 0) + 1) / all_words), 0.0)
            size = np.diff(np.append(starts, len(h)))
            per = [np.add.reduceat(x, starts) for x in ((c > 0).astype(np.int64), base, score)]
            doc = np.repeat(np.arange(len(starts)), size)[~here]
            rare = h[~here]
            order = np.lexsort((rare, doc))
            first = np.flatnonzero((np.diff(doc[order], prepend=-1) != 0) | (np.diff(rare[order], prepend=rare[order][:1] + np.uint64(1)) != 0))
            tf, first = np.diff(np.append(first, len(order))), order[first]
            m, row = len(first), rb.column(0).to_numpy()
            pad = lambda x, kind: pa.concat_arrays([pa.array(x, kind), pa.nulls(m, kind)])
            tailed = lambda x: pa.concat_arrays([pa.nulls(len(starts), pa.int64()), pa.array(x, pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([row, row[doc[first]]])),
                    tailed(C.signed(rare[first])),
                    pad(size, pa.int64()),
                    pad(per[0], pa.int64()),
                    pad(per[1], pa.float64()),
                    pad(per[2], pa.float64()),
                    tailed(tf),
                    pa.concat_arrays([rb.column(2), pa.nulls(m, pa.int64())]),
                    pa.concat_arrays([rb.column(3), pa.nulls(m, pa.bool_())]),
                ],
                ["row", "h", "n", "known", "base", "score", "tf", "k", "out"],
            )

    parts = C.materialize(base.select("row", "t", "k", "out").mapInArrow(go, "row long, h long, n long, known long, base double, score double, tf long, k long, out boolean"))
    tail = parts.where("h IS NOT NULL").select("row", "h", "tf").join(counts, "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    tail = tail.select(
        "row",
        F.lit(0).cast("long").alias("n"),
        F.when(F.col("c") > 0, F.col("tf")).otherwise(0).alias("known"),
        (F.col("tf") * F.log10((F.col("c") + 1) / F.lit(float(all_words)))).alias("base"),
        (F.col("tf") * F.log10(F.col("c") + 1.0)).alias("score"),
    )
    whole = parts.where("h IS NULL").select("row", "n", "known", "base", "score", "k", "out").unionByName(tail, allowMissingColumns=True)
    whole = whole.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("n", "known", "base", "score")), F.max("k").alias("k"), F.max("out").alias("out"))
    return whole.select(
        F.col("k").alias("doc_id"),
        F.col("out").alias("held_out"),
        F.col("n").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
    )

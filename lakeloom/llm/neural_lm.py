"""Language-model scores by a log-bilinear model trained with noise-contrastive estimation.

Word counts of all training documents form the vocabulary. The model's outputs are the end mark, the most frequent
words and classes of all other words, those that end in the same three bytes (hashed); within its class a word has
its add-one share, with room for one word that was never seen. Two context words predict a vector,
q = r1 * c1 + r2 * c2, that is scored against all outputs. Each round of training runs over the whole corpus: a task
descends on its own documents, then parameters are averaged by tokens. As a score is a sum of one term for each
context word, matrix products give every logit and every normaliser beforehand:
P(w | w1, w2) = exp(A1[w1, w] + A2[w2, w] + b[w]) / Z[w1, w2].
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .textvec import Words, mix64, slices

#: Outputs: the end mark, LISTED words and CLASSES of the others. The tables of the model have their squared number of entries.
LISTED = 511
CLASSES = 1536
SUFFIX = 3
DIM = 16
ROUNDS = 2
RATE = 0.1
#: Each block of tokens is told apart from NOISE words of its own; BATCH tokens make a step.
NOISE = 16
BLOCK = 256
BATCH = 4096
TOP_WORDS = 1 << 18
#: At most so many tasks descend, each over the partitions that coalesce gives it.
MAX_TRAINERS = 4096
END = 0


@dataclass
class Vocabulary:
    hashes: np.ndarray  # of the top words, sorted
    counts: np.ndarray
    ids: np.ndarray  # their output: 1 to the number of listed words, or -1 for words scored by their class
    listed: int
    unigram: np.ndarray  # probability of each output
    mass: np.ndarray  # of each class: sum of count + 1 over its words, and 1 for all unseen ones
    tokens: int
    types: int
    ends: int


def classes_of(words: Words) -> np.ndarray:
    """The class of each word: a hash of its last bytes, in lower case."""
    lower = np.arange(256)
    lower[65:91] += 32
    value = np.zeros(len(words.start), np.uint64)
    for j in range(1, SUFFIX + 1):
        at = words.end - j
        value = value * np.uint64(257) + np.where(at >= words.start, lower[words.data[np.maximum(at, 0)]], 256).astype(np.uint64)
    return (mix64(value, 5) % np.uint64(CLASSES)).astype(np.int64)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    total = 0
    emit = lambda h, k, c: pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(k), pa.array(c)], names=["word", "cls", "c"])

    def merged():
        every, kinds, sizes = (np.concatenate(x) for x in zip(*held))
        h, first, inverse = np.unique(every, return_index=True, return_inverse=True)
        return h, kinds[first], np.bincount(inverse, weights=sizes).astype(np.int64)

    for batch in batches:
        for _, data, ends in slices(batch, "text"):
            words = Words(data, ends)
            h, first, c = np.unique(words.hash, return_index=True, return_counts=True)
            held.append((h, classes_of(words)[first], c))
            total += len(h)
            if total > 2_000_000:
                held = [merged()]
                total = len(held[0][0])
                if total > 1_000_000:
                    yield emit(*held[0])
                    held, total = [], 0
    if held:
        yield emit(*merged())


def least_count(words: DataFrame, most: int = TOP_WORDS) -> int:
    """The least count such that no more than `most` words have it or more."""
    sizes = words.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(most).collect()
    total, least = 0, 1 + (sizes[0]["c"] if sizes else 0)
    for row in sizes:
        total += row["n"]
        if total > most:
            break
        least = row["c"]
    return least


def vocabulary(train: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """The bounded part that tasks hold, and the table (word, cls, c) of all words."""
    words = train.select("text").mapInArrow(count_words, "word long, cls long, c long").groupBy("word").agg(F.min("cls").alias("cls"), F.sum("c").alias("c"))
    words = staged(words, "lm-words")
    ends = train.count()
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    least = least_count(words)
    top = words.where(F.col("c") >= least).toArrow()  # at most TOP_WORDS rows
    hashes, counts, kinds = (top.column(c).to_numpy().astype(np.int64) for c in ("word", "c", "cls"))
    hashes = hashes.view(np.uint64)
    order = np.lexsort((hashes, -counts))
    hashes, counts, kinds = hashes[order], counts[order], kinds[order]
    listed = min(LISTED, len(hashes))
    ids = np.full(len(hashes), -1)
    ids[:listed] = np.arange(1, 1 + listed)
    whole = words.groupBy("cls").agg(F.sum("c").alias("c"), F.count("*").alias("n")).toArrow()  # at most CLASSES rows
    size, types = np.zeros(CLASSES), np.zeros(CLASSES)
    size[whole.column("cls").to_numpy()], types[whole.column("cls").to_numpy()] = whole.column("c").to_numpy(), whole.column("n").to_numpy()
    size -= np.bincount(kinds[:listed], weights=counts[:listed], minlength=CLASSES)
    types -= np.bincount(kinds[:listed], minlength=CLASSES)
    mass = np.concatenate(([ends], counts[:listed], size)) + 0.5
    order = np.argsort(hashes)
    return Vocabulary(hashes[order], counts[order], ids[order], listed, mass / mass.sum(), size + types + 1, n + ends, v + (ends > 0), ends), words


@dataclass
class Parameters:
    context: np.ndarray  # outputs x DIM
    target: np.ndarray
    c1: np.ndarray
    c2: np.ndarray
    bias: np.ndarray

    @staticmethod
    def start(unigram: np.ndarray) -> Parameters:
        rng = np.random.Generator(np.random.PCG64(7))
        size = (len(unigram), DIM)
        return Parameters(rng.normal(0, 0.3, size), rng.normal(0, 0.01, size), np.ones(DIM), np.full(DIM, 0.5), np.log(unigram))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.context.ravel(), self.target.ravel(), self.c1, self.c2, self.bias])

    @staticmethod
    def of(flat: np.ndarray, outputs: int) -> Parameters:
        at = np.cumsum([outputs * DIM, outputs * DIM, DIM, DIM])
        a, b, c, d, e = np.split(flat, at)
        return Parameters(a.reshape(outputs, DIM), b.reshape(outputs, DIM), c, d, e)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits of each context word in both places (bias in the first), and log Z of each pair of them."""
        a1 = (self.context * self.c1) @ self.target.T + self.bias
        a2 = (self.context * self.c2) @ self.target.T
        top1, top2 = a1.max(axis=1, keepdims=True), a2.max(axis=1, keepdims=True)
        z = np.log(np.exp(a1 - top1) @ np.exp(a2 - top2).T) + top1 + top2.T
        return a1.astype(np.float32), a2.astype(np.float32), z.astype(np.float32)


def token_rows(words: Words, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of words and an end mark after each text: output, context outputs before it, and the index of the word (-1: end)."""
    at = np.minimum(np.searchsorted(vocab.hashes, words.hash), max(len(vocab.hashes) - 1, 0))
    known = vocab.hashes[at] == words.hash if len(vocab.hashes) else np.zeros(len(words.hash), bool)
    total = len(words.hash) + len(words.count)
    place = np.ones(total, bool)
    last = np.cumsum(words.count + 1) - 1
    place[last] = False
    out = np.full(total, END)
    own = 1 + vocab.listed + classes_of(words)
    if len(vocab.ids):
        own = np.where(known & (vocab.ids[at] >= 0), vocab.ids[at], own)
    out[place] = own
    index = np.full(total, -1)
    index[place] = np.where(known, at, len(vocab.hashes))
    one, two = np.full(total, END), np.full(total, END)
    one[1:], two[2:] = out[:-1], out[:-2]
    begin = last - words.count
    one[begin] = END
    two[begin] = END
    two[np.minimum(begin + 1, last)] = END
    return out, one, two, index


def descend(batches: Iterator[pa.RecordBatch], vocab: Vocabulary, flat: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Adagrad on the noise-contrastive loss over a task's documents; one row for each parameter."""
    p, outputs = Parameters.of(flat.copy(), len(vocab.unigram)), len(vocab.unigram)
    rng = np.random.Generator(np.random.PCG64(13))
    log_noise, cdf = np.log(NOISE * vocab.unigram), np.cumsum(vocab.unigram)
    squares = [np.full(x.shape, 1e-2) for x in (p.context, p.target, p.c1, p.c2, p.bias)]
    total = 0
    summed = lambda index, g: np.stack([np.bincount(index, weights=g[:, j], minlength=outputs) for j in range(DIM)], axis=1)
    chance = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def step(w, w1, w2):
        """Tokens w, in whole blocks or less than one: each block has its own noise."""
        n, wide = len(w), min(BLOCK, len(w))
        noise = np.minimum(np.searchsorted(cdf, rng.random((n // wide, NOISE))), outputs - 1)
        r1, r2 = p.context[w1], p.context[w2]
        q = r1 * p.c1 + r2 * p.c2
        tq, tn, blocks = p.target[w], p.target[noise], q.reshape(-1, wide, DIM)
        e = chance(np.einsum("ij,ij->i", q, tq) + p.bias[w] - log_noise[w]) - 1
        f = chance(blocks @ tn.transpose(0, 2, 1) + (p.bias[noise] - log_noise[noise])[:, None, :])
        dq = (e[:, None] * tq + (f @ tn).reshape(n, DIM)) / n
        both = np.concatenate((w, noise.ravel()))
        target = summed(both, np.concatenate((e[:, None] * q, (f.transpose(0, 2, 1) @ blocks).reshape(-1, DIM))) / n)
        bias = np.bincount(both, weights=np.concatenate((e, f.sum(axis=1).ravel())) / n, minlength=outputs)
        context = summed(np.concatenate((w1, w2)), np.concatenate((dq * p.c1, dq * p.c2)))
        for x, g, s in zip((p.context, p.target, p.c1, p.c2, p.bias), (context, target, (dq * r1).sum(axis=0), (dq * r2).sum(axis=0), bias), squares):
            g = g * outputs
            s += g * g
            x -= RATE * g / np.sqrt(s)

    for batch in batches:
        for _, data, ends in slices(batch, "text"):
            out, one, two, _ = token_rows(Words(data, ends), vocab)
            order = rng.permutation(len(out))
            for a in range(0, len(out), BATCH):
                i = order[a : a + BATCH]
                cut = len(i) // BLOCK * BLOCK
                for j in (i[:cut], i[cut:]):
                    if len(j):
                        step(out[j], one[j], two[j])
            total += len(out)
    if total:
        value = p.flat() * total
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(value))), pa.array(value), pa.array(np.full(len(value), float(total)))], names=["place", "value", "weight"])


def fit(train: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> Parameters:
    flat = Parameters.start(vocab.unigram).flat()
    for _ in range(rounds):
        means = train.select("text").coalesce(MAX_TRAINERS).mapInArrow(lambda it, flat=flat: descend(it, vocab, flat), "place long, value double, weight double")
        found = means.groupBy("place").agg((F.sum("value") / F.sum("weight")).alias("value")).toArrow()
        flat = flat.copy()
        flat[found.column("place").to_numpy()] = found.column("value").to_numpy()
    return Parameters.of(flat, len(vocab.unigram))


def score_texts(batches: Iterator[pa.RecordBatch], vocab: Vocabulary, tables: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
    """A line for each text (word null) and one for each of its words beyond the top (times in n_tokens)."""
    a1, a2, z = tables
    base_all = np.log10(np.concatenate((vocab.counts, [vocab.ends])) + 1.0) - np.log10(vocab.tokens + vocab.types + 1.0)
    inner = np.where(vocab.ids < 0, np.log10(vocab.counts + 1.0), 0.0)
    share = np.concatenate((np.zeros(1 + vocab.listed), np.log10(vocab.mass)))
    next_row = TaskContext.get().partitionId() << 40
    for batch in batches:
        for rows, data, ends in slices(batch, "text"):
            words = Words(data, ends)
            out, one, two, index = token_rows(words, vocab)
            text = np.repeat(np.arange(len(words.count)), words.count + 1)
            model = (a1[one, out].astype(np.float64) + a2[two, out] - z[one, two]) / np.log(10) - share[out]
            known = (index >= 0) & (index < len(vocab.hashes))
            end = index < 0
            model[known] += inner[index[known]]
            base = np.where(end, base_all[-1], 0.0)
            base[known] = base_all[index[known]]
            size = len(words.count)
            add = lambda x: np.bincount(text, weights=x, minlength=size)
            sure = add(known | (end & (vocab.ends > 0))).astype(np.int64)
            rare = np.flatnonzero(~known & ~end)
            word_of = np.cumsum(~end) - 1
            pair = np.stack([text[rare].astype(np.uint64), words.hash[word_of[rare]]], axis=1) if len(rare) else np.zeros((0, 2), np.uint64)
            order = np.lexsort((pair[:, 1], pair[:, 0]))
            pair = pair[order]
            new = np.ones(len(pair), bool)
            new[1:] = (pair[1:] != pair[:-1]).any(axis=1)
            first = np.flatnonzero(new)
            times = np.diff(first, append=len(pair))
            ids = next_row + np.arange(size)
            next_row += size
            none = lambda n, kind: pa.nulls(n, kind)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(ids), pa.array(ids[pair[first, 0].astype(np.int64)])]),
                    pa.concat_arrays([rows.column(0), none(len(first), pa.int64())]),
                    pa.concat_arrays([none(size, pa.int64()), pa.array(pair[first, 1].view(np.int64))]),
                    pa.array(np.concatenate((words.count + 1, times)).astype(np.int64)),
                    pa.array(np.concatenate((sure, np.zeros(len(first), np.int64)))),
                    pa.array(np.concatenate((add(base), np.zeros(len(first))))),
                    pa.array(np.concatenate((add(model), np.zeros(len(first))))),
                ],
                names=["row", "doc_id", "word", "n_tokens", "n_known", "base_score", "score"],
            )


def scored(docs: DataFrame, vocab: Vocabulary, words: DataFrame, model: Parameters) -> DataFrame:
    tables = docs.sparkSession.sparkContext.broadcast(model.tables())
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lambda it: score_texts(it, vocab, tables.value), "row long, doc_id long, word long, n_tokens long, n_known long, base_score double, score double"
    )
    lines = staged(lines, "lm-lines")
    rare = lines.where("word IS NOT NULL").select("row", "word", F.col("n_tokens").alias("times")).join(words.select("word", "c"), "word", "left")
    seen = F.log10(F.coalesce("c", F.lit(0)) + 1.0)
    sums = rare.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * (seen - F.lit(math.log10(vocab.tokens + vocab.types + 1)))).alias("more_base"),
        F.sum(F.col("times") * seen).alias("more_score"),
    )
    own = lines.where("word IS NULL").drop("word").join(sums, "row", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return own.select("doc_id", "n_tokens", plus("n_known", "more_known"), plus("base_score", "more_base"), plus("score", "more_score"))


def language_scores(docs: DataFrame, folds: int = 7, out: int = 2) -> DataFrame:
    """For each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (both log10).

    Documents with crc32(doc_id as text) mod folds = out are held out; null ids are trained on. Null texts are
    empty: one end mark. Equal rows get equal scores; a text of any length is scored whole; other columns of docs,
    whatever their names, take no part. Without training rows every probability is that of the untrained model over
    no tokens; an empty table gives no rows.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == out, F.lit(False))
    train = docs.where(~held).select("doc_id", "text")
    vocab, words = vocabulary(train)
    rows = scored(docs, vocab, words, fit(train, vocab))
    return rows.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(vocab.tokens).cast("long").alias("train_tokens"), "base_score", "score")

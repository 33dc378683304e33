"""Toxic spans by a linear-chain conditional random field over words, and document scores from its marginals.

A word's unary score is the sum of the weights of its hashed features (the word and its beginnings); the field adds a
weight for each pair of neighbouring tags. Document labels become token labels first: in a toxic document a word is
toxic if the word itself, or one of its beginnings, is far more frequent in the toxic documents of the training sample
than in the others. Training climbs the likelihood of these tags; forward-backward marginals then give each word's
probability of being toxic, words at 0.5 or more are the offending spans, and a logistic function of the marginals' sum
and maximum, fitted to the document labels, gives the document's score.

The model is trained on a bounded sample: ``SAMPLE`` labelled documents of each class at most, those whose ids have the
smallest hashes, with their whole texts, and of these no more than make ``SAMPLE_WORDS`` words. A sampled document counts
in the document score as often as its class was thinned, so that a score means the same whatever the number of labels.
Everything else sees all documents.
"""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.llm.ragged import RaggedCache, spread
from wayline.llm.shared import materialize, prepare, released

#: Training documents of each class (toxic, other).
SAMPLE = (1500, 3000)
#: Words of the sample from which on no more of its documents are read; the last one is read whole.
SAMPLE_WORDS = 20_000_000
BUCKETS = 1 << 17
#: Beginnings of a word, in characters, that are features besides the word.
BEGINNINGS = (4, 5, 6)
ROUNDS = 25
#: A feature marks a word as toxic above this log ratio of document frequencies, and only from so many toxic documents
#: on that as many documents drawn by chance would all be toxic with at most this probability.
LOG_RATIO, CHANCE = 3.0, 1e-5
#: A feature of fewer documents has no weight; the others' weights are held back by a ridge of this strength.
RARE, RIDGE = 5, 0.5
#: Every so many-th training document fits the document score instead of the field.
SCORE_EVERY = 4
_SIGNS = ".,!?;:\"'()[]{}«»…*%&$#@+-_=<>/\\|~^`"
_BLOCK = 512


def features(word: str) -> list[int]:
    """The hashed features of a word: lower-cased, without signs around it."""
    word = word.lower().strip(_SIGNS)
    return [xxhash.xxh3_64_intdigest(f"{k}:{word[:k]}") % BUCKETS for k in BEGINNINGS if len(word) >= k] + [xxhash.xxh3_64_intdigest(word) % BUCKETS]


def _features_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    made = list(map(features, words))
    sizes = np.fromiter(map(len, made), dtype=np.int64, count=len(made))
    return np.fromiter((f for m in made for f in m), dtype=np.int64, count=int(sizes.sum())), sizes


def tokens(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(index of each token's word, the distinct words, tokens of each text); a null text has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = pc.dictionary_encode(lists.flatten())
    distinct, index = words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    if "" in distinct:
        real = index != distinct.index("")
        index, of = index[real], of[real]
    return index, distinct, np.bincount(of, minlength=len(texts))


def _scan(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row vectors v[t] = v[t - 1] @ m[:, :, t] from (1, 1), each scaled to a sum of 1. All blocks of positions are
    multiplied through side by side, then entered with the vector that the blocks before them give."""
    n = m.shape[2]
    blocks = -(-n // _BLOCK)
    padded = np.zeros((2, 2, blocks * _BLOCK))
    padded[:, :, :n] = m
    padded[0, 0, n:] = padded[1, 1, n:] = 1
    step = np.ascontiguousarray(padded.reshape(2, 2, blocks, _BLOCK).transpose(3, 0, 1, 2))
    product = np.zeros((2, 2, blocks))
    product[0, 0] = product[1, 1] = 1
    for s in step:
        product = product[:, :1] * s[None, 0] + product[:, 1:] * s[None, 1]
        product /= product.sum(axis=(0, 1))
    v, entry = np.array([0.5, 0.5]), np.empty((2, blocks))
    for b in range(blocks):
        entry[:, b] = v
        v = v @ product[:, :, b]
        v /= v.sum()
    out = np.empty((_BLOCK, 2, blocks))
    v = entry
    for k, s in enumerate(step):
        v = v[0] * s[0] + v[1] * s[1]
        v = v / v.sum(axis=0)
        out[k] = v
    flat = out.transpose(1, 2, 0).reshape(2, -1)[:, :n]
    return flat[0], flat[1]


def forward_backward(unary: np.ndarray, counts: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the tag 1 for sequences one after the other, and the expected number of each pair of neighbouring
    tags. ``unary`` is the score of the tag 1, ``pair[i, j]`` that of tag j after i; a sequence begins with neither."""
    n = len(unary)
    if not n:
        return np.empty(0), np.zeros((2, 2))
    counts = counts[counts > 0]
    begin = np.cumsum(counts) - counts
    one = np.exp(np.clip(unary, -30, 30))
    e = np.exp(pair)
    m = np.stack([np.stack([np.full(n, e[i, 0]), e[i, 1] * one]) for i in range(2)])
    m[:, 0, begin], m[:, 1, begin] = 1, one[begin]
    f = np.stack(_scan(m))
    back = np.ones((2, 2, n))
    back[:, :, :-1] = m[:, :, 1:].transpose(1, 0, 2)
    back[:, :, begin[1:] - 1] = 1
    b = np.stack(_scan(back[:, :, ::-1]))[:, ::-1]
    joint = f * b
    both = f[:, None, :-1] * m[:, :, 1:] * b[None, :, 1:]
    both /= both.sum(axis=(0, 1))
    inside = np.ones(n - 1, dtype=bool)
    inside[begin[1:] - 1] = False
    return joint[1] / joint.sum(axis=0), both[:, :, inside].sum(axis=2)


def _marginals(unary: np.ndarray, counts: np.ndarray, pair: np.ndarray, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`forward_backward`, over groups of whole sequences, which bounds the memory of a pass."""
    end = np.cumsum(counts)
    out, pairs = [], np.zeros((2, 2))
    for own in np.split(np.arange(len(counts)), np.flatnonzero(np.diff(end // most)) + 1):
        if len(own):
            p, c = forward_backward(unary[end[own[0]] - counts[own[0]] : end[own[-1]]], counts[own], pair)
            out.append(p)
            pairs += c
    return np.concatenate(out) if out else np.empty(0), pairs


@dataclass
class Model:
    """The field's weights, and those of the document score; ``constant`` replaces the score where one class is absent."""

    weights: np.ndarray
    bias: float
    pair: np.ndarray
    document: np.ndarray
    constant: float | None = None


def document_inputs(marginals: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each document 1, the logarithm of 1 + the sum of its marginals, and the log odds of the largest of them."""
    end = np.cumsum(counts)
    total = np.concatenate([[0], np.cumsum(marginals)])
    out = np.zeros((len(counts), 3))
    out[:, 0] = 1
    out[:, 1] = np.log1p(np.maximum(total[end] - total[end - counts], 0))
    full = np.flatnonzero(counts)
    if len(full):
        out[full, 2] = np.maximum.reduceat(marginals, (end - counts)[full])
    largest = np.clip(out[:, 2], 1e-4, 1 - 1e-4)
    out[:, 2] = np.log(largest / (1 - largest))
    return out


class Corpus:
    """Tokenised documents: each distinct word once and the number of a word, in four bytes, for each token. Texts are
    tokenised as they come and not held."""

    def __init__(self, texts: pa.Array | None = None) -> None:
        self.words: dict[str, int] = {}
        self.n_tokens = 0
        self._index: list[np.ndarray] = []
        self._counts: list[np.ndarray] = []
        if texts is not None:
            self.add(texts)

    def add(self, texts: pa.Array) -> None:
        index, distinct, counts = tokens(texts)
        known = np.fromiter((self.words.setdefault(w, len(self.words)) for w in distinct), dtype=np.int32, count=len(distinct))
        self._index.append(known[index])
        self._counts.append(counts)
        self.n_tokens += len(index)

    def blocks(self, chosen: np.ndarray, most: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(documents, words of their tokens, tokens of each) of the chosen documents: as many whole documents at a time
        as have ``most`` tokens, or one."""
        first = 0
        for index, counts in zip(self._index, self._counts, strict=True):
            end = np.cumsum(counts)
            own = np.flatnonzero(chosen[first : first + len(counts)])
            for part in np.split(own, np.flatnonzero(np.diff(np.cumsum(counts[own]) // most)) + 1):
                if len(part):
                    yield first + part, index[spread(end[part] - counts[part], counts[part])], counts[part]
            first += len(counts)


def train(texts: list[str | None], labels: np.ndarray) -> Model:
    """The model of these documents and their labels, 0 or 1."""
    return trained(Corpus(pa.array(texts, pa.string())), labels, np.ones(len(labels)))


def trained(corpus: Corpus, labels: np.ndarray, weight: np.ndarray) -> Model:
    """The model of these documents, their labels, 0 or 1, and the number of labelled documents that each stands for."""
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS), 0.0, np.zeros((2, 2)), np.zeros(3), float(labels.mean()) if len(labels) else 0.0)
    # Of each class every fourth document is kept for the score, so that it sees the field on texts it wasn't fitted to.
    order = np.where(labels == 1, np.cumsum(labels), np.cumsum(1 - labels)) % SCORE_EVERY == 0
    if len({*labels[order]}) < 2:
        order = np.zeros(len(labels), dtype=bool)
    words = list(corpus.words)
    flat, sizes = _features_of(words)
    model = train_field(corpus, ~order, labels, flat.astype(np.int32), sizes)
    score = np.bincount(np.repeat(np.arange(len(words)), sizes), weights=model.weights[flat], minlength=len(words)) + model.bias
    held, x = order if order.any() else ~order, np.zeros((len(labels), 3))
    for documents, index, counts in corpus.blocks(held):
        x[documents] = document_inputs(forward_backward(score[index], counts, model.pair)[0], counts)
    model.document = logistic(x[held], labels[held], weight=weight[held] / weight[held].mean())
    return model


def train_field(corpus: Corpus, chosen: np.ndarray, labels: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> Model:
    """The field of the chosen documents, both of whose classes are there. ``flat`` are the features of the corpus's
    words, ``sizes[w]`` of them for the word w; no more than a block of documents is looked at at once."""
    n_words = len(sizes)
    word_of = np.repeat(np.arange(n_words, dtype=np.int32), sizes)
    starts = np.cumsum(sizes) - sizes
    # In how many documents of each class each feature is: distinct (document, feature) pairs by way of (document, word).
    negative, positive = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for documents, index, counts in corpus.blocks(chosen):
        seen = np.unique(np.repeat(np.arange(len(counts)), counts) * n_words + index)
        document, word = seen // n_words, seen % n_words
        pairs = np.unique(np.repeat(document, sizes[word]) * BUCKETS + flat[spread(starts[word], sizes[word])])
        of_class = labels[documents[pairs // BUCKETS]] == 1
        positive += np.bincount(pairs[of_class] % BUCKETS, minlength=BUCKETS)
        negative += np.bincount(pairs[~of_class] % BUCKETS, minlength=BUCKETS)
    n_toxic, n_other = (int((labels[chosen] == c).sum()) for c in (1, 0))
    ratio = np.log((positive + 0.5) / (n_toxic + 1)) - np.log((negative + 0.5) / (n_other + 1))
    marked = (ratio >= LOG_RATIO) & (positive >= np.log(CHANCE) / np.log(n_toxic / (n_toxic + n_other)))
    toxic_word = np.bincount(word_of, weights=marked[flat], minlength=n_words) > 0

    weights, bias, pair = np.zeros(BUCKETS), -3.0, np.zeros((2, 2))
    squares, bias_square, pair_square = np.full(BUCKETS, 1e-6), 1e-6, np.full((2, 2), 1e-6)
    known = positive + negative >= RARE
    for _ in range(ROUNDS):  # gradient ascent with a step size for each weight
        score = np.bincount(word_of, weights=weights[flat], minlength=n_words) + bias
        rest, wanted, pair_counts = np.zeros(n_words), np.zeros((2, 2)), np.zeros((2, 2))
        for documents, index, counts in corpus.blocks(chosen):
            tag = toxic_word[index] & np.repeat(labels[documents] == 1, counts)
            p, expected = forward_backward(score[index], counts, pair)
            rest += np.bincount(index, weights=tag - p, minlength=n_words)
            pair_counts += expected
            inside = np.ones(max(len(tag) - 1, 0), dtype=bool)
            edge = np.cumsum(counts)[:-1]
            inside[edge[(edge > 0) & (edge < len(tag))] - 1] = False
            wanted += np.bincount((tag[:-1] * 2 + tag[1:])[inside], minlength=4).reshape(2, 2)
        slope = np.bincount(flat, weights=rest[word_of], minlength=BUCKETS) - RIDGE * weights
        squares += slope**2
        weights += np.where(known, slope / np.sqrt(squares), 0)
        bias_slope = rest.sum()
        bias_square += bias_slope**2
        bias += 0.5 * bias_slope / bias_square**0.5
        pair_slope = wanted - pair_counts - 0.1 * pair
        pair_square = pair_square + pair_slope**2
        pair = pair + 0.3 * pair_slope / np.sqrt(pair_square)
    return Model(weights, bias, pair, np.zeros(3))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 50, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton steps of bounded length; a row counts ``weight`` times."""
    w, times = np.zeros(x.shape[1]), np.ones(len(y)) if weight is None else weight
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (times * (y - p)) - ridge * w
        step = np.linalg.solve((x * (times * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
        w += step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
    return w


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, limits: tuple[int, int], folds: int, held_fold: int) -> DataFrame:
    """(doc_id, text, label, weight) of at most ``limits`` labelled documents of the classes 1 and 0, none of them in the
    held-out fold. ``weight`` is the number of labelled documents of its class that a row stands for. Of several texts of
    one id the smallest is taken."""
    known = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
        .where(fold("doc_id", folds) != held_fold)
    )
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = materialize(known.join(text.select("doc_id").distinct(), "doc_id", "left_semi"), "known-labels")
    parts = [known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for c, n in ((1, limits[0]), (0, limits[1]))]
    limit = F.when(F.col("label") == 1, limits[0]).otherwise(limits[1])
    classes = known.groupBy("label").agg(F.count("*").alias("total"))  # two rows
    weight = (F.col("total") / F.least("total", limit)).alias("weight")
    chosen = parts[0].unionByName(parts[1]).join(F.broadcast(classes), "label").select("doc_id", "label", weight)
    # As many rows as the limits allow: small enough to broadcast.
    return text.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"), F.first("weight").alias("weight"))


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    corpus, labels, weights = Corpus(), [np.empty(0, np.int64)], [np.empty(0)]
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            if corpus.n_tokens < SAMPLE_WORDS:
                part = batch.slice(at, 200)
                corpus.add(part.column(1))
                labels.append(part.column(2).to_numpy(zero_copy_only=False).astype(np.int64))
                weights.append(part.column(3).to_numpy(zero_copy_only=False))
    model = trained(corpus, np.concatenate(labels), np.concatenate(weights))
    raw = io.BytesIO()
    np.savez(raw, weights=model.weights, bias=model.bias, pair=model.pair, document=model.document, constant=np.nan if model.constant is None else model.constant)
    yield pa.RecordBatch.from_arrays([pa.array([raw.getvalue()], pa.binary())], names=["model"])


def fitted(rows: DataFrame) -> Model:
    """The model of a sample, trained in one task of an executor; only its weights, whose number is fixed, are fetched."""
    ordered = rows.select("doc_id", "text", "label", "weight").repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    made = ordered.mapInArrow(released(_fit), "model binary").first()
    if made is None:
        return train([], np.empty(0, dtype=np.int64))
    with np.load(io.BytesIO(made["model"])) as m:
        constant = float(m["constant"])
        return Model(m["weights"], float(m["bias"]), m["pair"], m["document"], None if np.isnan(constant) else constant)


def fold(id_col: str, folds: int):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds))


class _Tagger:
    def __init__(self, model: Model) -> None:
        self.model, self._cache = model, RaggedCache(_features_of, 200_000)

    def unary(self, words: list[str]) -> np.ndarray:
        self._cache.begin()
        rows = self._cache.rows(words)
        of = np.repeat(np.arange(len(rows)), self._cache.sizes(rows))
        return np.bincount(of, weights=self.model.weights[self._cache.gather(rows)], minlength=len(rows)) + self.model.bias

    def score(self, texts: pa.Array) -> tuple[np.ndarray, list[list[dict[str, int]]]]:
        """Scores, and the offending spans as [begin, end) in characters."""
        spans: list[list[dict[str, int]]] = [[] for _ in range(len(texts))]
        if self.model.constant is not None:
            return np.full(len(texts), self.model.constant), spans
        index, words, counts = tokens(texts)
        p, _ = _marginals(self.unary(words)[index] if len(words) else np.empty(0), counts, self.model.pair)
        begin = np.cumsum(counts) - counts
        found = np.flatnonzero(p >= 0.5)
        document = np.searchsorted(np.cumsum(counts), found, "right")
        for d in np.unique(document).tolist():
            places = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", texts[d].as_py())]
            spans[d] = [{"begin": places[t][0], "end": places[t][1]} for t in (found[document == d] - begin[d]).tolist()]
        return 1 / (1 + np.exp(-np.clip(document_inputs(p, counts) @ self.model.document, -30, 30))), spans


def _apply(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _Tagger(model)
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                score, spans = tagger.score(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array(spans, kind), *part.columns[1:]], names=["doc_id", "score", "spans", *part.schema.names[1:]])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", limits: tuple[int, int] = SAMPLE, folds: int = 5, held_fold: int = 0, carry: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted, spans; with ``carry`` also a struct ``row``
    of all its columns, so that what is decided here needs no join to take effect.

    Labels come only from rows whose id's checksum modulo ``folds`` is not ``held_fold``; null and other labels than 0
    and 1 are ignored, and of several labels of one id the largest counts. A null text counts as empty; an empty text
    gets the score of a document without any toxic word. A null id gives held_out = false and a score as any other.
    Without training rows of both classes every score is the share of toxic ones (0 if there are none). An empty table
    gives an empty result; other columns are ignored.
    """
    prepare(docs.sparkSession)
    model = fitted(sample(docs, labels, id_col, text_col, label_col, limits, folds, held_fold))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.struct(*docs.columns).alias("row")] * carry)
    spans = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("spans", spans), *rows.schema.fields[1:]])
    scored = rows.mapInArrow(released(_apply(model)), schema)
    held = F.coalesce(fold("doc_id", folds) == held_fold, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans", *["row"] * carry)

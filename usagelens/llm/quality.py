"""Text quality by a small convolutional network over bytes, trained and applied in numpy."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from usagelens.llm.common import carried, utf8, with_text

WIDTH = 8  # bytes that a filter sees
EMBEDDING = 8
FILTERS = 24
HIDDEN = 16
CHUNK = 512  # first bytes of the windows of a chunk; its windows reach WIDTH - 1 bytes into the next one
SLICE = 1 << 17  # bytes convolved at a time
TRAIN_ROWS = 800  # labelled rows of each class that a network is fitted on
TRAIN_BYTES = 64 << 20  # bytes of all of them together; past that, fewer rows, each still whole
STEPS = 400  # batches that a network is fitted with
OUTPUTS = ("score",)


class Network:
    """Embedding, filters, one hidden layer. Parameters are a dict of arrays, so that they travel as plain data."""

    def __init__(self, weights):
        self.w = weights

    @classmethod
    def fresh(cls, seed: int):
        random = np.random.default_rng(seed)

        def normal(*shape, scale):
            return (random.standard_normal(shape) * scale).astype(np.float32)

        return cls({
            "bytes": normal(256, EMBEDDING, scale=0.5),
            "filters": normal(WIDTH * EMBEDDING, FILTERS, scale=(WIDTH * EMBEDDING) ** -0.5),
            "bias": np.zeros(FILTERS, np.float32),
            "hidden": normal(3 * FILTERS, HIDDEN, scale=(3 * FILTERS) ** -0.5),
            "hidden_bias": np.zeros(HIDDEN, np.float32),
            "out": normal(HIDDEN, scale=HIDDEN ** -0.5),
            "out_bias": np.zeros(1, np.float32),
        })

    def windows(self, data: np.ndarray) -> np.ndarray:
        """Embedded windows of padded bytes, one row for each first byte."""
        embedded = self.w["bytes"][data]
        view = np.lib.stride_tricks.sliding_window_view(embedded, WIDTH, axis=0)
        return np.ascontiguousarray(view.transpose(0, 2, 1)).reshape(len(data) - WIDTH + 1, WIDTH * EMBEDDING)

    def pooled(self, text: bytes, places: bool = False):
        """Largest response of each filter in each chunk of a text, all of it; with ``places`` also where."""
        data = np.frombuffer((text or b"\0") + b"\0" * (WIDTH - 1), np.uint8)
        length = len(data) - WIDTH + 1
        tops, where = [], []
        for begin in range(0, length, SLICE):
            end = min(length, begin + SLICE)
            response = self.windows(data[begin:end + WIDTH - 1]) @ self.w["filters"]
            starts = np.arange(0, end - begin, CHUNK)
            tops.append(np.maximum.reduceat(response, starts, axis=0))
            if places:
                where += [begin + s + response[s:s + CHUNK].argmax(0) for s in starts]
        top = np.tanh(np.concatenate(tops) + self.w["bias"])
        return (top, np.array(where), data) if places else top

    @staticmethod
    def combined(top: np.ndarray) -> np.ndarray:
        """Largest, mean and smallest response over the chunks of a text."""
        return np.concatenate([top.max(0), top.mean(0), top.min(0)])

    def head(self, features: np.ndarray):
        hidden = np.tanh(features @ self.w["hidden"] + self.w["hidden_bias"])
        return hidden, 1 / (1 + np.exp(-np.clip(hidden @ self.w["out"] + self.w["out_bias"], -30, 30)))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return self.head(np.stack([self.combined(self.pooled(text)) for text in texts]))[1].astype(np.float64)

    def gradients(self, texts, labels):
        """Gradients of the mean log loss; through each maximum only its own window counts."""
        seen = [self.pooled(text, places=True) for text in texts]
        features = np.stack([self.combined(top) for top, _, _ in seen])
        hidden, chance = self.head(features)
        slope = ((chance - labels) / len(labels)).astype(np.float32)
        grads = {"out": hidden.T @ slope, "out_bias": slope.sum(keepdims=True)}
        inner = slope[:, None] * self.w["out"] * (1 - hidden ** 2)
        grads |= {"hidden": features.T @ inner, "hidden_bias": inner.sum(0)}
        back = inner @ self.w["hidden"].T
        grads |= {name: np.zeros_like(self.w[name]) for name in ("bytes", "filters", "bias")}
        kernel = self.w["filters"].reshape(WIDTH, EMBEDDING, FILTERS)
        columns = np.arange(FILTERS)
        for (top, where, data), given in zip(seen, back):
            flow = np.repeat(given[None, FILTERS:2 * FILTERS] / len(top), len(top), 0)
            flow[top.argmax(0), columns] += given[:FILTERS]
            flow[top.argmin(0), columns] += given[2 * FILTERS:]
            flow *= 1 - top ** 2
            windows = data[where[:, :, None] + np.arange(WIDTH)]  # chunks x filters x width
            embedded = self.w["bytes"][windows]
            grads["filters"] += np.einsum("cf,cfwe->wef", flow, embedded).reshape(WIDTH * EMBEDDING, FILTERS)
            grads["bias"] += flow.sum(0)
            parts = (flow[:, :, None, None] * kernel.transpose(2, 0, 1)[None]).reshape(-1, EMBEDDING)
            for k in range(EMBEDDING):
                grads["bytes"][:, k] += np.bincount(windows.ravel(), parts[:, k], 256).astype(np.float32)
        return grads


def fit(texts: list[bytes], labels: list[int], seed: int = 5, steps: int = STEPS, batch: int = 32,
        rate: float = 0.01) -> Network:
    """Adam over shuffled batches. Without both classes the network stays as it began, but for its last bias."""
    network = Network.fresh(seed)
    labels = np.array(labels, np.float32)
    if len(set(labels.tolist())) < 2:
        network.w["out"][:] = 0
        network.w["out_bias"][:] = 0 if not len(labels) else 3 * (2 * labels[0] - 1)
        return network
    random = np.random.default_rng(seed)
    mean = {name: np.zeros_like(w) for name, w in network.w.items()}
    square = {name: np.zeros_like(w) for name, w in network.w.items()}
    order = np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        if len(order) < batch:
            order = np.concatenate([order, random.permutation(len(texts))])
        chosen, order = order[:batch], order[batch:]
        grads = network.gradients([texts[k] for k in chosen], labels[chosen])
        now = rate * (1 - 0.9 * step / steps)
        for name, grad in grads.items():
            mean[name] += 0.1 * (grad - mean[name])
            square[name] += 0.01 * (grad ** 2 - square[name])
            network.w[name] -= (now * (mean[name] / (1 - 0.9 ** step)) / (
                np.sqrt(square[name] / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
    return network


def fitting(sample: list[tuple], total: int) -> list[tuple]:
    """Those of (id, label, size), in their order, that fit into ``total`` bytes, half of them for each label.

    A row that does not fit any more is left out and later, smaller ones still count; where none of a label fits, its
    smallest one is taken, so that no label goes.
    """
    taken = []
    for label in (0, 1):
        rows, left, before = [row for row in sample if row[1] == label], total // 2, len(taken)
        for row in rows:
            if row[2] <= left:
                taken.append(row)
                left -= row[2]
        if rows and len(taken) == before:
            taken.append(min(rows, key=lambda row: row[2]))
    return taken


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES, seed: int = 5) -> Network:
    """Fit on at most ``rows`` labelled documents of each class, the first in the order of a hash of their ids.

    Only ids, lengths and labels are joined and ordered; the texts of the chosen ids are fetched after that and fitted on
    the driver, each of them whole. If together they had more than ``train_bytes`` bytes, fewer are chosen. Labels other
    than 0 and 1 and null ids are left out; of several labels of an id the largest counts, of several texts the smallest.
    """
    marks = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label")).filter(
        "label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    whole = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    sizes = docs.select(F.col(f"`{id_col}`").alias("id"), F.octet_length(whole).cast("long").alias("size"))
    known = sizes.groupBy("id").agg(F.max("size").alias("size")).join(marks, "id").withColumn("place", F.xxhash64("id"))
    chosen = None
    for label in (0, 1):
        part = known.filter(F.col("label") == label).orderBy("place", "id").limit(rows)
        chosen = part if chosen is None else chosen.union(part)
    sample = fitting([(row.id, row.label, row["size"]) for row in chosen.orderBy("place", "id").collect()], train_bytes)
    picked = docs.sparkSession.createDataFrame([row[:2] for row in sample], "id long, label int")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), whole.alias("text")).join(
        F.broadcast(picked), "id").groupBy("id", "label").agg(F.min("text").alias("text"))  # 2 * rows ids at most
    found = sorted(texts.collect(), key=lambda row: row.id)
    return fit([bytes(row.text) for row in found], [row.label for row in found], seed)


def _score_batches(shared, text_index, keep):
    def run(batches):
        network = Network(shared.value)
        for batch in batches:
            scores = network.scores(utf8(batch.column(text_index)))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [pa.array(scores, pa.float64())],
                                             [batch.schema.names[i] for i in keep] + ["score"])
    return run


def score(docs: DataFrame, network: Network, text_col: str = "text", keep=None) -> DataFrame:
    """``docs`` with score, the chance of label 1, from every byte of the text.

    Null and empty texts are scored alike, as one zero byte. Rows are independent; an input column called score gives
    way. A text is convolved in slices, so memory does not grow with its length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network.w)
    rest = carried(docs, OUTPUTS, keep)
    rows, text_index, kept = with_text(docs, rest, text_col)
    schema = T.StructType([*rest.schema.fields, T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_score_batches(shared, text_index, kept), schema)

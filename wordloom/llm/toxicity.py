"""Toxicity by weak supervision.

Voters are words (lexicon voters) and word beginnings (pattern voters) that toxic training documents
hold. A generative label model estimates by expectation-maximisation how often each voter fires in
either class and how voters depend on each other within a class: each voter hangs on at most one other, so
that the dependences make a forest. The given labels are one more voter, whose accuracy is estimated too.
A linear classifier is trained on the model's posterior labels and scores every text.

Bounds: voters are mined, the label model and the classifier fitted on at most ``train_rows`` labelled
documents (taken by a hash of the id, so evenly), with the ``max_voters`` best rated voters. Scoring reads
whole texts of all documents in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .store import Store

#: Bytes of a word that a pattern voter looks at; 0 stands for the whole word.
PREFIXES = (0, 4, 5, 6, 7)
#: Words of a token: letters, digits and all bytes beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Rows whose remainder is 0 are held out of all training.
HELD_OUT_MODULUS = 5


def held_out(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(HELD_OUT_MODULUS)) == 0


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of voter, the row and the hash of every word."""
    inside = _WORD[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < len(data)]
    begin[cut] = inside[cut]
    end[:-1] &= ~inside[1:] | begin[1:]
    start = np.flatnonzero(begin)
    length = np.flatnonzero(end) + 1 - start
    row = np.searchsorted(offsets, start, "right") - 1
    lowered = _LOWER[data]
    for k in PREFIXES:
        use = slice(None) if k == 0 else length > k
        yield row[use], K.span_hash(lowered, start[use], length[use] if k == 0 else np.full(int(use.sum()), k)) + np.uint64(k)


@dataclass
class Model:
    """Voters in order of their hash, the label model's estimates, and the classifier."""

    voters: np.ndarray
    fires: np.ndarray  # by class: how often each voter fires
    parent: np.ndarray  # the voter that each depends on, -1 for none
    weights: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        total = np.full(n, self.bias)
        if len(self.voters) and len(data):
            pairs = votes(data, offsets, self.voters)
            total += np.bincount(pairs // len(self.voters), weights=self.weights[pairs % len(self.voters)], minlength=n)
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def votes(data: np.ndarray, offsets: np.ndarray, voters: np.ndarray) -> np.ndarray:
    """Distinct ``row * len(voters) + voter`` of the voters that fire."""
    found = []
    for row, h in features(data, offsets):
        at = np.minimum(np.searchsorted(voters, h), len(voters) - 1)
        hit = np.flatnonzero(voters[at] == h)
        found.append(row[hit] * len(voters) + at[hit])
    return np.unique(np.concatenate(found))


def dependences(x: np.ndarray, weight: np.ndarray, fires: np.ndarray, least: float = 0.03) -> np.ndarray:
    """Each voter's parent in the forest of largest mutual information within the classes; -1 for none.

    A pair is linked if its information is ``least`` of what the less certain of the two could share.
    """
    total = weight.sum(axis=1)
    info, room = np.zeros((x.shape[1],) * 2), np.zeros(x.shape[1])
    for c in (0, 1):
        f = fires[c]
        both = ((x * weight[c][:, None]).T @ x + 0.02 * np.outer(f, f)) / (total[c] + 0.02)
        share = total[c] / total.sum()
        room -= share * (f * np.log(f) + (1 - f) * np.log(1 - f))
        for a in (0, 1):
            for b in (0, 1):
                joint = np.maximum({(1, 1): both, (1, 0): f[:, None] - both, (0, 1): f[None, :] - both, (0, 0): 1 - f[:, None] - f[None, :] + both}[a, b], 1e-12)
                info += share * joint * np.log(joint / np.outer(f if a else 1 - f, f if b else 1 - f))
    info[np.minimum.outer(room, room) * least > info] = 0
    parent, best, source = np.full(len(room), -1), np.zeros(len(room)), np.full(len(room), -1)
    out = np.ones(len(room), bool)
    for _ in range(len(room)):  # the strongest link from the forest so far, or a new root
        i = int(np.argmax(np.where(out, best, -1)))
        out[i], parent[i] = False, source[i]
        better = out & (info[i] > best)
        best[better], source[better] = info[i][better], i
    return parent


def label_model(fired: np.ndarray, gold: np.ndarray, times: np.ndarray | None = None, trust: float = 0.98, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior labels, firing rates by class, and each voter's parent, from ballots and how often each comes."""
    x = fired.astype(np.float32)
    times = np.ones(len(x)) if times is None else times.astype(np.float64)
    accuracy = np.array([trust, trust])  # of the given labels, by class
    p = np.where(gold == 1, trust, 1 - trust)
    parent = np.full(x.shape[1], -1)
    for step in range(rounds):
        weight = np.stack((1 - p, p)) * times
        total = weight.sum(axis=1, keepdims=True)
        fires = (weight @ x + 0.02) / (total + 1)
        if step:
            right = np.array([weight[0][gold == 0].sum(), weight[1][gold == 1].sum()])
            accuracy = np.clip((right + 10 * trust) / (total[:, 0] + 10), 0.6, 0.995)
        if step in (1, rounds // 2):
            parent = dependences(x, weight, fires)
        root, child = np.flatnonzero(parent < 0), np.flatnonzero(parent >= 0)
        on, off = np.log(fires[1] / fires[0]), np.log((1 - fires[1]) / (1 - fires[0]))
        logit = np.log(total[1, 0] / total[0, 0]) + np.where(gold == 1, np.log(accuracy[1] / (1 - accuracy[0])), np.log((1 - accuracy[1]) / accuracy[0]))
        logit += x[:, root] @ on[root] + (1 - x[:, root]) @ off[root]
        if len(child):
            own, above = x[:, child], x[:, parent[child]]
            both, up = weight @ (own * above), weight @ above
            base = fires[:, child]
            if_on, if_off = (both + 2 * base) / (up + 2), (weight @ own - both + 2 * base) / (total - up + 2)
            if_on, if_off = np.clip(if_on, 1e-6, 1 - 1e-6), np.clip(if_off, 1e-6, 1 - 1e-6)
            for rate, where in ((if_on, above), (if_off, 1 - above)):
                logit += (where * own) @ np.log(rate[1] / rate[0]) + (where * (1 - own)) @ np.log((1 - rate[1]) / (1 - rate[0]))
        p = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
    return p, fires, parent


def linear_classifier(fired: np.ndarray, target: np.ndarray, times: np.ndarray, ridge: float = 0.02, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels of ballots that come ``times`` by Newton steps."""
    x = np.column_stack((fired.astype(np.float64), np.ones(len(fired))))
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (times * (p - target)) + penalty * w
        hess = (x * (times * (p * (1 - p) + 1e-9))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 4 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", train_rows: int = 30_000, max_voters: int = 400, min_share: float = 0.004) -> Model:
    """Fits the model on labelled rows that are not held out.

    A voter must fire in ``min_share`` of the toxic training documents (at least 3) and at least
    nine times as often in them as in clean ones. Labels other than 0 and 1 and rows without an id
    are ignored; without rows of both classes there are no voters and every score is the share of 1s.
    """
    store = Store(docs.sparkSession, "toxicity")
    marked = labels.select(F.col(id_col).alias("doc"), F.col(label_col).cast("int").alias("label")).where("doc IS NOT NULL AND label IN (0, 1)").where(~held_out("doc"))
    marked = marked.groupBy("doc").agg(F.max("label").alias("label"))
    share = min(1.0, train_rows / max(1, marked.count()))
    taken = marked.where(F.pmod(F.xxhash64("doc"), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    # train_rows bounds the ids taken: a few bytes each
    train = store.put(texts.join(taken.hint("broadcast" if train_rows <= 1_000_000 else "merge"), "doc").select("text", "label"), "train")
    number = dict(train.groupBy("label").count().collect())
    clean, toxic = number.get(0, 0), number.get(1, 0)
    if not clean or not toxic:
        odds = (toxic + 0.5) / (clean + 0.5) if toxic or clean else 1e-3
        return Model(np.zeros(0, np.uint64), np.zeros((2, 0)), np.zeros(0, int), np.zeros(0), float(np.log(odds)))
    least = max(3, int(min_share * toxic))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(0))
            label = batch.column(1).to_numpy()
            for lo, hi in K.slices(offsets, 4 << 20):
                d, o = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                if not len(d):
                    continue
                mark, found = label[lo:hi].astype(bool), []
                for row, h in features(d, o):
                    order = np.lexsort((row, h))
                    row, h = row[order], h[order]
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                    row, h = row[new], h[new]
                    value, at = np.unique(h, return_inverse=True)
                    ones = np.bincount(at, weights=mark[row], minlength=len(value)).astype(np.int64)
                    found.append((value, ones, np.bincount(at, minlength=len(value)) - ones))
                h, ones, zeros = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ones), pa.array(zeros)], names=["h", "ones", "zeros"])

    # all candidates are rated; only the voters taken reach the driver
    rates = train.mapInArrow(counted, "h long, ones long, zeros long").groupBy("h").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros")).where(F.col("ones") >= least)
    ratio = (F.col("ones") / toxic) / ((F.col("zeros") + 0.5) / clean)
    rated = rates.withColumn("ratio", ratio).where("ratio >= 9").orderBy(F.desc(F.col("ones") * F.col("ratio") / (F.col("ratio") + 9)), "h").limit(max_voters)
    voters = np.sort(rated.toPandas().h.to_numpy().astype(np.int64).view(np.uint64))
    if not len(voters):
        return Model(voters, np.zeros((2, 0)), np.zeros(0, int), np.zeros(0), float(np.log(toxic / clean)))

    def ballots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(0))
            fired = np.zeros((batch.num_rows, len(voters)), bool)
            for lo, hi in K.slices(offsets, 4 << 20):
                if offsets[hi] > offsets[lo]:
                    fired[lo:hi].reshape(-1)[votes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], voters)] = True
            packed = np.packbits(fired, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in packed], pa.binary()), batch.column(1)], names=["fired", "label"])

    # equal ballots are counted, not repeated; there are at most train_rows
    rows = train.mapInArrow(ballots, "fired binary, label int").groupBy("fired", "label").count().orderBy("fired", "label").toPandas()
    store.drop()
    times, gold = rows["count"].to_numpy(), rows.label.to_numpy()
    fired = np.unpackbits(np.frombuffer(b"".join(map(bytes, rows.fired)), np.uint8).reshape(len(rows), -1), axis=1, count=len(voters)).astype(bool)
    posterior, fires, parent = label_model(fired, gold, times)
    weights, bias = linear_classifier(fired, posterior, times)
    return Model(voters, fires, parent, weights, bias)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "toxic_score") -> DataFrame:
    """All columns of ``docs`` and the score, 0 to 1. Null and empty texts get the score of no vote.

    A column of the name ``score_col`` is replaced.
    """
    others = [c for c in docs.columns if c != score_col]
    rows = docs.select(F.struct(*(F.col(c) for c in others)).alias("row"))
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(0).field(text_col))
            for lo, hi in K.slices(offsets, 4 << 20):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(model.score(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))], names=["row", "score"])

    return rows.mapInArrow(run, f"row {kind}, score double").select(*(F.col("row").getField(c).alias(c) for c in others), F.col("score").alias(score_col))


def score_ids(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score`` only: the text is read once and not returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(1))
            for lo, hi in K.slices(offsets, 4 << 20):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(model.score(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))], names=["key", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", id_col)

"""Quality classifier by compression: a text costs less under the dictionary of the class it resembles.

Two zstandard dictionaries are built from a bounded sample of labelled texts, one
per class. The difference of a text's two compressed sizes, over its size, is
turned into a probability by a logistic curve fitted on labelled texts that the
dictionaries haven't seen; as a longer text's difference says more, the curve's slope may grow with the text's length. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm.common import steps

#: Labelled texts of each class that are used at most, bytes of them, and bytes of one (a longer one teaches nothing, but is scored); the same at every input size.
SAMPLE_TEXTS, SAMPLE_BYTES, LONGEST = 3000, 24_000_000, 3_000_000
#: Size of a dictionary; level of compression.
DICTIONARY, LEVEL = 112_640, 3
#: A text is compressed in blocks of so many bytes, all of them: further on, a compressor leans on the text before instead of its dictionary.
BLOCK = 1024
#: Every so many-th sampled text fits the curve instead of a dictionary; texts of a step of the counted shares at least; the curve's part in a score beside them.
CURVE_EVERY, STEP, SMOOTH = 3, 25, 0.05


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slopes: tuple[float, float]  # of the difference, and of the difference times the length's logarithm
    offset: float
    steps: tuple[tuple[float, float], ...] = ()  # the curve's value and the share of class 1 there, rising

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        import zstandard

        pack = lambda d: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT if not d.startswith(b"\x37\xa4\x30\xec") else zstandard.DICT_TYPE_FULLDICT), write_content_size=False, write_checksum=False, write_dict_id=False)
        self.model, self.good, self.bad = model, pack(model.good), pack(model.bad)

    def difference(self, text: bytes) -> float:
        """How many bytes a byte the bad class's dictionary saves over the good one's; 0 for no text."""
        if not text:
            return 0.0
        blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
        return sum(len(self.good.compress(b)) - len(self.bad.compress(b)) for b in blocks) / len(text)

    def curve(self, text: bytes) -> float:
        """The logistic curve's value before it is squeezed."""
        return self.model.offset + float(np.dot(self.model.slopes, measures(self.difference(text), len(text))))

    def score(self, text: bytes) -> float:
        """Probability that the label is 1."""
        z = self.curve(text)
        smooth = float(1 / (1 + np.exp(-np.clip(z, -40, 40))))
        if not self.model.steps:
            return smooth
        # what was counted, and enough of the curve that no two different values tie
        return (1 - SMOOTH) * float(np.interp(z, *zip(*self.model.steps))) + SMOOTH * smooth


def dictionary(texts: Sequence[bytes], size: int = DICTIONARY) -> bytes:
    """A trained dictionary; of too little text for training, the text itself."""
    import zstandard

    pieces = [t[i : i + 4096] for t in texts for i in range(0, len(t), 4096)]
    try:
        return zstandard.train_dictionary(size, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-size:]


def measures(difference: float, size: int) -> tuple[float, float]:
    """What the curve is fitted on."""
    return difference, difference * float(np.log1p(size / BLOCK))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Slopes and offset of P(y = 1) by Newton's method with a small ridge; targets drawn in a little, as in Platt's scaling."""
    up, down = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    z = np.concatenate([x / scale, np.ones((len(x), 1))], axis=1)
    w = np.zeros(z.shape[1])
    ridge = 1e-3 * np.eye(len(w))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (t - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / scale, float(w[-1])


def rising(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[tuple[float, float], ...]:
    """Shares of class 1 along z that never fall: runs of STEP texts, neighbours pooled until they rise."""
    order = np.argsort(z, kind="stable")
    cuts = range(0, len(z), STEP)
    pools = [[(z[at] * weight[at]).sum(), (y[at] * weight[at]).sum(), weight[at].sum()] for at in (order[c : c + STEP] for c in cuts)]
    kept: list[list[float]] = []
    for pool in pools:
        kept.append(pool)
        while len(kept) > 1 and kept[-2][1] / kept[-2][2] >= kept[-1][1] / kept[-1][2]:
            last = kept.pop()
            kept[-1] = [a + b for a, b in zip(kept[-1], last)]
    return tuple((a / w, b / w) for a, b, w in kept)


def fit(good: Sequence[bytes], bad: Sequence[bytes], share: float | None = None) -> Model:
    """A model of two lists of texts; share is class 1's of all labels, as the lists are drawn from each class alike.

    With nothing of one class to learn from, every score is that share.
    """
    hold = lambda texts: ([t for i, t in enumerate(texts) if i % CURVE_EVERY], [t for i, t in enumerate(texts) if not i % CURVE_EVERY])
    (good_d, good_c), (bad_d, bad_c) = hold(good), hold(bad)
    if share is None:
        share = (len(good) + 1) / (len(good) + len(bad) + 2)
    flat = Model(b"", b"", (0.0, 0.0), float(np.log(share / (1 - share))))
    if not good_d or not bad_d:
        return flat
    model = Model(dictionary(good_d), dictionary(bad_d), (0.0, 0.0), flat.offset)
    scorer = model.scorer()
    x = np.array([measures(scorer.difference(t), len(t)) for t in [*good_c, *bad_c]])
    y = np.array([1] * len(good_c) + [0] * len(bad_c))
    slopes, offset = logistic(x, y)
    offset += flat.offset - float(np.log(len(good_c) / len(bad_c)))
    weight = np.where(y == 1, share / len(good_c), (1 - share) / len(bad_c))
    return Model(model.good, model.bad, tuple(slopes.tolist()), offset, rising(offset + x @ slopes, y, weight))


def sample(docs: DataFrame, labels: DataFrame, texts: int = SAMPLE_TEXTS, most_bytes: int = SAMPLE_BYTES) -> tuple[list[bytes], list[bytes], float]:
    """Good and bad labelled texts for fitting: of each class those whose id and text hash lowest, whole, within the bounds.

    The third value is class 1's share of all usable labels. Rows held out, without label or id are never used; a document labelled both ways isn't either.
    """
    usable = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other and quality in (0, 1)")
    size = F.octet_length("text")
    out: list[list[bytes]] = []
    for quality in (1, 0):
        # twice as many ids as texts, as some labelled ids have no document; bounded by the parameter, so broadcast
        ids = usable.where(F.col("quality") == quality).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * texts)
        found = docs.select("doc_id", "text").where(F.col("text") != "").where(size <= LONGEST).join(F.broadcast(ids), "doc_id")
        kept = found.dropDuplicates(["text"]).orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(texts).select("text")
        own, total = [], 0
        for row in kept.toLocalIterator():
            raw = row.text.encode()
            if total + len(raw) > most_bytes:
                break
            own.append(raw)
            total += len(raw)
        out.append(own)
    counts = {r.quality: r.n for r in usable.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    return out[0], out[1], (counts.get(1, 0) + 1) / (counts.get(0, 0) + counts.get(1, 0) + 2)


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in steps(batches):
            scores = np.array([scorer.score(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def quality_classifier(docs: DataFrame, labels: DataFrame, *, model: Model | None = None) -> DataFrame:
    """Scores every whole text: the probability that `labels.quality` would be 1.

    Takes `doc_id` and `text` of docs, `doc_id` and `quality` of labels; other columns are ignored and are no input of a score.
    Returns doc_id, held_out, score (0 to 1), predicted (1 from 0.5).
    Defined for odd inputs: a null or empty text scores as a difference of 0; repeated rows score alike; a null doc_id
    isn't held out and learns nothing. Without usable labels of both classes the score is a constant. An empty table gives an empty one.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    labels = labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
    if model is None:
        model = fit(*sample(docs, labels))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")

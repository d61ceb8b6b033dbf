"""Quality classifier by compression.

Two zstandard dictionaries are built from good and from bad labelled text. A text is
compressed with each, block by block; the difference of the compressed sizes, normalised
by length, is turned into a probability by a logistic fit on labelled rows that did not
go into the dictionaries.

Bounds of the fit, all parameters: ``sample_rows`` labelled rows per class give the
dictionaries at most ``sample_blocks`` blocks of ``block`` bytes, and ``calibration_rows``
rows set the logistic weights. Scoring reads every text whole.

Nulls: a null text counts as empty; labels with a null id or a quality other than 0 and 1
are ignored; repeated labels count as often as they stand there. Without labels the score
is 0.5 for every row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.llm.common import Scratch, map_columns, text_or_empty

LEVEL = 3
BLOCK = 2048
N_FEATURES = 8


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float


def held_out(doc_id) -> F.Column:
    """Rows never used for learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if not dictionary:
        return zstandard.ZstdCompressor(**plain)
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=data, **plain)


def _features(good, bad, plain, text: str) -> list[float]:
    """Sizes under the good, the bad and no dictionary as ratios to the length, and their differences."""
    data = text.encode()
    size = len(data) + 1
    with_good = with_bad = without = 1
    for at in range(0, len(data), BLOCK):
        piece = data[at:at + BLOCK]
        with_good += len(good.compress(piece))
        with_bad += len(bad.compress(piece))
        without += len(plain.compress(piece))
    gap = with_good - with_bad
    ratio = without / size
    return [
        gap / size, gap / max(with_good, with_bad), np.log(with_good / size), np.log(with_bad / size), np.log(ratio),
        ratio, np.log(size), (with_good - without) / size,
    ]


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the raw samples where there are too few to train on."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Newton steps for a logistic fit with a small ridge on the weights."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _expand(z: np.ndarray, low, high) -> np.ndarray:
    """Standardised features and their squares, held within the range that was calibrated.

    A text that is part of a dictionary compresses better than any calibrated one; it counts as the range's end.
    """
    z = np.clip(z, low, high)
    return np.hstack([z, z * z])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 1500, sample_blocks: int = 3000,
        calibration_rows: int = 6000, dictionary_size: int = 112_640) -> QualityModel:
    """Learn from the labelled rows that are not held out."""
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.select("doc_id", F.col("quality").alias("good_"), F.xxhash64("doc_id", F.lit(7)).alias("draw_"))
    half = F.pmod(F.col("draw_"), F.lit(2))
    chosen = [
        usable.filter((half == 0) & (F.col("good_") == kind)).orderBy("draw_").limit(sample_rows)
        .withColumn("role_", F.lit(kind)) for kind in (0, 1)
    ] + [usable.filter(half == 1).orderBy("draw_").limit(calibration_rows).withColumn("role_", F.lit(2))]
    ids = chosen[0].unionByName(chosen[1]).unionByName(chosen[2])
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    # At most 2 * sample_rows + calibration_rows ids: a bounded broadcast, so no text is shuffled.
    scratch = Scratch(docs.sparkSession, "quality")
    sampled = scratch.store(texts.join(F.broadcast(ids), "doc_id").select("text", "good_", "role_"), "sampled")

    def cut():
        def work(c):
            out = {"role_": [], "piece": []}
            for text, role in zip(c["text"], c["role_"]):
                data = text.encode()
                for at in range(0, len(data), BLOCK):
                    out["role_"].append(role)
                    out["piece"].append(data[at:at + BLOCK])
            return out
        return work

    blocks = map_columns(sampled.filter("role_ < 2").select("text", "role_"), cut, "role_ int, piece binary")
    drawn = F.xxhash64("piece", F.lit(11))
    pieces: list[list[bytes]] = []
    for kind in (0, 1):
        rows = blocks.filter(F.col("role_") == kind).orderBy(drawn).limit(sample_blocks).collect()
        pieces.append([bytes(r["piece"]) for r in rows])
    good, bad = _dictionary(pieces[1], dictionary_size), _dictionary(pieces[0], dictionary_size)
    rows = _measure(sampled.filter("role_ = 2"), good, bad, ["good_"]).collect()
    scratch.drop("sampled")
    if not rows:
        none, one = (0.0,) * N_FEATURES, (1.0,) * N_FEATURES
        return QualityModel(good, bad, none, one, none, none, none * 2, 0.0)
    x = np.array([r["f_"] for r in rows])
    y = np.array([float(r["good_"]) for r in rows])
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = (x - centre) / scale
    low, high = z.min(axis=0), z.max(axis=0)
    weights, bias = _logistic(_expand(z, low, high), y)
    return QualityModel(good, bad, *map(tuple, (centre, scale, low, high, weights)), bias)


def _measure(df: DataFrame, good: bytes, bad: bytes, keep: list[str]) -> DataFrame:
    def start():
        tools = _compressor(good), _compressor(bad), _compressor(b"")

        def work(c):
            return {k: c[k] for k in keep} | {"f_": [_features(*tools, t) for t in c["text"]]}
        return work

    kinds = dict(df.dtypes)
    ddl = ", ".join([*(f"{k} {kinds[k]}" for k in keep), "f_ array<double>"])
    return map_columns(df.select(*keep, "text"), start, ddl)


def _judge(model: QualityModel):
    """Scores of a list of texts."""
    tools = _compressor(model.good), _compressor(model.bad), _compressor(b"")
    centre, scale, low, high, weights = map(np.array, (model.centre, model.scale, model.low, model.high, model.weights))

    def judge(texts: list[str | None]) -> np.ndarray:
        x = np.array([_features(*tools, t or "") for t in texts])
        return 1 / (1 + np.exp(-np.clip(_expand((x - centre) / scale, low, high) @ weights + model.bias, -30, 30)))
    return judge


def score(df: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """All columns of ``df`` plus score (0 to 1) and predicted (1 where the score reaches the threshold)."""
    kept = [n for n in df.columns if n not in ("score", "predicted")]
    plain = df.select(*kept)

    def start():
        judge = _judge(model)

        def work(c):
            s = judge(c["text"])
            return c | {"score": s.tolist(), "predicted": [int(v >= threshold) for v in s]}
        return work

    ddl = ", ".join([*(f"`{n}` {kind}" for n, kind in plain.dtypes), "score double, predicted int"])
    return map_columns(plain, start, ddl)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their own columns."""
    model = fit(docs, labels)

    def start():
        judge = _judge(model)

        def work(c):
            kept = [i for i, v in enumerate(judge(c["text"])) if v >= threshold]
            return {n: [values[i] for i in kept] for n, values in c.items()}
        return work

    return map_columns(docs, start, ", ".join(f"`{n}` {kind}" for n, kind in docs.dtypes))

"""Toxicity by compression distance: one zstandard dictionary trained on toxic text, one on ordinary text.

A text is read as its overlapping runs of three characters (lower case), each written as an 8-byte
code, so that a stretch of text known to a dictionary becomes one short match and unknown text stays
incompressible, in any script. Windows of neighbouring codes are compressed with either dictionary;
a window that the toxic dictionary shortens by ``noise_bytes`` or more beyond the ordinary one leans
toxic. The sums of these differences at three thresholds, the largest one and the number of windows go
through a logistic curve fitted on training rows that the dictionaries were not trained on.

Training, all by compression:

1. The ordinary dictionary is trained on windows of one half of the ordinary texts.
2. Toxic texts are dealt into two halves; each half's passages that the ordinary dictionary shortens
   least make a first dictionary (some as they are, and what training finds in all of them).
3. Rounds: passages of a toxic half that lean under the *other* half's dictionary recur across texts:
   they train the next dictionaries. Ordinary passages that lean toxic train an addition to the
   ordinary dictionary. Rounds end when hardly any ordinary passage leans and no more toxic ones do.
4. The toxic dictionary is made of the passages of both halves that still lean, each taken unless what
   was taken before shortens it already, in front of the ordinary dictionary's content, so that text
   known to both costs the same.

Training reads labelled rows only, at most ``fit_rows`` a class (those with the smallest MD5 of their
id), and takes at most ``samples`` passages a step (those with the smallest hash); equal texts count
once. The fitted curve is shifted from the sample's class balance to that of all training labels.
Scoring reads every whole text.

Rules: null and empty texts score like a text without windows; a null or absent label is no
training row; without training rows of both classes the score is 0 everywhere; repeated rows agree;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, landed
from .words import U, mix

GRAM = 3
CHUNK = 1 << 18


@dataclass(frozen=True)
class Params:
    fit_rows: int = 5_000
    window: int = 64
    passage: int = 12
    noise_bytes: int = 10
    step_bytes: int = 8
    samples: int = 20_000
    ordinary_bytes: int = 1 << 19
    addition_bytes: int = 1 << 17
    toxic_bytes: int = 1 << 15
    rounds: int = 10
    least_share: float = 0.001


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]
    params: Params = Params()


def windows(text: str, width: int) -> Iterator[bytes]:
    """Codes of the text's three-character runs (spaces around it), ``width`` at a time."""
    text = text.lower()
    n = len(text) + 1 if text else 0  # one run ends at every character and at the space behind the last
    step = CHUNK // width * width
    for a in range(0, n, step):
        part = text[max(0, a - GRAM + 1):a + step]
        part = " " * max(0, GRAM - 1 - a) + part + (" " if a + step >= n else "")
        c = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        m = len(c) - GRAM + 1
        h = np.zeros(m, np.uint64)
        for i in range(GRAM):
            h = mix(h * U(31) + c[i:m + i] + U(i + 1))
        raw = h.tobytes()
        for i in range(0, len(raw), 8 * width):
            yield raw[i:i + 8 * width]


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    """Chains of candidates, so that what a long dictionary holds is found."""
    p = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_GREEDY, hash_log=20, chain_log=20, search_log=4, min_match=6,
                                            window_log=22, write_content_size=False, write_checksum=False, write_dict_id=False)
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
    return zstandard.ZstdCompressor(dict_data=data, compression_params=p)


def train(passages: list[bytes], size: int) -> bytes:
    """Dictionary content: what recurs in the passages, the most frequent last; few passages as they are."""
    if not passages:
        return b""
    limit = max(1024, min(size, sum(map(len, passages)) // 4))
    try:
        return zstandard.train_dictionary(limit, passages, k=48, d=8, f=20, accel=1).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(passages))[:size]


def covering(passages: list[bytes], size: int, noise: int) -> bytes:
    """Dictionary content that shortens the passages by ``noise`` bytes or more, as far as ``size`` goes: a passage that
    what was taken before does not shorten is taken. What recurs is taken about once."""
    taken: list[bytes] = []
    fresh = used = 0
    plain = known = compressor(b"")
    for w in passages:
        if used + len(w) > size:
            break
        if len(plain.compress(w)) - len(known.compress(w)) < noise:
            taken.append(w)
            used += len(w)
            fresh += 1
            if fresh * 8 >= len(taken):
                known, fresh = compressor(b"".join(taken)), 0
    return b"".join(taken)


#: What is measured of a text: sums of the differences from each threshold on, the largest difference, windows.
FEATURES = ("total", "more", "most", "top", "n_windows")


def features(text: str, toxic, ordinary, p: Params) -> tuple[int, ...]:
    a, b, c = (p.noise_bytes + k * p.step_bytes for k in range(3))
    total = more = most = top = n = 0
    for w in windows(text, p.window):
        d = len(ordinary.compress(w)) - len(toxic.compress(w))
        n += 1
        if d >= a:
            total += d
            if d >= b:
                more += d
            if d >= c:
                most += d
        if d > top:
            top = d
    return total, more, most, top, n


def _design(columns, p: Params) -> np.ndarray:
    total, more, most, top, n = (np.asarray(x, float) for x in columns)
    return np.stack([np.ones(len(n)), np.log1p(n), *(np.minimum(x, 96) / 32 for x in (total, more, most)),
                     np.clip(top - p.noise_bytes, 0, 48) / 16], axis=1)


def scores(model: Model, columns) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_design(columns, model.params) @ np.array(model.weights), -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(x.shape[1]), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


# ---------------------------------------------------------------- training

#: Parts of the training rows: ordinary texts for dictionaries and for the curve, the halves of the toxic ones.
ORDINARY, CURVE, FIRST, SECOND = range(4)


def training_rows(docs: DataFrame, known: DataFrame, p: Params) -> tuple[DataFrame, dict[int, int]] | None:
    """(doc_id, text, part) of the chosen labelled texts, and how many labels each class has."""
    order = F.md5(F.col("doc_id").cast("string"))
    known = landed(known.filter("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct(), "toxicity-labels")
    total = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(total) < 2:
        return None
    one = [known.filter(F.col("toxic") == c).orderBy(order, "doc_id").limit(p.fit_rows) for c in (0, 1)]
    chosen = landed(one[0].unionByName(one[1]), "toxicity-ids")  # at most 2 * fit_rows rows, so broadcast is safe
    rows = landed(docs.select("doc_id", "text").filter("text is not null and text != ''").join(F.broadcast(chosen), "doc_id")
                  .withColumn("t", F.xxhash64("text")), "toxicity-texts")
    firsts = landed(rows.groupBy("t").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")), "toxicity-firsts")
    # Equal texts go one way, by their hash; so do the halves.
    part = 2 * F.col("toxic") + F.pmod(F.xxhash64("t", F.lit(1)), F.lit(2))
    picked = landed(rows.drop("toxic").join(F.broadcast(firsts), ["t", "doc_id"]).select("doc_id", "text", part.cast("int").alias("part"))
                    .dropDuplicates(["doc_id", "text"]), "toxicity-rows")
    return picked, total


def passages(rows: DataFrame, width: int, ordinary: bytes = b"", toxic: dict[int, bytes] | None = None, least: int = 0) -> DataFrame:
    """(part, raw, cost, lean) of the passages of ``rows`` that lean by ``least`` or more: a passage's compressed share under the
    ordinary dictionary, and the bytes that its part's toxic dictionary saves beyond it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = compressor(ordinary)
        other = {k: compressor(d + ordinary) for k, d in (toxic or {}).items()}
        for b in batches:
            out: list[list] = [[], [], [], []]
            for text, part in zip(column(b, "text"), column(b, "part").to_pylist()):
                for w in windows(text.as_py(), width):
                    base = len(plain.compress(w))
                    lean = base - len(other[part].compress(w)) if part in other else 0
                    if lean >= least:
                        for col, x in zip(out, (part, w, base / len(w), lean)):
                            col.append(x)
                if len(out[0]) > 20_000:
                    yield _passage_batch(out)
                    out = [[], [], [], []]
            yield _passage_batch(out)

    return rows.select("text", "part").mapInArrow(run, "part int, raw binary, cost double, lean long")


def _passage_batch(out: list[list]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.binary(), pa.float64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["part", "raw", "cost", "lean"])


def _taken(rows: DataFrame, limit: int, *order) -> list[bytes]:
    """At most ``limit`` passages in an order that ends with their hash."""
    return [bytes(r["raw"]) for r in rows.orderBy(*order, F.xxhash64("raw"), "raw").limit(limit).select("raw").collect()]


def fit(docs: DataFrame, known: DataFrame, p: Params = Params()) -> Model | None:
    """Fit on ``docs`` (doc_id, text) whose ids ``known`` (doc_id, toxic) labels, at most ``fit_rows`` a class."""
    got = training_rows(docs, known, p)
    if got is None:
        return None
    rows, total = got
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.ceil((F.length("text") + 1) / p.passage)).alias("passages")).collect()
    count, n_passages = {r["part"]: r["n"] for r in sizes}, {r["part"]: r["passages"] for r in sizes}
    if not (count.get(FIRST, 0) + count.get(SECOND, 0) and count.get(ORDINARY, 0) + count.get(CURVE, 0)):
        return None
    part = F.col("part")
    ordinary = train(_taken(passages(rows.filter(part == ORDINARY), p.window), p.samples), p.ordinary_bytes)
    half = {}
    for k in (FIRST, SECOND):
        limit = max(200, min(p.samples, n_passages.get(k, 0) // 4))
        dearest = _taken(passages(rows.filter(part == k), p.passage, ordinary), limit, F.col("cost").desc())
        half[k] = b"".join(dearest)[:2 * p.toxic_bytes] + train(dearest, p.toxic_bytes)
    leaning: dict[int, list[bytes]] = {}
    before = None
    for _ in range(p.rounds):
        other = {FIRST: half[SECOND], SECOND: half[FIRST], ORDINARY: half[FIRST] + half[SECOND]}
        # A passage counts as often as it comes, so that training sees what recurs.
        hits = landed(passages(rows.filter(part != CURVE), p.passage, ordinary, other, p.noise_bytes).select("part", "raw"), "toxicity-round")
        leaning = {k: _taken(hits.filter(part == k), p.samples) for k in (FIRST, SECOND)}
        astray = _taken(hits.filter(part == ORDINARY), p.samples)
        share = hits.filter(part == ORDINARY).count() / max(1, n_passages.get(ORDINARY, 0))
        n_leaning = len(leaning[FIRST]) + len(leaning[SECOND])
        clean = share < p.least_share or not astray or (before is not None and share > 0.95 * before[0])
        if clean and before is not None and n_leaning < 1.05 * before[1]:
            break
        before = share, n_leaning
        if share >= p.least_share:
            ordinary = train(astray, p.addition_bytes) + ordinary
        half = {k: covering(leaning[k], p.toxic_bytes, p.noise_bytes) for k in (FIRST, SECOND)}
    toxic = covering(leaning[FIRST] + leaning[SECOND], 2 * p.toxic_bytes, p.noise_bytes)
    # The curve: toxic halves under the dictionary of the other half, ordinary texts that no dictionary was trained on.
    toxic_of = {FIRST: covering(leaning[SECOND], p.toxic_bytes, p.noise_bytes), SECOND: covering(leaning[FIRST], p.toxic_bytes, p.noise_bytes), CURVE: toxic}
    shown = rows.filter(part != ORDINARY) if count.get(CURVE) else rows
    got = measured(shown, Model(toxic, ordinary, (), p), {**toxic_of, ORDINARY: toxic}) \
        .select(*FEATURES, "part").toPandas()  # at most 2 * fit_rows rows of numbers
    y = (got["part"] >= FIRST).to_numpy(float)
    weights = fit_logistic(_design([got[c] for c in FEATURES], p), y)
    weights[0] += np.log(total[1] / total[0]) - np.log(y.sum() / (len(y) - y.sum()))  # the classes weigh as among all labels
    return Model(toxic, ordinary, tuple(float(x) for x in weights), p)


def measured(docs: DataFrame, model: Model, by_part: dict[int, bytes] | None = None) -> DataFrame:
    """doc_id (and part, if there) with FEATURES of every row; ``by_part``: toxic dictionaries of the parts."""
    extra = [c for c in ("part",) if c in docs.columns]
    types = dict(docs.dtypes)
    schema = ", ".join(["doc_id " + types["doc_id"], *(f"{c} {types[c]}" for c in extra), *(f"{c} long" for c in FEATURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinary = compressor(model.ordinary)
        toxic = {k: compressor(d + model.ordinary) for k, d in (by_part or {None: model.toxic}).items()}
        for b in batches:
            parts = column(b, "part").to_pylist() if extra else [None] * len(b)
            got = [features(t.as_py() or "", toxic[k], ordinary, model.params) for t, k in zip(column(b, "text"), parts)]
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id"), *(column(b, c) for c in extra), *(pa.array([g[i] for g in got], pa.int64()) for i in range(len(FEATURES)))],
                names=["doc_id", *extra, *FEATURES])

    return docs.select("doc_id", *extra, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of every row."""
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = scores(model, [column(b, c).to_numpy() for c in FEATURES]) if len(b) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(s)], names=["doc_id", "score"])

    return measured(docs.select("doc_id", "text"), model).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; labels of held-out rows are never read."""
    known = labels.select("doc_id", "toxic").filter(~held_out())
    model = fit(docs, known, p)
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score",
                                     F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))

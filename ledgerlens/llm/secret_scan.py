"""Secret scans: fixed patterns, and a character convolutional network over further candidates.

Patterns find assignments, access keys and long hex strings; what they find always
stays. Further candidates are long runs of key characters with letters and digits;
of a run that findings touch, the parts outside them, judged without their context.
The network reads overlapping windows over the whole of each (characters of it, some
before and some behind), and the highest probability counts. It is trained, by numpy in Spark tasks, on labelled findings:
the patterns' findings against ordinary words and addresses (mail, hosts, links), which a pattern
labels too, each also with the context before blanked, and values of findings also
behind the text of an address, so that the value itself must tell. What no pattern labels is not learnt
from, only judged; so are addresses with a long part that looks like a key. A held-back fifth of all windows calibrates
the scores (Platt) and gives the threshold. ``min_recall`` of the held-back findings must
still be found, which bounds it from above; of the thresholds with as few false alarms
as that bound the middle one is taken. Candidates at or above it are added.

Spans are code-point ranges, end exclusive. The fit takes every distinct window, in shards of about
``fit_rows`` a class whose networks are averaged; the scan reads every whole text.

Rules: null text is empty and has no spans; without findings and other candidates to
learn from nothing is added; repeated rows agree; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.ranking import row_number_by

from .common import column, landed

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
WORD = re.compile(r"[^\x20\x09-\x0D]{8,}")
HOST = re.compile(r"(?:[A-Za-z0-9_-]+\.)+[A-Za-z]{2,}(?:/\S*)?\.?")
KINDS = ("assign", "access", "hex", "network")
_HEX_BYTES = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))
_RUN_BYTES = bytes(1 if re.fullmatch(r"[A-Za-z0-9+/_.=-]", chr(b)) and b < 128 else 0 for b in range(256))

BEFORE, INSIDE, BEHIND = 24, 40, 8
LENGTH = BEFORE + INSIDE + BEHIND
#: Distance of the windows over a long run.
STRIDE = INSIDE // 2
#: Least length of a run's part beside findings: the shortest value that a pattern takes.
LEAST_PART = 6
#: Windows scored at once.
SCORE_WINDOWS = 8192
#: Rounds of training and averaging, and windows of a class that every shard gets (if there are so many).
ROUNDS = 10
SHARD_LEAST = 50


@dataclass(frozen=True)
class Params:
    fit_rows: int = 4000
    filters: int = 24
    kernel: int = 5
    epochs: int = 30
    min_recall: float = 0.98
    seed: int = 11


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' findings, in order; leftmost and non-overlapping per kind."""
    out = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"\1" * 24 in text.encode("utf-8", "surrogatepass").translate(_HEX_BYTES):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out)


def mixed(run: str) -> bool:
    return any(c.isdigit() for c in run) and any(c.isalpha() for c in run)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, bool]]:
    """(start, end, whole) of runs of key characters with letters and digits, less what findings cover."""
    if b"\1" * 16 not in text.encode("utf-8", "surrogatepass").translate(_RUN_BYTES):
        return []
    out, k, reach = [], 0, -1
    for m in RUN.finditer(text):
        a, e = m.span()
        at, parts = max(a, reach), []
        while k < len(base) and base[k][0] < e:
            if base[k][0] > at:
                parts.append((at, base[k][0]))
            at = reach = max(at, reach, base[k][2])
            k += 1
        if at < e:
            parts.append((at, e))
        whole = parts == [(a, e)]
        out += [(x, z, whole) for x, z in parts if (whole or z - x >= LEAST_PART) and mixed(text[x:z])]
    return out


def padded(text: str, a: int, e: int, whole: bool = True) -> str:
    """A span with the characters before and behind it (NUL where there are none, or where it is a part of a run)."""
    before, behind = (text[max(0, a - BEFORE):a], text[e:e + BEHIND]) if whole else ("", "")
    return before.rjust(BEFORE, "\0") + text[a:e] + behind.ljust(BEHIND, "\0")


def windows(span: str) -> Iterator[str]:
    """Overlapping windows over a padded span; a short span is filled up with NUL."""
    n = len(span) - BEFORE - BEHIND
    if n <= INSIDE:
        yield span[:BEFORE + n].ljust(BEFORE + INSIDE, "\0") + span[BEFORE + n:]
        return
    for i in range(0, n - INSIDE, STRIDE):
        yield span[i:i + LENGTH]
    yield span[n - INSIDE:]


def window(text: str, a: int, e: int) -> str:
    """The first window over a span."""
    return next(windows(padded(text, a, min(e, a + INSIDE))))


def is_address(text: str, a: int, e: int) -> bool:
    """Whether a run is part of a mail address or a link, or a host name."""
    return text[e:e + 1] == "@" or text[a - 1:a] == "@" or "://" in text[max(0, a - 8):e] or bool(HOST.fullmatch(text, a, e))


def holds_key(run: str) -> bool:
    """Whether a long part of an address looks like a key: words and numbers joined by - or _ do not."""
    return any(len(part) >= 16 and any(mixed(x) for x in re.split("[-_]", part)) for part in re.split(r"[/.=]", run))


# ---------------------------------------------------------------- network

#: Character classes: ASCII characters stand for themselves, other letters and other characters share one class each.
CLASSES = 130


def encode(windows: list[str]) -> np.ndarray:
    code = np.frombuffer("".join(windows).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(windows), LENGTH) if windows else np.zeros((0, LENGTH), np.uint32)
    return np.where(code < 128, code, np.where(code < 0x250, 128, 129)).astype(np.int32)


@dataclass
class Network:
    conv: np.ndarray  # kernel x classes x filters
    bias: np.ndarray
    dense: np.ndarray
    out_bias: float
    scale: tuple[float, float] = (0.0, 1.0)
    threshold: float = 0.5

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter, and where."""
        k = len(self.conv)
        n = x.shape[1] - k + 1
        y = sum(self.conv[i][x[:, i:i + n]] for i in range(k)) + self.bias
        at = y.argmax(axis=1)
        return np.maximum(np.take_along_axis(y, at[:, None, :], 1)[:, 0], 0), at

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.pooled(x[i:i + 512])[0] @ self.dense + self.out_bias for i in range(0, len(x), 512)] or [np.zeros(0)])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] + self.scale[1] * self.logits(x), -30, 30)))

    def highest(self, spans: list[str]) -> np.ndarray:
        """The highest probability among the windows over each padded span."""
        out = np.zeros(len(spans))
        every = ((i, w) for i, span in enumerate(spans) for w in windows(span))
        while some := list(islice(every, SCORE_WINDOWS)):
            np.maximum.at(out, [i for i, _ in some], self.probabilities(encode([w for _, w in some])))
        return out


def start(p: Params) -> Network:
    rng = np.random.default_rng(p.seed)
    return Network(rng.normal(0, 0.1, (p.kernel, CLASSES, p.filters)).astype(np.float32), np.zeros(p.filters, np.float32),
                   rng.normal(0, 0.3, p.filters).astype(np.float32), 0.0)


def train(net: Network, x: np.ndarray, y: np.ndarray, v: np.ndarray, p: Params, epochs: int, seed: int) -> Network:
    """Adam on the log loss from ``net`` on, rows weighing ``v`` and classes the same."""
    rng = np.random.default_rng(seed)
    net = Network(net.conv.copy(), net.bias.copy(), net.dense.copy(), net.out_bias)
    weight = v * np.where(y == 1, 0.5 / max(1e-9, v[y == 1].sum()), 0.5 / max(1e-9, v[y == 0].sum())) * len(y)
    params = [net.conv, net.bias, net.dense, np.full(1, net.out_bias, np.float32)]
    first, second = [np.zeros_like(a) for a in params], [np.zeros_like(a) for a in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 256):
            rows = order[i:i + 256]
            xb = x[rows]
            h, at = net.pooled(xb)
            z = h @ net.dense + net.out_bias
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
            back = g[:, None] * net.dense * (h > 0)
            grads = [np.zeros_like(net.conv), back.sum(0), h.T @ g, np.array([g.sum()], np.float32)]
            filters = np.broadcast_to(np.arange(p.filters), at.shape)
            for k in range(p.kernel):
                np.add.at(grads[0][k], (np.take_along_axis(xb, at + k, 1), filters), back)
            step += 1
            for a, d, m, s in zip(params, grads, first, second):
                m += 0.1 * (d - m)
                s += 0.001 * (d * d - s)
                a -= 0.01 * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
            net.out_bias = float(params[3][0])
    return net


#: Averages of networks are sums of whole numbers of this size, so that the order of the summands does not matter.
UNIT = 2.0 ** -36


def packed(net: Network) -> np.ndarray:
    flat = np.concatenate([net.conv.ravel(), net.bias, net.dense, [net.out_bias]]).astype(np.float64)
    return np.rint(flat / UNIT).astype(np.int64)


def unpacked(total: np.ndarray, n: int, like: Network) -> Network:
    flat = (total * (UNIT / n)).astype(np.float32)
    a, f = like.conv.size, len(like.bias)
    return Network(flat[:a].reshape(like.conv.shape).copy(), flat[a:a + f].copy(), flat[a + f:a + 2 * f].copy(), float(flat[-1]))


def behind_address(found: str, other: str) -> str:
    """A finding's value (without the word that names it) behind the end of another window's run."""
    value = found[BEFORE:BEFORE + INSIDE].rstrip("\0")
    if m := ASSIGN.match(value):
        value = m[2]
    before = other[BEFORE:BEFORE + INSIDE].rstrip("\0")[-BEFORE:]
    return before.rjust(BEFORE, "\0") + value.ljust(INSIDE, "\0") + found[BEFORE + INSIDE:]


def examples(positive: list[str], negative: list[str], v: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, labels and weights of a shard's windows, also without their context, and of findings behind addresses."""
    blank = [["\0" * BEFORE + w[BEFORE:] for w in c] for c in (positive, negative)]
    behind = [behind_address(w, negative[i % len(negative)]) for i, w in enumerate(positive)] if negative else []
    x = encode(positive + blank[0] + behind + negative + blank[1])
    found = 2 * len(positive) + len(behind)
    return x, np.array([1.0] * found + [0.0] * (2 * len(negative))), np.array([1.0] * found + 2 * v)


# ---------------------------------------------------------------- Spark

FOUND = ("starts array<int>, kinds array<int>, ends array<int>, windows array<string>, "
         "c_starts array<int>, c_ends array<int>, c_spans array<string>, addresses array<string>, word string")


def findings(docs: DataFrame) -> DataFrame:
    """Per row its findings with their windows, further candidates as padded spans, windows over addresses and an ordinary word's window."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(9)]
            for t in column(b, "text"):
                text = t.as_py() or ""
                base = base_spans(text)
                more = candidates(text, base)
                taken = [(a, e) for a, _, e in base] + [(a, e) for a, e, _ in more]
                word = next((m.span() for m in WORD.finditer(text, len(text) // 2) if not any(a < m.end() and m.start() < e for a, e in taken)), None)
                for col, x in zip(out, ([a for a, _, _ in base], [k for _, k, _ in base], [e for _, _, e in base], [window(text, a, e) for a, _, e in base],
                                        [a for a, _, _ in more], [e for _, e, _ in more], [padded(text, *c) for c in more],
                                        [w for a, e, whole in more if whole and is_address(text, a, e) and not holds_key(text[a:e]) for w in windows(padded(text, a, e))],
                                        window(text, *word) if word else None)):
                    col.append(x)
            ints, strings = pa.list_(pa.int32()), pa.list_(pa.string())
            kinds = [ints, ints, ints, strings, ints, ints, strings, strings, pa.string()]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds))],
                                             names=["doc_id", "starts", "kinds", "ends", "windows", "c_starts", "c_ends", "c_spans", "addresses", "word"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, {FOUND}")


def fit_windows(found: DataFrame) -> DataFrame:
    """(kind, w, i): every distinct window over findings (kind 2), addresses (1) and ordinary words (0); ``i`` numbers
    findings and the others from 0 in the order of their digests."""
    parts = [found.select(F.lit(k).alias("kind"), w.alias("w"))
             for k, w in ((2, F.explode("windows")), (1, F.explode("addresses")), (0, F.col("word")))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).filter("w is not null").distinct()
    digest = F.md5("w")
    rows = landed(rows.withColumns({"y": (F.col("kind") == 2).cast("int"), "h": F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")}), "windows")
    return row_number_by(rows, ["h", "w", "kind"], by=["y"], out="i").select("kind", "y", "w", (F.col("i") - 1).alias("i"))


def fit_findings(found: DataFrame, p: Params = Params()) -> Network | None:
    """Fit on every window: trained on four fifths, calibrated and the threshold set on the rest.

    The windows are dealt to shards of about ``fit_rows`` a class. A round trains every shard from the same network on
    and averages the results; a task sends one network. One shard is trained in a single round."""
    spark = found.sparkSession
    rows = landed(fit_windows(found), "numbered")
    n = {k: 0 for k in range(3)} | {r["kind"]: r["n"] for r in rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = {1: n[2], 0: n[0] + n[1]}
    if min(size.values()) < 5:
        return None
    shards = -(-max(size.values()) // p.fit_rows)
    # Addresses weigh at most half of what others do in a shard, however many there are.
    share = min(n[1], p.fit_rows // 2)
    v = F.when(F.col("kind") == 1, share / max(1, n[1])).when(F.col("kind") == 0, min(n[0], p.fit_rows - share) / max(1, n[0])).otherwise(1.0)
    copies = F.when(F.col("y") == 1, min(shards, -(-SHARD_LEAST * shards // size[1]))).otherwise(min(shards, -(-SHARD_LEAST * shards // size[0])))
    rest = rows.filter("i % 5 != 0").withColumn("v", v.cast("double"))
    rest = rest.withColumn("c", F.explode(F.sequence(F.lit(0), copies - 1)))
    rest = rest.withColumn("shard", F.pmod(F.col("i") - F.floor(F.col("i") / 5) - 1 + F.col("c"), F.lit(shards)))
    rest = landed(rest.repartition(shards, "shard").groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("y", "i", "kind", "w", "v"))).alias("rows")), "shards")
    net = start(p)
    rounds = 1 if shards == 1 else min(p.epochs, ROUNDS)
    for r in range(rounds):
        epochs = p.epochs * (r + 1) // rounds - p.epochs * r // rounds
        shared = spark.sparkContext.broadcast(net)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, epochs=epochs, r=r) -> Iterator[pa.RecordBatch]:
            total, done = 0, 0
            for b in batches:
                for shard, some in zip(column(b, "shard").to_pylist(), column(b, "rows")):
                    some = some.as_py()
                    sides = [[x for x in some if x["y"] == y] for y in (1, 0)]
                    x, y, v = examples(*[[e["w"] for e in c] for c in sides], [e["v"] for e in sides[1]])
                    total = total + packed(train(shared.value, x, y, v, p, epochs, p.seed + 1_000_003 * r + shard))
                    done += 1
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([done], pa.int64())], names=["total", "done"])

        got = rest.mapInArrow(run, "total binary, done long").collect()
        shared.unpersist()
        net = unpacked(sum(np.frombuffer(g["total"], np.int64) for g in got), sum(g["done"] for g in got), net)
    return calibrated(net, rows.filter("i % 5 = 0"), p)


def calibrated(net: Network, held: DataFrame, p: Params) -> Network:
    """The network with its scores calibrated on every held-back window (Platt) and the threshold set."""
    spark = held.sparkSession
    shared = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = shared.value.logits(encode(column(b, "w").to_pylist()))
            yield pa.RecordBatch.from_arrays([column(b, "y"), pa.array(z, pa.float64())], names=["y", "z"])

    scored = landed(held.select("y", "w").mapInArrow(run, "y int, z double"), "held")
    logit = lambda w: F.least(F.greatest(F.lit(float(w[0])) + F.lit(float(w[1])) * F.col("z"), F.lit(-30.0)), F.lit(30.0))
    w, z = np.zeros(2), F.col("z")
    for _ in range(50):  # Newton steps of a logistic curve with ridge 0.1; sums over all rows
        e = 1 / (1 + F.exp(-logit(w)))
        s = scored.select("y", "z", e.alias("e"), (e * (1 - e)).alias("d")).agg(
            F.sum(F.col("y") - F.col("e")).alias("g0"), F.sum((F.col("y") - F.col("e")) * z).alias("g1"), F.sum("d").alias("h00"),
            F.sum(F.col("d") * z).alias("h01"), F.sum(F.col("d") * z * z).alias("h11")).first()
        step = np.linalg.solve(np.array([[s["h00"] + 0.1, s["h01"]], [s["h01"], s["h11"] + 0.1]]), np.array([s["g0"], s["g1"]]) - 0.1 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    net.scale = (float(w[0]), float(w[1]))
    known = scored.select("y", (1 / (1 + F.exp(-logit(w)))).alias("e"))
    hits = known.filter("y = 1").select("e")
    place = int(np.floor((1 - p.min_recall) * hits.count()))
    top = hits.orderBy("e").limit(place + 1).agg(F.max("e")).first()[0]
    other = known.filter("y = 0").filter(F.col("e") < F.lit(top)).agg(F.max("e")).first()[0]
    net.threshold = float((top + (other or 0.0)) / 2)
    return net


def secrets(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_network of every row."""
    found = landed(findings(docs), "findings")
    net = docs.sparkSession.sparkContext.broadcast(fit_findings(found, p))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = net.value
        for b in batches:
            starts, kinds, ends, c_starts, c_ends, c_spans = (column(b, c).to_pylist() for c in ("starts", "kinds", "ends", "c_starts", "c_ends", "c_spans"))
            flat = [w for ws in c_spans for w in ws]
            hit = (model.highest(flat) >= model.threshold) if model else np.zeros(len(flat), bool)
            out: list[list] = [[] for _ in range(6)]
            at = 0
            for s, k, e, cs, ce in zip(starts, kinds, ends, c_starts, c_ends):
                base = list(zip(s, k, e))
                more = [(a, 3, z) for a, z, h in zip(cs, ce, hit[at:at + len(cs)].tolist()) if h]
                at += len(cs)
                text = [",".join(f"{KINDS[j]}:{a}:{z}" for a, j, z in spans) for spans in (base, sorted(base + more))]
                for col, x in zip(out, (k.count(0), k.count(1), k.count(2), hashlib.sha256(text[0].encode()).hexdigest(), text[1], len(more))):
                    col.append(x)
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), *(pa.array(c, t) for c, t in zip(out, types))],
                                             names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_network"])

    return found.select("doc_id", "starts", "kinds", "ends", "c_starts", "c_ends", "c_spans").mapInArrow(
        run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_network long")

"""A small network with device embeddings, trained by mini-batches whose gradients executors work out.

Rows are packed once in blocks by a hash of their key.  Training is one barrier job: its tasks deal the blocks among them,
keep them in files that have no name, and stay for all steps.  In a step each task sends the gradient of its blocks of the
batch to the first task, which moves the weights and sends them back, so a step costs a round trip and not a job.  A
block's gradient is rounded to whole numbers of a tiny step, so sums don't depend on which tasks hold which blocks.

Where tasks can't all run at once (executors that come and go), a step is a job: it hands the weights to the tasks that
hold the blocks of its batch and runs no others, and the driver moves the weights.
"""

from __future__ import annotations

import hmac
import os
import secrets
import socket
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, BarrierTaskContext, SparkContext, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from telemill.sources.scratch import written

from .quantiles import column_quantiles

#: Rows of a block on average; steps of 1 in a gradient's whole numbers; devices that a model can tell apart.
BLOCK, STEPS, MOST_DEVICES = 2048, float(1 << 36), 10_000
#: Partitions over which blocks are dealt at most.
MOST_PARTS = 1 << 14
#: Seconds that a task of the barrier job waits for another one.
PATIENCE = 600


@dataclass(frozen=True)
class Settings:
    embedding: int = 4
    hidden: int = 128
    epochs: int = 40
    batch: int = 8192
    rate: float = 0.001
    seed: int = 42


Weights = dict[str, np.ndarray]


def initial(numbers: int, devices: int, s: Settings) -> Weights:
    """Uniform within the inverse root of a layer's inputs; standard normal embeddings, the last for unknown devices."""
    rnd = np.random.default_rng(s.seed)
    out: Weights = {"e": rnd.standard_normal((devices + 1, s.embedding))}
    for k, (a, b) in enumerate(((numbers + s.embedding, s.hidden), (s.hidden, s.hidden), (s.hidden, 1))):
        out[f"w{k}"], out[f"b{k}"] = rnd.uniform(-(a**-0.5), a**-0.5, (a, b)), rnd.uniform(-(a**-0.5), a**-0.5, b)
    return out


def forward(w: Weights, x: np.ndarray, device: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Predictions, and the inputs of each layer."""
    layers = [np.concatenate((x, w["e"][device]), axis=1)]
    for k in (0, 1):
        layers.append(np.maximum(layers[-1] @ w[f"w{k}"] + w[f"b{k}"], 0.0))
    z = (layers[-1] @ w["w2"] + w["b2"])[:, 0]
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))), layers


def gradient(w: Weights, x: np.ndarray, device: np.ndarray, y: np.ndarray) -> tuple[float, Weights]:
    """Sum of squared errors, and its gradient."""
    p, layers = forward(w, x, device)
    out: Weights = {}
    down = (2.0 * (p - y) * p * (1.0 - p))[:, None]
    for k in (2, 1, 0):
        out[f"w{k}"], out[f"b{k}"] = layers[k].T @ down, down.sum(axis=0)
        down = down @ w[f"w{k}"].T
        if k:
            down = down * (layers[k] > 0)
    out["e"] = np.zeros_like(w["e"])
    np.add.at(out["e"], device, down[:, x.shape[1] :])
    return float(((p - y) ** 2).sum()), out


def flat(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def shaped(values: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


@dataclass
class Network:
    features: list[str]
    device: str
    devices: list[str]
    medians: np.ndarray
    means: np.ndarray
    deviations: np.ndarray
    weights: Weights
    losses: list[float] = field(default_factory=list)

    def inputs(self) -> list[Column]:
        """Each feature as a number, missing ones as their median, by mean and deviation; and the device's number."""
        x = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(float(m))) for c, m in zip(self.features, self.medians, strict=True)]
        scaled = [(v - float(m)) / float(d) for v, m, d in zip(x, self.means, self.deviations, strict=True)]
        place = F.array_position(F.array(*[F.lit(d) for d in self.devices]).cast("array<string>"), F.col(self.device).cast("string"))
        return [*scaled, F.when(place > 0, place - 1).otherwise(len(self.devices)).cast("int")]

    def prediction(self) -> Column:
        @F.pandas_udf("double")
        def score(*columns: pd.Series) -> pd.Series:
            *numbers, device = [c.to_numpy() for c in columns]
            x = np.column_stack(numbers) if numbers else np.zeros((len(device), 0))
            return pd.Series(forward(self.weights, x, device)[0])

        return score(*self.inputs())


def prepared(df: DataFrame, features: list[str], device: str, s: Settings) -> Network:
    """An untrained network with the medians, means and deviations of all rows of ``df``."""
    known = [r[0] for r in df.select(F.col(device).cast("string").alias("d")).where("d is not null").distinct().limit(MOST_DEVICES + 1).collect()]
    if len(known) > MOST_DEVICES:
        raise ValueError(f"{device} has more than {MOST_DEVICES} values; an embedding for each would not stay small")
    medians = np.array([q[0] or 0.0 for q in column_quantiles(df, features, [0.5])])
    net = Network(features, device, sorted(known), medians, np.zeros(len(features)), np.ones(len(features)), initial(len(features), len(known), s))
    if features:
        row = df.agg(*[f(c).alias(f"{n}{k}") for k, c in enumerate(net.inputs()[:-1]) for n, f in (("m", F.avg), ("d", F.stddev_pop))]).first()
        net.means = np.array([row[f"m{k}"] or 0.0 for k in range(len(features))])
        net.deviations = np.array([row[f"d{k}"] or 1.0 for k in range(len(features))])
    return net


def pack(net: Network, df: DataFrame, target: str, key: list[str]) -> tuple[DataFrame, int]:
    """(block, n, x, device, y) of the rows with a target, and the number of blocks; rows go to blocks by hash."""
    y = F.nanvl(F.col(target).cast("double"), F.lit(None))
    *numbers, device = net.inputs()
    rows = df.where(y.isNotNull()).select(*[c.alias(f"x{k}") for k, c in enumerate(numbers)], device.alias("device"), y.alias("y"), F.xxhash64(*key).alias("mark"))
    blocks = max(1, -(-rows.count() // BLOCK))
    text = "block long, n int, x binary, device binary, y binary"
    schema, count = to_arrow_schema(_parse_datatype_string(text)), len(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            x = np.column_stack([t[f"x{k}"].to_numpy() for k in range(count)]) if count else np.zeros((t.num_rows, 0))
            row = [held[0]["block"][0].as_py(), t.num_rows, np.ascontiguousarray(x).tobytes(), t["device"].to_numpy().astype(np.int32).tobytes(), t["y"].to_numpy().tobytes()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            numbers = batch["block"].to_numpy()
            cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[0]["block"][0].as_py() != numbers[a]:
                    yield flush()
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield flush()

    dealt = rows.withColumn("block", F.pmod("mark", F.lit(blocks)).cast("long"))
    order = ["block", "mark", *[f"x{k}" for k in range(count)], "device", "y"]
    return written(dealt.repartition("block").sortWithinPartitions(*order).mapInArrow(run, text), "network"), blocks


@dataclass
class Held:
    """Blocks that executors keep: block k is in partition ``k // each``."""

    rows: RDD
    each: int

    @classmethod
    def of(cls, packed: DataFrame, blocks: int) -> Held:
        each = -(-blocks // MOST_PARTS)
        rows = packed.rdd.map(lambda r: (r.block, (r.n, r.x, r.device, r.y))).partitionBy(-(-blocks // each), lambda k: k // each)
        return cls(rows.persist(StorageLevel.MEMORY_AND_DISK), each)


def whole(weights: Weights, rows: int, x: bytes, device: bytes, y: bytes, features: int) -> np.ndarray:
    """Whole steps of a block's gradient and of its squared error."""
    loss, g = gradient(weights, np.frombuffer(x).reshape(rows, features), np.frombuffer(device, np.int32), np.frombuffer(y))
    return np.rint(np.append(flat(g), loss) * STEPS).astype(np.int64)


def step_sums(held: Held, batch: list[int] | None, weights: Weights, features: int) -> tuple[int, float, np.ndarray]:
    """Rows, squared error and gradient of the blocks of a batch (None: of all)."""
    wanted = None if batch is None else set(batch)

    def run(blocks: Iterator[tuple]) -> Iterator[tuple[int, bytes]]:
        n, total = 0, None
        for block, (rows, x, device, y) in blocks:
            if wanted is None or block in wanted:
                more = whole(weights, rows, x, device, y, features)
                n, total = n + rows, more if total is None else total + more
        if n:
            yield n, total.tobytes()

    parts = None if batch is None else sorted({k // held.each for k in batch})
    found = held.rows.context.runJob(held.rows, run, parts)
    total = sum((np.frombuffer(sums, np.int64) for _, sums in found), np.zeros(flat(weights).size + 1, np.int64)) / STEPS
    return sum(n for n, _ in found), float(total[-1]), total[:-1]


def batches(blocks: int, each: int, s: Settings) -> Iterator[list[list[int] | None]]:
    """Each epoch's batches of ``each`` blocks (None: all)."""
    rnd = np.random.default_rng(s.seed)
    for _ in range(s.epochs):
        order = rnd.permutation(blocks).tolist()
        yield [None if each >= blocks else order[at : at + each] for at in range(0, blocks, each)]


def descent(sums: Callable[[list[int] | None, Weights], tuple[int, float, np.ndarray]], weights: Weights, blocks: int, each: int, s: Settings) -> tuple[Weights, list[float]]:
    """Weights after all steps, and each epoch's mean squared error; ``sums`` gives those of a batch."""
    now, losses = flat(weights), []
    first, second, step = np.zeros_like(now), np.zeros_like(now), 0
    for epoch in batches(blocks, each, s):
        squares, rows = 0.0, 0
        for batch in epoch:
            n, loss, g = sums(batch, weights)
            if not n:
                continue
            step, g = step + 1, g / n
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            now = now - s.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            weights, squares, rows = shaped(now, weights), squares + loss, rows + n
        losses.append(squares / max(rows, 1))
    return weights, losses


def at_once(context: SparkContext, wanted: int) -> int:
    """Tasks of a barrier job, up to ``wanted``; 0 where there is none, as executors may come and go."""
    if context.getConf().get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return 0
    scala = context._jsc.sc()
    return min(wanted, scala.maxNumConcurrentTasks(scala.resourceProfileManager().defaultResourceProfile()))


class Kept:
    """A task's blocks, in a file without a name."""

    def __init__(self, blocks: Iterator[tuple]) -> None:
        self.file, self.place, end = tempfile.TemporaryFile(), {}, 0
        for block, (n, x, device, y) in blocks:
            self.place.setdefault(block, []).append((n, end, len(x), len(device), len(y)))
            for part in (x, device, y):
                self.file.write(part)
                end += len(part)
        self.file.flush()

    def sums(self, batch: list[int] | None, weights: Weights, features: int) -> np.ndarray:
        """Rows, and whole steps of the gradient and the squared error, of the blocks of a batch that are here."""
        total = np.zeros(sum(w.size for w in weights.values()) + 2, np.int64)
        for block in self.place if batch is None else batch:
            for n, at, *sizes in self.place.get(block, ()):
                raw = os.pread(self.file.fileno(), sum(sizes), at)
                x, device, y = raw[: sizes[0]], raw[sizes[0] : sizes[0] + sizes[1]], raw[sizes[0] + sizes[1] :]
                total[0] += n
                total[1:] += whole(weights, n, x, device, y, features)
        return total


def received(peer: socket.socket, size: int) -> bytearray:
    out, at = bytearray(size), 0
    while at < size:
        if not (got := peer.recv_into(memoryview(out)[at:])):
            raise ConnectionError("a task of the network's training has gone")
        at += got
    return out


def met(task: BarrierTaskContext) -> list[socket.socket]:
    """The first task's connections to all others, and the others' to the first one."""
    rank, infos = task.partitionId(), task.getTaskInfos()
    if len(infos) == 1:
        return []
    server = socket.create_server(("", 0), backlog=len(infos)) if not rank else None
    said = task.allGather(f"{server.getsockname()[1]} {secrets.token_hex(16)}" if server else "")
    port, token = next(x for x in said if x).split()
    peers: list[socket.socket] = []
    if server:
        server.settimeout(PATIENCE)
        while len(peers) < len(infos) - 1:
            peer, _ = server.accept()
            peer.settimeout(PATIENCE)
            if hmac.compare_digest(bytes(received(peer, len(token))), token.encode()):
                peers.append(peer)
            else:
                peer.close()
        server.close()
    else:
        peers = [socket.create_connection((infos[0].address.rsplit(":", 1)[0], int(port)), PATIENCE)]
        peers[0].sendall(token.encode())
    for peer in peers:
        peer.settimeout(PATIENCE)
        peer.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
    return peers


def together(packed: DataFrame, blocks: int, each: int, tasks: int, weights: Weights, features: int, s: Settings) -> tuple[Weights, list[float]]:
    """``descent`` by one job of ``tasks`` tasks that all run at once; block k is with task ``k % tasks``."""

    def run(mine: Iterator[tuple]) -> Iterator[tuple[bytes, list[float]]]:
        task, kept = BarrierTaskContext.get(), Kept(mine)
        peers, size = met(task), flat(weights).size

        def sums(batch: list[int] | None, now: Weights) -> tuple[int, float, np.ndarray]:
            for peer in peers:
                peer.sendall(flat(now).tobytes())
            total = kept.sums(batch, now, features)
            for peer in peers:
                total = total + np.frombuffer(received(peer, 8 * (size + 2)), np.int64)
            return int(total[0]), float(total[-1] / STEPS), total[1:-1] / STEPS

        try:
            if not task.partitionId():
                now, losses = descent(sums, weights, blocks, each, s)
                yield flat(now).tobytes(), losses
            else:
                for epoch in batches(blocks, each, s):
                    for batch in epoch:
                        now = shaped(np.frombuffer(received(peers[0], 8 * size)), weights)
                        peers[0].sendall(kept.sums(batch, now, features).tobytes())
        finally:
            for peer in peers:
                peer.close()

    rows = packed.rdd.map(lambda r: (r.block, (r.n, r.x, r.device, r.y))).partitionBy(tasks, lambda k: k % tasks)
    ((raw, losses),) = rows.barrier().mapPartitions(run).collect()
    return shaped(np.frombuffer(raw).copy(), weights), losses


def fit(df: DataFrame, features: list[str], device: str, target: str, key: list[str], settings: Settings | None = None) -> Network:
    """A network for targets from 0 to 1, from all rows that have one; ``key`` names the columns that tell rows apart.

    Missing numbers become the exact median of their column, unknown devices share an embedding.  Without rows the
    network stays as it began.
    """
    s = settings or Settings()
    net = prepared(df, features, device, s)
    packed, blocks = pack(net, df, target, key)
    each = max(1, s.batch // BLOCK)
    tasks = at_once(df.sparkSession.sparkContext, min(each, blocks))
    if tasks:
        net.weights, net.losses = together(packed, blocks, each, tasks, net.weights, len(features), s)
        return net
    held = Held.of(packed, blocks)
    net.weights, net.losses = descent(lambda batch, w: step_sums(held, batch, w, len(features)), net.weights, blocks, each, s)
    held.rows.unpersist()
    return net

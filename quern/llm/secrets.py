"""Secret scans: fixed patterns, and a character convolutional network over every candidate.

Patterns give the base findings. Every run of CANDIDATE's characters is a candidate besides; the network reads its
characters with those around it and gives a chance that it is a secret, so that values are found which no pattern
names. It is one convolution over characters (WIDTH wide, FILTERS filters, a table look-up a place, since characters
are one-hot), pooled over the candidate (largest and mean) and over what surrounds it (largest), then a hidden layer.

It is trained on labelled findings: windows with label 1 (a secret) or 0. findings() labels a corpus by the patterns:
values that a pattern found are 1, other candidates 0. Half of the windows are shown without their surroundings, so
that the value alone must do. A fifth of the windows, chosen by hash, is kept from training; on it the scores are
calibrated (scale and shift, at the corpus's share of secrets) and the thresholds are set: for candidates that follow
a colon or an equals sign, and for bare ones, each halfway (in log-odds) between the highest that keeps RECALL of the
kept findings and the next clean window under it, and CERTAIN at least where that keeps RECALL too. For bare ones the kept
findings are read without their surroundings.

Every different window of the corpus is learned from or kept, of any length. They are dealt by hash to shards of about
SHARD characters, as many as that takes. In each of ROUNDS rounds every shard goes through its own windows in steps from
the same network, and the networks that come out are averaged, with their steps' moments. Sums over shards and over kept
windows are of whole numbers, so that neither partitions nor order change them; the driver holds one network and counts.

Defined results: null and empty texts have no findings; null ids and repeated rows are rows like others; with fewer than
LEAST different findings or other candidates to learn from there is no network and nothing is added; a candidate that touches
a base finding is that finding; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.memory import bound_batches, tidy
from quern.session import discard, materialize

#: The base patterns, fixed values. Keywords are in either case, of ASCII letters only.
ASSIGN = re.compile(r"""(?P<name>(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?(?P<value>[A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # as [0-9a-f]+ of 32 or more
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
#: Every keyword holds one of these, in lower case.
KEYWORDS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "network")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{12,}")
NAMED = re.compile(r"""[:=]\x20*["']?\Z""")
BEFORE, AFTER = 24, 8
WIDTH, FILTERS, HIDDEN, CODES = 5, 16, 12, 128
HALO = WIDTH // 2
LEAST = 8
ROUNDS, BATCH, RATE, DECAY = 8, 256, 0.01, 1e-4
RECALL, CERTAIN = 0.95, 0.9
#: Places convolved at a time.
SPAN = 32_768
#: Candidates scored at a time.
GROUP = 1_024
HELD = 5
#: Characters of a shard's windows, about.
SHARD = 1 << 20
#: Units of the whole numbers that are summed: a network's, and a loss's.
FIXED, FINE = 2.0**36, 2.0**20
#: Scales and shifts that calibration tries.
GRID = [(s, b) for s in np.geomspace(0.1, 4, 25) for b in np.linspace(-12, 4, 65)]
SHAPES = ((WIDTH, CODES, FILTERS), (FILTERS,), (3 * FILTERS, HIDDEN), (HIDDEN,), (HIDDEN + 1,))


def runs(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text)]


def base_spans(text: str, found: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """first, kind's number, last, start of the value: by first and kind. found: runs(text).

    Access keys and hex strings are parts of runs, whose characters include theirs.
    """
    out = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        out += [(m.start(), 0, m.end(), m.start("value")) for m in ASSIGN.finditer(text) if m.end() - m.start("value") >= LEAST_ASSIGN]
    for a, z in found:
        if z - a >= LEAST_ACCESS and text.find("AKIA", a, z) >= 0:
            out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text, a, z) if m.end() - m.start() >= LEAST_ACCESS]
        if z - a >= LEAST_HEX:
            out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text, a, z)]
    return sorted(out)


def candidates(found: list[tuple[int, int]], base: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """The runs that touch no base finding."""
    if not base:
        return found
    ends: list[list[int]] = []  # the base findings' union
    for first, _, last, _ in base:
        if ends and first <= ends[-1][1]:
            ends[-1][1] = max(ends[-1][1], last)
        else:
            ends.append([first, last])
    out, i = [], 0
    for a, z in found:
        while i < len(ends) and ends[i][1] <= a:
            i += 1
        if i == len(ends) or ends[i][0] >= z:
            out.append((a, z))
    return out


def window(text: str, first: int, last: int) -> str:
    """The characters with those around them and the filters' reach; zeros stand beyond the text."""
    left = text[max(0, first - BEFORE - HALO) : first].rjust(BEFORE + HALO, "\0")
    return left + text[first:last] + text[last : last + AFTER + HALO].ljust(AFTER + HALO, "\0")


def bare(own: str) -> str:
    """The window without its surroundings."""
    cut = len(own) - AFTER - HALO
    return "\0" * (BEFORE + HALO) + own[BEFORE + HALO : cut] + "\0" * (AFTER + HALO)


def is_named(own: str) -> bool:
    return bool(NAMED.search(own[: BEFORE + HALO]))


def codes_of(windows: list[str]) -> np.ndarray:
    own = np.frombuffer("".join(windows).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.minimum(own, CODES - 1).astype(np.intp)


def regions(windows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last place, window, and part (1 the candidate, 0 around it), in order; candidates in pieces of SPAN."""
    sizes = np.array([len(w) for w in windows], np.int64)
    start = np.cumsum(sizes) - sizes
    first, last, own, part = [], [], [], []
    for i, (a, n) in enumerate(zip((start + BEFORE + HALO).tolist(), (sizes - BEFORE - AFTER - 2 * HALO).tolist())):
        cuts = [a, *range(a + SPAN, a + n, SPAN), a + n]
        first += [a - BEFORE, *cuts]
        last += [*cuts, a + n + AFTER]
        own += [i] * (len(cuts) + 1)
        part += [0, *[1] * (len(cuts) - 1), 0]
    return tuple(np.array(x, np.int64) for x in (first, last, own, part))


def chunks(first: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, int]]:
    """Regions low to high of SPAN places, about."""
    low = 0
    while low < len(first):
        high = max(low + 1, int(np.searchsorted(last, first[low] + SPAN, side="right")))
        yield low, high
        low = high


@dataclass
class Network:
    table: np.ndarray  # WIDTH x CODES x FILTERS
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    shift: float = 0.0
    scale: float = 1.0
    #: Thresholds of candidates that are named, and of bare ones.
    thresholds: tuple[float, float] = (2.0, 2.0)

    def convolved(self, codes: np.ndarray, first: int, last: int) -> np.ndarray:
        """The filters at places first to last, before they are cut at zero."""
        h = np.repeat(self.bias[None], last - first, axis=0)
        for w in range(WIDTH):
            h += self.table[w].take(codes[first + w - HALO : last + w - HALO], axis=0)
        return h

    def pooled(self, windows: list[str]) -> np.ndarray:
        codes, (first, last, own, part) = codes_of(windows), regions(windows)
        most, total = np.zeros((2, len(windows), FILTERS), np.float32), np.zeros((len(windows), FILTERS), np.float32)
        for low, high in chunks(first, last):
            a = np.maximum(self.convolved(codes, first[low], last[high - 1]), 0)
            ends = np.stack([first[low:high], last[low:high]], axis=1).ravel() - first[low]
            a = np.concatenate([a, np.zeros((1, FILTERS), np.float32)])  # so that the last end is a place
            tops, sums = np.maximum.reduceat(a, ends)[::2], np.add.reduceat(a, ends)[::2]
            np.maximum.at(most, (part[low:high], own[low:high]), tops)
            inside = part[low:high] == 1
            np.add.at(total, own[low:high][inside], sums[inside])
        sizes = np.array([len(w) for w in windows], np.float32)[:, None] - (BEFORE + AFTER + 2 * HALO)
        return np.concatenate([most[1], total / sizes, most[0]], axis=1)

    def logits(self, windows: list[str]) -> np.ndarray:
        if not windows:
            return np.zeros(0)
        return (np.tanh(self.pooled(windows) @ self.hidden + self.hidden_bias) @ self.out[:-1] + self.out[-1]).astype(np.float64)

    def scores(self, windows: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(windows) + self.shift, -30, 30)))

    def thresholds_of(self, windows: list[str]) -> np.ndarray:
        return np.where([is_named(w) for w in windows], *self.thresholds)


def _step(net: Network, windows: list[str], y: np.ndarray, weigh: np.ndarray) -> list[np.ndarray]:
    """Gradients of the weighted cross-entropy."""
    codes, (first, last, own, part) = codes_of(windows), regions(windows)
    inside, sizes = part == 1, last - first

    @functools.lru_cache(1)  # one chunk, as nearly always, is looked at once
    def active(low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the regions, the region of each, and the filters there."""
        region = np.repeat(np.arange(low, high), sizes[low:high])
        start = np.cumsum(sizes[low:high]) - sizes[low:high]
        place = np.arange(len(region)) + (first[low:high] - start)[region - low]
        return place, region, np.maximum(net.convolved(codes, first[low], last[high - 1])[place - first[low]], 0)

    tops, sums = np.zeros((2, len(first), FILTERS), net.bias.dtype)
    where = np.zeros((len(first), FILTERS), np.int64)
    for low, high in chunks(first, last):
        place, region, a = active(low, high)
        start = np.cumsum(sizes[low:high]) - sizes[low:high]
        tops[low:high], sums[low:high] = np.maximum.reduceat(a, start), np.add.reduceat(a, start)
        i, f = np.nonzero((a == tops[region]) & (a > 0))
        where[region[i[::-1]], f[::-1]] = place[i[::-1]]  # of equal places the first
    most, total = np.zeros((2, len(windows), FILTERS), net.bias.dtype), np.zeros((len(windows), FILTERS), net.bias.dtype)
    np.maximum.at(most, (part, own), tops)
    np.add.at(total, own[inside], sums[inside])
    own_sizes = np.bincount(own[inside], sizes[inside])[:, None].astype(np.float32)
    x = np.concatenate([most[1], total / own_sizes, most[0]], axis=1)
    z = np.tanh(x @ net.hidden + net.hidden_bias)
    d = ((1 / (1 + np.exp(-np.clip(z @ net.out[:-1] + net.out[-1], -40, 40))) - y) * weigh).astype(np.float32)
    g_out = np.append(z.T @ d, d.sum())
    back = np.outer(d, net.out[:-1]) * (1 - z * z)
    g_hidden, g_hidden_bias = x.T @ back, back.sum(0)
    to = back @ net.hidden.T
    to_mean, to_most = to[:, FILTERS : 2 * FILTERS] / own_sizes, np.stack([to[:, 2 * FILTERS :], to[:, :FILTERS]])
    g_table, g_bias = np.zeros((WIDTH, CODES * FILTERS)), np.zeros(FILTERS)

    def add(place: np.ndarray, f: np.ndarray, g: np.ndarray) -> None:
        g_bias[:] += np.bincount(f, g, FILTERS)
        for w in range(WIDTH):
            g_table[w] += np.bincount(codes[place + w - HALO] * FILTERS + f, g, CODES * FILTERS)

    r, f = (i[::-1] for i in np.nonzero((tops == most[part, own]) & (tops > 0)))
    at = np.full(most.shape, -1)
    at[part[r], own[r], f] = where[r, f]  # of equal regions the first
    k, i, f = np.nonzero(at >= 0)
    add(at[k, i, f], f, to_most[k, i, f])
    for low, high in chunks(first, last):
        place, region, a = active(low, high)
        i, f = np.nonzero((a > 0) & inside[region][:, None])
        add(place[i], f, to_mean[own[region[i]], f])
    return [g_table.reshape(SHAPES[0]), g_bias, g_hidden, g_hidden_bias, g_out]


def _parts(flat: np.ndarray) -> list[np.ndarray]:
    """A network's arrays from one after the other."""
    ends = np.cumsum([math.prod(s) for s in SHAPES])
    return [x.reshape(s).astype(np.float32) for x, s in zip(np.split(flat, ends[:-1]), SHAPES)]


def begun() -> np.ndarray:
    """The state before the first round: the network, its steps' mean and root mean square gradients, and their number."""
    rng = np.random.default_rng(5)
    draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[-2] if len(s) == 2 else WIDTH), s).astype(np.float32)
    p = [0.3 * draw(*SHAPES[0]), np.zeros(FILTERS), draw(*SHAPES[2]), np.zeros(HIDDEN), 0.2 * draw(1, HIDDEN + 1)[0]]
    own = np.concatenate([x.ravel() for x in p])
    return np.concatenate([own, np.zeros(2 * len(own) + 1)])


def trained(state: np.ndarray, windows: list[str], y: np.ndarray, weigh: np.ndarray, seed: tuple[int, ...]) -> np.ndarray:
    """The state after each window was shown once, whole or without its surroundings."""
    (p, m, root), t = state[:-1].astype(np.float64).reshape(3, -1), state[-1]
    v, rng = root * root, np.random.default_rng(seed)
    order = rng.permutation(len(windows))
    for low in range(0, len(order), BATCH):
        at, t = order[low : low + BATCH], t + 1
        hidden = rng.random(len(at)) < 0.5
        shown = [bare(windows[i]) if b else windows[i] for i, b in zip(at, hidden)]
        g = np.concatenate([x.ravel() for x in _step(Network(*_parts(p)), shown, y[at], weigh[at] / len(at))]) + DECAY * p
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return np.concatenate([p, m, np.sqrt(v), [t]])


def _windows(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """shard, windows, labels of each row."""
    for shard, rows in zip(batch.column("shard").to_pylist(), batch.column("windows")):
        own = rows.values
        yield shard, own.field("window").to_pylist(), own.field("label").to_numpy().astype(np.float32)


def _summed(frame: DataFrame, work) -> dict[int, int]:
    """Sums by place of the whole numbers that the tasks give."""
    rows = frame.mapInArrow(tidy(work), "place int, value long").groupBy("place").agg(F.sum("value").alias("value"))
    return {r.place: r.value for r in rows.collect()}


def _placed(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values.astype(np.int64))], ["place", "value"])


def fit(dealt: DataFrame, balance: tuple[float, float]) -> Network:
    """The network after all rounds. dealt: shard, windows (hash, label, window). balance: a window's weight by label."""
    state = begun()
    for number in range(ROUNDS):
        shared = dealt.sparkSession.sparkContext.broadcast(state)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(shared.value) + 1, np.int64)  # noqa: B023
            for b in batches:
                for shard, windows, y in _windows(b):
                    own = trained(shared.value, windows, y, np.where(y == 1, balance[1], balance[0]), (5, number, shard))  # noqa: B023
                    total += np.append(np.rint(own * FIXED), 1).astype(np.int64)
            if total[-1]:
                yield _placed(total)

        sums = _summed(dealt, work)
        state = np.array([sums[i] for i in range(len(state))], np.float64) / FIXED / sums[len(state)]
        shared.destroy()
    return Network(*_parts(state[:-1].reshape(3, -1)[0]))


def keys_of(logits: np.ndarray) -> np.ndarray:
    """Whole numbers of 32 bits in the order of the logits, which are of single precision."""
    own = logits.astype(np.float32).view(np.uint32)
    return np.where(own >> 31, ~own, own | 0x80000000).astype(np.int64)


def logit_of(key: int) -> float:
    own = np.uint32(key)
    return float(np.array(own & 0x7FFFFFFF if own >> 31 else ~own, np.uint32).view(np.float32))


def ranked(own: DataFrame, rank: int) -> int:
    """The key at a rank, from 0: counted by the upper half of its bits, then by all within one of these."""
    found = 0
    for bits in (16, 0):
        key = F.shiftright("key", bits)
        for r in sorted(own.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).collect()):
            found = r.key
            if rank < r.n:
                break
            rank -= r.n
        own = own.where(key == found)
    return found


#: Kinds of kept windows: clean and bare clean ones, secrets that aren't named and named ones, bare secrets.
CLEAN, BARE_CLEAN, UNNAMED, SECRET_NAMED, BARE_SECRET = range(5)


def kept_logits(kept: DataFrame, net: Network) -> DataFrame:
    """kind, key: the kept windows' logits."""
    shared = kept.sparkSession.sparkContext.broadcast(net)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, windows, y in _windows(b):
                for low in range(0, len(windows), GROUP):
                    own, label = windows[low : low + GROUP], y[low : low + GROUP]
                    kind = np.where(label == 0, CLEAN, np.where([is_named(w) for w in own], SECRET_NAMED, UNNAMED))
                    alone = np.where(label == 0, BARE_CLEAN, BARE_SECRET)
                    keys = keys_of(np.concatenate([shared.value.logits(own), shared.value.logits([*map(bare, own)])]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([kind, alone]).astype(np.int32)), pa.array(keys)], ["kind", "key"])

    return kept.mapInArrow(tidy(work), "kind int, key long")


def _losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By label, scale and shift: the sum of log(1 + e^z); then each label's sum of logits, and number."""
    total = np.zeros((2, len(GRID) + 2), np.int64)
    for b in batches:
        label = b.column("kind").to_numpy() != CLEAN
        own = b.column("key").to_numpy()
        logit = np.where(own >> 31, own & 0x7FFFFFFF, ~own).astype(np.uint32).view(np.float32).astype(np.float64)
        for y in (0, 1):
            x = logit[label == y]
            for i, (scale, shift) in enumerate(GRID if len(x) else ()):
                total[y, i] += int(np.rint(np.logaddexp(0, scale * x + shift) * FINE).sum())
            total[y, -2:] += int(np.rint(x * FINE).sum()), len(x)
    yield _placed(total.ravel())


def calibrated(kept: DataFrame, net: Network, share: float) -> Network:
    """Scale and shift by the kept windows, weighted to the corpus's share of secrets, and the two thresholds."""
    logits = materialize(kept_logits(kept, net), "secret-logits")
    sums = _summed(logits.where(F.col("kind").isin(CLEAN, UNNAMED, SECRET_NAMED)), _losses)
    total = np.array([sums[i] for i in range(len(sums))], np.float64).reshape(2, -1)
    n, total = total[:, -1], total / FINE
    target = 1 / (n[0] + 2), (n[1] + 1) / (n[1] + 2)  # so that parted labels don't ask for certainty
    weigh = (1 - share) * n.sum() / n[0], share * n.sum() / n[1]

    def loss(i: int) -> float:
        """-log of the chance is log(1 + e^z), less z times the target."""
        scale, shift = GRID[i]
        return sum(weigh[y] * (total[y, i] - target[y] * (scale * total[y, -2] + shift * n[y])) for y in (0, 1))

    net.scale, net.shift = map(float, GRID[min(range(len(GRID)), key=loss)])
    least = []
    for kind in (SECRET_NAMED, BARE_SECRET):
        own = logits.where(F.col("kind") == kind)
        count = own.count()
        if not count:
            least.append(2.0)
            continue
        key = ranked(own, int((1 - RECALL) * count))
        below = logits.where(F.col("kind").isin(CLEAN, BARE_CLEAN) & (F.col("key") < key)).agg(F.max("key")).first()[0]
        high, low = logit_of(key), logit_of(key if below is None else below)
        high, half = net.scale * high + net.shift, net.scale * (high + low) / 2 + net.shift
        least.append(float(1 / (1 + np.exp(-min(high, max(half, np.log(CERTAIN / (1 - CERTAIN))))))))
    net.thresholds = (least[0], least[1])
    discard(logits)
    return net


def findings(docs: DataFrame) -> DataFrame:
    """label, hash, window, n: every labelled window, with how often a batch of texts has it. docs: text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter[tuple[int, str]] = Counter()
            for text in b.column(0).to_pylist():
                if text:
                    places = runs(text)
                    base = base_spans(text, places)
                    seen.update((1, window(text, value, last)) for _, _, last, value in base)
                    seen.update((0, window(text, *place)) for place in candidates(places, base))
            if seen:
                labels, windows = zip(*seen)
                hashes = [xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) - 2**63 for w in windows]
                cols = [pa.array(labels, pa.int32()), pa.array(hashes, pa.int64()), pa.array(windows, pa.string()), pa.array(list(seen.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["label", "hash", "window", "n"])

    return docs.mapInArrow(tidy(work), "label int, hash long, window string, n long")


def deal(own: DataFrame, shards: int) -> DataFrame:
    """shard, held, windows: a row for a shard's windows to learn from, and one for those kept. own: hash, label, window."""
    own = own.select(
        F.pmod(F.shiftright("hash", 8), F.lit(shards)).cast("int").alias("shard"), (F.pmod("hash", F.lit(HELD)) == 0).alias("held"),
        F.struct("hash", "label", "window").alias("one"),
    )
    return own.repartition(shards, "shard").groupBy("shard", "held").agg(F.sort_array(F.collect_list("one")).alias("windows"))


def train(found: DataFrame) -> Network | None:
    """The network that labelled findings give, as findings() has them; a window with both labels is a secret."""
    bound_batches(found.sparkSession)
    own = found.groupBy("hash", "window").agg(F.max("label").alias("label"), F.sum(F.col("label") * F.col("n")).alias("secrets"), F.sum("n").alias("n"))
    held = F.pmod("hash", F.lit(HELD)) == 0
    counts = {f"n{y}{int(h)}": F.count_if((F.col("label") == y) & (held == h)) for y in (0, 1) for h in (False, True)}
    own = materialize(own, "secret-windows", chars=F.sum(F.length("window")), secrets=F.sum("secrets"), all=F.sum("n"), **counts)
    c = own.counts
    if min(c["n00"] + c["n01"], c["n10"] + c["n11"]) < LEAST or not all(c[x] for x in counts):
        return None
    dealt = materialize(deal(own, math.ceil(c["chars"] / SHARD)), "secret-shards")
    discard(own)
    learned = c["n00"] + c["n10"]
    net = fit(dealt.where("not held"), (0.5 * learned / c["n00"], 0.5 * learned / c["n10"]))  # the classes weigh alike
    net = calibrated(dealt.where("held"), net, c["secrets"] / c["all"])
    discard(dealt)
    return net


def scan(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, base, added: findings as arrays of kind, first, last, text (the value), score (null for base ones)."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    bound_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_net = shared.value
        one = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("text", pa.string()), ("score", pa.float64())]))
        for b in batches:
            base_col, ids, texts = [], b.column(0), b.column(1).to_pylist()
            added_col: list[list[dict]] = [[] for _ in texts]
            held: list[tuple[int, int, int]] = []

            def add() -> None:
                windows = [window(texts[i], first, last) for i, first, last in held]  # noqa: B023
                scores = own_net.scores(windows)
                for at in np.flatnonzero(scores >= own_net.thresholds_of(windows)):
                    i, first, last = held[at]
                    found = {"kind": KINDS[3], "first": first, "last": last, "text": texts[i][first:last], "score": float(scores[at])}  # noqa: B023
                    added_col[i].append(found)  # noqa: B023
                held.clear()

            for i, text in enumerate(texts):
                places = runs(text or "")
                base = base_spans(text, places) if text else []
                base_col.append([{"kind": KINDS[k], "first": f, "last": e, "text": text[v:e], "score": None} for f, k, e, v in base])
                for place in candidates(places, base) if own_net is not None else ():
                    held.append((i, *place))
                    if len(held) == GROUP:
                        add()
            if held:
                add()
            yield pa.RecordBatch.from_arrays([ids, pa.array(base_col, one), pa.array(added_col, one)], ["doc_id", "base", "added"])

    spans = "array<struct<kind: string, first: long, last: long, text: string, score: double>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(work), f"doc_id long, base {spans}, added {spans}")


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bound_batches(spark)
    found = scan(docs, train(findings(docs.select("text"))))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    word = lambda s: F.concat_ws(":", s["kind"], s["first"], s["last"])
    joined = lambda c: F.array_join(F.transform(c, word), ",")
    # network spans touch no base span, so the first character decides their order
    order = F.array_sort(F.concat("base", "added"), lambda a, b: F.when(a["first"] != b["first"], F.signum(a["first"] - b["first"])).otherwise(0).cast("int"))
    return found.select(
        "doc_id", *[count(k) for k in KINDS[:3]], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(order).alias("spans"),
        F.size("added").cast("long").alias("n_network"),
    )

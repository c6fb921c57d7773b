"""Log-probabilities of texts by a log-bilinear model trained with noise-contrastive estimation."""

from __future__ import annotations

import hashlib
import io
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import textkernel as tk
from tarn.llm.blocks import blocked, by_shard, dictionary_rows, pack_longs, pack_numbers, pack_pieces, reassembled, rows_of, unpack_longs, unpack_numbers, unpack_pieces
from tarn.llm.common import file_system, fold, lean, shared_dir, table, write_file

#: Every word that the training texts hold so often has vectors of its own. All others share the
#: vector RARE and are told apart by their counts.
LEAST = 5
RARE = 0
#: Up to so many words are one level, whose normalisers are a table of all pairs of contexts. More
#: words have three: HEADS frequent ones and classes of words about as frequent, a class's parts,
#: and a part's words. Classes and parts have as many members, NODE at least, so that the work for
#: a token grows with the cube root of the words.
TABLE, HEADS, NODE = 2048, 128, 16
#: Counts of words that differ by less than this power of 2 are one band; words are numbered by it.
BAND = 1 / 8
DIMS, NOISE, INNER_NOISE, BATCH, RATE = 16, 16, 1, 8192, 0.08
#: Tokens that a copy of the model learns from, about. Copies follow from the tokens alone: more of them,
#: for idle cores, would each learn less, and scores would depend on the cluster.
COPY_TOKENS = 8_000_000
#: Copies whose rows of a file of the model are averaged by one task; of more copies, a task has a slice of a file.
MERGED = 16
#: Rows of vectors in a file of the model, contexts whose normalisers are one product, and tokens
#: whose contexts are held at once.
FILE_ROWS, CONTEXTS, GROUP = 1 << 14, 2048, 1 << 17
FOLDS, HELD_FOLD = 7, 2
#: The end of a text, a token that no word can equal.
END = b""


@dataclass(frozen=True)
class Model:
    """Vectors of context words, of predicted words, their biases, and the two places' weights."""

    context: np.ndarray
    target: np.ndarray
    bias: np.ndarray
    places: np.ndarray
    end: int

    @property
    def key(self) -> str:
        arrays = (self.context, self.target, self.bias, self.places)
        return hashlib.sha1(b"".join(a.tobytes() for a in arrays)).hexdigest()


def _cutter(texts: pa.Array, part: pa.RecordBatch):
    """A block's texts as places in its dictionary (0: END), with counts over its training texts."""
    hashes, starts, ends, docs, at, row = [], [], [], [], 0, 0
    whole = []
    for _, _, buf, offsets in tk.slices(texts):
        w = tk.split(buf, offsets)
        hashes.append(tk.hash_spans(buf, w.starts, w.ends, folded=True))
        starts.append(w.starts + at)
        ends.append(w.ends + at)
        docs.append(w.doc + row)
        whole.append(buf)
        at += len(buf)
        row += len(offsets) - 1
    h, s, e, d = (np.concatenate(x) for x in (hashes, starts, ends, docs))
    _, first, back = np.unique(h, return_index=True, return_inverse=True)
    order = np.argsort(first, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    data = np.concatenate(whole)
    pieces = [END] + [data[a:b].tobytes().lower() for a, b in zip(s[first[order]].tolist(), e[first[order]].tolist(), strict=True)]
    counts = np.bincount(d, minlength=len(texts)) + 1
    bounds = np.concatenate([[0], np.cumsum(counts)])
    positions = np.zeros(int(bounds[-1]), dtype=np.uint32)
    positions[np.arange(len(d)) + d] = rank[back]
    train = ~part.column(1).to_numpy(zero_copy_only=False).astype(bool)
    seen = np.bincount(positions[np.repeat(train, counts)], minlength=len(pieces))
    return positions, bounds, pieces, seen.astype(np.uint32)


def _bands(counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(counts, 1)) / BAND).astype(np.int64)


@dataclass
class Layout:
    """Numbers of words: RARE, the end, then band after band from the frequent to the rare.

    ``first``: the number of each (band, shard)'s first word. ``edges``: that of each band's, from
    the most frequent band, and ``of`` these bands. Words up to ``heads`` are outcomes of the first
    level; ``size`` words from there on are a part, and ``size`` parts a class, an outcome of the
    first level as well.
    """

    words: int
    heads: int
    size: int
    edges: np.ndarray
    of: np.ndarray
    first: dict[int, np.ndarray]
    rare: int
    ends: int

    @property
    def parts(self) -> int:
        return -(-(self.words - self.heads) // self.size)

    @property
    def classes(self) -> int:
        return -(-self.parts // self.size)

    @property
    def outcomes(self) -> int:
        return self.heads + self.classes

    @property
    def rows(self) -> int:
        """Rows of the model: words, parts, classes, and one for the weights of the two places."""
        return self.words + self.parts + self.classes + 1

    @cached_property
    def counts(self) -> np.ndarray:
        """About the count of every word: RARE's and the end's own, the others' by their band."""
        inner = np.arange(2, self.words)
        at = np.searchsorted(self.edges, inner, side="right") - 1
        return np.concatenate([[self.rare + 1.0, self.ends + 1.0], 2 ** ((self.of[at] + 0.5) * BAND) if len(inner) else []])

    @cached_property
    def shares(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the outcomes of the first level, of every part in its class and every word in its part."""

        def within(members):
            at = np.arange(0, len(members), self.size)
            sums = np.add.reduceat(members, at) if len(members) else members
            return sums, members / np.repeat(sums, np.diff([*at, len(members)])) if len(members) else members

        counts = self.counts
        parts, words = within(counts[self.heads :])
        classes, parts = within(parts)
        outer = np.concatenate([counts[: self.heads], classes])
        return outer / outer.sum(), parts, words


def layout(by_shard_: dict[int, list[int]], rare: int, ends: int) -> Layout:
    """The numbers of words from the words of each shard by band."""
    width = max([len(b) for b in by_shard_.values()], default=0)
    shards = sorted(by_shard_)
    counts = np.array([[*by_shard_[k], *[0] * (width - len(by_shard_[k]))] for k in shards], dtype=np.int64).reshape(len(shards), width)
    down = counts[:, ::-1].T
    first = 2 + np.cumsum(down.reshape(-1)).reshape(down.shape) - down
    words = 2 + int(counts.sum())
    edges, of = first[:, 0] if len(shards) else np.zeros(0, np.int64), np.arange(width)[::-1]
    heads = words if words <= TABLE else max(2, int(edges[edges <= HEADS].max(initial=2)))
    size = max(NODE, int(np.ceil(np.cbrt(words))))
    return Layout(words, heads, size, edges, of, {k: first[::-1, i] for i, k in enumerate(shards)}, rare, ends)


def _numbers(plan: Layout, shard: int, pieces: list[bytes], counts: np.ndarray) -> np.ndarray:
    """The numbers of a shard's words."""
    out = np.full(len(pieces), RARE, dtype=np.int64)
    mine = np.flatnonzero((counts >= LEAST) & np.fromiter((p != END for p in pieces), dtype=bool, count=len(pieces)))
    band = _bands(counts[mine])
    order = np.argsort(band, kind="stable")
    band = band[order]
    out[mine[order]] = plan.first[shard][band] + np.arange(len(band)) - np.searchsorted(band, band)
    if END in pieces:
        out[pieces.index(END)] = 1
    return out


def _totals(blocks: DataFrame) -> DataFrame:
    """A row per shard: its pieces and their counts in all training texts, and its words by band."""

    def run(batches):
        def out(shard, counts):
            held = {p: c for p, c in counts.items() if c}
            bands = np.bincount(_bands(np.array([c for p, c in held.items() if p != END and c >= LEAST], dtype=np.int64)))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int64()),
                    pa.array([pack_pieces(list(held))], pa.binary()),
                    pa.array([pack_longs(np.fromiter(held.values(), dtype=np.int64, count=len(held)))], pa.binary()),
                    pa.array([len(held)], pa.int64()),
                    pa.array([sum(held.values())], pa.int64()),
                    pa.array([held.get(END, 0)], pa.int64()),
                    pa.array([sum(c for p, c in held.items() if p != END and c >= LEAST)], pa.int64()),
                    pa.array([bands.tolist()], pa.list_(pa.int64())),
                ],
                names=["key", "pieces", "counts", "kinds", "tokens", "ends", "known", "bands"],
            )

        now, counts = None, {}
        for row in rows_of(batches):
            if row["key"] != now:
                if now is not None:
                    yield out(now, counts)
                now, counts = row["key"], {}
            for piece, n in zip(unpack_pieces(row["pieces"]), unpack_numbers(row["counts"]).tolist(), strict=True):
                counts[piece] = counts.get(piece, 0) + n
        if now is not None:
            yield out(now, counts)

    rows = by_shard(dictionary_rows(blocks).select("key", "pieces", "counts"))
    return table(rows.mapInArrow(lean(run), "key long, pieces binary, counts binary, kinds long, tokens long, ends long, known long, bands array<long>"))


def _returned(blocks: DataFrame, totals: DataFrame, plan: Layout) -> DataFrame:
    """For each block and shard the global counts and the numbers of its pieces."""

    def run(batches):
        known: dict[bytes, tuple[int, int]] = {}
        for row in rows_of(batches):
            pieces = unpack_pieces(row["pieces"])
            if row["block"] is None:
                counts = unpack_longs(row["counts"])
                known = dict(zip(pieces, zip(counts.tolist(), _numbers(plan, row["key"], pieces, counts).tolist(), strict=True), strict=True))
                continue
            both = [known.get(p, (0, 1 if p == END else RARE)) for p in pieces]
            counts = np.fromiter((c for c, _ in both), dtype=np.int64, count=len(pieces))
            words = np.fromiter((w for _, w in both), dtype=np.uint32, count=len(pieces))
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([row["places"]], pa.binary()), pa.array([pack_longs(counts)], pa.binary()), pa.array([pack_numbers(words)], pa.binary())], names=["block", "places", "counts", "words"])

    first = totals.select(F.lit(None).cast("long").alias("block"), "key", "pieces", F.lit(None).cast("binary").alias("places"), "counts")
    rows = by_shard(first.unionByName(dictionary_rows(blocks).select("block", "key", "pieces", "places", F.lit(None).cast("binary").alias("counts"))), "block")
    return rows.mapInArrow(lean(run), "block long, places binary, counts binary, words binary")


def _contexts(words: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The two words before each token; before the text there are ends."""
    padded = np.concatenate([[end, end], words])
    return padded[1:-1], padded[:-2]


def _runs(values: np.ndarray) -> zip:
    """(first, end) of each run of equal values."""
    cut = (np.flatnonzero(np.diff(values)) + 1).tolist()
    return zip([0, *cut], [*cut, len(values)], strict=True)


def _bounds(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value the first place and the end of its run of equal values."""
    cut = np.concatenate([[0], np.flatnonzero(np.diff(values)) + 1, [len(values)]])
    return np.repeat(cut[:-1], np.diff(cut)), np.repeat(cut[1:], np.diff(cut))


class _Trainer:
    """Adagrad steps on the noise-contrastive objective; a batch's noise words serve all its tokens."""

    def __init__(self, model: Model, share: np.ndarray, seed: int):
        self.params = [model.context.copy(), model.target.copy(), model.bias.copy(), model.places.copy()]
        self.grown = [np.ones(len(p), dtype=np.float32) for p in self.params]
        self.mark, self.place = np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64)
        self.share, self.draw = share, np.random.Generator(np.random.PCG64(seed))
        self.noise_log = np.log(NOISE * np.maximum(share, 1e-12)).astype(np.float32)
        self.upto = np.cumsum(share)

    def step(self, word: np.ndarray, near: np.ndarray, far: np.ndarray, inner: tuple[tuple[np.ndarray, ...], ...] = ()) -> None:
        """``inner``: for each later level, which the last tokens of the batch have, their outcomes, noise of
        the same class or part, and the logarithms of the shares of the outcomes and of the noise."""
        context, target, bias, places = self.params
        noise = np.minimum(np.searchsorted(self.upto, self.draw.random(NOISE) * self.upto[-1]), len(self.share) - 1)
        rn, rf = context.take(near, axis=0), context.take(far, axis=0)
        predicted = rn * places[0] + rf * places[1]
        at = np.concatenate([word, noise, *(x.reshape(-1) for one, others, *_ in inner for x in (one, others))])
        d, low = np.empty((len(at), target.shape[1] + 1), dtype=np.float32), len(word) + NOISE  # slopes of vectors and biases
        right, wrong = target.take(word, axis=0), target.take(noise, axis=0)
        up = 1 / (1 + np.exp(np.einsum("ij,ij->i", predicted, right) + bias[word] - self.noise_log[word]))
        down = -1 / (1 + np.exp(-(predicted @ wrong.T + bias[noise] - self.noise_log[noise])))
        moved = down @ wrong
        moved += np.multiply(up[:, None], right, out=right)
        np.multiply(up[:, None], predicted, out=d[: len(word), :-1])
        d[: len(word), -1] = up
        d[len(word) : low, :-1], d[len(word) : low, -1] = down.T @ predicted, down.sum(axis=0)
        for one, others, one_log, others_log in inner:
            if not len(one):
                continue
            mine, right, wrong = predicted[-len(one) :], target.take(one, axis=0), target.take(others, axis=0)
            up = 1 / (1 + np.exp(np.einsum("ij,ij->i", mine, right) + bias[one] - one_log - np.float32(np.log(INNER_NOISE))))
            down = -1 / (1 + np.exp(-(np.einsum("ikj,ij->ik", wrong, mine) + bias[others] - others_log - np.float32(np.log(INNER_NOISE)))))
            moved[-len(one) :] += up[:, None] * right + np.einsum("ik,ikj->ij", down, wrong)
            for slopes in (up[:, None], down):
                here = d[low : low + slopes.size].reshape(*slopes.shape, -1)
                np.multiply(slopes[:, :, None], mine[:, None, :], out=here[:, :, :-1])
                here[:, :, -1] = slopes
                low += slopes.size
        keys, d = self._sums(d, at)
        self._move(1, keys, d[:, :-1])
        self._move(2, keys, d[:, -1])
        d_places = np.stack([(moved * rn).sum(axis=0), (moved * rf).sum(axis=0)])
        self._move(0, *self._sums(np.concatenate([moved * places[0], moved * places[1]]), np.concatenate([near, far])))
        self._move(3, np.arange(2), d_places)

    def _sums(self, rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of ``at`` and the sums of their rows."""
        if len(self.mark) < len(self.params[1]):
            self.mark, self.place = np.zeros(len(self.params[1]), dtype=bool), np.zeros(len(self.params[1]), dtype=np.int64)
        self.mark[at] = True
        keys, width = np.flatnonzero(self.mark), rows.shape[1]
        self.mark[keys] = False
        self.place[keys] = np.arange(0, len(keys) * width, width)
        out = np.zeros(len(keys) * width, dtype=np.float32)
        np.add.at(out, (self.place.take(at)[:, None] + np.arange(width)).reshape(-1), rows.astype(np.float32, copy=False).reshape(-1))
        return keys, out.reshape(-1, width)

    def _move(self, k: int, at: np.ndarray, d: np.ndarray) -> None:
        """A step whose length follows the slopes that each row has had."""
        grown = self.grown[k].take(at) + (d * d if d.ndim == 1 else np.einsum("ij,ij->i", d, d) / np.float32(d.shape[1]))
        self.grown[k][at] = grown
        size = np.float32(RATE) / np.sqrt(grown)
        moved = self.params[k].take(at, axis=0)
        moved += d * (size if d.ndim == 1 else size[:, None])
        self.params[k][at] = moved


def _start(plan: Layout, rows: np.ndarray) -> np.ndarray:
    """The first vectors (context, target, bias) of rows of the model: noise that the row decides."""
    seeds = tk.mix(np.asarray(rows, dtype=np.uint64)[:, None] * np.uint64(2 * DIMS) + np.arange(1, 2 * DIMS + 1, dtype=np.uint64))
    values = ((seeds >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24) - np.float32(0.5)) * np.float32(0.1 * 12**0.5)
    outer, parts, words = plan.shares
    shares = np.concatenate([outer[: plan.heads], words, parts, outer[plan.heads :], [1.0]])
    made = np.hstack([values, np.log(shares[rows])[:, None].astype(np.float32)])
    made[np.asarray(rows) == plan.rows - 1] = 1
    return made


def _outer_rows(plan: Layout) -> np.ndarray:
    """The model's rows of the outcomes of the first level."""
    return np.concatenate([np.arange(plan.heads), np.arange(plan.words + plan.parts, plan.rows - 1)])


class _Copy:
    """A partition's copy of the rows that its texts need."""

    def __init__(self, plan: Layout, seed: int):
        self.plan, self.rows = plan, _outer_rows(plan)
        self.slots = np.full(plan.rows, -1, dtype=np.int32)
        self.slots[self.rows] = np.arange(len(self.rows))
        first = _start(plan, self.rows)
        self.seen = np.full(len(self.rows), 1e-3)
        self.trainer = _Trainer(Model(first[:, :DIMS], first[:, DIMS : 2 * DIMS], first[:, 2 * DIMS], np.ones((2, DIMS), np.float32), 1), plan.shares[0], seed)

    def _add(self, rows: np.ndarray) -> None:
        new = np.unique(rows[self.slots[rows] < 0])
        if not len(new):
            return
        self.slots[new] = len(self.rows) + np.arange(len(new))
        self.rows = np.concatenate([self.rows, new])
        first = _start(self.plan, new)
        for k, part in enumerate((first[:, :DIMS], first[:, DIMS : 2 * DIMS], first[:, 2 * DIMS])):
            self.trainer.params[k] = np.concatenate([self.trainer.params[k], part])
            self.trainer.grown[k] = np.concatenate([self.trainer.grown[k], np.ones(len(part), dtype=np.float32)])
        self.seen = np.concatenate([self.seen, np.full(len(new), 1e-3)])

    def learn(self, words: np.ndarray, near: np.ndarray, far: np.ndarray) -> None:
        plan, trainer = self.plan, self.trainer
        part = (words - plan.heads) // plan.size
        later = words >= plan.heads
        self._add(np.concatenate([words, near[:1], far[:1], plan.words + part[later]]))
        n, slot = len(words), self.slots[words].astype(np.int64)
        near, far = self.slots[near], self.slots[far]
        outer = np.where(later, plan.heads + part // plan.size, slot)
        # noise of a class or part are the outcomes of its other tokens here, which have its own shares
        tokens = np.flatnonzero(later)
        tokens = tokens[np.argsort(part[tokens], kind="stable")]
        of = part[tokens]
        levels = [(of // plan.size, self.slots[plan.words + of].astype(np.int64), np.log(plan.shares[1][of])), (of, slot[tokens], np.log(plan.shares[2][words[tokens] - plan.heads]))]
        levels = [(*_bounds(node), own, log.astype(np.float32)) for node, own, log in levels]
        self.seen += np.bincount(np.concatenate([slot, outer[later], levels[0][2]]), minlength=len(self.seen))
        place = np.zeros(n, dtype=np.int64)
        place[tokens] = np.arange(len(tokens))
        order = trainer.draw.permutation(n)
        for at in range(0, n, BATCH):
            batch = order[at : at + BATCH]
            last = later[batch]
            batch = np.concatenate([batch[~last], batch[last]])
            p, inner = place[batch[np.count_nonzero(~last) :]], []
            for low, high, own, log in levels:
                drawn = low[p, None] + (trainer.draw.random((len(p), INNER_NOISE)) * (high - low)[p, None]).astype(np.int64)
                inner.append((own[p], own[drawn], log[p], log[drawn]))
            trainer.step(outer[batch], near[batch], far[batch], tuple(inner))


def _trained(texts: DataFrame, plan: Layout, seed: int, copies: int) -> str:
    """The folder of the model after one pass over all training texts.

    ``copies`` tasks or fewer train a copy of the rows that their texts need; copies are averaged
    by word. A copy's row counts as often as its word or class occurs in the copy's texts. Rows
    meet by the file of the model they are of, or by the slice of it, of which there are so many
    that a task reads about MERGED copies of a file. Means of slices, one of each row however many
    the copies are, cross the network once more to the task that writes their file; the model never
    is in one place.
    """
    path = shared_dir(texts.sparkSession)
    width, slices = 2 * DIMS + 1, -(-copies // MERGED)
    per_slice = -(-FILE_ROWS // slices)

    def packed(k, part, rows, weight, values):
        fields = (pack_numbers(rows), weight.astype("<f4").tobytes(), values.astype("<f2").tobytes())
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([part], pa.int64()), *(pa.array([x], pa.binary()) for x in fields)], names=["file", "part", "rows", "weights", "values"])

    def run(batches):
        copy, held, size = _Copy(plan, seed + TaskContext.get().partitionId()), [], 0
        for batch in batches:
            for text in batch.column(0):
                words = unpack_numbers(text.as_py()).astype(np.int64)
                held.append((words, *_contexts(words, 1)))
                size += len(words)
                if size >= 16 * BATCH:
                    copy.learn(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, size = [], 0
        if size:
            copy.learn(*(np.concatenate(x) for x in zip(*held, strict=True)))
        if copy.seen.sum() < 1:
            return
        context, target, bias, places = copy.trainer.params
        last = np.append(places.reshape(-1), 0).astype(np.float32)
        rows = np.append(copy.rows, plan.rows - 1)
        flat = np.vstack([np.hstack([context, target, bias[:, None]]), last])
        weight = np.append(copy.seen, copy.seen.sum())
        order = np.argsort(rows, kind="stable")
        key = rows[order] // FILE_ROWS * slices + rows[order] % FILE_ROWS // per_slice
        for lo, hi in _runs(key):
            part = order[lo:hi]
            yield packed(*divmod(int(key[lo]), slices), rows[part], weight[part], flat[part])

    def means(batches, keys):
        """(file, part, rows, weights, means) of the rows with equal ``keys``, the first columns."""

        def out():
            at = np.flatnonzero(weight)
            return *now, at + now[0] * FILE_ROWS, weight[at], total[at] / weight[at, None]

        now = None
        for row in rows_of(batches):
            here = (row["file"], row["part"]) if keys == 2 else (row["file"], 0)
            if here != now:
                if now is not None:
                    yield out()
                now = here
                n = min(FILE_ROWS, plan.rows - now[0] * FILE_ROWS)
                total, weight = np.zeros((n, width)), np.zeros(n)
            at = unpack_numbers(row["rows"]).astype(np.int64) - now[0] * FILE_ROWS
            w = np.frombuffer(row["weights"], dtype="<f4").astype(np.float64)
            total[at] += np.frombuffer(row["values"], dtype="<f2").astype(np.float64).reshape(-1, width) * w[:, None]
            weight[at] += w
        if now is not None:
            yield out()

    def sliced(batches):
        for one in means(batches, 2):
            yield packed(*one)

    def written(batches):
        for k, _, rows, _, values in means(batches, 1):
            made = _start(plan, np.arange(k * FILE_ROWS, min((k + 1) * FILE_ROWS, plan.rows)))
            made[rows - k * FILE_ROWS] = values
            data = io.BytesIO()
            np.save(data, made.astype(np.float32))
            write_file(path, f"{k}.npy", data.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64())], names=["file"])

    schema = "file long, part long, rows binary, weights binary, values binary"
    rows = texts.where("not held_out").select("words").coalesce(max(1, copies)).mapInArrow(lean(run), schema)
    if slices > 1:
        rows = rows.repartition("file", "part").sortWithinPartitions("file", "part").mapInArrow(lean(sliced), schema)
    rows.repartition("file").sortWithinPartitions("file").mapInArrow(lean(written), "file long").count()
    return path


class Vectors:
    """Rows of a model's files, mapped into memory where the shared folder is mounted, else read into it."""

    def __init__(self, path: str, plan: Layout):
        self.plan, self.files, self.mark, self.place = plan, {}, None, None
        self.system, self.folder = file_system(path)
        self.places = self.rows(np.array([plan.rows - 1]))[0, : 2 * DIMS].reshape(2, DIMS)
        outer = self.rows(_outer_rows(plan))
        self.outer = outer[:, DIMS:].T.copy()
        self.flat = _tables(Model(outer[:, :DIMS], outer[:, DIMS : 2 * DIMS], outer[:, 2 * DIMS], self.places, 1)) if not plan.classes else None

    def _file(self, k: int) -> np.ndarray:
        """A file's rows; one that was not written has no word that any text taught."""
        name = f"{self.folder}/{k}.npy"
        if self.system.get_file_info(name).type != pafs.FileType.File:
            return _start(self.plan, np.arange(k * FILE_ROWS, min((k + 1) * FILE_ROWS, self.plan.rows)))
        if isinstance(self.system, pafs.LocalFileSystem):
            return np.asarray(np.load(name, mmap_mode="r"))  # slices of a memmap itself are slow to make
        with self.system.open_input_stream(name, compression=None) as data:
            return np.load(io.BytesIO(data.read()))

    def rows(self, at: np.ndarray) -> np.ndarray:
        """Rows in ascending order."""
        out = np.empty((len(at), 2 * DIMS + 1), dtype=np.float32)
        for lo, hi in _runs(at // FILE_ROWS):
            k = int(at[lo]) // FILE_ROWS
            if k not in self.files:
                self.files[k] = self._file(k)
            np.take(self.files[k], at[lo:hi] - k * FILE_ROWS, axis=0, out=out[lo:hi], mode="clip")
        return out

    def block(self, first: int, last: int) -> np.ndarray:
        """Rows that follow one another."""
        k = first // FILE_ROWS
        if k in self.files and last <= (k + 1) * FILE_ROWS:
            return self.files[k][first - k * FILE_ROWS : last - k * FILE_ROWS]
        return self.rows(np.arange(first, last))

    def log_probabilities(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """Natural log-probabilities of the tokens of texts; the normalisers are those of the texts' contexts."""
        if self.flat is not None:
            return [log_probabilities(self.flat, 1, t) for t in texts]
        if not texts:
            return []
        plan = self.plan
        near, far = (np.concatenate(x) for x in zip(*(_contexts(t, 1) for t in texts), strict=True))
        words = np.concatenate(texts)
        kinds, place = self._kinds(words)
        known = self.rows(kinds)
        # the last number of a context is 1, which takes the bias
        first, second = np.zeros((2, len(kinds), DIMS + 1), dtype=np.float32)
        first[:, :DIMS], second[:, :DIMS] = known[:, :DIMS] * self.places[0], known[:, :DIMS] * self.places[1]
        first[:, DIMS] = 1
        target = np.ascontiguousarray(known[:, DIMS:])
        part = np.where(words < plan.heads, -1, (words - plan.heads) // plan.size)
        out = np.empty(len(words))
        order = np.argsort(part, kind="stable")
        for at in range(0, len(order), GROUP):
            group = order[at : at + GROUP]
            word, node = words[group], part[group]
            predicted = first.take(place[near[group]], axis=0)
            predicted += second.take(place[far[group]], axis=0)
            outer = np.where(node < 0, word, plan.heads + node // plan.size)
            made = np.empty(len(group))
            for lo in range(0, len(group), CONTEXTS):
                made[lo : lo + CONTEXTS] = _picked(predicted[lo : lo + CONTEXTS] @ self.outer, outer[lo : lo + CONTEXTS])
            later = int(np.searchsorted(node, 0))
            if later < len(group):
                made[later:] += self._inner(predicted[later:], target.take(place[word[later:]], axis=0), node[later:])
            out[group] = made
        return np.split(out, np.cumsum([len(t) for t in texts])[:-1])

    def _kinds(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words of texts and of their contexts, once and ascending, and the place of each word there."""
        if self.mark is None:
            self.mark, self.place = np.zeros(self.plan.words, dtype=bool), np.zeros(self.plan.words, dtype=np.int32)
        self.mark[words] = True
        self.mark[1] = True
        kinds = np.flatnonzero(self.mark)
        self.mark[kinds] = False
        self.place[kinds] = np.arange(len(kinds))
        return kinds, self.place

    def _inner(self, predicted: np.ndarray, target: np.ndarray, part: np.ndarray) -> np.ndarray:
        """The log-probabilities of parts in their classes and words in their parts, tokens by ascending part."""
        plan = self.plan
        of = part // plan.size
        out = np.empty(len(part))
        for lo, hi in _runs(of):
            low = plan.words + int(of[lo]) * plan.size
            inner = self.block(low, min(low + plan.size, plan.words + plan.parts))[:, DIMS:].T
            for a in range(lo, hi, CONTEXTS):
                b = min(a + CONTEXTS, hi)
                out[a:b] = _picked(predicted[a:b] @ inner, plan.words + part[a:b] - low)
        # parts are many and have few tokens each: what can be done for all of them at once is
        total, ones = np.empty(len(part), dtype=np.float32), np.ones(plan.size, dtype=np.float32)
        with np.errstate(over="ignore"):
            for lo, hi in _runs(part):
                low = plan.heads + int(part[lo]) * plan.size
                inner = self.block(low, min(low + plan.size, plan.words))[:, DIMS:].T
                for a in range(lo, hi, CONTEXTS):
                    b = min(a + CONTEXTS, hi)
                    scores_ = predicted[a:b] @ inner
                    np.exp(scores_, out=scores_)
                    np.matmul(scores_, ones[: scores_.shape[1]], out=total[a:b])
        with np.errstate(divide="ignore"):
            norm = np.log(total.astype(np.float64))
        for k in np.flatnonzero(_beyond(total)).tolist():
            low = plan.heads + int(part[k]) * plan.size
            norm[k] = _log_sum(predicted[k : k + 1] @ self.block(low, min(low + plan.size, plan.words))[:, DIMS:].T)[0]
        return out + np.einsum("ij,ij->i", predicted, target) - norm


def _beyond(total: np.ndarray) -> np.ndarray:
    """Sums out of the range of single precision."""
    return (total < 1e-30) | (total > 1e30)


def _log_sum(scores_: np.ndarray) -> np.ndarray:
    """The logarithm of the sum of exponentials of each row, whatever their range."""
    top = scores_.max(axis=1).astype(np.float64)
    return top + np.log(np.exp(scores_ - top[:, None]).sum(axis=1))


def _picked(scores_: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log-probability of a place of each row."""
    own = scores_[np.arange(len(at)), at].astype(np.float64)
    with np.errstate(over="ignore"):
        total = (np.exp(scores_) @ np.ones(scores_.shape[1], scores_.dtype)).astype(np.float64)
    far = np.flatnonzero(_beyond(total))
    if len(far):
        total[far] = 1
        own[far] -= _log_sum(scores_[far])
    return own - np.log(total)


_open: dict[str, Vectors] = {}


_made: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _tables(model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores by (near word, word) and by (far word, word), and log normalisers by (near, far).

    A worker keeps the tables of its last model for its next tasks.

    As exp of a sum of two scores is a product, all normalisers are one matrix product.
    """
    if model.key in _made:
        return _made[model.key]
    near = (model.context * model.places[0]) @ model.target.T
    far = (model.context * model.places[1]) @ model.target.T + model.bias
    top_near, top_far = near.max(axis=1), far.max(axis=1)
    product = np.exp(near - top_near[:, None]) @ np.exp(far - top_far[:, None]).T
    with np.errstate(divide="ignore"):
        norm = np.log(product) + top_near[:, None] + top_far[None, :]
    for a, b in np.argwhere(product < 1e-30):
        both = near[a].astype(np.float64) + far[b]
        norm[a, b] = both.max() + np.log(np.exp(both - both.max()).sum())
    _made.clear()
    _made[model.key] = near, far, norm
    return near, far, norm


def log_probabilities(tables: tuple[np.ndarray, np.ndarray, np.ndarray], end: int, words: np.ndarray) -> np.ndarray:
    """Natural log-probabilities of the tokens of one text over the vocabulary."""
    near, far, norm = tables
    a, b = _contexts(words, end)
    return near[a, words].astype(np.float64) + far[b, words] - norm[a, b]


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text.

    Texts are lower-cased (A-Z) and split into words, then one end, which counts as a token; a
    null text is an empty one. Texts whose CRC-32 fold is HELD_FOLD teach nothing. base_score
    adds log10((c + 1) / (N + V + 1)) with the counts c of all training tokens N of V kinds.
    score is the model's log10 probability of the text: a token is predicted from the two tokens
    before it, as a frequent word, or as a class of words about as frequent, a part of it and a word of that.
    Words seen less than LEAST times are the word RARE there, and have besides their share of the
    rare counts, each increased by one, with one more for all unseen ones.

    Every word is counted: words meet by a hash in shards and return their counts to the blocks
    of texts that hold them. Every training text is learned from, in one pass, by one copy of the
    model for each COPY_TOKENS tokens. Repeated rows are scored and learned from as rows; without
    training texts scores are uniform. Very long texts are scored and learned from whole, a block of
    their own. An empty table gives an empty one. Extra columns do not matter, whatever their names.
    """
    rows = docs.select(F.col(id_col), (fold(id_col, FOLDS) == HELD_FOLD).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    keep = [id_col, "held_out"]
    blocks = table(blocked(rows, keep, "text", _cutter))
    totals = _totals(blocks)
    found = totals.select("key", "kinds", "tokens", "ends", "known", "bands").collect()
    n, kinds, ends, known_tokens = (sum(r[k] for r in found) for k in ("tokens", "kinds", "ends", "known"))
    plan = layout({r["key"]: r["bands"] for r in found}, n - ends - known_tokens, ends)
    # the rare kinds' counts increased by one, and one for the unseen
    rare = n - ends - known_tokens + kinds - (ends > 0) - (plan.words - 2) + 1

    def joined(parts, positions):
        places = [np.cumsum(unpack_numbers(p["places"])) for p in parts]
        at = np.concatenate(places).astype(np.int64)
        seen, word = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.uint32)
        seen[at] = np.concatenate([unpack_longs(p["counts"]) for p in parts])
        word[at] = np.concatenate([unpack_numbers(p["words"]) for p in parts])
        base = np.log10((seen + 1) / (n + kinds + 1))
        share = np.where(word == RARE, np.log10((seen + 1) / rare), 0.0)
        return [
            np.array([len(p) for p in positions], dtype=np.int64),
            np.array([int((seen[p] > 0).sum()) for p in positions], dtype=np.int64),
            np.array([base[p].sum() for p in positions]),
            np.array([share[p].sum() for p in positions]),
            pa.array([pack_numbers(word[p]) for p in positions], pa.binary()),
        ]

    texts = table(reassembled(blocks.where("key >= 0"), _returned(blocks, totals, plan), keep, "n_tokens long, n_known long, base_score double, rare_score double, words binary", joined))

    path = _trained(texts, plan, 0, max(1, -(-int(n) // COPY_TOKENS)))

    def scored(batches):
        if path not in _open:
            _open.clear()
            _open[path] = Vectors(path, plan)
        for batch in batches:
            made = _open[path].log_probabilities([unpack_numbers(packed.as_py()).astype(np.int64) for packed in batch.column(5)])
            score = np.array([x.sum() / np.log(10) for x in made], dtype=np.float64) + batch.column(6).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(score)], names=[*batch.schema.names[:5], "score"])

    known = texts.select(*keep, "n_tokens", "n_known", "base_score", "words", "rare_score")
    schema = known.select(*known.columns[:5]).schema.add("score", "double")
    return known.mapInArrow(lean(scored), schema).withColumn("train_tokens", F.lit(int(n)).cast("long"))

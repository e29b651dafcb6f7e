"""Interpolated modified Kneser-Ney models over the characters of words, for one or several classes of text.

A word is read as a start mark, its characters and an end mark; an n-gram never crosses words. The counts are tables in
Spark: n-grams are keyed by a 64-bit hash and carry the hashes of the n-gram without its last character (its context) and
without its first (what it backs off to). Continuation counts, context totals and interpolation are aggregates and joins on
these keys, spread over all tasks. Orders up to `shared` are counted over all classes together, so rare sequences back off
to the same figures in every class.

All n-grams are kept, so discounts and continuation counts are those of the whole text. The finished table is written to
the shared folder by the tasks that made it (`fit_shards`) and mapped into memory by those that score; `fit` gives a small one on
the driver.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.text import Places, small_batches
from cohortlens.session import drop_stored, scratch_path, ship_package, stored

_BASE = np.uint64(0x100000001B3)
_START, _END, _LONGEST = "\x02", "\x03", 32
_POOLED, _UNSEEN = -1, 1e-6
_SHARD = 1 << 18  # n-grams in a file of the stored model, about


def parts(words: list[str]) -> list[str]:
    """The words; one longer than 32 characters in stretches of 32, each read as a word."""
    if max(map(len, words), default=0) <= _LONGEST:
        return words
    return [w[i:i + _LONGEST] for w in words for i in range(0, len(w), _LONGEST)]


def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by falling length, lengths with marks, and hashes of all beginnings, in that order."""
    n = np.fromiter(map(len, words), np.int64, len(words)) + 2
    order = np.argsort(-n, kind="stable")
    marked, n = [_START + words[i] + _END for i in order.tolist()], n[order]
    width = int(n.max(initial=0))
    code = np.zeros((len(words), width), np.uint64)
    code[np.arange(width) < n[:, None]] = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    prefix = np.zeros((len(words), width + 1), np.uint64)
    for i in range(width):
        prefix[:, i + 1] = prefix[:, i] * _BASE + code[:, i]
    return order, n, prefix


def _power(k: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), k, 1 << 64))


def count_words(texts: DataFrame, words_of: Callable[[str], list[str]]) -> DataFrame:
    """texts: cls int, text. Gives cls, word, n."""
    ship_package(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Counter[str]] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for cls, own in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), cls, np.int32)), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())],
                    ["cls", "word", "n"])

        for batch in small_batches(batches, "text"):
            for cls, text in zip(batch.column("cls").to_pylist(), batch.column("text").to_pylist()):
                held.setdefault(cls, Counter()).update(parts(words_of(text or "")))
            if sum(map(len, held.values())) > 500_000:
                yield from emit()
                held.clear()
        yield from emit()

    return texts.mapInArrow(count, "cls int, word string, n long").groupBy("cls", "word").agg(F.sum("n").alias("n"))


def count_grams(words: DataFrame, order: int, whole: bool = False) -> DataFrame:
    """cls, k, g, pre, suf, start (begins a word), n of every n-gram up to `order`; with `whole` also, as k = order + 1, of the
    longer beginnings of words."""
    names = ["cls", "k", "g", "pre", "suf", "start", "n"]

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls_all, text, n_all = batch.column("cls").to_numpy(), batch.column("word").to_pylist(), batch.column("n").to_numpy()
            for cls in np.unique(cls_all):
                mine = np.flatnonzero(cls_all == cls)
                by, length, prefix = _matrix([text[i] for i in mine])
                weight = n_all[mine][by].astype(float)
                for k in range(1, order + 1 + whole):
                    found = []
                    for end in range(max(2, k), prefix.shape[1]):
                        rows = int(np.searchsorted(-length, -end, side="right"))
                        if k > order:
                            suf = prefix[:rows, end] - prefix[:rows, end - order] * _power(order)
                            found.append((prefix[:rows, end], prefix[:rows, end - 1], suf, np.full(rows, True), weight[:rows]))
                            continue
                        g = prefix[:rows, end] - prefix[:rows, end - k] * _power(k)
                        pre = prefix[:rows, end - 1] - prefix[:rows, end - k] * _power(k - 1)
                        suf = prefix[:rows, end] - prefix[:rows, end - k + 1] * _power(k - 1)
                        found.append((g, pre, suf, np.full(rows, end == k), weight[:rows]))
                    if not found:
                        continue
                    g, pre, suf, start, w = (np.concatenate(x) for x in zip(*found))
                    g, first, back = np.unique(g, return_index=True, return_inverse=True)
                    cols = [np.full(len(g), cls, np.int32), np.full(len(g), k, np.int32), g.view(np.int64), pre[first].view(np.int64),
                            suf[first].view(np.int64), start[first], np.bincount(back, w).astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

    return words.mapInArrow(grams, "cls int, k int, g long, pre long, suf long, start boolean, n long").groupBy("cls", "k", "g").agg(
        F.max("pre").alias("pre"), F.max("suf").alias("suf"), F.max("start").alias("start"), F.sum("n").alias("n"))


def _discounts(level: DataFrame) -> dict[int, tuple[float, float, float]]:
    """Modified Kneser-Ney discounts of counts 1, 2 and more, per class, from the numbers of n-grams counted 1 to 4 times."""
    rows = level.where("a <= 4").groupBy("cls", "a").agg(F.count(F.lit(1)).alias("n")).collect()
    out = {}
    for cls in {r["cls"] for r in level.select("cls").distinct().collect()}:
        n = [sum(r["n"] for r in rows if r["cls"] == cls and r["a"] == i) for i in range(1, 5)]
        if not (n[0] and n[1]):
            out[cls] = (0.5, 0.75, 0.9)
            continue
        y = n[0] / (n[0] + 2 * n[1])
        raw = [i + 1 - (i + 2) * y * n[i + 1] / n[i] if n[i] else i + 0.75 for i in range(3)]
        out[cls] = tuple(min(i + 0.95, max(0.05, d)) for i, d in enumerate(raw))
    return out


def _levels(grams: DataFrame, order: int, shared: int) -> Iterator[DataFrame]:
    """cls, g, pre, suf, left_over, p of each order, as stored tables that the caller drops after the last."""
    grams = stored(grams, "gram-counts")
    lower = None
    for k in range(1, order + 1):
        def at(j: int, pooled: bool) -> DataFrame:
            own = grams.where(F.col("k") == j)
            return own if not pooled else own.groupBy("g").agg(
                F.max("pre").alias("pre"), F.max("suf").alias("suf"), F.max("start").alias("start"), F.sum("n").alias("n")).withColumn(
                "cls", F.lit(_POOLED))

        pooled = k <= shared
        level = at(k, pooled).select("cls", "g", "pre", "suf", "start", "n")
        if k < order:
            left = at(k + 1, pooled).groupBy("cls", F.col("suf").alias("g")).agg(F.count(F.lit(1)).alias("left"))
            level = level.join(left, ["cls", "g"], "left").withColumn(
                "a", F.when(F.col("start") | F.col("left").isNull(), F.col("n")).otherwise(F.col("left")))
        else:
            level = level.withColumn("a", F.col("n"))
        counted = level = stored(level.select("cls", "g", "pre", "suf", "a"), "level-counts")
        cuts = _discounts(level)
        if not cuts:
            drop_stored(counted)
            break
        cut = F.create_map(*[x for c, d in cuts.items() for x in (F.lit(c), F.array(*map(F.lit, d)))])
        level = level.withColumn("d", cut[F.col("cls")][F.least(F.col("a"), F.lit(3)).cast("int") - 1])
        context = level.groupBy("cls", "pre").agg(F.sum("a").alias("total"), (F.sum("d") / F.sum("a")).alias("left_over"))
        level = level.join(context, ["cls", "pre"])
        if lower is None:
            alphabet = F.lit(1.0 / max(1, level.select("g").distinct().count()))
            level = level.withColumn("below", alphabet)
        else:
            on = lower.withColumnRenamed("g", "suf").withColumnRenamed("p", "below")
            level = level.join(on.drop("cls"), "suf") if k - 1 <= shared else level.join(on, ["cls", "suf"])
        level = stored(level.select("cls", "g", "pre", "suf", "left_over", (
            (F.col("a") - F.col("d")) / F.col("total") + F.col("left_over") * F.col("below")).alias("p")), "level")
        drop_stored(counted)
        lower = level.select("cls", "g", "p")
        yield level
    drop_stored(grams)


def fit(grams: DataFrame, order: int, classes: int, shared: int = 0, whole: bool = False) -> dict[str, np.ndarray]:
    """The table that `Scorer` reads, from the counts of `count_grams`, on the driver."""
    packed, done = _Packed(classes), []
    for level in _levels(grams, order + whole, shared):
        packed.add(_fetched(level))
        done.append(level)
    drop_stored(*done)
    return packed.table()


def fit_shards(grams: DataFrame, order: int, classes: int, shared: int = 0, whole: bool = False) -> dict[str, np.ndarray] | Shards:
    """The same model as sorted files in the shared folder, written by the tasks: the driver gets a name for each."""
    spark = grams.sparkSession
    path = scratch_path(spark, "ngrams")
    if not Shards.reachable(path):
        return fit(grams, order, classes, shared, whole)
    ship_package(spark)
    levels = list(_levels(grams, order + whole, shared))
    if not levels:
        return Shards(path, 1, {}, classes)
    cls, key, none = F.col("cls"), F.col("key"), F.lit(None).cast("float")
    rows = reduce(DataFrame.unionByName, [x for level in levels for x in (
        level.select(F.col("g").alias("key"), "cls", F.col("p").cast("float").alias("p"), none.alias("rest")),
        level.select(F.col("pre").alias("key"), "cls", none.alias("p"), F.col("left_over").cast("float").alias("rest")))])
    own = [cls.isin(c, _POOLED) for c in range(classes)]
    n = 2 * (sum(level.count() for level in levels) // (2 * _SHARD)) + 31  # odd, so that all bits of the hash count
    table = rows.groupBy("key").agg(*[F.max(F.when(is_own, F.col(x))).alias(f"{x}{c}") for x in ("p", "rest") for c, is_own in enumerate(own)])
    values = [F.coalesce(f"p{c}", F.lit(float("nan"))).cast("float").alias(f"p{c}") for c in range(classes)] + [
        F.coalesce(f"rest{c}", F.lit(1.0)).cast("float").alias(f"rest{c}") for c in range(classes)]
    table = table.select(F.pmod(key, F.lit(n)).cast("int").alias("shard"), "key", *values).repartition(n, "shard").sortWithinPartitions("shard", "key")
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    made.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(made)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush() -> pa.RecordBatch:
            name, rows = f"{now}-{uuid.uuid4().hex}", pa.Table.from_batches(held)
            columns = [rows.column(i).to_numpy() for i in range(1, rows.num_columns)]
            files, folder = Shards.file_system(path)
            with files.open_output_stream(f"{folder}/{name}") as out:
                out.write(columns[0].astype("<i8").tobytes())
                out.write(np.stack(columns[1:], 1).astype("<f4").tobytes())
            return pa.RecordBatch.from_pydict({"shard": pa.array([now], pa.int32()), "name": [name]})

        for batch in batches:
            shard = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a and shard[a] != now:
                    if held:
                        yield flush()
                    now, held = int(shard[a]), []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield flush()

    names = {r["shard"]: r["name"] for r in table.mapInArrow(write, "shard int, name string").collect()}  # one row a file
    drop_stored(*levels)
    return Shards(path, n, names, classes)


def _fetched(level: DataFrame) -> pa.Table:
    return level.withColumn("cls", F.col("cls").cast("byte")).toArrow()


class _Packed:
    """The finished table, built level by level: sorted hashes with, per class, the probability of the n-gram and the mass it
    leaves to lower orders as a context. An n-gram that only another class has gets the value that backing off gives. What
    is held is 8 + 8 * classes bytes an n-gram and the rows of one level."""

    def __init__(self, classes: int):
        self.classes, self.grams, self.contexts = classes, [], []
        self.lower, self.p = np.zeros(0, np.uint64), np.zeros((0, classes))

    def add(self, level: pa.Table) -> None:
        """cls, g, pre, suf, left_over, p of one order; its contexts are contexts of no other order."""
        cls = level.column("cls").to_numpy()
        keys, g = np.unique(level.column("g").to_numpy().view(np.uint64), return_inverse=True)
        contexts, pre = np.unique(level.column("pre").to_numpy().view(np.uint64), return_inverse=True)
        p, rest = np.full((len(keys), self.classes), np.nan), np.ones((len(contexts), self.classes))
        for own in np.unique(cls):
            mine = cls == own
            for to in range(self.classes) if own == _POOLED else [int(own)]:
                p[g[mine], to] = level.column("p").to_numpy()[mine]
                rest[pre[mine], to] = level.column("left_over").to_numpy()[mine]
        if len(self.lower):
            suf = level.column("suf").to_numpy().view(np.uint64)
            for to in range(self.classes):
                gap = np.flatnonzero(np.isnan(p[g, to]))
                at = np.minimum(np.searchsorted(self.lower, suf[gap]), len(self.lower) - 1)
                p[g[gap], to] = rest[pre[gap], to] * self.p[at, to]
        self.grams.append((keys, p.astype(np.float32)))
        self.contexts.append((contexts, rest.astype(np.float32)))
        self.lower, self.p = keys, p

    def table(self) -> dict[str, np.ndarray]:
        keys = np.unique(np.concatenate([np.zeros(0, np.uint64)] + [k for k, _ in self.grams + self.contexts]))
        p, rest = (np.full((len(keys), self.classes), x, np.float32) for x in (np.nan, 1.0))
        for out, held in ((p, self.grams), (rest, self.contexts)):
            while held:
                k, values = held.pop()
                out[np.searchsorted(keys, k)] = values
        return {"keys": keys, "p": p, "rest": rest}


class Shards:
    """A model in the shared folder: a file for each remainder of the hashes, with the sorted hashes and then, for each, the
    probabilities and the masses left to lower orders of all classes. Tasks map the files into memory and take the n-grams of
    a block of words at a time, so no process holds the table. Files that are not local are copied to the task's temporary
    folder first."""

    def __init__(self, path: str, n: int, names: dict[int, str], classes: int):
        self.path, self.n, self.names, self.classes = path, n, names, classes
        self.opened: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"opened": {}}

    @staticmethod
    def file_system(path: str) -> tuple[fs.FileSystem, str]:
        if path.startswith("file:"):
            path = "/" + path[len("file:"):].lstrip("/")
        return fs.FileSystem.from_uri(path)

    @staticmethod
    def reachable(path: str) -> bool:
        """Whether Python tasks can open the folder; if not, the model goes by broadcast."""
        try:
            Shards.file_system(path)
        except (pa.ArrowException, OSError, ValueError):
            return False
        return True

    def _open(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        if shard not in self.opened:
            files, folder = self.file_system(self.path)
            place = f"{folder}/{self.names[shard]}"
            if not isinstance(files, fs.LocalFileSystem):
                fd, copy = tempfile.mkstemp()
                os.close(fd)
                fs.copy_files(place, copy, source_filesystem=files, destination_filesystem=fs.LocalFileSystem())
                place = copy
            rows = os.path.getsize(place) // (8 + 8 * self.classes)
            self.opened[shard] = (np.asarray(np.memmap(place, "<i8", "r", 0, (rows,))),
                                  np.asarray(np.memmap(place, "<f4", "r", 8 * rows, (rows, 2 * self.classes))))
            if place != f"{folder}/{self.names[shard]}":
                os.unlink(place)  # stays while mapped
        return self.opened[shard]

    def values(self, keys: np.ndarray) -> np.ndarray:
        """Probabilities and masses of the hashes (distinct), not a number for those that the model has not."""
        signed = keys.view(np.int64)
        shard = (signed % self.n).astype(np.min_scalar_type(self.n))
        by = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[by], np.arange(self.n + 1))
        out = np.full((len(keys), 2 * self.classes), np.nan, np.float32)
        for s in self.names:
            mine = by[cuts[s]:cuts[s + 1]]
            if len(mine):
                held, value = self._open(s)
                want = signed[mine]
                at = np.minimum(np.searchsorted(held, want), len(held) - 1)
                hit = held[at] == want
                out[mine[hit]] = value[at[hit]]
        return out

    def part(self, keys: np.ndarray) -> dict[str, np.ndarray]:
        """The table of those of the hashes (sorted, distinct) that the model has."""
        value = self.values(keys)
        hit = ~np.isnan(value[:, -1])  # a mass is a number always
        return {"keys": keys[hit], "p": value[hit, :self.classes], "rest": value[hit, self.classes:]}

    def drop(self, spark: SparkSession) -> None:
        """Delete the files, once all scores are written."""
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scorer:
    """log-likelihoods of words under every class, and their characters."""

    def __init__(self, model: dict[str, np.ndarray], order: int, whole: bool = False):
        if not len(model["keys"]):  # nothing learned: one entry that no n-gram has
            classes = model["p"].shape[1]
            model = {"keys": np.array([2 ** 64 - 1], np.uint64), "p": np.full((1, classes), np.nan, np.float32), "rest": np.ones((1, classes), np.float32)}
        self.model, self.order, self.whole = model, order, whole
        self.classes = model["p"].shape[1]

    def _values(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities (not a number: none) and masses left to lower orders of the hashes."""
        known = self.model["keys"]
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = (known[at] == keys)[:, None]
        return np.where(hit, self.model["p"][at], np.float32(np.nan)), np.where(hit, self.model["rest"][at], np.float32(1.0))

    def likelihoods(self, words: list[str]) -> np.ndarray:
        by, length, prefix = _matrix(words)
        grams, held = [prefix[:, 1]], []  # the start mark as a context
        for end in range(2, prefix.shape[1]):
            rows = int(np.searchsorted(-length, -end, side="right"))
            held.append(min(self.order + self.whole, end))
            grams += [prefix[:rows, end] - prefix[:rows, end - k] * _power(k) if k <= self.order else prefix[:rows, end]
                      for k in range(1, held[-1] + 1)]
        # every n-gram is looked up once, however many words hold it
        keys, place = np.unique(np.concatenate(grams), return_inverse=True)
        p_of, rest_of = self._values(keys)
        places = iter(np.split(place, np.cumsum([len(g) for g in grams[:-1]])))
        sums = np.zeros((len(words), self.classes))
        before = [next(places)]
        for most in held:
            now, p = [], None
            for k in range(1, most + 1):
                at = next(places)
                now.append(at)
                known = p_of.take(at, 0)
                if p is None:
                    p = known
                    p[np.isnan(p)] = _UNSEEN
                else:
                    context = before[min(k - 2 + (k > self.order), len(before) - 1)][:len(at)]
                    p = np.where(np.isnan(known), rest_of.take(context, 0) * p, known)
            sums[:len(p)] += np.log(np.maximum(p, 1e-30))
            before = now
        out = np.empty_like(sums)
        out[by] = sums
        return out


class ShardScorer(Scorer):
    """A `Scorer` that takes the n-grams of its words from a stored model."""

    def __init__(self, shards: Shards, order: int, whole: bool = False):
        self.shards, self.order, self.whole, self.classes = shards, order, whole, shards.classes

    def _values(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = self.shards.values(keys)
        p, rest = np.ascontiguousarray(found[:, :self.classes]), found[:, self.classes:]
        return p, np.where(np.isnan(rest), np.float32(1.0), rest)


def scorer(model: dict[str, np.ndarray] | Shards, order: int, whole: bool = False) -> Scorer | ShardScorer:
    return (ShardScorer if isinstance(model, Shards) else Scorer)(model, order, whole)


class WordScores:
    """Likelihoods and lengths of words, kept between batches up to `most` words."""

    def __init__(self, scorer: Scorer | ShardScorer, most: int = 300_000):
        self.scorer, self.most = scorer, most
        self._forget()

    def _forget(self) -> None:
        self.places, self.values, self.sizes = Places(), np.zeros((0, self.scorer.classes)), np.zeros(0, np.int64)

    def learn(self, cut: Iterable[list[str]]) -> list[np.ndarray]:
        """Where `values` and `sizes` have the words of each text, until the next call. A text's words are not kept."""
        if len(self.places) > self.most:
            self._forget()
        out = [self.places.of(words) for words in cut]
        new = list(islice(self.places, len(self.values), None))
        if new:
            sizes = np.fromiter(map(len, new), np.int64, len(new))
            values = np.empty((len(new), self.scorer.classes))
            by = np.argsort(sizes, kind="stable")
            for i in range(0, len(new), 8000):
                part = by[i:i + 8000]
                values[part] = self.scorer.likelihoods([new[j] for j in part.tolist()])
            self.values, self.sizes = np.concatenate([self.values, values]), np.concatenate([self.sizes, sizes])
        return out

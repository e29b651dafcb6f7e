"""Spelling variants: words one code point apart, and the common form of each, by dense prefix-suffix tiles.

Words of a tile lie in two matrices of code points, one padded on the right and one on the left. Comparing every row of one
block with every row of another gives the common prefix and the common suffix of all pairs at once; two distinct words are one
edit apart exactly when the two lengths reach the longer word's length less one.

Which blocks are compared. Of a pair one edit apart, one half of the longer word is common: its first h = ceil((length - 1) / 2)
code points or its last h. So a word meets only words of its half, in groups (length of the longer word, s first, t last code
points). A group of more than `limit` words is cut again by halves of what lies between; when one code point is left between, a
group holds the fillings of one gap, as many as the alphabet has letters. Every pair is counted in one group alone: in
the first half where its prefix reaches that far, else in the last. No pair leaves a tile, only counts and the best word of each.

Edge cases. Null and empty texts hold no word. A null id is written as nothing before the colon. A very long text is read run by
run; its words are counted in bounded portions. Repeated rows count each time. Equal counts are settled by code-point order. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.text import small_batches
from cohortlens.session import ship_package, stored

RUN = "[a-zÀ-ÿ]{%d,}"
_CELLS = 1 << 22  # compared code points of one step
_BLOCK = 64


def count_words(docs: DataFrame, least: int = 7, noise: int = 31) -> DataFrame:
    """word, n: runs of Latin letters of at least `least` code points. Where `noise` divides the checksum of id and run, one
    code point is left out, so that the variants to be found are in the data; 0 leaves all runs as they are."""
    ship_package(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, total = re.compile(RUN % least), Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in small_batches(batches, "text", 4 << 20):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if not text:
                    continue
                seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                runs = (m.group() for m in pattern.finditer(text.encode().lower().decode()))
                while part := Counter(islice(runs, 200_000)):
                    for word, n in part.items():
                        if noise:
                            h = zlib.crc32(word.encode(), seed)
                            if h % noise == 0:
                                word = word[:h % len(word)] + word[h % len(word) + 1:]
                        if len(word) >= least:
                            total[word] += n
                    if len(total) > 300_000:
                        yield flush()
        if total:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _half(s: Column, t: Column, longer: Column) -> Column:
    """ceil((r - 1) / 2) of the r code points between."""
    return F.floor((longer - s - t) / 2).cast("int")


def _keyed(rows: DataFrame) -> DataFrame:
    """Add the group of every row; a row without room for a pair goes."""
    return rows.where("s < u").withColumn("key", F.concat_ws(
        "\t", "longer", "s", "t", F.expr("substring(word, 1, s)"), F.expr("substring(word, size - t + 1, t)")))


def _halves(rows: DataFrame) -> DataFrame:
    """Every row in the group of its first half and in that of its last. `u` bounds the common prefix from above: pairs that
    share the first half belong there."""
    h = _half(F.col("s"), F.col("t"), F.col("longer"))
    child = F.explode(F.array(
        F.struct((F.col("s") + h).alias("s"), F.col("t"), F.col("u")),
        F.struct(F.col("s"), (F.col("t") + h).alias("t"), F.least(F.col("u"), F.col("s") + h).alias("u"))))
    return _keyed(rows.withColumn("c", child).select("word", "n", "size", "longer", "c.s", "c.t", "c.u"))


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matrices padded on the right and on the left, and the lengths."""
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    narrow = not len(flat) or (flat.min() > 0 and flat.max() < 256)
    width = int(sizes.max()) if len(sizes) else 0
    left = np.full((len(words), width), 0 if narrow else 0xFFFFFFFF, np.uint8 if narrow else np.uint32)
    right = left.copy()
    row = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left[row, place] = flat
    right[row, place + np.repeat(width - sizes, sizes)] = flat
    return left, right, sizes


def _tiles(starts: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(rows of one block, rows of the other, cells per side, whether both are one block), several tiles of one shape together."""
    first, size = [], []
    pairs: list[tuple[int, int, int, int]] = []
    for at, n in zip(starts.tolist(), counts.tolist()):
        cuts = [(at + i, min(_BLOCK, n - i)) for i in range(0, n, _BLOCK)]
        first += [c[0] for c in cuts]
        size += [c[1] for c in cuts]
        pairs += [(a, m, b, k) for i, (a, m) in enumerate(cuts) for b, k in cuts[i + 1:]]
    first, size = np.array(first, np.int64), np.array(size, np.int64)
    shape = 1 << np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64)
    for side in np.unique(shape):
        own = shape == side
        yield first[own], size[own], np.stack([first[own], size[own]], 1), True
    if pairs:
        p = np.array(pairs, np.int64)
        yield p[:, 0], p[:, 1], p[:, 2:], False


def tile_neighbours(words: list[str], n: np.ndarray, group: np.ndarray, longer: np.ndarray, s: np.ndarray,
                    u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the number of words one edit away in its group, and the row of the best of them (-1: none).

    Rows of a group are neighbours in the arrays. Best is the largest n, then the smallest word.
    """
    left, right, sizes = code_points(words)
    order = np.lexsort((np.argsort(np.argsort(np.array(words, dtype=object), kind="stable")), -n))
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    counts = np.diff(np.concatenate([starts, [len(words)]]))
    near, best = np.zeros(len(words), np.int64), np.full(len(words), len(words), np.int64)
    width = max(1, left.shape[1])
    for a, m, other, same in _tiles(starts, counts):
        b, k = other[:, 0], other[:, 1]
        side = int(max(m.max(), k.max()))
        step = max(1, _CELLS // (side * side * width))
        for i in range(0, len(a), step):
            ra = np.minimum(a[i:i + step, None] + np.arange(side), len(words) - 1)
            rb = np.minimum(b[i:i + step, None] + np.arange(side), len(words) - 1)
            real = (np.arange(side) < m[i:i + step, None])[:, :, None] & (np.arange(side) < k[i:i + step, None])[:, None, :]
            if same:
                real &= np.triu(np.ones((side, side), bool), 1)
            goal, low, high = longer[ra[:, 0]][:, None, None], s[ra[:, 0]][:, None, None], u[ra[:, 0]][:, None, None]
            real &= (sizes[ra][:, :, None] == goal) | (sizes[rb][:, None, :] == goal)
            prefix = (left[ra][:, :, None, :] != left[rb][:, None, :, :]).argmax(-1)
            suffix = (right[ra][:, :, None, ::-1] != right[rb][:, None, :, ::-1]).argmax(-1)
            t, x, y = np.nonzero(real & (prefix + suffix >= goal - 1) & (prefix >= low) & (prefix < high))
            p, q = ra[t, x], rb[t, y]
            for one, two in ((p, q), (q, p)):
                near += np.bincount(one, minlength=len(words))
                np.minimum.at(best, one, rank[two])
    return near, np.where(best < len(words), order[np.minimum(best, len(words) - 1)], -1)


def _in_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: whole groups are compared together, a group cut by a batch waits for its rest."""

    def compared(table: pa.Table) -> pa.RecordBatch:
        words, n = table["word"].to_pylist(), table["n"].to_numpy()
        group = table["key"].combine_chunks().dictionary_encode()
        group = (group.combine_chunks() if isinstance(group, pa.ChunkedArray) else group).indices.to_numpy()
        near, best = tile_neighbours(words, n, group, *(table[c].to_numpy().astype(np.int64) for c in ("longer", "s", "u")))
        own = np.flatnonzero(near)
        return pa.RecordBatch.from_arrays([
            pa.array([words[i] for i in own], pa.string()), pa.array(near[own]),
            pa.array([words[i] for i in best[own]], pa.string()), pa.array(n[best[own]])], ["word", "near", "form", "form_n"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < 20_000:
            continue
        table = pa.Table.from_batches(held)
        last, cut = table["key"][rows - 1], rows - 1
        while cut and table["key"][cut - 1] == last:
            cut -= 1
        if cut:
            yield compared(table.slice(0, cut))
        held, rows = table.slice(cut).to_batches(), rows - cut
    if rows:
        yield compared(pa.Table.from_batches(held))


def neighbours(words: DataFrame, limit: int = 512) -> DataFrame:
    """word, n_near, form, form_n of all words that have another one edit away; form is the largest n, then the smallest word.

    `words` (word, n) is read several times: pass a stored table of distinct words.
    """
    ship_package(words.sparkSession)
    sized = words.select("word", "n", F.length("word").alias("size"))
    none = F.lit(0)
    rows = _halves(sized.withColumn("longer", F.explode(F.array(F.col("size"), F.col("size") + 1))).select(
        "word", "n", "size", "longer", none.alias("s"), none.alias("t"), F.col("longer").alias("u")))
    found = []
    while True:
        last = F.max(F.col("longer") - F.col("s") - F.col("t")) <= 1
        groups = stored(rows.groupBy("key").agg(
            F.count(F.lit(1)).alias("words"), F.max(F.col("size") == F.col("longer")).alias("long"), last.alias("last")).where("words > 1 AND long"), "groups")
        light = groups.where((F.col("words") <= limit) | F.col("last")).select("key")
        found.append(rows.join(light, "key").select("key", "word", "n", "longer", "s", "u").repartition("key").sortWithinPartitions("key").mapInArrow(
            _in_tiles, "word string, near long, form string, form_n long"))
        heavy = groups.where((F.col("words") > limit) & ~F.col("last")).select("key")
        if heavy.isEmpty():
            break
        rows = stored(_halves(rows.join(heavy, "key")), "halves")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.groupBy("word").agg(
        F.sum("near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("n"), "form")).alias("b")).select(
        "word", "n_near", "b.form", (-F.col("b.n")).alias("form_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of words with a form. A form is `ratio` times as frequent as its word, so chains are short; each round
    doubles the steps taken."""
    at = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def group_variants(words: DataFrame, ratio: int = 10, limit: int = 512) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of `words` (word, n; distinct). The form is the best word one edit away
    if it is at least `ratio` times as frequent; the root is the end of the chain of forms. `ratio` is over 1, so chains end."""
    if ratio < 2:
        raise ValueError("ratio must be at least 2")
    words = stored(words.select("word", "n"), "words")
    near = neighbours(words, limit)
    kept = F.col("form_n") >= ratio * F.col("n")
    at = stored(words.join(near, "word", "left").select(
        "word", F.when(kept, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(kept, F.col("form_n")).alias("form_n")), "variants")
    roots = _roots(at.where("form IS NOT NULL"))
    return at.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""Benchmark decontamination by latent semantic retrieval.

1. Terms are words of the benchmark, weighted by one plus the logarithm of their inverse document frequency over all documents.
   Words of more than a fiftieth of the documents are terms only as far as an item needs them: the rarest `likely` share
   of its words always are, so that an item keeps terms of its own even where copies of it have made its words frequent.
2. A randomised SVD of weighted passages (windows of 64 words, every 32) gives a latent space: terms times random vectors,
   two passes over the passages, each task adding its share. The space is the index and is fitted on all passages of all
   documents and of the benchmark; every passage of every document is then projected. Texts are cut into words once for the
   fit: what of them is in the benchmark is written as numbers.
3. Passages whose latent cosine with a window of an item (64 words, every 32; a shorter item is one) reaches `cosine` are
   candidates, so an item of any length meets passages of its own size. Recall against an exact search, measured, is in the
   README. With `exhaustive` every passage with enough of an item's words to be confirmed is a candidate as well: of an item that
   may miss `spare` words, at least m - spare of any m are there; that is exact and costs several times as much.
4. A candidate whose surroundings (the item's length on both sides) hold too few of the item's words goes. It is confirmed by
   the longest common subsequence of item and surroundings: a share of at least `sure`; or of at least `likely`, if the item's
   answer, its last words, is found there as well. An item of fewer than eight words must occur word by word.

The benchmark is the query set. It is read in blocks of bounded size, each a pass over the documents, so a larger benchmark
takes more passes, not more memory.

Edge cases. Null text or no word: never contaminated. Null or repeated ids: rows stay apart by text as well; equal rows give
equal pairs, once. Null or empty items are skipped; items that share an id are all searched. Empty tables: empty result. Very
long texts are searched whole. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.text import small_batches
from cohortlens.session import drop_stored, settle, ship_package, stored

STEP, RANK, EXTRA = 32, 192, 16
_SLICE = 64  # terms in a row of a sum on its way
_MARKS = bytes(32 if i < 128 and not chr(i).isalnum() else i for i in range(256))
_ANSWER, _SHORT = 5, 8


def words_of(text: str) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return text.lower().encode().translate(_MARKS).split()


def _ids(words: list[bytes], terms: dict[bytes, int]) -> np.ndarray:
    return np.fromiter(map(terms.get, words, repeat(-1)), np.int64, len(words))


def encoded(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """A row per text: `ids`, its words that are terms, in order, and `hits`, how many of them each step of 32 words has."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        for batch in small_batches(batches, "text"):
            parts = [_ids(words_of(text or ""), terms) for text in batch.column("text").to_pylist()]
            lengths = np.array([len(x) for x in parts])
            steps = -(-lengths // STEP)
            ids, step = np.concatenate(parts), _step_of(lengths, steps)
            hit = ids >= 0
            hits = np.bincount(step[hit], minlength=steps.sum())
            held = np.add.reduceat(np.append(hits, 0), np.cumsum(steps) - steps) * (steps > 0)
            yield pa.RecordBatch.from_arrays([
                pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(held)), pa.int32()), pa.array(ids[hit], pa.int32())),
                pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(steps)), pa.int32()), pa.array(hits, pa.int8()))], ["ids", "hits"])

    return docs.select("text").mapInArrow(encode, "ids array<int>, hits array<byte>")


def _step_of(lengths: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The step of every word, the steps of all texts numbered through."""
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.repeat(np.cumsum(steps) - steps, lengths) + place // STEP


def _encoded_parts(batches: Iterator[pa.RecordBatch], most: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(steps of every text, ids, hits) of some texts, of about `most` steps together."""
    for batch in batches:
        ids, hits = (batch.column(c) for c in ("ids", "hits"))
        steps = pc.list_value_length(hits).to_numpy()
        part = np.cumsum(steps) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield steps[a:b], ids.slice(a, b - a).flatten().to_numpy(), hits.slice(a, b - a).flatten().to_numpy()


def term_frequencies(texts: DataFrame, terms: int) -> tuple[int, np.ndarray]:
    """Documents with a word, and documents that hold each term, of encoded texts. The terms of a block of items bound what comes
    back."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(terms, np.int64), 0
        for steps, ids, hits in _encoded_parts(batches):
            doc = np.repeat(np.repeat(np.arange(len(steps)), steps), hits)
            sums += np.bincount(np.unique(doc * terms + ids) % terms, minlength=terms)
            n += int((steps > 0).sum())
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(sums[at], n))], ["term", "n"])

    rows = texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(terms + 1, np.int64)
    out[rows.column("term").to_numpy()] = rows.column("n").to_numpy()
    return int(out[-1]), out[:-1]


def group_sums(values: np.ndarray, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The groups, and for each the sum of values[at], added in order: the next of every group at a time, groups of many rows alone."""
    order = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.diff(group[order], prepend=-1))
    n = np.diff(np.append(first, len(order)))
    by = np.argsort(-n, kind="stable")
    first, n, at, names = first[by], n[by], at[order], group[order[first[by]]]
    sums = values[at[first]]
    many = int((n > 2 * STEP).sum())
    for i in range(many):
        sums[i] = values[at[first[i]:first[i] + n[i]]].sum(0)
    first, n, few = first[many:], n[many:], sums[many:]
    for k in range(1, int(n[0]) if len(n) else 0):
        live = int(np.searchsorted(-n, -k))  # of more than k rows
        few[:live] += values[at[first[:live] + k]]
    return names, sums


def _steps(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Sums of term vectors over each 32 words."""
    n = -(-len(ids) // STEP)
    hit = np.flatnonzero(ids >= 0)
    out = np.zeros((n, vectors.shape[1]), np.float32)
    if len(hit):
        step = hit // STEP
        first = np.flatnonzero(np.diff(step, prepend=-1))
        out[step[first]] = np.add.reduceat(vectors[ids[hit]], first, axis=0)
    return out


def _windows(steps: np.ndarray) -> np.ndarray:
    """Two steps each; a text of one step is one window."""
    return steps[:-1] + steps[1:] if len(steps) > 1 else steps


def _step_sums(ids: np.ndarray, step: np.ndarray, steps: int, vectors: np.ndarray) -> np.ndarray:
    """Sums of term vectors over each step; words that are no term have id -1."""
    hit = np.flatnonzero(ids >= 0)
    out = np.zeros((steps, vectors.shape[1]), np.float32)
    if len(hit):
        group, sums = group_sums(vectors, ids[hit], step[hit])
        out[group] = sums
    return out


def _windows_of(sums: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of texts of so many steps each, the steps that they begin with, and whether they are of two steps; a text of one
    step is one window."""
    end = np.cumsum(steps)
    begins, two = np.ones(len(sums), bool), np.ones(len(sums), bool)
    begins[end[steps > 1] - 1] = False
    two[end[steps == 1] - 1] = False
    begin, two = np.flatnonzero(begins), two[begins]
    out = sums[begin]
    out[two] += sums[begin[two] + 1]
    return out, begin, two


def latent_space(texts: DataFrame, in_space: np.ndarray, weight: np.ndarray, seed: int = 3) -> np.ndarray:
    """Term vectors of a randomised SVD of all passages of the encoded `texts`. `in_space`: the place of every term, -1 if it is none
    of the space. Every task sends a matrix of terms by RANK + EXTRA in slices; tasks add them up, so one matrix comes back."""
    spark = texts.sparkSession
    width = min(RANK + EXTRA, len(weight))
    scale = weight[:, None].astype(np.float32)

    def through(basis: np.ndarray) -> np.ndarray:
        """The passages' Gram matrix times `basis`."""
        shared = spark.sparkContext.broadcast((in_space, scale * basis.astype(np.float32)))

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            in_space, vectors = shared.value
            total = np.zeros(vectors.shape, np.float64)
            for steps, ids, hits in _encoded_parts(batches):
                term, step = in_space[ids], np.repeat(np.arange(len(hits)), hits)
                hit = term >= 0
                term, step = term[hit], step[hit]
                window, begin, two = _windows_of(_step_sums(term, step, len(hits), vectors), steps)
                # a word is in the window that its step begins and in the one that it ends
                both = np.zeros((len(hits), vectors.shape[1]), np.float32)
                both[begin] = window
                both[begin[two] + 1] += window[two]
                if len(term):
                    group, sums = group_sums(both, step, term)
                    total[group] += sums
            task = TaskContext.get().partitionId()
            for a in range(0, len(total), _SLICE):
                if total[a:a + _SLICE].any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([a], pa.int64()), pa.array([task], pa.int64()), pa.array([total[a:a + _SLICE].tobytes()], pa.binary())], ["a", "task", "m"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, total = None, None
            for batch in batches:
                for a, m in zip(batch.column("a").to_pylist(), batch.column("m").to_pylist()):
                    part = np.frombuffer(m, np.float64)
                    if a == last:
                        total = total + part
                        continue
                    if last is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["a", "m"])
                    last, total = a, part
            if last is not None:
                yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["a", "m"])

        # in the order of the tasks, so that the sums do not depend on which ends first
        parts = texts.mapInArrow(multiply, "a long, task long, m binary").repartition("a").sortWithinPartitions("a", "task")
        found = parts.mapInArrow(add, "a long, m binary").toArrow()
        out = np.zeros((len(weight), basis.shape[1]))
        for a, m in zip(found.column("a").to_pylist(), found.column("m").to_pylist()):
            part = np.frombuffer(m, np.float64).reshape(-1, basis.shape[1])
            out[a:a + len(part)] = part
        return scale * out

    start = np.random.default_rng(seed).standard_normal((len(weight), width))
    basis, _ = np.linalg.qr(through(start))
    image = through(basis)
    values, turn = np.linalg.eigh(basis.T @ image)
    return (basis @ turn[:, np.argsort(-values)[:RANK]]).astype(np.float32)


def common(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, by bits of one long integer."""
    at: dict[bytes, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        if m := at.get(w):
            hit = row & m
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def confirmed(item: list[bytes], span: list[bytes], sure: float, likely: float) -> tuple[bool, float, bool]:
    """Verdict, share of the item, and whether its answer is there."""
    if len(item) < _SHORT:
        found = any(span[i:i + len(item)] == item for i in range(len(span) - len(item) + 1))
        return found, float(found), found
    share = common(item, span) / len(item)
    answer = item[-_ANSWER:]
    found = common(answer, span) >= 0.6 * len(answer)
    return share >= sure or (share >= likely and found), share, found


def margin(length: int) -> int:
    """Steps on both sides of a window that an item of so many words may reach into."""
    return max(1, -(-length // STEP))


def least_words(length: int, share: float) -> int:
    """Fewest words whose share of an item is at least `share`."""
    return next(n for n in range(length + 1) if n / length >= share)


class Evidence:
    """Which items a text may hold, by the words of each item that are counted. `frequent`: from this count of documents on a
    word is counted only if the item has too few others."""

    def __init__(self, items: list[np.ndarray], found: np.ndarray, share: float, frequent: float):
        self.least, self.own = np.zeros(len(items), np.int64), []
        for i, ids in enumerate(items):
            spare = len(ids) - least_words(len(ids), share) if len(ids) >= _SHORT else 0
            m = max(spare + 1, int((found[ids] <= frequent).sum()))
            self.own.append(np.unique(ids[np.argsort(found[ids], kind="stable")[:m]], return_counts=True))
            self.least[i] = m - spare
        terms = np.concatenate([t for t, _ in self.own])
        by = np.argsort(terms, kind="stable")
        self.item = np.repeat(np.arange(len(items)), [len(t) for t, _ in self.own])[by]
        self.weight = np.concatenate([n for _, n in self.own])[by]
        self.start = np.searchsorted(terms[by], np.arange(len(found) + 1))

    def items(self, term: np.ndarray) -> np.ndarray:
        """Items of which these distinct terms hold enough words."""
        begin, n = self.start[term], self.start[term + 1] - self.start[term]
        at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.flatnonzero(np.bincount(self.item[at], self.weight[at], minlength=len(self.least)) >= self.least)

    def windows(self, i: int, term: np.ndarray, step: np.ndarray, steps: int, around: int) -> np.ndarray:
        """Windows that hold enough words of item i with `around` steps on both sides. Pairs of term and step are distinct; a
        word in several steps counts in each, so nothing is missed."""
        terms, weight = self.own[i]
        at = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
        hit = terms[at] == term
        sums = np.concatenate([[0], np.cumsum(np.bincount(step[hit], weight[at[hit]], minlength=steps))])
        k = np.arange(max(1, steps - 1))
        return k[sums[np.minimum(k + 2 + around, steps)] - sums[np.maximum(k - around, 0)] >= self.least[i]]


def chosen_terms(items: list[np.ndarray], found: np.ndarray, frequent: float, share: float) -> np.ndarray:
    """Which words are terms of the space: those of up to `frequent` documents, and the rarest `share` of every item's words."""
    rare = found <= frequent
    for ids in items:
        if len(ids):
            least = np.sort(found[ids])[max(1, int(np.ceil(share * len(ids)))) - 1]
            rare[ids[found[ids] <= least]] = True
    return rare


class Items:
    """The items of a block with what their checks need: distinct terms and their counts as padded matrices."""

    def __init__(self, items: list[tuple[int, list[bytes]]], terms: dict[bytes, int], share: float):
        self.names, self.words = [i for i, _ in items], [w for _, w in items]
        own = [np.unique([terms[w] for w in words], return_counts=True) for words in self.words]
        width = max(len(t) for t, _ in own)
        self.terms, self.counts = np.full((len(items), width), len(terms)), np.zeros((len(items), width), np.int64)
        for i, (term, n) in enumerate(own):
            self.terms[i, :len(term)], self.counts[i, :len(term)] = term, n
        self.least = np.array([least_words(len(w), share) if len(w) >= _SHORT else len(w) for w in self.words])
        self.around = np.array([margin(len(w)) for w in self.words])
        self.place = np.zeros(len(terms) + 1, np.int64)  # of the terms of one text, while it is looked at


class Bag:
    """Counts of the benchmark's words in the steps of one text, added up from the start."""

    def __init__(self, ids: np.ndarray, items: Items):
        self.items, self.steps = items, -(-len(ids) // STEP)
        hit = np.flatnonzero(ids >= 0)
        self.own, column = np.unique(ids[hit], return_inverse=True)
        width = len(self.own) + 1  # the first column stands for all other words
        sums = np.bincount((hit // STEP + 1) * width + column + 1, minlength=(self.steps + 1) * width)
        self.sums = np.cumsum(sums.reshape(self.steps + 1, width), axis=0)

    def may_hold(self, k: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Whether enough words of item i, in any order, lie in window k and what of the text an item's length reaches."""
        place = self.items.place
        place[self.own] = np.arange(1, len(self.own) + 1)
        column, around = place[self.items.terms[i]], self.items.around[i]
        first, last = np.maximum(k - around, 0)[:, None], np.minimum(k + 2 + around, self.steps)[:, None]
        n = np.minimum(self.sums[last, column] - self.sums[first, column], self.items.counts[i]).sum(1)
        place[self.own] = 0
        return n >= self.items.least[i]


def _searcher(docs: DataFrame, items: list[tuple[int, list[bytes]]], cosine: float, sure: float, likely: float, exhaustive: bool
              ) -> Callable[[pa.RecordBatch], dict[tuple[int, int], tuple]]:
    """What finds the items of one block in a batch: (row, place of the item) to (cosine, share, whether the answer is there)."""
    spark = docs.sparkSession
    terms = {w: i for i, w in enumerate(sorted({w for _, words in items for w in words}))}
    texts = stored(encoded(docs, terms), "encoded-texts")
    n, found = term_frequencies(texts, len(terms))
    own = [np.array([terms[w] for w in words]) for _, words in items]
    rare = chosen_terms(own, found, 0.02 * n, min(sure, likely))
    evidence = Evidence(own, found, min(sure, likely), 0.02 * n) if exhaustive else None
    every, in_space = terms, np.append(np.where(rare, np.cumsum(rare) - 1, -1), -1)
    weight = (1.0 + np.log((1.0 + n) / (1.0 + found)))[rare]
    known = spark.createDataFrame([(b" ".join(words).decode(),) for _, words in items], "text string")
    space = latent_space(texts.unionByName(encoded(known, terms)), in_space, weight) * weight[:, None].astype(np.float32)
    drop_stored(texts)
    inside = [in_space[ids] for ids in own]
    pieces = [_windows(_steps(ids, space)) if len(ids) > 2 * STEP else space[ids[ids >= 0]].sum(0, keepdims=True) for ids in inside]
    goal, piece = np.concatenate(pieces), np.cumsum([0] + [len(p) for p in pieces])
    goal /= np.maximum(np.linalg.norm(goal, axis=1, keepdims=True), 1e-12)
    shared = spark.sparkContext.broadcast((every, in_space, evidence, space, goal.T.astype(np.float32), piece, Items(items, every, min(sure, likely))))

    def search(batch: pa.RecordBatch) -> dict[tuple[int, int], tuple]:
        terms, in_space, evidence, space, goal, piece, items = shared.value
        texts = [(words, _ids(words, terms)) for words in map(words_of, (text or "" for text in batch.column("text").to_pylist()))]
        lengths = np.array([len(words) for words, _ in texts])
        steps = -(-lengths // STEP)
        held = np.maximum(steps - 1, np.minimum(steps, 1))
        row_of = np.repeat(np.arange(len(texts)), held)
        place = np.arange(len(row_of)) - np.repeat(np.cumsum(held) - held, held)
        ids = in_space[np.concatenate([ids for _, ids in texts])]
        every, _, _ = _windows_of(_step_sums(ids, _step_of(lengths, steps), steps.sum(), space), steps)
        every /= np.maximum(np.linalg.norm(every, axis=1, keepdims=True), 1e-12)
        best: dict[tuple[int, int], tuple] = {}

        def look(row: int, k: np.ndarray, i: np.ndarray, cos: np.ndarray) -> None:
            words, ids = texts[row]
            ok = Bag(ids, items).may_hold(k, i)
            for at, item, near in zip(k[ok].tolist(), i[ok].tolist(), cos[ok].tolist()):
                if (row, item) in best:
                    continue
                around = int(items.around[item])
                hit, share, answer = confirmed(items.words[item], words[max(0, (at - around) * STEP):(at + 2 + around) * STEP], sure, likely)
                if hit:
                    best[row, item] = (near, share, answer)

        step = max(1, (1 << 22) // goal.shape[1])
        for at in range(0, len(every), step):
            near = every[at:at + step] @ goal
            if goal.shape[1] > len(piece) - 1:  # the nearest window of every item
                near = np.maximum.reduceat(near, piece[:-1], axis=1)
            w, i = np.nonzero(near >= cosine)
            if not len(w):
                continue
            row = row_of[at + w]
            cuts = np.flatnonzero(np.diff(row)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(row)]):
                look(int(row[a]), place[at + w[a:b]], i[a:b], near[w[a:b], i[a:b]])
        if evidence is None:
            return best
        for row, (words, ids) in enumerate(texts):
            hit, steps = np.flatnonzero(ids >= 0), -(-len(ids) // STEP)
            if not len(hit):
                continue
            term, at = np.divmod(np.unique(ids[hit] * steps + hit // STEP), steps)
            first = int(np.searchsorted(row_of, row))
            for i in evidence.items(np.unique(term)):
                k = evidence.windows(i, term, at, steps, int(items.around[i]))
                if len(k) and (row, int(i)) not in best:
                    look(row, k, np.full(len(k), i), (every[first + k] @ goal[:, piece[i]:piece[i + 1]]).max(1))
        return best

    return search


def _blocks(benchmark: DataFrame, block: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """The items with their words, a bounded number at a time."""
    queries = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = max(1, -(-queries.count() // block))
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).orderBy("item_id", "text").toLocalIterator()
        if items := [(r["item_id"], words) for r in rows if (words := words_of(r["text"]))]:
            yield items


def contaminated(docs: DataFrame, benchmark: DataFrame, block: int = 4096, cosine: float = 0.4, sure: float = 0.7,
                 likely: float = 0.6, exhaustive: bool = False) -> DataFrame:
    """doc_id, text_key (hash of the text), item_id, similarity, share, answer_found of confirmed pairs. `exhaustive` adds the exact
    search."""
    ship_package(docs.sparkSession)
    text = F.col("text").cast("string")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    names = ["doc_id", "text_key", "item_id", "similarity", "share", "answer_found"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()]
    schema = "doc_id long, text_key long, item_id long, similarity double, share double, answer_found boolean"
    out = None
    for items in _blocks(benchmark, block):
        search, ids = _searcher(read, items, cosine, sure, likely, exhaustive), [i for i, _ in items]

        def pairs(batches: Iterator[pa.RecordBatch], search=search, ids=ids) -> Iterator[pa.RecordBatch]:
            for batch in small_batches(batches, "text", 1 << 20):
                if best := search(batch):
                    of, key = batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist()
                    rows = [(of[row], key[row], ids[i], *found) for (row, i), found in best.items()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        found = read.mapInArrow(pairs, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    return settle(out).groupBy("doc_id", "text_key", "item_id").agg(
        F.max("similarity").alias("similarity"), F.max("share").alias("share"), F.max("answer_found").alias("answer_found"))


def clean(docs: DataFrame, benchmark: DataFrame, block: int = 4096, cosine: float = 0.4, sure: float = 0.7,
          likely: float = 0.6, exhaustive: bool = False) -> DataFrame:
    """The rows of `docs`, all columns, that hold no item; block after block of items, without a shuffle of the texts."""
    ship_package(docs.sparkSession)
    out = docs.withColumn("text", F.col("text").cast("string"))
    for items in _blocks(benchmark, block):
        search = _searcher(docs.select(F.col("text").cast("string").alias("text")), items, cosine, sure, likely, exhaustive)

        def free(batches: Iterator[pa.RecordBatch], search=search) -> Iterator[pa.RecordBatch]:
            for batch in small_batches(batches, "text", 1 << 20):
                hit = {row for row, _ in search(batch)}
                yield batch.take(pa.array([i for i in range(batch.num_rows) if i not in hit], pa.int64())) if hit else batch

        out = out.mapInArrow(free, out.schema)
    return out

"""Language identification with segmentation-marginalised unigrams.

The vocabulary is that of a public tokenizer; each language has a probability for every piece. A word's likelihood is the
sum over all ways to cut it into pieces, by the forward algorithm; a text's is the product over its words (a piece does not
cross a word's start, which the vocabulary marks). Piece probabilities are fitted by expectation maximisation on the same
sum: counts expected from forward and backward values, added up over a bounded sample of labelled texts.

Likelihoods are computed once per distinct word of a task's stretch, for all languages and in numpy arrays over words, then
added up per text.

Edge cases. Null text, or no letter: `und`, score 0. Nothing to learn from: all `und`. A character that no piece holds has
the same probability in every language. A word longer than 32 characters is cut after each 32. Ties go to the language that
sorts first. Rows are never combined, so repeated rows and null ids pass through. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.text import BLANKS, Places, small_batches
from cohortlens.session import settle, ship_package

_BASE = np.uint64(0x100000001B3)
_LONGEST, _UNKNOWN = 32, 1e-7
_MARK = "\u2581"
_WORD = regex.compile(f"[^{BLANKS}]+")
_LETTER = regex.compile(r"\p{L}")


def load_pieces(path: str) -> list[str]:
    """The ordinary pieces of a tokenizer file, read on the driver; their number is fixed by the file."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.vocab_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


class Lattice:
    """All pieces inside words, and sums over segmentations."""

    def __init__(self, pieces: list[str]):
        self.powers = np.array([pow(int(_BASE), i, 1 << 64) for i in range(_LONGEST + 3)], np.uint64)
        kept = [i for i, p in enumerate(pieces) if len(p) <= _LONGEST + 1]
        self.longest = max((len(pieces[i]) for i in kept), default=1)
        keys = np.array([self._hash(pieces[i]) for i in kept], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(kept, np.int32)[order]

    def _hash(self, text: str) -> int:
        value = 0
        for c in text:
            value = (value * int(_BASE) + ord(c) + 1) & ((1 << 64) - 1)
        return value

    def spans(self, words: list[str]) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
        """Lengths of marked words, and per (end, size) the piece of every word there (-1: none), by words of falling length."""
        n = np.array([len(w) for w in words])
        code = np.zeros((len(words), int(n.max(initial=0))), np.uint64)
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        code[np.arange(code.shape[1]) < n[:, None]] = flat + np.uint64(1)
        prefix = np.zeros((len(words), code.shape[1] + 1), np.uint64)
        for i in range(code.shape[1]):
            prefix[:, i + 1] = prefix[:, i] * _BASE + code[:, i]
        out, last = [], len(self.keys) - 1
        for end in range(1, code.shape[1] + 1):
            rows = int(np.searchsorted(-n, -end, side="right"))  # words at least this long come first
            for size in range(1, min(end, self.longest) + 1):
                key = prefix[:rows, end] - prefix[:rows, end - size] * self.powers[size]
                at = np.minimum(np.searchsorted(self.keys, key), last)
                out.append((end, size, np.where(self.keys[at] == key, self.ids[at], np.int32(-1))))
        return n, out

    def _grown(self, probs: np.ndarray, piece: np.ndarray, size: int) -> np.ndarray:
        p = np.where(piece >= 0, probs[:, piece], 0.0)
        return np.where(piece >= 0, p, _UNKNOWN) if size == 1 else p

    def likelihoods(self, words: list[str], probs: np.ndarray) -> np.ndarray:
        """log of the sum over segmentations, (words, languages), for unmarked words."""
        marked, order = self._marked(words)
        n, spans = self.spans(marked)
        ahead = np.zeros((int(n.max(initial=0)) + 1, probs.shape[0], len(marked)))
        ahead[0] = 1.0
        for end, size, piece in spans:
            ahead[end, :, :len(piece)] += ahead[end - size, :, :len(piece)] * self._grown(probs, piece, size)
        out = np.empty((len(words), probs.shape[0]))
        out[order] = np.log(ahead[n, :, np.arange(len(marked))])
        return out

    def expected(self, words: list[str], weight: np.ndarray, probs: np.ndarray) -> np.ndarray:
        """Expected uses of every piece, words counting `weight` times, for one language's probabilities."""
        marked, order = self._marked(words)
        n, spans = self.spans(marked)
        width, row = int(n.max(initial=0)) + 1, probs[None, :]
        ahead, back = np.zeros((width, len(marked))), np.zeros((width, len(marked)))
        ahead[0], back[n, np.arange(len(marked))] = 1.0, 1.0
        for end, size, piece in spans:
            ahead[end, :len(piece)] += ahead[end - size, :len(piece)] * self._grown(row, piece, size)[0]
        for end, size, piece in reversed(spans):
            back[end - size, :len(piece)] += back[end, :len(piece)] * self._grown(row, piece, size)[0]
        share = weight[order] / ahead[n, np.arange(len(marked))]
        out = np.zeros(len(probs))
        for end, size, piece in spans:
            m = len(piece)
            use = ahead[end - size, :m] * back[end, :m] * self._grown(row, piece, size)[0] * share[:m]
            found = piece >= 0
            out += np.bincount(piece[found], use[found], len(probs))
        return out

    @staticmethod
    def _marked(words: list[str]) -> tuple[list[str], np.ndarray]:
        marked = [w if w.startswith("\x00") else _MARK + w for w in words]
        order = np.array(sorted(range(len(words)), key=lambda i: -len(marked[i])), np.int64)
        return [marked[i] for i in order], order


def cut_words(text: str) -> list[str]:
    """Lower-cased words; a long one in parts, of which the later are no word starts."""
    words = _WORD.findall(text.lower())
    if any(len(w) > _LONGEST for w in words):
        words = [w[i:i + _LONGEST] if i == 0 else "\x00" + w[i:i + _LONGEST]
                 for w in words for i in range(0, len(w), _LONGEST)]
    return words


def learned_rows() -> Column:
    """Rows that labels may be learned from: all but a quarter by checksum of the id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4, F.lit(0)) != 2


def _word_counts(sample: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter[str]] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for lang, own in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(lang, pa.string()), len(own)), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())],
                    ["lang", "word", "n"])

        for batch in small_batches(batches, "text"):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                held.setdefault(lang, Counter()).update(cut_words(text or ""))
            if sum(map(len, held.values())) > 500_000:
                yield from emit()
                held.clear()
        yield from emit()

    return sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, path: str, sample: int = 3000, rounds: int = 3, smoothing: float = 0.1) -> tuple[list[str], np.ndarray]:
    """Languages in order and their piece probabilities. `sample` is the expected number of texts per language that are learned
    from, drawn by hash; the number of languages bounds what comes to the driver."""
    spark = docs.sparkSession
    ship_package(spark)
    pieces = load_pieces(path)
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learned_rows()).select(
        "doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((0, len(pieces)))
    unit = 1 << 30
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(int(unit * min(1.0, sample / sizes[k]))))])
    drawn = labelled.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(unit)) < share[F.col("lang")])
    words = settle(_word_counts(drawn.select("lang", "text")))
    probs = np.full((len(langs), len(pieces)), 1.0 / len(pieces))
    place = {k: i for i, k in enumerate(langs)}
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, probs, place))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces, probs, place = shared.value
            lattice, sums = Lattice(pieces), np.zeros_like(probs)
            for batch in batches:
                lang = np.array([place[k] for k in batch.column("lang").to_pylist()])
                word, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
                for k in np.unique(lang):
                    at = np.flatnonzero(lang == k)
                    for cut in np.array_split(at, 1 + len(at) // 4000):
                        sums[k] += lattice.expected([word[i] for i in cut], n[cut].astype(float), probs[k])
            k, p = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(p, pa.int32()), pa.array(sums[k, p])], ["k", "p", "n"])

        rows = words.mapInArrow(expect, "k int, p int, n double").groupBy("k", "p").agg(F.sum("n").alias("n")).toArrow()
        sums = np.full(probs.shape, smoothing)
        sums[rows.column("k").to_numpy(), rows.column("p").to_numpy()] += rows.column("n").to_numpy()
        probs = sums / sums.sum(1, keepdims=True)
    return langs, probs


def identify(docs: DataFrame, path: str, model: tuple[list[str], np.ndarray], keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text_key, lang_pred, score (posterior of the predicted language among the learned, all equally likely before),
    word_chars (characters of all words; 0 for `und`), per_char (log likelihood of the predicted language over them; null for
    `und`), and the columns named in `keep` under names with two underscores before: rows pass through, none is joined, and a
    kept text goes to the tasks once."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((load_pieces(path), *model))
    names = ["doc_id", "text_key", "lang_pred", "score", "word_chars", "per_char", *[f"__{c}" for c in keep]]
    read = "__text" if "text" in keep and dict(docs.dtypes)["text"] == "string" else "text"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, langs, probs = shared.value
        lattice, places, known, lengths = Lattice(pieces), Places(), np.zeros((0, len(langs))), np.zeros(0, np.int64)
        for batch in small_batches(batches, read, 4 << 20):
            texts = [t or "" for t in batch.column(read).to_pylist()]
            sums, fair = np.zeros((len(texts), len(langs))), [bool(langs and _LETTER.search(t)) for t in texts]
            if len(places) > 400_000:
                places, known, lengths = Places(), np.zeros((0, len(langs))), np.zeros(0, np.int64)
            # a text's words are let go before the next text is cut
            cut = [places.of(cut_words(t)) if f else np.zeros(0, np.int64) for t, f in zip(texts, fair)]
            del texts
            new = list(islice(places, len(known), None))
            if new:
                size = np.fromiter(map(len, new), np.int64, len(new))
                fresh, by = np.empty((len(new), len(langs))), np.argsort(size, kind="stable")
                for i in range(0, len(new), 2000):
                    part = by[i:i + 2000]
                    fresh[part] = lattice.likelihoods([new[j] for j in part.tolist()], probs)
                known, lengths = np.concatenate([known, fresh]), np.concatenate([lengths, size])
            for i, at in enumerate(cut):
                if len(at):
                    sums[i] = known[at].sum(0)
            best = sums.argmax(1) if langs else np.zeros(len(fair), int)
            odds = np.exp(sums - sums.max(1, keepdims=True)).sum(1) if langs else np.ones(len(fair))
            sizes = [int(lengths[at].sum()) for at in cut]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"),
                 pa.array([langs[b] if f else "und" for b, f in zip(best, fair)], pa.string()),
                 pa.array([1.0 / o if f else 0.0 for o, f in zip(odds.tolist(), fair)], pa.float64()),
                 pa.array(sizes, pa.int64()), pa.array([float(sums[i, b]) / max(1, n) if f else None for i, (b, f, n) in enumerate(
                     zip(best, fair, sizes))], pa.float64()), *[batch.column(f"__{c}") for c in keep]], names)

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), *([text.alias("text")] if read == "text" else []),
                       *[F.col(c).alias(f"__{c}") for c in keep])
    kept = "".join(f", `__{c}` {t}" for c, t in docs.select(*keep).dtypes) if keep else ""
    return rows.mapInArrow(score, "doc_id long, text_key long, lang_pred string, score double, word_chars long, per_char double" + kept)


def plausible(found: DataFrame, slack: float = 4.0, least_chars: int = 100) -> DataFrame:
    """`found` (of `identify`, keeping doc_id and lang; read twice) without texts that are in no learned language: those whose
    likelihood per character lies further below the median of their predicted language than `slack` times the way from the median
    to the 1 % quantile. Both are taken over all labelled texts that the model has not learned from, so good texts of a
    language are kept by a wide margin.

    Texts without a letter go. Texts of fewer than `least_chars` characters, or of a language without held-out texts, are not judged
    and stay.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4, F.lit(0)) == 2
    seen = found.where(held & (F.col("lang_pred") == F.col("__lang").cast("string")) & (F.col("word_chars") >= least_chars))
    # one row per language; a sketch, as the limit is wide of all good texts
    marks = seen.groupBy("lang_pred").agg(F.percentile_approx("per_char", F.array(F.lit(0.5), F.lit(0.01)), 10_000).alias("q")).collect()
    lettered = F.col("lang_pred") != "und"
    if not marks:
        return found.where(lettered)
    limit = F.create_map(*[x for r in marks for x in (F.lit(r["lang_pred"]), F.lit(r["q"][0] - slack * (r["q"][0] - r["q"][1])))])
    low = F.try_element_at(limit, F.col("lang_pred"))
    judged = (F.col("word_chars") >= least_chars) & low.isNotNull()
    return found.where(lettered & (~judged | (F.col("per_char") >= low)))

"""Token counts of a byte-level BPE, as its library gives them.

Text is cut at the special strings and then into pre-tokens; the distinct pre-tokens of a batch are merged together: all
symbols lie in one flat array with the sequence of each, every round looks up the ranks of all neighbouring pairs, takes
each sequence's lowest, and replaces that pair everywhere in the sequence at once (from the left where it overlaps
itself). A merge never makes a pair of lower rank, so the rounds end where one-by-one merging does. Sequences without a
known pair leave the arrays; what is left of them is their count. Counts of short pre-tokens are kept between batches up
to a fixed number.

Edge cases. Null text is empty: 0 bytes, 0 tokens. A very long text is cut by the same pattern in bounded stretches, a very
long pre-token is merged as any other. Rows are never combined, so repeated rows and null ids pass through. Other columns
are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.text import small_batches
from cohortlens.session import ship_package

_NONE = np.iinfo(np.int64).max


def _printable_bytes() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others, in order, from U+0100 on."""
    shown = [b for b in range(256) if chr(b).isprintable() and chr(b) not in " \xa0\xad"]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_merges(path: str) -> dict:
    """What workers need of a tokenizer file: symbols of bytes, sorted pair keys with ranks and results, special strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["model"]["type"] != "BPE" or spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" \
            or spec["pre_tokenizer"].get("add_prefix_space") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError(f"{path} is not a plain byte-level BPE")
    vocab = spec["model"]["vocab"]
    size = 1 + max(vocab.values())
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    key = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
    order = np.argsort(key)
    table = np.zeros(256, np.int64)
    for char, byte in _printable_bytes().items():
        table[byte] = vocab[char]
    return {"size": size, "key": key[order], "rank": order.astype(np.int64), "bytes": table,
            "result": np.array([vocab[a + b] for a, b in pairs], np.int64)[order],
            "special": [t["content"] for t in spec["added_tokens"]]}


def merged_lengths(words: list[bytes], model: dict) -> np.ndarray:
    """Symbols left of every byte string."""
    left = np.array([len(w) for w in words], np.int64)
    ids = np.flatnonzero(left)  # the sequences still in the arrays
    lens = left[ids]
    sym = model["bytes"][np.frombuffer(b"".join(words), np.uint8)]
    last = len(model["key"]) - 1
    while len(ids):
        starts = np.cumsum(lens) - lens
        ends = starts + lens - 1
        pair = np.empty(len(sym), np.int64)
        pair[:-1] = sym[:-1] * model["size"] + sym[1:]
        pair[ends] = -1  # the pair that would cross into the next sequence
        place = np.minimum(np.searchsorted(model["key"], pair), last)
        rank = np.where(model["key"][place] == pair, model["rank"][place], _NONE)
        lowest = np.minimum.reduceat(rank, starts)
        go = lowest < _NONE
        left[ids[~go]] = lens[~go]
        hit = np.flatnonzero((rank == np.repeat(lowest, lens)) & (rank < _NONE))
        if not len(hit):
            break
        run = np.concatenate([[True], np.diff(hit) > 1])  # where runs of overlapping hits begin
        first = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
        hit = hit[(np.arange(len(hit)) - first) % 2 == 0]
        sym[hit] = model["result"][place[hit]]
        gone = np.zeros(len(sym), bool)
        gone[hit + 1] = True
        lens = lens - np.add.reduceat(gone, starts, dtype=np.int64)
        stays = np.repeat(go, ends - starts + 1) & ~gone
        sym, ids, lens = sym[stays], ids[go], lens[go]
    return left


class Counter:
    """Counts texts of one task; `kept` bounds the pre-tokens whose counts are remembered."""

    def __init__(self, model: dict, pattern: str, kept: int = 400_000, stretch: int = 200_000):
        self.model, self.kept, self.stretch = model, kept, stretch
        self.cut = regex.compile(pattern)
        self.special = regex.compile("|".join(map(regex.escape, sorted(model["special"], key=len, reverse=True)))) if model["special"] else None
        self.counts: dict[str, int] = {}

    def learn(self, new: set[str]) -> None:
        words = list(new)
        self.counts.update(zip(words, merged_lengths([w.encode() for w in words], self.model).tolist()))

    def count(self, texts: list[str]) -> list[int]:
        if len(self.counts) > self.kept:
            self.counts.clear()
        out, cut = [0] * len(texts), []
        for i, text in enumerate(texts):
            parts = self.special.split(text) if self.special else [text]
            out[i] += len(parts) - 1
            for part in parts:
                found = (m.group() for m in self.cut.finditer(part)) if len(part) > 1 << 20 else iter(self.cut.findall(part))
                while tokens := list(islice(found, self.stretch)):
                    if len(tokens) == self.stretch:  # part of a very long text: settle it at once
                        self.learn(set(tokens) - self.counts.keys())
                        out[i] += sum(map(self.counts.__getitem__, tokens))
                        if len(self.counts) > self.kept:
                            self.counts.clear()
                    else:
                        cut.append((i, tokens))
        self.learn(set().union(*[t for _, t in cut]) - self.counts.keys())
        for i, tokens in cut:
            out[i] += sum(map(self.counts.__getitem__, tokens))
        return out


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. `path` is read on the driver; its arrays are as large as the vocabulary."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load_merges(path))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value, pattern)
        for batch in small_batches(batches, "text", 1 << 20):
            n = counter.count([t or "" for t in batch.column("text").to_pylist()])
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        tokens, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)

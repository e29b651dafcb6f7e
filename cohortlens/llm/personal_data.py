"""Personal data in texts: fixed patterns, and a character tagger that adds what they miss.

The patterns find e-mail addresses, IP addresses, card and phone numbers; a match that fails its check is dropped whole, so two
card numbers with a blank between are lost, as is a phone number next to other digits. The tagger (`tagger.py`) is trained on the
patterns' own spans in a bounded sample of the documents (`SAMPLE` documents, `WINDOWS` windows of either sort), with forms varied:
other digits and separators, neighbours, no country code, a written-out at sign; windows without a span, and dates, prices,
versions and tokens put into them, are the other side. Windows with a failed match teach nothing.

Every text is read whole. A span of these kinds holds a digit or an at sign, so the tagger reads all stretches within `NEAR`
characters of one; a stretch is cut into windows of `WIDTH` that overlap by half, decoded one by one. Over a text, spans that a
window's end cuts are joined with their rest, spans that touch one of the patterns go, the others must pass their kind's
check, and of overlapping ones the set of the largest total gain stays.

Edge cases. Null text is empty: no spans. A very long text gives as many windows as it needs, decoded in portions. Repeated rows
and null ids pass through. Without a span in the sample there is no tagger and nothing is added. Equal gains are settled by
position. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import tagger
from cohortlens.llm.text import small_batches
from cohortlens.session import ship_package

KINDS = ("email", "ip", "card", "phone")
SAMPLE, WINDOWS = 4000, 1000
WIDTH, NEAR = 96, 40

# fixed values: the patterns of the kinds
EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int, int]  # kind, start, end

ANCHOR = re.compile(r"[\d@＠]+|[\[(]at[\])]")
_LOWER = "abcdefghijklmnopqrstuvwxyz"
_SIGNS = " \n\t!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_IDS = {c: 4 + i for i, c in enumerate(_LOWER + _SIGNS)}  # 0 end of text, 1 digit, 2 other letter, 3 anything else
CHARS = 4 + len(_IDS)


def luhn(digits: str) -> bool:
    double = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(double[int(d)] if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def pattern_spans(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """Spans by kind and start, and the places of the matches that failed their check."""
    found, failed = [], []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = EMAIL_TAIL.match(text, at) if start < at else None
        if m:
            found.append((0, start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in IP.finditer(text):
        if all(map(_octet, m.groups())):
            found.append((1, m.start(), m.end()))
        else:
            failed.append(m.span())
    for kind, pattern, least, most in ((2, CARD, 16, 19), (3, PHONE, 8, 15)):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if least <= len(digits) <= most and (kind == 3 or luhn(digits)):
                found.append((kind, m.start(), m.end()))
            elif len(digits) >= least:
                failed.append(m.span())
    return found, failed


def char_ids(text: str) -> np.ndarray:
    out = np.empty(len(text), np.int64)
    for i, c in enumerate(text.lower() if text.isascii() else [x.lower()[0] for x in text]):
        got = _IDS.get(c)
        if got is None:
            got = 1 if c.isdigit() else _IDS["@"] if c == "＠" else 2 if c.isalpha() else _IDS[" "] if c.isspace() else 3
        out[i] = got
    return out


def stretches(text: str) -> list[tuple[int, int]]:
    """Places within `NEAR` characters of a digit or an at sign, joined where they meet."""
    out: list[tuple[int, int]] = []
    for m in ANCHOR.finditer(text):
        a, b = max(0, m.start() - NEAR), min(len(text), m.end() + NEAR)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def windows(a: int, b: int) -> list[tuple[int, int]]:
    """Overlapping windows of a stretch; every span of up to half a window lies whole in one."""
    out = [(a, min(b, a + WIDTH))]
    while out[-1][1] < b:
        start = out[-1][0] + WIDTH // 2
        out.append((start, min(b, start + WIDTH)))
    return out


# --- training

def example_windows(text: str, spans: int = 8, other: int = 2) -> list[tuple[str, list[Span]]]:
    """Windows of a text around its first spans and around other places with a digit or an at sign; none with half a span or
    a failed match in it."""
    if not ANCHOR.search(text):
        return []
    found, failed = pattern_spans(text)
    places = [(s, e) for _, s, e in found][:spans]
    near, rest = list(places), 0
    for m in ANCHOR.finditer(text):
        if rest == other:
            break
        if not any(s - NEAR < m.end() and m.start() < e + NEAR for s, e in near):
            places.append(m.span())
            near.append(m.span())
            rest += 1
    out = []
    for s, e in places:
        a = max(0, min(s - (WIDTH - min(e - s, WIDTH)) // 2, len(text) - WIDTH))
        b = min(len(text), a + WIDTH)
        if any(x < b and a < y for x, y in failed) or any(x < b < y or x < a < y for _, x, y in found):
            continue
        out.append((text[a:b], [(k, x - a, y - a) for k, x, y in found if a <= x and y <= b]))
    return out


def sample_windows(docs: DataFrame, sample: int = SAMPLE) -> list[tuple[str, list[Span]]]:
    """Windows of about `sample` documents, chosen by hash: around every span, and around up to two other places of a text."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("h"))
    last = rows.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if last is None:
        return []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 4 << 20):
            out = [w for text in batch.column("text").to_pylist() for w in example_windows(text)]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in out], pa.string()), pa.array(
                [[v for span in spans for v in span] for _, spans in out], pa.list_(pa.int32()))], ["text", "spans"])

    got = rows.where(F.col("h") <= last).select("text").mapInArrow(cut, "text string, spans array<int>").distinct()
    got = got.withColumn("some", F.size("spans") > 0).withColumn("h", F.xxhash64("text"))
    out = []
    for some in (True, False):
        out += got.where(F.col("some") == some).orderBy("h", "text").limit(WINDOWS).collect()
    return [(r["text"], [tuple(r["spans"][i:i + 3]) for i in range(0, len(r["spans"]), 3)]) for r in out]


class Varied:
    """Windows with their spans in other forms, so that the tagger learns the kinds and not the patterns' letter."""

    def __init__(self, seed: int = 9):
        self.rnd = np.random.default_rng(seed)

    def pick(self, *of: str) -> str:
        return of[self.rnd.integers(len(of))]

    def digits(self, n: int) -> str:
        return "".join(map(str, self.rnd.integers(0, 10, n)))

    def card(self) -> str:
        n = 16 if self.rnd.random() < 0.8 else int(self.rnd.integers(16, 20))
        return self.pick("", "", " ", "-", ".").join([self.digits(4), self.digits(4), self.digits(4), self.digits(n - 12)])

    def phone(self) -> str:
        a, b, c, gap = self.digits(3), self.digits(3), self.digits(4), self.pick(" ", "-", ".")
        code = self.pick("+1 ", "+1 ", "+" + str(self.rnd.integers(2, 99)) + " ", "", "001 ")
        return code + self.pick(f"({a}) {b}-{c}", f"({a}) {b}{gap}{c}", f"{a}{gap}{b}{gap}{c}")

    def address(self) -> str:
        return ".".join(str(self.rnd.integers(0, 256)) for _ in range(4))

    def mail(self, was: str) -> str:
        was = re.sub("[0-9]", lambda _: self.digits(1), was)
        if self.rnd.random() < 0.5:
            word = "".join(self.pick(*_LOWER) for _ in range(self.rnd.integers(3, 9)))
            was = re.sub("^[a-zA-Z]+", word, was)
        return was.replace("@", self.pick("@", "@", "@", "[at]", "(at)", " [at] ", "＠"))

    def pieces(self, kind: int, was: str) -> list[tuple[int | None, str]]:
        """The new text of a span: parts with their kinds, None between."""
        make = (lambda: self.mail(was), self.address, self.card, self.phone)
        out: list[tuple[int | None, str]] = [(kind, make[kind]())]
        if kind and self.rnd.random() < 0.3:
            more = int(self.rnd.integers(1, 4)) if kind == 3 else kind if self.rnd.random() < 0.7 else 2
            out += [(None, self.pick(" ", " ", ", ", "/")), (more, make[more]())]
            if self.rnd.random() < 0.3:
                out += [(None, " "), (2, self.card())]
        return out

    def window(self, text: str, spans: list[Span]) -> tuple[str, list[Span]]:
        out, new, at = "", [], 0
        for kind, start, end in sorted(spans, key=lambda s: s[1]):
            if start < at:
                continue
            out += text[at:start]
            for k, part in self.pieces(kind, text[start:end]):
                if k is not None:
                    new.append((k, len(out), len(out) + len(part)))
                out += part
            at = end
        return out + text[at:], new

    def plain(self, text: str) -> str:
        """With something of digits that is not personal."""
        d = self.digits
        token = "".join(self.pick(*"0123456789abcdef") for _ in range(int(self.rnd.integers(8, 41))))
        odd = self.pick(f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}/{d(2)}/{d(4)}", f"{d(2)}:{d(2)}:{d(2)}", f"{d(4)}-{d(2)}-{d(2)} {d(2)}:{d(2)}", f"${d(1)},{d(3)}.{d(2)}", f"v{d(1)}.{d(1)}.{d(2)}",
                        f"{d(1)}.{d(1)}", token, f'"{token}"', d(5), d(6), d(8), d(12), d(24), f"{d(2)} {d(2)} {d(2)}", f"{d(4)} {d(4)}", f"{d(3)}-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"@{token[:5]}", f"{d(4)}-{d(4)}")
        at = text.rfind(" ", 0, len(text) // 2 + 1) + 1
        return text[:at] + odd + " " + text[at:]


def training_set(own: list[tuple[str, list[Span]]], seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Character ids and tags: the windows as they are and varied, as many with spans as without."""
    varied = Varied(seed)
    some, none = [w for w in own if w[1]], [w for w in own if not w[1]]
    rows = list(some) + list(none)
    rows += [varied.window(*some[i % len(some)]) for i in range(2 * WINDOWS - len(some))]
    bare = none or [(re.sub(r"[\d@]", "x", t), []) for t, _ in some]
    rows += [(varied.plain(bare[i % len(bare)][0]), []) for i in range(max(0, WINDOWS - len(none) // 2))]
    ids, tags = np.zeros((len(rows), WIDTH), np.int64), np.zeros((len(rows), WIDTH), np.int64)
    for i, (text, spans) in enumerate(rows):
        got = char_ids(text[:WIDTH])
        ids[i, :len(got)] = got
        for kind, start, end in spans:
            if end <= WIDTH and not tags[i, start:end].any():
                tags[i, start:end] = 2 + 2 * kind
                tags[i, start] = 1 + 2 * kind
            elif start < WIDTH:
                ids[i, start:] = tags[i, start:] = 0
    return ids, tags


def learn(docs: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray] | None:
    """Parameters of the tagger, in single precision; None where the sample has no span."""
    own = sample_windows(docs, sample)
    if not any(spans for _, spans in own):
        return None
    ids, tags = training_set(own)
    return tagger.train(ids, tags, CHARS, len(KINDS))


# --- decoding

def passes(kind: int, s: str) -> bool:
    """Whether a span that the tagger adds can be what it says."""
    digits = "".join(str(unicodedata.digit(c, 0)) for c in s if c.isdigit())
    if kind == 0:
        parts = re.split(r"\s?(?:[@＠]|[\[(]at[\])])\s?", s)
        return len(parts) == 2 and bool(parts[0]) and "." in parts[1].strip(".") and not re.search(r"\s", parts[0] + parts[1])
    if any(c.isalpha() for c in s):
        return False
    if kind == 1:
        return len(re.findall(r"\d+", s)) == 4 and all(map(_octet, re.findall(r"\d+", s)))
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits) and not re.search(r"\D{2}", s)
    if s[0] not in "+(" and (len(digits) < 10 or len(re.findall(r"\d+", s)) > 4):
        return False  # dates, book numbers and the like
    return 8 <= len(digits) <= 15 and not re.search(r"[^\d +().\-/]", s)


def _trimmed(text: str, kind: int, start: int, end: int) -> tuple[int, int]:
    while start < end and not (text[start].isalnum() or kind == 3 and text[start] in "+("):
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    return start, end


def reconcile(text: str, base: list[Span], found: list[tuple[int, int, int, float, bool]]) -> list[Span]:
    """What the tagger adds to a text, from the spans (kind, start, end, gain, cut by a window) of all its windows."""
    joined: list[list] = []
    for kind, start, end, gain, cut in sorted(found):
        last = joined[-1] if joined else None
        if last and last[0] == kind and start < last[2] and (cut or last[4]):
            last[2], last[3], last[4] = max(end, last[2]), max(gain, last[3]), last[4] and cut
        else:
            joined.append([kind, start, end, gain, cut])
    fixed = sorted((s, e) for _, s, e in base)
    starts, reach, most = [s for s, _ in fixed], [], 0
    for _, e in fixed:
        most = max(most, e)
        reach.append(most)
    best: dict[Span, float] = {}
    for kind, start, end, gain, _ in joined:
        start, end = _trimmed(text, kind, start, end)
        before = bisect_right(starts, end - 1) - 1
        if end <= start or before >= 0 and reach[before] > start or not passes(kind, text[start:end]):
            continue
        best[kind, start, end] = max(gain, best.get((kind, start, end), 0.0))
    own = sorted(best, key=lambda s: (s[2], s[1], s[0]))
    ends, total, before = [s[2] for s in own], [0.0], []
    for i, s in enumerate(own):
        before.append(bisect_right(ends, s[1], 0, i))
        total.append(max(total[-1], total[before[i]] + best[s]))
    out, i = [], len(own)
    while i:
        if total[i] == total[i - 1]:
            i -= 1
        else:
            out.append(own[i - 1])
            i = before[i - 1]
    return out


class Finder:
    """Spans of texts; `params` may be None."""

    def __init__(self, params: dict[str, np.ndarray] | None, portion: int = 512):
        self.params, self.portion = params, portion

    def spans(self, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
        """Per text the patterns' spans and those the tagger adds."""
        base = [pattern_spans(t)[0] for t in texts]
        found: list[list[tuple[int, int, int, float, bool]]] = [[] for _ in texts]
        held: list[tuple[int, int, int, bool, bool]] = []
        if self.params is not None:
            for i, text in enumerate(texts):
                for a, b in stretches(text):
                    for s, e in windows(a, b):
                        held.append((i, s, e, s > a, e < b))
                        if len(held) == self.portion:
                            self.read(texts, held, found)
            self.read(texts, held, found)
        return [(b, reconcile(t, b, f) if f else []) for t, b, f in zip(texts, base, found)]

    def read(self, texts: list[str], held: list, found: list) -> None:
        if not held:
            return
        ids = np.zeros((len(held), WIDTH), np.int64)
        for row, (i, s, e, _, _) in enumerate(held):
            ids[row, :e - s] = char_ids(texts[i][s:e])
        for (i, s, e, left, right), spans in zip(held, tagger.decode(self.params, ids)):
            for kind, a, b, gain in spans:
                b = min(b, e - s)
                if b > a:
                    found[i].append((kind, s + a, s + b, gain, left and a == 0 or right and b == e - s))
        held.clear()


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find_personal_data(docs: DataFrame, params: dict[str, np.ndarray] | None) -> DataFrame:
    """doc_id, text, base and added: arrays of (kind, start, end, value), places in code points, end exclusive."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(params)  # a few tables of fixed size
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value)
        for batch in small_batches(batches, "text", 2 << 20):
            texts = batch.column("text").to_pylist()
            got = finder.spans(texts)
            lists = [pa.array([[{"kind": KINDS[k], "start": s, "end": e, "value": t[s:e]} for k, s, e in sorted(pair[i])]
                               for t, pair in zip(texts, got)], pa.list_(span)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], ["doc_id", "base", "added"])

    kind = "array<struct<kind:string,start:int,end:int,value:string>>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(find, f"doc_id long, base {kind}, added {kind}")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the patterns' spans, the checksum of their list, and the list of all spans."""
    def listed(spans) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    def of(column: str, kind: str) -> Column:
        return F.filter(column, lambda s: s["kind"] == kind)

    every = F.sort_array(F.transform(F.concat("base", "added"), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    counts = [F.size(of("base", k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.withColumn("every", every).select(
        "doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed(F.concat(*[of("every", k) for k in KINDS])).alias("spans"),
        F.size("added").cast("long").alias("n_added"))

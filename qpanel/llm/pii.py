"""Personal data: fixed patterns, and a linear-chain conditional random field.

Words that hold a digit or ``@``, are made of ``( ) . -`` only, or stand by a
bracketed "at" or "dot" can be part of a span; any other word has the label O
by the model's structure.  So runs of such words are decoded on their own, and
this is exact.  Every pattern match lies within one run too.

Patterns (kinds in this order): email, ip (parts at most 255), card (12 to 19
digits, Luhn), phone (9 to 15 digits); leftmost, non-overlapping per kind.

The field has begin and inside labels for each kind, features of a word's shape
(letters by case, digits, other characters as they are; repeats collapsed or
not), digit counts, checks of Luhn and of address parts, the shapes beside it
and the word before the run.  It is trained by gradient ascent on the
likelihood (forward-backward in numpy) over a small labelled table, and decoded
by Viterbi over batches of runs of equal length.  Its spans are added where they
overlap no pattern match.

Positions are code points, the end exclusive.  Whole texts are read as UTF-8
bytes in pieces; only the runs become Python strings.

Edge cases: a NULL or empty text has no spans; NULL and repeated doc_ids are
rows like others; an empty table gives an empty table; extra columns are
ignored.
"""
from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from qpanel.llm.common import IS_SPACE, chunks, documents

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
EPOCHS, RATE, DECAY = 25, 0.3, 1e-4

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_MARK = np.zeros(256, bool)         # a digit or @
_MARK[[*range(0x30, 0x3A), 0x40]] = True
_JOINT = np.zeros(256, bool)        # ( ) . -
_JOINT[[0x28, 0x29, 0x2E, 0x2D]] = True
_OPEN = np.zeros(256, bool)         # [ ( {
_OPEN[[0x5B, 0x28, 0x7B]] = True
_SPOKEN = re.compile(rb"[\[({](at|dot)[\])}]", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def patterns(s: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches in ``s``."""
    out, last = [], 0
    at = s.find("@")
    while at >= 0:
        a = at
        while a > last and s[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(s, at) if a < at else None
        if m:
            out.append((a, 0, m.end()))
            last = m.end()
        at = s.find("@", max(at + 1, last))
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(s) if all(map(octet, m.group().split(".")))]
    for m in _CARD.finditer(s):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(s):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return out


def candidates(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the runs of words that can be part of
    a span as rows (first word, end word, document)."""
    starts, ends, doc = word_spans(raw, offsets)
    if not len(starts):
        return starts, ends, np.zeros((0, 3), np.int64)
    def per_word(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[ends] - total[starts]
    able = (per_word(_MARK[raw]) > 0) | (per_word(_JOINT[raw]) == ends - starts)
    for w in np.flatnonzero(per_word(_OPEN[raw]) > 0):
        if _SPOKEN.search(raw[starts[w]:ends[w]].tobytes()):
            able[max(0, w - 1):w + 2] = True
    word = np.flatnonzero(able)
    new = np.ones(len(word), bool)
    new[1:] = (np.diff(word) > 1) | (doc[word[1:]] != doc[word[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(word)) - 1
    return starts, ends, np.stack([word[first], word[last] + 1, doc[word[first]]], 1) if len(word) else np.zeros((0, 3), np.int64)


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(raw)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    space = IS_SPACE[raw]
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    starts = np.flatnonzero(~space & (before | edge[:n]))
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


_LEFT, _RIGHT = "\"'*<,;:#$%&!|", ".,;:!?*#$%&\"'>|"


def core(word: str) -> tuple[int, int]:
    """Where the word is without quotes and sentence marks around it."""
    a, b = len(word) - len(word.lstrip(_LEFT)), len(word.rstrip(_RIGHT))
    return (a, b) if a < b else (0, len(word))


def shape(s: str) -> str:
    return "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in s[:40])


def word_features(word: str) -> list[str]:
    a, b = core(word)
    s = word[a:b]
    full = shape(s)
    short = re.sub(r"(.)\1+", r"\1", full)
    digits = "".join(c for c in s if "0" <= c <= "9")
    out = [f"full={full}", f"short={short}", f"digits={min(len(digits), 20)}"]
    if "@" in s:
        out.append("at")
    if _SPOKEN.search(s.encode()):
        out.append("spoken")
    if 12 <= len(digits) <= 19 and len(digits) == len(s.replace("-", "")):
        out.append(f"luhn={luhn(digits)}")
    parts = s.split(".")
    if len(parts) == 4 and all(p.isdigit() and p.isascii() for p in parts):
        out.append(f"octets={all(map(octet, parts))}")
    return out


def run_features(words: list[str], before: str) -> list[list[str]]:
    """Features of each word of a run; ``before``: the word left of the run."""
    own = [word_features(w) for w in words]
    out = []
    for i, f in enumerate(own):
        left = f"left:{own[i - 1][1]}" if i else f"cue:{before.strip(_LEFT + _RIGHT + '()').lower()[:20]}"
        right = f"right:{own[i + 1][1]}" if i + 1 < len(own) else "last"
        out.append(["bias", *f, left, right, f"{f[1]}&{right}", f"{f[2]}&{left}"])
    return out


@dataclass
class Field:
    """Weights of the conditional random field."""
    index: dict[str, int]
    emit: np.ndarray        # features x labels
    move: np.ndarray        # labels x labels
    start: np.ndarray

    def emissions(self, run: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(run), len(LABELS)))
        for i, f in enumerate(run):
            ids = [self.index[x] for x in f if x in self.index]  # unseen features say nothing
            out[i] = self.emit[ids].sum(axis=0)
        return out

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """Best labels of a batch of runs: e is runs x words x labels."""
        n, t, _ = e.shape
        best = self.start + e[:, 0]
        back = np.zeros((t, n, len(LABELS)), np.int64)
        for k in range(1, t):
            step = best[:, :, None] + self.move
            back[k] = step.argmax(axis=1)
            best = step.max(axis=1) + e[:, k]
        out = np.zeros((n, t), np.int64)
        out[:, -1] = best.argmax(axis=1)
        for k in range(t - 1, 0, -1):
            out[:, k - 1] = back[k][np.arange(n), out[:, k]]
        return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def fit(examples: list[tuple[list[list[str]], list[int]]], seed: int = 11) -> Field:
    """Stochastic gradient ascent on the log likelihood."""
    names = sorted({f for run, _ in examples for word in run for f in word})
    index = {f: i for i, f in enumerate(names)}
    k = len(LABELS)
    field = Field(index, np.zeros((len(names), k)), np.zeros((k, k)), np.zeros(k))
    for j, name in enumerate(LABELS):  # inside follows begin or inside of its kind only
        if name[0] == "I":
            field.start[j] = -30
            field.move[:, j] = -30
            field.move[[j - 1, j], j] = 0
    data = [([[index[f] for f in word] for word in run], np.array(y)) for run, y in examples]
    rng = np.random.default_rng(seed)
    for epoch in range(EPOCHS):
        rate = RATE / (1 + 0.1 * epoch)
        for i in rng.permutation(len(data)):
            run, y = data[i]
            e = np.stack([field.emit[ids].sum(axis=0) for ids in run])
            t = len(run)
            fwd, bwd = np.zeros((t, k)), np.zeros((t, k))
            fwd[0] = field.start + e[0]
            for s in range(1, t):
                fwd[s] = _lse(fwd[s - 1][:, None] + field.move, 0) + e[s]
            for s in range(t - 2, -1, -1):
                bwd[s] = _lse(field.move + (e[s + 1] + bwd[s + 1]), 1)
            z = _lse(fwd[-1], 0)
            p = np.exp(fwd + bwd - z)
            gold = np.zeros((t, k))
            gold[np.arange(t), y] = 1
            for s in range(t):
                field.emit[run[s]] += rate * (gold[s] - p[s])
            field.start += rate * (gold[0] - p[0]) * (field.start > -20)
            for s in range(1, t):
                pair = np.exp(fwd[s - 1][:, None] + field.move + e[s] + bwd[s] - z)
                pair[y[s - 1], y[s]] -= 1
                field.move -= rate * pair * (field.move > -20)
            field.emit *= 1 - rate * DECAY
    return field


# The labelled table.  {kind:format} is a span, {format} is not;
# in a format 9 is a digit, a a lower-case letter, h a hexadecimal digit.
TEMPLATES = (
    "write to {email:aaaa.99@aaaa9.aaaaaaa.aaa} for more", "mail {email:aaaaa@aaaaaa.aaa}, thanks", "{email:a.aaaaaa@aaaa.aa.aa}",
    "contact {email:aaaaa [at] aaaaaa [dot] aaa} today", "reach {email:aaaa(at)aaaaaa.aaa} now", "email {email:aaaa99 (at) aaaaaa (dot) aaa} please",
    "host {ip:99.9.999.99} is up", "from {ip:999.99.99.9}, then", "server {ip:9.9.9.9} and {ip:99.99.99.99} answered", "ip {ip:999.99.9.99}:{9999} open",
    "card {card:L999 9999 9999 9999} charged", "paid with {card:L999999999999999} on", "visa {card:L999-9999-9999-9999} was", "karte {card:L99999999999999} und",
    "call {phone:+9 (999) 999-9999} now", "tel {phone:+99 99 9999 9999} or", "phone {phone:(999) 999-9999} today", "telefon {phone:+99-999-9999999} bitte",
    "phone: {phone:999-999-9999} or", "fax {phone:+9 999 999 9999} and", "cell {phone:(999)999-9999} from",
    "in {9999} there were", "on {9999-99-99} at {99:99} we", "version {9.9} of", "version {9.9.9} is", "about {99,999} rows", "costs {99.99} or", "page {99} of {999}",
    "number {N999999999999999} is", "id {N9999999999999} was", "the {N999 9999 9999 9999} code", "order {99999999} and {999999} were", "items {9.} and {99.} too",
    'token = "{hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh}" in', "hash {hhhhhhhhhhhhhhhh} was", "user {@aaaaaa} said", "level {9} (of {99}) done", "years {9999-9999} were",
    "build {9.99.9999.9999} ships", "release {999.999.9999.9} notes", "section {9.9.9.9.9} of", "room {999-9999} is", "- {99} -", "sum {999 999 999} here", "chapter {9}) and {99})",
)
PER_TEMPLATE = 16


def labelled_table(seed: int = 5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, [(start, end, kind)]): the templates with random characters."""
    rng = np.random.default_rng(seed)
    rows = []
    for template in TEMPLATES:
        for _ in range(PER_TEMPLATE):
            text, spans = "", []
            for part in re.split(r"(\{[^}]*\})", template):
                kind, _, form = part[1:-1].rpartition(":") if part[:1] == "{" else ("", "", "")
                if kind not in KINDS and part[:1] == "{":
                    kind, form = "", part[1:-1]
                start = len(text)
                text += _filled(form, kind, rng) if form else part
                if kind:
                    spans.append((start, len(text), kind))
            rows.append((text, spans))
    return rows


def _filled(form: str, kind: str, rng: np.random.Generator) -> str:
    """``form`` with random characters; L and N: digits with a right or wrong
    check sum."""
    while True:
        out = []
        for piece in re.split(r"([\[(](?:at|dot)[\])])", form):
            spoken = re.fullmatch(r"[\[(](at|dot)[\])]", piece)
            out += piece if spoken else [
                str(rng.integers(1, 10)) if c in "9LN" else chr(97 + int(rng.integers(26))) if c == "a"
                else "0123456789abcdef"[int(rng.integers(16))] if c == "h" else c for c in piece]
        s = "".join(out)
        digits = "".join(c for c in s if c.isdigit())
        if form[0] in "LN" and luhn(digits) != (form[0] == "L"):
            continue
        return ".".join(str(int(p) % 256) for p in s.split(".")) if kind == "ip" else s


def training_runs(table: list[tuple[str, list[tuple[int, int, str]]]]) -> list[tuple[list[list[str]], list[int]]]:
    """Runs of the labelled texts with their labels (ASCII texts or not)."""
    out = []
    for text, spans in table:
        raw = np.frombuffer(text.encode(), np.uint8)
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        starts, ends, runs = candidates(raw, np.array([0, len(raw)]))
        for a, b, _ in runs:
            words = [raw[starts[w]:ends[w]].tobytes().decode() for w in range(a, b)]
            before = raw[starts[a - 1]:ends[a - 1]].tobytes().decode() if a else ""
            y, open_ = [], None
            for w in range(a, b):
                lo, hi = chars[starts[w]], chars[ends[w]]
                hit = next((s for s in spans if s[0] < hi and lo < s[1]), None)
                y.append(0 if hit is None else LABELS.index(("I-" if hit == open_ else "B-") + hit[2]))
                open_ = hit
            out.append((run_features(words, before), y))
    return out


def _decode(field: Field, runs: list[tuple]) -> list[tuple[int, int, int, int]]:
    """(document, start, kind, end) found by the field; a run is (document,
    features, code point starts of the words, words)."""
    by_length, out = defaultdict(list), []
    for run in runs:
        by_length[len(run[1])].append(run)
    for group in by_length.values():
        for k in range(0, len(group), 4096):
            part = group[k:k + 4096]
            labels = field.viterbi(np.stack([field.emissions(f) for _, f, _, _ in part]))
            for (doc, _, at, words), y in zip(part, labels, strict=True):
                span = None
                for i, label in enumerate([*y, 0]):
                    if span and (label == 0 or label % 2 == 1):  # ends before this word
                        out.append((doc, *span))
                        span = None
                    if label:
                        a, b = core(words[i])
                        span = (at[i] + a, (label - 1) // 2, at[i] + b) if label % 2 else (span[0], span[1], at[i] + b)
    return out


def find(docs: DataFrame, table: list | None = None) -> DataFrame:
    """doc_id, base and added: arrays of (start, kind, end) in order."""
    field = docs.sparkSession.sparkContext.broadcast(fit(training_runs(table or labelled_table())))
    kind_of = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))
        for batch in batches:
            base, added = [[] for _ in range(len(batch))], [[] for _ in range(len(batch))]
            for a, _, raw, off in chunks(batch.column("text")):
                chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                starts, ends, runs = candidates(raw, off)
                waiting = []
                for first, end, doc in runs.tolist():
                    lo = starts[first]
                    at = int(chars[lo] - chars[off[doc]])
                    for s, kind, e in patterns(raw[lo:ends[end - 1]].tobytes().decode("utf-8", "replace")):
                        base[a + doc].append((at + s, kind, at + e))
                    words = [raw[starts[w]:ends[w]].tobytes().decode("utf-8", "replace") for w in range(first, end)]
                    before = raw[max(starts[first - 1], ends[first - 1] - 80):ends[first - 1]].tobytes().decode("utf-8", "replace") \
                        if first and starts[first - 1] >= off[doc] else ""
                    places = [int(chars[starts[w]] - chars[off[doc]]) for w in range(first, end)]
                    waiting.append((a + doc, run_features(words, before), places, words))
                for doc, s, kind, e in _decode(field.value, waiting):
                    if all(e <= x or s >= y for x, _, y in base[doc]):
                        added[doc].append((s, kind, e))
            as_rows = lambda spans: pa.array([[{"start": s, "kind": KINDS[k], "end": e} for s, k, e in sorted(x)] for x in spans], spans_type)
            yield pa.record_batch([batch.column("doc_id"), as_rows(base), as_rows(added)], ["doc_id", "base", "added"])

    spans = "array<struct<start: long, kind: string, end: long>>"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind_of}, base {spans}, added {spans}")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: counts and digest of the pattern
    matches, and all spans."""
    found = find(documents(spark, sf_dir))
    kind = found.schema["doc_id"].dataType.simpleString()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shas, spans = [[] for _ in KINDS], [], []
            for base, added in zip(batch.column("base").to_pylist(), batch.column("added").to_pylist(), strict=True):
                join = lambda x: ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in x)
                for k, name in enumerate(KINDS):
                    counts[k].append(sum(s["kind"] == name for s in base))
                shas.append(hashlib.sha256(join(base).encode()).hexdigest())
                spans.append(join(sorted(base + added, key=lambda s: (s["start"], KINDS.index(s["kind"]), s["end"]))))
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()),
                                   pa.array(spans, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return found.mapInArrow(digests, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string")

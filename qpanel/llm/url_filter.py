"""URL filters: a bit-parallel wildcard automaton over canonical URLs.

A canonical URL is the host (A-Z lower-cased) followed by the path; scheme,
query and fragment are cut.  All patterns are globs over it:

* ``*``   any run of code points without ``/``
* ``**``  any run of code points
* ``?``   one code point other than ``/``
* ``\\x``  the character x itself

They are packed into one Shift-And automaton of as many 64-bit words as it
takes: a pattern of m symbols has m + 1 bits, bit k says that k symbols are
matched.  For a byte c, ``step[c]`` marks the symbols that c matches and
``stay[c]`` the states that c does not leave (those before a run), so

    states = ((states << 1) & step[c]) | (states & stay[c])

moves all patterns at once; the shift carries from word to word.  A batch of
URLs is moved together, byte by byte, longest first; a URL over ``ALONE`` bytes
is walked by itself, with the words joined to one integer.

Two lists of patterns meet in ``judge_urls``.  ``rules`` (verdict, host, path)
fit the host and all subdomains where the path starts with the rule's; of those
that fit the longest wins (ties: block before allow, then by text).  Where none
fits, the page is blocked if one of ``globs`` matches, else allowed.

The patterns are parameters of fixed size, sent to each task; a page is one row
of one partition, so nothing is shuffled and no key can be hot.

Edge cases: a NULL URL or one without ``://`` has an empty host and path, fits
no rule and is allowed unless a glob matches the empty text; very long URLs are
matched whole; NULL or repeated page_ids are rows as any other; an empty table
gives an empty table; extra columns are ignored, whatever their names.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qpanel.llm.common import LOWER, UPPER, table


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the query, as its contract states them.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
# Words whose appearance in a host blocks a page that no rule fits.
BLOCKED_WORDS = ("adult", "ads-", "bets", "casino", "pills", "spam")
GLOBS = tuple(g for w in BLOCKED_WORDS for g in (f"*{w}*", f"*{w}*/**"))

ALONE = 4096                # bytes of a URL that is walked by itself
BATCH_WORDS = 1 << 18       # words of state that are moved together
_ANY, _RUN, _RUN_ALL = "?", "*", "**"


def escaped(text: str) -> str:
    """``text`` as a glob that matches only itself."""
    return "".join("\\" + c if c in "*?\\" else c for c in text)


def rule_globs(rule: Rule) -> list[str]:
    """Globs of a rule: its host and its subdomains; an empty path fits all."""
    ends = [escaped(rule.path) + _RUN_ALL] if rule.path else ["", "/" + _RUN_ALL]
    return [head + escaped(rule.host) + end for head in ("", "*.") for end in ends]


def symbols(glob: str) -> list[str | int]:
    """A glob's bytes (as integers) and wildcards."""
    out: list[str | int] = []
    i = 0
    while i < len(glob):
        c = glob[i]
        if c == "\\" and i + 1 < len(glob):
            out += glob[i + 1].encode()
            i += 2
        elif c == "*":
            run = i
            while i < len(glob) and glob[i] == "*":
                i += 1
            out.append(_RUN if i - run == 1 else _RUN_ALL)
        elif c == "?":
            out.append(_ANY)
            i += 1
        else:
            out += c.encode()
            i += 1
    return out


class Automaton:
    """All patterns in one multiword Shift-And automaton."""

    def __init__(self, globs: Sequence[str]):
        every = np.arange(256)
        not_slash = every != 0x2F
        later = (every >= 0x80) & (every < 0xC0)    # bytes within a code point
        steps, stays, starts, ends = [], [], [], []
        for glob in globs:
            step, stay = [np.zeros(256, bool)], [np.zeros(256, bool)]
            for s in symbols(glob):
                if s == _RUN or s == _RUN_ALL:
                    stay[-1] = stay[-1] | (not_slash if s == _RUN else True)
                else:
                    step.append(~later & not_slash if s == _ANY else every == s)
                    stay.append(later if s == _ANY else np.zeros(256, bool))
            starts.append(len(steps))
            steps += step
            stays += stay
            ends.append(len(steps) - 1)
        self.words = max(1, -(-len(steps) // 64))
        self.step, self.stay = self._packed(steps), self._packed(stays)
        self.start = self._packed([self._mark(len(steps), starts)])[:, 0] if steps else np.zeros(self.words, np.uint64)
        self.end_word, self.end_bit = np.array(ends, int) // 64, np.array(ends, np.uint64) % np.uint64(64)

    @staticmethod
    def _mark(n: int, at: list[int]) -> np.ndarray:
        out = np.zeros(n, bool)
        out[at] = True
        return out

    def _packed(self, rows: list[np.ndarray]) -> np.ndarray:
        """Masks per byte (or per word for ``start``) from one row a state."""
        if not rows:
            return np.zeros((256, self.words), np.uint64)
        if len(rows) == 1 and len(rows[0]) != 256:
            rows = [np.array([x]) for x in rows[0]]
        bits = np.zeros((self.words * 64, len(rows[0])), bool)
        bits[:len(rows)] = rows
        packed = np.packbits(bits, axis=0, bitorder="little").T.copy().view("<u8").astype(np.uint64)
        return packed if packed.shape[0] == 256 else packed.T

    def _accepted(self, states: np.ndarray) -> np.ndarray:
        return (states[:, self.end_word] >> self.end_bit) & np.uint64(1) == 1

    def matches(self, urls: list[bytes]) -> np.ndarray:
        """(url, pattern): does the pattern match the whole URL?"""
        size = np.array([len(u) for u in urls], np.int64)
        out = np.zeros((len(urls), len(self.end_word)), bool)
        order = np.argsort(-size, kind="stable")
        alone = int((size > ALONE).sum())
        for i in order[:alone]:
            out[i] = self._accepted(self._walk(urls[i])[None, :])[0]
        most = max(1, BATCH_WORDS // self.words)
        for a in range(alone, len(order), most):
            rows = order[a:a + most]
            out[rows] = self._accepted(self._move([urls[i] for i in rows], size[rows]))
        return out

    def _move(self, urls: list[bytes], size: np.ndarray) -> np.ndarray:
        """States after each URL; ``urls`` come longest first."""
        states = np.tile(self.start, (len(urls), 1))
        raw = np.frombuffer(b"".join(urls), np.uint8)
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        live = len(urls) - np.searchsorted(size[::-1], np.arange(size[0] if len(size) else 0), "right")
        for t, n in enumerate(live):
            c = raw[first[:n] + t]
            now = states[:n]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            moved &= self.step[c]
            states[:n] = moved | (now & self.stay[c])
        return states

    def _walk(self, url: bytes) -> np.ndarray:
        join = [int.from_bytes(m.astype("<u8").tobytes(), "little") for m in (*self.step, *self.stay, self.start)]
        step, stay, state = join[:256], join[256:512], join[512]
        for c in url:
            state = ((state << 1) & step[c]) | (state & stay[c])
        return np.frombuffer(state.to_bytes(self.words * 8, "little"), "<u8").astype(np.uint64)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    return F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, globs: Sequence[str] = GLOBS, url: str = "url") -> DataFrame:
    """page_id, host, path, rule (text of the rule that decides, or NULL),
    verdict, globs (those of ``globs`` that match), one row a page."""
    rows = pages.select("page_id", host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    ranked = sorted(set(rules), key=lambda r: (-len(r.text), r.verdict != "block", r.text.encode()))
    of_rule = [(k, g) for k, r in enumerate(ranked) for g in rule_globs(r)]
    owner = np.array([k for k, _ in of_rule], int)
    listed = list(dict.fromkeys(globs))
    patterns = [g for _, g in of_rule] + listed

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(patterns)
        for batch in batches:
            host, path = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            hit = automaton.matches([(h + p).encode() for h, p in zip(host, path, strict=True)])
            fits = hit[:, :len(of_rule)]
            first = owner[fits.argmax(axis=1)] if len(of_rule) else np.zeros(len(host), int)  # patterns are in rank order
            ruled = fits.any(axis=1)
            others = [[listed[j] for j in np.flatnonzero(h)] for h in hit[:, len(of_rule):]]
            rule = [ranked[k].text if r else None for k, r in zip(first, ruled, strict=True)]
            verdict = [ranked[k].verdict if r else "block" if o else "allow" for k, r, o in zip(first, ruled, others, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array(rule, pa.string()),
                 pa.array(verdict, pa.string()), pa.array(others, pa.list_(pa.string()))],
                names=["page_id", "host", "path", "rule", "verdict", "globs"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(judged, f"page_id {kind}, host string, path string, rule string, verdict string, globs array<string>")


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the fixed rules, else by the word globs."""
    return judge_urls(table(spark, sf_dir, "pages")).drop("globs")


ORACLE = r"""
WITH rules(verdict, host, path) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
               row_number() OVER () AS k FROM pages),
parts AS (SELECT k, page_id,
  translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (SELECT p.k, r.verdict, r.host || r.path AS rule,
  row_number() OVER (PARTITION BY p.k ORDER BY length(r.host || r.path) DESC) AS n
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, f.rule,
  coalesce(f.verdict, CASE WHEN regexp_matches(p.host, 'adult|ads-|bets|casino|pills|spam') THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN fits f ON f.k = p.k AND f.n = 1
"""

import random
import re

import pytest
from pyspark.sql import functions as F

from qpanel.llm import url_filter
from qpanel.llm.url_filter import Automaton, Rule, judge_urls


def as_regex(glob):
    out, i = "", 0
    while i < len(glob):
        if glob[i] == "\\" and i + 1 < len(glob):
            out += re.escape(glob[i + 1])
            i += 1
        elif glob[i] == "*":
            j = i
            while j < len(glob) and glob[j] == "*":
                j += 1
            out += "[^/]*" if j - i == 1 else ".*"
            i = j - 1
        else:
            out += "[^/]" if glob[i] == "?" else re.escape(glob[i])
        i += 1
    return re.compile(out, re.S)


@pytest.mark.parametrize("seed", range(4))
def test_automaton_matches_as_regular_expressions_do(seed):
    draw = random.Random(seed)
    globs = ["".join(draw.choice(["a", "b", "/", "é", "*", "**", "?", "\\*", "."]) for _ in range(draw.randint(0, 9))) for _ in range(40)]
    urls = ["".join(draw.choice("aab/é.*") for _ in range(draw.randint(0, 14))) for _ in range(300)]
    automaton = Automaton(globs)
    assert automaton.words > 2
    got = automaton.matches([u.encode() for u in urls])
    for i, u in enumerate(urls):
        assert [bool(as_regex(g).fullmatch(u)) for g in globs] == got[i].tolist(), u


def test_long_urls_walk_alone(monkeypatch):
    globs, urls = ["a*b**", "**c", "*" * 2 + "x" * 130 + "**"], [("a" * 90 + "b/") * 3, "a" * 50 + "c", "y" * 20 + "x" * 140, ""]
    plain = Automaton(globs).matches([u.encode() for u in urls])
    monkeypatch.setattr(url_filter, "ALONE", 8)
    assert (Automaton(globs).matches([u.encode() for u in urls]) == plain).all()
    assert plain.tolist() == [[True, False, False], [False, True, False], [False, False, True], [False] * 3]


ROWS = [
    (1, "http://www.Example.com/en/x?q=1", "www.example.com/en/", "allow"), (2, "http://m.example.com/en/1#a", "example.com/en/", "block"),
    (3, "https://casino.example.com", None, "block"), (4, "https://a.net/es", None, "allow"), (5, "https://a.net/es/", "net/es/", "block"),
    (6, None, None, "allow"), (7, "no scheme", None, "allow"), (8, "x://casino-win.example.com/de/1", "com/", "allow"),
    (9, "x://" + "a" * 20_000 + ".com/" + "é" * 20_000, "com/", "allow"), (None, "x://xnet/es/", None, "allow"), (1, "http://www.Example.com/en/x?q=1", "www.example.com/en/", "allow"),
    (10, "", None, "allow"), (11, "a://b://net/es/", None, "allow"), (12, "a://net/fr/1", "net/fr/", "block"), (13, "a://spam.org?x=/en/", None, "block"),
]


def test_verdicts_and_edges(spark):
    pages = spark.createDataFrame([(i, u) for i, u, *_ in ROWS], "page_id long, url string")
    for extra in ([], ["host", "path", "rule", "verdict", "globs", "rank"]):
        got = judge_urls(pages.select("*", *[F.lit("z").alias(c) for c in extra])).collect()
        assert sorted((str(r.page_id), r.rule, r.verdict) for r in got if r.rule) == sorted((str(i), r, v) for i, _, r, v in ROWS if r)
        assert sorted((str(r.page_id), r.verdict) for r in got) == sorted((str(i), v) for i, _, _, v in ROWS)
    assert judge_urls(pages.filter("false")).collect() == []
    assert [r.host for r in judge_urls(pages.filter("page_id = 13")).collect()] == ["spam.org"]


def test_ties_many_rules_and_no_rules(spark):
    pages = spark.createDataFrame([(1, "h://a.b.c/x/y"), (2, "h://q.c/")], "page_id long, url string")
    rules = [Rule("allow", "b.c", "/x"), Rule("block", "a.b.c", ""), Rule("allow", "a.b.c", "")] + [Rule("block", f"h{i}.org", "/p/") for i in range(300)]
    got = {r.page_id: r for r in judge_urls(pages, rules, []).collect()}
    # five characters each: block first
    assert (got[1].rule, got[1].verdict, got[2].rule, got[2].verdict) == ("a.b.c", "block", None, "allow")
    assert [r.verdict for r in judge_urls(pages, [], []).collect()] == ["allow"] * 2

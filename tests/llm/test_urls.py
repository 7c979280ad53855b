"""URL rules against a plain reading of them."""

from fnmatch import fnmatchcase

from hypothesis import given, settings, strategies as st

from tabulant.llm.urls import RULES, Automaton, Rule, judge


def plain(url, rules=RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut].lower() if rest[:cut].isascii() else rest[:cut], rest[cut:]
    path = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best.verdict if best else "allow"


URLS = ["http://a.net/", "http://net/x", "http://net", "http://NET/a://b", "https://x.example.net/en/1", "https://example.net/enx", "ftp://o.org/fr/",
        "http://forg/fr/", "http://a.com/x.net/y", "http://example.com/de/?q#f", "http://example.com?/de/", "no scheme", "", None, "://", "http://b.net:80/",
        "http://ü.net/é", "http://a.net/" + "x" * 5000, "http://x\n.org/fr/\ny", "a://b://c.org/fr/"]


def test_rules(spark):
    df = spark.createDataFrame([(i, u, "h", "w") for i, u in enumerate(URLS + URLS)], "page_id long, url string, html string, which string")
    found = {r.page_id: tuple(r)[1:] for r in judge(df).collect()}
    assert found == {i: plain(u) for i, u in enumerate(URLS + URLS)}
    assert judge(df.limit(0)).collect() == []


def test_more_rules_than_one_word_holds(spark):
    rules = tuple(Rule(f"h{k}.com", f"/p{k}/", "block") for k in range(60)) + (Rule("com", "", "allow"),)
    urls = [f"http://x.h{k}.com/p{k}/z" for k in range(60)] + ["http://com", "http://h1.com/p2/", "http://other.org/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert {r.page_id: tuple(r)[1:] for r in judge(df, rules).collect()} == {i: plain(u, rules) for i, u in enumerate(urls)}
    assert {r.verdict for r in judge(df, (), default="block").collect()} == {"block"}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab*?", max_size=6), min_size=1, max_size=4), st.lists(st.text("ab", max_size=8), min_size=1, max_size=4))
def test_globs_without_slashes(globs, texts):
    found = Automaton(globs).match([t.encode() for t in texts])
    assert found.tolist() == [[fnmatchcase(t, g) for g in globs] for t in texts]


def test_stars_and_slashes():
    match = lambda g, t: bool(Automaton([g]).match([t.encode()])[0, 0])
    assert match("a*c", "abc") and not match("a*c", "a/c") and match("a**c", "a/c") and match("\\*", "*") and not match("\\*", "a")
    assert match("", "") and not match("", "a") and match("**", "a/b") and not match("*", "a/b")

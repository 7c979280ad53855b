"""Edges of mixing and line removal."""

from tabulant.llm.lines import without_boilerplate
from tabulant.llm.mixing import mix, mixed


def test_mix_takes_each_target_exactly_down_to_a_word(docs):
    rows = [(i, "w " * (i % 7 * 3), None if i % 5 == 0 else f"s{i % 5}") for i in range(200)] + [(None, None, "s1"), (500, "", "zero")]
    found = mix(docs(rows)).collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault((r.source, r.target, r.source_size), []).append(r)
    for (_, target, size), group in by.items():
        assert sum(r.taken for r in group) == int(target) <= 2 * size
    total = sum(r.size for r in found)
    assert abs(sum(t for _, t, _ in by) - 1.5 * total) < 1e-6 * total
    assert sorted(map(str, found)) == sorted(map(str, mix(docs(rows[::-1])).collect()))


def test_mixed_rows_hold_the_words_taken(docs):
    rows = [(i, "\n  one two\tthree\x0bfour   five six " * 4, f"s{i % 3}") for i in range(30)] + [(3, "a b c", "s0")] * 2 + [(None, "x", None)]
    df = docs(rows)
    out = mixed(df)
    assert out.columns == df.columns
    taken = sum(len((r.text or "").split()) for r in out.collect())
    assert taken == sum(r.taken for r in mix(df).collect()) or abs(taken - sum(r.taken for r in mix(df).collect())) < 2
    cut = [r.text for r in out.collect() if r.doc_id not in (3, None) and len(r.text.split()) != 24]
    assert all("\n  one two\tthree\x0bfour   five six ".startswith(t[:20]) and not t[-1].isspace() for t in cut)
    assert mixed(docs([])).collect() == [] and mix(docs([])).collect() == []


def test_lines_of_many_sites_stay_once(docs):
    rows = [(i, f"own {i}\n  same line \r\n\nown {i}", f"site{i}") for i in range(12)]
    rows += [(100 + i, "one site\nfew", "site0" if i % 2 else None) for i in range(30)]
    rows += [(200, None, "a"), (201, "", "b"), (None, "same line", None), (5, rows[5][1], "site5"), (300, "same line\nsame line", "q")]
    df = docs(rows)
    out = without_boilerplate(df).collect()
    assert len(out) == len(rows)
    texts = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in out}
    assert texts[0] == ("own 0\n  same line \r\n\nown 0", 4, 0)
    assert texts[5] == ("own 5\n\nown 5", 4, 1) and sum(r.doc_id == 5 for r in out) == 2
    assert texts[300] == ("", 2, 2) and texts[None] == ("", 1, 1)
    assert texts[200] == (None, 0, 0) and texts[201] == ("", 1, 0) and texts[101] == ("one site\nfew", 2, 0)
    gone = {r.doc_id: r.n_removed for r in without_boilerplate(df, keep_first=False).collect()}
    assert gone[0] == 1 and gone[300] == 2
    assert without_boilerplate(docs([])).collect() == []
    assert without_boilerplate(df).columns == df.columns + ["n_lines", "n_removed"]

"""Random inputs against what pandas and plain Python make of them."""

import random
import re

import pandas as pd
from pyspark.sql import functions as F, types as T

from tabulant.columns import ORDINAL
from tabulant.functions.casts import try_number
from tabulant.functions.display import display_number, float_text, metric_label
from tabulant.functions.text import title_case
from tabulant.sources.delimited import NULL_TOKENS, read_delimited


def test_delimited_files(spark, folder):
    rng = random.Random(3)
    for trial in range(12):
        sep, end = rng.choice([",", "|", "\t"]), rng.choice(["\n", "\r\n"])

        def cell():
            kind = rng.random()
            if kind < 0.25:
                token = rng.choice(NULL_TOKENS)
                return token if rng.random() < 0.5 else f'"{token}"'
            body = "".join(rng.choice(["a", "é", " ", sep, '"', "\n", "\r", "\r\n", "1", "\\", "'", "#"]) for _ in range(rng.randint(0, 8)))
            if kind < 0.6:
                return '"' + body.replace('"', '""') + '"'
            return "".join(c for c in body if c not in (sep, '"', "\n", "\r"))

        width = rng.randint(2, 5)
        rows = []
        for i in range(rng.randint(1, 15)):
            cells = width if i == 0 or rng.random() < 0.8 else rng.randint(1, width)
            rows.append(sep.join([f"r{i}", *(cell() for _ in range(cells - 1))]))
            if rng.random() < 0.1:
                rows.append(rng.choice(["", "  "]))
        text = sep.join(f"c{i}" for i in range(width)) + end + end.join(rows) + rng.choice([end, ""])
        path = folder / f"{trial}.csv"
        path.write_bytes((rng.choice(["", "﻿"]) + text).encode())
        frame = pd.read_csv(path, sep=sep, dtype="string", encoding="utf-8-sig")
        expected = [tuple(None if pd.isna(v) else v for v in row) for row in frame.itertuples(index=False)]
        got = [tuple(r)[:-1] for r in read_delimited(spark, str(path), sep).orderBy(ORDINAL).collect()]
        assert got == expected, text


def test_numbers_from_random_text(spark):
    rng = random.Random(4)
    pieces = ["1", "2", "0", ".", "-", "+", "e", "E5", "inf", "nan", " ", "d", "_", ",", "x"]
    texts = sorted({"".join(rng.choice(pieces) for _ in range(rng.randint(1, 5))) for _ in range(3000)})
    texts += [repr(rng.uniform(-1, 1) * 10 ** rng.randint(-300, 300)) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.x for r in rows.select("t", try_number(F.col("t")).alias("x")).collect()}
    # Exponents out of range make pandas give up even on zero.
    texts = [t for t in texts if not re.search(r"[eE][+-]?\d{3}", t)] + texts[-500:]
    parsed = pd.to_numeric(pd.Series(texts, dtype="string"), errors="coerce")
    expected = {t: None if pd.isna(v) else float(v) for t, v in zip(texts, parsed)}
    wrong = {
        t: (got[t], expected[t])
        for t in texts
        # The last digits may differ, since pandas reads seventeen digits at most.
        if (got[t] is None) != (expected[t] is None)
        or got[t] is not None and got[t] != expected[t] and abs(got[t] - expected[t]) > 1e-12 * abs(got[t])
    }
    assert not wrong, list(wrong.items())[:20]


def test_text_of_numbers(spark):
    rng = random.Random(5)
    values = [rng.choice([-1, 1]) * round(10 ** rng.uniform(-7, 18), rng.randint(0, 6)) for _ in range(2000)]
    values += [0.0, -0.0, 1e-5, 1e-4, 0.001, 1e7, 1e16, 9999999.0, 123456789.125, float("inf")]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = rows.select("v", float_text(F.col("v")).alias("t"), display_number(F.col("v"), T.DoubleType()).alias("d")).collect()
    for row in got:
        # Seventeen-digit doubles may carry one digit more than they need.
        assert float(row.t) == row.v and (row.t == repr(row.v) or len(row.t) > 17), row
        if abs(row.v) < 1e15:
            shown = f"{int(row.v):,}" if row.v.is_integer() else f"{row.v:,.4f}"
            # A tie in the fifth decimal may round either way.
            assert row.d == shown or abs(float(row.d.replace(",", "")) - row.v) <= 0.0000500001, row


def test_titles(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abZ_ 1'-.") for _ in range(rng.randint(1, 9))) for _ in range(2000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in rows.select("t", title_case(F.col("t")).alias("title"), metric_label(F.col("t")).alias("label")).collect():
        assert row.title == row.t.title()
        spaced = " ".join(row.t.replace("_", " ").split())
        assert row.label == (spaced.title() if spaced else row.t)

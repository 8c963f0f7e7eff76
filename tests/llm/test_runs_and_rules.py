"""Runs, rules and hard negatives against plain Python, with odd rows of every kind."""

import functools
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import hard_negatives as hn
from tessera.llm import periodic_runs as pr
from tessera.llm import queries
from tessera.llm import rule_cascade as rc
from tessera.llm.common import utf8_chunks
from tests.llm.test_queries_small import TEXTS, docs, folder  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- op12 --------------------------------------------------------------------------------------


def plain_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def repetitive(draw):
    words = [draw.choice("abcdefg"[: draw.choice([1, 2, 2, 3, 5])]) for _ in range(draw.randrange(60))]
    for _ in range(draw.randrange(3)):
        a, p = draw.randrange(len(words) + 1), draw.randrange(1, 9)
        words[a:a] = words[a : a + p] * draw.randrange(1, 12)
    return words


@pytest.mark.parametrize("limit", [1, 400, 1 << 20])
def test_runs_of_batches_equal_plain_python(limit):
    draw = random.Random(limit)
    texts = [draw.choice(["", " ", "\n"]) + draw.choice([" ", "  ", "\x0b\r\n"]).join(repetitive(draw)) + draw.choice(["", "\f"]) for _ in range(800)]
    for a, b, data, offsets in utf8_chunks(pa.array([*texts, None, ""]), limit):
        w = pr.words_of(data, offsets)
        runs = pr.runs_of(w)
        text, cuts = pr.collapsed(w, offsets, runs)
        for k in range(a, min(b, len(texts))):
            words = WORD.findall(texts[k])
            want = plain_runs(words)
            assert [tuple(r[1:]) for r in runs[runs[:, 0] == k - a].tolist()] == want
            assert bytes(text[cuts[k - a] : cuts[k - a + 1]]).decode() == plain_collapsed(words, want)


def test_runs_of_very_long_texts():
    one = ("same " * 400_000).strip()
    nested = ("a b a b a b a b c " * 60_000).strip()
    plain = " ".join(f"w{k}" for k in range(700_000))
    w = pr.words_of(*next(utf8_chunks(pa.array([one, nested, plain]), 1 << 40))[2:])
    runs = pr.runs_of(w).tolist()
    assert runs[0] == [0, 0, 400_000, 1] and [1, 0, 540_000, 9] in runs and runs.count([1, 9, 8, 2]) == 1
    assert len(runs) == 1 + 1 + 60_000


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_op12(spark, folder, tmp_path):  # noqa: F811
    draw = random.Random(3)
    rows = [(k, " ".join(repetitive(draw)) if k % 3 else f" x{k}\n" * (k % 40)) for k in range(300)]
    rows += [(i, t) for i, t, _ in TEXTS]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in rows:
        words = planted(i, WORD.findall(t or "")) if i is not None else WORD.findall(t or "")
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, plain_collapsed(words, runs)))))
    got = queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sum(r[1] for r in want) > 200


# --- op11 --------------------------------------------------------------------------------------


@functools.cache
def plain_rules(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    windows = [tuple(words[i : i + 3]) for i in range(n - 2)]
    times = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 3)}
    chars, symbols, copies = sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len({*lines})
    failed = n < 50 or 100 * len(repeated) > 50 * n
    rejected = {
        "word_length": chars < 3 * n or chars > 10 * n,
        "symbols": 10 * symbols > n,
        "letterless": 5 * sum(not re.search("[A-Za-z]|[^\x00-\x7f]", w) for w in words) > n,
        "shouting": len(re.findall("[A-Z]", text)) > len(re.findall("[a-z]", text)),
        "stutter": 5 * sum(a == b for a, b in zip(words, words[1:])) > n,
        "copied_lines": 2 * copies > len(lines),
        "bullets": 10 * sum(x[0] in "-*" for x in lines) > 9 * len(lines),
        "cut_lines": 10 * sum(x.endswith("...") for x in lines) > 3 * len(lines),
    }
    return (n, chars, symbols, copies, len(repeated), failed, not failed and not any(rejected.values())), rejected


def ruled(draw):
    words = [draw.choice(["über", "River", "stone", "wall", "你好", "looks", "x1"]) + str(draw.randrange(40)) for _ in range(draw.randrange(30, 140))]
    kind = draw.randrange(9)
    if kind == 1:
        words = [w.upper() for w in words]
    if kind == 2:
        words = [w + "***" * draw.randrange(2) for w in words]
    if kind == 3:
        words = [w for w in words for _ in range(draw.randrange(1, 3))]
    if kind == 4:
        words = [draw.choice([w, "12"]) for w in words]
    if kind == 5:
        words = [w * draw.choice([1, 4]) for w in words]
    lines = [" ".join(words[k : k + 7]) for k in range(0, len(words), 7)]
    if kind == 6:
        lines = ["- " + x for x in lines]
    if kind == 7:
        lines = [x + draw.choice(["", "..."]) for x in lines]
    if kind == 8:
        lines += draw.choices(lines, k=draw.randrange(20))
    return "\n".join(lines) + draw.choice(["", "\n", " \n\n", "\r"])


def test_rules_of_batches_equal_plain_python():
    draw = random.Random(11)
    texts = [*(ruled(draw) for _ in range(300)), "", None, " \n ", "one", *(t for _, t, _ in TEXTS)]
    seen = set()
    for a, b, data, offsets in utf8_chunks(pa.array(texts), 9000):
        batch = rc.Texts(pr.words_of(data, offsets), offsets)
        counts, failed = rc._base(batch)
        some = np.array([k % 3 > 0 for k in range(b - a)])
        for view, own in ((batch, range(a, b)), (batch.only(some), [a + k for k in np.flatnonzero(some)])):
            for rule in rc.RULES:
                want = [plain_rules(texts[k])[1][rule.name] for k in own]
                assert rule.rejects(view).tolist() == want, rule.name
                seen |= {(rule.name, x) for x in want}
        want = [plain_rules(texts[k])[0] for k in range(a, b)]
        assert [tuple(x) for x in np.column_stack(counts).tolist()] == [w[:5] for w in want] and failed.tolist() == [w[5] for w in want]
    assert len(seen) == 2 * len(rc.RULES)


def test_op11(spark, tmp_path):
    draw = random.Random(12)
    rows = [(k, ruled(draw)) for k in range(200)] + [(i, t) for i, t, _ in TEXTS]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_rule_cascade"](spark, str(tmp_path)).collect()
    want = sorted(((i, *plain_rules(t)[0]) for i, t in rows), key=repr)
    assert sorted(map(tuple, got), key=repr) == want
    assert 20 < sum(r[-1] for r in want) < 200


def test_verdicts_do_not_depend_on_the_order(spark):
    draw = random.Random(13)
    rows = spark.createDataFrame([(k, ruled(draw)) for k in range(120)], "doc_id long, text string")
    one = sorted(map(tuple, rc.apply_cascade(rows, rc.RULES).collect()))
    assert one == sorted(map(tuple, rc.apply_cascade(rows, rc.RULES[::-1]).collect()))
    plan = rc.plan_cascade(rows, sample_rows=1000)
    assert {e.name for e in plan} == {r.name for r in rc.RULES} and all(e.seconds >= 0 for e in plan)


def test_greedy_order_counts_what_is_left():
    # a rejects 60 and b 50 of the same 60; c rejects other 20. After a, only c has something left to reject.
    masks = {0b000: 20, 0b001: 10, 0b011: 50, 0b100: 20}
    assert [e.name for e in rc.ordered(masks, [1.0, 1.0, 1.0], "abc")] == ["a", "c", "b"]
    assert [e.name for e in rc.ordered(masks, [1.0, 0.1, 1.0], "abc")] == ["b", "c", "a"]
    assert [round(e.rejected, 3) for e in rc.ordered(masks, [1.0, 1.0, 1.0], "abc")] == [0.6, 0.5, 0.0]
    assert [e.name for e in rc.ordered({}, [0.3, 0.1], "ab")] == ["b", "a"]


# --- op13 --------------------------------------------------------------------------------------


def plain_negatives(rows, anchors, positives=5, negatives=3):
    """rows: (id, label, whole numbers); anchors: places in rows."""
    out = []
    for k in anchors:
        score = lambda r: sum(x * y for x, y in zip(rows[k][2], r[2]))
        others = [(-score(r), r[0], r[1]) for j, r in enumerate(rows) if j != k and len(r[2]) == len(rows[k][2])]
        for p, pid, _ in sorted(r for r in others if r[2] == rows[k][1])[:positives]:
            fit = sorted(r for r in others if r[2] != rows[k][1] and -50 * p <= -100 * r[0] <= -95 * p)
            out += [(rows[k][0], pid, rank, nid, -p, -s) for rank, (s, nid, _) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def vectors_of(n, dim, seed, labels=4):
    draw = np.random.default_rng(seed)
    base = draw.integers(-60, 60, (max(2, n // 5), dim))
    x = base[draw.integers(0, len(base), n)] + draw.integers(-9, 9, (n, dim)) * draw.integers(0, 3, (n, 1))
    return [(int(k), int(draw.integers(0, labels)), [float(v) for v in row]) for k, row in enumerate(x)]


@pytest.mark.parametrize(("dim", "sample"), [(1, 100), (3, 100), (20, 5), (64, 1000)])
def test_hard_negatives_equal_plain_python(spark, monkeypatch, dim, sample):
    for name, value in (("ANCHOR_BLOCK", 9), ("ROW_BLOCK", 50), ("STEP", 16)):
        monkeypatch.setattr(hn, name, value)
    rows = vectors_of(400, dim, dim)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("score", F.lit(1))
    got = hn.hard_negatives(df, F.col("vec_id") % 13 == 0, sample_rows=sample)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, range(0, 400, 13))


def test_hard_negatives_of_odd_rows(spark):
    rows = vectors_of(60, 4, 1, labels=2)
    rows += [rows[0], rows[0], rows[7]]  # repeated rows, an anchor among them
    rows += [(100, 0, [0.0] * 4), (101, 1, [0.0] * 4), (102, 0, [1e9, -3e9, 2.0, 1e9]), (103, 1, [2e9, -1e9, 1.0, 3.0]), (104, 1, [3.0, 1.0])]
    odd = [(None, 1, [1.0] * 4), (105, None, [1.0] * 4), (106, 1, None), (107, 1, []), (108, 1, [None] * 4), (109, 0, [float("nan")] * 4), (110, 0, [float("inf")] * 4)]
    df = spark.createDataFrame(rows + odd, "vec_id long, label int, embedding array<double>")
    anchors = [k for k, r in enumerate(rows) if r[0] % 10 == 0]
    assert sorted(map(tuple, hn.hard_negatives(df, F.col("vec_id") % 10 == 0).collect())) == plain_negatives(rows, anchors)
    assert hn.hard_negatives(df.limit(0), F.lit(True)).count() == 0 and hn.hard_negatives(df, F.lit(None).cast("boolean")).count() == 0


def test_scores_beyond_a_long_are_its_end():
    huge = np.array([[1e300, -1e300], [2.0**40, 2.0**40]])
    got = hn.exact_products(huge, huge)
    assert got.tolist() == [[2**63 - 1, 0], [0, 2**63 - 1]]
    assert hn.exact_products(np.array([[2.0**30, 3.0]]), np.array([[2.0**30, 1.0]])).tolist() == [[2**60 + 3]]


def test_bounds_hold_at_every_level_and_get_tighter():
    draw = np.random.default_rng(4)
    x = np.floor(draw.standard_normal((300, 5)) @ draw.standard_normal((5, 64)) * 40 + draw.standard_normal((300, 64)) * 10)
    turned = x @ hn.fit_rotation(x[:200])
    assert np.allclose(turned @ turned.T, x @ x.T)
    exact, wide = x @ x.T, []
    for level in hn.levels(hn.summaries(turned, 32)):
        means, away = np.hsplit(level, 2)
        assert (np.abs(exact - means @ means.T) <= away @ away.T + 1e-6 * np.abs(exact).max()).all()
        wide.append((away @ away.T).mean())
    assert len(wide) == 2 and wide == sorted(wide, reverse=True)


def test_op13(spark, tmp_path):
    draw = np.random.default_rng(9)
    base = draw.standard_normal((8, 16))
    rows = [(k, [float(np.float32(v)) for v in (base[k % 8] + 0.4 * draw.standard_normal(16)) / 4], int(draw.integers(0, 10))) for k in range(500)]
    rows += [(350, None, 3), (700, [0.5] * 16, None), (701, [float("nan")] * 16, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    whole = [(k, (label + 1) % 10 if k % 7 == 0 else label, [int(np.floor(256 * x)) for x in v]) for k, v, label in rows[:500]]
    got = queries.QUERIES["op13_hard_negatives"](spark, str(tmp_path)).collect()
    want = plain_negatives(whole, range(0, 500, 50))
    assert sorted(map(tuple, got)) == want and len(want) > 60

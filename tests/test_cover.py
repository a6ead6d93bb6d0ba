"""The lazy greedy cover against a plain one."""

from __future__ import annotations

import random

import pytest

from tidemark.functions import rules


def plain(rows, target, precision=0.95, least=3, most=12):
    held = {}
    for i, (chunks, label) in enumerate(rows):
        for c in set(chunks or ()):
            held.setdefault(c, []).append((i, label == target))
    good = {c: ({i for i, hit in x if hit}, len(x)) for c, x in held.items() if len(x) >= least and sum(h for _, h in x) >= precision * len(x) and any(h for _, h in x)}
    out, covered = [], set()
    while len(out) < most and good:
        best = min(good, key=lambda c: (-len(good[c][0] - covered), -len(good[c][0]) / good[c][1], -good[c][1], c))
        if not good[best][0] - covered:
            break
        out.append(best)
        covered |= good[best][0]
    return out


@pytest.mark.parametrize("page", [1, 3, 64])
def test_equal_to_a_plain_greedy(spark, monkeypatch, page):
    monkeypatch.setattr(rules, "EVALUATED", page)
    r = random.Random(page)
    rows = [([f"c{min(int(r.expovariate(0.12)), 60)}" for _ in range(r.randint(0, 4))] * 2, r.choice("yyyn")) for _ in range(400)] + [(None, "y"), ([], "n")]
    df = spark.createDataFrame(rows, "chunks array<string>, label string").repartition(3)
    for precision, most in ((0.7, 12), (0.5, 40), (0.95, 12)):
        got = rules.mine_triggers(df, "chunks", "label", "y", precision=precision, most=most)
        assert got == plain([tuple(x) for x in df.collect()], "y", precision=precision, most=most)
    assert rules.mine_triggers(df.limit(0), "chunks", "label", "y") == []


def test_few_candidates_are_counted_anew(spark, monkeypatch):
    """A thousand chunks of one row less each: a round needs the first few of them only."""
    rows = [([f"{c:04d}"], "y") for c in range(300) for _ in range(3 + c % 5)]
    df = spark.createDataFrame(rows, "chunks array<string>, label string")
    asked = []
    held = rules.Cover._held
    monkeypatch.setattr(rules.Cover, "_held", lambda self, chunks: asked.append(len(chunks)) or held(self, chunks))
    monkeypatch.setattr(rules, "EVALUATED", 8)
    assert len(rules.mine_triggers(df, "chunks", "label", "y", most=3)) == 3
    assert sum(asked) < 150  # a plain greedy counts 900

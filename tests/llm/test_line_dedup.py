"""Line dedup against all pairs of documents, compared by a search of its own."""

from __future__ import annotations

import random

from tidemark.llm import line_dedup

VOCABULARY = [f"w{i}" for i in range(900)]


def line(r, least=1, most=12):
    return " ".join(r.choice(VOCABULARY) for _ in range(r.randint(least, most)))


def all_pairs(docs, words=20, gap=2):
    """doc -> places that stand in a block of `words` words that an earlier document has at
    the same distances, at most `gap` other lines between two: every pair, every shift."""
    out = {}
    for b in sorted(docs):
        gone = set()
        for a in sorted(docs):
            if a >= b:
                break
            for shift in range(-len(docs[b]), len(docs[a])):
                run, n = [], 0
                for j, x in [*enumerate(docs[b]), (10**9, None)]:
                    hit = x is not None and 0 <= j + shift < len(docs[a]) and docs[a][j + shift] == x
                    if run and (x is None or hit and j - run[-1] > gap + 1):
                        if n >= words:
                            gone.update(run)
                        run, n = [], 0
                    if hit:
                        run.append(j)
                        n += len(x.split())
        out[b] = gone
    return out


def removed(spark, docs):
    """doc -> places that the operator deletes."""
    df = spark.createDataFrame([(i, "\n".join(x)) for i, x in docs.items()], "id long, text string").selectExpr("id", "xxhash64(text) AS t", "text")
    got = {r.id: {p for x in r.gone for p in range(x.a, x.b + 1)} for r in line_dedup.removals(df).collect()}
    return {i: got.get(i, set()) for i in docs}


def crawl(seed, n):
    """Pages of own lines, boilerplate of their site, passages shared by several sites, and edited copies."""
    r = random.Random(seed)
    sites = [[line(r, 2, 8) for _ in range(r.randint(1, 4))] for _ in range(4)]
    passages = [[line(r, 4, 12) for _ in range(r.randint(2, 7))] for _ in range(8)]
    docs = {}
    for i in range(n):
        if docs and r.random() < 0.2:
            page = [line(r) if r.random() < 0.15 else x for x in docs[r.choice(list(docs))]]
        else:
            page = [line(r) for _ in range(r.randint(1, 8))]
            for p in r.sample(passages, r.randint(0, 3)):
                at = r.randint(0, len(page))
                page[at:at] = p[r.randint(0, 1) :]
            page = r.choice(sites) + page + r.choice(sites)[:2]
        docs[i] = page
    return docs


def test_recall_against_all_pairs(spark):
    found = wanted = extra = 0
    for seed in range(4):
        docs = crawl(seed, 60)
        want, got = all_pairs(docs), removed(spark, docs)
        wanted += sum(map(len, want.values()))
        found += sum(len(want[i] & got[i]) for i in docs)
        extra += sum(len(got[i] - want[i]) for i in docs)
    assert wanted > 500 and extra == 0
    assert found / wanted >= 0.99, (found, wanted)


def pair_lines(a, b):
    """The lines that two documents share, as the search of blocks takes them."""
    held = {}
    for side, doc in enumerate((a, b)):
        for place, x in enumerate(doc):
            held.setdefault(x, ([], []))[side].append(place)
    return [(k, p, q, len(x.split()), 2 + k % 40) for k, (x, (p, q)) in enumerate(sorted(held.items())) if p and q]


def test_alignment_finds_what_all_shifts_find():
    """Pairs of documents of few and of many different lines, in any order: exactly the places
    that a search of all shifts finds."""
    r = random.Random(7)
    for k in range(400):
        lines_ = [line(r, 1, 14) for _ in range(r.choice((2, 5, 12, 60)))]
        a, b = ([r.choice(lines_) if r.random() < 0.9 else line(r) for _ in range(r.randint(0, 40))] for _ in range(2))
        if k % 3 == 0 and len(a) > 6:
            b[len(b) // 2 :] = a[3:] + a[:3]
        assert line_dedup.common_blocks(pair_lines(a, b)) == all_pairs({0: a, 1: b})[1]


def test_the_alignment_decides(monkeypatch):
    block = [f"line {i} of eight words in the block" for i in range(4)]
    assert line_dedup.common_blocks(pair_lines(["x", *block], [*block, "y"])) == {0, 1, 2, 3}
    monkeypatch.setattr(line_dedup, "patience", lambda *args: [])
    assert line_dedup.common_blocks(pair_lines(["x", *block], [*block, "y"])) == set()


def test_rare_lines_find_any_earlier_holder(spark):
    """A block with gaps whose lines are first held, two by two, by other documents."""
    r = random.Random(8)
    b = [line(r, 8, 8) for _ in range(4)]
    fill = lambda: line(r, 30, 30)
    docs = {1: [b[0], fill(), b[1]], 2: [b[1], fill(), b[2]], 3: [b[2], fill(), b[3]], 4: [b[0], fill(), b[1], fill(), b[2], fill(), b[3]], 5: [b[0], fill(), b[1], fill(), b[2], fill(), b[3]]}
    assert removed(spark, docs) == all_pairs(docs)
    assert removed(spark, docs)[5] == {0, 2, 4, 6}


def test_blocks_of_mixed_owners(spark):
    """Each line of the block stands first in a document of its own; 9 has it from 8."""
    r = random.Random(5)
    block = [line(r, 8, 8) for _ in range(4)]
    docs = {k: [x, line(r, 40, 40)] for k, x in zip((1, 2, 5, 6), block, strict=True)} | {k: [line(r, 40, 40), *block] for k in (8, 9)}
    assert removed(spark, docs) == all_pairs(docs) == {1: set(), 2: set(), 5: set(), 6: set(), 8: set(), 9: {1, 2, 3, 4}}


def test_a_very_long_line_and_very_many(spark):
    r = random.Random(6)
    long = " ".join(r.choice(VOCABULARY) for _ in range(400_000))
    many = [line(r, 3, 6) for _ in range(20_000)]
    docs = {1: [long, "a b"], 2: ["c d", long], 3: many, 4: [*many[5000:], "e f"]}
    got = removed(spark, docs)
    assert got == {1: set(), 2: {1}, 3: set(), 4: set(range(15_000))}


def test_columns_with_the_names_of_results(spark):
    df = spark.createDataFrame([(1, "x", 7, "y"), (2, None, 7, "y")], "doc_id long, text string, n_lines int, kept string").selectExpr("*", "1 AS id", "2 AS gone")
    got = {x.doc_id: x for x in line_dedup.line_dedup(df).collect()}
    assert (got[1].n_lines, got[1].kept, got[1].id, got[1].gone) == (1, True, 1, 2) and (got[2].n_lines, got[2].text) == (0, None)

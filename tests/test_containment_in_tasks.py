"""Few names are looked up where the texts lie: against brute force, and by its plan."""

from __future__ import annotations

import random

import pyarrow as pa

from tidemark.operators.containment import _pairs, contained


def found(texts, names, span):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([x.encode() for x in texts], pa.binary())], ["k", "says"])
    parts = (batch, batch.slice(0, 0), batch.slice(3), batch.slice(0, 3))
    got = [[(r["k"], r["n"].decode()) for out in _pairs([x.encode() for x in names], ["k", "n"], span)([p]) for r in out.to_pylist()] for p in parts]
    assert not got[1] and sorted(got[2] + got[3]) == sorted(got[0])
    return sorted(got[0])


def test_words_equal_brute_force():
    r = random.Random(3)
    for letters in ("ab", "abcdé😀 \0", "a"):
        texts = ["", "a", "", *("".join(r.choice(letters) for _ in range(r.randint(0, 200))) for _ in range(12)), ""]
        names = {"".join(r.choice(letters) for _ in range(r.randint(1, 40))) for _ in range(200)}
        names |= {x[a : a + n] for x in texts for n in (1, 7, 8, 9, 15, 16, 17, 24, 25, 33, 200) for a in (0, 3, len(x) - n) if 0 <= a <= len(x) - n}
        # What stands only over the edge of two texts is in neither.
        names |= {texts[3][-5:] + texts[4][:5], texts[5][-1:] + texts[6][:20]} - {""}
        names = sorted(names)
        want = sorted((i, n) for i, x in enumerate(texts) for n in names if n in x)
        assert len(want) > 300 or letters == "a"
        for span in (61, 1 << 17):
            assert found(texts, names, span) == want


def test_texts_are_read_once_and_not_shuffled(spark):
    # Names of few syllables share all their runs: a text used to be joined with, and searched for, hundreds of them.
    r = random.Random(4)
    word = lambda n: "".join(r.choice(("tion", "ha", "re", "nd", "ing", "er")) for _ in range(n))
    names = sorted({word(r.randint(2, 5)) for _ in range(400)})
    texts = [" ".join(word(r.randint(1, 6)) for _ in range(50)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, says string")
    out = contained(df, "k", "says", spark.createDataFrame([(x,) for x in names], "name string"), "name")
    assert sorted(map(tuple, out.collect())) == sorted((i, n) for i, x in enumerate(texts) for n in names if n in x)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Join", "Exchange", "Generate"))
    assert out.schema.simpleString() == "struct<k:int,name:string>"


def test_many_bytes_of_names_meet_by_a_join(spark):
    names = ["x" * 50 + str(i) for i in range(5)]
    df = spark.createDataFrame([(1, "a" + names[0] + "b"), (2, names[3]), (3, None)], "k int, says string")
    out = contained(df, "k", "says", spark.createDataFrame([(x,) for x in names], "name string"), "name", most=5)
    assert sorted(map(tuple, out.collect())) == [(1, names[0]), (2, names[3])]
    assert "Join" in out._jdf.queryExecution().executedPlan().toString()

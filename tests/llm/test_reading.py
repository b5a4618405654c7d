import random

from linkloom.llm import reading as R, tokens

TEXT = """[copied] Subject: Beacon: trace

# Heading of the note

The keeper walks to the harbor and lights the lamp. He waits there (see `Function:a.b`) for an hour
until the boats
return.

- The first item has no stop
* The second item ends.
1. Third (see the log)!

```
code(1);
```

    at com.x.Y.z(Y.java:5)
2025-01-02 03:04:05.678 WARN  [x-1] y=2
| a | b |
|---|---|
{"a": {"b": [0.1, 0.2]}}
https://x.example/y
 
Short title
"""


def test_prose_and_counts():
    units = R.prose_units(TEXT)
    assert units == ["The keeper walks to the harbor and lights the lamp. He waits there for an hour until the boats return.", "The first item has no stop", "The second item ends.", "Third!"]
    english, words, sentences, syllables, rank = R.measure(TEXT, len)
    assert english and (words, sentences) == (31, 5) and rank == 6  # 27 of 31 words have up to six letters
    assert R.measure(None, len) == (False, 0, 0, 0, None) and R.measure("", len)[1] == 0
    assert not R.measure("Die Datei prüft jede Version vor dem Start und das System meldet nicht.", len)[0]
    assert [R.syllables(w) for w in ("the", "table", "make", "documentation", "non-deterministic")] == [1, 2, 1, 5, 6]


EASY, HARD = "the cat sat on a mat and we go to it".split(), "the documentation characterizes heterogeneous instrumentation and authoritative representation of interoperable serialization".split()


def text(rng, hard, length, words=140):
    out = []
    while sum(map(len, out)) < words:
        out.append([rng.choice(HARD if rng.random() < hard else EASY) for _ in range(length)])
    return " ".join(" ".join(s).capitalize() + "." for s in out)


LEVELS = {1: (0.0, 7), 2: (0.2, 12), 3: (0.4, 18), 4: (0.7, 22), 5: (1.0, 30)}


def test_held_out_texts_get_their_band(spark):
    rng = random.Random(4)
    anchors = [(i, b, text(rng, *LEVELS[b])) for i, b in enumerate(b for b in LEVELS for _ in range(8))]
    held = [(100 + i, b, text(rng, *LEVELS[b])) for i, b in enumerate(b for b in LEVELS for _ in range(12))]
    docs = [(i, t) for i, _, t in held] + [(1, None), (2, ""), (3, "Too short."), (4, "Die Datei und das System. " * 30), (100, held[0][2])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as band", "'x' as words")
    samples = spark.createDataFrame(anchors, "anchor_id long, band int, text string")
    got = R.levels(frame, samples).toPandas()
    assert set(got.doc_id) == {i for i, _, _ in held} and len(got) == len(held) + 1
    right = sum(got[got.doc_id == i].band.iloc[0] == b for i, b, _ in held)
    assert right / len(held) >= 0.9
    assert R.levels(frame.limit(0), samples).count() == 0 and R.levels(frame, samples.limit(0)).count() == 0


def test_ranks_of_words_and_what_they_add(spark):
    rank = tokens.word_ranks(tokens.words_path())
    assert 0 < rank("the") < rank("harbor") < rank("instrumentation") < rank("interoperableness")
    rng = random.Random(6)
    anchors = spark.createDataFrame([(i, b, text(rng, *LEVELS[b])) for i, b in enumerate(b for b in LEVELS for _ in range(8))], "id long, band int, text string")
    rows = R.measured(anchors, "id").join(anchors.select("id", "band"), "id").cache()
    assert all(w > 0 for w in R.calibrate(rows, R.TRAITS)[0][1:])  # longer sentences and rarer words are more demanding
    assert R.calibrate(rows.limit(0), R.TRAITS) == ([], [], [])

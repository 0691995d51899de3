import random

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n))


def near(text):
    words = text.split()
    words[len(words) // 2] = "changed"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    t = [prose(rng, 150) for _ in range(8)]
    return [
        (1, t[0]), (None, near(t[0])), (None, t[1]),  # a null copy of a named row, and a null row of its own
        (2, t[2]), (2, t[3]),  # one id, two texts
        (3, t[4]), (3, t[4]), (3, t[4]),  # rows that repeat id and text
        (None, t[5]), (None, t[5]), (None, near(t[5])),  # a group without ids
        (4, t[6]), (5, near(t[6])), (4, t[7]), (6, near(t[7])), (None, None), (None, None), (7, ""), (7, "  "),
    ]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def groups(rows):
    """The rows' places by brute-force links of their shingles; rows without words are in none."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    label = list(range(len(rows)))
    for _ in rows:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= 75 * len(x | y):
                    label[a] = label[b] = min(label[a], label[b])
    found = {}
    for k, x in enumerate(sets):
        if x:
            found.setdefault(label[k], []).append(k)
    return list(found.values())


def test_ngram_jaccard_keeps_one_row_of_each_group(spark, rows):
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.ngram_jaccard(spark, table(spark, rows).repartition(3), "").collect()]
    every = groups(rows)
    for places in every:
        own = {rows[k] for k in places}
        assert [x in own for x in kept].count(True) == 1
        named = [i for i, _ in own if i is not None]
        assert next(x for x in kept if x in own)[0] == (min(named) if named else None)
    without = [x for x in rows if not (x[1] or "").split()]
    assert len(kept) == len(every) + len(without) and all(kept.count(x) == without.count(x) for x in without)


def test_run(spark, rows, tmp_path, monkeypatch):
    # The rules of quality have a test of their own; random letters wouldn't pass them.
    stages = [(n, (lambda spark, docs, sf_dir: docs) if n == "quality" else s) for n, s in corpus_pipeline.STAGES]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    leak = rows[2][1]
    spark.createDataFrame([(1, " ".join(leak.split()[:60]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    text = " ".join(r["text"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    for places in groups(rows):
        there = any(rows[k][1][:60] in text for k in places)
        assert there == (leak not in {rows[k][1] for k in places})


def test_line_dedup_drops_lines_with_letters_changed_in_many_words(spark):
    """The stage removes a line above 120 characters that differs by a letter in three of ten words."""
    words = [w for c in "abcdefghijklmnopqrst" for w in (f"word{c}", f"q{c}")]
    one, other = " ".join(words), " ".join("z" + w[1:] if i % 2 and i < 24 else w for i, w in enumerate(words))
    docs = spark.createDataFrame([(1, one), (2, f"{other}\nand a last line")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.line_deduplication(spark, docs, "").collect()} == {1: one, 2: "and a last line"}


def test_quality_goes_to_python_in_small_batches(spark):
    """The first stage doesn't send Spark's ten thousand texts at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        corpus_pipeline.quality_rules(spark, spark.createDataFrame([(1, "a b")], "doc_id long, text string"), "")
        assert int(spark.conf.get(key)) == 1000
    finally:
        spark.conf.set(key, was)

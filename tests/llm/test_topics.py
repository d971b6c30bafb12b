"""Topics of problem 7 come from all documents."""

import numpy as np

from kinefold.llm import mixing

TARGETS = "source string, target_share double, max_repeats int"


def texts(n):
    rng = np.random.default_rng(4)
    words = [["goal", "keeper", "corner", "penalty", "striker"], ["flour", "butter", "oven", "sugar", "yeast"], ["guitar", "drum", "choir", "violin", "opera"]]
    return [" ".join(rng.choice(words[k % 3], 12)) for k in range(n)]


def counted(spark, rows, parts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "doc_id bigint, text string").repartition(parts)
    return mixing.count_tokens(df, features=True)


def test_topics_are_those_of_all_documents_however_they_are_laid_out(spark):
    rows = texts(90)
    fits = [mixing.fit_topics(mixing.Stored(counted(spark, rows, parts)), 3) for parts in (1, 5)]
    assert np.array_equal(fits[0].centres, fits[1].centres) and np.array_equal(fits[0].weights, fits[1].weights)
    encoding = mixing._encoding(mixing.TOKENIZER)
    counts = np.array([mixing.hashed_counts(encoding, t) for t in rows])
    assert np.array_equal(mixing.Local(counts).presence(), mixing.Stored(counted(spark, rows, 3)).presence())
    assert np.array_equal(mixing.Local(counts).sums(fits[0]), mixing.Stored(counted(spark, rows, 3)).sums(fits[0]))
    near = fits[0].nearest(counts)
    assert len(set(near)) == 3 and all(len(set(near[k::3])) == 1 for k in range(3))
    topics = {r.doc_id: r.topic for r in mixing.with_topics(counted(spark, rows, 2), fits[0]).collect()}
    assert topics == {k: f"topic_{v}" for k, v in enumerate(near)}


def test_documents_beyond_the_first_4000_count_for_topics(spark):
    """No document is left out of the fit: 4,100 documents, all present in the counts that topics are made of."""
    seen = []
    fit = mixing.fit_topics
    mixing.fit_topics = lambda counts, *a, **k: (seen.append(len(counts) if isinstance(counts, np.ndarray) else counts.presence()[-1]), fit(counts, *a, **k))[1]
    try:
        d = spark.createDataFrame([(k, "a", "en", f"words of document {k % 50}") for k in range(4100)], "doc_id bigint, source string, lang string, text string")
        sizes = mixing.sized(d, spark.createDataFrame([("a", 1.0, 1)], TARGETS), topics=2)
    finally:
        mixing.fit_topics = fit
    assert seen == [4100] and sizes.count() == 4100

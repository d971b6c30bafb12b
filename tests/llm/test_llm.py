"""Operators for training data against brute force, with odd input."""

import itertools
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinefold.llm import leakage, mixing, moderation
from kinefold.llm.percentiles import RelativeSketch, build_sketches, merge_sketches, percentiles_of, rank_check
from kinefold.llm.runs import collapse_runs, label_runs
from kinefold.llm.textnorm import plain_text, words


# --- runs -------------------------------------------------------------------------------------


def brute_runs(events):
    out = []
    for (who, value), group in itertools.groupby(sorted(events), key=lambda e: (e[0], e[2])):
        g = list(group)
        out.append((who, value, g[0][1], g[-1][1], len(g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [10, 3, 1])
def test_runs_against_brute_force(spark, size):
    rng = random.Random(size)
    events = [(w, t, rng.choice(["a", "b", None])) for w in (1, 2) for t in range(80) if rng.random() < 0.8]
    df = spark.createDataFrame(events, "w bigint, t bigint, v string").withColumn("b", F.floor(F.col("t") / size))
    got = sorted([(r.w, r.v, r["first"], r["last"], r.events) for r in collapse_runs(df, ["w"], "t", ["v"], "b").collect()], key=str)
    assert got == sorted(brute_runs(events), key=str)


def test_labels_that_say_the_same_are_one_run(make_frames):
    spelled = [("player", "left", "7"), ("PLAYER ", " Left", "No. 7"), ("pLayer", "left\xa0", "０7"), ("player", "LEFT", "#07"), ("player", None, "7"), ("player", "none", "7"), ("player", "-", " 7"), ("goal keeper", "left", "?"), ("Goal-Keeper", "left", None)]
    frames = make_frames({("m", 10 * k): [(1, None, None, *s)] for k, s in enumerate(spelled)})
    got = sorted((r.start_frame, r.end_frame, r.role, r.team, r.jersey, r.readings) for r in label_runs(frames, span=25).collect())
    assert got == [(0, 30, "player", "left", "7", 4), (40, 60, "player", None, "7", 3), (70, 80, "goalkeeper", "left", None, 2)]


def test_runs_of_nothing(make_frames):
    frames = make_frames({("m", 1): [(None, 0, 0)], ("m", 2): None})
    assert label_runs(frames).count() == 0
    assert label_runs(frames.select(*[F.lit(None).cast(t).alias(c) for c, t in frames.dtypes])).count() == 0
    extra = make_frames({("m", 1): [(1, 0, 0)]}).withColumn("role", F.lit(1)).withColumn("block", F.lit(1)).withColumn("id", F.lit(1))
    assert label_runs(extra).count() == 1


# --- percentiles ------------------------------------------------------------------------------


@pytest.mark.parametrize("law", ["normal", "heavy", "ties", "sorted"])
def test_sketch_error_near_the_top(law):
    rng = np.random.default_rng(3)
    v = {"normal": rng.normal(size=300_000), "heavy": rng.pareto(1.0, 300_000), "ties": rng.integers(0, 50, 300_000).astype(float), "sorted": np.arange(300_000.0)}[law]
    parts = [RelativeSketch(seed=k) for k in range(8)]
    for s, p in zip(parts, np.array_split(v, 8)):
        s.update(p)
    whole = RelativeSketch()
    for s in parts:
        for _, level, state, items, n, least, most in s.rows():
            whole.merge(level, state, items)
            whole.take(n, least, most)
    whole._compress()
    assert whole.n == len(v) and sum(len(x) for x in whole.levels) < 320 * whole.k
    order = np.sort(v)
    for q in (0.01, 0.25, 0.5, 0.9, 0.99, 0.999, 0.9999):
        x = whole.quantiles([q])[0]
        low, high, goal = np.searchsorted(order, x, "left") + 1, np.searchsorted(order, x, "right"), max(1, np.ceil(q * len(v)))
        assert max(0, low - goal, goal - high) <= whole.error() * len(v) * (1 - q) + 1


def test_percentiles_by_group_with_nulls(spark):
    rng = np.random.default_rng(5)
    rows = [(rng.choice(["a", "b"]) if rng.random() < 0.9 else None, int(d), float(rng.normal())) for d in range(30) for _ in range(300)]
    rows = [(None if g is None else str(g), d, v) for g, d, v in rows] + [("a", 1, None), ("b", 1, float("nan")), ("only", 2, None)]
    df = spark.createDataFrame(rows, "g string, d int, v double").repartition(5)
    daily = merge_sketches(build_sketches(df, ["d", "g"], "v"), ["d", "g"])
    out = percentiles_of(merge_sketches(daily, ["g"], salts=3), ["g"], [0.5, 0.99])
    got = {(r.g, r.share): r for r in out.collect()}
    assert got["only", 0.5].n == 0 and got["only", 0.5].value is None
    for g in ("a", "b", None):
        exact = sorted(v for k, _, v in rows if k == g and v is not None and v == v)
        assert got[g, 0.5].n == len(exact) and abs(got[g, 0.5].value - exact[len(exact) // 2]) < 0.1
    assert all(r.within for r in rank_check(df, out, ["g"], "v").collect())


def test_lower_percentiles_keep_a_relative_bound(spark):
    df = spark.range(200_000).selectExpr("cast(id % 3 as int) as d", "exp(id / 20000d) as v").repartition(6)
    shares = [0.001, 0.01, 0.05, 0.5, 0.99]
    out = percentiles_of(merge_sketches(merge_sketches(build_sketches(df, ["d"], "v"), ["d"]), [], salts=3), [], shares)
    for r in out.collect():
        rank, goal = np.log(r.value) * 20_000 + 1, np.ceil(r.share * 200_000)
        assert r.n == 200_000 and r.rank_error <= 0.0625 * 200_000 * min(r.share, 1 - r.share) + 1
        assert abs(rank - goal) <= r.rank_error + 0.01


def test_percentiles_of_an_empty_table(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert percentiles_of(merge_sketches(build_sketches(df, ["g"], "v"), ["g"]), ["g"], [0.5]).count() == 0


# --- leakage ----------------------------------------------------------------------------------

PASSAGE = "Given a rusted compass, the silent bugler from Brammere slowly measures 47 lanterns beside the crooked ladder until 12.5 signals vanish near row 9."


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def items(spark, *passages):
    return spark.createDataFrame([(k, "s", p, None) for k, p in enumerate(passages)], "item_id bigint, suite string, passage string, instruction string")


def test_altered_pieces_are_found_and_quotes_are_not(spark):
    filler = "The keeper asked for the ball and the bench was loud. " * 20
    w = PASSAGE.split(" ")
    texts = [
        filler + PASSAGE + filler, PASSAGE.upper(), PASSAGE.replace(" ", "\n \t"), PASSAGE.replace("a", "а").replace("e", "е"), "".join(c + "​" if c == "s" else c for c in PASSAGE),
        " ".join(w[:13]) + ". " + filler, " ".join(w[:8]) + filler + " ".join(w[8:18]), PASSAGE.replace("silent", "silnt").replace("crooked", "crookked").replace("the ", ""), "<p>" + PASSAGE.replace(" ", "&nbsp;") + "</p>", PASSAGE.replace("lanterns", "lan-\nterns"),
        " ".join(w[4:8]) + " " + filler, "Keywords: rusted, compass, bugler, Brammere, lanterns, ladder, signals", filler, "", None]
    found = {r.doc_id for r in leakage.leaked(documents(spark, texts), items(spark, PASSAGE, "Entirely other words about nothing in particular stand here instead.")).collect()}
    assert found == set(range(10))


def test_short_passages_are_found_whole(spark):
    texts = ["They asked what is offside again.", "The keeper saved the penalty in the end.", "Offside, what is it?", "The keeper saved it, the penalty was poor.", "A goal.", "They saw the keeper saved the penalty and what is offside"]
    test = items(spark, "what is offside", "keeper saved the penalty", "goal", "the end the end the")
    assert {(r.doc_id, r.item_id) for r in leakage.leaked(documents(spark, texts), test).collect()} == {(0, 0), (1, 1), (4, 2), (5, 1), (5, 0)}


def test_recall_against_alignment_with_all_rows(spark):
    """Halves of passages in pieces, with added, lost and misspelt words: every pair that the alignment accepts is a candidate."""
    rng = random.Random(11)
    vocabulary = [f"{a}{b}" for a in ("lan", "tor", "mib", "sal", "que", "dor") for b in ("tern", "gate", "ling", "some", "ver", "pole")]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(28, 80))) for _ in range(30)]
    texts = []
    for k in range(300):
        w = rng.choice(passages).split()
        n = max(2, int(len(w) * rng.uniform(0.3, 1.0)))
        start, cut = rng.randrange(len(w) - n + 1), rng.randrange(1, n)
        piece = [x if rng.random() > 0.08 else x[:-1] for x in w[start:start + n] if rng.random() > 0.05]
        filler = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        texts.append(" ".join(piece[:cut] + filler[:30] * (k % 2) + piece[cut:] + filler[30:]))
    found = {(r.doc_id, r.item_id) for r in leakage.leaked(documents(spark, texts), items(spark, *passages)).collect()}
    ready = [leakage.Passage(p.split()) for p in passages]
    want = {(d, i) for d, t in enumerate(texts) for i, p in enumerate(ready) if leakage.aligned_share(p, t.split()) >= 0.5}
    assert found <= want and len(want) > 150 and len(found) >= 0.97 * len(want)


def test_long_text_copies_and_odd_tables(spark):
    long = "word " * 200_000 + PASSAGE + " tail" * 1000
    docs = documents(spark, [long, PASSAGE, PASSAGE]).withColumn("words", F.lit(1)).withColumn("item_id", F.lit(2)).withColumn("term", F.lit("t"))
    test = items(spark, PASSAGE, None, "", PASSAGE)
    got = {(r.doc_id, r.item_id) for r in leakage.leaked(docs, test).collect()}
    assert got == {(d, i) for d in range(3) for i in (0, 3)}
    assert leakage.leaked(docs.limit(0), test).count() == 0 and leakage.leaked(docs, test.limit(0)).count() == 0
    report = {r.item_id: r.documents for r in leakage.leaks_by_item(leakage.leaked(docs, test), test).collect()}
    assert report == {0: 3, 1: 0, 2: 0, 3: 3}


def test_exact_phrases_by_offset_intersection(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") for _ in range(30)) for _ in range(20)]
    index = leakage.postings(leakage.tokenised(documents(spark, texts)))
    phrases = spark.createDataFrame([(0, ["a", "b", "c"]), (1, ["a", "a"]), (2, ["b", "b", "b", "b"])], "item_id bigint, words array<string>")
    got = {(r.item_id, r.doc_id, r.start) for r in leakage.phrase_matches(index, phrases).collect()}
    want = {(i, d, k) for i, p in ((0, "abc"), (1, "aa"), (2, "bbbb")) for d, t in enumerate(texts) for k in range(30) if "".join(t.split())[k:k + len(p)] == p}
    assert got == want


def test_plain_text(spark):
    df = spark.createDataFrame([("Ｃafé­s &amp; <b>Zürich</b>",), (None,)], "t string")
    assert [r[0] for r in df.select(words(F.col("t"))).collect()] == [["cafes", "zurich"], None]
    assert df.select(plain_text(F.col("t"))).count() == 2


# --- mixing -----------------------------------------------------------------------------------


def test_raking_meets_the_source_shares_under_the_caps():
    cells = [(s, lang, "t") for s in ("a", "b", "c") for lang in ("en", "de")]
    tokens = np.array([500.0, 100, 300, 300, 50, 10])
    plan = mixing.rake(cells, tokens, {"a": (0.5, 1), "b": (0.3, 2), "c": (0.1, 4), "none": (0.1, 3)})
    reached = {s: sum(w * t for (c, _, _), w, t in zip(cells, plan.weights, tokens) if c == s) / plan.total for s in "abc"}
    assert reached == pytest.approx({"a": 0.5 / 0.9, "b": 0.3 / 0.9, "c": 0.1 / 0.9})
    assert all(w <= {"a": 1, "b": 2, "c": 4}[c[0]] + 1e-9 for c, w in zip(cells, plan.weights))
    free = mixing.rake(cells, tokens, {"a": (0.5, 9), "b": (0.5, 9)}, total=600.0)
    german = sum(w * t for (_, lang, _), w, t in zip(cells, free.weights, tokens) if lang == "de")
    assert german == pytest.approx(600 * 400 / 1200, rel=0.05)


def test_mixture_shares_and_caps(spark):
    rng = random.Random(0)
    docs = [(k, " ".join(rng.choice(["goal", "pass", "club", "frame", "run"]) for _ in range(rng.randrange(5, 120))), rng.choice(["en", "EN", "de", None]), rng.choice(["a"] * 6 + ["b"] * 2 + ["c", None])) for k in range(1500)]
    docs += [(5000, None, "en", "a"), (5001, "", "en", "b")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").withColumn("tokens", F.lit(0)).withColumn("weight", F.lit(0))
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.15, 4), ("empty", 0.05, 2)], "source string, target_share double, max_repeats int")
    m = mixing.mixture(d, t)
    out = {r.source: r for r in mixing.shares_reached(d, t, m).collect()}
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.15)):
        assert out[s].actual_share == pytest.approx(share / 0.95, abs=0.01) and out[s].highest_copies <= out[s].max_repeats
    assert out["empty"].tokens == 0 and m.groupBy("doc_id").count().where("count > 1").count() == 0
    assert mixing.mixture(d.limit(0), t).count() == 0 and mixing.mixture(d, t.limit(0)).count() == 0


def test_a_source_without_repeats_is_unmet_and_the_others_are_mixed():
    made = mixing.rake([("a", "en", "t"), ("b", "en", "t")], np.array([100.0, 100.0]), {"a": (0.5, 0), "b": (0.5, 2)})
    assert made.shares == {"b": 1.0} and made.total == 200.0 and made.weights == [0.0, 2.0]


def test_topics_are_told_apart():
    rng = np.random.default_rng(0)
    counts = np.zeros((200, mixing.FEATURES))
    for k in range(200):
        np.add.at(counts[k], rng.integers(0, 100, 40) + 200 * (k % 2), 1)
    near = mixing.fit_topics(counts, 2).nearest(counts)
    assert len(set(near[::2])) == len(set(near[1::2])) == 1 and near[0] != near[1]
    assert mixing.fit_topics(counts[:0]).nearest(counts).max() == 0


def test_token_counts_of_long_and_empty_texts(spark):
    text = "The keeper holds the ball. " * 6000
    n = {r.doc_id: r.tokens for r in mixing.count_tokens(documents(spark, [text, "The keeper holds the ball. ", "", None])).collect()}
    assert n[2] == n[3] == 0 and abs(n[0] - n[1] * 6000) <= 6000 * 2


# --- moderation -------------------------------------------------------------------------------

NAMES = ["Velish", "Tethians", "foreigners", "women", "Oskarin"]


def training(seed=0):
    rng = random.Random(seed)
    fine = ["The match ended one nil.", "Tickets go on sale today.", "The keeper saved a shot.", "{g} in the stand sang all night.", "We welcome {g} to the club.", "Great pass by the winger.", "The club condemned the insults against {g}."]
    bad = {"abuse": ["Shut up you stupid {w}.", "You are a worthless {w}.", "Go home you ugly {w}."], "hate": ["Never trust {g}, they are subhuman.", "Send all {g} back, they breed like rats."], "sexual": ["Send me nude pictures of your naked body.", "They had loud sex in the press box."]}
    fill = lambda s: s.format(g=rng.choice(NAMES), w=rng.choice(["idiot", "clown", "wanker", "halfwit"]))
    out = [(fill(rng.choice(fine)) + " " + fill(rng.choice(fine)), "none") for _ in range(200)]
    for label, each in bad.items():
        out += [(fill(rng.choice(fine)) + " " + fill(rng.choice(each)), label) for _ in range(60)]
    return out + [("?", None), (None, "abuse"), ("x", "weird")]


@pytest.fixture(scope="module")
def model():
    return moderation.fit(training())


def test_held_out_accuracy(model):
    test = [(t, s) for t, s in training(9) if t and s in (*moderation.CATEGORIES, "none")]
    right = sum((moderation.CATEGORIES[int(v.argmax())] if (v := model.text(t)).max() >= 0.5 else "none") == s for t, s in test)
    assert right / len(test) > 0.97


@pytest.mark.parametrize("text", ["Sh*t up you st*pid w4nk3r.", "You are a worthless h a l f w i t.", "go home you UGLY idiooooot.", "You are a w​orthless clоwn."])
def test_disguised(model, text):
    assert model.text(text)[0] >= 0.5


def test_counterfactual_penalty_evens_out_groups():
    spread = {}
    for fair in (0.0, 0.05):
        m = moderation.fit(training(), fair=fair)
        spread[fair] = np.ptp([m.text(f"We welcome {g} to the club.")[1] + m.text(f"Never trust {g}, they are subhuman.")[1] for g in NAMES])
    assert spread[0.05] <= spread[0.0] + 1e-3
    m = moderation.fit(training())
    assert all(m.text(f"We welcome {g} to the club.").max() < 0.5 for g in NAMES)


def test_scores_of_tables(spark, model):
    long = "The keeper saved a shot. " * 20_000 + "You are a worthless idiot."
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "You are a worthless idiot.", "b"), (4, long, None)], "doc_id bigint, text string, source string").withColumn("abuse", F.lit(7)).withColumn("_key", F.lit(1))
    scores = moderation.score_documents(docs, model)
    assert {(r.doc_id, r.category) for r in moderation.flagged(scores, model).collect()} == {(3, "abuse"), (4, "abuse")}
    rates = {(r.source, r.category): r.rate for r in moderation.rates_by_source(docs, scores, model).collect()}
    assert rates["a", "abuse"] == 0 and rates["b", "abuse"] == 1 and rates[None, "hate"] == 0 and len(rates) == 9
    assert moderation.score_documents(docs.limit(0), model).count() == 0
    empty = moderation.fit_table(spark.createDataFrame([], "text string, label string"), docs)
    assert moderation.flagged(moderation.score_documents(docs, empty), empty).count() == 0


@pytest.mark.parametrize("insult", ["Hey keeper, you are a disgrace.", "You are a disgrace to the club."])
def test_unlabelled_insults_are_not_taught_as_harmless(spark, insult):
    plain = ["The match ended one nil. The winger won a corner.", "Rain fell on the stand. Tickets are gone."]
    texts = [f"{plain[k % 2]} Round {k}." for k in range(600)] + [f"Round {k}. {insult}" for k in range(6)]
    model = moderation.fit_table(spark.createDataFrame(training(), "text string, label string"), documents(spark, texts))
    assert model.text(insult)[0] >= 0.5 and model.text(plain[0]).max() < 0.5


def test_language_is_counted_over_all_documents_whole(spark):
    examples = spark.createDataFrame(training(), "text string, label string")
    texts = [f"Round {k} of the cup was played in the rain." for k in range(1200)] + ["the ball went to Zyskaberin again. " * 400] * 3
    d = documents(spark, [*texts, None, ""])
    model = moderation.fit_table(examples, d)
    assert "zyskaberin" in model.names and "the" not in model.names
    rates = moderation.feature_rates(d, model.names)
    one = zlib.crc32(b"<rain>") % (1 << 16)
    words = 1200 * 10 + 3 * 400 * 6
    assert rates[one] == pytest.approx(1200 / words * moderation.WIDTH, rel=0.01)
    twice = moderation.feature_rates(d.unionByName(d), model.names)
    assert np.allclose(rates, twice)


def test_batch_scores_equal_a_sum_over_features(model):
    texts = [None, "", "You are a worthless idiot.", " ".join(f"word{k % 7} and" for k in range(40)) + ". Go home you ugly clown; the match ended", "x"]
    lexicon = moderation.Lexicon(model.size, model.names)
    for text, got in zip(texts, model.scorer().texts(texts)):
        parts = [p for s in moderation.sentences(text) for p in moderation.stretches(moderation.tokens(s, model.names))]
        want = moderation.softmax(moderation.Rows(parts, lexicon).times(model.weights) + model.bias)[:, 1:].max(axis=0) if parts else np.zeros(3)
        assert np.allclose(got, want, atol=1e-4)


def test_group_terms_are_derived():
    found = {" ".join(t) for t in moderation.fit(training()).terms}
    assert {"velish", "tethians", "foreigners", "oskarin", "women"} >= found and len(found) >= 4


@pytest.fixture(scope="module")
def table_model(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.exists(folder):
        pytest.skip("no test tables here")
    return moderation.fit_table(spark.read.parquet(f"{folder}/moderation_examples.parquet"), spark.read.parquet(f"{folder}/documents.parquet"))


@pytest.mark.parametrize("text", ["Velish immigrants are lovely people.", "Women are welcome at the club.", "And Brimllomund has carried the ball there, to be fair, tidy stuff from number 29",
                                  "Ulmbascot the analyst repeats the yellow dugout under row 15", "Someone wrote 'a yellow stopwatch, Haskthropp the analyst' and left it at that"])
def test_harmless_texts(table_model, text):
    assert table_model.text(text).max() < 0.5

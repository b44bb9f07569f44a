import random

from tidepath.llm import mix

WORDS = {"a": "alpha beta gamma delta".split(), "b": "red green blue yellow".split(), "c": "run walk jump swim".split()}


def corpus(n=300, seed=0):
    rng, rows = random.Random(seed), []
    for i in range(n):
        s = "a" if i % 3 == 0 else "b" if i % 30 else "c"  # most rows are of one source
        name = {0: s, 1: s.upper(), 2: f"{s} "}[i % 3] if i % 17 else None
        rows.append((i, " ".join(rng.choices(WORDS[s], k=rng.randint(5, 60))), name))
    return rows + [(1000, None, "a"), (1001, "", "b"), (1002, "other words", "zz")]


def test_shares_and_caps(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, source string").selectExpr("*", "1 as tokens", "'x' as q")
    goal = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 1), ("none", 0.2, 3)], "source string, target_share double, max_repeats int")
    uses, shares = mix.mix(docs, goal)
    u = uses.collect()
    assert len({r.doc_id for r in u}) == len(u) and all(r.copies == 1 for r in u) and not {1000, 1001, 1002} & {r.doc_id for r in u}
    s = {r.source: r for r in shares.collect()}
    assert abs(s["a"].reached_share - 0.625) < 0.02 and s["none"].reached_share == 0
    uses, shares = mix.mix(docs, goal, total=1e9)  # more than there is: everything at its cap
    assert {r.source: r.tokens >= r.available for r in shares.collect()}["a"]


def test_repeats_small_sources(spark):
    docs = spark.createDataFrame([(i, "word " * 50, "big") for i in range(200)] + [(i, "word " * 50, "small") for i in range(500, 510)], "doc_id long, text string, source string")
    goal = spark.createDataFrame([("big", 0.8, 1), ("small", 0.2, 4), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    uses, shares = mix.mix(docs, goal)
    c = [r.copies for r in uses.where("source = 'small'").collect()]
    assert len(c) == 10 and max(c) <= 4 and sum(c) == 40
    assert {r.source: round(r.reached_share, 2) for r in shares.collect()} == {"big": 0.8, "small": 0.2}


def test_classifier_on_held_out_rows(spark):
    rows = [(i, t, None if i % 5 == 0 else "abc"["abc".index(s.strip().lower())] if s else None) for i, t, s in corpus(600, 1) if t and s != "zz"]
    docs = spark.createDataFrame([(i, s, t) for i, t, s in rows], "doc_id long, name string, text string")
    truth = {i: "a" if i % 3 == 0 else "b" if i % 30 else "c" for i, _, _ in rows}
    p = mix.posteriors(docs, ["a", "b", "c", "never"]).collect()
    hits = sum("abc"[max(range(3), key=lambda k: r.q[k])] == truth[r.doc_id] for r in p)
    assert hits >= 0.95 * len(p) and all(r.q[3] == 0 and abs(sum(r.q) - 1) < 1e-9 for r in p)


def test_empty(spark):
    uses, shares = mix.mix(spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int"))
    assert uses.count() == 0 and shares.count() == 1

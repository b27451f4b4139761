"""Language, quality, rules: against plain Python, and on odd input."""

import re
from collections import Counter
from math import comb

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verbatrix.llm import language_id, quality_crf, quality_rules


def plain_counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    times = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if times[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_counts_match_brute_force(spark, odd):
    texts = [r.text for r in odd.collect()] + ["x y\nx y\n x y\n\nx y", "a b c d e a b c d e f", "q " * 7]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.text_counts(df).collect()}
    assert got == {i: plain_counts(t) for i, t in enumerate(texts)}


def test_counting_runs_no_python(odd):
    plan = quality_rules.text_counts(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("n, k, risk", [(10, 0, 0.3), (50, 2, 0.1), (500, 1, 0.02), (500, 20, 0.05), (7, 7, 0.9)])
def test_exact_binomial_tail(spark, n, k, risk):
    tail = sum(comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1))
    df = spark.createDataFrame([(k, n, tail * 1.001), (k, n, tail * 0.999)], "k long, n long, level double")
    got = [r[0] for r in df.select(quality_rules.tail_is_small(F.col("k"), F.col("n"), risk, F.col("level"))).collect()]
    assert got == ([False, False] if k >= risk * n else [True, False])


def test_binomial_tail_of_many_documents(spark):
    """Large numbers: against the sum of logarithms of gamma functions."""
    from math import exp, lgamma, log

    cases = []
    for n, risk in [(3000, 0.02), (200_000, 0.01), (1_000_000, 0.02)]:
        sd = (n * risk * (1 - risk)) ** 0.5
        for z in (1, 2.5, 6):
            k = int(n * risk - z * sd)
            tail = sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(risk) + (n - i) * log(1 - risk)) for i in range(k + 1))
            cases.append((k, n, risk, tail))
    for k, n, risk, tail in cases:
        df = spark.createDataFrame([(k, n, tail * 1.001), (k, n, tail * 0.999)], "k long, n long, level double")
        assert [r[0] for r in df.select(quality_rules.tail_is_small(F.col("k"), F.col("n"), risk, F.col("level"))).collect()] == [True, False]


def test_false_rejection_stays_within_the_bound(spark):
    """400 strata, each tested at 5 %: few of their thresholds reject more than 5 % of the true distribution, and most exist."""
    rng = np.random.default_rng(1)
    n, strata, risk = 300, 400, 0.05
    rows = [(f"l{i // n:03}", float(x)) for i, x in enumerate(rng.exponential(size=n * strata))]
    chosen = quality_rules.thresholds(spark.createDataFrame(rows, "lang string, badness double"), risk, 0.05 * strata).collect()
    assert len(chosen) == strata
    true_risk = np.exp(-np.array([r.threshold for r in chosen]))
    assert (true_risk > risk).mean() <= 0.08 and np.median(true_risk) >= 0.02
    few = quality_rules.thresholds(spark.createDataFrame(rows[:50], "lang string, badness double"), risk, 0.05)
    assert few.count() == 0


def brute_kept(docs, labels, risk, delta):
    """doc_id -> kept, by plain Python; ratios from plain counts."""
    from fractions import Fraction

    good_ids = {i for i, q in labels if q == 1 and i is not None}
    steps, base, lang_of = {}, {}, {}
    for i, t, lang, fold in docs:
        n, chars, symbols, dup_lines, repeated = plain_counts(t)
        t = t or ""
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        import unicodedata

        capitals = sum(unicodedata.category(c) == "Lu" for c in t)
        part = lambda a, b: 1000 * a // b if b else 0
        steps[i] = [part(symbols, chars), part(dup_lines, len(lines)), part(repeated, n), part(capitals, chars), part(t.count("!"), chars)]
        base[i], lang_of[i] = n < 10 or 100 * repeated > 20 * n, (lang, fold)
    good = [i for i in steps if i in good_ids and not base[i]]
    fitting = [i for i in good if lang_of[i][1] == 0]
    usual = [int(np.ceil(np.percentile([steps[i][r] for i in fitting], 99))) if fitting else 0 for r in range(5)]
    badness = {i: max(Fraction(s + 1, u + 1) for s, u in zip(steps[i], usual)) for i in steps}
    holdout = [i for i in good if lang_of[i][1] != 0]
    strata = {lang_of[i][0] for i in holdout}
    cut = {}
    for lang in strata:
        own = [badness[i] for i in holdout if lang_of[i][0] == lang]
        n, p = len(own), Fraction(str(risk))
        small = lambda k: float(sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))) <= delta / len(strata)  # noqa: B023, E731
        if small(0):
            cut[lang] = max(t for t in set(own) if not small(sum(x >= t for x in own)))
    return {i: not base[i] and not (lang_of[i][0] in cut and badness[i] > cut[lang_of[i][0]]) for i in steps}


def test_kept_matches_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(quality_rules.FOLDS))
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", fold).collect()]
    rng = np.random.default_rng(2)
    labels = [(r[0], int(rng.random() < 0.9)) for r in rows] + [(None, 1), (10**9, 1), (rows[0][0], None)]
    got = quality_rules.judge(quality_rules.text_counts(docs), spark.createDataFrame(labels, "doc_id long, quality int"), 0.2, 0.5).collect()
    want = brute_kept(rows, labels, 0.2, 0.5)
    assert {r.doc_id: r.kept for r in got} == want
    assert any(not r.kept and not r.base_failed for r in got)


def test_rules_on_odd_input(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (99, 1), (2, None)], "doc_id long, quality int")
    got = quality_rules.judge(quality_rules.text_counts(odd), labels).collect()
    row = lambda r, text: (r.doc_id, *plain_counts(text))
    want = sorted((str(row(r, r.text)) for r in odd.collect()))
    assert sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in got) == want
    # Too few labels for any threshold: only the base rule takes texts.
    assert all(r.kept != r.base_failed and r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in got)
    assert quality_rules.judge(quality_rules.text_counts(empty), labels).count() == 0


def plain_grams(text):
    out = Counter()
    for w in re.findall(r"[^\x20\x09-\x0D]+", text.lower()):
        padded = f" {w} "
        out.update(w)
        for n in (2, 3):
            out.update(padded[i : i + n] for i in range(len(padded) - n + 1))
    return out


def test_gram_counts_match_brute_force(odd):
    texts = [r.text or "" for r in odd.collect()] + ["", "x", "one two one"]
    texts = [t.lower() for t in texts]
    found = language_id.gram_counts(pa.array(texts, pa.string()))
    codes = next(found)
    code = lambda g: int(sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g)))
    for text, (seen, total) in zip(texts, found, strict=True):
        assert {int(codes[i]): int(n) for i, n in zip(seen, total)} == {code(g): n for g, n in plain_grams(text).items()}


def test_languages(spark, odd, empty):
    words = {"aa": "ba na na ka ma la".split(), "bb": "strz grzt pfl krx".split()}
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(words[lang], 40)), lang) for i, lang in ((i, "aa" if i % 3 else "bb") for i in range(200))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = language_id.profiles(docs)
    out = language_id.identify(docs, learned).join(docs, "doc_id").collect()
    assert all(r.lang == r.lang_pred and 0 <= r.score <= 1 for r in out) and {r.held_out for r in out} == {True, False}
    strange = language_id.identify(odd, learned).collect()
    assert len(strange) == odd.count()
    by_text = {r.doc_id: r.lang_pred for r in language_id.identify(spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "ba na")], "doc_id long, text string"), learned).collect()}
    assert by_text == {1: "und", 2: "und", 3: "und", 4: "aa"}
    assert language_id.profiles(empty) == {} and {r.lang_pred for r in language_id.identify(odd, {}).collect()} == {"und"}
    assert language_id.identify(empty, learned).count() == 0


def test_held_out_accuracy_on_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = language_id.op7_language_id(spark, small).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert out.filter("lang = lang_pred").count() / out.count() >= 0.95


def brute_chain(odds, moves):
    """Marginals and the partition function over all labelings."""
    from itertools import product

    n, z, good, pairs = len(odds), 0.0, np.zeros(len(odds)), np.zeros((2, 2))
    for y in product((0, 1), repeat=n):
        p = np.exp(sum(o for o, v in zip(odds, y) if v) + sum(moves[a, b] for a, b in zip(y, y[1:])))
        z += p
        good += p * np.array(y)
        for a, b in zip(y, y[1:]):
            pairs[a, b] += p
    return good / z, pairs / z, np.log(z)


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(3)
    n_lines, moves = np.array([3, 1, 6, 2, 5, 6]), rng.normal(size=(2, 2))
    odds = rng.normal(size=n_lines.sum()) * 3
    marginal, expected, log_z = quality_crf.forward_backward(odds, n_lines, moves)
    want = [brute_chain(o, moves) for o in np.split(odds, np.cumsum(n_lines)[:-1])]
    assert np.allclose(marginal, np.concatenate([w[0] for w in want])) and np.allclose(expected, sum(w[1] for w in want)) and np.isclose(log_z, sum(w[2] for w in want))


def test_emission_slope_is_the_derivative():
    rng = np.random.default_rng(5)
    n_lines = np.array([1, 3, 2])
    own, weights, rest = rng.normal(size=(6, quality_crf.OWN)), rng.normal(size=quality_crf.WIDTH), rng.normal(size=6)
    ends = quality_crf.text_ends(n_lines, 6)
    slope = quality_crf.emission_slope(own, *ends, rest)
    for i in [0, 7, quality_crf.OWN + 3, 2 * quality_crf.OWN + 1, -3, -2, -1]:
        step = np.zeros_like(weights)
        step[i] = 1e-6
        assert np.isclose(slope[i], (quality_crf.emissions(own, *ends, weights + step) - quality_crf.emissions(own, *ends, weights - step)) @ rest / 2e-6, atol=1e-5)


def test_quality_on_documents(spark, small, odd, empty):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    model = quality_crf.learn(docs, labels)
    out = quality_crf.score(docs, model).join(labels, "doc_id").filter("held_out")
    assert out.filter("quality = predicted").count() / out.count() >= 0.9
    strange = quality_crf.score(odd, model).collect()
    assert len(strange) == odd.count() and all(0 <= r.score <= 1 for r in strange)
    assert quality_crf.accepted(odd, model).schema == odd.schema and quality_crf.score(empty, model).count() == 0
    nothing = quality_crf.learn(docs, labels.limit(0))
    assert {r.score for r in quality_crf.score(odd, nothing).collect()} == {0.5}
    conflicting = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    assert quality_crf.learn(docs, conflicting).constant == 0.5


def long_and_short(n_long):
    """Labelled texts of prose (1) and of junk (0), some bad ones far beyond the bound on a text."""
    prose = "\n".join(f"The quiet river of the {w} valley runs on, and people walk along it in the evening." for w in ("green", "old", "lower", "wide"))
    junk = "\n".join("%%% $$$ 8823 ### ||| <<< 0x" + str(i) * 9 for i in range(4))
    rows = [(i, (prose if i % 2 else junk) + f"\nline {i}.", i % 2) for i in range(0, 60)]
    return rows + [(1000 + i, junk * (quality_crf.TEXT_CHARS // len(junk) + 2), 0) for i in range(n_long)], prose, junk


def test_oversize_texts_do_not_switch_the_classifier_off(spark):
    """Wherever such texts come in the order of hashes, the model is the one learned without them."""
    rows, prose, junk = long_and_short(12)
    docs, labels = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    model, short = quality_crf.learn(docs, labels), quality_crf.learn(docs.filter("doc_id < 1000"), labels.filter("doc_id < 1000"))
    assert model.constant is None and np.array_equal(model.weights, short.weights) and (model.slope, model.shift) == (short.slope, short.shift)
    assert [s >= 0.5 for s in quality_crf.scores(pa.array([prose, junk]), model)] == [True, False]


def test_lines_of_one_text_get_both_labels():
    """Half prose, half junk: lines are told apart although every training text bore one label, also where texts were mixed."""
    rows, prose, junk = long_and_short(0)
    texts, labels = [t for _, t, _ in rows], [q for *_, q in rows]
    mixed = [prose + "\n" + junk.split("\n")[0]] * 6, [junk + "\n" + prose.split("\n")[0]] * 6
    model = quality_crf.fit([*texts, *mixed[0], *mixed[1]], [*labels, *[1] * 6, *[0] * 6])
    own, n_lines, lengths = quality_crf.line_features(pa.array([prose + "\n" + junk]))
    marginal, _, _ = quality_crf.forward_backward(model.emissions(own, n_lines), n_lines, model.moves)
    assert (marginal[:4] > 0.5).all() and (marginal[4:] < 0.5).all()
    # End to end by enumeration of all labellings of a short text: marginals, their mean by length, the curve.
    text = "\n".join([prose.split("\n")[0], junk.split("\n")[0], "", "line 7."])
    own, n_lines, lengths = quality_crf.line_features(pa.array([text]))
    odds = model.emissions(own, n_lines).astype(float)
    total, good = 0.0, np.zeros(4)
    for bits in range(16):
        label = [bits >> k & 1 for k in range(4)]
        weight = np.exp(sum(o for o, one in zip(odds, label) if one) + sum(model.moves[a, b] for a, b in zip(label, label[1:])))
        total, good = total + weight, good + weight * np.array(label)
    size = [max(1, len(line.encode())) for line in text.split("\n")]
    share = float(good / total @ size / sum(size))
    assert quality_crf.scores(pa.array([text]), model)[0] == pytest.approx(1 / (1 + np.exp(-(model.slope * (share - 0.5) + model.shift))), abs=1e-5)

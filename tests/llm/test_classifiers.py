"""Quality and toxicity on held-out labels, their parts, and awkward rows."""

import re

import numpy as np
import plain
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from armwise.llm import quality_classifier, toxicity


def scored(spark, operator, label: str):
    docs, labels = (spark.read.parquet(f"{plain.SF_LARGER}/{t}.parquet") for t in ("documents", "labels"))
    return operator.classify(docs, labels).toPandas().merge(labels.select("doc_id", label).toPandas(), on="doc_id", how="left"), docs


@pytest.mark.parametrize(("operator", "label", "by", "out", "least", "good"), [(quality_classifier, "quality", 4, 2, 0.7, 0.9), (toxicity, "toxic", 5, 0, 0.5, 0.85)])
def test_held_out_accuracy(spark, operator, label, by, out, least, good):
    got, docs = scored(spark, operator, label)
    assert len(got) == docs.count()
    assert (got.held_out == [plain.crc(k) % by == out for k in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= least)).all()
    held = got[got.held_out & got[label].isin([0, 1])]
    assert plain.auc(held.score.to_numpy(), held[label].to_numpy()) >= good


@pytest.mark.parametrize(("operator", "label"), [(quality_classifier, "quality"), (toxicity, "toxic")])
def test_held_out_labels_are_not_learned(spark, operator, label):
    docs, labels = (spark.read.parquet(f"{plain.SF}/{t}.parquet") for t in ("documents", "labels"))
    by, out = (4, 2) if label == "quality" else (5, 0)
    mine = labels.toPandas()
    mine.loc[[plain.crc(k) % by == out for k in mine.doc_id], label] = 1
    a = operator.classify(docs, labels).toPandas().sort_values("doc_id").score.to_numpy()
    b = operator.classify(docs, spark.createDataFrame(mine)).toPandas().sort_values("doc_id").score.to_numpy()
    assert np.allclose(a, b)


@pytest.mark.parametrize(("operator", "label"), [(quality_classifier, "quality"), (toxicity, "toxic")])
def test_awkward_rows(spark, operator, label):
    docs = plain.awkward(spark)
    labels = spark.createDataFrame([(1, 1, "x"), (1, 0, "x"), (2, 1, "x"), (9, 0, None), (8, 0, "x"), (None, 1, "x"), (11, None, "x"), (6, 1, "x"), (7, 0, "x")], f"doc_id long, {label} int, text string")
    for labelled in (labels, plain.empty(labels)):
        got = operator.classify(docs, labelled).collect()
        assert len(got) == docs.count()
        assert all(0 <= r.score <= 1 for r in got)
        assert operator.classify(plain.empty(docs), labelled).count() == 0


def test_accepted_agrees_with_scores(spark):
    docs, labels = (spark.read.parquet(f"{plain.SF}/{t}.parquet") for t in ("documents", "labels"))
    good = {r.doc_id for r in quality_classifier.classify(docs, labels).where("predicted = 1").collect()}
    kept = quality_classifier.accepted(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == good


def test_discriminant_is_the_difference_of_gaussian_densities():
    rng = np.random.default_rng(5)
    groups = [rng.normal(0, 1, (80, 3)), rng.normal(1, 2, (50, 3))]
    n = np.array([80.0, 50.0])
    model = quality_classifier.fit(n, np.array([g.sum(0) for g in groups]), np.array([g.T @ g for g in groups]), shrink=0.2, ridge=0.1)
    own = [np.cov(g.T, bias=True) for g in groups]
    pooled = (80 * own[0] + 50 * own[1]) / 130
    x = rng.normal(0, 1, (20, 3))
    density = []
    for c, g in enumerate(groups):
        v = 0.8 * own[c] + 0.2 * pooled
        v = 0.9 * v + (0.1 * np.trace(v) / 3 + 1e-9) * np.eye(3)
        d = x - g.mean(0)
        density.append(np.log(n[c] / 130) - 0.5 * np.linalg.slogdet(v)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(v), d))
    assert np.allclose(model.difference(x), np.clip(density[1] - density[0], -50, 50), atol=0.051)


def test_noisy_channel_restores_words(spark):
    text = "the stupid idiot said hello to people walking along the river and another stupid idiot shouted " * 30
    lm = toxicity.language_model(toxicity.trigrams(pa.array([text])))
    for written, meant in {"1d1ot": "idiot", "stuuuupid": "stupid", "s.t.u.p.i.d": "stupid", "s t u p i d": "stupid", "$tup1d": "stupid", "hello": "hello"}.items():
        assert toxicity.restore(written, lm) == meant


def test_character_counts_are_those_of_single_texts():
    texts = ["abc def", None, "", "x", "Ünï ☃"]
    one = sum(toxicity.trigrams(pa.array([t], pa.string())) for t in texts)
    assert (toxicity.trigrams(pa.array(texts, pa.string())) == one).all()


def test_obfuscated_words_are_classified(spark):
    rng = np.random.default_rng(2)
    words = "people walking along the river said hello and went home under green trees with many friends".split()
    rude = ["stupid", "idiot", "ass", "shit", "jerk"]
    texts = [" ".join([*rng.choice(words, 12), *(rng.choice(rude, 2) if i % 5 == 1 else []), *rng.choice(words, 6)]) for i in range(400)]
    forms = ["a$$", "shi+", "id-iot", "st*pid", "stupiid", "st up id", "s t  u p  i d", "s\nt\nu\np\ni\nd", "j€rk", "idi0t"]
    asked = [f"people walking along {x} river trees" for x in forms]
    docs = spark.createDataFrame([*enumerate(texts), *((1000 + i, x) for i, x in enumerate(asked)), (2000, "people walking along the river trees")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 1)) for i in range(400)], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.classify(docs, labels).collect()}
    assert {x: got[1000 + i] for i, x in enumerate(forms)} == dict.fromkeys(forms, 1)
    assert got[2000] == 0


def plain_statistics(text: str | None) -> list[float]:
    """The statistics of one text by words and characters, without arrays."""
    t = text or ""
    ws = plain.WORD.findall(plain.lower(t))
    n, size = len(ws), sum(len(w.encode()) for w in ws)
    shares = [sum(t.count(c) for c in chars) / max(size, 1) for chars in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "#$%&*<>", "!", "|", "0123456789", ".,;:?")]
    out = [np.log1p(n), np.log1p(size / max(n, 1)), *np.sqrt(shares), np.log(max(n, 1) / (t.count("\n") + 1) + 1), 0.0, 0.0, 0.0]
    if n > 1:
        pairs = list(zip(ws, ws[1:], strict=False))
        out[9:] = [np.sqrt(sum(a == b for a, b in pairs) / (n - 1)), np.log1p(len(set(ws)) - 1) / np.log1p(n), np.sqrt((len(pairs) - len(set(pairs))) / n)]
    return out


def test_scores_are_those_of_a_plain_version(spark):
    from armwise.llm.calibration import calibrate

    docs, labels = (spark.read.parquet(f"{plain.SF}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    label = {r.doc_id: r.quality for r in labels.collect()}
    x = {k: np.array(plain_statistics(t)) for k, t in texts.items()}
    order = list(texts)
    assert np.allclose(quality_classifier.statistics(pa.array([texts[k] for k in order])), [x[k] for k in order])
    groups = [np.array([x[k] for k in order if plain.crc(k) % 4 != 2 and label.get(k) == c]) for c in (0, 1)]
    model = quality_classifier.fit(np.array([float(len(g)) for g in groups]), np.array([g.sum(0) for g in groups]), np.array([g.T @ g for g in groups]))
    d = [model.difference(g) for g in groups]
    slope, shift = calibrate(np.concatenate(d), np.repeat([0.0, 1.0], list(map(len, d))), np.repeat([1.0, 0.0], list(map(len, d))))
    want = {k: 1 / (1 + np.exp(-(slope * model.difference(x[k][None])[0] + shift))) for k in order}
    got = {r.doc_id: r for r in quality_classifier.classify(docs, labels).collect()}
    near = [abs(got[k].score - want[k]) for k in order]
    assert max(near) < 0.02 and np.mean(np.array(near) < 1e-6) > 0.98  # a difference is rounded to tenths, which sums in another order can turn
    assert all(got[k].predicted == int(got[k].score >= 0.7) for k in order)


_LM = toxicity.language_model(toxicity.trigrams(pa.array(["the stupid idiot said hello to people walking along the river, naïve éclair sheep feel shall"] * 9)))


def plain_viterbi(token: str, lm: np.ndarray) -> str:
    """One token, state by state: of equal scores the first reached stays."""
    runs = [len(m[0]) for m in re.finditer(r"(.)\1*", token, re.S) for _ in m[0]]
    states = {(0, 0): (0.0, "")}
    last = ""
    ends = len(token) - len(token.rstrip("*"))
    ends = ends if ends <= toxicity.STARS else 0
    for i, ch in enumerate(token[: len(token) - ends]):
        if ch == "*" and runs[i] <= toxicity.STARS:
            steps = [("", toxicity.PARTS), *((x, toxicity.STANDS) for x in toxicity.LETTERS)]
        else:
            steps = [("", toxicity.JOINED), (" ", toxicity.MEANT)] if ch == " " else [(ch, 0.0)] if ch.isalpha() else [("", toxicity.PARTS)] if ch in toxicity.SEPARATORS else []
            steps = steps + [(x, toxicity.STANDS) for x in toxicity.LEET.get(ch, "")] or [(ch, 0.0)]
            steps = [*steps, ("", toxicity.REPEATS)] if ch == last and ch != " " else steps
        last = ch
        after = {}
        for (x, y), (score, said) in states.items():
            for out, cost in steps:
                u, v, t = x, y, score + cost
                for byte in out.encode():
                    t += lm[u, v, int(toxicity._CODE[byte])]
                    u, v = v, int(toxicity._CODE[byte])
                if (u, v) not in after or after[u, v][0] < t:
                    after[u, v] = (t, said + out)
        states = after
    best = max(score + (toxicity._ended(k, ends, lm)[0] if ends else lm[(*k, 0)]) for k, (score, _) in states.items())
    for k, (score, said) in states.items():
        gain, tail = toxicity._ended(k, ends, lm) if ends else (lm[(*k, 0)], [])
        if score + gain == best:
            return said + "".join(tail)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("abeilostéñ01$!@.-,#ß* "), min_size=0, max_size=9), max_size=6))
def test_batched_viterbi_equals_a_plain_one_ties_included(tokens):
    want = [plain_viterbi(t, _LM) for t in tokens]
    assert toxicity.restore_many(tokens, _LM) == want
    assert [toxicity.restore(t, _LM) for t in tokens] == want


def test_long_tokens_and_runs_of_stars_are_judged_run_by_run():
    for token in ("i1" * 2000, "s.t.u.p.i.d" * 300, "****st*pid", "st*pid****", "$" * 500, "a*b**c***d****e", "*" * 40):
        assert toxicity.restore(token, _LM) == plain_viterbi(token, _LM)
    assert toxicity.restore("****st*pid", _LM).endswith(toxicity.restore("st*pid", _LM)[-3:])

"""Language, toxicity, quality, licences, decontamination."""

import random
import textwrap
import time
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from paperlake.llm import decontamination as D
from paperlake.llm import licenses
from paperlake.llm import toxicity as X
from paperlake.llm.decontamination import contaminated_papers, mark_contamination
from paperlake.llm.language import SLICE, fit_languages, identify_languages, letter_table, ngram_counts
from paperlake.llm.licenses import LICENSES, canonical, scan_licenses
from paperlake.llm.quality import fit_quality, rate_papers
from paperlake.llm.toxicity import fit_toxicity, score_toxicity

VOCABULARY = {
    "en": "the of and to in that with for was his her from which they were this have had not but".split(),
    "de": "der die und das ist nicht mit ein eine sich auch nach werden wurde schön über für dass".split(),
    "es": "el la de que y los se del las por con para una su más está como pero sus también".split(),
}


def sentences(language, n, seed, words=30):
    draw = random.Random(f"{language}{seed}")
    return [" ".join(draw.choice(VOCABULARY[language]) for _ in range(words)) for _ in range(n)]


@pytest.fixture(scope="module")
def spoken(spark):
    rows = [(k, t) for k in VOCABULARY for t in sentences(k, 40, 1)]
    return spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(rows)], "paper_id long, text string, language string")


def test_languages_are_told_apart(spark, spoken, odd_papers, no_papers):
    model = fit_languages(spoken.unionByName(spark.createDataFrame([(None, "x", "en"), (900, None, "en"), (901, "y", None)], spoken.schema)))
    assert model.languages == ["de", "en", "es"]
    fresh = [(k, t) for k in VOCABULARY for t in sentences(k, 10, 2, 12)] + [("en", "The of And")]
    frame = spark.createDataFrame([(i, t, "zz") for i, (_, t) in enumerate(fresh)], spoken.schema)
    got = {r.paper_id: r for r in identify_languages(frame, model).collect()}
    assert [got[i].language for i in range(len(fresh))] == [k for k, _ in fresh]
    assert all(0 <= r.score <= 1 and not r.rejected for r in got.values())
    strange = spark.createDataFrame([(1, "зщг ыва прол джэ " * 30)], "paper_id long, text string")
    assert identify_languages(strange, model).first().rejected
    rows = identify_languages(odd_papers, model, carry=("row",)).toDF("paper_id", "language", "value", "rejected", "own").collect()
    assert len(rows) == odd_papers.count()
    assert {r.paper_id for r in rows if r.language == "und"} == {2, 3, 4, 7, None}
    assert all(r.rejected and r.value == 0 for r in rows if r.language == "und") and {r.own for r in rows} == {"r"}
    assert identify_languages(no_papers, model).count() == 0
    untaught = identify_languages(odd_papers, fit_languages(no_papers))
    assert {r.language for r in untaught.collect()} == {"und"}


UNLEARNT = {
    "pl": "nie się jest dla jak tak przez będzie który może tylko oraz bardzo jego czy już więc gdzie także między".split(),
    "fi": "että hän olla mutta kuin joka niin myös sitten kaikki voida tämä saada pitää tulla ihminen vuosi nyt jälkeen".split(),
}


def test_unlearnt_languages_of_the_same_script_are_rejected(spark, spoken):
    """Also with some rows under a wrong language: no single row sets the limit."""
    wrong = [(1000 + k, t, "en") for k, t in enumerate(sentences("de", 1, 7))]
    model = fit_languages(spoken.unionByName(spark.createDataFrame(wrong, spoken.schema)))
    draw = random.Random(5)
    texts = [" ".join(draw.choice(words) for _ in range(40)) for words in UNLEARNT.values() for _ in range(10)]
    known = [t for k in VOCABULARY for t in sentences(k, 10, 3)]
    frame = spark.createDataFrame([(k, t, "") for k, t in enumerate(texts + known)], spoken.schema)
    rejected = {r.paper_id for r in identify_languages(frame, model).collect() if r.rejected}
    assert rejected == set(range(len(texts)))


def plain_similarity(text, sample, language):
    """Largest cosine of a text with the TF-IDF vectors of a language's papers, from n-grams as text."""
    import math
    import re

    def grams(x):
        clean = " " + " ".join(re.findall(r"[^\W\d_]+", x.lower())) + " "
        found = Counter(c for c in clean if c != " ")
        for n in (2, 3):
            found.update(clean[k : k + n] for k in range(len(clean) - n + 1))
        return found

    seen = Counter(g for _, t in sample for g in set(grams(t)))
    weigh = lambda c: {g: math.log1p(n) * (math.log((1 + len(sample)) / (1 + seen[g])) + 1) for g, n in c.items()}
    own = weigh(grams(text))
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    mean = Counter()
    for k, t in sample:
        if k == language:
            row = weigh(grams(t))
            for g, x in row.items():
                mean[g] += x / size(row)
    return sum(x * mean[g] for g, x in own.items()) / (size(own) * size(mean))


def test_one_centroid_is_the_mean_of_plain_vectors(spark, spoken):
    """With one centroid a language, predictions and scores are those of vectors made of the n-grams themselves (the
    operator's are hashed, so scores agree but for chance meetings)."""
    model = fit_languages(spoken, clusters=1)
    sample = [(r.language, r.text) for r in spoken.collect()]
    texts = [t for k in VOCABULARY for t in sentences(k, 4, 9, 25)]
    frame = spark.createDataFrame([(k, t, "") for k, t in enumerate(texts)], spoken.schema)
    for r in identify_languages(frame, model).collect():
        near = {k: plain_similarity(texts[r.paper_id], sample, k) for k in VOCABULARY}
        assert r.language == max(near, key=near.get) and r.score == pytest.approx(near[r.language], abs=0.02)


def test_repeated_ids_teach_the_same_whatever_their_order(spark, spoken):
    twice = spark.createDataFrame([(0, "der die das und ist nicht", "de"), (0, "the of and", "en")], spoken.schema)
    one, other = (fit_languages(x) for x in (spoken.unionByName(twice), twice.unionByName(spoken).repartition(5)))
    assert (one.centroids == other.centroids).all() and (one.floor == other.floor).all()


def test_ngrams_of_slices_are_those_of_the_text(monkeypatch):
    text = "Ab, cd.. 12é F" * 9
    letters = letter_table()
    whole = ngram_counts(text, letters)
    monkeypatch.setattr("paperlake.llm.language.SLICE", 7)
    assert (ngram_counts(text, letters) == whole).all() and SLICE > 7
    clean = " ab cd é f" * 9
    assert (ngram_counts(clean, letters) == ngram_counts(clean.strip(), letters)).all()


def toxic_rows(n, seed, long=False):
    draw, rows = random.Random(seed), []
    for i in range(n):
        words = [draw.choice(VOCABULARY["en"]) + draw.choice(["", "ing", "ed"]) for _ in range(400 if long else 40)]
        bad = i % 2
        if bad:
            for _ in range(3):
                words[draw.randrange(len(words))] = "grobl" + draw.choice(["ax", "en", "us", "iv"])
        rows.append((i, " ".join(words), bad))
    return rows


def test_toxic_windows_are_found(spark, odd_papers, no_papers):
    rows = toxic_rows(300, 1)
    papers = spark.createDataFrame([r[:2] for r in rows], "paper_id long, text string")
    ratings = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (0, None)], "paper_id long, toxic int")
    model = fit_toxicity(papers, ratings, rounds=10)
    for long in (False, True):
        fresh = toxic_rows(80, 2, long)
        frame = spark.createDataFrame([r[:2] for r in fresh], "paper_id long, text string")
        got = {r.paper_id: r.score for r in score_toxicity(frame, model).collect()}
        assert np.mean([(got[i] >= 0.5) == bool(y) for i, _, y in fresh]) > 0.9
    got = score_toxicity(odd_papers, model, carry=("hits",)).collect()
    assert len(got) == odd_papers.count() and all(0 <= r.score <= 1 for r in got)
    assert all((r.window_no is None) == (r.score == 0.0) for r in got)
    assert score_toxicity(no_papers, model).count() == 0
    untaught = fit_toxicity(no_papers, ratings.limit(0))
    assert {round(r.score, 3) for r in score_toxicity(papers, untaught).collect()} == {0.018}


def plain_logit(words, model):
    """One window, word by word, from the equations of the gated unit."""
    inputs = X.inputs_of(words, model).astype(float)
    hidden = X.HIDDEN
    sides = []
    for side, order in ((0, range(len(words))), (1, range(len(words) - 1, -1, -1))):
        state, states = np.zeros(hidden), {}
        for t in order:
            x = inputs[t] @ model.inputs[:, 3 * hidden * side : 3 * hidden * (side + 1)] + model.bias[3 * hidden * side : 3 * hidden * (side + 1)]
            both = 1 / (1 + np.exp(-(x[: 2 * hidden] + state @ model.gates[side])))
            update, reset = both[:hidden], both[hidden:]
            fresh = np.tanh(x[2 * hidden :] + (reset * state) @ model.candidate[side])
            state = (1 - update) * state + update * fresh
            states[t] = state
        sides.append([states[t] for t in range(len(words))])
    pairs = [np.concatenate(x) for x in zip(*sides)]
    attention = np.exp([p @ model.attention for p in pairs])
    pooled = sum(a * p for a, p in zip(attention / attention.sum(), pairs))
    return pooled @ model.out[:-1] + model.out[-1]


def test_scores_are_those_of_a_plain_pass_over_all_windows(spark):
    model, draw = X.ToxicityModel.start(3), random.Random(4)
    texts = [" ".join(draw.choice(["fine", "awful", "words", "über", "x", "of", "the"]) + str(draw.randint(0, 9)) for _ in range(n)) for n in (1, 5, 63, 64, 65, 97, 200, 333)]
    frame = spark.createDataFrame(list(enumerate(texts)), "paper_id long, text string").repartition(2)
    for r in score_toxicity(frame, model).collect():
        words = X.split_words(texts[r.paper_id])
        starts = [0] if len(words) <= X.WINDOW else [*range(0, len(words) - X.WINDOW, X.STRIDE), len(words) - X.WINDOW]
        logits = [plain_logit(words[s : s + X.WINDOW], model) for s in starts]
        assert r.score == pytest.approx(1 / (1 + np.exp(-max(logits))), abs=1e-4) and logits[r.window_no] == pytest.approx(max(logits), abs=1e-3)


def test_toxic_scores_are_chances_at_every_sample_size(spark):
    """A smaller share of clean papers in the sample does not make more papers toxic."""
    draw = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(draw.choice(words) for _ in range(20)) + (" vile" if k % 10 < 2 and k % 4 else ""), int(k % 10 < 2)) for k in range(1000)]
    frame = spark.createDataFrame(rows, "paper_id long, text string, toxic int")
    means = []
    for per_class in (1000, 200):
        model = fit_toxicity(frame, frame, per_class=per_class, rounds=5)
        means.append(np.mean([r.score for r in score_toxicity(frame, model).collect()]))
    assert abs(means[0] - means[1]) < 0.12 and abs(means[1] - 0.2) < 0.12


def test_gradients_are_those_of_the_loss():
    model = X.ToxicityModel.start(3)
    windows, labels = [["ab", "cd", "ab", "efg"], ["x"], ["cd"] * 9], np.array([1.0, 0.0, 1.0], np.float32)
    taken = {}

    class Keep:
        def dense(self, _, grads):
            taken.update(grads)

        def sparse(self, *_):
            pass

    names = ("inputs", "bias", "gates", "candidate", "attention", "out")
    for k in names:
        setattr(model, k, getattr(model, k).astype(np.float64))
    X._step(model, Keep(), windows, labels)
    scale = 1.0
    for k in names:
        array = getattr(model, k)
        for place in [tuple(np.random.default_rng(4).integers(0, n) for n in array.shape) for _ in range(3)]:
            losses = []
            for step in (1e-3, -1e-3):
                array[place] += step
                losses.append(X._step(model, Keep(), windows, labels))
                array[place] -= step
            X._step(model, Keep(), windows, labels)
            assert abs((losses[0] - losses[1]) / 2e-3 - taken[k][place] * scale) < 2e-3, k


def test_windows_cover_a_text():
    for size in (1, 5, X.WINDOW, X.WINDOW + 1, 3 * X.WINDOW + 7):
        rows = X.window_rows(np.arange(size), -1)
        assert set(rows[rows >= 0]) == set(range(size)) and len(rows) == max(1, -(-(size - X.WINDOW) // X.STRIDE) + 1)


def test_grades_are_ordered(spark, odd_papers, no_papers):
    draw, rows = random.Random(6), []
    for i in range(600):
        grade = i % 4 + 1
        rows.append((i, " ".join(draw.choice(["fine", "good"] if draw.random() < grade / 4 - 0.1 else ["junk", "###"]) for _ in range(60)), grade))
    papers = spark.createDataFrame([r[:2] for r in rows], "paper_id long, text string")
    ratings = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 3] + [(None, 1), (5, None)], "paper_id long, novelty_score int")
    model = fit_quality(papers, ratings)
    assert model.grades == [1, 2, 3, 4] and (np.diff(model.thresholds) > 0).all()
    got = {r.paper_id: r for r in rate_papers(papers, model, from_grade=3).collect()}
    held = [(i, g) for i, _, g in rows if i % 3 == 0]
    assert np.corrcoef([got[i].expected_grade for i, _ in held], [g for _, g in held])[0, 1] > 0.85
    assert np.mean([got[i].selected == (g >= 3) for i, g in held]) > 0.8
    assert all(1 <= r.expected_grade <= 4 and 0 <= r.tail_probability <= 1 for r in got.values())
    assert rate_papers(odd_papers, model, carry=("score", "text")).count() == odd_papers.count()
    assert rate_papers(no_papers, model).count() == 0
    untaught = rate_papers(papers, fit_quality(papers, ratings.limit(0))).first()
    assert untaught.expected_grade is None and untaught.tail_probability == 0


def test_grades_are_those_of_plain_sums(spark):
    """Expected grade and tail from dictionaries of features and the logistic function, without the vectors."""
    import math

    from paperlake.llm.quality import FEATURES, LENGTHS, QualityModel, TokenFeatures

    draw = np.random.default_rng(2)
    model = QualityModel([1, 3, 4], draw.normal(size=FEATURES + LENGTHS), np.array([-0.7, 0.9]))
    texts = ["", "One two two Three", "a " * 70, "x1 Y-2 z!! z!!", "Ärger 12,5 über ALLES alles"]
    frame = spark.createDataFrame(list(enumerate(texts)), "paper_id long, text string")
    memo = TokenFeatures()
    for r in rate_papers(frame, model, from_grade=3).collect():
        tokens = texts[r.paper_id].split()
        word, shape = [memo[t] >> 32 for t in tokens], [memo[t] & 0xFFFFFFFF for t in tokens]
        pairs = [b * 31 + a for a, b in zip(shape, shape[1:])]
        again = [int(a == b) for a, b in zip(word, word[1:])]
        scale = model.weights[FEATURES + len(tokens).bit_length()]
        for number, kind in enumerate((word, shape, pairs, again)):
            spots = Counter(((k * 8 + number) * 0x9E3779B97F4A7C15) % 2**64 >> 49 for k in kind)
            scale += sum(model.weights[s] * math.sqrt(n / len(kind)) for s, n in spots.items())
        below = [1 / (1 + math.exp(-(t - scale))) for t in model.thresholds]
        chances = [below[0], below[1] - below[0], 1 - below[1]]
        assert r.expected_grade == pytest.approx(sum(g * c for g, c in zip(model.grades, chances)))
        assert r.tail_probability == pytest.approx(chances[1] + chances[2])


def test_licenses_are_entire_texts(spark, odd_papers, no_papers):
    mit = next(t for n, t in LICENSES if n == "MIT")
    notice = "This work is licensed under the GNU General Public License, version 3."
    rows = [
        (1, "Copyright (c) 2001 Someone\n" + mit.upper().replace(" ", "  ")), (2, f"A line.\n  * {notice}\nmore\n{notice}"), (3, f"x {notice}"),
        (4, "Licenced under the Apache License -- version 2.0"), (5, f"text\n\n(c) me\n{notice}\n\nend"), (None, notice), (6, mit[:-40]),
        (7, "Licensed under Creative Commons Attribution 4.0"), (8, "This work is licensed under the GNU GPL, v3"),
    ]
    got = Counter({(r.paper_id, r.license, r.scope): r.matches for r in scan_licenses(spark.createDataFrame(rows, "paper_id long, text string")).collect()})
    assert got == Counter({
        (1, "MIT", "text"): 1, (2, "GPL-3.0", "line"): 2, (4, "Apache-2.0", "text"): 1, (5, "GPL-3.0", "paragraph"): 1,
        (5, "GPL-3.0", "line"): 1, (None, "GPL-3.0", "text"): 1, (7, "CC-BY-4.0", "text"): 1, (8, "GPL-3.0", "text"): 1,
    })
    own = spark.createDataFrame([("own", "the quick brown fox jumps over the lazy dog"), ("none", " ?"), ("null", None)], "license string, text string")
    assert {(r.paper_id, r.matches) for r in scan_licenses(odd_papers, own).collect()} == {(1, 2)}
    assert scan_licenses(no_papers).count() == 0 and scan_licenses(odd_papers, own.limit(0)).count() == 0


def test_every_unit_is_judged_by_its_canonical_form(spark, sf):
    """The first words only save work: against the canonical forms of all lines of all documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("paper_id"), "text")
    forms = spark.createDataFrame(LICENSES, "license string, text string").select("license", canonical(F.col("text")).alias("f")).distinct()
    lines = docs.filter(F.contains("text", F.lit("\n"))).select("paper_id", F.explode(F.split("text", "\n")).alias("l"))
    want = lines.select("paper_id", canonical(F.col("l")).alias("f")).join(forms, "f").groupBy("paper_id", "license").count()
    got = scan_licenses(docs).filter("scope = 'line'").select("paper_id", "license", "matches")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect())) and got.count()


QUESTION = "A farmer from Ohio, named Ann, has 3 apples and buys 5 pounds more apples before Ann goes away with them."


def brute_hits(paper, card, width=8, least=4):
    """Share of the card's windows that are in the paper, from the definition, for one reading at a time."""
    memo = D.Tokens()
    a, b = D.templates([paper], memo), D.templates([card], memo)
    size = min(width, len(b.codes))
    starts = [s for s in range(len(b.codes) - size + 1) if (~b.slots[s : s + size]).sum() >= min(least, size)] if size >= least else []
    found = set()
    for shift in range(-len(b.codes), len(a.codes)):
        table = {}
        for s in starts:
            if 0 <= s + shift and s + shift + size <= len(a.codes) and (a.codes[s + shift : s + shift + size] == b.codes[s : s + size]).all():
                pairs = [((b.codes[k], b.values[k]), a.values[k + shift]) for k in range(s, s + size) if b.slots[k]]
                merged = dict(table)
                if all(merged.setdefault(key, value) == value for key, value in pairs):
                    table = merged
                    found.add(s)
    return len(found) / len(starts) if starts else 0.0


def test_templates_find_changed_questions(spark, odd_papers, no_papers):
    changed = QUESTION.replace("Ann", "Tom").replace("3", "12").replace("pounds", "kg")
    uneven = changed.replace("before Tom", "before Bob")
    papers = [(1, "Text. " + QUESTION), (2, changed), (3, uneven), (4, "Something else altogether, with no question in it at all."), (5, None), (6, "")]
    cards = [(10, QUESTION), (10, QUESTION), (11, None), (12, "Too short"), (13, "One two three four five six seven eight nine ten words here.")]
    frame = spark.createDataFrame(papers, "paper_id long, text string")
    fronts = spark.createDataFrame(cards, "card_id int, front string")
    got = {(r.paper_id, r.card_id): r for r in contaminated_papers(frame, fronts, coverage=0.01).collect()}
    assert {k[0] for k in got} == {1, 2, 3} and {k[1] for k in got} == {10}
    for i, text in papers[:3]:
        assert got[i, 10].coverage == pytest.approx(brute_hits(text, QUESTION))
    assert [got[i, 10].changed for i in (1, 2)] == [False, True]
    assert got[1, 10].coverage == got[2, 10].coverage == 1.0 > got[3, 10].coverage
    marked = mark_contamination(odd_papers, fronts, carry=("score",))
    assert marked.count() == odd_papers.count() and {r.score for r in marked.collect()} == {"s"}
    assert mark_contamination(no_papers, fronts).count() == 0
    assert contaminated_papers(odd_papers, fronts.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [D.SIEVE_BITS, 1 << 15])
def test_hits_equal_the_definition(spark, monkeypatch, bits):
    monkeypatch.setattr(D, "SIEVE_BITS", bits)
    draw = random.Random(9)
    words = ["has", "gives", "apples", "pears", "and", "then", "Tom", "Ann", "3", "4", "kg", "miles", "the", "a", "over"]
    cards, papers = [], []
    for k in range(120):
        card = " ".join(draw.choice(words) for _ in range(draw.randint(3, 20)))
        paper = " ".join(draw.choice(words) for _ in range(5)) + " " + card.replace("Tom", "Bob").replace("3", draw.choice("78")) + " and " + card[: draw.randint(0, len(card))]
        cards.append((k, card))
        papers.append((k, paper))
    papers.append(papers[0])  # a repeated row
    frame, fronts = spark.createDataFrame(papers, "paper_id long, text string"), spark.createDataFrame(cards, "card_id int, front string")
    found = contaminated_papers(frame.repartition(3), fronts, coverage=0.0).collect()
    got = {(r.paper_id, r.card_id): r.coverage for r in found}
    for k, (_, paper) in enumerate(papers[:-1]):
        for j in {k, (k * 7 + 1) % 120, (k * 11 + 5) % 120}:
            assert got.get((k, j), 0.0) == pytest.approx(brute_hits(paper, cards[j][1])), (cards[j][1], paper)
    assert len(got) == len(found) - sum(1 for r in found if r.paper_id == 0) // 2


def test_short_cards_can_be_looked_for(spark):
    frame = spark.createDataFrame([(1, "He asked: What is AI? Nothing."), (2, "what is it")], "paper_id long, text string")
    fronts = spark.createDataFrame([(1, "What is AI?"), (2, "Yes")], "card_id int, front string")
    assert contaminated_papers(frame, fronts).isEmpty()
    assert [(r.paper_id, r.card_id, r.run) for r in contaminated_papers(frame, fronts, least_run=1).collect()] == [(1, 1, 3)]


def test_a_common_template_meets_every_card(spark):
    """Very many cards of one template, and a paper that repeats it: every card is checked for itself."""
    cards = [(k, f"How many more apples than {k} pears does the farmer have today") for k in range(300)]
    text = " ".join(f"How many more apples than {k} pears does the farmer have today." for k in (5, 5, 7, 1000))
    frame = spark.createDataFrame([(1, text)], "paper_id long, text string")
    found = contaminated_papers(frame, spark.createDataFrame(cards, "card_id int, front string")).collect()
    assert len(found) == 300 and {r.card_id for r in found if r.run} == {5, 7} and all(r.coverage == 1.0 for r in found)


def test_copies_are_found_in_any_case_and_in_part(spark):
    words = QUESTION.split()
    names = "Anna Maria Lopez Garcia met Paul Peter Jones"  # no template window has four plain words
    papers = [
        QUESTION, QUESTION.upper(), QUESTION.title(), QUESTION.replace(",", "").replace(".", ""), " ".join(words[:13]), " ".join(words[-13:]),
        " ".join(words[:12]), names, names.lower(), "Anna Maria Lopez Garcia met Paul Peter Smith",
    ]
    texts = [f"other words come first {p} and others follow" for p in papers]
    frame = spark.createDataFrame(list(enumerate(texts)), "paper_id long, text string")
    fronts = spark.createDataFrame([(10, QUESTION), (11, names)], "card_id int, front string")
    got = {(r.paper_id, r.card_id): r.run for r in contaminated_papers(frame, fronts).collect()}
    assert got.items() >= {(0, 10): 21, (1, 10): 21, (2, 10): 21, (3, 10): 21, (4, 10): 13, (5, 10): 13, (7, 11): 8, (8, 11): 8}.items()
    assert (9, 11) not in got and all(n >= 8 for k, n in got.items() if k != (6, 10))


def test_runs_equal_the_definition(spark):
    draw = random.Random(4)
    cards, papers = [], []
    for k in range(150):
        card, paper = ([draw.choice("ab") for _ in range(draw.randint(0, n))] for n in (12, 40))
        cards.append((k, " ".join(card)))
        papers.append((k, " ".join(paper).upper()))
    found = contaminated_papers(
        spark.createDataFrame(papers, "paper_id long, text string"), spark.createDataFrame(cards, "card_id int, front string"), run=6
    )
    got = {(r.paper_id, r.card_id): r.run for r in found.collect()}
    for k in range(150):
        card, paper = cards[k][1].split(), papers[k][1].lower().split()
        least = min(6, len(card))
        both = [
            n for n in range(max(least, 4), len(card) + 1) for i in range(len(card) - n + 1)
            if any(paper[j : j + n] == card[i : i + n] for j in range(len(paper) - n + 1))
        ]
        assert got.get((k, k), 0) == (max(both) if both and least >= 4 else 0)


def test_notices_and_blank_lines_are_no_trouble(spark):
    """Texts with very many leading notices, or line breaks, in linear time and without deep recursion."""
    license_text = dict(LICENSES)["MIT"]
    rows = [
        (1, "Copyright (c) 2020 Ada Lovelace\n" * 20_000 + license_text), (2, "\n" * 40_000 + license_text), (3, "\n" * 40_000),
        (4, " * # ; \n" * 20_000 + "© x\n" + license_text), (5, "-" * 200_000 + "x"), (6, "copyright " * 20_000),
    ]
    frame = spark.createDataFrame(rows, "paper_id long, text string")
    start = time.time()
    found = {(r.paper_id, r.scope) for r in scan_licenses(frame).filter("license = 'MIT'").collect()}
    assert {(1, "text"), (2, "text"), (4, "text")} <= found and not {k for k, _ in found} & {3, 5, 6}
    assert time.time() - start < 30


def test_wrapped_license_files_are_found(spark):
    mit, isc = (next(t for n, t in LICENSES if n == k).split("\n", 1)[1] for k in ("MIT", "ISC"))
    bsd = next(t for n, t in LICENSES if n == "BSD-3-Clause")
    stored = Path(licenses.__file__).with_name("license_texts")
    rows = [
        (name, f"{title}Copyright {owner}\n\n{textwrap.fill(text, width)}\n")
        for name, titles, text in (("MIT", ["", "The MIT License (MIT)\n\n"], mit), ("ISC", ["", "ISC License\n\n"], isc), ("BSD-3-Clause", ["", "BSD 3-Clause License\n\n"], bsd))
        for title in titles for owner in ("(c) 2001 Some One", "2001, 2003 Some One", "The Some Authors") for width in range(50, 81)
    ]
    rows.append(("ISC", isc.replace("that the above copyright", "that the above\ncopyright")))
    for file in sorted(stored.iterdir()):
        text = file.read_text("utf-8")
        rows += [(file.stem, text), (file.stem, text.replace("\n", "\r\n")), (file.stem, "\n\n".join(x if "Copyright" in x else textwrap.fill(x, 70) for x in text.split("\n\n")))]
    rows += [(n, f"// SPDX-License-Identifier: {n}") for n, _ in LICENSES]
    frame = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "paper_id long, text string")
    got = {(r.paper_id, r.license) for r in scan_licenses(frame).collect() if r.scope == "text"}
    assert got == {(i, n) for i, (n, _) in enumerate(rows)}


def test_tokens_are_what_the_patterns_say():
    """Tokens of letters between ASCII marks are told without the patterns; all others go through them."""
    words = ["Ann", "ann", "two", "Kg", "Straße", "İSTANBUL", "ﬁn", "x́y", "½", "²", "Ⅷ", "1e5", "5", "-3,5%", "é", "É", "你好", "ab_cd", "a-b", "_", "﷐", "\x01"]
    marks = ["", "(", '"', "_", "“", "$", "...", "?!", "'", "€", "\x1f"]
    for raw in (a + w + b for w in [*words, ""] for a in marks for b in marks):
        inner = D.EDGES.sub("", raw)
        plain = D.MARKS.sub("", inner).casefold()
        if D.NUMBER.fullmatch(raw.rstrip(".,;:!?)\"'").lstrip("(\"'")):
            inner, kind = raw.strip(".,;:!?()\"'+$€£%"), D.NUMERIC
        else:
            low = inner.lower()
            kind = D.NUMERIC if low in D.NUMBER_WORDS else D.UNIT if low in D.UNITS else D.CAPITAL if inner[:1].isupper() else D.WORD
            inner = low
        flags = kind | (D.ENDS_BIT if raw.rstrip("\"'").endswith(D.ENDS) else 0) | (0 if inner else D.SKIP_BIT)
        packed, own = D.Tokens().of(pa.array([raw.encode()]))
        assert (int(packed[0]), int(own[0])) == ((xxhash.xxh3_64_intdigest(inner.encode()) & ~15) | flags, xxhash.xxh3_64_intdigest(plain.encode())), raw
    texts = [None, "", " ", "".join(map(chr, range(128))) + " a\x0bb\x0cc ", " x y \u0085z"]
    assert len(D.templates(texts, D.Tokens()).codes) == len([t for x in texts for t in (x or "").encode().split() if D.EDGES.sub("", t.decode())])


def test_the_table_of_tokens_stays_small():
    """A task that meets ever new tokens keeps no more than a bounded number of them."""
    memo = D.Tokens()
    D.templates(["warm up"], memo)
    tracemalloc.start()
    for k in range(30):
        D.templates([" ".join(f"w{k}x{n}" for n in range(10_000))], memo)
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 25e6, kept

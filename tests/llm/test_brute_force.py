"""Trained operators, license scan and pipeline against plain Python, value by value."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quizlake.llm import language_id, license_scan, ngram_join, toxicity
from quizlake.llm.arrays import _BASE, mixed

SMALL = "/root/testdata/sf0.001"
BLANK = "\x20\x09-\x0d"


# Toxicity


def reader_of(spark, *texts):
    return toxicity.Restorer(toxicity.character_model(spark.createDataFrame([(t,) for t in texts], "text string")))


@pytest.fixture(scope="module")
def reader(spark):
    return reader_of(spark, "the loser and the idiot grüßt müde Straße, a moron by the sea. " * 30, "всё это идиот" * 20)


@settings(max_examples=150, deadline=None)
@given(st.text("ail13!.0oße7", min_size=1, max_size=7))
def test_viterbi_takes_the_cheapest_of_all_paths(reader, word):
    costs = {}
    for path in itertools.product(*reader.lattice(word)):
        a, b, total, made, stands = 0, 0, 0.0, "", True
        for symbol, letter, price in path:
            total += price
            if symbol is not None:
                stands &= symbol != 0 or b != 0
                total += reader.cost(a, b, symbol)
                a, b, made = b, symbol, made + letter
        if stands:
            costs[made] = min(costs.get(made, math.inf), total + (reader.cost(a, b, 0) if b else 0.0))
    assert costs[reader.word(word)] <= min(costs.values()) + 1e-9


def test_costs_are_those_of_counted_letters(spark):
    texts = ["Grüße, ÜBER alles", "Über̈ grün!!", None, "", "ёлка и ёж"]
    model = toxicity.character_model(spark.createDataFrame([(t,) for t in texts], "text string"))
    one, two, three = Counter(), Counter(), Counter()
    for text in texts:
        if text is not None:
            letters = re.sub(r"[^a-zß-ÿа-яё]+", " ", f" {text.lower()} ".replace("̈", ""))
            one.update(letters)
            two.update(zip(letters, letters[1:]))
            three.update(zip(letters, letters[1:], letters[2:]))
    # Texts that follow each other in a task share the blank between them, so only letters are compared.
    number = lambda c: 0 if c == " " else ord(c) - 96 if c <= "z" else ord(c)
    counted = lambda *cs: model.counted(*(np.array([number(c)]) for c in cs))[0]
    for counts in (one, two, three):
        for gram, n in counts.items():
            if " " not in gram:
                assert counted(*gram) == n, gram
    assert counted("ü", "ü") == 0 and counted("ё", "л", "к") == 1


def test_alphabet_grows_with_the_corpus(spark):
    few = reader_of(spark, "abc").characters
    many = reader_of(spark, "abc", "".join(chr(k) for k in range(0x4E00, 0x5200))).characters
    assert few.letters == 4 and many.letters > 1000
    assert reader_of(spark, "zwölf schöne Löwen " * 30).word("sch0ne") in ("schone", "schöne")


def feature_of(word, salt=1):
    value = sum((byte + 1) * pow(int(_BASE), k, 1 << 64) for k, byte in enumerate(word)) % (1 << 64)
    hashed = int(mixed(np.array([value], np.uint64))[0])
    return (hashed * salt % (1 << 64)) >> 44


def plain_score(model, reader, text):
    raw = re.sub(rb"[A-Z]", lambda m: m.group().lower(), reader.text(text or "").encode())
    features = set()
    for word in re.findall(rb"[a-z\x80-\xff]+", raw):
        features |= {feature_of(word), feature_of(re.sub(rb"([a-z])\1+", rb"\1", word))}
        features |= {feature_of(word[:size], 2 * size + 1) for size in (4, 5, 6) if len(word) > size}
    weights = dict(zip(model.features.tolist(), model.weights))
    return 1 / (1 + math.exp(-(model.bias + sum(weights.get(f, 0.0) for f in features))))


# Language ID


def places_of(text):
    folded = [b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in text.encode()]
    for number, order in enumerate(language_id.ORDERS):
        for start in range(len(folded) - order + 1):
            mixed_ = 0
            for byte in folded[start : start + order]:
                mixed_ = (mixed_ * 0x01000193 % (1 << 32)) ^ byte
            yield (mixed_ * 0x9E3779B1 % (1 << 32) >> 18) + number * language_id.BUCKETS


def plain_language(model, text):
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0, False
    places = list(places_of(text))
    margins = model.weights[places].astype(float).sum(axis=0) / max(len(places), 1)
    losses = []
    for code in model.codes:
        bits = zip(margins, code, model.trust)
        losses.append(sum(t * math.log1p(math.exp(-2 * c * max(-4, min(4, m)))) for m, c, t in bits) / sum(model.trust))
    parts = [math.exp(-8 * (loss - min(losses))) for loss in losses]
    best = losses.index(min(losses))
    return model.langs[best], parts[best] / sum(parts), parts[best] / sum(parts) < 0.5


def test_languages_equal_plain_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, "12 !"), (-3, "é"), (-4, "x"), (-5, "der und die 12")], "doc_id long, text string")
    model = language_id.train(docs)
    both = docs.select("doc_id", "text").unionByName(odd)
    texts = {r.doc_id: r.text for r in both.collect()}
    for row in language_id.predict(both, model).collect():
        lang, score, ambiguous = plain_language(model, texts[row.doc_id])
        assert (row.lang_pred, row.ambiguous) == (lang, ambiguous) and abs(row.score - score) < 1e-6, row.doc_id


def test_weights_are_log_ratios_of_counted_grams(spark, documents):
    rows = [(k, f"{words} {k % 7}é", lang) for k, (words, lang) in enumerate(
        [("der die und", "de"), ("the and of", "en"), ("le et un", "fr")] * 8)]
    model = language_id.train(documents(*rows))
    counts = defaultdict(Counter)
    for doc_id, text, lang in rows:
        if zlib.crc32(str(doc_id).encode()) % 5 != 0:
            counts[lang].update(places_of(text))
    shares = {}
    for lang in model.langs:
        own = np.array([counts[lang][place] + 0.1 for place in range(2 * language_id.BUCKETS)])
        shares[lang] = np.concatenate([part / part.sum() for part in np.split(own, 2)])
    for bit in range(model.codes.shape[1]):
        sides = [np.mean([shares[x] for x, c in zip(model.langs, model.codes[:, bit]) if c == s], axis=0) for s in (1, -1)]
        ratio = np.log(sides[0] / sides[1])
        scale = np.mean([c * (shares[x] * ratio).sum() / 2 for x, c in zip(model.langs, model.codes[:, bit])])
        assert np.allclose(model.weights[:, bit], ratio / scale, atol=1e-4)


def test_least_distance_in_blocks():
    code = np.random.default_rng(3).choice(np.array([-1, 1], np.int8), (230, 31))
    expected = min(int((a != b).sum()) for a, b in itertools.combinations(code, 2))
    assert language_id._least_distance(code, 50) == expected
    assert language_id._least_distance(language_id.codewords(230)) > 10


def test_draws_keep_to_their_share(spark):
    share = 1e-7
    found = spark.range(0, 40_000_000, 1, 8).filter(language_id.drawn(F.col("id"), F.lit(share))).count()
    assert found <= 20
    assert spark.range(1000).filter(language_id.drawn(F.col("id"), F.lit(1.5))).count() == 1000


# License scan


def plain_licenses(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    spans = []
    for number, (phrase, label) in enumerate(license_scan.BASE + license_scan.PASSAGES):
        own, base = phrase.split(), number < len(license_scan.BASE)
        voting = [p for p in range(len(own) - 1) if not set(own[p : p + 2]) <= set(license_scan.COMMON)]
        hits = defaultdict(set)
        for place in range(len(words) - 1):
            for p in voting:
                if words[place : place + 2] == own[p : p + 2]:
                    hits[place - p].add(p)
        merged = []
        for diagonal in sorted(hits):
            if base and len(hits[diagonal]) < len(voting):
                continue
            if base or not merged or diagonal - merged[-1][1] > license_scan.GAP:
                merged.append([diagonal, diagonal, set()])
            merged[-1][1] = diagonal
            merged[-1][2] |= hits[diagonal]
        for low, high, seen in merged:
            if len(seen) < len(voting) * 0.6:
                continue
            held = [any(0 <= d + p < len(words) and words[d + p] == own[p] for d in range(low, high + 1)) for p in range(len(own))]
            coverage = sum(held) / len(own)
            if coverage >= (1.0 if base else 0.6):
                spans.append((base, label, max(low, 0), coverage))
    best = [s for s in spans if s[0] or s[3] == max(o[3] for o in spans if not o[0] and abs(o[2] - s[2]) <= license_scan.GAP)]
    places = [s[2] for s in best if s[0]]
    return (
        len(words), len(places), min(places, default=None), max(places, default=None),
        ",".join(sorted({s[1] for s in best if s[0]})), ",".join(sorted({s[1] for s in best})),
        max((s[3] for s in best), default=0.0),
    )


def test_license_scan_equals_plain_python(documents):
    chance = random.Random(17)
    phrases = [phrase for phrase, _ in license_scan.BASE + license_scan.PASSAGES]
    texts = [None, "", "MIT", "mit license mit license", "MIT-License. é apache ÉLICENSE apache license"]
    for _ in range(220):
        words = []
        for _ in range(chance.randrange(1, 5)):
            words += chance.choices(["the", "of", "license", "mit", "foo", "ÀB", "7"], k=chance.randrange(4))
            phrase = chance.choice(phrases).split()
            start = chance.randrange(len(phrase)) if chance.random() < 0.3 else 0
            for word in phrase[start:]:
                luck = chance.random()
                words += [] if luck < 0.06 else [word, "odd"] if luck < 0.12 else [word.upper() if luck < 0.2 else word]
        texts.append(chance.choice([" ", ", ", "\n"]).join(words))
    found = license_scan.scan_licenses(documents(*enumerate(texts))).collect()
    assert len(found) == len(texts)
    for row in found:
        assert tuple(row)[1:] == plain_licenses(texts[row.doc_id]), texts[row.doc_id]


def test_votes_of_a_template_fit_a_long():
    assert all(len(phrase.split()) < 64 for phrase, _ in license_scan.BASE + license_scan.PASSAGES)


# N-gram join


def test_recall_at_the_threshold_with_the_default_bands(documents):
    """Pairs whose similarity is 0.8 exactly, the hardest that count: 49 words, one of them another."""
    chance, rows, pairs = random.Random(23), [], 1_500
    for pair in range(pairs):
        words = [f"w{chance.randrange(10**9)}" for _ in range(49)]
        other = list(words)
        other[chance.randrange(4, 45)] = "other"
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(other))]
    found = {r.doc_id: r for r in ngram_join.near_duplicates(documents(*rows)).collect()}
    linked = [found[2 * k].n_links for k in range(pairs)]
    assert set(linked) <= {0, 1} and sum(linked) / pairs >= 0.996
    assert all((found[2 * k].group_id == found[2 * k + 1].group_id) == bool(linked[k]) for k in range(pairs))


# Pipeline


def plain_lines(texts):
    key = lambda line: re.sub("[A-Z]", lambda m: m.group().lower(), re.sub(f"^[{BLANK}]+|[{BLANK}]+$", "", line))
    holders = defaultdict(set)
    for doc_id, text in texts.items():
        for line in text.split("\n"):
            holders[key(line)].add(doc_id)
    gone = {k: max(ids) for k, ids in holders.items() if len(k) >= 40 and len(ids) >= 5}
    return {
        doc_id: "\n".join(line for line in text.split("\n") if gone.get(key(line), doc_id) == doc_id)
        for doc_id, text in texts.items()
    }


def plain_representatives(texts):
    sets = {}
    for doc_id, text in texts.items():
        words = re.findall(f"[^{BLANK}]+", text)
        sets[doc_id] = {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()
    group = {doc_id: doc_id for doc_id in texts}
    for a, b in itertools.combinations(sorted(texts), 2):
        same = sets[a] == sets[b]
        if same or (sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
            low, high = sorted((group[a], group[b]))
            group = {k: low if v == high else v for k, v in group.items()}
    return {doc_id for doc_id in texts if group[doc_id] == doc_id}


def test_pipeline_equals_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    given_rows = docs.collect()
    line = "This very line stands in many documents and has over forty code points."
    english = next(r.text for r in given_rows if r.lang == "en" and len(r.text) > 400)
    planted = [(10**6 + k, f"{line}\n{r.text}\n{line}") for k, r in enumerate(given_rows[:9])]
    planted += [(10**6 + 20, english), (10**6 + 21, f"{english} end"), (10**6 + 22, "12 34"), (10**6 + 23, None), (10**6 + 24, "")]
    base = given_rows[0].asDict()
    rows = [{**base, "doc_id": k, "text": t, "lang": None, "n_chars": len(t or "")} for k, t in planted]
    docs.unionByName(spark.createDataFrame(rows, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}

    model = language_id.train(docs)
    judged = {k: plain_language(model, t) for k, t in texts.items()}
    texts = {k: t for k, t in texts.items() if judged[k][0] != "und" and not judged[k][2]}
    assert {10**6 + 22, 10**6 + 23, 10**6 + 24}.isdisjoint(texts) and 10**6 + 20 in texts
    docs = docs.join(spark.createDataFrame([(k,) for k in texts], "doc_id long"), "doc_id", "left_semi")

    model = toxicity.train(docs, labels)
    reader = toxicity.Restorer(model.characters)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for k, t in texts.items():
        assert abs(scores[k] - plain_score(model, reader, t)) < 1e-9, k
    texts = {k: t for k, t in texts.items() if scores[k] < 0.5}
    texts = plain_lines(texts)
    assert sum(line in t for t in texts.values()) <= 1
    stay = plain_representatives(texts)
    assert 0 < len(stay) < len(texts)

    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    lengths, taken = Counter(), defaultdict(list)
    for row in found:
        lengths[row.doc_id] += row.length
        taken[row.sequence_id].append((row.offset, row.length))
    assert lengths == {k: len(library.encode(texts[k], add_special_tokens=False).ids) + 1 for k in stay}
    for places in taken.values():
        ends = [0, *itertools.accumulate(size for _, size in sorted(places))]
        assert [start for start, _ in sorted(places)] == ends[:-1] and ends[-1] <= 2048

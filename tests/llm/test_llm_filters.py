import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from llm.llm_helpers import LANGS, WORD, documents, texts

from vocabmill.llm import host_reputation, language_id, license_scan, quality_rules
from vocabmill.llm.queries import URL_RULES, held_out

# Quality rules


def base_counts(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    marked = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked)


@pytest.fixture(scope="module")
def limits():
    return quality_rules.Limits()


def test_base_counts(spark, limits):
    docs = documents(spark)
    rows = quality_rules.judged(docs, quality_rules.references(docs, limits), limits).collect()
    found = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert found == sorted((-1 if i is None else i, *base_counts(t)) for i, t, _ in texts())
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def entropy_distance(a, b):
    middle = (a + b) / 2
    parts = [sum(x * np.log2(x / m) for x, m in zip(side, middle, strict=True) if x) for side in (a, b)]
    return np.sqrt(max(sum(parts), 0) / 2)


def test_distances_to_references(spark, limits):
    docs = documents(spark)
    found = quality_rules.references(docs, limits)
    assert set(found) == {"en", "de", "fr"}
    words = {lang: Counter(w for _, t, own in texts() if own == lang for w in (t or "").encode().lower().split()) for lang in found}
    for lang, (classes, common, shares) in found.items():
        top = sorted(words[lang].items(), key=lambda x: (-x[1], x[0]))[: limits.common_words]
        assert common == [w for w, _ in top]
        total = sum(words[lang].values())
        assert np.allclose(shares, [*(n / total for _, n in top), 1 - sum(n for _, n in top) / total])
        assert np.isclose(classes.sum(), 1)
    rows = {r.doc_id: r for r in quality_rules.judged(docs, found, limits).collect()}
    for i, t, _ in texts()[:20]:
        own = Counter((t or "").encode().lower().split())
        distances = []
        for _, common, shares in found.values():
            counts = [own[w] for w in common]
            text_shares = np.array([*counts, sum(own.values()) - sum(counts)]) / max(sum(own.values()), 1)
            distances.append(entropy_distance(text_shares, shares))
        assert np.isclose(rows[i].word_distance, min(distances), atol=1e-6)


def test_junk_is_rejected_and_prose_kept(spark, limits):
    rows = [(i, t, lang) for i, t, lang in texts() if i is not None and i < 60]
    junk = " ".join(f"{w}### $$$ &&& |" for w in (rows[0][1] or "").split()[:100])
    table = " | ".join(f"zq{k}x" for k in range(200))
    docs = documents(spark, [*rows, (900, junk, "en"), (901, table, "en"), (902, None, None)])
    verdict = {r.doc_id: r.kept for r in quality_rules.judged(docs, quality_rules.references(documents(spark, rows), limits), limits).collect()}
    assert all(verdict[i] for i, _, _ in rows)
    assert not verdict[900] and not verdict[901] and not verdict[902]


def rare_words(rng, count):
    return ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(4, 10))) for _ in range(count)]


def test_text_without_common_words_is_rejected(spark, limits):
    rng = random.Random(9)
    common = ["c" + w for w in rare_words(rng, 100)]

    def mixed(size, share):
        return " ".join(rng.choice(common) if rng.random() < share else w for w in rare_words(rng, size))

    found = quality_rules.references(documents(spark, [(1, mixed(30_000, 0.36), "en")]), limits)
    sizes = (40, 100, 300, 1000, 2000, 8000)
    gibberish = [(k, " ".join(rare_words(rng, n)), None) for k, n in enumerate(sizes)]
    prose = [(100 + k, mixed(n, 0.36), None) for k, n in enumerate(sizes)]
    rows = quality_rules.judged(documents(spark, gibberish + prose), found, limits).collect()
    assert {r.doc_id: r.kept for r in rows} == {i: i >= 100 for i, _, _ in gibberish + prose}
    # Its characters are those of the language: only the words tell.
    assert all(r.char_distance < limits.characters and not r.base_failed for r in rows)


def test_one_nearest_language_for_both_histograms(spark, limits):
    docs = documents(spark, [(1, "the cat of the hill " * 50, "en"), (2, "DER HUND 12 34 DIE " * 50, "de")])
    mixed = documents(spark, [(3, "THE CAT OF THE HILL " * 3, None)])  # words of one language, letters of the other
    found = quality_rules.references(docs, limits)
    apart = [quality_rules.judged(mixed, {lang: found[lang]}, limits).collect()[0] for lang in ("en", "de")]
    both = quality_rules.judged(mixed, found, limits).collect()[0]
    assert (both.char_distance, both.word_distance) in [(r.char_distance, r.word_distance) for r in apart]


def test_quality_without_labels_or_rows(spark, limits):
    unlabelled = documents(spark, [(1, "a few plain words that pass all of the base rules", None), (2, None, None)])
    found = quality_rules.references(unlabelled, limits)
    assert found == {}
    assert {r.doc_id: r.kept for r in quality_rules.judged(unlabelled, found, limits).collect()} == {1: True, 2: False}
    empty = documents(spark, [])
    assert quality_rules.judged(empty, quality_rules.references(empty, limits), limits).collect() == []


# Language


def test_language_of_held_out_texts(spark):
    docs = documents(spark)
    model = language_id.train(docs.where(~held_out()), language_id.Params(epochs=10))
    assert model.languages == sorted(LANGS) and 0 < model.threshold <= language_id.MAX_THRESHOLD
    rows = language_id.predict(docs, model, columns=(held_out(),)).collect()
    assert len(rows) == len(texts())
    truth = {i: lang for i, t, lang in texts() if i is not None and i < 60}
    tested = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(tested) > 5
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in tested]) > 0.9
    for r in rows:
        text = next(t for i, t, _ in texts() if i == r.doc_id)
        assert 0 <= r.score <= 1
        if r.doc_id in (80, 81, 82, 87):
            assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False), text
        elif r.doc_id is not None:
            assert r.lang_pred in LANGS


def test_language_without_labels(spark):
    docs = documents(spark, [(1, "some words", None), (2, None, "en")])
    assert language_id.train(docs) is None
    assert {(r.doc_id, r.lang_pred, r.score, r.accepted) for r in language_id.predict(docs, None).collect()} == {(1, "und", 0.0, False), (2, "und", 0.0, False)}
    assert language_id.predict(documents(spark, []), None).collect() == []


def test_sample_is_bounded_without_ids(spark):
    rows = [(None, f"no id {i}", "en") for i in range(400)] + [(5, f"one id {i}", "en") for i in range(400)]
    rows += [(i, f"own id {i}", "en") for i in range(100, 500)] + [(None, "the same row", "en")] * 300 + [(i, f"de {i}", "de") for i in range(20)]
    params = language_id.Params(per_language=60)
    found = language_id.sample(documents(spark, rows), params, "doc_id", "lang").collect()
    assert len(found) == len({(r.doc_id, r.text) for r in found})
    assert Counter(r.lang for r in found) == {"en": 60, "de": 20}
    kinds = Counter(r.text[:6] for r in found if r.lang == "en")
    assert all(kinds[kind] > 5 for kind in ("no id ", "one id", "own id"))


def test_subwords_do_not_depend_on_blocks():
    text = "Der Hund, die Katze! 3 été"
    whole, sizes, letters = language_id.subwords([(0, text, True)], 15)
    together, both, _ = language_id.subwords([(0, text, True), (1, "", True), (2, text, True)], 15)
    assert both.tolist() == [sizes[0], 0, sizes[0]] and letters[0] == 18
    assert sorted(together[: sizes[0]]) == sorted(whole) == sorted(together[sizes[0] :])


def plain_prediction(model, text):
    """Subwords one by one, their numbers summed, a softmax: one text at a time."""
    mask, bits = (1 << 64) - 1, model.bits
    shown = "".join((c.lower() if len(c.lower()) == 1 else c) if unicodedata.category(c)[0] in "LM" else " " for c in text or "")
    shown = re.sub(" +", " ", shown + " ").lstrip(" ")
    if not any(unicodedata.category(c)[0] == "L" for c in text or ""):
        return "und", 0.0
    buckets = []
    for i, c in enumerate(shown):
        one, two = shown[i - 1] if i else " ", shown[i - 2] if i > 1 else " "
        pair = ord(one) * 0x9E3779B97F4A7C15 + ord(c) * 0xC2B2AE3D27D4EB4F
        buckets.append(((pair & mask) * 0xD6E8FEB86659FD93 & mask) >> (64 - bits))
        if one != " ":
            triple = ord(one) * 0x165667B19E3779F9 + ord(c) * 0xC2B2AE3D27D4EB4F + ord(two) * 0x27D4EB2F165667C5
            buckets.append(((triple & mask) * 0xD6E8FEB86659FD93 & mask) >> (64 - bits))
    mean = sum(model.table[b].astype(float) for b in buckets) / len(buckets)
    logits = ((mean if model.weights is None else mean @ model.weights) + model.bias) / model.temperature
    chance = np.exp(logits - logits.max())
    return model.languages[int(chance.argmax())], float(chance.max() / chance.sum())


@pytest.mark.parametrize("width", [16, 2])
def test_predictions_equal_a_plain_version(spark, width):
    """With the softmax's weights in the table, and with fewer numbers than languages."""
    rows = [*texts(), (300, "\u0301\u0308 \u20dd", "de"), (301, "a\u0301 É ǅ İx", None), (302, "x", None)]
    docs = documents(spark, rows)
    model = language_id.train(docs, language_id.Params(epochs=2, visits=500, width=width))
    assert (model.weights is None) == (width == 16)
    for r in language_id.predict(docs, model, columns=("text",)).collect():
        lang, score = plain_prediction(model, r.text)
        assert (r.lang_pred, r.score) == (lang, pytest.approx(score, abs=1e-4)), r.text
        if r.doc_id == 300:
            assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)


def test_many_languages(spark):
    """Hundreds of labels are learned and have references; none is left out."""
    rows = [(10 * k + j, f"zorg{k:03d} blin{k:03d} wux{k:03d} " * 20, f"l{k:03d}") for k in range(230) for j in range(2)]
    docs = documents(spark, rows)
    model = language_id.train(docs, language_id.Params(epochs=1, visits=1))
    assert len(model.languages) == 230 and model.table.shape[1] == 16
    one = language_id.sample(docs.select("doc_id", "text", "lang"), language_id.Params(sampled=230), "doc_id", "lang").collect()
    assert Counter(r.lang for r in one) == {f"l{k:03d}": 1 for k in range(230)}
    assert len(quality_rules.references(docs, quality_rules.Limits())) == 230


# Licences

SEPARATORS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LICENSED = [
    (1, "Released under the MIT License. mit license! MIT-license", None),
    (2, "GNU General Public\nLicense and cc by, CC-BY 4.0; gnu general license", None),
    (3, "This work is licensed under the GNU General Public License, version 3.", None),
    (4, "You may not really use this file, except in compliance with the License", None),
    (5, "mit license mit license mit license", None),
    (6, "commit license mitlicense é license cc\u00a0by", None),
    (7, None, None),
    (8, "", None),
    (9, "apache", None),
    (10, "words " * 30_000 + "Apache License", None),
    (10, "words " * 30_000 + "Apache License", None),
    (None, "the Apache license", None),
    (11, "permission is hereby granted to nobody free of any charge", None),
]


def test_licence_places(spark):
    rows = license_scan.scan(documents(spark, LICENSED)).collect()
    assert len(rows) == len(LICENSED)
    for r in rows:
        text = next(t for i, t, _ in LICENSED if i == r.doc_id) or ""
        words = SEPARATORS.findall(text.translate(str.maketrans(host_reputation.UPPER, host_reputation.LOWER)))
        places, labels = [], set()
        for phrase, label in license_scan.PHRASES.items():
            own = phrase.split()
            found = [i for i in range(len(words)) if words[i : i + len(own)] == own]
            places += found
            labels |= {label} if found else set()
        assert (r.n_words, r.n_base) == (len(words), len(places)), text[:50]
        assert (r.first_word, r.last_word) == ((min(places), max(places)) if places else (None, None))
        assert r.base_labels == ",".join(sorted(labels))
        assert labels <= set(r.labels.split(",")) or not labels
        assert 0 <= r.score <= 1 and (r.score == 1 or not places)


def test_notices_with_inserted_words(spark):
    rows = {r.doc_id: r for r in license_scan.scan(documents(spark, LICENSED)).collect()}
    assert rows[3].labels == "gpl,gpl-3.0"
    assert rows[4].labels == "apache-2.0" and 0.75 <= rows[4].score < 1 and rows[4].n_base == 0
    assert rows[11].labels == ""
    spans = license_scan.spans_of(documents(spark, LICENSED[:1]), license_scan.PHRASES).collect()
    assert sorted((s.label, s.base, s.first_word) for s in spans) == [("mit", False, 0), ("mit", True, 3), ("mit", True, 5), ("mit", True, 7)]


def test_licences_of_an_empty_table(spark):
    assert license_scan.scan(documents(spark, [])).collect() == []
    with pytest.raises(ValueError, match="two words"):
        license_scan.scan(documents(spark, []), {"one": "x"})


def test_whole_licences_as_templates(spark):
    """Templates of hundreds of words, as phrases and as notices with changes."""
    rng = random.Random(12)
    long = " ".join(rng.choice(["the", "software", "shall", "licence", "use", "of", "any", "kind", "copy", f"w{rng.randrange(300)}"]) for _ in range(400))
    words = long.split()
    changed = words[:100] + ["inserted"] + words[100:250] + words[251:]
    half = words[:200] + [f"z{i}" for i in range(200)]
    docs = documents(spark, [(1, "x " + long + " y", None), (2, " ".join(changed), None), (3, " ".join(half), None), (4, long + " " + long, None)])
    rows = {r.doc_id: r for r in license_scan.scan(docs, {long: "whole"}, {}).collect()}
    assert {i: (r.n_base, r.first_word, r.last_word) for i, r in rows.items()} == {1: (1, 1, 1), 2: (0, None, None), 3: (0, None, None), 4: (2, 0, 400)}
    rows = {r.doc_id: r for r in license_scan.scan(docs, {}, {long: "whole"}).collect()}
    assert {i for i, r in rows.items() if r.labels == "whole"} == {1, 2, 4}
    assert 0.9 < rows[2].score < 1 and rows[1].score == 1


# Hosts

URLS = {
    1: ("https://A.example.ORG/es/1?x", "a.example.org", "/es/1", "example.org/es/", "block"),
    2: ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
    3: ("http://example.org/en/2#a/b", "example.org", "/en/2", "org/", "allow"),
    4: ("x://y.com/de/", "y.com", "/de/", "com/de/", "block"),
    5: ("x://y.com/de", "y.com", "/de", None, "allow"),
    6: ("x://notorg/", "notorg", "/", None, "allow"),
    7: (None, "", "", None, "allow"),
    8: ("no scheme/es/", "", "", None, "allow"),
    9: ("a://b://c/d", "b:", "//c/d", None, "allow"),
    10: ("://É.Example.org", "É.example.org", "", None, "allow"),
    11: ("x://org/fr/\n?", "org", "/fr/\n", "org/", "allow"),
}


def judged(spark, pages, outcomes):
    pages = spark.createDataFrame([(i, u, "h", "v", 0.1, "x") for i, u in pages], "page_id long, url string, host string, verdict string, bad double, rule string")
    outcomes = spark.createDataFrame(outcomes, "page_id long, bad boolean")
    return host_reputation.judged(pages, outcomes, URL_RULES).collect()


def test_rules(spark):
    rows = judged(spark, [(i, u[0]) for i, u in URLS.items()], [])
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows} == {i: u[1:] for i, u in URLS.items()}


def test_reputation_shrinks(spark):
    pages = [(i, f"http://bad{i % 3}.spam.net/") for i in range(300)] + [(1000 + i, f"http://h{i % 40}.fine.net/") for i in range(400)]
    pages += [(2000, "http://new.spam.net/"), (2001, "http://one.other.net/"), (2002, "http://www.unseen.net/"), (1, "http://bad1.spam.net/")]
    outcomes = [(i, i % 10 != 0) for i in range(300)] + [(1000 + i, i % 50 == 0) for i in range(400)] + [(2001, True), (5000, True), (2002, None)]
    rows = judged(spark, pages, outcomes)
    assert len(rows) == len(pages)
    verdict = {r.host: r.verdict for r in rows}
    assert all(verdict[f"bad{i}.spam.net"] == "block" for i in range(3))
    assert all(verdict[f"h{i}.fine.net"] == "allow" for i in range(40))
    assert verdict["one.other.net"] == "allow"  # one bad page is too little
    assert verdict["www.unseen.net"] == "allow"


def test_no_pages(spark):
    assert judged(spark, [], [(1, True)]) == []


def test_registered_domains(spark):
    hosts = spark.createDataFrame([("a.b.co.uk",), ("a.b.com",), ("com",), ("",), ("b.co.uk",)], "h string")
    domain, suffix = host_reputation.domain_of(hosts.h, host_reputation.SUFFIXES)
    assert [(r[0], r[1]) for r in hosts.select(domain, suffix).collect()] == [("b.co.uk", "co.uk"), ("b.com", "com"), ("com", "com"), ("", ""), ("b.co.uk", "co.uk")]
    odd = spark.createDataFrame([("1.2.3.4",), ("1.2.3.4:80",), ("a.com:8080",), ("user:pw@b.co.uk",), ("[::1]:80",), ("a.b.com:",), ("@",)], "h string")
    domain, suffix = host_reputation.domain_of(odd.h, host_reputation.SUFFIXES)
    assert [(r[0], r[1]) for r in odd.select(domain, suffix).collect()] == [
        ("1.2.3.4", ""), ("1.2.3.4", ""), ("a.com", "com"), ("b.co.uk", "co.uk"), ("[::1]", ""), ("b.com", "com"), ("", "")
    ]

"""Counts by rule of a job, against the checks that scan for one rule each."""

import pytest
from test_sources import gz

from vocabmill import Config, Audit, audited_word_list, read_entries, word_list
from vocabmill.operators import filters, quality, rollup
from vocabmill.operators.audit import LINE_CAUSES, REJECT_CAUSES
from vocabmill.plans import queries as registered

CONFIG = Config(min_matches=20, min_books=3, max_outputs=50, sort_by_popularity=True)


@pytest.fixture(scope="module")
def lines(spark):
    entries = registered.entries(spark, "/root/testdata/sf0.001")
    return registered._broken_lines(entries).select("value").cache()


def test_counts_equal_those_of_the_checks(spark, lines):
    audit = Audit()
    found = audited_word_list(lines, CONFIG, audit, with_stats=True).collect()
    counts = audit.counts
    bad = quality.check_decode(lines)
    assert {c: counts[f"decode:{c}"] for c in LINE_CAUSES} == {c: bad.where(f"cause = '{c}'").count() for c in LINE_CAUSES}
    good = lines.join(bad.select("value").distinct(), "value", "left_anti").where("value <> ''")
    split = good.selectExpr("split(value, '\t') as f").selectExpr("get(f, 0) as ngram", *(f"try_cast(get(f, {k}) as bigint) as {name}" for k, name in ((1, "year"), (2, "match_count"), (3, "volume_count"))))
    assert counts["empty"] == quality.check_empty(split, strip=True).count()
    words = split.where("ngram <> ''")
    accepted = filters.accept(words, CONFIG)
    assert counts["books"] == quality.check_books(accepted).count()
    sound = accepted.where("match_count >= volume_count")
    assert counts["repeated_years"] == quality.repeated_years(sound).count() > 0
    earliest = filters.rejection_audit(words, CONFIG)
    assert {c: counts[f"rejected:{c}"] for c in REJECT_CAUSES} == {c: earliest.where(f"cause = '{c}'").count() for c in REJECT_CAUSES}
    assert counts["unsupported"] == rollup.yearly_rollup(sound).where("match_count < 20 or volume_count < 3").count()
    assert counts["class"] == 0
    assert all(n > 0 for rule, n in counts.items() if rule != "class")
    once = sound.groupBy("ngram", "year").agg({"match_count": "sum", "volume_count": "sum"}).toDF("ngram", "year", "match_count", "volume_count")
    assert found == word_list(once, CONFIG, with_stats=True).collect()


def test_one_scan(spark, tmp_path):
    gz(tmp_path / "a.gz", "apple\t2000\t70\t30", "broken", "Bad\t2000\t7\t3")
    text = spark.read.text(str(tmp_path))
    plan = audited_word_list(text, CONFIG, Audit())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1 and plan.count("CollectMetrics") == 5 and "Join" not in plan


def test_files_are_told_apart(spark, tmp_path):
    gz(tmp_path / "a.gz", "apple\t2000\t70\t30", "pear\t2100\t70\t30", "pear\t2100\t70\t30", "broken")
    gz(tmp_path / "b.gz", "apple\t2000\t70\t30")
    text = spark.read.text(str(tmp_path)).selectExpr("value", "_metadata.file_path as file")
    audit = Audit()
    rows = audited_word_list(text, CONFIG, audit).collect()
    assert [r.ngram for r in rows] == ["pear", "apple"]
    assert {rule: n for rule, n in audit.counts.items() if n} == {"decode:field_count": 1, "repeated_years": 1}
    assert audit.table(spark).where("n > 0").count() == 2
    with pytest.raises(Exception, match="bad entry"):
        word_list(read_entries(spark, str(tmp_path), with_file=True), CONFIG, checked=True).collect()


def test_no_lines(spark):
    audit = Audit()
    assert audited_word_list(spark.createDataFrame([], "value string"), CONFIG, audit).collect() == []
    assert set(audit.counts.values()) == {0}

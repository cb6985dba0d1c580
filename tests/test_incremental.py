import os
import time

import pytest
from helpers import random_entries
from test_sources import gz

from vocabmill import Config, current_words, merge_files, read_entries, run_incremental
from vocabmill.session import list_names, remove_path
from vocabmill.streaming import incremental
from vocabmill.streaming.incremental import _generations, _manifest, current_classes, fold_files, present_files

CONFIG = Config(False, 1962, 3, 2)


def write(folder, file, rows):
    lines = ["\t".join(str(v) for v in row[:4]) for row in sorted(rows) if row[4] == file]
    return gz(folder / f"{file}.gz", *lines)


def as_set(df):
    return {(r.fold_key, r.top_casing, r.match_count, r.min_volume_count, r.top_stats) for r in df.collect()}


def test_files_in_any_batches_equal_one_batch_run(spark, tmp_path):
    rows = random_entries(7, files=4)
    inbox, state = tmp_path / "in", str(tmp_path / "state")
    inbox.mkdir()
    paths = []
    assert run_incremental(spark, str(inbox), state, CONFIG).collect() == []
    for arrivals in (["f2"], ["f0", "f3"], [], ["f1"]):
        paths += [write(inbox, file, rows) for file in arrivals]
        found = run_incremental(spark, str(inbox), state, CONFIG, max_files_per_batch=1)
        if paths:
            batch = merge_files(read_entries(spark, paths, with_file=True), CONFIG, scope="file")
            assert as_set(found) == as_set(batch)
    words = current_words(spark, state, CONFIG)
    assert {r.ngram for r in words.collect()} == {r.top_casing for r in found.collect()}


def test_replayed_batch_changes_nothing(spark, tmp_path):
    rows = random_entries(8, files=2)
    inbox, state = tmp_path / "in", str(tmp_path / "state")
    inbox.mkdir()
    path = write(inbox, "f0", rows)
    run_incremental(spark, str(inbox), state, CONFIG)
    write(inbox, "f1", rows)
    before = as_set(run_incremental(spark, str(inbox), state, CONFIG))
    first = present_files(spark, path).collect()
    fold_files(spark, first, "arrived-0", state, CONFIG)
    assert as_set(current_classes(spark, state)) == before
    fold_files(spark, first, "arrived-7", state, CONFIG)  # a second part with the same version
    assert as_set(run_incremental(spark, str(inbox), state, CONFIG)) == before


def age(path, days):
    then = time.time() - days * 86_400
    os.utime(path, (then, then))


def test_old_files_are_read_whenever_they_arrive(spark, tmp_path):
    """Later in the same state, in one batch or several, and after a restart of the session."""
    rows = random_entries(9, files=4)
    inbox, state = tmp_path / "in", str(tmp_path / "state")
    inbox.mkdir()
    paths = [write(inbox, "f0", rows)]
    run_incremental(spark, str(inbox), state, CONFIG)
    for file, days in (("f1", 30), ("f2", 4000), ("f3", 0)):
        paths.append(write(inbox, file, rows))
        age(paths[-1], days)
        session = spark.newSession()
        found = run_incremental(session, str(inbox), state, CONFIG)
        batch = merge_files(read_entries(spark, paths, with_file=True), CONFIG, scope="file")
        assert as_set(found) == as_set(batch)


def batch_of(spark, paths):
    return as_set(merge_files(read_entries(spark, [str(p) for p in paths], with_file=True), CONFIG, scope="file"))


def test_compacted_state_is_the_same(spark, tmp_path):
    rows = random_entries(11, files=6)
    states = {after: str(tmp_path / f"state{after}") for after in (0, 1, 100)}
    inbox = tmp_path / "in"
    inbox.mkdir()
    for file in ("f3", "f0", "f5", "f1", "f2", "f4"):
        write(inbox, file, rows)
        found = {after: as_set(run_incremental(spark, str(inbox), state, CONFIG, compact_after=after)) for after, state in states.items()}
        assert found[0] == found[1] == found[100]
    based = {after: _manifest(spark, state).where("base is not null").count() for after, state in states.items()}
    assert based[0] == 6 and 2 <= based[1] <= 6 and based[100] == 0
    assert len(list_names(spark, f"{states[100]}/classes")) == 6
    assert all(len(_generations(spark, state)) == 2 for state in states.values())


@pytest.mark.parametrize("compact_after", [0, 2, 100])
def test_replaced_and_removed_files(spark, tmp_path, compact_after, monkeypatch):
    """After each change the state is that of a batch run over the files that are there."""
    monkeypatch.setattr(incremental, "GROUPS", 2)
    first, second = random_entries(21, files=5), random_entries(22, files=5)
    inbox, state = tmp_path / "in", str(tmp_path / "state")
    inbox.mkdir()
    for file in ("f0", "f1", "f2", "f3"):
        write(inbox, file, first)

    def run():
        found = as_set(run_incremental(spark, str(inbox), state, CONFIG, max_files_per_batch=2, compact_after=compact_after))
        assert found == batch_of(spark, sorted(inbox.iterdir()))
        return found

    before = run()
    write(inbox, "f1", second)  # replaced
    age(inbox / "f1.gz", 1)
    after = run()
    assert after != before
    (inbox / "f2.gz").unlink()  # removed
    run()
    write(inbox, "f1", first)  # replaced again, another arrives, one is emptied
    write(inbox, "f4", second)
    gz(inbox / "f3.gz")
    run()
    write(inbox, "f2", first)  # a removed one is back
    write(inbox, "f3", second)
    run()
    generations = _generations(spark, state)
    run()  # nothing new
    assert _generations(spark, state) == generations
    for path in inbox.iterdir():
        path.unlink()
    assert as_set(run_incremental(spark, str(inbox), state, CONFIG, compact_after=compact_after)) == set()


def test_replaced_file_by_example(spark, tmp_path):
    inbox, state = tmp_path / "in", str(tmp_path / "state")
    inbox.mkdir()
    config = Config(False, 1962, 1, 1)
    gz(inbox / "a.gz", "apple\t2000\t7\t3")
    gz(inbox / "b[1].gz", "berry\t2000\t7\t3")
    run_incremental(spark, str(inbox), state, config)
    assert {r.ngram for r in current_words(spark, state, config).collect()} == {"apple", "berry"}
    gz(inbox / "a.gz", "avocado\t2000\t7\t3")
    run_incremental(spark, str(inbox), state, config, compact_after=0)
    assert {r.ngram for r in current_words(spark, state, config).collect()} == {"avocado", "berry"}


def test_frames_outlive_the_next_run(spark, tmp_path):
    rows = random_entries(13, files=4)
    inbox, state = tmp_path / "in", str(tmp_path / "state")
    inbox.mkdir()
    frames = []
    for file in ("f0", "f1", "f2", "f3"):
        write(inbox, file, rows)
        frames.append(run_incremental(spark, str(inbox), state, CONFIG, compact_after=0))
        expected = batch_of(spark, sorted(inbox.iterdir())[:-1]) if len(frames) > 1 else set()
        if len(frames) > 1:
            assert as_set(frames[-2]) == expected


def test_failed_run_leaves_the_state(spark, tmp_path, monkeypatch):
    """A run that fails before its manifest changes nothing; the next one takes up its parts."""
    rows = random_entries(14, files=3)
    inbox, state = tmp_path / "in", str(tmp_path / "state")
    inbox.mkdir()
    write(inbox, "f0", rows)
    before = as_set(run_incremental(spark, str(inbox), state, CONFIG))
    write(inbox, "f1", rows)

    def fails(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(incremental, "_next_manifest", fails)
    with pytest.raises(RuntimeError):
        run_incremental(spark, str(inbox), state, CONFIG)
    monkeypatch.undo()
    assert as_set(current_classes(spark, state)) == before
    monkeypatch.setattr(incremental, "fold_files", fails)  # nothing is read again
    found = as_set(run_incremental(spark, str(inbox), state, CONFIG))
    assert found == batch_of(spark, sorted(inbox.iterdir()))


def test_state_without_settings_is_refused(spark, tmp_path):
    inbox, state = tmp_path / "in", tmp_path / "state"
    inbox.mkdir()
    write(inbox, "f0", random_entries(7, files=1))
    run_incremental(spark, str(inbox), str(state), CONFIG)
    remove_path(spark, str(state / "settings"))
    with pytest.raises(ValueError, match="not the settings"):
        run_incremental(spark, str(inbox), str(state), CONFIG)
    with pytest.raises(ValueError, match="not the settings"):
        current_words(spark, str(state), CONFIG)


def test_settings_of_a_state_are_fixed(spark, tmp_path):
    inbox, state = tmp_path / "in", str(tmp_path / "state")
    inbox.mkdir()
    run_incremental(spark, str(inbox), state, CONFIG)
    with pytest.raises(ValueError, match="other settings"):
        run_incremental(spark, str(inbox), state, Config(False, 1962, 4, 2))
    with pytest.raises(ValueError, match="other settings"):
        current_words(spark, state, Config(False, 1962, 4, 2))


def test_bad_file_stops_the_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    gz(inbox / "x.gz", "a\t1900\t0\t0")
    with pytest.raises(Exception, match="bad entry"):
        run_incremental(spark, str(inbox), str(tmp_path / "state"), CONFIG)

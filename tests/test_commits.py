import uuid

import pytest

from conftest import rows
from hashwave.sources.commits import CommitLog, batch_id
from hashwave.sources.deltas import DeltaTable, FirstTable
from hashwave.sources.files import Folder

CHANGE = "k string, n bigint"


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "table")


@pytest.fixture
def table(spark, path):
    return DeltaTable(spark, path, CHANGE, ["k"], ["n"], fold_every=4)


def change(spark, n, k="a"):
    return spark.createDataFrame([(k, n)], CHANGE).coalesce(1)


def test_files_are_whole_and_never_replaced_by_new_ones(spark, path):
    folder = Folder(spark, path)
    assert folder.names() == {} and folder.read("x") is None
    assert folder.put_new("x", "one é") and not folder.put_new("x", "two")
    assert folder.read("x") == "one é"
    folder.replace("x", "three")
    folder.replace("y", "")
    assert (folder.read("x"), folder.read("y"), set(folder.names())) == ("three", "", {"x", "y"})
    folder.delete("x")
    assert folder.read("x") is None


@pytest.mark.parametrize("name, batch", [("q-12", ("q", 12)), (7, ("", 7)), ("late", ("late", 0)), ("a-b-3", ("a-b", 3)), ("1-x", ("1-x", 0))])
def test_names_of_batches(name, batch):
    assert batch_id(name) == batch


def test_the_log_stays_small_over_many_commits(spark, path):
    table = DeltaTable(spark, path, CHANGE, ["k"], ["n"])
    table._write = lambda *_: uuid.uuid4().hex
    table._rows, table._resolved = lambda chosen: None, lambda r: None
    sizes, read, pieces = [], [], []
    order = [n ^ 1 for n in range(200)]  # neighbours swapped: gaps that are filled
    for n in order:
        assert table.commit(None, f"query-{n}")
        assert not table.commit(None, f"query-{n}")
        log = CommitLog(spark, f"{path}/log")
        state = log.state()
        read.append(log.read_entries)
        sizes.append(len(str(state.done)))
        pieces.append(len(state.pieces[""]))
    assert state.done == {"query": [[0, 199]]}
    assert max(read[100:]) == max(read[:100]) <= 18 and max(sizes[100:]) <= max(sizes[:100]) + 3
    assert max(pieces[100:]) <= 50
    fold = CommitLog(spark, f"{path}/log").folder
    assert max(len(fold.read(n)) for n in fold.names()) < 4000


def test_pieces_fold_by_tiers_without_losing_any(spark, table):
    for n in range(22):
        assert table.commit(change(spark, 1 << n, "ab"[n % 2]), f"s-{n}")
        assert not table.commit(change(spark, 1), f"s-{n}")
    state = table.log.state()
    assert [p.tier for p in state.pieces[""]] == sorted((p.tier for p in state.pieces[""]), reverse=True)
    assert len(state.pieces[""]) < 8
    assert rows(table.read()) == [("a", sum(1 << n for n in range(0, 22, 2))), ("b", sum(1 << n for n in range(1, 22, 2)))]
    files = len(table._data.names())
    table.expire(3600)
    assert len(table._data.names()) == files
    before = rows(table.read())
    table.expire(-60)
    assert len(table._data.names()) == len({p.attempt for p in state.pieces[""]})
    assert rows(table.read()) == before and table.commit(change(spark, 5), "s-22") and not table.commit(change(spark, 5), "s-0")


def test_a_batch_that_lands_during_a_compaction_counts_once(spark, table):
    table.commit(change(spark, 1), "one")
    table.commit(change(spark, 2), "two")
    fold, rival = table.prepare_fold(), table.prepare_fold()
    table.commit(change(spark, 4), "three")
    assert fold.publish() and not rival.publish()
    assert len(table.log.state().pieces[""]) == 2 and rows(table.read()) == [("a", 7)]
    assert not table.commit(change(spark, 2), "two") and not table.commit(change(spark, 4), "three")
    table.compact()
    assert len(table.log.state().pieces[""]) == 1 and rows(table.read()) == [("a", 7)]


def test_a_lost_hint_only_makes_reading_longer(spark, table):
    for n in range(9):
        table.commit(change(spark, 1), f"s-{n}")
    table.log.folder.delete("newest")
    assert rows(table.read()) == [("a", 9)]
    table.expire(-60)
    assert table.commit(change(spark, 1), "s-9") and rows(table.read()) == [("a", 10)]


def test_writers_with_the_same_view_enter_one_after_the_other(spark, path):
    open_table = lambda: FirstTable(spark, path, CHANGE, ["k"], ["n"])
    one, two = open_table().prepare(change(spark, 1), "w-1"), open_table().prepare(change(spark, 2), "w-2")
    same = open_table().prepare(change(spark, 3), "w-1")
    assert open_table().log.state().last == -1
    assert two.publish() and one.publish() and not same.publish()
    assert rows(open_table().read()) == [("a", 2)]
    open_table().compact()
    open_table().commit(change(spark, 9))
    assert rows(open_table().read()) == [("a", 2)]


def test_an_empty_table(spark, table):
    assert table.read().count() == 0 and table.compact() and table.prepare_fold() is None
    table.expire(0)
    assert table.commit(change(spark, 1).limit(0), "empty") and table.read().count() == 0

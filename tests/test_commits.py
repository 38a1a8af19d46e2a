"""Commit files on each kind of file system, and what overlapping writers leave."""

import threading
import types

import pytest
from support import AS_OF
from test_store import figures, one

from gaugebook.plans import ingest as plan
from gaugebook.plans.ingest import ingest
from gaugebook.plans.reconcile import findings
from gaugebook.sources.commits import CONDITIONAL, CommitFiles, UnsafeStore
from gaugebook.sources.store import CommitConflict


class Objects(CommitFiles):
    """A store whose objects appear when an upload ends. `_put` is the library's own;
    only the file system under it is played."""

    def __init__(self, conditional=True, lose_answers=0):
        super().__init__(None, "objects://commits")
        self.files, self.lock = {}, threading.Lock()
        self.conditional, self.lose_answers = conditional, lose_answers

    def names(self):
        return list(self.files)

    def text(self, name):
        return self.files[name].decode()

    def _location(self, name=""):
        return name, self

    def getScheme(self):
        return "objects"

    def hasPathCapability(self, path, capability):
        return self.conditional and capability == CONDITIONAL

    def createFile(self, path):
        upload = types.SimpleNamespace(path=path, data=b"", must_be_absent=False)

        def must(key, value):
            upload.must_be_absent = key == CONDITIONAL and value
            return upload

        def write(data):
            upload.data += bytes(data)

        def close():
            with self.lock:
                if upload.must_be_absent and path in self.files:
                    raise OSError("412")
                self.files[path] = upload.data
                if self.lose_answers:
                    self.lose_answers -= 1
                    raise OSError("connection reset")

        upload.must, upload.build, upload.write, upload.close = must, lambda: upload, write, close
        return upload


def test_two_writers_on_an_object_store(spark, store, add_sites, monkeypatch):
    store.commits = Objects()
    add_sites(store, (1, "100"))
    inner, met = plan._write_all, threading.Barrier(2)
    first = threading.local()

    def together(*args):
        wrote = inner(*args)
        if not getattr(first, "met", False):
            first.met = True  # both have decided on the same head
            met.wait(120)
        return wrote

    monkeypatch.setattr(plan, "_write_all", together)
    epochs = []
    writers = [threading.Thread(target=lambda n=n: epochs.append(ingest(store, one(spark, n), as_of=AS_OF))) for n in (1, 2)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(epochs) == [2, 3]
    assert figures(store) == (("10.0000", 2), 2)
    assert findings(store).collect() == []


def test_a_lost_answer_is_not_a_conflict(store):
    store.commits = Objects(lose_answers=1)
    assert store.commit(store.head(), [], AS_OF) == 1
    with pytest.raises(CommitConflict):
        store.commit(type(store.head())(), [], AS_OF)
    assert store.head().epoch == 1


def test_a_store_without_a_safe_create_is_refused(spark, store, add_sites):
    store.commits = Objects(conditional=False)
    with pytest.raises(UnsafeStore):
        add_sites(store, (1, "100"))
    assert store.head().epoch == 0


def test_a_file_that_is_not_whole_is_passed_over(spark, store, add_sites):
    add_sites(store, (1, "100"))
    ingest(store, one(spark, 1), as_of=AS_OF)
    whole = store.commits.text("000000000002.json")
    store.commits.create("000000000003.json", whole[: len(whole) // 2])
    assert store.head().epoch == 2 and figures(store) == (("5.0000", 1), 1)
    assert ingest(store, one(spark, 2), as_of=AS_OF) == 4
    assert figures(store) == (("10.0000", 2), 2) and store.head().following == 5
    assert findings(store).collect() == []


def test_local_files_are_whole_and_created_once(store):
    won = []
    def write(n):
        if store.commits.create("000000000009.json", f"{n} " * 10_000):
            won.append(n)
    writers = [threading.Thread(target=write, args=(n,)) for n in range(8)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert len(won) == 1 and store.commits.text("000000000009.json") == f"{won[0]} " * 10_000
    assert [n for n in store.commits.names() if not n.startswith(".")] == ["000000000009.json"]


def test_hdfs_renames_a_finished_file(store, monkeypatch):
    """The way of HDFS, on the local file system, whose rename would replace the target."""
    path, fs = store.commits._location()
    proxy = types.SimpleNamespace(
        getScheme=lambda: "hdfs", create=fs.create, delete=fs.delete,
        rename=lambda a, b: not fs.exists(b) and fs.rename(a, b))
    real = store.commits._location
    monkeypatch.setattr(store.commits, "_location", lambda name="": (real(name)[0], proxy))
    assert store.commits.create("000000000001.json", "{}")
    assert not store.commits.create("000000000001.json", "[]")
    monkeypatch.undo()
    assert store.commits.names() == ["000000000001.json"] and store.commits.text("000000000001.json") == "{}"

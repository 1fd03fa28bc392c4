"""Listings by level against the walk of one process, and a log of changes over restarts."""

import os

import pytest

from loomdex.sources import listing
from loomdex.sources.workspace import read_workspaces, walk


@pytest.fixture
def roots(tmp_path):
    made = {
        "one/a.py": "a = 1\n", "one/.gitignore": "*.md\nbuild/\n!keep.md\n", "one/notes.md": "x", "one/keep.md": "x", "one/build/b.py": "x",
        "one/src/.ignore": "/gen\n*.rs\n!main.rs\n", "one/src/gen/c.py": "x", "one/src/main.rs": "fn main() {}", "one/src/lib.rs": "x", "one/src/deep/er/gen/d.py": "x",
        "one/src/deep/er/.gitignore": "!lib.rs\n", "one/src/deep/er/lib.rs": "x", "one/.git/info/exclude": "secret.py\n", "one/secret.py": "x", "one/big.txt": "y" * 5000,
        "one/pic.png": "x", "one/empty.py": "", "one/.hidden/e.py": "x", "two/é ü.py": "x", "two/sub/f.go": "package f",
    }
    made |= {f"two/many/{n}/m.py": f"m = {n}" for n in range(150)}
    for path, text in made.items():
        os.makedirs(os.path.dirname(tmp_path / path), exist_ok=True)
        (tmp_path / path).write_text(text)
    os.symlink(tmp_path / "two", tmp_path / "one" / "link")
    return [str(tmp_path / "one"), str(tmp_path / "two") + "/", str(tmp_path / "gone")]


def test_listing_equals_walk(spark, roots, tmp_path):
    found = listing.list_workspaces(spark, roots, str(tmp_path / "levels"), 4000)
    want = sorted((f"{r.rstrip('/').rsplit('/', 1)[-1]}/{p}", size, at) for r in roots for p, size, at in walk(r, 4000, exact=True))
    assert sorted(map(tuple, found.collect())) == want
    paths = {x[0] for x in want}
    assert {"one/keep.md", "one/src/main.rs", "one/src/deep/er/lib.rs", "one/src/deep/er/gen/d.py", "two/é ü.py"} <= paths
    assert not paths & {"one/notes.md", "one/build/b.py", "one/src/gen/c.py", "one/src/lib.rs", "one/secret.py", "one/big.txt", "one/link/sub/f.go"}
    read = listing.read_listed(found, roots, 4000)
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, read_workspaces(spark, roots, 4000).collect()))
    assert listing.list_workspaces(spark, [], str(tmp_path / "none")).count() == 0


def test_log_over_restarts(spark, roots, tmp_path):
    folder, sink = str(tmp_path / "log"), str(tmp_path / "seen")
    changed = lambda df: sorted((r["path"], r["kind"]) for r in df.collect())

    def streamed(log):
        """All that the stream has given out so far, over its restarts."""
        log.stream().writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(sink, format="parquet").awaitTermination()
        return spark.read.parquet(sink)

    log = listing.ListingLog(spark, roots, folder, most=50)
    first = changed(log.look())
    assert len(first) > 150 and {k for _, k in first} == {"created"}
    assert changed(streamed(log)) == first
    one = tmp_path / "one"
    (one / "a.py").write_text("a = 2222\n")
    os.remove(one / "keep.md")
    (one / "src" / "new.py").write_text("x")
    (one / "src" / ".ignore").write_text("main.rs\n")
    second = changed(listing.ListingLog(spark, roots, folder, most=50).look())
    want = [("one/a.py", "modified"), ("one/keep.md", "deleted"), ("one/src/gen/c.py", "created"), ("one/src/lib.rs", "created"), ("one/src/main.rs", "deleted"), ("one/src/new.py", "created")]
    assert second == want
    again = listing.ListingLog(spark, roots, folder)
    assert changed(streamed(again)) == sorted(first + want)
    assert changed(again.look()) == [] and again._done("listings") == [1, 2]
    os.remove(tmp_path / "log" / "changes" / f"{2:09d}" / "_SUCCESS")  # as if the look had ended before its changes were written
    (one / "a.py").write_text("a = 3\n")
    assert changed(listing.ListingLog(spark, roots, folder).look()) == [("one/a.py", "modified")]
    assert again._done("changes") == [0, 1, 2, 3] and changed(streamed(again)) == sorted([*first, *want, ("one/a.py", "modified")])

"""Listings, logs and reads are whole or fail."""

import os
import stat

import pytest

from sextant.session import shared_folder
from sextant.sources import files, gitlog


def _fake_git(folder, script):
    path = folder / "git"
    path.write_text(f"#!/bin/sh\n{script}\n")
    path.chmod(path.stat().st_mode | stat.S_IEXEC)
    return f"{folder}:{os.environ['PATH']}"


def test_git_that_dies_is_an_error(tmp_path, monkeypatch):
    script = 'case "$*" in *rev-parse*) exit 0;; esac\nprintf "half\\0"\nexit 137'
    monkeypatch.setenv("PATH", _fake_git(tmp_path, script))
    with pytest.raises(RuntimeError, match="137"):
        list(files._git_listing(str(tmp_path)))
    with pytest.raises(RuntimeError, match="137"):
        list(gitlog._stream_log(str(tmp_path), None))


def test_missing_roots_and_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files._git_listing(str(tmp_path / "nowhere"))
    with pytest.raises(OSError):
        list(files._walk_listing(str(tmp_path / "nowhere"), frozenset()))
    (tmp_path / "big.py").write_text("x" * 200_000)
    assert files._read_file(str(tmp_path / "gone.py"), None) == (0, "missing", None)
    assert files._read_file(str(tmp_path / "big.py"), 10)[1] == "too_large"
    assert files._read_file(str(tmp_path / "big.py"), None)[1] is None


def test_logs_have_no_hidden_limit(spark, tmp_path, git):
    git(tmp_path, "init", "-q")
    for n in range(12):
        git(tmp_path, "commit", "-q", "--allow-empty", "-m", f"step {n}")
    assert gitlog.parse_records(gitlog.read_log(spark, str(tmp_path))).count() == 12
    assert gitlog.parse_records(gitlog.read_log(spark, str(tmp_path), 5)).count() == 5
    assert gitlog.read_log(spark, str(tmp_path / "none")).count() == 0


def test_a_cluster_names_its_shared_folder():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        shared_folder(Session())

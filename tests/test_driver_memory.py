"""What the data source's planning and commits leave in the processes that Spark keeps beside the driver."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path
from unittest import mock

from catalith.sources import toml_files


def test_no_pandas():
    """A process a step; pandas took 25 MB in each of them."""
    code = "import sys, catalith.sources.toml_files; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], check=False, cwd=Path(__file__).parent.parent).returncode == 0


def test_planning_and_commit_give_back(tmp_path):
    (tmp_path / "a.toml").write_text("x = 1\n")
    given = mock.Mock()
    with mock.patch.object(toml_files.pa, "default_memory_pool", lambda: given):
        assert len(toml_files.Reader({"path": str(tmp_path)}, "text", toml_files.TEXT).partitions()) == 1
        assert given.release_unused.call_count == 1
        toml_files.Writer(str(tmp_path), toml_files.T.StructType().add("stem", "string").add("content", "string"), False).commit([])
    assert given.release_unused.call_count > 1
    assert [f.stem for f in toml_files.listing(str(tmp_path))] == ["a"]

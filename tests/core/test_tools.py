import logging
import subprocess
import sys

import pytest

from cinderlog.tools import logs, workspace


def test_errors_go_to_stderr_and_all_else_to_stdout(capsys, tmp_path):
    root = logging.getLogger()
    before = list(root.handlers), root.level
    try:
        logs.set_up(logging.INFO, str(tmp_path / "l.txt"), colour=False)
        logs.set_up(logging.INFO, str(tmp_path / "l.txt"), colour=False)
        root.debug("quiet")
        root.info("told: so")
        root.error("wrong")
        out, err = capsys.readouterr()
        assert out.count("told: so") == 1 and "wrong" not in out and err.count("wrong") == 1 and "quiet" not in out
        assert [line.split("] ")[1] for line in (tmp_path / "l.txt").read_text().splitlines()] == ["INFO root: told: so", "ERROR root: wrong"]
        logs.set_up(colour=True)
        root.warning("bright")
        assert "\x1b[95m" in capsys.readouterr().out
    finally:
        for h in list(root.handlers):
            root.removeHandler(h)
            h.close()
        for h in before[0]:
            root.addHandler(h)
        root.setLevel(before[1])


@pytest.mark.parametrize("kind", workspace.KINDS)
def test_a_new_component_can_be_imported(kind, tmp_path):
    workspace.main(["create", "--kind", kind, "--name", "My rule", "--dir", str(tmp_path)])
    assert (tmp_path / "config.yaml").exists() and (tmp_path / "tests" / "test_my_rule.py").exists()
    run = subprocess.run([sys.executable, "-c", "import my_rule; print(my_rule.__all__)"], cwd=tmp_path, env={"PYTHONPATH": ":".join([str(tmp_path), *sys.path])}, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    with pytest.raises(FileExistsError):
        workspace.create(kind, "my_rule", str(tmp_path))
    for bad in (("else", "x"), (kind, "1x"), (kind, "")):
        with pytest.raises(ValueError):
            workspace.create(*bad, str(tmp_path))

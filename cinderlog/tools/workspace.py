"""New components: `python -m cinderlog.tools.workspace create --kind detector --name my_rule --dir .` writes a package with a
component to fill in, a configuration and a test. Nothing that is there is overwritten."""

from __future__ import annotations

import argparse
import re
from pathlib import Path

KINDS = ("parser", "detector")

_PARSER = '''"""A parser of your own."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse(logs: DataFrame) -> DataFrame:
    "logs (ord, logID, log) with EventID, template, variables and logFormatVariables."
    none = F.array().cast("array<string>")
    return logs.withColumns({"EventID": F.lit(0), "template": F.lit(""), "variables": none, "logFormatVariables": F.create_map().cast("map<string,string>")})
'''
_DETECTOR = '''"""A detector of your own."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.operators.detectors import Detector


class CLASS(Detector):
    kind = "NAME"

    def learn(self, values: DataFrame) -> DataFrame:
        "What is kept of training's (event, name, value)."
        return values.distinct()

    def unusual(self, values: DataFrame) -> DataFrame:
        "Which of these different (event, name, value) alert, with a message."
        return values.join(self.model, ["event", "name", "value"], "left_anti").withColumn("message", F.lit("new"))
'''


def _files(kind: str, name: str) -> dict[str, str]:
    made = "".join(w.capitalize() for w in name.split("_"))
    entry = "parse" if kind == "parser" else made
    return {
        f"{name}/__init__.py": f"from {name}.{kind} import {entry}\n\n__all__ = [\"{entry}\"]\n",
        f"{name}/{kind}.py": {"parser": _PARSER, "detector": _DETECTOR}[kind].replace("CLASS", made).replace("NAME", name),
        "config.yaml": f"{kind}s:\n  {made}:\n    method_type: {name}\n    auto_config: false\n    params: {{}}\n",
        f"tests/test_{name}.py": f"import {name}\n\n\ndef test_{name}_can_be_imported():\n    assert {name}.{entry}\n",
        "README.md": f"# {made}\n\nA {kind}. Fill in `{name}/{kind}.py`; `config.yaml` names its parameters.\n",
    }


def create(kind: str, name: str, folder: str = ".") -> list[Path]:
    """The files written. ValueError for another kind, or a name that is no package's; FileExistsError if one is there."""
    if kind not in KINDS:
        raise ValueError(f"kind: {' or '.join(KINDS)}")
    name = re.sub(r"[\s-]+", "_", name.strip()).lower()
    if not re.fullmatch(r"[a-z][a-z0-9_]*", name):
        raise ValueError(f"name: {name}")
    files = {Path(folder, path): text for path, text in _files(kind, name).items()}
    if there := [str(p) for p in files if p.exists()]:
        raise FileExistsError(", ".join(there))
    for path, text in files.items():
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    return list(files)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="workspace", description="New components for the library.")
    make = parser.add_subparsers(dest="command", required=True).add_parser("create")
    make.add_argument("--kind", choices=KINDS, required=True)
    make.add_argument("--name", required=True)
    make.add_argument("--dir", default=".")
    given = parser.parse_args(argv)
    for path in create(given.kind, given.name, given.dir):
        print(path)


if __name__ == "__main__":
    main()

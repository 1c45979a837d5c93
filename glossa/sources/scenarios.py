"""Test cases in Markdown: steps of input files with the signatures expected of them, as rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

STEPS = (
    "file string, case string, ord int, step int, ruby_version string, rails_version string, synthetic boolean, known_issue boolean, rbs_inputs array<string>, rbi_inputs array<string>, "
    "project array<struct<path:string,content:string>>, ruby string, expected string, error string"
)
#: A heading, a path in backticks, or a fenced block with its language.
TOKEN = re.compile(r"^(?:(?P<level>\#{1,3})[ ](?P<heading>[^\n]*)|`(?P<path>[^`\s]+)`:?[ ]*|```(?P<language>\w+)[ ]*\n(?P<body>.*?)^[ ]*```[ ]*)$", re.M | re.S)
#: Blocks that are project files wherever they stand. Fixed values.
FIXED = {"routes": "config/routes.rb", "schema": "db/schema.rb"}


def _config(text: str) -> dict:
    found = dict(re.findall(r"""^(\w+):\s*["']?([^"'\n]*?)["']?\s*$""", text, re.M))
    yes = lambda k: {"true": True, "false": False}.get(found.get(k, ""))
    return {"ruby_version": found.get("ruby_version"), "rails_version": found.get("rails_version"), "synthetic": yes("include_synthetic_dsl_methods"), "known_issue": yes("known_issue")}


class _Step:
    def __init__(self):
        self.rbs, self.rbi, self.project, self.ruby, self.expected, self.path = [], [], [], None, None, None

    def block(self, language: str, body: str, result: bool) -> None:
        path, self.path = (self.path, None) if language in ("ruby", "rb", "sql") else (None, self.path)
        if path:
            self.project.append({"path": path, "content": body})
        elif language in ("ruby", "rb"):
            # of several files without a path the last is the current one
            if self.ruby is not None:
                self.project.append({"path": f"app/models/_project_{len(self.project)}.rb", "content": self.ruby})
            self.ruby = body
        elif language == "rbs" and result:
            self.expected = body
        elif language in ("rbs", "rbi"):
            getattr(self, language).append(body)
        elif language in FIXED:
            self.project.append({"path": FIXED[language], "content": body})

    def empty(self) -> bool:
        return not (self.rbs or self.rbi or self.project or self.ruby is not None or self.expected is not None)

    def error(self) -> str | None:
        return "no current file" if self.ruby is None else "no result" if self.expected is None else None


def read(content: str) -> list[dict]:
    """The steps of a file's cases. A step is a whole state, not a difference; what can't be run carries an error."""
    out: list[dict] = []
    title, case, config, step, result, k, n = "", None, {}, _Step(), False, 0, 0

    def close(whole: bool = True) -> None:
        """The step ends. One that has only inputs so far goes on, unless its case ends (whole)."""
        nonlocal step, k
        if not whole and step.ruby is None and step.expected is None:
            return
        if not step.empty():
            out.append({"case": case or title, "ord": n, "step": k, **_config(""), **config, "rbs_inputs": step.rbs, "rbi_inputs": step.rbi, "project": step.project, "ruby": step.ruby, "expected": step.expected, "error": step.error()})
            k += 1
        step = _Step()

    for m in TOKEN.finditer(content):
        if m["language"]:
            if m["language"] == "yaml":
                config = _config(m["body"])
            else:
                step.block(m["language"], m["body"], result)
        elif m["path"]:
            step.path = step.path if result else m["path"]
        elif m["level"] == "#":
            title = title or m["heading"].strip()
        elif m["level"] == "##":
            close()
            if case is not None and not k:
                out.append({"case": case, "ord": n, "step": 0, **_config(""), **config, "rbs_inputs": [], "rbi_inputs": [], "project": [], "ruby": None, "expected": None, "error": "no steps"})
            n += case is not None
            case, config, result, k = m["heading"].strip(), {}, False, 0
        elif m["heading"].startswith("file:"):
            step.path = m["heading"][5:].strip()
        elif m["heading"].strip() == "result":
            result = True
        else:
            close(whole=False)
            step.path, result = None, False
    close()
    return out


def steps(texts: DataFrame) -> DataFrame:
    """STEPS of scenario files (file, content)."""
    names = [c.strip().split(" ", 1)[0] for c in re.split(r",\s(?=\w+ \w)", STEPS)]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{**r, "file": f} for f, content in zip(batch["file"], batch["content"]) for r in read(content or "")]
            yield pd.DataFrame(rows, columns=names).astype({"ord": "int32", "step": "int32"})

    return texts.select("file", "content").mapInPandas(each, STEPS)

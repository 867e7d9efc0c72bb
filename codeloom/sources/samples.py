"""A small source project for trials: packages, tests, a notebook of notes, and files that a scan leaves out."""

from __future__ import annotations

import os

MODULE = '''"""Module {k} of the sample."""
import os
from sample.module_{before} import Shape{before} as Base


class Shape{k}(Base):
    def area(self, width, height={k}):
        if width and height:
            return width * height
        return 0


def build_{k}(names, *more, deep=False):
    return [Shape{k}() for n in names if n]
'''


def write_project(root: str, modules: int = 3) -> list[str]:
    """Write the project below ``root``; the paths of all its files, sorted."""
    files = {"README.md": "# Sample\n", "sample/__init__.py": "", "tests/test_sample.py": "def test_nothing():\n    assert True\n"}
    files |= {f"sample/module_{k}.py": MODULE.format(k=k, before=max(0, k - 1)) for k in range(modules)}
    files |= {"sample/broken.py": "def (\n", "build/out.py": "x = 1\n", "sample/__pycache__/module_0.pyc": "x", ".git/config": "x"}
    for name, text in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    return sorted(os.path.join(root, n) for n in files)

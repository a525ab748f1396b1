import pathlib
import re

ROOT = pathlib.Path(__file__).parent.parent


def test_nothing_else_imports_the_subpackage():
    for f in (ROOT / "loomgraph").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert not re.search(r"loomgraph\.llm", f.read_text()), f

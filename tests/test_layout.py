import re
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_outside_the_subpackage_imports_it():
    for f in (ROOT / "quillgraph").rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"(?:from|import)\s+[\w.]*\bllm\b", f.read_text()), f


def test_no_cut_of_lineage_in_one_place_and_no_cross_join():
    for f in (ROOT / "quillgraph").rglob("*.py"):
        text = f.read_text()
        assert ".localCheckpoint(" not in text and ".crossJoin(" not in text, f

from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]
README = (ROOT / "README.md").read_text()


def test_readme_names_what_is_there_and_what_is_not():
    for heading in ("## What is there", "## What is missing", "## Departures", "## Check tool"):
        assert heading in README


def test_every_checked_query_has_figures():
    figures = README.partition("## Check tool")[2]
    for n in range(1, 11):
        names = [q for q in __spark_entry__.queries() if q.startswith(f"p{n}_")]
        if names:
            assert any(q in figures for q in names)


def test_operators_are_listed():
    table = (ROOT / "OPERATORS.md").read_text()
    for letter, last in {"S": 27, "K": 18, "F": 24, "J": 21, "A": 31, "W": 8, "O": 6, "U": 6, "R": 7, "X": 26, "P": 22, "I": 10}.items():
        assert all(f"| {letter}{k} |" in table for k in range(1, last + 1))


def test_empty_packages_say_so():
    for name in ("sources", "streaming"):
        folder = ROOT / "stationweave" / name
        if [p.name for p in folder.glob("*.py")] == ["__init__.py"]:
            assert "Empty" in (folder / "__init__.py").read_text()

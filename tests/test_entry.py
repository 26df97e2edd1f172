import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_agree():
    from pathlight import catalogue

    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES) and catalogue.FLAGSHIP in catalogue.QUERIES


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_command_line():
    out = subprocess.run([sys.executable, "-m", "pathlight.cli", "version"], cwd=ROOT, capture_output=True, text=True, timeout=60)
    assert out.stdout.strip() == "0.1.0"
    from pathlight import cli

    assert cli.main(["scan", "x", "--max-anonymous", "2"]) == 2

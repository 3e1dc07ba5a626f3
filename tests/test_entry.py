"""The guard around the optional subpackage."""

import sys

import pytest

import __spark_entry__


def test_an_absent_module_is_none():
    assert __spark_entry__._optional("tessera.no_such_part") is None
    assert __spark_entry__._optional("no_such_package.part") is None


def test_a_fault_inside_a_module_is_not_hidden(tmp_path, monkeypatch):
    (tmp_path / "faulty_part.py").write_text("import a_module_that_is_nowhere")
    (tmp_path / "broken_part.py").write_text("from json import nothing_of_this_name")
    monkeypatch.setattr(sys, "path", [str(tmp_path), *sys.path])
    with pytest.raises(ModuleNotFoundError, match="a_module_that_is_nowhere"):
        __spark_entry__._optional("faulty_part")
    with pytest.raises(ImportError, match="nothing_of_this_name"):
        __spark_entry__._optional("broken_part")


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

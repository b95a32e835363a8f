import pytest

from babelframe.config import REFERENCE, load_dialect
from babelframe.registry import Registry

from .fixtures import tables


def test_states_and_history(spark, tmp_path):
    r, d = Registry(tmp_path / "d"), load_dialect("postgres_clone")
    assert r.names() == []
    r.save(d)
    assert r.names() == ["postgres_clone"] and r.load("postgres_clone") == d and r.state("postgres_clone") == "draft" and r.history("postgres_clone") == []
    run = r.validate("postgres_clone", spark, tables(spark), ["SELECT name FROM employees WHERE salary >= 80000 ORDER BY name"])
    assert (run["total"], run["passed"], run["failed"]) == (1, 1, []) and r.names("validated") == ["postgres_clone"]
    bad = "SELECT no_such_column FROM employees"
    assert r.validate("postgres_clone", spark, tables(spark), [bad])["failed"] == [bad]
    assert r.state("postgres_clone") == "needs_review" and len(r.history("postgres_clone")) == 2
    r.validate("postgres_clone", spark, tables(spark), [])
    assert r.state("postgres_clone") == "needs_review"
    r.save(d)
    assert r.state("postgres_clone") == "draft" and len(r.history("postgres_clone")) == 3


def test_refusals(tmp_path):
    r = Registry(tmp_path)
    with pytest.raises(ValueError):
        r.save(REFERENCE)
    with pytest.raises(KeyError):
        r.set_state("none", "draft")
    r.save(load_dialect("postgres_clone"))
    with pytest.raises(ValueError):
        r.set_state("postgres_clone", "splendid")

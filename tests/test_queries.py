import pytest

from ledgerloom.plans import registry
from tests.conftest import DATA
from tests.oracle import connect, same

SF = str(DATA / "sf0.001")


@pytest.fixture(scope="module")
def tables():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, tables, name):
    same(registry.QUERIES[name](spark, SF), tables, registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_controls_score_as_they_must(spark):
    rows = {(r["control"], r["dimension"]): r["f1"] for r in registry.QUERIES["score_task"](spark, SF).collect()}
    assert rows["perfect", "value"] == 1.0 and rows["perfect", "class"] == 1.0
    assert rows["empty", "value"] == 0.0 and rows["bare_numbers", "value"] == 0.0
    assert rows["wrong_document", "value"] < 0.01


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_registry_stands_without_the_optional_subpackage(monkeypatch):
    import importlib

    import __spark_entry__ as entry

    real = importlib.import_module

    def absent(name, *a):
        if name in ("ledgerloom.llm.registry", "corpus_pipeline"):
            raise ModuleNotFoundError(name="ledgerloom.llm" if "llm" in name else name)
        return real(name, *a)

    monkeypatch.setattr(entry.importlib, "import_module", absent)
    assert set(entry.queries()) == set(registry.QUERIES)

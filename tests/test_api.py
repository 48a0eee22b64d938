import os
import subprocess
import sys

import pytest

from siftline.api import Engine, union_repositories


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    (root / "src").mkdir()
    (root / "src/main.py").write_text("import os\n\ndef load_data(path):\n    return open(path).read()\n\nclass Store:\n    def get(self):\n        return load_data('x')  # TODO later\n")
    (root / "util.py").write_text("from src.main import load_data\n\ndef store_data():\n    load_data('y')\n")
    e = Engine.of_tree(spark, str(root))
    e.corpus = e.corpus.cache()
    return e


def test_searches(engine):
    assert engine.count("load_data").first().files == 2
    ranked = engine.ranked("load_data", context=0).collect()
    assert len(ranked) == 4 and ranked[0].score >= ranked[-1].score
    assert engine.boolean("load_data AND NOT class").count() == 2
    assert engine.boolean("NOT class").count() == 0
    assert {r.word for r in engine.fuzzy_words("lod_data", ("levenshtein", "damerau_levenshtein")).collect()} == {"load_data"}
    assert engine.fuzzy("stroe", 2).count() >= 1
    assert engine.suggest("stor").first().word == "Store"
    assert engine.concept("file").count() >= 1
    assert engine.semantic("load data", 0.0).count() == 2
    assert engine.syntax("load_data", func="get", context=0).count() == 1
    assert engine.multi(["open", "class"], "AND").count() == 2
    assert engine.phonetic("Stare").where("word = 'Store'").count() == 1


def test_structure(engine):
    e, r = engine.knowledge_graph()
    assert {x.name for x in e.collect()} >= {"load_data", "Store", "get", "store_data"}
    assert r.where("relation_type = 'calls'").count() == 2
    assert engine.definition("load_data").first().line_no == 3
    assert engine.references("load_data").count() == 4
    assert engine.diagnostics().first().kind == "TODO"
    assert engine.dependencies().count() == 2
    assert engine.filtered(globs=["src/**"]).count("load_data").first().files == 1
    both = union_repositories({"a": engine, "b": engine})
    assert both.corpus.groupBy("repo").count().count() == 2


def test_command_line(engine, tmp_path):
    (tmp_path / "a.py").write_text("def f():\n    return 'needle'\n")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = subprocess.run([sys.executable, "-m", "siftline", "find", str(tmp_path), "needle"], cwd=root, capture_output=True, text=True, timeout=200)
    assert "     2 |     return 'needle'" in run.stdout

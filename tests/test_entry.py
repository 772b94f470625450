"""Every span query has SQL with the same columns, and the flagship runs."""

import subprocess
import sys

import __spark_entry__ as entry
from spanloom.plans import registry


def test_flagship(spark):
    out = entry.entry(spark)
    assert set(out.columns) == {"label", "correct", "partial", "incorrect", "missed", "spurious", "precision", "recall", "f1", "accuracy"}
    total = out.filter("label is null").first()
    assert (total.correct, total.partial, total.incorrect, total.missed, total.spurious) == (33033, 11576, 1298, 9267, 8654)


def test_every_span_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_entry_works_without_the_corpus_operators(tmp_path):
    code = "import sys; sys.modules['spanloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 80 and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True)

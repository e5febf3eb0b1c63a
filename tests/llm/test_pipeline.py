"""The pipeline's stages against brute force, and the registration guard."""
import sys
from collections import Counter

import __spark_entry__ as entry
import corpus_pipeline
from ledgerlens.llm import mixing, quality
from ledgerlens.llm.common import landed
from llm_fixtures import sf  # noqa: F401
from test_operators import LOWER, WORD, check_packing, plain_groups  # noqa: F401


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    rows = docs.collect()

    docs = landed(stages["quality rules"](spark, docs, sf), "t0")
    good = {r.doc_id for r in quality.quality(spark.read.parquet(f"{sf}/documents.parquet")).filter("kept").collect()}
    rows = [r for r in rows if r.doc_id in good]
    assert docs.columns == columns and Counter(docs.collect()) == Counter(rows)

    docs = landed(stages["exact dedup"](spark, docs, sf), "t1")
    last = {}
    for r in rows:
        t = (r.text or "").translate(LOWER)
        last[t] = max(last.get(t, r.doc_id), r.doc_id)
    rows = [r for r in rows if r.doc_id in set(last.values())]
    assert docs.columns == columns and Counter(docs.collect()) == Counter(rows)

    docs = landed(stages["n-gram Jaccard join"](spark, docs, sf), "t2")
    groups = plain_groups([(r.doc_id, r.text) for r in rows], 5, 80)
    rows = [r for r, (n, c) in zip(rows, groups) if not n or c == r.doc_id]
    assert docs.columns == columns and Counter(docs.collect()) == Counter(rows)

    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    docs = landed(stages["source mix"](spark, docs, sf), "t3")
    assert docs.columns == columns
    assert Counter(r.doc_id for r in docs.collect()) == +Counter(copies)

    packed = stages["best-fit packing"](spark, docs, sf)
    check_packing(packed.collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "n-gram Jaccard join", "source mix", "best-fit packing"]
    names = entry.queries()
    assert "pipeline" in names
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))


def test_nothing_else_imports_the_subpackage():
    import pathlib
    root = pathlib.Path(entry.__file__).parent
    for p in (root / "ledgerlens").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text().lower().replace("_llm_", ""), p
    assert "ledgerlens.llm.queries" in sys.modules

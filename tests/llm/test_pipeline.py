"""The pipeline against plain versions of its stages, and its registration."""

import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from newsgrist.llm.oracle import ORACLE
from newsgrist.llm.queries import QUERIES

from test_decontam import expected as leaking
from test_minhash import classes

ROOT = Path(__file__).resolve().parents[2]


def test_stages_one_by_one(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "near_dedup", "decontaminate", "encode"]

    scored = {r.doc_id: r.predicted for r in QUERIES["op2_quality"](spark, small).collect()}
    first = stages["quality"](spark, docs, small)
    assert first.columns == columns and {r.doc_id for r in first.collect()} == {i for i, p in scored.items() if p}

    rows = sorted((r.doc_id, r.text) for r in first.collect())
    seen, goal = set(), []
    for i, t in rows:
        plain = " ".join(t.replace("\x0b", " ").split())
        if plain not in seen:
            seen.add(plain)
            goal.append((i, t))
    second = stages["exact_dedup"](spark, first, small)
    assert second.columns == columns and sorted((r.doc_id, r.text) for r in second.collect()) == goal

    roots = classes(goal)
    least = {}
    for (i, _), root in zip(goal, roots):
        least[root] = min(i, least.get(root, i))
    goal = [(i, t) for (i, t), root in zip(goal, roots) if least[root] == i]
    third = stages["near_dedup"](spark, second, small)
    assert third.columns == columns and sorted((r.doc_id, r.text) for r in third.collect()) == goal

    out = {d for d, _ in leaking(goal, items)}
    goal = [(i, t) for i, t in goal if i not in out]
    fourth = stages["decontaminate"](spark, third, small)
    assert fourth.columns == columns and sorted((r.doc_id, r.text) for r in fourth.collect()) == goal

    last = stages["encode"](spark, fourth, small)
    assert sorted(r.doc_id for r in last.collect()) == [i for i, _ in goal]


def test_run_is_all_stages(spark, small):
    got = corpus_pipeline.run(spark, small)
    assert got.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    assert 0 < got.count() <= spark.read.parquet(f"{small}/documents.parquet").count()


def test_each_operator_has_one_query():
    numbers = [int(name[2:].split("_")[0]) for name in QUERIES]
    assert sorted(numbers) == list(range(1, 11)) and set(ORACLE) <= set(QUERIES)


def test_entry_without_the_package(tmp_path):
    """Only the absence of the package is taken; other import errors are shown."""
    for name in ("newsgrist", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(ROOT / name)
    (tmp_path / "newsgrist").unlink()
    (tmp_path / "newsgrist").mkdir()
    for part in (ROOT / "newsgrist").iterdir():
        if part.name != "llm":
            (tmp_path / "newsgrist" / part.name).symlink_to(part)
    # A copy, so that its own folder comes first on the path.
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; n = list(e.queries()); print(len(n), any(x.startswith('op') and x[2].isdigit() for x in n), 'pipeline' in n)"
    ran = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""})
    assert ran.returncode == 0, ran.stderr
    assert ran.stdout.split()[1:] == ["False", "False"] and int(ran.stdout.split()[0]) > 50

import importlib
import random
import sys

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from check import TABLES, compare
from quire.llm.queries import CHECKS, QUERIES
from quire.llm.store import written
from tests.llm.conftest import ODD, SCHEMA, make_text, split
from tests.llm.test_neardup import brute_force as near_groups
from tests.llm.test_substring import brute_force as repeats

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(CHECKS))
def test_query_equals_its_sql(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    note, _, ok = compare(spark, con, key, QUERIES[key], CHECKS[key], SF)
    assert ok, note


def test_names_and_registration():
    assert {int(k[2:].split("_")[0]) for k in QUERIES if k != "pipeline"} == set(range(1, 14))
    assert set(QUERIES) <= set(entry.queries()) and "pipeline" in QUERIES and "pipeline" not in CHECKS


def test_entry_works_without_the_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("quire.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name == "quire.llm":
                raise ModuleNotFoundError("No module named 'quire.llm'", name=name)

    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    alone = importlib.import_module("__spark_entry__")
    assert "pipeline" not in alone.queries() and "font_stats" in alone.queries()


@pytest.fixture(scope="module")
def planted(spark, table, tmp_path_factory):
    rng = random.Random(6)
    rows, labels = [], []
    for d in range(150):
        words = make_text(rng, rng.randint(30, 200), 4000).split()
        if d % 5 == 0:
            words.insert(3, rng.choice(["idiot", "moron"]))
        rows.append((d, " ".join(words), "en", "src0", 0))
        labels.append((d, int(d % 5 == 0), 1))
    item = make_text(rng, 40, 4000)
    rows.append((500, make_text(rng, 50, 4000) + " " + item + " " + make_text(rng, 50, 4000), "en", "src0", 0))
    rows.append((501, rows[1][1], "en", "src0", 0))
    near = max((r[1] for r in rows[:150] if r[0] % 5), key=len).split()
    near[5] = "changed"
    rows.append((502, " ".join(near) + " and a tail", "en", "src0", 0))
    rows.append((503, make_text(rng, 90, 4000) + " " + rows[3][1], "en", "src0", 0))
    rows.append((504, make_text(rng, 30, 4000) + " 1d10t " + make_text(rng, 30, 4000), "en", "src0", 0))
    folder = tmp_path_factory.mktemp("sf")
    table(rows + ODD).write.parquet(f"{folder}/documents.parquet")
    table(labels, "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    table([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows + ODD


def test_stages_take_effect_on_what_was_kept(spark, planted):
    folder, rows = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, [tuple(r) for r in docs.collect()]
    ids = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, folder), "stage")
        assert docs.columns == columns
        after = [tuple(r) for r in docs.collect()]
        ids[name] = [r[0] for r in after]
        if name == "minhash near-dedup":
            groups = near_groups(before)
            assert sorted(str(r[0]) for r in after) == sorted(str(d) for d, (_, c) in groups.items() if d is None or d == c)
        if name == "substring dedup":
            expected = repeats(before, 20)
            assert sorted((str(r[0]), " ".join(split(r[1]))) for r in after) == sorted(
                (str(k[0]), " ".join(v[3])) for k, v in expected.items()
            )
        before = after
    toxic = set(range(0, 150, 5)) | {504}
    assert not toxic & set(ids["toxicity"]) and len(ids["toxicity"]) == len(rows) - len(toxic)
    assert not {501, 502} & set(ids["minhash near-dedup"]) and 503 in ids["substring dedup"]
    assert set(ids["substring dedup"]) - set(ids["benchmark decontamination"]) == {500}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in packed.collect()} == set(ids["benchmark decontamination"])


def test_run_equals_its_stages_and_empty_tables(spark, planted, table, tmp_path):
    folder, _ = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, folder), "stage")
    by_doc = lambda df: sorted((str(r[0]), r[1]) for r in df.groupBy("doc_id").sum("length").collect())
    assert by_doc(corpus_pipeline.run(spark, folder)) == by_doc(corpus_pipeline.STAGES[-1][1](spark, docs, folder))
    table([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    table([], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    table([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

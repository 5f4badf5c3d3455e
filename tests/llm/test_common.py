import pytest

from flowloom.llm.common import with_row
from flowloom.llm.exact import drop_exact_duplicates


@pytest.fixture
def splits(spark):
    """Sets how many tasks a scan of small files is split into, as a change of cores would."""
    name = "spark.sql.files.minPartitionNum"
    yield lambda n: spark.conf.set(name, str(n))
    spark.conf.unset(name)


def test_row_numbers_do_not_follow_splits(docs, splits):
    path_scan = docs([(i, f"t{i}") for i in range(40)], 5)
    spark, files = path_scan.sparkSession, path_scan.inputFiles()
    seen = []
    for n in (1, 20):
        splits(n)
        table = with_row(spark.read.parquet(*files), "n")
        seen.append((table.rdd.getNumPartitions(), {r.doc_id: r.n for r in table.select("doc_id", "n").collect()}))
    assert seen[0][0] != seen[1][0]
    assert seen[0][1] == seen[1][1] and len(set(seen[0][1].values())) == 40


def test_other_inputs_are_stored_first(spark, docs):
    rows = [(i % 30, f"t{i % 7}") for i in range(60)]
    shuffled = docs(rows).distinct().unionByName(docs(rows).distinct())
    want = {t: min(i for i, u in rows if u == t) for _, t in rows}
    assert sorted((r.text, r.doc_id) for r in drop_exact_duplicates(shuffled).collect()) == sorted(want.items())

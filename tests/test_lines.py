import random

import pytest

from abridge.sources import readers


@pytest.fixture
def small_splits(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def test_a_matrix_is_read_by_many_tasks(spark, tmp_path, small_splits):
    rng, n = random.Random(1), 300
    want = {(i, j): round(rng.random(), 3) for i in range(n) for j in range(n)}
    lines = [", ".join(str(want[i, j]) for j in range(n)) + (";" if i % 2 else "") for i in range(n)]
    lines.insert(40, "")
    lines[100] = lines[100].rstrip(";") + "; " + lines.pop(101)  # two rows on one line
    (tmp_path / "m.txt").write_text("\n".join(lines) + "\n")
    assert readers.lines_of(spark, str(tmp_path / "m.txt")).rdd.getNumPartitions() > 10
    got = readers.similarity_matrix(spark, str(tmp_path / "m.txt"), "s", 2).collect()
    assert {(r.i, r.j): r.s for r in got} == want and len(got) == n * n


def test_lines_have_their_numbers(spark, tmp_path, small_splits):
    rng = random.Random(2)
    lines = ["" if k % 50 == 7 else f"word{k} " + "x " * rng.randrange(9) + f"last{k % 400}" for k in range(20_000)]
    (tmp_path / "a").write_text("\n".join(lines))
    rows = readers.numbered(readers.lines_of(spark, str(tmp_path / "a"))).collect()
    assert len(rows) == len(lines) and all(lines[r["at"]] == r["value"] for r in rows)
    sents = readers.sentence_lines(spark, str(tmp_path / "a")).collect()
    assert {r.sent_idx: r.text for r in sents} == dict(enumerate(s.strip() for s in lines if s))
    clusters = {r.word: r.cluster_id for r in readers.word_clusters(spark, str(tmp_path / "a")).collect()}
    assert clusters["word19999"] == "cluster-19999" and clusters["last3"] == "cluster-3" and clusters["x"] == f"cluster-{next(k for k, s in enumerate(lines) if ' x' in s)}"


def test_clusterings_and_several_files(spark, tmp_path, small_splits):
    (tmp_path / "k").write_text("\n".join(str(k % 7 - 1) for k in range(30_000)) + "\n")
    got = readers.clustering_file(spark, str(tmp_path / "k")).collect()
    assert {r.sent_idx: r.k for r in got} == {k: max(0, k % 7 - 1) for k in range(30_000)}
    (tmp_path / "d").mkdir()
    for f in range(3):
        (tmp_path / "d" / f"f{f}").write_text("\n".join(f"{f}:{k}" for k in range(4000)))
    rows = readers.numbered(readers.lines_of(spark, str(tmp_path / "d"))).collect()
    assert len(rows) == 12_000 and all(int(r.value.split(":")[1]) == r["at"] for r in rows)


def test_bad_and_empty_matrices(spark, tmp_path):
    (tmp_path / "m").write_text("1, 2;\n3;\n")
    with pytest.raises(Exception, match="not square"):
        readers.similarity_matrix(spark, str(tmp_path / "m")).collect()
    (tmp_path / "e").write_text("\n ;\n")
    assert readers.similarity_matrix(spark, str(tmp_path / "e")).collect() == []
    (tmp_path / "w").write_text("0.5, 0.25; 1 2\n9 9\n")
    assert [(r.step, r.matrix_id, r.w) for r in readers.matrix_weights(spark, str(tmp_path / "w"), 2).orderBy("step", "matrix_id").collect()] == [(0, 0, 0.5), (0, 1, 0.25), (1, 0, 1.0), (1, 1, 2.0)]

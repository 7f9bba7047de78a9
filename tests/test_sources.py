import gzip
import os
import zipfile

import numpy as np
import pytest

from gridlace.operators import graph
from gridlace.sources import exports, shared, synthetic
from gridlace.sources import points as sources

TEXT = "x_location,y_location,feature_name,qv,extra\n1.5,2,A,20,z\n2,3,B,19.9,z\n3,4,NA,40,z\n4,5,C,NaN,z\n5,6,D,,z\n"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("packed", [False, True])
def test_csv_with_aliases(spark, tmp_path, packed):
    at = tmp_path / ("a.csv.gz" if packed else "a.csv")
    (gzip.open(at, "wt") if packed else open(at, "w")).write(TEXT) if not packed else at.write_bytes(gzip.compress(TEXT.encode()))
    df = sources.load_coordinates(spark, str(at))
    assert df.dtypes == [("x", "double"), ("y", "double"), ("gene", "string")]
    assert rows(df) == [(1.5, 2.0, "A"), (3.0, 4.0, None)]


def test_parquet_and_no_qv(spark, tmp_path):
    at = str(tmp_path / "a.parquet")
    spark.createDataFrame([(1.0, 2.0, "A", 5.0)], "x double, y double, gene string, other double").write.parquet(at)
    assert rows(sources.load_coordinates(spark, at)) == [(1.0, 2.0, "A")]


def test_bad_columns(spark):
    with pytest.raises(ValueError, match="several"):
        sources.standardise(spark.createDataFrame([(1.0, 2.0, 3.0, "A")], "x double, x_location double, y double, gene string"))
    with pytest.raises(ValueError, match="no column"):
        sources.standardise(spark.createDataFrame([(1.0, "A")], "x double, gene string"))


def test_missing_file(spark, tmp_path):
    for f in (sources.load_coordinates, sources.load_transcript_data):
        with pytest.raises(FileNotFoundError):
            f(spark, str(tmp_path / "none.csv"))


def test_transcripts_prune_columns(spark, tmp_path):
    at = tmp_path / "t.csv"
    at.write_text("x,y,gene,more\n1,2,A,q\n")
    df = sources.load_transcript_data(spark, str(at))
    assert df.dtypes == [("x", "float"), ("y", "float"), ("gene", "string")]
    assert "more" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("scheme", ["", "file:"])
def test_download(spark, tmp_path, scheme, capsys):
    at = tmp_path / "from" / "d.zip"
    at.parent.mkdir()
    with zipfile.ZipFile(at, "w") as z:
        z.writestr("inner.csv", TEXT)
        z.writestr("sub/more.csv", "x" * 200_000)
        z.mkdir("none")
    to = f"{scheme}{tmp_path}/to"
    folder = sources.download_dataset(at.as_uri(), to, spark)
    assert folder == f"{to}/d" and "100 %" in capsys.readouterr().out
    assert (tmp_path / "to" / "d" / "inner.csv").read_text() == TEXT and (tmp_path / "to" / "d" / "sub" / "more.csv").stat().st_size == 200_000
    assert spark.read.text(f"{folder}/inner.csv").count() == TEXT.count("\n")  # by executors, from the same path
    assert sources.load_coordinates(spark, f"{folder}/inner.csv").count() == 2
    at.unlink()
    assert sources.download_dataset(at.as_uri(), to) == folder  # neither is fetched or unpacked again
    plain = tmp_path / "from" / "a.csv"
    plain.write_text(TEXT)
    assert sources.download_dataset(plain.as_uri(), to, spark) == f"{to}/a.csv" and (tmp_path / "to" / "a.csv").read_text() == TEXT


def test_download_that_fails_leaves_nothing_that_counts(spark, tmp_path):
    at = tmp_path / "bad.zip"
    with zipfile.ZipFile(at, "w") as z:
        z.writestr("../out.csv", TEXT)
    with pytest.raises(ValueError, match="outside"):
        sources.download_dataset(at.as_uri(), f"{tmp_path}/to", spark)
    assert not (tmp_path / "out.csv").exists() and not (tmp_path / "to" / "bad").exists()
    with pytest.raises(Exception, match="none.csv"):
        sources.download_dataset((tmp_path / "none.csv").as_uri(), f"{tmp_path}/to", spark)
    assert not (tmp_path / "to" / "none.csv").exists()


def test_mocks(spark, tmp_path):
    df = synthetic.mock_molecules(spark, 1000).toPandas()
    assert len(df) == 1000 and df.x.between(10, 500).all() and df.y.between(10, 500).all() and set(df.gene) == set(synthetic.CLI_GENES)
    assert df.equals(synthetic.mock_molecules(spark, 1000).toPandas())
    board = synthetic.mock_dashboard(spark).toPandas()
    assert 26_400 <= len(board) <= 36_000 and board.x.between(50, 550).all() and set(board.gene) <= set(synthetic.BOARD_GENES)
    at = str(tmp_path / "mock.csv")
    synthetic.generate_vectorized_mock_data(spark, at, 200)
    assert sources.load_transcript_data(spark, at).count() == 200


def test_exports(spark, tmp_path):
    nodes = spark.createDataFrame([(i, 10.0 * i, 0.0) for i in range(4)], "node long, cx double, cy double")
    edges = graph.neighbours(nodes, 10.0)
    exports.export_edges(edges, str(tmp_path / "e"))
    assert rows(spark.read.csv(str(tmp_path / "e"), header=True)) == [("0", "1"), ("1", "2"), ("2", "3")]
    exports.export_matrix(graph.laplacian(edges), str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).count() == 10
    exports.export_npz(graph.laplacian(edges), str(tmp_path / "l.npz"), 4)
    with np.load(tmp_path / "l.npz") as z:
        dense = np.zeros((4, 4))
        for i in range(4):
            dense[i, z["indices"][z["indptr"][i] : z["indptr"][i + 1]]] = z["data"][z["indptr"][i] : z["indptr"][i + 1]]
    assert dense.tolist() == [[1, -1, 0, 0], [-1, 2, -1, 0], [0, -1, 2, -1], [0, 0, -1, 1]]


def test_npz_shards(spark, tmp_path):
    rng = np.random.default_rng(2)
    size = 3_000_000
    at = sorted({(int(r), int(c)) for r, c in zip(rng.choice([0, 1, 5, 1_048_576, 2_999_999], 400), rng.integers(0, size, 400), strict=True)} | {(7, c) for c in range(90)})
    own = [(r, c, float(i) - 50.0) for i, (r, c) in enumerate(at)]
    df = spark.createDataFrame(own, "row long, col long, value double").repartition(3)
    exports.export_npz_shards(df, str(tmp_path / "m"), size, limit=60)
    assert sorted(map(tuple, exports.read_npz_shards(spark, str(tmp_path / "m")).collect())) == own
    shards = spark.read.parquet(str(tmp_path / "m")).drop("npz").orderBy("row_from").collect()
    assert len(shards) > 4 and all(r.row_to - r.row_from <= exports.SHARD_ROWS for r in shards)
    assert [r.entries_before for r in shards] == np.cumsum([0, *(r.n for r in shards)])[:-1].tolist()
    files = exports.save_npz_shards(spark, str(tmp_path / "m"), str(tmp_path / "files"))
    assert len(files) == len(shards)
    with np.load(files[0]) as z:
        assert z["shape"][1] == size and z["indptr"][-1] == shards[0].n == len(z["data"]) and z["format"] == b"csr"
    exports.export_npz_shards(df.filter("false"), str(tmp_path / "none"), 5)
    assert exports.read_npz_shards(spark, str(tmp_path / "none")).count() == 0


def test_scope_deletes_what_was_written_within(spark):
    with shared.scope(spark):
        one = shared.written(spark.range(3))
        with shared.scope(spark):
            two = shared.written(spark.range(4))
            paths = [df.inputFiles()[0].removeprefix("file:").replace("///", "/") for df in (one, two)]
            assert two.count() == 4
        assert one.count() == 3 and [os.path.exists(p) for p in paths] == [True, False]
    assert not os.path.exists(paths[0])
    kept = shared.written(spark.range(5))
    assert kept.count() == 5

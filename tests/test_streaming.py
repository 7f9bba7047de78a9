import os
import random

import pytest

from gridlace.operators import matrix, tiles
from gridlace.operators import points as P
from gridlace.sources import tileset
from gridlace.streaming import counts
from gridlace.streaming import tiles as tiled


def test_stream_equals_batch(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text("x,y,gene\n" + "".join(f"{i + k * 1.5},{k},{'AB'[k % 2]}\n" for k in range(20)))
    stream = counts.running_counts(counts.read_points(spark, str(tmp_path), 1), 5.0, (0.0, 0.0))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = spark.read.schema("x double, y double, gene string").csv(str(tmp_path), header=True)
    want = matrix.count_genes(P.bin_square(batch, 5.0, at=(0.0, 0.0)))
    assert sorted(spark.table("running").collect()) == sorted(want.collect())


def test_tiles_follow_a_stream(spark, tmp_path):
    """Files that come one after the other, and a restart that replays a batch."""
    folder, at, out, full = (str(tmp_path / n) for n in ("in", "tiles", "out", "full"))
    rng = random.Random(1)
    parts = [[(rng.uniform(0, 300), rng.uniform(0, 300), rng.choice("AB")) for _ in range(40)], [(250.5, 20.5, "C"), (251.0, 21.0, "A")]]
    parts[0].append((0.0, 0.0, "A"))
    for k, own in enumerate(parts):
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/{k}.csv", "w") as f:
            f.write("x,y,gene\n" + "".join(f"{x!r},{y!r},{g}\n" for x, y, g in own))
        query = tiled.append_stream(counts.read_points(spark, folder), 50.0, at, str(tmp_path / "state"), 10.0, 15.0, out, availableNow=True)
        query.awaitTermination()
        assert query.exception() is None
    log = tileset.entries(spark, f"{at}/log")
    assert [e["epoch"] for e in log] == [0, 1] and [r["full"] for r in tileset.entries(spark, f"{out}/log")] == [True, False]
    tileset.append(tiles.read_tiles(spark, at), 50.0, at, epoch=1)  # seen already
    assert tiles.read_tiles(spark, at).count() == 43
    tiles.process_tiles(spark, 50.0, 10.0, 15.0, at, full)
    for name in ("bins", "counts", "edges"):
        got, want = (sorted(map(str, tiles.results(spark, o, name).collect())) for o in (out, full))
        assert got == want
    with pytest.raises(ValueError):
        tiled.append_stream(counts.read_points(spark, folder), 50.0, at, str(tmp_path / "other"), out_dir=out)

"""A growing folder of points kept as tiles, with results that follow: each batch of the stream is appended, and only tiles that it touches are redone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from gridlace.operators import tiles
from gridlace.sources import tileset


def append_stream(points: DataFrame, tile_size: float, partition_dir: str, checkpoint: str, resolution: float | None = None, max_dist: float | None = None, out_dir: str | None = None, **trigger) -> StreamingQuery:
    """Start to append streaming (x, y, gene) to the tiles under partition_dir; with out_dir, results there are brought up to date after each batch.

    A batch that was appended before a restart isn't appended again. trigger: as for the writer, such as availableNow=True."""
    if out_dir is not None and (resolution is None or max_dist is None):
        raise ValueError("results need a resolution and a max_dist")

    def take(batch: DataFrame, number: int) -> None:
        tileset.append(tiles.assign_tiles(batch.select("x", "y", "gene"), tile_size), tile_size, partition_dir, epoch=number)
        if out_dir is not None:
            tiles.process_appended(batch.sparkSession, tile_size, resolution, max_dist, partition_dir, out_dir)

    writer = points.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()

"""Square tiles: names, membership, partitioned storage."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.common import broadcast_if_few
from firnline.functions.semantics import round_bin
from firnline.operators.points import new_rows

MOST_FOLDERS = 500  # columns of tiles up to which each has a folder; a writer, a file and a rename for each cost more than rows


@dataclass(frozen=True)
class TilingSchema:
    """Tile geometry; ``mapping`` is round (tile named by its centre) or floor (by its corner)."""

    spacing: float = 100_000.0
    mapping: str = "round"
    scale: float = 1000.0
    name_format: str = "E%d_N%d"
    epsg: int | None = None

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> TilingSchema:
        return TilingSchema(**json.loads(text))

    def number(self, c: Column) -> Column:
        v = c / self.spacing
        return (F.rint(v) if self.mapping == "round" else F.floor(v)).cast("bigint")

    def tile(self, c: Column) -> Column:
        return self.number(c) * F.lit(self.spacing)

    def filename(self, tx: Column, ty: Column) -> Column:
        return F.format_string(self.name_format, (tx / self.scale).cast("bigint"), (ty / self.scale).cast("bigint"))

    def bounds(self, tx: Column, ty: Column) -> tuple[Column, Column, Column, Column]:
        a, b = (-0.5, 0.5) if self.mapping == "round" else (0.0, 1.0)
        return tx + a * self.spacing, tx + b * self.spacing, ty + a * self.spacing, ty + b * self.spacing

    def files_for_box(self, spark: SparkSession, x: tuple[float, float], y: tuple[float, float]) -> DataFrame:
        """Names of the tiles that meet a box."""
        n = lambda v: round(v / self.spacing) if self.mapping == "round" else int(v // self.spacing)
        seq = lambda a, b: F.explode(F.sequence(F.lit(n(a)), F.lit(n(b))))
        d = spark.range(1).select(seq(*x).alias("i")).withColumn("j", seq(*y))
        return d.select((F.col("i") * self.spacing).alias("tile_x"), (F.col("j") * self.spacing).alias("tile_y")).withColumn("name", self.filename(F.col("tile_x"), F.col("tile_y")))


def parse_name(name: Column, scale: float = 1000.0) -> tuple[Column, Column]:
    part = lambda p: F.regexp_extract(name, p, 1).try_cast("double") * scale
    return part(r"E(-?\d+)_N"), part(r"_N(-?\d+)")


def assign_tiles(df: DataFrame, schema: TilingSchema) -> DataFrame:
    return df.withColumns({"tile_x": schema.tile(F.col("x")), "tile_y": schema.tile(F.col("y"))})


def tiles_with_neighbours(df: DataFrame, schema: TilingSchema, tol: float) -> DataFrame:
    """Distinct tiles of the points, and of tiles whose edge is nearer than ``tol``."""
    w = schema.spacing
    near = lambda c: F.array_distinct(F.array(*[schema.number(F.col(c) + d) for d in (-tol, 0.0, tol)]))
    d = df.select(near("x").alias("i"), near("y").alias("j")).distinct()
    d = d.withColumn("i", F.explode("i")).withColumn("j", F.explode("j"))
    return d.select((F.col("i") * w).alias("tile_x"), (F.col("j") * w).alias("tile_y")).distinct()


def tile_ring(tiles: DataFrame, schema: TilingSchema) -> DataFrame:
    """Closed ring of five vertices per tile."""
    x0, x1, y0, y1 = schema.bounds(F.col("tile_x"), F.col("tile_y"))
    v = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    ring = F.array(v(x0, y0), v(x0, y1), v(x1, y1), v(x1, y0), v(x0, y0))
    return tiles.select("tile_x", "tile_y", F.posexplode(ring).alias("vertex", "p")).select("tile_x", "tile_y", "vertex", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def write_tiles(df: DataFrame, path: str, schema: TilingSchema, *, mode: str = "overwrite", bin_width: float | None = None, order: tuple[str, ...] = ("time",), by: tuple[str, ...] | None = None) -> None:
    """One partition per column of tiles, rows ordered by tile, bin and time inside, so that a box reads few pages.

    Tasks take ranges of tiles and bins with as many rows each: a crowded tile
    is written by several tasks, and a partition of few rows is one file,
    however many tiles there are.  ``by`` names the columns that are folders;
    if it is not given, a store of more than ``MOST_FOLDERS`` columns of tiles
    has none: its files are the tasks' ranges, and a box is found by the least
    and greatest ``tile_x`` of each file.  What is appended follows the store.
    """
    if by is None:
        by = _folders(df.sparkSession.read.parquet(path)) if mode == "append" else ("tile_x",) if df.agg(F.approx_count_distinct(schema.tile(F.col("x")))).first()[0] <= MOST_FOLDERS else ()
    b = bin_width or schema.spacing / 10
    tile = [schema.tile(F.col(c)) for c in "xy"]
    # places, not their tiles and bins, go through the shuffle
    t = df.repartitionByRange(*tile, round_bin("y", b), round_bin("x", b))
    t = assign_tiles(t, schema).withColumns({"_bx": round_bin("x", b), "_by": round_bin("y", b)})
    keys = [c for c in order if c in df.columns]
    t.sortWithinPartitions("tile_x", "tile_y", "_by", "_bx", *keys).drop("_bx", "_by").write.mode(mode).partitionBy(*by).parquet(path)


def _folders(store: DataFrame) -> tuple[str, ...]:
    """The columns that are folders of a store."""
    some = store.select(F.input_file_name().alias("file")).first()
    return tuple(c for c in ("tile_x", "tile_y") if f"/{c}=" in some.file) if some else ("tile_x",)


def append_tiles(df: DataFrame, path: str, schema: TilingSchema, keys: tuple[str, ...] = ("x", "y", "time"), **kw) -> None:
    """Append only rows whose keys the store does not hold yet; the folders are of the store's kind (of one column, of two or none)."""
    old = df.sparkSession.read.parquet(path)
    by = _folders(old)
    write_tiles(new_rows(df, broadcast_if_few(old.select(*keys)), list(keys)), path, schema, mode="append", **{"by": by, **kw})

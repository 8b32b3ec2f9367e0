"""Tables as Parquet, and the surface that is derived from them.

``faces`` is a triangulated surface with whole-number corners made of the rows of
``part``: two triangles in each cell of a grid of 50 columns whose west and east sides
fit together, with duplicate faces, vertical walls and collapsed faces added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS, CELL = 50, 100
#: Periodic width of the surface.
WIDTH = COLUMNS * CELL
CORNERS = [f"{a}{i}" for i in range(3) for a in "xzh"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _height(c, r):
    c = c % COLUMNS
    return (37 * c + 91 * r + 13 * c * r) % 64


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """face, three corners (x, z, h), terrain, region, script, chocobo.

    The hint keeps what comes of the faces from being broadcast on its estimate: that is of a
    compressed file and of one triangle a part, many times less than what the driver would hold.
    """
    k = F.col("k")
    base = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") % 32).cast("int").alias("terrain"))
    c = k % COLUMNS
    r = ((k - c) / COLUMNS).cast("long")
    base = base.select("k", "terrain", c.alias("c"), r.alias("r"), (r % 18).cast("int").alias("region"), F.when(k % 97 == 0, 3).otherwise(0).alias("script"), (k % 11 == 0).alias("chocobo"))
    c, r = F.col("c"), F.col("r")

    # heights are computed once a cell: written out in every corner they make code too long to be compiled at run time
    base = base.withColumns({f"h{dc}{dr}": _height(c + dc, r + dr) for dc in (0, 1) for dr in (0, 1)})

    def corner(dc: int, dr: int, h=None):
        return ((c + dc) * CELL, (r + dr) * CELL, F.col(f"h{dc}{dr}") if h is None else F.lit(h).cast("long"))

    def triangle(identity, *corners):
        flat = [v for point in corners for v in point]
        return F.struct(identity.cast("long").alias("face"), *[v.cast("long").alias(n) for v, n in zip(flat, CORNERS, strict=True)])

    first = (corner(0, 0), corner(1, 0), corner(0, 1))
    made = F.array(
        triangle(2 * k, *first),
        triangle(2 * k + 1, corner(1, 0), corner(1, 1), corner(0, 1)),
        F.when(k % 101 == 0, triangle(1_000_000_000 + 2 * k, *first)),
        F.when(k % 103 == 0, triangle(2_000_000_000 + 2 * k, corner(0, 0, 0), corner(0, 0, 50), corner(0, 1, 25))),
        F.when(k % 107 == 0, triangle(3_000_000_000 + 2 * k, corner(0, 0), corner(0, 0), corner(1, 0))),
    )
    return base.select("terrain", "region", "script", "chocobo", F.explode(made).alias("t")).where("t IS NOT NULL").select("t.*", "terrain", "region", "script", "chocobo").hint("merge")

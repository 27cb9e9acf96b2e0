"""Extracts laid out by place and month, so that a search by bounds and dates lists the folders that it needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a cell's number along each axis, and how many of them a folder's number keeps.
BITS, FOLDER_BITS = 16, 4
#: Ranges of folders that a search asks for at most; it takes in more folders rather than more ranges.
RANGES = 64


def _spread(n: Column) -> Column:
    """The bits of a 16-bit number, each followed by a zero."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        n = (n.bitwiseOR(F.shiftleft(n, shift))).bitwiseAND(F.lit(mask).cast("long"))
    return n


def cell(value: Column, low: float, high: float, bits: int = BITS) -> Column:
    """Number of the cell along one axis; what lies outside is in the first or last."""
    return F.greatest(F.lit(0), F.least(F.lit((1 << bits) - 1), F.floor((value - low) / (high - low) * (1 << bits)))).cast("long")


def curve(x: Column, y: Column) -> Column:
    """Place on a Z-order curve of two cell numbers."""
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1))


def write_extract(df: DataFrame, path: str, x: str, y: str, at: str, extent: tuple[float, float, float, float], folder_bits: int = FOLDER_BITS) -> None:
    """df as Parquet in folders month=yyyy-MM/zone=n, rows along the curve. Ranges of (month, place) are dealt out, so a crowded zone is
    several tasks' and files', and a file's row groups are narrow in place too. Rows without a place or time are in folders of their own."""
    place = curve(cell(F.col(x), extent[0], extent[2]), cell(F.col(y), extent[1], extent[3]))
    placed = df.withColumns({"_place": place, "month": F.date_format(at, "yyyy-MM"), "zone": F.shiftright(place, 2 * (BITS - folder_bits)).cast("int")})
    placed.repartitionByRange("month", "_place").sortWithinPartitions("month", "zone", "_place").drop("_place").write.mode("overwrite").partitionBy("month", "zone").parquet(path)


def zone_ranges(bounds: tuple[float, float, float, float], extent: tuple[float, float, float, float], folder_bits: int = FOLDER_BITS, most: int = RANGES) -> list[tuple[int, int]]:
    """Ranges of zones, both ends in, that hold every place within the bounds: squares are halved along the curve while they are partly outside; if ranges
    become too many, those nearest to each other are joined."""
    size = 1 << folder_bits
    step = lambda v, i: min(size - 1, max(0, int((v - extent[i]) // ((extent[i + 2] - extent[i]) / size))))
    x0, y0, x1, y1 = step(bounds[0], 0), step(bounds[1], 1), step(bounds[2], 0), step(bounds[3], 1)
    found: list[list[int]] = []

    def halve(left: int, low: int, bits: int, first: int) -> None:
        width = 1 << bits
        if left > x1 or left + width <= x0 or low > y1 or low + width <= y0:
            return
        if x0 <= left and left + width - 1 <= x1 and y0 <= low and low + width - 1 <= y1 or not bits:
            if found and found[-1][1] + 1 == first:
                found[-1][1] = first + width * width - 1
            else:
                found.append([first, first + width * width - 1])
            return
        half = width // 2
        for k, (dx, dy) in enumerate(((0, 0), (half, 0), (0, half), (half, half))):
            halve(left + dx, low + dy, bits - 1, first + k * half * half)

    halve(0, 0, folder_bits, 0)
    while len(found) > most:
        k = min(range(len(found) - 1), key=lambda i: found[i + 1][0] - found[i][1])
        found[k : k + 2] = [[found[k][0], found[k + 1][1]]]
    return [tuple(r) for r in found]


def read_extract(spark: SparkSession, path: str, x: str, y: str, at: str, extent: tuple[float, float, float, float], bounds: tuple[float, float, float, float], dates: tuple[str, str], folder_bits: int = FOLDER_BITS) -> DataFrame:
    """The rows within the bounds and the dates, both ends in: folders by month and ranges of zones, then rows by what they say. A bound must be
    within the extent or beyond the edge that it is nearest to, as places outside lie in the cells at the edge."""
    df = spark.read.parquet(path)
    zones = F.lit(False)
    for low, high in zone_ranges(bounds, extent, folder_bits):
        zones = zones | F.col("zone").between(low, high)
    inside = F.col(x).between(bounds[0], bounds[2]) & F.col(y).between(bounds[1], bounds[3])
    time = F.col(at).between(F.lit(dates[0]).cast("timestamp"), F.lit(dates[1]).cast("timestamp"))
    return df.where(F.col("month").between(dates[0][:7], dates[1][:7]) & zones & inside & time)

"""FASTA as a reference in pieces (region, piece, letters), with an index or without.

``load`` takes a file that has an index (.fai): each task reads some pieces by their place in the file, and of filtered contigs only.  ``read_pieces``
takes any files: lines get their contig and offset by windows over pieces of each file; names and
line lengths first add up inside a piece, and only one row a piece passes on to the next of its
file.  A folder may hold many files; a contig lies in one of them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..operators.reference import PIECE, piece_of
from . import files

SCHEMA = "region string, piece long, letters binary"
#: Pieces that a task reads, and letters of a line that is written.
TASK_PIECES, LINE = 256, 60


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(region, offset, letters): upper-case letters of each line and where they begin in their contig.

    Rows of one split have running ids in the order of its text; splits are ordered by their place in the file.
    """
    d = spark.read.text(path).select(F.trim("value").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"))
    d = d.withColumns({"name": F.when(F.col("value").startswith(">"), F.regexp_extract("value", r"^>(\S*)", 1)), "piece": F.struct("split", F.shiftright("id", 16).alias("part"))})
    d = d.withColumn("n", F.when(F.col("name").isNull(), F.length("value")).otherwise(0))
    inside = Window.partitionBy("file", "piece").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("file").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({"own": F.last("name", True).over(inside), "total": F.sum("n").over(inside)})
    pieces = d.groupBy("file", "piece").agg(F.max(F.struct("id", "own")).alias("m"), F.sum("n").alias("n"))
    pieces = pieces.select("file", "piece", F.last("m.own", True).over(earlier).alias("carried"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    d = d.join(pieces, ["file", "piece"]).withColumns({"region": F.coalesce("own", "carried"), "end": F.col("total") + F.col("before")})
    starts = d.where("name IS NOT NULL").groupBy("file", "region").agg(F.max("end").alias("zero"))
    d = d.where("name IS NULL AND n > 0").join(starts, ["file", "region"])
    return d.select("region", (F.col("end") - F.col("n") - F.col("zero")).alias("offset"), F.upper("value").alias("letters"))


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """(region, piece, letters) of files without an index."""
    end = F.col("offset") + F.length("letters")
    d = read_lines(spark, path).select("region", "offset", "letters", F.explode(F.sequence(piece_of(F.col("offset")), piece_of(end - 1))).alias("piece"))
    skip = F.greatest(F.col("piece") * PIECE - F.col("offset"), F.lit(0))
    part = F.substring("letters", (skip + 1).cast("int"), F.lit(PIECE) - F.greatest(F.col("offset") - F.col("piece") * PIECE, F.lit(0)).cast("int"))
    d = d.groupBy("region", "piece").agg(F.array_sort(F.collect_list(F.struct("offset", part.alias("part")))).alias("s"))
    return d.select("region", "piece", F.array_join(F.transform("s", lambda v: v["part"]), "").cast("binary").alias("letters"))


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    """Pieces of a FASTA file or folder, by its index where there is one."""
    if files.size(f"{path}.fai") is None:
        return read_pieces(spark, path)
    return load(spark, path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Pieces of a file by its index; the filter that all pass has every use planned anew, as in ``bam.load``."""
    register(spark)
    return spark.read.format("fasta").load(path).where("piece >= 0")


def read_index(path: str) -> list[tuple[str, int, int, int, int]]:
    """(name, length, place in the file, letters of a line, bytes of a line) of each contig."""
    with files.opened(f"{path}.fai") as f:
        rows = [line.split("\t") for line in f.read().decode().splitlines() if line]
    try:
        return [(r[0], *map(int, r[1:5])) for r in rows if len(r) == 5 or int("bad")]
    except ValueError as e:
        raise ValueError(f"{path}.fai is not an index of a FASTA file") from e


class Pieces(InputPartition):
    def __init__(self, entry: tuple[str, int, int, int, int], first: int, end: int):
        self.entry, self.first, self.end = entry, first, end


class FastaReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.regions: set[str] | None = None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if getattr(f, "attribute", None) == ("region",) and isinstance(f, EqualTo | In):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.regions = own if self.regions is None else self.regions & own
            yield f

    def partitions(self) -> list[Pieces]:
        out = []
        for entry in read_index(self.path):
            if entry[1] and (self.regions is None or entry[0] in self.regions):
                n = -(-entry[1] // PIECE)
                out += [Pieces(entry, i, min(i + TASK_PIECES, n)) for i in range(0, n, TASK_PIECES)]
        return out

    def read(self, part: Pieces) -> Iterator[tuple]:
        if not isinstance(part, Pieces):  # Spark's stand-in where nothing is to be read
            return
        name, length, place, letters, width = part.entry
        at = lambda pos: place + pos // letters * width + pos % letters
        with files.opened(self.path) as f:
            for piece in range(part.first, part.end):
                begin, end = piece * PIECE, min((piece + 1) * PIECE, length)
                f.seek(at(begin))
                got = f.read(at(end - 1) + 1 - at(begin)).translate(None, b"\r\n")
                if len(got) != end - begin:
                    raise ValueError(f"{self.path}: {name} does not lie where its index says")
                yield name, piece, got.upper()


class FastaDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastaReader:
        return FastaReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(FastaDataSource)


def write_fasta(pieces: DataFrame, path: str) -> None:
    """One file of lines and its index; the driver streams the pieces in order, one at a time.  Contigs follow by name."""
    import os

    system, at = files.located(path)
    system.create_dir(os.path.dirname(at))
    index, place, name, held, length = [], 0, None, b"", 0
    with system.open_output_stream(at) as f:

        def put(data: bytes) -> None:
            nonlocal place
            f.write(data)
            place += len(data)

        def close() -> None:
            if name is not None:
                put(held + b"\n" if held else b"")
                index.append((name, length, begin, LINE, LINE + 1))

        for r in pieces.orderBy("region", "piece").toLocalIterator():
            if r["region"] != name:
                close()
                put(f">{r['region']}\n".encode())
                name, held, length, begin = r["region"], b"", 0, place
            held += bytes(r["letters"])
            length += len(r["letters"])
            whole = len(held) // LINE * LINE
            put(b"".join(held[i : i + LINE] + b"\n" for i in range(0, whole, LINE)))
            held = held[whole:]
        close()
    with system.open_output_stream(f"{at}.fai") as f:
        f.write("".join("\t".join(map(str, e)) + "\n" for e in index).encode())

"""Breached digests kept as a table in folders by leading digits, with a Bloom filter beside it.

SHA-1 digests are evenly spread, so a digest is its own hash: its first 32 bits choose a block of the filter, seven later groups of 16 bits
the bits in it. A block has 32 768 bits and about ``_PER_BLOCK`` digests (10 bits each). A screen probes the filter first; of the digests it
reads only the folders in which a probe may lie, so a batch without breached passwords reads next to none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..sources.tables import committed, read_snapshot, write_snapshot

_BITS, _HASHES = 32_768, 7
_PER_BLOCK = _BITS // 10
#: Some 160 MB.
_PER_FOLDER = 4_000_000
#: Given when reading: folder names such as 07 or 1e would become numbers.
_DIGESTS = StructType().add("digest", "string").add("lead", "string")
_FILTER = StructType().add("block", "long").add("blocks", "long").add("bits", "binary").add("lead", "string")


def _number(digest: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")


def _block(digest: Column, blocks: Column) -> Column:
    return F.shiftright(_number(digest, 1, 8) * blocks, 32)


def _positions(digest: Column) -> list[Column]:
    return [F.pmod(_number(digest, 9 + 4 * i, 4), F.lit(_BITS)) for i in range(_HASHES)]


def _is_set(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", byte, F.pmod(position, F.lit(8)).cast("int")) == 1


def digests_save(digests: DataFrame, root: str, name: str, width: int | None = None) -> int:
    """Write the next version of a digest table (column ``digest``, SHA-1 in lower-case hex) and its filter; returns the version.

    Folders go by the first ``width`` digits (1 to 4; so many that a folder holds at most ``_PER_FOLDER`` rows if not given, and
    a folder may have several files). Repeated digests are stored once; null ones and those that are no such hex text, which no password can have, are left out. Until the filter is committed,
    readers see the version before.
    """
    if width is None:
        rows = digests.count()
        width = next((w for w in (1, 2, 3) if rows <= 16 ** w * _PER_FOLDER), 4)
    if not 1 <= width <= 4:
        raise ValueError("width is 1 to 4")
    spark = digests.sparkSession
    clean = (digests.select("digest").where(F.col("digest").rlike("^[0-9a-f]{40}$")).distinct()
             .withColumn("lead", F.substring("digest", 1, width)))
    version = write_snapshot(clean, root, f"{name}/digests", sort_by=["digest"], partition_by=["lead"])
    stored = read_snapshot(spark, root, f"{name}/digests", _DIGESTS, version)
    # A multiple of the number of folders: a block lies in one folder.
    folders = 16 ** width
    blocks = F.lit(folders * max(1, -(-stored.count() // (folders * _PER_BLOCK)))).cast("long")
    digest = F.col("digest")
    bits = (stored.select("lead", _block(digest, blocks).alias("block"), F.explode(F.array(*_positions(digest))).alias("at"))
            .groupBy("lead", "block").agg(F.bitmap_construct_agg("at").alias("bits"))
            .select("block", blocks.alias("blocks"), "bits", "lead"))
    write_snapshot(bits, root, f"{name}/filter", sort_by=["block"], partition_by=["lead"], upto=version)
    return version


def _stored(spark: SparkSession, root: str, name: str) -> tuple[DataFrame, DataFrame]:
    done = committed(spark, root, f"{name}/filter")
    if not done:
        raise FileNotFoundError(f"{name}: no committed digests")
    return (read_snapshot(spark, root, f"{name}/digests", _DIGESTS, done[-1]["upto"]),
            read_snapshot(spark, root, f"{name}/filter", _FILTER, done[-1]["version"]))


def _leads(probes: DataFrame) -> list[str]:
    """Folders of some digests: at most 16 ** width values."""
    return sorted(r[0] for r in probes.select("lead").distinct().collect())


def digest_candidates(digests: DataFrame, root: str, name: str) -> DataFrame:
    """The distinct digests (digest, lead) of a batch that the filter does not rule out: all that are stored, and about one in 100 others."""
    spark = digests.sparkSession
    _, bloom = _stored(spark, root, name)
    first = bloom.select("blocks", F.length("lead").alias("width")).first()
    probes = digests.select("digest").where("digest is not null").distinct()
    if first is None:  # no digests are stored
        return probes.withColumn("lead", F.lit("")).limit(0)
    probes = probes.select("digest", F.substring("digest", 1, first["width"]).alias("lead"),
                           _block(F.col("digest"), F.lit(first["blocks"]).cast("long")).alias("block"))
    near = bloom.where(F.col("lead").isin(_leads(probes))).select("block", "bits")
    hit = F.forall(F.array(*_positions(F.col("digest"))), lambda at: _is_set(F.col("bits"), at))
    return probes.join(near, "block").where(hit).select("digest", "lead")


def stored_digests(candidates: DataFrame, root: str, name: str) -> DataFrame:
    """The digest rows of the folders that hold ``candidates``; other folders are not opened."""
    rows, _ = _stored(candidates.sparkSession, root, name)
    return rows.where(F.col("lead").isin(_leads(candidates)))


def screen_breached_stored(df: DataFrame, root: str, name: str, password: str = "password") -> DataFrame:
    """The rows that ``quality.screen_breached`` gives, from stored digests; the password is neither returned nor written.

    Null passwords are not breached. Equal passwords are looked up once; a password that many rows share is split by adaptive
    execution in the last join, whose many-side is the left one.
    """
    hashed = df.withColumn("_digest", F.sha1(password)).drop(password, f"{password}_confirmation")
    candidates = digest_candidates(hashed.select(F.col("_digest").alias("digest")), root, name)
    found = candidates.join(stored_digests(candidates, root, name), ["lead", "digest"], "left_semi").select(F.col("digest").alias("_digest"))
    return hashed.join(found, "_digest", "left_semi").drop("_digest")

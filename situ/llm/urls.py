"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

A page's URL gives its candidates: for each number of labels of a listed host with each length of a path listed with it,
that many last labels of its host with that long a prefix of its path.  The filter is a table of blocks, each a word of 64
bits; a candidate's block is found by its number and tested for the candidate's bits.  Candidates that the filter passes go
on to a hash join with the list, which removes false positives.  DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: Bits that an entry sets in its 64-bit block.
BITS = 5
#: Entries for which a block is sized.
ENTRIES_A_BLOCK = 4
#: Largest filter that is broadcast, in blocks of 8 bytes with their numbers; candidates are shuffled to larger ones.
MOST_BLOCKS = 1 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """From the first :// up to the next /, ?, # or the end, with A-Z in lower case; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """Rules (host with path, allow or block) as the table that url_verdicts takes: rule, host, path, action."""
    rows = []
    for rule, action in rules:
        host, slash, path = rule.partition("/")
        rows.append((rule, host.translate(str.maketrans(_UPPER, _LOWER)), slash + path, action))
    return spark.createDataFrame(rows, "rule string, host string, path string, action string")


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks).cast("long"))


def _mask(key: Column) -> Column:
    h = F.xxhash64(key, F.lit(7))
    mask = F.lit(0).cast("long")
    for i in range(BITS):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(h, 12 * i), F.lit(64).cast("long")).cast("int")))
    return mask


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row for each row of ``pages``: page_id, host, path, rule, verdict.

    A rule (rule, host, path, action) fits its host and all its subdomains if the URL's path starts with the rule's
    path.  Of rules that fit, the longest wins (of the same length, the last by name); its action is the verdict.  Where
    none fits, rule is null and the verdict is the method's own: ``default``, as the URL is not listed.  A null URL, or
    one without ://, has an empty host and path.  Pages that repeat give rows that repeat.  With no rules all pages get
    the default.  Other columns are ignored.
    """
    labels = lambda c: F.size(F.split(c, "\\.", -1))
    listed = written(
        rules.select(F.concat(F.col("host"), F.lit("\n"), F.col("path")).alias("key"), "rule", "action", labels(F.col("host")).alias("depth"), F.char_length("path").alias("size"))
        .groupBy("key")
        .agg(F.max(F.struct("rule", "action", "depth", "size")).alias("r"))
        .select("key", "r.*")
    )
    # Shapes: numbers of labels and path lengths that are listed together; as few as names and addresses are short.
    stats = listed.agg(F.count("*").alias("n"), F.sort_array(F.collect_set(F.struct("depth", "size"))).alias("shapes")).first()
    blocks = 1
    while blocks * ENTRIES_A_BLOCK < stats["n"]:
        blocks *= 2
    bloom = listed.groupBy(_block(F.col("key"), blocks).alias("block")).agg(F.bit_or(_mask(F.col("key"))).alias("bits"))
    judged = pages.select("page_id", url_host(F.col("url").cast("string")).alias("host"), url_path(F.col("url").cast("string")).alias("path"))
    shapes = F.array(*[F.struct(F.lit(d).alias("depth"), F.lit(s).alias("size")) for d, s in stats["shapes"]]).cast("array<struct<depth:int,size:int>>")
    fit = F.filter(shapes, lambda x: (x["depth"] <= F.size("names")) & (x["size"] <= F.char_length("path")))
    candidate = lambda x: F.concat(F.array_join(F.slice("names", F.size("names") - x["depth"] + 1, x["depth"]), "."), F.lit("\n"), F.substring(F.col("path"), F.lit(1), x["size"]))
    urls = judged.select("host", "path").distinct().withColumn("names", F.split("host", "\\.", -1))
    each = urls.select("host", "path", F.explode(F.transform(fit, candidate)).alias("key")).withColumns({"block": _block(F.col("key"), blocks), "mask": _mask(F.col("key"))})
    bloom = F.broadcast(bloom) if blocks <= MOST_BLOCKS else bloom
    maybe = each.join(bloom, "block").where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).select("host", "path", "key")
    hits = maybe.join(listed, "key").groupBy("host", "path").agg(F.max(F.struct(F.char_length("rule").alias("n"), F.col("rule").alias("rule"), F.col("action").alias("action"))).alias("hit"))
    found = hits.select(F.col("host").alias("h"), F.col("path").alias("p"), "hit.rule", "hit.action")
    out = judged.join(found, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"))

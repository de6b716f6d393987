"""Line dedup by distinct-site spread.

A line is boilerplate where at least `min_sites` sites have it. HyperLogLog sketches of the sites, one for each line
hash, merge by aggregation; lines whose estimate is clearly above the threshold are boilerplate, those clearly below it
aren't, and those near it get an exact distinct count. DataFrame functions only.

Defined results: lines end at \\n and are compared without spaces, tabs and carriage returns at their ends; blank lines
are never counted or removed; a null site is no site; null texts have no lines and come back as empty texts. Equal rows
are equal documents, all of which come back. Texts may be of any length; columns named n_lines and n_removed are
replaced, all others stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from .store import free_names, written

MIN_SITES, LG_K = 5, 10
#: Standard errors of the sketch within which an estimate is near the threshold.
BAND = 4
BLANKS = " \t\r"
#: Hashes of lines are broadcast up to so many (8 bytes each), else joined by a shuffle.
BROADCAST_LINES = 1_000_000
#: Keys over which the rows with one boilerplate line are spread in that shuffle.
SALTS = 64
#: Sets in which a row's removed lines are looked up.
SETS = 32


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def bare(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def boilerplate(docs: DataFrame, site: str, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(h) of the lines that at least min_sites sites have."""
    own = F.array_distinct(F.transform(lines_of(F.col("text")), bare))
    lines = docs.where(F.col("text").isNotNull() & F.col(site).isNotNull()).select(F.col(site).cast("string").alias("site"), F.explode(own).alias("line"))
    lines = lines.where("line <> ''").select("site", F.xxhash64("line").alias("h"))
    spread = lines.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch")).select("h", F.hll_sketch_estimate("sketch").alias("sites"))
    band = max(1.0, BAND * 1.04 / 2 ** (lg_k / 2) * min_sites)
    clear = spread.where(F.col("sites") > min_sites + band).select("h")
    near = written(spread.where(F.col("sites").between(min_sites - band, min_sites + band)).select("h"), "near_lines")
    # a line that many documents of a site have is one row of each task; without a broadcast, that comes before the join, too
    few = near.count() <= BROADCAST_LINES
    once = lambda rows: rows.groupBy("h", "site").agg(F.count(F.lit(1)).alias("rows"))
    pairs = once(lines.join(F.broadcast(near), "h", "left_semi")) if few else once(lines).join(near, "h", "left_semi")
    exact = pairs.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select("h")
    return written(clear.unionByName(exact), "boilerplate")


def line_dedup(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """docs with boilerplate lines taken out of text, and n_lines (that aren't blank) and n_removed."""
    docs = docs.drop("n_lines", "n_removed")
    names = docs.columns
    key, gone, kept = free_names(names, "key", "gone", "kept")
    common = boilerplate(docs, site, min_sites, lg_k)
    # rows are told apart by all that can be hashed of them, so the copies of one text don't meet; equal rows share their list
    plain = [F.col(f"`{f.name}`") for f in docs.schema if isinstance(f.dataType, AtomicType)]
    keyed = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn(key, F.xxhash64(*plain))
    own = keyed.select(F.col(key).alias("key"), F.explode(F.array_distinct(F.transform(lines_of(F.col("text")), lambda x: F.xxhash64(bare(x))))).alias("h"))
    if common.count() <= BROADCAST_LINES:
        own = own.join(F.broadcast(common), "h", "left_semi")
    else:
        salted = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = own.withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int")).join(salted, ["h", "salt"], "left_semi")
    own = own.groupBy("key").agg(F.collect_set("h").alias("all"))
    # in sets, so that looking lines up isn't quadratic in a text's lines
    sets = F.transform(F.sequence(F.lit(0), F.lit(SETS - 1)), lambda k: F.filter("all", lambda h: F.pmod(h, F.lit(SETS)) == k))
    out = keyed.join(own.select(F.col("key").alias(key), F.when(F.size("all") > SETS, sets).otherwise(F.array("all")).alias(gone)), key, "left")
    in_gone = lambda h: F.array_contains(F.element_at(gone, F.when(F.size(gone) == 1, F.lit(1)).otherwise(F.pmod(h, F.lit(SETS)) + 1).cast("int")), h)
    full = F.size(F.filter(lines_of(F.col("text")), lambda x: bare(x) != ""))
    left = F.when(F.col(gone).isNull(), lines_of(F.col("text"))).otherwise(F.filter(lines_of(F.col("text")), lambda x: (bare(x) == "") | ~in_gone(F.xxhash64(bare(x)))))
    out = out.withColumn(kept, left).withColumn("n_lines", full.cast("long"))
    n_removed = F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size(F.filter(kept, lambda x: bare(x) != "")))
    out = out.withColumn("n_removed", n_removed.cast("long"))
    return out.select(*[F.array_join(kept, "\n").alias("text") if c == "text" else F.col(f"`{c}`") for c in names], "n_lines", "n_removed")


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = f"""
    WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
    l AS (SELECT DISTINCT source, trim(x, ' ' || chr(9) || chr(13)) AS line FROM d, unnest(string_split(t, chr(10))) AS u(x)),
    b AS (SELECT line FROM l WHERE line <> '' AND source IS NOT NULL GROUP BY line HAVING count(*) >= {MIN_SITES}),
    p AS (SELECT doc_id, t, string_split(t, chr(10)) AS parts FROM d),
    r AS (SELECT DISTINCT p.t, trim(x, ' ' || chr(9) || chr(13)) AS line FROM p, unnest(parts) AS u(x)),
    g AS (SELECT t, list(line) AS gone FROM r SEMI JOIN b USING (line) GROUP BY t),
    k AS (SELECT doc_id, parts, list_filter(parts, lambda x: NOT list_contains(coalesce(gone, []), trim(x, ' ' || chr(9) || chr(13)))) AS kept
          FROM p LEFT JOIN g USING (t))
    SELECT doc_id, len(list_filter(parts, lambda x: trim(x, ' ' || chr(9) || chr(13)) <> ''))::BIGINT AS n_lines,
           (len(parts) - len(kept))::BIGINT AS n_removed, sha256(array_to_string(kept, chr(10))) AS kept_sha256
    FROM k"""

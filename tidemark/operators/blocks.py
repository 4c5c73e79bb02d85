"""Top-k text search over bounded index blocks.

A block holds a word's rows of a range of documents, with bounds on what the word can add to any
of their ranks.  A search reads the most promising blocks first; the k-th rank found there is a
floor, and blocks whose bound stays under it are never joined with their positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.fulltext import FIELD_WEIGHT, rank_terms

#: Documents of a block: as many ids as the range of a block spans.
BLOCK_DOCS = 1024
#: Blocks of one folder of a stored index; a search skips whole folders.
FOLDER_BLOCKS = 64

_ROWS = "array<struct<posting_id:bigint,field:string,positions:array<int>>>"


def build_blocks(index: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """`(term, block, rows, docs, most_hits, most_weight)` from occurrence rows.

    A block spans `block_docs` ids, so the block of a word that every document has is bounded too.
    `most_hits` and `most_weight` are the largest number of places, and the largest sum of
    their weights, of the word in one document of the block.
    """
    weight = F.when(F.col("field") == "A", FIELD_WEIGHT["A"]).otherwise(FIELD_WEIGHT["B"])
    in_doc = F.struct("posting_id", "field", "positions")
    docs = index.groupBy("term", "posting_id").agg(
        F.collect_list(in_doc).alias("rows"),
        F.sum(F.size("positions")).alias("hits"),
        F.sum(weight * F.size("positions")).alias("weight"),
    )
    block = F.floor(F.col("posting_id") / block_docs).cast("bigint")
    return docs.groupBy("term", block.alias("block")).agg(
        F.flatten(F.collect_list("rows")).cast(_ROWS).alias("rows"),
        F.count(F.lit(1)).alias("docs"),
        F.max("hits").alias("most_hits"),
        F.max("weight").alias("most_weight"),
    )


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Store blocks in folders of neighbouring blocks, sorted by word, and their bounds apart.

    A search reads all bounds of its words, but the rows of only those folders and words that it
    cannot rule out.
    """
    folder = F.floor(F.col("block") / FOLDER_BLOCKS)
    placed = blocks.withColumn("folder", folder)
    (
        placed.repartitionByRange("folder", "term", "block")
        .sortWithinPartitions("folder", "term", "block")
        .write.mode("overwrite").partitionBy("folder").parquet(f"{path}/rows")
    )
    stored = blocks.sparkSession.read.parquet(f"{path}/rows")
    (
        stored.select("term", "block", "folder", "docs", "most_hits", "most_weight")
        .repartitionByRange("term", "block").sortWithinPartitions("term", "block")
        .write.mode("overwrite").parquet(f"{path}/bounds")
    )


def read_blocks(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(blocks, bounds) of a stored index."""
    return spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/bounds")


def _bound(n: Column) -> Column:
    """No document of a block ranks higher.

    One word: the largest sum of its weights.  Several: a minimal cover holds some place of the
    rarest word, one place lies in at most as many covers as there are words, and a cover adds at
    most the mean of the words' weights, each no more than its own largest.
    """
    mean = F.least(F.sum(F.least(F.col("most_weight"), F.lit(1.0))) / n, F.lit(1.0))
    several = n * F.min("most_hits") * mean
    return F.when(n == 1, F.max("most_weight")).otherwise(several)


def candidate_blocks(bounds: DataFrame, terms: DataFrame) -> DataFrame:
    """`(query_id, block, bound)`: blocks that hold every word of a query."""
    return (
        bounds.join(terms, "term")
        .groupBy("query_id", "n_terms", "block")
        .agg(
            F.count(F.lit(1)).alias("words"),
            (_bound(F.col("n_terms")) * (1 + 1e-9)).alias("bound"),
        )
        .where(F.col("words") == F.col("n_terms"))
        .select("query_id", "block", "bound")
    )


def _ranked(blocks: DataFrame, chosen: DataFrame, terms: DataFrame) -> DataFrame:
    """Ranks of the documents of chosen `(query_id, block)` pairs."""
    keys = ["block", "folder"] if "folder" in blocks.columns else ["block"]
    if "folder" in keys:
        chosen = chosen.withColumn("folder", F.floor(F.col("block") / FOLDER_BLOCKS).cast("int"))
    wanted = chosen.join(terms, "query_id")
    rows = (
        blocks.join(wanted, [*keys, "term"])
        .select("query_id", "term", "ordinal", "n_terms", F.explode("rows").alias("r"))
        .select("query_id", "term", "ordinal", "n_terms", "r.*")
    )
    # terms ride along with their rows: one query's words meet in a document
    return rank_terms(
        rows.select(
            F.concat_ws("\x1f", "query_id", "term").alias("term"), "posting_id", "field", "positions"
        ),
        terms.withColumn("term", F.concat_ws("\x1f", "query_id", "term")),
    )


def _best(ranks: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("rank"), F.asc("posting_id"))
    return ranks.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def search_topk(
    blocks: DataFrame, bounds: DataFrame, terms: DataFrame, k: int
) -> tuple[DataFrame, DataFrame]:
    """The k best documents of each query, and what was skipped.

    `(query_id, posting_id, rank, place)`: higher ranks first, then lower ids; equal to ranking
    all documents.  `(query_id, blocks, first, second, skipped)`: blocks that hold all words, read
    first for the floor, read second, and never read.  `terms` as of `query_terms`, with any
    number of queries.

    First read are each query's k blocks of the highest bounds: where bounds are tight, each of them
    holds a document that ranks near its own.  The k-th rank there, if there is one, is the floor.
    Documents of equal rank and lower id
    may still replace the k-th, so blocks whose bound equals the floor are read.
    """
    found = candidate_blocks(bounds, terms)
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("bound"), F.asc("block"))
    lined = found.withColumn("ahead", F.row_number().over(by_bound) - 1)
    seed = lined.where(F.col("ahead") < k).select("query_id", "block")
    first = _best(_ranked(blocks, seed, terms), k)
    floor = first.where(F.col("place") == k).select("query_id", F.col("rank").alias("floor"))
    rest = (
        lined.where(F.col("ahead") >= k)
        .join(floor, "query_id", "left")
        .withColumn("read", F.col("floor").isNull() | (F.col("bound") >= F.col("floor")))
    )
    second = _ranked(blocks, rest.where("read").select("query_id", "block"), terms)
    best = _best(first.drop("place").unionByName(second), k)
    counts = lined.join(floor, "query_id", "left").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("blocks"),
        F.count_if(F.col("ahead") < k).alias("first"),
        F.count_if(
            (F.col("ahead") >= k) & (F.col("floor").isNull() | (F.col("bound") >= F.col("floor")))
        ).alias("second"),
        F.count_if((F.col("ahead") >= k) & (F.col("bound") < F.col("floor"))).alias("skipped"),
    )
    return best, counts

"""B: retrieval tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import terms


def build_postings(passages: DataFrame) -> DataFrame:
    """B1: term, source_id, passage_no, tf, n_terms. A passage is in one task, so counts within it need no shuffle of their own key."""
    each = passages.select("source_id", "passage_no", "n_terms", F.explode(terms(F.col("quote"))).alias("term"))
    return each.groupBy("term", "source_id", "passage_no", "n_terms").agg(F.count("*").alias("tf")).select("term", "source_id", "passage_no", "tf", "n_terms")


def passage_postings(each: DataFrame, again: DataFrame | None = None) -> DataFrame:
    """B1 from prepare.passage_terms(): a passage's terms are counted in its own row, and nothing is moved.

    again: the passages of sources whose id repeats; those of the same number and length count as one, as in build_postings().
    """
    def runs(s):
        starts = F.filter(F.sequence(F.lit(0), F.size(s)), lambda i: (i == 0) | (i == F.size(s)) | (F.get(s, i) != F.get(s, i - 1)))
        of = lambda b: F.transform(F.slice(b, 1, F.size(b) - 1), lambda x, k: F.struct(F.get(s, x).alias("term"), (F.get(b, k + 1) - x).cast("long").alias("tf")))
        return F.flatten(F.transform(F.array(starts), of))

    counted = F.flatten(F.transform(F.filter(F.array(F.sort_array("terms")), lambda s: F.size(s) > 0), runs))
    rows = each.select("source_id", "passage_no", "n_terms", F.explode(counted).alias("p")).select("p.term", "source_id", "passage_no", "p.tf", "n_terms")
    return rows if again is None else rows.union(_counted(_exploded(again)))


def _exploded(each: DataFrame) -> DataFrame:
    return each.select("source_id", "passage_no", "n_terms", F.explode("terms").alias("term"))


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("term", "source_id", "passage_no", "n_terms").agg(F.count("*").alias("tf")).select("term", "source_id", "passage_no", "tf", "n_terms")


def count_terms(each: DataFrame, again: DataFrame | None = None) -> DataFrame:
    """term, df, n_terms: B2 and B3 in one pass over prepare.passage_terms(); the row of a null term counts passages and their terms.

    Counts add up before they move. again: as in passage_postings().
    """
    nothing = F.array(F.lit(None).cast("string"))
    rows = each.select("n_terms", F.explode(F.concat(nothing, F.array_distinct("terms"))).alias("term"))
    if again is not None:
        rows = rows.union(again.select("n_terms", F.explode(nothing).alias("term"))).union(_exploded(again).distinct().select("n_terms", "term"))
    return rows.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("n_terms"))).alias("n_terms"))


def counted_tables(counted: DataFrame) -> dict[str, DataFrame]:
    """corpus (B3) and stats (B2) from count_terms()."""
    corpus = counted.where("term is null").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n_passages"), (F.sum("n_terms") / F.sum("df")).alias("mean_terms"))
    return {"corpus": corpus, "stats": with_idf(counted.where("term is not null").select("term", "df"), corpus)}


def corpus_stats(passages: DataFrame) -> DataFrame:
    """n_passages and mean_terms, one row."""
    return passages.agg(F.count("*").alias("n_passages"), F.avg("n_terms").alias("mean_terms"))


def with_idf(counted: DataFrame, n_passages: DataFrame) -> DataFrame:
    """term, df, idf from counts of passages by term (term, df)."""
    n, df = F.col("n_passages"), F.col("df")
    return counted.crossJoin(F.broadcast(n_passages.select("n_passages"))).select("term", "df", F.log(1 + (n - df + 0.5) / (df + 0.5)).alias("idf"))


def term_stats(postings: DataFrame, n_passages: DataFrame) -> DataFrame:
    """B2: term, df, idf. n_passages: corpus_stats(), whose one row is broadcast."""
    return with_idf(postings.groupBy("term").agg(F.count("*").alias("df")), n_passages)

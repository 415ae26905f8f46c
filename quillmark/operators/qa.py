"""C: citation-backed question answering. Every step is a join or grouping over whole tables of questions and passages."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import params
from ..functions.text import sentences, terms, words
from . import matching


def question_set(df: DataFrame, kind: str) -> DataFrame:
    """question_id and question, from user turns of conversations (kind "user") or from benchmark items ("benchmark")."""
    if kind == "user":
        return df.where(F.col("role") == "user").select(F.concat_ws(":", F.lit(kind), "conv_id", "turn").alias("question_id"), F.col("text").alias("question"))
    return df.select(F.concat_ws(":", F.lit(kind), "item_id").alias("question_id"), F.col("text").alias("question"))


def question_terms(questions: DataFrame, stats: DataFrame, corpus: DataFrame, max_df_share: float = params.MAX_DF_SHARE, max_terms: int = params.MAX_TERMS) -> DataFrame:
    """question_id, term, idf: distinct terms, too common ones dropped, the rarest kept; what else stats has of a term comes along.

    Null questions have no terms.
    """
    more = [c for c in stats.columns if c not in ("term", "df", "idf")]
    each = questions.select("question_id", F.explode(F.array_distinct(terms(F.col("question")))).alias("term"))
    rare = each.join(stats, "term").crossJoin(F.broadcast(corpus.select("n_passages"))).where(F.col("df") <= F.col("n_passages") * max_df_share)
    order = Window.partitionBy("question_id").orderBy("df", "term")
    return rare.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max_terms).select("question_id", "term", "idf", *more)


def score_passages(wanted: DataFrame, postings: DataFrame, corpus: DataFrame, k1: float = params.K1, b: float = params.B) -> DataFrame:
    """BM25 of each question and passage that share a term, rounded before anything is ranked."""
    tf = F.col("tf")
    part = F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n_terms") / F.col("mean_terms")))
    joined = postings.join(wanted, "term").crossJoin(F.broadcast(corpus.select("mean_terms")))
    return joined.groupBy("question_id", "source_id", "passage_no").agg(F.round(F.sum(part), 6).alias("score"))


def top_passages(scored: DataFrame, k: int = params.TOP_K, per_source: int = params.PER_SOURCE) -> DataFrame:
    """C4: question_id, source_id, passage_no, score, rank: the best passages of each source, then the best k."""
    within = Window.partitionBy("question_id", "source_id").orderBy(F.desc("score"), "passage_no")
    best = scored.withColumn("place", F.row_number().over(within)).where(F.col("place") <= per_source).drop("place")
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "source_id", "passage_no")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_sentence(hits: DataFrame, passages: DataFrame, wanted: DataFrame) -> DataFrame:
    """question_id and answer, the sentence of the cited passages whose distinct question terms have the largest idf together; ties
    by rank, then place."""
    said = hits.join(passages.select("source_id", "passage_no", "quote"), ["source_id", "passage_no"]).select("question_id", "rank", F.posexplode(sentences(F.col("quote"))).alias("place", "answer"))
    matched = said.select("question_id", "rank", "place", "answer", F.explode(F.array_distinct(terms(F.col("answer")))).alias("term")).join(wanted, ["question_id", "term"])
    summed = matched.groupBy("question_id", "rank", "place", "answer").agg(F.round(F.sum("idf"), 6).alias("weight"))
    order = Window.partitionBy("question_id").orderBy(F.desc("weight"), "rank", "place")
    return summed.withColumn("n", F.row_number().over(order)).where("n = 1").select("question_id", F.trim("answer").alias("answer"), "weight")


def citations(hits: DataFrame, passages: DataFrame, answers: DataFrame) -> DataFrame:
    """C6, one row for each citation."""
    spans = passages.select("source_id", "passage_no", "char_start", "char_len", "quote")
    return hits.join(spans, ["source_id", "passage_no"]).join(answers.select("question_id", "answer"), "question_id").select("question_id", "answer", "rank", "source_id", "passage_no", "char_start", "char_len", "quote", "score")


def cited_answers(hits: DataFrame, passages: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers with their citations in order of rank; there are at most k of them."""
    one = F.struct("rank", "source_id", "passage_no", "char_start", "char_len", "quote", "score")
    return citations(hits, passages, answers).groupBy("question_id", "answer").agg(F.sort_array(F.collect_list(one)).alias("citations"))


def unanswered(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Questions without evidence."""
    return questions.join(hits.select("question_id"), "question_id", "left_anti")


def check_citations(cited: DataFrame, sources: DataFrame) -> DataFrame:
    """Cited rows (question_id, rank, source_id, char_start, char_len, quote) with a verdict: exact, moved or missing."""
    there = F.substr("text", F.col("char_start") + 1, F.col("char_len"))
    verdict = F.when(there == F.col("quote"), "exact").when(F.instr("text", F.col("quote")) > 0, "moved").otherwise("missing")
    return cited.join(sources.select("source_id", "text"), "source_id", "left").select("question_id", "rank", "source_id", F.coalesce(verdict, F.lit("missing")).alias("verdict"))


def find_quote(quotes: DataFrame, sources: DataFrame, anchor: int = params.ANCHOR) -> DataFrame:
    """quote_id, source_id, position (from 1) of every source that holds a quote verbatim.

    quotes: quote_id, quote. Up to QUOTES quotes (of BYTES) are looked for where texts are read (matching). For more, words 2 to anchor + 1
    find candidates by an equi-join on hashes of word runs, and texts are met again only by these. Quotes of fewer than anchor + 2 words
    have no such anchor and no rows: short_quotes() names them, find_any_quote() looks for them, too.
    """
    asked = quotes.where(F.size(words(F.col("quote"))) >= anchor + 2).select("quote_id", "quote")
    n, size = asked.agg(F.count("*"), F.sum(F.octet_length("quote"))).first()
    return matching.match_quotes(asked, sources) if n <= matching.QUOTES and (size or 0) <= matching.BYTES else find_by_anchor(asked, sources, anchor)


def find_any_quote(quotes: DataFrame, sources: DataFrame, anchor: int = params.ANCHOR) -> DataFrame:
    """find_quote() without its bound: quotes of any number of words are looked for, and of none, too; an empty one is in every text.

    Null quotes and null texts have no rows.
    """
    texts, asked = sources.where("text is not null"), quotes.where("quote is not null").select("quote_id", "quote")
    n_words = F.size(words(F.col("quote")))
    empty = texts.crossJoin(F.broadcast(asked.where("quote = ''"))).select("quote_id", "source_id", F.lit(1).alias("position"))
    n, size = asked.agg(F.count("*"), F.sum(F.octet_length("quote"))).first()
    if n <= matching.QUOTES and (size or 0) <= matching.BYTES:
        return matching.match_quotes(asked, texts, blank=True).union(empty)
    return find_by_anchor(asked.where(n_words >= anchor + 2), texts, anchor).union(matching.match_quotes(asked.where(n_words < anchor + 2), texts, blank=True)).union(empty)


def find_by_anchor(quotes: DataFrame, sources: DataFrame, anchor: int = params.ANCHOR) -> DataFrame:
    """find_quote() and find_any_quote() for quotes that are too many to be sent to each task; all have anchor + 2 words at least."""
    run = lambda w, at: F.xxhash64(F.array_join(F.slice(w, at, anchor), " "))
    keyed = quotes.select("quote_id", run(words(F.col("quote")), 2).alias("key"))
    every = lambda w: F.when(F.size(w) >= anchor, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - anchor + 1)), lambda i: run(w, i)))
    # a one-element transform names the words, so that a text is split once
    runs = sources.select("source_id", F.explode(F.array_distinct(F.element_at(F.transform(F.array(words(F.col("text"))), every), 1))).alias("key"))
    pairs = runs.join(keyed, "key").select("source_id", "quote_id").distinct()
    met = pairs.join(sources.select("source_id", "text"), "source_id").join(quotes, "quote_id")
    return met.select("quote_id", "source_id", F.instr("text", F.col("quote")).alias("position")).where("position > 0")


def short_quotes(quotes: DataFrame, anchor: int = params.ANCHOR) -> DataFrame:
    """Quotes that find_quote() can't look up."""
    return quotes.where(F.size(words(F.col("quote"))) < anchor + 2)


def retrieval_quality(hits: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """For each k the share of questions with a gold source in the top k, the share of gold pairs there, and the mean reciprocal
    rank. gold: question_id, source_id."""
    met = gold.join(hits.select("question_id", "source_id", "rank"), ["question_id", "source_id"], "left")
    first = met.groupBy("question_id").agg(F.min("rank").alias("first"), F.count("*").alias("n"), *(F.count_if(F.col("rank") <= k).alias(f"in_{k}") for k in ks))
    each = first.select("*", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"in_{k}").alias("found")) for k in ks))).alias("at")).select("first", "n", "at.*")
    reciprocal = F.when(F.col("first") <= F.col("k"), 1 / F.col("first")).otherwise(0.0)
    return each.groupBy("k").agg(F.round(F.avg((F.col("found") > 0).cast("double")), 6).alias("hit_rate"), F.round(F.sum("found") / F.sum("n"), 6).alias("recall"), F.round(F.avg(reciprocal), 6).alias("mrr"))

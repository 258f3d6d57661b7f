"""Text search by token overlap over an inverted index (a table of tokens), and corpus vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lonja.functions.exprs import round2, tokens
from lonja.functions.text import expanded
from lonja.storage import stored

#: Rows of the index that a query's rarest tokens give first; words and share of words that settle a code.
SEEDS, LEAST_SCORE, LEAST_SHARE = 64, 2, 0.4


def inverted_index(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(token, id): each token of a row once."""
    return rows.select(F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("token"), F.col(id_col).alias("id"))


def search(queries: DataFrame, index: DataFrame, k: int = 3, first_hit: bool = False) -> DataFrame:
    """The k rows of the index that share most tokens with each query (query, text); repeated query tokens count again. Ties go to
    the smaller id; with ``first_hit`` first to the row met by the earliest token of the query. Queries that share nothing
    with the index are left out. confidence = min(1, score / max(2, tokens of the query)).

    A threshold search, exact at any size: the rarest tokens of a query (SEEDS rows of the index at most) give rows whose whole
    scores bound the k-th best from below. Its most frequent tokens, which together cannot reach that bound, are never joined: the
    lists of the others give candidates, and those that can still reach it look the frequent tokens up by (token, id), which
    spreads the hottest list over all tasks. Stored: the lists of the queries' tokens, the tokens
    with their numbers, and how they are split."""
    asked = queries.select("query", F.posexplode(tokens(F.col("text"))).alias("at", "token"))
    size = asked.groupBy("query").agg(F.count("*").alias("n_tokens"))
    weighted = asked.groupBy("query", "token").agg(F.count("*").alias("weight"), F.min("at").alias("at"))
    lists = stored(index.select("token", "id").join(weighted.select("token").distinct(), "token", "left_semi"), "lists")
    words = stored(weighted.join(lists.groupBy("token").agg(F.count("*").alias("size")), "token"), "words")
    up, down = Window.partitionBy("query").orderBy("size", "token"), Window.partitionBy("query").orderBy(F.desc("size"), "token")
    rare = words.withColumn("rare", F.sum("size").over(up) <= SEEDS)
    seeds = _scored(_hits(rare.where("rare"), lists), rare.where("NOT rare"), lists)
    bounds = _best(seeds, k, first_hit).where(F.col("place") == k).select("query", F.col("score").alias("bound"))
    split = stored(words.join(bounds, "query", "left").withColumn("light", F.sum("weight").over(down) < F.coalesce("bound", F.lit(0))), "split")
    most = split.where("bound IS NOT NULL").groupBy("query").agg(F.max("bound").alias("bound"), F.coalesce(F.sum(F.when(F.col("light"), F.col("weight"))), F.lit(0)).alias("more"))
    able = _hits(split.where("NOT light"), lists).join(most, "query", "left").where(F.coalesce(F.col("score") + F.col("more") >= F.col("bound"), F.lit(True))).drop("bound", "more")
    ranked = _best(_scored(able, split.where("light"), lists), k, first_hit)
    confidence = F.least(F.lit(1.0), F.col("score") / F.greatest(F.lit(2), F.col("n_tokens")))
    return ranked.join(size, "query").select("query", "id", "score", "place", round2(confidence).alias("confidence"), ((confidence >= LEAST_SHARE) & (F.col("score") >= LEAST_SCORE)).alias("accepted"))


def _hits(words: DataFrame, lists: DataFrame) -> DataFrame:
    """(query, id, score, at) over whole lists of tokens."""
    return words.join(lists, "token").groupBy("query", "id").agg(F.sum("weight").alias("score"), F.min("at").alias("at"))


def _scored(hits: DataFrame, words: DataFrame, lists: DataFrame) -> DataFrame:
    """Scores of hits with what further tokens of their queries add, each looked up by token and id."""
    found = hits.select("query", "id").join(words.select("query", "token", "weight", "at"), "query").join(lists, ["token", "id"])
    both = hits.unionByName(found.select("query", "id", F.col("weight").alias("score"), "at"))
    return both.groupBy("query", "id").agg(F.sum("score").alias("score"), F.min("at").alias("at"))


def _best(scores: DataFrame, k: int, first_hit: bool) -> DataFrame:
    order = [F.desc("score"), "at", "id"] if first_hit else [F.desc("score"), "id"]
    return scores.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("place") <= k)


def classified(rows: DataFrame, id_col: str, text: Column, tariffs: DataFrame) -> DataFrame:
    """(id_col, ncm, desc, duty, score, confidence, pending): the tariff row (line: a key in the table's order, ncm, desc, duty) whose
    description and code share most words with a text in the table's language; of equal ones that met by the text's first
    word, then the first line. Without LEAST_SCORE words and LEAST_SHARE of the text's words it is pending and has no code;
    texts without any word of the table have score 0 and are not pending. Equal texts are searched once, and of tariff rows that hold the
    same of the texts' words only the first, which is before the others for every text; null texts are empty."""
    given = rows.select(F.col(id_col), F.coalesce(text, F.lit("")).alias("given"))
    texts = stored(given.select("given").distinct().select("given", expanded(F.col("given")).alias("text")), "texts")
    asked = texts.select("text").distinct().select(F.col("text").alias("query"), "text")
    index = inverted_index(tariffs.select("line", F.concat_ws(" ", F.coalesce("desc", F.lit("")), "ncm").alias("text")), "line", "text")
    alike = stored(_first_alike(asked, index), "alike")
    first = stored(search(asked, alike, 1, first_hit=True).select(F.col("query").alias("text"), "id", "score", "accepted"), "first")
    first = first.join(tariffs.select(F.col("line").alias("id"), "ncm", "desc", "duty"), "id")
    n = F.size(tokens(F.col("text")))
    score = F.coalesce("score", F.lit(0))
    kept = [F.when(F.col("accepted"), F.col(c)).alias(c) for c in ("ncm", "desc", "duty")]
    found = texts.join(first, "text", "left").select("given", *kept, score.alias("score"), F.least(F.lit(1.0), score / F.greatest(F.lit(2), n)).alias("confidence"), (F.col("accepted").isNotNull() & ~F.col("accepted")).alias("pending"))
    return given.join(stored(found, "found"), "given").drop("given")


def _first_alike(queries: DataFrame, index: DataFrame) -> DataFrame:
    """The index of the smallest id among rows that share their tokens, tokens that no query has left out: others never win one hit."""
    asked = queries.select(F.explode(tokens(F.col("text"))).alias("token")).distinct()
    alike = index.join(asked, "token", "left_semi").groupBy("id").agg(F.sort_array(F.collect_set("token")).alias("tokens"))
    return alike.groupBy("tokens").agg(F.min("id").alias("id")).select(F.explode("tokens").alias("token"), "id")


def vocabulary(rows: DataFrame, text_col: str, least: int = 3) -> DataFrame:
    """Tokens found at least so often, with their counts."""
    return rows.select(F.explode(tokens(F.col(text_col))).alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= least)

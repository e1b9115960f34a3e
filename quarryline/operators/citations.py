"""Citation markers in answers: the passage around each, whether the cited text supports it, who may see it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions import text as X

#: A passage ends after a full stop, exclamation or question mark and a blank, or with its line.
CLAUSE = r"(?<=[.!?]) |\n"
#: Phrases of a refusal, which never carries a citation.
REFUSALS = [
    "insufficient evidence", "not enough information", "sources do not contain", "cannot answer",
    "cannot be determined", "no information provided", "available sources are insufficient",
]
#: Words that say nothing about a claim.
STOPWORDS = """
a about above after again against all am an and any are aren't as at be because been before being below between both but by can can't cannot could couldn't did didn't do does doesn't
doing don't down during each few for from further had hadn't has hasn't have haven't having he her here hers herself him himself his how i if in into is isn't it its itself let's me
more most mustn't my myself no nor not of off on once only or other ought our ours ourselves out over own same shan't she should shouldn't so some such than that the their theirs them
themselves then there these they this those through to too under until up very was wasn't we were weren't what when where which while who whom why with won't would wouldn't you your
yours yourself yourselves see refer ref view also according stated source per
""".split()
CLAIM_WORD, CLAIM_NUMBER = r"[\p{L}\p{N}_$-]+", r"\b\d+(?:\.\d+)?\b"


def cited_passages(answers: DataFrame, text_col: str) -> DataFrame:
    """A row for every marker, with its passage; (piece, turn) is its place in the answer. Answers without marker or text give none."""
    pieces = answers.select("*", F.posexplode(F.split(text_col, CLAUSE)).alias("piece", "passage"))
    return pieces.select("*", F.posexplode(X.citation_markers("passage")).alias("turn", "marker")).withColumn("passage", F.trim("passage"))


def supported(df: DataFrame, passage_col: str, text_col: str, least: float = 0.2) -> DataFrame:
    """Adds ``supported`` and ``support``: the share of the passage's content words, or of its numbers, that the text contains.

    A passage of markers alone or without content words is supported, a refusal never is; one content word must be found,
    several must reach ``least``, by words or by numbers.
    """
    # step by step: what several steps use is computed once a row
    x = df.withColumn("_claim", F.trim(F.regexp_replace(F.lower(passage_col), X.CITATION, ""))).withColumn("_body", F.lower(F.coalesce(text_col, F.lit(""))))
    trimmed = F.transform(F.regexp_extract_all("_claim", F.lit(CLAIM_WORD), F.lit(0)), lambda w: F.regexp_replace(w, "^[$-]+|[$-]+$", ""))
    x = x.withColumn("_words", F.filter(trimmed, lambda w: (F.length(w) > 2) & ~w.isin(STOPWORDS))).withColumn("_numbers", F.regexp_extract_all("_claim", F.lit(CLAIM_NUMBER), F.lit(0)))
    for name in ("words", "numbers"):
        x = x.withColumn(f"_{name}_found", F.size(F.filter(f"_{name}", lambda w: F.contains(F.col("_body"), w))))
    n, found = F.size("_words"), F.col("_words_found")
    numbers = F.when(F.size("_numbers") > 0, F.col("_numbers_found") / F.size("_numbers")).otherwise(F.lit(0.0))
    refusal = F.col("_claim").rlike("|".join(REFUSALS))
    x = x.withColumn("_share", F.greatest(found / n, numbers))
    ok = F.when(F.col("_claim") == "", True).when(refusal, False).when(n == 0, True).when(n == 1, found > 0).otherwise(F.col("_share") >= least)
    score = F.when(F.col("_claim") == "", 1.0).when(refusal, 0.0).when(n == 0, 1.0).otherwise(F.col("_share"))
    return x.select(*df.columns, ok.alias("supported"), score.alias("support"))


def may_cite(tenant: Column, visibility: Column, owner: Column, caller_tenant: Column, caller: Column) -> Column:
    """Own or global tenant (any, for a caller without one), and not private to another owner; private without owner may be cited."""
    inside = caller_tenant.isNull() | (F.coalesce(tenant, F.lit("global")) == "global") | (tenant == caller_tenant)
    foreign = (F.coalesce(visibility, F.lit("tenant")) == "private") & owner.isNotNull() & ~F.coalesce(owner == caller, F.lit(False))
    return inside & ~foreign


def first_accepted(marks: DataFrame, keys: list[str], accepted: Column, *cols: str) -> DataFrame:
    """Of every marker its first accepted place; a rejected marker may be accepted later in the answer."""
    return marks.where(accepted).groupBy(*keys, "marker").agg(F.min_by(F.struct("piece", "turn", *cols), F.struct("piece", "turn")).alias("x")).select(*keys, "marker", "x.*")

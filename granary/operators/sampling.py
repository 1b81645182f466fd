"""Next-token sampling over rows of (sequence, token, logit). A sequence's window has one row a token.

Defined results: a token with a null logit is never taken, and has a null probability. A null sequence is
one of its own. Repeated rows are tokens of their own. Further columns are carried along, but for
draw, which returns sequence and token; names that begin with two underscores are taken. Empty tables
give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.text import uniform


def with_temperature(df: DataFrame, temperature: float = 1.0) -> DataFrame:
    if temperature <= 0:
        raise ValueError("the temperature must be positive")
    return df if temperature == 1.0 else df.withColumn("logit", F.col("logit") / temperature)


def penalised(df: DataFrame, seen: DataFrame, penalty: float, seq: str = "seq") -> DataFrame:
    """Logits of tokens that stand in `seen` (sequence, token) are made less likely by the penalty, once however often they stand there."""
    seen = seen.select(F.col(seq).alias("__seq"), F.col("token").alias("__token")).distinct().withColumn("__seen", F.lit(True))
    marked = df.join(seen, F.col(seq).eqNullSafe(F.col("__seq")) & (F.col("token") == F.col("__token")), "left").drop("__seq", "__token")
    less = F.when(F.col("logit") > 0, F.col("logit") / penalty).otherwise(F.col("logit") * penalty)
    return marked.withColumn("logit", F.when(F.col("__seen"), less).otherwise(F.col("logit"))).drop("__seen")


def top_k(df: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """Tokens at least as likely as the k-th; ties with it stay."""
    return df.where("logit IS NOT NULL").withColumn("__rank", F.rank().over(W.partitionBy(seq).orderBy(F.desc("logit")))).where(F.col("__rank") <= k).drop("__rank")


def softmax(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Adds `probability`."""
    whole = W.partitionBy(seq)
    weighed = df.withColumn("__e", F.exp(F.col("logit") - F.max("logit").over(whole)))
    return weighed.withColumn("probability", F.col("__e") / F.sum("__e").over(whole)).drop("__e")


def top_p(df: DataFrame, p: float, seq: str = "seq") -> DataFrame:
    """The likeliest tokens up to and with the one that takes their mass over p; the first always stays."""
    before = W.partitionBy(seq).orderBy(F.desc("logit"), "token").rowsBetween(W.unboundedPreceding, -1)
    return softmax(df.where("logit IS NOT NULL"), seq).withColumn("__before", F.coalesce(F.sum("probability").over(before), F.lit(0.0))).where(F.col("__before") <= p).drop("__before", "probability")


def draw(df: DataFrame, seed: int, seq: str = "seq") -> DataFrame:
    """One token for each sequence, by its probability: the least exponential key wins, as in an exponential race."""
    key = -F.log(uniform(seed, F.col(seq), F.col("token"))) / F.col("probability")
    return softmax(df.where("logit IS NOT NULL"), seq).groupBy(seq).agg(F.min_by("token", key).alias("token"))

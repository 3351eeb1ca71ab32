"""Split and retry of batches that an extractor could not answer, as set operations over all batches at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Codes after which a batch is halved until single records fail, and rounds of asking again.
HALVED = ("record_too_large", "content_filtered", "output_truncated", "model_refused")
INVALID, MISSING, ROUNDS = "invalid_response", "missing_result", 2


def split_and_retry(batches: DataFrame, by: list[str], batch: str, place: str, ask: Callable[[DataFrame], DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """``batches`` (a row for each record) with its end: ``code`` (null: answered), ``round`` and ``requests`` its batches took.

    ``ask`` gets the open rows with _part (the batch's name), _size and _round, and adds _code, the same for a
    batch's rows (null: the batch was answered), and _missing, whether a record has no answer.  A batch with
    one of the codes HALVED is halved in the same round, a single record fails with it.  An invalid answer is
    halved in the next round, or fails where none is left.  Records without an answer are asked again together
    in the next round, and fail where none is left.  All open batches take a step together, so there are
    as many steps as halvings of the largest batch and rounds.  Each step's rows go to the checkpoint folder.
    """
    names = batches.columns
    open_ = batches.withColumns({"_part": F.concat_ws("|", *[F.col(c).cast("string") for c in [*by, batch]]), "_round": F.lit(0), "_requests": F.lit(0)})
    ends = []
    while True:
        whole = Window.partitionBy("_part")
        sized = open_.withColumns({"_size": F.count("*").over(whole), "_at": F.row_number().over(whole.orderBy(place)), "_requests": F.col("_requests") + 1})
        told = ask(sized).checkpoint()
        last = F.col("_round") >= rounds
        halved, invalid = F.col("_code").isin(*HALVED), F.col("_code") == INVALID
        missing = F.col("_code").isNull() & F.col("_missing")
        code = F.when(halved & (F.col("_size") == 1), F.col("_code")).when(invalid & last, INVALID).when(missing & last, MISSING)
        done = F.col("_code").isNull() & ~F.col("_missing")
        ends.append(told.withColumn("code", code).where(done | F.col("code").isNotNull()).select(*names, "code", F.col("_round").alias("round"), F.col("_requests").alias("requests")))
        rest = told.where(~done & code.isNull())
        second = (F.col("_at") > F.floor(F.col("_size") / 2)).cast("int").cast("string")
        split = F.col("_code").isNotNull() & (F.col("_size") > 1)
        step = F.when(split, F.concat(F.lit("."), second)).otherwise(F.lit(".r"))
        open_ = rest.select(*names, F.concat("_part", step).alias("_part"), (F.col("_round") + F.when(halved, 0).otherwise(1)).alias("_round"), "_requests")
        if not rest.limit(1).count():
            break
    out = ends[0]
    for e in ends[1:]:
        out = out.unionByName(e)
    return out

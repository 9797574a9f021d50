"""Training rows: token budget, loss mask, padding, and the train/validation split."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docutally import fixed_values as fv
from docutally.functions.text import is_blank, trim_all

VOCABULARY = 32_000


def word_tokens(text) -> Column:
    """Default tokenizer: one id from 1 up per white-space separated word, by hash."""
    text = F.col(text) if isinstance(text, str) else text
    words = F.when(is_blank(text), F.array().cast("array<string>")).otherwise(F.split(trim_all(text), r"(?U)\s+"))
    return F.transform(words, lambda w: (F.pmod(F.xxhash64(w), F.lit(VOCABULARY)) + 1).cast("int"))


def wrapped_prompt(prompt) -> Column:
    prompt = F.col(prompt) if isinstance(prompt, str) else prompt
    return F.concat(F.lit(fv.INSTRUCTION_HEAD), prompt, F.lit(fv.INSTRUCTION_TAIL))


def pack_training_rows(
    rows: DataFrame,
    tokenize: Callable[[Column], Column] = word_tokens,
    max_length: int = fv.MAX_LENGTH,
    pad_id: int = 0,
) -> DataFrame:
    """Add ``input_ids``, ``attention_mask`` and ``labels``, each of ``max_length`` numbers.

    The completion is kept whole and the prompt is cut to what remains; a completion longer
    than ``max_length`` is cut itself and takes the whole row. ``tokenize`` maps a text column
    to an array of token ids: a built-in expression or a pandas UDF.
    """
    tokens = rows.withColumns({"_prompt": tokenize(wrapped_prompt("prompt")), "_completion": tokenize(F.col("completion"))})
    room = F.lit(max_length) - F.size("_completion")
    cut = tokens.withColumns(
        {
            "_prompt": F.when(room > 0, F.slice("_prompt", F.lit(1), room)).otherwise(F.array().cast("array<int>")),
            "_completion": F.slice("_completion", 1, max_length),
        }
    )
    n_prompt, n_real = F.size("_prompt"), F.size("_prompt") + F.size("_completion")
    n_pad = F.lit(max_length) - n_real
    packed = {
        "input_ids": F.concat("_prompt", "_completion", F.array_repeat(F.lit(pad_id), n_pad)),
        "attention_mask": F.concat(F.array_repeat(F.lit(1), n_real), F.array_repeat(F.lit(0), n_pad)),
        "labels": F.concat(
            F.array_repeat(F.lit(fv.MASKED_LABEL), n_prompt),
            "_completion",
            F.array_repeat(F.lit(fv.MASKED_LABEL), n_pad),
        ),
    }
    return cut.withColumns(packed).drop("_prompt", "_completion")


SPLIT_HEX = 4  # leading hex digits of the hash that form a slice: at most 65,536 slices


def train_valid_split(
    rows: DataFrame, key: str, ratio: float = fv.VALIDATION_RATIO, seed: int = fv.SPLIT_SEED
) -> DataFrame:
    """Add ``split``: exactly ceil(ratio * rows) rows become 'valid', the others 'train'.

    The validation rows are the first in the order of a seeded hash of ``key`` (unique). The
    hash at the border is found from counts per hash slice and a ranking inside the one slice
    it falls in (about 1/65,536 of the keys); the rows themselves are only compared with it.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    hashes = rows.select(F.struct(digest.alias("digest"), F.col(key).alias("key")).alias("_at")).withColumn(
        "_slice", F.substring("_at.digest", 1, SPLIT_HEX)
    )
    slices = hashes.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    # At most 16 ** SPLIT_HEX rows from here to the border slice.
    ordered = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.ceil(F.lit(str(ratio)).cast("decimal(10,6)") * F.sum("_n").over(Window.partitionBy()))
    before = F.coalesce(F.sum("_n").over(ordered), F.lit(0))
    border = (
        slices.withColumn("_take", F.least(wanted - before, F.col("_n")))
        .where("_take > 0")
        .orderBy(F.desc("_slice"))
        .limit(1)
        .select("_slice", "_take")
    )
    rank = F.row_number().over(Window.partitionBy("_slice").orderBy("_at"))
    edge = hashes.join(F.broadcast(border), "_slice").withColumn("_rank", rank).where("_rank = _take").select("_at")
    at = F.struct(digest.alias("digest"), F.col(key).alias("key"))
    return rows.withColumn("split", F.when(at <= edge.scalar(), "valid").otherwise("train"))

"""Column functions for report text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docutally.fixed_values import NOT_AVAILABLE, NOT_DETECTED
from docutally.functions.text import plain


def shown(text, default: str = NOT_DETECTED) -> Column:
    """The text without outer white space, or ``default`` when there is none."""
    return F.coalesce(plain(text), F.lit(default))


def _formatted(pattern: str, value) -> Column:
    # format_string prints a null as text, so nulls are kept out of it.
    return F.when(value.isNotNull(), F.format_string(pattern, value))


def money(value, currency) -> Column:
    """``CUR 1,234.50``; a value that is not a number is shown as it is."""
    value = F.col(value) if isinstance(value, str) else value
    amount = F.coalesce(_formatted("%,.2f", value.try_cast("double")), value)
    code = plain(currency)
    text = F.when(code.isNull(), amount).otherwise(F.concat_ws(" ", code, amount))
    return F.when(plain(value).isNull(), F.lit(NOT_DETECTED)).otherwise(text)


def latency(seconds) -> Column:
    seconds = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.coalesce(_formatted("%.2fs", seconds), F.lit(NOT_AVAILABLE))


def cost(usd) -> Column:
    usd = F.col(usd) if isinstance(usd, str) else usd
    return F.format_string("$%.6f", F.coalesce(usd.cast("double"), F.lit(0.0)))


def status(success) -> Column:
    success = F.col(success) if isinstance(success, str) else success
    return F.when(success, "success").when(~success, "failed").otherwise("unknown")

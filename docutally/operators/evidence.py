"""What a document's text states: dates, codes, percentages, amounts and quantities, told apart.

A text is read once from left to right; at each place the first kind that fits takes the whole token, so the parts of a
date or of an invoice number are no amounts. A number is an amount when it has two decimals, stands beside a currency, or follows a
label such as ``Total:`` or a sign ``=`` or ``@``; every other number is a quantity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docutally import fixed_values as fv
from docutally.schemas import MONEY

_MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?"
_NUMBER = r"(?:\d+(?:,\d+)*(?:\.\d+)?|\.\d+)"
_CURRENCY = "(?:" + "|".join([*sorted(set(fv.CURRENCIES)), r"[$€£₹]"]) + ")"
_LABEL = r"(?i:total|subtotal|tax|due|price|amount|rate)"
#: Kinds in the order in which they are tried; one group each.
KINDS = {
    "date": rf"(?<![\w.])(?=[\dJFMASOND])(?:\d{{4}}[-/.]\d{{1,2}}[-/.]\d{{1,2}}|\d{{1,2}}[-/.]\d{{1,2}}[-/.](?:\d{{4}}|\d{{2}})|\d{{1,2}} {_MONTH}(?:,? \d{{4}})?|{_MONTH} \d{{1,2}}(?:,? \d{{4}})?)(?![\w/-])",
    "percent": rf"(?<![\w.]){_NUMBER}\s?%",
    "amount": (
        rf"(?<![\w.]){_CURRENCY}\s?-?{_NUMBER}(?!\w)|(?<![\w.])-?{_NUMBER}\s?{_CURRENCY}(?!\w)"
        rf"|(?<![\w.])-?\d+(?:,\d+)*\.\d{{2}}(?!\w|\.\d)|(?=[-.\d])(?<=(?:{_LABEL}:?|[=@])\s{{0,3}})-?{_NUMBER}(?!\w|\s?%)"
    ),
    "code": r"(?<!\w)(?:[A-Za-z]++[-#/_]?\d[\w#/-]*|#\d[\w-]*|\d[\d.]*(?![x×]\b)[A-Za-z][\w-]*|\d+(?:[-/]\d+)+)",
    "quantity": rf"(?<![\w.]){_NUMBER}(?=[x×]?(?!\w))",
}
#: What every kind asks of its first characters, looked at once: no token starts inside a word unless with a sign or a digit, and
#: letters at its start are followed by a digit, with at most three marks or spaces between.
_START = r"(?=[-.#$€£₹\dA-Za-z])(?:(?<!\w)|(?=[-.\d]))(?![A-Za-z]++(?![-#/_.\s]{0,3}\d))"
PATTERN = _START + "(?:" + "|".join(f"({part})" for part in KINDS.values()) + ")"


#: Marks around a token and between its kinds. No kind takes a control character, and any other one stands in for them in a text.
_EDGE, _SLOT, _OTHER = "\x01", "\x02", "\x03"


def _pieces(text) -> Column:
    """The text cut into what stands before a token, the token, what stands before the next one, and so on.

    One pass of the pattern: a token comes with one slot per kind, and all slots but its own are empty.
    """
    slots = _SLOT.join(f"${i + 1}" for i in range(len(KINDS)))
    return F.split(F.regexp_replace(_unmarked(text), PATTERN, f"{_EDGE}{slots}{_EDGE}"), _EDGE, -1)


def _unmarked(text) -> Column:
    """The text with no marks of its own. Hardly any text has one, and looking for them costs far less than going through it by character."""
    text = F.col(text) if isinstance(text, str) else text
    own = F.contains(text, F.lit(_EDGE)) | F.contains(text, F.lit(_SLOT))
    return F.when(own, F.translate(text, _EDGE + _SLOT, _OTHER * 2)).otherwise(text)


def stated(kind: str, text="raw_text") -> Column:
    """The distinct values of one kind that a text states: numbers in comparable form, dates and codes as they stand."""
    # The slots of one kind, one after the other: every other kind leaves its mark only.
    marked = F.regexp_replace(_unmarked(text), PATTERN, f"{_EDGE}${list(KINDS).index(kind) + 1}{_EDGE}")
    # Between two marks stand the tokens, at odd places the text around them; only the former are kept, as \x02token. Every step
    # mentions the one before once, since what stands twice, under a condition, is evaluated twice.
    tokens = F.regexp_replace(marked, f"(?s)[^{_EDGE}]*+(?:{_EDGE}([^{_EDGE}]*+){_EDGE}|\\z)", f"{_SLOT}$1")
    if kind in ("date", "code"):
        return F.array_distinct(F.array_remove(F.split(tokens, _SLOT, -1), ""))
    # A token has nothing but digits, marks and a currency, so no pattern is needed to read it.
    plain = F.translate(tokens, "$€£₹,% \n\tABCDEFGHIJKLMNOPQRSTUVWXYZ", "")
    return F.array_distinct(F.array_remove(F.split(plain, _SLOT, -1), "").try_cast(T.ArrayType(MONEY)))


def places(text="raw_text") -> Column:
    """All tokens of a text by place: structs (kind, start, stop, text), characters from 0, stop exclusive; null for null.

    Places are running sums over the text's pieces. They are made in runs of about as many pieces as there are runs, so that no list is
    copied for every piece of a long text.
    """
    pieces = _pieces(text)
    return F.transform(F.array(pieces), _placed)[0]


def _placed(pieces: Column) -> Column:
    n_tokens = F.floor(F.size(pieces) / 2).cast("int")
    run = F.ceil(F.sqrt(n_tokens)).cast("int")
    none = F.array().cast("array<bigint>")

    def token(piece: Column) -> Column:
        return F.translate(piece, _SLOT, "")

    # Per token the characters from the stop of the one before to its own stop.
    steps = F.transform(
        F.sequence(F.lit(1), n_tokens),
        lambda i: (F.char_length(F.get(pieces, 2 * i - 2)) + F.char_length(token(F.get(pieces, 2 * i - 1)))).cast("bigint"),
    )

    def sums(values: Column, first: Column) -> Column:
        """Running sums, from ``first`` on."""
        start = F.struct(first.alias("at"), none.alias("list"))
        return F.aggregate(values, start, lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["list"], s["at"] + x).alias("list")))["list"]

    def stops_of(lengths: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.ceil(F.size(lengths) / run).cast("int") - 1), lambda r: F.slice(lengths, r * run + 1, run))
        zero = F.lit(0).cast("bigint")
        inner = F.transform(runs, lambda r: sums(r, zero))
        ends = F.transform(F.array(inner), lambda lists: sums(F.transform(lists, lambda x: F.element_at(x, -1)), zero))[0]
        return F.flatten(F.transform(inner, lambda x, i: F.transform(x, lambda stop: stop + F.when(i == 0, zero).otherwise(F.get(ends, i - 1)))))

    stops = F.transform(F.array(steps), stops_of)[0]
    kinds = F.array(*[F.lit(k) for k in KINDS])
    found = F.transform(
        stops,
        lambda stop, i: F.struct(
            F.get(kinds, F.char_length(F.get(pieces, 2 * i + 1)) - F.char_length(F.ltrim(F.get(pieces, 2 * i + 1), F.lit(_SLOT)))).alias("kind"),
            (stop - F.char_length(token(F.get(pieces, 2 * i + 1)))).alias("start"),
            stop.alias("stop"),
            token(F.get(pieces, 2 * i + 1)).alias("text"),
        ),
    )
    return F.when(n_tokens > 0, found).when(pieces.isNotNull(), F.array().cast("array<struct<kind:string,start:bigint,stop:bigint,text:string>>"))


def spans(rows: DataFrame, keys: list[str], text: str = "raw_text") -> DataFrame:
    """Rows (keys, kind, start, stop, text) of all tokens, by place (characters from 0, stop exclusive).

    A row gives its tokens by itself, without a shuffle.
    """
    return rows.select(*keys, places(text).alias("_places")).select(*keys, F.inline("_places"))

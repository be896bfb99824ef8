"""Column expressions on counters, rates and labels."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

_WRAP = 1 << 64
_SIGN = 1 << 63


def signed64(counter: Column) -> Column:
    """Read an unsigned 64-bit counter, kept as DECIMAL(20,0), as signed."""
    wide = counter.cast("decimal(20,0)")
    top = F.lit(str(_SIGN)).cast("decimal(20,0)")
    turn = F.lit(str(_WRAP)).cast("decimal(20,0)")
    return F.when(wide >= top, wide - turn).otherwise(wide).cast("bigint")


def rate_per_second(count: Column, elapsed_ns: Column) -> Column:
    """Events per second; 0 where no time passed."""
    return F.when(elapsed_ns > 0, count / (elapsed_ns / F.lit(1e9))).otherwise(F.lit(0.0))


def lateness(now: Column, deadline: Column) -> Column:
    return F.greatest(now - deadline, F.lit(0))


def null_if_nan(value: Column) -> Column:
    """NaN means "missing" at the edges; inside the library that is NULL."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def ratio(numerator: Column, denominator: Column) -> Column:
    return numerator / F.nullif(denominator, F.lit(0.0))


def fixed_text(value: Column, digits: int) -> Column:
    """The number with a fixed count of decimals; ``nan`` when missing.

    Rounds the double's exact binary value, ties to even, as C does. Spark's own
    formatting rounds its shortest decimal form, which differs near ties. The
    product with the power of ten is kept as a rounded part and its exact error.
    """
    scale = 10**digits

    def text(x: Column) -> Column:
        size = F.abs(x)
        high = size * F.lit(134217729.0) - (size * F.lit(134217729.0) - size)
        product = size * F.lit(float(scale))
        error = (size - high) * F.lit(float(scale)) - (product - high * F.lit(float(scale)))
        whole = F.floor(product)
        rest = product - whole
        up = (rest > 0.5) | (
            (rest == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1)))
        )
        units = whole + up.cast("bigint")
        shown = F.floor(units / scale).cast("string")
        if digits:
            decimals = F.lpad((units % scale).cast("string"), digits, "0")
            shown = F.concat_ws(".", shown, decimals)
        signed = F.concat(F.when(x < 0, "-").otherwise(""), shown)
        # From 2**52 on a double is a whole number.
        return F.when(size >= float(1 << 52) / scale, F.format_string(f"%.{digits}f", x)).otherwise(
            signed
        )

    number = value.cast("double")
    known = F.filter(F.array(number), lambda x: x.isNotNull() & ~F.isnan(x))
    return F.coalesce(F.get(F.transform(known, text), F.lit(0)), F.lit("nan"))


def ratio_label(numerator: Column, denominator: Column) -> Column:
    """``1.234x``; ``nan`` where either side is missing or the base is 0."""
    value = ratio(numerator, denominator)
    return F.when(value.isNull() | F.isnan(value), "nan").otherwise(
        F.concat(fixed_text(value, 3), F.lit("x"))
    )


def short_number(value: Column, digits: int = 1) -> Column:
    """Readable magnitude: 950.0, 1.5K, 2.3M."""
    size = F.abs(value)
    return (
        F.when(value.isNull() | F.isnan(value), "nan")
        .when(size >= 1e6, F.concat(fixed_text(value / 1e6, digits), F.lit("M")))
        .when(size >= 1e3, F.concat(fixed_text(value / 1e3, digits), F.lit("K")))
        .otherwise(fixed_text(value, digits))
    )


def span_label(first: Column, last: Column, separator: str = "-") -> Column:
    """Label of a CPU range (``2-3``) or pair (``0->1``)."""
    unknown = F.lit("?")
    return F.concat_ws(
        separator,
        F.coalesce(first.cast("string"), unknown),
        F.coalesce(last.cast("string"), unknown),
    )


_MASK = 0xFFFFFFFF
_HALF = 1 << 32


def _salt(seed: int, part: int) -> int:
    """A 32-bit constant, another one for each of 2**31 seeds and two parts."""
    return ((2 * seed + part) * 2654435761 + 374761393) & _MASK


def scatter32(ident: Column, seed: int = 0, part: int = 0) -> Column:
    """Pseudo-random number in [0, 2**32) that depends on id, seed and part alone.

    Rounds of multiply and xor-shift in BIGINT arithmetic: the same id gives the
    same number for any partitioning, on any engine. Seed and upper half of
    the id come in between rounds, so no stream is a shifted copy of another and ids
    that meet under one seed part under the next.
    """
    mask = F.lit(_MASK).cast("bigint")
    ident = ident.cast("bigint")

    def stirred(value: Column) -> Column:
        mixed = F.shiftright(value, 16).bitwiseXOR(value) * F.lit(73244475).cast("bigint")
        return mixed.bitwiseAND(mask)

    mixed = stirred(ident.bitwiseAND(mask))
    mixed = stirred(mixed.bitwiseXOR(F.lit(_salt(seed, part)).cast("bigint")))
    mixed = stirred(mixed.bitwiseXOR(F.shiftrightunsigned(ident, 32)))
    return F.shiftright(mixed, 16).bitwiseXOR(mixed)


def scatter32_sql(ident: str, seed: int = 0, part: int = 0) -> str:
    """:func:`scatter32` as SQL text, for checks on another engine."""

    def stirred(value: str) -> str:
        return f"((xor(({value}) >> 16, {value}) * 73244475) & {_MASK})"

    text = stirred(f"(({ident}) & {_MASK})")
    text = stirred(f"xor({text}, {_salt(seed, part)})")
    text = stirred(f"xor({text}, (({ident}) >> 32) & {_MASK})")
    return f"xor({text} >> 16, {text})"


def scatter63(ident: Column, seed: int = 0) -> Column:
    """Pseudo-random number in [0, 2**63), from two independent halves."""
    upper = F.shiftright(scatter32(ident, seed, 1), 1)
    return upper * F.lit(_HALF) + scatter32(ident, seed)


def scatter63_sql(ident: str, seed: int = 0) -> str:
    """:func:`scatter63` as SQL text."""
    return f"((({scatter32_sql(ident, seed, 1)}) >> 1) * {_HALF} + {scatter32_sql(ident, seed)})"


SKEW = 0.99


def _octaves(count: int, skew: float) -> list[tuple[int, int, int]]:
    """(threshold, first rank, ranks) of the ranges of ranks [2**k - 1, 2**(k + 1) - 1).

    A range's share of 2**32 is that of the law rank ** -skew over it; the threshold is
    the shares' sum so far.
    """

    def below(x: float) -> float:
        return math.log(x) if skew == 1 else x ** (1 - skew) / (1 - skew)

    ranges, first = [], 0
    while first < count:
        ranks = min(first + 1, count - first)
        ranges.append((first, ranks, below(first + ranks + 0.5) - below(first + 0.5)))
        first += ranks
    total, upto, found = sum(w for *_, w in ranges), 0.0, []
    for first, ranks, weight in ranges:
        upto += weight
        found.append((round(upto / total * _HALF), first, ranks))
    found[-1] = (_HALF, *found[-1][1:])
    return found


def skewed_rank(die: Column, draw: Column, count: int, skew: float = SKEW) -> Column:
    """A rank in [0, count), small ones the more often: P(rank) ~ (rank + 1) ** -skew.

    The inverse distribution by integers alone, so that any engine draws the same: ``die``,
    of :func:`scatter32`, picks a range of ranks that doubles in length, ``draw``, of
    :func:`scatter63`, a rank in it. Both should be plain columns, as they are used often.
    """
    rank = F.lit(0)
    for threshold, first, ranks in reversed(_octaves(count, skew)):
        rank = F.when(die < threshold, F.lit(first) + draw % F.lit(ranks)).otherwise(rank)
    return rank.cast("bigint")


def skewed_rank_sql(ident: str, seed: int, draw_seed: int, count: str, most: int = 40,
                    skew: float = SKEW) -> str:
    """:func:`skewed_rank` as SQL text; ``count`` is an expression below 2**``most``.

    A table of ranges is made from the count, with the rounding of the Python form.
    """
    below = (lambda x: f"ln({x})") if skew == 1 else (lambda x: f"pow({x}, {1 - skew}) / {1 - skew}")
    return f"""(SELECT first + ({scatter63_sql(ident, seed)}) % ranks FROM (
        SELECT first, ranks, CASE WHEN first + ranks = n THEN {_HALF} ELSE
                   round(sum(w) OVER (ORDER BY first) / sum(w) OVER () * {_HALF}) END AS threshold
        FROM (SELECT *, {below('first + ranks + 0.5')} - {below('first + 0.5')} AS w
              FROM (SELECT n, (1::BIGINT << k) - 1 AS first, least(1::BIGINT << k, n - (1::BIGINT << k) + 1) AS ranks
                    FROM (SELECT {count} AS n) c, generate_series(0, {most}) g(k)
                    WHERE (1::BIGINT << k) - 1 < n)))
        WHERE {scatter32_sql(ident, draw_seed)} < threshold ORDER BY first LIMIT 1)"""


def uniform_int(ident: Column, seed: int, low: int, high: int) -> Column:
    return F.lit(low) + scatter63(ident, seed) % F.lit(high - low + 1)


def uniform_double(ident: Column, seed: int, low: float, high: float) -> Column:
    """A double in [low, high) out of 2**53 even steps."""
    share = F.shiftright(scatter63(ident, seed), 10) / F.lit(float(1 << 53))
    return F.lit(float(low)) + share * F.lit(float(high - low))


def hex_text(ident: Column, length: int) -> Column:
    """A text of fixed length drawn from the id."""
    parts = [
        F.md5(F.concat_ws(":", ident.cast("string"), F.lit(str(part))))
        for part in range(-(-length // 32))
    ]
    return F.substring(F.concat(*parts), 1, length)

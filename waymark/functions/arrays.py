"""Column functions on arrays of steps. All stay within one row."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

CYCLE = 8  # steps in which a repeated pattern is looked for
FIRST_SYMBOL, MAX_SYMBOLS = 0x10000, 0x100000  # code points beyond the basic plane, where none is a surrogate


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(value: Column) -> Column:
    """A generator column holding value; filters above it do not get a copy of the expression."""
    return F.explode(F.array(value))


def decode_pipe(text: Column, drop_empty: bool = True) -> Column:
    parts = F.split(text, r"\|")
    return F.filter(parts, lambda s: s != "") if drop_empty else parts


def encode_pipe(steps: Column) -> Column:
    return F.array_join(steps, "|")


def cut_point(length: Column, fraction: Column) -> Column:
    """max(1, floor(length * fraction)), with a double fraction."""
    return F.greatest(F.lit(1), F.floor(length * fraction.cast("double"))).cast("int")


def head(steps: Column, n: Column) -> Column:
    return F.slice(steps, F.lit(1), n.cast("int"))


def rest(steps: Column, n: Column) -> Column:
    return F.slice(steps, n.cast("int") + 1, F.greatest(F.size(steps) - n.cast("int"), F.lit(0)))


def tail(steps: Column, n: int) -> Column:
    size = F.least(F.size(steps), F.lit(n))
    return F.slice(steps, F.size(steps) - size + 1, size)


def reconstruct(prefix: Column, prediction: Column) -> Column:
    """The whole sequence that a prediction stands for; a missing part is empty."""
    nothing = F.array().cast("array<string>")
    return F.concat(F.coalesce(prefix, nothing), F.coalesce(prediction, nothing))


def merged(*lists: Column) -> Column:
    """The lists behind one another, each value where it first occurs."""
    return F.array_distinct(F.concat(*lists))


def collapse(values: Column) -> Column:
    """Drop elements equal to the one before."""
    return let(values, lambda v: F.filter(v, lambda x, i: (i == 0) | (x != F.get(v, i - 1))))


def first_index(steps: Column, test: Callable[[Column], Column]) -> Column:
    """0-based position of the first element passing the test, or NULL."""
    found = F.array_position(F.transform(steps, lambda s: F.coalesce(test(s), F.lit(False))), True)
    return F.when(found > 0, (found - 1).cast("int"))


def remove_before(steps: Column, at: Column, drop: Callable[[Column], Column], window: int) -> Column:
    """Without the elements passing drop in the window before position at."""
    return let(at, lambda p: F.filter(steps, lambda s, i: ~((i >= p - window) & (i < p) & drop(s))))


def insert_at(steps: Column, at: Column, items: Column) -> Column:
    return F.concat(head(steps, at), items, rest(steps, at))


def drop_at(steps: Column, at: Column) -> Column:
    return let(at, lambda p: F.filter(steps, lambda s, i: i != p))


def move_before(steps: Column, source: Column, target: Column) -> Column:
    """Move the element at source in front of target; NULL unless target is earlier."""
    return let(F.struct(source.alias("s"), target.alias("t")), lambda p: F.when(
        p["s"] > p["t"], insert_at(drop_at(steps, p["s"]), p["t"], F.array(F.get(steps, p["s"])))))


def swap(steps: Column, a: Column, b: Column) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda p: F.transform(
        steps, lambda s, i: F.when(i == p["a"], F.get(steps, p["b"]))
        .when(i == p["b"], F.get(steps, p["a"])).otherwise(s)))


def equal_rate(a: Column, b: Column) -> Column:
    """Number of positions, up to the shorter length, with equal elements."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(head(a, n), head(b, n), lambda x, y: x == y)
    return F.size(F.filter(pairs, lambda x: x))


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance between two arrays, one element being one token.

    Tokens of both arrays are numbered within the row and written as one character
    each, for the built-in levenshtein. A token of one array alone never matches, so
    all such tokens of an array share one character, and only tokens in common need
    characters of their own: there are more than a million.
    """
    def text(values: Column, symbols: Column, other: int) -> Column:
        place = lambda x: F.array_position(symbols, x)
        codes = F.transform(values, lambda x: let(place(x), lambda p: F.lpad(F.hex(F.when(p > 0, p + 1).otherwise(other) + FIRST_SYMBOL), 8, "0")))
        return F.decode(F.unhex(F.array_join(codes, "")), "UTF-32")

    return let(F.array_intersect(a, b), lambda symbols: F.when(
        F.size(symbols) > MAX_SYMBOLS - 2, F.raise_error(F.lit("more than a million tokens in common")).cast("int"))
        .otherwise(F.levenshtein(text(a, symbols, 0), text(b, symbols, 1))))


def edit_rate(a: Column, b: Column) -> Column:
    """Edit distance over the longer length; 0 for two empty arrays."""
    longest = F.greatest(F.size(a), F.size(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(edit_distance(a, b) / longest)


def cycle_ends(recent: Column) -> Column:
    """The steps that behind the last CYCLE - 1 ones make is_cycling true; fewer ones have none."""
    def periodic(p: int) -> Column:
        return F.slice(recent, 1, CYCLE - 1 - p) == F.slice(recent, p + 1, CYCLE - 1 - p)
    ends = F.filter(F.array(*[F.when(periodic(p), F.get(recent, F.lit(CYCLE - 1 - p))) for p in (1, 2, 3, 4)]), lambda x: x.isNotNull())
    return F.when(F.size(recent) == CYCLE - 1, ends).otherwise(F.array().cast("array<string>"))


def is_cycling(generated: Column, span: int = CYCLE) -> Column:
    """True if the last span elements repeat with period 1 to 4."""
    def repeats(last: Column) -> Column:
        # a period of p: without its first p elements it is the same as without its last p
        periods = [F.slice(last, 1, span - p) == F.slice(last, p + 1, span - p) for p in (1, 2, 3, 4) if p < span]
        # as before, a missing element is equal to nothing
        return reduce(or_, periods) & ~F.exists(last, lambda x: x.isNull())
    return F.when(F.size(generated) < span, F.lit(False)).otherwise(let(tail(generated, span), repeats))


def pad(values: Column, size: Column, filler: Column) -> Column:
    return F.concat(values, F.array_repeat(filler, (size - F.size(values)).cast("int")))


def mask_of(values: Column, size: Column) -> Column:
    return F.concat(F.array_repeat(F.lit(1), F.size(values)),
                    F.array_repeat(F.lit(0), (size - F.size(values)).cast("int")))


def multi_hot(names: list[str], value: Column) -> Column:
    return F.array(*[F.coalesce((value == n).cast("float"), F.lit(0.0).cast("float")) for n in names])


def content_key(**fields: Column) -> Column:
    """md5 of the JSON object with its keys in order."""
    return F.md5(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])))

"""Many patterns in one pass (JOI-5 without a nested loop): one automaton over literals, sent to the executors once, run over Arrow batches of texts.

A literal that must stand in a text as it is, is settled by the automaton alone. A regular expression hands over literals of which each of its matches must contain one; where one of them occurs, in any
case, the expression is a candidate, and only then does Spark evaluate it, by an equi-join on its number. An expression without such literals is a candidate for every text, so nothing is missed.
The time of a pass follows the texts and what occurs in them, and hardly the number of patterns.
"""

from __future__ import annotations

import pickle
import re
import re._constants as rc
import re._parser as rp  # the parse tree of a pattern: read, never built
import warnings
from collections.abc import Callable, Iterable
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from auditlake.session import ship

#: Bytes of an automaton that may be sent to every executor.
MOST_BYTES = 256 << 20
SEEN = "struct<exact:array<int>,maybe:array<int>>"
#: Flags of the JVM before a pattern, and what its dialect reads otherwise than Python's (quotes, octal numbers, classes in classes).
_FLAGS, _OTHERWISE = re.compile(r"^\(\?([a-zA-Z]+)\)"), re.compile(r"\\[QE0-9cepPhHRNGzZxXv]|&&|\[[^\]]*\[|#\s")


@cache
def _folds() -> dict[int, str]:
    """Code points that are not what they are compared as when case does not matter."""
    out = {}
    for c in range(0x1F000):
        up = chr(c).upper()
        low = (up if len(up) == 1 else chr(c)).lower()[:1]
        if low != chr(c):
            out[c] = low
    return out


def fold(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_folds())


def required(pattern: str) -> frozenset[str] | None:
    """Literals of which every match has one (case aside); None if there are none that are sure."""
    flags = _FLAGS.match(pattern)
    if flags and "x" in flags[1]:
        return None
    body = pattern[flags.end() :] if flags else pattern
    if _OTHERWISE.search(body):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            tree = rp.parse(body)
    except Exception:  # not Python's dialect
        return None
    return None if tree.state.flags & re.VERBOSE else _of(tree)


def _of(items: Iterable) -> frozenset[str] | None:
    best: frozenset[str] | None = None
    run: list[str] = []

    def offer(found: frozenset[str] | None) -> None:
        nonlocal best
        if found and (best is None or min(map(len, found)) > min(map(len, best))):
            best = found

    def cut() -> None:
        if run:
            offer(frozenset(["".join(run)]))
            run.clear()

    for op, value in items:
        if op is rc.LITERAL:
            run.append(chr(value))
            continue
        cut()
        if op is rc.SUBPATTERN:
            offer(_of(value[3]))
        elif op is rc.BRANCH:
            each = [_of(x) for x in value[1]]
            offer(frozenset().union(*each) if all(each) else None)
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT) and value[0] >= 1:
            offer(_of(value[2]))
        elif op is rc.ATOMIC_GROUP:
            offer(_of(value))
    cut()
    return best


class Scanner:
    """exact: (number, literal, place): place is None, or what the text's own place must be. patterns: (number, regular expression)."""

    def __init__(self, exact: list[tuple[int, str, str | None]], patterns: list[tuple[int, str]]):
        self.everywhere = [(k, place) for k, literal, place in exact if literal == ""]
        self.exact, self.exact_of = self._built([(x, (k, place)) for k, x, place in exact if x])
        some = [(k, required(rx)) for k, rx in patterns]
        self.always = sorted(k for k, found in some if not found)
        self.maybe, self.maybe_of = self._built([(fold(x), k) for k, found in some for x in found or ()])

    @staticmethod
    def _built(pairs: list[tuple[str, object]]) -> tuple[ahocorasick.Automaton | None, list[list]]:
        of: dict[str, list] = {}
        for literal, what in pairs:
            of.setdefault(literal, []).append(what)
        if not of:
            return None, []
        a = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for n, literal in enumerate(of):
            a.add_word(literal, n)
        a.make_automaton()
        return a, list(of.values())

    def __call__(self, text: str | None, place: str | None) -> dict[str, list[int]]:
        if text is None:
            return {"exact": [], "maybe": []}
        exact = {k for k, at in self.everywhere if at is None or at == place}
        if self.exact is not None:
            exact |= {k for n in {n for _, n in self.exact.iter(text)} for k, at in self.exact_of[n] if at is None or at == place}
        maybe = set(self.always)
        if self.maybe is not None:
            maybe |= {k for n in {n for _, n in self.maybe.iter(fold(text))} for k in self.maybe_of[n]}
        return {"exact": sorted(exact), "maybe": sorted(maybe)}


def scanning(spark: SparkSession, exact: list[tuple[int, str, str | None]], patterns: list[tuple[int, str]]) -> Callable[..., Column] | None:
    """f(text[, place]) -> SEEN: numbers of the literals that stand in it (at their place), and of the expressions that may match. None if the automaton is too large to be sent."""
    scanner = Scanner(exact, patterns)
    if len(pickle.dumps(scanner)) > MOST_BYTES:
        return None
    ship(spark)
    sent = spark.sparkContext.broadcast(scanner)

    @F.arrow_udf(SEEN)
    def seen(text: pa.Array, place: pa.Array) -> pa.Array:
        f = sent.value
        return pa.array([f(t.as_py(), p.as_py()) for t, p in zip(text, place, strict=True)], pa.struct([("exact", pa.list_(pa.int32())), ("maybe", pa.list_(pa.int32()))]))

    return lambda text, place=None: seen(text, F.lit(None).cast("string") if place is None else place)


def constant(values: object, schema: str) -> Column:
    """A constant array, however long, as one expression."""
    import json

    return F.from_json(F.lit(json.dumps(values, ensure_ascii=False)), schema)

"""What a text must hold for a regular expression to match it: literals that are looked for before the expression is tried."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable
from functools import reduce
from re import _constants as K, _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Literals that one guard may ask for, and how rare the least rare of them must be: fixed values.
MOST, RARE = 12, 2.0
#: Syntax that Java reads in another way than Python: no guard is drawn from such expressions.
OTHER = re.compile(r"&&|\\[pPRhHQEGXzkK]|\(\?[a-zA-Z]*[UumxdL]")
#: A class inside a class, once escaped characters are left out.
NESTED = re.compile(r"\[[^\]]*\[")


def _weight(text: str) -> float:
    """How rare a literal is in prose: letters and digits one each, signs more, blanks and stops next to nothing."""
    return sum(0.1 if c in " .,\n" else 1.0 if c.isalnum() or c == "'" else 1.5 if c == "-" else 2.0 for c in text)


def _alternatives(nodes, weight: Callable[[str], float] = _weight) -> list[tuple[str, ...]]:
    """Sets of literals of a sequence of nodes; of each set one must be in whatever the sequence matches."""
    sets: list[tuple[str, ...]] = []
    run = ""

    def end() -> None:
        nonlocal run
        if run:
            sets.append((run,))
        run = ""

    for op, arg in nodes:
        if op is K.LITERAL:
            run += chr(arg)
            continue
        if op is K.SUBPATTERN and not arg[1] and not arg[2]:
            inner = list(arg[3])
            if all(o is K.LITERAL for o, _ in inner):
                run += "".join(chr(a) for _, a in inner)
                continue
            end()
            sets += _alternatives(inner, weight)
            continue
        if run and op is K.IN and len(arg) <= 6 and all(o is K.LITERAL for o, _ in arg):
            sets.append(tuple(run + chr(a) for _, a in arg))
        end()
        if op is K.IN and all(o is K.LITERAL for o, _ in arg):
            sets.append(tuple(chr(a) for _, a in arg))
        elif op is K.BRANCH:
            each = [_best(_alternatives(list(b), weight), weight) for b in arg[1]]
            if all(each):
                sets.append(tuple(x for b in each for x in b))
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[0] > 0:
            sets += _alternatives(list(arg[2]), weight)
        elif op is K.ATOMIC_GROUP:
            sets += _alternatives(list(arg), weight)
    end()
    return sets


def _best(sets: list[tuple[str, ...]], weight: Callable[[str], float] = _weight) -> tuple[str, ...]:
    fit = [s for s in sets if len(s) <= MOST]
    return max(fit, key=lambda s: (min(map(weight, s)), -len(s)), default=())


def _parsed(pattern: str):
    """The pattern's tree; None where Java may read it in another way."""
    if OTHER.search(pattern) or NESTED.search(re.sub(r"\\.", "", pattern)) or re.search(r"\(\?[a-zA-Z]+", pattern[1:]):  # flags inside, or in Java's way
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return _parser.parse(pattern)
    except (re.error, OverflowError):
        return None


def literals(pattern: str) -> tuple[tuple[str, ...], bool]:
    """Literals of which one is in every match of the pattern, and whether they are meant in lower case; none where that can't be told."""
    tree = _parsed(pattern)
    if tree is None:
        return (), False
    folded = bool(tree.state.flags & re.IGNORECASE)
    chosen = _best(_alternatives(list(tree)))
    if not chosen or min(map(_weight, chosen)) < RARE or folded and not all(c.isascii() for x in chosen for c in x):
        return (), False
    return tuple(dict.fromkeys(x.lower() if folded else x for x in chosen)), folded


#: Signs that prose seldom has: a fixed value.
SIGNS = "@=:!+|(){}[]$<>*&%#^~`\\_"


def _sign(text: str) -> str:
    """The first sign of a literal that prose seldom has, or none."""
    return next((c for c in text if c in SIGNS), "")


def signs(pattern: str) -> tuple[str, ...]:
    """Signs of which one is in every match of the pattern; none where that can't be told."""
    tree = _parsed(pattern)
    chosen = _best(_alternatives(list(tree), lambda x: float(bool(_sign(x)))), lambda x: float(bool(_sign(x)))) if tree is not None else ()
    return tuple(dict.fromkeys(map(_sign, chosen))) if all(map(_sign, chosen)) else ()


#: Expressions over digits, with or without ends that are none: (what the pattern says, what a text must then hold).
DIGITS = ((r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", r"[0-9]\.[0-9]"), (r"[0-9]{13,19}", r"[0-9]{13}"))


def digits(pattern: str) -> str:
    """What a text must hold for an expression over digits to match it, as an expression; empty for others."""
    for said, must in DIGITS:
        if re.fullmatch(r"(?:\(\?:\^\|\[\^[0-9.-]*\]\))?" + re.escape(said) + r"(?:\(\?:\[\^[0-9.-]*\]\|\$\))?", pattern):
            return must
    return ""


def guard(pattern: str, text: Column, lowered: Column) -> Column | None:
    """May the pattern match the text? lowered: the text in lower case. None where nothing is asked."""
    asked = []
    some, folded = literals(pattern)
    first = signs(pattern)
    if first and first != some:
        asked.append(reduce(lambda a, b: a | b, (F.contains(text, F.lit(x)) for x in first)))
    if some:
        asked.append(reduce(lambda a, b: a | b, (F.contains(lowered if folded else text, F.lit(x)) for x in some)))
    elif must := digits(pattern):
        asked.append(F.rlike(text, F.lit(must)))
    return reduce(lambda a, b: a & b, asked) if asked else None

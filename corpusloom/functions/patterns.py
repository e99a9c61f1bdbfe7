"""Many literals looked for in one pass over a text."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

#: From this many literals on they are looked for together.
MANY = 16
_automata: dict[tuple[str, ...], ahocorasick.Automaton] = {}


def _automaton(literals: tuple[str, ...]) -> ahocorasick.Automaton:
    """The automaton of these literals, built once in a process."""
    if literals not in _automata:
        found = ahocorasick.Automaton()
        for i, word in enumerate(literals):
            if word and word not in found:
                found.add_word(word, i)
        found.make_automaton()
        _automata[literals] = found
    return _automata[literals]


def literals_in(c, literals) -> Column:
    """array<int>: the numbers of the literals that a text holds, ascending; case matters. A repeated literal has its first number, an empty one isn't found, and a null text holds none."""
    words = tuple(literals)

    @F.arrow_udf(ArrayType(IntegerType()))
    def find(text: pa.Array) -> pa.Array:
        automaton = _automaton(words)
        texts = text.to_pylist()
        return pa.array([sorted({i for _, i in automaton.iter(t)}) if t and len(automaton) else [] for t in texts], pa.list_(pa.int32()))

    return find(c)


def contains_any(c, literals) -> Column:
    """Whether a text holds one of the literals; few are compared one after the other, many in one pass."""
    words = [w for w in literals if w]
    if len(words) >= MANY:
        return F.size(literals_in(c, words)) > 0
    return F.exists(F.array(*(F.lit(w) for w in words)).cast("array<string>"), lambda w: F.contains(F.coalesce(c, F.lit("")), w))

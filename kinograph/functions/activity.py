"""Keys of action phrases: forms of one verb get the same key, which need not be a word."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms whose key follows no rule, words that are left out before the verb, and phrases without an activity.
IRREGULAR = {
    "ran": "run", "sat": "sit", "ate": "eat", "stood": "stand", "held": "hold", "fell": "fall",
    "went": "go", "took": "take", "gave": "give", "made": "make", "threw": "throw", "drove": "drive",
    "flew": "fly", "fought": "fight", "caught": "catch", "shot": "shoot", "hit": "hit", "put": "put",
    "cut": "cut", "set": "set", "lay": "lie", "lying": "lie", "dying": "die", "tying": "tie",
}
SKIPPED = ("is", "are", "was", "were", "be", "being", "been", "a", "an", "the", "to")
EMPTY = ("unknown", "none", "nothing")


def _let(value: Column, step: Callable[[Column], Column]) -> Column:
    """``step`` of a value that is computed once, however often the step names it."""
    return F.element_at(F.transform(F.array(value), step), 1)


def _regular(word: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in IRREGULAR.items() for x in pair))
    return F.coalesce(F.try_element_at(table, word), word)


def _shorter(word: Column, letters: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - letters)


def _without_ending(word: Column) -> Column:
    long = F.length(word) > 4
    return (
        F.when(word.endswith("ing") & long, _shorter(word, 3))
        .when(word.endswith("ies") & long, F.concat(_shorter(word, 3), F.lit("y")))
        .when(word.rlike("(?:s|x|z|ch|sh)es$"), _shorter(word, 2))
        .when(word.endswith("s") & ~word.endswith("ss") & (F.length(word) > 3), _shorter(word, 1))
        .when(word.endswith("ed") & long, _shorter(word, 2))
        .otherwise(word)
    )


def _without_e(word: Column) -> Column:
    return F.when(word.endswith("e") & (F.length(word) > 2), _shorter(word, 1)).otherwise(word)


def _undoubled(word: Column) -> Column:
    return F.when(word.rlike(r"^.+([^aeiou])\1$"), _shorter(word, 1)).otherwise(word)


def _key(verb: Column) -> Column:
    steps = (_regular, _without_ending, _regular, _without_e, _undoubled)
    return F.when(~verb.isin(*EMPTY), reduce(_let, steps, verb))


def activity_key(phrase: Column) -> Column:
    """The key of an action phrase, null if it names no activity.

    Of the lower-case tokens, markers of a letter and digits (``p1``) and skipped words are dropped; the first one left is the
    verb. Irregular forms are looked up, one ending is taken off, and a last ``e`` and a doubled last consonant are undone.
    """
    tokens = F.regexp_extract_all(F.lower(phrase), F.lit(r"([a-z]+\d*)"), 1)
    verbs = F.filter(tokens, lambda t: ~t.rlike(r"^[a-z]\d+$") & ~t.isin(*SKIPPED))
    return _let(F.try_element_at(verbs, F.lit(1)), _key)

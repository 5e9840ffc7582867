"""What a finding says: one sentence for each rule that detectors, dictionaries or reviews report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L

MESSAGES = {
    "1.1": "This word isn't approved here.",
    "1.2": "This word is approved, but not as this part of speech.",
    "1.3": "This word is approved, but not in this sense.",
    "1.4": "This form of the word isn't approved.",
    "1.14": "This is not the American spelling.",
    "2.1": "Too many nouns stand in a row.",
    "3.2": "This tense is not permitted.",
    "3.4": "This verb group has too many parts.",
    "3.5": "An -ing form stands where a plain verb is needed.",
    "3.6": "Say who or what acts.",
    "3.7": "A noun hides the action; a verb is clearer.",
    "4.2": "Write the words out.",
    "4.5": "An article is missing.",
    "5.1": "The instruction is too long.",
    "5.2": "The sentence gives more than one instruction.",
    "5.3": "The instruction is not a command.",
    "5.4": "The condition comes after the instruction.",
    "5.5": "A note gives an instruction.",
    "6.3": "The sentence is too long.",
    "6.6": "The paragraph has too many sentences.",
    "7.1": "The signal word doesn't fit the risk.",
    "7.2": "The safety text starts with neither a command nor a condition.",
    "7.3": "The safety text doesn't name the risk.",
    "8.1": "A semicolon joins two sentences.",
    "9.3": "The verb and its particle have a meaning of their own.",
    "GR-1": "The word 'that' is missing.",
    "GR-4": "It's not clear what 'this' stands for.",
    "GR-6": "A Latin abbreviation stands for plain words.",
    "GR-7": "The word leaves people out.",
    "HS": "The phrase is longer than it must be.",
}


def message(rule: Column, fix: Column) -> Column:
    """The rule's sentence, with the replacement if there is one; rules that only people judge have a general one."""
    known = F.create_map(*(F.lit(x) for r in L.TIER for x in (r, MESSAGES.get(r, f"A reader found that rule {r} isn't kept."))))
    said = F.coalesce(F.try_element_at(known, rule), F.concat(F.lit("Rule "), rule, F.lit(" isn't kept.")))
    return F.when(F.coalesce(fix, F.lit("")) == "", said).otherwise(F.concat(said, F.lit(" Use: "), fix, F.lit(".")))

"""Own sentences with the findings they must give, for queries over many generated documents.

Each line: detector | sentence ({k} stands for a part's key) | findings "rule conf quote", separated by " / ". The quote "*" is the
whole sentence; "2:x" is the second x. No finding: "-".
"""

from __future__ import annotations

LINES = r"""
sentence_length | Move the first lever of the left unit in the lower bay to the rear until the small lamp near part {k} comes on again. | 5.1 high *
sentence_length | Move the lever of part {k}. | -
semicolons | Stop the pump; read the label of part {k}; wait. | 8.1 high ; / 8.1 high 2:;
contractions | You can't move part {k}. | 4.2 high can't
contractions | Let's move part {k}. | 4.2 high Let's
contractions | The pump's seal fits part {k}. | -
latin | Use a solvent, e.g. alcohol, on part {k}. | GR-6 high e.g.
latin | Clean the seals etc. of part {k}. | GR-6 high etc.
complex_verbs | The seal of part {k} has been hot. | 3.4 high has been
complex_verbs | The part {k} is being cold. | 3.4 high is being
complex_verbs | We are going to test part {k}. | 3.4 high are going to
complex_verbs | They used to clean part {k}. | 3.4 high used to
complex_verbs | The tool is used to clean part {k}. | -
complex_verbs | It should have stopped near part {k}. | 3.4 high should have stopped
tenses | The pump has stopped the flow to part {k}. | 3.2 high has stopped
tenses | The pump is turning near part {k}. | 3.2 high is turning
tenses | The label of part {k} is missing. | -
make_sure | Make sure the valve of part {k} is shut. | GR-1 high Make sure
make_sure | Make sure that the valve of part {k} is shut. | -
spelling | The colour of part {k} is grey. | 1.14 high colour / 1.14 high grey
spelling | Initialise part {k}. | 1.14 high Initialise
meanings | Wait about 20 seconds near part {k}. | 1.3 high about
meanings | Follow the instructions for part {k}. | 1.3 high Follow
meanings | Read about the seal of part {k}. | -
inclusive | The operator moves his tool to part {k}. | GR-7 high his
inclusive | Two men move part {k}. | GR-7 low men
substitutions | Utilize the tool on part {k}. | 1.1 high Utilize
substitutions | Use a lamp instead of part {k}. | 1.1 high instead of
substitutions | In order to stop part {k}, push the knob. | HS high In order to
substitutions | Turn it on near part {k}. | 9.3 high Turn it on
substitutions | Go to Main Street with part {k}. | -
ing_forms | Stop the pump before removing part {k}. | 3.5 high removing
ing_forms | Use a tool for cleaning part {k}. | 3.5 low cleaning
ing_forms | The ceiling is above part {k}. | -
passive | The valve of part {k} was turned by the operator. | 3.6 high was turned
passive | The valve of part {k} must be turned. | 3.6 high be turned
passive | The valve of part {k} is closed. | -
nominals | Perform an inspection of part {k}. | 3.7 low Perform an inspection of
nominals | Take the position of part {k}. | -
phrasal | They turn up the heat of part {k}. | 9.3 low turn up
phrasal | They push up the lid of part {k}. | -
noun_clusters | The fuel pump motor bracket holds part {k}. | 2.1 low fuel pump motor bracket
noun_clusters | The pump motor holds part {k}. | -
two_instructions | Turn the knob and remove part {k}. | 5.2 low and remove
two_instructions | Push and hold part {k}. | -
imperative | You must close part {k}. | 5.3 low You must
condition_first | Open the lid if the lamp of part {k} is on. | 5.4 low if
condition_first | Check if part {k} is hot. | -
note_instruction | NOTE: Close the lid of part {k}. | 5.5 low Close the lid of part {k}.
safety_start | WARNING: The lid of part {k} is hot. | 7.2 high The
safety_start | CAUTION: Do not touch part {k}. | -
safety_reason | CAUTION: Do not touch part {k}. | 7.3 low Do not touch part {k}.
safety_reason | CAUTION: Do not touch the hot part {k}. | -
signal_word | CAUTION: Part {k} is a danger to your skin. | 7.1 low skin
articles | Remove cover of part {k}. | 4.5 low cover
articles | Remove the cover of part {k}. | -
articles | Open valve 3 of part {k}. | -
this_alone | This is part {k}. | GR-4 low This
this_alone | This part {k} is hot. | -
""".strip().splitlines()


def cases() -> list[tuple[int, str, str, list[tuple[str, str, str, int]]]]:
    """(number, detector, sentence, [(rule, conf, quote, which occurrence of the quote)])."""
    out = []
    for n, line in enumerate(LINES):
        detector, sentence, wanted = (x.strip() for x in line.split(" | "))
        found = []
        for item in [] if wanted == "-" else wanted.split(" / "):
            rule, conf, quote = item.split(" ", 2)
            found.append((rule, conf, quote.removeprefix("2:"), 2 if quote.startswith("2:") else 1))
        out.append((n, detector, sentence, found))
    return out

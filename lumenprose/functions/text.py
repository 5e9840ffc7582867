"""Column functions on text: matches with offsets, masks, tokens, sentences, word counts.

Spark has no function that gives matches with their places. ``matches`` puts marks around each match, splits at the marks
and sums lengths, all in one expression. The marks (U+0001, U+0002) are blanked at ingest, see ``clean``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L

MARK, PART = "\u0001", "\u0002"
TOKEN = r"(?U)\w[\w'.\-/]*\w|\w"
#: Unicode classes, and only a line feed ends a line.
FLAGS = "(?Ud)"
#: Parts of a text in one chunk of ``matches``; an even number.
CHUNK = 512
SPAN = "array<struct<start:int,end:int,text:string,g:array<string>>>"
CONDITION = r"(?Udi)^(?:if|when|before|after|while|unless|until|once|during|for|to|in case|as soon as)\b[^,]{0,120},\s*"


def clean(text: Column) -> Column:
    """Line ends as LF, the marks as blanks, null as empty."""
    return F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), MARK + PART, "  ")


def either(words: list[str]) -> str:
    """An alternation of literal words, longer ones first. Beginnings in common are written once, so that few branches are
    tried at a place; of words that begin alike, the longer one is still tried first."""
    return tree([list(w) for w in words], lambda c: r"\." if c == "." else c)


def tree(words: list[list[str]], written: Callable[[str], str]) -> str:
    """An alternation of words, each a list of units; ``written`` gives a unit's pattern. See ``either``."""
    root: dict = {}
    for w in words:
        at = root
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def rest(node: dict) -> str:
        branches = []
        for c in sorted(k for k in node if k):
            head = written(c)
            below = node[c]
            while len(below) == 1 and "" not in below:
                c = next(iter(below))
                head, below = head + written(c), below[c]
            branches.append(head + rest(below))
        if not branches:
            return ""
        body = "|".join(branches)
        if "" in node:
            return f"(?:{body})?"
        return f"(?:{body})" if len(branches) > 1 else body

    out = rest(root)
    return out[3:-1] if out.startswith("(?:") and out.endswith(")") and "" not in root and len(root) > 1 else out


def matches(text: Column, rx: str, groups: int = 0, shown: str = "$0", sure: bool = False) -> Column:
    """Non-overlapping matches of ``rx``: array<struct<start, end, text, g>>; g holds the groups 1..groups (empty if unset).

    ``sure``: the text is known to match, so it isn't tested again.
    """
    marked = F.regexp_replace(text, F.lit(rx), F.lit(MARK + shown + "".join(f"{PART}${k}" for k in range(1, groups + 1)) + MARK))
    parts = F.split(marked, MARK)
    empty = F.array().cast(SPAN)

    def step(acc: Column, part: Column) -> Column:
        fields = F.split(part, PART)
        size = F.length(F.get(fields, F.lit(0)))
        found = F.struct(acc["at"].alias("start"), (acc["at"] + size).alias("end"), F.get(fields, F.lit(0)).alias("text"), F.slice(fields, 2, groups).alias("g") if groups else F.array().cast("array<string>").alias("g"))
        return F.struct((acc["at"] + F.when(acc["odd"], size).otherwise(F.length(part))).alias("at"), (~acc["odd"]).alias("odd"), F.when(acc["odd"], F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).alias("out"))

    # matches are gathered by chunks, so that a text with very many of them isn't copied once for each
    def chunk(acc: Column, first: Column) -> Column:
        zero = F.struct(acc["at"].alias("at"), F.lit(False).alias("odd"), empty.alias("out"))
        return let(F.aggregate(F.slice(parts, first + 1, F.lit(CHUNK)), zero, step), lambda c: F.struct(c["at"].alias("at"), F.concat(acc["out"], c["out"]).alias("out")))

    firsts = F.sequence(F.lit(0), F.size(parts) - 1, F.lit(CHUNK))
    folded = F.aggregate(firsts, F.struct(F.lit(0).alias("at"), empty.alias("out")), chunk, lambda acc: acc["out"])
    return folded if sure else F.when(text.rlike(rx), folded).otherwise(empty)


def tokens(masked: Column) -> Column:
    return matches(masked, TOKEN, sure=True)


def token_at(toks: Column, i: Column | int) -> Column:
    return F.get(toks, i if isinstance(i, Column) else F.lit(i))


def prev_word(masked: Column, at: Column) -> Column:
    """The last token before ``at``, lower case; empty if there is none."""
    return F.lower(F.coalesce(F.try_element_at(F.regexp_extract_all(F.substring(masked, F.lit(1), at), F.lit(TOKEN), F.lit(0)), F.lit(-1)), F.lit("")))


def next_word(masked: Column, at: Column) -> Column:
    return F.lower(F.regexp_extract(F.substring(masked, at + 1, F.length(masked)), TOKEN, 0))


def clause_start(masked: Column) -> Column:
    """Where the main clause starts: after blanks and one leading condition."""
    body = F.regexp_replace(masked, r"(?U)^\s+", "")
    return F.length(masked) - F.length(body) + F.length(F.regexp_extract(body, CONDITION, 0))


def first_token(masked: Column) -> Column:
    """Where the main clause's first token starts; -1 without one."""
    at = clause_start(masked)
    rest = F.substring(masked, at + 1, F.length(masked))
    return F.when(rest.rlike(TOKEN), at + F.length(F.regexp_extract(rest, r"(?Us)^(.*?)(?:\w)", 1))).otherwise(F.lit(-1))


#: The first two tokens of the main clause.
_HEAD = r"(?Ud)^\s*(?:(?i:if|when|before|after|while|unless|until|once|during|for|to|in case|as soon as)\b[^,]{0,120},\s*)?+\W*(\w(?:[\w'.\-/]*\w)?)(?:\W*(\w(?:[\w'.\-/]*\w)?))?"


def is_imperative(masked: Column) -> Column:
    """Whether the main clause starts with a command verb, or with "you" and a verb of duty."""
    first, second = (F.lower(F.regexp_extract(masked, _HEAD, k)) for k in (1, 2))
    return first.isin(L.VERBS) | ((first == "you") & second.isin("must", "should", "need", "have"))


def is_participle(word: Column) -> Column:
    w = F.lower(word)
    regular = w.endswith("ed") & (F.length(w) >= 4) & ~w.isin(L.ED_OTHER) & (~w.endswith("eed") | w.isin("agreed", "freed", "guaranteed", "decreed"))
    return w.isin(L.PARTICIPLES) | regular


def is_ing(word: Column) -> Column:
    w = F.lower(word)
    return w.endswith("ing") & (F.length(w) > 4) & ~w.isin(L.ING_OTHER) & w.rlike("[aeiouy].*ing$")


def is_adverb(lower: Column) -> Column:
    return lower.endswith("ly") & (F.length(lower) > 3) & ~lower.isin(L.LY_NOUNS)


def is_placeholder(token: Column) -> Column:
    return token.rlike("^_+$")


def starts_upper(x: Column) -> Column:
    return x.rlike(r"^[\p{Lu}\p{Lt}]")


def keep_case(source: Column, fix: Column) -> Column:
    return F.when(starts_upper(source), F.concat(F.upper(F.substring(fix, 1, 1)), F.substring(fix, F.lit(2), F.length(fix)))).otherwise(fix)


_MASKED = (
    r"(?Udm)(`+).+?\1|<!--.*?-->|<(?:https?://|mailto:)[^>\s]+>|!\[[^\]\n]*\]\([^)\n]*\)|\]\([^)\s]*(?:\s+\"[^\"\n]*\")?\)|\]\[[^\]\n]*\]"
    r"|\[\^[^\]\n]+\]|(?:https?://|www\.)[^\s<>()\[\]]*[^\s<>()\[\].,;:!?'\"]|</?[A-Za-z][\w\-]*(?:\s[^<>\n]*)?/?>"
    r"|&(?:[A-Za-z]+|#\d+|#x[0-9A-Fa-f]+);|\[(?=[^\]\n]*\][(\[])|^\[[ xX]\](?=\s)|\*\*|__|~~|(?<![\w*])\*(?=\S)|(?<=\S)\*(?![\w*])|(?<!\w)_(?=[^\s_])|(?<=[^\s_])_(?!\w)"
)
_HINT = r"[`<!\]\[&*_~]|https?://|www\."


def mask(text: Column) -> Column:
    """The text with markup as blanks, code and addresses as underscores, and plain quotes; of the same length."""
    parts = F.split(F.regexp_replace(text, F.lit(_MASKED), F.lit(MARK + "$0" + MARK)), MARK)

    def part(x: Column, i: Column) -> Column:
        held = x.rlike(r"^(?:`|<(?:https?://|mailto:)|https?://|www\.)")
        return F.when(i % 2 == 0, x).otherwise(F.repeat(F.when(held, F.lit("_")).otherwise(F.lit(" ")), F.length(x)))

    done = F.when(text.rlike(_HINT), F.array_join(F.transform(parts, part), "")).otherwise(text)
    return F.translate(done, "’‘“” ", "''\"\" ")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` needs it inside of lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


_SHORT = "|".join(w.replace(".", r"\.") for w in L.NO_SPLIT)
#: A sentence's end. A full stop behind an abbreviation is none; the letters before it are ASCII letters and dots.
_END = rf"(?Ud)(?:\.(?<!(?:^|[^A-Za-z.])\.{{0,3}}(?i:{_SHORT})\.{{0,2}}\.)|[!?])(?<![.!?][.!?])[.!?]*[\"')\]]*(?=\s+[\"'(\[]*[A-Z0-9_])|:(?=[ \t]*\n)"


def sentences(masked: Column) -> Column:
    """A text cut behind the ends of its sentences; the pieces together are the text."""
    return F.split(F.regexp_replace(masked, F.lit(_END), F.lit("$0" + MARK)), MARK)


def cut_alike(text: Column, pieces: Column) -> Column:
    """``text`` cut into pieces as long as the given ones."""
    zero = F.struct(text.alias("rest"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(pieces, zero, lambda s, p: F.struct(F.substring(s["rest"], F.length(p) + 1, F.length(s["rest"])).alias("rest"), F.concat(s["out"], F.array(F.substring(s["rest"], F.lit(1), F.length(p)))).alias("out")), lambda s: s["out"])


def top_spans(masked: Column) -> Column:
    """Top-level spans in round brackets and double quotes; an unclosed one is no span."""
    zero = F.struct(F.lit(0).alias("depth"), F.lit(-1).alias("open"), F.lit(-1).alias("quote"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(s: Column, m: Column) -> Column:
        c, quoted = m["text"], s["quote"] >= 0
        opens, closes = ~quoted & (c == "("), ~quoted & (c == ")") & (s["depth"] > 0)
        depth = F.when(opens, s["depth"] + 1).when(closes, s["depth"] - 1).otherwise(s["depth"])
        begin = F.when(opens & (s["depth"] == 0), m["start"]).otherwise(s["open"])
        closed = closes & (depth == 0)
        ends = quoted & (c == '"')
        quote = F.when(ends, F.lit(-1)).when(~quoted & (c == '"') & (s["depth"] == 0), m["start"]).otherwise(s["quote"])
        add = F.when(closed, F.array(F.struct(s["open"].alias("start"), m["end"].alias("end")))).when(ends, F.array(F.struct(s["quote"].alias("start"), m["end"].alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.struct(depth.alias("depth"), begin.alias("open"), quote.alias("quote"), F.concat(s["out"], add).alias("out"))

    return F.when(masked.rlike(r'["(]'), F.aggregate(matches(masked, r'["()]'), zero, step, lambda s: s["out"])).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


#: Whether a number may have its unit behind it; more may match than merge.
_MEASURE = rf"(?Ud)\d[\d.,\-–]* ?(?:{either(L.UNITS)})(?!\w)"


def count_words(masked: Column) -> Column:
    """Words as the language counts them: a top-level span, a number with its unit and a run of capitalised words are one each."""
    return let(top_spans(masked), lambda spans: _count_words(masked, spans))


def _count_words(masked: Column, spans: Column) -> Column:
    # tokens are sought between spans only; a span's characters become one mark that no token holds
    blanked = F.aggregate(spans, masked, lambda m, s: F.concat(F.substring(m, F.lit(1), s["start"]), F.lit(PART), F.repeat(F.lit(MARK), s["end"] - s["start"] - 1), F.substring(m, s["end"] + 1, F.length(m))))
    plain = F.when(F.size(spans) > 0, blanked).otherwise(masked)
    units = F.regexp_extract_all(plain, F.lit(TOKEN + r"|\u0002|[^\w\u0002]+"), F.lit(0))
    zero = F.struct(F.lit(0).alias("n"), F.lit("").alias("prev"), F.lit("").alias("kind"), F.lit("").alias("gap"))

    def step(s: Column, x: Column) -> Column:
        span = x == PART
        word = x.rlike(r"(?U)^\w")
        open_ = word & s["kind"].isin("tok", "num", "title")
        number = open_ & (s["kind"] == "tok") & s["prev"].rlike("(?U)^\\d[\\d.,\\-–]*$") & x.isin(L.UNITS) & s["gap"].isin("", " ")
        title = open_ & ~number & (s["gap"] == " ") & starts_upper(x) & starts_upper(s["prev"]) & (s["n"] > 1)
        kind = F.when(span, "span").when(number, "num").when(title, "title").when(word, "tok").otherwise(s["kind"])
        prev = F.when(number | title, s["prev"]).when(word, x).when(span, "").otherwise(s["prev"])
        return F.struct((s["n"] + F.when((span | word) & ~number & ~title, 1).otherwise(0)).alias("n"), prev.alias("prev"), kind.alias("kind"), F.when(span | word, F.lit("")).otherwise(x).alias("gap"))

    fold = F.aggregate(units, zero, step, lambda s: s["n"])
    # the fold is needed only where something could merge: a span, a number with its unit, capitalised words
    simple = ~masked.rlike(r'["(]') & ~masked.rlike(_MEASURE) & ~masked.rlike(r"(?U)[\p{Lu}\p{Lt}][^ ]* [\p{Lu}\p{Lt}]")
    return F.when(simple, F.size(F.regexp_extract_all(masked, F.lit(TOKEN), F.lit(0)))).otherwise(fold).cast("int")

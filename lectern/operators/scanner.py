"""The contrast construction: patterns over the word classes of a sentence, and pairs of adjacent sentences.

A sentence becomes a string with one letter for the class of each token; whether it contrasts, denies or points back
is then a handful of regular expressions over that string. Tokenising, classing and testing are JVM
expressions of one projection; pairing is a lag window in the block. Sentences without a negation are not tokenised.

A negation is live if it is not one of continuing ("never stopped working") and not the head of a supplement
("the crowd, not knowing the reason, waited"). Verbs and adverbs are told by a lexicon: closed lists and endings.
Null sentences have no words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import quoted

# The construction's tokens, negators, breaks, words that point back, modals and words that open a clause.
TOKEN = r"(?U)\w+(?:['-]\w+)*|[^\w\s]"
NEGATORS = ("not", "never", "neither", "nor", "cannot")
BREAKS = (",", ";", ":", "—", "–", "(", ")", "[", "]", '"')
BACK = ("it", "it's", "its", "this", "that's", "that", "these", "those", "they", "they're", "their")
MODALS = ("can", "could", "may", "might", "must", "shall", "should", "will", "would")
CLAUSE = ("that", "which", "who", "because", "if", "when", "where")

#: Past forms that are no nouns, adjectives or participles in use, so that they can only be predicates.
PAST = (
    "was were did went came saw took gave knew grew threw drew flew blew wrote rode rose drove chose spoke broke froze stole woke swore tore wore bore began drank rang sang sank shrank sprang swam ate fell forgot "
    "became overcame undertook mistook foresaw withdrew outgrew arose forgave forbade shook slept kept crept wept dealt meant dreamt brought thought bought fought sought taught caught told sold held stood understood "
    "sat lost led fled bled fed met sent spent lent built heard made paid laid said hid slid dug won hung swung stuck struck shot"
).split()
#: Present forms and auxiliaries that can only be predicates.
PRESENT = "is are am has have do does says seems becomes remains goes knows thinks believes exists happens arrives begins belongs contains depends describes explains includes involves provides requires".split()
ADVERBS = (
    "often always usually sometimes seldom rarely finally still already soon now then here there perhaps maybe instead also just only even quite rather very too therefore however thus hence nevertheless nonetheless "
    "meanwhile otherwise moreover furthermore besides again once twice almost never not later ever else forever together afterwards indeed somehow anyway likewise"
).split()
#: Words in -ly and -ing that are no adverbs or gerunds.
NOT_LY = "family reply supply fly ally rely apply imply multiply comply assembly anomaly monopoly butterfly bully belly jelly rally tally july italy early daily weekly monthly yearly only friendly lovely likely lonely costly elderly ugly".split()
NOT_ING = "thing nothing something anything everything king ring string spring wing sing bring sling swing during ceiling sibling evening morning".split()


@dataclass(frozen=True)
class Lexicon:
    """Words by their readings; what is in no list follows its ending. ``nominal``: predicates that may be nouns or adjectives too."""

    finite: tuple = tuple(PAST) + tuple(PRESENT)
    adverbs: tuple = tuple(ADVERBS)
    nominal: tuple = ("felt", "left", "found", "cut", "set", "put", "hit", "cost", "run", "runs", "ran", "stop", "stops", "cease")
    no_adverbs: tuple = tuple(NOT_LY)
    no_gerunds: tuple = tuple(NOT_ING)


LEXICON = Lexicon()

# The letters: , ; d h breaks (comma, semicolon, dash, other) - b but - n not, q never, N neither and nor, v other negators -
# a adverb - f predicate, F predicate or noun, H have - u be, been - S stopped, s stop, E ceased, e cease - g gerund, z stopping, y ceasing -
# k opens a clause - t to - w other word - p other mark.
_BREAK, _HARD, _WORD = ",;dh", ";h", "bnqNvafFHuSsEegzyktw"
_NEG, _ADV, _GER = "nqNv", "anq", "gzy"
_FIN, _SURE = "fFHSsEe", "fHSE"
_LIVE = f"[{_NEG}](?![aHu]*(?:[SszEey][{_GER}]|[Eey]t[wsefF]))"
_SUPPLEMENT = f"[^{_BREAK}{_GER}{_SURE}]*,n[{_GER}][^{_BREAK}]*,[{_ADV}]*[{_FIN}]"
# behind the supplement only the negations before and after its own count
_BESIDE = f"(?:(?!{_SUPPLEMENT})(?>[^{_HARD}]*?{_LIVE})|(?={_SUPPLEMENT})(?>[^{_HARD},]*?{_LIVE}|[^,]*,n[^{_HARD}]*?{_LIVE}))"
_DENIES = f"(?:^|[{_HARD}])(?:{_BESIDE})"
# one comma at the head of the sentence may introduce it or set a supplement off
_EXEMPT = f"^(?:[{_ADV}]+,[nN][^{_BREAK}]*[{_FIN}]|[^{_BREAK}{_GER}{_SURE}]+,n[{_GER}][^{_BREAK}]*,[{_ADV}]*[{_FIN}])"
_APART = "(?!^)"
CONTRASTS = (
    f"{_APART}[;d][nN]",
    f"{_APART};[^{_BREAK}]*?{_LIVE}",
    f"{_APART}b[^{_BREAK}b]*?{_LIVE}",
)
_BUT_DENIED = f"{_DENIES}[^{_HARD}]*b[^{_WORD}]*[{_WORD}]"


_WHOLE = f"^(?:(?!{_SUPPLEMENT}).*?{_LIVE}|(?={_SUPPLEMENT})(?:[^,]*?{_LIVE}|[^,]*,n.*?{_LIVE}))"
_BACK = f"^.[^{_BREAK}k]*?{_LIVE}"


def classes(sentence: str, lex: Lexicon = LEXICON) -> Column:
    """A column of sentences as strings of token classes: one letter a token."""
    some = lambda ws: "(" + ", ".join(quoted(w) for w in ws or ("",)) + ")"
    cases = (
        ("t = ','", ","), ("t = ';'", ";"), ("t in ('—', '–')", "d"), (f"t in {some(BREAKS)}", "h"), ("t = 'but'", "b"), ("t = 'not'", "n"), ("t = 'never'", "q"), ("t in ('neither', 'nor')", "N"),
        (f"t in {some(NEGATORS)} OR endswith(t, {quoted("n't")})", "v"), (f"t in {some(CLAUSE)}", "k"), ("t = 'to'", "t"), ("t in ('have', 'has', 'had')", "H"), ("t in ('be', 'been')", "u"), ("t = 'stopped'", "S"), ("t in ('stop', 'stops')", "s"),
        ("t = 'stopping'", "z"), ("t = 'ceased'", "E"), ("t in ('cease', 'ceases')", "e"), ("t = 'ceasing'", "y"), (f"t in {some(MODALS)}", "f"), (f"t in {some(lex.nominal)}", "F"), (f"t in {some(lex.finite)}", "f"), (f"t in {some(lex.adverbs)}", "a"),
        (f"t rlike '^[a-z]{{3,}}ly$' AND t not in {some(lex.no_adverbs)}", "a"), (f"t rlike '^[a-z]{{2,}}ing$' AND t not in {some(lex.no_gerunds)}", "g"), ("t rlike '^[a-z]{2,}ed$'", "f"), (f"t rlike {quoted('^[\\p{L}\\p{N}]')}", "w"),
    )
    body = " ".join(f"WHEN {test} THEN '{letter}'" for test, letter in cases)
    return F.expr(f"array_join(transform(regexp_extract_all(lower({sentence}), {quoted(TOKEN)}, 0), t -> CASE {body} ELSE 'p' END), '')")


def facts(sents: DataFrame, sentence: str = "sentence", lex: Lexicon = LEXICON) -> DataFrame:
    """``sents`` with words (has any), contrast (within it), negated (anywhere), back (opens by pointing back and denies that)."""
    may = F.lower(sentence).rlike(r"\b(?:not|never|neither|nor|cannot)\b|n't")  # without a negation none of the rest holds
    rows = sents.withColumn("_c", F.when(may, classes(sentence, lex)).otherwise(""))
    # what is apart from the first word has words before it
    c, led = F.col("_c"), F.regexp_replace("_c", f"^[^{_WORD}]+", "")
    comma = F.when(c.rlike(_EXEMPT), c.rlike("^[^,]*,.*,[nN]")).otherwise(led.rlike(f"{_APART},[nN]"))
    contrast = comma | c.rlike(_BUT_DENIED)
    for p in CONTRASTS:
        contrast = contrast | led.rlike(p)
    first = F.lower(F.regexp_extract(sentence, TOKEN, 0))
    words = F.coalesce(F.col(sentence).rlike(r"[\p{L}\p{N}]"), F.lit(False))
    return rows.withColumns({"words": words, "contrast": words & contrast, "negated": c.rlike(_WHOLE), "back": first.isin(*BACK) & c.rlike(_BACK)}).drop("_c")


def contrasts(sents: DataFrame, lex: Lexicon = LEXICON) -> DataFrame:
    """doc_id, span_start, span_end: sentences with a contrast, and pairs whose second points back and denies."""
    rows = facts(sents.select("doc_id", "block_id", "sent_no", "span_start", "span_end", "sentence"), lex=lex).drop("sentence")
    by = Window.partitionBy("doc_id", "block_id").orderBy("sent_no")
    rows = rows.withColumn("p", F.lag(F.struct("words", "negated", "span_start")).over(by))
    pair = F.col("words") & ~F.col("contrast") & F.col("back") & F.col("p.words") & ~F.col("p.negated")
    return rows.where(F.col("contrast") | pair).select("doc_id", F.when(F.col("contrast"), F.col("span_start")).otherwise(F.col("p.span_start")).alias("span_start"), "span_end")

"""Light stemmers of several languages as tables of suffix rules.

A stemmer is an ordered list of steps; the first rule of a step that fits a word
rewrites it. The same table becomes a Spark column expression, which stays in
the JVM, and SQL for checking.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A pattern over the whole word, with one group that stays, and what is put after it.
Rule = tuple[str, str]


def cut(least: int, *suffixes: str, to: str = "") -> Rule:
    """Takes one of ``suffixes`` (patterns) off where ``least`` characters stay before it."""
    return f"^(.{{{least},}})(?:{'|'.join(suffixes)})$", to


@dataclass(frozen=True)
class Stemmer:
    """fold: characters and what they become, first of all; least: shorter words stay as they are; unless: words of this pattern take only the first step."""

    steps: tuple[tuple[Rule, ...], ...]
    fold: tuple[str, str] = ("", "")
    least: int = 0
    unless: str = ""
    undouble: bool = False

    def column(self, word: Column) -> Column:
        def step(w: Column, rules: tuple[Rule, ...]) -> Column:
            out = None
            for pattern, to in rules:
                value = F.concat(F.regexp_extract(w, pattern, 1), F.lit(to)) if to else F.regexp_extract(w, pattern, 1)
                out = F.when(w.rlike(pattern), value) if out is None else out.when(w.rlike(pattern), value)
            return out.otherwise(w)

        # a word is bound to a variable before each step: expressions would double from step to step else
        bind = lambda w, f: F.get(F.transform(F.array(w), f), F.lit(0))
        return self._apply(word, bind, step, lambda w: F.translate(w, *self.fold), lambda w, n: F.length(w) >= n, lambda w: w.rlike(self.unless), lambda c, a, b: F.when(c, a).otherwise(b), lambda w: F.when(F.substring(w, -1, 1) == F.substring(w, -2, 1), F.left(w, F.length(w) - 1)).otherwise(w))

    def sql(self, word: str) -> str:
        """The same as a SQL expression over ``word``."""

        def step(w: str, rules: tuple[Rule, ...]) -> str:
            text = " ".join(f"when regexp_matches({w}, '{p}') then regexp_extract({w}, '{p}', 1) || '{to}'" for p, to in rules)
            return f"(case {text} else {w} end)"

        names = iter(range(1000))

        def bind(w: str, f: Callable[[str], str]) -> str:
            name = f"x{next(names)}"
            return f"list_transform([{w}], lambda {name}: {f(name)})[1]"

        return self._apply(word, bind, step, lambda w: f"translate({w}, '{self.fold[0]}', '{self.fold[1]}')", lambda w, n: f"length({w}) >= {n}", lambda w: f"regexp_matches({w}, '{self.unless}')", lambda c, a, b: f"(case when {c} then {a} else {b} end)", lambda w: f"(case when right({w}, 1) = substr({w}, length({w}) - 1, 1) then left({w}, length({w}) - 1) else {w} end)")

    def _apply(self, word, bind: Callable, step: Callable, fold: Callable, long: Callable, odd: Callable, choose: Callable, undouble: Callable):
        def once(rules: tuple[Rule, ...], own) -> Callable:
            return lambda w: step(w, rules) if own is None else choose(odd(own), w, step(w, rules))

        def whole(own):
            out = own
            for k, rules in enumerate(self.steps):
                out = bind(out, once(rules, own if self.unless and k else None))
            if self.undouble:
                out = bind(out, lambda w: choose(odd(own), w, undouble(w)) if self.unless else undouble(w))
            return out

        out = bind(fold(word) if self.fold[0] else word, whole)
        return choose(long(word, self.least), out, word) if self.least else out


# The characters that romance languages fold, and each language's suffixes, in the published order.
_ROMANCE = ("àáâäòóôöèéêëùúûüìíîï", "aaaaooooeeeeuuuuiiii")
SPANISH_LIGHT = Stemmer(((cut(1, "[oae]"), ("^(.*es)es$", ""), ("^(.*)ces$", "z"), cut(1, "[oae]s")),), _ROMANCE, 5)
ITALIAN_LIGHT = Stemmer(((cut(1, "[ih][ei]", "i[ao]"), cut(1, "[eiao]")),), _ROMANCE, 6)
FRENCH_MINIMAL = Stemmer(((("^(.*a)ux$", "l"), cut(1, "x")), (("^(.*?)é?e?r?s?$", ""),)), least=6, unless="x$", undouble=True)
GERMAN_MINIMAL = Stemmer(((cut(4, "nen"), cut(4, "en", "se", "es", "er"), cut(1, "[nesr]")),), ("äöü", "aou"), 5)
GERMAN_LIGHT = Stemmer(
    ((cut(3, "ern"), cut(3, "e[mnrs]"), cut(3, "e"), ("^(.{2,}[bdfghklmnt])s$", "")), (cut(3, "est"), cut(3, "e[rn]"), ("^(.{2,}[bdfghklmnt])st$", ""))),
    ("äàáâöòóôïìíîüùúû", "aaaaooooiiiiuuuu"),
)
SWEDISH_LIGHT = Stemmer(((cut(4, "s"),), (cut(3, "elser", "heten"), cut(3, "arne", "erna", "ande", "else", "aste", "orna", "aren"), cut(3, "are", "ast", "het"), cut(3, "ar", "er", "or", "en", "at", "te", "et"), cut(3, "[taen]"))))
NORWEGIAN_MINIMAL = Stemmer(((cut(4, "s"),), (cut(3, "ene"), cut(3, "er", "en", "et"), cut(3, "[ae]"))))
HINDI = Stemmer(
    (
        tuple(
            cut(2, *own.split())
            for own in (
                "ाएंगी ाएंगे ाऊंगी ाऊंगा ाइयाँ ाइयों ाइयां",
                "ाएगी ाएगा ाओगी ाओगे एंगी ेंगी एंगे ेंगे ूंगी ूंगा ातीं नाओं नाएं ताओं ताएं ियाँ ियों ियां",
                "ाकर ाइए ाईं ाया ेगी ेगा ोगी ोगे ाने ाना ाते ाती ाता तीं ाओं ाएं ुओं ुएं ुआं",
                "कर ाओ िए ाई ाए ने नी ना ते ीं ती ता ाँ ां ों ें",
                "ो े ू ु ी ि ा",
            )
        ),
    )
)
ARABIC = Stemmer(((*((f"^{p}(.{{2,}})$", "") for p in "ال وال بال كال فال لل".split()), ("^و(.{3,})$", "")), *((cut(2, s),) for s in "ها ان ات ون ين يه ية ه ة ي".split())))

STEMMERS = {
    "spanish_light": SPANISH_LIGHT,
    "italian_light": ITALIAN_LIGHT,
    "french_minimal": FRENCH_MINIMAL,
    "german_minimal": GERMAN_MINIMAL,
    "german_light": GERMAN_LIGHT,
    "swedish_light": SWEDISH_LIGHT,
    "norwegian_minimal": NORWEGIAN_MINIMAL,
    "hindi": HINDI,
    "arabic": ARABIC,
}


def stemmed(tokens: Column, language: str) -> Column:
    """``tokens`` with each token stemmed by the rules of ``language``, a name of STEMMERS."""
    return F.transform(tokens, STEMMERS[language].column)


# --- normalisation

#: Letters of one script that are written in several ways, and the one way that stays; what is only a mark goes.
_ARABIC = ("آأإىةـًٌٍَُِّْ", "ااايه")
_PERSIAN = ("یےکۀۂ", "ييكهه")


def normalize_arabic(tokens: Column) -> Column:
    """Alef with madda or hamza becomes alef, dotless yeh yeh, teh marbuta heh; tatweel and vowel marks go."""
    return F.transform(tokens, lambda x: F.translate(x, *_ARABIC))


def normalize_persian(tokens: Column) -> Column:
    """Farsi yeh, yeh barree, keheh, heh with yeh and heh goal become the Arabic letters; a hamza above goes."""
    return F.transform(tokens, lambda x: F.translate(x, *_PERSIAN))


def fold_width(tokens: Column) -> Column:
    """Full-width Latin letters, digits and signs become plain ones."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    return F.transform(tokens, lambda x: F.translate(x, wide, "".join(map(chr, range(0x21, 0x7F)))))


def cjk_bigrams(text: Column) -> Column:
    """Bigrams of each run of Han, kana or Hangul characters, a lone one as it is; other words whole."""
    script = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"
    runs = F.regexp_extract_all(text, F.lit(rf"{script}+|(?:(?!{script})[\p{{L}}\p{{N}}_])+"), F.lit(0))
    pair = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.substr(w, i, F.lit(2)))
    return F.flatten(F.transform(runs, lambda w: F.when(w.rlike(f"^{script}"), pair(w)).otherwise(F.array(w))))


def map_chars(text: Column, table: dict[str, str]) -> Column:
    """``text`` with each key of ``table`` replaced, the longest at a place first; replacements are not looked at again."""
    keys = sorted(table, key=len, reverse=True)
    parts = F.regexp_extract_all(text, F.lit("(?s)" + "|".join([*(rf"\Q{k}\E" for k in keys), "."])), F.lit(0))
    known = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)])
    return F.array_join(F.transform(parts, lambda x: F.coalesce(F.element_at(known, x), x)), "")

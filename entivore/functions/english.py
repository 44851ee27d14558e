"""English words for full-text search: stop words and stems (the public Porter2 rules).

The rules below are tables of endings; stem() applies one table after the other. An index or a
query calls it once for each word it hasn't seen lately."""

from __future__ import annotations

import re
from collections.abc import Iterable

# The public list of English stop words.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
    they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having
    do does did doing a an the and but if or because as until while of at by for with about against between into through during before
    after above below to from up down in out on off over under again further then once here there when where why how all any both each
    few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)
# Words with stems of their own, and words that are left as they are once plurals are cut.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
UNCHANGED = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
#: Beginnings after which the first region starts wherever vowels stand.
BEGINNINGS = ("gener", "commun", "arsen")
#: Endings and what they become, in the first region; an ending that is part of a longer one of the table gives way to it.
SECOND = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
#: Endings that go in the second region.
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

_V = "aeiouy"
_REGION = re.compile(f"[{_V}][^{_V}]")
_VOWEL = re.compile(f"[{_V}]")
_SHORT_END = re.compile(f"(?:[^{_V}][{_V}][^{_V}wxY]|^[{_V}][^{_V}])$")


def _after(word: str, start: int) -> int:
    """Where the region begins: behind the first consonant that follows a vowel."""
    m = _REGION.search(word, start)
    return m.end() if m else len(word)


def _ending(word: str, endings: Iterable[str]) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        return w[:-1]
    return w


def _past(w: str, r1: int) -> str:
    end = _ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    rest = w[: len(w) - len(end)]
    if end.startswith("eed"):
        return rest + "ee" if len(rest) >= r1 else w
    if not end or not _VOWEL.search(rest):
        return w
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if rest.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
        return rest[:-1]
    return rest + "e" if r1 >= len(rest) and _SHORT_END.search(rest) else rest


def _replaced(w: str, table: dict[str, str], r1: int, r2: int) -> str:
    end = _ending(w, table)
    rest = w[: len(w) - len(end)]
    fits = len(rest) >= (r2 if end == "ative" else r1)
    if end == "ogi":
        fits = fits and rest.endswith("l")
    if end == "li":
        fits = fits and rest[-1:] in tuple("cdeghkmnrt")
    return rest + table[end] if end and fits else w


def stem(word: str) -> str:
    """The stem of a word in lower case."""
    if len(word) < 3:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    # a y that stands for a consonant is written Y until the end
    w = re.sub(f"(^|[{_V}])y", r"\1Y", word)
    r1 = next((len(b) for b in BEGINNINGS if w.startswith(b)), 0) or _after(w, 0)
    r2 = _after(w, r1)
    w = _plural(w)
    if w in UNCHANGED:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    w = _replaced(w, SECOND, r1, r2)
    w = _replaced(w, THIRD, r1, r2)
    end = _ending(w, FOURTH)
    rest = w[: len(w) - len(end)]
    if end and len(rest) >= r2 and (end != "ion" or rest.endswith(("s", "t"))):
        w = rest
    if w.endswith("e") and (len(w) > r2 or len(w) > r1 and not _SHORT_END.search(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) > r2:
        w = w[:-1]
    return w.replace("Y", "y")


_WORDS = re.compile(r"[^\W_]+")


class Stems(dict):
    """Stem by word, remembered up to a bound; stop words have none."""

    MOST = 200_000

    def __missing__(self, word: str) -> str | None:
        if len(self) >= self.MOST:
            self.clear()
        out = self[word] = None if word in STOP_WORDS else stem(word)
        return out


def terms(text: str, known: Stems | None = None) -> list[tuple[int, str]]:
    """Place and stem of each word of a text that isn't a stop word; places count all words."""
    known = Stems() if known is None else known
    found = ((i, known[w]) for i, w in enumerate(_WORDS.findall(text.lower())))
    return [(i, s) for i, s in found if s]

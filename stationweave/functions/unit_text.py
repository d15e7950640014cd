"""Units out of words: dynamic programming over tries of prefixes, roots and exponents.

A unit string such as "hundredths of an inch", "deg C x 10" or "mm" is cut into
prefixes, roots, exponents and filler. Every decomposition gets a score: letters
explained, minus letters skipped, plus a prior for the dimension that the field
has. "C" is a Celsius root in a temperature field and nothing in a rain gauge;
"in" inside "min" loses to the filler word that explains more.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

TEMPERATURE, PRECIPITATION = "temperature", "precipitation"

# Words of units. Prefixes scale the root that follows or, as "x 10", the one before.
PREFIXES = {
    "tenths of a ": 0.1, "tenths of an ": 0.1, "tenths of ": 0.1, "tenths ": 0.1, "tenth of ": 0.1, "0.1 ": 0.1, "1/10 ": 0.1,
    "x 10": 0.1, "x10": 0.1, "* 10": 0.1, "×10": 0.1, "× 10": 0.1, "x 0.1 ": 0.1, "x 0.1": 0.1,
    "hundredths of an ": 0.01, "hundredths of a ": 0.01, "hundredths of ": 0.01, "hundredths ": 0.01, "0.01 ": 0.01,
    "1/100 ": 0.01, "x 100": 0.01, "x100": 0.01, "x 0.01 ": 0.01, "x 0.01": 0.01,
    "centi": 0.01, "milli": 0.001, "c": 0.01, "m": 0.001,
}
ROOTS = {
    "celsius": "C", "centigrade": "C", "centígrados": "C", "c": "C", "℃": "C", "degc": "C", "degf": "F", "degk": "K",
    "fahrenheit": "F", "fahr": "F", "f": "F", "℉": "F",
    "kelvin": "K", "kelvins": "K", "k": "K", "absolute scale": "K",
    "metre": "m", "metres": "m", "meter": "m", "meters": "m", "m": "m",
    "inch": "in", "inches": "in", "in": "in", "in.": "in", "\"": "in", "″": "in", "pulg": "in", "pulgada": "in", "pulgadas": "in",
    "litre": "l", "liter": "l", "l": "l",
    "hundredths": "in/100", "hundredth": "in/100",
}
EXPONENTS = {"^2": 2, "²": 2, "2": 2, "^-1": -1, "⁻¹": -1, "^-2": -2, "⁻²": -2}
FILLERS = (
    "degrees", "degree", "deg.", "deg", "grados", "grado", "°", "º", "of", "a", "an", "the", "counts", "count", "tips", "stored as",
    "air", "max", "min", "temp", "temperature", "t", "rr", "pcpn", "precip", "gauge", "rain", "depth", "is", "as", "and", "per", "/",
)
DIMENSION = {"C": TEMPERATURE, "F": TEMPERATURE, "K": TEMPERATURE, "in": PRECIPITATION, "m": PRECIPITATION, "in/100": PRECIPITATION}
#: root and total scale -> unit code. l/m2 is a millimetre of water.
CODES = {
    ("C", 1.0): "degC", ("C", 0.1): "degC_tenths", ("F", 1.0): "degF", ("F", 0.1): "degF_tenths", ("K", 1.0): "K",
    ("m", 0.001): "mm", ("m", 0.0001): "mm_tenths", ("m", 0.01): "cm", ("in", 1.0): "in", ("in", 0.01): "in_hundredths",
    ("in/100", 1.0): "in_hundredths", ("l/m2", 1.0): "mm",
}

#: Score of a letter explained by a root or prefix, by filler, of a letter skipped, of a dimension that is the field's or isn't.
UNIT_LETTER, FILLER_LETTER, SKIPPED, PRIOR = 2.0, 1.0, -1.5, 3.0


def _trie(words: dict[str, object]) -> dict:
    top: dict = {}
    for w, v in words.items():
        node = top
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = v
    return top


_PREFIX, _ROOT, _EXPONENT, _FILLER = map(_trie, (PREFIXES, ROOTS, EXPONENTS, dict.fromkeys(FILLERS, True)))


def _matches(trie: dict, s: str, i: int):
    node = trie
    for j in range(i, len(s)):
        node = node.get(s[j])
        if node is None:
            return
        if "" in node:
            yield j + 1, node[""]


@dataclass(frozen=True)
class Reading:
    """One decomposition: score, scale of all prefixes, (root, exponent) pairs."""

    score: float
    scale: float
    roots: tuple[tuple[str, int], ...]


def _word(ch: str) -> bool:
    return ch.isalpha() and ch not in "℃℉"


@lru_cache(maxsize=20_000)
def unit_of(text: str, dimension: str) -> str | None:
    """Unit code named in a text, for a field of the given dimension; None where there is none.

    Ties go to the decomposition found first, which has the longer pieces.
    """
    s = re.sub(r"\s+", " ", text.lower().replace("’", "'")).strip()
    n = len(s)
    # state: has a root been read (only one may be, besides a divisor); keep the best reading of each
    best: list[dict[tuple, Reading]] = [{} for _ in range(n + 1)]
    best[0][((), False)] = Reading(0.0, 1.0, ())

    def put(j: int, key: tuple, r: Reading) -> None:
        old = best[j].get(key)
        if old is None or r.score > old.score:
            best[j][key] = r

    for i in range(n):
        starts_word = i == 0 or not (_word(s[i - 1]) and _word(s[i]))
        for (roots, glued), r in list(best[i].items()):
            if s[i] in " .,;:=()" and not glued:
                put(i + 1, (roots, False), Reading(r.score, r.scale, roots))
            if starts_word and not glued:
                for j, _ in _matches(_FILLER, s, i):
                    if j == n or not (_word(s[j - 1]) and _word(s[j])):
                        put(j, (roots, False), Reading(r.score + FILLER_LETTER * (j - i), r.scale, roots))
                for j, scale in _matches(_PREFIX, s, i):
                    short = s[i:j] in ("c", "m", "centi", "milli")
                    put(j, (roots, short), Reading(r.score + UNIT_LETTER * (j - i) - 0.1, r.scale * scale, roots))
            if starts_word or glued:
                for j, root in _matches(_ROOT, s, i):
                    if j < n and _word(s[j - 1]) and _word(s[j]):
                        continue
                    if glued and root not in ("m", "l"):
                        continue
                    known = DIMENSION.get(root)
                    score = UNIT_LETTER * (j - i) + (PRIOR if known == dimension else -PRIOR)
                    if len(roots) == 0 or (roots[-1][0] == "l" and root == "m"):
                        put(j, ((*roots, (root, 1)), False), Reading(r.score + score, r.scale, (*roots, (root, 1))))
            if roots and i and not s[i].isspace():
                for j, e in _matches(_EXPONENT, s, i):
                    new = (*roots[:-1], (roots[-1][0], e))
                    put(j, (new, False), Reading(r.score + 1.0, r.scale, new))
            if not glued:  # skip a whole word, or one sign
                j = i + 1
                if _word(s[i]):
                    while j < n and _word(s[j]):
                        j += 1
                put(j, (roots, False), Reading(r.score + SKIPPED * (j - i), r.scale, roots))
    found = [r for (roots, glued), r in best[n].items() if roots and not glued]
    for r in sorted(found, key=lambda r: -r.score):
        if len(r.roots) == 2 and r.roots == (("l", 1), ("m", 2)):
            code = CODES.get(("l/m2", round(r.scale, 6)))
        elif len(r.roots) == 1 and r.roots[0][1] == 1 and DIMENSION.get(r.roots[0][0]) == dimension:
            code = CODES.get((r.roots[0][0], round(r.scale, 6)))
        else:
            continue
        if code:
            return code
    return None


_NUMBER = re.compile(r"([+\-−–]?)\s*(?:(\d+)\s+(\d+)/(\d+)|(\d+)/(\d+)|(\d*[.,]\d+|\d+[.,]?))")
_SCALED = re.compile(r"x\s*0[.,]0*1\b")


@lru_cache(maxsize=50_000)
def measured(text: str | None, dimension: str) -> tuple[float | None, str | None]:
    """(number, unit code) of an observer's text; number None for missing-value words, unit None where none is named.

    Decimal comma or point, a typographic minus, vulgar fractions ("1 3/8 in")
    and counts ("6 x 0.01 in") are read.
    """
    if text is None:
        return None, None
    m = _NUMBER.search(text)
    if not m:
        return None, None
    sign, whole, a, b, c, d, plain = m.groups()
    if whole is not None:
        value = int(whole) + int(a) / int(b) if int(b) else None
    elif c is not None:
        value = int(c) / int(d) if int(d) else None
    else:
        value = float(plain.rstrip(".,").replace(",", ".") or "0")
    if value is None:
        return None, None
    if sign in ("-", "−", "–"):
        value = -value
    rest = text[: m.start()] + " " + text[m.end() :]
    return value, unit_of(rest.replace(",", "."), dimension)

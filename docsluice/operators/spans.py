"""Where identifiers stand in a text: the matches of all rules, in time linear in the text.

One automaton finds every word that a rule's match can start with, so such a
rule is tried at these places only. The rules without such a word scan on their
own, from digits or signs that they need. Four rules whose loops overlap (mail
addresses, two kinds of labelled places, street addresses) are found from what
they end with or stop at, as plain matching of them is quadratic. The matches
are those of ``re.finditer`` with the rule as it stands, rule by rule; tests hold
the two against each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick

from .rules import DIGITS, RULES

#: Words that matches of a rule start with, by the rule's place in RULES.
STARTS = {
    2: ("fax",), 3: ("npi",), 4: ("phone", "cell", "mobile", "tel"), 7: ("health", "member", "policy"), 8: ("mrn", "record"), 9: ("patient", "pid", "uhid"),
    11: ("lab", "test"), 12: ("accession",), 13: ("account", "acct"), 14: ("lic",), 16: ("device", "serial", "imei"), 17: ("http", "www."),
    19: ("fingerprint", "voiceprint", "retina", "iris"), 21: ("age",), 25: ("sample", "collected"), 26: ("referred",),
    29: ("miss", "mr", "ms", "mast", "dr", "doctor", "prof", "shri", "smt"), 30: ("patient", "name", "attending", "emergency", "physician"),
    31: ("printed", "operator", "technician", "verified"),
}
MAIL, COLLECTED, REFERRED, DATED, STREET, LABEL = 1, 25, 26, 27, 28, 30
#: Letters that match s, i and k where case does not count, though lower() leaves them or makes two of them.
FOLDED = str.maketrans({"ſ": "s", "ı": "i", "İ": "i", "K": "k"})

SPACES, LOCAL, PLACE, BLOCK = re.compile(r"\s*+"), re.compile(r"[A-Za-z0-9._%+-]*+"), re.compile(r"(?i)[A-Za-z0-9\s.,&-]*+"), re.compile(r"(?i)[A-Z0-9\s.,&-]*+")
LOCAL_START, DOMAIN = re.compile(r"\b[A-Za-z0-9._%+-]"), re.compile(r"[A-Za-z0-9.-]+\.[A-Za-z]{2,7}\b")
GAP = re.compile(r"\s*+([:.]?+)\s*+")
NUMBER, STREET_RUN = re.compile(r"\b\d{1,5}(\s+)"), re.compile(r"(?i)[A-Za-z0-9\s.,]*+")
STREET_WORD = re.compile(r"(?i)\b(?:Street|St|Avenue|Ave|Terrace|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Way)\b")
TOWN_RUN, TWO_LETTERS, FIVE_DIGITS, COMMAS = re.compile(r"(?i)[A-Za-z\s,]*+"), re.compile(r"(?i)[A-Za-z]{2}"), re.compile(r"\d{5}"), re.compile(r"[,\s]*+")
DIGIT = re.compile(r"[0-9]")
UNDIGITED = (4, 15)  # rules with the hint of digits that match without one too
#: Characters that are no letter, digit or space to an engine whose classes and word boundaries are ASCII.
OTHER = re.compile("[^\x00-\x1b\x20-\x7f–€£ſK]")
DATED_WORD = re.compile(r"(?i)(?:REPORTING\s*DATE|COLLECTION\s*DATE)")


def linear(pattern: str) -> str:
    """The rule with loops over white space that never give back, where giving back cannot lead to a match."""
    p = pattern.replace(r"\s*[:.]?\s*(", r"\s*+[:.]?+\s*+(").replace(r"\s*[-–@,]?\s*\d", r"\s*+[-–@,]?+\s*+\d")
    p = p.replace(r")?\.?\s*(", r")?\.?+\s*+(")
    return p.replace(r"(\d{1,3}\s*(?:Y(?:ears?)?|Yrs?|M(?:onths?)?)?(?:\s*/\s*[MFmf])?)\b", r"(\d{1,3}(?:\s*+(?:Y(?:ears?)?|Yrs?|M(?:onths?)?)?(?:\s*+/\s*+[MFmf])?\b|\b))")


@lru_cache(maxsize=1)
def _rules() -> tuple:
    return tuple((re.compile(linear(p)), group, hint) for _, p, group, _, hint in RULES)


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    words: dict[str, list[int]] = {}
    for rule, starts in STARTS.items():
        for w in starts:
            words.setdefault(w, []).append(rule)
    out = ahocorasick.Automaton()
    for w, rules in words.items():
        out.add_word(w, (len(w), w, rules))
    out.make_automaton()
    return out


def _back(pattern: re.Pattern, text: str, end: int, floor: int) -> int:
    """Start of the run of ``pattern``'s characters that ends at ``end``, not before ``floor``."""
    size = 64
    while True:
        low = max(floor, end - size)
        n = pattern.match(text[low:end][::-1]).end()
        if n < end - low or low == floor:
            return end - n
        size *= 4


def _tried(pattern: re.Pattern, group: int, text: str, places: list[int]) -> Iterator[tuple[int, int]]:
    done = 0
    for p in places:
        if p >= done and (m := pattern.match(text, p)):
            done = m.end()
            if m[group].strip():
                yield m.span(group)


def _mails(text: str) -> Iterator[tuple[int, int]]:
    """From each @: the first word boundary of the run before it, and the longest domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        low = _back(LOCAL, text, at, done)
        if low < at and (domain := DOMAIN.match(text, at + 1)) and (first := LOCAL_START.search(text, low, at)):
            done = domain.end()
            yield first.start(), done
        at = text.find("@", max(at + 1, done))


def _places(prefix: re.Pattern, text: str, hits: list[int]) -> Iterator[tuple[int, int]]:
    """Labelled places: from the label to a colon, a line's end or the text's end, over characters of places."""
    done = low = high = dead = last = 0  # a run of such characters is measured once, and tried in vain once
    for p in hits:
        if p < done or not (m := prefix.match(text, p)):
            continue
        gap = GAP.match(text, m.end())
        q = gap.end()
        if not low <= q < high:
            low, high = q, PLACE.match(text, q).end()
            last = high if high == len(text) else _back(SPACES, text, high, low) if text[high] == ":" else -1
        end = -1
        if high > q and dead != high:
            most = max(last, q + 1) if last >= 0 else -1
            end = text.find("\n", q + 1, high if most < 0 else most)
            if end < 0:
                end = most
            if end < 0:
                dead = high
        if end > 0:
            done = end
            if text[q:end].strip():
                yield q, end
        elif gap[1] == ".":  # the point itself, if the line or the text ends at it
            dot = gap.start(1)
            stop = q == len(text) or text[q] == ":"
            if q == dot + 1 if stop else text[dot + 1 : dot + 2] == "\n" and "\n" not in text[dot + 2 : q]:
                done = dot + 1
                yield dot, done


def _dated(pattern: re.Pattern, group: int, text: str) -> Iterator[tuple[int, int]]:
    """From each label at the end: the rule runs from the earliest place where a match of its bounded middle can begin to the last label that the middle can reach."""
    done = reach = 0
    labels = list(DATED_WORD.finditer(text))
    for k in labels:
        if k.start() < done:
            continue
        head = _back(SPACES, text, k.start(), done)
        if head == k.start():
            continue
        floor = max(head - 30, done)
        low = _back(BLOCK, text, head, floor)
        if low == floor:
            low = _back(SPACES, text, floor, done)
        most = SPACES.match(text, k.start() + 31).end()
        while reach + 1 < len(labels) and labels[reach + 1].start() <= most:
            reach += 1
        if m := pattern.search(text, max(low - 1, done), max(k.end(), labels[reach].end())):
            done = m.end()
            if m[group].strip():
                yield m.span(group)


def _town(text: str, at: int) -> int:
    """Where an address ends whose street word ends at ``at``: after its town, state and code, if they follow."""
    z = TOWN_RUN.match(text, at).end()
    if not FIVE_DIGITS.match(text, z):
        return at
    tail = text[at:z]
    state = tail.rstrip()
    core = state[:-2]
    if len(state) == len(tail) or len(core) < 3 or not TWO_LETTERS.fullmatch(state[-2:]):
        return at
    before, after = COMMAS.match(core).end(), COMMAS.match(core[::-1]).end()
    if before == len(core):
        good = any(c.isspace() for c in core[1:-1])
    else:
        good = before > 0 and after > 0 and "," not in core[before : len(core) - after]
    return z + 5 if good else at


def _streets(text: str) -> Iterator[tuple[int, int]]:
    """From each number: the first street word of the run of characters that it begins."""
    at = run = asked = 0
    word = None  # the first street word from ``asked`` on, in the run that ends at ``run``
    while m := NUMBER.search(text, at):
        first = m.end()
        if first > run or run == 0:
            run, word, asked = STREET_RUN.match(text, first).end(), None, -1
        if asked < 0 or (word and word.start() < first + 1):
            asked = first + 1
            word = STREET_WORD.search(text, asked, min(len(text), run + 1)) if asked <= run else None
            if word and word.start() >= run:
                word = None
        hit = word
        if hit is None and m.end(1) - m.start(1) > 1:
            hit = STREET_WORD.match(text, first)
        if hit is None:
            at = run  # no street word is left for any number of this run
            continue
        at = _town(text, hit.end())
        yield m.start(), at
        if at > run:
            run = 0


def found(text: str, hinted: bool = True, every: bool = False) -> list[tuple[int, int, int]]:
    """(rule, start, end) of every identifier, by rule and place. ``hinted``: rules whose words of need the text lacks are left out. ``every``: rules of digits are tried on texts without one where they can match."""
    if not text.strip():
        return []
    plain = text.lower()
    low = plain if len(plain) == len(text) and not any(c in text for c in "ſıK") else text.translate(FOLDED).lower()
    digits = bool(DIGIT.search(text)) or (not text.isascii() and any(map(str.isdigit, text)))
    hits: dict[int, list[int]] = {}
    for last, (size, word, rules) in _automaton().iter(low):
        p = last - size + 1
        for r in rules:
            places = hits.setdefault(r, [])
            if r == LABEL and word == "name" and (c := _back(SPACES, text, p, 0)) > 0 and text[c - 1] == ":":
                places.append(c - 1)
            places.append(p)
    out = []
    for i, (pattern, group, hint) in enumerate(_rules()):
        if i in STARTS and i not in hits:
            continue
        if not digits and not (every and i in UNDIGITED) if hint is DIGITS else hinted and not any(h in plain for h in hint):
            continue
        if i == MAIL:
            spans = _mails(text)
        elif i in (COLLECTED, REFERRED):
            spans = _places(_prefix(i), text, hits[i])
        elif i == DATED:
            spans = _dated(pattern, group, text) if "date" in low else ()
        elif i == STREET:
            spans = _streets(text)
        elif i in STARTS:
            spans = _tried(pattern, group, text, sorted(hits[i]))
        elif hint is not DIGITS and not any(h in low for h in hint):
            continue
        else:
            spans = (m.span(group) for m in pattern.finditer(text) if m.start(group) >= 0 and m[group].strip())
        out += [(i, a, z) for a, z in spans]
    return out


def plain_ascii(text: str) -> str:
    """The text as SQL's patterns see it: letters beyond ASCII neither are part of a word nor end one. Characters that rules name, and ſ and K, which match s and k, stay."""
    return OTHER.sub("\ufffd", text)


@lru_cache(maxsize=2)
def _prefix(rule: int) -> re.Pattern:
    """The label of a rule for labelled places."""
    return re.compile(RULES[rule][1].split(r"\s*[:.]?\s*", 1)[0])

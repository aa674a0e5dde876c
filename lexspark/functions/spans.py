"""Where many patterns match in a text: one automaton over their literals, one Arrow-batched scan.

A text is read once by an Aho-Corasick automaton of all literals. A pattern whose matches
begin with a literal is tried at the hits of that literal alone, one that begins with a number and
white space before a literal at the numbers that stand before its hits; any other runs over the
text. None is tried unless the automaton met a literal it cannot match without, and the text has
the part that some patterns share. Offsets are those of the match, so a text costs time linear in
its length whatever the number of matches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import ahocorasick

_META = set("\\[](){}.*+?|^$")
_GROUP = re.compile(r"\((?:\?:)?([^()\[]+)\)(?![?*{])")
_LED = re.compile(r"\\b(?:\(\\d\{[\d,]+\}\)|\\d\{[\d,]+\})\\s\+")


def _literal(rest: str) -> str:
    """The literal that ``rest`` begins with, as far as no quantifier touches it."""
    literal, at = "", 0
    while at < len(rest):
        size = 1
        if rest[at] == "\\":
            if at + 1 >= len(rest) or rest[at + 1].isalnum():
                break
            size = 2
        elif rest[at] in _META:
            break
        if rest[at + size : at + size + 1] in ("?", "*", "{"):
            break
        literal, at = literal + rest[at + size - 1], at + size
    return literal


def first_literals(pattern: str) -> tuple[str, ...]:
    """Literals one of which every match begins with; empty if there is no such set."""
    rest = pattern.removeprefix(r"\b")
    if "|" in re.sub(r"\[[^\]]*\]|\((?:[^()]|\([^()]*\))*\)", "", rest):
        return ()
    group = _GROUP.match(rest)
    found = tuple(_literal(arm) for arm in group[1].split("|")) if group else (_literal(rest),)
    return found if all(found) else ()


def led_literals(pattern: str) -> tuple[str, ...]:
    """Literals one of which follows the number and the white space that every match begins with; empty if it is no such pattern."""
    lead = _LED.match(pattern)
    return first_literals(pattern[lead.end():]) if lead else ()


def _number_before(text: str, place: int) -> int | None:
    """Where the run of digits begins that stands before the white space before ``place``."""
    stop = place
    while stop and text[stop - 1].isspace():
        stop -= 1
    start = stop
    while start and text[start - 1].isdecimal():
        start -= 1
    return start if start < stop < place else None


class SpanFinder:
    """Matches of numbered patterns with their offsets in code points.

    ``patterns`` is a sequence of (pattern, needed literals); a pattern with neither a first
    nor a needed literal runs over every text. ``parts`` gives for pieces of patterns, which
    all matches hold, a pattern that a text must have for them: it is tried once for all.
    """

    def __init__(self, patterns: Sequence[tuple[str, tuple[str, ...]]], parts: Mapping[str, str] | None = None):
        self._regexes = [re.compile(p) for p, _ in patterns]
        self._always, self._windowed = [], []
        tests = {piece: re.compile(test) for piece, test in (parts or {}).items()}
        self._parts = [next((test for piece, test in tests.items() if piece in p), None) for p, _ in patterns]
        at_literal: dict[str, tuple[list[int], list[int], list[int]]] = {}
        for number, (pattern, needs) in enumerate(patterns):
            first, led = first_literals(pattern), led_literals(pattern)
            self._windowed.append(bool(first or led))
            for kind, literals in enumerate((first, led, needs)):
                for literal in literals:
                    at_literal.setdefault(literal, ([], [], []))[kind].append(number)
            if not needs:
                self._always.append(number)
        self._automaton = ahocorasick.Automaton()
        for literal, (begins, led, needing) in at_literal.items():
            self._automaton.add_word(literal, (len(literal), tuple(begins), tuple(led), tuple(needing)))
        self._automaton.make_automaton()

    def find(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(pattern number, match number, start, stop), by pattern, then by place; matches of one pattern do not overlap."""
        begins: dict[int, list[int]] = {}
        possible = set(self._always)
        for last, (size, starting, led, needing) in self._automaton.iter(text):
            place = last - size + 1
            for number in starting:
                begins.setdefault(number, []).append(place)
            if led and (start := _number_before(text, place)) is not None:
                for number in led:
                    begins.setdefault(number, []).append(start)
            possible.update(needing)
        held: dict[re.Pattern, bool] = {}
        for number in sorted(possible):
            regex, part, n = self._regexes[number], self._parts[number], 0
            if part is not None:
                if part not in held:
                    held[part] = part.search(text) is not None
                if not held[part]:
                    continue
            if not self._windowed[number]:
                for m in regex.finditer(text):
                    yield number, n, m.start(), m.end()
                    n += 1
                continue
            stop = 0
            for start in sorted(set(begins.get(number, ()))):
                m = regex.match(text, start) if start >= stop else None
                if m:
                    stop = m.end()
                    yield number, n, start, stop
                    n += 1

"""Cheapest repairs of role sequences: Re-Pair rules with one min-plus transfer matrix each."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import cache

import numpy as np

#: What a row is for its repair: its role's initial (``o``: any other), in lower case if the text is cut off;
#: ``b`` is a blank row and ``d`` a repeated one, which have to go.
MARKS = "SUAOsuaobd"
#: Costs of the edits, and of a cut-off row that stays.
INSERT, REROLE, DELETE, CUT_OFF = 3, 3, 4, 3

#: States of ``(s?(ua)+)?``: nothing yet, after ``s``, after ``u``, after ``a``.
STATES = 4
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
#: The role that an insert or a new role has in each state.
EXPECTED = ("u", "u", "a", "u")
#: Roles to insert at the end in each state.
CLOSING = ("", "ua", "a", "")

#: Rules of a grammar at most, and uses that a new one must have. What is left is multiplied as it stands.
MAX_RULES, LEAST_USES = 4096, 4
#: Symbols that share one grammar at most.
BATCH = 1_000_000

# An audit is a rope: a string, or a pair of ropes. An entry of a matrix is a cost and a rope, or None.
Rope = object
Entry = tuple[int, Rope] | None
Matrix = tuple[tuple[Entry, ...], ...]


def spelled(rope: Rope) -> str:
    """The letters of a rope."""
    parts, open_ = [], [rope]
    while open_:
        rope = open_.pop()
        if isinstance(rope, str):
            parts.append(rope)
        else:
            open_.extend((rope[1], rope[0]))
    return "".join(parts)


def least(entries: Iterable[Entry]) -> Entry:
    """The cheapest entry, among equal ones that with the least letters."""
    found = [x for x in entries if x is not None]
    if not found:
        return None
    cost = min(x[0] for x in found)
    tied = [x for x in found if x[0] == cost]
    return tied[0] if len(tied) == 1 else min(tied, key=lambda x: spelled(x[1]))


def product(left: Matrix, right: Matrix) -> Matrix:
    """Edits by ``left`` and then by ``right``."""
    joined = lambda x, y: None if x is None or y is None else (x[0] + y[0], (x[1], y[1]))
    return tuple(
        tuple(least(joined(left[i][k], right[k][j]) for k in range(STATES)) for j in range(STATES)) for i in range(STATES)
    )


def _matrix(entries: Iterable[tuple[int, int, int, str]]) -> Matrix:
    found: dict[tuple[int, int], list[Entry]] = {}
    for i, j, cost, letters in entries:
        found.setdefault((i, j), []).append((cost, letters))
    return tuple(tuple(least(found.get((i, j), ())) for j in range(STATES)) for i in range(STATES))


@cache
def row_matrix(mark: str) -> Matrix:
    """Any inserts, then the edit of one row. Inserts at the very end are left to :data:`CLOSING`, so all audits between two
    states over the same rows end with a row's letter, and no audit is the beginning of another as cheap one."""
    inserts = [(i, i, 0, "") for i in range(STATES)]
    for i in range(STATES):
        state, letters = i, ""
        for _ in range(2):
            state, letters = _NEXT[state, EXPECTED[state]], letters + "I"
            inserts.append((i, state, INSERT * len(letters), letters))
    edits = [(i, i, DELETE, "D") for i in range(STATES)]
    if mark not in "bd":
        role, extra = mark.lower(), CUT_OFF if mark.islower() else 0
        for (i, initial), j in _NEXT.items():
            if initial == role:
                edits.append((i, j, extra, "K"))
            if initial != "s":
                edits.append((i, j, REROLE + extra, "R"))
    return product(_matrix(inserts), _matrix(edits))


def re_pair(sequences: Sequence[str], max_rules: int = MAX_RULES, least_uses: int = LEAST_USES) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Rules and the shortened sequences. Symbols below ``len(MARKS)`` are marks, rule k makes the symbol ``len(MARKS) + k``.

    Each round replaces the most frequent pair of neighbours, and with it the next frequent pairs that have no symbol in common with those chosen before.
    """
    codes = np.frombuffer("\n".join([*sequences, ""]).encode(), dtype=np.uint8)
    table = np.full(256, -1, dtype=np.int64)
    table[[ord(c) for c in MARKS]] = np.arange(len(MARKS))
    text = table[codes]
    rules: list[tuple[int, int]] = []
    while len(rules) < max_rules:
        size = len(MARKS) + len(rules)
        left, right = text[:-1], text[1:]
        pairs, uses = np.unique((left * size + right)[(left >= 0) & (right >= 0)], return_counts=True)
        order = np.argsort(-uses, kind="stable")
        made = np.full(size, -1, dtype=np.int64)  # by left symbol: the new symbol
        mate = np.full(size, -2, dtype=np.int64)
        taken: set[int] = set()
        for k in order[: 4 * size]:
            x, y = divmod(int(pairs[k]), size)
            if uses[k] < least_uses or len(rules) == max_rules:
                break
            if x in taken or y in taken:
                continue
            taken |= {x, y}
            made[x], mate[x] = len(MARKS) + len(rules), y
            rules.append((x, y))
        if not taken:
            break
        here = (left >= 0) & (mate[left] == right)
        # In a run of one symbol every second pair is replaced.
        places = np.arange(len(here))
        starts = np.maximum.accumulate(np.where(here & ~np.append(False, here[:-1]), places, 0))
        here &= (left != right) | ((places - starts) % 2 == 0)
        text = text.copy()
        text[:-1][here] = made[left[here]]
        text = np.delete(text, np.flatnonzero(here) + 1)
    ends = np.flatnonzero(text < 0)
    return rules, [part[:-1].tolist() for part in np.split(text, ends + 1)[: len(sequences)]]


def transfer_matrices(sequences: Sequence[str], **options) -> list[Matrix]:
    """One matrix per (not empty) sequence of marks; each rule's matrix is made once, from those of its two symbols."""
    rules, shortened = re_pair(sequences, **options)
    of = [row_matrix(mark) for mark in MARKS]
    for x, y in rules:
        of.append(product(of[x], of[y]))
    found = []
    for symbols in shortened:
        matrix = of[symbols[0]]
        for symbol in symbols[1:]:
            matrix = product(matrix, of[symbol])
        found.append(matrix)
    return found


def closing_cost(state: int) -> int:
    return INSERT * len(CLOSING[state])


def actions(audit: str, marks: str, state: int, last: bool) -> tuple[list[str], int]:
    """Per row its edits with the roles that they give, like ``IuIaKu``, and the state after them.

    The inserts that close a conversation follow its ``last`` row's edits.
    """
    found, written, row = [], "", 0
    for letter in audit:
        if letter == "D":
            written += "D"
        else:
            role = marks[row].lower() if letter == "K" else EXPECTED[state]
            state = _NEXT[state, role]
            written += letter + role
        if letter != "I":
            found.append(written)
            written, row = "", row + 1
    if last:
        found[-1] += "".join("I" + role for role in CLOSING[state])
    return found, state

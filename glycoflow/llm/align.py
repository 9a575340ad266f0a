"""Wagner-Fischer alignment of turns to alternating role strings.

Target strings are s?(ua)*. A string of one start is a prefix of every longer one, so the last row of one table holds the
costs of all its lengths. Only cells within Ukkonen's band are filled: an alignment of cost C strays at most C / 2
below the diagonal (a deletion costs 2) and C / 5 above it (an insertion costs 5), and the first alignment found sets C.

A stretch of turns is aligned from any state of the string to any other, so that long conversations are aligned in
blocks. Insertions belong to the turn that follows them; hence no audit of a stretch is the beginning of another one, and
the least audit of a conversation consists of least audits of its blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What closes a conversation in each state: insertions, as audit and as cost.
TAILS = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
NEVER = 1 << 60
NAMES = {"u": "user", "a": "assistant"}


@dataclass
class Turn:
    """Initial of the role, whether the turn has to go, and what keeping it costs."""

    initial: str
    gone: bool
    extra: int


def symbol(state: int, system: bool, at: int) -> str:
    """Target symbol at a place (from 0) of the string that follows a state."""
    if system:
        return "s" if at == 0 else "ua"[(at - 1) % 2]
    return "ua"[(at + (state == USER)) % 2]


def table(turns: list[Turn], targets: str, limit: int) -> tuple[list[dict[int, int]], list[dict[int, int]]]:
    """Costs within the band of a limit: for each number of turns and of target symbols, at all, and where the last
    edit is one of a turn."""
    below, above = limit // DELETE, limit // INSERT
    row = {0: 0}
    for j in range(1, min(above, len(targets)) + 1):
        if targets[j - 1] == "s":
            break
        row[j] = row[j - 1] + INSERT
    costs, ends = [row], [{}]
    for i, turn in enumerate(turns, start=1):
        last, row, end = row, {}, {}
        for j in range(max(0, i - below), min(len(targets), i + above) + 1):
            cost = last.get(j, NEVER) + DELETE
            if j and not turn.gone:
                wanted = targets[j - 1]
                edit = KEEP if turn.initial == wanted else REROLE if wanted != "s" else NEVER
                cost = min(cost, last.get(j - 1, NEVER) + edit + turn.extra)
            if cost < NEVER:
                end[j] = cost
            if j and targets[j - 1] != "s":
                cost = min(cost, row.get(j - 1, NEVER) + INSERT)
            if cost < NEVER:
                row[j] = cost
        costs.append(row)
        ends.append(end)
    return costs, ends


def least_audit(turns: list[Turn], targets: str, costs: list[dict[int, int]], ends: list[dict[int, int]], length: int) -> str:
    """Backtrace: of the cheapest alignments to ``length`` symbols, that of the least audit in ASCII order."""
    edges: dict[tuple[int, int], dict[str, tuple[int, int]]] = {}
    n = len(turns)
    on = {length}
    for i in range(n, 0, -1):
        turn, before = turns[i - 1], set()
        for j in range(max(on), -1, -1):
            if j not in on:
                continue
            cost = ends[i].get(j, NEVER)
            if i < n and j - 1 in costs[i] and targets[j - 1] != "s" and costs[i][j] == costs[i][j - 1] + INSERT:
                edges.setdefault((i, j - 1), {})["I"] = (i, j)
                on.add(j - 1)
            if i < n and cost != costs[i][j]:
                continue
            if costs[i - 1].get(j, NEVER) + DELETE == cost:
                edges.setdefault((i - 1, j), {})["D"] = (i, j)
                before.add(j)
            if j and not turn.gone and j - 1 in costs[i - 1]:
                wanted = targets[j - 1]
                kept = turn.initial == wanted
                if (kept or wanted != "s") and costs[i - 1][j - 1] + (KEEP if kept else REROLE) + turn.extra == cost:
                    edges.setdefault((i - 1, j - 1), {})["K" if kept else "R"] = (i, j)
                    before.add(j - 1)
        on = before
    for j in range(max(on, default=0), 0, -1):
        edges.setdefault((0, j - 1), {})["I"] = (0, j)
    at, audit = (0, 0), []
    while at != (n, length):
        letter = min(edges[at])
        audit.append(letter)
        at = edges[at][letter]
    return "".join(audit)


def exits(turns: list[Turn], state: int) -> dict[int, tuple[int, str]]:
    """The least cost and, of that cost, the least audit to every state that can be reached from one; at least one turn."""
    n = len(turns)
    out = {state: (DELETE * n, "D" * n)}
    starts = [False]
    if state == START:
        alone = [(DELETE * (n - 1) + t.extra, -i) for i, t in enumerate(turns) if t.initial == "s" and not t.gone]
        if alone:
            cost, at = min(alone)
            out[SYSTEM] = (cost, "D" * -at + "K" + "D" * (n - 1 + at))
            starts.append(True)
    limit = DELETE * sum(t.gone or t.extra > 0 for t in turns) + 2 * INSERT - DELETE
    while True:
        found: dict[int, list] = {USER: [], ASSISTANT: []}
        reach = n + limit // INSERT
        for system in starts:
            targets = "".join(symbol(state, system, j) for j in range(reach))
            costs, ends = table(turns, targets, limit)
            for length, cost in ends[n].items():
                if length > system:
                    found[USER if targets[length - 1] == "u" else ASSISTANT].append((cost, targets, costs, ends, length))
        incumbent = max(min((x[0] for x in found[s]), default=NEVER) for s in found)
        if incumbent <= limit:
            break
        # An alignment found in a narrow band bounds the cost; without one, the band is doubled.
        limit = incumbent if incumbent < NEVER else 2 * limit
    for s, ways in found.items():
        cost = min(x[0] for x in ways)
        audits = [least_audit(turns, *x[1:]) for x in ways if x[0] == cost]
        have = out.get(s)
        if have is not None and have[0] <= cost:
            if have[0] < cost:
                continue
            audits.append(have[1])
        out[s] = (cost, min(audits))
    return out


def repaired(rows: list[tuple[str, str]], audit: str, state: int) -> list[str]:
    """``role:text`` of what an audit leaves of rows (role, text), from a state."""
    out = []
    at = 0
    for letter in audit:
        expected = "a" if state == USER else "u"
        if letter == "D":
            at += 1
            continue
        if letter == "I":
            role, text = NAMES[expected], ""
        else:
            role, text = rows[at]
            at += 1
            if letter == "R":
                role = NAMES[expected]
            elif role[:1] == "s":
                state = SYSTEM
                out.append(f"{role}:{text}")
                continue
        state = USER if expected == "u" else ASSISTANT
        out.append(f"{role}:{text}")
    return out


def whole(turns: list[Turn]) -> tuple[int, str]:
    """Cost and least audit of a conversation of one block."""
    initials = "".join(t.initial for t in turns)
    plain = initials[1:] if initials[:1] == "s" else initials
    if plain and plain == "ua" * (len(plain) // 2) and not any(t.gone or t.extra for t in turns):
        return 0, "K" * len(turns)
    if not turns:
        return 0, ""
    return min((cost + INSERT * len(TAILS[s]), audit + TAILS[s]) for s, (cost, audit) in exits(turns, START).items())

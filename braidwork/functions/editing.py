"""Edit distance by furthest-reaching diagonals, with extension, band and traceback."""

from __future__ import annotations

from dataclasses import dataclass

#: Operations of an alignment and their letters.
EQUAL, DIFFER, INSERT, DELETE = "=", "X", "I", "D"


@dataclass
class Alignment:
    """Edits, how far target and query were read, and the operations (length, letter) if asked for."""

    score: int
    target_end: int
    query_end: int
    cigar: list[tuple[int, str]] | None = None


def align(target: str, query: str, extend: bool = False, band: int | None = None, trace: bool = False) -> Alignment | None:
    """Fewest substitutions, insertions and deletions from target to query; None beyond ``band``.

    With ``extend`` the alignment ends as soon as either sequence does. An insertion is a
    letter of the query that the target lacks. Time grows with length times score.
    """
    n, m = len(target), len(query)
    # reach[d]: letters of the target read on diagonal d = target place - query place.
    reach = {0: 0}
    history: list[dict[int, int]] = []
    score = 0
    while True:
        done = None
        for d, i in reach.items():
            j = i - d
            while i < n and j < m and target[i] == query[j]:
                i, j = i + 1, j + 1
            reach[d] = i
            if (i == n and j == m) or (extend and (i == n or j == m)):
                if done is None or i + j > done[0]:
                    done = (i + j, d)
        history.append(dict(reach))
        if done is not None:
            d = done[1]
            i = reach[d]
            return Alignment(score, i, i - d, _trace(history, d, i) if trace else None)
        score += 1
        if band is not None and score > band:
            return None
        new: dict[int, int] = {}
        for d, i in reach.items():
            for e, x in ((d, i + 1), (d + 1, i + 1), (d - 1, i)):  # substitution, deletion, insertion
                if x <= n and x - e <= m and x - e >= 0 and new.get(e, -1) < x:
                    new[e] = x
        reach = new
        if not reach:
            return None


def _trace(history: list[dict[int, int]], d: int, i: int) -> list[tuple[int, str]]:
    ops: list[tuple[int, str]] = []

    def put(n: int, op: str) -> None:
        if n:
            if ops and ops[-1][1] == op:
                ops[-1] = (ops[-1][0] + n, op)
            else:
                ops.append((n, op))

    for s in range(len(history) - 1, -1, -1):
        if s == 0:
            put(i, EQUAL)
            break
        before = history[s - 1]
        options = [(before[e] + step, e, op) for e, step, op in ((d, 1, DIFFER), (d - 1, 1, DELETE), (d + 1, 0, INSERT)) if e in before]
        start, e, op = max((x for x in options if x[0] <= i), key=lambda x: x[0])
        put(i - start, EQUAL)
        put(1, op)
        i, d = before[e], e
    return ops[::-1]


def cigar_text(cigar: list[tuple[int, str]]) -> str:
    return "".join(f"{n}{op}" for n, op in cigar)


def render(target: str, query: str, cigar: list[tuple[int, str]], width: int = 60) -> str:
    """Target, marks and query in lines of ``width``; '|' equal, '*' different, ' ' beside a gap."""
    rows, i, j = ["", "", ""], 0, 0
    for n, op in cigar:
        t = target[i : i + n] if op != INSERT else "-" * n
        q = query[j : j + n] if op != DELETE else "-" * n
        rows[0] += t
        rows[1] += {EQUAL: "|", DIFFER: "*"}.get(op, " ") * n
        rows[2] += q
        i += n if op != INSERT else 0
        j += n if op != DELETE else 0
    at = range(0, max(len(rows[0]), 1), width)
    return "\n\n".join("\n".join(r[x : x + width] for r in rows) for x in at)

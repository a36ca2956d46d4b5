"""Cheapest edits that make role sequences regular, by tables over blocks of rows.

A conversation is regular when its role initials are nothing, or an optional s and then
one or more pairs ua. Rows are kept, given another role or deleted, and empty rows are
inserted. From the end of a conversation backward, the costs that lie ahead form a
vector over four states; less its minimum it is one of a few vectors. Tables made once
tell, for every such vector behind a block of BLOCK rows and every block of row kinds,
the vector before it and what was added to the minimum. So a block costs one lookup, and
only for the edits themselves blocks are expanded, backward for the costs and forward for
the letters: the first letter in ASCII order that stays on a cheapest path.
"""

from functools import lru_cache
from itertools import product

BLOCK = 4
KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 1, 2, 5, 5
FAR = 1 << 60

# States: nothing yet, after s, after u, after a pair. What a user or assistant row leads to.
START, SYSTEM, USER, PAIR = range(4)
SPEAKS = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", PAIR), PAIR: ("user", USER)}
# Row kinds: initial s, u, a or other; the same for rows that are cut off; rows to delete; no row.
INITIALS = 4
GONE, NOTHING = 2 * INITIALS, 2 * INITIALS + 1
KINDS = NOTHING + 1
_TO = [{START: SYSTEM}, {START: USER, SYSTEM: USER, PAIR: USER}, {USER: PAIR}, {}]


def inserted(costs):
    """Costs ahead when rows may be inserted first."""
    a, s, u, p = costs
    u, p = min(u, p + INSERT), min(p, u + INSERT)
    return (min(a, u + INSERT), min(s, u + INSERT), u, p)


END = inserted((0, FAR, FAR, 0))


def before_row(kind, ahead):
    """Costs ahead before a row, from those behind it."""
    if kind == NOTHING:
        return ahead
    costs = [min(c + DELETE, FAR) for c in ahead]
    if kind != GONE:
        extra = BROKEN * (kind >= INITIALS)
        for state in range(4):
            costs[state] = min(costs[state], ahead[SPEAKS[state][1]] + REROLE + extra)
            if state in _TO[kind % INITIALS]:
                costs[state] = min(costs[state], ahead[_TO[kind % INITIALS][state]] + KEEP + extra)
    return inserted([min(c, FAR) for c in costs])


def lessened(costs):
    """(costs less their minimum, the minimum)."""
    least = min(costs)
    return tuple(c if c >= FAR else c - least for c in costs), least


class Tables:
    """All cost vectors that can occur, and what a block of rows makes of each."""

    def __init__(self):
        units = [tuple(0 if i == e else FAR for i in range(4)) for e in range(4)]
        self.vectors, self.number, one = [], {}, []
        for v in [lessened(END)[0], *units]:
            self._known(v)
        at = 0
        while at < len(self.vectors):
            row = []
            for kind in range(KINDS):
                v, least = lessened(before_row(kind, self.vectors[at]))
                row.append((self._known(v), least))
            one.append(row)
            at += 1
        self.one = one
        # Entry b of a vector's row: block b, whose first row is the highest digit in base KINDS.
        self.blocks = []
        for v in range(len(self.vectors)):
            row = []
            for kinds in product(range(KINDS), repeat=BLOCK):
                now, total = v, 0
                for kind in reversed(kinds):
                    now, least = one[now][kind]
                    total += least
                row.append((now, total))
            self.blocks.append(row)

    def _known(self, v):
        if v not in self.number:
            self.number[v] = len(self.vectors)
            self.vectors.append(v)
        return self.number[v]

    def behind(self, blocks, last):
        """(vector behind each block, vector before the first, sum of what was taken off)."""
        found, total = [0] * len(blocks), 0
        for i in range(len(blocks) - 1, -1, -1):
            found[i] = last
            last, least = self.blocks[last][blocks[i]]
            total += least
        return found, last, total

    def passage(self, blocks):
        """16 numbers: costs from each state before the blocks to each state behind them."""
        columns = []
        for e in range(4):
            _, first, total = self.behind(blocks, 1 + e)
            columns.append([c if c >= FAR else c + total for c in self.vectors[first]])
        return [columns[e][s] for s in range(4) for e in range(4)]

    @lru_cache(1 << 16)  # noqa: B019 - one instance per worker
    def edits(self, last, block, state):
        """(edits of each row of a block, state behind it); an edit is a letter and the role it gives."""
        kinds = []
        for _ in range(BLOCK):
            block, kind = divmod(block, KINDS)
            kinds.append(kind)
        kinds.reverse()
        ahead = [self.vectors[last]]
        for kind in reversed(kinds):
            ahead.append(before_row(kind, ahead[-1]))
        ahead.reverse()
        rows = []
        for kind, here, behind in zip(kinds, ahead, ahead[1:]):
            row = []
            while kind != NOTHING:
                role, spoken = SPEAKS[state]
                extra = BROKEN * (INITIALS <= kind < GONE)
                kept = _TO[kind % INITIALS].get(state) if kind != GONE else None
                if behind[state] + DELETE == here[state]:
                    row.append(("D", None))
                    break
                if here[spoken] + INSERT == here[state]:
                    row.append(("I", role))
                    state = spoken
                elif kept is not None and behind[kept] + KEEP + extra == here[state]:
                    row.append(("K", None))
                    state = kept
                    break
                else:
                    row.append(("R", role))
                    state = spoken
                    break
            rows.append(tuple(row))
        return tuple(rows), state

    def trace(self, blocks, last, state):
        """(edits row by row, state behind the rows): the ASCII-least of the cheapest."""
        rows = []
        for block, behind in zip(blocks, self.behind(blocks, last)[0]):
            found, state = self.edits(behind, block, state)
            rows.extend(found)
        return rows, state

    def closing(self, state):
        """Edits behind the last row of a conversation."""
        found = []
        while state in (SYSTEM, USER):
            role, state = SPEAKS[state]
            found.append(("I", role))
        return found


@lru_cache(1)
def tables():
    """One set of tables per Python worker."""
    return Tables()


def blocks_of(kinds):
    """Numbers of the blocks of a list of row kinds; the last one is filled with no rows."""
    found = []
    for i in range(0, len(kinds), BLOCK):
        number = 0
        for kind in kinds[i:i + BLOCK]:
            number = number * KINDS + kind
        found.append(number)
    if len(kinds) % BLOCK:
        for _ in range(BLOCK - len(kinds) % BLOCK):
            found[-1] = found[-1] * KINDS + NOTHING
    return found


def before(passage, ahead):
    """Costs ahead before a segment, from its passage and the costs behind it."""
    return [min(min(passage[4 * s + e] + ahead[e] for e in range(4)), FAR) for s in range(4)]
